"""Plain single-process versions of what the operators compute, written without their code."""

from __future__ import annotations

import math
import random

import zstandard

GONE = {"nav", "header", "footer", "aside", "form"}
BLOCK = {"div", "p", "ul", "li", "section", "article", "h1", "table", "tr", "td", *GONE}
WORDS = "ant bee cat dog elk fox gnu hen ibis jay".split()


def random_page(rng: random.Random, depth: int = 0, tag: str = "body", clean: bool = True) -> tuple:
    """(tag, classes, children), children being texts or elements; texts and links lie in blocks of their own. An article lies in no container of furniture, which it would be taken to end."""
    classes = rng.choice(["", "", "", "ad", "related-work", "comments", "notice", "site-header", "story", "content"]) if tag in ("div", "section", "p", "li") else ""
    if tag in ("p", "li", "h1"):
        kids: list = []
        for _ in range(rng.randrange(1, 4)):
            words = " ".join(rng.choices(WORDS, k=rng.choice([1, 3, 30])))
            kids.append(("a", "", [words]) if rng.random() < 0.3 else ("b", "", [words]) if rng.random() < 0.3 else words)
        return tag, classes, kids
    inner = ["p", "p", "p", "h1"] + (["div", "section", "nav", "aside", "article", "ul"] if depth < 3 else [])
    if tag == "ul":
        inner = ["li"]
    clean = clean and classes not in ("ad", "comments", "notice", "site-header") and tag not in GONE
    if not clean:
        inner = [t for t in inner if t != "article"]
    return tag, classes, [random_page(rng, depth + 1, rng.choice(inner), clean) for _ in range(rng.randrange(1, 7))]


def as_html(node) -> str:
    if isinstance(node, str):
        return node + " "
    tag, classes, kids = node
    return f"<{tag}{f' class={chr(34)}{classes}{chr(34)}' if classes else ''}>{''.join(map(as_html, kids))}</{tag}>"


def page_text(root) -> str:
    """The main text of a random page, straight from its tree."""
    lines: list = []

    def leaves(node, in_link):
        if isinstance(node, str):
            yield node, in_link
        else:
            for kid in node[2]:
                yield from leaves(kid, in_link or node[0] == "a")

    def walk(node, weight, inside):
        tag, classes, kids = node
        if tag in GONE:
            weight = 0
        elif classes == "ad" or not (inside and tag in ("p", "li")) and classes in ("comments", "notice", "site-header"):
            weight = 0
        elif classes == "related-work" and not inside:
            weight = min(weight, 0.25)
        inside = inside or tag == "article" and weight > 0
        if inside and weight:
            weight = 1
        if tag in ("p", "li", "h1"):
            texts = list(leaves(node, False))
            lines.append((" ".join(t for t, _ in texts), sum(len(t) for t, link in texts if link), weight, inside))
        else:
            for kid in kids:
                walk(kid, weight, inside)

    walk(root, 1, False)
    inner = [10 * len(t) if inside and w else 0 for t, _, w, inside in lines]
    outer = [w * (len(t) - links) if not inside and links < 0.8 * len(t) else 0 for t, links, w, inside in lines]
    windows = [[sum(w[i : i + 3]) for i in range(len(w))] for w in (inner, outer)]
    most = [max(w, default=0) for w in windows]
    kept = set()
    for w, sums, surge in ((inner, windows[0], 0 if most[0] >= most[1] else max(most) / 5), (outer, windows[1], max(most) / 5)):
        for i in range(len(w)):
            if sums[i] > surge:
                lo, hi = i, i
                while lo and w[lo - 1] > 0:
                    lo -= 1
                while hi < len(w) and sums[hi] > 0:
                    hi += 1
                kept.update(j for j in range(lo, hi) if w[j] > 0)
    return "\n".join(lines[i][0] for i in sorted(kept))


def coder(dictionary: bytes, level: int, chunk: int):
    params = zstandard.ZstdCompressionParameters.from_level(level, source_size=chunk, dict_size=len(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)


def language(dictionaries: dict[str, list[bytes]], text: str | None) -> tuple[str, bool]:
    """Language and rejection of one text under the dictionaries of each language."""
    if not any(c.isalpha() for c in text or "") or not dictionaries:
        return "und", True
    data, sizes = text.lower().encode("utf-8", "replace"), {}
    for name, several in dictionaries.items():
        c = coder(several[0], 6, 4096)
        sizes[name] = sum(len(c.compress(data[i : i + 4096])) for i in range(0, len(data), 4096))

    def margin() -> float:
        a, b = sorted(sizes.values())[:2]
        return (b - a) / b

    if len(sizes) > 1 and margin() < 0.04:
        for name, several in dictionaries.items():
            costs = []
            for d in several:
                c, before = coder(d, 12, 4096), d[-300:]
                for i in range(0, len(data), 3796):
                    costs.append(len(c.compress(before + b" " + data[i : i + 3796])) - len(c.compress(before)))
            sizes[name] = max(1.0, sum(costs) / len(several))
    return min(sizes, key=lambda n: (sizes[n], n)), len(sizes) > 1 and margin() < 0.002


def signs(data: bytes) -> bytes:
    """Runs of small letters, runs of capitals and digits as one sign each kind."""
    out = []
    for c in data:
        k = "a" if c >= 128 or chr(c).islower() else "A" if chr(c).isupper() else "0" if chr(c).isdigit() else " " if c in b"\t\r" else chr(c)
        if k not in "aA" or not out or out[-1] != k:
            out.append(k)
    return "".join(out).encode()


def quality(dictionaries: list[bytes], weights: list[float], text: str | None) -> float:
    """The score of one text under the dictionaries (bad, good, bad shape, good shape) and weights of the model."""
    data = (text or "").encode("utf-8", "replace")
    form = signs(data)
    bad, good, bad_form, good_form = (sum(len(coder(d, 6, 2048).compress(x[i : i + 2048])) for i in range(0, len(x), 2048)) for d, x in zip(dictionaries, (data, data, form, form)))
    a, s = (5 * max(-0.6, min(0.6, (x - y) / (x + y + 8))) for x, y in ((bad, good), (bad_form, good_form)))
    left, form_left = min(1, good / max(1, len(data))), min(1, (good_form + 1) / (len(form) + 1))
    soft = math.exp(-12 * left)
    z = sum(w * x for w, x in zip(weights, (1, math.log(left + 0.01), soft, a, a * soft, s, s * soft, math.log(form_left + 0.01))))
    return 1 / (1 + math.exp(-z))
