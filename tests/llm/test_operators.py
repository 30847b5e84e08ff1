"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows, clashing columns and no rows, against plain versions."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int, kind: str = "en") -> str:
    rng = random.Random(f"{kind}{seed}")
    parts = {"en": "the of and th ing er on an in re", "de": "der die sch ung keit ein ver ä zu be", "fr": "le eux ment tion é que ai oi re pa"}[kind].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def rows():
    out = [(i, words(i, 30 + i % 50, ("en", "de", "fr")[i % 3]), ("en", "de", "fr")[i % 3], "big" if i % 2 else f"s{i % 7}", 0) for i in range(120)]
    out += [(200, None, "en", "big", 0), (201, "", None, None, 0), (202, "   \n ", "en", "s1", 0), (203, "12 34", "en", "s1", 0), (204, words(9, 20000), "en", "big", 0)]
    out += [(205, out[5][1], "en", "big", 0), (205, out[5][1], "en", "big", 0), (206, "a<|endoftext|>b  c\n\n d\x1ce", "en", None, 0), (None, "lost id", "en", "s2", 0)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = "r", "sk", "key", "part", "id", "text_crc32", "n"
    df = spark.createDataFrame(rows, DOC)
    return df.withColumns({c: F.lit(i) for i, c in enumerate(extra)}).withColumn("a.b", F.lit(1)).repartition(3)


def empty(docs):
    return docs.where("false")


def test_ring_counts_slots_and_order(spark, docs, rows):
    from spanweave.llm.sharding import ring_shards

    got = ring_shards(docs, 7).collect()
    assert len(got) == len(rows)
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(n))
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert ring_shards(empty(docs), 7).count() == 0


def test_ring_moves_little_when_it_grows(spark):
    from spanweave.llm.sharding import ring_shards

    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    a = {r["doc_id"]: r["shard"] for r in ring_shards(df, 10, slack=0.25).collect()}
    b = {r["doc_id"]: r["shard"] for r in ring_shards(df, 11, slack=0.25).collect()}
    assert sum(a[k] != b[k] for k in a) < 0.35 * len(a)
    assert max(Counter(b.values()).values()) <= math.ceil(4000 * 1.25 / 11)


def test_sweep_against_one_row_at_a_time():
    from spanweave.llm.sharding import sweep

    rng = random.Random(3)
    for _ in range(50):
        owners = [rng.randrange(5) for _ in range(20)] + list(range(5))
        counts = {(a, p): rng.randrange(6) for a in range(len(owners)) for p in range(2)}
        n = sum(counts.values())
        room = [n // 5 + (s < n % 5) for s in range(5)]
        want, free = [], list(room)
        for (arc, part), c in sorted(counts.items()):
            for i in range(c):
                a = arc
                while not free[owners[a]]:
                    a = (a + 1) % len(owners)
                free[owners[a]] -= 1
                want.append((arc, part, i, owners[a]))
        got = [(x["arc"], x["part"], i, x["shard"]) for x in sweep(counts, owners, room) for i in range(x["lo"], x["hi"])]
        assert sorted(got) == want


def test_mixing_weights_and_whole_documents(spark, docs, rows):
    from spanweave.llm.mixing import mix

    got = mix(docs, max_repeat=2.0).select("r.doc_id", "source", "n_tokens", "weight", "copy", "r.`a.b`").collect()
    drawn = Counter(r["doc_id"] for r in got)
    assert set(drawn) == {r[0] for r in rows}
    assert max(Counter((r["doc_id"], r["copy"]) for r in got if r["doc_id"] != 205).values()) == 1
    assert max(r["copy"] for r in got) <= 2
    weight = {r["source"]: r["weight"] for r in got}
    assert sum(weight.values()) == pytest.approx(1, abs=1e-6)
    want = Counter()
    for _, t, _, s, _ in rows:
        want[s] += len((t or "").split())
    most = max(want.values())
    passes = {s: weight[s] / want[s] / (weight["big"] / most) for s in want if want[s]}
    assert max(passes.values()) <= 2.001
    assert mix(empty(docs)).count() == 0
    assert mix(spark.createDataFrame([(1, None, None, "x", 0)], DOC)).count() == 1


def test_mixing_budget_and_entropy(spark):
    from spanweave.llm.mixing import mix

    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one two three four").alias("text"), F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, "mid").otherwise("low").alias("source"))
    got = mix(df, max_repeat=None, entropy=0.9, budget_tokens=8000).groupBy("source").agg(F.sum("n_tokens").alias("n"), F.max("weight").alias("w")).collect()
    w = {r["source"]: r["w"] for r in got}
    assert -sum(x * math.log(x) for x in w.values()) / math.log(3) == pytest.approx(0.9, abs=1e-3)
    assert all(abs(r["n"] - 8000 * r["w"]) < 100 for r in got)


def test_token_counts_equal_the_tokenizer(spark, docs, rows):
    from spanweave.llm.tokens import count_tokens, pieces, slices

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in count_tokens(docs, path).collect())
    want = Counter((i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False)), n > 512) for i, t, *_ in rows)
    assert got == want
    assert count_tokens(empty(docs), path).count() == 0
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["a", "Été", " ", "  ", "\n", "\t", "'s", "12", "!?", " ", " ", "漢", "\x1c", "don't", "\U0001f600"]) for _ in range(rng.randrange(40)))
        assert "".join(pieces(text)) == text and "".join(slices(text, 7)) == text
        assert sum(len(tok.encode(p, add_special_tokens=False)) for s in slices(text, 7) for p in pieces(s)) == len(tok.encode(text, add_special_tokens=False)), repr(text)


def test_packing_round_trip(spark, docs, rows):
    from spanweave.llm.packing import pack

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    got = pack(docs, path).collect()
    ids = [(i, np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")) for i, t, *_ in rows]
    want = Counter((i, len(a)) for i, a in ids)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for i, a in ids:
        pieces = {(r["start"], r["length"], r["ids_crc32"]) for r in by[i]}
        assert all(zlib.crc32(a[s : s + n].tobytes()) == c for s, n, c in pieces)
        assert sum(n for _, n, _ in pieces) == len(a) and sum(r["length"] for r in by[i]) == len(a) * want[(i, len(a))]
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    padding = 0
    for pieces in bins.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 2048
        padding += 2048 - at if at & (at - 1) else 0
    assert padding < 4096
    assert pack(empty(docs), path).count() == 0


PAGE = """<html><head><title>T</title><style>x</style><script>var a="</p>";</script></head><body class="no-sidebar"><nav><a href=/>Home</a></nav><div class="cookie-notice">We use
cookies</div><!-- <p>no</p> --><article><h1>Head &amp; line</h1><p>One <b>bold</b>
 text<p>Two&nbsp;&#233;<div class="ad">Buy now</div><ul><li>x</li><li><a href=#>y</a></li></ul><form><p>Mail</p></form></article><aside>Side</aside><section id="comments"><article><p>Nice</p></article></section><footer>Foot</footer></body>"""


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("plain &lt;b&gt;", "plain <b>"),
        (PAGE, "Head & line\nOne bold text\nTwo é\nx\ny"),
        ("<div class=ad>unclosed<article><p>Kept</p></article>", "Kept"),
        ("<body><div><a href=1>menu one</a> <a href=2>menu two</a></div><p>" + "long text " * 30 + "</p><p>short</p><div id=footer>f</div>", " ".join(["long text"] * 30) + "\nshort"),
        ("<nav>only</nav>", ""),
        ("<p>x<!-- never closed", "x"),
        ("<p hidden>no</p><p>yes</p>", "yes"),
        ("<div class=top>Site name here</div><div id=content><p>Only this</p><div class='share-box'>Share</div></div><div>More on the site</div>", "Only this"),
        ("<p>" + "first part " * 20 + "</p><div class=ad><p>a</p><p>b</p><p>c</p><p>d</p></div><p>" + "second part " * 20 + "</p>", " ".join(["first part"] * 20) + "\n" + " ".join(["second part"] * 20)),
    ],
)
def test_main_text(html, text):
    from spanweave.llm.html import main_text

    assert main_text(html) == text


def test_pages_table(spark):
    from spanweave.llm.html import extract_main_text

    df = spark.createDataFrame([(1, "u", PAGE, "z"), (1, "u", PAGE, "z"), (None, None, None, "z"), (3, "v", "<p>" + "é " * 50000, "z")], "page_id long, url string, html string, text string")
    got = extract_main_text(df).collect()
    assert sorted(r["n_chars"] for r in got) == sorted([len("Head & line\nOne bold text\nTwo é\nx\ny")] * 2 + [0, 99999])
    assert extract_main_text(df.where("false")).count() == 0


def test_languages_held_out(spark, docs, rows):
    from spanweave.llm.langid import identify_languages

    got = identify_languages(docs).select("r.doc_id", "r.text", "r.lang", "held_out", "lang_pred", "score", "rejected").collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 200]
    assert held and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    for r in got:
        assert 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in r["text"] or ""):
            assert r["lang_pred"] == "und" and r["rejected"]
    assert identify_languages(empty(docs)).count() == 0
    assert {r["lang_pred"] for r in identify_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_quality_held_out(spark):
    from spanweave.llm.quality import score_quality

    rows, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        text = words(i, 60)
        rows.append((i, " ".join(w.upper() + "!!" for w in text.split()) if bad else text, "en", "s", 0))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(9001, None, "en", "s", 0), (9002, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOC).withColumn("score", F.lit(7))
    lab = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in score_quality(docs, lab).select("r.doc_id", "held_out", "score", "predicted").collect()}
    held = [i for i, q, _ in labels if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == (i % 3 != 0) for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == len(rows)
    assert {r["score"] for r in score_quality(docs, lab.where("false")).collect()} == {0.5}
    assert score_quality(docs.where("false"), lab).count() == 0


def jaccard(a: str, b: str) -> float:
    def bag(t):
        w = t.lower().split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    x, y = bag(a), bag(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def classes_by_force(texts: dict[int, str], similarity: float = 0.8) -> dict[int, int]:
    up = {i: i for i in texts}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(i for i in texts if texts[i] and texts[i].split())
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if jaccard(texts[a], texts[b]) >= similarity:
                i, j = sorted((find(a), find(b)))
                up[j] = i
    return {i: find(i) for i in texts}


@pytest.mark.parametrize("bucket", [512, 12, 6])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, bucket):
    from spanweave.llm import bagminhash

    monkeypatch.setattr(bagminhash, "BUCKET", bucket)
    rng = random.Random(5)
    texts: dict[int, str] = {}
    for g in range(12):
        base = words(g, 120).split()
        for c in range(1 + g * 2):
            w = list(base)
            for _ in range(rng.randrange(6)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(w)
    passage = words(77, 60)
    for i in range(15):
        texts[len(texts)] = passage + " " + words(1000 + i, 40)
    n = len(texts)
    texts |= {n: "same few words", n + 1: "same few  words", n + 2: "", n + 3: None, n + 4: "a a a a a a a a", n + 5: "a a a a a a a a a", n + 6: texts[3].upper()}
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()] + [(None, "lost", "en", "s", 0), (3, texts[3], "en", "s", 0)], DOC).withColumn("class_id", F.lit(1))
    got = bagminhash.near_duplicates(df).select("r.doc_id", F.col("class_id").alias("c"), "kept").collect()
    assert len(got) == len(texts) + 2
    assert {r["doc_id"]: r["c"] for r in got if r["doc_id"] is not None} == classes_by_force(texts)
    assert all(r["kept"] == (r["doc_id"] == r["c"] or r["doc_id"] is None) for r in got)
    assert bagminhash.near_duplicates(df.where("false")).count() == 0


def test_signature_estimates_weighted_jaccard():
    from spanweave.llm.bagminhash import signatures

    rng = np.random.default_rng(0)
    errors = []
    for _ in range(100):
        k = int(rng.integers(5, 200))
        a, b = rng.integers(1, 9, k), rng.integers(0, 9, k)
        h = rng.integers(0, 2**63, k).astype(np.uint64)
        on = b > 0
        sig = signatures(np.concatenate([np.zeros(k, int), np.ones(on.sum(), int)]), np.concatenate([h, h[on]]), np.concatenate([a, b[on]]), 2, 256)
        errors.append((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def test_components_of_chains_and_hubs(spark):
    from spanweave.llm.components import connected_components

    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 60)] + [(500, 400), (400, 500), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 1 for i in range(1, 60)} | {400: 400, 500: 400}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_over_many_tasks(spark, monkeypatch):
    from spanweave.llm import components
    from spanweave.llm.components import connected_components

    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
        spark.conf.set("spark.sql.files.openCostInBytes", "400")
        monkeypatch.setattr(components, "TASK_EDGES", 50)
        rng = random.Random(2)
        edges = [(i, i + 1) for i in range(300) if i % 50] + [(0, i) for i in range(500, 540)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(260)]
        rng.shuffle(edges)
        up = {x: x for e in edges for x in e}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            i, j = sorted((find(a), find(b)))
            up[j] = i
        df = spark.createDataFrame(edges, "a long, b long").repartition(6)
        got = {r["node"]: r["component"] for r in connected_components(df).collect()}
        assert got == {x: find(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


VEC = "vec_id long, embedding array<float>, label int"


def vector_rows(n: int = 300, d: int = 16):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((n, d)).astype("f4")
    for i in range(0, n // 3):
        x[i] = x[0] + 0.12 * rng.standard_normal(d)
    x[5] = x[6]
    out = [(i, [float(v) for v in x[i]], 0) for i in range(n)]
    out += [(1000, None, 0), (1100, [], 0), (1200, [0.0] * d, 0), (1300, [float("nan")] * d, 0), (1400, [float("inf")] + [0.0] * (d - 1), 0), (1500, [None] + [1.0] * (d - 1), 0), (1600, [1.0, 0.0], 0), (1700, [1.0, 0.0], 0)]
    return out


def sound(v, zero_ok: bool) -> bool:
    return bool(v) and all(c is not None and math.isfinite(c) for c in v) and (zero_ok or any(v))


def test_top_k_against_all_scores(spark, monkeypatch):
    from spanweave.llm import topk

    monkeypatch.setattr(topk, "DATA_CHUNK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rows = vector_rows()
    df = spark.createDataFrame(rows, VEC).withColumn("id", F.lit(1)).withColumn("score", F.lit(2)).repartition(3)
    got = sorted(tuple(r) for r in topk.exact_topk(df, F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score").collect())
    ints = {i: [math.floor(1024 * c) for c in v] for i, v, _ in rows if sound(v, True)}
    want = []
    for q in (i for i in ints if i % 20 == 0):
        scored = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:10])]
    assert got == sorted(want)
    assert topk.exact_topk(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_cover_tree_covers():
    from spanweave.llm.topk import CoverTree

    x = np.random.default_rng(1).standard_normal((700, 8))
    t = CoverTree(x)
    for node in range(len(t.centre)):
        assert np.linalg.norm(x[t.members[node]] - x[t.centre[node]], axis=1).max() <= t.radius[node] + 1e-9
        if t.children[node]:
            assert sorted(np.concatenate([t.members[c] for c in t.children[node]])) == sorted(t.members[node])


def test_near_vectors_against_all_pairs(spark, monkeypatch):
    from spanweave.llm import neighbours

    monkeypatch.setattr(neighbours, "TILE", 16)
    monkeypatch.setattr(neighbours, "GROUP", 40)
    rows = vector_rows()
    df = spark.createDataFrame([*rows, (None, rows[0][1], 0)], VEC).withColumn("u", F.lit(1)).repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in neighbours.near_vectors(df).select("r.vec_id", "n_links", "component_id", "kept").collect()}
    good = {i: np.array(v, "f8") / np.linalg.norm(v) for i, v, _ in rows if sound(v, False)}
    near = {i: {j for j in good if j != i and len(good[j]) == len(v) and float(v @ good[j]) >= 0.9} for i, v in good.items()}
    part = {i: i for i, *_ in rows}
    for _ in range(len(rows)):
        part = {i: min([part[i], *(part[j] for j in near.get(i, ()))]) for i in part}
    assert got == {i: (len(near.get(i, ())), part[i], part[i] == i) for i in part} | {None: (0, None, True)}
    assert neighbours.near_vectors(df.where("false")).count() == 0


def test_links_beyond_full_lists_join_components(spark, monkeypatch):
    from spanweave.llm import neighbours

    monkeypatch.setattr(neighbours, "AUDIT", 0)  # so that nothing is repaired afterwards
    rng = np.random.default_rng(3)
    axes = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    centres = axes[0], 0.94 * axes[0] + math.sqrt(1 - 0.94**2) * axes[1]
    groups = [c + 0.1 * np.linalg.qr(rng.standard_normal((62, 20)))[0].T @ axes[2:] for c in centres]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate(groups))]
    u = np.array([v / np.linalg.norm(v) for _, v in rows])
    cosines = u @ u.T
    assert cosines[:20, 20:].min() > 0.9 and cosines[:20, 20:].max() < cosines[:20, :20].min()
    rows += [(100 + i, [float(x) for x in rng.standard_normal(64)]) for i in range(60)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neighbours.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).select("r.vec_id", "n_links", "component_id").collect()}
    assert got == {i: (39, 0) if i < 40 else (0, i) for i, _ in rows}


def test_trees_keep_the_miss_probability():
    from spanweave.llm import neighbours

    for n in (2, 300, 10_256, 100_000, 1_000_000, 10_000_000, 1_000_000_000):
        for threshold in (-1.0, 0.2, 0.5, 0.9, 0.99, 1.0):
            bits, trees = neighbours.planting(n, threshold)
            assert trees <= neighbours.MOST_TREES and (1 - (1 - math.acos(threshold) / math.pi) ** bits) ** trees <= neighbours.MISS


def test_links_across_parts_of_a_full_leaf(spark, monkeypatch):
    from spanweave.llm import neighbours

    for name, value in {"AUDIT": 0, "GROUP": 8, "ROUNDS": 0, "LEAF": 1000}.items():  # one leaf, dealt in parts: no tree, list or audit finds what parts keep from each other
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(4)
    pairs = [rng.standard_normal(48) for _ in range(60)]
    rows = [(2 * i + k, [float(x) for x in v + 0.02 * k * rng.standard_normal(48)]) for i, v in enumerate(pairs) for k in range(2)]
    rows += [(1000 + i, [float(x) for x in pairs[0] + 0.02 * rng.standard_normal(48)]) for i in range(30)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neighbours.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).select("r.vec_id", "n_links", "component_id").collect()}
    assert got == {i: (31, 0) if i < 2 or i >= 1000 else (1, i - i % 2) for i, _ in rows}


def test_an_audit_that_fails_at_last_is_an_error(spark, monkeypatch):
    from spanweave.llm import neighbours

    rows = [(i, [1.0, i / 1000]) for i in range(4)]
    lost = lambda nodes, *_: nodes.sparkSession.createDataFrame([(0, 1)], "a long, b long")
    monkeypatch.setattr(neighbours, "STARTS", 2)
    monkeypatch.setattr(neighbours, "audit", lost)
    with pytest.raises(RuntimeError):
        neighbours.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count()


def test_windows_decide_on_marked_pages():
    from spanweave.llm.html import main_text

    body = [" ".join([w] * 60) for w in ("first", "second", "third")]
    teaser = "<article><p>Read this too</p></article>"
    assert main_text("<div>" + "".join(f"<p>{p}</p>" for p in body) + "</div>" + teaser) == "\n".join(body)
    short = "".join(f"<p>{p}</p>" for p in body)
    assert main_text(f"<div><p>Site name</p></div><article>{short}</article><div><p>More on the site</p></div>") == "\n".join(body)
    ads = "<div class=ad><p>a</p><p>b</p><p>c</p><p>d</p></div>"
    assert main_text(f"<article>{short}{ads}<p>The end</p></article>") == "\n".join([*body, "The end"])
