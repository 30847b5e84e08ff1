"""The operators against plain single-process versions, and rows that repeat, are long or carry odd labels."""

from __future__ import annotations

import random
import time
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("spanweave.llm")
import plain  # noqa: E402

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_main_text_of_random_trees():
    from spanweave.llm.html import main_text

    windows_matter = 0
    for seed in range(400):
        page = plain.random_page(random.Random(seed))
        html, want = plain.as_html(page), plain.page_text(page)
        assert main_text(html) == want, (seed, html)
        windows_matter += bool(want)
    assert windows_matter > 200


def test_names_inside_an_article_keep_its_text():
    from spanweave.llm.html import main_text

    html = '<article><p>One</p><section class="related-work">Two</section><div id="search-algorithms">Three</div><p class="notice">Four</p><div class="comments">no</div><aside>no</aside><p class="ad">no</p></article>'
    assert main_text(html) == "One\nTwo\nThree\nFour"


@pytest.mark.parametrize("html", ["<a " * 100_000, "<p <b>x" * 50_000, "<!" * 200_000, "<div>" * 50_000 + "</p>" * 50_000, "<b>" * 50_000 + "<p>" * 50_000, "<a '<a ''" * 40_000, '<a href="x>' * 40_000, "<!--" * 100_000])
def test_broken_pages_take_linear_time(html):
    from spanweave.llm.html import main_text

    began = time.time()
    main_text(html)
    assert time.time() - began < 8


def test_odd_tags():
    from spanweave.llm.html import main_text

    assert main_text("<p>1 < 2 and <b>x</b> <y or z</p>") == "1 < 2 and x <y or z"
    assert main_text('<p class="a>text</p><p>more</p>') == "text\nmore"
    assert main_text("<p <b>bold</b> text") == "bold text"


def test_languages_against_the_plain_version(spark):
    from spanweave.llm.langid import identify_languages, learn_languages

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    dictionaries = learn_languages(docs)
    assert set(dictionaries) == {r[0] for r in docs.where("lang IS NOT NULL").select("lang").distinct().collect()}
    for r in identify_languages(docs).select("r.text", "lang_pred", "rejected").collect():
        assert (r["lang_pred"], r["rejected"]) == plain.language(dictionaries, r["text"])


def test_language_coders_receive_every_byte(monkeypatch):
    from spanweave.llm import langid

    seen = []
    monkeypatch.setattr(langid, "size", lambda c, data, chunk: seen.append(data) or len(data))
    text = "Ab ab ab, 12!\n" * 3000
    langid.Languages({"x": [b"dictionary x"], "y": [b"dictionary y"]}).identify(text)
    assert seen == [text.lower().encode()] * 2


def test_quality_against_the_plain_version(spark):
    from spanweave.llm.quality import learn_quality, score_quality

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = learn_quality(docs, labels)
    assert model.weights is not None and len(model.weights) == 8
    for r in score_quality(docs, labels).select("r.text", "score", "predicted").limit(150).collect():
        want = plain.quality(model.dictionaries, list(model.weights), r["text"])
        assert abs(r["score"] - want) < 1e-9 and r["predicted"] == int(r["score"] >= 0.7)


def test_quality_of_odd_labels_repeats_and_long_texts(spark):
    from spanweave.llm.quality import score_quality

    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(plain.WORDS, k=40)) if i % 2 else "!! ?? " * 20, "en", "s", 0) for i in range(200)]
    rows += [rows[1]] * 50 + [(500, "word " * 100_000, "en", "s", 0), (501, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOC)
    labels = [(i, i % 2) for i in range(200)] + [(500, 2), (501, -1), (1, 1), (None, 5)]
    got = score_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).select("r.doc_id", "score").collect()
    assert len(got) == len(rows) and len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    odd = spark.createDataFrame([(i, 7) for i in range(200)], "doc_id long, quality int")
    assert {r["score"] for r in score_quality(docs, odd).select("score").collect()} == {0.5}


def test_pieces_are_spread_over_whole_texts():
    from spanweave.llm.compression import pieces

    data = bytes(range(256)) * 40
    assert pieces(data[:300], 400) == data[:300]
    cut = pieces(data, 400)
    assert len(cut) <= 400 and cut.startswith(data[:90]) and cut.endswith(data[-90:])


def test_harmonic_bins():
    from spanweave.llm.packing import harmonic

    for seed in range(120):
        rng = random.Random(seed)
        capacity = rng.choice([2048, 64, 100])
        lengths = [rng.randint(capacity // 2 + 1, capacity) for _ in range(50)] if seed % 3 == 0 else [max(1, int(rng.lognormvariate(5, 1.3))) for _ in range(rng.choice([0, 1, 2, 5, 50, 1000]))]
        placed, left = harmonic(lengths, capacity)
        bins: dict = {}
        cover: dict = {i: [] for i in range(len(lengths))}
        for i, s, n, q, o in placed:
            bins.setdefault(q, []).append((o, n))
            cover[i].append((s, n))
        for i, s, n in left:
            cover[i].append((s, n))
        for stretch, total in [*((b, capacity) for b in bins.values()), *((cover[i], n) for i, n in enumerate(lengths))]:
            at = 0
            for o, n in sorted(stretch):
                assert o == at and n > 0
                at += n
            assert at == total
        assert sum(n for _, _, n in left) < capacity
    rng = random.Random(0)
    lengths = [min(2048, max(1, int(rng.lognormvariate(5.5, 1.2)))) for _ in range(2000)]
    times = Counter(i for i, *_ in harmonic(lengths, 2048)[0])
    assert sum(n == 1 for n in times.values()) > 0.8 * len(lengths)


def test_repeated_ids_of_vectors(spark):
    from spanweave.llm.neighbours import near_vectors
    from spanweave.llm.topk import exact_topk

    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.99, 0.01]), (2, [0.0, 1.0]), (3, [0.0, 5.0]), (None, [1.0, 0.0]), (4, None), (100, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = near_vectors(df).select("r.vec_id", "n_links", "component_id", "kept").collect()
    assert len(got) == len(rows)
    assert {r["component_id"] for r in got if r["vec_id"] == 1} == {1} and [r["n_links"] for r in got if r["vec_id"] == 4] == [0]
    top = exact_topk(df, df.vec_id % 100 == 0, k=10).collect()
    want = sorted(((-int(np.floor(1024 * np.array(v)) @ np.array([1024, 1024])), i) for i, v in rows if i not in (None, 100) and v))
    assert [(-r["score"], r["vec_id"]) for r in sorted(top, key=lambda r: r["rank"])] == want


def test_near_duplicates_of_long_and_repeated_rows(spark):
    from spanweave.llm.bagminhash import near_duplicates

    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " tail"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "other words in this text here"), (5, None), (None, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(0))
    got = Counter((r["doc_id"], r["class_id"], r["kept"]) for r in near_duplicates(df).select("r.doc_id", "class_id", "kept").collect())
    assert got == Counter([(1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True), (4, 4, True), (5, 5, True), (None, None, True)])


def test_tables_of_a_call_go(spark, tmp_path, monkeypatch):
    import os

    from spanweave.llm import common
    from spanweave.llm.bagminhash import near_duplicates

    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    df = spark.createDataFrame([(i, f"some words that are here twice {i // 2}") for i in range(10)], "doc_id long, text string")
    out = near_duplicates(df)
    assert len(os.listdir(tmp_path)) == 1
    assert out.where("kept").count() == 5
    with common.scratch(spark):
        out = common.durable(near_duplicates(df).where("kept"), "stage", keep=True)
    assert len(os.listdir(tmp_path)) == 2 and out.count() == 5
