"""Every stage of the pipeline on its own input, against what its operator decides."""

from __future__ import annotations

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.durable(stage(spark, seen, SF), f"test-{name}")
        assert out.columns == columns
        ids_in, ids_out = {r[0] for r in seen.select("doc_id").collect()}, {r[0] for r in out.select("doc_id").collect()}
        assert ids_out <= ids_in
        if name == "mixing":
            assert ids_out == ids_in
        counts.append(out.count())
        seen = out
    packed = corpus_pipeline.STAGES[-1][1](spark, seen, SF)
    assert packed.select("doc_id").distinct().count() == seen.select("doc_id").distinct().count()
    assert counts[1] >= 0.9 * counts[0] and counts[3] < counts[2] < counts[1]


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_on_odd_rows(spark):
    """Null, empty, blank, very long and repeated rows beside ordinary ones, with columns named like the operators' own."""
    plain = spark.read.parquet(f"{SF}/documents.parquet").where("text IS NOT NULL AND length(text) > 300")
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    first = plain.orderBy("doc_id").select("text", "lang").first()
    long = (first["text"] + "\n") * (200_000 // len(first["text"]))
    odd = [(900_001, None, None, None, None), (900_002, "", "en", "a", 0), (900_003, " \n\t", "en", "a", 3), (900_004, "123 456 !!", "en", "a", 10), (900_005, long, first["lang"], None, len(long)), (None, first["text"], first["lang"], "a", 1)]
    odd += [(900_006, first["text"][::-1], None, "b", 5)] * 3
    docs = plain.select(*names).unionAll(spark.createDataFrame(odd, plain.select(*names).schema))
    clashing = ["r", "g", "id", "k", "u", "node", "component", "class_id", "kept", "score", "predicted", "rejected", "fold", "key", "text_crc32", "sk", "plan", "a.b"]
    docs = corpus_pipeline.durable(docs.selectExpr("*", *[f"{i} AS `{c}`" for i, c in enumerate(clashing)]), "test-odd")
    total = docs.count()
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.durable(stage(spark, docs, SF), f"test-odd-{name}")
        if name != "packing":
            assert out.columns == docs.columns
            assert all(out.where(f"`{c}` <> {i}").isEmpty() for i, c in enumerate(clashing))
        held[name] = [r[0] for r in out.select("doc_id").collect()]
    assert not {900_001, 900_002, 900_003, 900_004} & set(held["language"]) and {900_005, None} <= set(held["language"])
    assert held["quality"].count(900_006) in (0, 3)
    assert {900_001, 900_002, 900_003, 900_005, None} <= set(held["near_duplicates"]) and held["near_duplicates"].count(900_006) == 3
    assert len(held["mixing"]) >= total and set(held["mixing"]) == {r[0] for r in docs.select("doc_id").collect()}
    assert held["mixing"].count(900_006) % 3 == 0
    packed = stage(spark, docs, SF).where("doc_id >= 900001 OR doc_id IS NULL").groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    size = {r["doc_id"]: (r["sum(length)"], r["max(doc_tokens)"]) for r in packed}
    assert size[900_001] == size[900_002] == (1, 1) and size[900_006][0] == 3 * size[900_006][1] and size[900_005][0] == size[900_005][1] > 2048
