"""Quality by compression: dictionaries of good and bad labelled text, and a calibrated score.

Two views of a text are compressed: its bytes, and its shape, where a run of small letters is one sign and so is a run of capitals. In each, the difference of the sizes under
the bad and the good dictionary, over their sum, says which it resembles. A logistic model on these differences and on how far the text compresses at all, fitted on labelled rows that are in no
dictionary, makes the score.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches, whole_row
from .compression import bounded_sample, compressor, content, fold, pieces, size

#: Bound of the labelled sample of each class. Bytes of its dictionaries, and of each text in them, in pieces spread over the whole of it.
DOCS_PER_CLASS = 4000
BYTES_DICTIONARY, SHAPE_DICTIONARY, EACH = 1 << 17, 1 << 16, 600
LEVEL, CHUNK = 6, 2048
THRESHOLD = 0.7


def _sign(c: int) -> int:
    ch = chr(c)
    if c >= 128 or ch.islower():
        return ord("a")
    if ch.isupper():
        return ord("A")
    if ch.isdigit():
        return ord("0")
    return ord(" ") if ch in "\t\r" else c


_SIGNS = bytes(_sign(c) for c in range(256))
_SMALL, _LARGE = re.compile(rb"a+"), re.compile(rb"A+")


def shape(data: bytes) -> bytes:
    return _SMALL.sub(b"a", _LARGE.sub(b"A", data.translate(_SIGNS)))


class QualityModel:
    """dictionaries: bytes of bad, bytes of good, shape of bad, shape of good. weights: of the logistic model, or the prior's log odds alone."""

    def __init__(self, dictionaries: list[bytes], weights: np.ndarray | None = None):
        self.dictionaries, self.weights = dictionaries, weights
        self.coders = [compressor(d, LEVEL, CHUNK) for d in dictionaries]

    def features(self, text: str | None) -> list[float]:
        data = (text or "").encode("utf-8", "replace")
        form = shape(data)
        bad, good = (size(c, data, CHUNK) for c in self.coders[:2])
        bad_form, good_form = (size(c, form, CHUNK) for c in self.coders[2:])
        a = max(-0.6, min(0.6, (bad - good) / (bad + good + 8))) * 5
        s = max(-0.6, min(0.6, (bad_form - good_form) / (bad_form + good_form + 8))) * 5
        left = min(1.0, good / max(1, len(data)))
        form_left = min(1.0, (good_form + 1) / (len(form) + 1))
        soft = math.exp(-12 * left)
        return [1.0, math.log(left + 0.01), soft, a, a * soft, s, s * soft, math.log(form_left + 0.01)]

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.5
        if len(self.weights) == 1:
            return float(1 / (1 + math.exp(-self.weights[0])))
        z = float(np.dot(self.features(text), self.weights))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def logit(good: int, bad: int) -> np.ndarray:
    return np.array([math.log((good + 0.5) / (bad + 0.5))])


def learn_quality(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = DOCS_PER_CLASS) -> QualityModel:
    """Fit on about per_class labelled rows of each class outside fold 2.

    Folds 0 and 3 make the dictionaries, from pieces spread over whole texts, without the lines that pieces of both classes have; fold 1 calibrates on whole texts. Tasks cut the pieces and measure the
    calibration rows, so no text reaches the driver. Labels other than 0 and 1 are none. A doc_id with several labels has its smallest. Without rows of both
    classes in both parts, the score is the share of good rows, 0.5 without any.
    """
    spark, lab, row = docs.sparkSession, whole_row(labels), whole_row(docs)
    known = labels.select(lab.getField(key).alias("key"), lab.getField(label).alias("y")).where(F.col("key").isNotNull() & F.col("y").isin(0, 1) & (fold(F.col("key")) != 2))
    ids = bounded_sample(known.groupBy("key").agg(F.min("y").cast("int").alias("y")).withColumn("mark", F.lit(0)), "y", per_class)
    texts = docs.select(row.getField(key).alias("key"), F.coalesce(row.getField(text), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(ids.drop("mark")), "key").withColumn("mark", F.xxhash64("text")).withColumn("fold", fold(F.col("key")))  # about 2 x per_class ids
    sample = bounded_sample(sample.withColumn("class", F.concat_ws("/", F.col("y"), F.col("fold") == 1)), "class", per_class)  # rows that repeat an id count as rows

    @F.pandas_udf("binary")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([pieces(t.encode("utf-8", "replace"), EACH) for t in texts], dtype=object)

    made = sorted(sample.where("fold <> 1").select("key", "mark", "y", cut("text").alias("part")).collect(), key=lambda r: (str(r["key"]), r["mark"]))  # EACH bytes a row
    counts = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = QualityModel([b""] * 4, logit(counts.get(1, 0), counts.get(0, 0)) if counts else None)
    lines: list[set[bytes]] = [set(), set()]
    for r in made:
        lines[r["y"]].update(bytes(r["part"]).split(b"\n"))
    if not all(lines):
        return prior
    shared = lines[0] & lines[1]
    own = [[o for r in made if r["y"] == y and (o := b"\n".join(x for x in bytes(r["part"]).split(b"\n") if x not in shared))] for y in (0, 1)]
    model = QualityModel([content(parts, BYTES_DICTIONARY) for parts in own] + [content(list(map(shape, parts)), SHAPE_DICTIONARY) for parts in own])
    sent = spark.sparkContext.broadcast(model.dictionaries)

    @F.pandas_udf("array<double>")
    def measure(texts: pd.Series) -> pd.Series:
        coder = QualityModel(sent.value)
        return pd.Series([coder.features(t) for t in texts], dtype=object)

    held = sorted((r["y"], tuple(r["x"])) for r in sample.where("fold = 1").select("y", measure("text").alias("x")).collect())  # eight numbers a row
    if len({y for y, _ in held}) < 2:
        return prior
    model.weights = logistic(np.array([x for _, x in held]), np.array([y for y, _ in held], float))
    return model


def score_quality(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """Score every whole text: r (the row), held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 from `threshold` on).

    Labels, language, source and ids are no inputs of a score. Null texts score as empty ones do; repeated rows score alike; an empty table gives no rows.
    """
    text_batches(docs.sparkSession)
    fitted = learn_quality(docs, labels, key=key, text=text, label=label)
    model = docs.sparkSession.sparkContext.broadcast((fitted.dictionaries, fitted.weights))  # 400 KB of dictionaries
    packed = docs.select(whole_row(docs).alias("r"))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        coder = QualityModel(*model.value)
        return pd.Series([coder.score(t) for t in texts], dtype="float64")

    scored = packed.withColumn("score", score(F.col("r").getField(text)))
    return scored.select("r", (fold(F.col("r").getField(key)) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
