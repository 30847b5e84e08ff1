"""Language identification by compression against one dictionary a language.

A text is lower-cased and compressed whole, in chunks, under each language's dictionary; the smallest size names the language. Where the two smallest are close, all dictionaries of each
language vote; where they are still close, the text is rejected.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches, whole_row
from .compression import bounded_sample, compressor, content, fold, pieces, size

#: Documents that a language is learnt from; its dictionaries, their bytes, and bytes taken of each document, in pieces spread over the whole of it.
DOCS_PER_LANGUAGE, DICTIONARIES, DICTIONARY_BYTES, DOC_BYTES = 480, 3, 1 << 16, 400
LEVEL, CHUNK = 6, 4096
#: In a vote, a chunk follows this much of the dictionary's own end, whose cost is taken off: short texts then pay for their signs and not for the frame.
VOTE_LEVEL, CARRIER = 12, 300
#: Below the first margin all dictionaries of a language vote; below the second the decision is rejected.
NARROW, REJECT = 0.04, 0.002
UNKNOWN = "und"


def folded(text: str) -> bytes:
    """What is compressed: the whole text in small letters."""
    return text.lower().encode("utf-8", "replace")


class Languages:
    """A compressor for each dictionary of each language. samples: language -> texts."""

    def __init__(self, dictionaries: dict[str, list[bytes]]):
        self.names = sorted(dictionaries)
        self.coders = [compressor(dictionaries[name][0], LEVEL, CHUNK) for name in self.names]
        self.voters = [[(c := compressor(d, VOTE_LEVEL, CHUNK), d[-CARRIER:] + b" ", len(c.compress(d[-CARRIER:]))) for d in dictionaries[name]] for name in self.names]

    def identify(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score from 0 to 1, rejected). A text that is null or has no letter is `und`, score 0, rejected."""
        if not text or not self.names or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        data = folded(text)
        sizes = [float(size(c, data, CHUNK)) for c in self.coders]
        if self.margin(sizes) < NARROW:
            sizes = [self.vote(data, voters) for voters in self.voters]
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        score = 1.0 / sum(math.exp(max(-700.0, (sizes[best] - s) / 2.0)) for s in sizes)
        return self.names[best], score, len(sizes) > 1 and self.margin(sizes) < REJECT

    @staticmethod
    def vote(data: bytes, voters: list[tuple]) -> float:
        """The mean size under all dictionaries of a language, each chunk after the carrier."""
        step = CHUNK - CARRIER
        return max(1.0, sum(len(c.compress(carrier + data[i : i + step])) - cost for c, carrier, cost in voters for i in range(0, len(data), step)) / len(voters))

    @staticmethod
    def margin(sizes: list[float]) -> float:
        """How much smaller the best size is than the next, as a share of it."""
        if len(sizes) < 2:
            return 1.0
        a, b = sorted(sizes)[:2]
        return (b - a) / b if b else 0.0


def learn_languages(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = DOCS_PER_LANGUAGE) -> dict[str, list[bytes]]:
    """Dictionaries of each language, from about per_language documents of it outside fold 2 with a language and a text. The tasks cut the documents to pieces, so whole texts never reach the driver."""
    row = whole_row(docs)
    rows = docs.select(row.getField(key).alias("key"), row.getField(text).alias("text"), row.getField(lang).alias("lang"))
    usable = rows.where((fold(F.col("key")) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("mark", F.xxhash64("text"))

    @F.pandas_udf("binary")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([pieces(folded(t), DOC_BYTES) for t in texts], dtype=object)

    chosen = bounded_sample(usable, "lang", per_language).select("lang", "key", "mark", cut("text").alias("part")).collect()  # about per_language rows of DOC_BYTES a language
    by: dict[str, list[bytes]] = {}
    for r in sorted(chosen, key=lambda r: (r["lang"], str(r["key"]), r["mark"])):
        by.setdefault(r["lang"], []).append(bytes(r["part"]))
    return {name: [content(parts[i::DICTIONARIES], DICTIONARY_BYTES) for i in range(min(DICTIONARIES, len(parts)))] for name, parts in by.items() if any(parts)}


def identify_languages(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", train: DataFrame | None = None) -> DataFrame:
    """The language of every whole text: r (the row), held_out, lang_pred, score and rejected.

    Learns from `train` (docs itself, if none is given): text and non-null lang of rows outside fold 2. A prediction uses the text alone. Null texts and texts without a letter are
    `und` and rejected; a margin under REJECT between the two best languages rejects too, with the best language still named; ties go to the first name. Without any training
    row everything is `und`. Repeated rows get the same answer; an empty table gives no rows.
    """
    text_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(learn_languages(train if train is not None else docs, key=key, text=text, lang=lang))  # DICTIONARIES x DICTIONARY_BYTES a language
    packed = docs.select(whole_row(docs).alias("r"))

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        coder = Languages(model.value)
        return pd.DataFrame([coder.identify(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    found = packed.withColumn("p", predict(F.col("r").getField(text)))
    return found.select("r", (fold(F.col("r").getField(key)) == 2).alias("held_out"), "p.lang_pred", "p.score", "p.rejected")
