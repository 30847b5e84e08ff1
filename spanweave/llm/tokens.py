"""Token counts by a two-tier lookup on the map side.

A text is cut into pre-token pieces: at each space that follows a character that is not white space, a place where a
pre-token of the byte-level pattern always begins, so a piece's length in tokens depends on the piece alone. Tier one is a broadcast
table of the lengths of frequent pieces, fitted on a bounded sample of documents; tier two is a bounded cache in each
worker, filled by encoding the batch's missing pieces with the tokenizer itself. No piece is ever shuffled, and the sample decides
about speed only: any piece that no tier holds is encoded.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches, whole_row

#: Documents that tier one is fitted on and characters taken of each, its entries, and the entries of a worker's cache.
SAMPLE_DOCS, SAMPLE_CHARS, FREQUENT, CACHED = 2000, 10_000, 50_000, 350_000
#: Longest piece that is kept, and the length of the slices of a longer text.
KEEP_CHARS, SLICE_CHARS = 64, 1 << 20
#: Pieces that are encoded as one text.
JOINED = 256
_SPACES = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S) ")


def pieces(text: str) -> list[str]:
    """Pre-token pieces of a text; joined they are the text."""
    parts = text.split(" ")
    if not _SPACES.search(text):
        return [parts[0], *[" " + p for p in parts[1:]]] if parts[0] else [" " + p for p in parts[1:]]
    out, at = [], 0
    for m in _CUT.finditer(text):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def slices(text: str, size: int = SLICE_CHARS) -> Iterator[str]:
    """A long text in slices that begin where pieces begin, so that memory follows the slice and not the text."""
    at = 0
    while len(text) - at > size:
        m = _CUT.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def load_tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def worker_store() -> dict:
    """What a worker process keeps between tasks, as long as Spark reuses it."""
    import sys
    import types

    return vars(sys.modules.setdefault("_spanweave_worker", types.ModuleType("_spanweave_worker")))


class PieceTable:
    """The two tiers in one worker: the given frequent pieces, and those that have been encoded here, in two generations of up to `cached`.

    encode: values of a list of pieces. A piece that is met again moves to the young generation, so what is frequent stays.
    """

    def __init__(self, encode, frequent: dict, cached: int = CACHED):
        self.encode, self.frequent, self.cached = encode, frequent, cached
        self.known, self.old = dict(frequent), {}

    def values(self, words: list[str]) -> list:
        found = list(map(self.known.get, words))
        at = [i for i, v in enumerate(found) if v is None]
        if not at:
            return found
        missing = {words[i] for i in at}
        if len(self.known) + len(missing) > self.cached + len(self.frequent):
            self.known, self.old = dict(self.frequent), self.known
        new = {w: v for w in missing if (v := self.old.get(w)) is not None}
        fresh = [w for w in missing if w not in new]
        new.update(zip(fresh, self.encode(fresh)))
        for i in at:
            found[i] = new[words[i]]
        self.known.update(new)
        for w in fresh:
            if len(w) > KEEP_CHARS:
                del self.known[w]
        return found


def joined_ids(tokenizer, joined: str) -> np.ndarray:
    return np.array(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")


class PieceLengthEncoder:
    """Lengths of pieces. Pieces of one leading space and no other white space are encoded joined, which costs far less: in a byte-level vocabulary, their
    tokens are told apart by the space that each begins with."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.starts = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), bool)
        for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
            self.starts[i] = token.startswith("\u0120")  # how a byte-level vocabulary writes a space

    def __call__(self, pieces_: list[str]) -> list[int]:
        plain = [i for i, p in enumerate(pieces_) if len(p.split()) == 1 and p[0] == " " and not p[1].isspace() and not p[-1].isspace()]
        out: list = [None] * len(pieces_)
        for at in range(0, len(plain), JOINED):
            some = plain[at : at + JOINED]
            ids = joined_ids(self.tokenizer, "".join([pieces_[i] for i in some]))
            firsts = np.flatnonzero(self.starts[ids])
            if len(firsts) == len(some):
                for i, n in zip(some, np.diff(np.append(firsts, len(ids))).tolist()):
                    out[i] = n
        rest = [i for i, n in enumerate(out) if n is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([pieces_[i] for i in rest], add_special_tokens=False)):
            out[i] = len(e)
        return out


class TokenCounter:
    """Counts whole texts by a table of pieces."""

    def __init__(self, tokenizer, frequent: dict[str, int], cached: int = CACHED):
        self.tokenizer, self.table = tokenizer, PieceTable(PieceLengthEncoder(tokenizer), frequent, cached)
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def count(self, text: str) -> int:
        total = 0
        for part in slices(text):
            if any(s in part for s in self.special):  # the tokenizer takes these out before it looks for pre-tokens
                total += len(self.tokenizer.encode(part, add_special_tokens=False))
            else:
                total += sum(self.table.values(pieces(part)))
        return total


def frequent_lengths(docs: DataFrame, tokenizer_path: str, text: str = "text") -> dict[str, int]:
    """Tier one: the lengths of the most frequent pieces in the first SAMPLE_CHARS characters of SAMPLE_DOCS documents, from as few partitions as hold them.

    Changes no count, whatever it holds.
    """
    seen: Counter = Counter()
    for r in docs.select(F.substring(whole_row(docs).getField(text), 1, SAMPLE_CHARS).alias("t")).limit(SAMPLE_DOCS).collect():
        seen.update(pieces(r["t"] or ""))
    short = [w for w, _ in seen.most_common(2 * FREQUENT) if w and len(w) <= KEEP_CHARS][:FREQUENT]
    return dict(zip(short, PieceLengthEncoder(load_tokenizer(tokenizer_path))(short))) if short else {}


def count_tokens(docs: DataFrame, tokenizer_path: str, *, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """Tokens of every whole text: key, n_bytes (UTF-8), n_tokens and over_limit (more tokens than `limit`).

    Counts are those of the tokenizer without begin, end or added special tokens; special strings inside a text count as the tokenizer's default has it. A
    null text counts as empty: 0 bytes, 0 tokens. Null keys and repeated rows keep their rows; an empty table gives none; other columns are ignored.
    One narrow map over the scan: no shuffle.
    """
    text_batches(docs.sparkSession)
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_lengths(docs, tokenizer_path, text))  # FREQUENT pieces of KEEP_CHARS characters at most
    row = whole_row(docs)
    narrow = docs.select(row.getField(key).alias("k"), F.coalesce(row.getField(text), F.lit("")).alias("t"))

    def run(batches):
        store, name = worker_store(), ("lengths", tokenizer_path)
        counter = store.get(name) or store.setdefault(name, TokenCounter(load_tokenizer(tokenizer_path), frequent.value))
        for b in batches:
            texts = b.column(1)
            counts = [counter.count(t) for t in texts.to_pylist()]
            n_bytes = pa.compute.binary_length(texts.cast(pa.large_binary()) if pa.types.is_large_string(texts.type) else texts.cast(pa.binary()))
            yield pa.RecordBatch.from_arrays([b.column(0), n_bytes.cast(pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], names=["k", "n_bytes", "n_tokens", "over_limit"])

    import pyarrow.compute  # noqa: F401  pa.compute, here and on the workers

    kind = narrow.schema["k"].dataType.simpleString()
    return narrow.mapInArrow(run, f"k {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("k", key)
