"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

Class j holds the documents with capacity/(j+1) < length <= capacity/j, and each of its sequences is filled with j of them. Workers pack what they hold independently, batch by batch: a document longer than the
capacity gives whole sequences first and goes on as its rest; documents of the classes stay whole; what the j documents of a sequence leave of it is filled from a few
documents that are poured, cut where a sequence is full. Poured are those whose class would waste most, as many as the others leave room for. So a batch leaves one sequence unfilled at most.

The pieces of that sequence are cut at halves of the capacity down to `least_cut`, written with the rest and packed over all batches: pieces of one length form bins of capacity/length each, numbered
within (length, bucket), and a count table of lengths x buckets rows gives each bucket's first number. The pieces of each length's last, unfilled bin, fewer than
capacity/length of them whatever the input, are packed together in one small task, longest first.
"""

from __future__ import annotations

import string
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bagminhash import slices_of
from .common import durable, scoped, text_batches, whole_row
from .tokens import JOINED, PieceTable, joined_ids, load_tokenizer, slices, worker_store

BUCKETS = 256
#: Documents shorter than this share of the capacity are poured first: they are the finest grain.
SAND = 1 / 32
#: Sequences of workers are numbered from here on, by task and in turn, beyond those of the pieces that are packed together.
OWN = 1 << 40
#: Bytes of text that a worker tokenises and packs at once.
BYTES_AT_ONCE = 8_000_000
_CONTROL = {chr(c) for c in (0x1C, 0x1D, 0x1E, 0x1F)}


def ids_bytes(encoding) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    ids = encoding.ids
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIdsEncoder:
    """Ids of words, as bytes. Words of letters, with or without ASCII punctuation behind, are encoded joined by spaces: each gives one or two pre-tokens, whose last tokens the
    vocabulary marks as ends. Where the ends don't number what is expected, and for other words, each is encoded alone."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.ends = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), bool)
        for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
            self.ends[i] = token.endswith("</w>")

    def __call__(self, words: list[str]) -> list[bytes]:
        out: list = [None] * len(words)
        stems = [w.rstrip(string.punctuation) for w in words]
        plain = [i for i, stem in enumerate(stems) if stem.isalpha()]
        units = [1 if len(stems[i]) == len(words[i]) else 2 for i in plain]
        for at in range(0, len(plain), JOINED):
            some = plain[at : at + JOINED]
            ids = joined_ids(self.tokenizer, " ".join([words[i] for i in some]))
            ends, last = np.flatnonzero(self.ends[ids]), np.cumsum(units[at : at + JOINED]) - 1
            if len(ends) == last[-1] + 1:
                data, lo = ids.tobytes(), 0
                for i, hi in zip(some, (4 * (ends[last] + 1)).tolist()):
                    out[i] = data[lo:hi]
                    lo = hi
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)):
            out[i] = ids_bytes(e)
        return out


class WordEncoder:
    """Ids of texts under a tokenizer that drops white space: each white-space-separated word has ids of its own, which a table keeps."""

    def __init__(self, tokenizer):
        self.tokenizer, self.table = tokenizer, PieceTable(WordIdsEncoder(tokenizer), {})

    def encode(self, text: str) -> bytes:
        if any(c in text for c in _CONTROL):  # str.split() would split at these, the tokenizer doesn't
            return ids_bytes(self.tokenizer.encode(text, add_special_tokens=False))
        return b"".join(b"".join(self.table.values(part.split())) for part in slices(text))


def cut_lengths(n: int, capacity: int, least_cut: int) -> list[int]:
    """Lengths of the pieces of a document of n ids, in order."""
    out = [capacity] * (n // capacity)
    n %= capacity
    half = capacity // 2
    while half >= least_cut:
        if n >= half:
            out.append(half)
            n -= half
        half //= 2
    return [*out, n] if n else out


def harmonic(lengths: list[int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Pack documents into full sequences, and what is left over.

    Returns pieces (document, start, length, sequence, offset) of sequences that are full, and pieces (document, start, length) of the one that is not.
    """
    placed: list[tuple[int, int, int, int, int]] = []
    n_bins = 0
    rests: list[tuple[int, int, int]] = []  # (length, document, start)
    for i, n in enumerate(lengths):
        whole = n - n % capacity
        for start in range(0, whole, capacity):
            placed.append((i, start, capacity, n_bins, 0))
            n_bins += 1
        if n > whole:
            rests.append((n - whole, i, whole))
    rests.sort(key=lambda r: (-r[0], r[1]))
    sand = [r for r in rests if r[0] <= capacity * SAND]
    solid = rests[: len(rests) - len(sand)]
    # what a document takes of its sequence beyond its own length, if its class fills it
    by_waste = sorted(solid, key=lambda r: (capacity // (capacity // r[0]) - r[0], r[0]))
    total = sum(r[0] for r in rests)
    fixed = 0.0  # sequences that the documents taken so far fill, in shares of one
    taken, held = [], 0
    for r in by_waste:
        fixed += 1 / (capacity // r[0])
        held += r[0]
        if fixed * capacity - held > total - held:
            break  # the others could not fill what these leave
        taken.append(r)
    while True:
        groups: dict[int, list] = {}
        for r in taken:
            groups.setdefault(capacity // r[0], []).append(r)
        bins = [group[k : k + j] for j, group in sorted(groups.items()) for k in range(0, len(group) - len(group) % j, j)]
        kept = {r[1] for group in bins for r in group}
        poured = [r for r in solid if r[1] not in kept] + sand
        room = [capacity - sum(r[0] for r in group) for group in bins]
        if sum(room) <= sum(r[0] for r in poured):
            break
        taken = taken[:-1]
    stream = iter(poured)
    n, i, start = next(stream, (0, 0, 0))
    for group, free in zip(bins, room):
        offset = 0
        for length, doc, at in group:
            placed.append((doc, at, length, n_bins, offset))
            offset += length
        while free:
            take = min(free, n)
            placed.append((i, start, take, n_bins, offset))
            offset, free, n, start = offset + take, free - take, n - take, start + take
            if not n:
                n, i, start = next(stream, (0, 0, 0))
        n_bins += 1
    left, filled = [], 0  # the sequence that only poured documents fill
    while n:
        take = min(capacity - filled, n)
        left.append((i, start, take, n_bins, filled))
        filled, n, start = filled + take, n - take, start + take
        if filled == capacity:
            placed += left
            left, filled, n_bins = [], 0, n_bins + 1
        if not n:
            n, i, start = next(stream, (0, 0, 0))
    return placed, [x[:3] for x in left]


def pack_rest(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """First fit, longest first, over the bounded rest. Deterministic: ties by document, start and the copy number."""
    pdf = pdf.sort_values(["length", "doc", "start", "no"], ascending=[False, True, True, True], kind="stable")
    room: list[int] = []
    bins, offsets = [], []
    first = 0
    for n in pdf["length"]:
        while first < len(room) and room[first] == 0:
            first += 1
        b = next((i for i in range(first, len(room)) if room[i] >= n), len(room))
        if b == len(room):
            room.append(capacity)
        bins.append(b)
        offsets.append(capacity - room[b])
        room[b] -= n
    return pdf.assign(rest_bin=np.array(bins, "int64"), offset=np.array(offsets, "int64"))


@scoped
def pack(docs: DataFrame, tokenizer_path: str, *, key: str = "doc_id", text: str = "text", capacity: int = 2048, least_cut: int = 64, end_id: int = 1) -> DataFrame:
    """Pack every document, its ids followed by end_id, into sequences of at most `capacity` ids.

    Returns a row a piece: key, start, length, ids_crc32 (of the piece's ids as little-endian unsigned 32-bit numbers), doc_tokens (with the end id), sequence_id, offset (in the sequence, gapless from 0). A null text counts as
    empty and is the end id alone. Repeated rows are separate documents; null keys stay null. An empty table gives no rows. Other columns are ignored.
    """
    text_batches(docs.sparkSession)
    row = whole_row(docs)
    narrow = docs.select(row.getField(key).alias("k"), F.coalesce(row.getField(text), F.lit("")).alias("t"))
    kind = narrow.schema["k"].dataType.simpleString()
    end = struct.pack("<I", end_id)

    def run(batches):
        from pyspark import TaskContext

        store, name = worker_store(), ("words", tokenizer_path)
        encoder = store.get(name) or store.setdefault(name, WordEncoder(load_tokenizer(tokenizer_path)))
        context = TaskContext.get()
        number = OWN * (1 + (context.partitionId() if context else 0))
        for b in batches:
            for lo, size_ in slices_of(b.column(1), BYTES_AT_ONCE):
                ids = [encoder.encode(t) + end for t in b.column(1).slice(lo, size_).to_pylist()]
                placed, left = harmonic([len(x) // 4 for x in ids], capacity)
                rows = [(i, s, n, zlib.crc32(ids[i][4 * s : 4 * (s + n)]), len(ids[i]) // 4, number + q, o) for i, s, n, q, o in placed]
                for i, s, n in left:
                    for c in cut_lengths(n, capacity, least_cut):
                        rows.append((i, s, c, zlib.crc32(ids[i][4 * s : 4 * (s + c)]), len(ids[i]) // 4, None, None))
                        s += c
                number += 1 + max((p[3] for p in placed), default=-1)
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, size_).take(pa.array(columns[0], pa.int64())), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    numbers = "start long, length long, ids_crc32 long, doc_tokens long"
    made = durable(narrow.mapInArrow(run, f"doc {kind}, {numbers}, sequence_id long, offset long"), "pack-made", keep=True)
    pieces = made.where("sequence_id IS NULL").drop("sequence_id", "offset").withColumn("bucket", F.pmod(F.xxhash64("doc", "start", "ids_crc32"), F.lit(BUCKETS)).cast("int"))
    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))  # at most (least_cut + log2(capacity)) x BUCKETS rows
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    firsts = counts.withColumn("first", F.sum("n").over(before) - F.col("n")).withColumn("n_all", F.sum("n").over(Window.partitionBy("length"))).drop("n")
    order = Window.partitionBy("length", "bucket").orderBy("doc", "start", "ids_crc32", "doc_tokens")
    ranked = pieces.withColumn("no", F.row_number().over(order) - 1).join(F.broadcast(firsts), ["length", "bucket"])
    ranked = ranked.withColumn("no", F.col("no") + F.col("first")).withColumn("per_bin", F.floor(F.lit(capacity) / F.col("length")))
    ranked = durable(ranked.withColumn("bin", F.expr("no div per_bin")).withColumn("whole", F.expr("(bin + 1) * per_bin <= n_all")).drop("bucket", "first", "n_all"), "pack-ranked", keep=True)
    # ids of full bins: bin x (capacity + 1) + length; of the rest: below zero
    full = ranked.where("whole").withColumn("sequence_id", F.col("bin") * (capacity + 1) + F.col("length")).withColumn("offset", F.expr("no % per_bin") * F.col("length"))
    rest = ranked.where("NOT whole").select("doc", "start", "length", "ids_crc32", "doc_tokens", "no")
    fields = f"doc {kind}, {numbers}, no long, rest_bin long, offset long"
    packed = rest.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(lambda pdf: pack_rest(pdf.drop(columns="all"), capacity), fields).withColumn("sequence_id", -1 - F.col("rest_bin"))  # under (least_cut + log2) x capacity ids
    columns = [F.col("doc").alias(key), "start", "length", "ids_crc32", "doc_tokens", F.col("sequence_id").cast("long"), F.col("offset").cast("long")]
    return made.where("sequence_id IS NOT NULL").select(*columns).unionByName(full.select(*columns)).unionByName(packed.select(*columns))
