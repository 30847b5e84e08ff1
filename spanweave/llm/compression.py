"""Classification by compression: zstandard with raw-content dictionaries, one for each class.

A text that resembles a dictionary's content compresses better against it. Texts are compressed whole, in chunks, so that the dictionary
stays in reach however long the text is.
"""

from __future__ import annotations

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def fold(key):
    """The fold of a row: crc32 of its id as text, modulo 4. Fold 2 is held out. A null id lies in fold 0."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(4)).cast("int")


def bounded_sample(rows: DataFrame, klass: str, per_class: int) -> DataFrame:
    """About per_class rows of each class, all of a smaller one: a count of the classes and a filter by the hash of the columns `key` and `mark`, so that nothing is sorted or brought together.

    Rows that are equal in both come all or none, so callers make `mark` tell repeated keys apart.
    """
    counts = {r[klass]: r["n"] for r in rows.groupBy(klass).agg(F.count("*").alias("n")).collect()}  # one row a class
    spread = 1 << 20
    share = F.lit(0)
    for value, n in counts.items():
        share = F.when(F.col(klass) == F.lit(value), F.lit(min(spread, -(-per_class * spread // n)))).otherwise(share)
    return rows.where(F.pmod(F.xxhash64("key", "mark"), F.lit(spread)) < share)


def compressor(content: bytes, level: int, chunk: int) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(level, source_size=chunk, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False)
    if len(content) < 8:
        return zstandard.ZstdCompressor(compression_params=params)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=params)


def size(c: zstandard.ZstdCompressor, data: bytes, chunk: int) -> int:
    """Bytes of data compressed in chunks; 0 for none."""
    if len(data) <= chunk:
        return len(c.compress(data)) if data else 0
    return sum(len(c.compress(data[i : i + chunk])) for i in range(0, len(data), chunk))


def pieces(data: bytes, each: int, most: int = 4) -> bytes:
    """At most `each` bytes of a text: all of a short one, else up to `most` pieces spread over the whole of it."""
    if len(data) <= each:
        return data
    size_, last = each // most - 1, most - 1
    return b"\n".join(data[at : at + size_] for at in ((len(data) - size_) * i // last for i in range(most)))


def content(parts: list[bytes], limit: int) -> bytes:
    """Raw dictionary content: parts in order, up to `limit` bytes in all."""
    out, n = [], 0
    for p in parts:
        out.append(p)
        n += len(p) + 1
        if n >= limit:
            break
    return b"\n".join(out)[:limit]
