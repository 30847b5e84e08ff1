"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` points on a ring of `cells` positions; a key belongs to the first point at or clockwise of its
hash. Loads are bounded: a shard takes rows only up to its capacity, and what exceeds it continues clockwise to the next
point of a shard that has room. Rows enter in ring order, so the outcome depends on the keys alone.

How it runs: one scan makes narrow rows (key, size, checksum, arc). A count per arc part, bounded by
shards x vnodes x parts whatever the number of rows, goes to the driver, which sweeps the ring once. It yields intervals of
row numbers within an arc part, at most (arc parts + shards) of them, and these are broadcast back. No row passes through the driver
and no task holds more than one arc part.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, rows_literal, scoped, whole_row

RING_CELLS = 1 << 16
ARC_PARTS = 8


def ring_points(n_shards: int, vnodes: int, cells: int = RING_CELLS) -> list[tuple[int, int]]:
    """(cell, shard) in ring order. A point that meets another at its cell goes; the smaller shard stays."""
    points: dict[int, int] = {}
    for shard in range(n_shards):
        for v in range(vnodes):
            cell = int.from_bytes(hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest(), "big") % cells
            points.setdefault(cell, shard)
    return sorted(points.items())


def capacities(n_rows: int, n_shards: int, slack: float) -> list[int]:
    """Rows that each shard may take. No slack: the counts that are at most one apart."""
    if slack > 0:
        return [int(-(-n_rows * (1 + slack) // n_shards))] * n_shards
    return [n_rows // n_shards + (s < n_rows % n_shards) for s in range(n_shards)]


def sweep(counts: dict[tuple[int, int], int], owners: list[int], room: list[int]) -> list[dict]:
    """Fill shards in ring order; overflow continues clockwise.

    counts: rows of each (arc, part); owners: the shard of each arc. Returns intervals [lo, hi) of row numbers in an arc part,
    each with its shard and the slot of its first row.
    """
    room, used, out, n = list(room), [0] * len(room), [], len(owners)
    if sum(room) < sum(counts.values()):
        raise ValueError("the shards have less room than there are rows")
    onward = [(a + 1) % n for a in range(n)]

    def open_arc(a: int) -> int:
        closed = []
        while room[owners[a]] == 0:
            closed.append(a)
            a = onward[a]
        for x in closed:
            onward[x] = a
        return a

    for (arc, part), left in sorted(counts.items()):
        lo = 0
        while left:
            shard = owners[open_arc(arc)]
            take = min(left, room[shard])
            out.append({"arc": arc, "part": part, "lo": lo, "hi": lo + take, "shard": shard, "base": used[shard]})
            room[shard] -= take
            used[shard] += take
            lo, left = lo + take, left - take
    return out


@scoped
def ring_shards(docs: DataFrame, n_shards: int, *, key: str = "doc_id", text: str = "text", vnodes: int = 64, slack: float = 0.0) -> DataFrame:
    """Place each row of docs on one shard by the ring; slack 0 makes row counts differ by one at most.

    Returns key, size (UTF-8 bytes plus 16), text_crc32, shard and slot (gapless from 0 in each shard). A null text has size 16 and the
    checksum 0 of the empty text. Null keys share one place on the ring. Rows that repeat a key share an arc but are dealt over its parts
    by size and checksum, and overflow parts them further. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    points = ring_points(n_shards, vnodes)
    cells, owners = [c for c, _ in points], [s for _, s in points]
    narrow = docs.select(whole_row(docs).alias("r")).select(
        F.col("r").getField(key).alias("key"),
        (F.coalesce(F.octet_length(F.col("r").getField(text)), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("r").getField(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    arcs = [{"arc": i, "from_cell": cells[i - 1] + 1 if i else 0, "to_cell": c} for i, c in enumerate(cells)]
    arcs.append({"arc": 0, "from_cell": cells[-1] + 1, "to_cell": RING_CELLS - 1})
    arcs = [a for a in arcs if a["from_cell"] <= a["to_cell"]]
    ring = rows_literal(spark, json.dumps(arcs), "arc int, from_cell int, to_cell int").select("arc", F.explode(F.sequence("from_cell", "to_cell")).alias("cell"))
    hashed = narrow.withColumn("h", F.xxhash64("key")).withColumn("cell", F.pmod("h", F.lit(RING_CELLS)).cast("int"))
    placed = durable(
        hashed.join(F.broadcast(ring), "cell").withColumn("part", F.pmod(F.xxhash64("h", "size", "text_crc32"), F.lit(ARC_PARTS)).cast("int")).drop("cell"),  # RING_CELLS rows at most
        "ring-placed",
        keep=True,
    )
    counts = {(x["arc"], x["part"]): x["n"] for x in placed.groupBy("arc", "part").agg(F.count("*").alias("n")).collect()}  # shards x vnodes x ARC_PARTS rows at most
    cuts = sweep(counts, owners, capacities(sum(counts.values()), n_shards, slack))
    cuts_table = rows_literal(spark, json.dumps(cuts), "arc int, part int, lo long, hi long, shard int, base long")
    order = Window.partitionBy("arc", "part").orderBy("h", "key", "size", "text_crc32")
    ranked = placed.withColumn("rank", (F.row_number().over(order) - 1).cast("long"))
    joined = ranked.join(F.broadcast(cuts_table), ["arc", "part"]).where("rank >= lo AND rank < hi")  # arc parts + shards rows at most
    return joined.select(F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"))

