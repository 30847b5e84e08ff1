"""Exact top-k by inner product: a dual-tree search over cover trees.

Queries and data are both indexed by trees whose nodes have a centre and a covering radius. For a pair of nodes no inner product of members exceeds
<cq, cp> + rq |cp| + rp |cq| + rq rp, so a pair whose bound lies below the worst k-th score of the query node's members is dropped with everything
beneath it; other pairs are opened, nearest first, down to leaves, where scores are computed by matrix products.

How it runs: queries are taken in blocks of at most QUERY_BLOCK, each broadcast in turn. Every task streams its share of the data in chunks of at most
DATA_CHUNK vectors, indexes each chunk, searches it with the block's tree, and keeps k rows a query. What the queries find among themselves is a first lower bound for
all tasks, so tasks return little; the best k of these rows are the answer. No limit on candidates: the result is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, scoped, whole_row
from .vectors import by_dimension, is_sound

QUERY_BLOCK, DATA_CHUNK = 16384, 8192
#: A node's children lie closer to their centres by this factor, if FANOUT of them can do that; nodes of LEAF members are not split.
SHRINK, FANOUT, LEAF = 1.6, 24, 96


class CoverTree:
    """Nodes in arrays: centre, radius, the member rows and children. Children's centres are members, the first the parent's own (nesting); every member lies
    within the radius, which is measured, of its node's centre (covering); centres are picked farthest first (separation)."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.norms = np.sqrt(np.einsum("ij,ij->i", points, points))
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.members: list[np.ndarray] = []
        self.children: list[list[int]] = []
        if len(points):
            self._grow(0, np.arange(len(points)), self._distances(0, np.arange(len(points))))

    def _distances(self, centre: int, rows: np.ndarray) -> np.ndarray:
        d = self.points[rows] - self.points[centre]
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def _grow(self, centre: int, rows: np.ndarray, far: np.ndarray) -> int:
        todo = [(-1, centre, rows, far)]
        while todo:
            parent, centre, rows, far = todo.pop()
            node = len(self.centre)
            self.centre.append(centre)
            self.radius.append(float(far.max()))
            self.members.append(rows)
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if len(rows) <= LEAF or self.radius[node] == 0:
                continue
            nearest, owner, centres, target = far.copy(), np.zeros(len(rows), int), [centre], self.radius[node] / SHRINK
            while len(centres) < FANOUT and nearest.max() > target:
                c = int(rows[nearest.argmax()])
                d = self._distances(c, rows)
                closer = d < nearest
                owner[closer], nearest = len(centres), np.minimum(nearest, d)
                centres.append(c)
            if len(centres) == 1:
                continue
            for i, c in enumerate(centres):
                mine = owner == i
                if mine.any():
                    todo.append((node, c, rows[mine], nearest[mine]))
        return 0


class Best:
    """The k best (score, id) of each query: scores descending, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo("int64").max)
        self.floor = np.full(n, -np.inf)

    def worst(self, rows: np.ndarray) -> float:
        """The lowest score that a row of any of these queries must reach."""
        return float(np.maximum(self.scores[rows, -1], self.floor[rows]).min())

    def offer(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        bar = np.maximum(self.scores[rows, -1], self.floor[rows])
        good = scores >= bar[:, None]
        for i in np.flatnonzero(good.any(axis=1)):
            r, m = rows[i], good[i]
            s, x = np.concatenate([self.scores[r], scores[i, m]]), np.concatenate([self.ids[r], ids[m]])
            order = np.lexsort((x, -s))[: self.k]
            self.scores[r], self.ids[r] = s[order], x[order]


def dual_search(queries: CoverTree, query_ids: np.ndarray, data: CoverTree, data_ids: np.ndarray, best: Best) -> int:
    """Offer `best` all data rows that can be among the k best of a query. Returns the number of scores computed."""
    if not len(query_ids) or not len(data_ids):
        return 0
    computed = 0
    todo = [(np.inf, 0, 0)]
    while todo:
        bound, q, p = todo.pop()
        rows = queries.members[q]
        if bound < best.worst(rows):
            continue
        open_q = bool(queries.children[q]) and (queries.radius[q] >= data.radius[p] or not data.children[p])
        if not open_q and not data.children[p]:
            cols = data.members[p]
            scores = queries.points[rows] @ data.points[cols].T
            scores[query_ids[rows][:, None] == data_ids[cols][None, :]] = -np.inf
            computed += scores.size
            best.offer(rows, data_ids[cols], scores)
            continue
        pairs = [(c, p) for c in queries.children[q]] if open_q else [(q, c) for c in data.children[p]]
        a, b = np.array([x for x, _ in pairs]), np.array([x for _, x in pairs])
        cq, cp = np.array(queries.centre)[a], np.array(data.centre)[b]
        rq, rp = np.array(queries.radius)[a], np.array(data.radius)[b]
        middle = np.einsum("ij,ij->i", queries.points[cq], data.points[cp])
        bounds = middle + rq * data.norms[cp] + rp * queries.norms[cq] + rq * rp
        bounds += 1e-9 * (np.abs(bounds) + 1)  # what rounding may have taken
        todo.extend((float(bounds[i]), int(a[i]), int(b[i])) for i in np.argsort(bounds, kind="stable"))
    return computed


@scoped
def exact_topk(vectors: DataFrame, is_query: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = 10, scale: float = 1024.0) -> DataFrame:
    """The k rows with the highest integer inner product for each query row.

    Components become floor(scale * x). is_query is an expression over the column `key`. Returns query_id, rank (from 1), `key` and score (long), ties to the smaller key. Candidates are all rows but those with the
    query's own key; a query has fewer rows if there are fewer candidates. Vectors that are null, empty or hold null or non-finite components take no part; vectors of another dimension than the query's are no
    candidates. Rows that repeat a key are separate candidates, and repeated query rows are one query by their first vector. Null keys take no part. Empty tables give no rows. Exact while scores stay below 2^53.
    """
    spark = vectors.sparkSession
    row = whole_row(vectors)
    sound = vectors.select(row.getField(key).cast("long").alias(key), row.getField(vector).alias("_v")).where(F.col(key).isNotNull() & is_sound(F.col("_v")))
    ints = sound.select(F.col(key).alias("id"), F.transform("_v", lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("double")).alias("v"))
    asked = sound.where(is_query).select(F.col(key).alias("id"), F.transform("_v", lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("double")).alias("v"))
    asked = durable(asked, "topk-queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    schema = "query_id long, id long, score long"
    parts = []
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow().sort_by("id").combine_chunks()
        taken: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if rows.num_rows:
            ids = rows["id"].to_numpy()
            for d, (at, m) in by_dimension(rows["v"].combine_chunks() if isinstance(rows["v"], pa.ChunkedArray) else rows["v"]).items():
                _, first = np.unique(ids[at], return_index=True)
                own = CoverTree(m[first])
                best = Best(len(first), k)
                dual_search(own, ids[at][first], own, ids[at][first], best)
                taken[d] = (ids[at][first], m[first], best.scores[:, -1])
        sent = spark.sparkContext.broadcast(taken)  # about QUERY_BLOCK vectors

        def search(batches, sent=sent):
            state = {}
            for d, (query_ids, points, floor) in sent.value.items():
                best = Best(len(query_ids), k)
                best.floor = floor
                state[d] = (CoverTree(points), query_ids, best, [], [])

            def run(d):
                tree, query_ids, best, held_ids, held = state[d]
                if held:
                    dual_search(tree, query_ids, CoverTree(np.concatenate(held)), np.concatenate(held_ids), best)
                    held.clear()
                    held_ids.clear()

            for b in batches:
                ids = b.column(0).to_numpy(zero_copy_only=False)
                for d, (at, m) in by_dimension(b.column(1)).items():
                    if d not in state:
                        continue
                    for i in range(0, len(at), DATA_CHUNK):
                        state[d][3].append(ids[at[i : i + DATA_CHUNK]])
                        state[d][4].append(m[i : i + DATA_CHUNK])
                        if sum(map(len, state[d][3])) >= DATA_CHUNK:
                            run(d)
            for d in state:
                run(d)
                _, query_ids, best, _, _ = state[d]
                q, c = np.nonzero(np.isfinite(best.scores))
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[q], pa.int64()), pa.array(best.ids[q, c], pa.int64()), pa.array(best.scores[q, c].astype("int64"), pa.int64())], names=["query_id", "id", "score"])

        found = ints.mapInArrow(search, schema)
        parts.append(durable(found, "topk-block", keep=True) if blocks > 1 else found)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), F.col("id").alias(key), "score")
