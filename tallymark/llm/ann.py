"""Approximate nearest neighbours by collision counting.

``PROJECTIONS`` random directions each give a sorted array of the vectors' projections. A query opens a
window around its own projection in every array; a vector that lies in at least ``MIN_SHARE`` of the
windows has collided often enough and is verified by its exact cosine. Windows widen by ``GROWTH``
(virtual rehashing: the arrays stay as they are, only newly covered stretches are counted) until a
vector as near as the k-th found would have been verified with probability ``SURE``; a query for which
that never happens ends with windows over everything, which is a full search.

Rows are dealt to blocks of about ``BLOCK`` vectors that lie near each other: up to ``ANCHORS`` rows, chosen by a
hash of their ids, are the anchors of cells, each row belongs to the cell of its nearest anchor, small cells share
a block and large ones are dealt over several by hash. The task of a block sorts its arrays and streams the
stated queries past them from the shared folder, so neither side is gathered or sent to the driver. A query
knows its k-th best cosine among the anchors; a block all of whose vectors are farther than that, by the
triangle inequality of angles over its cells, is passed over without loss, so that in data with clusters the
work does not grow with queries times blocks. Each block yields at most k rows a query and these meet by query id.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part,
as queries or candidates; vectors of other lengths than the query's are no candidates of it; ties go to
the smaller id; a row is no candidate of queries of its own id; repeated rows are candidates each, and a
repeated query is answered once; an empty table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import opened_fs, scratch, shipped, stored, table

PROJECTIONS, MIN_SHARE, GROWTH, SURE = 24, 0.6, 1.5, 0.97
BLOCK = 16_384
ANCHORS, PER_BLOCK = 4096, 16  #: anchors at most, and for each block
START = 0.12  #: half of the first windows, for vectors of length 1
K, EVERY = 5, 50
HALVES = np.append(START * GROWTH ** np.arange(12), np.inf)  #: of the windows


def _tail(p: float, m: int, least: int) -> float:
    """P(at least ``least`` of m) at p each."""
    if p >= 1:
        return 1.0
    return sum(math.comb(m, i) * p**i * (1 - p) ** (m - i) for i in range(least, m + 1))


class CollisionIndex:
    """ids: int64; x: vectors, all of one length and valid."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, m: int = PROJECTIONS, seed: int = 3):
        self.ids, self.x = ids, x
        self.norm = np.sqrt((x * x).sum(axis=1))
        self.a = np.random.default_rng(seed).normal(size=(x.shape[1], m))
        p = ((x / self.norm[:, None]) @ self.a).T
        self.order = np.argsort(p, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(p, self.order.astype(np.int64), axis=1)
        self.m, self.least = m, math.ceil(MIN_SHARE * m)

    def search(self, own: int, q: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the k nearest found, nearest first."""
        norm = math.sqrt(float((q * q).sum()))
        at = (q / norm) @ self.a
        n, m = self.sorted.shape[1], self.m
        # all windows' ends at once; the last window holds everything
        ends = np.concatenate([HALVES, -HALVES])
        spans = np.array([np.searchsorted(row, v + ends) for row, v in zip(self.sorted, at)])
        his, los = spans[:, : len(HALVES)], spans[:, len(HALVES) :]
        lo = hi = los[:, 0]
        counts = np.zeros(n, np.int16)
        fresh = self.ids != own
        best_i, best_s = np.zeros(0, np.int64), np.zeros(0)
        for level, half in enumerate(HALVES):
            new_lo, new_hi = los[:, level], his[:, level]
            for order, a, b, c, d in zip(self.order, new_lo.tolist(), lo.tolist(), hi.tolist(), new_hi.tolist()):
                if level == 0:
                    counts[order[a:d]] += 1
                    continue
                if a < b:
                    counts[order[a:b]] += 1
                if c < d:
                    counts[order[c:d]] += 1
            lo, hi = new_lo, new_hi
            found = np.nonzero((counts >= self.least) & fresh)[0]
            if len(found):
                fresh[found] = False
                best_i = np.concatenate([best_i, found])
                # row by row, so that a score does not depend on where in the block a vector lies
                best_s = np.concatenate([best_s, (self.x[found] * q).sum(axis=1) / (self.norm[found] * norm)])
                keep = np.lexsort((self.ids[best_i], -best_s))[:k]
                best_i, best_s = best_i[keep], best_s[keep]
            if not fresh.any():
                break
            if len(best_i) == k:
                far = math.sqrt(max(0.0, 2 - 2 * float(best_s[-1])))  # distance of the k-th on the sphere
                p = math.erf(float(half) / far / math.sqrt(2)) if far > 0 else 1.0
                if _tail(p, m, self.least) >= SURE:
                    break
        return self.ids[best_i], best_s


def valid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec (doubles) of the rows that take part."""
    v = F.col("vec")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(v.isNotNull() & F.col("id").isNotNull() & finite & F.exists(v, lambda x: x != 0))


FOUND = "query_id long, vec_id long, score double"
Anchors = dict[int, tuple[np.ndarray, np.ndarray]]  #: by length: ids, and vectors of length 1


def by_length(ids: pa.Array, vecs: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """length, places, ids and vectors of the rows of each length."""
    size = np.diff(vecs.offsets.to_numpy())
    flat, at = vecs.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)])
    for d in np.unique(size):
        own = np.nonzero(size == d)[0]
        yield int(d), own, ids.to_numpy()[own], flat[at[own][:, None] + np.arange(d)]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def anchors_of(rows: DataFrame, count: int) -> Anchors:
    """``count`` rows, the same ones each time; never more than ANCHORS come to the driver."""
    got = rows.orderBy(F.xxhash64("id"), "id").limit(min(count, ANCHORS)).collect()
    out: dict[int, list] = {}
    for r in got:
        out.setdefault(len(r.vec), []).append((r.id, r.vec))
    return {d: (np.array([i for i, _ in rs]), _unit(np.array([v for _, v in rs], np.float64))) for d, rs in out.items()}


def with_cells(rows: DataFrame, anchors: Anchors) -> DataFrame:
    """rows with ``cell``, the place of the nearest anchor of their length; -1 where there is none."""
    shared = rows.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = dict(zip(shared.value, np.cumsum([0, *(len(i) for i, _ in shared.value.values())]).tolist()))
        for batch in batches:
            cell = np.full(batch.num_rows, -1, np.int64)
            for d, own, _, x in by_length(batch.column(0), batch.column(1)):
                if d in shared.value:
                    cell[own] = first[d] + (_unit(x) @ shared.value[d][1].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["id", "vec", "cell"])

    return rows.mapInArrow(run, "id long, vec array<double>, cell long")


def with_bounds(queries: DataFrame, anchors: Anchors, k: int) -> DataFrame:
    """queries with ``least``: their k-th best cosine among anchors, which the k-th best of all is not below; -2
    where there are fewer."""
    shared = queries.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = np.full(batch.num_rows, -2.0)
            for d, own, ids, x in by_length(batch.column(0), batch.column(1)):
                if d in shared.value and len(shared.value[d][0]) > k:
                    s = _unit(x) @ shared.value[d][1].T
                    s[ids[:, None] == shared.value[d][0]] = -2.0
                    least[own] = np.partition(s, -k, axis=1)[:, -k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least)], ["id", "vec", "least"])

    return queries.mapInArrow(run, "id long, vec array<double>, least double")


def dealt(rows: DataFrame, block: int) -> tuple[DataFrame, int]:
    """rows (id, vec, cell) with ``block``, and how many blocks there are. Cells are counted, at most ANCHORS of them,
    and laid one after another."""
    counts = sorted((r.cell, r.n) for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect())
    plan, at, held = [], 0, 0
    for cell, n in counts:
        if held and held + n > block:
            at, held = at + 1, 0
        parts = -(-n // block)
        plan.append((cell, at, parts))
        # parts are dealt by hash, so a cell of several fills its blocks
        at, held = (at, held + n) if parts == 1 else (at + parts - 1, block)
    spark = rows.sparkSession
    where = spark.createDataFrame(plan, "cell long, first long, parts long")
    return rows.join(F.broadcast(where), "cell").select("id", "vec", "cell", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block")), at + 1


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of vectors for each row of queries."""
    spark = shipped(vectors.sparkSession)
    rows = valid(vectors, id_col, vec_col)
    blocks = max(1, -(-rows.count() // block))
    anchors = anchors_of(rows, PER_BLOCK * blocks) if blocks > 1 else {}
    path = scratch(spark, "queries")
    with_bounds(valid(queries, id_col, vec_col).dropDuplicates(["id"]), anchors, k).write.parquet(path)
    shared = spark.sparkContext.broadcast(anchors)

    def of_block(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Searches one block for all queries that it may hold a result of."""
        parts = pa.Table.from_batches(held).combine_chunks()
        cell = parts.column(2).to_numpy()
        index, near = {}, {}
        first = 0
        starts = {}
        for d, (ids, _) in shared.value.items():
            starts[d], first = first, first + len(ids)
        for d, own, ids, x in by_length(parts.column(0).chunk(0), parts.column(1).chunk(0)):
            index[d] = CollisionIndex(ids, x)
            if d in shared.value:  # the widest angle of each cell's vectors in this block
                cells, back = np.unique(cell[own], return_inverse=True)
                a = shared.value[d][1][cells - starts[d]]
                angle = np.arccos(np.clip((_unit(x) * a[back]).sum(axis=1), -1, 1))
                wide = np.zeros(len(cells))
                np.maximum.at(wide, back, angle)
                near[d] = (a, wide)
        fs, root = opened_fs(path)
        for batch in pads.dataset(root, filesystem=fs, format="parquet").to_batches(batch_size=1024):
            out: list[tuple] = []
            least = batch.column("least").to_numpy()
            for d, own, ids, q in by_length(batch.column("id"), batch.column("vec")):
                if d not in index:
                    continue
                may = np.ones(len(own), bool)
                if d in near:
                    a, wide = near[d]
                    apart = np.arccos(np.clip(_unit(q) @ a.T, -1, 1)) - wide
                    may = np.cos(np.clip(apart.min(axis=1), 0, np.pi)) >= least[own] - 1e-9
                for i in np.nonzero(may)[0]:
                    found, scores = index[d].search(int(ids[i]), q[i], k)
                    out += [(int(ids[i]), v, s) for v, s in zip(found.tolist(), scores.tolist())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            key = batch.column(3).to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and key[a] != now:
                    yield from of_block(held)
                    held = []
                now = key[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from of_block(held)

    if blocks > 1:
        rows, blocks = dealt(stored(with_cells(rows, anchors), "cells"), block)
    else:
        rows = rows.select("id", "vec", F.lit(-1).cast("long").alias("cell"), F.lit(0).cast("long").alias("block"))
    # a task a block: hashing would give some tasks several and others none
    found = rows.repartitionById(blocks, F.pmod("block", F.lit(blocks)).cast("int")).sortWithinPartitions("block").mapInArrow(search, FOUND)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % EVERY == 0))


ORACLES = {}
QUERIES = {"op10_nearest": op10_nearest}
