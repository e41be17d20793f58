"""Approximate nearest neighbours: a forest of random-projection trees and exact reranking.

Nearness is the inner product. Vectors get one more component that makes their norms equal,
so the largest inner product is the nearest vector. Each tree splits a bounded sample
(``sample_rows``) at the median of projections on the line between two random members,
down to ``leaves`` leaves; only these hyperplanes come from the sample, and every vector is
put into a leaf of every tree. A query searches all trees through one priority queue, whose
keys are the least margin on the way to a node, until the leaves taken hold
``search_share`` of all rows, and at least ``search_rows``. The vectors of those leaves are
reranked by the exact inner product in double precision.

Rows with the same id and vector are made one first. Leaves with many rows, as of a vector
that occurs under thousands of ids, are cut into shards by id and vector, and each shard is
searched by itself, so no task holds an unbounded leaf; the query's own rows are left out
before a shard's list is cut.

Defined cases: vectors that are null, empty, zero, of another length than the most common
one, or with null or non-finite components take no part, neither as queries nor as
candidates; rows with a null vec_id neither; a query with fewer candidates returns all of
them; equal scores go to the smaller vec_id; repeated rows with the same id and vector are
one vector; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import materialise

TOP = 20
TREES = 8
SHARD_ROWS = 512


class Forest:
    """Hyperplanes of complete binary trees, fitted on a sample."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.trees, self.depth = trees, depth
        inner = 2**depth - 1
        self.w = np.zeros((trees, inner, sample.shape[1]), np.float32)
        self.t = np.zeros((trees, inner), np.float32)
        for tree in range(trees):
            rows = {0: np.arange(len(sample))}
            for node in range(inner):
                own = rows.pop(node)
                if len(own) > 1:
                    a, b = rng.choice(own, 2, replace=False)
                    w = sample[a] - sample[b]
                    if not w.any():
                        w = rng.standard_normal(sample.shape[1])
                else:
                    w = rng.standard_normal(sample.shape[1])
                w = (w / np.linalg.norm(w)).astype(np.float32)
                p = sample[own] @ w
                t = np.median(p) if len(own) else 0.0
                self.w[tree, node], self.t[tree, node] = w, t
                rows[2 * node + 1], rows[2 * node + 2] = own[p <= t], own[p > t]

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Signed distances to all hyperplanes: (rows, trees, nodes)."""
        flat = x.astype(np.float32) @ self.w.reshape(-1, self.w.shape[2]).T - self.t.ravel()
        return flat.reshape(len(x), self.trees, -1)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree, numbered over all trees: (rows, trees)."""
        m = self.margins(x)
        out = np.zeros((len(x), self.trees), np.int64)
        for tree in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (m[np.arange(len(x)), tree, node] > 0)
            out[:, tree] = node - (2**self.depth - 1) + tree * 2**self.depth
        return out

    def search(self, margins: np.ndarray, rows: np.ndarray, wanted: int) -> list[int]:
        """Leaves of one query in the order of the shared queue, until they hold ``wanted`` rows."""
        inner = 2**self.depth - 1
        queue = [(0.0, tree, 0) for tree in range(self.trees)]
        found, total = [], 0
        while queue and total < wanted:
            key, tree, node = heapq.heappop(queue)
            while node < inner:
                m = float(margins[tree, node])
                near, far = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (key + m * m, tree, far))
                node = near
            leaf = node - inner + tree * 2**self.depth
            if rows[leaf]:
                found.append(leaf)
                total += int(rows[leaf])
        return found


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def lifted(x: np.ndarray, norm: float) -> np.ndarray:
    """The vectors with a component that gives all of them the length ``norm``."""
    x = x.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(norm**2 - (x * x).sum(1), 0))]).astype(np.float32)


def best(items: np.ndarray, ids: np.ndarray, query: np.ndarray, scores: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` items by exact score, then id; ``scores`` may be off by rounding."""
    if len(scores) > top:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - top)[len(scores) - top] - 1e-9 * (1 + abs(scores).max()))
    else:
        near = np.arange(len(scores))
    exact = (items[near] * query).sum(1)
    order = np.lexsort((ids[near], -exact))[:top]
    return ids[near][order], exact[order]


def _rows(found) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, id and score of each entry of lists (query_id, vec_ids, scores)."""
    query, ids, scores = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (found.column(i) for i in range(3)))
    size = np.diff(ids.offsets.to_numpy()) if len(ids) else np.zeros(0, np.int64)
    return np.repeat(query.to_numpy(zero_copy_only=False), size).astype(np.int64), ids.flatten().to_numpy(zero_copy_only=False), scores.flatten().to_numpy(zero_copy_only=False)


def merged(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's ``top`` distinct entries by score, then id, in the order of the queries."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    new = np.ones(len(ids), bool)
    new[1:] = (query[1:] != query[:-1]) | (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])
    query, ids, scores = query[new], ids[new], scores[new]
    first = np.ones(len(query), bool)
    first[1:] = query[1:] != query[:-1]
    start = np.maximum.accumulate(np.where(first, np.arange(len(query)), 0)) if len(query) else np.zeros(0, np.int64)
    keep = np.arange(len(query)) - start < top
    return query[keep], ids[keep], scores[keep]


def needed_share(forest: Forest, sample: np.ndarray, norm: float, top: int, target: float, queries: int = 64) -> float:
    """The share of rows that must be searched for ``target`` recall, measured within the sample by brute force."""
    q = np.arange(0, len(sample), max(1, len(sample) // queries))
    x = sample.astype(np.float64)
    leaf = forest.leaves(lifted(x, norm))
    rows = np.bincount(leaf.ravel(), minlength=forest.trees * 2**forest.depth)
    margins = forest.margins(np.column_stack([x[q], np.zeros(len(q))]))
    needed = []
    for i, row in enumerate(q):
        scores = x @ x[row]
        scores[row] = -np.inf
        nearest = np.argsort(-scores)[:top]
        order = forest.search(margins[i], rows, rows.sum() + 1)
        before = np.full(len(rows), np.inf)
        before[order] = np.cumsum(rows[order])
        needed.extend(before[leaf[nearest]].min(1))
    return float(np.quantile(needed, target)) / len(sample) if needed else 1.0


def nearest(vectors: DataFrame, modulus: int = 20, top: int = TOP, trees: int = TREES, depth: int = 7, sample_rows: int = 10000, target: float = 0.96, search_rows: int = 2000) -> DataFrame:
    """For each query, a row whose id is divisible by ``modulus``, its ``top`` nearest: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e")).filter("vec_id is not null and size(e) > 0 and forall(e, x -> x is not null and x = x and abs(x) < double('infinity')) and exists(e, x -> x <> 0)")
    size = v.groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None:
        return spark.createDataFrame([], schema)
    v = materialise(v.filter(F.size("e") == size["n"]).dropDuplicates(["vec_id", "e"]), "ann-vectors")
    total, norm = v.agg(F.count("*"), F.max(F.expr("sqrt(aggregate(e, double(0), (s, x) -> s + double(x) * double(x)))"))).first()
    unit = F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    sample = v.filter(unit < sample_rows / total).orderBy("vec_id").limit(2 * sample_rows).toArrow() if total > sample_rows else v.orderBy("vec_id").limit(sample_rows).toArrow()
    x = _matrix(sample.column("e"))
    if not len(x):
        x = np.zeros((1, size["n"]))
    depth = max(1, min(depth, int(np.log2(max(2, len(x) / 8)))))
    forest = Forest(lifted(x, norm), trees, depth)
    wanted = max(search_rows, int(np.ceil(needed_share(forest, x, norm, top, target) * total)))
    leaves = trees * 2**depth

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaf = forest.leaves(lifted(_matrix(b.column(1)), norm))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, leaf.size + 1, trees), pa.int32()), pa.array(leaf.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["vec_id", "e", "leaves"])

    element = v.schema["e"].dataType.elementType.simpleString()
    placed = materialise(v.select("vec_id", "e").mapInArrow(place, f"vec_id long, e array<{element}>, leaves array<int>"), "ann-leaves")
    rows = np.zeros(leaves, np.int64)
    for r in placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect():
        rows[r["leaf"]] = r["count"]
    shards = np.maximum(1, -(-rows // SHARD_ROWS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 128):
                part = b.slice(a, 128)
                q = _matrix(part.column(1)).astype(np.float64)
                margins = forest.margins(np.column_stack([q, np.zeros(len(q))]))
                own, leaf, shard = [], [], []
                for i in range(len(q)):
                    for n in forest.search(margins[i], rows, wanted):
                        own += [i] * shards[n]
                        leaf += [n] * shards[n]
                        shard += range(shards[n])
                take = part.take(pa.array(own, pa.int64()))
                yield pa.RecordBatch.from_arrays([take.column(0), take.column(1), pa.array(leaf, pa.int32()), pa.array(shard, pa.int32())], names=["vec_id", "e", "leaf", "shard"])

    asked = placed.filter(F.col("vec_id") % modulus == 0).select("vec_id", "e").mapInArrow(ask, f"vec_id long, e array<{element}>, leaf int, shard int")
    count = F.element_at(F.lit([int(s) for s in shards]), F.col("leaf") + 1)
    items = placed.select("vec_id", "e", F.explode("leaves").alias("leaf")).withColumn("shard", F.pmod(F.xxhash64("vec_id", "e"), count).cast("int"))

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[str, list] = {"query_id": [], "vec_ids": [], "scores": []}
        if left.num_rows and right.num_rows:
            x, ids = _matrix(left.column("e")).astype(np.float64), left.column("vec_id").to_numpy()
            q, asking = _matrix(right.column("e")).astype(np.float64), right.column("vec_id").to_numpy()
            for a in range(0, len(q), 256):
                for i, scores in enumerate(q[a : a + 256] @ x.T):
                    other = ids != asking[a + i]
                    near, exact = best(x, ids, q[a + i], scores, top) if other.all() else best(x[other], ids[other], q[a + i], scores[other], top)
                    found["query_id"].append(asking[a + i])
                    found["vec_ids"].append(near)
                    found["scores"].append(exact)
        return pa.table({"query_id": pa.array(found["query_id"], pa.int64()), "vec_ids": pa.array(found["vec_ids"], pa.list_(pa.int64())), "scores": pa.array(found["scores"], pa.list_(pa.float64()))})

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One list a query from all the groups of a task, so that what moves is bounded by the tasks, not by the groups."""
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for b in batches:
            kept = merged(*(np.concatenate(x) for x in zip(kept, _rows(b), strict=True)), top)
        query, ids, scores = kept
        cut = np.flatnonzero(np.diff(query, prepend=query[:1] - 1)) if len(query) else np.zeros(0, np.int64)
        at = pa.array(np.append(cut, len(query)), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(query[cut], pa.int64()), pa.ListArray.from_arrays(at, pa.array(ids, pa.int64())), pa.ListArray.from_arrays(at, pa.array(scores, pa.float64()))], names=["query_id", "vec_ids", "scores"])

    def merge(group: pa.Table) -> pa.Table:
        query, ids, scores = merged(*_rows(group), top)
        return pa.table({"query_id": pa.array(query, pa.int64()), "rank": pa.array(np.arange(1, len(ids) + 1), pa.int32()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.float64())})

    lists = "query_id long, vec_ids array<long>, scores array<double>"
    found = items.groupBy("leaf", "shard").cogroup(asked.groupBy("leaf", "shard")).applyInArrow(rank, lists).mapInArrow(of_task, lists)
    return found.groupBy("query_id").applyInArrow(merge, schema)


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
