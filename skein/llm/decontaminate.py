"""Benchmark decontamination: q-gram lemma filter in diagonal bands, then banded alignment.

Texts and benchmark items are normalised to lower-case ASCII letters, other bytes as they
are, and single spaces for white space and punctuation. An item has a window of ``WINDOW``
bytes at every byte; shorter items are one window. A window of m bytes that occurs in a text
with at most e edits shares m - q + 1 - q*e of its q-grams with it, on diagonals that differ
by at most e; so shared q-grams are collected in overlapping bands of diagonals, and windows
that reach the bound within a band are verified by banded alignment: first the one at the
band's densest place, then, where that fails, all others. Any run of ``WINDOW`` bytes of an
item that a text holds within the budget is found, wherever it starts; shorter runs are not.

The benchmark goes to the workers in blocks of at most ``block_bytes``; a larger benchmark
takes more passes over the texts, without a shuffle.

Defined cases: null or empty texts hold nothing; null items and items with fewer than
``Q`` bytes take no part; repeated items are reported by each of their ids; each document
row gives one row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import as_lists, fresh, materialise, slices

Q = 10
WINDOW = 96
RATE = 0.08
GAP = 32
BLOCK_BYTES = 4 << 20
TEXT_BYTES = 2 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*range(0, 33), *range(33, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = 32


def normalise(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of all texts with ``GAP`` zero bytes before each text and at the end, and each text's start."""
    folded = _FOLD[data]
    keep = np.ones(len(folded), bool)
    keep[1:] = ~((folded[1:] == 32) & (folded[:-1] == 32))
    keep[ends[:-1][ends[:-1] < len(folded)]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])[ends]
    size = np.diff(kept)
    starts = np.concatenate([[0], np.cumsum(size + GAP)[:-1]]) + GAP if len(size) else np.zeros(0, np.int64)
    out = np.zeros(int(size.sum()) + GAP * (len(size) + 1), np.uint8)
    at = np.repeat(starts - kept[:-1], size) + np.arange(int(size.sum()))
    out[at] = folded[keep]
    return out, starts


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit key of the ``Q`` bytes from each position on (two overlapping words of 8 bytes, mixed)."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    k = data.astype(np.uint64)
    for s in (1, 2, 4):
        k = (k[:-s] << np.uint64(8 * s)) | k[s:]
    return (k[:n] * np.uint64(0x9E3779B97F4A7C15)) ^ (k[Q - 8 : Q - 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F))


class Index:
    """The items of a block and where each of their q-grams stands."""

    def __init__(self, items: list[tuple[int, str]]):
        self.text, self.item, self.size, self.budget = [], [], [], []
        keys, owns, offs = [], [], []
        for item, text in items:
            raw = np.frombuffer(text.encode(), np.uint8)
            data, starts = normalise(raw, np.array([0, len(raw)]))
            data = data[GAP:-GAP]
            data = np.frombuffer(data.tobytes().strip(), np.uint8)
            if len(data) < Q:
                continue
            k = grams(data)
            m = min(WINDOW, len(data))
            keys.append(k)
            owns.append(np.full(len(k), len(self.text)))
            offs.append(np.arange(len(k)))
            self.text.append(data)
            self.item.append(item)
            self.size.append(m)
            self.budget.append(max(0, min(int(RATE * m), (m - Q) // Q)))
        self.size, self.budget, self.item = np.array(self.size, int), np.array(self.budget, int), np.array(self.item, np.int64)
        self.length = np.array([len(t) for t in self.text], int)
        self.longest = int(self.length.max()) if len(self.length) else 0
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.own = np.concatenate(owns)[order] if len(keys) else np.zeros(0, int)
        self.off = np.concatenate(offs)[order] if len(keys) else np.zeros(0, int)
        self.keys, self.first = np.unique(keys[order], return_index=True)
        self.many = np.diff(np.append(self.first, len(order)))
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    def candidates(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of window starts, in a band of diagonals, whose windows reach the q-gram bound: item, first diagonal, first and last start.

        The rows of one band stand together.
        """
        none = np.zeros(0, np.int64)
        g = grams(data)
        if not len(self.keys) or not len(g):
            return none, none, none, none
        pos = np.flatnonzero(self.bits[(g >> np.uint64(42)).astype(np.int64)])
        at = np.searchsorted(self.keys, g[pos])
        at[at == len(self.keys)] = 0
        same = self.keys[at] == g[pos]
        pos, at = pos[same], at[same]
        many = self.many[at]
        row = np.repeat(self.first[at] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        own, off = self.own[row], self.off[row]
        diagonal = np.repeat(pos, many) - off + self.longest
        width = np.maximum(self.budget[own], 1)
        band = diagonal // width
        # a band holds the diagonals of two neighbouring steps, so any e + 1 diagonals lie in one band
        seen = _unique_pairs(np.concatenate([own, own]) * (1 << 40) + np.concatenate([band, band - 1]), np.concatenate([off, off]))
        key, off = seen[:, 0], seen[:, 1]
        own = key >> 40
        need = self.size[own] - Q + 1 - Q * self.budget[own]
        # the need-th q-gram from each one on, in the same band and within one window
        end = np.arange(len(key)) + need - 1
        inside = end < len(key)
        end[~inside] = 0
        ok = inside & (key[end] == key) & (off[end] - off <= self.size[own] - Q)
        key, own, first, last = key[ok], own[ok], off[ok], off[end[ok]]
        low, high = np.maximum(last - (self.size[own] - Q), 0), np.minimum(first, self.length[own] - self.size[own])
        return own, (key & ((1 << 40) - 1)) * np.maximum(self.budget[own], 1) - self.longest, low, high

    def verify(self, data: np.ndarray, own: np.ndarray, diagonal: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the item's window from ``at`` on aligns with the text within its budget on diagonals near the band."""
        ok = np.zeros(len(own), bool)
        padded = np.concatenate([np.zeros(WINDOW * 2, np.uint8), data, np.zeros(WINDOW * 2, np.uint8)])
        for shape in np.unique(np.column_stack([self.size[own], self.budget[own]]), axis=0) if len(own) else []:
            m, e = int(shape[0]), int(shape[1])
            width = 2 * max(e, 1) + 2 * e
            rows = np.flatnonzero((self.size[own] == m) & (self.budget[own] == e))
            for i in range(0, len(rows), 4096):
                r = rows[i : i + 4096]
                text = padded[(diagonal[r] + at[r] - e + 2 * WINDOW)[:, None] + np.arange(m + width)]
                pattern = np.stack([self.text[w][s : s + m] for w, s in zip(own[r], at[r], strict=True)])
                cost = np.zeros((len(r), width), np.int32)
                step = np.arange(width, dtype=np.int32)
                for j in range(m):
                    new = cost + (text[:, j : j + width] != pattern[:, j : j + 1])
                    new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
                    cost = np.minimum.accumulate(new - step, axis=1) + step
                ok[r] = cost.min(1) <= e
        return ok

    def find(self, texts: pa.Array) -> list[set[int]]:
        """The items found in each text."""
        binary = texts.cast(pa.large_binary())
        ends = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
        raw = np.frombuffer(binary.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        data, starts = normalise(raw, ends - ends[0])
        own, diagonal, low, high = self.candidates(data)
        found: list[set[int]] = [set() for _ in range(len(texts))]
        if not len(own):
            return found
        doc = np.maximum(np.searchsorted(starts, diagonal + (low + high) // 2 + self.size[own] // 2, "right") - 1, 0)
        pair = np.unique(np.column_stack([doc, own]), axis=0, return_inverse=True)[1].ravel()
        # the narrowest run of starts of each band is its densest place
        order = np.lexsort((high - low, diagonal, pair))
        lead = np.ones(len(order), bool)
        lead[1:] = (pair[order][1:] != pair[order][:-1]) | (diagonal[order][1:] != diagonal[order][:-1])
        best = order[lead]
        hit = np.zeros(pair.max() + 1, bool)
        hit[pair[best[self.verify(data, own[best], diagonal[best], (low[best] + high[best]) // 2)]]] = True
        rest = np.flatnonzero(~hit[pair])
        for i in range(0, len(rest), 4096):
            r = rest[i : i + 4096]
            r = r[~hit[pair[r]]]
            n = high[r] - low[r] + 1
            row = np.repeat(r, n)
            at = np.repeat(low[r] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            if len(row):
                one = np.unique(np.column_stack([pair[row], diagonal[row], at]), axis=0, return_index=True)[1]
                row, at = row[one], at[one]
                hit[pair[row[self.verify(data, own[row], diagonal[row], at)]]] = True
        for d, w in np.unique(np.column_stack([doc, own])[hit[pair]], axis=0):
            found[int(d)].add(int(self.item[w]))
        return found


def _unique_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return np.column_stack([a[new], b[new]])


def benchmark_blocks(benchmark: DataFrame, block_bytes: int) -> tuple[int, Iterator[list[tuple[int, str]]]]:
    """The number of blocks of about ``block_bytes`` and the items of each, one block at a time on the driver."""
    items = benchmark.select("item_id", "text").filter("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)

    def blocks() -> Iterator[list[tuple[int, str]]]:
        for i in range(n):
            part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
            yield sorted((r["item_id"], r["text"]) for r in part.collect())

    return n, blocks()


def _look(docs: DataFrame, items: list[tuple[int, str]], column: str) -> DataFrame:
    """The documents with a column of the sorted ids of a block's items found in their texts."""
    at = docs.columns.index("text")
    schema = docs.withColumn(column, F.array().cast("array<bigint>")).schema

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items)
        for batch in batches:
            texts = as_lists(batch.column(at))
            for a, b in slices(texts, TEXT_BYTES):
                found = [sorted(x) for x in index.find(texts.slice(a, b - a))]
                yield batch.slice(a, b - a).append_column(column, pa.array(found, pa.list_(pa.int64())))

    return docs.mapInArrow(look, schema)


def find_items(docs: DataFrame, benchmark: DataFrame, column: str = "found_items", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all columns kept, with a new ``column`` of the sorted ids of the items found.

    A benchmark of one block goes with the one pass over the texts. A larger one takes a pass
    for each block, whose hits (hash of doc_id and text, items) are written before the next
    block is fetched, so driver and plans hold one block; the hits are joined in the end.
    """
    if column in docs.columns:
        raise ValueError(f"the documents have a column {column}")
    n, blocks = benchmark_blocks(benchmark, block_bytes)
    if n <= 1:
        return _look(docs, next(blocks, []), column)
    (key,) = fresh(docs, "key")
    node = F.xxhash64("doc_id", "text").alias(key)
    hits = None
    for items in blocks:
        part = materialise(_look(docs.select(node, "text"), items, column).filter(F.size(column) > 0).select(key, column).distinct(), "hits")
        hits = part if hits is None else hits.unionByName(part)
    merged = hits.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(column)))).alias(column))
    out = docs.select("*", node).join(merged, key, "left").withColumn(column, F.coalesce(column, F.array().cast("array<bigint>")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], column)


def scan_benchmark(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, items."""
    found = find_items(docs.select("doc_id", "text"), benchmark, block_bytes=block_bytes)
    return found.select("doc_id", (F.size("found_items") > 0).alias("contaminated"), F.size("found_items").cast("long").alias("n_items"), F.array_join(F.col("found_items").cast("array<string>"), ",").alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no benchmark item was found, with their columns."""
    (column,) = fresh(docs, "found")
    return find_items(docs, benchmark, column, block_bytes).filter(F.size(column) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_benchmark(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
