"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

``STATISTICS`` of each whole text are standardised and mapped to random Fourier features,
whose inner products approximate a Gaussian kernel. Each partition of the labelled rows
sums its part of the normal equations; the parts are added in Spark and the ridge solution
is found on the driver, where only the (features + 1) squared sums arrive. Scores of the
labelled rows are counted in equal bins and made monotone by pooling adjacent violators,
so a score is a calibrated probability of label 1.

Defined cases: null text is empty and is scored like it; without usable labels every score
is 0.5; labels that are null or of null doc_id are not learned from, repeated labels count
as often as they occur; each document row gives one row; other columns are ignored; a null
doc_id counts as not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import as_lists, materialise, slices

FOLDS = 5
FEATURES = 192
BINS = 2000
STATISTICS = [
    "log_bytes", "log_words", "log_lines", "word_bytes", "upper", "digit", "symbol", "stop", "pipe", "newline", "non_ascii",
    "distinct_words", "repeated_next", "ends_in_symbol", "bytes_per_line", "starts_upper", "double_symbol",
]

_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3
_CLASS[[33, 44, 46, 58, 59, 63]] = 4
_CLASS[124] = 5
_CLASS[10] = 6
_CLASS[128:] = 7


def statistics(texts: pa.Array) -> np.ndarray:
    """``STATISTICS`` of each text (not null): (texts, statistics)."""
    n = len(texts)
    binary = texts.cast(pa.large_binary())
    ends = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + n + 1]
    data = np.frombuffer(binary.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    size = np.diff(ends)
    kind = _CLASS[data]

    def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        out, full = np.zeros(n), np.flatnonzero(np.diff(at))
        if len(full):
            out[full] = np.add.reduceat(flags.astype(np.int64), at[full])
        return out

    counts = [per_text(kind == k, ends) for k in range(1, 8)]
    symbol = (kind == 3) | (kind == 4)
    double = symbol.copy()
    double[1:] &= symbol[:-1]
    double[:1] = False
    counts.append(per_text(double, ends))
    lists = pc.ascii_split_whitespace(texts)
    at = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
    at -= at[0]
    index = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n_words = np.diff(at)
    owner = np.repeat(np.arange(n), n_words)
    vocab = max(1, len(words.dictionary))
    again = np.zeros(len(index), bool)
    again[1:] = (index[1:] == index[:-1]) & (owner[1:] == owner[:-1])
    distinct = np.bincount(np.unique(owner * vocab + index) // vocab, minlength=n) if len(index) else np.zeros(n)
    last = pc.match_substring_regex(words.dictionary, r"[!-/:-@\[-`{-~]$").to_numpy(zero_copy_only=False)
    first = pc.match_substring_regex(words.dictionary, r"^\p{Lu}").to_numpy(zero_copy_only=False)
    b, w, lines = np.maximum(size, 1), np.maximum(n_words, 1), counts[5] + 1
    upper, digit, other, stop, pipe, newline, high, doubled = counts
    return np.column_stack([
        np.log1p(size), np.log1p(n_words), np.log1p(lines), (size - n_words) / w, upper / b, digit / b, other / b, stop / b, pipe / b, newline / b, high / b,
        distinct / w, per_text(again, at) / w, per_text(last[index], at) / w, np.log1p(size / lines), per_text(first[index], at) / w, doubled / b,
    ])


def text_statistics(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out and the statistics of each document."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_lists(batch.column(2))
            for a, b in slices(texts):
                x = statistics(texts.slice(a, b - a))
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), batch.column(1).slice(a, b - a), values], names=["doc_id", "held_out", "x"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(compute, "doc_id long, held_out boolean, x array<double>")


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


class Model:
    """Standardising, random features, ridge weights and the calibration curve."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, features: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.w = rng.standard_normal((len(mean), features)) / width
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.curve = np.full(BINS, 0.5)

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant."""
        z = np.clip((x - self.mean) / self.std, -6, 6) @ self.w + self.b
        return np.column_stack([np.cos(z) * np.sqrt(2 / len(self.b)), np.ones(len(x))])

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Equal bins of the raw score from -0.5 to 1.5."""
        return np.clip(((self.lift(x) @ self.weights + 0.5) * (BINS / 2)).astype(np.int64), 0, BINS - 1)


def isotonic(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Non-decreasing means of ``total / count`` by pooling adjacent violators; empty bins take the value to their left."""
    blocks: list[list[float]] = []
    for i in np.flatnonzero(count):
        blocks.append([total[i], count[i], i])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t, c, _ = blocks.pop()
            blocks[-1][0] += t
            blocks[-1][1] += c
    out = np.empty(len(count))
    starts = [int(b[2]) for b in blocks] + [len(count)]
    out[: starts[0]] = blocks[0][0] / blocks[0][1]
    for (t, c, _), a, b in zip(blocks, starts, starts[1:], strict=False):
        out[a:b] = t / c
    return out


def train(labelled: DataFrame, features: int = FEATURES, width: float = 4.0, ridge: float = 1e-3, seed: int = 5) -> Model | None:
    """Fit on rows (x, y). Only sums arrive at the driver."""
    n_stats = len(STATISTICS)
    sums = labelled.agg(F.count("*").alias("n"), *[f(F.col("x")[i]).alias(f"{k}{i}") for i in range(n_stats) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not sums["n"]:
        return None
    model = Model(np.array([sums[f"m{i}"] for i in range(n_stats)]), np.array([sums[f"s{i}"] for i in range(n_stats)]), features, width, seed)
    rows = features + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.zeros((rows, rows + 1))
        for batch in batches:
            if batch.num_rows:
                z = model.lift(_matrix(batch.column(0)))
                a += z.T @ np.column_stack([z, batch.column(1).to_numpy(zero_copy_only=False)])
        values = pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, rows + 1), pa.int32()), pa.array(a.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int32()), values], names=["i", "v"])

    parts = labelled.select("x", "y").mapInArrow(equations, "i int, v array<double>")
    cells = parts.select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    m = np.zeros((rows, rows + 1))
    for r in cells.collect():
        m[r["i"], r["j"]] = r["v"]
    model.weights = np.linalg.solve(m[:, :rows] + ridge * sums["n"] / features * np.eye(rows), m[:, rows])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(model.bins(_matrix(batch.column(0))), pa.int64()), batch.column(1)], names=["bin", "y"])

    count, total = np.zeros(BINS), np.zeros(BINS)
    for r in labelled.select("x", "y").mapInArrow(binned, "bin long, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect():
        count[r["bin"]], total[r["bin"]] = r["n"], r["y"]
    model.curve = isotonic(count, total)
    return model


def score(stats: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = model.curve[model.bins(_matrix(batch.column(2)))] if model else np.full(batch.num_rows, 0.5)
                s = np.clip(s, 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return stats.select("doc_id", "held_out", "x").mapInArrow(apply, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Statistics are computed once, kept in the shared folder, and serve training and scoring."""
    stats = materialise(text_statistics(docs, folds), "quality-stats")
    y = labels.select("doc_id", F.col("quality").cast("double").alias("y")).filter("doc_id is not null and y is not null")
    labelled = materialise(stats.filter(~F.col("held_out")).join(y, "doc_id").select("x", "y"), "quality-labelled")
    return score(stats, train(labelled))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
