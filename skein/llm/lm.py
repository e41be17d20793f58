"""Language-model scoring by a weighted backoff automaton over bigrams.

The states are the words (a text starts in the state of the end token) and a root. A state
``h`` has an arc for every word ``w`` seen after it, with log10 of the Dirichlet-smoothed
``(c(hw) + mass * p(w)) / (c(h) + mass)``; its failure arc, with log10 of
``mass / (c(h) + mass)``, leads to the root, which has an arc for every word with log10 of
``p(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1))``. Scoring is one left-to-right traversal that
carries the state and adds up the weights.

The counts grow with the corpus, so no worker holds them all. Texts are read in chunks; a
chunk sends the sorted hashes of its distinct words and bigrams, cut into ranges of the hash
space, to the range's task, which adds up the counts of all chunks and returns them in the
order they came. Each chunk then builds the part of the automaton that its own texts can
reach. Payloads are compressed; token streams are kept in the shared folder meanwhile.
No count is pruned and no text cut.

Defined cases: null text is empty and has the end token only; rows with a null doc_id are
scored, not learned from and not held out; each row gives one row and repeated rows count as
often; without training rows every token has probability 1; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import as_lists, ascii_words, materialise, mix64, slices, word_hashes

FOLDS = 10
MASS = 30.0
ADD = 0.1
CHUNK_BYTES = 6 << 20
END = np.uint64(0x5BD1E9955BD1E995)
TOKENS = -1


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays by byte planes, compressed."""
    import zstandard

    head = np.array([x for a in arrays for x in (len(a), a.itemsize)], np.int64).tobytes()
    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b"" for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + planes)


def unpack(data: bytes, *dtypes) -> list[np.ndarray]:
    """The arrays of ``pack``."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    head = np.frombuffer(raw, np.int64, 2 * len(dtypes)).reshape(-1, 2)
    out, at = [], head.nbytes
    for (n, size), dtype in zip(head, dtypes, strict=True):
        n, size = int(n), int(size)
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(dtype).reshape(n))
        at += n * size
    return out


def bounds(parts: int) -> np.ndarray:
    """Where the equal ranges of the hash space end."""
    return np.array([(i + 1) * 2**64 // parts for i in range(parts - 1)], np.uint64)


def bigram_keys(hashes: np.ndarray, before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    first, second = mix64(hashes + np.uint64(1)), mix64(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return mix64(first[before] + second[tokens] * np.uint64(3))


def stream(words: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' tokens with the end after each, and the token before each (the end before the first)."""
    n = len(words) + len(sizes)
    at = np.cumsum(sizes + 1) - 1
    tokens = np.full(n, end, np.int32)
    inner = np.ones(n, bool)
    inner[at] = False
    tokens[inner] = words
    before = np.concatenate([np.array([end], np.int32), tokens[:-1]]) if n else tokens
    return tokens, before


def token_streams(docs: DataFrame, folds: int) -> DataFrame:
    """Rows (chunk, part, payload): each chunk's documents, word numbers and word hashes."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_lists(batch.column(3))
            for a, b in slices(texts, CHUNK_BYTES):
                ids = batch.column(0).slice(a, b - a).cast(pa.int64())
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                learn = batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False).astype(bool)
                held = batch.column(2).slice(a, b - a).to_numpy(zero_copy_only=False).astype(bool)
                words, at = ascii_words(texts.slice(a, b - a))
                index, hashed, _ = word_hashes(words) if len(words) else (np.zeros(0, np.int32), np.zeros(0, np.uint64), None)
                hashes, number = np.unique(np.append(hashed, END), return_inverse=True)
                flags = (known * 1 + held * 2 + learn * 4).astype(np.uint8)
                payload = pack(ids.fill_null(0).to_numpy(zero_copy_only=False), flags, np.diff(at).astype(np.int64), number[index].astype(np.uint32), hashes)
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([TOKENS], pa.int32()), pa.array([payload], pa.binary())], names=["chunk", "part", "payload"])

    rest = F.crc32(F.col("doc_id").cast("string")) % folds
    return docs.select("doc_id", F.coalesce(rest != 0, F.lit(False)).alias("learn"), F.coalesce(rest == 0, F.lit(False)).alias("held"), "text").mapInArrow(compute, "chunk long, part int, payload binary")


def spread(streams: DataFrame, parts: int) -> DataFrame:
    """Rows (chunk, part, payload): each chunk's distinct bigrams and words with their counts, by hash range."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, payload in zip(batch.column(0), batch.column(2), strict=True):
                _, flags, sizes, words, hashes = unpack(payload.as_buffer(), np.int64, np.uint8, np.int64, np.uint32, np.uint64)
                tokens, before = stream(words, sizes, int(np.searchsorted(hashes, END)))
                weight = np.repeat(flags & 4 > 0, sizes + 1)
                counts = np.bincount(tokens, weights=weight, minlength=len(hashes)).astype(np.uint32)
                keys, places = np.unique(bigram_keys(hashes, before, tokens), return_inverse=True)
                pairs = np.bincount(places, weights=weight, minlength=len(keys)).astype(np.uint32)
                del places, tokens, before, words, weight
                rows = []
                for base, n, k, c in ((0, parts, keys, pairs), (parts, word_parts(parts), hashes, counts)):
                    cut = np.searchsorted(k, bounds(n))
                    for i, (x, y) in enumerate(zip(np.split(k, cut), np.split(c, cut), strict=True)):
                        if len(x):
                            rows.append((base + i, pack(np.diff(x, prepend=np.uint64(0)), y)))
                yield pa.RecordBatch.from_arrays([pa.array([chunk.as_py()] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["chunk", "part", "payload"])

    return streams.mapInArrow(compute, "chunk long, part int, payload binary")


def word_parts(parts: int) -> int:
    return max(1, parts // 6)


def add_up(sent: DataFrame, parts: int) -> DataFrame:
    """For each (chunk, part) the corpus counts of its keys in their order; and each part's sums (chunk -1)."""

    def compute(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        chunks, keys, counts = group.column("chunk").to_pylist(), [], []
        for p in group.column("payload"):
            gaps, c = unpack(p.as_py(), np.uint64, np.uint32)
            keys.append(np.cumsum(gaps, dtype=np.uint64))
            counts.append(c)
        sizes = [len(k) for k in keys]
        each, place = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        total = np.bincount(place, weights=np.concatenate(counts), minlength=len(each)).astype(np.int64)
        back = [pack(x) for x in np.split(total[place], np.cumsum(sizes)[:-1])]
        own = part >= parts
        return pa.table({
            "chunk": pa.array([*chunks, -1], pa.int64()), "part": pa.array([part] * (len(chunks) + 1), pa.int32()), "payload": pa.array([*back, b""], pa.binary()),
            "n": pa.array([0] * len(chunks) + [int(total.sum()) * own], pa.int64()), "v": pa.array([0] * len(chunks) + [int((total > 0).sum()) * own], pa.int64()),
        })

    return sent.groupBy("part").applyInArrow(compute, "chunk long, part int, payload binary, n long, v long")


class Automaton:
    """The part of the automaton that a chunk's texts can reach.

    ``counts``: of the words; ``keys``, ``pairs``: sorted bigram keys and their counts.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, keys: np.ndarray, pairs: np.ndarray, n: int, v: int, mass: float):
        self.hashes, self.keys = hashes, keys
        self.p = (counts + ADD) / (n + ADD * (v + 1))
        self.root = np.log10(self.p)
        self.fail = np.log10(mass / (counts + mass))
        self.total, self.pairs, self.mass = counts, pairs, mass

    def weights(self, tokens: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The weight of each step: the state's arc where there is one, else its failure arc and the root's arc."""
        arc = self.pairs[np.searchsorted(self.keys, bigram_keys(self.hashes, before, tokens))]
        out = self.fail[before] + self.root[tokens]
        has = arc > 0
        h, w = before[has], tokens[has]
        out[has] = np.log10((arc[has] + self.mass * self.p[w]) / (self.total[h] + self.mass))
        return out


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, mass: float = MASS, folds: int = FOLDS) -> DataFrame:
    """One row per document with its token counts, the base score and the automaton's log10 probability."""
    spark = docs.sparkSession
    parts = 3 * max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    streams = materialise(token_streams(docs, folds), "lm-tokens")
    counted = materialise(add_up(spread(streams, parts), parts), "lm-counts")
    n, v = (x or 0 for x in counted.filter("chunk = -1").agg(F.sum("n"), F.sum("v")).first())

    def compute(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("part").to_pylist(), group.column("payload").to_pylist(), strict=True))
        ids, flags, sizes, words, hashes = unpack(rows[0][1], np.int64, np.uint8, np.int64, np.uint32, np.uint64)
        back = [(p, unpack(x, np.int64)[0]) for p, x in rows[1:]]
        pairs = np.concatenate([x for p, x in back if p < parts])
        counts = np.concatenate([x for p, x in back if p >= parts])
        tokens, before = stream(words, sizes, int(np.searchsorted(hashes, END)))
        keys = np.unique(bigram_keys(hashes, before, tokens))
        net = Automaton(hashes, counts, keys, pairs, n, v, mass)
        at = np.cumsum(sizes + 1) - (sizes + 1)
        known = np.add.reduceat((counts > 0)[tokens].astype(np.int64), at)
        return pa.table({
            "doc_id": pa.array(ids, pa.int64(), mask=flags & 1 == 0), "held_out": pa.array(flags & 2 > 0), "n_tokens": pa.array(sizes + 1, pa.int64()), "n_known": pa.array(known, pa.int64()),
            "train_tokens": pa.array(np.full(len(ids), n), pa.int64()), "base_score": pa.array(np.add.reduceat(net.root[tokens], at)), "score": pa.array(np.add.reduceat(net.weights(tokens, before), at)),
        })

    both = streams.unionByName(counted.filter("chunk <> -1").select("chunk", "part", "payload"))
    return both.groupBy("chunk").applyInArrow(compute, SCHEMA)


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
