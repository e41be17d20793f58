"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of each white-space word, with a space at both ends,
forwards and backwards from a zero state, and labels every byte position with language
probabilities. A document's probabilities are the mean over the positions of its words
that hold a letter. As state starts anew at each word, a word that repeats is read once
per slice of documents and counted as often as it occurs; every position of the whole
text counts. The network is trained in numpy by backpropagation through time on the
driver, on the whole texts of a bounded sample: about ``docs_per_lang`` documents of each
language.

Defined cases: null text, a text without letters, or no training rows give ``und`` with
score 0; words over ``PIECE`` bytes are read in pieces; ties go to the language first in
order; each input row gives one row, so repeated rows repeat; other columns are ignored;
a null doc_id counts as not held out and is not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import SLICE_BYTES, as_lists, slices

FOLDS = 5
PIECE = 30
HIDDEN = 16


def held_out(folds: int):
    """Whether crc32 of the doc_id's text leaves no remainder."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class BiGru:
    """Two gated recurrent layers over bytes, one in each direction, and a softmax over both."""

    def __init__(self, n_labels: int, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        r = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
        h = hidden
        self.hidden = h
        # per direction: byte table (input weights and bias), recurrent weights of the gates and of the candidate
        self.p = {f"{k}{d}": v for d in "fb" for k, v in (("x", r(256, 3 * h, s=0.3)), ("u", r(h, 2 * h, s=h**-0.5)), ("c", r(h, h, s=h**-0.5)))}
        self.p |= {"o": r(2 * h, n_labels, s=0.1), "ob": np.zeros(n_labels, np.float32)}

    def _run(self, xs: np.ndarray, d: str, keep: bool):
        """States after each of the steps, (steps, rows, hidden), and what the gradient needs."""
        h, x, u, c = self.hidden, self.p["x" + d], self.p["u" + d], self.p["c" + d]
        state = np.zeros((len(xs), h), np.float32)
        states, memo = [], []
        for t in range(xs.shape[1]):
            inp = x[xs[:, t]]
            gates = _sigmoid(inp[:, : 2 * h] + state @ u)
            z, r = gates[:, :h], gates[:, h:]
            hc = state @ c
            n = np.tanh(inp[:, 2 * h :] + r * hc)
            new = n + z * (state - n)
            if keep:
                memo.append((state, z, r, hc, n))
            states.append(new)
            state = new
        return np.stack(states), memo

    def probabilities(self, xs: np.ndarray) -> np.ndarray:
        """Label probabilities of every position: (rows, steps, labels)."""
        f, _ = self._run(xs, "f", False)
        b, _ = self._run(xs[:, ::-1], "b", False)
        logits = np.concatenate([f, b[::-1]], 2) @ self.p["o"] + self.p["ob"]
        logits -= logits.max(2, keepdims=True)
        e = np.exp(logits)
        return (e / e.sum(2, keepdims=True)).transpose(1, 0, 2)

    def gradients(self, xs: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over positions and its gradients, through time."""
        h, rows, steps = self.hidden, len(xs), xs.shape[1]
        f, mf = self._run(xs, "f", True)
        b, mb = self._run(xs[:, ::-1], "b", True)
        both = np.concatenate([f, b[::-1]], 2)
        logits = both @ self.p["o"] + self.p["ob"]
        logits -= logits.max(2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(2, keepdims=True)
        loss = -np.log(prob[:, np.arange(rows), labels] + 1e-9).mean()
        prob[:, np.arange(rows), labels] -= 1
        prob /= rows * steps
        g = {"o": np.einsum("tbi,tbj->ij", both, prob), "ob": prob.sum((0, 1))}
        dboth = prob @ self.p["o"].T
        for d, memo, x, dh_all in (("f", mf, xs, dboth[:, :, :h]), ("b", mb, xs[:, ::-1], dboth[::-1, :, h:])):
            u, c = self.p["u" + d], self.p["c" + d]
            du, dc, dx = np.zeros_like(u), np.zeros_like(c), np.zeros_like(self.p["x" + d])
            carry = np.zeros((rows, h), np.float32)
            for t in range(steps - 1, -1, -1):
                state, z, r, hc, n = memo[t]
                dh = dh_all[t] + carry
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (state - n) * z * (1 - z)
                dr = dn * hc * r * (1 - r)
                dgates = np.concatenate([dz, dr], 1)
                dhc = dn * r
                du += state.T @ dgates
                dc += state.T @ dhc
                np.add.at(dx, x[:, t], np.concatenate([dgates, dn], 1))
                carry = dh * z + dgates @ u.T + dhc @ c.T
            g |= {"u" + d: du, "c" + d: dc, "x" + d: dx}
        return float(loss), g


def pieces(words: list[bytes], labels: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words cut into pieces of at most ``PIECE`` bytes, as they are scored, with their labels and counts."""
    cut = [(w[i : i + PIECE], k, c) for w, k, c in zip(words, labels, counts, strict=True) for i in range(0, len(w), PIECE)]
    return [x[0] for x in cut], np.array([x[1] for x in cut], np.int64), np.array([x[2] for x in cut], float)


def fit(words: list[bytes], labels: np.ndarray, n_labels: int, steps: int = 500, rows: int = 256, rate: float = 0.02, seed: int = 7, counts: np.ndarray | None = None) -> BiGru:
    """Train with Adam on pieces of words of equal length at a time, each as often as it occurs."""
    net, rng = BiGru(n_labels, seed=seed), np.random.default_rng(seed)
    words, labels, counts = pieces(words, labels, np.ones(len(words)) if counts is None else counts)
    sizes = np.array([len(w) for w in words])
    by_size = {int(s): np.flatnonzero(sizes == s) for s in np.unique(sizes)}
    share = {s: counts[v] / counts[v].sum() for s, v in by_size.items()}
    weight = np.array([counts[v].sum() for v in by_size.values()]) / counts.sum()
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        s = int(rng.choice(list(by_size), p=weight))
        pick = rng.choice(by_size[s], rows, p=share[s])
        xs = np.frombuffer(b"".join(b" " + words[i] + b" " for i in pick), np.uint8).reshape(rows, s + 2)
        _, g = net.gradients(xs, labels[pick])
        lr = rate * min(1, step / 20) * (1 - step / (steps + 1)) ** 0.5
        for k in net.p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v2[k] = 0.99 * v2[k] + 0.01 * g[k] ** 2
            net.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-6)
    return net


def word_scores(net: BiGru, vocab: pa.Array, rows: int = 4096) -> np.ndarray:
    """For each word the sum of its positions' probabilities, in pieces of at most ``PIECE`` bytes."""
    n_labels = len(net.p["ob"])
    binary = vocab.cast(pa.large_binary())
    ends = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
    data = np.frombuffer(binary.buffers()[2] or b"", np.uint8)
    size = np.diff(ends)
    n_pieces = -(-size // PIECE)
    owner = np.repeat(np.arange(len(size)), n_pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
    start = ends[:-1][owner] + nth * PIECE
    length = np.minimum(size[owner] - nth * PIECE, PIECE)
    out = np.zeros((len(size), n_labels))
    order = np.argsort(length, kind="stable")
    bounds = np.searchsorted(length[order], np.arange(1, PIECE + 2))
    for n in range(1, PIECE + 1):
        for i in range(bounds[n - 1], bounds[n], rows):
            own = order[i : min(i + rows, bounds[n])]
            xs = np.full((len(own), n + 2), 32, np.uint8)
            xs[:, 1:-1] = data[start[own][:, None] + np.arange(n)]
            np.add.at(out, owner[own], net.probabilities(xs)[:, 1:-1].sum(1))
    return out


def document_scores(net: BiGru, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Mean label probabilities of each text, and the number of positions."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    offsets -= offsets[0]
    vocab, index = words.dictionary, words.indices.to_numpy(zero_copy_only=False)
    lettered = pc.match_substring_regex(vocab, r"\p{L}").to_numpy(zero_copy_only=False)
    size = np.where(lettered, pc.binary_length(vocab).to_numpy(zero_copy_only=False), 0)
    scores = np.zeros((len(vocab) , len(net.p["ob"])))
    if lettered.any():
        scores[lettered] = word_scores(net, vocab.filter(pa.array(lettered)))
    total = np.zeros((len(texts), scores.shape[1]))
    n = np.zeros(len(texts), np.int64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        n[full] = np.add.reduceat(size[index], offsets[full])
        for j in range(scores.shape[1]):
            total[full, j] = np.add.reduceat(scores[index, j], offsets[full])
    return total / np.maximum(n, 1)[:, None], n


def train(docs: DataFrame, docs_per_lang: int = 400, folds: int = FOLDS, steps: int = 500) -> tuple[BiGru | None, list[str]]:
    """The network and its languages, from whole texts of a bounded sample of the rows not held out.

    ``docs_per_lang``: the expected rows of a language in the sample, drawn by a hash of id and
    text. Their words are counted in Spark, so what reaches the driver is each distinct word of
    the sample once per language, however long or often repeated its texts are.
    """
    seen = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(folds))
    counts = {r["lang"]: r["count"] for r in docs.select("doc_id", "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(folds)).groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return None, []
    share = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, docs_per_lang / counts[k])]), F.col("lang"))
    unit = F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    words = seen.filter(unit < share).select("lang", F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).filter(r"word RLIKE '\\p{L}'")
    rows = sorted((r["lang"], r["word"], r["count"]) for r in words.groupBy("lang", "word").count().collect())
    if not rows:
        return None, []
    return fit([w.encode() for _, w, _ in rows], np.array([langs.index(k) for k, _, _ in rows]), len(langs), steps=steps, counts=np.array([c for _, _, c in rows], float)), langs


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, n_positions long"


def predictions(net: BiGru | None, langs: list[str], texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, mean probability of it and positions read, of texts that are not null."""
    if net is None:
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    mean, n = document_scores(net, texts)
    best = mean.argmax(1)
    return [langs[k] if m else "und" for k, m in zip(best, n, strict=True)], np.where(n > 0, np.clip(mean.max(1), 0, 1), 0.0), n


def identify(docs: DataFrame, net: BiGru | None, langs: list[str], folds: int = FOLDS) -> DataFrame:
    """One row per document with its language, the mean probability of that language and the positions read."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_lists(batch.column(2))
            for a, b in slices(texts, 2 * SLICE_BYTES):
                names, score, n = predictions(net, langs, texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).cast(pa.int64()), batch.column(1).slice(a, b - a), pa.array(names, pa.string()), pa.array(score), pa.array(n)],
                    names=["doc_id", "held_out", "lang_pred", "score", "n_positions"],
                )

    return docs.select("doc_id", held_out(folds).alias("held_out"), "text").mapInArrow(label, SCHEMA)


def keep_told(docs: DataFrame, net: BiGru | None, langs: list[str], min_score: float) -> DataFrame:
    """The documents, all columns kept, with a language of at least ``min_score``.

    Without a network, as where no document has a language, all documents stay.
    """
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_lists(batch.column(at))
            for a, b in slices(texts, 2 * SLICE_BYTES):
                _, score, n = predictions(net, langs, texts.slice(a, b - a))
                yield batch.slice(a, b - a).filter(pa.array((n > 0) & (score >= min_score)))

    return docs if net is None else docs.mapInArrow(keep, docs.schema)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, *train(docs))
