"""Line dedup: patience alignment of documents that share rare line hashes.

Lines are compared by the hash of their text without white space at the ends. A line of few
words tells little, so documents are found through runs: from every line that has words the
shortest run of lines with at least ``min_block_words`` words that starts there, and the
shortest that ends there. The hash of a run that at most ``rare`` rows hold leads to every
earlier document among its holders; a more frequent one leads to its first holder, so a
frequent line needs no cap and gives as many pairs as holders. Every line of a common block
of enough words lies in one of these runs, so each part of a block leads to a document that
holds that part as it stands, whoever first held its single lines.

Each pair is aligned as patience diff does: equal lines at either end match; of the lines
that stand once on either side the longest run in the same order matches; the ranges
between are aligned in the same way. Aligned neighbours form blocks, and those of at
least ``min_block_words`` words are deleted from the later document. Blocks that moved
against the alignment stay, unless another earlier document aligns with them.

A document is a pair of doc_id and text; the earlier of two has the smaller doc_id, then the
smaller hash of its text.

Defined cases: null and empty texts have no lines to share and stay as they are; rows with
a null doc_id come after all others, as if they had the largest id; rows with the same
doc_id and text are one document and are treated alike; rows with one doc_id and different
texts are different documents; other columns are kept by ``dedup_lines``. Lines are split at
line feeds; a text of any length is compared whole.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import discard, fresh, materialise, mix64

MIN_BLOCK_WORDS = 8
RARE = 4
#: Pairs of one document that a task of the alignment takes at once.
PAIRS = 1000
LINES = "split(text, '\\n', -1)"
#: Takes the place of a null doc_id.
LAST_ID = 2**63 - 1
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 2**64)


def _identity() -> list:
    return [F.coalesce("doc_id", F.lit(LAST_ID)).alias("did"), F.xxhash64("text").alias("tkey")]


def line_table(docs: DataFrame) -> DataFrame:
    """did, tkey, and the hash and words of every line of the texts."""
    return (
        docs.select("doc_id", "text")
        .filter("text is not null")
        .select(*_identity(), F.expr(f"transform({LINES}, x -> btrim(x, ' \\t\\r\\f'))").alias("l"))
        .select("did", "tkey", F.expr("transform(l, x -> xxhash64(x))").alias("hs"), F.expr("transform(l, x -> if(x = '', 0, size(split(x, '\\\\s+'))))").alias("ws"))
    )


def run_bounds(words: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last lines of the shortest runs of at least ``least`` words from and to each line with words.

    ``words``: of the lines of many texts; ``at``: where each text's lines start, and the end.
    """
    total = np.concatenate([[0], np.cumsum(words)])
    lines = np.nonzero(words)[0]
    text = np.searchsorted(at, lines, side="right") - 1
    last = np.searchsorted(total, total[lines] + least) - 1
    ok = last < at[text + 1]
    first = np.searchsorted(total, total[lines + 1] - least, side="right") - 1
    back = (total[lines + 1] >= least) & (first >= at[text])
    bounds = np.unique(np.concatenate([np.stack([lines[ok], last[ok]], 1), np.stack([first[back], lines[back]], 1)]), axis=0)
    return bounds[:, 0], bounds[:, 1]


def run_hashes(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of the lines from ``first`` to ``last``, the same wherever the run stands."""
    n = len(hashes)
    down, up = (np.full(n + 1, base, np.uint64) for base in (_INVERSE, _ODD))
    down[0] = up[0] = 1
    down, up = np.cumprod(down, dtype=np.uint64), np.cumprod(up, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(hashes) * down[:n], dtype=np.uint64)])
    return mix64((sums[last + 1] - sums[first]) * up[first] + (last - first).astype(np.uint64))


def runs(lines: DataFrame, min_block_words: int) -> DataFrame:
    """One row per document row and distinct run: did, tkey, the document's lines and the hash of the run."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                at = batch.column(2).offsets.to_numpy().astype(np.int64)
                hashes = batch.column(2).values.to_numpy()[at[0] : at[-1]].view(np.uint64)
                words = batch.column(3).flatten().to_numpy().astype(np.int64)
                at -= at[0]
                first, last = run_bounds(words, at, min_block_words)
                row = np.searchsorted(at, first, side="right") - 1
                w = run_hashes(hashes, first, last).view(np.int64)
                row, w = np.unique(np.stack([row, w], 1), axis=0).T
                size = np.diff(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(size[row]), pa.array(w)], names=["did", "tkey", "n", "w"])

    return lines.select("did", "tkey", "hs", "ws").mapInArrow(compute, "did long, tkey long, n long, w long")


def patience(a: list, b: list, places: dict) -> list[tuple[int, int]]:
    """The pairs of equal lines (place in ``a``, place in ``b``) of the patience alignment, in order.

    ``places``: the sorted places of every line of ``b``.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        count = Counter(a[i:j])
        once = []
        for x in range(i, j):
            if count[a[x]] == 1 and (at := places.get(a[x])):
                lo = bisect_left(at, k)
                if lo < len(at) and at[lo] < m and (lo + 1 == len(at) or at[lo + 1] >= m):
                    once.append((x, at[lo]))
        if not once:
            continue
        tails: list[int] = []
        rows: list[int] = []
        back = [-1] * len(once)
        for r, (_, y) in enumerate(once):
            pile = bisect_left(tails, y)
            back[r] = rows[pile - 1] if pile else -1
            tails[pile : pile + 1] = [y]
            rows[pile : pile + 1] = [r]
        r, chain = rows[-1], []
        while r >= 0:
            chain.append(once[r])
            r = back[r]
        chain.reverse()
        # each range ends before an anchor; the anchors start the ranges and match there
        starts = [(i, k), *chain]
        ends = [*chain, (j, m)]
        todo.extend((s[0], e[0], s[1], e[1]) for s, e in zip(starts, ends, strict=True))
    return sorted(out)


def aligned_blocks(matches: list[tuple[int, int]], words: list[int], side: int, min_block_words: int) -> list[int]:
    """The places on one side of the aligned blocks that have enough words."""
    out: list[int] = []
    block: list[int] = []
    before = None
    for match in [*matches, None]:
        if match is None or before is None or match[0] != before[0] + 1 or match[1] != before[1] + 1:
            if sum(words[p] for p in block) >= min_block_words:
                out += block
            block = []
        if match is not None:
            block.append(match[side])
        before = match
    return out


def document_pairs(lines: DataFrame, min_block_words: int, rare: int) -> DataFrame:
    """Pairs of documents that share a run: the shorter (s) and the longer (b), and whether the later is the shorter."""
    held = runs(lines, min_block_words)
    # written on its own, so that the join below has a shuffle on either side and a hot run's rows can be split
    owners = materialise(
        held.groupBy("w").agg(F.count("*").alias("c"), F.min(F.struct("did", "tkey", "n")).alias("o"), F.max(F.struct("did", "tkey")).alias("last")).filter(F.struct("o.did", "o.tkey") < F.col("last")).select("w", "c", "o"), "run-owners"
    )
    shared = materialise(held.join(owners, "w").select("w", "c", F.struct("did", "tkey", "n").alias("d"), "o"), "runs")
    few = shared.filter(F.col("c") <= rare)
    pairs = (
        few.select("w", F.col("d").alias("later"))
        .join(few.select("w", F.col("d").alias("earlier")), "w")
        .filter("earlier < later")
        .select("later", "earlier")
        .unionByName(shared.filter((F.col("c") > rare) & (F.col("o") < F.col("d"))).select(F.col("d").alias("later"), F.col("o").alias("earlier")))
        .distinct()
    )
    short = F.col("later.n") < F.col("earlier.n")
    out = materialise(
        pairs.select(
            *[F.when(short, F.col(f"later.{c}")).otherwise(F.col(f"earlier.{c}")).alias(f"s_{c}") for c in ("did", "tkey")],
            *[F.when(short, F.col(f"earlier.{c}")).otherwise(F.col(f"later.{c}")).alias(f"b_{c}") for c in ("did", "tkey")],
            short.alias("later_is_s"),
        ),
        "line-pairs",
    )
    discard(owners)
    discard(shared)
    return out


def _attach(pairs: DataFrame, arrays: DataFrame, side: str, per_task: int) -> DataFrame:
    """The pairs with the lines of one side. A document of many pairs is spread over several tasks."""
    keys = [f"{side}_did", f"{side}_tkey"]
    table = arrays.select(F.col("did").alias(keys[0]), F.col("tkey").alias(keys[1]), F.col("hs").alias(f"{side}_hs"), F.col("ws").alias(f"{side}_ws"))
    many = materialise(pairs.groupBy(*keys).count().filter(F.col("count") > per_task).select(*keys, F.ceil(F.col("count") / per_task).cast("int").alias("tasks")), "many")
    other = {"s": "b", "b": "s"}[side]
    parts = F.coalesce("tasks", F.lit(1))
    salted = pairs.join(many, keys, "left").withColumn("salt", F.pmod(F.xxhash64(f"{other}_did", f"{other}_tkey"), parts)).drop("tasks")
    table = table.join(many, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("tasks")
    return salted.join(table.withColumn("salt", F.col("salt").cast("long")), [*keys, "salt"]).drop("salt")


def removals(docs: DataFrame, min_block_words: int = MIN_BLOCK_WORDS, rare: int = RARE, per_task: int = PAIRS) -> DataFrame:
    """did, tkey, the line numbers to delete and a byte for every line up to the last of them, the blocks, and the earlier documents."""
    lines = materialise(line_table(docs), "lines")
    pairs = document_pairs(lines, min_block_words, rare)
    ends = pairs.select(F.col("s_did").alias("did"), F.col("s_tkey").alias("tkey")).unionByName(pairs.select(F.col("b_did").alias("did"), F.col("b_tkey").alias("tkey"))).distinct()
    arrays = materialise(lines.join(ends, ["did", "tkey"]).groupBy("did", "tkey").agg(F.first("hs").alias("hs"), F.first("ws").alias("ws")), "line-arrays")
    discard(lines)
    both = _attach(_attach(pairs, arrays, "s", per_task), arrays, "b", per_task)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, b, places = None, [], {}
        for batch in batches:
            col = {name: batch.column(name) for name in batch.schema.names}
            ids = {c: col[c].to_pylist() for c in ("s_did", "s_tkey", "b_did", "b_tkey", "later_is_s")}
            out = []
            for i in range(batch.num_rows):
                if last != (key := (ids["b_did"][i], ids["b_tkey"][i])):
                    last, b, places = key, col["b_hs"][i].values.to_pylist(), {}
                    for p, h in enumerate(b):
                        places.setdefault(h, []).append(p)
                small = ids["later_is_s"][i]
                matches = patience(col["s_hs"][i].values.to_pylist(), b, places)
                gone = aligned_blocks(matches, col["s_ws" if small else "b_ws"][i].values.to_pylist(), 0 if small else 1, min_block_words)
                if gone:
                    later, earlier = ("s", "b") if small else ("b", "s")
                    out.append((ids[f"{later}_did"][i], ids[f"{later}_tkey"][i], ids[f"{earlier}_did"][i], gone))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())))], names=["did", "tkey", "source", "gone"]
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, masks, blocks = [], [], []
            for x in batch.column(2):
                places = np.unique(np.concatenate([np.asarray(part.values) for part in x.values]))
                mask = np.zeros(int(places[-1]) + 1, np.uint8)
                mask[places] = 1
                gone.append(places)
                masks.append(mask.tobytes())
                blocks.append(int((np.diff(places) > 1).sum()) + 1)
            sources = [sorted(x) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(gone, pa.list_(pa.int32())), pa.array(masks, pa.binary()), pa.array(blocks, pa.int64()), pa.array(sources, pa.list_(pa.int64()))],
                names=["did", "tkey", "gone", "mask", "n_blocks", "sources"],
            )

    columns = [f"{s}_{c}" for s in "sb" for c in ("did", "tkey", "hs", "ws")]
    found = both.select(*columns, "later_is_s").mapInArrow(decide, "did long, tkey long, source long, gone array<int>")
    return found.groupBy("did", "tkey").agg(F.collect_list("gone").alias("gone"), F.collect_set("source").alias("sources")).mapInArrow(merge, "did long, tkey long, gone array<int>, mask binary, n_blocks long, sources array<long>")


def dedup_lines(docs: DataFrame, min_block_words: int = MIN_BLOCK_WORDS, rare: int = RARE, drop_emptied: bool = True) -> DataFrame:
    """The documents with the aligned blocks deleted; documents of which no text is left go."""
    did, tkey, mask = fresh(docs, "did", "tkey", "mask")
    gone = removals(docs, min_block_words, rare).select(F.col("did").alias(did), F.col("tkey").alias(tkey), F.col("mask").alias(mask))
    keyed = docs.select("*", *[c.alias(name) for c, name in zip(_identity(), (did, tkey), strict=True)])
    text = F.when(F.col(mask).isNull(), F.col("text")).otherwise(F.expr(f"array_join(filter({LINES}, (x, i) -> substring({mask}, i + 1, 1) <> X'01'), '\\n')"))
    out = keyed.join(gone, [did, tkey], "left").withColumn("text", text)
    if drop_emptied:
        out = out.filter(F.col(mask).isNull() | (F.trim("text") != ""))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, min_block_words: int = MIN_BLOCK_WORDS, rare: int = RARE) -> DataFrame:
    """One row per document row: its lines, the lines deleted, the blocks and the documents they stand in before."""
    gone = removals(docs, min_block_words, rare)
    counted = docs.select("doc_id", *_identity(), F.expr(f"coalesce(size({LINES}), 0)").cast("long").alias("n_lines"))
    return counted.join(gone, ["did", "tkey"], "left").select(
        "doc_id",
        F.when(F.col("n_lines") < 0, 0).otherwise(F.col("n_lines")).alias("n_lines"),
        F.coalesce(F.size(F.col("gone")).cast("long"), F.lit(0)).alias("n_removed"),
        F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"),
        F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit("")).alias("removed_lines"),
        F.coalesce(F.array_join(F.col("sources").cast("array<string>"), ","), F.lit("")).alias("source_docs"),
    )


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
