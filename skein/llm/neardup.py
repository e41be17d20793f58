"""Near-duplicates of word shingles: fast similarity sketches, banding, exact verification.

A document's set holds the distinct 64-bit hashes of its runs of ``k`` words. In round i of
the sketch every element is hashed to one of ``COORDS`` bins and a value; a bin keeps the
least value of the first round that reached it, and from round ``COORDS`` on each round
fills one bin from all elements, so every coordinate fills. Sketches agree in a coordinate
with the Jaccard similarity as probability, with concentration as for independent hashes.
``BANDS`` bands of ``COORDS / BANDS`` coordinates give buckets. At a similarity of 0.85 a
pair misses all buckets with probability 6e-11, at 0.8 5e-8.

Documents with equal sets are one class, whose smallest doc_id stands for it. Elements that
stand in one set only, and counts of the elements by frequency and cell of the hash space,
bound every intersection from above; pairs whose bound is too small for a link are not
compared, which is exact and spares nearly all pairs of a large group of loosely similar
texts. The members of a bucket are first compared with one of them, the one with the least
of its own. Where a bucket then still spans several components, the members outside its
largest component are held against all members of other components, in blocks of members, so
no link that joins components is lost and no task holds a whole large bucket. All
comparisons are on full sets.

Defined cases: texts without words have an empty set and no links; texts with fewer than
``k`` words are one shingle; a doc_id on several rows is one node that has the links of
all its texts; rows with a null doc_id take no part, have a null component and are kept;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import as_lists, ascii_words, discard, fresh, materialise, mix64, slices, word_hashes
from skein.llm.components import connected_components

COORDS = 128
BANDS = 32
CELLS = 16
BLOCK = 512
_GOLD = 0x9E3779B97F4A7C15
_EDGES = (np.arange(COORDS, dtype=np.uint64) << np.uint64(57))


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, at = ascii_words(texts)
    if not len(words):
        return [np.zeros(0, np.uint64)] * len(texts)
    index, hashed, _ = word_hashes(words)
    n = max(0, len(index) - k + 1)
    runs = np.zeros(n, np.uint64)
    for j in range(k):
        runs += mix64(hashed + np.uint64((j + 1) * _GOLD % 2**64))[index[j : j + n]]
    runs = mix64(runs)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            short = np.uint64(b - a)
            for j in range(b - a):
                short = mix64(np.array([short]) + mix64(hashed[index[a + j : a + j + 1]]))[0]
            out.append(np.array([short], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(elements: np.ndarray) -> np.ndarray:
    """The fast similarity sketch of a non-empty set of 64-bit hashes."""
    out = np.zeros(COORDS, np.uint64)
    empty = np.ones(COORDS, bool)
    for i in range(2 * COORDS):
        y = mix64(elements + np.uint64((i + 1) * _GOLD % 2**64))
        if i < COORDS:
            y.sort()
            first = np.searchsorted(y, _EDGES)
            value = y[np.minimum(first, len(y) - 1)]
            hit = empty & (first < len(y)) & (value >> np.uint64(57) == np.arange(COORDS, dtype=np.uint64))
            out[hit] = value[hit] + np.uint64(i)
            empty &= ~hit
        elif empty[i - COORDS]:
            out[i - COORDS] = y.min() + np.uint64(i)
            empty[i - COORDS] = False
        if not empty.any():
            break
    return out


def band_keys(sketches: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit bucket key for each band of each sketch: (documents, bands)."""
    s = mix64(sketches).reshape(len(sketches), bands, -1)
    odd = np.array([(2 * j + 1) * _GOLD % 2**64 for j in range(s.shape[2])], np.uint64)
    return mix64((s * odd).sum(2, dtype=np.uint64) + mix64(np.arange(1, bands + 1, dtype=np.uint64)))


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, size of the set, a 128-bit fingerprint of it in two halves, and the bucket keys."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            texts = as_lists(batch.column(1))
            for a, b in slices(texts):
                sets = shingle_sets(texts.slice(a, b - a), k)
                prints = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets]).reshape(-1, 2)
                keys = band_keys(np.array([sketch(s) if len(s) else np.zeros(COORDS, np.uint64) for s in sets]).reshape(-1, COORDS)).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), lists],
                    names=["doc_id", "n", "fp1", "fp2", "keys"],
                )

    return docs.select("doc_id", "text").mapInArrow(compute, "doc_id long, n long, fp1 long, fp2 long, keys array<long>")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id and the whole set as bytes of sorted 64-bit hashes."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_lists(batch.column(1))
            for a, b in slices(texts):
                sets = shingle_sets(texts.slice(a, b - a), k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "elements"])

    return docs.select("doc_id", "text").mapInArrow(compute, "doc_id long, elements binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum()) if len(q) else 0
                keep[i] = both > 0 and 100 * both >= percent * (len(p) + len(q) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    left, right = sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per element of the sets (doc_id, elements)."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            parts = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1).slice(i, 256)]
            if parts:
                ids = np.repeat(batch.column(0).slice(i, 256).to_numpy(zero_copy_only=False), [len(x) for x in parts])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(parts), pa.int64())], names=["doc_id", "e"])


def unshared(sets: DataFrame) -> DataFrame:
    """(rep, u): how many elements of a set stand in no other set; 0 where a doc_id has several sets.

    Two sets x and y then share at most ``min(n_x - u_x, n_y - u_y)`` elements.
    """

    rows = sets.mapInArrow(_spread, "doc_id long, e long")
    alone = rows.groupBy("e").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).filter("rep = last").groupBy("rep").agg(F.count("*").alias("u"))
    several = sets.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("rep"))
    return alone.join(several, "rep", "left_anti")


def profiles(sets: DataFrame) -> DataFrame:
    """(rep, p0 .. p17): how many elements of a set fall into each class.

    A class is a range of the number of these sets that hold the element (2 to 8, 9 to 64),
    or beyond that one of ``CELLS`` cells of the hash space; elements of one set only are in
    no class. Two sets share at most the sum over the classes of the smaller count. A doc_id
    with several sets has no row.
    """
    rows = sets.mapInArrow(_spread, "doc_id long, e long")
    often = rows.groupBy("e").agg(F.count("*").alias("f")).filter("f > 1")
    cell = F.when(F.col("f") <= 8, 0).when(F.col("f") <= 64, 1).otherwise(2 + F.shiftrightunsigned("e", 40) % CELLS)
    several = sets.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("rep"))
    counts = rows.join(often, "e").select(F.col("doc_id").alias("rep"), cell.cast("int").alias("cell")).groupBy("rep").agg(*[F.sum((F.col("cell") == j).cast("int")).cast("int").alias(f"p{j}") for j in range(CELLS + 2)])
    return counts.join(several, "rep", "left_anti")


def open_buckets(here: DataFrame) -> DataFrame:
    """The buckets whose members belong to several components: members, largest component, pairs across components."""
    per = here.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key")
    return (
        per.agg(F.sum("c").alias("members"), F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("cc"), F.count("*").alias("comps"))
        .filter("comps > 1")
        .select("key", "members", "main", ((F.col("members") * F.col("members") - F.col("cc")) / 2).alias("pairs"))
    )


def components(docs: DataFrame, k: int = 5, percent: int = 80, star_rounds: int = 2, block: int = BLOCK) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id, kept.

    ``k``: words of a shingle; ``percent``: least similarity in percent; ``star_rounds``: rounds
    in which a bucket's members are compared with one centre, before all remaining pairs are;
    ``block``: members of a bucket that one task of the last round holds against the others.
    """
    sk = materialise(sketches(docs, k), "sketches")
    classes = materialise(
        sk.filter("n > 0 and doc_id is not null").groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("n", "keys"), "doc_id").alias("s")).select("fp1", "fp2", "rep", "s.n", "s.keys"), "classes"
    )
    buckets = classes.select("rep", "n", F.explode("keys").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo <> hi").select("key")
    members = materialise(buckets.join(shared, "key"), "buckets")
    reps = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = materialise(full_sets(docs.select("doc_id", "text").join(reps, "doc_id"), k), "sets")
    # a member with more than the allowed share of unshared elements has no link at all
    bounded = members.join(unshared(sets), "rep", "left").select("key", "rep", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("most"))
    here = materialise(bounded.filter(F.col("most") * 100 >= F.col("n") * percent).withColumn("comp", F.col("rep")), "members")
    discard(members)

    # the largest intersection that two members can have must be enough for a link
    both = F.least("ma", "mb")
    possible = (F.col("ca") != F.col("cb")) & (both * 100 >= (F.col("na") + F.col("nb") - both) * percent)
    side = lambda s, *more: ["key", *more, F.col("rep").alias(s), F.col("n").alias(f"n{s}"), F.col("most").alias(f"m{s}"), F.col("comp").alias(f"c{s}")]
    links, comps, tables = None, None, []
    for step in range(star_rounds + 1):
        buckets = open_buckets(here)
        left = buckets.agg(F.sum("pairs").alias("pairs"), F.sum("members").alias("members")).first()
        if not left["pairs"]:
            break
        last = step == star_rounds or (step > 0 and left["pairs"] <= 16 * left["members"])
        n = int(left["members"])
        open_ = materialise(here.join(buckets, "key"), "open", n)
        if last:
            classed = profiles(sets.join(open_.select(F.col("rep").alias("doc_id")).distinct(), "doc_id"))
            full = materialise(open_.join(classed, "rep", "left"), "profiles", n)
            cells = [f"p{j}" for j in range(CELLS + 2)]
            # members of the bucket's largest component need no comparison with each other; a large bucket is cut into blocks
            blocks = F.ceil(F.col("members") / block).cast("int")
            x = full.filter("comp <> main").select(*side("a"), "main", *[F.col(c).alias(f"a_{c}") for c in cells], F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
            y = full.select(*side("b"), *[F.col(c).alias(f"b_{c}") for c in cells], F.pmod(F.hash("rep"), blocks).alias("block"))
            most = sum((F.least(f"a_{c}", f"b_{c}") for c in cells[1:]), F.least(f"a_{cells[0]}", f"b_{cells[0]}"))
            known = F.col(f"a_{cells[0]}").isNotNull() & F.col(f"b_{cells[0]}").isNotNull()
            enough = ~known | (most * 100 >= (F.col("na") + F.col("nb") - most) * percent)
            once = (F.col("a") < F.col("b")) | (F.col("cb") == F.col("main"))
            pairs = x.join(y, ["key", "block"]).filter(once & possible & enough)
            tables.append(full)
        else:
            # the first centre is the member with the least of its own, the likely origin of the others
            order = F.struct((F.col("na") - F.col("ma")) / F.col("na"), F.col("a")) if step == 0 else F.struct(F.xxhash64("a", "key", F.lit(step)))
            centre = materialise(open_.select(*side("a")).groupBy("key").agg(F.min_by(F.struct("a", "na", "ma", "ca"), order).alias("c")).select("key", "c.*"), "centres", n)
            pairs = centre.join(open_.select(*side("b")), "key").filter(possible)
            tables.append(centre)
        pairs = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs", n)
        found = materialise(verified(pairs, sets, percent), "found", n)
        for table in (*tables, open_, pairs):
            discard(table)
        tables.clear()
        links = found if links is None else links.unionByName(found)
        comps = connected_components(links)
        if last:
            break
        new = here.drop("comp").join(comps, F.col("rep") == F.col("id"), "left").select("key", "rep", "n", "most", F.coalesce("component", "rep").alias("comp"))
        old, here = here, materialise(new, "members")
        discard(old)
    discard(here)
    discard(sets)
    ids = classes.select("fp1", "fp2", "rep")
    ids = ids.withColumn("component", F.col("rep")) if comps is None else ids.join(comps, ids.rep == comps.id, "left").select("fp1", "fp2", "rep", F.coalesce("component", "rep").alias("component"))
    return (
        sk.select("doc_id", "n", "fp1", "fp2")
        .join(ids.select("fp1", "fp2", "component"), ["fp1", "fp2"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stand for their component, with their columns: of each the one with the smallest doc_id.

    Here a node is a (doc_id, text), by its 64-bit hash, so rows with a null doc_id take part
    (they come after all others) and of rows with equal doc_id and text one stays, with words
    or without. Of different texts of one doc_id each is judged on its own.
    """
    (key,) = fresh(docs, "key")
    node = F.xxhash64("doc_id", "text")
    found = materialise(components(docs.select(node.alias("doc_id"), "text"), k, percent), "near-copies")
    several = found.filter("not kept").select("component_id").distinct()
    named = found.join(several, "component_id").select("doc_id", "component_id").distinct().join(docs.select(node.alias("doc_id"), F.col("doc_id").alias("name")).distinct(), "doc_id")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("name").isNull(), "name", "doc_id")).alias("first"))
    gone = named.join(first, "component_id").filter("doc_id <> first.doc_id").select(F.col("doc_id").alias(key))
    out = docs.withColumn(key, node).join(gone, key, "left_anti")
    repeated = materialise(found.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(key)), "repeated")
    if not repeated.isEmpty():
        columns = [F.col(f"`{c}`") for c in docs.columns]
        one = out.join(repeated, key).groupBy(key).agg(F.first(F.struct(*columns)).alias("row")).select(key, "row.*")
        out = out.join(repeated, key, "left_anti").unionByName(one)
    return out.select(*docs.columns)


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=85)


def op2_sql(k: int = 3, percent: int = 85) -> str:
    """All pairs by shared shingles and their transitive closure, as DuckDB SQL."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    run = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce("text", ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= {k} THEN list_transform(range(1, len(w) - {k - 2}), lambda i: {run}) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
u AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= {percent} * (len(x.s) + len(y.s) - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS id, b AS root FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.root = e.a),
m AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(root, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(root, doc_id)) AS kept FROM s LEFT JOIN m ON doc_id = id
"""
