"""Mixing sources to target weights: iterative proportional fitting and calibrated sampling.

Tokens are summed into cells of (source, language, topic). Raking scales the cells until the
token shares of every source, language and topic meet their targets; a document's weight is
its cell's factor. Documents are then kept with probability ``min(1, scale * factor)``, where
``scale`` makes the expected tokens of the sample the wanted share of all tokens, and a kept
document's weight is divided by its probability, so weighted sums stay calibrated. A
document's draw is a hash of its id, or of its text where the id is null, the same on
every run.

Targets are given as shares per value, or by default are the observed shares raised to a
tempering power and normalised, so that large sources and languages weigh less. Values
without a target keep their observed share; the shares of each margin are normalised. A
target of 0 gives a value's documents the factor and probability 0. Raking ends when every
margin is met to ``TOLERANCE`` or after ``rounds``; ``margins`` tells what was reached,
which differs from the targets where no weights can meet them all.

Cells are few where the margins are (sources x languages x topics). Up to ``local_cells``
cells are raked on the driver; beyond that each step is two aggregates and joins in Spark.

Defined cases: null source, language or text is a value of its own (``""``, ``""`` and no
tokens); documents without tokens have weight 0 and are kept, as they weigh nothing; rows
are judged one by one, and repeated rows share their draw; other columns are kept by
``sample_mixture``, but for columns named like the ones that it adds, which it replaces.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import discard, fresh, materialise

MARGINS = ("source", "lang", "topic")
#: Tempering powers of the default targets.
POWERS = {"source": 0.7, "lang": 0.8, "topic": 0.9}
KEEP = 0.8
LOCAL_CELLS = 50_000
ROUNDS = 100
#: Raking has converged when every margin is within this share of its target.
TOLERANCE = 1e-9
UNIT = 2**32


def topic_of(text: Column) -> Column:
    """The default topic: what kind of text the document's marks tell."""
    per = lambda c: (F.length(text) - F.length(F.replace(text, F.lit(c)))) * 100
    n = F.length(text)
    return (
        F.when(n == 0, "empty")
        .when(per("|") > n, "table")
        .when(per("!") > n, "loud")
        .when(text.contains("License") | text.contains("licensed"), "licensed")
        .when(n < 500, "short")
        .otherwise("prose")
    )


def cell_columns(topic=topic_of) -> dict[str, Column]:
    """A document's margins, tokens (runs without ASCII white space) and draw."""
    text = F.coalesce("text", F.lit(""))
    bare = F.trim(text, F.lit(" \t\n\x0b\f\r"))
    words = F.when(bare == "", 0).otherwise(F.size(F.split(bare, "[ \t\n\x0b\f\r]+")))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("|"), text))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("mix|"), name)), 1, 8), 16, 10)
    return {"source": F.coalesce("source", F.lit("")), "lang": F.coalesce("lang", F.lit("")), "topic": topic(text), "n_tokens": words.cast("long"), "draw": draw.cast("long")}


def goals(cells: DataFrame, margin: str, power: float, given: dict[str, float] | None) -> DataFrame:
    """The target share of each value of a margin; they add up to 1."""
    sums = cells.groupBy(margin).agg(F.sum("mass").alias("m")).filter("m > 0")
    total = sums.agg(F.sum("m")).first()[0] or 1.0
    share = F.col("m") / float(total)
    if given is None:
        raw = F.pow(share, F.lit(power))
    elif given:
        raw = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in given.items() for x in (kv[0], float(kv[1]))]), F.col(margin)), share)
    else:
        raw = share
    out = sums.select(margin, raw.alias("goal"))
    norm = out.agg(F.sum("goal")).first()[0] or 1.0
    return out.withColumn("goal", F.col("goal") / float(norm))


def local_goals(sums: dict[str, float], power: float, given: dict[str, float] | None) -> dict[str, float]:
    """The same targets as ``goals`` from the sums of a margin's values."""
    total = sum(sums.values()) or 1.0
    raw = {v: (m / total) ** power if given is None else given.get(v, m / total) for v, m in sums.items()}
    norm = sum(raw.values()) or 1.0
    return {v: r / norm for v, r in raw.items()}


def rake_locally(rows: list, targets: dict[str, dict[str, float]] | None, rounds: int) -> np.ndarray:
    """The factor of each cell (source, lang, topic, mass)."""
    mass = np.array([r["mass"] for r in rows], float)
    factor = np.ones(len(rows))
    index, aim = {}, {}
    for m in MARGINS:
        names, index[m] = np.unique(np.array([r[m] for r in rows], object).astype(str), return_inverse=True)
        sums = dict(zip(names.tolist(), np.bincount(index[m], weights=mass).tolist(), strict=True))
        want = local_goals(sums, POWERS[m], (targets or {}).get(m) if targets else None)
        aim[m] = np.array([want[n] for n in names.tolist()]) * mass.sum()
    for _ in range(rounds):
        off = 0.0
        for m in MARGINS:
            now = np.bincount(index[m], weights=mass * factor, minlength=len(aim[m]))
            by = np.divide(aim[m], now, out=np.zeros_like(now), where=now > 0)
            off = max(off, float(abs(by[(now > 0) & (aim[m] > 0)] - 1).max(initial=0.0)))
            factor *= by[index[m]]
        if off <= TOLERANCE:
            break
    return factor


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, local_cells: int = LOCAL_CELLS) -> DataFrame:
    """The cells (source, lang, topic, mass) with a column ``factor``."""
    spark = cells.sparkSession
    cells = cells.filter("mass > 0").select(*MARGINS, "mass")
    schema = "source string, lang string, topic string, mass double, factor double"
    n, total = cells.agg(F.count("*"), F.sum("mass")).first()
    if not n:
        return spark.createDataFrame([], schema)
    if n <= local_cells:
        rows = sorted(cells.collect())
        return spark.createDataFrame([(*r, float(f)) for r, f in zip(rows, rake_locally(rows, targets, rounds), strict=True)], schema)
    aims = {m: materialise(goals(cells, m, POWERS[m], (targets or {}).get(m) if targets else None), "goals") for m in MARGINS}
    now = materialise(cells.withColumn("factor", F.lit(1.0)), "rake")
    for _ in range(rounds):
        step = now
        for m in MARGINS:
            by = F.when(F.col("have") > 0, F.col("goal") * total / F.col("have")).otherwise(0.0)
            scale = step.groupBy(m).agg(F.sum(F.col("mass") * F.col("factor")).alias("have")).join(aims[m], m).select(m, by.alias("by"))
            step = step.join(scale, m).withColumn("factor", F.col("factor") * F.col("by")).drop("by")
        new = materialise(step.select(*MARGINS, "mass", "factor"), "rake")
        off = new.join(now.select(*MARGINS, F.col("factor").alias("old")), list(MARGINS)).filter("old > 0").agg(F.max(F.abs(F.col("factor") / F.col("old") - 1))).first()[0]
        discard(now)
        now = new
        if (off or 0) <= TOLERANCE:
            break
    return now


def scale_for(cells: DataFrame, keep: float, local_cells: int = LOCAL_CELLS) -> float:
    """The scale at which the expected tokens of ``min(1, scale * factor)`` are ``keep`` of all tokens, by bisection."""
    mass = cells.agg(F.sum("mass")).first()[0]
    cells = cells.filter("factor > 0")
    reach, total, top, n = cells.agg(F.sum("mass"), F.sum(F.col("mass") * F.col("factor")), F.max(1 / F.col("factor")), F.count("*")).first()
    if not reach or not keep:
        return 1.0 if keep else 0.0
    want = min(keep * mass, reach)
    if n <= local_cells:
        m, f = (np.array(x) for x in zip(*[(r["mass"], r["factor"]) for r in cells.select("mass", "factor").collect()], strict=True))

        def reached(points: list[float]) -> list[float]:
            return [float((m * np.minimum(1.0, f * p)).sum()) for p in points]
    else:

        def reached(points: list[float]) -> list[float]:
            return list(cells.agg(*[F.sum(F.col("mass") * F.least(F.lit(1.0), F.col("factor") * p)) for p in points]).first())

    # factors may differ by many orders of magnitude, so the steps are ratios
    low, high = want / total, float(top)
    for _ in range(7):
        points = [low * (high / low) ** ((i + 1) / 64) for i in range(64)]
        over = next((i for i, x in enumerate(reached(points)) if x >= want), 63)
        low, high = (points[over - 1] if over else low), points[over]
    return high


def drawn(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, topic=topic_of, rounds: int = ROUNDS, local_cells: int = LOCAL_CELLS) -> tuple[DataFrame, dict[str, Column]]:
    """The documents with private columns, and these: ``source lang topic n_tokens draw factor p``.

    The factors are joined by cell: broadcast up to ``local_cells`` cells, so no document
    moves; beyond that Spark chooses, and splits the hot cells of a sort-merge join.
    """
    wanted = cell_columns(topic)
    names = dict(zip([*wanted, "f"], fresh(docs, *wanted, "f"), strict=True))
    named = docs.select("*", *[c.alias(names[k]) for k, c in wanted.items()])
    cells = materialise(named.groupBy(*[F.col(names[m]).alias(m) for m in MARGINS]).agg(F.sum(names["n_tokens"]).cast("double").alias("mass")), "cells")
    raked = rake(cells, targets, rounds, local_cells)
    scale = scale_for(raked, keep, local_cells)
    factors = raked.select(*[F.col(m).alias(names[m]) for m in MARGINS], F.col("factor").alias(names["f"]))
    if cells.count() <= local_cells:
        factors = F.broadcast(factors)
    out = named.join(factors, [names[m] for m in MARGINS], "left")
    col = {k: F.col(v) for k, v in names.items()}
    col["factor"] = F.when(col["n_tokens"] == 0, 0.0).otherwise(F.coalesce(col["f"], F.lit(0.0)))
    col["p"] = F.when(col["n_tokens"] == 0, 1.0).otherwise(F.least(F.lit(1.0), col["factor"] * scale))
    col["kept"] = col["draw"] < col["p"] * UNIT
    col["weight"] = F.when(col["kept"] & (col["n_tokens"] > 0), col["factor"] / col["p"]).otherwise(0.0)
    return out, col


def margins(weighed: DataFrame) -> DataFrame:
    """margin, value, observed and weighted share of the tokens, over the rows of ``weigh``."""
    total = weighed.agg(F.sum("n_tokens").alias("t"), F.sum(F.col("n_tokens") * F.col("factor")).alias("w"))
    one = [
        weighed.groupBy(F.lit(m).alias("margin"), F.col(m).alias("value")).agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") * F.col("factor")).alias("m")) for m in MARGINS
    ]
    all_ = one[0].unionByName(one[1]).unionByName(one[2]).join(F.broadcast(total))
    return all_.select("margin", "value", (F.col("n") / F.col("t")).alias("observed"), (F.col("m") / F.col("w")).alias("weighted"))


def weigh(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, topic=topic_of, rounds: int = ROUNDS, local_cells: int = LOCAL_CELLS) -> DataFrame:
    """One row per document: its cell, tokens, factor, probability, whether it is kept, and its weight if kept."""
    out, col = drawn(docs.select("doc_id", "text", "source", "lang"), targets, keep, topic, rounds, local_cells)
    return out.select("doc_id", *[col[m].alias(m) for m in (*MARGINS, "n_tokens", "factor")], col["p"].alias("probability"), col["kept"].alias("kept"), col["weight"].alias("weight"))


def sample_mixture(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, topic=topic_of) -> DataFrame:
    """The documents drawn, with all their columns and ``mix_tokens``, ``mix_probability`` and ``mix_weight``."""
    out, col = drawn(docs, targets, keep, topic)
    added = {"mix_tokens": col["n_tokens"], "mix_probability": col["p"], "mix_weight": col["weight"]}
    return out.filter(col["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added], *[c.alias(k) for k, c in added.items()])


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weigh(spark.read.parquet(f"{sf_dir}/documents.parquet"))
