"""License scans by diagonal voting, in DataFrame operations alone.

Every rolling word bigram of every text is hashed and joined to the template
positions with the same hash; a hit votes for the diagonal ``text position -
template position``. Votes are summed by diagonal, neighbouring diagonals of a
template are merged into spans, and a span is verified by its share of the
template's bigrams. The templates are a fixed list, so their table is broadcast.

Bigrams are compared by 64-bit hashes: among 1e13 words some 1e-4 places are expected to
meet one of the few hundred template bigrams by chance.

Every text also has one marker, which votes like a template of its own, so texts
without hits have a row, and a document's marker votes tell how many rows of one
partition it stands in: votes are divided by them, and each of these rows is returned.

Defined cases: null text is empty; an empty or null text gives no words, no labels
and score 0; there is one row per input row, whether rows repeat or ids are null; other
columns are ignored. Words are compared after ``lower``; non-ASCII letters occur in
no template, so this equals lower-casing A-Z (of the letters that ``lower`` takes into
ASCII, the Kelvin sign occurs in no base phrase).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The phrases that must match as a whole, with their labels. The first three are the base.
PHRASES = [
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
    ("bsd license", "bsd"),
    ("isc license", "isc"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("cc by nc", "cc-by-nc"),
    ("cc by sa", "cc-by-sa"),
    ("creative commons attribution", "cc-by"),
]
N_BASE = 3

#: Notices from the public license texts, found also where words were changed.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]

#: Words of which a template bigram may not wholly consist.
COMMON = frozenset("the of and or to in is it this that with by for a any as are be".split())


def template_rows() -> list[tuple[int, str, bool, int, int, str, str]]:
    """(template, label, is phrase, bigrams of the template, position, word, next word)."""
    rows = []
    for t, (text, label) in enumerate(PHRASES + NOTICES):
        w = text.split()
        phrase = t < len(PHRASES)
        at = [i for i in range(len(w) - 1) if phrase or not {w[i], w[i + 1]} <= COMMON]
        rows += [(t, label, phrase, len(at), i, w[i], w[i + 1]) for i in at]
    return rows


def scan_licenses(docs: DataFrame, min_share: float = 0.6, max_shift: int = 3) -> DataFrame:
    """One row per document row with its words, base places, labels and best share of a template.

    ``min_share``: least share of a notice's bigrams on merged diagonals;
    ``max_shift``: diagonals that differ by at most this much are merged.
    """
    spark = docs.sparkSession
    # the generator holds the words and hands on one 64-bit hash at a time; pos 0 is the marker
    grams = F.expr("concat(array(0L), zip_with(words, slice(words, 2, greatest(size(words) - 1, 0)), (a, b) -> if(b IS NULL, 0L, xxhash64(a, b))))")
    text = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .select("doc_id", F.xxhash64("text").alias("text_key"), F.spark_partition_id().alias("part"), F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)).alias("words"))
        # counted before the explode, so that the words do not go along with every position
        .select("doc_id", "text_key", "part", F.size("words").cast("long").alias("n_words"), "words")
        .select("doc_id", "text_key", "part", "n_words", F.posexplode(grams).alias("pos", "gram"))
    )
    templates = (
        spark.createDataFrame(template_rows(), "template int, label string, phrase boolean, n_grams int, at int, w1 string, w2 string")
        .select("*", F.xxhash64("w1", "w2").alias("t_gram"))
        .unionByName(spark.range(1).select(F.lit(-1).alias("template"), F.lit("").alias("label"), F.lit(False).alias("phrase"), F.lit(0).alias("n_grams"), F.lit(0).alias("at"), F.lit("").alias("w1"), F.lit("").alias("w2"), F.lit(0).cast("long").alias("t_gram")))
    )
    same = (F.col("gram") == F.col("t_gram")) & ((F.col("pos") == 0) == (F.col("template") < 0))
    doc = ["doc_id", "text_key", "part", "n_words"]
    template = [*doc, "template", "label", "phrase", "n_grams"]
    hits = text.join(F.broadcast(templates), same).select(*template, (F.col("pos") - 1 - F.col("at")).alias("diagonal"))
    # summed before they move, then all of a document's diagonals to one place
    summed = hits.groupBy(*template, "diagonal").agg(F.count("*").alias("votes")).repartition("doc_id", "text_key", "part")
    copies = F.max(F.when(F.col("template") < 0, F.col("votes"))).over(Window.partitionBy(*doc))
    votes = summed.withColumn("copies", copies).withColumn("votes", (F.col("votes") / F.col("copies")).cast("long"))
    by_diagonal = Window.partitionBy(*template).orderBy("diagonal")
    merged = (
        votes.withColumn("new", F.when(F.col("phrase") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > max_shift, F.lit(True)), 1).otherwise(0))
        .withColumn("span", F.sum("new").over(by_diagonal))
        .groupBy(*template, "copies", "span")
        .agg(F.least(F.sum("votes"), F.col("n_grams").cast("long")).alias("votes"), F.min("diagonal").alias("start"))
        .withColumn("share", F.when(F.col("template") < 0, 0.0).otherwise(F.col("votes") / F.col("n_grams")))
    )
    ok = (F.col("template") >= 0) & F.when(F.col("phrase"), F.col("votes") == F.col("n_grams")).otherwise(F.col("share") >= min_share)
    base = ok & (F.col("template") < N_BASE)
    joined = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    return (
        merged.groupBy(*doc, "copies")
        .agg(
            F.sum(base.cast("long")).alias("n_base"),
            F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
            joined(base).alias("base_labels"),
            joined(ok).alias("labels"),
            F.coalesce(F.max(F.when(ok, F.col("share"))), F.lit(0.0)).alias("score"),
        )
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        .drop("text_key", "part", "copies", "copy")
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_sql(min_share: float = 0.6, max_shift: int = 3) -> str:
    """The same plan as DuckDB SQL, joining on the words themselves."""
    values = ", ".join(f"({t}, '{label}', {phrase}, {n}, {at}, '{a}', '{b}')" for t, label, phrase, n, at, a, b in template_rows())
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH t(template, label, phrase, n_grams, "at", w1, w2) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce("text", ''), '{upper}', '{upper.lower()}'), '{WORD}') AS words FROM documents),
w AS (SELECT r, unnest(words[:-2]) AS a, unnest(words[2:]) AS b, unnest(range(len(words) - 1)) AS pos FROM d WHERE len(words) > 1),
v AS (SELECT r, template, label, phrase, n_grams, pos - "at" AS diagonal, count(*) AS votes FROM w JOIN t ON a = w1 AND b = w2 GROUP BY r, template, label, phrase, n_grams, pos - "at"),
n AS (SELECT *, CASE WHEN phrase OR coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) > {max_shift}, true) THEN 1 ELSE 0 END AS fresh FROM v),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM n),
m AS (SELECT r, template, label, phrase, n_grams, span, least(sum(votes), n_grams) AS votes, min(diagonal) AS start FROM s GROUP BY r, template, label, phrase, n_grams, span),
ok AS (SELECT *, votes / n_grams AS share FROM m WHERE CASE WHEN phrase THEN votes = n_grams ELSE votes / n_grams >= {min_share} END),
g AS (SELECT r, count(*) FILTER (WHERE template < {N_BASE}) AS n_base, min(start) FILTER (WHERE template < {N_BASE}) AS first_word, max(start) FILTER (WHERE template < {N_BASE}) AS last_word,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE template < {N_BASE})), ','), '') AS base_labels,
  array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share)::DOUBLE AS score FROM ok GROUP BY r)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN g ON d.r = g.r
"""
