"""License scan by diagonal voting (operator 4).

Every run of three words of every text is hashed and joined, in Spark, to the places of equal runs in the license templates.  A match
votes for the diagonal (word in the text) - (word in the template).  Votes are gathered per document, template and diagonal, diagonals
at most `GAP` apart are merged (words put in or left out move a match to a neighbouring diagonal), and a merged span counts when
it holds enough of the template's words within its length.

The templates are constants of this module (a few hundred rows), so they are broadcast and the runs of the corpus never leave their
task: only matches and one row per document are shuffled.

Defined results: a null or empty text has no words and no label; texts below three words have words but no run.  Each input row
gives one result row, repeated ones too; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 3
GAP = 2
COVERAGE = 0.8

# The phrases that a base label stands for.
BASE_PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

# Further notices, worded as their licenses ask users to word them.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "either version 3 of the license or at your option any later version"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced"),
)


def words_of(text: Column) -> Column:
    """ASCII-lower-cased words: runs of ASCII letters and digits and of all characters beyond ASCII.

    `lower` also changes letters beyond ASCII, which keeps words apart from the ASCII templates but for the Kelvin sign;
    that one is replaced first.
    """
    text = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u2126")))
    return F.array_remove(F.split(text, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def templates(spark: SparkSession) -> DataFrame:
    """One row per run of K template words; the row `tpl = -1` meets the marker row that each document sends along."""
    rows = [(-1, "", False, 0, -1, "")]
    for tpl, (label, phrase) in enumerate(BASE_PHRASES + NOTICES):
        words = phrase.split()
        rows += [(tpl, label, tpl < len(BASE_PHRASES), len(words), i, " ".join(words[i:i + K])) for i in range(len(words) - K + 1)]
    names = ("tpl", "label", "base", "tpl_words", "tpl_pos", "tpl_run")
    made = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows])
    return spark.range(1).select(F.inline(made)).withColumn("tpl_hash", F.xxhash64("tpl_run"))


def matches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Votes, one per matching run, and per input row one marker with `tpl = -1`: row, key, n_words, template columns, `pos`."""
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), words_of(F.col(text)).alias("words"))
    run = F.transform("words", lambda w, i: F.struct(
        i.cast("int").alias("pos"), F.concat_ws(" ", w, F.get("words", i + 1), F.get("words", i + 2)).alias("run")))
    runs = words.select(
        "row", "key", F.size("words").cast("long").alias("n_words"),
        F.concat(F.array(F.struct(F.lit(-1).alias("pos"), F.lit("").alias("run"))), F.slice(run, 1, F.greatest(F.size("words") - (K - 1), F.lit(0)))).alias("runs"))
    single = runs.select("row", "key", "n_words", F.explode_outer("runs").alias("r")).select(
        "row", "key", "n_words", "r.pos", "r.run", F.xxhash64("r.run").alias("hash"))
    table = F.broadcast(templates(docs.sparkSession))
    return single.join(table, (F.col("hash") == F.col("tpl_hash")) & (F.col("run") == F.col("tpl_run"))).drop("hash", "tpl_hash", "run", "tpl_run")


def spans(votes: DataFrame, gap: int = GAP, coverage: float = COVERAGE) -> DataFrame:
    """Merged diagonals per row and template with their share of the template's words (`covered`) and whether they are verified."""
    diagonal = (F.col("pos") - F.col("tpl_pos")).alias("diagonal")
    places = F.array_sort(F.collect_set(F.col("tpl_pos")))
    per_diagonal = votes.repartition("row").groupBy("row", "key", "n_words", "tpl", "label", "base", "tpl_words", diagonal).agg(places.alias("places"))
    order = Window.partitionBy("row", "tpl").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > gap, F.lit(True)).cast("int")
    clustered = per_diagonal.withColumn("fresh", fresh).withColumn("cluster", F.sum("fresh").over(order))
    first = F.col("diagonal") + F.array_min("places")
    last = F.col("diagonal") + F.array_max("places") + K
    exact = F.col("base") & (F.size("places") == F.col("tpl_words") - (K - 1))
    merged = clustered.groupBy("row", "key", "n_words", "tpl", "label", "base", "tpl_words", "cluster").agg(
        F.min(first).alias("first"), F.max(last).alias("stop"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
        F.sum(exact.cast("long")).alias("n_exact"), F.min(F.when(exact, F.col("diagonal"))).alias("first_exact"),
        F.max(F.when(exact, F.col("diagonal"))).alias("last_exact"))
    hit = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (K - 1))))))
    covered = F.when(F.col("tpl") >= 0, hit / F.col("tpl_words")).otherwise(F.lit(0.0))
    # words may be put in between, but a span that is much longer than its template holds scattered words only;
    # a repeated notice gives overlapping clusters, which the exact count covers
    near = (F.col("stop") - F.col("first") <= F.col("tpl_words") * 1.5 + gap) | (F.col("n_exact") > 0)
    return merged.withColumn("covered", covered).withColumn("verified", (F.col("tpl") >= 0) & near & (F.col("covered") >= coverage))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: places of the base phrases, labels and the best verified share of a template."""
    found = spans(matches(docs, key, text))
    joined = lambda labels: F.array_join(F.array_sort(F.collect_set(labels)), ",")
    best = F.max(F.when(F.col("verified"), F.col("covered")).otherwise(F.lit(0.0)))
    return found.groupBy("row", "key", "n_words").agg(
        F.sum("n_exact").alias("n_base"), F.min("first_exact").cast("long").alias("first_word"), F.max("last_exact").cast("long").alias("last_word"),
        joined(F.when(F.col("n_exact") > 0, F.col("label"))).alias("base_labels"),
        joined(F.when(F.col("verified") | (F.col("n_exact") > 0), F.col("label"))).alias("labels"), best.alias("score"),
    ).select(F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
