"""License scans by diagonal voting, in DataFrame operations only.

Rolling word k-gram hashes of every text are joined to the positions where templates hold the same k-gram.  A
hit's diagonal is its position in the text minus its position in the template; hits of one copy share one, and
an inserted or missing word only shifts it a little.  Hits are verified word by word where the join finds them,
counted by diagonal, and neighbouring diagonals are merged into spans that must cover enough of their template.

Each gram leaves its row with its own words only, so a text costs time linear in its words, and hits carry a row
number, not a text.  Templates are the few hundred grams fixed below and are broadcast, so grams without a hit are
never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.llm.common import ascii_lower, table

#: Fixed phrases of the contract: (phrase, label).
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Notices that the method looks for, in public licence texts' own words: (text, label).
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("licensed under the apache license version 2 0", "apache"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version", "gpl"),
    ("licensed under the gnu general public license version", "gpl"),
    ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mpl"),
    ("this work is licensed under a creative commons attribution", "cc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]

#: Words in a gram; diagonals that far apart belong together; share of a template's grams that a span must hold.
K, DRIFT, COVER = 2, 3, 0.6


def words_of(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; null texts have none."""
    lowered = ascii_lower(F.coalesce(text, F.lit("")))
    return F.filter(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def template_grams(spark: SparkSession, k: int = K) -> DataFrame:
    """(hash, gram, template, label, kind, tpos, grams): each k-gram of each phrase and template, in a local relation of known size."""
    rows = ", ".join(f"({n}, '{text}', '{label}', '{kind}')" for n, (text, label, kind) in enumerate([(*p, "base") for p in PHRASES] + [(*t, "method") for t in TEMPLATES]))
    made = spark.sql(f"SELECT template, label, kind, split(text, ' ') AS w FROM VALUES {rows} AS t(template, text, label, kind)")
    grams = F.expr(f"transform(sequence(1, size(w) - {k - 1}), i -> slice(w, i, {k}))")
    made = made.select("template", "label", "kind", F.size(grams).alias("grams"), F.posexplode(grams).alias("tpos", "gram"))
    return made.select(F.xxhash64(*(F.col("gram")[i] for i in range(k))).alias("hash"), "*")


def license_spans(docs: DataFrame, k: int = K) -> DataFrame:
    """(row, doc_id, n_words, kind, label, template, first, last, cover): every span of every row of ``docs(doc_id, text)``.

    A row without a span, as of a null or empty text, is returned once with null kind.  ``row`` numbers rows, so
    repeated rows and null doc ids stay apart; no rows give none; other columns are not read.
    """
    words = docs.select("doc_id", words_of(F.col("text")).alias("words")).withColumn("row", F.monotonically_increasing_id()).withColumn("n_words", F.size("words").cast("long"))
    args = ", ".join(f"words[i + {j}]" for j in range(k))
    made = F.expr(f"IF(n_words >= {k}, transform(sequence(0, CAST(n_words AS INT) - {k}), i -> struct(xxhash64({args}) AS hash, slice(words, i + 1, {k}) AS own)), array())")
    grams = words.select("row", "doc_id", "n_words", F.posexplode_outer(made).alias("pos", "g")).select("row", "doc_id", "n_words", "pos", F.col("g.hash").alias("hash"), F.col("g.own").alias("own"))
    hits = grams.join(F.broadcast(template_grams(docs.sparkSession, k)), "hash", "left")  # a few hundred fixed rows
    seen = hits.select("row", "doc_id", "n_words", "pos", F.when(F.expr("own = gram"), F.struct("kind", "label", "template", "tpos", "grams")).alias("h")).where("h is not null or coalesce(pos, 0) = 0")
    diagonals = seen.groupBy("row", "h.template", (F.col("pos") - F.col("h.tpos")).alias("diagonal")).agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("h.kind").alias("kind"), F.first("h.label").alias("label"), F.first("h.grams").alias("grams"),
        F.count("h.tpos").alias("votes"), F.min("pos").alias("first"), (F.max("pos") + k - 1).alias("last"),
    )
    # phrases need every gram on one diagonal; templates merge diagonals of two votes or more that follow each other closely
    stray = (F.col("kind") == "method") & (F.col("votes") < 2)
    diagonals = diagonals.select("row", "doc_id", "n_words", *(F.when(~stray, F.col(c)).alias(c) for c in ("template", "diagonal", "kind", "label", "grams", "votes", "first", "last")))
    w = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(w) > DRIFT) | (F.col("kind") == "base"), F.lit(True))
    spans = diagonals.withColumn("run", F.sum(apart.cast("int")).over(w)).groupBy("row", "template", "run").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("kind").alias("kind"), F.first("label").alias("label"),
        F.min("first").alias("first"), F.max("last").alias("last"), F.least(F.lit(1.0), F.sum("votes") / F.first("grams")).alias("cover"),
    )
    sound = F.when(F.col("kind") == "base", F.col("cover") == 1.0).when(F.col("kind") == "method", F.col("cover") >= COVER).otherwise(F.lit(False))
    empty = [F.when(sound, F.col(c)).alias(c) for c in ("kind", "label", "template", "first", "last", "cover")]
    return spans.select("row", "doc_id", "n_words", *empty)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row a row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the best cover of any span, 0 without one.  Empty and null texts have no words and no labels.
    """
    base = F.col("kind") == "base"
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return (
        license_spans(docs)
        .groupBy("row")
        .agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
            listed(F.when(base, F.col("label"))).alias("base_labels"), listed("label").alias("labels"), F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence phrases and notices, as ``scan_licenses`` gives them."""
    return scan_licenses(table(spark, sf_dir, "documents"))
