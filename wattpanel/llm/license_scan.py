"""License scan by diagonal voting.

All rolling word k-grams of the documents are hashed and joined to the positions at which the
templates have the same k-gram.  A hit votes for the diagonal (document position minus template position); votes are
counted per (document, template, diagonal), neighbouring diagonals (a word added or left
out shifts the rest by one) are merged, and a merged span is verified: it must cover ``COVER`` of the template's words (more of a template under ``LOOSE`` words, all of one up to ``WHOLE``) inside a span not much
longer than the template, and no overlapping span may cover its own template better.  Base phrases are found word by word beside this and always stay.

Words are runs of letters, digits and non-ASCII characters of the lower-cased text.  Null text is empty; identical rows (doc_id and text) get identical results,
each row one; templates shorter than ``K`` words are refused.  Template k-grams are broadcast in blocks of ``BLOCK_GRAMS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import reliable, text_key, text_or_empty

K = 3
COVER = 0.8
WHOLE, LOOSE = 12, 40  # up to 12 words a template must be covered whole (one word tells versions apart), from 40 on to COVER, in between in proportion
NEIGHBOURS = 3
SLACK = 1.5
BLOCK_GRAMS = 500_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# fixed values: base phrases and their labels
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# fixed values: notices by which licenses are applied or referred to
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


def _words(text: Column) -> Column:
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")  # no other letters
    return F.array_remove(F.split(lowered, NOT_WORD), "")


def _needed(words: Column) -> Column:
    """Share of a template's words that a span must cover: falls from 1 to ``COVER`` without a step."""
    loose = F.least(F.greatest((words - WHOLE) / (LOOSE - WHOLE), F.lit(0.0)), F.lit(1.0))
    return 1 - (1 - COVER) * loose - 1e-9


def _grams(frame: DataFrame, k: int) -> DataFrame:
    """``frame`` with hw -> a row for each word k-gram: at and gram."""
    placed = frame.select("*", F.posexplode("hw").alias("at", "_w")).filter(F.col("at") <= F.size("hw") - k)
    return placed.select(*[c for c in frame.columns if c != "hw"], "at", F.xxhash64(*[F.get("hw", F.col("at") + j) for j in range(k)]).alias("gram"))


def _template_blocks(spark: SparkSession, templates: tuple[tuple[str, str], ...], k: int) -> list[DataFrame]:
    rows = [(i, label, text) for i, (label, text) in enumerate(templates)]
    blocks, now, size = [], [], 0
    for row in rows:
        now.append(row)
        size += len(row[2].split())
        if size >= BLOCK_GRAMS:
            blocks, now, size = [*blocks, now], [], 0
    frames = [spark.createDataFrame(b, "template int, label string, text string") for b in [*blocks, now] if b]
    out = []
    for frame in frames:
        hashed = frame.select("template", "label", F.transform(_words(F.col("text")), lambda w: F.xxhash64(w)).alias("hw")).withColumn("words", F.size("hw"))
        out.append(_grams(hashed.filter(F.col("words") >= k), k).withColumnRenamed("at", "template_at"))
    return out


def spans(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, k: int = K) -> DataFrame:
    """doc_id, _k1, _k2, label, cover, first_word, last_word and verified of the merged spans."""
    named = docs.select("doc_id", *text_key(), F.transform(_words(text_or_empty()), lambda w: F.xxhash64(w)).alias("hw"))
    grams = _grams(named, k)
    out = None
    for block in _template_blocks(docs.sparkSession, templates, k):
        hits = grams.join(F.broadcast(block), "gram")
        row = ["doc_id", "_k1", "_k2", "template", "label", "words"]
        votes = hits.groupBy(*row, (F.col("at") - F.col("template_at")).alias("diagonal")).agg(F.collect_set("template_at").alias("q"), F.min("at").alias("first"), F.max("at").alias("last"))
        order = Window.partitionBy(*row).orderBy("diagonal")
        fresh = F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= NEIGHBOURS, 0).otherwise(1)
        merged = votes.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))
        merged = merged.groupBy(*row, "run").agg(F.array_distinct(F.flatten(F.collect_list("q"))).alias("q"), F.min("first").alias("first"), F.max("last").alias("last"))
        covered = F.size(F.array_distinct(F.flatten(F.transform("q", lambda p: F.sequence(p, p + (k - 1))))))
        merged = merged.withColumn("cover", covered / F.col("words"))
        fits = (F.col("cover") >= _needed(F.col("words"))) & (F.col("last") + k - F.col("first") <= F.col("words") * SLACK + NEIGHBOURS)
        found = merged.select("doc_id", "_k1", "_k2", "label", "cover", F.col("first").cast("long").alias("first_word"), (F.col("last") + (k - 1)).cast("long").alias("last_word"), fits.alias("verified"))
        out = found if out is None else out.unionByName(found)
    reach = int(max(2 * len(text.split()) for _, text in templates) * SLACK) + NEIGHBOURS  # no verified span is longer
    around = Window.partitionBy("doc_id", "_k1", "_k2").orderBy("first_word").rangeBetween(-reach, reach)
    near = F.collect_list(F.when(F.col("verified"), F.struct("first_word", "last_word", "cover"))).over(around)
    beaten = F.expr("exists(near, x -> x.first_word <= last_word and x.last_word >= first_word and x.cover > cover)")
    return out.withColumn("near", near).withColumn("verified", F.col("verified") & ~beaten).drop("near")


def _places(phrase: str) -> Column:
    """Word positions at which the phrase stands, from the words ``w``."""
    words = phrase.split()
    match = " and ".join(f"get(w, i + {j}) = '{x}'" for j, x in enumerate(words))
    return F.expr(f"filter(sequence(0L, greatest(0L, size(w) - {len(words)})), i -> coalesce({match}, false))".replace("get(w, i +", "get(w, cast(i as int) +"))


def base_places(docs: DataFrame) -> DataFrame:
    """doc_id, _k1, _k2, n_words, n_base, first_word, last_word and base (labels) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(), _words(text_or_empty()).alias("w"))
    rows = rows.withColumn("all", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")))
    none = F.expr("cast(array() as array<bigint>)")
    found = [F.when(F.col("all").contains(f" {phrase} "), _places(phrase)).otherwise(none).alias(f"p{i}") for i, (phrase, _) in enumerate(BASE)]
    rows = rows.select("doc_id", "_k1", "_k2", F.size("w").cast("long").alias("n_words"), *found)
    places = F.concat(*[F.col(f"p{i}") for i in range(len(BASE))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)]))
    return rows.select("doc_id", "_k1", "_k2", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"), F.array_sort(labels).alias("base"))


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score (largest share of a template found) of every row."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    best = spans(docs, templates).groupBy(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), F.col("_k1").alias("_a"), F.col("_k2").alias("_b"))
    best = reliable(best.agg(F.collect_set(F.when(F.col("verified"), F.col("label"))).alias("more"), F.max("cover").alias("cover")))
    rows = base_places(docs)
    same = (F.coalesce(rows["doc_id"], F.lit(0)) == best["_id"]) & (rows["doc_id"].isNull() == best["_none"]) & (rows["_k1"] == best["_a"]) & (rows["_k2"] == best["_b"])
    rows = rows.join(best, same, "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.coalesce("cover", F.lit(0.0)).alias("score")
    )
