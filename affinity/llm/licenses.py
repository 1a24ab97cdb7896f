"""License scans by diagonal voting, in DataFrame functions only.

Every document becomes an array of word hashes and, by array passes, all rolling
hashes of k words. One pass explodes them and joins them to the places of the
same k-grams in the license templates; the words themselves decide each match.
A match at document word p of template word t votes for the diagonal p - t: a
copy of a template puts all its votes on one diagonal, and each word inserted or
lost moves the rest of them to a neighbouring one. Neighbouring diagonals are
merged, and the merged span counts if it covers enough of the template.

A template shorter than k words is matched whole, as one gram of its own length.
Only matches and one row per document are shuffled, never texts.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinity.llm.decontaminate import words_of


class Template(NamedTuple):
    label: str
    text: str
    base: bool = False  # a phrase whose every place is reported


#: Phrases whose places are counted (fixed values).
PHRASES = [Template("mit", "mit license", True), Template("apache", "apache license", True),
           Template("gpl", "general public license", True)]

#: Public license notices (fixed values: their usual wording).
NOTICES = [
    Template("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
    copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
    is furnished to do so, subject to the following conditions"""),
    Template("apache", """you may not use this file except in compliance with the License. You may obtain a copy of the License at
    http://www.apache.org/licenses/LICENSE-2.0"""),
    Template("apache", "licensed under the apache license version 2.0"),
    Template("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
    License as published by the Free Software Foundation"""),
    Template("gpl", "this work is licensed under the gnu general public license version 3"),
    Template("lgpl", "GNU Lesser General Public License"),
    Template("agpl", "GNU Affero General Public License"),
    Template("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met"""),
    Template("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
    granted, provided that the above copyright notice and this permission notice appear in all copies"""),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("cc-by", "licensed under cc by 4.0"),
    Template("cc-by-sa", "licensed under cc by-sa 4.0"),
    Template("cc-by-nc", "licensed under cc by-nc 4.0"),
    Template("cc-by-nc-sa", "licensed under cc by-nc-sa 4.0"),
    Template("cc-by-nc-nd", "licensed under cc by-nc-nd 4.0"),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc0", "dedicated to the public domain under CC0"),
]

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Words of a gram, and the least share of a template's grams that a span must cover.
GRAM, SHARE = 4, 0.6
#: Above so many template words the grams are no longer broadcast but joined by a shuffle.
BROADCAST_WORDS = 200_000


def rolling(df: DataFrame, words: str, sizes: list[int]) -> DataFrame:
    """Add _gN, the rolling hashes of N words from each word on, for each N.

    Every list is as long as that of the words, the last N - 1 hashes stand for
    fewer words; each pass doubles the covered length.
    """
    df = df.withColumn("_h", F.transform(words, lambda x: F.xxhash64(x)))
    for n in sizes:
        g, df = F.col(f"_g{n}"), df.withColumn(f"_g{n}", F.col("_h"))
        size = 1
        while size < n:
            step = min(size, n - size)
            df = df.withColumn(f"_g{n}", F.zip_with(g, F.slice(g, F.lit(step + 1), F.size(g)), lambda x, y: F.xxhash64(x, y)))
            size += step
    return df


def template_words(text: str) -> list[str]:
    """The words of a template, as ``words_of`` gives those of a document."""
    return _WORD.findall(text.translate(_LOWER))


def template_grams(spark: SparkSession, words: list[list[str]], k: int) -> tuple[DataFrame, list[int]]:
    """(_template, _k, _slot, _at, _gram, _f): a row for each place of a gram, _slot the number of its size; and the sizes."""
    sizes = sorted({min(len(w), k) for w in words if w})
    rows = [(i, n, sizes.index(n), at, w[at:at + n]) for i, w in enumerate(words) if w
            for n in [min(len(w), k)] for at in range(len(w) - n + 1)]
    out = spark.createDataFrame(rows, "_template int, _k int, _slot int, _at int, _w array<string>")
    hashed = rolling(out, "_w", sizes)
    f = F.coalesce(*[F.when(F.col("_k") == n, F.get(f"_g{n}", F.lit(0))) for n in sizes])
    return hashed.select("_template", "_k", "_slot", "_at", F.array_join("_w", " ").alias("_gram"), f.alias("_f")), sizes


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(labels)), ",")


def scan_licenses(docs: DataFrame, templates: list[Template] | None = None, k: int = GRAM, share: float = SHARE,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Words are runs of ASCII digits and letters (A-Z lower-cased) and all
    characters beyond ASCII. n_base counts the places of base templates,
    first_word and last_word are their least and greatest first word (from 0; null
    without one). labels also has those of the templates found as spans.
    ``spans`` lists every one: label, from, to (words, end exclusive), cover.
    score is 0 without a span, else half for any and half for the greatest share
    of a notice (a template that is no base phrase) that one span covers.

    Null and empty texts have no words and score 0; a null id is kept; repeated
    rows repeat their row; templates without words match nothing; other columns
    are not read.
    """
    spark = docs.sparkSession
    templates = PHRASES + NOTICES if templates is None else templates
    key = ["_id", "_k1", "_k2"]  # equal id and text: equal result, however often the row occurs
    text = F.coalesce("_t", F.lit(""))
    read = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).select(
        "_id", F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(7), text).alias("_k2"), words_of(F.col("_t")).alias("_w"))
    words = [template_words(t.text) for t in templates]
    # what is known of a template: slack is how far apart two diagonals of one copy may lie
    about = spark.createDataFrame([(i, t.label, t.base, min(len(w), k), max(len(w) - k, 0) + 1, 0 if t.base else len(w) // 8)
                                   for i, (t, w) in enumerate(zip(templates, words))],
                                  "_template int, label string, base boolean, _k int, n_grams int, slack int")
    # a gram that every document has once, behind the lists of all sizes: it stands for the document, its place is n_words
    every = F.xxhash64(F.lit("document"))
    sizes = [1]
    one = spark.range(1).select(F.lit(-1).alias("_template"), F.lit(0).alias("_k"), F.lit(0).alias("_slot"), F.lit(0).alias("_at"),
                                F.lit("").alias("_gram"), every.alias("_f"))
    if any(words):
        grams, sizes = template_grams(spark, words, k)
        one = one.withColumn("_slot", F.lit(len(sizes) - 1)).unionByName(grams)
    if sum(map(len, words)) <= BROADCAST_WORDS:
        one, about = F.broadcast(one), F.broadcast(about)

    listed = F.concat(*[F.col(f"_g{n}") for n in sizes], F.array(every))
    # (the outer form: no filter on the list's size is derived and pushed through the projections that build it)
    grams = (rolling(read, "_w", sizes).select(*key, "_w", listed.alias("_all"))
             .select(*key, "_w", F.posexplode_outer("_all").alias("_i", "_f")))
    n = F.size("_w")
    place = F.col("_i") - F.col("_slot") * n
    same = F.array_join(F.slice("_w", place + 1, F.col("_k")), " ") == F.col("_gram")  # the words decide
    hits = (grams.join(one, "_f").filter((place >= 0) & (place + F.col("_k") <= n) & same)
            .groupBy(*key, "_template", "_at", place.alias("_p")).agg(F.count(F.lit(1)).alias("_rows")))

    # votes by diagonal, neighbouring diagonals merged; the document's own row goes along as template -1
    diagonals = (hits.groupBy(*key, "_template", (F.col("_p") - F.col("_at")).alias("_diagonal"))
                 .agg(F.collect_set("_at").alias("_ats"), F.min("_p").alias("_from"), F.max("_p").alias("_last"),
                      F.max("_rows").alias("_rows"))
                 .join(about, "_template", "left"))
    along = Window.partitionBy(*key, "_template").orderBy("_diagonal")
    apart = F.col("_diagonal") - F.lag("_diagonal").over(along) > F.col("slack")
    regions = (diagonals.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int"))
               .withColumn("_region", F.sum("_new").over(along))
               .groupBy(*key, "_template", "label", "base", "_k", "n_grams", "_region")
               .agg(F.size(F.array_distinct(F.flatten(F.collect_list("_ats")))).alias("_cover"), F.min("_from").alias("_from"),
                    F.max("_last").alias("_last"), F.max("_rows").alias("_rows"))
               .withColumn("_share", F.col("_cover") / F.col("n_grams"))
               .filter((F.col("_template") < 0) | (F.col("_share") >= share)))

    is_doc, base = F.col("_template") < 0, F.col("base")
    span = F.struct("label", F.col("_from").alias("from"), (F.col("_last") + F.col("_k")).alias("to"), F.col("_share").alias("cover"))
    best = F.max(F.when(~is_doc & ~base, F.col("_share")))
    return (regions.groupBy(*key).agg(
        F.max(F.when(is_doc, F.col("_from"))).cast("long").alias("n_words"), F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("_from"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("_from"))).cast("long").alias("last_word"),
        _joined(F.when(base, F.col("label"))).alias("base_labels"), _joined(F.col("label")).alias("labels"),
        F.when(F.count_if(~is_doc) > 0, F.lit(0.5) + F.lit(0.5) * F.coalesce(best, F.lit(0.0))).otherwise(F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(~is_doc, span))).alias("spans"), F.max(F.when(is_doc, F.col("_rows"))).alias("_rows"))
        .withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))))
        .select(F.col("_id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"))
