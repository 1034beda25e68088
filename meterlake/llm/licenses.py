"""License notices by diagonal voting of word k-grams, in DataFrame operations only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Templates of more words than this are met by four words in a row, which seldom repeat within a text; others by two.
SHORT = 12


@dataclass(frozen=True)
class Template:
    """``whole``: every word must stand in place; else a span must be alike to a share ``share``."""

    name: str
    label: str
    text: str
    whole: bool = False
    share: float = 0.8

    @property
    def words(self) -> list[str]:
        return re.findall("[a-z0-9]+", self.text.lower())

    @property
    def k(self) -> int:
        return 2 if len(self.words) <= SHORT else 4


# The base phrases with their labels, then notices and headers of common licenses in their usual wording.
BASE = (
    Template("base-mit", "mit", "mit license", True),
    Template("base-apache", "apache", "apache license", True),
    Template("base-gpl", "gpl", "general public license", True),
)
NOTICES = (
    Template("mit-notice", "mit", "Released under the MIT License."),
    Template("mit-grant", "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    Template("apache-notice", "apache-2.0", "Licensed under the Apache License, Version 2.0."),
    Template("gpl-notice", "gpl-3.0", "licensed under the GNU General Public License, version 3."),
    Template("lgpl-notice", "lgpl", "GNU Lesser General Public License"),
    Template("cc-by-nc", "cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    Template("cc-by-sa", "cc-by-sa", "Creative Commons Attribution-ShareAlike"),
    Template("bsd-terms", "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    Template("mpl-notice", "mpl-2.0", "Mozilla Public License, v. 2.0"),
)
HEADERS = (
    Template("mit-text", "mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
        conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""),
    Template("apache-header", "apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See
        the License for the specific language governing permissions and limitations under the License."""),
    Template("gpl-3-header", "gpl-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""", share=0.98),
    Template("gpl-2-header", "gpl-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""", share=0.98),
    Template("lgpl-header", "lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
        License as published by the Free Software Foundation""", share=0.95),
    Template("bsd-text", "bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."""),
    Template("mpl-header", "mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    Template("isc-text", "isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies."""),
    Template("unlicense-text", "unlicense", "This is free and unencumbered software released into the public domain."),
    Template("cc-by-sa-header", "cc-by-sa", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
)


@dataclass(frozen=True)
class LicenseScan:
    """``drift``: how far apart in words two diagonals of one notice may lie to be merged (words put in or left out)."""

    drift: int = 3
    templates: tuple[Template, ...] = BASE + NOTICES + HEADERS


def words_of(text: Column) -> tuple[Column, Column]:
    """(words, how many): what stands between runs of ASCII characters other than letters and digits, A-Z lower-cased. A text
    is split at those runs, which costs far less than matching every word; an empty first or last part is no word."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), BETWEEN)
    lead = (F.get(parts, F.lit(0)) == "").cast("int")
    trail = ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    n = F.size(parts) - lead - trail
    return F.slice(parts, lead + 1, n), n.cast("long")


def _template_grams(spark: SparkSession, p: LicenseScan) -> DataFrame:
    """(template, length, k, t_pos, t_two, t_four): a row for each position; ``t_four`` is null where two words are enough."""
    rows = []
    for t in p.templates:
        w = t.words
        if len(w) < t.k:
            raise ValueError(f"template {t.name} has fewer than {t.k} words")
        rows += [(t.name, len(w), t.k, i, " ".join(w[i : i + 2]), " ".join(w[i : i + 4]) if t.k == 4 else None) for i in range(len(w) - t.k + 1)]
    return spark.createDataFrame(rows, "template string, length int, k int, t_pos int, t_two string, t_four string").withColumn("hash", F.xxhash64("t_two"))


def scan_licenses(docs: DataFrame, p: LicenseScan = LicenseScan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Every rolling pair of words of every text is hashed and joined to the positions of the templates' pairs (the
    templates are parameters, about a thousand rows, so they are the broadcast side); in templates of more than
    ``SHORT`` words the next two words must agree as well. Matches vote for their diagonal, word position less template
    position. A base phrase stands where all its words are on one diagonal. Of the other templates, diagonals within ``drift``
    words that follow one another, in the text and in the template, merge to one span. Spans are verified word by word: the template's
    words that stand in the span, each counted once and in order, over the words of the template or of the
    span, whichever are more, must be the template's ``share`` at least. The score is the largest such share.

    Null and empty texts have no words and score 0. Rows are told apart by id and text, so repeated rows
    get equal results; a null id is an id like others. Phrases match across any separators.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    gram = lambda k: F.concat_ws(" ", *[F.get("words", F.col("pos") + j) for j in range(k)])
    texts = d.select("doc_id", "text_hash", words_of(F.col("text"))[0].alias("words"))
    # positions are exploded and words are taken from the one array of the text: no array of grams is built, however long the text
    places = F.when(F.size("words") > 1, F.sequence(F.lit(0), F.size("words") - 2))
    exploded = texts.select("doc_id", "text_hash", "words", F.explode(places).alias("pos")).withColumn("two", gram(2)).withColumn("hash", F.xxhash64("two"))
    # equal hashes are followed by equal words, so that no collision votes
    votes = exploded.join(F.broadcast(_template_grams(spark, p)), "hash").where((F.col("two") == F.col("t_two")) & (F.col("t_four").isNull() | (F.col("t_four") == gram(4)))).drop("words")
    names = ["doc_id", "text_hash", "template", "length", "k"]
    diagonals = votes.groupBy(*names, (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(F.collect_set("t_pos").alias("at"))
    diagonals = diagonals.withColumn("first_t", F.array_min("at")).withColumn("last_t", F.array_max("at"))
    # words of a long template that chance to recur
    diagonals = diagonals.where((F.size("at") > 1) | (F.col("k") == 2))
    in_place = F.array_distinct(F.flatten(F.transform("at", lambda t: F.sequence(t, t + F.col("k") - 1))))
    exact = F.col("template").isin([t.name for t in p.templates if t.whole])
    start, stop = F.col("diagonal") + F.col("first_t"), F.col("diagonal") + F.col("last_t") + F.col("k")
    by = Window.partitionBy("doc_id", "text_hash", "template").orderBy("start", "diagonal")
    apart = F.abs(F.col("diagonal") - F.lag("diagonal").over(by)) > p.drift
    gap = F.col("start") - F.lag("stop").over(by) > F.col("length")
    back = F.col("first_t") <= F.lag("last_t").over(by)
    spans = (
        diagonals.select(*names, "diagonal", "first_t", "last_t", start.alias("start"), stop.alias("stop"), in_place.alias("in_place"))
        .withColumn("new", F.coalesce((exact | apart | gap | back).cast("int"), F.lit(1)))
        .withColumn("span", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*names, "span")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("in_place")))).alias("in_place"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("diagonal").alias("diagonal"))
        .withColumn("share", F.col("in_place") / F.greatest("length", F.col("stop") - F.col("start")))
    )
    least = F.create_map(*[F.lit(x) for t in p.templates for x in (t.name, 1.0 if t.whole else t.share)])
    label = F.create_map(*[F.lit(x) for t in p.templates for x in (t.name, t.label)])
    found = spans.where(F.col("share") >= F.element_at(least, F.col("template")))
    by_doc = found.withColumn("label", F.element_at(label, F.col("template"))).groupBy("doc_id", "text_hash").agg(
        F.count(F.when(exact, 1)).alias("n_base"),
        F.min(F.when(exact, F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(exact, F.col("diagonal"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(exact, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"))
    words = d.select("doc_id", "text_hash", words_of(F.col("text"))[1].alias("n_words"))
    out = words.alias("w").join(by_doc.alias("f"), F.col("w.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("w.text_hash") == F.col("f.text_hash")), "left")
    return out.select("w.doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
