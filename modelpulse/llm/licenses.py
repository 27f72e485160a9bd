"""Licence notices in documents: Dice coefficient of word bigrams against templates.

A line and a template are brought to the same form (lower case, letters and digits only, one space
between words). Their likeness is twice the common bigrams, counted as often as they stand, over the sum of both. It can
reach the threshold only if the line has neither too few nor too many bigrams for the template;
lines out of the bounds of all templates are dropped before any bigram is made, and what meets a
template's bigrams is held to that template's own bounds. Main path: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST = 0.8
#: Notices by licence: short forms as they stand in files and on pages.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation"
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and"
        " to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance"
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any"
        " later version.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met:",
        "Licensed under the BSD 3-Clause License.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
        " distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
}
NOT_WORDS, A_WORD = r"[^\p{L}\p{N}]+", r"[\p{L}\p{N}]+"


def normal_words(line: Column) -> Column:
    """Words of a line in small letters."""
    return F.filter(F.split(line, NOT_WORDS), lambda w: w != "")


def bigrams(words: Column) -> Column:
    """Pairs of neighbours as often as they stand; a single word stands for itself."""
    return F.when(
        F.size(words) > 1,
        F.zip_with(
            F.slice(words, F.lit(1), F.size(words) - 1),
            F.slice(words, F.lit(2), F.size(words) - 1),
            lambda a, b: F.concat(a, F.lit(" "), b),
        ),
    ).otherwise(words)


def template_table(spark: SparkSession, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """(license, template, size, gram, often) of every bigram of every template."""
    rows = [(name, no, text) for name, texts in sorted(templates.items()) for no, text in enumerate(texts)]
    table = spark.createDataFrame(rows, "license string, template int, wording string")
    grams = table.select("license", "template", bigrams(normal_words(F.lower("wording"))).alias("grams"))
    each = grams.select("license", "template", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    return each.groupBy("license", "template", "size", "gram").agg(F.count(F.lit(1)).alias("often"))


def scan(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    templates: dict[str, list[str]] = TEMPLATES,
    least: float = LEAST,
) -> DataFrame:
    """One row per id: license (the likest, first by name if as like), dice, n_notices, licenses.

    n_notices counts lines like some template. Ids without one have null, null, 0 and an empty
    array. A null text has no lines. Rows of one id are taken together; null ids go.
    """
    sizes = [max(len(_words(t)) - 1, 1) for texts in templates.values() for t in texts]
    low, high = least / (2 - least), (2 - least) / least
    given = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).where("id is not null")
    lines = given.select("id", F.posexplode(F.split(F.lower("t"), "\n", -1)).alias("place", "line"))
    lines = lines.withColumn("n", F.greatest(F.regexp_count("line", F.lit(A_WORD)) - 1, F.lit(1)))
    # Bounds over all templates, before any word is taken apart.
    sized = lines.where((F.col("n") >= low * min(sizes)) & (F.col("n") <= high * max(sizes)) & F.col("line").rlike(A_WORD))
    grams = sized.select(
        "id", "place", F.xxhash64("line").alias("line"), "n", F.explode(bigrams(normal_words(F.col("line")))).alias("gram")
    )
    # The templates are a fixed list, so their bigrams are a table of known size.
    table = template_table(docs.sparkSession, templates)
    met = grams.join(F.broadcast(table), "gram")
    bounded = met.where((F.col("n") >= low * F.col("size")) & (F.col("n") <= high * F.col("size")))
    same = ["id", "place", "line", "license", "template", "n", "size"]
    common = bounded.groupBy(*same, "gram", "often").agg(F.count(F.lit(1)).alias("here"))
    likeness = common.groupBy(*same).agg(F.sum(F.least("here", "often")).alias("common"))
    found = likeness.withColumn("dice", 2.0 * F.col("common") / (F.col("n") + F.col("size"))).where(F.col("dice") >= least)
    by_doc = found.groupBy("id").agg(
        F.min(F.struct((-F.col("dice")).alias("d"), "license")).getField("license").alias("license"),
        F.max("dice").alias("dice"),
        F.count_distinct("place", "line").alias("n_notices"),
        F.array_sort(F.collect_set("license")).alias("licenses"),
    )
    return given.select("id").distinct().join(by_doc, "id", "left").select(
        F.col("id").alias(doc_id),
        "license",
        F.round("dice", 6).alias("dice"),
        F.coalesce("n_notices", F.lit(0)).cast("bigint").alias("n_notices"),
        F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"),
    )


def _words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()
