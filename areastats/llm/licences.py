"""Licence scan: statements matched to templates, and inherited down the directory tree.

A file's text is cut into blocks at tags and lines without a word. The statements of a block are the block itself (a
notice wrapped over lines, the opening paragraph of a licence text), its lines (titles, tags of one line), and its
sentences, line ends or not (a notice inside a longer text). A statement is a sparse TF-IDF vector
over its words; the template it resembles most by cosine gives its licence, if it also has all words that name the
template's licence: without them `EPL-2.0` would pass for `MPL-2.0`, and version 2 of a licence for its version 3. Document
frequencies are counted over all files; words that no template has weigh like words in no
file, so they only lengthen a statement's vector.

As a statement needs all naming words of a template, statements without the rarest of any template's
are left out first, with nothing lost. The rest are compared once per distinct text.

A file with a statement speaks for its directory: the licence stated by most of a directory's
files is the directory's (ties: the first name). A file without a statement takes the licence of the
nearest directory above it that has one: the ancestors of each distinct directory are joined
with the directories that have a licence, and the longest wins.

Defined results: a NULL text has no statement; a NULL url, or one without `://`, lies in the directory ''
with no ancestors; repeated rows are judged alike. Of statements and templates equally alike the first licence
in `TEMPLATES` counts for a statement, the last name for a file. A file without licence has NULLs. An empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areastats.llm.common import Scratch
from areastats.llm.urls import host_and_path

# The wording of licence notices, titles and opening paragraphs, each with the words that name its licence.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2 0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004", "apache 2 0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted.", "redistribution permitted"),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "redistribution permitted",
    ),
    ("BSD-3-Clause", "BSD 3-Clause License", "bsd 3"),
    ("CC-BY-4.0", "Licensed under a Creative Commons Attribution 4.0 International License.", "creative commons attribution 4 0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", "cc by 4 0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "cc by nc 4 0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "cc by sa 4 0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu general public 3"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "gnu general public 3"),
    ("GPL-3.0", "GNU General Public License Version 3", "gnu general public 3"),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "gnu general public 3",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
        "permission fee hereby granted",
    ),
    ("MIT", "Released under the MIT License.", "mit license"),
    ("MIT", "MIT License", "mit license"),
    ("MIT", "The MIT License (MIT)", "mit license"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:",
        "permission hereby granted sublicense",
    ),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0.", "mozilla public 2 0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0", "mozilla public 2 0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla public 2 0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered public domain"),
    ("all-rights-reserved", "All rights reserved.", "rights reserved"),
]
TEMPLATES += [
    (name, f"SPDX-License-Identifier: {name}", "spdx " + name.lower().replace("-", " ").replace(".", " "))
    for name in ["Apache-2.0", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "GPL-3.0", "ISC", "MIT", "MPL-2.0", "Unlicense"]
]
THRESHOLD = 0.8
#: A tag, or a line without a word.
BLOCK = r"<[^>]*>|\n[^A-Za-z0-9<\n]*\n"
BLANK = r"[\x20\x09-\x0D]+"
#: Ends of sentences. The phrase that closes a copyright line begins one.
SENTENCE_END = r"([.!?;])\x20"
CLOSING = r"(?i)(all rights reserved)"
WORD = "[a-z0-9]+"

Template = tuple[str, str, str]


def words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def weights(templates: Sequence[Template], files: int, frequency: Mapping[str, int]) -> tuple[dict, list, float]:
    """IDF of each template word, unit vectors of the templates, and the weight of any other word."""
    idf = lambda n: math.log((files + 1) / (n + 1)) + 1
    vectors = []
    for _, text, _ in templates:
        v = {w: n * idf(frequency.get(w, 0)) for w, n in Counter(words(text)).items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({w: x / length for w, x in v.items()})
    return {w: idf(frequency.get(w, 0)) for v in vectors for w in v}, vectors, idf(0)


def anchors(templates: Sequence[Template], idf: Mapping[str, float]) -> set[str]:
    """Words of which a matching statement must have one: of each template the rarest that names its licence."""
    return {max(words(naming), key=lambda w: (idf[w], w)) for _, _, naming in templates}


def statements(text: Column) -> Column:
    """Blocks of a text, their lines and their sentences, as an array; the same one may occur twice."""
    level = F.regexp_replace(text, BLANK, " ")
    sentences = F.split(F.regexp_replace(F.regexp_replace(level, SENTENCE_END, "$1\n"), CLOSING, "\n$1"), "\n", -1)
    return F.array_distinct(F.concat(F.array(text), F.split(text, "\n", -1), sentences))


def match_statements(found: DataFrame, templates: Sequence[Template], idf, vectors, other: float, threshold: float) -> DataFrame:
    """Best template of each distinct statement text that reaches the threshold: statement, licence, similarity."""
    spark = found.sparkSession
    naming = [set(words(t[2])) for t in templates]
    rows = [(w, i, x, int(w in naming[i])) for i, v in enumerate(vectors) for w, x in sorted(v.items())]
    # These tables are as long as the templates' vocabulary, and as their list.
    parts = F.broadcast(spark.createDataFrame(rows, "word string, i int, x double, names int"))
    known = F.broadcast(spark.createDataFrame(sorted(idf.items()), "word string, idf double"))
    listed = F.broadcast(spark.createDataFrame([(i, t[0], len(naming[i])) for i, t in enumerate(templates)], "i int, licence string, needed int"))
    each = F.explode(F.regexp_extract_all(F.lower("statement"), F.lit(WORD), F.lit(0))).alias("word")
    counted = found.select("statement").distinct().select("statement", each).groupBy("statement", "word").agg(F.count("*").alias("tf"))
    weighed = counted.join(known, "word", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(other)))
    # A statement's words become one row again, so its length and its templates come from the same shuffle.
    whole = weighed.groupBy("statement").agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"),
        # Words no template has add to the length alone.
        F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("word", "w"))).alias("words"),
    )
    dots = whole.select("statement", "length", F.explode("words").alias("e")).select("statement", "length", "e.word", "e.w").join(parts, "word")
    dots = dots.groupBy("statement", "i").agg(
        F.round(F.sum(F.col("w") * F.col("x")) / F.first("length"), 6).alias("similarity"), F.sum("names").alias("named")
    )
    fits = dots.join(listed, "i").where((F.col("named") == F.col("needed")) & (F.col("similarity") >= threshold))
    best = fits.groupBy("statement").agg(F.max(F.struct("similarity", (-F.col("i")).alias("i"), "licence")).alias("best"))
    return best.select("statement", "best.licence", "best.similarity")


def directory(host: Column, path: Column) -> Column:
    """Host and path up to the last slash; '' without a host."""
    return F.when(host == "", "").otherwise(F.concat(host, F.coalesce(F.nullif(F.regexp_extract(path, "(?s)^(.*/)", 1), F.lit("")), F.lit("/"))))


def ancestors(folder: Column) -> Column:
    """A directory and all above it: h/a/b/ gives h/a/b/, h/a/, h/."""
    parts = F.split(F.regexp_replace(folder, "/$", ""), "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))


def scan_licences(
    files: DataFrame, key: str = "page_id", url: str = "url", text: str = "html", templates: Sequence[Template] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per file: key, directory, licence, similarity (of its own statement), origin (own, inherited), from_directory."""
    spark = files.sparkSession
    scratch = Scratch(spark)
    parts = files.withColumn("_url", F.coalesce(F.col(url), F.lit("")))
    host, path = host_and_path(F.col("_url"))
    base = parts.select(F.col(key).alias("_key"), directory(host, path).alias("directory"), F.coalesce(F.col(text), F.lit("")).alias("_text"))

    # 1. Document frequencies of the templates' words over all files.
    vocabulary = sorted({w for t in templates for w in words(t[1])})
    used = F.array_intersect(F.split(F.lower("_text"), "[^a-z0-9]+", -1), F.array(*map(F.lit, vocabulary)))
    counted = base.select(F.explode(F.concat(used, F.array(F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    frequency = {r.word: r.n for r in counted.collect()}  # a row per word of the templates
    idf, vectors, other = weights(templates, frequency.pop("", 0), frequency)

    # 2. Statements that have an anchor word, and their best template.
    anchor = rf"(?<![a-z0-9])(?:{'|'.join(sorted(anchors(templates, idf)))})(?![a-z0-9])"
    has_anchor = lambda c: F.lower(c).rlike(anchor)
    pieces = base.where(has_anchor("_text")).select("_key", "directory", F.explode(F.split("_text", BLOCK, -1)).alias("block"))
    pieces = pieces.where(has_anchor("block")).select("_key", "directory", F.explode(statements(F.col("block"))).alias("statement"))
    pieces = scratch.store(pieces.where(has_anchor("statement")), "statements")
    matched = match_statements(pieces, templates, idf, vectors, other, threshold)
    stated = pieces.join(matched, "statement").groupBy("_key", "directory")
    own = stated.agg(F.max(F.struct("similarity", "licence")).alias("own"))
    own = scratch.store(own.select("_key", "directory", "own.licence", "own.similarity"), "own-licences")

    # 3. Directories with a licence, and the nearest one above every directory.
    votes = own.where("directory <> ''").groupBy("directory", "licence").agg(F.count("*").alias("n"))
    speaks = votes.groupBy("directory").agg(F.min(F.struct((-F.col("n")).alias("n"), "licence")).alias("v"))
    speaks = speaks.select(F.col("directory").alias("above"), F.col("v.licence").alias("licence"))
    folders = base.select("directory").where("directory <> ''").distinct()
    near = folders.select("directory", F.explode(ancestors(F.col("directory"))).alias("above")).join(speaks, "above")
    near = near.groupBy("directory").agg(F.max(F.struct(F.length("above").alias("n"), "above", "licence")).alias("near"))
    near = scratch.store(near.select("directory", F.col("near.above").alias("from_directory"), F.col("near.licence").alias("inherited")), "directories")
    out = base.drop("_text").join(own, ["_key", "directory"], "left").join(near, "directory", "left")
    return out.select(
        F.col("_key").alias(key),
        "directory",
        F.coalesce("licence", "inherited").alias("licence"),
        "similarity",
        F.when(F.col("licence").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited").alias("origin"),
        F.when(F.col("licence").isNull(), F.col("from_directory")).alias("from_directory"),
    )


def query(spark, sf_dir):
    return scan_licences(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def _oracle() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rows = ", ".join(
        f"({i}, '{name}', '{w}', {c}, {int(w in words(naming))})"
        for i, (name, text, naming) in enumerate(TEMPLATES)
        for w, c in sorted(Counter(words(text)).items())
    )
    return rf"""
WITH u AS (
  SELECT page_id, coalesce(html, '') AS html, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), p AS (
  SELECT page_id, html, CASE WHEN host = '' THEN '' ELSE host || coalesce(nullif(regexp_extract(path, '(?s)^(.*/)', 1), ''), '/') END AS directory FROM q
), tw(i, name, word, tf, names) AS (VALUES {rows}),
files AS (SELECT count(*)::DOUBLE AS n FROM p),
df AS (SELECT word, count(*) AS n FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(lower(html), '{WORD}')) AS word FROM p) GROUP BY word),
idf AS (SELECT DISTINCT word, ln((files.n + 1) / (coalesce(df.n, 0) + 1)) + 1 AS idf FROM tw LEFT JOIN df USING (word), files),
tv AS (SELECT i, name, word, names, sum(names) OVER (PARTITION BY i) AS needed, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY i)) AS x FROM tw JOIN idf USING (word)),
bl AS (SELECT page_id, directory, unnest(regexp_split_to_array(html, '{BLOCK}')) AS block FROM p),
st AS (SELECT page_id, directory, unnest(list_distinct(list_concat([block], regexp_split_to_array(block, '\n'), regexp_split_to_array(
  regexp_replace(regexp_replace(regexp_replace(block, '{BLANK}', ' ', 'g'), '{SENTENCE_END}', '\1' || chr(10), 'g'), '{CLOSING}', chr(10) || '\1', 'g'), '\n')))) AS statement
  FROM bl),
sw AS (
  SELECT statement, word, count(*) AS tf FROM (SELECT statement, unnest(regexp_extract_all(lower(statement), '{WORD}')) AS word FROM (SELECT DISTINCT statement FROM st)) GROUP BY ALL
), sx AS (SELECT statement, word, tf * coalesce(idf, ln(files.n + 1) + 1) AS w FROM sw LEFT JOIN idf USING (word), files),
sn AS (SELECT statement, sqrt(sum(w * w)) AS len FROM sx GROUP BY statement),
sc AS (SELECT statement, i, name, sum(w * x) AS dot FROM sx JOIN tv USING (word) GROUP BY statement, i, name, needed HAVING sum(names) = needed),
best AS (
  SELECT statement, name AS licence, round(dot / len, 6) AS similarity FROM sc JOIN sn USING (statement)
  WHERE round(dot / len, 6) >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY statement ORDER BY round(dot / len, 6) DESC, i) = 1
), own AS (
  SELECT page_id, directory, licence, similarity FROM st JOIN best USING (statement)
  QUALIFY row_number() OVER (PARTITION BY page_id, directory ORDER BY similarity DESC, licence DESC) = 1
), speaks AS (
  SELECT directory AS above, licence FROM (SELECT directory, licence, count(*) AS n FROM own WHERE directory <> '' GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY directory ORDER BY n DESC, licence) = 1
), near AS (
  SELECT directory, above AS from_directory, licence AS inherited FROM (SELECT DISTINCT directory FROM p) d JOIN speaks ON starts_with(directory, above)
  QUALIFY row_number() OVER (PARTITION BY directory ORDER BY length(above) DESC) = 1
)
SELECT p.page_id, p.directory, coalesce(licence, inherited) AS licence, similarity,
  CASE WHEN licence IS NOT NULL THEN 'own' WHEN inherited IS NOT NULL THEN 'inherited' END AS origin,
  CASE WHEN licence IS NULL THEN from_directory END AS from_directory
FROM p LEFT JOIN own USING (page_id, directory) LEFT JOIN near USING (directory)
"""


ORACLE = _oracle()
