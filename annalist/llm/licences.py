"""Licence scans (DataFrame functions only).

Every line of a text that holds a word is a possible header: its sparse TF-IDF vector is compared by cosine with those of
the licence templates, and lines of at least `threshold` carry the licence of the best template. The template table is a
fixed list of some dozen rows, so its term weights are broadcast; words outside it only lengthen a line's vector, as
distinct terms of the largest weight. A line "SPDX-License-Identifier" carries the licence that it names. A document is
a licence file if licence lines hold at least half of its characters, or if it is a licence as a whole: the vector of all
its words, however they are cut into lines, is compared in the same way with those of the texts in `licence_texts`.

Licences are then inherited: a document without one takes that of the nearest ancestor directory that holds a licence
file, by an equality join of the ancestors of its directory with the directories of licence files.

Defined results: a null or empty text holds no licence; several licences in one text are all listed, sorted, and the
best one (largest cosine, then name; that of the whole text before those of lines) stands for the text; of several licence files in a directory the one of the
smallest path counts; rows with a null path hold none and inherit none; repeated rows of one path and text count as one
text; other texts under that path are judged each, and the path holds the licences of all and is a licence file if one of
them is; an empty table gives an empty result; other columns are not read, but for those that `keep` names.
"""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, text_column

#: Header and grant sentences by SPDX name.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal, public domain dedication."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: A line of common words alone would otherwise need a comparison with every template.
STOP = ("the", "of", "and", "to", "in", "is", "a", "this", "any", "or", "with", "for", "are", "that", "as", "by", "it", "on", "be")
THRESHOLD = 0.6
#: Least cosine of a whole text with the text of a licence.
FILE_THRESHOLD = 0.8
#: Names in SPDX headers, in lower case.
SPDX = {
    f"{name}{end}".lower(): name
    for name in {*(licence for licence, _ in TEMPLATES), "LGPL-2.1", "BSD-2-Clause"}
    for end in (("", "-only", "-or-later", "+") if "GPL" in name else ("",))
}
_SPDX_MARK = "spdx-license-identifier"
_WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"


def _terms(text: str) -> list[str]:
    import re

    return [w for w in re.findall(_WORD, text.lower()) if w not in STOP]


def _vectors(templates: list[tuple[str, str]]) -> tuple[dict[str, float], list[dict[str, float]]]:
    """The weight of each term, and the vector of each template, of unit length."""
    n = len(templates)
    terms = [_terms(t) for _, t in templates]
    df: dict[str, int] = {}
    for ts in terms:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in df.items()}
    vectors = []
    for ts in terms:
        own = {t: ts.count(t) * idf[t] for t in set(ts)}
        length = math.sqrt(sum(v * v for v in own.values()))
        vectors.append({t: v / length for t, v in own.items()})
    return idf, vectors


def template_terms(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> tuple[DataFrame, float]:
    """term, idf, and the (template, licence, weight) of the templates that have it, of unit length; and the weight of
    a term outside the templates."""
    idf, vectors = _vectors(templates)
    weights: dict[str, list[tuple[int, str, float]]] = {t: [] for t in idf}
    for i, ((licence, _), own) in enumerate(zip(templates, vectors)):
        for t, v in own.items():
            weights[t].append((i, licence, v))
    table = spark.createDataFrame([(t, idf[t], weights[t]) for t in sorted(idf)], "term string, idf double, at array<struct<template:int,licence:string,weight:double>>")
    return table, math.log(1 + len(templates)) + 1


def full_texts() -> list[tuple[str, str]]:
    """The texts of whole licences by SPDX name."""
    return [(p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]


def _any_of(terms: set[str]) -> str:
    listed = "|".join(sorted(terms, key=lambda t: (-len(t), t))).replace(".", r"\.")
    return rf"(?<![a-z0-9])(?:{listed})(?![a-z0-9])"


def _needed(templates: list[tuple[str, str]], threshold: float) -> set[str]:
    """Terms of which a text has one if its cosine with a template reaches `threshold`: of each template the heaviest,
    whose squares add up to more than 1 - threshold ** 2, so that the others alone can't reach it."""
    needed: set[str] = set()
    for own in _vectors(templates)[1]:
        left = 1.0
        for t in sorted(own, key=lambda t: (-own[t], t)):
            if left < threshold**2 - 1e-6:
                break
            needed.add(t)
            left -= own[t] ** 2
    return needed


def _cosines(rows: DataFrame, row: list[str], table: DataFrame, unknown: float, threshold: float) -> DataFrame:
    """The columns `row`, licence and cosine of each of `rows` (row, terms) and template that reach `threshold`."""
    found = rows.select(*row, F.size("terms").alias("n_terms"), F.explode("terms").alias("term")).join(F.broadcast(table), "term")
    counts = found.groupBy(*row, "n_terms", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("idf").alias("idf"), F.first("at").alias("at"))
    parts = F.transform("at", lambda a: F.struct(a["template"].alias("template"), a["licence"].alias("licence"), (a["weight"] * F.col("tf") * F.col("idf")).alias("part")))
    # At most one entry for each term and template that has it.
    per_row = counts.groupBy(*row, "n_terms").agg(
        F.sum(F.pow(F.col("tf") * F.col("idf"), 2)).alias("known"), F.sum("tf").alias("n_known"), F.flatten(F.collect_list(parts)).alias("parts")
    )
    length = F.sqrt(F.col("known") + (F.col("n_terms") - F.col("n_known")) * (unknown * unknown))
    scores = per_row.select(*row, length.alias("length"), F.inline("parts")).groupBy(*row, "length", "template", "licence").agg(F.sum("part").alias("dot"))
    return scores.withColumn("cosine", F.round(F.col("dot") / F.col("length"), 9)).where(F.col("cosine") >= threshold).select(*row, "licence", "cosine")


def _term_column(text: str):
    return F.filter(F.regexp_extract_all(text, F.lit(f"({_WORD})"), F.lit(1)), lambda w: ~w.isin(*STOP))


def licence_texts(docs: DataFrame, threshold: float = FILE_THRESHOLD, text: str = "text", key: str = "path") -> DataFrame:
    """key, h (a hash of the text), licence and cosine of each text that is a licence as a whole."""
    texts = full_texts()
    table, unknown = template_terms(docs.sparkSession, texts)
    lower = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.lower(text_column(text)).alias("x"))
    near = lower.where(F.col("x").rlike(_any_of(_needed(texts, threshold))))
    words = near.select("key", F.xxhash64("x").alias("h"), _term_column("x").alias("terms")).dropDuplicates(["key", "h"])
    best = F.min(F.struct((-F.col("cosine")).alias("rank"), "licence"))
    scored = _cosines(words, ["key", "h"], table, unknown, threshold)
    return scored.groupBy("key", "h").agg(best.alias("best")).select("key", "h", F.col("best.licence").alias("licence"), (-F.col("best.rank")).alias("cosine"))


def licence_lines(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", key: str = "path") -> DataFrame:
    """key, h (a hash of the text), line (place), n_chars, total (characters of the text), licence and cosine of each line
    with a licence."""
    table, unknown = template_terms(docs.sparkSession)
    lower = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.lower(text_column(text)).alias("t"))
    # What is known of a text is computed before it is cut, else each line would compute it anew.
    texts = lower.select("key", "t", F.xxhash64("t").alias("h"), F.length("t").alias("total"))
    lines = texts.select("key", "h", "total", F.posexplode(F.split("t", "\n")).alias("line", "x"))
    # A line without any template term has cosine 0. The lines left are few, and read twice.
    near, named = F.col("x").rlike(_any_of({t for _, notice in TEMPLATES for t in _terms(notice)})), F.contains("x", F.lit(_SPDX_MARK))
    left = checkpointed(lines.select("*", near.alias("near"), named.alias("named")).where("near OR named"))
    line = ["key", "h", "line", "n_chars", "total"]
    n_chars = F.length("x").alias("n_chars")
    words = left.where("near").select("key", "h", "line", n_chars, "total", _term_column("x").alias("terms")).distinct()
    names = F.create_map(*(F.lit(x) for pair in sorted(SPDX.items()) for x in pair))
    spdx = names[F.regexp_extract("x", _SPDX_MARK + r":\s*([a-z0-9.+-]+)", 1)]
    by_name = left.where("named").select("key", "h", "line", n_chars, "total", spdx.alias("licence"), F.lit(1.0).alias("cosine"))
    scored = _cosines(words, line, table, unknown, threshold).unionByName(by_name.where(F.col("licence").isNotNull()))
    best = F.min(F.struct((-F.col("cosine")).alias("rank"), "licence"))
    return scored.groupBy(*line).agg(best.alias("best")).select(*line, F.col("best.licence").alias("licence"), (-F.col("best.rank")).alias("cosine"))


def scan(docs: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
    """path, licences (sorted), licence (the best), cosine, is_file of each text that holds a licence."""
    by_line = licence_lines(docs, text=text, key=path).withColumn("whole", F.lit(False))
    by_text = licence_texts(docs, text=text, key=path).withColumn("whole", F.lit(True))
    found = by_line.unionByName(by_text, allowMissingColumns=True)
    by_version = found.groupBy("key", "h").agg(
        F.collect_set("licence").alias("licences"),
        F.min(F.struct((~F.col("whole")).alias("line"), (-F.col("cosine")).alias("rank"), "licence")).alias("best"),
        (F.max("whole") | F.coalesce(2 * F.sum("n_chars") >= F.max("total"), F.lit(False))).alias("is_file"),
    )
    return by_version.groupBy("key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("licences")))).alias("licences"), F.min("best").alias("best"), F.max("is_file").alias("is_file")
    ).select(F.col("key").alias(path), "licences", F.col("best.licence").alias("licence"), (-F.col("best.rank")).alias("cosine"), "is_file")


def inherit(paths: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """path, inherited, from_directory: the licence of the nearest ancestor directory among `files` (path, licence)."""
    directory = lambda c: F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    here = files.groupBy(directory(F.col(path)).alias("directory")).agg(F.min(F.struct(path, "licence"))["licence"].alias("inherited"))
    # Directories are far fewer than paths: each is resolved once.
    own = paths.select(F.col(path), directory(F.col(path)).alias("own"))
    parts = F.split("own", "/")
    ancestors = own.select("own").distinct().select("own", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("directory")))).alias("a"))
    nearest = ancestors.select("own", "a.depth", "a.directory").join(here, "directory").groupBy("own").agg(F.max(F.struct("depth", "directory", "inherited")).alias("best"))
    return own.join(nearest, "own", "left").select(path, F.col("best.inherited").alias("inherited"), F.col("best.directory").alias("from_directory"))


def scan_and_inherit(docs: DataFrame, text: str = "text", path: str = "path", keep: tuple[str, ...] = ()) -> DataFrame:
    """path, licences, licence, cosine, is_file, effective (own licence, else the inherited one), from_directory of each row,
    and its columns `keep`."""
    own = scan(docs, text, path)
    above = inherit(docs.select(path), own.where("is_file").select(path, "licence"), path).dropDuplicates([path])
    row = F.struct(*(F.col(c) for c in keep)) if keep else F.lit(None)
    return (
        docs.select(path, row.alias("row"))
        .join(own, path, "left")
        .join(above, path, "left")
        .select(
            path,
            *(F.col("row")[c].alias(c) for c in keep),
            F.coalesce("licences", F.array().cast("array<string>")).alias("licences"),
            "licence",
            "cosine",
            F.coalesce("is_file", F.lit(False)).alias("is_file"),
            F.coalesce("licence", "inherited").alias("effective"),
            F.when(F.col("licence").isNull(), F.col("from_directory")).alias("from_directory"),
        )
    )


def op7(docs: DataFrame) -> DataFrame:
    """Documents lie at source/lang/doc_id; one without an id lies nowhere."""
    path = F.when(F.col("doc_id").isNotNull(), F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string")))
    found = scan_and_inherit(docs.select("doc_id", "text", path.alias("path")), keep=("doc_id",))
    return found.select("doc_id", F.size("licences").cast("long").alias("n_licences"), F.array_join("licences", ",").alias("licences"), "licence", "effective", "is_file")
