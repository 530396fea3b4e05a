"""Licence scan: TF-IDF cosine of licence statements to templates, and inheritance along directories,
in DataFrame operations only.

A file's statements are its lines, its blocks of neighbouring lines (a paragraph, or a run of comment
lines; a statement may be wrapped) and the sentences of blocks of several lines, as far as they hold a
word for licences or two of the words that the templates are made of; of a licence file (by its name)
the whole text is one more.  Comment marks are no words.  Statements and templates become sparse vectors of
words, weighted by 1 + ln(tf) and by the rarity of the word among all statements of the corpus; joining
them on the word multiplies the two matrices.  Equal statements are one vector.  Only words that a template
has can add to a product, so all others go into the length of the statement alone; the templates' words,
which every statement has, take their rarity from a broadcast table of their number.  A version ("version
2", "v. 2.0") is one word, and decides: a statement with versions is compared with the templates that
have one of them, or none.  A statement has the licence of its nearest template if the cosine reaches
`LEAST`.  The sentence that the BSD licences have in common is resolved by the clauses of the file.

A file without a licence of its own takes that of the nearest directory above it (its own directory
first) that a licence file speaks for; the best statement holds, ties go to the licence that sorts
first.  Directories are resolved once each, and then joined to their files.

Null and empty texts and paths have no statement and nothing to inherit from.  Rows with null or
repeated `file` are files of their own: licences go by (file, path, text), nulls included."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, text_of

LEAST = 0.6
_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([^/]*)$"

#: Licences and the statements that name them.
_GNU = (
    ("GPL-2.0", "program", "GNU General Public License", "2"),
    ("GPL-3.0", "program", "GNU General Public License", "3"),
    ("LGPL-2.1", "library", "GNU Lesser General Public License", "2.1"),
    ("LGPL-3.0", "library", "GNU Lesser General Public License", "3"),
    ("AGPL-3.0", "program", "GNU Affero General Public License", "3"),
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
)
_BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_NO_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.'
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    *((licence, f"This work is licensed under the {name}, version {version}.") for licence, _, name, version in _GNU),
    *(
        (licence, f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or any later version.")
        for licence, thing, name, version in _GNU
    ),
    *((licence, f"{name} Version {version}") for licence, _, name, version in _GNU),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", " ".join((*_BSD, _BSD_NAME, _NO_WARRANTY))),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", " ".join((*_BSD, _NO_WARRANTY))),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Released under the ISC License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright to this work. It is in the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Identifiers of an SPDX line by licence; an ending "-only", "-or-later" or "+" is not told apart.
_SPDX = sorted({licence for licence, _ in TEMPLATES})
#: What tells the BSD licences apart in a file with the sentence they share.
_THIRD_CLAUSE, _SECOND_CLAUSE = r"(?i)neither\s+the\s+name|3[- ]clause", r"(?i)redistributions\s+in\s+binary\s+form\s+must\s+reproduce|2[- ]clause"

#: Words of the templates that any text may have.
_COMMON = frozenset(
    "a above accompanying all an and any appear are as at available be by can contributors copies derived disclaimed distribute "
    "distribution either except express fee file following for form forms free from hereby holder holders http implied in is it "
    "its january later library licenses list made materials may met must name names neither nor not notice of or org other person "
    "prior products program promote provided purpose released reproduction search source specific subject terms that the this to "
    "under use used version warranties with without work written www you your".split()
)
_TELLING = sorted({w for _, t in TEMPLATES for w in re.findall(r"[^\W\d_]{2,}", t.lower())} - _COMMON)
_ONE = rf"\b(?:{'|'.join(_TELLING)})\b"
_SURE = r"\blicen[cs]e|\bcopyright\b|\bCC[ -]BY|\bpublic domain\b|\bpermission is hereby granted\b"
#: A quick test for what can be a statement at all.
_CUE = rf"(?i){_SURE}|{_ONE}"
_MARK = r"[ \t]*(?://|/\*|\*|#|;|%|--|<!--|\.\.[ \t]|\"{3}|'{3})"


_VERSION = r"\b(?:version|v)[^\p{L}\p{N}]{0,12}(\d+)(?:\.0)*((?:\.\d+)?)(?!\w)"


def _words(text: Column) -> Column:
    """Lower-cased words; "version 2", "v. 2.0" and "V2" are the word `v2`, "version 2.1" is `v2_1`."""
    low = F.lower(text)
    one = F.regexp_replace(low, _VERSION, "\u0001$1$2 ")
    named = F.regexp_replace(F.regexp_replace(one, "\u0001(\\d+)\\.(\\d+)", " v$1_$2 "), "\u0001(\\d+)", " v$1 ")
    told = F.when(low.rlike(r"v[^\p{L}]{0,13}\d|version"), named).otherwise(low)
    return F.regexp_extract_all(told, F.lit(r"[\p{L}\p{N}]+(?:(?<=\bv\d{1,9})_\d+)?"), F.lit(0))


def _versions(words: Column) -> Column:
    return F.filter(words, lambda w: w.rlike(r"^v\d"))


def is_licence_file(path: str = "path") -> Column:
    return F.coalesce(F.col(path).rlike(_FILE), F.lit(False))


def _cued(text: Column) -> Column:
    """Whether a text has a word for licences, or two different words of the templates."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_ONE), F.lit(0)))
    return text.rlike(_CUE) & (text.rlike(f"(?i){_SURE}") | (F.size(words) > 1))


def _blocks(text: Column) -> Column:
    """Paragraphs and runs of comment lines; a comment line without a word ends a block."""
    lines = F.regexp_replace(text, r"\r\n?", "\n")
    bare = F.regexp_replace(lines, r"(?m)^[^\p{L}\p{N}\n]+$", "")
    out = F.regexp_replace(bare, rf"(?m)^({_MARK}[^\n]*)\n(?!{_MARK})", "$1\n\n")
    into = F.regexp_replace(out, rf"(?m)^((?!{_MARK})[^\n]+)\n(?={_MARK})", "$1\n\n")
    return F.split(into, r"\n{2,}", -1)


def _key() -> Column:
    """What files of one key have in common is everything: file, path and text."""
    return F.md5(F.concat(F.to_json(F.struct("file", "path")), F.lit("\n"), text_of()))


def statements(files: DataFrame) -> DataFrame:
    """(key, words, clause) of each statement; `files` has (file, path, text)."""
    whole = text_of()
    cued = files.filter(is_licence_file() | whole.rlike(_CUE))
    # Only a file with the shared sentence, or one of the names, is asked for its clauses.
    shared = whole.contains("edistribution") | whole.contains("EDISTRIBUTION") | whole.contains("BSD")
    clause = F.when(shared & whole.rlike(_THIRD_CLAUSE), "BSD-3-Clause").when(shared & whole.rlike(_SECOND_CLAUSE), "BSD-2-Clause")
    cued = cued.select(
        _key().alias("key"), whole.alias("text"), is_licence_file().alias("named"), F.filter(_blocks(whole), _cued).alias("blocks"),
        clause.alias("clause"),
    )
    wrapped = F.filter("blocks", lambda b: b.contains("\n"))
    sentences = F.flatten(F.transform(wrapped, lambda b: F.split(b, r"(?<=[.;])\s+", -1)))
    lines = F.flatten(F.transform("blocks", lambda b: F.split(b, r"\n", -1)))
    pieces = F.filter(F.array_distinct(F.concat(lines, sentences)), _cued)
    every = F.concat(pieces, "blocks", F.when(F.col("named"), F.array("text")).otherwise(F.array().cast("array<string>")))
    made = cued.select("key", "clause", F.explode(F.array_distinct(F.transform(every, _words))).alias("words"))
    return made.filter(F.size("words") > 0)


def template_vectors(spark: SparkSession) -> DataFrame:
    """(template, licence, versions, word, tf): a fixed number of rows."""
    rows = [(i, licence, text) for i, (licence, text) in enumerate(TEMPLATES)]
    made = spark.createDataFrame(rows, "template int, licence string, text string").withColumn("words", _words(F.col("text")))
    made = made.select("template", "licence", _versions(F.col("words")).alias("t_versions"), F.explode("words").alias("word"))
    return made.groupBy("template", "licence", "t_versions", "word").agg(F.count("*").alias("tf"))


def spdx(files: DataFrame) -> DataFrame:
    """(key, licence, score) of the files with an SPDX line that names a licence of the templates."""
    named = F.regexp_extract(text_of(), r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9.\-]+)", 1)
    plain = F.regexp_replace(named, r"-only$|-or-later$|\.$", "")
    found = files.filter(text_of().contains("SPDX-License-Identifier:")).select(_key().alias("key"), plain.alias("licence"))
    return found.filter(F.col("licence").isin(*_SPDX)).distinct().withColumn("score", F.lit(1.0))


def detect(files: DataFrame, work: Workspace, least: float = LEAST) -> DataFrame:
    """(key, licence, score) of the files with a licence statement of their own."""
    spark = files.sparkSession
    named = statements(files).withColumn("statement", F.md5(F.array_join("words", " ")))
    named = work.keep(named.select("key", "clause", "statement", "words"))
    # One vector for each distinct statement; how often it occurs counts for the rarity of its words.
    distinct = named.groupBy("statement").agg(F.count("*").alias("copies"), F.first("words").alias("words"))
    distinct = distinct.withColumn("versions", F.array_distinct(_versions(F.col("words"))))
    counts = distinct.select("statement", "copies", F.explode("words").alias("word")).groupBy("statement", "copies", "word")
    vectors = work.keep(counts.agg(F.count("*").alias("tf")))
    versions = work.keep(distinct.select("statement", "versions").filter(F.size("versions") > 0))
    total = named.count()
    rarity = vectors.groupBy("word").agg((1 + F.ln((F.lit(total) + 1) / (F.sum("copies") + 1))).alias("idf"))
    rarity = work.keep(rarity)
    weight = (1 + F.ln(F.col("tf"))) * F.coalesce("idf", F.lit(1.0) + F.ln(F.lit(total + 1.0)))
    templates = template_vectors(spark).join(rarity, "word", "left").select("template", "licence", "t_versions", "word", weight.alias("t_weight"))
    templates = work.keep(templates)
    # The templates are a fixed list of some hundred words, the most frequent ones of statements among them.
    frequent = F.broadcast(templates.select("word").distinct().join(rarity, "word"))
    rare = rarity.join(F.broadcast(templates.select("word").distinct()), "word", "left_anti")
    here = vectors.join(frequent, "word").select("statement", "word", weight.alias("weight"))
    other = vectors.join(rare, "word").select("statement", F.lit(None).cast("string").alias("word"), weight.alias("weight"))
    length = here.unionByName(other).groupBy("statement").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("length"))
    t_length = templates.groupBy("template").agg(F.sqrt(F.sum(F.col("t_weight") ** 2)).alias("t_length"))
    product = (
        here.join(F.broadcast(templates), "word")
        .groupBy("statement", "template", "licence", "t_versions")
        .agg(F.sum(F.col("weight") * F.col("t_weight")).alias("dot"))
    )
    cosine = F.round(F.col("dot") / (F.col("length") * F.col("t_length")), 9)
    scored = product.join(length, "statement").join(F.broadcast(t_length), "template").withColumn("score", cosine)
    scored = scored.filter(F.col("score") >= least).join(versions, "statement", "left")
    agrees = F.col("versions").isNull() | (F.size("t_versions") == 0) | F.arrays_overlap("versions", "t_versions")
    best = F.min_by(F.struct("licence", "score"), F.struct(-F.col("score"), "licence"))
    nearest_template = work.keep(scored.filter(agrees).groupBy("statement").agg(best.alias("b")).select("statement", "b.*"))
    of_files = named.select("key", "clause", "statement").join(nearest_template, "statement")
    told = F.when(F.col("licence").startswith("BSD-") & F.col("clause").isNotNull(), F.col("clause")).otherwise(F.col("licence"))
    of_files = of_files.select("key", told.alias("licence"), "score").unionByName(spdx(files))
    return work.keep(of_files.groupBy("key").agg(best.alias("b")).select("key", "b.*"))


def directory(path: str = "path") -> Column:
    """The directory part, without the last name; empty at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def nearest(directories: DataFrame, spoken: DataFrame) -> DataFrame:
    """(directory, ancestor, licence): for each directory the licence of the deepest directory at
    or above it among `spoken` (ancestor, licence)."""
    parts = F.split("directory", "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    chains = directories.select("directory", F.explode(F.array_union(F.array(F.lit("")), above)).alias("ancestor"))
    found = chains.join(spoken, "ancestor").groupBy("directory")
    return found.agg(F.max_by(F.struct("ancestor", "licence"), F.length("ancestor")).alias("n")).select("directory", "n.*")


def scan(files: DataFrame, least: float = LEAST) -> DataFrame:
    """For each row of (file, path, text): licence, score, origin (own, inherited, none) and the
    directory it is inherited from."""
    work = Workspace(files.sparkSession)
    own = detect(files, work, least)
    keyed = files.select("file", "path", directory().alias("directory"), _key().alias("key"))
    paths = work.keep(keyed.join(own, "key", "left").drop("key"))
    speaking = paths.filter(is_licence_file() & F.col("licence").isNotNull())
    spoken = speaking.groupBy(F.col("directory").alias("ancestor")).agg(
        F.min_by("licence", F.struct(-F.col("score"), "licence")).alias("licence")
    )
    wanting = paths.filter(F.col("licence").isNull() & F.col("directory").isNotNull()).select("directory").distinct()
    heirs = work.keep(nearest(wanting, work.keep(spoken)).withColumnRenamed("licence", "above"))
    joined = paths.join(heirs, "directory", "left")
    origin = F.when(F.col("licence").isNotNull(), "own").when(F.col("above").isNotNull(), "inherited").otherwise("none")
    return joined.select(
        "file", "path", F.coalesce("licence", "above").alias("licence"), "score", origin.alias("origin"),
        F.when(F.col("licence").isNull(), F.col("ancestor")).alias("inherited_from"),
    )
