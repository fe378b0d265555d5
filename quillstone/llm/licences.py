"""Licence scans with DataFrame functions only.

Texts are cut into sentences and lines; those that speak of licences are headers, and all of a file's headers together are
one more candidate. Candidates, known by their MD5, and templates become sparse TF-IDF vectors (document frequencies over
all distinct candidates and templates) and are compared by cosine through a join on terms: a candidate meets only templates
that share a term. The best template at or above LEAST is a file's licence.

A licence file is one with such a name (LICENSE, COPYING ...) or whose words are mostly headers. Every directory inherits
from the nearest ancestor (or itself) that holds a licence file: the distinct directories are joined with the licence
files' directories by their ancestor paths, the longest wins. What a file says itself and what it inherits are reported
apart: `documents` has paths of source/doc_id only, where a document that consists of a header would else speak for all of
its source.

Equal candidates are compared once and equal directories joined once, so a common header or a directory with a third of
all files costs no more than a rare one.

Defined results: a null or empty text has no headers; a null path is the file name "" in the root; ties go to the higher
cosine, then to the licence and the path that sort first; repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LEAST = 0.5
#: A file whose headers have this share of its words is a licence file.
MOSTLY = 0.8

#: What licences' headers and files say.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    "MIT": ("Released under the MIT License.", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "ISC": ("Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related rights to this work (CC0 1.0).",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Proprietary": ("Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited.",),
}
#: One more template of each licence, by rule.
TEMPLATES = {k: (*v, f"SPDX-License-Identifier: {k}") for k, v in TEMPLATES.items()}
_TRIGGER = r"(?i)licen[cs]|copyright|copyleft|spdx|public domain|permission|redistribut|rights reserved|creative commons|free software"
_FILE = r"(?i)(^|/)(un)?(licen[cs]e|copying|copyright)[^/]*$"
_WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
_BIG, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(x):
    return F.regexp_extract_all(F.translate(x, _BIG, _SMALL), F.lit(_WORD), F.lit(0))


def _pieces(text):
    return F.split(F.regexp_replace(text, r"([.!?])[ \t\r]+", "$1\n"), "\n")


def _weights(vectors: DataFrame, df: DataFrame) -> DataFrame:
    """vectors: (key, term, tf). Adds the weight and the key's norm."""
    w = vectors.join(df, "term").withColumn("w", F.col("tf") * F.col("idf"))
    return w.join(w.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")), "key")


def _templates(spark) -> DataFrame:
    """(key, text), a few dozen rows made in the JVM."""
    rows = [F.struct(F.lit(f"{k}#{i}").alias("key"), F.lit(t).alias("text")) for k, v in TEMPLATES.items() for i, t in enumerate(v)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def compared(candidates: DataFrame) -> DataFrame:
    """candidates: (key, text), distinct, written out. Per key with any shared term: key, licence, cosine of the best template."""
    terms = lambda df: df.select("key", F.explode(_words(F.col("text"))).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))
    own, given = terms(candidates), terms(_templates(candidates.sparkSession))
    n = candidates.count() + sum(map(len, TEMPLATES.values()))
    both = own.select("term").unionAll(given.select("term"))
    # Written out, so that a join with it may be split at a term that most candidates have.
    df = C.persisted(both.groupBy("term").agg((F.log((F.lit(n) + 1) / (F.count("*") + 1)) + 1).alias("idf")), "licence-terms")
    # The templates are a fixed few hundred rows.
    t = F.broadcast(_weights(given, df).select(F.col("key").alias("template"), "term", F.col("w").alias("tw"), F.col("norm").alias("tn")))
    s = _weights(own, df)
    cosine = s.join(t, "term").groupBy("key", "template").agg((F.sum(F.col("w") * F.col("tw")) / F.first(F.col("norm")) / F.first(F.col("tn"))).alias("c"))
    best = cosine.select("key", F.round("c", 6).alias("cosine"), F.substring_index("template", "#", 1).alias("licence"))
    return best.groupBy("key").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "licence")).alias("b")).select("key", "b.licence", (-F.col("b.less")).alias("cosine"))


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Per file: doc_id, path, licence (its own) and cosine, n_headers, licence_dir and inherited_licence of the nearest one."""
    rows = files.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(path_col), F.lit("")).alias("path"), F.col(text_col).alias("text"))
    rows = rows.withColumn("dir", F.regexp_replace("path", r"(^|/)[^/]*$", ""))
    headed = rows.filter(F.col("text").rlike(_TRIGGER)).select("doc_id", "path", "dir", F.filter(_pieces(F.col("text")), lambda x: x.rlike(_TRIGGER)).alias("headers"), F.regexp_count(F.translate("text", _BIG, _SMALL), F.lit(_WORD)).alias("n_words"))
    headed = C.persisted(headed.withColumn("candidates", F.array_distinct(F.concat("headers", F.array(F.array_join("headers", "\n"))))), "licence-headers")
    key = F.unhex(F.md5("text")).alias("key")
    candidates = headed.select(F.explode("candidates").alias("text")).select(key, "text").groupBy("key").agg(F.min("text").alias("text"))
    known = C.persisted(compared(C.persisted(candidates, "licence-candidates")).filter(F.col("cosine") >= LEAST), "licence-known")
    each = headed.select("doc_id", "path", F.explode("candidates").alias("text")).select("doc_id", "path", key).join(known, "key")
    own = each.groupBy("doc_id", "path").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "licence")).alias("b")).select("doc_id", "path", F.col("b.licence").alias("own_licence"), (-F.col("b.less")).alias("cosine"))
    sizes = headed.withColumn("n_headers", F.size("headers").cast("long")).withColumn("in_headers", F.aggregate("headers", F.lit(0), lambda a, x: a + F.regexp_count(F.translate(x, _BIG, _SMALL), F.lit(_WORD))))
    sizes = sizes.groupBy("doc_id", "path", "dir").agg(F.max("n_headers").alias("n_headers"), F.max(F.col("path").rlike(_FILE) | (F.col("in_headers") >= MOSTLY * F.col("n_words"))).alias("is_licence_file"))
    found = own.select(F.col("doc_id").alias("f_doc_id"), F.col("path").alias("f_path"), "own_licence", "cosine")
    own = sizes.join(found, F.col("doc_id").eqNullSafe(F.col("f_doc_id")) & (F.col("path") == F.col("f_path")), "left").drop("f_doc_id", "f_path")
    holders = own.filter("is_licence_file and own_licence is not null").groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "own_licence", "path")).alias("b")).select(F.col("dir").alias("licence_dir"), F.col("b.own_licence").alias("inherited"))
    folders = rows.select("dir").distinct()
    steps = F.split("dir", "/", -1)
    up = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/")), F.array(F.lit(""))))
    nearest = folders.select("dir", F.explode(F.array_distinct(up)).alias("licence_dir")).join(holders, "licence_dir")
    nearest = nearest.groupBy("dir").agg(F.max(F.struct(F.length("licence_dir").alias("n"), "licence_dir", "inherited")).alias("b")).select("dir", "b.licence_dir", "b.inherited")
    own = own.select(*(F.col(c).alias(f"o_{c}") for c in ("doc_id", "path")), "own_licence", "cosine", "n_headers")
    out = rows.drop("text").join(own, F.col("doc_id").eqNullSafe(F.col("o_doc_id")) & (F.col("path") == F.col("o_path")), "left").join(nearest, "dir", "left")
    return out.select("doc_id", "path", F.col("own_licence").alias("licence"), "cosine", F.coalesce("n_headers", F.lit(0)).cast("long").alias("n_headers"), "licence_dir", F.col("inherited").alias("inherited_licence"))


def op8_licences(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents")
    return scan(docs.select("doc_id", F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("path"), "text"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_VALUES = ", ".join(f"({_quoted(f'{k}#{i}')}, {_quoted(t)})" for k, v in TEMPLATES.items() for i, t in enumerate(v))
_LOW = "translate({}, '" + _BIG + "', '" + _SMALL + "')"
ORACLE_SQL = {
    "op8_licences": f"""
WITH f AS (SELECT doc_id, coalesce(source, '') AS dir, coalesce(source, '') || '/' || coalesce(CAST(doc_id AS VARCHAR), '') AS path, text FROM documents),
h AS (SELECT doc_id, path, dir, list_filter(string_split(regexp_replace(text, '([.!?])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10)), lambda x: regexp_matches(x, '{_TRIGGER}')) AS headers,
             len(regexp_extract_all({_LOW.format('text')}, '{_WORD}')) AS n_words
      FROM f WHERE regexp_matches(text, '{_TRIGGER}')),
c AS (SELECT *, list_distinct(list_append(headers, array_to_string(headers, chr(10)))) AS candidates FROM h),
d AS (SELECT DISTINCT unnest(candidates) AS k FROM c),
t AS (SELECT * FROM (VALUES {_VALUES}) AS v(k, text)),
a AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(regexp_extract_all({_LOW.format('k')}, '{_WORD}')) AS term FROM d) GROUP BY ALL),
b AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(regexp_extract_all({_LOW.format('text')}, '{_WORD}')) AS term FROM t) GROUP BY ALL),
i AS (SELECT term, ln(((SELECT count(*) FROM d) + (SELECT count(*) FROM t) + 1) / (count(*) + 1)) + 1 AS idf FROM (SELECT term FROM a UNION ALL SELECT term FROM b) GROUP BY term),
aw AS (SELECT k, term, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY k)) AS n FROM a JOIN i USING (term)),
bw AS (SELECT k, term, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY k)) AS n FROM b JOIN i USING (term)),
m AS (SELECT aw.k, split_part(bw.k, '#', 1) AS licence, round(sum(aw.w * bw.w) / any_value(aw.n) / any_value(bw.n), 6) AS cosine FROM aw JOIN bw USING (term) GROUP BY aw.k, bw.k),
e AS (SELECT doc_id, path, licence, cosine FROM (SELECT doc_id, path, unnest(candidates) AS k FROM c) JOIN m USING (k) WHERE cosine >= {LEAST}
      QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY cosine DESC, licence) = 1),
o AS (SELECT c.doc_id, c.path, c.dir, e.licence AS own_licence, e.cosine, CAST(len(headers) AS BIGINT) AS n_headers,
             regexp_matches(c.path, '{_FILE}') OR list_sum(list_transform(headers, lambda x: len(regexp_extract_all({_LOW.format('x')}, '{_WORD}')))) >= {MOSTLY} * n_words AS is_licence_file
      FROM c LEFT JOIN e ON c.doc_id IS NOT DISTINCT FROM e.doc_id AND c.path = e.path),
p AS (SELECT dir, own_licence AS inherited FROM o WHERE is_licence_file AND own_licence IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, own_licence, path) = 1)
SELECT f.doc_id, f.path, o.own_licence AS licence, o.cosine, coalesce(o.n_headers, 0) AS n_headers,
       CASE WHEN p.dir IS NOT NULL THEN p.dir WHEN r.dir IS NOT NULL THEN r.dir END AS licence_dir, coalesce(p.inherited, r.inherited) AS inherited_licence
FROM f LEFT JOIN o ON f.doc_id IS NOT DISTINCT FROM o.doc_id AND f.path = o.path LEFT JOIN p ON f.dir = p.dir LEFT JOIN p AS r ON r.dir = ''"""
}
