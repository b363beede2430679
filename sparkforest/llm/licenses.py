"""License scans from DataFrame functions alone: SPDX identifiers, and TF-IDF cosine of license lines and of blocks
of neighbouring lines to templates, then inheritance from the nearest ancestor directory that declares a license."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkforest.llm._util import Scratch
from sparkforest.llm.quality_rules import let

#: Header forms of common licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0": "This program is licensed under the GNU General Public License, version 2",
    "LGPL-3.0": "licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "licensed under the GNU Affero General Public License, version 3",
    "BSD-3-Clause": "licensed under the BSD 3-Clause License. Redistribution and use in source and binary forms",
    "MPL-2.0": "subject to the terms of the Mozilla Public License, version 2.0",
    "CC-BY-4.0": "licensed under CC BY 4.0 Creative Commons Attribution",
    "CC-BY-SA-4.0": "licensed under CC BY-SA 4.0 Creative Commons Attribution-ShareAlike",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0 Creative Commons Attribution-NonCommercial",
}
_GPL = "free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
#: Titles, notices and bodies that go over several lines. A license may have several.
BLOCKS = [
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", _BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("GPL", "GNU GENERAL PUBLIC LICENSE"),
    ("LGPL", "GNU LESSER GENERAL PUBLIC LICENSE"),
    ("AGPL", "GNU AFFERO GENERAL PUBLIC LICENSE"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    *((f"{name}-{v}", f"This {what} is " + _GPL.format(title, v.removesuffix(".0"))) for name, title, what, vs in (("GPL", "General Public License", "program", ("2.0", "3.0")), ("LGPL", "Lesser General Public License", "library", ("2.1", "3.0")), ("AGPL", "Affero General Public License", "program", ("3.0",))) for v in vs),
]
#: Blocks of up to so many lines that aren't blank are compared; they begin and end with a line that shares a long
#: term with BLOCKS.
LENGTH = 20
#: An SPDX expression, without brackets around it all.
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*(\(*ID\)*(?:[ \t]+(?:OR|AND|WITH)[ \t]+\(*ID\)*)*)".replace("ID\\)", r"[a-z0-9]+(?:[.\-][a-z0-9]+)*\+?\)")
#: A line is a license line if it has this.
MARK = r"(?i)licen[cs]e|copyright|spdx"
#: Least cosine for a match.
LEAST = 0.6
#: Files that declare a license for their directory and all below.
FILES = r"(?i)^(licen[cs]e|copying|notice)(\.(txt|md|rst))?$"


def terms_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9.\-]+|\.(?=\s|$)"), lambda t: t != "")


def _split(text: str) -> list[str]:
    return [t for t in re.split(r"[^a-z0-9.\-]+|\.(?=\s|$)", text.lower()) if t]


#: What lines of BLOCKS have and most other lines don't.
SIGNAL = r"(?i)\b(" + "|".join(sorted({t for _, x in BLOCKS for t in _split(x) if t.isalpha() and len(t) >= 6} | {"gnu"})) + r")\b"


def templates(spark: SparkSession, of: list[tuple[str, str]]) -> tuple[DataFrame, float]:
    """(template, license, term, weight, idf), weights of unit length, and the idf of a term in no template. A fixed, small table."""
    tf = [(name, Counter(_split(x))) for name, x in of]
    df = Counter(t for _, c in tf for t in c)
    idf = {t: math.log((1 + len(tf)) / (1 + n)) + 1 for t, n in df.items()}
    rows = []
    for i, (name, c) in enumerate(tf):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        rows += [(i, name, t, n * idf[t] / norm, idf[t]) for t, n in c.items()]
    return spark.createDataFrame(rows, "template int, license string, term string, weight double, idf double"), math.log(1 + len(tf)) + 1


def near(found: DataFrame, of: list[tuple[str, str]]) -> DataFrame:
    """(line, license, score, dot) of each distinct ``line`` and each template that it is near enough to; ``dot`` is
    how much of the line's weight the template has."""
    table, unknown = templates(found.sparkSession, of)
    lines = found.groupBy("line").agg(F.lit(1).alias("_")).select("line")  # a line that many files share is scored once
    terms = lines.select("line", F.explode(terms_of(F.col("line"))).alias("term")).groupBy("line", "term").agg(F.count("*").alias("n"))
    weighed = terms.join(F.broadcast(table.select("term", "idf").distinct()), "term", "left").withColumn("w", F.col("n") * F.coalesce("idf", F.lit(unknown)))
    norms = weighed.groupBy("line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(F.broadcast(table.select("template", "license", "term", "weight")), "term").groupBy("line", "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    return dots.join(norms, "line").select("line", "license", F.round(F.col("dot") / F.col("norm"), 9).alias("score"), F.round("dot", 9).alias("dot")).where(F.col("score") >= LEAST)


def blocks(text: Column) -> Column:
    """Distinct blocks of a text's neighbouring lines; lines without a letter or digit don't count."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit("[A-Za-z0-9]")))
    marked = lambda x: F.filter(F.transform(x, lambda y, i: F.when(F.regexp_like(y, F.lit(SIGNAL)), i)), lambda i: i.isNotNull())
    ends = lambda at, i: F.filter(F.slice(at, i + 1, F.lit(LENGTH)), lambda j: j < F.get(at, i) + LENGTH)
    of = lambda x, at: F.flatten(F.transform(at, lambda first, i: F.transform(ends(at, i), lambda last: F.array_join(F.slice(x, first + 1, last - first + 1), "\n"))))
    return F.array_distinct(let(lines, lambda x: let(marked(x), lambda at: of(x, at))))


def scan(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, license, score) of each file with a license: its first SPDX expression (score 1), else the template
    nearest to any license line or to its best block, where that is near enough.

    The best block is the one that shares most weight with its template, so that a whole notice or body tells more
    than a title or a line in it. Of equal scores, the first license by name. Null texts and files without
    license text have no row; paths that repeat count as one file.
    """
    texts = files.select(F.col(path).alias("path"), F.col(text).alias("text"))
    scratch = Scratch(files.sparkSession)
    texts = scratch.store(texts.where(F.col("text").rlike(f"{MARK}|{SIGNAL}")))  # each use would else search all texts again
    found = texts.where(F.col("text").rlike(MARK)).select("path", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where(F.col("line").rlike(MARK))
    choice = F.struct((-F.col("score")).alias("s"), "license")
    best = near(found, list(TEMPLATES.items())).groupBy("line").agg(F.min(choice).alias("b"))
    by_line = found.join(best, "line").select("path", F.lit(1).alias("rank"), "b")
    parts = texts.where(F.col("text").rlike(SIGNAL)).select("path", F.explode(blocks(F.col("text"))).alias("line"))
    best = near(parts, BLOCKS).groupBy("line").agg(F.min(F.struct((-F.col("dot")).alias("d"), choice.alias("b"))).alias("x"))
    by_block = parts.join(best, "line").groupBy("path").agg(F.min("x").alias("x")).select("path", F.lit(1).alias("rank"), "x.b")
    named = F.filter(F.regexp_extract_all("text", F.lit(SPDX), F.lit(1)), lambda x: ~F.upper(x).isin("NONE", "NOASSERTION"))
    spdx = texts.where(F.col("text").rlike("(?i)spdx-license-identifier:")).select("path", F.get(named, F.lit(0)).alias("license")).where("license is not null")
    spdx = spdx.select("path", F.lit(0).alias("rank"), F.struct(F.lit(-1.0).alias("s"), "license").alias("b"))
    all_found = by_line.unionByName(by_block).unionByName(spdx).groupBy("path").agg(F.min(F.struct("rank", "b")).alias("x"))
    return scratch.store(all_found.select("path", F.col("x.b.license").alias("license"), (-F.col("x.b.s")).alias("score")))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def inherit(files: DataFrame, own: DataFrame, path: str = "path") -> DataFrame:
    """(path, license, score, origin, levels) of each distinct path: its own license (levels 0, origin the path
    itself), else that of the license file in the nearest directory above it (levels from 1), else nulls.
    Null paths have no row."""
    paths = files.select(F.col(path).alias("path")).where("path is not null").distinct()
    declared = own.where(F.element_at(F.split("path", "/"), -1).rlike(FILES))
    declared = declared.select(directory(F.col("path")).alias("dir"), F.struct((-F.col("score")).alias("s"), "license", F.col("path").alias("origin")).alias("d"))
    declared = declared.groupBy("dir").agg(F.min("d").alias("d"))
    # Directories are fewer than files: each looks its ancestors up once, files then look up their directory.
    dirs = paths.select(directory(F.col("path")).alias("of")).distinct()
    parts = F.split("of", "/")
    above = dirs.select("of", F.explode(F.sequence(F.size(parts), F.lit(0), F.lit(-1))).alias("depth")).select("of", "depth", F.array_join(F.slice(F.split("of", "/"), F.lit(1), F.col("depth")), "/").alias("dir"))
    nearest = above.join(declared, "dir").groupBy("of").agg(F.max(F.struct("depth", "d")).alias("x")).select("of", (F.size(F.split("of", "/")) - F.col("x.depth") + 1).alias("up"), F.col("x.d").alias("d"))
    out = paths.join(own, "path", "left").withColumn("of", directory(F.col("path"))).join(nearest, "of", "left")
    has = F.col("license").isNotNull()
    return out.select("path", F.coalesce("license", "d.license").alias("license"), F.coalesce("score", -F.col("d.s")).alias("score"), F.when(has, F.col("path")).otherwise(F.col("d.origin")).alias("origin"), F.when(has, 0).otherwise(F.col("up")).alias("levels"))


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: source/thousand/hundred/name, the first of each hundred and thousand being its LICENSE."""
    i = F.col("doc_id")
    name = F.when(i % 100 == 0, F.lit("LICENSE")).otherwise(F.concat(F.lit("doc"), i.cast("string"), F.lit(".txt")))
    top = F.concat_ws("/", F.coalesce("source", F.lit("none")), (i / 1000).cast("long").cast("string"))
    where = F.when(i % 1000 == 0, top).otherwise(F.concat_ws("/", top, (i / 100).cast("long").cast("string")))
    return docs.select("doc_id", F.concat_ws("/", where, name).alias("path"), "text")


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    files = document_paths(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = inherit(files, scan(files))
    return files.select("doc_id", "path").join(found, "path").select("doc_id", "path", "license", F.round("score", 6).alias("score"), "origin", F.col("levels").cast("int").alias("levels"))


def _sql() -> str:
    values = ", ".join(f"('{name}', '{text}')" for name, text in TEMPLATES.items())
    split = r"list_filter(string_split_regex(lower({}), '[^a-z0-9.\-]+|\.(\s|$)'), lambda x: x <> '')"
    return rf"""
with f as (
  select doc_id, text, case when doc_id % 1000 = 0 then coalesce(source, 'none') || '/' || (doc_id // 1000) || '/LICENSE'
    when doc_id % 100 = 0 then coalesce(source, 'none') || '/' || (doc_id // 1000) || '/' || (doc_id // 100) || '/LICENSE'
    else coalesce(source, 'none') || '/' || (doc_id // 1000) || '/' || (doc_id // 100) || '/doc' || doc_id || '.txt' end as path
  from documents
), tpl(license, body) as (values {values}
), tt as (
  select license, term, count(*) as n from (select license, unnest({split.format("body")}) as term from tpl) group by all
), idf as (
  select term, ln((1 + (select count(*) from tpl)) / (1.0 + count(*))) + 1 as idf from tt group by term
), tw as (
  select license, term, n * idf / sqrt(sum(n * idf * n * idf) over (partition by license)) as weight from tt join idf using (term)
), l as (
  select distinct path, unnest(string_split(text, chr(10))) as line from f where regexp_matches(text, '(?i)licen[cs]e|copyright|spdx')
), ll as (
  select * from l where regexp_matches(line, '(?i)licen[cs]e|copyright|spdx')
), lt as (
  select line, term, count(*) as n from (select line, unnest({split.format("line")}) as term from (select distinct line from ll)) group by all
), lw as (
  select line, term, n * coalesce(idf, ln(1 + (select count(*) from tpl)) + 1) as w from lt left join idf using (term)
), nm as (
  select line, sqrt(sum(w * w)) as norm from lw group by line
), sc as (
  select line, license, round(sum(w * weight) / any_value(norm), 9) as score from lw join tw using (term) join nm using (line) group by line, license
), own as (
  select path, license, score from (select path, license, score, row_number() over (partition by path order by score desc, license) as rn from ll join sc using (line) where score >= 0.6) where rn = 1
), dec as (
  select regexp_replace(path, '/?[^/]*$', '') as dir, license, score, path as origin from own where path like '%/LICENSE'
), up as (
  select f.doc_id, d.license, d.score, d.origin, len(string_split(regexp_replace(f.path, '/?[^/]*$', ''), '/')) - len(string_split(d.dir, '/')) + 1 as up,
    row_number() over (partition by f.doc_id order by len(d.dir) desc) as rn
  from f join dec d on starts_with(regexp_replace(f.path, '[^/]*$', ''), d.dir || '/')
)
select f.doc_id, f.path, coalesce(own.license, up.license) as license, round(coalesce(own.score, up.score), 6) as score,
  case when own.license is not null then f.path else up.origin end as origin,
  cast(case when own.license is not null then 0 else up.up end as int) as levels
from f left join own using (path) left join up on up.doc_id = f.doc_id and up.rn = 1
"""


OP7_SQL = _sql()
