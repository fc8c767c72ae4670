"""License scans.  DataFrame operations only.

Every line that could state a licence is compared with short templates, every block of lines that could be a licence
header with header templates, and every licence file as a whole with licence bodies, by the cosine of sparse TF-IDF vectors; a file without its own statement inherits from the nearest ancestor directory
that holds a licence file.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import cut, drop

#: Licence name and the wording of its usual header or reference.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: The usual notices of more than one sentence, as they stand at the head of files or of short licence files.
HEADERS = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
     " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
     " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software"
     ' distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
     " See the License for the specific language governing permissions and limitations under the License."),
    *((f"{short}-{version}.0", f"This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name}General Public License"
       f" as published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version.")
      for short, what, name in (("GPL", "program", ""), ("LGPL", "library", "Lesser "), ("AGPL", "program", "Affero ")) for version, colon, comma in ((2, ";", ";"), (3, ":", ","))
      if (short, version) not in (("LGPL", 2), ("AGPL", 2))),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"
     " as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,"
     " You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"),"
     " to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell"
     " copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
     " provided that the above copyright notice and this permission notice appear in all copies."),
]
#: Whole licences, one file each, by name.
BODIES = [(f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in sorted((Path(__file__).parent / "licenses").glob("*.txt"))]
#: A block is up to so many consecutive lines of at most so many characters, one of which has a word that every notice has.
BLOCK_LINES, BLOCK_WIDTH = 12, 400
_STATES = ("licen", "permission", "redistribut", "public domain")
#: Cosine from which a line or licence file counts as stating a template's licence.
THRESHOLD = 0.77
#: Directory names of files that license their directory.
LICENSE_FILE = r"^(LICEN[SC]E|COPYING|NOTICE)(\.(txt|md))?$"
_WORD = r"[a-z0-9][a-z0-9.+\-]*[a-z0-9+]|[a-z0-9]"
_SALTS = 16


def _weights(templates) -> tuple[dict[str, float], list[tuple[str, dict[str, float]]], float]:
    """idf by term, (name, unit vector) by template, and the idf of terms in no template."""
    bags = [re.findall(_WORD, text.lower()) for _, text in templates]
    n = len(bags)
    idf = {w: math.log((1 + n) / (1 + sum(w in b for b in bags))) + 1 for w in sorted({w for b in bags for w in b})}
    vectors = []
    for (name, _), bag in zip(templates, bags, strict=True):
        v = {w: bag.count(w) * idf[w] for w in sorted(set(bag))}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append((name, {w: x / norm for w, x in v.items()}))
    return idf, vectors, math.log(1 + n) + 1


def _anchors(vectors) -> list[str]:
    """For each template the terms that common text has least, by their form: those with a dot or dash, then the longest; enough that a line with none of
    them stays under the threshold."""
    out: set[str] = set()
    for _, v in vectors:
        left = 1.0
        for w in sorted(v, key=lambda w: (w.isalnum(), -len(w), -v[w], w)):
            if math.sqrt(max(left, 0.0)) < THRESHOLD:
                break
            out.add(w)
            left -= v[w] ** 2
    return sorted(out)


def _best(texts: DataFrame, sets, threshold: float) -> DataFrame:
    """(set, key, best struct<score, license>) of texts (set int, key, body), one row a set and key, that reach the threshold with some template of sets[set].

    Sparse vectors as rows: a text's terms are counted, weighed by a join with the idf table, which also holds the templates' weights
    of a term, and multiplied by these. That table is fixed and of a few thousand rows. Of equal cosines the later name counts.
    All sets go through one plan, and rows dealt by (set, key) are not dealt again.
    """
    rows, unseens = [], []
    for s, templates in enumerate(sets):
        idf, vectors, unseen = _weights(templates)
        unseens.append(F.lit(unseen))
        rows += [(s, w, x, [(i, name, v[w]) for i, (name, v) in enumerate(vectors) if w in v]) for w, x in idf.items()]
    table = F.broadcast(texts.sparkSession.createDataFrame(rows, "set int, w string, idf double, weights array<struct<i:int,license:string,y:double>>"))
    terms = texts.select("set", "key", F.explode(F.regexp_extract_all(F.lower("body"), F.lit(f"({_WORD})"))).alias("w")).groupBy("set", "key", "w").count()
    x = F.col("count") * F.coalesce("idf", F.element_at(F.array(*unseens), F.col("set") + 1))
    terms = terms.join(table, ["set", "w"], "left").select("set", "key", x.alias("x"), "weights")
    # The term times itself, for the norm, has no template.
    own = F.array(F.struct(F.lit(None).cast("int").alias("i"), F.lit(None).cast("string").alias("license"), F.col("x").alias("y")))
    dots = terms.select("set", "key", "x", F.explode(F.concat(own, F.coalesce("weights", F.array().cast("array<struct<i:int,license:string,y:double>>")))).alias("t"))
    dots = dots.groupBy("set", "key", "t.i", "t.license").agg(F.sum(F.col("x") * F.col("t.y")).alias("dot"))
    norm = F.sqrt(F.max(F.when(F.col("i").isNull(), F.col("dot")))).alias("norm")
    scored = dots.groupBy("set", "key").agg(norm, F.collect_list(F.when(F.col("i").isNotNull(), F.struct("dot", "license"))).alias("dots"))
    scored = scored.select("set", "key", F.array_max(F.transform("dots", lambda d: F.struct(F.round(d["dot"] / F.col("norm"), 6).alias("score"), d["license"].alias("license")))).alias("best"))
    return scored.where(F.col("best.score") >= threshold)


def best_templates(lines: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(line, best struct<score, license>) of the distinct lines that reach the threshold with some template; a column body, if there
    is one, holds the text that line is the key of."""
    body = "body" if "body" in lines.columns else "line"
    texts = lines.select(F.lit(0).alias("set"), F.col("line").alias("key"), F.col(body).alias("body"))
    return _best(texts, [templates], threshold).select(F.col("key").alias("line"), "best")


def _found(held: DataFrame, best: DataFrame) -> DataFrame:
    """(doc_id, path, best) of held (doc_id, path, set, key), where many may share a key.

    Merged at every size: best is read from files, whose size says little of the salted rows that a broadcast would put into the driver.
    """
    best = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))).hint("merge")
    salt = F.pmod(F.coalesce(F.xxhash64("doc_id", "path"), F.lit(0)), F.lit(_SALTS)).cast("int").alias("salt")
    return held.select("doc_id", "path", "set", "key", salt).join(best, ["set", "key", "salt"]).select("doc_id", "path", "best")


def blocks(files: DataFrame) -> DataFrame:
    """(doc_id, path, line, n) of files (doc_id, path, text): every line with a word of _STATES and every block of n lines around one, comment marks left out."""
    n, states = F.size("lines"), lambda x: F.lower(x).rlike("|".join(_STATES))
    lines = files.where(states(F.col("text"))).select("doc_id", "path", F.split("text", "\r?\n").alias("lines"))
    # Around each such line as many lines as a block may reach; lines too long for a block are null there.
    short = lambda x: F.when(F.length(x) <= BLOCK_WIDTH, x)
    first = lambda i: F.greatest(F.lit(1), i - BLOCK_LINES + 1)
    near = lambda i: F.struct(F.element_at("lines", i).alias("own"), F.transform(F.slice("lines", first(i), F.lit(2 * BLOCK_LINES - 1)), short).alias("near"), (i - first(i) + 1).alias("at"))
    at = F.filter(F.sequence(F.lit(1), n), lambda i: states(F.element_at("lines", i)))
    rows = lines.select("doc_id", "path", F.explode(F.transform(at, near)).alias("r")).select("doc_id", "path", "r.*")
    size = F.size("near")
    starts = lambda k: F.sequence(F.greatest(F.lit(1), F.col("at") - k + 1), F.least(F.col("at"), size - k + 1))
    windows = lambda k: F.transform(starts(k), lambda s: F.struct(k.alias("n"), F.slice("near", s, k).alias("part")))
    pick = F.when(size > 1, F.flatten(F.transform(F.sequence(F.lit(2), F.least(F.lit(BLOCK_LINES), size)), windows)))
    whole = F.array(F.struct(F.lit(1).alias("n"), F.array("own").alias("part")))
    rows = rows.select("doc_id", "path", F.explode(F.concat(whole, F.coalesce(pick, F.array().cast("array<struct<n:int,part:array<string>>>")))).alias("b"))
    rows = rows.where(~F.exists("b.part", lambda x: x.isNull()))
    words = F.array_join(F.regexp_extract_all(F.lower(F.array_join("b.part", "\n")), F.lit(f"({_WORD})")), " ")
    return rows.select("doc_id", "path", words.alias("line"), (F.col("b.n") > 1).alias("many")).distinct()


def scan(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, headers=HEADERS, bodies=BODIES) -> DataFrame:
    """Licence of every file of files (doc_id, path, text): doc_id, path, own_license, own_score, license, license_dir, kind.

    own_*: the best template over all lines of the whole text, all blocks of lines that could be a header and, for a licence file, the
    whole text, that reach the threshold (of equal scores the later name).
    kind: 'file' for a licence file with a licence, 'header' for another file with a statement of its own, 'inherited'
    where the nearest ancestor directory with a licence file gives one, else 'none'. A null text or path is empty; an
    empty text states nothing; several licence files in one directory give the best score's; rows that share doc_id and path are one
    file, and each gets its result; an empty table gives no rows. Lines without any anchor term cannot reach the threshold and aren't weighed;
    the others are weighed once for each distinct line.
    """
    idf, vectors, _ = _weights(templates)
    anchors = _anchors(vectors)
    whole = "(^|[^a-z0-9])(" + "|".join(re.escape(a) for a in anchors) + ")([^a-z0-9]|$)"
    path = F.coalesce(F.col("path"), F.lit("")).alias("path")
    lower = F.lower("text")
    held = files.select("doc_id", path, "text").where(reduce(lambda x, y: x | y, [F.contains(lower, F.lit(a)) for a in anchors]))
    lines = held.select("doc_id", "path", F.explode(F.split("text", "\n")).alias("line"))
    lower = F.lower("line")
    # A plain search leaves few lines to the pattern; what passes is small and is read twice.
    lines = lines.where(reduce(lambda x, y: x | y, [F.contains(lower, F.lit(a)) for a in anchors])).where(lower.rlike(whole))
    # Each step is written, so that no plan holds several: the driver keeps all of a plan and its code while it runs.
    lines = cut(lines.withColumn("key", F.sha2("line", 256)))
    block = cut(blocks(files.select("doc_id", path, "text")).withColumn("key", F.sha2("line", 256)))
    sets = [templates, headers, bodies]
    of = lambda rows, s, body: rows.select("doc_id", "path", s.alias("set"), "key", F.col(body).alias("body"))
    is_file = F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENSE_FILE)
    held = of(lines, F.lit(0), "line").union(of(block, F.explode(F.when(F.col("many"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))), "line"))
    held = held.union(of(files.select("doc_id", path, F.sha2("text", 256).alias("key"), "text").where(is_file & F.col("text").isNotNull()), F.lit(2), "text"))
    best = cut(_best(held.groupBy("set", "key").agg(F.first("body").alias("body")), sets, threshold))
    own = cut(_found(held, best).groupBy("doc_id", "path").agg(F.max("best").alias("best_")))
    drop(lines, block, best)
    return _inherit(files.select("doc_id", path), own, is_file)


def _inherit(files: DataFrame, own: DataFrame, is_file: Column) -> DataFrame:
    """Join each file's directory to the nearest of its ancestors, itself included, that holds a licence file with a statement in own (doc_id, path, best_)."""
    dir_ = F.regexp_replace("path", r"/?[^/]*$", "").alias("dir_")
    given = own.where(is_file).groupBy(dir_.alias("up")).agg(F.max("best_").alias("given"))
    dirs = files.select(dir_).distinct()
    part = F.split("dir_", "/")
    ups = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(part)), lambda i: F.array_join(F.slice(part, F.lit(1), i), "/")))
    near = dirs.withColumn("up", F.explode(F.array_distinct(ups))).join(given, "up")
    near = near.groupBy("dir_").agg(F.max_by(F.struct("up", "given"), F.length("up")).alias("near"))
    near = near.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    own = own.select(F.col("doc_id").alias("d_"), F.col("path").alias("p_"), "best_")
    f = files.join(own.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("path") == F.col("p_")), "left")
    salt = F.pmod(F.coalesce(F.xxhash64("doc_id", "path"), F.lit(0)), F.lit(_SALTS)).cast("int").alias("salt")
    out = f.select("doc_id", "path", "best_", dir_, is_file.alias("is_file"), salt).join(near, ["dir_", "salt"], "left")
    own = F.col("best_.license")
    kind = F.when(own.isNotNull() & F.col("is_file"), "file").when(own.isNotNull(), "header").when(F.col("near").isNotNull(), "inherited").otherwise("none")
    return out.select(
        "doc_id", "path", own.alias("own_license"), F.coalesce("best_.score", F.lit(0.0)).alias("own_score"),
        F.coalesce(own, F.col("near.given.license")).alias("license"),
        F.when(own.isNull(), F.col("near.up")).alias("license_dir"), kind.alias("kind"),
    )


def as_files(documents: DataFrame) -> DataFrame:
    """documents as a tree of files: source/lang/<doc_id div 64>/<doc_id>.txt, each 64th document (and each 1024th, for its language) a LICENSE."""
    d = F.coalesce(F.col("doc_id"), F.lit(-1))
    part = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("unknown")), "/", "_")
    top = F.concat_ws("/", part("source"), part("lang"))
    low = F.concat_ws("/", top, F.floor(d / 64).cast("string"))
    path = F.when(F.pmod(d, F.lit(1024)) == 0, F.concat(top, F.lit("/LICENSE"))).when(F.pmod(d, F.lit(64)) == 0, F.concat(low, F.lit("/LICENSE"))).otherwise(F.concat_ws("/", low, F.concat(d.cast("string"), F.lit(".txt"))))
    return documents.select("doc_id", path.alias("path"), "text")


def _oracle() -> str:
    idf, vectors, unseen = _weights(TEMPLATES)
    anchors = "|".join(re.escape(a) for a in _anchors(vectors))
    idf_rows = ", ".join(f"('{w}', {v!r}::DOUBLE)" for w, v in idf.items())
    tpl_rows = ", ".join(f"({i}, '{name}', '{w}', {x!r}::DOUBLE)" for i, (name, v) in enumerate(vectors) for w, x in v.items())
    return rf"""
WITH idf(w, idf) AS (VALUES {idf_rows}), tpl(i, license, w, x) AS (VALUES {tpl_rows}),
files AS (SELECT doc_id, coalesce(doc_id, -1) AS d, coalesce(text, '') AS text,
    replace(coalesce(source, 'unknown'), '/', '_') || '/' || replace(coalesce(lang, 'unknown'), '/', '_') AS top FROM documents),
paths AS (SELECT doc_id, text, row_number() OVER () AS rid, CASE WHEN d % 1024 = 0 THEN top || '/LICENSE' WHEN d % 64 = 0 THEN top || '/' || CAST(d // 64 AS VARCHAR) || '/LICENSE'
    ELSE top || '/' || CAST(d // 64 AS VARCHAR) || '/' || CAST(d AS VARCHAR) || '.txt' END AS path FROM files),
f AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name, regexp_replace(path, '/?[^/]*$', '') AS dir FROM paths),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM f),
picked AS (SELECT rid, line, row_number() OVER () AS lid FROM lines WHERE regexp_matches(lower(line), '(^|[^a-z0-9])({anchors})([^a-z0-9]|$)')),
words AS (SELECT rid, lid, unnest(regexp_extract_all(lower(line), '{_WORD}')) AS w FROM picked),
bags AS (SELECT rid, lid, words.w, count(*) * coalesce(any_value(idf), {unseen!r}::DOUBLE) AS x FROM words LEFT JOIN idf ON words.w = idf.w GROUP BY rid, lid, words.w),
norms AS (SELECT lid, sqrt(sum(x * x)) AS norm FROM bags GROUP BY lid),
dots AS (SELECT rid, lid, i, license, sum(bags.x * tpl.x) AS dot FROM bags JOIN tpl ON bags.w = tpl.w GROUP BY ALL),
scored AS (SELECT rid, round(dot / norm, 6) AS score, license FROM dots JOIN norms USING (lid)),
best AS (SELECT rid, max(struct_pack(score := score, license := license)) AS b FROM scored WHERE score >= {THRESHOLD} GROUP BY rid),
g AS (SELECT f.*, b, regexp_matches(name, '{LICENSE_FILE}') AS is_file FROM f LEFT JOIN best USING (rid)),
given AS (SELECT dir AS up, max(b) AS given FROM g WHERE is_file AND b IS NOT NULL GROUP BY dir),
near AS (SELECT dir, arg_max(struct_pack(up := up, given := given), length(up)) AS near FROM (SELECT DISTINCT dir FROM g) JOIN given
    ON up = dir OR up = '' OR starts_with(dir, up || '/') GROUP BY dir)
SELECT doc_id, path, b.license AS own_license, coalesce(b.score, 0.0) AS own_score, coalesce(b.license, near.given.license) AS license,
    CASE WHEN b IS NULL THEN near.up END AS license_dir,
    CASE WHEN b IS NOT NULL AND is_file THEN 'file' WHEN b IS NOT NULL THEN 'header' WHEN near IS NOT NULL THEN 'inherited' ELSE 'none' END AS kind
FROM g LEFT JOIN near USING (dir)
"""


ORACLE = _oracle()
