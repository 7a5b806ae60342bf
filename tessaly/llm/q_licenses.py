"""op5: the license of every document, its own or its directory's.

The documents table has no paths, so files are laid out by source and id: a LICENSE file for every 50th id in its
directory, and for every 1000th id one directory higher.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaly.llm.licenses import THRESHOLD, scan_licenses

TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = F.concat("source", F.lit("/"), F.expr("doc_id div 1000"), F.lit("/"))
    deep = F.concat(top, F.expr("doc_id div 50 % 20"), F.lit("/"))
    path = F.when(F.col("doc_id") % 1000 == 0, F.concat(top, F.lit("LICENSE"))).when(F.col("doc_id") % 50 == 0, F.concat(deep, F.lit("LICENSE")))
    files = docs.select("doc_id", F.coalesce(path, F.concat(deep, "doc_id", F.lit(".txt"))).alias("path"), "text")
    found = scan_licenses(files, TEMPLATES, file_id="doc_id")
    return found.select("doc_id", "path", "own_license", F.round("own_score", 6).alias("own_score"), "license", "inherited_from")


QUERIES = {"op5_license_scan": op5_license_scan}

_ROWS = ", ".join("('{}', '{}')".format(k, v) for k, v in TEMPLATES.items())
ORACLE_SQL = {
    "op5_license_scan": rf"""
WITH f AS (
  SELECT doc_id, text, source || '/' || (doc_id // 1000) || '/' AS top, source || '/' || (doc_id // 1000) || '/' || (doc_id // 50 % 20) || '/' AS deep FROM documents),
p AS (SELECT doc_id, text, CASE WHEN doc_id % 1000 = 0 THEN top || 'LICENSE' WHEN doc_id % 50 = 0 THEN deep || 'LICENSE' ELSE deep || doc_id || '.txt' END AS path FROM f),
up(a, b) AS (VALUES ('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')),
l AS (SELECT doc_id, row_number() OVER () AS u, regexp_extract_all(translate(line, a, b), '[a-z0-9]+') AS ws
      FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM p), up),
w AS (SELECT doc_id, u, word, count(*) AS tf FROM (SELECT doc_id, u, unnest(ws) AS word FROM l WHERE len(ws) > 0) GROUP BY ALL),
t AS (SELECT name, word, count(*) AS tf FROM (SELECT name, unnest(regexp_extract_all(translate(txt, a, b), '[a-z0-9]+')) AS word FROM (VALUES {_ROWS}) v(name, txt), up) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM l WHERE len(ws) > 0),
df AS (SELECT word, count(*) AS df FROM w WHERE word IN (SELECT word FROM t) GROUP BY word),
idf AS (SELECT DISTINCT t.word, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS idf FROM t LEFT JOIN df ON df.word = t.word, n),
tn AS (SELECT name, sqrt(sum(power(tf * idf, 2))) AS norm FROM t JOIN idf ON idf.word = t.word GROUP BY name),
wn AS (SELECT doc_id, u, sqrt(sum(power(tf * coalesce(idf, ln(1 + n) + 1), 2))) AS norm FROM w LEFT JOIN idf ON idf.word = w.word, n GROUP BY doc_id, u),
d AS (SELECT w.doc_id, w.u, t.name, sum(w.tf * t.tf * idf * idf) AS dot FROM w JOIN t ON t.word = w.word JOIN idf ON idf.word = w.word GROUP BY ALL),
s AS (SELECT d.doc_id, d.name, round(dot / tn.norm / wn.norm, 9) AS score FROM d JOIN tn ON tn.name = d.name JOIN wn ON wn.u = d.u),
b AS (SELECT doc_id, name, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, name) AS k FROM s) WHERE k = 1),
o AS (SELECT p.doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, CASE WHEN score >= {THRESHOLD} THEN name END AS own, coalesce(score, 0) AS score FROM p LEFT JOIN b ON b.doc_id = p.doc_id),
g AS (SELECT dir, own FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY score DESC, own) AS k FROM o WHERE own IS NOT NULL AND path LIKE '%/LICENSE') WHERE k = 1),
h AS (SELECT o.doc_id, g.dir, g.own, row_number() OVER (PARTITION BY o.doc_id ORDER BY length(g.dir) DESC) AS k FROM o JOIN g ON o.dir = g.dir OR starts_with(o.dir, g.dir || '/'))
SELECT o.doc_id, path, o.own AS own_license, round(score, 6) AS own_score, coalesce(o.own, h.own) AS license, CASE WHEN o.own IS NULL THEN h.dir END AS inherited_from
FROM o LEFT JOIN h ON h.doc_id = o.doc_id AND h.k = 1
"""
}
