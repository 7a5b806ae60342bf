"""License scans: sparse TF-IDF cosine of texts' parts to license templates, then inheritance from the nearest directory.

Weights are tf * idf, with idf = ln((1 + N) / (1 + df)) + 1 over all N lines that have a word; words of no template
weigh as unseen ones. Parts of a text are its lines, its blocks (consecutive lines that aren't blank), every run of as
many words as the template has, wherever lines end, and of license files the whole text. A file's own license is the
best template over these, if its cosine reaches the threshold; where none does, own_score is that of the best line.
Files without one inherit that of the nearest ancestor directory in which a license file has one.

Only lines are scored in texts of which no part can reach the threshold: a cosine is at most the norm of the template's
words that the text holds, over the norm of the template.

Defined results: null and empty texts, and texts without a word, have no license of their own; texts of any length are
read whole; ties go to the smaller
template name; several license files in a directory: the best score, then the smaller name; a null path has no
directory and inherits nothing; repeated rows are scanned one by one; without templates nothing has a license; an empty
table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaly.llm.shared import written

THRESHOLD = 0.7
WORD = re.compile(r"[a-z0-9]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
LICENSE_FILE = r"(?i)(?:^|/)(?:licen[cs]e|copying|unlicense|notice)[^/]*$"


def words(line: str) -> list[str]:
    """Runs of a-z and 0-9, A-Z lower-cased."""
    return WORD.findall(line.translate(LOWER))


def unit_counts(files: DataFrame, text: str, vocabulary: frozenset[str]) -> tuple[int, dict[str, int]]:
    """The number of units, and for each word of the vocabulary how many units hold it."""
    shared = files.sparkSession.sparkContext.broadcast(vocabulary)  # the words of the templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found, units = shared.value, Counter(), 0
        for batch in batches:
            for x in batch.column(0):
                for line in (x.as_py() or "").split("\n"):
                    held = set(words(line))
                    units += bool(held)
                    found.update(held & known)
        rows = [("", units), *found.items()]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["word", "n"])

    summed = files.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in summed}
    return counts.pop("", 0), counts


def blocks(lines: list[str], held: list[list[str]]) -> Iterator[list[str]]:
    """The words of each run of consecutive lines that aren't blank."""
    block: list[str] = []
    for line, found in zip(lines, held):
        if line.strip():
            block += found
        elif block:
            yield block
            block = []
    if block:
        yield block


def nearest_run(text: list[str], bag: Counter, idf: dict[str, float], unseen: float) -> list[str]:
    """Of the runs of as many words as the bag has, the one with the largest cosine to it."""
    n = sum(bag.values())
    run: Counter = Counter()
    top, at, dot, square = 0.0, 0, 0.0, 0.0
    for k, word in enumerate(text):
        weight = idf.get(word, unseen) ** 2
        square += weight * (2 * run[word] + 1)
        run[word] += 1
        dot += weight * bag.get(word, 0)
        if k >= n:
            old = text[k - n]
            weight = idf.get(old, unseen) ** 2
            run[old] -= 1
            square -= weight * (2 * run[old] + 1)
            dot -= weight * bag.get(old, 0)
            if not run[old]:
                del run[old]
        if dot > 0 and dot * dot > top * square * (1 + 1e-12):
            top, at = dot * dot / square, k + 1
    return text[max(0, at - n) : at]


def own_licenses(files: DataFrame, templates: dict[str, str], keep: list[str], text: str = "text", threshold: float = THRESHOLD, whole: Column | None = None) -> DataFrame:
    """The columns keep of files with own_license and own_score (of the best template, also below the threshold). whole:
    whether a file's whole text is one of its parts."""
    bags = {name: Counter(words(t)) for name, t in sorted(templates.items()) if words(t)}
    n, df = unit_counts(files, text, frozenset(w for bag in bags.values() for w in bag))
    idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for bag in bags.values() for w in bag}
    unseen = math.log(1 + n) + 1
    norms = {name: math.sqrt(sum((k * idf[w]) ** 2 for w, k in bag.items())) for name, bag in bags.items()}
    postings: dict[str, list[tuple[str, float]]] = {}
    for name, bag in bags.items():
        for w, k in bag.items():
            postings.setdefault(w, []).append((name, k * idf[w] ** 2 / norms[name]))

    def scores(unit: list[str]) -> dict[str, float]:
        bag = Counter(unit)
        dots: dict[str, float] = {}
        for w in sorted(bag.keys() & postings.keys()):
            for name, x in postings[w]:
                dots[name] = dots.get(name, 0.0) + bag[w] * x
        if not dots:
            return dots
        norm = math.sqrt(sum((k * idf.get(w, unseen)) ** 2 for w, k in sorted(bag.items())))
        return {name: round(dots[name] / norm, 9) for name in sorted(dots)}

    def better(top: tuple[str | None, float], found: dict[str, float], least: float = 0.0) -> tuple[str | None, float]:
        for name, score in found.items():
            if score >= least and (score > top[1] or score == top[1] and top[0] is not None and name < top[0]):
                top = (name, score)
        return top

    def best(page: str, entire: bool) -> tuple[str | None, float]:
        top: tuple[str | None, float] = (None, 0.0)
        lines = page.split("\n")
        held = [words(line) for line in lines]
        for unit in held:
            top = better(top, scores(unit))
        flat = [w for unit in held for w in unit]
        there = postings.keys() & set(flat)
        able = [name for name, bag in bags.items() if math.sqrt(sum((bag[w] * idf[w]) ** 2 for w in bag.keys() & there)) >= threshold * norms[name] * (1 - 1e-8)]
        if able:
            units = [*blocks(lines, held), *(nearest_run(flat, bags[name], idf, unseen) for name in able), *([flat] if entire else [])]
            for unit in units:
                top = better(top, scores(unit), threshold)
        return top

    entire = F.lit(False) if whole is None else F.coalesce(whole, F.lit(False))
    plain = files.select(*[F.col(c) for c in keep], entire.alias("_whole"), F.col(text).alias("_scanned"))
    names = [*keep, "own_license", "own_score"]
    schema = ", ".join(f"`{c}` {plain.schema[c].dataType.simpleString()}" for c in keep) + ", own_license string, own_score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [best(x.as_py() or "", e.as_py()) for e, x in zip(*batch.columns[-2:])]
            own = [name if score >= threshold else None for name, score in found]
            yield pa.RecordBatch.from_arrays(batch.columns[:-2] + [pa.array(own, pa.string()), pa.array([s for _, s in found], pa.float64())], names=names)

    return plain.mapInArrow(run, schema)


def directory(path: Column) -> Column:
    """What stands before the last slash; empty for a file at the top."""
    return F.regexp_extract(path, r"(?s)\A(.*)/[^/]*\z", 1)


def scan_licenses(files: DataFrame, templates: dict[str, str], file_id: str = "file_id", path: str = "path", text: str = "text", threshold: float = THRESHOLD, license_file: str = LICENSE_FILE) -> DataFrame:
    """file_id, path, own_license, own_score, license, inherited_from (the directory, where inherited) for every file."""
    scanned = written(own_licenses(files, templates, [file_id, path], text, threshold, F.col(path).rlike(license_file)).withColumn("_dir", directory(F.col(path))), "licenses")
    best = F.struct(F.col("own_score").alias("s"), F.expr("transform(split(own_license, ''), c -> -ascii(c))").alias("smaller"))
    granted = scanned.where(F.col("own_license").isNotNull() & F.col(path).rlike(license_file)).groupBy(F.col("_dir").alias("_at")).agg(F.max_by("own_license", best).alias("_given"))
    # each directory looks through its ancestors once, however many files it holds
    dirs = scanned.where(F.col("_dir").isNotNull()).select("_dir").distinct()
    parts = F.split("_dir", "/")
    above = dirs.select("_dir", F.posexplode(F.transform(F.sequence(F.lit(0), F.when(F.col("_dir") == "", 0).otherwise(F.size(parts))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("_depth", "_at"))
    nearest = above.join(granted, "_at").groupBy("_dir").agg(F.max_by(F.struct("_at", "_given"), "_depth").alias("_near"))
    inherits = F.col("own_license").isNull()
    return scanned.join(nearest, "_dir", "left").select(
        file_id,
        path,
        "own_license",
        "own_score",
        F.coalesce("own_license", "_near._given").alias("license"),
        F.when(inherits, F.col("_near._at")).alias("inherited_from"),
    )
