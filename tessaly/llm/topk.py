"""Exact top-k inner products over norm-sorted blocks.

Vectors are rotated by the singular vectors of the whole table and dealt by descending length into blocks of bounded
size; queries meet blocks in tasks of their own. The longest candidates come first and give every query a score to beat;
then come rounds of ever more blocks, after each of which that score rises, and a block is sent only to those queries
whose length times its own can still reach it. Inside a block candidates go by descending length, too: partial inner
products over the first rotated components (CUTS) plus the product of the two residual lengths (Cauchy-Schwarz) bound a
score, pairs whose bound can't reach the query's score to beat fall out after each cut, and only the pairs left are
scored. Scores are exact integers, by float64 products while these are exact and by Python integers beyond.

Defined results: vectors that are null or empty, hold a null or non-finite component, or have a null id take no part;
missing components of shorter vectors count as 0; every row is a candidate and repeated rows are ranked one by one, but
rows with the query's own id are its own and left out; ties go to the smaller id; scores beyond 64 bits are kept at its ends; with no query or no
candidate the result is empty; vectors of any length are multiplied whole; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaly.llm.shared import small, written

CANDIDATE_BLOCK = 4096
QUERY_BLOCK = 1024
#: Candidates that meet the queries at once, and the numbers of rotated components after which pairs are dropped.
STEP = 512
CUTS = (4, 16, 32)
#: Of the pairs of some queries and candidates, the part up to which those alive are scored one by one.
SPARSE = 0.1
#: Components below this give products and sums that float64 holds exactly (up to 2**11 components).
EXACT = 2**21


def integer_vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and v, the components floor(scale * x), of the vectors that take part."""
    x = F.col(embedding)
    sound = x.isNotNull() & (F.size(x) > 0) & F.col(vec_id).isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    # a double beyond 2**53 is whole already, and its floor may not fit a bigint
    whole = F.transform(F.transform(x, lambda e: scale * e.cast("double")), lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y))
    return table.where(sound).select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("v"))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Columns: the right singular vectors of the table, by descending singular value. Each task sums its own
    width x width products; the sums are small whatever the number of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for rows in batches:
            m = _matrix(rows["v"], width)
            m /= max(1.0, np.abs(m).max(initial=0.0))
            total += m.T @ m
        yield pd.DataFrame({"i": np.repeat(np.arange(width), width), "j": np.tile(np.arange(width), width), "s": total.ravel()})

    sums = vectors.mapInPandas(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow().to_pandas()
    gram = np.zeros((width, width))
    gram[sums["i"], sums["j"]] = sums["s"]
    return np.linalg.eigh(gram)[1][:, ::-1].copy()


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of q with the rows of x."""
    if max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) < EXACT:
        return (q @ x.T).astype(np.int64)
    to_int = np.vectorize(int, otypes=[object])
    product = to_int(q).dot(to_int(x).T)
    return np.clip(product, -(2**63), 2**63 - 1).astype(np.int64)


def pair_scores(q: np.ndarray, x: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Integer inner products of q[rows[i]] with x[columns[i]]."""
    some, these = np.unique(rows, return_inverse=True)
    others, those = np.unique(columns, return_inverse=True)
    if len(rows) > SPARSE * len(some) * len(others) or max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) >= EXACT:
        return exact_scores(q[some], x[others])[these, those]
    out = np.empty(len(rows), np.int64)
    for at in range(0, len(rows), 50_000):
        part = slice(at, at + 50_000)
        out[part] = np.einsum("ij,ij->i", q[rows[part]], x[columns[part]]).astype(np.int64)
    return out


def alive(rq: np.ndarray, rx: np.ndarray, floor: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the pairs whose bound reaches the row's floor, and of those only where other is true."""
    rows, columns, width = np.arange(len(rq)), np.arange(len(rx)), rq.shape[1]
    slack = 1e-9 * np.sqrt((rq**2).sum(1))[:, None] * np.sqrt((rx**2).sum(1))[None, :] + 1e-6  # for rounding
    sums, live, done = np.zeros((len(rq), len(rx))), other, 0
    for cut in (0, *(c for c in CUTS if c < width)):
        a, b = rq[rows], rx[columns]
        sums = sums + a[:, done:cut] @ b[:, done:cut].T
        rest = np.sqrt((a[:, cut:] ** 2).sum(1))[:, None] * np.sqrt((b[:, cut:] ** 2).sum(1))[None, :]
        live = live & (sums + rest + slack[np.ix_(rows, columns)] >= floor[rows][:, None])
        keep, stay = live.any(axis=1), live.any(axis=0)
        rows, columns, sums, live, done = rows[keep], columns[stay], sums[np.ix_(keep, stay)], live[np.ix_(keep, stay)], cut
    i, j = np.nonzero(live)
    return rows[i], columns[j]


def best_of(queries: pd.DataFrame, block: pd.DataFrame, basis: np.ndarray, k: int, scored: list[int] | None = None) -> pd.DataFrame:
    """For each query its k best of the block, as far as they can reach the query's floor (a score, or null). scored
    gets the number of pairs that were scored."""
    width = basis.shape[0]
    q, x = _matrix(queries["v"], width), _matrix(block["v"], width)
    length = np.sqrt((x**2).sum(1))
    order = np.argsort(-length, kind="stable")
    x, ids, length = x[order], block["vec_id"].to_numpy()[order], length[order]
    rq, own, reach = q @ basis, queries["vec_id"].to_numpy(), np.sqrt((q**2).sum(1))
    floor = queries["floor"].to_numpy(float, na_value=-np.inf).copy()
    top = pd.DataFrame({"i": [], "vec_id": [], "score": []}).astype("int64")
    for at in range(0, len(x), STEP):
        if not (reach * length[at] * (1 + 1e-9) + 1 >= floor).any():
            break  # nor can any shorter one
        part = slice(at, at + STEP)
        rows, columns = alive(rq, x[part] @ basis, floor, own[:, None] != ids[part][None, :])
        if scored is not None:
            scored.append(len(rows))
        found = pd.DataFrame({"i": rows, "vec_id": ids[part][columns], "score": pair_scores(q, x[part], rows, columns)})
        found = found[found["score"] >= floor[rows]]
        top = pd.concat([top, found]).sort_values(["i", "score", "vec_id"], ascending=[True, False, True]).groupby("i", sort=False).head(k)
        last = top.groupby("i")["score"].agg(["size", "min"])
        last = last[last["size"] == k]
        floor[last.index] = np.maximum(floor[last.index], last["min"])
    i = top["i"].to_numpy(np.int64)
    return pd.DataFrame({"query_id": own[i], "query_row": queries["row"].to_numpy()[i], "vec_id": top["vec_id"].to_numpy(np.int64), "score": top["score"].to_numpy(np.int64)})


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the vectors (vec_id, v) that is_query marks, against all of them."""
    spark = vectors.sparkSession
    vectors = written(vectors, "vectors")
    width, rows = vectors.agg(F.max(F.size("v")), F.count(F.lit(1))).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not rows:
        return empty
    basis = spark.sparkContext.broadcast(rotation(vectors, width))  # width x width, whatever the rows
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e))
    blocks = max(1, -(-rows // candidate_block))
    # equal lengths are split by the hash of their ids
    dealt = vectors.repartitionByRange(blocks, length.desc(), F.xxhash64("vec_id")).select("vec_id", "v", F.spark_partition_id().alias("block"))
    dealt = written(dealt, "blocks")
    queries = vectors.where(is_query).select("vec_id", "v", F.monotonically_increasing_id().alias("row"))
    queries = written(queries.withColumn("length", length), "queries")
    parts = max(1, -(-queries.count() // query_block))

    def run(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = [best_of(asked, block.iloc[i : i + candidate_block], basis.value, k) for i in range(0, len(block), candidate_block)] if len(asked) else []
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "query_row": [], "vec_id": [], "score": []}).astype("int64")

    def best(found: DataFrame) -> DataFrame:
        """With the rank; Spark keeps only k rows of a query before it shuffles."""
        order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    # a row for each block of candidate_block rows
    numbers = written(dealt.groupBy("block").agg(F.max(length).alias("longest")), "numbers")
    n_blocks, top = numbers.agg(F.count(F.lit(1)), F.min("block")).first()
    found, at, size = None, top, 1
    while at < top + max(n_blocks, blocks):
        if found is None:
            asked = queries.withColumn("floor", F.lit(None).cast("double")).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
        else:
            floors = found.where(F.col("rank") == k).select("query_row", F.col("score").cast("double").alias("floor"))
            asked = queries.join(floors, queries["row"] == floors["query_row"], "left").drop("query_row")
            # queries that need candidates of about the same length share a part
            asked = asked.repartitionByRange(parts, F.col("floor") / F.col("length"), "row").withColumn("part", F.spark_partition_id())
        asked = written(asked, "asked")
        there = numbers.where(F.col("block").between(at, at + size - 1))
        able = asked.join(small(there, min(size, n_blocks)), F.col("floor").isNull() | (F.col("length") * F.col("longest") * (1 + 1e-9) + 1 >= F.col("floor")))
        able = written(able.select("row", "part", "block", "v", "vec_id", "floor"), "able")
        meets = able.select(F.col("part").alias("to"), "block").distinct()
        sent = dealt.where(F.col("block").between(at, at + size - 1)).join(meets, "block")
        more = able.groupBy("part", "block").cogroup(sent.groupBy("to", "block")).applyInPandas(run, "query_id long, query_row long, vec_id long, score long")
        found = written(best(more if found is None else found.drop("rank").unionByName(more)), "found")
        at, size = at + size, 3 * size
    return found.select("query_id", "rank", "vec_id", "score")
