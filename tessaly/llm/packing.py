"""Best-fit packing by sums of squares.

Every document becomes token pieces of at most one sequence; the pieces are dealt by hash into groups of bounded size,
and in each group a piece goes, longest first, where the sum over gaps g of N(g)^2 becomes smallest, N(g) being the
number of open bins with g tokens left.

Defined results: a null or empty text is its closing id alone; an empty table gives an empty result; repeated rows are
packed one by one; pieces of equal length go in any order; texts of any length are encoded whole, and longer documents
than a sequence are cut so that only the first piece is shorter than a sequence; extra columns of the input don't matter.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaly.llm.bpe import PRE_TOKEN, byte_pairs
from tessaly.llm.shared import written

CAPACITY = 2048
#: About so many pieces are packed together by one task; each group may end with one bin more than it needs.
GROUP_PIECES = 50_000


#: Texts with such runs go to the own coder, whose time doesn't grow with the square of a run.
LONG_RUN = re.compile(r"\S{1000}|\s{100}")


class Ids:
    """Ids of whole texts as the tokenizers library gives them for a tokenizer file: by tiktoken over the file's own
    vocabulary, which is several times faster, where the file's merges are in the order of their ids; else, and for long
    runs, by bpe.BytePairs."""

    def __init__(self, path: str):
        self.own = byte_pairs(path)
        ranks = {b: i for i, b in self.own.bytes_of.items() if i not in self.own.added.values()}
        sound = all(a < b for a, b in pairwise(self.own.into)) and len(ranks) == max(ranks.values()) + 1
        self.fast = tiktoken.Encoding("ids", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens=self.own.added) if sound else None

    def encode(self, text: str) -> bytes:
        if self.fast is None or LONG_RUN.search(text):
            return self.own.encode(text)
        return np.array(self.fast.encode(text, allowed_special="all"), "<u4").tobytes()


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    return Ids(path)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document of n tokens: whole sequences, and before them what is left over."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def token_pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for every piece of every document."""
    schema = f"{doc_id} {docs.schema[doc_id].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ids_of(path)
        for batch in batches:
            rows = []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = coder.encode(value.as_py() or "") + end
                for piece, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    rows.append((doc, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            sides = list(zip(*rows)) if rows else [()] * 5
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(sides, kinds)], names=[doc_id, "piece", "start", "length", "ids_crc32"])

    return docs.select(doc_id, text).mapInArrow(run, schema)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each size, in the given order: its bin and its offset there.

    A bin of gap g that takes a piece of size s changes the sum of squares by 2 (N(g - s) - N(g)) + 2, a new one by
    2 N(capacity - s) + 1, and one that becomes full by 1 - 2 N(s); gap 0 counts as closed. A new bin competes with the
    open ones only while there are fewer than all sizes need; later one is opened only for a piece that fits nowhere.
    """
    needed = -(-int(sizes.sum()) // capacity)
    count = np.zeros(capacity + 1, np.int64)
    open_bins: dict[int, list[int]] = defaultdict(list)
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    fill: list[int] = []
    for i, s in enumerate(sizes.tolist()):
        best, gap = None, capacity
        if count[s]:
            best, gap = 1 - 2 * int(count[s]), s
        have = np.flatnonzero(count[s + 1 : capacity])  # gaps that are left over, less s + 1
        if len(have):
            change = 2 * (count[have + 1] - count[have + s + 1]) + 2
            k = int(change.argmin())
            if best is None or change[k] < best:
                best, gap = int(change[k]), int(have[k]) + s + 1
        fresh = 2 * int(count[capacity - s]) + 1 if s < capacity else 0
        if best is None or len(fill) < needed and fresh <= best:
            place = len(fill)
            fill.append(0)
        else:
            place = open_bins[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = place, fill[place]
        fill[place] += s
        if left := capacity - fill[place]:
            open_bins[left].append(place)
            count[left] += 1
    return bins, offsets


def packed(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """pieces (with a column length) with sequence_id and offset. Pieces of full length are sequences of their own and
    don't move; the others are dealt by hash into groups of about group_pieces, longest first in each."""
    full = pieces.where(F.col("length") == capacity).select("*", (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-short.count() // group_pieces))
    dealt = short.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("length", ascending=False, kind="stable")
        bins, offsets = sum_of_squares(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=2 * ((rows["_group"].to_numpy() << 32) + bins), offset=offsets).drop(columns="_group")

    return full.unionByName(dealt.groupBy("_group").applyInPandas(pack, full.schema))


def pack_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    return packed(written(token_pieces(docs, path, doc_id, text, end_id, capacity), "pieces"), capacity)
