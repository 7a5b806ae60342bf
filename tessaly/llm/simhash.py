"""SimHash fingerprints, and a search of all fingerprints within a Hamming radius by permuted block tables.

Terms are n-grams of WIDTH words with A-Z lower-cased; a term that occurs c times weighs 1 + floor(log2 c). A term's hash
gives BITS signs, each term votes with its weight, and a bit of the fingerprint is the sign of its votes; even votes are
settled by the signs of the term with the smallest hash. The part p of the bits in which two fingerprints differ
estimates the angle between the texts' weighted terms, so their likeness is cos(pi p), and 0 for angles beyond a right
one: about 0 for unrelated texts, 1 for equal ones.

The search cuts fingerprints into BLOCKS blocks. Table t holds all fingerprints with block t moved to the front, as the
key. Two fingerprints that differ in at most `radius` bits differ in at most radius // BLOCKS of them in some block, so a
query looks up its own block, and the blocks that differ from it in so many bits, in each table. A pair is taken in the
first table that brings it together, and checked over all bits. Fingerprints are distinct when they meet: copies are
counted, not joined.

Where a document is compared with the next one, documents are dealt by range of their ids and sorted, one shuffle of the
texts; each task hands the first text and the last to a small table (two rows a task), by which tasks are joined up.

Defined results: a null text is empty; texts without words have the fingerprint 0, so they are alike to each other; texts
of fewer words than WIDTH are one term; a text of any length is read whole; ids go down, null ids come last, and rows that
share an id follow each other by the checksum of their text; repeated rows are documents of their own; the only row of a
table is its own next; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessaly.llm.bpe import Remembered
from tessaly.llm.shared import small, written

WIDTH = 5
BITS = 256
BLOCKS = 8
BLOCK_BITS = BITS // BLOCKS
#: Equal but for one bit in some block, at least.
RADIUS = 2 * BLOCKS - 1
#: Terms whose signs are held at once.
TERMS = 255 * 32
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)

_words = Remembered(xxhash.xxh3_64_intdigest)


def weighted_terms(text: str, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit hashes of the distinct terms of a text, and their weights. bytes.split() splits at exactly x20 and
    x09-x0D, and bytes.lower() lowers exactly A-Z."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))] if words else [], np.uint64), np.ones(min(1, len(words)), np.int64)
    each = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(words) - width + 1
    mixed = np.zeros(n, np.uint64)
    for i in range(width):
        mixed = (mixed ^ each[i : i + n]) * _ODD[i % len(_ODD)]
        mixed ^= mixed >> np.uint64(32)
    terms, counts = np.unique(mixed, return_counts=True)
    return terms, np.frexp(counts)[1].astype(np.int64)  # the exponent of c is 1 + floor(log2 c)


def signs(terms: np.ndarray) -> np.ndarray:
    """BITS bits for each term, 0 or 1."""
    words = (terms[:, None] ^ _ODD[None, :]) * _ODD[0]
    words = (words ^ (words >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    words = (words ^ (words >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    words ^= words >> np.uint64(31)
    return np.unpackbits(words.view(np.uint8), axis=1)


def fingerprint(text: str | None, width: int = WIDTH) -> bytes:
    terms, weights = weighted_terms(text or "", width)
    if not len(terms):
        return bytes(BITS // 8)
    ones = np.zeros(BITS, np.int64)
    for level in range(int(weights.max())):
        some = terms[weights > level]
        for at in range(0, len(some), TERMS):
            bits = signs(some[at : at + TERMS])
            whole = len(bits) // 255 * 255
            ones += bits[:whole].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.uint8)
    votes = 2 * ones - int(weights.sum())
    return np.packbits((votes > 0) | ((votes == 0) & (signs(terms[:1])[0] == 1))).tobytes()


def likeness(one: bytes, other: bytes) -> float:
    apart = (int.from_bytes(one) ^ int.from_bytes(other)).bit_count()
    return max(0.0, float(np.cos(np.pi * apart / BITS))) if 2 * apart < BITS else 0.0


FIELDS = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
_KINDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(text: str, mark: bytes, following: str, following_mark: bytes, width: int) -> tuple:
    """FIELDS of a text, and the text that follows it."""
    cut = len(text) // 2
    edited = text[: len(text) - cut] + following[:cut]
    edited_mark = mark if edited == text else fingerprint(edited, width)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return len(text), digest, mark.hex(), edited_mark.hex(), likeness(mark, edited_mark), likeness(mark, following_mark)


def compared_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id and FIELDS of every document: its fingerprint, that of its text with the last half of the code points
    replaced by the first as many of the next document's, by descending doc_id, and their likeness; the last document's
    next is the first."""
    kind = docs.schema[doc_id].dataType.simpleString()
    plain = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    order = [F.desc_nulls_last("doc_id"), F.xxhash64("text")]
    names = ["doc_id", *FIELDS, "task", "role", "text"]
    types = [pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, before = TaskContext.get().partitionId(), None
        for whole in batches:
            id_type = whole.column(0).type
            for at in range(0, whole.num_rows, 256):
                batch, ids, rows = whole.slice(at, 256), [], []
                for i, x in zip(batch.column(0), batch.column(1)):
                    now = (i, x.as_py(), fingerprint(x.as_py(), width))
                    if before is None:
                        ids.append(i)
                        rows.append((None, None, now[2].hex(), None, None, None, task, "first", now[1]))
                    else:
                        ids.append(before[0])
                        rows.append((*_compared(before[1], before[2], now[1], now[2], width), task, None, None))
                    before = now
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py() for i in ids], id_type), *(pa.array(c, k) for c, k in zip(zip(*rows), types))], names=names)
        if before is not None:
            last = (None, None, before[2].hex(), None, None, None, task, "last", before[1])
            yield pa.RecordBatch.from_arrays([pa.array([before[0].as_py()], id_type), *(pa.array([c], k) for c, k in zip(last, types))], names=names)

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_compared(x, bytes.fromhex(m), y, bytes.fromhex(k), width) for x, m, y, k in zip(*(c.to_pylist() for c in batch.columns[1:]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), types))], names=names[: 1 + len(FIELDS)])

    found = plain.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, f"doc_id {kind}, {_KINDS}, task int, role string, text string")
    found = written(found, "fingerprints")
    first = found.where("role = 'first'").select(F.col("task").alias("next_task"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    # a row for each task, whatever the number of documents
    everyone = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = found.where("role = 'last'").select("task", F.coalesce(F.lead("task").over(Window.orderBy("task")), F.min("task").over(everyone)).alias("next_task"))
    ends = found.where("role = 'last'").join(following, "task").join(first, "next_task").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")
    return found.where("role IS NULL").select("doc_id", *FIELDS).unionByName(ends.mapInArrow(join_up, f"doc_id {kind}, {_KINDS}"))


def _longs(mark):
    """A hexadecimal fingerprint as its blocks, each a long."""
    return F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda t: F.conv(F.substring(mark, t * (BLOCK_BITS // 4) + 1, F.lit(BLOCK_BITS // 4)), 16, 10).cast("long"))


def within_radius(queries: DataFrame, marks: DataFrame, radius: int = RADIUS, fingerprint: str = "fingerprint") -> DataFrame:
    """fingerprint, other, apart: for each distinct fingerprint of queries all distinct ones of marks, itself among them,
    that differ from it in at most radius bits, and the number of these. Null fingerprints take no part."""
    flips = [sum(1 << b for b in some) for k in range(radius // BLOCKS + 1) for some in combinations(range(BLOCK_BITS), k)]

    def blocks(df: DataFrame, name: str, changes: list[int]) -> DataFrame:
        some = df.where(F.col(fingerprint).isNotNull()).select(F.col(fingerprint).alias(name)).distinct()
        some = some.select(name, F.posexplode(_longs(F.col(name))).alias("t", "block"))
        if len(changes) == 1:
            return some
        return some.select(name, "t", F.explode(F.transform(F.array(*map(F.lit, changes)), lambda x: x.cast("long").bitwiseXOR(F.col("block")))).alias("block"))

    bits = F.zip_with(_longs(F.col("mine")), _longs(F.col("other")), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(bits, F.lit(0), lambda s, x: s + x)
    # no earlier table brings the pair together
    first = ~F.exists(F.slice(bits, F.lit(1), F.col("t")), lambda x: x <= radius // BLOCKS)
    # a query has many keys, which Spark's size estimates don't count: never broadcast
    met = blocks(queries, "mine", flips).hint("merge").join(blocks(marks, "other", [0]), ["t", "block"]).where((apart <= radius) & first)
    return met.select(F.col("mine").alias("fingerprint"), "other", apart.alias("apart"))


def counted_within(found: DataFrame, chosen, radius: int = RADIUS) -> DataFrame:
    """found (doc_id, fingerprint and more) with n_within: for rows that chosen (a Column) holds for, the number of other
    rows whose fingerprints differ from its own in at most radius bits; else null."""
    copies = found.groupBy(F.col("fingerprint").alias("other")).agg(F.count(F.lit(1)).alias("copies"))
    near = within_radius(found.where(chosen), found, radius).join(copies, "other")
    n = written(near.groupBy(F.col("fingerprint").alias("mine")).agg((F.sum("copies") - 1).alias("n_within")), "within")
    rows = found.join(small(n, n.count(), BITS // 4 + 24), F.col("fingerprint") == F.col("mine"), "left").drop("mine")
    return rows.withColumn("n_within", F.when(chosen, F.col("n_within")))
