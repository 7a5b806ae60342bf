"""Periodic runs of words, by bit-parallel lags.

The words of a text become small ids, and each bit of the ids a bit plane: one big integer with a bit for each word. For
a lag q the planes are XORed with themselves shifted by q and the results ORed: a zero says that the words q apart are
identical. ANDing the zeros with themselves, shifted by doubling steps, leaves a bit where a stretch of the wanted
length begins, so a stretch of long enough zeros stands alone.

A run is a stretch of consecutive words with smallest period q and at least max(6, 4 q) words that no neighbouring word
extends keeping the period. So its q-stretch of zeros has 3 q or more, and four words at consecutive multiples of q are
one word: lags without such a place (`_checkpoints`) have no run and their planes aren't shifted. By Fine and Wilf's
theorem a stretch of 4 q words with a smaller period p has one that divides q, and is then, ends included, the run of
that p, which was found before; checkpoints inside it are passed over.

A text is one row and stays whole in its task; nothing is shuffled. Time is about n log n for n words and one pass over
the planes for each lag that has a checkpoint; memory is a few planes.

Defined results: a null text, or one without words, has no run and keeps no word; a text of any length is read whole; a
null id only means a text that isn't edited; repeated rows give repeated results; ties among longest runs go to the
smallest start, then the smallest period; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

LEAST_WORDS = 6
LEAST_PERIODS = 4

Run = tuple[int, int, int]  # start, length, period


def bit_planes(ids: np.ndarray) -> list[int]:
    """One big integer for each bit of the ids; its bit i is that of word i."""
    bits = int(ids.max()).bit_length() if len(ids) else 0
    return [int.from_bytes(np.packbits((ids >> b) & 1, bitorder="little").tobytes(), "little") for b in range(bits)]


def matches(planes: list[int], n: int, lag: int) -> int:
    """Bit i: words i and i + lag are identical, for the n - lag first words."""
    apart = 0
    for plane in planes:
        apart |= plane ^ (plane >> lag)
    return ~apart & ((1 << (n - lag)) - 1)


def long_stretches(bits: int, length: int) -> list[tuple[int, int]]:
    """(first, end) of the maximal stretches of at least length ones in bits."""
    starts, covered = bits, 1
    while covered < length and starts:
        step = min(covered, length - covered)
        starts &= starts >> step
        covered += step
    if not starts:
        return []
    held = np.frombuffer(starts.to_bytes(starts.bit_length() // 8 + 1, "little"), np.uint8)
    edges = np.flatnonzero(np.diff(np.unpackbits(held, bitorder="little").astype(np.int8), prepend=0, append=0))
    return [(int(a), int(b) + length - 1) for a, b in zip(edges[::2], edges[1::2])]


def _checkpoints(ids: np.ndarray, lag: int) -> np.ndarray:
    """The words at multiples of lag that begin LEAST_PERIODS equal words, each a lag after the other."""
    some = ids[::lag]
    same = some[1:] == some[:-1]
    there = same[: len(same) - LEAST_PERIODS + 2]
    for k in range(1, LEAST_PERIODS - 1):
        there = there & same[k : len(same) - LEAST_PERIODS + 2 + k]
    return np.flatnonzero(there) * lag if there.any() else _NONE


_NONE = np.empty(0, np.int64)


def _outside(places: np.ndarray, runs: np.ndarray, lag: int) -> np.ndarray:
    """The checkpoints that don't lie, with all their words, in one of the runs (rows of start, length, period by
    falling length) whose period divides lag."""
    reach = (LEAST_PERIODS - 1) * lag
    some = runs[: np.searchsorted(-runs[:, 1], -reach)]
    some = some[lag % some[:, 2] == 0]
    if not len(some):
        return places
    some = some[np.argsort(some[:, 0], kind="stable")]
    ends = np.maximum.accumulate(some[:, 0] + some[:, 1])
    before = np.searchsorted(some[:, 0], places, side="right") - 1
    return places[(before < 0) | (ends[before] <= places + reach)]


def periodic_runs(ids: np.ndarray, least_words: int = LEAST_WORDS) -> list[Run]:
    """The runs of a sequence of word ids, by start, then period."""
    n = len(ids)
    found: dict[tuple[int, int], int] = {}  # (start, length): period, the smallest, as lags rise
    known = np.empty((0, 3), np.int64)
    planes = bit_planes(ids)
    for lag in range(1, n // LEAST_PERIODS + 1):
        places = _checkpoints(ids, lag)
        if len(places) and len(known):
            places = _outside(places, known, lag)
        if not len(places):
            continue
        least = max(least_words - lag, (LEAST_PERIODS - 1) * lag)
        new = [(first, end + lag - first) for first, end in long_stretches(matches(planes, n, lag), least)]
        new = [stretch for stretch in new if stretch not in found]
        if new:
            found |= dict.fromkeys(new, lag)
            known = np.array([(s, m, p) for (s, m), p in found.items()], np.int64)
            known = known[np.argsort(-known[:, 1], kind="stable")]
    return sorted(((s, m, p) for (s, m), p in found.items()), key=lambda run: (run[0], run[2]))


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Whether each of n words stays: those go that a run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def longest(runs: list[Run]) -> Run | None:
    return min(runs, key=lambda run: (-run[1], run[0], run[2]), default=None)


def looped(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Words of a document with a loop planted by the checksum of its id, for one document in ten."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


FIELDS = (("n_words", "long"), ("n_runs", "long"), ("start", "long"), ("length", "long"), ("period", "long"), ("exponent_milli", "long"), ("runs_sha256", "string"), ("collapsed_sha256", "string"))


def summary(words: list[bytes]) -> tuple:
    """FIELDS of one text's words."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    runs = periodic_runs(ids)
    best = longest(runs)
    keep = kept_words(len(words), runs)
    collapsed = b" ".join(w for w, k in zip(words, keep.tolist()) if k) if runs else b" ".join(words)
    listed = "".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()
    milli = 1000 * best[1] // best[2] if best else None
    return len(words), len(runs), *(best or (None,) * 3), milli, hashlib.sha256(listed).hexdigest(), hashlib.sha256(collapsed).hexdigest()


def run_summaries(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", edit: Callable[[list[bytes], int | None], list[bytes]] | None = None) -> DataFrame:
    """doc_id and FIELDS for every row of docs; edit may change the words before. bytes.split() splits at exactly x20 and
    x09-x0D."""
    plain = docs.select(docs[doc_id], docs[text])
    out = T.StructType([plain.schema[0], *(T.StructField(name, T.LongType() if kind == "long" else T.StringType()) for name, kind in FIELDS)])
    kinds = [pa.int64() if kind == "long" else pa.string() for _, kind in FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = []
                for i, x in zip(batch.column(0), batch.column(1)):
                    words = (x.as_py() or "").encode("utf-8", "surrogatepass").split()
                    rows.append(summary(edit(words, i.as_py()) if edit else words))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(zip(*rows), kinds))], names=out.names)

    return plain.mapInArrow(run, out)
