"""Quality rules with host-level verdicts.

Every document is measured over its whole text, the base rule fails it or not, failures are counted by host, each
host's failure rate is shrunk towards a beta prior fitted to all hosts by moments, and a host whose shrunk rate is
above a limit loses its remaining documents too.

Defined results: a null text counts as no words (and so fails the base rule); rows with a null host form no host and
are judged by the base rule alone; repeated rows are measured and counted one by one; texts of any length are measured whole; an empty table gives an empty
result; columns of the input named like a measure are replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessaly.llm.shared import small, written

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
WHITE = "\t\n\x0b\x0c\r "
#: Hosts lose their remaining documents above this shrunk rate of failures: almost all that is known of them is bad.
HOST_FAIL_RATE = 0.8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def window_ranks(words: list[bytes], window: int = WINDOW) -> np.ndarray:
    """An integer for each window of words; equal windows, and only those, get equal integers. window: a power of two.

    The rank of a window of 2k words is the rank of the pair of its halves' ranks, so no hash can collide.
    """
    seen: dict[bytes, int] = {}
    ranks = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    k = 1
    while k < window and len(ranks) > k:
        pairs = ranks[:-k] * (int(ranks.max()) + 1) + ranks[k:]
        ranks = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        k *= 2
    return ranks if k == window else ranks[:0]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more in words."""
    if len(words) <= window:
        return 0
    ranks = window_ranks(words, window)
    again = np.flatnonzero(np.bincount(ranks)[ranks] > 1)
    if not len(again):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + window, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:-1]))


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """MEASURES of one text. bytes.split() splits at exactly x20 and x09-x0D."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - sum(text.count(c) for c in WHITE),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def measured(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns keep) with MEASURES; one pass over the texts, no shuffle."""
    columns = [c for c in (docs.columns if keep is None else keep) if c not in MEASURES]
    plain = docs.select(*[docs[c] for c in columns], docs[text].alias("_measured_text"))
    out = T.StructType([f for f in plain.schema.fields if f.name != "_measured_text"] + [T.StructField(m, T.LongType()) for m in MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            sides = list(zip(*found)) if found else [()] * len(MEASURES)
            arrays = batch.columns[:-1] + [pa.array(x, pa.int64()) for x in sides]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in out.fields])

    return plain.mapInArrow(run, out)


def base_rule():
    """The base rule as a Column over the measures."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def host_verdicts(judged: DataFrame, host: str, limit: float = HOST_FAIL_RATE) -> DataFrame:
    """(host, host_rate, host_failed) from judged (host, base_failed): one row for each host.

    The prior is Beta(a, b) with the mean of all rows and the hosts' spread beyond the binomial one (method of
    moments); without such spread, or with a single host, the prior weighs as much as one host of mean size.
    """
    hosts = judged.where(F.col(host).isNotNull()).groupBy(host).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("base_failed").cast("double")).alias("f"))
    total = hosts.agg(
        (F.sum("f") / F.sum("n")).alias("m"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"), F.sum(F.col("f") * F.col("f") / F.col("n")).alias("ff")
    )
    # between = sum n (p - m)^2; its expectation is (k - 1) m (1 - m) + (s - q / s) (v - within share)
    between = F.col("ff") - F.col("s") * F.col("m") * F.col("m")
    spread = F.col("m") * (1 - F.col("m"))
    room = F.col("s") - F.col("q") / F.col("s")
    rho = F.when((room > 0) & (spread > 0), (between - (F.col("k") - 1) * spread) / F.nullif((room - (F.col("k") - 1)) * spread, F.lit(0.0)))
    weight = F.when((rho > 0) & (rho < 1), (1 - rho) / rho).otherwise(F.col("s") / F.nullif(F.col("k"), F.lit(0)))
    prior = total.select("m", weight.alias("w"))
    rate = (F.col("f") + F.col("m") * F.col("w")) / (F.col("n") + F.col("w"))
    return hosts.crossJoin(F.broadcast(prior)).select(host, rate.alias("host_rate"), (rate > limit).alias("host_failed"))  # prior: one row


def quality_verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, MEASURES, base_failed, host_rate, kept: a row for each row of docs, without the texts."""
    judged = written(measured(docs, text, [doc_id, host]).withColumn("base_failed", base_rule()), "quality")
    hosts = written(host_verdicts(judged, host), "hosts")
    return judged.join(small(hosts, hosts.count(), 256), host, "left").select(
        doc_id, *MEASURES, "base_failed", "host_rate", (~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False))).alias("kept")
    )


def quality_kept(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of docs that both rules keep. Texts are measured twice and never shuffled while the failed hosts fit a broadcast."""
    judged = measured(docs, text, [host]).withColumn("base_failed", base_rule())
    failed = written(host_verdicts(judged, host).where("host_failed").select(F.col(host).alias("_failed_host")), "failed-hosts")
    good = measured(docs, text).where(~base_rule()).select(*docs.columns)
    rows = failed.count()
    if not rows:
        return good
    side = small(failed, rows, 256)
    return good.join(side, good[host] == side["_failed_host"], "left_anti")
