"""Streams whose state expires: caches by time to live, and blocked domains with hashes that are forgotten.

State lives in the state store (RocksDB), a row for a key or a group of keys that travels with their rows, so Python asks
nothing of the JVM while it works; timeouts on event time remove what is older than the time to live once the watermark has passed it. Rows of one key are
taken in the order of time and tie within a trigger; across triggers, what is older than the watermark is late.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How long scraped content and discovered URLs stay in their caches.
SCRAPE_HOURS, DISCOVERY_HOURS = 24, 7 * 24
#: Kinds that pandas turns into doubles beside nulls.
WHOLE = ("tinyint", "smallint", "int", "bigint")
#: How a key is written as JSON that no other key has.
EXACT = {"ignoreNullFields": "false", "timeZone": "UTC", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """State in RocksDB, beside the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def cache_fetches(stream: DataFrame, keys: list[str], time: str, tie: str, hours: int, late: str = "1 hour", groups: int = 2048) -> DataFrame:
    """The rows (keys, time, tie) that a cache with a time to live misses: those that fetch anew. A row that finds an
    entry younger than hours is a hit and doesn't renew it. Rows without a time take no part. Keys are dealt by hash to
    groups, as a call of Python for each key takes many times as long as its rows; a group's state is the time of the last
    fetch of each of its keys, less what the watermark has passed the end of. The number of groups holds for a stream's life."""
    use_state_store(stream.sparkSession)
    names, ttl = [*keys, time, tie], hours * 3600 * 10**6
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    # whole numbers travel as text, which nulls leave as it is
    sent = {n: "string" if kinds[n] in WHOLE else kinds[n] for n in names}

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts = list(batches)
        batch = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        at, whose, ties = batch["at_micros"].to_numpy(), batch["at_key"].to_numpy(), batch["at_tie"]
        order = np.lexsort((ties if ties.dtype != object else ties.rank(method="dense", na_option="bottom"), at))
        fetched = state.get[0] if state.exists else {}
        taken = []
        for n, now, who in zip(order.tolist(), at[order].tolist(), whose[order].tolist()):
            last = fetched.get(who)
            if last is None or now >= last + ttl:
                taken.append(n)
                fetched[who] = now
        passed = state.getCurrentWatermarkMs() * 1000
        if fetched := {who: last for who, last in fetched.items() if last + ttl > passed}:
            state.update((fetched,))
            state.setTimeoutTimestamp(-(-(max(fetched.values()) + ttl) // 1000))
        elif state.exists:
            state.remove()
        if taken:
            yield batch.iloc[taken][names]

    # grouping takes -0.0 and 0.0 as equal, JSON doesn't
    same = [(F.col(k) + F.lit(0.0)).alias(k) if kinds[k] in ("float", "double") else F.col(k) for k in keys]
    order = F.coalesce(F.col(tie).cast("long"), F.lit(2**63 - 1)) if kinds[tie] in WHOLE else F.col(tie)
    rows = stream.where(F.col(time).isNotNull()).select(
        *[F.col(n).cast(sent[n]) for n in names], F.col(time).cast("timestamp").alias("at_time"), order.alias("at_tie"), F.to_json(F.struct(*same), EXACT).alias("at_key")
    )
    rows = rows.withWatermark("at_time", late).withColumn("at_micros", F.unix_micros("at_time")).withColumn("at_group", F.pmod(F.xxhash64("at_key"), F.lit(groups)))
    out = rows.groupBy("at_group").applyInPandasWithState(run, ", ".join(f"{n} {sent[n]}" for n in names), "fetched map<string, long>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(*[F.col(n).cast(kinds[n]) for n in names])


def blocked_domains(stream: DataFrame, hours: int = DISCOVERY_HOURS, late: str = "1 hour") -> DataFrame:
    """domain, signal, seq for the first signal of each domain. stream: domain, seq, at, url, content_hash, thin,
    challenge. With more than one path: a content hash that came before, at most hours ago; else a second thin page; else
    a second challenge page. A domain's state is counters and the hashes of the last hours; of a flagged one, the flag."""
    use_state_store(stream.sparkSession)
    ttl = hours * 3600 * 10**6

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        path, several, again, thins, walls, flagged, hashes, times = state.get if state.exists else (None, False, False, 0, 0, False, [], [])
        seen = dict(zip(hashes, times))
        if state.hasTimedOut:  # counters stay, hashes that are too old by now go
            seen = {h: t for h, t in seen.items() if t + ttl >= state.getCurrentWatermarkMs() * 1000}
            state.update((path, several, again, thins, walls, flagged, list(seen), list(seen.values())))
            if seen:
                state.setTimeoutTimestamp(max((max(seen.values()) + ttl) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
            return
        parts = list(batches)
        if flagged:
            return
        batch = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        at, seqs = batch["at_micros"].to_numpy(), batch["seq"].to_numpy()
        urls, contents, thin, wall = (batch[c].tolist() for c in ("url", "content_hash", "thin", "challenge"))
        now = None
        for n in np.lexsort((seqs, at)).tolist():
            now, h = int(at[n]), contents[n]
            path = urls[n] if path is None else path
            several |= urls[n] != path
            if h:
                again |= h in seen and now - seen[h] <= ttl
                seen[h] = now
            thins, walls = thins + (thin[n] is True), walls + (wall[n] is True)
            sign = "hash_equality" if again else "thin_fanout" if thins > 1 else "challenge_fanout" if walls > 1 else None
            if several and sign:
                state.update((None, True, True, 0, 0, True, [], []))
                yield pd.DataFrame({"domain": [key[0]], "signal": [sign], "seq": [seqs[n]]})
                return
        state.update((path, several, again, thins, walls, False, list(seen), list(seen.values())))
        state.setTimeoutTimestamp(max((now + ttl) // 1000 + 1, state.getCurrentWatermarkMs() + 1))

    rows = stream.withColumn("at_time", F.col("at").cast("timestamp")).where("at_time IS NOT NULL").withWatermark("at_time", late).withColumn("at_micros", F.unix_micros("at_time"))
    kind = stream.schema["domain"].dataType.simpleString()
    kept = "path string, several boolean, again boolean, thins long, walls long, flagged boolean, hashes array<string>, times array<long>"
    return rows.groupBy("domain").applyInPandasWithState(run, f"domain {kind}, signal string, seq long", kept, "append", GroupStateTimeout.EventTimeTimeout)
