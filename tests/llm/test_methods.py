"""Steps of op1, op7 and op10 by brute force, and the pipeline's stages on odd rows."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessaly.llm import langid
from tessaly.llm.packing import packed, sum_of_squares
from tessaly.llm.quality import HOST_FAIL_RATE, quality_verdicts
from tessaly.llm.shared import bound_batches


@pytest.mark.parametrize("seed", range(6))
def test_each_piece_goes_where_the_squares_become_smallest(seed):
    r = random.Random(seed)
    capacity = 40
    sizes = sorted((r.randrange(1, capacity) for _ in range(150)), reverse=True)
    bins, offsets = sum_of_squares(np.array(sizes), capacity)
    needed, left = -(-sum(sizes) // capacity), {}
    squares = lambda gaps: sum(n * n for n in Counter(g for g in gaps if g).values())
    for s, b, at in zip(sizes, bins.tolist(), offsets.tolist()):
        open_gaps = {g for g in left.values() if g >= s}
        after = lambda g: squares([*(list(left.values()) if g is None else _without(list(left.values()), g)), (capacity if g is None else g) - s])
        sums = {g: after(g) for g in open_gaps}
        if len(left) < needed or not open_gaps:
            sums[None] = after(None)
        assert at == capacity - left.get(b, capacity)
        assert sums[left.get(b)] == min(sums.values())
        left[b] = left.get(b, capacity) - s
        assert left[b] >= 0


def _without(gaps, one):
    gaps.remove(one)
    return gaps


def test_packing_in_several_groups(spark):
    r = random.Random(3)
    rows = [(i, r.choice([1, 7, 50, 99, 100, r.randrange(1, 100)])) for i in range(900)]
    got = packed(spark.createDataFrame(rows, "doc_id long, length long").repartition(3), capacity=100, group_pieces=150).collect()
    by = {}
    for x in got:
        by.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for places in by.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= 100
    assert sorted(x["doc_id"] for x in got) == list(range(900)) and len(by) <= -(-sum(n for _, n in rows) // 100) + 6


def brute_hosts(rows):
    """The moment fit of a beta prior, host by host."""
    hosts = {}
    for host, failed in rows:
        if host is not None:
            n, f = hosts.get(host, (0, 0))
            hosts[host] = n + 1, f + failed
    total = sum(n for n, _ in hosts.values())
    mean = sum(f for _, f in hosts.values()) / total
    between = sum(n * (f / n - mean) ** 2 for n, f in hosts.values())
    room = total - sum(n * n for n, _ in hosts.values()) / total
    spread, k = mean * (1 - mean), len(hosts)
    rho = (between - (k - 1) * spread) / ((room - (k - 1)) * spread) if room > 0 and spread > 0 else None
    weight = (1 - rho) / rho if rho is not None and 0 < rho < 1 else total / k
    return {h: (f + mean * weight) / (n + weight) for h, (n, f) in hosts.items()}


@pytest.mark.parametrize("shares", [(0.95, 0.9, 0.85, 0.82, 0.78, 0.5, 0.1, 0.0), (0.9, 0.9, 0.9), (0.0, 0.0), (1.0, 1.0, 0.99)])
def test_host_verdicts_by_moments(spark, shares):
    good, rows = " ".join(f"w{i}" for i in range(30)), []
    for h, share in enumerate(shares):
        n = 40 + 35 * h
        rows += [(f"h{h}", "bad" if i < round(share * n) else good) for i in range(n)]
    rows += [(None, good), (None, "bad")]
    docs = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    rates = brute_hosts([(h, t == "bad") for h, t in rows])
    for x in quality_verdicts(docs).collect():
        host, text = rows[x["doc_id"]]
        assert x["base_failed"] == (text == "bad")
        if host is None:
            assert x["host_rate"] is None and x["kept"] == (text != "bad")
        else:
            assert x["host_rate"] == pytest.approx(rates[host]) and x["kept"] == (text != "bad" and rates[host] <= HOST_FAIL_RATE)
    if len(shares) == 8:  # on both sides of the limit
        assert {rate > HOST_FAIL_RATE for rate in rates.values()} == {True, False}


def brute_counts(text):
    """Subwords one by one, with Python's integers."""
    mask, factors = 2**64 - 1, [int(x) for x in langid._FACTORS]
    counts, places = Counter(), []
    words, word = [], []
    for c in text.lower():
        if langid._letters()[ord(c)]:
            word.append(ord(c))
        elif word:
            words.append(word)
            word = []
    words += [word] if word else []
    for w in words:
        marked = [0, *w, 0]
        for order in langid.ORDERS:
            for i in range(len(marked) - order + 1):
                piece = marked[i : i + order]
                if order == 1 and piece == [0]:
                    continue
                h = order
                for k, c in enumerate(piece):
                    h = ((h ^ c) * factors[k]) & mask
                    h ^= h >> 29
                counts[(h >> 13) % langid.BUCKETS] += 1
                if order in langid.KNOWN_ORDERS:
                    places.append(h >> (64 - langid.KNOWN_BITS))
    return counts, places


def test_training_brings_no_rows_to_the_driver(spark, monkeypatch):
    """The counts of the learnt rows meet in a task; before, they all came to the driver as an Arrow table."""
    monkeypatch.setattr(type(spark.range(0)), "toArrow", None)
    docs = spark.createDataFrame([(i, f"one two three {i}" if i % 2 else f"eins zwei drei {i}", "en" if i % 2 else "de") for i in range(60)], "doc_id long, text string, lang string")
    assert langid.train(docs, F.lit(True)).labels == ["de", "en"]
    assert langid.train(docs.where("doc_id < 0"), F.lit(True)) is None


def test_predictions_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(docs, ~langid.held_out())
    odd = [(-1, None), (-2, ""), (-3, "123 !"), (-4, "é"), (-5, "Ab aB"), (-6, "x" * 40)]
    rows = odd + [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").limit(25).collect()]
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame([(i, t, "clash", 1.0) for i, t in rows], "doc_id long, text string, lang_pred string, score double"), model).collect()}
    for i, text in rows:
        counts, places = brute_counts(text or "")
        if not counts:
            assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == (langid.UNKNOWN, 0.0, True)
            continue
        size = sum(counts.values())
        hidden = sum((n / size) * model.embeddings[b].astype(float) for b, n in counts.items())
        logits = (hidden @ model.weights.astype(float) + model.bias) / model.temperature
        p = np.exp(logits - logits.max())
        p /= p.sum()
        assert got[i]["lang_pred"] == model.labels[int(p.argmax())] and got[i]["score"] == pytest.approx(p.max(), abs=1e-3)
        known = np.mean([model.met[x] for x in places]) if places else 1.0
        if abs(p.max() - model.threshold) > 1e-3:
            assert got[i]["rejected"] == bool(p.max() < model.threshold or known < model.least_known)
    assert langid.predict(docs.limit(0), model).count() == 0


def test_stages_on_odd_rows(spark):
    """Nulls go as texts without words, repeated rows of one id stay once, empty tables stay empty; columns stay."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60")
    some = docs.where(F.length("text") > 400)
    odd = docs.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields])
    whole = docs.unionByName(some).unionByName(odd).unionByName(odd.withColumn("text", F.lit(""))).unionByName(odd.withColumn("doc_id", F.lit(10**6).cast("long")))
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), "").count() == 0
        kept = stage(spark, whole, "")
        assert kept.columns == docs.columns
        ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
        if name != "ngram_jaccard":
            assert 10**6 not in ids and None not in ids and len(ids) > len(set(ids))
        else:
            assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None}) and 10**6 in ids
    assert stages["packing"](spark, docs.limit(0), "").count() == 0
    pieces = stages["packing"](spark, whole, "").collect()
    assert sum(r["doc_id"] is None for r in pieces) == 2 and sum(r["doc_id"] == 10**6 for r in pieces) == 1


def test_language_sample_is_held_once():
    """Training takes views of the sample's batches; before, it copied all of their arrays."""
    r = np.random.default_rng(5)

    def lists(n_rows, n, most, kind):
        values = np.concatenate([np.sort(r.choice(most, n, replace=False)) for _ in range(n_rows)]).astype(kind)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, n_rows * n + 1, n, dtype=np.int32)), pa.array(values))

    batches = []
    for k in range(10):
        ids, names = pa.array(range(20 * k, 20 * k + 20)), pa.array(["de", "en"] * 10)
        at, place = lists(20, 100, langid.BUCKETS, np.int16), lists(20, 3000, 100_000, np.int32)
        n, often = (pa.ListArray.from_arrays(x.offsets, pa.array(np.ones(len(x.values), kind))) for x, kind in ((at, np.float32), (place, np.int32)))
        batches.append(pa.RecordBatch.from_arrays([ids, names, pa.array(r.random(20)), at, n, place, often], names=["id", "label", "rank", "at", "n", "place", "often"]))
    size, pool, old = sum(b.nbytes for b in batches), pa.proxy_memory_pool(pa.default_memory_pool()), pa.default_memory_pool()
    pa.set_memory_pool(pool)
    try:
        model = langid._model(list(batches), 60)
    finally:
        pa.set_memory_pool(old)
    assert model.labels == ["de", "en"] and 0 < model.met.sum() < 100_000
    assert pool.max_memory() < size / 10


def test_pipeline_hands_out_few_texts_at_once(spark):
    """At 1000 rows a batch the buffers of workers and executors grew past the check's limit."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        bound_batches(spark)
        assert int(spark.conf.get(key)) <= 200
    finally:
        spark.conf.set(key, before)
