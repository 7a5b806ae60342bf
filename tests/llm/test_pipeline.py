"""Each stage of the corpus pipeline on what the one before it kept."""

import random
import re
from itertools import combinations

import corpus_pipeline
from tessaly.llm.shared import written
from tests.llm.test_pairs_and_packing import DOCS, union_find
from tests.llm.test_texts import brute_quality


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "language_id", "ngram_jaccard", "packing"]
    good = written(stages["quality_rules"](spark, docs, sf_dir), "t")
    base = {r["doc_id"] for r in docs.collect() if (m := brute_quality(r["text"]))[0] >= 20 and 100 * m[4] <= 30 * m[0]}
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} == base
    spoken = written(stages["language_id"](spark, good, sf_dir), "t")
    assert spoken.columns == docs.columns and spoken.count() >= 0.97 * good.count()
    single = written(stages["ngram_jaccard"](spark, spoken, sf_dir), "t")
    sets = {r["doc_id"]: five_words(lowered(r["text"])) for r in spoken.collect()}
    up = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((up[a], up[b]))
                up = {i: low if c == high else c for i, c in up.items()}
    assert single.columns == docs.columns and {r["doc_id"] for r in single.collect()} == set(up.values())
    packed = stages["packing"](spark, single, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == set(up.values())


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def five_words(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_near_copies_take_five_words_and_four_fifths(spark):
    r = random.Random(8)
    texts = []
    for n in (60, 150, 400):
        base = [f"w{r.randrange(5000)}" for _ in range(n)]
        # an added passage of 15 to 30 percent of the length, and copies with changed words
        texts += [" ".join(base + [f"x{r.randrange(5000)}" for _ in range(n * share // 100)]) for share in (0, 15, 19, 22, 24, 27, 30)]
        texts += [" ".join(w if r.random() > rate else "changed" for w in base) for rate in (0.01, 0.02, 0.05)]
    sets = [five_words(t) for t in texts]
    links = [(a, b) for a, b in combinations(range(len(texts)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    kept = {x["doc_id"] for x in dict(corpus_pipeline.STAGES)["ngram_jaccard"](spark, docs, "").collect()}
    assert kept == set(union_find(len(texts), links)) and len(kept) < len(texts)
