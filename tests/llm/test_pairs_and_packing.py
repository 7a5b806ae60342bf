"""op1, op3, op9 and the components against brute force."""

import itertools
import pathlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessaly.llm.components import connected_components
from tessaly.llm.jaccard import _left, described, distinct_documents, jaccard_components, shingles
from tessaly.llm.packing import cuts, pack_documents, sum_of_squares
from tessaly.llm.shared import shared_dir
from tessaly.llm.topk import best_of, exact_scores, integer_vectors, top_k

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def union_find(n, links):
    up = list(range(n))
    for a, b in links:
        while up[a] != a:
            a = up[a]
        while up[b] != b:
            b = up[b]
        up[max(a, b)] = min(a, b)
    out = []
    for x in range(n):
        while up[x] != x:
            x = up[x]
        out.append(x)
    return out


def test_components_follow_long_paths(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (200, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))}


def near_copies():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [r.choice(vocabulary) for _ in range(50)]
    texts = [None, "", " \n\t", "one", "ONE", "one two three", "One two\tthree", "one two three four", "É a b c d", "é a b c d", "\x1cx a b c"]
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.choice([6, 30, 90, 400]))]
        for _ in range(r.choice([1, 3, 7])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append(" ".join(copy))
    for _ in range(20):
        texts.append(" ".join(passage + [r.choice(vocabulary) for _ in range(r.choice([5, 9, 60]))]))
    # a group whose copies link to a base more than to each other
    base = [r.choice(vocabulary) for _ in range(200)]
    for _ in range(40):
        copy = list(base)
        for _ in range(3):
            copy[r.randrange(200)] = r.choice(vocabulary)
        texts.append(" ".join(copy))
    texts.append(" ".join(base))
    return texts


def test_jaccard_components_are_brute_force_ones(spark):
    texts = near_copies()
    sets = [brute_sets(t) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = union_find(len(texts), links)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, want))}
    assert len(set(want)) < len(want) - 50


def test_jaccard_of_documents_that_share_passages(spark):
    """Documents with a passage in common that don't link, families of near misses, and a hub that joins its copies."""
    r = random.Random(12)
    word = lambda: f"w{r.randrange(4000)}"
    passage, base = [word() for _ in range(60)], [word() for _ in range(150)]
    texts = [" ".join(passage + [word() for _ in range(r.choice([8, 30, 90]))]) for _ in range(120)]
    texts += [" ".join(w if r.random() > rate else word() for w in base) for rate in (0.01, 0.02, 0.03, 0.05) for _ in range(30)]
    texts += ["a b c d e", "a b c d e f", "a b c d e f g h i j k", "x " + " ".join(passage)]
    sets = [brute_sets(t) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = {x["doc_id"]: x["component_id"] for x in jaccard_components(spark.createDataFrame(rows, DOCS)).collect()}
    want = union_find(len(texts), links)
    assert got == dict(enumerate(want)) and 5 < len(links) < 2000 and want[:100] != [0] * 100


def test_jaccard_edges(spark):
    assert jaccard_components(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(3, "a b c d e", "n"), (3, "a b c d e", "n"), (None, "a b c d e", "n"), (1, "a b c d e", "n"), (9, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in jaccard_components(docs).collect())
    assert got == [(-1, 2, None), (1, 2, 1), (3, 2, 1), (3, 2, 1), (9, 0, 9)]
    kept = distinct_documents(docs.union(docs.where("doc_id = 1")))
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, -1, 1, 9] or sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 9]


def test_jaccard_keeps_no_table_of_ngrams(spark):
    """Tables of n-grams and prefixes go once their readers are written; before, they stayed beside every later table."""
    folder = pathlib.Path(shared_dir(spark).removeprefix("file:"))
    there = lambda: {p.name for p in folder.iterdir() if p.name.startswith(("looked-", "sets-", "rows-", "held-"))}
    before = there()
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[i % 3 :] + [f"x{i % 5}"])) for i in range(12)]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert there() == before
    assert {r["component_id"] for r in got.collect()} == {0}  # what is left is enough for the result


def test_jaccard_leaves_few_unrelated_sets(spark):
    """So many n-grams are looked at that most sets without a copy hold enough single ones; at 80 percent
    one in five was about as many as a prefix takes."""
    draw = random.Random(3)
    rows = [(i, " ".join(draw.choices([f"w{k}" for k in range(500)], k=300))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent, width in ((80, 5), (85, 4)):
        looked = described(docs, "doc_id", "text", percent, width, whole=False)
        left = _left(looked.select(F.col("doc_id").alias("node"), F.xxhash64("print").alias("mark"), "n", "counted"), percent)
        assert left.count() < 40


def test_jaccard_null_id_before_a_sound_copy(spark):
    base = [f"w{i}" for i in range(60)]
    text, near = " ".join(base), " ".join([*base, "more"])
    rows = [(None, text), (5, text), (None, text), (2, near), (None, "other words stand here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {(r["doc_id"], r["component_id"]) for r in jaccard_components(docs).collect()}
    assert got == {(None, None), (5, 2), (2, 2)}
    assert sorted(r["doc_id"] or -1 for r in distinct_documents(docs).collect()) == [-1, -1, -1, 2]


def test_shingles_lower_only_ascii_and_split_only_at_the_six():
    assert len(shingles("A B C D")) == 1 and (shingles("A B C D") == shingles("a\tb\nc\x0bd")).all()
    assert not np.array_equal(shingles("É b c d"), shingles("é b c d"))
    assert len(shingles("a\xa0b c d e")) == 1


def test_cuts_and_sum_of_squares_rules():
    assert cuts(1, 8) == [(0, 1)] and cuts(8, 8) == [(0, 8)] and cuts(9, 8) == [(0, 1), (1, 8)] and cuts(24, 8) == [(0, 8), (8, 8), (16, 8)]
    r = np.random.default_rng(3)
    sizes = np.sort(r.integers(1, 2047, 4000))[::-1]
    bins, offsets = sum_of_squares(sizes, 2048)
    fill = np.bincount(bins, sizes)
    assert fill.max() <= 2048 and len(fill) <= 1.01 * sizes.sum() / 2048
    for b in range(0, len(fill), 97):
        mine = np.flatnonzero(bins == b)
        assert offsets[mine].tolist() == [0, *np.cumsum(sizes[mine])[:-1]]


def test_pack_documents(spark):
    library = Tokenizer.from_file(PATH)
    texts = ["", None, "hello world", "hello world", "a  b \n c", "<|endoftext|> x", "word " * 5000, "x" * 3000, " lead", "naïve 日本"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "null id", 1), (2, "hello world", 1)], "doc_id long, text string, offset int")
    rows = pack_documents(docs, PATH).collect()
    assert pack_documents(docs.limit(0), PATH).count() == 0
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i)
        mine = sorted(set(mine))
        assert sum(m[2] for m in mine) == len(ids)
        assert all(m[3] == zlib.crc32(ids[m[1] : m[1] + m[2]].tobytes()) for m in mine)
        assert all(m[2] == 2048 for m in mine[1:])
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r["doc_id"] == 2 for r in rows) == 2 and len(rows) >= len(texts) + 2


def brute_top(vectors, queries, k):
    out = set()
    for q in queries:
        scored = sorted((-sum(a * b for a, b in itertools.zip_longest(vectors[q], v, fillvalue=0)), i) for i, v in vectors.items() if i != q)
        out |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])}
    return out


def test_top_k_scores_few_pairs_of_skewed_vectors():
    """Lengths that fall off and components that mostly lie in a few directions: most pairs fall to the bounds."""
    r = np.random.default_rng(4)
    shape = r.normal(0, 1, (2000, 64)) @ (np.diag(np.exp(-np.arange(64) / 6)) @ r.normal(0, 1, (64, 64)))
    x = np.floor(256 * shape * (r.pareto(1.5, 2000) + 0.05)[:, None])
    basis = np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()
    block = pd.DataFrame({"vec_id": np.arange(2000), "v": list(x)})
    asked = block.iloc[::50].assign(row=np.arange(40), floor=np.nan)
    scored = []
    got = best_of(asked, block, basis, 5, scored)
    exact = (x[::50] @ x.T).astype(np.int64)
    want = {(50 * i, j, exact[i, j]) for i in range(40) for j in sorted((j for j in range(2000) if j != 50 * i), key=lambda j: (-exact[i, j], j))[:5]}
    assert {tuple(t) for t in got[["query_id", "vec_id", "score"]].to_numpy()} == want
    assert sum(scored) < 0.4 * 40 * 2000
    # a floor that nothing reaches leaves nothing to score
    assert not len(best_of(asked.assign(floor=1e30), block, basis, 5, none := [])) and sum(none) == 0


@pytest.mark.parametrize("blocks", [(7, 3), (4096, 1024)])
def test_top_k_is_brute_force(spark, blocks):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(0, 1 + i % 5, 24)], "a") for i in range(60)] + [(60 + i, [0.5] * 24, "b") for i in range(12)]
    rows += [(90, None, ""), (91, [], ""), (92, [1.0, float("nan")], ""), (93, [None, 1.0], ""), (94, [float("inf")], ""), (None, [1.0], ""), (95, [2.0, -1.0], "")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block string")
    vectors = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    from pyspark.sql import functions as F

    got = top_k(integer_vectors(table), F.col("vec_id") % 10 == 0, 5, *blocks).collect()
    assert {tuple(x) for x in got} == brute_top(vectors, [i for i in vectors if i % 10 == 0], 5) and len(got) == len(set(map(tuple, got)))


def test_top_k_repeated_rows(spark):
    from pyspark.sql import functions as F

    rows = [(0, [2.0]), (0, [2.0]), (1, [3.0]), (1, [3.0]), (2, [1.0])]
    got = top_k(integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), F.col("vec_id") == 0, 3).collect()
    assert sorted(tuple(x)[1:3] for x in got) == [(1, 1), (1, 1), (2, 1), (2, 1), (3, 2), (3, 2)]


def test_top_k_edges(spark):
    from pyspark.sql import functions as F

    table = spark.createDataFrame([(0, [1e30, 1.0]), (1, [-3.0, 2.0]), (2, [1e30, 0.0])], "vec_id long, embedding array<float>")
    got = top_k(integer_vectors(table), F.col("vec_id") == 0).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(got)] == [(1, 2), (2, 1)] and got[0]["score"] in (2**63 - 1, -(2**63))
    assert top_k(integer_vectors(table.limit(0)), F.col("vec_id") == 0).count() == 0
    assert top_k(integer_vectors(table), F.col("vec_id") == 77).count() == 0
    assert exact_scores(np.array([[2.0**30, 1]]), np.array([[2.0**30, 3]])).tolist() == [[2**60 + 3]]


def passages_that_lead(width, groups):
    """Groups of seven documents of 23 n-grams and some: five windows over one text, each a word further, and two that
    differ in their last word. Hashes are chosen so that one n-gram (P) leads all seven, another (Y) the windows, and
    their last one each of the two: P's block alone can bring the two together, and it shrinks once Y's has been met."""
    r = random.Random(11)
    made = []
    n = 20 + width - 1
    word = lambda: f"w{r.randrange(10**9)}"
    small_one = lambda hashes: hashes[0] % np.uint64(5) and hashes[0] < np.uint64(2**64 // 500)

    def lucky(start, count):
        while True:
            new = [word() for _ in range(count)]
            if small_one(shingles(" ".join(start + new), width)):
                return new

    while len(made) < groups:
        p, y = lucky([], width), lucky([], width)
        whole = [word() for _ in range(n + 4)]
        whole[5 : 5 + width], whole[12 : 12 + width] = p, y
        windows = [whole[i : i + n] for i in range(5)]
        body = p + [word() for _ in range(n - width - 1)]
        tail = body[len(body) - width + 1 :] if width > 1 else []
        two = [body + lucky(tail, 1) for _ in range(2)]
        first = lambda words, k: set(shingles(" ".join(words), width)[:k].tolist())
        both = first(p, 1) | first(y, 1)
        if all(first(x, 2) == both for x in windows) and all(first(x, 2) == first(p, 1) | first(x[n - width :], 1) for x in two):
            made.append([" ".join(x) for x in [*windows, *two]])
    return made


@pytest.mark.parametrize("width", [1, 4])
def test_blocks_that_shrink_are_met(spark, width):
    groups = passages_that_lead(width, 12)
    texts = [x for group in groups for x in group]
    sets = [set(shingles(x, width).tolist()) for x in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = union_find(len(texts), links)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_components(docs, width=width).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert all(got[7 * g + 6] == got[7 * g + 5] != got[7 * g] for g in range(len(groups)))
