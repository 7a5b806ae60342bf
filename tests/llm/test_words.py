"""op11, op12 and op13 against brute force, and their edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessaly.llm import periodic, simhash
from tessaly.llm.variants import near_words, spelling_variants

CLASH = "doc_id long, text string, word string, n long, fingerprint string, task int, length string, start date, key long, root int"


def clashing(spark, texts):
    """Documents with columns named like the operators' own."""
    return spark.createDataFrame([(i, t, "w", 7, "f", 1, "l", None, 3, 4) for i, t in texts], CLASH)


# --- op11 -----------------------------------------------------------------------------------------------------------


def brute_variants(texts, min_length=5, min_count=3, every=97, factor=2):
    counts = Counter()
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    forms, close = {}, {w: [v for v in words if near(w, v)] for w in words}
    for w, others in close.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= factor * words[w] else None
    out = {}
    for w in words:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out[w] = (words[w], len(close[w]), forms[w], words[forms[w]] if forms[w] else None, root)
    return out


def variants(df, **more):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling_variants(df, **more).collect()}


def variant_texts():
    r = random.Random(2)
    words = ["colour", "color", "colourr", "calour", "ruoloc", "étude", "etude", "études", "strasse", "straße", "abcde", "abced", "abcdef", "bacde", "xxxxx", "xxxxxx", "xxxx", "aaaaab", "baaaaa", "listen", "silent", "STRASSE", "Étude", "×÷×÷×", "leaux", "leauxx"]
    texts = [(i, " ".join(r.choices(words, [1 + 7 * (k % 4 == 0) for k in range(len(words))], k=r.randrange(0, 60)))) for i in range(60)]
    return texts + [(100, None), (101, ""), (102, "12 34 -- \n"), (None, "colour colour abcde"), (103, "colour " * 500), (7, "colour-color,COLOUR_color"), (7, "colour-color,COLOUR_color")]


def test_variants_against_brute_force(spark):
    texts = variant_texts()
    got = variants(clashing(spark, texts))
    assert got == brute_variants(texts) and len(got) > 15 and any(x[2] is not None for x in got.values())


def test_variants_of_random_short_words(spark):
    r = random.Random(9)
    texts = [(i, " ".join("".join(r.choice("abé") for _ in range(r.randrange(1, 6))) for _ in range(120))) for i in range(15)]
    assert variants(clashing(spark, texts), min_length=1, min_count=1, every=3) == brute_variants(texts, 1, 1, 3)


def test_chains_of_forms_and_ties(spark):
    # each word is twice as frequent as the one before: the root of the first is the last
    chain = ["aaaaaaaa"[:k] + "b" * (8 - k) for k in range(9)]
    texts = [(None, " ".join(w for k, w in enumerate(chain) for _ in range(3 * 2**k))), (None, " ".join(["ccccc"] * 3 + ["ccccd"] * 6 + ["cccce"] * 6))]
    got = variants(clashing(spark, texts))
    assert got == brute_variants(texts) and got[chain[0]][4] == chain[-1] and got["ccccc"][2] == "ccccd"


def test_no_words(spark):
    assert variants(clashing(spark, [])) == {} and variants(clashing(spark, [(1, "one two"), (2, None)])) == {}
    alone = variants(clashing(spark, [(None, "lonely lonely lonely")]))
    assert alone == {"lonely": (3, 0, None, None, "lonely")}


def test_pairs_come_once_each_way(spark):
    words = spark.createDataFrame([("abcde", 3), ("abcdf", 3), ("abcd", 3), ("edcba", 3), ("abcdee", 3), ("aabcde", 3)], "word string, n long")
    got = sorted((r["a"], r["b"]) for r in near_words(words).collect())
    assert len(got) == len(set(got)) and set(got) == {(a, b) for x in [("abcde", "abcdf"), ("abcd", "abcde"), ("abcd", "abcdf"), ("abcde", "abcdee"), ("abcde", "aabcde")] for a, b in (x, x[::-1])}


# --- op12 -----------------------------------------------------------------------------------------------------------


def brute_fingerprint(text, width=5):
    """Votes term by term and bit by bit."""
    mask, odd = 2**64 - 1, [int(x) for x in simhash._ODD]
    words = text.encode().lower().split()
    if not words:
        return bytes(32)
    terms = Counter()
    if len(words) < width:
        terms[xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))] += 1
    else:
        each = [xxhash.xxh3_64_intdigest(w) for w in words]
        for i in range(len(words) - width + 1):
            h = 0
            for k in range(width):
                h = ((h ^ each[i + k]) * odd[k % 4]) & mask
                h ^= h >> 32
            terms[h] += 1

    def bits(term):
        out = []
        for o in odd:
            w = ((term ^ o) * odd[0]) & mask
            w = ((w ^ (w >> 29)) * 0xBF58476D1CE4E5B9) & mask
            w = ((w ^ (w >> 32)) * 0x94D049BB133111EB) & mask
            out += [(byte >> (7 - k)) & 1 for byte in (w ^ (w >> 31)).to_bytes(8, "little") for k in range(8)]
        return out

    votes = np.zeros(256, int)
    for term, n in terms.items():
        votes += n.bit_length() * (2 * np.array(bits(term)) - 1)
    least = bits(min(terms))
    return np.packbits([v > 0 or v == 0 and b == 1 for v, b in zip(votes, least)]).tobytes()


def fingerprint_texts():
    r = random.Random(6)
    word = lambda: r.choice("der die das foo bar baz qux quux corge grault".split()) + str(r.randrange(30))
    base = [word() for _ in range(300)]
    texts = [" ".join(base), " ".join(base), " ".join([*base[:150], "changed", *base[151:]]), " ".join(base[:-1]), "", None, " \n ", "one", "One two", "a b c d e", "x " * 700, "é" * 9, "\U0001f600 smile \U0001f600"]
    return texts + [" ".join(word() for _ in range(r.randrange(1, 90))) for _ in range(25)]


def test_fingerprints_against_brute_force():
    for text in fingerprint_texts():
        assert simhash.fingerprint(text) == brute_fingerprint(text or "")
    many = " ".join(f"w{i}" for i in range(simhash.TERMS + 700))  # more terms than are held at once
    assert simhash.fingerprint(many) == brute_fingerprint(many)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_compared_documents(spark, parts):
    texts = list(enumerate(fingerprint_texts())) + [(3, "same id"), (3, "another"), (None, "no id"), (50, "twice"), (50, "twice")]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = simhash.compared_documents(clashing(spark, texts)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    hashed = {t: h for t, h in spark.createDataFrame([(x,) for x in {t or "" for _, t in texts}], "t string").select("t", F.xxhash64("t")).collect()}
    rows = sorted(texts, key=lambda x: (x[0] is None, -(x[0] or 0), hashed[x[1] or ""]))
    want = []
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = brute_fingerprint(text), brute_fingerprint(edited), brute_fingerprint(after)
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), a.hex(), b.hex(), simhash.likeness(a, b), simhash.likeness(a, c)))
    key = lambda x: (x[0] is None, x[0] or 0, x[2], x[5], x[6])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_likeness():
    one = simhash.fingerprint("some words that are here for long enough to count")
    assert simhash.likeness(one, one) == 1.0 and simhash.likeness(one, bytes(255 - x for x in one)) == 0.0
    r = random.Random(1)
    base = [f"w{r.randrange(10**6)}" for _ in range(400)]
    half = simhash.likeness(simhash.fingerprint(" ".join(base)), simhash.fingerprint(" ".join(base[:200] + [f"v{r.randrange(10**6)}" for _ in range(200)])))
    other = simhash.likeness(simhash.fingerprint(" ".join(base)), simhash.fingerprint(" ".join(f"u{r.randrange(10**6)}" for _ in range(400))))
    assert 0.3 < half < 0.7 and other < 0.3


@pytest.mark.parametrize("radius", [3, 7, 15])
def test_search_finds_all_within_the_radius(spark, radius):
    r = random.Random(radius)
    marks = [r.getrandbits(256) for _ in range(40)]
    for m in list(marks):
        for _ in range(6):
            for_far = m
            for b in r.sample(range(256), r.randrange(1, radius + 4)):
                for_far ^= 1 << b
            marks.append(for_far)
    spread = marks[0]
    for t in range(8):  # as even over the blocks as can be
        for b in range(radius // 8 + (t < radius % 8)):
            spread ^= 1 << (32 * t + b)
    marks += [spread, marks[5], marks[5], 0, 1]
    table = spark.createDataFrame([(f"{m:064x}",) for m in marks] + [(None,)], "fingerprint string")
    queries = table.where("fingerprint IS NULL OR crc32(fingerprint) % 2 = 0 OR fingerprint = '" + f"{marks[0]:064x}'")
    got = [(int(x["fingerprint"], 16), int(x["other"], 16), x["apart"]) for x in simhash.within_radius(queries, table, radius).collect()]
    asked = {int(x["fingerprint"], 16) for x in queries.where("fingerprint IS NOT NULL").collect()}
    want = {(a, b, (a ^ b).bit_count()) for a, b in itertools.product(asked, set(marks)) if (a ^ b).bit_count() <= radius}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > len(asked)


def test_counts_of_copies(spark):
    marks = [(1, "f" * 64), (2, "f" * 64), (3, "e" + "f" * 63), (4, "0" * 64), (100, "f" * 64)]
    found = spark.createDataFrame(marks, "doc_id long, fingerprint string")
    got = {r["doc_id"]: r["n_within"] for r in simhash.counted_within(found, F.col("doc_id").isin(4, 100)).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 0, 100: 3}


def test_no_documents(spark):
    none = simhash.compared_documents(clashing(spark, []))
    assert none.count() == 0 and simhash.counted_within(none, F.lit(True)).count() == 0
    alone = simhash.compared_documents(clashing(spark, [(5, "abcdef")])).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and alone["near_next"] == 1.0


# --- op13 -----------------------------------------------------------------------------------------------------------


def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            end = i + q
            if i > start and end - start >= max(6, 4 * q) and not any(all(words[k] == words[k + p] for k in range(start, end - p)) for p in range(1, q)):
                out.append((start, end - start, q))
            i += i == start
    return sorted(out, key=lambda x: (x[0], x[2]))


def brute_summary(text, doc_id, edit=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if edit and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(listed), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def run_texts():
    r = random.Random(12)
    texts = [None, "", " \n", "a " * 5, "a " * 6, "a b " * 3, "a b a b a b a", "ab " * 40, "x y z " * 9 + "w", "A a A a A a A a", "é é é é é é", "a\x1cb a\x1cb a\x1cb a\x1cb a\x1cb a\x1cb", "b c " * 4 + "b b b b b b c b", "w " * 3000]
    for _ in range(120):
        words = [r.choice("ab" if r.random() < 0.5 else "abcdefgh") for _ in range(r.randrange(0, 90))]
        if len(words) > 10:
            a, p = r.randrange(len(words)), r.randrange(1, 8)
            words = words[:a] + [words[a + (i - a) % p] if a + (i - a) % p < len(words) else w for i, w in enumerate(words)][a:]
        texts.append(" ".join(words))
    return list(enumerate(texts)) + [(None, "q " * 10), (3, "a " * 5), (3, "a " * 5)]


@pytest.mark.parametrize("edit", [None, periodic.looped])
def test_runs_against_brute_force(spark, edit):
    texts = run_texts()
    found = periodic.run_summaries(clashing(spark, texts), edit=edit)
    got = sorted((tuple(r) for r in found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()), key=repr)
    assert got == sorted(((i, *brute_summary(t, i, edit is not None)) for i, t in texts), key=repr)
    assert periodic.run_summaries(clashing(spark, [])).count() == 0


def test_runs_of_long_sequences():
    assert periodic.periodic_runs(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]
    fib = [0], [0, 1]
    while len(fib[1]) < 900:
        fib = fib[1], fib[1] + fib[0]
    assert periodic.periodic_runs(np.array(fib[1])) == brute_runs(fib[1])
    nested = ([1] * 7 + [2]) * 6 + [3] + ([1] * 7 + [2]) * 5 + [1] * 9
    assert periodic.periodic_runs(np.array(nested)) == brute_runs(nested)
    r = random.Random(0)
    for _ in range(300):
        words = [r.randrange(2) for _ in range(r.randrange(0, 60))] * r.choice([1, 1, 4, 5])
        assert periodic.periodic_runs(np.array(words, np.int64)) == brute_runs(words)
