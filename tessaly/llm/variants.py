"""Spelling variants by anagram hashing.

1. Runs of letters are counted over all texts, each by the checksum of its document and itself perhaps short of a letter;
   words are those of some length that occur often enough. The checksum is taken once for each run of a document.
2. A word's key is the sum of its letters' code points to the fifth power, so anagrams share a key, and taking away a
   letter takes away its power. Words one addition or removal apart: the key of the longer less one of its letters'
   powers is the key of the shorter. Words one exchange apart: their keys less the powers of the two letters exchanged
   are equal. So every word sends its key and its keys less one letter; equal keys meet, nothing is tried letter by
   letter of an alphabet.
3. One addition, removal or exchange leaves the first or the last half of a word as it is, in its order. Keys are joined
   together with that half, so that the anagrams of a key don't all meet; a pair may come twice.
4. Letter order is verified for what met: the pairs at an edit distance of one stay.
5. A word's form is its near word with the largest count, if that is at least twice its own; the roots come from
   following forms by pointer doubling. Counts at least double from step to step, so there is no circle and about
   log2(log2(n)) joins are enough.

Defined results: null and empty texts have no runs; documents with a null id count but their runs lose no letter;
repeated rows count each time; a text of any length is read whole; ties go to the smallest word in code-point order; an
empty table, or one without words that are frequent enough, gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaly.llm.shared import small, written

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH = 5
MIN_COUNT = 3
#: A run loses a letter if this divides its checksum.
EVERY = 97
#: A form occurs at least so many times as often as its variant.
FACTOR = 2
POWER = 5


def _without(word: Column, at: Column) -> Column:
    """word without its code point at (from 0)."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))


def counted_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = EVERY) -> DataFrame:
    """word, n: the runs of all texts, lower-cased, those whose checksum every divides without one letter."""
    runs = docs.select(docs[doc_id].alias("doc_id"), F.explode(F.regexp_extract_all(docs[text], F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.coalesce(F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary")), F.lit(1))
    word = F.when(h % every == 0, _without(F.col("run"), (h % F.char_length("run")).cast("int"))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def anagram_key(letters: Column) -> Column:
    """The sum of the letters' code points to the fifth power; letters: an array of single letters."""
    return F.aggregate(letters, F.lit(0).cast("long"), lambda s, x: s + _power(x))


def _power(letter: Column) -> Column:
    # whole numbers below 2**53, so exact
    return F.pow(F.ascii(letter).cast("double"), F.lit(float(POWER))).cast("long")


def near_words(words: DataFrame) -> DataFrame:
    """a, b with counts n_a, n_b: all pairs of words (word, n) that differ by one code point inserted, deleted or
    replaced, each pair in both orders."""
    letters = F.filter(F.split("word", ""), lambda x: x != "")
    keyed = words.select("word", "n", letters.alias("letters"), F.char_length("word").alias("size"))
    keyed = written(keyed.select("word", "n", "size", "letters", anagram_key(F.col("letters")).alias("key")), "keys")

    def half(size: Column, side: str) -> Column:
        """The half of a word that a change in the other half leaves; size is that of the longer word of a pair."""
        at = F.floor(size / 2).cast("int")
        return F.substring("word", F.lit(1), at) if side == "first" else F.substring(F.col("word"), F.char_length("word") - (size - at) + 1, size - at)

    less = F.explode(F.transform(F.array_distinct("letters"), lambda x: F.col("key") - _power(x)))
    short, plain = keyed.select("word", "n", "size", less.alias("key")), keyed.select("word", "n", F.col("key"), (F.col("size") + 1).alias("size"))

    def sided(df: DataFrame, name: str) -> DataFrame:
        both = F.explode(F.array(*(F.struct(F.lit(i).alias("side"), half(F.col("size"), s).alias("half")) for i, s in enumerate(("first", "last")))))
        return df.select("key", "size", F.col("word").alias(name), F.col("n").alias(f"n_{name}"), both.alias("part")).select("key", "size", "part.*", name, f"n_{name}")

    on = ["key", "size", "side", "half"]
    one = F.levenshtein("a", "b", 1) == 1
    left, right = sided(short, "a"), sided(short, "b")
    exchanged = left.join(right, on).where((F.col("a") < F.col("b")) & one)
    removed = left.join(sided(plain, "b"), on).where(one)
    pairs = exchanged.select("a", "b", "n_a", "n_b").union(removed.select("a", "b", "n_a", "n_b")).distinct()
    pairs = written(pairs, "near-words")
    return pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n_b").alias("n_a"), F.col("n_a").alias("n_b")))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word that following forms (word, form) reaches, for words that have a form."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    rows = at.count()
    while True:
        ahead = at.select(F.col("word").alias("_word"), F.col("root").alias("_ahead"))
        step = at.join(small(ahead, rows, 64), F.col("root") == F.col("_word"), "left")
        at = written(step.select("word", F.coalesce("_ahead", "root").alias("root"), F.col("_ahead").isNotNull().alias("moved")), "roots")
        if at.where("moved").isEmpty():
            return at.select("word", "root")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, every: int = EVERY, factor: int = FACTOR) -> DataFrame:
    """word, n, n_near, form, form_n, root for every word of the texts."""
    words = counted_words(docs, doc_id, text, every).where((F.char_length("word") >= min_length) & (F.col("n") >= min_count))
    words = written(words, "words")
    best = F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form")))
    near = near_words(words).groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"), F.first("n_a").alias("n"))
    fits = -F.col("best.less") >= factor * F.col("n")
    near = written(near.select("word", "n_near", F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")), "near")
    forms = near.where("form IS NOT NULL")
    found = near.join(roots(forms), "word", "left")
    rows = near.count()
    return words.join(small(found, rows, 128), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root")
    )
