"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

1. Every document gets a fingerprint of its n-gram set and a parity bitmap of it. Documents with equal fingerprints form
   a class; from here on a class is one row.
2. Of one n-gram in some, chosen by hash, it is found out whether a single class holds it: more of them than a prefix
   takes, as a set with too few single ones stays to be looked at whole. All n-grams are ordered: these single ones, then
   those not looked at, then the rest. A set of n n-grams can only link to sets that share one of
   its first n - ceil(n p / 100) + 1 in that order, its prefix; single ones are shared by none, so most sets whose text
   isn't a copy have nothing left there. What is counted goes to as many tasks as it is worth; nothing is broadcast.
   Prefixes and bitmaps are made for what is left only, from the texts again, and a table goes once its readers are written.
3. A prefix n-gram and the classes that hold it are a block of the incidence matrix. Every block first meets its pivot
   only (one pair for each row), and the links found merge classes; groups of near copies are one component after that.
4. Two classes that no block holds in different components need no look. Blocks that hold few pairs of them for their
   rows meet all of these. The sets of the classes in other blocks are written once, all of their n-grams are counted, and
   prefixes and blocks are made anew, rarest n-grams first. These blocks meet pivots until few pairs are left between
   components or their number no longer halves, then all of their pairs, accumulating the overlap within the prefixes.
5. Pairs are discarded by size (p max <= 100 min), by the places of a shared n-gram (two sets of n and m only link if
   they share one of the first n - ceil(p (n + m) / (100 + p)) + 1 of n and as many of m), by what the overlap so far
   and the places after the last shared n-gram leave possible, then by the bound that the bitmaps' distance puts on the
   overlap; the overlap of what is left is counted over the whole sets.

Words are maximal runs without x20 and x09-x0D, A-Z lower-cased. Defined results: a text with fewer words than the
n-gram's width is one n-gram; a text without words, or null, has size 0 and links with nothing; repeated rows are
equal sets; rows with a null id get their size and a null component, and take no part in links; rows that share an id
are one document with the links of each; a text of any length is one set, whole; an empty table gives an empty result;
other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaly.llm.components import connected_components
from tessaly.llm.shared import few, fits_broadcast, forget, small, written

WIDTH = 4
PERCENT = 85
PARITY_BITS = 2048
#: Pivots end when so few pairs are left between components for each row of the blocks, or when they no longer halve them.
PAIRS_A_ROW = 4
#: Fingerprints that a task remembers; a copy that comes after they were forgotten only gets its prefix once more.
REMEMBERED = 200_000
#: The bits of an n-gram's hash by which it is counted in step 2. Two that agree in them count as held by both classes,
#: which costs a look and loses no link; at 30 GB this is one in a thousand.
COUNTED_BITS = 40
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-grams of a text. bytes.split() splits at exactly x20 and x09-x0D, and
    bytes.lower() lowers exactly A-Z."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    mixed = np.zeros(n, np.uint64)
    for i in range(width):
        mixed = (mixed ^ each[i : i + n]) * _FACTORS[i % len(_FACTORS)]
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def prefix_size(n, percent: int):
    return n - (n * percent + 99) // 100 + 1


def counted_one_in(percent: int) -> int:
    """One n-gram in so many is looked at in step 2, at least 4 for each 3 of a prefix. Any number gives the same links."""
    return max(1, 300 // (4 * max(1, 100 - percent)))


def described(docs: DataFrame, doc_id: str, text: str, percent: int, width: int, whole: bool = True) -> DataFrame:
    """doc_id, n, print (of the set), and for the first copy in a task that has an id: prefix (the first of the n-grams
    that aren't looked at, in the order of their hashes), counted (those that are) and parity. If not whole, only counted
    of these three."""
    kind = docs.schema[doc_id].dataType.simpleString()
    every = np.uint64(counted_one_in(percent))

    def one(hashes: np.ndarray) -> tuple[np.ndarray | None, np.ndarray, np.ndarray | None]:
        chosen = hashes % every == 0
        if not whole:
            return None, hashes[chosen].view(np.int64), None
        parity = np.bincount((hashes >> np.uint64(40)).astype(np.int64) % PARITY_BITS, minlength=PARITY_BITS) & 1
        prefix = hashes[~chosen][: prefix_size(len(hashes), percent)]
        return prefix.view(np.int64), hashes[chosen].view(np.int64), np.packbits(parity.astype(np.uint8)).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 256):
                batch = whole_batch.slice(at, 256)
                rows = []
                for i, x in zip(batch.column(0), batch.column(1)):
                    hashes = shingles(x.as_py(), width)
                    mark = xxhash.xxh3_128_digest(hashes.tobytes())
                    first = i.is_valid and len(hashes) > 0 and mark not in met
                    if first:
                        if len(met) >= REMEMBERED:
                            met.clear()
                        met.add(mark)
                    rows.append((len(hashes), mark, *(one(hashes) if first else (None,) * 3)))
                longs = pa.list_(pa.int64())
                columns = [pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.binary(), longs, longs, longs))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n", "print", "prefix", "counted", "parity"])

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, f"doc_id {kind}, n long, print binary, prefix array<long>, counted array<long>, parity array<long>")


def _of(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """node, text: the documents whose ids are wanted (node, written). Texts aren't shuffled while the ids fit a broadcast."""
    side = wanted.select(F.col("node").alias("_wanted"))
    return docs.select(F.col(doc_id).alias("node"), F.col(text).alias("text")).join(small(side, wanted.count()), F.col("node") == F.col("_wanted"), "left_semi")


def _sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """node, hashes: the n-gram sets of the wanted documents (node), from their texts."""
    some = _of(docs, wanted, doc_id, text)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = [shingles(x.as_py(), width).view(np.int64) for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "hashes"])

    return some.mapInArrow(run, f"node {kind}, hashes array<long>")


def linked(pairs: DataFrame, classes: DataFrame, n_classes: int, sets: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """The pairs (a, b) that link, by the bitmap bound and then the whole sets (node, hashes), which sets gives for a
    table of nodes."""
    pairs = written(pairs, "met")
    n_pairs = pairs.count()
    narrow = fits_broadcast(classes, n_classes, PARITY_BITS // 8)

    def with_class(df: DataFrame, x: str, more: int) -> DataFrame:
        side = classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("parity").alias(f"p_{x}"))
        return df.join(F.broadcast(side), x) if narrow else side.join(small(df, n_pairs, more), x)

    apart = F.aggregate(F.zip_with("p_a", "p_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    total = F.col("n_a") + F.col("n_b")
    able = with_class(with_class(pairs, "a", 0), "b", PARITY_BITS // 8)
    able = written(few(able.where((100 + percent) * F.floor((total - apart) / 2) >= percent * total).select("a", "b", "n_a", "n_b"), n_pairs), "pairs")
    n_able = able.count()
    if not n_able:
        return able.select("a", "b")
    wanted = written(few(able.select(F.explode(F.array("a", "b")).alias("node")).distinct(), 2 * n_able), "wanted")
    there = sets(wanted)
    met = there.select(F.col("node").alias("b"), F.col("hashes").alias("h_b")).join(small(able, n_able), "b").join(there.select(F.col("node").alias("a"), F.col("hashes").alias("h_a")), "a")
    overlap = F.size(F.array_intersect("h_a", "h_b"))
    return met.where((100 + percent) * overlap >= percent * total).select("a", "b")


def _reach(n, other, percent: int):
    """The last place (from 0) at which a set of n n-grams must share one with a set of other n-grams that it links to:
    n - ceil(percent (n + other) / (100 + percent))."""
    return n - F.floor((percent * (n + other) + 99 + percent) / (100 + percent))


def _left(first: DataFrame, percent: int) -> DataFrame:
    """node, mark, u of the sets (node, mark, n, counted) that have less single n-grams (u), held by sets of one mark, than
    their prefix is long."""
    looked = first.select("mark", F.explode("counted").alias("gram")).select("mark", F.col("gram").bitwiseAND(2**COUNTED_BITS - 1).alias("gram"))
    looked = looked.groupBy("gram").agg(F.min("mark").alias("mark"), F.max("mark").alias("other"))
    single = written(looked.where("mark = other").groupBy("mark").agg(F.count(F.lit(1)).alias("u")), "single")
    size = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1
    some = first.select("node", "mark", "n").join(small(single, single.count()), "mark", "left").withColumn("u", F.coalesce("u", F.lit(0)))
    return written(some.where(F.col("u") < size).select("node", "mark", "u"), "left")


def _rows(some: DataFrame, percent: int) -> DataFrame:
    """node, n, at, gram: the prefixes of sets (node, n, u, prefix, counted), without the single n-grams at their start.
    Only n-grams that several sets hold, one of them in a short place."""
    size = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1
    rows = some.select("node", "n", "u", F.posexplode(F.slice("prefix", 1, (size - F.col("u")).cast("int"))).alias("at", "gram"))
    # sets so small that the n-grams that were looked at lie in the prefix: the least place that these can have
    rest = F.col("n") - F.size("counted")
    late = some.where(F.col("u") + rest < size).select("node", "n", "u", rest.alias("at"), F.explode("counted").alias("gram"))
    rows = written(rows.union(late).select("node", "n", (F.col("u") + F.col("at")).alias("at"), "gram"), "rows")
    held = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("k"), F.max(_short(percent).cast("int")).alias("short"))
    held = written(held.where("k > 1 AND short = 1").select("gram"), "held")
    return rows.join(small(held, held.count()), "gram")


def _short(percent: int):
    """Whether an equal or larger set can link through a row."""
    return F.col("at") <= _reach(F.col("n"), F.col("n"), percent)


def _blocks(rows: DataFrame, percent: int) -> tuple[DataFrame, int]:
    """gram, node, n, at, short: the rows written as blocks, and their number."""
    blocks = written(rows.select("gram", "node", "n", "at").distinct().withColumn("short", _short(percent)), "blocks")
    return blocks, blocks.count()


def _counted_blocks(sets: DataFrame, percent: int) -> tuple[DataFrame, int]:
    """What _blocks gives, for the sets (node, hashes) of some classes and with their n-grams in the order of their
    exact counts there. An n-gram of one set takes one of its first places, whichever."""
    rows = sets.select("node", F.size("hashes").alias("n"), F.explode("hashes").alias("gram"))
    shared = written(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "shared")
    held = rows.join(small(shared, shared.count()), "gram").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("k", "gram"))).alias("held"))
    placed = held.select("node", "n", F.posexplode("held").alias("place", "of"), F.size("held").alias("size"))
    at = (F.col("n") - F.col("size") + F.col("place")).alias("at")
    last = F.col("n") - F.floor((F.col("n") * percent + 99) / 100)
    return _blocks(placed.select("of.gram", "node", "n", at).where(F.col("at") <= last), percent)


def _open(blocks: DataFrame, n_rows: int, label: DataFrame, n_nodes: int) -> tuple[DataFrame, int, int]:
    """The rows of the blocks that hold pairs of different components of which one row is short, with the component, and
    whether these are more than PAIRS_A_ROW for each row of the block; the number of those blocks, and of those pairs."""
    lined = blocks.join(small(label, n_nodes), "node")
    sizes = few(lined.groupBy("gram", "component").agg(F.count(F.lit(1)).alias("k"), F.count_if("short").alias("s")), n_rows)
    pairs = (F.sum("s") * F.sum("k") - F.sum(F.col("s") * F.col("k"))).alias("pairs")
    sizes = few(sizes.groupBy("gram").agg(pairs, F.sum("k").alias("k"), F.count(F.lit(1)).alias("c")), n_rows)
    sizes = written(sizes.where("c > 1 AND pairs > 0").select("gram", (F.col("pairs") > PAIRS_A_ROW * F.col("k")).alias("large"), "pairs"), "sizes")
    left, n_open = sizes.agg(F.sum("pairs"), F.count(F.lit(1))).first()
    return lined.join(small(sizes.select("gram", "large"), n_open), "gram"), n_open, left or 0


def _fitting(mine: DataFrame, lined: DataFrame, percent: int) -> DataFrame:
    """Rows of blocks that can link to the rows of mine: o, n_o, at_o beside gram, node, n, at."""
    other = lined.select("gram", F.col("node").alias("o"), F.col("n").alias("n_o"), F.col("at").alias("at_o"), F.col("component").alias("c_o"))
    n, n_o = F.col("n"), F.col("n_o")
    fits = (100 * F.least("n", "n_o") >= percent * F.greatest("n", "n_o")) & (F.col("component") != F.col("c_o"))
    return mine.join(other, "gram").where(fits & (F.col("at") <= _reach(n, n_o, percent)) & (F.col("at_o") <= _reach(n_o, n, percent)))


def _with_pivots(lined: DataFrame, n_rows: int, n_open: int, percent: int, turn: int) -> DataFrame:
    """Pairs (a, b) of every row with its block's pivot: the class with the fewest rarer n-grams, which of near copies is
    the one nearest to their origin."""
    pivot = F.min_by(F.struct("node", "n", "at", "component"), F.struct("at", F.xxhash64("node", "gram", F.lit(turn)))).alias("p")
    mine = small(few(lined.groupBy("gram").agg(pivot), n_rows).select("gram", "p.*"), n_open)
    return few(_fitting(mine, lined, percent).select(F.least("node", "o").alias("a"), F.greatest("node", "o").alias("b")).distinct(), n_rows)


def _with_all(lined: DataFrame, n_rows: int, percent: int, whole: bool) -> DataFrame:
    """Pairs (a, b) of the blocks. If these are the whole prefixes, only those that can reach the overlap that a link
    needs: all n-grams that two sets share up to the last one met lie in both prefixes, so their number is exact."""
    met = _fitting(lined, lined, percent).where("node < o")
    met = few(met.groupBy(F.col("node").alias("a"), F.col("o").alias("b"), "n", "n_o").agg(F.count(F.lit(1)).alias("k"), F.max("at").alias("at"), F.max("at_o").alias("at_o")), n_rows)
    most = F.col("k") + F.least(F.col("n") - F.col("at"), F.col("n_o") - F.col("at_o")) - 1
    return met.where(((100 + percent) * most >= percent * (F.col("n") + F.col("n_o"))) | F.lit(not whole)).select("a", "b")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links reach) for every row of docs."""
    docs = docs.select(docs[doc_id], docs[text])
    looked = written(described(docs, doc_id, text, percent, width, whole=False).drop("prefix", "parity"), "looked")
    table = written(looked.select("doc_id", "n", "print"), "sizes")  # what is read to the end
    copies = written(table.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("print").agg(F.min("doc_id").alias("node")), "copies")
    left = _left(looked.where(F.col("counted").isNotNull()).select(F.col("doc_id").alias("node"), F.xxhash64("print").alias("mark"), "n", "counted"), percent)
    forget(looked)
    # the n-grams of most texts aren't kept: those of what is left are taken from the texts again
    marks = written(left.groupBy("mark").agg(F.min("u").alias("u")), "marks")
    again = described(_of(docs, written(left.select("node").distinct(), "again"), doc_id, text), "node", "text", percent, width)
    first = written(again.where(F.col("counted").isNotNull()).withColumn("mark", F.xxhash64("print")).join(small(marks, marks.count()), "mark"), "sets")
    rows = _rows(first.withColumnRenamed("doc_id", "node"), percent).withColumnRenamed("node", "doc_id")
    blocks, n_rows = _blocks(rows.join(first.select("doc_id", "print").join(copies, "print").select("doc_id", "node"), "doc_id"), percent)
    forget(rows)

    label = written(few(blocks.select("node").distinct(), n_rows).withColumn("component", F.col("node")), "labels")
    n_nodes = label.count()
    # the bitmaps of the classes in blocks; a class's first copy in some task has one
    able = first.select("n", "print", "parity").join(small(copies.join(small(label, n_nodes), "node", "left_semi"), n_nodes, 32), "print")
    classes = written(few(able.groupBy("node", "n").agg(F.min("parity").alias("parity")), n_nodes * 8), "classes")
    forget(first)
    read = lambda wanted: _sets(docs, wanted, doc_id, text, width)

    links = None

    def join(pairs: DataFrame, sets: Callable[[DataFrame], DataFrame]) -> None:
        nonlocal links, label
        found = written(linked(pairs, classes, n_nodes, sets, percent), "links")
        if not found.isEmpty():
            links = found if links is None else written(links.union(found), "links")
            joined = connected_components(links)
            label = written(label.select("node").join(small(joined, n_nodes), "node", "left").select("node", F.coalesce("component", "node").alias("component")), "labels")

    lined, n_open, _ = _open(blocks, n_rows, label, n_nodes)
    if n_open:
        join(_with_pivots(lined, n_rows, n_open, percent, 0), read)
        lined, n_open, _ = _open(blocks, n_rows, label, n_nodes)
    if n_open:
        # blocks that are large here are met below, however few pairs the links of the others leave in them
        unmet = written(few(lined.where("large").select("gram").distinct(), n_rows), "unmet")
        join(_with_all(lined.where("NOT large"), n_rows, percent, False), read)
        # what stands in such a block with another component still
        lined, _, _ = _open(blocks, n_rows, label, n_nodes)
        lined = lined.join(small(unmet, unmet.count()), "gram", "left_semi")
        sets = written(read(written(few(lined.select("node").distinct(), n_rows), "open")), "open-sets")
        forget(blocks)
        blocks, n_rows = _counted_blocks(sets, percent)
        before, last, turn = None, n_rows == 0, 0
        while not last:
            turn += 1
            lined, n_open, left = _open(blocks, n_rows, label, n_nodes)
            if not n_open:
                break
            last = left <= PAIRS_A_ROW * n_rows or before is not None and left > before / 2
            before = left
            pairs = _with_all(lined, n_rows, percent, True) if last else _with_pivots(lined, n_rows, n_open, percent, turn)
            join(pairs, lambda wanted: sets.join(wanted, "node", "left_semi"))

    named = copies.join(small(label, n_nodes), "node", "left").select("print", F.coalesce("component", "node").alias("component_id"))
    out = [F.col("doc_id").alias(doc_id), F.col("n").alias("n_shingles"), "component_id"]
    sound = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    alone = table.where(~sound).withColumn("component_id", F.col("doc_id"))
    return table.where(sound).join(named, "print").select(*out).union(alone.select(*out))


def distinct_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """docs without the near copies: of each component the document with the smallest id stays, and of repeated rows of
    one id one. Rows with a null id stay. Texts aren't shuffled while the ids that go fit a broadcast."""
    found = written(jaccard_components(docs, doc_id, text, percent, width).select(F.col(doc_id).alias("_id"), "component_id"), "components")
    gone = written(found.where("_id <> component_id").select("_id").distinct(), "gone")
    again = written(found.where("_id = component_id").groupBy("_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("_id"), "again")
    n_gone, n_again = gone.count(), again.count()
    kept = docs.join(F.broadcast(gone) if fits_broadcast(gone, n_gone) else gone, docs[doc_id] == gone["_id"], "left_anti")
    if not n_again:
        return kept
    side = F.broadcast(again) if fits_broadcast(again, n_again) else again
    once = kept.join(side, kept[doc_id] == side["_id"], "left_semi").dropDuplicates([doc_id])
    return kept.join(side, kept[doc_id] == side["_id"], "left_anti").unionByName(once)
