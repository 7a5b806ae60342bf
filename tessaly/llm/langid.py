"""Language ID: averaged hashed subword embeddings under a linear softmax.

A text's subwords (letter n-grams of 1 to 4 inside words with marked ends) are hashed into buckets; the mean of their
embeddings goes through a linear softmax. The model is trained by stochastic gradient descent in numpy on a bounded,
hashed sample of labelled rows; a temperature and two limits of rejection are calibrated on a part of it that training
didn't see: the score, and the share of the text's subwords of KNOWN_ORDERS letters that training met. The softmax only
tells the learnt languages apart, so a text of another one can score high; it is told by subwords that were never met.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected; rows with a null label
are never trained on; labels that aren't strings are taken as strings; with no label at all every text is ``und``;
repeated rows get equal results; texts of any length are read whole; where no row is left to calibrate on (fewer than five, or none of them right), only
texts without a letter are rejected; an empty table gives an empty result; other columns stay, one named like an output is
replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessaly.llm.shared import small

UNKNOWN = "und"
BUCKETS = 4096
DIMENSIONS = 16
ORDERS = (1, 2, 3, 4)
#: Labelled rows of each label that the model is fitted on, at most; and of all labels together, from which every label
#: gets an equal share, one row at least. All labels are learnt, however many there are.
ROWS_A_LABEL = 1500
SAMPLE_ROWS = 60_000
EPOCHS = 12
BATCH = 64
RATE = 2.0
#: Of the calibration rows that the model gets right, the share that each limit may cost, and the part of the value
#: under which they lie that is the limit.
REJECT_SHARE = 0.001
MARGIN = 0.9
#: The subwords whose share that training met is the second limit, and the size of the table of those met.
KNOWN_ORDERS = (3, 4)
KNOWN_BITS = 22
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint64)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def subwords(text: str) -> np.ndarray:
    """Counts of the text's hashed subwords in BUCKETS; all 0 where the text has no letter."""
    return measured(text)[0]


def measured(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The counts, and the places of the text's subwords of KNOWN_ORDERS in the table of those met."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _letters()[codes]
    counts = np.zeros(BUCKETS, np.float32)
    if not inside.any():
        return counts, np.empty(0, np.int32)
    # one mark (0) on either side of each word
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    marked = np.where(inside, codes, 0)[keep].astype(np.uint64)
    marked = np.concatenate([np.zeros(1, np.uint64), marked, np.zeros(1, np.uint64)])
    ends = marked == 0
    places = [np.empty(0, np.int32)]
    for order in ORDERS:
        n = len(marked) - order + 1
        if n <= 0:
            continue
        mixed = np.full(n, order, np.uint64)
        for i in range(order):
            mixed = (mixed ^ marked[i : i + n]) * _FACTORS[i]
            mixed ^= mixed >> np.uint64(29)
        sound = ~ends[:n] if order == 1 else np.ones(n, bool)
        for i in range(1, order - 1):  # a mark only stands at an end
            sound &= ~ends[i : i + n]
        if order == 2:
            sound &= ~(ends[:n] & ends[1 : 1 + n])
        mixed = mixed[sound]
        counts += np.bincount((mixed >> np.uint64(13)).astype(np.int64) % BUCKETS, minlength=BUCKETS)
        if order in KNOWN_ORDERS:
            places.append((mixed >> np.uint64(64 - KNOWN_BITS)).astype(np.int32))
    return counts, np.concatenate(places)


@dataclass(frozen=True)
class Model:
    labels: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    met: np.ndarray
    least_known: float

    def known_share(self, places: np.ndarray) -> float:
        """Of a text's subwords, the share that training met; 1 for a text that is too short to have any."""
        return float(self.met[places].mean()) if len(places) else 1.0

    def logits(self, shares: np.ndarray) -> np.ndarray:
        return shares @ self.embeddings @ self.weights + self.bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(counts: list[tuple[np.ndarray, np.ndarray]], places: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int = 7) -> Model:
    """Train on four fifths of the rows and calibrate on the rest. counts: of each row the buckets of its subwords and how
    many lie there; places: the distinct places in the table of met subwords, and how often each is there."""

    def shares(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), BUCKETS), np.float32)
        for i, row in enumerate(rows):
            at, n = counts[row]
            out[i, at] = n / n.sum()
        return out

    names = sorted(set(labels))
    y = np.array([names.index(x) for x in labels], np.int64)
    random = np.random.default_rng(seed)
    order = random.permutation(len(y))
    held = order[: len(y) // 5]
    train = order[len(y) // 5 :]
    e = random.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32) * np.sqrt(DIMENSIONS)
    w = np.zeros((DIMENSIONS, len(names)), np.float32)
    b = np.zeros(len(names), np.float32)
    steps, done = EPOCHS * max(1, -(-len(train) // BATCH)), 0
    for _ in range(EPOCHS):
        for at in range(0, len(train), BATCH):
            rows = random.permutation(train)[:BATCH] if at == 0 and len(train) <= BATCH else train[at : at + BATCH]
            x = shares(rows)
            hidden = x @ e
            error = softmax(hidden @ w + b)
            error[np.arange(len(rows)), y[rows]] -= 1
            error /= len(rows)
            rate = RATE * (1 - done / steps)
            to_e = x.T @ (error @ w.T)
            w -= rate * hidden.T @ error
            b -= rate * error.sum(axis=0)
            e -= rate * 20 * to_e
            done += 1
        train = random.permutation(train)
    met = np.zeros(2**KNOWN_BITS, bool)
    for row in train:
        met[places[row][0]] = True
    check = held if len(held) else train
    logits = shares(check) @ e @ w + b
    # the temperature with the least log loss, and of those tried the softer one in ties
    tried = np.geomspace(0.25, 8, 41)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(check)), y[check]], 1e-12)).mean() for t in tried]
    temperature = float(tried[int(np.argmin(loss))])
    p = softmax(logits / temperature)
    right = p.argmax(axis=1) == y[check]

    def limit(values: np.ndarray) -> float:
        if not len(held) or not len(values):
            return 0.0
        least = float(np.sort(values)[int(len(values) * REJECT_SHARE)])
        # rows too few to show the share lower the odds by as much as they are too few
        few = min(1.0, len(values) * REJECT_SHARE)
        return min(MARGIN * least, few * least / (few * least + 1 - least))

    known = np.array([float(met[at] @ n / n.sum()) if len(at) else 1.0 for at, n in (places[k] for k in check[right])])
    return Model(names, e, w, b, temperature, limit(p.max(axis=1)[right]), met, limit(known))


def train(docs: DataFrame, eligible: Column, doc_id: str = "doc_id", text: str = "text", label: str = "lang", rows_a_label: int = ROWS_A_LABEL) -> Model | None:
    """A model from the eligible rows with a label: for each label at most rows_a_label of them, and SAMPLE_ROWS in all,
    those whose hashed ids are smallest (of rows with the same id and label, the one with the smallest text). Their subword
    counts meet in one task, which is bounded by SAMPLE_ROWS; only the model comes to the driver."""
    rows = docs.where(eligible & F.col(label).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(label).cast("string").alias("label"))
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    # a row for each label; with more labels than SAMPLE_ROWS one row of each is learnt
    n_labels = counts.count()
    each = max(1, min(rows_a_label, SAMPLE_ROWS // max(1, n_labels)))
    # some more than each, from which the smallest are taken
    share = counts.select("label", ((each + 5 * each**0.5) / F.col("n")).alias("share"))
    place = F.pmod(F.xxhash64("id"), F.lit(2**40)) / float(2**40)
    some = rows.join(small(share, n_labels, 64), "label").where(place < F.col("share")).groupBy("id", "label").agg(F.min("text").alias("text"), F.min(place).alias("place"))
    some = some.select("id", "text", "label", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, ranks, where, what, places, often = [], [], [], [], [], [], []
            for i, t, name, rank in zip(*(c.to_pylist() for c in batch.columns)):
                counts, place = measured(t or "")
                held = np.flatnonzero(counts)
                if len(held):
                    ids.append(i)
                    labels.append(name)
                    ranks.append(rank)
                    where.append(held.astype(np.int16))
                    what.append(counts[held])
                    place, n = np.unique(place, return_counts=True)
                    places.append(place)
                    often.append(n.astype(np.int32))
            ints = pa.list_(pa.int32())
            kinds = [batch.schema.field(0).type, pa.string(), pa.float64(), pa.list_(pa.int16()), pa.list_(pa.float32()), ints, ints]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((ids, labels, ranks, where, what, places, often), kinds)], names=["id", "label", "rank", "at", "n", "place", "often"])

    kind = docs.schema[doc_id].dataType.simpleString()
    counted = some.mapInArrow(run, f"id {kind}, label string, rank double, at array<smallint>, n array<float>, place array<int>, often array<int>")

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (model := _model(list(batches), each)) is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])
        pa.default_memory_pool().release_unused()

    found = counted.repartition(1).mapInArrow(learnt, "model binary").first()
    return None if found is None else pickle.loads(found["model"])


def _model(batches: list[pa.RecordBatch], each: int) -> Model | None:
    """The model of the counted rows, of which each label takes as many as each."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return None
    # rows stay where Arrow's batches put them; what is made for each row is a view, so nothing is held twice
    heads = pa.Table.from_batches([b.select(["id", "label", "rank"]) for b in batches])
    rows = heads.to_pandas().sort_values(["label", "rank", "id"], kind="stable").groupby("label", sort=False).head(each).sort_values(["id", "label"], kind="stable")

    def pieces(name: str) -> list[np.ndarray]:
        columns = [b.column(name) for b in batches]
        every = [x for c in columns for x in np.split(c.values.to_numpy(), c.offsets.to_numpy()[1:-1])]
        return [every[i] for i in rows.index]

    return fit(list(zip(pieces("at"), pieces("n"))), list(zip(pieces("place"), pieces("often"))), rows["label"].tolist())


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected; one pass over the texts."""
    outputs = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    kept = [c for c in docs.columns if c not in [f.name for f in outputs]]
    plain = docs.select(*[docs[c] for c in kept], docs[text].alias("_predicted_from"))
    schema = T.StructType([f for f in plain.schema.fields if f.name != "_predicted_from"] + outputs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x DIMENSIONS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = [measured(x.as_py() or "") for x in batch.column(batch.num_columns - 1)]
                counts = np.stack([x for x, _ in found])
                size = counts.sum(axis=1, keepdims=True)
                known = (size[:, 0] > 0) & (m is not None)
                names, scores = [UNKNOWN] * len(counts), np.zeros(len(counts))
                if m is not None:
                    p = softmax(m.logits(counts / np.maximum(size, 1)) / m.temperature)
                    names = [m.labels[k] if ok else UNKNOWN for k, ok in zip(p.argmax(axis=1), known)]
                    scores = np.where(known, p.max(axis=1), 0.0).astype(np.float64)
                gone = ~known
                if m is not None:
                    gone |= (scores < m.threshold) | np.array([m.known_share(x) < m.least_known for _, x in found])
                yield pa.RecordBatch.from_arrays(batch.columns[:-1] + [pa.array(names, pa.string()), pa.array(scores), pa.array(gone)], names=[f.name for f in schema.fields])

    return plain.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that training never sees: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_kept(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, lang) that the model, trained on them, doesn't reject."""
    model = train(docs, ~held_out())
    return predict(docs, model).where(~F.col("rejected")).select(*docs.columns)
