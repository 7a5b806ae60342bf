"""Byte-level BPE: encoding by a priority queue of merge ranks over a doubly linked symbol list, and decoding.

The vocabulary, merges and added tokens come from a tokenizer file of the tokenizers library (a parameter). Texts are
cut at added tokens, then into pre-tokens, and each pre-token is merged by rank; a merge whose symbols have changed
since it was queued is stale and is skipped. Decoding concatenates the vocabulary's byte strings.

Defined results: a null text encodes as no ids and decodes as an empty text; an empty table gives an empty result; null
ids decode as null; repeated rows are encoded one by one; texts of any length are encoded whole.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed values of the format: the pre-token pattern and the printable stand-ins of bytes.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WIDE = re.compile(r" (?:\s|\Z)|\A ")
#: Entries in each of the two look-ups of a Python worker, about 200 bytes each.
REMEMBERED = 600_000


def byte_letters() -> dict[str, int]:
    """The vocabulary's letter for each byte: printable Latin-1 stands for itself, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Remembered(dict):
    """Values that make() gave, by key; forgotten all at once when there are too many."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) < 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = value
        return value


class BytePairs:
    """The tables of one tokenizer file, with encode() and decode() of single texts."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        letter = byte_letters()
        self.bytes_of = {i: bytes(letter[c] for c in s) for s, i in spec["model"]["vocab"].items()}
        id_of = {b: i for i, b in self.bytes_of.items()}
        self.byte_id = [id_of[bytes([b])] for b in range(256)]
        #: by first id << 32 | second id, the pair's rank; by rank, the id that it merges into
        self.rank: dict[int, int] = {}
        self.into: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b = (bytes(letter[c] for c in x) for x in (a, b))
            self.rank[id_of[a] << 32 | id_of[b]] = rank
            self.into.append(id_of[a + b])
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")")
        self.pre = regex.compile(PRE_TOKEN)
        self.tokens = Remembered(self.merged)  # by pre-token
        self.spaced = Remembered(lambda word: b"".join(map(self.tokens.__getitem__, self.pre.findall(" " + word))))  # by what follows a space

    def merged(self, token: str) -> bytes:
        """The ids of one pre-token. The queue holds rank << 32 | place for each adjacent pair that can merge; an entry
        is stale when the pair now at its place has another rank."""
        ids = [self.byte_id[b] for b in token.encode()]
        n, rank, into = len(ids), self.rank, self.into
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [r << 32 | i for i in range(n - 1) if (r := rank.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            i, r = entry & 0xFFFFFFFF, entry >> 32
            j = after[i]
            if j < 0 or ids[i] < 0 or rank.get(ids[i] << 32 | ids[j]) != r:
                continue
            ids[i] = new = into[r]
            ids[j] = -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank.get(new << 32 | ids[k])) is not None:
                    heapq.heappush(queue, r << 32 | i)
            if (h := before[i]) >= 0 and (r := rank.get(ids[h] << 32 | new)) is not None:
                heapq.heappush(queue, r << 32 | h)
        found = [x for x in ids if x >= 0]
        return struct.pack(f"<{len(found)}I", *found)

    def plain(self, text: str) -> bytes:
        """The ids of a text without added tokens. A pre-token reaches across a space only where more white space or the
        end follows it; a text without such places is cut at its spaces and the pieces are looked up."""
        if not text:
            return b""
        if WIDE.search(text):
            return b"".join(map(self.tokens.__getitem__, self.pre.findall(text)))
        first, *rest = text.split(" ")
        return b"".join(map(self.tokens.__getitem__, self.pre.findall(first))) + b"".join(map(self.spaced.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        """All ids of a text, as little-endian unsigned 32-bit integers."""
        if not any(s in text for s in self.added):
            return self.plain(text)
        return b"".join(np.array([self.added[x]], "<u4").tobytes() if x in self.added else self.plain(x) for x in self.cut.split(text))

    def decode(self, ids) -> str:
        """The text of ids, added tokens included; bytes that aren't UTF-8 come as U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def byte_pairs(path: str) -> BytePairs:
    return BytePairs(path)


def with_column(df: DataFrame, out: str, kind: T.DataType, arrow: pa.DataType, source: str, make) -> DataFrame:
    """df with a column out that make() gives for each value of source, batch by batch; out replaces one of that name."""
    kept = [c for c in df.columns if c != out]
    plain = df.select(*[df[c] for c in kept], df[source].alias("_encoded_from"))
    schema = T.StructType([f for f in plain.schema.fields if f.name != "_encoded_from"] + [T.StructField(out, kind)])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), 512):
                batch = whole.slice(at, 512)
                yield pa.RecordBatch.from_arrays(batch.columns[:-1] + [make(batch.column(batch.num_columns - 1), arrow)], names=names)

    return plain.mapInArrow(run, schema)


def _lists(blobs: list[bytes], arrow: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *(len(b) // 4 for b in blobs)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(blobs), "<i4")))


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the ids of every whole text, an array<int>."""

    def make(column: pa.Array, arrow: pa.DataType) -> pa.Array:
        coder = byte_pairs(path)
        return _lists([coder.encode(x.as_py() or "") for x in column], arrow)

    return with_column(df, ids, T.ArrayType(T.IntegerType()), pa.list_(pa.int32()), text, make)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of its ids."""

    def make(column: pa.Array, arrow: pa.DataType) -> pa.Array:
        coder = byte_pairs(path)
        return pa.array([None if not x.is_valid else coder.decode(x.values.to_numpy(zero_copy_only=False).tolist()) for x in column], arrow)

    return with_column(df, text, T.StringType(), pa.string(), ids, make)
