"""Byte-level BPE of a whole corpus by vectorised merging.

Texts are cut into runs of non-space and space.  Runs not seen before by a worker are cut by the tokenizer's own pattern
into pieces, and the pieces are merged together: pieces of similar length form one padded matrix of token ids; in each
round every row merges its leftmost pair of lowest rank, found through a hash table of pairs, and all rows that merged
shrink by one column.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the characters with Unicode's White_Space property.
SPACE = "\t-\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A run of non-space with the one space before it, or white space that stays apart; no piece of a GPT-2 style pattern crosses these.
RUNS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Pieces of more bytes are merged with a heap instead of a matrix row, whose cost grows with the square of the length.
LONG = 256
#: Runs a worker remembers before it starts anew; bounds its memory.
REMEMBERED = 400_000
NONE = np.int64(2**31 - 1)


@dataclass
class PairTable:
    """Ranks of token pairs in an open-addressed hash table; the rank of a pair is the id of the merged token."""

    keys: np.ndarray
    ranks: np.ndarray
    byte_ids: np.ndarray
    pattern: str
    longest_probe: int
    merges: dict[int, int] = field(default_factory=dict, repr=False)

    @staticmethod
    def build(vocabulary: dict[bytes, int], pattern: str) -> PairTable:
        pairs = {}
        for token, rank in vocabulary.items():
            for i in range(1, len(token)):
                a, b = vocabulary.get(token[:i]), vocabulary.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        wanted = np.fromiter(pairs, np.int64, len(pairs))
        found = np.fromiter(pairs.values(), np.int64, len(pairs))
        bits = max(4, int(np.ceil(np.log2(len(pairs) * 4 + 1))))
        keys, ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int64)
        slot, todo, probe = _hash(wanted, bits), np.arange(len(wanted)), 0
        while len(todo):
            free = keys[slot[todo]] == -1
            _, first = np.unique(np.where(free, slot[todo], -1), return_index=True)
            first = first[free[first]]
            put = todo[first]
            keys[slot[put]], ranks[slot[put]] = wanted[put], found[put]
            left = np.ones(len(todo), bool)
            left[first] = False
            todo = todo[left]
            slot[todo] = (slot[todo] + 1) & ((1 << bits) - 1)
            probe += 1
        byte_ids = np.array([vocabulary[bytes([i])] for i in range(256)], np.int64)
        return PairTable(keys, ranks, byte_ids, pattern, probe)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where the pair does not merge; negative ids are padding."""
        bits = len(self.keys).bit_length() - 1
        key = left << 32 | np.maximum(right, 0)
        slot = _hash(key, bits)
        here = self.keys[slot]
        out = np.where(here == key, self.ranks[slot], NONE)
        todo = np.flatnonzero((here != key) & (here != -1))
        for step in range(1, self.longest_probe + 1):
            if not len(todo):
                break
            at = (slot[todo] + step) & (len(self.keys) - 1)
            here = self.keys[at]
            hit = here == key[todo]
            out[todo[hit]] = self.ranks[at[hit]]
            todo = todo[~hit & (here != -1)]
        out[(left < 0) | (right < 0)] = NONE
        return out

    def rank(self, left: int, right: int) -> int:
        if not self.merges:
            held = self.keys >= 0
            self.merges = dict(zip(self.keys[held].tolist(), self.ranks[held].tolist()))
        return self.merges.get(left << 32 | right, int(NONE))


def _hash(key: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    return mixed.astype(np.int64)


def encode_pieces(pieces: list[bytes], table: PairTable) -> list[list[int]]:
    """Token ids of each piece."""
    out: list[list[int]] = [[]] * len(pieces)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ceiling = np.where(lengths <= 16, lengths, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
    for size in np.unique(ceiling).tolist():
        at = np.flatnonzero(ceiling == size)
        if size == 0:
            continue
        if size > LONG:
            for i in at.tolist():
                out[i] = _encode_long(pieces[i], table)
            continue
        for lo in range(0, len(at), 1 << 15):
            rows = at[lo : lo + (1 << 15)]
            raw = np.frombuffer(b"".join(pieces[i].ljust(size, b"\0") for i in rows.tolist()), np.uint8).reshape(-1, size)
            ids = np.where(np.arange(size) < lengths[rows, None], table.byte_ids[raw], -1)
            for i, found in zip(rows.tolist(), _merge_rows(ids, table)):
                out[i] = found
    return out


def _merge_rows(ids: np.ndarray, table: PairTable) -> list[list[int]]:
    out: list[list[int]] = [[]] * len(ids)
    row = np.arange(len(ids))
    ranks = table.lookup(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
    while True:
        at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(ids), np.int64)
        best = ranks[np.arange(len(ids)), at] if ranks.shape[1] else np.full(len(ids), NONE)
        done = best == NONE
        if done.any():
            for i, found in zip(row[done].tolist(), ids[done].tolist()):
                out[i] = [x for x in found if x >= 0]
            go = ~done
            ids, ranks, row, at, best = ids[go], ranks[go], row[go], at[go], best[go]
        if not len(ids):
            return out
        n, width = ids.shape
        every = np.arange(n)
        ids[every, at] = best
        keep = np.ones((n, width), bool)
        keep[every, at + 1] = False
        ids = ids[keep].reshape(n, width - 1)
        ranks = ranks[keep[:, 1:]].reshape(n, width - 2)
        # only the pairs on either side of the merged token are new
        before = at > 0
        ranks[every[before], at[before] - 1] = table.lookup(ids[every[before], at[before] - 1], ids[every[before], at[before]])
        after = at < width - 2
        ranks[every[after], at[after]] = table.lookup(ids[every[after], at[after]], ids[every[after], at[after] + 1])


def _encode_long(piece: bytes, table: PairTable) -> list[int]:
    """The same merges by a heap of (rank, place) over a linked list, for pieces of any length."""
    ids = table.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
    n = len(ids)
    following, preceding = list(range(1, n + 1)), list(range(-1, n - 1))
    none = int(NONE)
    heap = [(r, i) for i, r in enumerate(table.lookup(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64)).tolist()) if r != none]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = following[i] if ids[i] >= 0 else n
        if j >= n or table.rank(ids[i], ids[j]) != rank:
            continue
        ids[i], ids[j] = rank, -1
        k = following[i] = following[j]
        if k < n:
            preceding[k] = i
            if (r := table.rank(rank, ids[k])) != none:
                heapq.heappush(heap, (r, i))
        p = preceding[i]
        if p >= 0 and (r := table.rank(ids[p], rank)) != none:
            heapq.heappush(heap, (r, p))
    return [x for x in ids if x >= 0]


class Encoder:
    """Encodes batches of texts; remembers the runs it has met."""

    def __init__(self, table: PairTable):
        import regex

        self.table, self.pattern, self.known = table, regex.compile(table.pattern), {}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        runs = [RUNS.findall(t) if t else [] for t in texts]
        fresh = set().union(*map(set, runs)) - self.known.keys()
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known = {}
            fresh = set().union(*map(set, runs))
        cut = {run: self.pattern.findall(run) for run in fresh}
        pieces = list(set(chain.from_iterable(cut.values())))
        ids = dict(zip(pieces, encode_pieces([p.encode("utf-8", "surrogatepass") for p in pieces], self.table)))
        for run, parts in cut.items():
            self.known[run] = ids[parts[0]] if len(parts) == 1 else list(chain.from_iterable(ids[p] for p in parts))
        get = self.known.__getitem__
        return [list(chain.from_iterable(map(get, r))) for r in runs]


def load_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ids of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


_ENCODERS: dict[str, Encoder] = {}


def encoder_for(key: str, shared: Broadcast) -> Encoder:
    """The encoder of this worker process; it outlives a task, and with it the runs it remembers."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(shared.value)
    return _ENCODERS[key]


def encode_corpus(df: DataFrame, *, id: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None, batch_chars: int = 4_000_000) -> DataFrame:
    """(``id``, ids ARRAY<INT>): one row per row of ``df``, with the token ids of its text, without special tokens.

    NULL and empty texts give an empty list; NULL and repeated ids are kept as they are; special tokens' strings in a
    text are ordinary text.  ``path`` is a .tiktoken file and ``pattern`` its pre-tokenizer; without them those of
    byte_bpe_50k.  The pair table (a few MB, bounded by the vocabulary) is broadcast.  It is a narrow job without any
    exchange; texts are taken ``batch_chars`` characters at a time, a longer text by itself.  Other columns are not read.
    """
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    shared, key = df.sparkSession.sparkContext.broadcast(PairTable.build(load_ranks(path), pattern)), f"{path}\n{pattern}"
    rows = df.select(F.col(id), F.col(text).cast("string").alias("text_"))
    schema = T.StructType([T.StructField(id, rows.schema[0].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(key, shared)
        for whole in batches:
            size = np.cumsum(pc.fill_null(pc.utf8_length(whole.column(1)), 0).to_numpy(zero_copy_only=False)) // batch_chars
            for lo, hi in _spans(size):
                part = whole.slice(lo, hi - lo)
                ids = encoder.encode(part.column(1).to_pylist())
                offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))]).astype(np.int32)
                values = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=[id, "ids"])

    return rows.mapInArrow(run, schema)


def _spans(group: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the stretches of equal values."""
    cuts = np.flatnonzero(np.diff(group)) + 1
    edges = [0, *cuts.tolist(), len(group)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b > a]
