"""Byte-level BPE by replaying the merges over a corpus.

A block of texts is split by the pattern and its different pieces are laid out in one array of symbols. An inverted index
leads from each mergeable pair (by the rank it merges to) to its positions; ranks are taken in order, every occurrence is
merged at once, and only the neighbours that a merge touched are looked up again. The result is that of merging each piece
alone, lowest rank first and leftmost first. Null is empty; repeated rows are encoded each.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tallyjoin.llm.arrow import blocks, tidied
from tallyjoin.llm.common import small_batches

NONE = np.int64(1 << 40)
#: Bytes of text whose pieces are merged together, and pieces that a task remembers before it forgets them all.
REPLAY, REMEMBERED = 3 << 19, 200_000


class Vocabulary:
    """Tokens of a rank file: for each mergeable pair of ids, the id it becomes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.bytes < 0).any():
            raise ValueError("every byte must be a token")
        pairs, first = {}, np.full(len(self.tokens), True)
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
                    # A part that is ranked after the whole could see a lower rank appear while it is merged.
                    for part in (a, b):
                        if rank < part:
                            first[part] = False
        self.all_at_once = first
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.made = keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order]
        lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.data = np.frombuffer(b"".join(self.tokens), np.uint8)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id that each pair becomes, or NONE."""
        if not len(self.keys):
            return np.full(len(a), NONE)
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], NONE)

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the pieces, none of which is empty."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(lengths)
        n = int(ends[-1]) if len(ends) else 0
        token = np.append(self.bytes[np.frombuffer(b"".join(pieces), np.uint8)], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1], before[ends - lengths] = n, n
        after[n] = n
        piece = np.repeat(np.arange(len(pieces)), lengths)
        rank = np.full(n + 1, NONE)
        inner = np.flatnonzero(after[:n] < n)
        rank[inner] = self.merged(token[inner], token[after[inner]])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def post(positions: np.ndarray) -> None:
            """Enter positions whose pair can merge under their rank."""
            ranks = rank[positions]
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            positions, ranks = positions[: (m := int(np.searchsorted(ranks, NONE)))], ranks[:m]
            if not m:
                return
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for part in np.split(positions, cuts) if len(cuts) else [positions]:
                r = int(rank[part[0]])
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        post(inner)
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])
            at = at[rank[at] == r]
            if len(at) > 1:
                if self.all_at_once[r]:
                    # Of places that overlap, take the first, third, and so on of each run.
                    linked = np.append(False, after[at[:-1]] == at[1:])
                    if linked.any():
                        k = np.arange(len(at))
                        at = at[(k - np.maximum.accumulate(np.where(linked, 0, k))) % 2 == 0]
                else:
                    leftmost = np.append(True, piece[at[1:]] != piece[at[:-1]])
                    post(at[~leftmost])
                    at = at[leftmost]
            if not len(at):
                continue
            gone = after[at]
            follow = after[gone]
            token[at], after[at], rank[gone] = r, follow, NONE
            inside = follow < n
            before[follow[inside]] = at[inside]
            prior = before[at]
            touched = np.unique(np.concatenate([at, prior[prior < n]]))
            right = after[touched]
            rank[touched] = np.where(right < n, self.merged(token[touched], token[right]), NONE)
            post(touched)
        return self._left(token[:n], after, before, piece, lengths)

    @staticmethod
    def _left(token: np.ndarray, after: np.ndarray, before: np.ndarray, piece: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids that are still linked, piece by piece."""
        n = len(token)
        live = np.zeros(n + 1, bool)
        live[np.cumsum(lengths) - lengths] = True
        live[after[:n][before[np.minimum(after[:n], n - 1)] == np.arange(n)]] = True if n else False
        live[n] = False
        kept = np.flatnonzero(live[:n])
        return token[kept].astype(np.uint32), np.append(0, np.cumsum(np.bincount(piece[kept], minlength=len(lengths))))

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        return self.data[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    """The vocabulary in a file of base64 tokens and ranks; every machine has the file."""
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())})


class Encoder:
    """Encodes texts by blocks and remembers the pieces it has met."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.find = vocabulary, regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.offsets = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.known) > REMEMBERED:
            self.forget()
        known, fresh, rows = self.known, [], []
        for text in texts:
            pieces = self.find(text)
            try:
                rows.append(np.array([known[p] for p in pieces], np.int64))
            except KeyError:
                for p in pieces:
                    if p not in known:
                        known[p] = len(known)
                        fresh.append(p.encode())
                rows.append(np.array([known[p] for p in pieces], np.int64))
        if fresh:
            self._learn(fresh)
        return [self._gather(row) for row in rows]

    def _learn(self, fresh: list[bytes]) -> None:
        whole = [self.vocabulary.ranks.get(p, -1) for p in fresh]
        ids, offsets = self.vocabulary.replay([p for p, r in zip(fresh, whole) if r < 0])
        whole = np.array(whole, np.int64)
        sizes = np.ones(len(fresh), np.int64)
        sizes[whole < 0] = np.diff(offsets)
        ends = np.cumsum(sizes)
        out = np.empty(int(ends[-1]), np.uint32)
        single = np.zeros(len(out), bool)
        single[(ends - 1)[whole >= 0]] = True
        out[single], out[~single] = whole[whole >= 0], ids
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + ends])
        self.ids = np.concatenate([self.ids, out])

    def _gather(self, row: np.ndarray) -> np.ndarray:
        starts, sizes = self.offsets[row], self.offsets[row + 1] - self.offsets[row]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for block in blocks(batches):
        held.append(block)
        size += block.nbytes
        if size >= REPLAY:
            yield held
            held, size = [], 0
    if held:
        yield held


def _coded(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...], back: bool) -> DataFrame:
    small_batches(docs.sparkSession)
    fields = [docs.schema[c] for c in keep]
    names = [*keep, "ids", *["decoded"] * back]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(path)
        encoder = Encoder(vocabulary, pattern)
        for group in _gathered(batches):
            rows = [t or "" for block in group for t in block.column(len(keep)).to_pylist()]
            found, begin = encoder.encode(rows), 0
            for block in group:
                part = found[begin : begin + block.num_rows]
                begin += block.num_rows
                new = [pa.array([x.astype("<u4").tobytes() for x in part], pa.binary())]
                if back:
                    new.append(pa.array([vocabulary.decode(x) for x in part], pa.binary()))
                yield pa.RecordBatch.from_arrays([*block.columns[:-1], *new], names=names)

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{c} binary" for c in names[len(keep) :]]
    return docs.select(*keep, "text").mapInArrow(tidied(run), ", ".join(schema))


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``ids``: each text's token ids as little-endian unsigned 32-bit integers."""
    return _coded(docs, path, pattern, keep, False)


def round_trip(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The same and ``decoded``: the bytes that the ids stand for, decoded in the same worker."""
    return _coded(docs, path, pattern, keep, True)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``: the bytes that the ids stand for."""
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(path)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids")).to_pylist()
            decoded = pa.array([vocabulary.decode(np.frombuffer(x or b"", "<u4")) for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=[*batch.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(tidied(run), schema + ", decoded binary")


def token_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The figures of the contract from round_trip()."""
    from pyspark.sql import functions as F

    df = round_trip(docs, path, pattern)
    n = F.expr("octet_length(ids) div 4").cast("bigint")
    return df.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
