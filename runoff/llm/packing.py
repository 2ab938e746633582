"""Best-fit packing of token pieces by local search.

Documents are tokenized, closed by END, and cut only where they are longer than a sequence. Pieces are dealt by hash
to groups of about GROUP pieces, which are packed apart: best fit, longest first, then local search among underfull
bins. A step moves a piece, or swaps one for one or two for one, to a bin at least as full, so the sum of squared fill
rises; the emptiest bins give first, so they run empty and go, and the fullest that can take do. Every underfull bin
gives and takes, until none has a step left. What lies in bins filled below LOOSE meets again in larger groups
for a second pass. Only identifiers, lengths and checksums are shuffled, never texts.

Defined results: null and empty texts are one token, END; texts of any length are cut into pieces, none is dropped. Rows that share an identifier are packed as documents of
their own. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runoff.llm.common import durable
from runoff.llm.tokens import default_path, encode, encoder
from runoff.llm.words import slices

LENGTH, END = 4096, 1
#: Pieces that are packed together.
GROUP = 20_000
#: Bins filled less than this part are packed again across groups.
LOOSE = 0.98


def token_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the identifiers themselves if with_ids."""
    path = path or default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in batches:
            for part in slices(batch):
                ids, bounds = encode(part.column("text"), words)
                names, rows = part.column("doc_id").to_pylist(), []
                for name, a, b in zip(names, bounds[:-1], bounds[1:], strict=True):
                    whole = np.append(ids[a:b], np.uint32(end)).astype("<u4")
                    for k, at in enumerate(range(0, len(whole), length)):
                        raw = whole[at : at + length].tobytes()
                        rows.append((name, k, at, len(raw) // 4, zlib.crc32(raw), raw))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                fields = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(columns[: 5 + with_ids], fields[: 5 + with_ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the bin that it fills most."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free room
    free, bins = 0, []  # bit r: some bin has room r
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        fits = free >> size << size
        if fits:
            r = (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free &= ~(1 << r)
            bins[b].append(item)
        else:
            r, b = capacity, len(bins)
            bins.append([item])
        if left := r - size:
            room[left].append(b)
            free |= 1 << left
    return bins


class _Bin:
    """An underfull bin's items, as the sums of one and of two of them, each by the items that make it."""

    def __init__(self, items: list[int], size: list[int]) -> None:
        self.items = items
        alike: dict[int, list[int]] = {}
        for i in items:
            alike.setdefault(size[i], []).append(i)
        self.fill = sum(size[i] for i in items)
        self.one = {v: (own[0],) for v, own in alike.items()}
        self.two = {2 * v: tuple(own[:2]) for v, own in alike.items() if len(own) > 1}
        values = sorted(alike)
        for k, v in enumerate(values):
            for w in values[k + 1 :]:
                self.two.setdefault(v + w, (alike[v][0], alike[w][0]))
        self.sums = np.array(list(self.one), np.int64), np.array(list(self.two), np.int64)
        back = {0: ()} | self.two | self.one  # what may come back for one item
        self.backs = (sorted(back), back), (values, self.one)

    def exchange(self, take: _Bin, room: int) -> tuple[tuple, tuple] | None:
        """The step to a bin at least as full that moves most: items that go, items that come back."""
        best, found = 0, None
        for ours, (values, back) in zip((self.one, self.two), take.backs, strict=True):
            for v, go in ours.items():
                k = bisect_left(values, v - room)  # the least that must come back
                if k < len(values) and v - values[k] > best:
                    best, found = v - values[k], (go, back[values[k]])
        return found


class _Takers:
    """For each sum of one and of two items, the two fullest bins with a step that takes it.

    Entries of a bin that changes go, so others may be missing until the next build, but none is wrong.
    """

    def __init__(self, bins: dict[int, _Bin], capacity: int) -> None:
        self.capacity = capacity
        self.fill = np.full((2, 2, capacity + 1), -1, np.int64)  # [one or two, first or second, sum]
        self.bin = np.full((2, 2, capacity + 1), -1, np.int64)
        for k in sorted(bins, key=lambda k: bins[k].fill):
            self.add(k, bins[k])

    def add(self, k: int, b: _Bin) -> None:
        room = self.capacity - b.fill
        if not room:
            return
        for (values, _), fill, bins in zip(b.backs, self.fill, self.bin, strict=True):
            low = np.array(values, np.int64)  # takes low + 1 to low + room
            step = np.bincount(low + 1, minlength=self.capacity + 2) - np.bincount(low + room + 1, minlength=self.capacity + 2)
            at = np.flatnonzero(np.cumsum(step[: self.capacity + 1]))
            first = at[b.fill > fill[0, at]]
            fill[1, first], bins[1, first] = fill[0, first], bins[0, first]
            fill[0, first], bins[0, first] = b.fill, k
            second = at[(b.fill > fill[1, at]) & (bins[0, at] != k)]
            fill[1, second], bins[1, second] = b.fill, k

    def drop(self, k: int) -> None:
        for fill, bins in zip(self.fill, self.bin, strict=True):
            first = np.flatnonzero(bins[0] == k)
            fill[0, first], bins[0, first] = fill[1, first], bins[1, first]
            second = np.concatenate([first, np.flatnonzero(bins[1] == k)])
            fill[1, second], bins[1, second] = -1, -1

    def fullest(self, k: int, b: _Bin) -> int | None:
        """The fullest bin, at least as full as b, bin k, that takes something of it."""
        most, found = b.fill - 1, None
        for sums, fill, bins in zip(b.sums, self.fill, self.bin, strict=True):
            if len(sums):
                own = (bins[0, sums] == k).astype(np.int64)
                full = fill[own, sums]
                at = int(full.argmax())
                if full[at] > most:
                    most, found = int(full[at]), int(bins[own[at], sums[at]])
        return found


def improve(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Local search on the underfull bins until none has a step to one at least as full."""
    size = lengths.tolist()
    packed = [list(b) for b in bins]
    under = {k: _Bin(b, size) for k, b in enumerate(packed) if sum(size[i] for i in b) < capacity}
    stepped = True
    while stepped:
        stepped, takers = False, _Takers(under, capacity)
        for g in sorted(under, key=lambda k: under[k].fill):
            give = under.get(g)
            if give is None:
                continue
            while give.items and (t := takers.fullest(g, give)) is not None:
                take = under[t]
                go, back = give.exchange(take, capacity - take.fill)
                give = _Bin([i for i in give.items if i not in go] + list(back), size)
                packed[t] = [i for i in take.items if i not in back] + list(go)
                takers.drop(t)
                under[t] = _Bin(packed[t], size)
                if under[t].fill == capacity:
                    del under[t]
                else:
                    takers.add(t, under[t])
            if give is not under[g]:
                stepped, packed[g] = True, give.items
                takers.drop(g)
                if give.items:
                    under[g] = give
                    takers.add(g, give)
                else:
                    del under[g]
    return [b for b in packed if b]


def _packed(pieces: DataFrame, level: int, group: int, capacity: int) -> DataFrame:
    """pieces with sequence_id, offset and the fill of their sequence."""
    groups = max(1, -(-pieces.count() // group))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "ids_crc32"], ignore_index=True)
        lengths = rows["length"].to_numpy()
        bins = improve(best_fit(lengths, capacity), lengths, capacity)
        order = np.concatenate([np.array(b) for b in bins])
        counts = np.array([len(b) for b in bins])
        rows = rows.iloc[order].reset_index(drop=True)
        sizes, which = rows["length"].to_numpy(), np.repeat(np.arange(len(bins)), counts)
        ends = np.cumsum(sizes)
        first = np.cumsum(counts) - counts
        before = (ends - sizes)[first]
        full = np.add.reduceat(sizes, first)
        return rows.drop(columns="_group").assign(sequence_id=(level << 60) + (int(key[0]) << 24) + which, offset=ends - sizes - before[which], _fill=full[which])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, _fill long"
    dealt = pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(level)), F.lit(groups)).alias("_group"))
    return dealt.groupBy("_group").applyInPandas(pack, schema)


def pack(pieces: DataFrame, capacity: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Every piece with its sequence_id and offset there; `pieces` are read more than once."""
    first = durable(_packed(pieces, 0, group, capacity))
    tight = first.where(F.col("_fill") >= LOOSE * capacity)
    again = _packed(first.where(F.col("_fill") < LOOSE * capacity).drop("sequence_id", "offset", "_fill"), 1, group, capacity)
    return tight.unionByName(again).drop("_fill")


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(durable(token_pieces(docs, doc_id, text)))
