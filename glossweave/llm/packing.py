"""Packing into windows by multiway differencing (Karmarkar and Karp).

Every document becomes token ids with an end id.  Whole windows are cut from its front;
what is left is a tail.  Tails are gathered until they fill ``group`` windows but for
``slack`` ids each, and differencing deals them out: partial partitions are merged, the
most unequal two first, the largest sums of one onto the smallest of the other, which
leaves windows of nearly the same length.  Tails longer than a quarter of a window are cut
for that; if a window goes over the capacity, those longer than ``part`` are cut too, and
the group is dealt out again.  Pieces are of unlike lengths, since differencing balances
those best.  If even that goes over, the number of windows rises.

The end of a partition is dealt out in the same way, into as many windows as it fills;
less than a window is left then, and is cut at powers of two, so it needs no padding.

A group is bounded, so memory is; nothing is shuffled, and a lost task is made again
from its part of the input.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from glossweave.llm.common import map_arrow
from glossweave.llm.encode import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"
#: sequence_id = partition * PER_PARTITION + number in the partition.
PER_PARTITION = 1 << 40
#: Pieces of text whose ids a worker remembers.
MEMO = 250_000


def difference(lengths: list[int], k: int) -> list[list[int]]:
    """Indices of lengths in k sets of nearly equal sums."""
    heap = []
    for i, n in enumerate(lengths):
        heapq.heappush(heap, (-n, i, [(n, i)] + [(0, None)] * (k - 1)))
    at = len(lengths)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        c = [(x + y, p if q is None else q if p is None else (p, q)) for (x, p), (y, q) in zip(a, reversed(b), strict=True)]
        c.sort(key=lambda t: t[0], reverse=True)
        heapq.heappush(heap, (c[-1][0] - c[0][0], at, c))
        at += 1
    sets = []
    for _, tree in heap[0][2] if heap else []:
        items, todo = [], [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo.extend(x[::-1])
            elif x is not None:
                items.append(x)
        sets.append(items)
    return sets


def deal(lengths: list[int], capacity: int, least: int = 1) -> list[list[int]]:
    """Sets of indices, each of at most capacity: as few sets as differencing finds, ``least`` or more."""
    k = max(least, -(-sum(lengths) // capacity))
    while True:
        sets = difference(lengths, k)
        if all(sum(lengths[i] for i in s) <= capacity for s in sets):
            return [s for s in sets if s]
        k += 1


Piece = tuple[object, int, int]


def cut(tails: list[Piece], longest: int) -> list[Piece]:
    """The same ids in pieces (document, start, length) of at most ``longest``, of unlike lengths where one is cut."""
    out, cuts = [], 0
    for doc, start, n in tails:
        while n > longest:
            cuts += 1
            m = max(1, longest // 2 + cuts * 89 % max(1, longest // 2))
            out.append((doc, start, m))
            start, n = start + m, n - m
        out.append((doc, start, n))
    return out


class Packer:
    """Documents in, (document, start, length, sequence, offset, sequence length) out."""

    def __init__(self, capacity: int = 2048, group: int = 32, part: int = 320, slack: int = 12):
        if capacity < 1 or group < 1 or not 0 <= slack < capacity:
            raise ValueError("capacity and group must be positive, and slack less than capacity")
        self.capacity, self.group, self.slack, self.full = capacity, group, slack, group * (capacity - slack)
        self.levels = sorted({max(1, capacity // 4), max(1, min(part, capacity))}, reverse=True)
        self.tails: list[Piece] = []
        self.held = self.sequence = 0

    def window(self, parts: list[Piece]) -> Iterator[tuple]:
        size, offset = sum(n for _, _, n in parts), 0
        for doc, start, n in parts:
            yield doc, start, n, self.sequence, offset, size
            offset += n
        self.sequence += 1

    def add(self, doc: object, tokens: int) -> Iterator[tuple]:
        start = 0
        while tokens - start >= self.capacity:
            yield from self.window([(doc, start, self.capacity)])
            start += self.capacity
        while start < tokens:
            n = min(tokens - start, self.full - self.held)
            self.tails.append((doc, start, n))
            self.held += n
            start += n
            if self.held == self.full:
                yield from self.dealt(self.tails, self.group)
                self.tails, self.held = [], 0

    def sets(self, tails: list[Piece], k: int) -> list[list[Piece]] | None:
        """k windows by differencing, with as few cuts as balance them; None if there are none."""
        for longest in self.levels:
            pieces = cut(tails, longest)
            sets = difference([n for _, _, n in pieces], k)
            if all(sum(pieces[i][2] for i in s) <= self.capacity for s in sets):
                return [[pieces[i] for i in s] for s in sets if s]
        return None

    def dealt(self, tails: list[Piece], k: int) -> Iterator[tuple]:
        found = self.sets(tails, k)
        if found is None:
            pieces = cut(tails, self.levels[-1])
            found = [[pieces[i] for i in s] for s in deal([n for _, _, n in pieces], self.capacity, k + 1)]
        for parts in found:
            yield from self.window(parts)

    def end(self) -> Iterator[tuple]:
        """The rest: windows by differencing, with more room in each if they don't balance, then one for each power of two in what is left."""
        rest, room = self.tails, self.capacity - self.slack
        while k := sum(n for _, _, n in rest) // room:
            first, last = self._parted(rest, k * room)
            found = self.sets(first, k)
            if found is None and (wider := self.capacity - 2 * (self.capacity - room) - 1) > self.capacity // 2:
                room = wider
                continue
            if found is None:
                yield from self.dealt(first, k)
            for parts in found or ():
                yield from self.window(parts)
            rest = last
        while left := sum(n for _, _, n in rest):
            first, rest = self._parted(rest, 1 << (left.bit_length() - 1))
            yield from self.window(first)
        self.tails, self.held = [], 0

    def _parted(self, tails: list[Piece], ids: int) -> tuple[list[Piece], list[Piece]]:
        """The first ids of tails, and the rest; at most one tail is cut."""
        first, rest = [], []
        for doc, start, n in tails:
            m = min(n, ids)
            if m:
                first.append((doc, start, m))
            if m < n:
                rest.append((doc, start + m, n - m))
            ids -= m
        return first, rest


def pack(docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 1, capacity: int = 2048, group: int = 32, part: int = 320, slack: int = 12) -> DataFrame:
    """Pieces of all documents (doc_id, text) in sequences of at most ``capacity`` ids.

    One row per piece, as SCHEMA says: start counts the document's ids before the
    piece, offset its place in the sequence, doc_tokens includes the end id,
    sequence_length is the sequence's number of ids.  Null or empty text: the end id
    alone.  A null doc_id stays null.  Rows with the same doc_id are packed each for
    itself.  An empty table gives no rows; other columns are not read.
    """
    schema = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer, kind, "<u4", MEMO), Packer(capacity, group, part, slack)
        base, tail = TaskContext.get().partitionId() * PER_PARTITION, end_id.to_bytes(4, "little")

        def rows(found: list[tuple]) -> pa.RecordBatch:
            out = [(d[0], s, n, zlib.crc32(d[1][4 * s : 4 * (s + n)]), len(d[1]) // 4, base + q, o, z) for d, s, n, q, o, z in found]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

        found: list[tuple] = []
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) + tail
                found += packer.add((key, ids), len(ids) // 4)
                if len(found) > 1000:
                    yield rows(found)
                    found = []
        found += packer.end()
        if found:
            yield rows(found)

    return map_arrow(docs.select("doc_id", "text"), run, SCHEMA)
