"""Packing of token sequences by minimum bin slack.

A document is cut into full windows and a rest.  The rests wait in a histogram of
lengths.  A window starts with the longest rest; a dynamic programme over a
bitset (bit ``s`` is set if some multiset of the waiting lengths sums to ``s``)
finds the sum closest to the free room, and going back through the bitsets gives
how many rests of each length make it.  A found multiset is used as often as the
counts allow, so the number of programmes follows the number of distinct lengths
and not the number of documents.  Room that no multiset fills takes the head of a
waiting rest.

Packing is local to a task, in blocks of a fixed number of ids, and what does not
fill a window waits for the next block: nothing is shuffled, and a retried task
makes the same sequences.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import keyed_texts, strings
from webloom.llm.tokens import encoder

BLOCK_TOKENS = 4_000_000
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
_ARROW = pa.schema([(f.split()[0], pa.int64()) for f in PIECES.split(", ")])
_WITH_IDS = _ARROW.append(pa.field("ids", pa.binary()))


def closest_multiset(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take so that their sum is as close to ``room``
    from below as it can be; {length: number}."""
    lengths = sorted((n for n, c in counts.items() if c and n <= room), reverse=True)
    mask, reach, trail = (1 << (room + 1)) - 1, 1, []
    for n in lengths:
        most, step = min(counts[n], room // n), 1
        while most > 0 and not reach >> room & 1:
            take = min(step, most)
            trail.append((n, take, reach))
            reach |= reach << (n * take) & mask
            most, step = most - take, step * 2
        if reach >> room & 1:
            break
    at, picked = reach.bit_length() - 1, defaultdict(int)
    for n, take, before in reversed(trail):
        if not before >> at & 1:
            picked[n] += take
            at -= n * take
    return dict(picked)


class Packer:
    """Turns (key, ids) into pieces; holds at most a block and one window's worth of rests."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence = window, first_sequence
        self.waiting: dict[int, deque] = defaultdict(deque)
        self.heap: list[int] = []
        self.held = 0

    def add(self, key: int | None, ids: np.ndarray) -> Iterator[tuple]:
        total, full = len(ids), len(ids) - len(ids) % self.window
        for at in range(0, full, self.window):
            yield self._piece((key, ids, at, self.window, total), 0)
            self.sequence += 1
        if total > full:
            self._wait((key, ids, full, total - full, total))

    def _wait(self, rest: tuple) -> None:
        if not self.waiting[rest[3]]:
            heapq.heappush(self.heap, -rest[3])
        self.waiting[rest[3]].append(rest)
        self.held += rest[3]

    def _take(self, length: int) -> tuple:
        self.held -= length
        return self.waiting[length].popleft()

    def _piece(self, rest: tuple, offset: int) -> tuple:
        key, ids, at, length, total = rest
        raw = ids[at : at + length].tobytes()
        return key, at, length, zlib.crc32(raw), total, self.sequence, offset, raw

    def _longest(self) -> int:
        while not self.waiting[-self.heap[0]]:
            heapq.heappop(self.heap)
        return -self.heap[0]

    def drain(self, last: bool) -> Iterator[tuple]:
        """Fill windows while the rests suffice; at the end also the tail."""
        while self.held >= self.window:
            first = self._longest()
            counts = {n: len(q) for n, q in self.waiting.items() if q}
            counts[first] -= 1
            plan = closest_multiset(counts, self.window - first)
            plan[first] = plan.get(first, 0) + 1
            times = min((counts[n] + (n == first)) // c for n, c in plan.items())
            for _ in range(times):
                offset = 0
                for n in sorted(plan, reverse=True):
                    for _ in range(plan[n]):
                        yield self._piece(self._take(n), offset)
                        offset += n
                if offset < self.window:
                    yield from self._fill(offset)
                self.sequence += 1
                if self.held < self.window:
                    break
                if any(len(self.waiting[n]) < c for n, c in plan.items()):
                    break
        if last:
            yield from self._tail()

    def _fill(self, offset: int) -> Iterator[tuple]:
        """Heads of the longest rests in the room that is left."""
        while offset < self.window:
            key, ids, at, length, total = self._take(self._longest())
            used = min(length, self.window - offset)
            yield self._piece((key, ids, at, used, total), offset)
            offset += used
            if used < length:
                self._wait((key, ids, at + used, length - used, total))

    def _tail(self) -> Iterator[tuple]:
        """The last rests, in sequences of powers of two, which need no padding."""
        rests = [r for n in sorted(self.waiting, reverse=True) for r in self.waiting[n]]
        left, room, offset = sum(r[3] for r in rests), 0, 0
        for key, ids, at, length, total in rests:
            while length:
                if not room:
                    room, offset = 1 << (left.bit_length() - 1), 0
                used = min(length, room)
                yield self._piece((key, ids, at, used, total), offset)
                at, length, left = at + used, length - used, left - used
                room, offset = room - used, offset + used
                if not room:
                    self.sequence += 1
        self.waiting.clear()
        self.held = 0


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    window: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row per piece of a document and the place of the piece in a sequence.

    A null text is an empty one, which is its end id alone; documents of equal or
    null id are packed like others, each row by itself; an empty table gives no
    rows.  ``with_ids`` adds the ids of each piece, from which
    :func:`sequences` makes the training rows.
    """
    schema = _WITH_IDS if with_ids else _ARROW

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        out: list[tuple] = []
        seen = 0

        def block() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * 8
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), strings(batch.column("text"))):
                ids = enc.ids(text, end_id)
                out += packer.add(key, ids)
                seen += len(ids)
                if seen >= block_tokens:
                    out += packer.drain(last=False)
                    seen = 0
                    yield block()
        out += packer.drain(last=True)
        yield block()

    given = keyed_texts(docs, id_col, text_col)
    return given.mapInArrow(rows, PIECES + (", ids binary" if with_ids else ""))


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the packed ids, little-endian 32-bit.

    A sequence is one window at most, so its pieces are few.
    """
    ordered = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    held = pieces.groupBy("sequence_id").agg(ordered.alias("held"))
    joined = F.aggregate("held.ids", F.lit(b""), lambda acc, x: F.concat(acc, x))
    total = F.aggregate("held.length", F.lit(0).cast("long"), lambda acc, x: acc + x)
    return held.select("sequence_id", total.alias("n_tokens"), joined.alias("ids"))
