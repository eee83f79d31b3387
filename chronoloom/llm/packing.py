"""Packing (operator 5): hierarchical multi-length packing.

Texts are encoded and packed block by block inside each task, so nothing is shuffled and memory is bounded by the
block. In a block, documents longer than the window first give whole windows; every rest is routed to the smallest
context tier that holds it. Each tier from the longest down opens sequences of its own size with its own documents;
gaps are filled from the shorter tiers, best fit first, and what no whole document fits is filled by cutting one. The
tail of a block moves on to the next block; the tail of a task is cut into power-of-two contexts, which need no
padding. Sequences of the whole table, longest first, are then dealt to step groups of the same number of tokens.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, rows
from .tokens import VOCABULARY, text_bytes

WINDOW = 2048
TIERS = (256, 512, 1024, 2048)
END = 1
BLOCK_TOKENS = 1 << 20
GROUP = 16

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, tier int, padded long, _before long"


class _Doc:
    __slots__ = ("key", "ids", "at", "total")

    def __init__(self, key, ids: np.ndarray):
        self.key, self.ids, self.at, self.total = key, ids, 0, len(ids)

    @property
    def left(self) -> int:
        return self.total - self.at


class Packer:
    """Packs blocks of one task. Pieces are tuples (document, start, length, sequence, offset)."""

    def __init__(self, window: int = WINDOW, tiers: tuple[int, ...] = TIERS):
        self.window, self.tiers = window, tuple(sorted(t for t in tiers if t < window)) + (window,)
        self.sequence = 0
        self.pieces: list[tuple[_Doc, int, int, int, int]] = []
        self.sizes: list[int] = []
        #: Tokens in earlier sequences of the same size, by sequence and by size.
        self.before: list[int] = []
        self.packed: dict[int, int] = {}

    def _take(self, doc: _Doc, n: int, offset: int) -> None:
        self.pieces.append((doc, doc.at, n, self.sequence, offset))
        doc.at += n

    def _close(self, size: int) -> None:
        self.sizes.append(size)
        self.before.append(self.packed.get(size, 0))
        self.packed[size] = self.before[-1] + size
        self.sequence += 1

    def pack(self, docs: list[_Doc]) -> list[_Doc]:
        """Fill sequences of each tier; returns the documents whose rests do not fill another one (under one window in all)."""
        window = self.window
        for doc in docs:
            while doc.left >= window:
                self._take(doc, window, 0)
                self._close(window)
        rest = [d for d in docs if d.left]
        # Each tier's documents by length, ties by arrival; tiers are looked up from the longest that can fit.
        shelf: dict[int, list[tuple[int, int]]] = {t: [] for t in self.tiers}
        for i, d in enumerate(rest):
            shelf[self.tiers[bisect.bisect_left(self.tiers, d.left)]].append((d.left, -i))
        for t in shelf:
            shelf[t].sort()

        def fitting(room: int) -> _Doc | None:
            """The longest document of at most `room` tokens."""
            for t in reversed(self.tiers):
                own = shelf[t]
                if own and own[0][0] <= room:
                    i = bisect.bisect_right(own, (room, 1)) - 1
                    return rest[-own.pop(i)[1]]
            return None

        def shortest() -> _Doc:
            for t in self.tiers:
                if shelf[t]:
                    return rest[-shelf[t].pop()[1]]
            raise LookupError

        for size in reversed(self.tiers):
            open_tokens = sum(n for t in self.tiers if t <= size for n, _ in shelf[t])
            while shelf[size] and open_tokens >= size:
                room = size
                while room:
                    doc = fitting(room)
                    if doc is None:  # cut one: the longest of the shortest tier loses its head, its rest is routed anew
                        doc = shortest()
                        self._take(doc, room, size - room)
                        i = len(rest)
                        rest.append(doc)
                        bisect.insort(shelf[self.tiers[bisect.bisect_left(self.tiers, doc.left)]], (doc.left, -i))
                        room = 0
                    else:
                        n = doc.left
                        self._take(doc, n, size - room)
                        room -= n
                self._close(size)
                open_tokens -= size
        return [rest[-i] for t in reversed(self.tiers) for _, i in reversed(shelf[t])]

    def tail(self, docs: list[_Doc]) -> None:
        """Power-of-two contexts for what is left: the binary digits of its length, longest first."""
        total = sum(d.left for d in docs)
        queue = [d for d in docs if d.left]
        for bit in reversed(range(total.bit_length())):
            size = 1 << bit
            if not total & size:
                continue
            room = size
            while room:
                n = min(room, queue[0].left)
                self._take(queue[0], n, size - room)
                room -= n
                if not queue[0].left:
                    queue.pop(0)
            self._close(size)


def step_groups(pieces: DataFrame, tokens: int) -> DataFrame:
    """Replaces _before (tokens in the task's earlier sequences of the same size) by step_group.

    Sequences stand in one row, longest first, then by task. They are cut into as few groups as hold `tokens` each on
    average at most; a group's tokens differ from that average by less than one window.
    """
    task = F.shiftright("sequence_id", 36)
    counts = pieces.groupBy(task.alias("_task"), "tier").agg(F.max(F.col("_before") + F.col("tier")).alias("n")).collect()
    at, starts = 0, []
    for r in sorted(counts, key=lambda r: (-r.tier, r["_task"])):
        starts.append((r["_task"], r.tier, at))
        at += r.n
    table = F.broadcast(rows.small_table(pieces.sparkSession, starts, "_task long, tier int, _start long"))  # a row a task and size
    group = F.expr(f"CAST(CAST(_start + _before AS DECIMAL(20, 0)) * {-(-at // tokens)} DIV {max(at, 1)} AS LONG)")
    return pieces.withColumn("_task", task).join(table, ["_task", "tier"]).select(*[group.alias("step_group") if c == "_before" else F.col(f"`{c}`") for c in pieces.columns])


def pack(df: DataFrame, path: str | None = None, *, window: int = WINDOW, tiers: tuple[int, ...] = TIERS, end: int | None = END, block_tokens: int = BLOCK_TOKENS, group: int = GROUP, with_ids: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, padded, step_group, ids
    (unless with_ids is false).

    Every token id of every row (with `end` after its text) lies in exactly one piece; offsets are gapless from 0 in a
    sequence; a sequence has as many tokens as a tier (`tier` is its size) or, at the end of a task, a power of two.
    `padded` is what padding to the window would add (0 here). Null texts count as empty and give their end token alone; with end=None they give no
    piece. Null keys and repeated rows are packed as they are. Other columns of df are not carried. step_group numbers
    groups of `group` windows, or as many tokens in shorter sequences, over the whole table.
    """
    path = path or bpe.vocabulary_path(VOCABULARY)
    kind = df.schema[key].dataType.simpleString()
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "padded", "_before", *["ids"] * with_ids]

    def run(batches):
        from pyspark import TaskContext

        coder, packer = bpe.encoder(path), Packer(window, tiers)
        first = TaskContext.get().partitionId() << 36
        key_type = None

        def flush():
            pieces, packer.pieces = packer.pieces, []
            for i in range(0, len(pieces), 2048):
                part = pieces[i : i + 2048]
                ids = [d.ids[s : s + n] for d, s, n, _, _ in part]
                seq = np.array([p[3] for p in part], np.int64)
                size = np.array([packer.sizes[p[3]] for p in part], np.int64)
                whole = np.isin(size, packer.tiers) | ((size & (size - 1)) == 0)
                cols = [
                    pa.array([p[0].key for p in part], key_type),
                    pa.array([p[1] for p in part], pa.int64()),
                    pa.array([p[2] for p in part], pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    pa.array([p[0].total for p in part], pa.int64()),
                    pa.array(seq + first),
                    pa.array([p[4] for p in part], pa.int64()),
                    pa.array(size.astype(np.int32)),
                    pa.array(np.where(whole, 0, window - size)),
                    pa.array([packer.before[p[3]] for p in part], pa.int64()),
                ]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=names)

        held, tokens = [], 0
        for batch in rows.slices(batches, text, rows.FINE):
            key_type = batch.schema.field(0).type
            data, offsets = text_bytes(batch, text)
            flat, counts = coder.encode(data, offsets)
            at = 0
            for k, n in zip(batch.column(0).to_pylist(), counts.tolist(), strict=True):
                ids = flat[at : at + n]
                at += n
                if end is not None:
                    ids = np.append(ids, np.int32(end))
                if len(ids):
                    held.append(_Doc(k, ids))
                    tokens += len(ids)
            if tokens >= block_tokens:
                held = packer.pack(held)
                tokens = sum(d.left for d in held)
                yield from flush()
        packer.tail(packer.pack(held))
        yield from flush()

    pieces = rows.arrow_map(df.select(key, text), run, f"`{key}` {kind}, {SCHEMA}" + ", ids array<int>" * with_ids)
    return step_groups(rows.checkpoint(pieces), group * window)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(rows.documents(spark, sf_dir), with_ids=False)
