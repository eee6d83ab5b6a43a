"""Removal of repeated byte strings by external induced sorting of suffixes.

A string of ``length`` bytes contains one *anchor*: the place of its least
``GRAM``-byte hash, which depends on its bytes alone. Equal strings therefore have equal
anchors at equal distances, and a string can repeat only if its anchor's gram does.

1. Sampling: every text is cut at its anchors. An anchor stands for the strings that it
   is the anchor of; together they span one segment of the text. Equal segments get one
   name and a count, so copies are sorted once.
2. Segments whose gram occurs once are left out. They can hold no repeated string.
3. The suffixes that begin at anchors are sorted through a priority queue which spills
   sorted runs to disk, and neighbours get the length of their common prefix.
4. Induction: tuples (suffix, common prefix with the one before) are popped in order and
   pushed, with the byte further left as key, into a monotone queue that has a bucket on
   disk for each byte. Popped again they are in the order of the longer suffixes; a common
   prefix has grown by one, or is the least of those in between. Repeated to the segments'
   left ends, each queue filled from the last, this sorts every suffix of every segment
   from the sampled ones. A step streams blocks of ``_BLOCK`` tuples; tuples, bytes and
   rows are in files of the task once they exceed ``memory`` bytes, so a shard can be far
   larger than memory.
5. A string is repeated if a neighbour shares ``length`` bytes or its segment has
   copies. The spans found are brought back to the texts.

Shards are keyed by the gram, so a string never meets its copies across shards. A gram
that occurs more than ``CROWD`` times is keyed by the bytes around it as well, once for
each of ``PARTS`` ranges of the distance at which a string begins; segments that are alone
with their key are passed over.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U64

LENGTH = 400
GRAM = 100
MEMORY = 64 << 20
#: A gram that occurs more often is split by the bytes around it.
CROWD = 1024
PARTS = 3
_POSITION_BITS = 23
_PIECE = 1 << 21


class SpillingQueue:
    """A priority queue for items that are all pushed before the first is popped. It
    holds ``memory`` bytes, then writes sorted runs to unnamed temporary files of the
    task and merges them."""

    def __init__(self, memory: int = MEMORY) -> None:
        self.memory, self.held, self.items, self.runs = memory, 0, [], []

    def push(self, item: tuple, size: int) -> None:
        self.items.append(item)
        self.held += size
        if self.held > self.memory:
            self.spill()

    def spill(self) -> None:
        run = tempfile.TemporaryFile()
        for item in sorted(self.items):
            pickle.dump(item, run, protocol=5)
        run.seek(0)
        self.runs.append(run)
        self.items, self.held = [], 0

    @staticmethod
    def _read(run) -> Iterator[tuple]:
        while True:
            try:
                yield pickle.load(run)
            except EOFError:
                run.close()
                return

    def __iter__(self) -> Iterator[tuple]:
        self.items.sort()
        return heapq.merge(iter(self.items), *map(self._read, self.runs))


def _anchors(values: list[bytes], length: int, gram: int) -> dict[str, np.ndarray]:
    """Anchors of values joined into one buffer: value index, place, first and last
    start of its strings, the gram's hash and the segment's name."""
    data = np.frombuffer(b"".join(values), np.uint8)
    sizes = np.array([len(v) for v in values])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    prefix = common.prefix_hash(data)
    n = len(data) - gram + 1
    place = np.arange(n)
    grams = common.span_hash(prefix, place, place + gram)
    key = (grams >> U64(_POSITION_BITS) << U64(_POSITION_BITS)) | place.astype(U64)
    window, width = length - gram + 1, 1
    while width * 2 <= window:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < window:
        key = np.minimum(key[: n - window + 1], key[window - width : window - width + n - window + 1])
    chosen = (key & U64((1 << _POSITION_BITS) - 1)).astype(np.int64)
    start = np.arange(len(chosen))
    value = np.searchsorted(begin, start, "right") - 1
    inside = start + length <= begin[value + 1]
    start, chosen, value = start[inside], chosen[inside], value[inside]
    new = np.ones(len(start), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    x, lo, hi = chosen[first], start[first], start[last]
    name = common.span_hash(prefix, lo, hi + length) + (x - lo).astype(U64) * U64(0x9FB21C651E98DF25)
    return {"value": value[first], "x": x - begin[value[first]], "before": x - lo, "after": x - hi, "h": grams[x].view(np.int64), "u": common.mix(name).view(np.int64)}


def _anchor_frames(frames: Iterator[pd.DataFrame], length: int, gram: int) -> Iterator[pd.DataFrame]:
    """Texts are encoded and cut range by range; no batch of rows is held twice."""
    for pdf in frames:
        ids, ks = pdf["doc_id"], pdf["k"].to_numpy()
        for first, _, values in common.text_batches(pdf["text"].tolist()):
            pieces, owner, offset = [], [], []
            for i, v in enumerate(values, first):
                for at in range(0, max(len(v) - length, -1) + 1, _PIECE - length + 1):
                    pieces.append(v[at : at + _PIECE])
                    owner.append(i)
                    offset.append(at)
            owner, offset = np.array(owner, np.int64), np.array(offset, np.int64)
            for lo, hi in common.batches_by_bytes(pieces, 1 << 20):
                got = _anchors(pieces[lo:hi], length, gram)
                of = got.pop("value") + lo
                got["x"] = got["x"] + offset[of]
                yield pd.DataFrame({"doc_id": ids.iloc[owner[of]].array, "k": ks[owner[of]], **got})


def anchors(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, k, x (place in bytes), before and after (the farthest and nearest start
    of its strings, counted back from x), h (gram), u (segment)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _anchor_frames(frames, length, gram)

    return docs.mapInPandas(run, "doc_id long, k long, x long, before int, after int, h long, u long")


_ROW = np.dtype([("u", "<i8"), ("h", "<i8"), ("group", "<i8"), ("before", "<i4"), ("after", "<i4"), ("many", "?")])
_LEFTS = 1 << 13


class Shard:
    """The segments of one sort, taken in one by one: what lies right of the anchors goes
    to a spilling queue, what lies left and the rows' numbers to files once they exceed
    ``memory`` bytes. Rows of one key come one after the other."""

    def __init__(self, length: int, memory: int = MEMORY) -> None:
        self.length, self.memory = length, memory
        self.queue = SpillingQueue(memory)
        self.n = self.size = self.deepest = 0
        self.group, self.key = -1, None
        self.rows, self.lefts = (tempfile.SpooledTemporaryFile(memory // 8) for _ in range(2))

    def add(self, key: tuple, u: int, h: int, copies: int, before: int, after: int, segment: bytes) -> None:
        if key != self.key:
            self.group, self.key = self.group + 1, key
        self.rows.write(np.array([(u, h, self.group, before, after, copies > 1)], _ROW).tobytes())
        self.lefts.write(segment[:before].rjust(self.length, b"\0"))
        self.queue.push((self.group, segment[before:], self.n), len(segment) + 80)
        self.n += 1
        self.size += len(segment)
        self.deepest = max(self.deepest, before)

    def table(self) -> np.ndarray:
        self.rows.seek(0)
        if self.n * _ROW.itemsize <= self.memory // 8:
            return np.frombuffer(self.rows.read(), _ROW)
        self.rows.rollover()
        return np.memmap(self.rows, _ROW, "r", shape=self.n)

    def left(self) -> np.ndarray:
        """For each distance before the anchors, the rows' bytes."""
        shape = (self.deepest + 1, self.n)
        out = np.memmap(tempfile.TemporaryFile(), np.uint8, "w+", shape=shape) if shape[0] * self.n > self.memory else np.zeros(shape, np.uint8)
        self.lefts.seek(0)
        for at in range(0, self.n, _LEFTS):
            block = np.frombuffer(self.lefts.read(_LEFTS * self.length), np.uint8).reshape(-1, self.length)
            out[1:, at : at + len(block)] = block[:, ::-1].T[: self.deepest]
        self.lefts.close()
        return out


_TUPLE = np.dtype([("row", "<i8"), ("lcp", "<i4"), ("open", "<i4")])
_FAR = np.int32(1 << 30)
_BLOCK = 1 << 17


class TupleFile:
    """Suffix tuples in the order in which they were added, in memory up to ``memory``
    bytes, then in a file of the task."""

    def __init__(self, memory: int) -> None:
        self.file, self.n = tempfile.SpooledTemporaryFile(memory), 0

    def add(self, tuples: np.ndarray) -> None:
        self.file.write(tuples.tobytes())
        self.n += len(tuples)

    def blocks(self) -> Iterator[np.ndarray]:
        self.file.seek(0)
        for at in range(0, self.n, _BLOCK):
            yield np.frombuffer(self.file.read(min(_BLOCK, self.n - at) * _TUPLE.itemsize), _TUPLE)
        self.file.close()


class InductionQueue:
    """A monotone priority queue of tuples by group and byte: tuples come group by group
    and leave by (group, byte), equal ones in the order in which they came. Each keeps as
    ``lcp`` one more than the least of its own and those that came since the last one of
    its byte; the first of a byte has 0.

    Whole groups of a block are sorted in memory. A group that goes on in the next block
    has a ``TupleFile`` for each byte, and of each byte the least ``lcp`` since its last
    tuple is held."""

    def __init__(self, memory: int) -> None:
        self.memory, self.out = memory, TupleFile(memory)
        self.group = None
        self._reset()

    def _reset(self) -> None:
        self.buckets: dict[int, TupleFile] = {}
        self.least = np.full(256, _FAR, np.int32)

    def _flush(self) -> None:
        for byte in sorted(self.buckets):
            for block in self.buckets[byte].blocks():
                self.out.add(block)
        self._reset()

    def push(self, block: np.ndarray, groups: np.ndarray, byte: np.ndarray, alive: np.ndarray, more: bool) -> None:
        """``alive``: which tuples of ``block`` are extended; the others' ``lcp`` count
        for those around them. ``more``: another block follows."""
        lcp = block["lcp"]
        at = np.flatnonzero(alive)
        keys = groups[at] * 256 + byte[at]
        by = np.argsort(keys, kind="stable")
        at, keys = at[by], keys[by]
        new = np.ones(len(at), bool)
        new[1:] = keys[1:] != keys[:-1]
        padded = np.append(lcp, _FAR)
        close = np.zeros(len(at), np.int32)
        again = np.flatnonzero(~new)
        if len(again):
            close[again] = np.minimum.reduceat(padded, np.stack([at[again - 1] + 1, at[again] + 1], 1).ravel())[::2] + 1
        if self.group is not None and len(at):
            # What came before this block of the group that goes on in it.
            first = np.flatnonzero(new & (groups[at] == self.group))
            running = np.minimum.accumulate(lcp)
            known = np.minimum(self.least[byte[at[first]]], running[at[first]])
            seen = np.array([int(b) in self.buckets for b in byte[at[first]]], bool)
            close[first[seen]] = known[seen] + 1
        out = block[at]
        out["lcp"] = close
        own = groups[at]
        if self.group is not None:
            if self.group == groups[-1] and more:
                self._extend(out, byte[at], at, padded)
                return
            goes_on = own == self.group
            self._extend(out[goes_on], byte[at[goes_on]], at[goes_on], padded)
            self._flush()
            out, at, own = out[~goes_on], at[~goes_on], own[~goes_on]
            self.group = None
        if more:
            self.group = groups[-1]
            last = own == self.group
            self.out.add(out[~last])
            self._extend(out[last], byte[at[last]], at[last], padded)
        else:
            self.out.add(out)

    def _extend(self, tuples: np.ndarray, byte: np.ndarray, at: np.ndarray, padded: np.ndarray) -> None:
        """Tuples of the group that may go on, sorted by byte, with their places in the block."""
        whole = padded.min()
        present = np.unique(byte)
        for b in self.buckets.keys() - set(present.tolist()):
            self.least[b] = min(self.least[b], whole)
        for b in present.tolist():
            lo, hi = np.searchsorted(byte, [b, b + 1])
            if b not in self.buckets:
                self.buckets[b] = TupleFile(self.memory // 256)
            self.buckets[b].add(tuples[lo:hi])
            self.least[b] = padded[at[hi - 1] + 1 :].min()

    def popped(self) -> Iterator[np.ndarray]:
        self._flush()
        return self.out.blocks()


def _sampled(shard: Shard) -> Iterator[np.ndarray]:
    """The tuples of the suffixes that begin at anchors, in order."""
    block, prev_group, prev = [], -1, b""
    for g, right, i in shard.queue:
        m = min(len(right), len(prev)) if g == prev_group else 0
        if right[:m] != prev[:m]:
            m = int((np.frombuffer(right, np.uint8, m) != np.frombuffer(prev, np.uint8, m)).argmax())
        block.append((i, m, -1))
        prev_group, prev = g, right
        if len(block) == _BLOCK:
            yield np.array(block, _TUPLE)
            block = []
    if block:
        yield np.array(block, _TUPLE)


def _with_next(blocks: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.int32, bool]]:
    """Each block with the next one's first ``lcp`` and whether there is a next one."""
    held = None
    for block in blocks:
        if held is not None:
            yield held, block["lcp"][0], True
        held = block
    if held is not None:
        yield held, np.int32(0), False


def repeated_starts(shard: Shard) -> Iterator[np.ndarray]:
    """The induced sort of one shard. Gives arrays of (row, from, to): runs of distances
    before the row's anchor at which a repeated string begins."""
    if not shard.n:
        return
    rows, left, length, closed = shard.table(), shard.left(), shard.length, []

    def close(row: np.ndarray, start: np.ndarray, end: int) -> None:
        if len(row):
            closed.append(np.stack([row, start.astype(np.int64), np.full(len(row), end)], 1))

    def judged(blocks: Iterator[np.ndarray], d: int) -> Iterator[tuple[np.ndarray, bool]]:
        """Opens and closes runs at distance ``d``; now and then leaves out suffixes that
        cannot repeat any more, their ``lcp`` going to those after them."""
        pending, begun = _FAR, False
        for block, following, more in _with_next(blocks):
            row, lcp, opened = block["row"], block["lcp"], block["open"]
            best = np.maximum(lcp, np.append(lcp[1:], following))
            many, before = rows["many"][row], rows["before"][row]
            hit = ((best >= length) | many) & (rows["after"][row] <= d)
            over = ~hit & (opened >= 0)
            close(row[over], opened[over], d - 1)
            block = block.copy()
            block["open"] = np.where(hit, np.where(opened < 0, d, opened), -1)
            if d % 8 == 0:
                keep = np.flatnonzero(many | (best + (before - d) >= length))
                padded = np.append(lcp, _FAR)
                if len(keep):
                    cut = np.minimum.reduceat(padded, np.stack([np.append(0, keep[:-1] + 1), keep + 1], 1).ravel())[::2]
                    cut[0] = min(cut[0], pending) if begun else 0
                    pending, begun = padded[keep[-1] + 1 :].min(), True
                    block = block[keep]
                    block["lcp"] = cut
                else:
                    pending, block = min(pending, lcp.min()), block[:0]
            if len(block):
                yield block, more

    blocks = _sampled(shard)
    for d in range(shard.deepest + 1):
        queue = InductionQueue(shard.memory // 8)
        held = None
        for block, _ in judged(blocks, d):
            if held is not None:
                _push(queue, held, rows, left, d + 1, True, close)
            held = block
        if held is not None:
            _push(queue, held, rows, left, d + 1, False, close)
        if sum(map(len, closed)) >= _LEFTS or d == shard.deepest and closed:
            yield np.concatenate(closed)
            closed.clear()
        blocks = queue.popped()


def _push(queue: InductionQueue, block: np.ndarray, rows: np.ndarray, left: np.ndarray, d: int, more: bool, close) -> None:
    """Push a block's suffixes that reach ``d`` bytes before their anchor; runs of the
    others end."""
    row = block["row"]
    alive = rows["before"][row] >= d
    done = ~alive & (block["open"] >= 0)
    close(row[done], block["open"][done], d - 1)
    byte = left[d][row] if d < len(left) else np.zeros(len(row), np.uint8)
    queue.push(block, rows["group"][row], byte.astype(np.int64), alive, more)


def _sorted_shards(segments: DataFrame, length: int, memory: int) -> DataFrame:
    """(h, u, near, far), a row for each run of distances before the anchor, for the
    segments (h, part, u, copies, before, after, segment)."""

    def flush(shard: Shard) -> Iterator[pd.DataFrame]:
        if not shard.n:
            return
        rows = shard.table()
        for found in repeated_starts(shard):
            own = rows[found[:, 0]]
            yield pd.DataFrame({"h": own["h"], "u": own["u"], "near": found[:, 1], "far": found[:, 2]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, last, lone = Shard(length, memory), None, None
        for pdf in frames:
            for h, part, u, copies, before, after, segment in zip(*(pdf[c].tolist() for c in ("h", "part", "u", "copies", "before", "after", "segment"))):
                key, row = (h, part), (u, h, copies, before, after, bytes(segment))
                if key != last:
                    if shard.size > memory:
                        yield from flush(shard)
                        shard = Shard(length, memory)
                    # The only segment of its key waits for another; alone it repeats nothing.
                    last, lone = key, row if copies == 1 else None
                    if lone:
                        continue
                if lone:
                    shard.add(key, *lone)
                    lone = None
                shard.add(key, *row)
        yield from flush(shard)

    parts = common.n_partitions(segments.sparkSession)
    return segments.repartition(parts, "h", "part").sortWithinPartitions("h", "part", "u").mapInPandas(run, "h long, u long, near int, far int")


def _parted(before: int, after: int, segment: bytes, length: int, gram: int) -> Iterator[tuple[int, int, int, bytes]]:
    """The segment of a crowded gram, cut for ``PARTS`` ranges of distances at which a
    string begins: (part, before, after, segment). All strings of a range share the bytes
    around the anchor of which ``part`` is a hash, so equal strings meet in one part."""
    step = -(-(length - gram) // PARTS) or 1
    for j in range(0, max(1, length - gram), step):
        far, near = min(before, j + step), max(after, j)
        if near <= far:
            core = segment[before - j : before + length - min(j + step, length - gram)]
            part = int.from_bytes(hashlib.blake2b(core, digest_size=8, salt=b"%d" % (j // step)).digest(), "little", signed=True)
            yield part, far, near, segment[before - far : before - near + length]


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, memory: int = MEMORY, crowd: int = CROWD) -> DataFrame:
    """(doc_id, k, spans): for each text with repeated strings, pairs of byte offsets
    flattened to one array, not yet merged. ``docs``: doc_id, k (hash of text), text."""
    found = common.stage(anchors(docs, length, gram))
    # Written first: both sides of the join are then plain shuffles, and the rows of a gram
    # that is everywhere can be dealt to several tasks.
    twice = common.stage(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", (F.col("n") > crowd).alias("crowded")))
    kept = common.stage(found.join(twice, "h"))
    common.drop_stage(found)
    named = kept.groupBy("h", "u").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "k", "x", "before", "after", "crowded")).alias("at"))
    wanted = named.select(F.col("at.doc_id").alias("doc_id"), F.col("at.k").alias("k"), F.struct("h", "u", "copies", "at.x", "at.before", "at.after", "at.crowded").alias("s"))
    wanted = wanted.groupBy("doc_id", "k").agg(F.collect_list("s").alias("wanted"))
    texts = docs.select(F.col("doc_id").alias("id"), F.col("k").alias("key"), "text")
    joined = texts.join(wanted, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("k"))).select("text", "wanted")

    columns = ["h", "part", "u", "copies", "before", "after", "segment"]

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for text, want in zip(pdf["text"], pdf["wanted"]):
                value = common.utf8(text)
                for s in want:
                    segment = value[s["x"] - s["before"] : s["x"] - s["after"] + length]
                    rows = _parted(s["before"], s["after"], segment, length, gram) if s["crowded"] else [(0, s["before"], s["after"], segment)]
                    out.extend((s["h"], part, s["u"], s["copies"], before, after, own) for part, before, after, own in rows)
                    if len(out) >= 2_000:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
            if out:
                yield pd.DataFrame(out, columns=columns)

    segments = joined.mapInPandas(cut, "h long, part long, u long, copies long, before int, after int, segment binary").dropDuplicates(["h", "u", "part"])
    runs = _sorted_shards(segments, length, memory)
    span = F.struct((F.col("x") - F.col("far")).alias("s"), (F.col("x") - F.col("near") + length).alias("e"))
    hits = kept.join(runs, ["h", "u"]).select("doc_id", "k", span.alias("p"))
    return hits.groupBy("doc_id", "k").agg(F.collect_list("p").alias("spans"))


def _kept_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What is left of the texts (doc_id, text, spans), a frame for each range of them."""
    for pdf in frames:
        spanned = pdf["spans"].tolist()
        for lo, hi, values in common.text_batches(pdf["text"].tolist()):
            sizes, merged, kept = [], [], []
            for value, spans in zip(values, spanned[lo:hi]):
                out, parts, at = [], [], 0
                if spans is not None:
                    for s, e in sorted((p["s"], p["e"]) for p in spans):
                        if out and s <= out[-1][1]:
                            out[-1][1] = max(e, out[-1][1])
                        else:
                            out.append([s, e])
                for s, e in out:
                    parts.append(value[at:s])
                    at = e
                parts.append(value[at:])
                sizes.append(len(value))
                merged.append([{"start": s, "end": e} for s, e in out])
                kept.append(b"".join(parts))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[lo:hi].array, "n_bytes": sizes, "spans": merged, "kept": kept})


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, memory: int = MEMORY, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs: array of start, end) and kept
    (binary), one row for each row of ``docs``.

    Every byte goes that is covered by a ``length``-byte string that also begins
    anywhere else in the input, the same text included. Null texts count as empty; texts
    under ``length`` bytes keep everything; repeated rows are copies of each other;
    a null doc_id is carried through. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("k"))
    found = repeated_spans(docs, length, gram, memory, crowd)
    found = found.select(F.col("doc_id").alias("id"), F.col("k").alias("key"), "spans")
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("k") == F.col("key")), "left").select("doc_id", "text", "spans")

    return joined.mapInPandas(_kept_frames, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
