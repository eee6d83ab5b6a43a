"""Best-fit packing of token sequences by exact-complement hashing.

Documents are tokenised once; the planner sees only how many pieces there are of each
length, at most ``capacity`` numbers, whatever the corpus holds. From these it consumes
combinations whose lengths fill a sequence exactly (one, two or three pieces that
complement the longest piece left), each as often as the counts allow, then fills the
rest by best fit. A plan is a list of patterns with multiplicities; every pattern uses up
a length, so there are few. Pieces find their place from their rank among the pieces of
their length, without another look at the texts.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

CAPACITY = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
#: Pieces of one length that are ranked together, about; a longer list is dealt to buckets.
BUCKET_ROWS = 200_000

#: Fixed value: the published pre-tokenisation pattern of this vocabulary.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Longer runs of white space go to the library: the pattern above backtracks over a run,
#: and the encoder's stack ends before 1,000,000 places.
LONG_SPACE = 100_000

_encoders: dict = {}
_tokenizers: dict = {}


def encoder(path: str | None = None):
    """Encoder for the byte-level BPE vocabulary at ``path`` (JSON of the tokenizers
    library; the public 50k one by default). It gives that library's ids, several times
    faster, since the merge order of such a vocabulary is the order of its ids."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(letter[c] for c in token): i for token, i in vocabulary.items() if all(c in letter for c in token) and not token.startswith("<|")}
        _encoders[path] = tiktoken.Encoding("quarry", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def tokenizer(path: str | None = None) -> Callable[[str], list[int]]:
    """Function from a text to the ids that the tokenizers library gives for it with its
    default settings and without special tokens around it. Tokens that the file adds to
    the vocabulary are found in the text first; the encoder does what is between them."""
    if path not in _tokenizers:
        import public_tokenizers
        from tokenizers import Tokenizer

        file = path or public_tokenizers.path(TOKENIZER)
        with open(file, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        ordinary, library = encoder(path).encode_ordinary, Tokenizer.from_file(file)
        ids = {t["content"]: t["id"] for t in added}
        plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)
        marks = re.compile("|".join(f"({re.escape(c)})" for c in sorted(ids, key=len, reverse=True)) or r"(?!)")
        spaces = re.compile(rf"\s{{{LONG_SPACE}}}")

        def encode(text: str) -> list[int]:
            marked = any(c in text for c in ids)
            if marked and not plain or len(text) >= LONG_SPACE and spaces.search(text):
                return library.encode(text, add_special_tokens=False).ids
            if not marked:
                return ordinary(text)
            out, at = [], 0
            for m in marks.finditer(text):
                out += ordinary(text[at : m.start()])
                out.append(ids[m.group()])
                at = m.end()
            return out + ordinary(text[at:])

        _tokenizers[path] = encode
    return _tokenizers[path]


def piece_starts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: all full but perhaps the first."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(path)
        for pdf in frames:
            rows = []
            for doc_id, text in zip(pdf["doc_id"].array, pdf["text"]):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                for k, (s, n) in enumerate(piece_starts(len(ids), capacity)):
                    own = ids[s : s + n]
                    rows.append((doc_id, k, s, n, zlib.crc32(own.tobytes()), *([own.astype(np.int64)] if with_ids else [])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInPandas(run, schema)


def _exact(left: np.ndarray, capacity: int, depth: int) -> list[tuple[int, list[int]]]:
    """Consume from ``left`` the combinations of a longest piece and one to ``depth``
    others that fill a sequence exactly."""
    out: list[tuple[int, list[int]]] = []

    def use(lengths: list[int]) -> bool:
        """Take this combination as often as possible; True once the first is used up."""
        sort, need = np.unique(lengths, return_counts=True)
        times = int((left[sort] // need).min())
        if times:
            left[sort] -= times * need
            out.append((times, sorted(lengths, reverse=True)))
        return not left[lengths[0]]

    use([capacity])
    for size in range(1, depth + 1):
        for longest in range(capacity - 1, 0, -1):
            if not left[longest]:
                continue
            gap = capacity - longest
            if size == 1:
                if gap <= longest and left[gap]:
                    use([longest, gap])
                continue
            there = np.flatnonzero(left[: min(gap, longest + 1)])
            if size == 2:
                for a in there[::-1].tolist():
                    if 2 * a < gap or not left[longest]:
                        break
                    if left[a] and left[gap - a]:
                        use([longest, a, gap - a])
                continue
            for a in there[::-1].tolist():
                rest = gap - a
                if not left[longest] or 3 * a < gap:
                    break
                if not left[a]:
                    continue
                b = there[(there <= min(a, rest - 1)) & (2 * there >= rest)]
                b = b[(left[b] > 0) & (left[rest - b] > 0)]
                for second in b[::-1].tolist():
                    if use([longest, a, second, rest - second]):
                        break
    return out


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Best fit of what is left, longest first: pieces of a length go to the open
    sequences with the least sufficient gap, as many at once as there are."""
    open_bins: dict[int, list[tuple[int, list[int]]]] = {}
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            gap = min((g for g in open_bins if g >= length), default=None)
            if gap is None:
                each = min(capacity // length, n)
                times = n // each
                open_bins.setdefault(capacity - each * length, []).append((times, [length] * each))
                n -= times * each
                continue
            times, lengths = open_bins[gap].pop()
            if not open_bins[gap]:
                del open_bins[gap]
            each = min(gap // length, n)
            take = min(times, n // each)
            if take < times:
                open_bins.setdefault(gap, []).append((times - take, lengths))
            open_bins.setdefault(gap - each * length, []).append((take, lengths + [length] * each))
            n -= take * each
    return [x for bins in open_bins.values() for x in bins]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Patterns ``(times, lengths)`` that use every piece of ``counts`` exactly once.

    Exact combinations of up to four pieces, then best fit. Where pieces are few, long
    exact combinations can cost more later than they save, so the plan with the fewest
    sequences over the depths 3, 2, 1 and 0 is taken, the deepest of equals.
    """
    plans = []
    for depth in (3, 2, 1, 0):
        left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            left[length] = n
        plans.append(_exact(left, capacity, depth) + _best_fit(left, capacity))
    return min(plans, key=lambda p: sum(t for t, _ in p))


def places(patterns: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, ranges of ranks: first rank, first sequence, offset."""
    used: dict[int, int] = {}
    table: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for times, lengths in patterns:
        offset = 0
        for length in lengths:
            table.setdefault(length, []).append((used.get(length, 0), base, offset))
            used[length] = used.get(length, 0) + times
            offset += length
        base += times
    return {k: tuple(np.array(v, np.int64).T) for k, v in table.items()}


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID, with_ids: bool = False, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and the piece's ids).

    Every row of ``docs`` gives its pieces, so repeated rows and null doc_ids do too. A
    null or empty text is the end id alone. Texts of more than ``capacity`` ids are cut
    into full pieces after a first one that may be shorter. Other columns are ignored.
    """
    cut = common.stage(pieces(docs, capacity, path, end_id, with_ids))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # The driver holds a number for each length and for each ``bucket_rows`` pieces.
    each = F.lit([-(-counts.get(n, 0) // bucket_rows) or 1 for n in range(1, capacity + 1)])
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.element_at(each, F.col("length").cast("int"))).cast("int"))
    before: dict[tuple[int, int], int] = {}
    used: dict[int, int] = {}
    for r in cut.groupBy("length", "bucket").agg(F.count("*").alias("n")).orderBy("length", "bucket").collect():
        before[r["length"], r["bucket"]] = used.get(r["length"], 0)
        used[r["length"]] = used.get(r["length"], 0) + r["n"]
    where = places(plan(counts, capacity))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = cut.withColumn("rank", F.row_number().over(order))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for (length, b), at in pdf.groupby(["length", "bucket"]).indices.items():
                first, base, place = where[length]
                rank = pdf["rank"].to_numpy()[at] - 1 + before[length, b]
                own = np.searchsorted(first, rank, "right") - 1
                sequence[at] = base[own] + rank - first[own]
                offset[at] = place[own]
            yield pdf.drop(columns=["bucket", "rank"]).assign(sequence_id=sequence, offset=offset)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    return ranked.mapInPandas(run, schema)
