"""Splitting documents at good places into overlapping chunks.

Sizes are estimates: a quarter of the characters. Lines are gathered until ``TARGET``
is reached outside a code fence; the cut is then the best scored of the last lines,
nearer ones preferred, or after the line where none is good. The new chunk begins with
the end of the last one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from operator import xor
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

from quarry.functions.text import break_score

TARGET, OVERLAP, LOOK_BACK = 900, 135, 50


class Chunk(NamedTuple):
    seq: int
    pos: int  # number of the line it begins with
    text: str


def _estimate(s: str) -> int:
    return len(s) // 4


def _is_fence(line: str) -> bool:
    return line.strip().startswith("```")


def _overlap(lines: list[str]) -> list[str]:
    """The last of ``lines`` that reach ``OVERLAP`` together; none if they are blank."""
    sizes = list(accumulate(map(_estimate, reversed(lines))))
    last = lines[len(lines) - 1 - bisect_left(sizes, OVERLAP, hi=len(sizes) - 1) :]
    return last if any(last) or len(last) > 1 else []


def best_cut(lines: list[str]) -> int:
    """Index of the line before which to cut, 0 if none scores above 1. The best score so
    far is kept as a whole number, so a later line of nearly its score replaces it."""
    first = max(1, len(lines) - LOOK_BACK)
    inside = list(accumulate(map(_is_fence, lines), xor, initial=False))
    best, cut = 0, 0
    for j in range(first, len(lines)):
        far = (len(lines) - j) / (len(lines) - first + 1)
        score = break_score(lines[j]) * (1 - far * far * 0.7)
        if not inside[j] and score >= best:
            best, cut = int(score), j
    return cut if best > 1 else 0


def _divide(lines: list[str], line: str) -> tuple[list[str], list[str], int]:
    """The lines of a full chunk, those left for the next, and how many lines before the
    present ``line`` that one begins. The last of ``lines`` is not ended yet."""
    at = best_cut(lines)
    if at:
        return lines[:at], [*lines[at:], line], len(lines) - at
    return [*lines[:-1], lines[-1] + line, ""], [""], -1


def chunk(content: str) -> list[Chunk]:
    lines = content.split("\n")
    inside = accumulate(map(_is_fence, lines), xor)
    full: list[tuple[int, list[str]]] = []
    begun, size, pos, carried = [""], 0, 0, []
    for i, (line, fenced) in enumerate(zip(lines, inside)):
        size += _estimate(line)
        if size >= TARGET and not fenced:
            done, rest, back = _divide(begun, line)
            full.append((pos, done))
            carried = _overlap(done)
            begun, pos = [*carried, *rest], i - back
            size = _estimate("\n".join(begun))
            continue
        if begun == [""]:
            pos = i
            if carried:
                begun, carried = [*carried, ""], []
                size = _estimate("\n".join(begun))
        begun[-1:] = [begun[-1] + line, ""]
    texts = [(at, "\n".join(own).strip()) for at, own in [*full, (pos, begun)]]
    return [Chunk(k, at, text) for k, (at, text) in enumerate(t for t in texts if t[1])]


def chunk_documents(docs: DataFrame) -> DataFrame:
    """hash, seq, pos, text of the chunks of each distinct content."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(h, *c) for h, content in zip(pdf["hash"], pdf["content"]) for c in chunk(content or "")]
            yield pd.DataFrame(rows, columns=["hash", "seq", "pos", "text"])

    return docs.select("hash", "content").dropDuplicates(["hash"]).mapInPandas(run, "hash string, seq int, pos int, text string")
