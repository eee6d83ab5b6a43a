"""Tokens of many texts at once, with their kind, on UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np

from . import common
from .common import U64

_LETTER, _DIGIT = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[128:] = _LETTER
_KIND[48:58] = _DIGIT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?:;\n")] = True


class Tokens(NamedTuple):
    """Runs of letters (any non-ASCII character counts as one) and numbers (digits, with
    points or commas between digits) of texts joined by a newline each."""

    data: np.ndarray  # the joined bytes
    lower: np.ndarray  # the same, A-Z and the Latin-1 capitals lower-cased
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray  # where each text's tokens begin; one more than texts
    hash: np.ndarray  # of the token in lower case
    number: np.ndarray
    capital: np.ndarray
    opens: np.ndarray  # first of its text, or after . ! ? : ; or a line's end


def tokenize(values: Sequence[bytes]) -> Tokens:
    data = np.frombuffer(b"\n".join(values) + b"\n", np.uint8)
    kind = _KIND[data]
    inner = np.zeros(len(data), bool)
    if len(data) > 2:
        inner[1:-1] = ((data[1:-1] == 46) | (data[1:-1] == 44)) & (kind[:-2] == _DIGIT) & (kind[2:] == _DIGIT)
    kind = np.where(inner, _DIGIT, kind)
    change = np.flatnonzero(np.diff(kind)) + 1
    edges = np.concatenate([[0], change, [len(data)]])
    own = kind[edges[:-1]]
    start, end, own = edges[:-1][own > 0], edges[1:][own > 0], own[own > 0]
    lower = _LOWER[data]
    if len(data) > 1:
        wide = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        lower[wide] += 32
    hashes = common.span_hash(common.prefix_hash(lower), start, end)
    capital = (own == _LETTER) & (lower[start] != data[start])
    second = np.minimum(start + 1, len(data) - 1)
    capital |= (own == _LETTER) & (data[start] == 0xC3) & (lower[second] != data[second])
    doc_start = np.cumsum([0] + [len(v) + 1 for v in values])
    at = np.searchsorted(start, doc_start)
    ends = np.cumsum(_ENDS[data])
    opens = np.ones(len(start), bool)
    if len(start) > 1:
        opens[1:] = ends[start[1:]] > ends[end[:-1] - 1]
    return Tokens(data, lower, start, end, at, hashes, own == _DIGIT, capital, opens)


def hash_word(word: str) -> U64:
    return tokenize([word.encode()]).hash[0]
