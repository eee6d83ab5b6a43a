"""The query language: words, quoted phrases and column filters, all joined by AND."""

from __future__ import annotations

from typing import NamedTuple

from quarry.functions import text


class QuerySyntaxError(ValueError):
    pass


class Phrase(NamedTuple):
    """Terms in a row; the last may be a prefix. ``field`` restricts the column and
    ``first`` asks for the column's beginning."""

    terms: tuple[str, ...]
    prefix: bool = False
    field: str | None = None
    first: bool = False


FIELDS = ("title", "content", "docid")


def parse(query: str, stemmed: bool = False) -> list[Phrase]:
    """Phrases of a query. Bare words are prefixes; quoted ones are exact. A quote that
    is never closed leaves its words bare. Quotes around bare words are dropped.
    ``title:word``, ``^word`` and ``a+b`` are understood, other operators refused."""
    out: list[Phrase] = []
    words = query.split()
    i = 0
    while i < len(words):
        word = words[i]
        if word.startswith('"'):
            last = next((j for j in range(i, len(words)) if words[j].endswith('"') and (j > i or len(words[j]) > 1)), None)
            if last is not None:
                out.append(_phrase(" ".join(words[i : last + 1])[1:-1], False, stemmed))
                i = last + 1
                continue
        bare = word.strip("\"'")
        if bare:
            out.append(_bare(bare, stemmed))
        i += 1
    if not out:
        raise QuerySyntaxError("empty query")
    return out


def _bare(word: str, stemmed: bool) -> Phrase:
    field, first = None, False
    if ":" in word:
        field, word = word.split(":", 1)
        if field.lower() not in FIELDS:
            raise QuerySyntaxError(f"no such column: {field}")
        field = field.lower()
    if word.startswith("^"):
        first, word = True, word[1:]
    parts = word.split("+")
    if word in ("AND", "OR", "NOT", "NEAR") or not all(p and all(c == "_" or c.isalnum() or ord(c) > 127 for c in p) for p in parts):
        raise QuerySyntaxError(f"syntax error near {word!r}")
    return _phrase(" ".join(parts), True, stemmed)._replace(field=field, first=first)


def _phrase(words: str, prefix: bool, stemmed: bool) -> Phrase:
    terms = text.tokenize(words)
    return Phrase(tuple(map(text.stem, terms)) if stemmed else tuple(terms), prefix)


#: Marks that a model may put before a line, each taken off once, in order.
LINE_MARKS = ("1.", "2.", "- ", "lex:", "vec:", "Lex:", "Vec:")


def expansions(answer: str, original: str) -> list[tuple[str, str]]:
    """Two further queries from a model's lines, as (query, kind): the first for keywords
    (lex), the second for meaning (vec); the original stands in for missing ones."""

    def bare(line: str) -> str:
        for mark in LINE_MARKS:
            line = line.removeprefix(mark)
        return line.strip()

    lines = [line.strip() for line in answer.split("\n")]
    found = [bare(line) for line in lines if line and line != original]
    found = [line for line in found if line and line != original]
    return list(zip([*found, original, original], ("lex", "vec")))
