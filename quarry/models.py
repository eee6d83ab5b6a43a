"""Models behind the hybrid search. None is shipped; engines are plugged in."""

from __future__ import annotations

import hashlib
import re
import time
import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple, Protocol

import numpy as np

from quarry.functions.text import tokenize
from quarry.operators.query import expansions


class ModelSpec(NamedTuple):
    """A model's role and the file it is expected in below the cache folder."""

    name: str
    role: str
    file: str


class Engine(Protocol):
    def embed(self, text: str, is_query: bool) -> Sequence[float]: ...

    def expand(self, query: str) -> list[tuple[str, str]]: ...

    def rerank(self, query: str, texts: Sequence[str]) -> list[float]: ...


class NoModelError(RuntimeError):
    pass


QUERY_PREFIX = "task: search result | query: "


def document_input(title: str, text: str) -> str:
    return f"title: {title} | text: {text}"


class StubEngine:
    """No models: no vectors, no expansion beyond the query, every rerank score 0.5."""

    has_embedder = has_expander = has_reranker = False

    def embed(self, text: str, is_query: bool) -> list[float]:
        raise NoModelError("no embedding model")

    def expand(self, query: str) -> list[tuple[str, str]]:
        return expansions("", query)

    def rerank(self, query: str, texts: Sequence[str]) -> list[float]:
        return [0.5] * len(texts)


class HashingEngine(StubEngine):
    """Deterministic vectors from hashed words, for tests and demonstrations."""

    has_embedder = True

    def __init__(self, size: int = 64) -> None:
        self.size = size

    def embed(self, text: str, is_query: bool) -> list[float]:
        out = np.zeros(self.size)
        for token in tokenize(text.removeprefix(QUERY_PREFIX)):
            digest = hashlib.sha256(token.encode()).digest()
            out[digest[0] % self.size] += 1 if digest[1] % 2 else -1
        length = np.linalg.norm(out)
        return (out / length if length else out).tolist()


class WorkerEngine(StubEngine):
    """An engine that every Python worker makes for itself, once, from ``make`` (a function
    that can be sent to workers) and drops after ``idle`` seconds without a call. Texts
    are cut to ``max_tokens`` of the engine's own tokens, or of words if it has no
    ``clip``."""

    has_embedder = True
    _made: dict = {}

    def __init__(self, make: Callable[[], Engine], idle: float = 300.0, max_tokens: int = 2048) -> None:
        self.make, self.idle, self.max_tokens, self.key = make, idle, max_tokens, uuid.uuid4().hex

    def engine(self) -> Engine:
        now = time.monotonic()
        for key, (_, last, idle) in list(self._made.items()):
            if now - last > idle:
                del self._made[key]
        held = self._made.get(self.key)
        engine = held[0] if held else self.make()
        self._made[self.key] = (engine, now, self.idle)
        return engine

    def embed(self, text: str, is_query: bool) -> Sequence[float]:
        engine = self.engine()
        clip = getattr(engine, "clip", clip_words)
        return engine.embed(clip(text, self.max_tokens), is_query)

    def expand(self, query: str) -> list[tuple[str, str]]:
        return self.engine().expand(query)

    def rerank(self, query: str, texts: Sequence[str]) -> list[float]:
        return self.engine().rerank(query, texts)


def clip_words(text: str, n: int) -> str:
    """``text`` up to the end of its ``n``-th word."""
    for k, m in enumerate(re.finditer(r"\S+", text), 1):
        if k == n:
            return text[: m.end()]
    return text


def embed_all(engine: Engine, texts: Sequence[str]) -> list[Sequence[float]]:
    """Vectors of documents; fails as a whole with the first that fails."""
    return [engine.embed(t, False) for t in texts]


def yes_probability(yes: float, no: float) -> float:
    """Softmax of two logits."""
    top = max(yes, no)
    a, b = np.exp(yes - top), np.exp(no - top)
    return float(a / (a + b))
