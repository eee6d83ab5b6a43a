"""Results as text for people and programs."""

from __future__ import annotations

import json
from collections.abc import Sequence

FORMATS = ("text", "json", "csv", "md", "files")


def render(results: Sequence[dict], style: str = "text") -> str:
    """Results (docid, path, title, context, score) in one of ``FORMATS``. CSV fields are
    not quoted. Without results every style ends with ``no results``."""
    lines: list[str] = []
    if style == "json":
        shown = [{k: v for k, v in r.items() if v not in (None, "") or k in ("docid", "path", "title", "score")} for r in results]
        lines.append(json.dumps(shown or None, indent=2, ensure_ascii=False))
    elif style == "csv":
        lines += ["docid,score,path,context"] + [f"{r['docid']},{r['score']:.4f},{r['path']},{r.get('context') or ''}" for r in results]
    elif style == "md":
        lines += [f"- **{r['title']}** (`{r['path']}`) score {r['score']:.4f}" for r in results]
    elif style == "files":
        lines += [r["path"] for r in results]
    elif style == "text":
        for r in results:
            lines.append(f"#{r['docid']} {r['score']:.4f} {r['path']}\n    {r['title']}" + (f"\n    {r['context']}" if r.get("context") else ""))
    else:
        raise ValueError(f"unknown format: {style}")
    if not results:
        lines.append("no results")
    return "\n".join(lines)


def shorten(text: str, limit: int) -> str:
    """The first ``limit`` bytes and a remark; whole where it fits or ``limit`` is 0."""
    data = text.encode()
    if limit <= 0 or len(data) <= limit:
        return text
    return data[:limit].decode("utf-8", "replace") + f"\n\n[... truncated to {limit} chars]"


def envelope(value) -> dict:
    """A tool's answer."""
    return {"content": [{"type": "text", "text": json.dumps(value, ensure_ascii=False)}]}
