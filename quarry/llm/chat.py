"""Chat formatting by event-sourced reconstruction.

A log has one event a row: ``message`` starts a message with a text, ``delta`` appends,
``edit`` replaces the text, ``regenerate`` empties it before new deltas, ``delete``
removes the message. Events are grouped by message and folded in order of their
sequence; messages stand in the order of their first event. Rendering works on blocks of
``BLOCK`` sequence numbers, so a conversation of any length is a row for each block, to
be read in order, and never one row.

The template writes a turn as ``<s>role[INST]text</s>``. Control strings inside roles and
texts, and the backslash, get a backslash, so that a reader finds the turns again and
removing the backslashes gives the exact text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a rendered block."""
    found = re.findall(r"<s>(.*?)\[INST\](.*?)</s>", formatted, flags=re.DOTALL)
    return [(unescape(r), unescape(t)) for r, t in found]


def fold(events: DataFrame) -> DataFrame:
    """conv_id, position, message_id, role, text of the final messages.

    ``events``: conv_id, seq, event, message_id, role, text; other columns are ignored.
    A null text is empty; the role is the last one given, a missing one empty. Events of
    one sequence number are taken in the order of their kind, role and text, and a
    repeated event counts as often as it is there.
    """
    events = events.select("conv_id", "seq", "event", "message_id", "role", F.coalesce("text", F.lit("")).alias("text"))
    log = events.groupBy("conv_id", "message_id").agg(F.array_sort(F.collect_list(F.struct("seq", "event", "role", "text"))).alias("log"))
    resets = F.filter("log", lambda e: e["event"] != "delta")
    start = F.coalesce(F.array_max(F.transform(F.col("log"), lambda e, i: F.when(e["event"] != "delta", i + 1))), F.lit(1))
    tail = F.expr("slice(log, start, size(log))")
    text = F.array_join(F.transform(tail, lambda e: F.when(e["event"].isin("regenerate", "delete"), F.lit("")).otherwise(e["text"])), "")
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    last = F.try_element_at(resets, F.lit(-1))["event"]
    return (
        log.withColumn("start", start)
        .where(F.coalesce(last != "delete", F.lit(True)))
        .select("conv_id", F.col("log")[0]["seq"].alias("position"), "message_id", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), text.alias("text"))
    )


def render(messages: DataFrame) -> DataFrame:
    """conv_id, block, n_turns, formatted, loss (array of start, end in code points):
    a row for each block of a conversation's messages."""
    head = F.concat(F.lit("<s>"), escape(F.col("role")), F.lit("[INST]"))
    body = escape(F.col("text"))
    turn = F.struct(
        "position", "message_id", "role", F.concat(head, body, F.lit("</s>")).alias("shown"), F.length(head).alias("at"), F.length(body).alias("n")
    )
    block = F.coalesce(F.floor(F.col("position") / BLOCK), F.lit(-1)).alias("block")
    turns = messages.select("conv_id", block, turn.alias("turn")).groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    spans = F.aggregate(
        "turns",
        F.expr("struct(0 as at, cast(array() as array<struct<start: int, end: int>>) as loss)"),
        lambda a, t: F.struct(
            (a["at"] + F.length(t["shown"])).alias("at"),
            F.when(
                t["role"] == TRAINED_ROLE,
                F.concat(a["loss"], F.array(F.struct((a["at"] + t["at"]).alias("start"), (a["at"] + t["at"] + t["n"]).alias("end")))),
            )
            .otherwise(a["loss"])
            .alias("loss"),
        ),
        lambda a: a["loss"],
    )
    return turns.select("conv_id", "block", F.size("turns").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t["shown"]), "").alias("formatted"), spans.alias("loss"))


def format_chats(events: DataFrame) -> DataFrame:
    return render(fold(events))
