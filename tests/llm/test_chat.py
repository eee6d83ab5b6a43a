import hashlib
import random

import duckdb

from quarry.llm import chat, queries

SCHEMA = "conv_id long, seq long, event string, message_id string, role string, text string"


def test_folds_deltas_edits_and_regenerations(spark):
    log = [
        (1, 0, "message", "a", "user", "hi"),
        (1, 1, "message", "b", "assistant", ""),
        (1, 2, "delta", "b", None, "Hel"),
        (1, 3, "delta", "b", None, "lo"),
        (1, 4, "edit", "a", None, "hi there"),
        (1, 5, "regenerate", "b", None, None),
        (1, 7, "delta", "b", None, "day"),
        (1, 6, "delta", "b", None, "Good "),
        (1, 8, "message", "c", "user", "gone"),
        (1, 9, "delete", "c", None, None),
        (2, 0, "delta", "x", None, "only"),
        (None, None, "message", None, None, None),
    ]
    got = {(r.conv_id, r.message_id): (r.position, r.role, r.text) for r in chat.fold(spark.createDataFrame(log, SCHEMA)).collect()}
    assert got == {(1, "a"): (0, "user", "hi there"), (1, "b"): (1, "assistant", "Good day"), (2, "x"): (0, "", "only"), (None, None): (None, "", "")}


def brute(turns):
    out = {}
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1], t[2] or "", t[3] or ""))
        said = "".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x in own)
        loss = "".join(x or "" for _, _, r, x in own if r == "assistant")
        out[conv] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(2)
    bits = ["</s>", "[INST]", "[/INST]", "<s>", "\\", "<", "/s>", "[", "é🙂", "\n", "x", "[\\INST]"]
    turns = [(c, t, rng.choice(["user", "assistant", "sys[INST]", None]), rng.choice([None, "", "".join(rng.choices(bits, k=9))])) for c in range(6) for t in range(9)]
    turns += [(7, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(1000)] + [(8, 0, "user", "z" * 200_000)] + [(9, 0, "user", "same")] * 3
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as seq", "2 as block")
    got = {r.conv_id: tuple(r)[1:5] for r in queries.chat_digests(chat.format_chats(queries.turn_events(df))).collect()}
    assert got == brute(turns)


def test_registered_query_keeps_every_conversation(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    got = {r.conv_id: tuple(r)[1:5] for r in queries.op6_chat_formatting(spark, sf).collect()}
    assert got == brute(rows)


def test_oracle(spark):
    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"create or replace view conversations as select * from '{sf}/conversations.parquet'")
    sql = sorted(duckdb.sql(queries.oracle_sql()["op6_chat_formatting"]).fetchall())
    assert sorted(map(tuple, queries.op6_chat_formatting(spark, sf).collect())) == sql


def test_empty(spark):
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).collect() == []
