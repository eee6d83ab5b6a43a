"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import chat, common, decontamination, fingerprint, minhash, packing, pii, resharding, suffix_dedup, toxicity, url_filter
from .common import table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = fingerprint.with_next(docs, ("text", "signature"), prepare=fingerprint.fingerprints)
    found = found.withColumn("edited", fingerprint.edited(F.col("text"), F.col("next_text")))
    found = found.withColumn("edited_signature", fingerprint.signature(F.col("edited")))
    return found.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint.shown(F.col("signature")).alias("fingerprint"),
        fingerprint.shown(F.col("edited_signature")).alias("edited_fingerprint"),
        fingerprint.likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        fingerprint.likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        (F.size("spans") > 0).alias("repeated"),
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    base = [k.name for k in pii.KINDS if k.base]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda *names: F.filter("pii", lambda s: s["kind"].isin(*names))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(joined(of(*base)), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))


def chat_digests(blocks: DataFrame) -> DataFrame:
    """Read rendered blocks back, conversation by conversation in order of their blocks,
    holding one block and the digests' states at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, None

        def row():
            n, turns, loss_n, loss, size = held
            return (key[0], n, turns.hexdigest(), loss_n, loss.hexdigest(), size)

        for pdf in frames:
            out = []
            ids = [None if pd.isna(x) else int(x) for x in pdf["conv_id"].array]
            for conv, formatted, spans in zip(ids, pdf["formatted"], pdf["loss"]):
                if key != (conv,):
                    if key is not None:
                        out.append(row())
                    key, held = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in chat.read_turns(formatted):
                    held[0] += 1
                    held[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for s in spans:
                    text = chat.unescape(formatted[s["start"] : s["end"]])
                    held[2] += len(text)
                    held[3].update(text.encode("utf-8", "surrogatepass"))
                held[4] += len(formatted)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame([row()] if key is not None else [], columns=names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    ordered = blocks.repartition(common.n_partitions(blocks.sparkSession), "conv_id").sortWithinPartitions("conv_id", "block")
    return ordered.select("conv_id", "formatted", "loss").mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def turn_events(turns: DataFrame) -> DataFrame:
    """Each row (conv_id, turn, role, text) as the events that a chat service would log:
    an assistant's text streams in after a first answer was regenerated, another role's
    is posted in part and then edited. Rows that share a turn are messages of their own,
    in order of role and text; a row without a turn is a single message."""
    again = F.row_number().over(Window.partitionBy("conv_id", "turn", "role", "text").orderBy(F.lit(0)))
    name = F.concat_ws("/", F.lpad(F.coalesce(F.col("turn"), F.lit(-1)).cast("string"), 20, "0"), F.coalesce("role", F.lit("")), F.sha2(F.coalesce("text", F.lit("")), 256), again.cast("string"))
    text, half = F.coalesce("text", F.lit("")), F.floor(F.length("text") / 2).cast("int")
    begin, rest = F.coalesce(F.substring("text", F.lit(1), half), F.lit("")), F.coalesce(F.substring("text", half + 1, F.length("text")), F.lit(""))

    def events(*steps: tuple) -> Column:
        return F.array(*(F.struct(F.lit(i).alias("step"), F.lit(kind).alias("event"), said.alias("said")) for i, (kind, said) in enumerate(steps)))

    log = F.when(F.col("turn").isNull(), events(("message", text)))
    log = log.when(F.col("role") == chat.TRAINED_ROLE, events(("message", F.lit("")), ("delta", begin), ("regenerate", F.lit("")), ("delta", begin), ("delta", rest)))
    log = log.otherwise(events(("message", begin), ("edit", text)))
    each = turns.select("conv_id", "turn", "role", "text", name.alias("message_id")).select("conv_id", "turn", "role", "message_id", F.explode(log).alias("e"))
    return each.select("conv_id", (F.col("turn") * 8 + F.col("e.step")).alias("seq"), "e.event", "message_id", "role", F.col("e.said").alias("text"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_digests(chat.format_chats(turn_events(turns)))


def op7_min_cost_flow_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old layout deals documents to 32 shards by a hash of their doc_id."""
    old = F.pmod(F.xxhash64("doc_id"), F.lit(resharding.OLD_SHARDS))
    placed, moves = resharding.reshard(table(spark, sf_dir, "documents"), old)
    path = common.scratch_dir(spark)
    affected = resharding.rewrite(placed, moves, path)
    written = spark.read.schema("doc_id long, text string, size long, slot long, shard int").parquet(path) if affected else placed.where("false").drop("old_shard")
    if len(affected) < resharding.NEW_SHARDS:
        written = written.unionByName(placed.where(~F.col("shard").isin(affected)).drop("old_shard"))
    text = F.coalesce("text", F.lit(""))
    return written.select(
        "doc_id",
        (F.octet_length(text) + resharding.OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that contaminates it."""
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("k")


def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the chain's probabilities and its verdict."""
    out = toxicity.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "p_low_quality", "p_toxic", "toxic")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = (
        op1_url_filters,
        op2_best_fit_packing,
        op3_order_minhash,
        op4_suffix_dedup,
        op5_pii,
        op6_chat_formatting,
        op7_min_cost_flow_sharding,
        op8_benchmark_decontamination,
        op9_toxicity_chain,
        op10_minhash_near_dedup,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    escaped = "replace({}, '\\', '\\\\')"
    for c in chat.CONTROLS:
        escaped = f"replace({escaped}, '{c}', '{c[0]}\\{c[1:]}')"
    chats = f"""
with turns as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
digests as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as said,
  coalesce(string_agg(text, '' order by turn, text) filter (where role = 'assistant'), '') as loss,
  sum(length('<s>[INST]</s>') + length({escaped.format("role")}) + length({escaped.format("text")})) as size from turns group by conv_id)
select conv_id, n_turns, sha256(said) as turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256, cast(size as bigint) as formatted_chars from digests"""
    return {"op1_url_filters": url_filter.oracle_sql(), "op6_chat_formatting": chats}
