import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quarry.llm import packing


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_each_piece_once_and_fits(seed):
    rng = random.Random(seed)
    counts = Counter(rng.randint(1, 64) if seed % 2 else min(64, int(rng.expovariate(0.05)) + 1) for _ in range(3000))
    patterns = packing.plan(dict(counts), 64)
    used = Counter()
    for times, lengths in patterns:
        assert sum(lengths) <= 64
        for n in lengths:
            used[n] += times
    assert used == counts
    total = sum(k * n for k, n in counts.items())
    least = max(-(-total // 64), sum(n for k, n in counts.items() if k > 32) + counts[32] // 2)
    assert sum(t for t, _ in patterns) <= least * 1.01 + 1


def test_plan_of_nothing_and_of_tiny_pieces():
    assert packing.plan({}, 64) == []
    assert sum(t for t, _ in packing.plan({3: 10_000_000}, 64)) == -(-10_000_000 // 21)


def test_ids_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", " ", "a", "it's  we'll\n\n x", "Äöü çá 日本 🙂", "<|endoftext|> x", "a" * 3000, " \t\n" * 50, "1234567 89 ١٢"]
    assert [t.encode(x, add_special_tokens=False).ids for x in texts] == list(map(packing.tokenizer(), texts))


def test_ids_equal_the_library_as_it_is(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  \n<|endoftext|", "<|ENDOFTEXT|> <|end<|endoftext|>of", "it's  we'll\n\n 日本", "a" + " " * 1_000_000, "\n" * 1_000_000 + "b <|endoftext|>", "x" * 1_000_000, "7" * 1_000_000]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert want[1] == [64, 220, 50256, 275]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1), with_ids=True).collect()
    for i, ids in enumerate(want):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [x for r in own for x in r.ids] == [*ids, packing.END_ID], i


def check_rows(rows, docs, capacity=1024):
    enc = packing.encoder()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
    for doc_id, text in docs:
        ids = np.array([*enc.encode_ordinary(text or ""), 2], "<u4")
        own = sorted(got[doc_id], key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(own):
            assert (r["piece"], r["start"]) == (k, at)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            assert r["length"] <= capacity and (k == 0 or r["length"] == capacity)
            at += r["length"]
        assert at == len(ids) and (len(own) == 1 or len(ids) > capacity)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for slots in bins.values():
        at = 0
        for offset, n in sorted(slots):
            assert offset == at
            at += n
        assert at <= capacity
    total = sum(r["length"] for r in rows)
    return len(bins), -(-total // capacity)


def test_packs_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs += [(10_000, None), (10_001, ""), (10_002, "w " * 5000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as piece", "2 as bucket")
    n, least = check_rows([r.asDict() for r in packing.pack(df).collect()], docs)
    assert n <= least + 2


def test_repeated_null_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    rows = packing.pack(df, with_ids=True).collect()
    assert len(rows) == 3 and len({(r.sequence_id, r.offset) for r in rows}) == 3
    assert all(len(r.ids) == r.length for r in rows)
    assert packing.pack(df.where("false")).collect() == []


def test_many_buckets_of_a_length(spark):
    rows = [(i, "a b c " * (i % 3) + "word " * (i % 40)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_rows([r.asDict() for r in packing.pack(df, capacity=32, bucket_rows=3).collect()], rows, 32)
