import random

from pyspark.sql import functions as F

from quarry.llm import fingerprint, queries


def sign(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as signature")
    return [r.signature for r in fingerprint.fingerprints(df).orderBy("doc_id").collect()]


def like(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a array<bigint>, b array<bigint>")
    return df.select(fingerprint.likeness(F.col("a"), F.col("b"))).first()[0]


def test_sensitive_to_edits_and_order(spark):
    rng = random.Random(0)
    w = [f"w{rng.randrange(3000)}" for _ in range(800)]
    moved = w[400:] + w[:400]
    few = list(w)
    few[100:102] = ["new", "words"]
    other = [f"v{i}" for i in range(800)]
    base, copy, edit, swap, none = sign(spark, [" ".join(x) for x in (w, w, few, moved, other)])
    assert base == copy and 28 <= len(base) <= 32
    assert like(spark, base, edit) > 0.8
    assert like(spark, base, swap) < 0.8
    assert like(spark, base, none) == 0


def test_slots_hold_numbered_kmers_in_text_order(spark):
    once, thrice, empty, null, short, blank = sign(spark, ["a b c " * 30, "a b c " * 90, "", None, "ab", " " * 100])
    assert once != thrice and empty == null == blank == [] and len(short) == 1
    assert like(spark, [], []) == 1.0 and like(spark, [], once) == 0.0


def test_large_repetitive_text(spark):
    (a, b) = sign(spark, ["same line again\n" * 20_000, "x" * 200_000])
    assert a and b


def test_repetitive_text_keeps_its_likeness(spark):
    near = []
    for seed in range(6):
        rng = random.Random(seed)
        line = " ".join(f"w{rng.randrange(10**6)}" for _ in range(10))
        other = " ".join(f"v{rng.randrange(10**6)}" for _ in range(2500))
        a, b = sign(spark, [" ".join([line] * 1000), " ".join([line] * 750) + " " + other])
        near.append(like(spark, a, b))
    assert min(near) > 0.15 and max(near) < 0.75, near


def test_equals_a_plain_selection(spark):
    """Every occurrence numbered by a window, the least of each slot by a rank."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcd") for _ in range(n)) for n in (70, 300, 3000)]
    texts += [" ".join(f"w{rng.randrange(40)}" for _ in range(6000)), "same old line " * 900]
    rows = [(i, *[t[p - k] if p >= k else None for k in (2, 1, 0)], p) for i, t in enumerate(x.split() for x in texts) for p in range(len(t))]
    spark.createDataFrame(rows, "i int, a string, b string, c string, at int").createOrReplaceTempView("plain_kmers")
    got = spark.sql("""with ids as (select i, at, xxhash64(h, row_number() over (partition by i, h order by at) + 0L) as id from (select i, at, xxhash64(a, b, c) as h from plain_kmers)),
ranked as (select i, at, id, pmod(id, 32) as slot, row_number() over (partition by i, pmod(id, 32) order by id) as r from ids)
select i, slot, xxhash64(slot, transform(array_sort(collect_list(struct(at, id))), x -> x.id)) as h from ranked where r <= 2 group by i, slot order by i, slot""").collect()
    assert sign(spark, texts) == [[r.h for r in got if r.i == i] for i in range(len(texts))]


def test_text_without_spaces_keeps_its_likeness(spark):
    rng = random.Random(3)
    for letters in ("abcdefghijklmnopqrstuvwxyz0123456789+/", [chr(0x4E00 + i) for i in range(2000)], [chr(0x20000 + i) for i in range(2000)]):
        make = lambda n: "".join(rng.choice(letters) for _ in range(n))
        kept = make(1500)
        a, b, inserted, other = sign(spark, [kept + make(500), kept + make(500), make(3) + kept + make(100), make(2000)])
        assert like(spark, a, b) > 0.2 and like(spark, a, inserted) > 0.2 and like(spark, a, other) < 0.2


def test_one_rule_at_every_size(spark):
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    for n in (50, 62, 64, 65, 66, 70):  # likeness does not depend on the side of a limit
        a, b = sign(spark, [words[:n], words[:48]])
        assert like(spark, a, b) > 0.3, n
    a, b, c, d = sign(spark, ["alpha beta gamma", "alpha beta delta", "字典里的词语", "字典里的词典"])
    assert like(spark, a, b) > 0.3 and like(spark, c, d) > 0.3


def test_tokens(spark):
    texts = ["a bc\t\nd", " x" + "y" * 16 + " z ", "y" * 16 + " z", "ab日本cd e", "y" * 17 + "日", "日" + "y" * 16]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r.t for r in df.select(fingerprint._tokens(F.col("text")).alias("t")).collect()]
    assert got == [["a", "bc", "d"], ["x", *"y" * 16, "z"], ["y" * 16, "z"], ["ab", "日", "本", "cd", "e"], [*"y" * 17, "日"], ["日", "y" * 16]]


def next_of(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    return [(str(r[0]), str(r[1]), str(order[(i + 1) % len(order)][1])) for i, r in enumerate(order)]


def test_next_over_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(200), f"t{i:03d}") for i in range(150)] + [(None, "n"), (7, None), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 2, 9):
        got = sorted((str(r.doc_id), str(r.text), str(r.next_text)) for r in fingerprint.with_next(df, ("text",), parts).collect())
        assert got == sorted(next_of(rows))
    assert fingerprint.with_next(df.where("false"), ("text",)).collect() == []
    assert [r.next_text for r in fingerprint.with_next(df.where("text = 'n'"), ("text",)).collect()] == ["n"]


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    import hashlib

    got = {r.doc_id: r for r in queries.op3_order_minhash(spark, sf).collect()}
    assert len(got) == len(docs)
    for i, (d, t) in enumerate(docs):
        follow = docs[(i + 1) % len(docs)][1]
        q = len(t) // 4
        assert got[d].n_chars == len(t)
        assert got[d].edited_sha256 == hashlib.sha256((t[: len(t) - q] + follow[:q]).encode()).hexdigest()
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    near = [r.near_edited for r in got.values()]
    assert sum(near) / len(near) > 0.3 and sum(r.near_next for r in got.values()) / len(got) < 0.1
    assert sum(r.near_edited > r.near_next for r in got.values()) > 0.95 * len(got)
    same = {}
    for d, t in docs:
        assert same.setdefault(t, got[d].fingerprint) == got[d].fingerprint
