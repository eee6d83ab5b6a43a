import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd

from quarry.llm import suffix_dedup


def brute(rows, length):
    values = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(v[s : s + length] for _, v in values for s in range(len(v) - length + 1))
    out = []
    for i, v in values:
        gone = np.zeros(len(v) + 1, bool)
        for s in range(len(v) - length + 1):
            if seen[v[s : s + length]] > 1:
                gone[s : s + length] = True
        starts = np.flatnonzero(gone & ~np.concatenate([[False], gone[:-1]]))
        out.append((i, len(v), int(gone.sum()), len(starts), bytes(b for b, g in zip(v, gone) if not g)))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(df, **kw).collect()
    return sorted(((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in got), key=str)


def corpus(seed, n=60, alphabet="abé"):
    rng = random.Random(seed)
    make = lambda k: "".join(rng.choices(alphabet, k=k))
    parts = [make(rng.randint(20, 120)) for _ in range(6)]
    rows = []
    for i in range(n):
        t = ""
        for _ in range(rng.randint(0, 4)):
            t += make(rng.randint(0, 60)) + (rng.choice(parts) if rng.random() < 0.6 else "")
        rows.append((i, t))
    return rows + [(900, "ab" * 120), (901, None), (902, ""), (903, rows[5][1]), (903, rows[5][1]), (None, "x" * 90)]


def test_matches_brute_force(spark):
    for seed in range(3):
        rows = corpus(seed)
        assert run(spark, rows, length=40, gram=10) == brute(rows, 40)
    rows = corpus(9, alphabet="abcdefghij")
    assert run(spark, rows, length=50, gram=20) == brute(rows, 50)


def test_spilling_gives_the_same(spark):
    rows = corpus(4)
    assert run(spark, rows, length=40, gram=10, memory=2000) == brute(rows, 40)


def plain_induction(segments, length):
    """(row, distance) of the repeated starts, all strings of one distance compared."""
    seen = Counter((d, s[before - d : before - d + length]) for s, before, after, _ in segments for d in range(after, before + 1))
    return {(i, d) for i, (s, before, after, many) in enumerate(segments) for d in range(after, before + 1) if many or seen[d, s[before - d : before - d + length]] > 1}


def test_induction_in_blocks_equals_comparison(monkeypatch):
    rng = random.Random(8)
    for trial in range(60):
        monkeypatch.setattr(suffix_dedup, "_BLOCK", rng.choice([1, 2, 3, 5, 16, 1000]))
        length, gram = 12, 3
        segments, groups = [], []
        for g in range(rng.randint(1, 4)):
            core = bytes(rng.choices(b"ab", k=gram))
            for _ in range(rng.randint(1, 12)):
                before, after = sorted((rng.randint(0, length - gram), rng.randint(0, length - gram)), reverse=True)
                s = bytes(rng.choices(b"ab", k=before)) + core + bytes(rng.choices(b"ab", k=length - gram - after))
                segments.append((s, before, after, rng.random() < 0.1))
                groups.append(g)
        shard = suffix_dedup.Shard(length, rng.choice([200, 1 << 20]))
        for i, ((s, before, after, many), g) in enumerate(zip(segments, groups)):
            shard.add((g, 0), i, g, 1 + many, before, after, s)
        got = {(int(r), d) for found in suffix_dedup.repeated_starts(shard) for r, lo, hi in found.tolist() for d in range(lo, hi + 1)}
        want = {(i, d) for g in set(groups) for own in [[i for i, x in enumerate(groups) if x == g]] for i, d in ((own[k], d) for k, d in plain_induction([segments[i] for i in own], length))}
        assert got == want, trial


def test_pieces_of_a_long_text(spark, monkeypatch):
    rng = random.Random(1)
    shared = "".join(rng.choices("abcdef ", k=900))
    rows = [(1, "".join(rng.choices("abcdef ", k=3000)) + shared), (2, shared[:700] + "z"), (3, shared[100:])]
    monkeypatch.setattr(suffix_dedup, "_PIECE", 1 << 10)
    assert run(spark, rows) == brute(rows, 400)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_queue_merges_runs():
    q = suffix_dedup.SpillingQueue(memory=50)
    items = [(hashlib.md5(str(i).encode()).digest(), i) for i in range(40)]
    for x in items:
        q.push(x, 30)
    assert list(q) == sorted(items)


def test_crowded_grams_are_split(spark):
    """A common phrase in different surroundings, some of which repeat in part."""
    rng = random.Random(12)
    make = lambda k: "".join(rng.choices("abcdefghij", k=k))
    phrase, around = make(25), [make(30) for _ in range(12)]
    rows = [(i, rng.choice(around)[rng.randrange(20) :] + phrase + rng.choice(around)[: rng.randrange(30)] + make(5)) for i in range(120)]
    rows += [(500 + i, make(40) + phrase + make(40)) for i in range(60)] + [(700, rows[3][1]), (701, rows[3][1])]
    want = brute(rows, 40)
    assert sum(r[2] > 0 for r in want) > 60
    for kw in ({"crowd": 1}, {"crowd": 20}, {"crowd": 20, "memory": 500}):
        assert run(spark, rows, length=40, gram=10, **kw) == want
    for seed in range(2):
        rows = corpus(seed)
        assert run(spark, rows, length=40, gram=10, crowd=1, memory=3000) == brute(rows, 40)


def test_a_shard_of_one_gram_stays_on_disk():
    """Segments of one gram, ten times the memory: their bytes are not held."""
    import tracemalloc

    rng, memory, n = random.Random(5), 1 << 20, 20_000
    tracemalloc.start()
    shard = suffix_dedup.Shard(400, memory)
    for i in range(n):
        shard.add((7, 0), i, 7, 1, 300, 0, rng.randbytes(300) + b"g" * 100 + rng.randbytes(300))
    copy = rng.randbytes(200) + b"g" * 100 + rng.randbytes(200)
    for i in range(2):
        shard.add((7, 0), n + i, 7, 1, 200, 0, copy)
    found = {row for block in suffix_dedup.repeated_starts(shard) for row in block[:, 0].tolist()}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(found) == [n, n + 1] and peak < 10 * memory < shard.size


def test_a_batch_of_rows_leaves_in_small_frames():
    """10,000 rows of 5 KB, as Spark hands them over: neither the anchors nor the kept bytes
    of all of them are held at once."""
    import tracemalloc

    rng = random.Random(2)
    base = ["".join(rng.choices("abcdefgh ", k=5000)) for _ in range(50)]
    texts = [base[i % 50] for i in range(10_000)]
    spans = [[{"s": 100, "e": 600}, {"s": 400, "e": 900}] if i % 2 else None for i in range(10_000)]
    pdf = pd.DataFrame({"doc_id": range(10_000), "k": 0, "text": texts, "spans": spans})
    tracemalloc.start()
    ids, places = [], 0
    for f in suffix_dedup._kept_frames(iter([pdf])):
        assert f["kept"].map(len).sum() < 2 << 20
        ids += f["doc_id"].tolist()
        odd = f[f["doc_id"] % 2 == 1]
        assert [x for s in odd["spans"] for x in s] == [{"start": 100, "end": 900}] * len(odd)
        assert all(len(k) == 4200 for k in odd["kept"])
    assert ids == list(range(10_000))
    for f in suffix_dedup._anchor_frames(iter([pdf[:2000]]), 400, 100):
        places += len(f)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert places > 2000 and peak < 130 << 20
