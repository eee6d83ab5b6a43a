import math
import random
import re
from collections import Counter

import numpy as np

from quarry.llm import common, toxicity

BAD = ["vile", "awful", "nasty"]


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(vocab, k=rng.randint(5, 120))
        toxic, junk = rng.random() < 0.2, rng.random() < 0.3
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        if junk:
            words = [w + "###" for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, int(not junk), int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as toxic", "2 as p_toxic")
    known = spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.assess(d, known).collect()}
    assert len(got) == 600
    rest = labels[400:]
    assert np.mean([got[i].toxic == bool(t) for i, _, t in rest]) > 0.97
    assert np.mean([(got[i].p_low_quality >= 0.5) == (q == 0) for i, q, _ in rest]) > 0.97


def mark(word, more=0):
    """The number of a word's mark (bytes in lower case)."""
    hashed = common.span_hash(common.prefix_hash(np.frombuffer(word, np.uint8)), np.array([0]), np.array([len(word)])) + np.uint64(more)
    return 2 * int(common.mix(hashed)[0] >> np.uint64(65 - toxicity.BITS))


def plain_inputs(text):
    """Marks and shares of one ASCII text, word by word."""
    tokens = [m[0].lower().encode() for m in re.finditer(r"[A-Za-z]+|[0-9](?:[.,]?[0-9])*", text)]
    count = Counter(m for t in tokens for m in [mark(t), *(mark(t[:n], n) for n in toxicity.BEGINNINGS if len(t) > n)])
    marks = set(count) | {m + 1 for m, c in count.items() if c > 1 and 100 * c >= len(tokens)}
    share = lambda kept: sum(map(kept, text)) / max(len(text), 1)
    symbols = set(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))
    shares = [math.log1p(len(tokens)), share(lambda c: "A" <= c <= "Z"), share(symbols.__contains__), share(str.isdigit), len(set(tokens)) / max(len(tokens), 1)]
    return marks, shares


def plain_fit(rows, y):
    """Ridge logistic regression over (marks, shares): a function from one row to its log-odds."""
    pos, neg = sum(y), len(y) - sum(y)
    if not pos or not neg:
        return lambda r: math.log((pos + 0.5) / (neg + 0.5))
    telling = []
    for m in sorted(set().union(*(r[0] for r in rows))):
        yes = sum(m in r[0] for r, t in zip(rows, y) if t)
        no = sum(m in r[0] for r, t in zip(rows, y) if not t)
        p = (yes + no + 1) / (pos + neg + 2)
        z = abs((yes + 0.5) / (pos + 1) - (no + 0.5) / (neg + 1)) / math.sqrt(p * (1 - p) * (1 / pos + 1 / neg))
        if yes + no >= toxicity.RARE:
            telling.append((-z, m))
    chosen = sorted(m for z, m in sorted(telling)[: toxicity.N_MARKS] if -z > 3)
    columns = list(zip(*(r[1] for r in rows)))
    mean = [sum(c) / len(c) for c in columns]
    scale = [math.sqrt(sum((v - m) ** 2 for v in c) / len(c)) + 1e-9 for c, m in zip(columns, mean)]
    inputs = lambda r: [float(m in r[0]) for m in chosen] + [(v - m) / s for v, m, s in zip(r[1], mean, scale)] + [1.0]
    x = [inputs(r) for r in rows]
    w = [0.0] * len(x[0])
    w[-1] = math.log(pos / neg)
    ridge = [0.3] * (len(w) - 1) + [1e-6]
    for _ in range(15):
        slope, bend = [-k * v for k, v in zip(ridge, w)], np.diag(ridge)
        for row, t in zip(x, y):
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(row, w))))))
            slope = [g + v * (t - p) for g, v in zip(slope, row)]
            bend = bend + np.outer(row, row) * (p * (1 - p) + 1e-9)
        step = np.linalg.solve(bend, slope)
        w = [a + max(-4, min(4, b)) for a, b in zip(w, step)]
        if max(map(abs, step)) < 1e-6:
            break
    return lambda r: sum(a * b for a, b in zip(inputs(r), w))


def plain_chain(docs, labels, folds=toxicity.FOLDS):
    """doc_id to (p_low_quality, p_toxic): each model is fitted on rows that hold the earlier
    ones' log-odds, out of fold in training."""
    rows, seen = {i: plain_inputs(t) for i, t in docs}, {i: [] for i, _ in docs}
    cut = lambda v: max(-8, min(8, v))
    known = sorted(labels)
    train = {i: (rows[i][0], list(rows[i][1])) for i, *_ in known}
    fold = {i: int(common.mix(np.array([i], np.uint64))[0] % np.uint64(folds)) for i in train}
    for k in range(2):
        y = {i: (1 - q, t)[k] for i, q, t in known}
        model = plain_fit([train[i] for i in y], list(y.values()))
        for i, (marks, shares) in rows.items():
            odds = model((marks, shares + [cut(v) for v in seen[i]]))
            seen[i].append(odds)
        parts = [plain_fit([train[i] for i in y if fold[i] != f], [y[i] for i in y if fold[i] != f]) for f in range(folds)] if not k else []
        held_out = {i: cut(parts[fold[i]](train[i])) for i in y} if parts else {}
        for i, v in held_out.items():
            train[i][1].append(v)
    return {i: [1 / (1 + math.exp(-max(-30, min(30, v)))) for v in odds] for i, odds in seen.items()}


def test_chain_matches_a_plain_one(spark):
    docs, labels = corpus(160, 5)
    docs = [(i, t.replace("wa", "Longerword1.5 ", 2).replace("wb", "x,") + "!" * (i % 4)) for i, t in docs]
    want = plain_chain(docs, labels[:110])
    d, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels[:110], "doc_id long, quality int, toxic int")
    got = toxicity.assess(d.repartition(3), known).collect()
    assert len(got) == 160 and len({round(r.p_toxic, 3) for r in got}) > 20
    for r in got:
        assert abs(r.p_low_quality - want[r.doc_id][0]) < 1e-6 and abs(r.p_toxic - want[r.doc_id][1]) < 1e-6


def test_later_models_use_earlier_ones():
    rng = np.random.default_rng(0)
    n = 2000
    first = rng.random(n) < 0.5
    second = first ^ (rng.random(n) < 0.05)
    doc = np.flatnonzero(first)
    word = np.full(len(doc), 7)
    models = toxicity.fit_chain(doc, word, np.zeros((n, 1)), np.stack([first, second], 1).astype(int), rng.integers(0, 5, n))
    assert len(models[0].mean) == 1 and len(models[1].mean) == 2
    assert models[1].weights[-1] > 0.1


def test_edge_cases(spark):
    docs, labels = corpus(80)
    known = spark.createDataFrame([*labels, (None, 1, 1), (5, None, 1), (9_999, 1, 0)], "doc_id long, quality int, toxic int")
    rows = [*docs, (500, None), (501, ""), (502, "?! ..."), (None, "vile vile"), (7, docs[7][1]), (503, "ok " * 100_000 + "vile awful nasty")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.assess(d, known).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [(by[i].p_toxic, by[i].toxic) for i in (500, 501, 502)] == [(0.0, False)] * 3
    assert toxicity.assess(d.where("false"), known).collect() == []
    assert not any(r.toxic for r in toxicity.assess(d, known.where("false")).collect())
    assert len(toxicity.assess(d, known.where("toxic = 0")).collect()) == len(rows)


def test_labelled_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = "pmod(hash(doc_id), 4) = 0"
    rows = toxicity.assess(docs, labels.where(f"not {held}")).withColumnRenamed("toxic", "found").join(labels.where(held), "doc_id").collect()
    hit = sum(r.found and r.toxic == 1 for r in rows)
    assert hit / sum(r.toxic for r in rows) > 0.8
    assert sum(r.found and r.toxic == 0 for r in rows) / len(rows) < 0.02
