import re
from collections import defaultdict

import numpy as np

from quarry.llm import common, decontamination

ITEMS = [
    (1, "A train leaves Boston at 40 mph and travels 120 miles before it meets the 40 mph freight train from Chicago on the track."),
    (2, "the small grey cat sat near the open window all day long and watched birds"),
    (3, "what colour was it"),
    (4, None),
    (5, " ?! "),
]


def run(spark, docs, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as h", "2 as item_id")
    i = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "3 as pos")
    return sorted((r.doc_id, r.item_id, r.n_windows, r.reparameterised) for r in decontamination.matches(d, i, **kw).collect())


DOCS = [
    (10, "Intro words first. " + ITEMS[0][1] + " More follows here."),
    (11, "He said that a train leaves Denver at 55 mph and travels 300 miles before it meets the 55 mph freight train from Dallas on the track."),
    (12, "A train leaves Denver at 55 mph and travels 300 miles before it meets the 60 mph freight train from Dallas on the track."),
    (13, "so THE small grey cat sat near the open window all day long and watched birds and so on"),
    (14, "the small grey cat sat near the open door"),
    (15, "now: what colour was it? nobody knew"),
    (16, None),
    (17, ""),
    (18, "word " * 50_000 + ITEMS[1][1]),
    (19, "nothing to see here at all"),
]
FOUND = [(10, 1, False), (11, 1, True), (13, 2, False), (15, 3, False), (18, 2, False)]


def lower(word):
    return "".join(c.lower() if "A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" else c for c in word)


def template(text):
    """(canonical token, slot kind or None, plain token) of each token, by plain loops."""
    out, end, number = [], 0, False
    for m in re.finditer(r"[A-Za-z\u0080-\U0010ffff]+|[0-9](?:[.,]?[0-9])*", text):
        word, opens = m[0], end == 0 and not out or re.search("[.!?:;\n]", text[end : m.start()]) is not None
        kind = None
        if word[0].isascii() and word[0].isdigit():
            kind = "number"
        elif number and lower(word) in decontamination.UNITS:
            kind = "unit"
        elif lower(word[0]) != word[0] and not opens:
            kind = "name"
        out.append((kind and f"<{kind}>" or lower(word), kind, lower(word)))
        end, number = m.end(), kind == "number"
    return out


def brute(docs, items, window=decontamination.WINDOW, coverage=decontamination.COVERAGE):
    own, total = [], defaultdict(set)
    for item, text in items:
        t = template(text or "")
        n = min(window, len(t))
        own += [(item, p, t[p : p + n]) for p in range(len(t) - n + 1) if n]
    index = defaultdict(list)
    for item, p, w in own:
        total[item].add(p)
        index[tuple(x[0] for x in w)].append((item, p, w))
    found = []
    for doc, text in sorted(set(docs), key=str):
        t, lines = template(text or ""), defaultdict(list)
        for n in sorted({len(k) for k in index}):
            for p in range(len(t) - n + 1):
                for item, q, w in index.get(tuple(x[0] for x in t[p : p + n]), ()):
                    lines[item, p - q].append((q, [(a[1], a[2], b[2]) for a, b in zip(w, t[p : p + n]) if a[1]]))
        places, changed = defaultdict(set), defaultdict(bool)
        for (item, _), hits in lines.items():
            slots = {x for _, s in hits for x in s}
            if len({x[:2] for x in slots}) == len(slots):
                places[item] |= {q for q, _ in hits}
                changed[item] |= any(a != b for _, a, b in slots)
        found += [(doc, i, len(p), changed[i]) for i, p in places.items() if len(p) >= coverage * len(total[i])]
    return sorted(found)


def test_matches_brute_force(spark):
    assert run(spark, DOCS) == brute(DOCS, ITEMS)
    texts = ["Tom paid 5 dollars, Ann paid 5 dollars. Tom paid 7 euros: Bob 7 km", "a 1 b 2 c 3 d 4 e 5 f 6", "É x. À Nice Été 3,5 kg 1.2.3 ×Y", "12 12 12 12 12 12 12 12 12"]
    docs = [(i, "Go. " + t.replace(a, b) * k) for i, (t, a, b, k) in enumerate((t, a, b, k) for t in texts for a, b in (("5", "9"), ("Tom", "Eve"), ("12 12", "13 13"), ("b", "B")) for k in (1, 2))]
    items = [*enumerate(texts), (2, texts[0]), (3, texts[3]), (7, None)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for window in (3, 8):
        got = sorted((r.doc_id, r.item_id, r.n_windows, r.reparameterised) for r in decontamination.matches(d, i, window=window).collect())
        assert got == brute(docs, items, window)


def test_finds_copies_and_changed_values(spark):
    got = [(d, i, r) for d, i, _, r in run(spark, DOCS)]
    assert got == FOUND


def test_without_the_filter(spark):
    assert [(d, i, r) for d, i, _, r in run(spark, DOCS, filter_limit=0)] == FOUND


def test_windows_match_a_plain_loop():
    texts = [x.encode() for x in ("A bus from Paris took 3.5 hours, not 12km.", "", "x", "Été à Nice: Tom 5 kg")]
    canon, kind, plain, at = decontamination.templates(texts)
    assert kind[at[0] : at[1]].tolist() == [0, 0, 0, 2, 0, 1, 3, 0, 1, 3]
    assert kind[at[3] :].tolist() == [0, 0, 2, 0, 1, 3]
    assert np.diff(at).tolist() == [10, 0, 1, 6]
    w = common.window_hashes(canon[:4], 2)
    assert len(set(w.tolist())) == 3


def test_removal_and_empty(spark):
    d = spark.createDataFrame([*DOCS, (None, ITEMS[1][1]), (None, "fine text"), (10, "other text")], "doc_id long, text string")
    i = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = [(r.doc_id, r.text) for r in decontamination.decontaminate(d, i).collect()]
    assert sorted(x for x, _ in kept if x) == [10, 12, 14, 16, 17, 19] and (10, "other text") in kept
    assert [t for x, t in kept if x is None] == ["fine text"]
    assert decontamination.matches(d, i.where("false")).collect() == []
    assert decontamination.matches(d.where("false"), i).collect() == []


def test_benchmark_in_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    text = {r.doc_id: r.text for r in docs.collect()}
    whole = {(d, r.item_id) for r in items.collect() for d, t in text.items() if r.text in t}
    got = sorted((r.doc_id, r.item_id, r.n_windows, r.reparameterised) for r in decontamination.matches(docs, items).collect())
    assert got == brute(list(text.items()), [(r.item_id, r.text) for r in items.collect()])
    assert whole <= {x[:2] for x in got}
