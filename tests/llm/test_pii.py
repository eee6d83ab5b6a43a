import hashlib
import re

from quarry.llm import pii, queries

#: The patterns that the base kinds are defined by.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), rank, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


TEXTS = [
    "mail a.b+c@x-y.example.com. and a@b.c_d@e.f, @x.y z@ q@w v@w..x a@b.c@d.e",
    "ip 1.2.3.4 256.1.1.1 001.02.0255.3 1.2.3 1.2.3.4.5.6.7.8 000000000000000000000000000001.2.3.4 99999999999999999999.1.1.1",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 378282246310005, 1234 5678 12x 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1",
    "é🙂 tel +1 (017) 555-7713 +44 20 7946 0958. +12 +1--------2 +1 (1) 2345678 )",
    None,
    "",
    "1" * 20_000,
    "a" * 20_000 + "@",
    "a.b-c " * 20_000 + "x@y" + ".z" * 20_000,
    "+" * 5000 + "1 " * 5000 + ".".join(["1"] * 5000),
    "IBAN GB82 WEST 1234 5698 7654 32, DE89370400440532013000, GB82 WEST 1234 5698 7654 33",
    "ssn 078-05-1120, part 078-05-1120x, phone: 555-123-4567, order 555-123-4567",
]


def base_of(spans):
    return [(s.kind, s.start, s.end) for s in spans if s.kind in BASE]


def test_base_spans_match_plain_regular_expressions(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "1 as pii")
    got = {r.doc_id: r.pii for r in pii.find_pii(df).collect()}
    for i, t in enumerate(TEXTS):
        assert base_of(got[i]) == plain(t), i
    added = [(s.kind, TEXTS[i][s.start : s.end]) for i in (10, 11) for s in got[i] if s.kind not in BASE]
    assert added == [("iban", "GB82 WEST 1234 5698 7654 32"), ("iban", "DE89370400440532013000"), ("ssn", "078-05-1120"), ("phone_local", "555-123-4567")]


def test_many_matches(spark):
    """More matches than one block of the running sums has, in one text."""
    text = " ".join(f"n{i}@x{i}.org, 1.2.3.{i % 300}" for i in range(5000))
    df = spark.createDataFrame([(1, text), (2, "a@b.cd " * 64), (3, "a@b.cd " * 65)], "doc_id long, text string")
    for r in pii.find_pii(df).collect():
        assert base_of(r.pii) == plain(r.text)
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert got[2] == "<email> " * 64 and got[3] == "<email> " * 65
    want = re.sub(r"n[0-9]+@x[0-9]+\.org", "<email>", text)
    assert got[1] == re.sub(r"1\.2\.3\.([0-9]+)", lambda m: "<ip>" if int(m[1]) <= 255 else m[0], want)


def test_redaction(spark):
    df = spark.createDataFrame([(1, "to é a@b.cd or +1 (017) 555-7713!", 5), (2, None, 5), (3, "none", 5), (4, "call 555-123-4567 4111111111111111@x.org", 5)], "doc_id long, text string, n int")
    assert [tuple(r) for r in pii.redact(df).orderBy("doc_id").collect()] == [(1, "to é <email> or <phone>!", 5), (2, None, 5), (3, "none", 5), (4, "call <phone_local> <email>", 5)]
    assert pii.redact(df.where("false")).collect() == []


def test_registered_query(spark):
    sf = "/root/testdata/sf0.01"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op5_pii(spark, sf).collect()
    assert len(rows) == len(text)
    for r in rows:
        spans = plain(text[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in spans) for k in BASE)
        assert set(joined.split(",")) <= set(r.spans.split(","))
