import random
import re

import duckdb

from quarry.llm import queries, url_filter

URLS = [
    (1, "https://a.Example.NET/en/x?y#z"),
    (2, "http://example.net/de/1"),
    (3, "http://example.net"),
    (4, "https://example.com/de/q"),
    (5, "https://myexample.com/de/q"),
    (6, "https://x.org/fr/"),
    (7, "https://x.org/fr"),
    (8, "ftp://h.net:80/p"),
    (9, None),
    (10, ""),
    (11, "no scheme cheap-pills.org/fr/"),
    (12, "https://spam-farm.example.org/en/1"),
    (13, "https://cheap.pills.example.com/de/1"),
    (14, "https://example.net/en/://b.org/fr/"),
    (15, "http://?q=net/"),
    (16, "https://example.net?/en/"),
    (17, "https://" + "a." * 50_000 + "net/" + "x/" * 50_000),
    (18, "HTTPS://ÉXAMPLE.net/#a?b"),
    (1, "https://a.Example.NET/en/x?y#z"),
    (None, "https://q.net/"),
]


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    rest = rest.split("#", 1)[0].split("?", 1)[0]
    host, slash, path = rest.partition("/")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = slash + path
    fits = []
    for name, verdict in (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")):
        h, _, p = name.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(name), name, verdict))
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_base_rules(spark):
    df = spark.createDataFrame(URLS, "page_id long, url string").selectExpr("*", "'x' as host", "1 as row", "2 as token")
    rows = url_filter.filter_urls(df).collect()
    want = sorted((str(i), *map(str, plain(u))) for i, u in URLS)
    got = sorted((str(r.page_id), r.host, r.path, str(r.rule), str(r.verdict if r.rule else None)) for r in rows)
    assert got == want
    by = {r.page_id: r for r in rows}
    assert (by[12].pattern, by[12].verdict) == ("spam farm", "block") and (by[11].pattern, by[11].verdict) == ("cheap pills", "block")
    assert by[2].verdict == "block" and by[10].verdict == "allow" and by[9].host == ""


def test_shuffled_index_gives_the_same(spark):
    df = spark.createDataFrame(URLS, "page_id long, url string")
    a, b = (sorted(map(str, url_filter.filter_urls(df, broadcast_limit=n).collect())) for n in (10, 0))
    c = sorted(map(str, url_filter.filter_urls(df).collect()))
    assert b == c and len(a) == len(c)


def test_rarest_token_and_unindexed_rules(spark):
    df = spark.createDataFrame([(i, f"http://common.net/{'rare' if i == 3 else i}") for i in range(9)], "page_id long, url string")
    rules = [url_filter.Rule("any", "block", "rare", (), False), url_filter.phrase_rule("common rare", "block")]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], "id int, name string, verdict string, regex string, tokens array<string>, base boolean, exception boolean")
    assert {r.name: r.token for r in url_filter.rarest_tokens(df, table).collect()} == {"any": None, "common rare": "rare"}
    assert [r.page_id for r in url_filter.filter_urls(df, rules).collect() if r.verdict == "block"] == [3]
    assert url_filter.filter_urls(df.where("false")).collect() == []
    assert {r.verdict for r in url_filter.filter_urls(df, []).collect()} == {"allow"}


def test_lines_of_a_filter_list():
    rule = url_filter.listed_rule
    fits = lambda line, url: re.search(rule(line).regex.replace(r"\z", r"\Z"), url) is not None
    assert all(rule(x) is None for x in ("", "! note", "[Adblock]", "site.org##.box", "*", "||"))
    assert fits("||ads.org^", "https://x.Ads.org/a") and not fits("||ads.org^", "https://xads.org/") and not fits("||ads.org^", "https://ads.organic/")
    assert fits("/ban*er^", "http://h/banner?x") and not fits("/ban*er^", "http://h/banners") and fits("|http://h", "http://h.org") and not fits("|h.org", "http://h.org")
    assert fits(".rss|", "http://h/a.rss") and not fits(".rss|", "http://h/a.rss?x") and fits("/a[0-9]+z/", "http://h/A12Z")
    assert rule("||ads.org^$third-party,domain=a.com|~b.com").regex == rule("||ads.org^").regex
    assert rule("@@/docs/*").verdict == "allow" and rule("@@/docs/*").exception and rule("x/ads*foo|").tokens == () and rule("/ads/foo*").tokens == ("ads",)


def test_thousands_of_rules_match_every_rule_tried(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: rng.choice(["ads", "shop", "net", "a1", "xyz"]) + str(rng.randrange(60) or "")
    shapes = ["||{}.{}^", "/{}/{}", "/{}-*{}^", "{}.{}|", "@@/{}/*{}", "&{}={}", "@@||{}.{}^$image", "|https://{}.{}"]
    lines = ["! list"] + [rng.choice(shapes).format(word(), word()) for _ in range(4000)]
    (tmp_path / "list.txt").write_text("\n".join(lines))
    rules = url_filter.BASE_RULES + url_filter.read_rules(spark, str(tmp_path))
    assert len(rules) > 3000
    urls = [(i, f"https://{word()}.{word()}/{word()}/{rng.choice(['', 'DOCS/'])}{word()}-{word()}?{word()}={word()}&{word()}={word()}") for i in range(300)]
    tried = [(r, re.compile(r.regex.replace(r"\z", r"\Z"))) for r in rules]
    want = []
    for i, u in urls:
        host, path, *_ = plain(u)
        hits = [(r.base, r.exception, len(r.name), -k, r) for k, (r, x) in enumerate(tried) if x.search(host + path if r.base else u)]
        best = max(hits)[-1] if hits else None
        want.append((i, best.name if best else None, best.verdict if best else "allow"))
    assert sum(x[1] is not None for x in want) > 30
    df = spark.createDataFrame(urls, "page_id long, url string")
    for limit in (50_000, 0):
        got = sorted((r.page_id, r.rule or r.pattern, r.verdict) for r in url_filter.filter_urls(df, rules, broadcast_limit=limit).collect())
        assert got == want


def test_oracle(spark):
    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"create or replace view pages as select * from '{sf}/pages.parquet'")
    sql = sorted(map(str, duckdb.sql(queries.oracle_sql()["op1_url_filters"]).fetchall()))
    assert sorted(str(tuple(r)) for r in queries.op1_url_filters(spark, sf).collect()) == sql
