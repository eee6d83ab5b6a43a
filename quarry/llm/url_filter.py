"""URL filtering by pattern rules that are indexed by their rarest literal token.

A rule is a regular expression over the whole url together with literal tokens (runs of
a-z and 0-9, lower case) that every matching url contains as whole tokens. How often each
of these tokens occurs is counted over all urls; a rule is indexed under its rarest one.
The distinct tokens of a url fetch the rules indexed under them, and only these run their
expression. Rules without a token are tried on every url.

Only DataFrame operations are used. The index is broadcast while it has at most
``BROADCAST_LIMIT`` rules; a larger one is joined by a shuffle on salted tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_LIMIT = 50_000
SALTS = 64


class Rule(NamedTuple):
    """``base`` rules run on host and path joined and decide before the patterns, which
    run on the whole url. Among rules that fit, one that is an exception wins, then the
    longest ``name``, then the first."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    base: bool
    exception: bool = False


def host_rule(name: str, verdict: str) -> Rule:
    """``host/path``: fits the host and its subdomains if the url's path begins so;
    without a slash any path."""
    host, slash, path = name.partition("/")
    regex = r"^(?:[^/]*\.)?" + re.escape(host.lower() + slash + path) + ("" if slash else "(?=/|$)")
    whole = host + "/" + path[: path.rfind("/") + 1]
    return Rule(name, verdict, regex, tuple(dict.fromkeys(re.findall("[a-z0-9]+", whole.lower()))), True)


def phrase_rule(phrase: str, verdict: str) -> Rule:
    """The words of ``phrase`` one after another within a part of the url."""
    words = re.findall("[a-z0-9]+", phrase.lower())
    return Rule(phrase, verdict, r"(?i)(?:^|[^a-z0-9])" + "[^a-z0-9/]+".join(words) + r"(?:[^a-z0-9]|$)", tuple(words), False)


def listed_rule(line: str) -> Rule | None:
    """A line of a filter list in the usual syntax; None for comments, headers and lines
    that do not speak of urls.

    ``*`` is any text, ``^`` a separator or the end, ``|`` at an end the url's end and
    ``||`` the beginning of a host or subdomain; ``@@`` makes an exception and slashes
    around the line a regular expression. Options after ``$`` restrict where a browser
    applies a rule and are dropped. Letters fit in either case.
    """
    name = line.strip()
    body = name.removeprefix("@@")
    exception = body != name
    if not body or body.startswith(("!", "[")) or re.search("#[@?$]?#", body):
        return None
    if len(body) > 2 and body.startswith("/") and body.endswith("/"):
        return Rule(name, "allow" if exception else "block", f"(?i){body[1:-1]}", (), False, exception)
    body = re.sub(r"\$~?[a-z][a-z0-9,=~|._*-]*$", "", body, flags=re.IGNORECASE)
    head, tail = "", ""
    if body.startswith("||"):
        head, body = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?", body[2:]
    elif body.startswith("|"):
        head, body = "^", body[1:]
    if body.endswith("|"):
        tail, body = r"\z", body[:-1]
    if not body.strip("*"):
        return None
    parts = {"*": ".*", "^": r"(?:[^a-z0-9_.%-]|$)"}
    regex = "(?i)" + head + "".join(parts.get(c) or re.escape(c) for c in body) + tail
    # A run of letters and digits is a whole token of the url if the rule says what is next
    # to it: another character, or an end of the url.
    framed = ("." if head else "*") + body.lower() + ("." if tail else "*")
    tokens = re.findall(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", framed)
    return Rule(name, "allow" if exception else "block", regex, tuple(dict.fromkeys(tokens)), False, exception)


def listed_rules(lines: Iterable[str]) -> tuple[Rule, ...]:
    """The rules of a filter list, each once."""
    return tuple(dict.fromkeys(r for r in map(listed_rule, lines) if r))


def read_rules(spark: SparkSession, path: str) -> tuple[Rule, ...]:
    """The rules of the filter lists below ``path`` (text files, wherever Spark reads)."""
    return listed_rules(r["value"] for r in spark.read.text(path).orderBy("value").collect())


BASE_RULES = (
    host_rule("net/", "block"),
    host_rule("example.net/en/", "allow"),
    host_rule("example.com/de/", "block"),
    host_rule("org/fr/", "allow"),
)
PHRASES = ("spam farm", "cheap pills", "free casino", "online casino", "adult video", "xxx", "porn", "replica watches", "payday loan", "click bait")
#: What pages are rarely wanted for: advertisements, counters, log-ins, carts and feeds.
LIST = """
||ads.*^
||ad.*^
||adserver.*^
||banner.*^
||tracker.*^
||tracking.*^
||pixel.*^
||click.*^
/ads/*
/adserver/*
/advert/*
/advertising/*
/banners/*
/popup/*
/popunder/*
/affiliate/*
/sponsored/*
/tracking/*
/pixel.gif^
/beacon.js^
/clickthrough^
&ad_id=
&affiliate_id=
?affiliate_id=
&utm_campaign=*&utm_medium=cpc^
/wp-login.php^
/wp-admin/*
/cgi-bin/*
/login^
/signin^
/register^
/logout^
/cart^
/checkout^
/trackback^
/xmlrpc.php^
?replytocom=
?sessionid=
&sessionid=
?phpsessid=
;jsessionid=
/feed/|
.rss|
.exe|
.apk|
.torrent|
/viagra^
/casino/*
/poker/*
/escort^
/webcam^
||casino.*^
||bet.*^
||poker.*^
@@/docs/*
@@/documentation/*
@@/wiki/*
@@||docs.*^
@@||wiki.*^
"""
PATTERN_RULES = tuple(phrase_rule(p, "block") for p in PHRASES) + listed_rules(LIST.split("\n"))
DEFAULT_VERDICT = "allow"


def _place(url: Column) -> tuple[Column, Column]:
    """Host as written, and host with path."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)), F.lit(""))
    place = F.substring_index(F.substring_index(rest, "#", 1), "?", 1)
    return F.substring_index(place, "/", 1), place


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return _lower(_place(url)[0])


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    host, place = _place(url)
    return F.substr(place, F.length(host) + 1)


def url_tokens(url: Column) -> Column:
    """The distinct runs of a-z and 0-9 of the url, lower case."""
    return F.array_distinct(F.filter(F.split(_lower(F.coalesce(url, F.lit(""))), "[^a-z0-9]+"), lambda t: t != ""))


def rarest_tokens(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``rules`` (id, tokens, ...) with ``token``: its token that the fewest urls have,
    the first of equals; null for a rule without tokens."""
    own = rules.select("id", F.explode("tokens").alias("token"))
    seen = pages.select(F.explode(url_tokens(F.col("url"))).alias("token"))
    known = own.select("token").distinct()
    counts = seen.join(F.broadcast(known) if rules.count() <= BROADCAST_LIMIT else known, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    best = own.join(counts, "token", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    return rules.join(best, "id", "left")


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = BASE_RULES + PATTERN_RULES, default: str = DEFAULT_VERDICT, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """page_id, host, path, rule (of the base rules; else null), pattern (the other rule
    that decided; else null) and verdict, one row for each row of ``pages``.

    A null url, or one without ``://``, has an empty host and path; base rules do not fit
    it, patterns may. Repeated rows and null page_ids are kept. Other columns are ignored.
    """
    spark = pages.sparkSession
    urls = pages.select("page_id", "url", F.monotonically_increasing_id().alias("row"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    rows = [(i, *r) for i, r in enumerate(rules)]
    table = spark.createDataFrame(rows, "id int, name string, verdict string, regex string, tokens array<string>, base boolean, exception boolean")
    index = rarest_tokens(pages, table).drop("tokens").withColumn("token", F.coalesce("token", F.lit("*")))
    found = urls.withColumn("token", F.explode(F.array_append(url_tokens(F.col("url")), F.lit("*"))))
    if len(rows) <= broadcast_limit:
        candidates = found.join(F.broadcast(index), "token", "left")
    else:
        salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        candidates = found.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["token", "salt"], "left")
    target = F.when(F.col("base"), F.concat("host", "path")).otherwise(F.col("url"))
    rank = F.struct("base", "exception", F.length("name").alias("n"), (-F.col("id")).alias("first"), "name", "verdict")
    hit = F.when(F.rlike(target, F.col("regex")), rank)
    best = candidates.groupBy("row").agg(F.max(hit).alias("best"), *(F.first(c).alias(c) for c in ("page_id", "host", "path")))
    base = F.coalesce(F.col("best.base"), F.lit(False))
    return best.select(
        "page_id",
        "host",
        "path",
        F.when(base, F.col("best.name")).alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.when(~base, F.col("best.name")).alias("pattern"),
    )


def oracle_sql(rules: Sequence[Rule] = BASE_RULES + PATTERN_RULES, default: str = DEFAULT_VERDICT) -> str:
    """DuckDB SQL over ``pages`` that tries every rule on every url."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    listed = ", ".join(f"({i}, {quoted(r.name)}, {quoted(r.verdict)}, {quoted(r.regex)}, {r.base}, {r.exception})" for i, r in enumerate(rules))
    return f"""
with parts as (select page_id, url, row_number() over () as n,
    split_part(split_part(case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end, '#', 1), '?', 1) as place from pages),
urls as (select page_id, url, n, translate(split_part(place, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    substr(place, length(split_part(place, '/', 1)) + 1) as path from parts),
rules(id, name, verdict, regex, base, exception) as (values {listed}),
hits as (select n, base, name, verdict, row_number() over (partition by n order by base desc, exception desc, length(name) desc, id) as k from urls join rules
    on regexp_matches(case when base then host || path else url end, replace(regex, '(?=/|$)', '(/|$)')))
select page_id, host, path, case when base then name end as "rule", coalesce(verdict, '{default}') as verdict, case when not base then name end as pattern
from urls left join (select * from hits where k = 1) using (n)"""
