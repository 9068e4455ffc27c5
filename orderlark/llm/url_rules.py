"""URL filter: pattern rules indexed by their rarest literal token.

A rule is a pattern that must be found in host + rest of a URL (the host in lower case).
Patterns are literal text with `*` (anything), `^` (a separator or the end), a leading `|` (the
start) or `||` (the host or a parent domain), and a trailing `|` (the end). Literal tokens are
the runs of letters and digits that the pattern bounds on both sides; a URL that a pattern fits
has each of them among its own tokens.

1. The URL tokens of the whole table are counted, those of the rules only; each rule is filed
   under that one of its tokens which the fewest URLs have.
2. The index is an array of SLOTS slots, a token's slot following from its hash. Each URL looks
   its tokens up, and only the rules found there run their regular expressions on it; rules
   without a token are candidates of every URL.
3. Of the rules that fit, the one with the least rank decides: base rules (host and path) by
   falling length, then patterns that allow, then those that block. Without one the URL is
   allowed.

All of it is DataFrame code in one pass over the URLs, without a shuffle of them. Rules are a
parameter of at most MOST_RULES, so the index that all executors get is bounded.

Defined results: a null URL and one without `://` have an empty host and path, are judged by
neither base rules nor patterns, and are allowed; rows are judged each for itself, so repeated
rows come back repeated; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlark.llm.common import constant, table

SLOTS = 4096
MOST_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    """A rule as written, its verdict, its regular expression, its tokens, whether it is a base one."""

    text: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    base: bool = False


#: Base rules (verdict, host, path).
BASE = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

#: Patterns of pages that are of no use as training text.
BLOCKING = """
||spam-farm.
||casino. ||poker. ||slots. ||betting. ||lottery.
||xxx^ ||porn. ||adult. ||escort. ||sex.
||ads. ||adserver. ||doubleclick. ||tracker. ||pixel. ||banner. ||click.
||warez. ||torrent. ||crack. ||keygen. ||pharma. ||viagra. ||payday.
||link-farm. ||seo-links. ||parked. ||domain-for-sale.
/casino/ /poker/ /viagra/ /cialis/ /payday-loans/ /porn/ /xxx/ /escorts/
/ads/ /adclick^ /adserver/ /banner/ /popunder^ /sponsored/ /affiliate/
/login^ /signin^ /signup^ /register^ /logout^ /account/ /password-reset^
/cart^ /checkout^ /basket^ /wishlist^ /compare^
/search? /search/ /tag/*/page/ /calendar/*/20 /archive/*/page/ /wp-login. /wp-admin/ /wp-json/ /xmlrpc.
/cgi-bin/ /trackback/ /feed/ /rss/ /atom. /print/ /amp/ /replytocom^
^sessionid= ^phpsessid= ^jsessionid= ^sid= ^replytocom= ^add-to-cart= ^share= ^sort=*&order=
.pdf| .zip| .exe| .jpg| .jpeg| .png| .gif| .mp3| .mp4| .css| .js| .xml| .json|
""".split()

#: Exceptions, which outrank them.
ALLOWING = ["||docs.*/search/", "/account/privacy^", "/feed/about^", "||blog.*/tag/", "/login-help^"]

_REGEX = {"*": ".*", "^": "(?:[^a-z0-9_.%-]|$)"}


def pattern_rule(text: str, verdict: str) -> Rule:
    body, start, end = text, "", ""
    if body.startswith("||"):
        body, start = body[2:], "^(?:[^/?#]*\\.)?"
    elif body.startswith("|"):
        body, start = body[1:], "^"
    if body.endswith("|"):
        body, end = body[:-1], "$"
    body = body.lower()
    # An open end of the pattern may lie inside a longer word, as may the place of a `*`.
    bounded = ("^" if start else "*") + body + ("^" if end else "*")
    # A `*` at an open end says nothing, and would make a search quadratic in the URL.
    body = body if start else body.lstrip("*")
    body = body if end else body.rstrip("*")
    regex = "".join(_REGEX.get(c, re.escape(c)) for c in body)
    tokens = {m[0] for m in re.finditer(r"(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])", bounded)}
    return Rule(text, verdict, f"(?is){start}{regex}{end}", tuple(sorted(tokens)))


def base_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host and its subdomains, and paths that begin with the given one."""
    made = pattern_rule(f"||{host}{path}", verdict)
    # Hosts are in lower case already, paths keep their case.
    return Rule(host + path, verdict, f"(?s)^(?:[^/?#]*\\.)?{re.escape(host + path)}", made.tokens, base=True)


def ruleset(base: Sequence[tuple[str, str, str]] = BASE, allowing: Sequence[str] = ALLOWING, blocking: Sequence[str] = BLOCKING) -> list[Rule]:
    """Rules by falling rank."""
    first = sorted((base_rule(*b) for b in base), key=lambda r: (-len(r.text), r.text))
    return [*first, *[pattern_rule(p, "allow") for p in allowing], *[pattern_rule(p, "block") for p in blocking]]


def located(url: Column) -> list[Column]:
    """host, path, and target (host and all that follows it)."""
    url = F.coalesce(url, F.lit(""))
    lower = lambda c: F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    part = lambda i: F.regexp_extract(url, "(?s)^.*?://([^/?#]*)([^?#]*)(.*)", i)
    return [lower(part(1)).alias("host"), part(2).alias("path"), F.concat(lower(part(1)), part(2), part(3)).alias("target")]


def tokens(target: Column) -> Column:
    """Distinct lower-cased runs of letters and digits."""
    lower = F.translate(target, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_distinct(F.array_remove(F.split(lower, "[^a-z0-9]+"), ""))


def rule_index(targets: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row: slots, an array of SLOTS arrays of (token, rule), and always, the rules
    without a token; targets has a column target."""
    spark = targets.sparkSession
    facts = [(i, r.regex, r.text, r.verdict, r.base, list(r.tokens)) for i, r in enumerate(rules)]
    known = spark.createDataFrame(facts, "rank int, regex string, text string, verdict string, base boolean, tokens array<string>")
    rule = F.struct("rank", "regex", "text", "verdict", "base").alias("rule")
    each = known.select(rule, F.explode_outer("tokens").alias("token"))
    wanted = each.select("token").distinct()
    # MOST_RULES bounds the wanted tokens, so they may be broadcast; a token that very many
    # URLs have is then counted where it is read.
    met = targets.select(F.explode(tokens(F.col("target"))).alias("token")).join(F.broadcast(wanted), "token", "left_semi")
    counts = met.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = Window.partitionBy("rule.rank").orderBy(F.coalesce("n", F.lit(0)), F.length("token").desc(), "token")
    filed = each.join(counts, "token", "left").withColumn("_r", F.row_number().over(rarest)).where("_r = 1")
    slot = F.pmod(F.xxhash64("token"), F.lit(SLOTS)).cast("int")
    slots = filed.where("token IS NOT NULL").groupBy(slot.alias("slot")).agg(F.collect_list(F.struct("token", "rule")).alias("filed"))
    empty = F.expr("CAST(array() AS array<struct<token: string, rule: struct<rank: int, regex: string, text: string, verdict: string, base: boolean>>>)")
    places = spark.range(SLOTS).select(F.col("id").cast("int").alias("slot")).join(slots, "slot", "left")
    packed = places.select("slot", F.coalesce("filed", empty).alias("filed"))
    # A row for every slot, and at most MOST_RULES rules in all.
    index = packed.agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "filed"))), lambda s: s["filed"]).alias("slots"))
    unfiled = filed.where("token IS NULL").agg(F.collect_list("rule").alias("always"))
    return index.select(F.struct("slots", unfiled.scalar().alias("always")).alias("index"))


def judged(df: DataFrame, rules: Sequence[Rule] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (a base rule's text), verdict, pattern (the deciding
    pattern), candidates (rules whose expressions were run)."""
    rules = ruleset() if rules is None else list(rules)
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules, at most {MOST_RULES} are indexed")
    places = df.select(F.col(id_col).alias("page_id"), *located(F.col(url_col)))
    index = constant(rule_index(places.select("target"), rules), "index")
    slot = lambda t: F.pmod(F.xxhash64(t), F.lit(SLOTS)).cast("int")
    filed = F.flatten(F.transform(tokens(F.col("target")), lambda t: F.filter(F.get(index["slots"], slot(t)), lambda e: e["token"] == t)))
    found = places.withColumn("candidates", F.when(F.col("target") != "", F.concat(F.transform(filed, lambda e: e["rule"]), index["always"])))
    fitting = F.filter("candidates", lambda r: F.rlike(F.col("target"), r["regex"]))
    best = found.withColumn("best", F.array_min(fitting))
    return best.select(
        "page_id",
        "host",
        "path",
        F.when(F.col("best.base"), F.col("best.text")).alias("rule"),
        F.coalesce("best.verdict", F.lit("allow")).alias("verdict"),
        F.when(~F.col("best.base"), F.col("best.text")).alias("pattern"),
        F.coalesce(F.size("candidates"), F.lit(0)).alias("candidates"),
    )


def op12_url_rules(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages")).drop("candidates")


QUERIES = {"op12_url_rules": op12_url_rules}


def _sql() -> str:
    """Every rule held against every URL, without an index."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ",\n".join(f"({i}, {quoted(r.regex)}, {quoted(r.text)}, {quoted(r.verdict)}, {str(r.base).lower()})" for i, r in enumerate(ruleset()))
    return rf"""
WITH r(rank, regex, text, verdict, base) AS (VALUES {values}),
u AS (SELECT row_number() OVER () AS row, page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)(.*)', ['h', 'p', 't']) AS x FROM pages),
l AS (SELECT row, page_id, translate(x.h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, x.p AS path, x.t AS t FROM u),
f AS (SELECT row, any_value(page_id) AS page_id, any_value(host) AS host, any_value(path) AS path, arg_min(r, r.rank) AS r
      FROM l LEFT JOIN r ON host || path || t <> '' AND regexp_matches(host || path || t, r.regex) GROUP BY row)
SELECT page_id, host, path, CASE WHEN r.base THEN r.text END AS rule, coalesce(r.verdict, 'allow') AS verdict, CASE WHEN NOT r.base THEN r.text END AS pattern FROM f"""


ORACLE = {"op12_url_rules": _sql()}
