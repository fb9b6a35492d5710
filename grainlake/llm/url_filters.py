r"""URL filters: pattern rules indexed by their rarest literal token.

Two kinds of rules are held in one index.  A place rule names a host (with all
its subdomains) and the beginning of a path; of those that fit, the longest
wins, and any of them goes before pattern rules.  A pattern rule is matched
against the whole lower-cased url: ``*`` stands for anything, ``^`` for a
separator or the end, ``|`` for the url's begin or end, ``||`` for the begin of
a host or subdomain, ``@@`` in front makes it an exception.  Exceptions go
before blocks; a url that no rule matches is allowed.

Tokens are the runs of ``[a-z0-9]`` of the lower-cased url.  A literal run of a
rule is one of its tokens if it must stand in every match between two
characters that are no part of a run.  The rule is filed under that of its
tokens which the fewest urls hold; a rule without any is a candidate for every
url.  A url's own tokens fetch its candidates, and only those run their regular
expressions.  All of it is DataFrame expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = "[a-z0-9]+"
#: Up to so many rules the index is a constant of the plan; beyond it, a table that is joined.
PLAN_RULES = 10_000

#: Urls that lead to no text of their own, and exceptions to that.
PATTERNS = """
||ads.
||adserver.
||tracker.
||analytics.
/ads/
/advert/
/banner^
/login^
/signin^
/signup^
/register^
/logout^
/cart^
/checkout^
/account^
/search^
/calendar/*/
/share^
/print^
/feed^
/rss^
/tag/
/tags/
/wp-admin/
/wp-login.php
/xmlrpc.php
/cgi-bin/
^utm_source=
^utm_campaign=
^sessionid=
^replytocom=
^sort=
^page=*&ref=
phpsessid=
jsessionid=
-casino-
.zip|
.exe|
.pdf|
.jpg|
.png|
.css|
.js|
@@/tags/index.html|
@@/print/about^
@@||docs.*/search^
""".split()


@dataclass(frozen=True)
class Rule:
    """``text``: how it is reported; ``place``: matched against host and path instead of the url; ``length``: for the order of place rules."""

    text: str
    allow: bool
    place: bool
    regex: str
    tokens: tuple[str, ...]
    length: int = 0


def place_rule(host: str, path: str, allow: bool) -> Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""
    host = host.translate(str.maketrans(UPPER, LOWER))
    regex = r"\A(?:[^/]*\.)?" + re.escape(host) + (re.escape(path) if path else r"(?:/|\z)")
    # the path's last run may go on in the url
    return Rule(host + path, allow, True, regex, _runs("|" + host + ("/" if not path else path + "*")), len(host + path))


def pattern_rule(pattern: str) -> Rule:
    """A rule in the notation of the module's docstring."""
    body = pattern.removeprefix("@@").translate(str.maketrans(UPPER, LOWER))
    inner = body.removeprefix("||") if body.startswith("||") else body.removeprefix("|")
    begin = r"\A[^/]*://(?:[^/?#]*\.)?" if body.startswith("||") else r"\A" if body.startswith("|") else ""
    end = r"\z" if inner.endswith("|") else ""
    inner = inner.removesuffix("|")
    special = {"*": ".*", "^": r"(?:[^a-z0-9_.%-]|\z)"}
    regex = "(?s)" + begin + "".join(special.get(c) or re.escape(c) for c in inner) + end
    return Rule(pattern, pattern.startswith("@@"), False, regex, _runs(("|" if begin else "*") + inner + ("|" if end else "*")))


def _runs(pattern: str) -> tuple[str, ...]:
    """The literal runs that are whole tokens of every match: those with no wildcard beside them."""
    pattern = pattern.translate(str.maketrans(UPPER, LOWER))
    return tuple(sorted({m[0] for m in re.finditer(TOKEN, pattern) if "*" not in pattern[m.start() - 1 : m.start()] + pattern[m.end() : m.end() + 1]}))


def lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without one."""
    return F.coalesce(lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without a ``://``."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a url."""
    return F.array_distinct(F.regexp_extract_all(lower(F.coalesce(url, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1)))


def token_counts(urls: DataFrame, rules: Sequence[Rule], url_col: str = "url") -> dict[str, int]:
    """How many rows of ``urls`` hold each of the rules' tokens: at most one number for each of them."""
    known = urls.sparkSession.createDataFrame([(t,) for t in sorted({t for r in rules for t in r.tokens})], "token string")
    # written, so that its size is known when the join is planned: a few tokens are broadcast and no url's tokens move
    known = materialise(known, "url-tokens")
    held = urls.select(F.explode(tokens_of(F.col(url_col))).alias("token")).join(known, "token", "left_semi")
    return {r.token: r.n for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}


def build_index(rules: Sequence[Rule], counts: dict[str, int]) -> list[dict]:
    """A row per rule: the token it is filed under (rarest first, then alphabetical; empty if it has none) and its rank.

    The highest rank wins: blocks, then exceptions, then place rules by length;
    of place rules of one length the one with the longer host, then the later
    in the alphabet.  A rule given twice is one rule; of two place rules of one
    text the last one given holds.
    """
    unique = {(r.place, r.text): r for r in rules}.values()
    order = sorted(unique, key=lambda r: (r.place, r.length, r.text.find("/") if r.place else 0, r.allow if not r.place else False, r.text))
    return [
        {"token": min(r.tokens, key=lambda t: (counts.get(t, 0), t)) if r.tokens else "", "rank": k, "text": r.text, "allow": r.allow, "place": r.place, "regex": r.regex}
        for k, r in enumerate(order)
    ]


_RULE = "struct<token:string,rank:int,text:string,allow:boolean,place:boolean,regex:string>"


def _hit(rule: Column, url: Column, place: Column) -> Column:
    return F.regexp_like(F.when(rule["place"], place).otherwise(url), rule["regex"])


def _from_plan(urls: DataFrame, index: list[dict]) -> DataFrame:
    """The winning rule, with the index as a hash table that is a constant of the plan: no row moves."""
    slots: list[list[dict]] = [[] for _ in range(max(1, 2 * len(index)))]
    for r in index:
        slots[crc32(r["token"].encode()) % len(slots)].append(r)
    table = F.from_json(F.lit(json.dumps(slots)), f"array<array<{_RULE}>>")
    fetch = lambda t: F.filter(F.get(table, F.crc32(t) % len(slots)), lambda r: r["token"] == t)
    candidates = F.flatten(F.transform(F.concat(F.array(F.lit("")), tokens_of(F.col("url"))), fetch))
    hits = F.filter(candidates, lambda r: _hit(r, F.col("low"), F.col("place")))
    best = F.array_max(F.transform(hits, lambda r: F.struct(r["rank"].alias("rank"), r["text"].alias("text"), r["allow"].alias("allow"), r["place"].alias("place"))))
    return urls.withColumn("best", best)


def _from_table(urls: DataFrame, index: list[dict]) -> DataFrame:
    """The same with the index as a table: distinct urls meet it by their tokens, and the rows meet the distinct urls' winners."""
    table = materialise(urls.sparkSession.createDataFrame(index, _RULE), "url-rules")
    held = urls.select("url", "low", "place").where("url is not null").distinct()
    held = held.select("*", F.explode(F.concat(F.array(F.lit("")), tokens_of(F.col("url")))).alias("token"))
    met = held.join(table.select("token", F.struct("*").alias("r")), "token").where(_hit(F.col("r"), F.col("low"), F.col("place")))
    best = met.groupBy(F.col("url").alias("of_url")).agg(F.max(F.struct("r.rank", "r.text", "r.allow", "r.place")).alias("best"))
    best = materialise(best, "url-winners")
    return urls.join(best, urls.url == best.of_url, "left").drop("of_url")


def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", plan_rules: int = PLAN_RULES) -> DataFrame:
    """``(id, url, host, path, rule, verdict, pattern)`` for every row.

    ``rule`` is the place rule that decides, else null; ``pattern`` the pattern
    rule that decides, else null.  A null or empty url has an empty host and
    path, matches only rules without a token, and is allowed by default.
    Repeated rows keep a row each; no rules allow all; other columns are ignored.
    """
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    index = build_index(rules, token_counts(source, rules))
    urls = source.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), lower(F.coalesce("url", F.lit(""))).alias("low"))
    urls = urls.withColumn("place", F.concat("host", "path"))
    judged = _from_plan(urls, index) if len(index) <= plan_rules else _from_table(urls, index)
    verdict = F.when(F.coalesce(F.col("best.allow"), F.lit(True)), "allow").otherwise("block")
    return judged.select(
        "id", "url", "host", "path",
        F.when(F.col("best.place"), F.col("best.text")).alias("rule"),
        verdict.alias("verdict"),
        F.when(~F.col("best.place"), F.col("best.text")).alias("pattern"),
    )
