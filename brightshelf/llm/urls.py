"""URL filters: pattern rules indexed by their rarest literal token. DataFrame functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import literal

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``regex`` is searched in host + path. Every text that it finds something in must have each of ``literals`` as a whole
    token, that is a run of a-z and 0-9 between other characters; a rule without literals is run on every url. Among the
    rules that fit, ``strength`` decides, then the smaller name."""

    name: str
    verdict: str
    regex: str
    literals: tuple[str, ...]
    strength: int


def site(verdict: str, rule: str) -> Rule:
    """A rule ``host/path``: it fits the host and all its subdomains, for paths that start with the rule's."""
    host, _, rest = rule.partition("/")
    path = "/" + rest
    whole = re.findall("[a-z0-9]+", host.lower())
    # The last token of a path that stops short of a separator may go on in the url.
    whole += re.findall("[a-z0-9]+(?=[^a-zA-Z0-9])", re.sub("[A-Z0-9a-z]*[A-Z][A-Z0-9a-z]*", "/", path))
    return Rule(rule, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(dict.fromkeys(whole)), 1000 + len(rule))


#: The rules that the contract of op6 sets.
SITES = tuple(site(*x) for x in (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")))
#: What decides where none of them fits: labels of hosts that serve advertising or gambling.
PATTERNS = tuple(Rule(f"label:{x}", "block", rf"^[^/]*(?<![a-z0-9]){x}(?![a-z0-9])[^/]*(?:/|$)", (x,), 0) for x in ("ads", "track", "tracker", "bets", "casino", "poker"))


def parts(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where url is null or has no ``://``."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, _UPPER, _LOWER), path


def tokens(host: str = "host", path: str = "path") -> Column:
    return F.array_distinct(F.regexp_extract_all(F.concat(host, path), F.lit("[a-z0-9]+"), F.lit(0)))


def index(split: DataFrame, rules: tuple[Rule, ...]) -> dict[str, list[int]]:
    """For each rule's rarest literal among the urls of ``split`` (tokens): the rules kept under it, by number. Rules
    without a literal stand under the empty string. One aggregation, with a count for each literal of the rules."""
    literals = sorted({x for r in rules for x in r.literals})
    counts = split.agg(*(F.count_if(F.array_contains("tokens", x)).alias(f"n{k}") for k, x in enumerate(literals))).first() if literals else ()
    often = dict(zip(literals, counts, strict=True))
    out: dict[str, list[int]] = {}
    for k, r in enumerate(rules):
        out.setdefault(min(r.literals, key=lambda x: (often[x], x), default=""), []).append(k)
    return out


def _fetch(under: dict[str, list[int]]):
    """What gives the rules under a token. The index is a hash table: an array of buckets by the token's hash, so a url's
    tokens fetch theirs at the same cost whatever the number of rules."""
    size = 1 << (2 * len(under)).bit_length()
    buckets: list[list[dict]] = [[] for _ in range(size)]
    for t, n in under.items():
        digest = xxhash.xxh64_intdigest(t.encode(), 42)
        buckets[(digest - (digest >> 63 << 64)) % size].append({"t": t, "n": n})
    table = literal(buckets, "array<array<struct<t:string,n:array<int>>>>")
    return lambda t: F.flatten(F.transform(F.filter(F.element_at(table, F.pmod(F.xxhash64(t), F.lit(size)).cast("int") + 1), lambda e: e["t"] == t), lambda e: e["n"]))


def judged(pages: DataFrame, sites: tuple[Rule, ...] = SITES, patterns: tuple[Rule, ...] = PATTERNS, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) for each row of ``pages`` (page_id, url; other columns are not read).

    The longest fitting site rule decides (equal lengths: the smaller name); else the smallest fitting pattern, named in
    ``pattern``; else ``default``. Null urls have empty parts and the default. Rows are judged one by one, so repeated and
    null page_ids do not matter, and nothing is shuffled. The rules are a short list of the caller's: they become one
    literal of the plan.
    """
    rules = tuple(sorted((*sites, *patterns), key=lambda r: (-r.strength, r.name)))
    host, path = parts()
    split = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("tokens", tokens())
    under = index(split, rules)
    if not rules:
        return split.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.lit(None).cast("string").alias("pattern"))
    # A rule's number is its rank, so the smallest number that fits decides.
    always = F.array(*map(F.lit, under.get("", []))).cast("array<int>")
    candidates = F.concat(always, F.flatten(F.transform("tokens", _fetch({t: n for t, n in under.items() if t}))))
    regexes = F.array(*(F.lit(r.regex) for r in rules))
    whole = F.concat("host", "path")
    out = split.withColumn("candidates", candidates).withColumn("fits", F.array_min(F.filter("candidates", lambda k: F.rlike(whole, F.element_at(regexes, k + 1)))))
    # element_at() gives the last element for a null place, so places are never null there.
    named = lambda values: F.when(F.col("fits").isNotNull(), F.element_at(F.array(*map(F.lit, values)), F.coalesce("fits", F.lit(0)) + 1))
    of_site, name = named([r in sites for r in rules]), named([r.name for r in rules])
    return out.select(
        "page_id", "host", "path", F.when(of_site, name).alias("rule"), F.coalesce(named([r.verdict for r in rules]), F.lit(default)).alias("verdict"), F.when(~of_site, name).alias("pattern")
    )
