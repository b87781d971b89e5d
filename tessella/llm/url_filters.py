"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a host, a path prefix and/or a regular expression. Its literal tokens (runs of letters
and digits that every matching URL must contain as whole tokens) are counted in the URLs at hand;
the rule is indexed under its rarest token. A URL's tokens then fetch candidate rules from the
index by a join, and only those are tested; so a URL's cost does not grow with the rules that have other tokens. The
index is broadcast up to BROADCAST_RULES rules, and joined by its size else. The few rules that match inside
longer tokens have no such token and are tested on every URL. Everything is built-in Spark SQL.

A URL is judged once, however many rows have it; the rows look their URL's result up.

Verdicts: prefix rules come first and the longest fitting one wins; without one, the pattern rules
decide: an allow pattern wins over block patterns, and a URL that no pattern fits is allowed.

Defined cases: a null url or one without "://" has empty host and path and is tested as such (no
prefix rule fits; verdict allow). A null key stays. Repeated rows are judged each on its own. Extra columns are
ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessella.llm.common import table


@dataclass(frozen=True)
class PrefixRule:
    """Fits its host and all subdomains where the path starts with the rule's path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """A regular expression on the lower-cased "host/path?query"; `tokens` stand whole in every match; without any it is always tested."""

    verdict: str
    name: str
    tokens: tuple[str, ...]
    pattern: str


#: Rules up to which the index is broadcast.
BROADCAST_RULES = 100_000

#: Fixed values of the query's contract.
PREFIX_RULES = (
    PrefixRule("allow", "com", "/"),
    PrefixRule("block", "example.com", "/en/"),
    PrefixRule("allow", "www.example.com", "/en/"),
    PrefixRule("block", "net", "/es/"),
    PrefixRule("block", "net", "/fr/"),
)

#: name | verdict | tokens (- for none) | pattern
PATTERNS = r"""
spam-host | block | spam | ^(?:[^/]*[.-])?spam[.-]
spam-farm | block | - | ^[^/]*spam-farm
casino | block | casino | (?:^|[^a-z0-9])casino(?:[^a-z0-9]|$)
poker | block | poker | (?:^|[^a-z0-9])poker(?:[^a-z0-9]|$)
betting | block | betting | (?:^|[^a-z0-9])betting(?:[^a-z0-9]|$)
slots | block | slots | (?:^|[^a-z0-9])slots(?:[^a-z0-9]|$)
viagra | block | viagra | (?:^|[^a-z0-9])viagra(?:[^a-z0-9]|$)
payday-loan | block | - | (?:^|[^a-z0-9])payday[-_]?(?:loans?|advance)
porn | block | porn | (?:^|[^a-z0-9])porn(?:[^a-z0-9]|$)
xxx | block | xxx | (?:^|[^a-z0-9])xxx(?:[^a-z0-9]|$)
adult | block | adult | ^(?:[^/]*\.)?adult\.|/adult/
escort | block | escort | (?:^|[^a-z0-9])escort(?:[^a-z0-9]|$)
torrent | block | torrent | (?:^|[^a-z0-9])torrent(?:[^a-z0-9]|$)
warez | block | warez | (?:^|[^a-z0-9])warez(?:[^a-z0-9]|$)
crack | block | keygen | (?:^|[^a-z0-9])keygen(?:[^a-z0-9]|$)
malware | block | - | ^[^/]*malware
phishing | block | - | ^[^/]*phishing
clickbait | block | clickbait | (?:^|[^a-z0-9])clickbait(?:[^a-z0-9]|$)
ads-host | block | ads | ^ads\.
adserver | block | adserver | ^(?:[^/]*\.)?adserver\.
doubleclick | block | doubleclick | ^(?:[^/]*\.)?doubleclick\.
tracker | block | tracker | ^(?:[^/]*\.)?tracker\.
link-farm | block | - | ^[^/]*(?:link|content)-?farm\.
login | block | login | /login(?:[/?.]|$)
signin | block | signin | /signin(?:[/?.]|$)
logout | block | logout | /logout(?:[/?.]|$)
cart | block | cart | /cart(?:[/?.]|$)
checkout | block | checkout | /checkout(?:[/?.]|$)
wp-admin | block | admin wp | /wp-admin/
wp-login | block | login wp | /wp-login\.php
calendar-trap | block | calendar | /calendar/\d{4}/\d{2}
session-id | block | phpsessid | [?&]phpsessid=
replytocom | block | replytocom | [?&]replytocom=
print-view | block | print | /print(?:[/?.]|$)
feed | block | feed rss | /rss/feed(?:[/?.]|$)
robots | block | robots txt | /robots\.txt$
wiki | allow | wiki | ^(?:[^/]*\.)?wiki\.|/wiki/
docs | allow | docs | ^docs\.
archive | allow | archive | ^archive\.
edu | allow | edu | ^[^/]*\.edu(?:\.[a-z]{2})?/
gov | allow | gov | ^[^/]*\.gov(?:\.[a-z]{2})?/
"""


def pattern_rules() -> list[PatternRule]:
    lines = ([x.strip() for x in line.split(" | ")] for line in PATTERNS.strip().splitlines())
    return [PatternRule(verdict, name, tuple(t for t in tokens.split() if t != "-"), pattern) for name, verdict, tokens, pattern in lines]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("url")))
    host = F.coalesce(ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def tokens_of(prefix: PrefixRule) -> set[str]:
    return {t for t in re.split(r"[^a-z0-9]+", prefix.host) if t}


def url_tokens(c: Column) -> Column:
    return F.filter(F.split(c, "[^a-z0-9]+"), lambda t: t != "")


def rarest_tokens(urls: DataFrame, rules: list[tuple[str, ...]]) -> list[str | None]:
    """For each rule, its token that stands in the fewest rows of (url, token) (ties: alphabetical), or None without tokens.

    The counts that reach the driver are one row for each distinct rule token at most.
    """
    wanted = sorted({t for r in rules for t in r})
    known = _sized(urls.sparkSession.createDataFrame([(t,) for t in wanted], "token string"), len(wanted))
    counts = urls.select("token").join(known, "token").groupBy("token").agg(F.count("*").alias("n")).collect()
    seen = {r["token"]: r["n"] for r in counts}
    return [min(r, key=lambda t: (seen.get(t, 0), t), default=None) for r in rules]


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """The table for a broadcast if it has few rows; a larger one is joined as Spark sees fit."""
    return F.broadcast(df) if rows <= BROADCAST_RULES else df


def at_end(pattern: str) -> str:
    """A pattern whose $ stands for the very end, not also for the place before a last line feed as in Java."""
    return re.sub(r"(?<!\\)\$", r"\\z", pattern)


def judge_urls(pages: DataFrame, prefixes: list[PrefixRule], patterns: list[PatternRule], key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule (longest fitting prefix rule or null), pattern (first fitting pattern or null), verdict."""
    base = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    query = F.coalesce(F.regexp_extract("url", r"(\?[^#]*)", 1), F.lit(""))
    with_parts = lambda df: df.select("*", host.alias("host"), path.alias("path"))
    subject = F.concat("host", ascii_lower(F.col("path")), ascii_lower(query))
    urls = with_parts(base.where("url IS NOT NULL").select("url").distinct()).select("*", subject.alias("subject"))
    tokens = urls.select("*", F.explode(F.array_distinct(url_tokens(F.col("subject")))).alias("token"))

    every = [*(tuple(sorted(tokens_of(p))) for p in prefixes), *(p.tokens for p in patterns)]
    rows = []
    for i, (rule, token) in enumerate(zip([*prefixes, *patterns], rarest_tokens(tokens, every))):
        fields = (0, rule.verdict, rule.name, rule.host, rule.path, "", i) if isinstance(rule, PrefixRule) else (1, rule.verdict, rule.name, "", "", at_end(rule.pattern), i)
        rows.append((token, *fields))
    kind = "token string, kind int, verdict string, name string, rule_host string, rule_path string, pattern string, rank int"
    index = rule_table(pages, [r for r in rows if r[0] is not None], kind)
    below = (F.col("host") == F.col("rule_host")) | F.col("host").endswith(F.concat(F.lit("."), F.col("rule_host")))
    fits = F.when(F.col("kind") == 0, below & F.startswith(F.col("path"), F.col("rule_path"))).otherwise(F.regexp_like("subject", F.col("pattern")))
    found = tokens.join(index, "token").where(fits).select("url", "kind", "verdict", "name", "rank")
    # Rules without a necessary token: literals, tested where the urls are.
    always = [r for r in rows if r[0] is None]
    if always:
        each = F.array(*(F.when(F.regexp_like("subject", F.lit(r[6])), F.struct(F.lit(r[1]).alias("kind"), F.lit(r[2]).alias("verdict"), F.lit(r[3]).alias("name"), F.lit(r[7]).alias("rank"))) for r in always))
        found = found.union(urls.select("url", F.explode(F.array_compact(each)).alias("r")).select("url", "r.kind", "r.verdict", "r.name", "r.rank"))
    best = found.groupBy("url").agg(
        F.max(F.when(F.col("kind") == 0, F.struct(F.length("name").alias("n"), (-F.col("rank")).alias("rank"), "name", "verdict"))).alias("prefix"),
        F.min(F.when(F.col("kind") == 1, F.struct("verdict", "rank", "name"))).alias("pattern"),
    )
    return with_parts(base).join(best, "url", "left").select(
        F.col("key").alias(key), "host", "path", F.col("prefix.name").alias("rule"),
        F.coalesce("prefix.verdict", "pattern.verdict", F.lit("allow")).alias("verdict"),
        F.col("pattern.name").alias("pattern"),
    )


def rule_table(pages: DataFrame, rows: list[tuple], kind: str) -> DataFrame:
    return _sized(pages.sparkSession.createDataFrame(rows, kind), len(rows))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), list(PREFIX_RULES), pattern_rules())


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def oracle() -> str:
    """The same verdicts without an index: every rule against every url."""
    prefixes = ", ".join(f"({_sql_text(p.verdict)}, {_sql_text(p.host)}, {_sql_text(p.path)}, {i})" for i, p in enumerate(PREFIX_RULES))
    patterns = ", ".join(f"({_sql_text(p.verdict)}, {_sql_text(p.name)}, {_sql_text(p.pattern)}, {i})" for i, p in enumerate(pattern_rules()))
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH prefixes(verdict, rhost, rpath, rank) AS (VALUES {prefixes}),
patterns(verdict, name, pattern, rank) AS (VALUES {patterns}),
cut AS (SELECT page_id, row_number() OVER () AS rid, url,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (SELECT page_id, rid,
    coalesce({lower.format("regexp_extract(rest, '^([^/?#]*)', 1)")}, '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's'), '') AS path,
    coalesce(regexp_extract(url, '(\\?[^#]*)', 1), '') AS query FROM cut),
subjects AS (SELECT *, host || {lower.format("path")} || {lower.format("query")} AS subject FROM parts),
fit AS (SELECT rid, arg_max(rhost || rpath, length(rhost || rpath) * 1000 - rank) AS rule,
    arg_max(verdict, length(rhost || rpath) * 1000 - rank) AS verdict
    FROM parts, prefixes
    WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY rid),
hit AS (SELECT rid, arg_min(name, (verdict, rank)) AS pattern, min(verdict) AS verdict
    FROM subjects, patterns WHERE regexp_matches(subject, pattern) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(fit.verdict, hit.verdict, 'allow') AS verdict, pattern
FROM parts LEFT JOIN fit USING (rid) LEFT JOIN hit USING (rid)"""
