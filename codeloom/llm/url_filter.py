"""URL filters: pattern rules indexed by their rarest literal token; DataFrame functions only.

Every rule names literal tokens that any URL it fits must hold as whole tokens. Token counts over all URLs choose the
rarest of them, under which the rule is filed. A URL's tokens fetch the rules filed under them, and only those run their
regular expressions, against host and path.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codeloom.llm.common import LOWER, UPPER, ascii_lower
from codeloom.session import fixed_table

#: Up to this many rules the index is broadcast; beyond it the join with the tokens is left to the planner.
BROADCAST_RULES = 100_000

#: Host and path rules of the contract.
BASE_RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)

#: Pattern rules of this library: words that stand alone between delimiters, and paths of pages without prose.
BLOCKED_WORDS = ("adult", "bets", "betting", "casino", "escort", "gambling", "jackpot", "malware", "nude", "payday", "phishing", "poker", "porn", "roulette", "sex", "spam", "torrent", "viagra", "warez", "xxx")
BLOCKED_PATHS = ("/ads/", "/cart/", "/cgi-bin/", "/login/", "/search/", "/tag/", "/wp-admin/", "/wp-login.php")


@dataclass(frozen=True)
class Rule:
    """rule: the text of a host and path rule, else empty; literals: whole lower-case tokens of every URL it fits."""

    pattern: str
    action: str
    literals: tuple[str, ...]
    rule: str = ""


def tokens_of(text: str) -> list[str]:
    return [t for t in re.split(r"[^a-z0-9]+", text.lower()) if t]


def quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", text)


def host_rule(rule: str, action: str) -> Rule:
    """A rule such as `example.org/en/1`: the host with all subdomains, and the start of the path."""
    host, path = rule[: rule.index("/")], rule[rule.index("/"):]
    closed = path[: path.rindex("/") + 1]  # what follows the last slash may go on in the URL
    return Rule(f"^([^/]*\\.)?{quoted(host)}{quoted(path)}", action, tuple(tokens_of(host + closed)), rule)


def word_rule(word: str, action: str) -> Rule:
    return Rule(f"(^|[^a-z0-9]){word}([^a-z0-9]|$)", action, tuple(tokens_of(word)))


def path_rule(path: str, action: str) -> Rule:
    """A path or a start of one that any URL holds; what touches either end may go on in the URL."""
    first, last = re.search(r"[^A-Za-z0-9]|$", path).start(), re.search(r"[A-Za-z0-9]*$", path).start()
    return Rule(f"{quoted(path)}", action, tuple(tokens_of(path[first:last])))


def default_rules() -> list[Rule]:
    return [host_rule(*r) for r in BASE_RULES] + [word_rule(w, "block") for w in BLOCKED_WORDS] + [path_rule(p, "block") for p in BLOCKED_PATHS]


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """(pattern, action, literals, rule): a rule table such as `url_filter` takes, from a short list."""
    rows = [(r.pattern, r.action, " ".join(r.literals), r.rule) for r in rules] or [("", "", "", "")]
    table = fixed_table(spark, "pattern, action, literals, rule", rows).filter("pattern <> ''")
    return table.withColumn("literals", F.filter(F.split("literals", " "), lambda t: t != ""))


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for null and for a URL without `://`."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row of pages: id, url, host, path, rule, pattern, verdict.

    The longest fitting host and path rule decides (rule: its text); else the fitting pattern rules do, a block before an
    allow (pattern: the longest of them); a URL that nothing fits is allowed. Rules without literals run on every URL.
    Null URLs have empty host and path. Repeated rows are judged each; other columns are ignored; no rules and no pages
    are fine.
    """
    n_rules = rules.count()
    small = F.broadcast if n_rules <= BROADCAST_RULES else lambda df: df
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("target", F.concat("host", "path"))
    # word patterns take upper-case letters for delimiters, other rules are filed under whole words in lower case
    tokens = F.array_union(F.split(F.lower("target"), "[^a-z0-9]+"), F.split("target", "[^a-z0-9]+"))  # an empty token stands for rules without literals
    tokenised = rows.withColumn("token", F.explode(F.array_union(tokens, F.array(F.lit("")))))

    listed = rules.select("pattern", F.explode("literals").alias("token"))
    counts = tokenised.select("token").join(small(listed.select("token").distinct()), "token").groupBy("token").count()
    rarest = listed.join(counts, "token", "left").groupBy("pattern").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"))
    index = rules.join(rarest, "pattern", "left").select("pattern", "action", "rule", F.coalesce("token", F.lit("")).alias("token"))

    fetched = tokenised.join(small(index), "token", "left")
    fits = F.expr("target RLIKE pattern")
    judged = fetched.groupBy("_row").agg(
        *[F.first(c).alias(c) for c in ("id", "url", "host", "path")],
        F.max(F.when((F.col("rule") != "") & fits, F.struct(F.length("rule").alias("length"), "rule", "action"))).alias("base"),
        F.max(F.when((F.col("rule") == "") & fits, F.struct((F.col("action") == "block").alias("blocks"), F.length("pattern").alias("length"), "pattern", "action"))).alias("own"),
    )
    return judged.select(
        "id", "url", "host", "path", F.col("base.rule").alias("rule"), F.when(F.col("base").isNull(), F.col("own.pattern")).alias("pattern"),
        F.coalesce("base.action", "own.action", F.lit("allow")).alias("verdict"),
    )


def op1_query(pages: DataFrame) -> DataFrame:
    judged = url_filter(pages, rule_table(pages.sparkSession, default_rules()))
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def _fits_sql(rule: str) -> str:
    host, path = rule[: rule.index("/")], rule[rule.index("/"):]
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


_BY_LENGTH = sorted(BASE_RULES, key=lambda r: -len(r[0]))
_OWN_SQL = " OR ".join(
    [rf"regexp_matches(host || path, '(^|[^a-z0-9]){w}([^a-z0-9]|$)')" for w in BLOCKED_WORDS] + [f"contains(host || path, '{p}')" for p in BLOCKED_PATHS]
)
OP1_SQL = f"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS host FROM a),
c AS (SELECT page_id, translate(host, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT *, CASE {" ".join(f"WHEN {_fits_sql(r)} THEN '{r}'" for r, _ in _BY_LENGTH)} END AS rule FROM c)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{r}' THEN '{a}'" for r, a in _BY_LENGTH)}
  WHEN {_OWN_SQL} THEN 'block' ELSE 'allow' END AS verdict FROM d
"""
