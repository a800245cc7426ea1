"""URL filter: pattern rules indexed by their rarest literal token.

Every rule states the literal tokens that any URL it fits must contain. The rule is filed
under the token that occurs in the fewest URLs. The tokens of a URL then fetch its candidate
rules from this index, and only the candidates' regular expressions run.

The rules are configuration: at most ``MAX_RULES``, part of the plan. The table is read twice
(token counts, verdicts), each time the URL column alone, and nothing is shuffled but one
count per token and task. All of it is JVM-side.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.llm.common import query, table

MAX_RULES = 5000


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in ``target``: ``site`` (host and path) or ``url``.

    ``tokens`` are lower-case alphanumeric runs that every URL that fits contains as whole
    runs. Of the rules that fit, the one with the largest ``weight`` wins, then the first.
    """

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    weight: int
    target: str = "site"


def site_rule(action: str, host: str, path: str) -> Rule:
    """A rule for a host with its subdomains and a path prefix; longer rules weigh more."""
    whole = [t for part in host.split(".") for t in [part.lower()] if re.fullmatch("[a-z0-9]+", t)]
    # The last run of the prefix may go on in a longer path, so it is no token of its own.
    runs = re.findall("[a-z0-9]+(?=[^A-Za-z0-9])", path) if path.lower() == path else []
    pattern = f"^(?:[^/]*\\.)?{_quoted(host)}{_quoted(path)}"
    return Rule(host + path, action, pattern, tuple(dict.fromkeys([*whole, *runs])), len(host + path))


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", text)


#: Host and path rules that decide before anything else.
SITE_RULES = (
    site_rule("allow", "org", "/"),
    site_rule("block", "example.org", "/es/"),
    site_rule("block", "example.org", "/en/1"),
    site_rule("allow", "com", "/fr/"),
    site_rule("block", "com", "/de/"),
)

#: What the method blocks elsewhere: further pages of a listing, session and shop pages.
PATTERN_RULES = (
    Rule("page", "block", r"[?&][pP]age=[0-9]+(?:[&#]|$)", ("page",), 2, "url"),
    Rule("login", "block", r"/(?i:login)(?:[/.]|$)", ("login",), 1),
    Rule("signup", "block", r"/(?i:signup)(?:[/.]|$)", ("signup",), 1),
    Rule("cart", "block", r"/(?i:cart)(?:[/.]|$)", ("cart",), 1),
    Rule("session", "block", r"[?&](?i:sessionid)=", ("sessionid",), 1, "url"),
    Rule("feed", "block", r"/(?i:feed)(?:\.xml|/)?$", ("feed",), 1),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or a text without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    before_query = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^?#]*)", 1)
    host = F.substring_index(before_query, "/", 1)
    path = F.substring(before_query, F.length(host) + 1, F.length(before_query))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def url_tokens(url: Column) -> Column:
    """Distinct lower-case alphanumeric runs (ASCII) of a URL."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = F.translate(F.coalesce(url, F.lit("")), upper, upper.lower())
    return F.array_remove(F.array_distinct(F.split(low, "[^a-z0-9]+")), "")


def token_counts(urls: DataFrame, col: str, tokens: Sequence[str]) -> dict[str, int]:
    """In how many URLs each of the rules' tokens occurs: one row per token is returned."""
    known = F.array(*[F.lit(t) for t in tokens])
    found = F.explode(F.array_intersect(url_tokens(F.col(col)), known)).alias("t")
    counts = dict.fromkeys(tokens, 0)
    counts.update(urls.select(found).groupBy("t").count().collect())
    return counts


def rarest_token_index(rules: Sequence[Rule], counts: dict[str, int]) -> dict[str, list[int]]:
    """Rule numbers by their rarest token; rules without a token come under ``""``."""
    index: dict[str, list[int]] = {}
    for k, rule in enumerate(rules):
        index.setdefault(min(rule.tokens, key=lambda t: (counts[t], t), default=""), []).append(k)
    return index


def match_rules(urls: DataFrame, rules: Sequence[Rule], col: str = "url") -> Column:
    """Column of the winning rule, ``struct<name, action>``, null where no rule fits."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the plan holds at most {MAX_RULES}")
    if not rules:
        return F.lit(None).cast("struct<name:string,action:string>")
    tokens = sorted({t for r in rules for t in r.tokens})
    index = rarest_token_index(rules, token_counts(urls, col, tokens) if tokens else {})
    host, path = host_and_path(F.col(col))
    targets = {"site": F.concat(host, path), "url": F.coalesce(F.col(col), F.lit(""))}

    def entry(k: int) -> Column:
        r = rules[k]
        return F.struct(
            F.lit(r.weight).alias("weight"), F.lit(-k).alias("nth"), F.lit(r.name).alias("name"),
            F.lit(r.action).alias("action"), F.lit(r.pattern).alias("pattern"),
            F.lit(r.target).alias("target"),
        )

    filed = F.create_map(
        *[x for t, ks in index.items() for x in (F.lit(t), F.array(*[entry(k) for k in ks]))]
    )
    asked = F.concat(url_tokens(F.col(col)), F.array(F.lit("")))
    hits = F.filter(asked, lambda t: F.array_contains(F.array(*[F.lit(t) for t in index]), t))
    candidates = F.flatten(F.transform(hits, lambda t: F.element_at(filed, t)))
    fitting = F.filter(
        candidates,
        lambda r: F.when(r["target"] == "url", F.regexp(targets["url"], r["pattern"])).otherwise(
            F.regexp(targets["site"], r["pattern"])
        ),
    )
    best = F.array_max(fitting)
    return F.when(best.isNotNull(), F.struct(best["name"].alias("name"), best["action"].alias("action")))


def filter_urls(
    pages: DataFrame,
    site_rules: Sequence[Rule] = SITE_RULES,
    pattern_rules: Sequence[Rule] = PATTERN_RULES,
    col: str = "url",
    key: str = "page_id",
) -> DataFrame:
    """One row per input row: ``key, host, path, rule, verdict, pattern_rule``.

    ``site_rules`` decide first, then ``pattern_rules``; a URL that no rule fits is allowed.
    A null URL or one without ``://`` has an empty host and path, fits no site rule and is
    allowed unless a pattern fits. Repeated rows are judged each, other columns are left out.
    """
    rows = pages.select(F.col(key).alias(key), F.col(col).cast("string").alias("_url"))
    host, path = host_and_path(F.col("_url"))
    site = match_rules(rows, site_rules, "_url")
    other = match_rules(rows, pattern_rules, "_url")
    judged = rows.select(
        key, host.alias("host"), path.alias("path"), site.alias("_site"), other.alias("_other")
    )
    return judged.select(
        key, "host", "path", F.col("_site.name").alias("rule"),
        F.coalesce("_site.action", "_other.action", F.lit("allow")).alias("verdict"),
        F.when(F.col("_site").isNull(), F.col("_other.name")).alias("pattern_rule"),
    )


def _sql() -> str:
    def arm(r: Rule) -> str:
        subject = "url" if r.target == "url" else "host || path"
        return f"regexp_matches({subject}, '{r.pattern}')"

    # One arm per rule, the heaviest first.
    def ranked(rules: Sequence[Rule]) -> list[Rule]:
        return sorted(rules, key=lambda r: -r.weight)

    site = " ".join(f"WHEN {arm(r)} THEN '{r.name}'" for r in ranked(SITE_RULES))
    act = " ".join(f"WHEN '{r.name}' THEN '{r.action}'" for r in SITE_RULES)
    pat = " ".join(f"WHEN {arm(r)} THEN '{r.name}'" for r in ranked(PATTERN_RULES))
    return f"""WITH u AS (SELECT page_id, coalesce(url, '') AS url, regexp_extract(
        CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END,
        '^([^?#]*)', 1) AS site FROM pages),
    h AS (SELECT page_id, url, translate(split_part(coalesce(site, ''), '/', 1),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        substr(coalesce(site, ''), length(split_part(coalesce(site, ''), '/', 1)) + 1) AS path FROM u),
    m AS (SELECT *, CASE {site} END AS rule, CASE {pat} END AS other FROM h)
    SELECT page_id, host, path, rule,
      CASE WHEN rule IS NOT NULL THEN CASE rule {act} END
           WHEN other IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
      CASE WHEN rule IS NULL THEN other END AS pattern_rule FROM m"""


@query("op9_url_filter", _sql())
def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
