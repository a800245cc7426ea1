"""Quality rules as a short-circuit cascade, in built-in functions only.

Each rule is a condition that rejects a document. On a bounded sample every rule is timed, against
a rule that does nothing, and its rejections are noted; the cascade then takes, again and again, the rule with the most
rejections among the documents still standing per second of its cost. The whole table goes
through one ``CASE``: a rule is evaluated only for documents that no earlier rule rejected.
The order decides what is computed, never what is kept. Nothing is shuffled.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.llm.common import SPACES, let, query, stored, table, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
SAMPLE_ROWS = 2000
#: How often a rule is evaluated on every row of the sample when it is timed.
COPIES = 16


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a SQL condition on the columns of ``base_columns``; null does not reject.

    ``per_row`` counts letters and the like straight from the text where that is needed.
    """

    name: str
    rejects: str


def _stripped(chars: str) -> str:
    return f"length(regexp_replace(text, '{chars}', ''))"


#: The thresholds are wide: prose of any language passes, markup, shouting and lists do not.
RULES = (
    Rule("symbols", "10 * n_symbols > word_chars"),
    Rule("repeated_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    Rule("short_words", "2 * word_chars < 3 * n_words"),
    Rule("long_words", "word_chars > 40 * n_words"),
    Rule("exclamations", f"2 * (length(text) - {_stripped('!')}) > n_words"),
    Rule("capitals", f"10 * (length(text) - {_stripped('[A-Z]')}) > 7 * word_chars"),
    Rule("digits", f"10 * (length(text) - {_stripped('[0-9]')}) > 4 * word_chars"),
    Rule("few_letters", f"2 * {_stripped('[^\\\\p{L}]+')} < word_chars"),
)


def repeated_window_words(ws: Column, k: int = WINDOW) -> Column:
    """Words that lie in a ``k``-word window found twice or more in ``ws``.

    Hashes of the windows clear most texts; where two are equal, the windows themselves are
    sorted and compared, so the count is exact. Work and memory are those of one text.
    """

    def window(i: Column) -> Column:
        return F.slice(ws, i, F.lit(k))

    starts = F.sequence(F.lit(1), F.size(ws) - (k - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(window(i)))
    keyed = F.sort_array(
        F.transform(starts, lambda i: F.struct(F.array_join(window(i), " ").alias("w"), i.alias("i")))
    )

    def repeated(s: Column) -> Column:
        def key(j: Column) -> Column:
            return F.get(s, j)["w"]

        same = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda j: F.coalesce(key(j) == key(j - 1), F.lit(False))
            | F.coalesce(key(j) == key(j + 1), F.lit(False)),
        )
        return F.sort_array(F.transform(same, lambda j: F.get(s, j)["i"]))

    def covered(positions: Column) -> Column:
        zero = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("total"))
        return F.aggregate(
            positions, zero,
            lambda a, p: F.struct(
                (p + k).alias("upto"), (a["total"] + k - F.greatest(F.lit(0), a["upto"] - p)).alias("total")
            ),
            lambda a: a["total"],
        )

    exact = covered(let(keyed, repeated))
    n = F.size(ws)
    return (
        F.when(n <= k, F.lit(0).cast("long"))
        .when(F.size(F.array_distinct(hashes)) == n - (k - 1), F.lit(0).cast("long"))
        .otherwise(exact)
    )


def base_columns(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and the counts the rules work on; a null text counts as empty."""
    blank = " " * len(SPACES)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    split = rows.select(
        "doc_id", "text", words(F.col("text")).alias("_words"),
        F.filter(
            F.split("text", "\n"), lambda x: F.length(F.trim(F.translate(x, SPACES, blank))) > 0
        ).alias("_lines"),
    )
    text = F.col("text")
    return split.select(
        "doc_id", "text",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("_words")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def measure_rules(
    base: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS
) -> tuple[list[float], list[tuple[int, int]]]:
    """Seconds of each rule on a sample, and how many of its rows share each set of rejections.

    All copies of the sample go through a rule in one task of one job; what the same job takes with a
    rule that is just false (starting, reading, counting) is taken off.

    The sample holds about ``sample_rows`` rows, chosen by a hash of the id, whatever the size
    of the table. A set is a bit mask over ``rules``.
    """
    total = base.sparkSession.range(0).count() if not rules else base.select("doc_id").count()
    share = min(1.0, sample_rows / max(total, 1))
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 30))
    sample = stored(base.where(draw < int(share * (1 << 30))).limit(2 * sample_rows))
    copies = sample.coalesce(1).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES))))

    def seconds_of(rejects: str) -> float:
        hit = copies.agg(F.count_if(F.expr(rejects)))
        took = []
        for _ in range(3):
            began = time.perf_counter()
            hit.collect()
            took.append(time.perf_counter() - began)
        return min(took)

    nothing = seconds_of("doc_id IS NULL AND doc_id IS NOT NULL") if rules else 0.0
    seconds = [max(seconds_of(rule.rejects) - nothing, 1e-4) / COPIES for rule in rules]
    flags = [F.coalesce(F.expr(r.rejects), F.lit(False)).cast("long") * (1 << k) for k, r in enumerate(rules)]
    mask = sum(flags[1:], flags[0]).alias("mask")
    return seconds, [tuple(r) for r in sample.select(mask).groupBy("mask").count().collect()]


def cascade_order(seconds: Sequence[float], masks: Sequence[tuple[int, int]]) -> list[int]:
    """Rule numbers: next comes the rule with most rejections per second among the rest."""
    left, standing, order = list(range(len(seconds))), list(masks), []
    while left:
        def worth(k: int) -> float:
            return sum(n for m, n in standing if m >> k & 1) / max(seconds[k], 1e-9)

        best = max(left, key=lambda k: (worth(k), -seconds[k], -k))
        order.append(best)
        left.remove(best)
        standing = [(m, n) for m, n in standing if not m >> best & 1]
    return order


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: ``doc_id``, the counts, ``base_failed``, ``kept``.

    Empty and null texts have no words and so fail. Repeated ids are judged each, an empty
    table gives an empty result, other columns are left out.
    """
    base = base_columns(docs).withColumn("base_failed", base_failed())
    verdict = F.when(F.col("base_failed"), False)
    if rules:
        light = base_columns_cheap(docs)
        for k in cascade_order(*measure_rules(light, rules, sample_rows)):
            verdict = verdict.when(F.expr(rules[k].rejects), False)
    return base.withColumn("kept", verdict.otherwise(True)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def base_columns_cheap(docs: DataFrame) -> DataFrame:
    """The counts without the repeated windows, which no rule of the cascade uses."""
    return base_columns(docs).drop("n_repeat_words")


def _sql() -> str:
    rejects = " OR ".join(f"({r.rejects})" for r in RULES)
    rejects = rejects.replace("'')", "'', 'g')").replace("\\\\p", "\\p")
    ws = r"[^\x20\x09-\x0D]+"
    return rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '{ws}') AS ws,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{ws}')) AS ls FROM t),
    g AS (SELECT doc_id, i, list_aggregate(ws[i : i + 4], 'string_agg', ' ') AS win
      FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w WHERE len(ws) >= 5)),
    r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
    c AS (SELECT doc_id, count(DISTINCT p) AS n FROM
      (SELECT doc_id, unnest(generate_series(i, i + 4)) AS p FROM r) GROUP BY 1),
    b AS (SELECT w.doc_id, text, CAST(len(ws) AS BIGINT) AS n_words,
      CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
      CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN c USING (doc_id)),
    f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND NOT ({rejects}) AS kept FROM f"""


@query("op1_quality_rules", _sql())
def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
