"""Mix sources to target weights by hierarchical budgeting, in built-in functions only.

Weights go down a tree (domain, language, source). At every level the budget of a parent is
shared among its children in proportion to their weights; a child that cannot use its share
(its subtree holds fewer tokens) takes all it has, and the shortage goes to its siblings.
As the limits of whole subtrees are known on every level, only what no sibling can take
reaches the siblings of the ancestors.

A leaf then spends its budget in epochs. A whole epoch takes every document once; the last,
partial epoch orders the documents by a seeded hash and takes the prefix that the budget
still holds. The prefix is found without sorting a leaf: token sums of 4096 hash ranges per
leaf locate the range where the budget ends, and only that range's documents are sorted. So a
leaf with a third of all rows is spread over all tasks until 1/4096 of it is left.

All arithmetic is on integers, so results do not depend on the order of summation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pluvia.llm.common import query, stored, table, words

#: Tree of the ``documents`` table; the domain is a group of sources (see ``domain_of``).
LEVELS = ("domain", "lang", "source")
#: Relative weights by level and name; names that are not listed weigh ``DEFAULT_WEIGHT``.
WEIGHTS: Mapping[str, Mapping[str, int]] = {
    "domain": {"d0": 5, "d1": 3, "d2": 2},
    "lang": {"en": 4, "de": 2, "fr": 2, "es": 2},
}
DEFAULT_WEIGHT = 1
#: The mixture holds this many percent of the tokens of the input.
BUDGET_PERCENT = 80
MAX_EPOCHS = 2
SEED = 17
RANGE_DIGITS = 3  # hash ranges per leaf: 16 ** 3


def domain_of(source: Column) -> Column:
    """Domain of a source: its trailing number modulo three; ``other`` without a number."""
    digits = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(digits == "", "other").otherwise(
        F.concat(F.lit("d"), F.pmod(digits.try_cast("int"), F.lit(3)).cast("string"))
    )


def leaf_columns(docs: DataFrame) -> DataFrame:
    """``doc_id, domain, lang, source, n_tokens``; null names count as the name ``""``."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(
        "doc_id", domain_of(F.col("source").cast("string")).alias("domain"), name("lang").alias("lang"),
        name("source").alias("source"), F.size(words(F.col("text"))).cast("long").alias("n_tokens"),
    )


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    own = weights.get(level, {})
    if not own:
        return F.lit(DEFAULT_WEIGHT).cast("long")
    listed = F.create_map(*[F.lit(x) for pair in own.items() for x in pair])
    return F.coalesce(F.try_element_at(listed, F.col(level)), F.lit(DEFAULT_WEIGHT)).cast("long")


def share_budget(nodes: DataFrame, parents: Sequence[str], level: str) -> DataFrame:
    """Adds ``budget`` to children that carry ``weight``, ``cap`` and ``parent_budget``.

    In the order of cap per weight the children that the common rate fills form a prefix:
    a child is full if ``cap * (weights from here on) <= weight * (budget left before it)``.
    """
    group = Window.partitionBy(*parents)
    order = group.orderBy((F.col("cap") / F.col("weight")), level)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onwards = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    left = F.col("parent_budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    full = wide("cap") * F.sum("weight").over(onwards).cast("decimal(19,0)") <= wide("weight") * left.cast(
        "decimal(19,0)"
    )
    ranked = nodes.withColumn("_full", full)
    # Rounding of the ratio may swap equal children, so the prefix is taken up to its first gap.
    ranked = ranked.withColumn("_full", F.bool_and("_full").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    taken = F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(group)
    rest = F.sum(F.when(~F.col("_full"), F.col("weight")).otherwise(0)).over(group)
    share = F.expr(
        "CAST((CAST(weight AS DECIMAL(19,0)) * CAST(parent_budget - _taken AS DECIMAL(19,0)))"
        " DIV greatest(_rest, 1) AS BIGINT)"
    )
    return (
        ranked.withColumn("_taken", taken).withColumn("_rest", rest)
        .withColumn("budget", F.when(F.col("_full"), F.col("cap")).otherwise(F.least(share, F.col("cap"))))
        .drop("_full", "_taken", "_rest", "weight", "cap", "parent_budget")
    )


def leaf_budgets(
    leaves: DataFrame,
    levels: Sequence[str] = LEVELS,
    weights: Mapping[str, Mapping[str, int]] = WEIGHTS,
    budget_percent: int = BUDGET_PERCENT,
    max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """Token budget of every leaf: ``levels, tokens, budget``. ``leaves`` has ``levels, tokens``."""
    top = leaves.agg(F.sum("tokens").alias("tokens"))
    whole = F.expr(f"coalesce(tokens, 0) * {int(budget_percent)} DIV 100")
    # A child can hold max_epochs times its tokens; the root no more than all of them together.
    parent = top.select(F.least(whole, F.col("tokens") * max_epochs).alias("parent_budget"))
    path: list[str] = []
    for level in levels:
        nodes = leaves.groupBy(*path, level).agg((F.sum("tokens") * max_epochs).alias("cap"))
        nodes = nodes.withColumn("weight", _weight(level, weights))
        # The parents are one row each; the first level has a single parent row.
        nodes = nodes.join(parent, path) if path else nodes.join(F.broadcast(parent), F.lit(True))
        path.append(level)
        parent = share_budget(nodes, path[:-1], level).withColumnRenamed("budget", "parent_budget")
    return leaves.join(parent.withColumnRenamed("parent_budget", "budget"), list(levels))


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Place of a document in an epoch: hexadecimal digest of seed, epoch and id."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.md5(text.cast("binary"))


def epoch_cutoffs(slim: DataFrame, budgets: DataFrame, levels: Sequence[str], seed: int) -> DataFrame:
    """Per leaf: ``whole`` epochs and ``cutoff``, the last order key of the partial epoch.

    Documents with equal keys (repeated ids) are in or out together.
    """
    keys = list(levels)
    plan = budgets.select(
        *keys,
        F.expr("CASE WHEN tokens > 0 THEN budget DIV tokens ELSE 0 END").alias("whole"),
        F.expr("CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END").alias("rest"),
    )
    placed = slim.join(plan, keys).withColumn("_key", order_key(seed, F.col("whole"), F.col("doc_id")))
    placed = placed.withColumn("_range", F.substring("_key", 1, RANGE_DIGITS))
    sums = placed.groupBy(*keys, "rest", "_range").agg(F.sum("n_tokens").alias("_n"))
    running = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range"))
    ends = sums.withColumn("_upto", running).where(F.col("_upto") > F.col("rest"))
    ends = ends.groupBy(*keys).agg(
        F.min("_range").alias("_range"), F.min(F.struct("_range", F.expr("_upto - _n")))["col2"].alias("_before")
    )
    last = placed.join(ends, [*keys, "_range"])
    upto = F.col("_before") + F.sum("n_tokens").over(Window.partitionBy(*keys).orderBy("_key"))
    fitting = last.withColumn("_upto", upto).groupBy(*keys, "_range").agg(
        F.max(F.when(F.col("_upto") <= F.col("rest"), F.col("_key"))).alias("_last")
    )
    # No fitting key in the range: all ranges before it. No such range: the whole leaf.
    cut = F.coalesce("_last", "_range", F.lit("g")).alias("cutoff")
    return plan.join(fitting, keys, "left").select(*keys, "whole", cut)


def epochs_of(docs: DataFrame, cutoffs: DataFrame, levels: Sequence[str], seed: int) -> DataFrame:
    """Adds ``epochs``, how many times the mixture takes each row."""
    placed = docs.join(cutoffs, list(levels))
    inside = order_key(seed, F.col("whole"), F.col("doc_id")) <= F.col("cutoff")
    return placed.withColumn("epochs", F.col("whole") + inside.cast("long")).drop("whole", "cutoff")


def mix(
    docs: DataFrame,
    weights: Mapping[str, Mapping[str, int]] = WEIGHTS,
    budget_percent: int = BUDGET_PERCENT,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: ``doc_id, domain, lang, source, n_tokens, epochs``.

    Tokens are words. Null texts have none and cost nothing, so they come with the prefix.
    Repeated ids share their place in the order; null ids are one such id. An empty table
    gives an empty result, other columns are left out.
    """
    slim = stored(leaf_columns(docs))
    return epochs_of(slim, cutoffs_of(slim, weights, budget_percent, max_epochs, seed), LEVELS, seed)


def cutoffs_of(slim: DataFrame, weights, budget_percent: int, max_epochs: int, seed: int) -> DataFrame:
    """Budgets, whole epochs and cutoffs of all leaves, stored: one row per leaf."""
    leaves = stored(slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")))
    budgets = stored(leaf_budgets(leaves, LEVELS, weights, budget_percent, max_epochs))
    return stored(epoch_cutoffs(slim, budgets, LEVELS, seed))


def select_documents(
    docs: DataFrame,
    weights: Mapping[str, Mapping[str, int]] = WEIGHTS,
    budget_percent: int = BUDGET_PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """The rows of ``docs`` that a mixture of at most one epoch takes, with their columns."""
    slim = stored(leaf_columns(docs))
    cut = cutoffs_of(slim, weights, budget_percent, 1, seed)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cut = cut.select(*[F.col(c).alias(f"_mix_{c}") for c in cut.columns])
    on = (
        (domain_of(F.col("source").cast("string")) == F.col("_mix_domain"))
        & (name("lang") == F.col("_mix_lang"))
        & (name("source") == F.col("_mix_source"))
    )
    # A whole epoch takes all of a leaf; else the order key decides.
    inside = order_key(seed, F.col("_mix_whole"), F.col("doc_id")) <= F.col("_mix_cutoff")
    return docs.join(cut, on).where((F.col("_mix_whole") >= 1) | inside).select(*docs.columns)


def _weight_sql(level: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.get(level, {}).items())
    return f"CASE {level} {arms} ELSE {DEFAULT_WEIGHT} END" if arms else str(DEFAULT_WEIGHT)


def mixing_sql(docs: str = "documents", percent: int = BUDGET_PERCENT, epochs: int = MAX_EPOCHS) -> str:
    """The budgets of all leaves and the epochs of all documents as common table expressions."""
    parts, path, parent = [], [], "l0"
    for k, level in enumerate(LEVELS, 1):
        by = f"PARTITION BY {', '.join(path)}" if path else ""
        on = f"JOIN {parent} USING ({', '.join(path)})" if path else f"CROSS JOIN {parent}"
        cols = ", ".join([*path, level])
        parts.append(
            f"""c{k} AS (SELECT {cols}, cap, w, budget AS b FROM (SELECT {cols},
          CAST(sum(tokens) * {epochs} AS HUGEINT) AS cap, CAST({_weight_sql(level)} AS HUGEINT) AS w
          FROM leaves GROUP BY {cols}) {on}),
        f{k} AS (SELECT *, cap * sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
          <= w * (b - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS hit
          FROM c{k} WINDOW o AS ({by} ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), {level})),
        g{k} AS (SELECT *, bool_and(hit) OVER ({by} ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), {level}
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM f{k}),
        l{k} AS (SELECT {cols}, CASE WHEN filled THEN cap ELSE least(cap,
          w * (b - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ({by}))
          // greatest(1, sum(CASE WHEN filled THEN 0 ELSE w END) OVER ({by}))) END AS budget FROM g{k})"""
        )
        path.append(level)
        parent = f"l{k}"
    keys = ", ".join(LEVELS)
    return f"""slim AS (SELECT doc_id, CASE WHEN regexp_matches(coalesce(source, ''), '[0-9]{{1,9}}$')
          THEN 'd' || CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INT) % 3 ELSE 'other' END AS domain,
          coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(coalesce(len(
          regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens FROM {docs}),
        leaves AS (SELECT {keys}, sum(n_tokens) AS tokens FROM slim GROUP BY {keys}),
        l0 AS (SELECT least(sum(tokens) * {percent} // 100, sum(tokens) * {epochs}) AS budget FROM leaves),
        {", ".join(parts)},
        plan AS (SELECT {keys}, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole,
          CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM leaves JOIN l{len(LEVELS)} USING ({keys})),
        placed AS (SELECT *, md5('{SEED}:' || CAST(whole AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null'))
          AS k FROM slim JOIN plan USING ({keys})),
        mixed AS (SELECT *, CAST(whole + CASE WHEN sum(n_tokens) OVER (PARTITION BY {keys} ORDER BY k) <= rest
          THEN 1 ELSE 0 END AS BIGINT) AS epochs FROM placed)"""


@query(
    "op10_mixing",
    f"WITH {mixing_sql()} SELECT doc_id, domain, lang, source, n_tokens, epochs FROM mixed",
)
def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "domain", "lang", "source", "n_tokens", "epochs"
    )
