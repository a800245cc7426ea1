"""Toxicity by class-conditional Kneser-Ney character models.

Two models, toxic and ordinary, give a letter's probability after the letters before it in its
word, so that they know stems as well as words. Their counts differ on the longest n-grams only; all shorter ones are shared backoff
counts of both classes together. A count is discounted by ``SPREADS`` times its own spread (its
root) and by ``EXPECTED`` times what both classes together let expect: what chance or an uneven
mix of languages explains goes to the backoff, where both classes agree, so rare and ordinary
expressions cancel in the comparison. The score compares the length-normalised
logarithms of the likelihoods, calibrated on rows that the counts did not see.

The models are fitted on a sample of at most about ``SAMPLE_ROWS`` labelled rows per class, as
many of one class as of the other, drawn by a hash of the id; equal texts count once. The
counts are added up by Spark. Their tables are bounded by the sample and travel with the query.
Scoring reads each text once and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.llm.charlm import (
    alphabet_table,
    char_count_batches,
    fitting_order,
    gram_count_batches,
    hashed,
    kneser_ney,
    row_grams,
)
from pluvia.llm.common import query, remainder, stored, table
from pluvia.llm.textarrays import SortedHashes, bounded_batches, mixed, pieces

ORDER = 7
SAMPLE_ROWS = 2000
CALIBRATION_SHARE = 4  # one sampled row in so many calibrates
SPREADS = 2.0
#: Times the count that both classes together let expect.
EXPECTED = 1.25


@dataclass
class Model:
    """Log-likelihood ratios, toxic to ordinary.

    The shared backoff cancels: where neither class keeps any of an n-gram's count, the ratio
    is that of the two backoff weights of its context.
    """

    alphabet: np.ndarray
    grams: tuple[SortedHashes, np.ndarray]
    contexts: tuple[SortedHashes, np.ndarray]
    order: int = ORDER
    slope: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def ratios(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean log-likelihood ratio and number of characters of each row."""
        grams, at, _ = row_grams(data, offs, self.alphabet, self.order, in_word=True)
        n = np.diff(at)
        out = np.zeros(len(n))
        if not len(grams):
            return out, n
        place = self.grams[0].find(mixed(grams))
        ratio = self.grams[1][place]  # place -1 is the zero behind the end
        rest = np.flatnonzero(place < 0)
        bits = np.uint64(60 // self.order)
        ratio[rest] = self.contexts[1][self.contexts[0].find(mixed(grams[rest] >> bits))]
        full = np.flatnonzero(n)
        out[full] = np.add.reduceat(ratio, at[:-1][full]) / n[full]
        return out, n

    def scores(self, ratio: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Probability of the toxic label; texts without a letter get that of a ratio of zero."""
        a, b, c = self.slope
        z = a * ratio + b * ratio * np.sqrt(n) + c
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _ratio_table(keys: np.ndarray, ratio: np.ndarray) -> tuple[SortedHashes, np.ndarray]:
    where, values = hashed(keys, ratio)
    return where, np.append(values, 0.0)


def _model(counts: DataFrame, alphabet: np.ndarray, n_chars: int, order: int = ORDER) -> Model:
    """What comes to the driver is bounded by the sample: one row per n-gram and class."""
    rows = counts.groupBy("cls", "gram").agg(F.sum("n").alias("n")).toPandas().sort_values(["cls", "gram"])
    by_class = [rows[rows.cls == c] for c in (0, 1)]
    levels = kneser_ney(
        [(r.gram.to_numpy().view(np.uint64), r.n.to_numpy()) for r in by_class], order, n_chars, True, SPREADS, EXPECTED
    )
    grams, p, contexts, weight = [], [], [], []
    begins = alphabet[0x20]
    for k, level in enumerate(levels, 1):
        # Counted n-grams have full length or begin with the space before their word.
        own = level.mass.max(1) > 0 if k == order else (level.grams >> np.uint64(60 // order * (k - 1)) == begins) & (k > 1)
        grams.append(level.grams[own])
        p.append(np.log(level.p[own]))
        uneven = level.backoff[:, 0] != level.backoff[:, 1]
        contexts.append(level.contexts[uneven])
        weight.append(np.log(level.backoff[uneven]))
    p, weight = np.concatenate(p), np.concatenate(weight)
    return Model(
        alphabet, _ratio_table(np.concatenate(grams), p[:, 1] - p[:, 0]),
        _ratio_table(np.concatenate(contexts), weight[:, 1] - weight[:, 0]), order,
    )


def _ratio_batches(model: Model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in pieces(batches):
            ratio, n = model.ratios(data, offs)
            yield pa.RecordBatch.from_arrays(
                [rows.column("toxic"), pa.array(ratio), pa.array(n.astype(np.int64))], ["toxic", "ratio", "n"]
            )

    return run


def calibrate(toxic: np.ndarray, ratio: np.ndarray, n: np.ndarray, steps: int = 200) -> tuple[float, float, float]:
    """Logistic regression on the mean ratio and the mean ratio times root length, classes weighed alike."""
    if not len(toxic) or toxic.min() == toxic.max():
        return (0.0, 0.0, -1.0 if not len(toxic) or toxic.max() == 0 else 1.0)
    x = np.stack([ratio, ratio * np.sqrt(n), np.ones(len(n))], 1)
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    x = x / scale
    weight = np.where(toxic == 1, 0.5 / (toxic == 1).sum(), 0.5 / (toxic == 0).sum())
    beta = np.zeros(3)
    for _ in range(steps):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (p - toxic)) + 1e-5 * beta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-5 * np.eye(3)
        move = np.linalg.solve(hess, grad)
        beta -= move
        if np.abs(move).max() < 1e-8:
            break
    return tuple(beta / scale)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """About ``sample_rows`` texts per class ``toxic`` (0, 1) with a part for calibration."""
    known = labels.where(F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("long"))
    known = known.where(F.col("_id").isNotNull()).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    sizes = dict(known.groupBy("toxic").count().collect())
    draw = F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(1 << 30))
    rows = min(sample_rows, *(max(sizes.get(c, 0), 1) for c in (0, 1)))
    limit = [int(min(1.0, rows / max(sizes.get(c, 1), 1)) * (1 << 30)) for c in (0, 1)]
    drawn = known.where(draw < F.when(F.col("toxic") == 1, limit[1]).otherwise(limit[0]))
    drawn = drawn.withColumn("part", F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(CALIBRATION_SHARE)))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    # Short rows, about twice sample_rows of them whatever the size of the tables.
    found = texts.join(F.broadcast(drawn), "_id").select("text", "toxic", "part")
    return stored(found.groupBy(F.md5(F.col("text").cast("binary"))).agg(
        F.first("text").alias("text"), F.max("toxic").alias("toxic"), F.min("part").alias("part")
    ).select("text", "toxic", "part"))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Model of ``labels.toxic``. Rows without text or label are not used."""
    bounded_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, sample_rows)
    chars = sample.select("text").mapInArrow(char_count_batches, "c long, n long").groupBy("c").agg(F.sum("n").alias("n"))
    chars = [r.c for r in sorted(chars.collect(), key=lambda r: (-r.n, r.c))]
    order = fitting_order(len(chars), ORDER)
    alphabet = alphabet_table(np.array(chars, np.int64), order)
    grams = gram_count_batches(alphabet, order, "toxic", in_word=True)
    counts = sample.where("part > 0").mapInArrow(grams, "cls long, gram long, n long")
    model = _model(counts, alphabet, len(chars), order)
    unseen = sample.where("part = 0").mapInArrow(_ratio_batches(model), "toxic long, ratio double, n long").collect()
    toxic, ratio, n = (np.array(x, float) for x in zip(*unseen, strict=True)) if unseen else (np.zeros(0),) * 3
    model.slope = calibrate(toxic, ratio, n)
    return model


def _score_batches(model: Model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in pieces(batches):
            ratio, n = model.ratios(data, offs)
            score = model.scores(ratio, n)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted`` of every row.

    Null and empty texts have no token: their ratio is zero and their score the threshold of
    the calibration alone. Repeated rows are scored each; other columns are left out.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(_score_batches(model), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op7_toxicity")
def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = fit(docs, labels.where(~held_out))
    return score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")
