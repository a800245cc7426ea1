"""Language identification by interpolated Kneser-Ney character models.

One model per language, fitted on a sample of about ``SAMPLE_ROWS`` rows per language, drawn by
a hash of the id; Spark adds up the counts. All languages share sorted hash arrays of n-grams
and contexts, with one column of log probabilities per language, so a position is looked up
once. The language with the lowest cross-entropy per character is chosen. Its cross-entropy is
compared with that of sampled rows of the language which the counts did not see, and of their
beginnings, at the same length: a text far above their median is rejected. Medians decide both
the middle and the spread, so that junk among these rows does not. Scoring reads each text once
and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.llm.charlm import (
    alphabet_table,
    fitting_order,
    char_count_batches,
    gram_count_batches,
    hashed,
    kneser_ney,
    row_grams,
)
from pluvia.llm.common import query, remainder, stored, table
from pluvia.llm.textarrays import PIECE_BYTES, bounded_batches, mixed, pieces

ORDER = 4
SAMPLE_ROWS = 400
CALIBRATION_SHARE = 4  # one sampled row in so many calibrates
#: A text is rejected so many robust standard deviations (by the median absolute deviation) above
#: texts of its language and length.
REJECT_AT = 8.0
#: Least spread, in bits per character.
LEAST_SPREAD = 0.05
#: Characters from which a length class begins, a factor of two apart.
LENGTHS = 2 ** np.arange(2, 14)
#: Texts of a length class that a language needs for a limit of its own.
LEAST_TEXTS = 8
UNDETERMINED = "und"


@dataclass
class Model:
    languages: list[str]
    alphabet: np.ndarray
    order: int
    grams: list = field(default_factory=list)  # per order: sorted hashes, log2 probabilities
    contexts: list = field(default_factory=list)  # per order: sorted hashes, log2 weights
    floor: float = 0.0
    limits: np.ndarray | None = None  # per language and length class: most bits per character
    sharpness: float = 10.0

    def cross_entropies(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits per character of each row under each language, number of characters, letters."""
        grams, at, has = row_grams(data, offs, self.alphabet, self.order)
        n, wide = np.diff(at), len(self.languages)
        total = np.zeros((len(grams), wide), np.float32)
        todo = np.arange(len(grams))
        left, bits = grams, 60 // self.order
        for k in range(self.order, 0, -1):
            keys, values = self.grams[k - 1]
            place = keys.find(mixed(left))
            hit = place >= 0
            total[todo[hit]] += values[place[hit]]
            todo, left = todo[~hit], left[~hit]
            if not len(todo):
                break
            keys, values = self.contexts[k - 1]
            place = keys.find(mixed(left >> np.uint64(bits)))
            hit = place >= 0
            total[todo[hit]] += values[place[hit]]
            left = left & np.uint64((1 << (bits * (k - 1))) - 1)
        total[todo] += self.floor
        out = np.zeros((len(n), wide))
        full = np.flatnonzero(n)
        if len(full):
            out[full] = -np.add.reduceat(total, at[:-1][full], axis=0, dtype=np.float64) / n[full][:, None]
        return out, n, has

    def judge(self, data, offs) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of the best language (-1: none), its share, its cross-entropy, rejection."""
        if not self.languages:
            n = len(offs) - 1
            return np.full(n, -1), np.zeros(n), np.zeros(n), np.ones(n, bool)
        h, n, has = self.cross_entropies(data, offs)
        best = h.argmin(1)
        low = h[np.arange(len(h)), best]
        share = 1 / np.exp2(-self.sharpness * (h - low[:, None])).sum(1)
        above = low > self.limits[best, length_class(n)]
        return np.where(has, best, -1), np.where(has, share, 0.0), low, above | ~has


def length_class(n: np.ndarray) -> np.ndarray:
    return np.maximum(np.searchsorted(LENGTHS, n, "right") - 1, 0)


def _piece_limit(n_languages: int) -> int:
    return max(1, PIECE_BYTES * 8 // max(8, n_languages))


def _entropy_batches(model: Model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in pieces(batches, limit=_piece_limit(len(model.languages))):
            h, n, _ = model.cross_entropies(data, offs)
            yield pa.RecordBatch.from_arrays(
                [rows.column("cls"), rows.column("whole"), pa.array(h.tolist(), pa.list_(pa.float64())),
                 pa.array(n.astype(np.int64))], ["cls", "whole", "h", "n"],
            )

    return run


def robust_limit(h: np.ndarray) -> float:
    """``REJECT_AT`` spreads above the median; less than half of ``h`` may be anything."""
    middle = np.median(h)
    return float(middle + REJECT_AT * max(1.4826 * np.median(np.abs(h - middle)), LEAST_SPREAD))


def _limits(model: Model, cls: np.ndarray, own: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Limits from the bits per character of unseen texts under their own language.

    Where a language has too few texts of a length, its next shorter class counts for them, else
    the next longer. Languages that have too few of every length share the limits of all their
    texts together, or the widest of the others; without any text the cost of characters drawn
    evenly from the alphabet is the limit.
    """
    wide, kinds = len(model.languages), length_class(n)

    def of(chosen: np.ndarray) -> np.ndarray:
        out = np.full(len(LENGTHS), np.nan)
        for k in range(len(LENGTHS)):
            here = own[chosen & (kinds == k)]
            if len(here) >= LEAST_TEXTS:
                out[k] = robust_limit(here)
        known = np.flatnonzero(~np.isnan(out))
        if len(known):
            out = out[known[np.maximum(np.searchsorted(known, np.arange(len(out)), "right") - 1, 0)]]
        return out

    limits = np.array([of(cls == c) for c in range(wide)])
    few = np.isnan(limits[:, 0])
    if few.any():
        shared = of(np.isin(cls, np.flatnonzero(few)))
        if np.isnan(shared[0]):
            shared = limits[~few].max(0) if not few.all() else np.full(len(LENGTHS), -model.floor)
        limits[few] = shared
    return limits


def _calibrated(model: Model, cls: np.ndarray, whole: np.ndarray, h: np.ndarray, n: np.ndarray) -> None:
    """Sets the limits of every language and the sharpness of the shares."""
    lettered = n > 0
    cls, whole, h, n = cls[lettered], whole[lettered], h[lettered], n[lettered]
    model.limits = _limits(model, cls, h[np.arange(len(h)), cls], n)
    cls, h = cls[whole], h[whole]
    if len(h) and len(model.languages) > 1:
        def loss(s: float) -> float:
            z = -s * (h - h.min(1, keepdims=True))
            return float(np.mean(np.log2(np.exp2(z).sum(1)) - z[np.arange(len(h)), cls]))

        model.sharpness = min((1.0, 2.0, 5.0, 10.0, 20.0, 50.0), key=loss)


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, order: int = ORDER) -> Model:
    """Model of ``lang`` from ``text``; rows where either is null are not used."""
    bounded_batches(docs.sparkSession)
    known = docs.select(
        F.col("doc_id").cast("string").alias("_id"), F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
    ).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = dict(known.groupBy("lang").count().collect())
    languages = sorted(sizes)
    if not languages:
        return Model([], alphabet_table(np.zeros(0, np.int64), order), order)
    shares = F.create_map(*[
        F.lit(x) for k in languages for x in (k, int(min(1.0, sample_rows / sizes[k]) * (1 << 30)))
    ])
    numbers = F.create_map(*[F.lit(x) for c, k in enumerate(languages) for x in (k, c)])
    key = F.coalesce("_id", F.lit(""))
    drawn = known.where(F.pmod(F.xxhash64(key, F.lit(3)), F.lit(1 << 30)) < shares[F.col("lang")])
    sample = stored(drawn.select(
        "text", numbers[F.col("lang")].cast("long").alias("cls"),
        F.pmod(F.xxhash64(key, F.lit(5)), F.lit(CALIBRATION_SHARE)).alias("part"),
    ))
    chars = sample.select("text").mapInArrow(char_count_batches, "c long, n long").groupBy("c").agg(F.sum("n").alias("n"))
    chars = [r.c for r in sorted(chars.collect(), key=lambda r: (-r.n, r.c))]
    order = fitting_order(len(chars), order)
    alphabet = alphabet_table(np.array(chars, np.int64), order)
    counts = sample.where("part > 0").mapInArrow(gram_count_batches(alphabet, order, "cls"), "cls long, gram long, n long")
    rows = counts.groupBy("cls", "gram").agg(F.sum("n").alias("n")).toPandas().sort_values(["cls", "gram"])
    by_class = [rows[rows.cls == c] for c in range(len(languages))]
    levels = kneser_ney([(r.gram.to_numpy().view(np.uint64), r.n.to_numpy()) for r in by_class], order, len(chars))
    model = Model(languages, alphabet, order, floor=float(-np.log2(len(chars) + 1)))
    for level in levels:
        model.grams.append(_logs(level.grams, level.p))
        model.contexts.append(_logs(level.contexts, level.backoff))
    size = F.array(*[F.lit(int(x)) for x in LENGTHS], F.length("text"))
    unseen = sample.where("part = 0").select("text", "cls", F.explode(F.array_distinct(size)).alias("_size"))
    unseen = unseen.where(F.col("_size") <= F.length("text")).select(
        F.expr("left(text, _size)").alias("text"), "cls", (F.col("_size") == F.length("text")).alias("whole")
    )
    unseen = unseen.mapInArrow(_entropy_batches(model), "cls long, whole boolean, h array<double>, n long").collect()
    none = (np.zeros(0, int), np.zeros(0, bool), np.zeros((0, len(languages))), np.zeros(0, int))
    _calibrated(model, *((np.array(x) for x in zip(*unseen, strict=True)) if unseen else none))
    return model


def _logs(keys: np.ndarray, p: np.ndarray):
    where, values = hashed(keys, np.log2(np.maximum(p, 1e-30)).astype(np.float32))
    return where, np.vstack([values, np.zeros((1, values.shape[1]), np.float32)])


def _judge_batches(model: Model):
    names = np.array([*model.languages, UNDETERMINED], object)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in pieces(batches, limit=_piece_limit(len(model.languages))):
            best, share, bits, rejected = model.judge(data, offs)
            kept = [rows.column(c) for c in rows.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(names[best], pa.string()), pa.array(share), pa.array(bits), pa.array(rejected)],
                [*[c for c in rows.schema.names if c != "text"], "lang_pred", "score", "bits", "rejected"],
            )

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, bits, rejected`` of every row.

    Null texts and texts without a letter are ``und``, score 0 and rejected. Repeated rows are
    judged each, an empty table gives an empty result, other columns are left out.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        _judge_batches(model), "doc_id long, lang_pred string, score double, bits double, rejected boolean"
    )


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns."""
    bounded_batches(docs.sparkSession)
    fields = [f.name for f in docs.schema]
    # The rows travel under positions, so that no column of theirs can clash.
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(fields)])
    text = f"c{fields.index('text')}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in pieces(batches, text, _piece_limit(len(model.languages))):
            rejected = model.judge(data, offs)[3]
            yield rows.filter(pa.array(~rejected))

    return inner.mapInArrow(run, inner.schema).toDF(*fields)


@query("op2_language_id")
def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    model = fit(docs.where(~held_out))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
