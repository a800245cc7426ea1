"""Target-distribution importance resampling with segment deduplication.

Features are runs of consecutive words, hashed into buckets. Newlines cut texts into lines; equal
lines meet in one grouping, the features of a distinct line are counted once and multiplied by its
occurrences. Runs that cross a line are counted from the texts, apart. A bucket's gain compares the
target's counts with the corpus'; a document's weight is the sum over its features, and a Gumbel
number from its id makes the highest scores a draw without replacement.

The sums per bucket and the splits of the ranking are all that reaches the driver.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pluvia.llm.common import query, stored, table
from pluvia.llm.textarrays import LOWER, NOT_ALNUM, bounded_batches, pieces, word_spans

NGRAM = 1
BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
#: Longer features are hashed one by one.
LONG = 64


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> 1 ^ np.uint32(0xEDB88320), out >> 1)
    return out.astype(np.uint32)


_CRC = _crc_table()


def span_crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of byte spans, all short ones together, byte by byte."""
    size = ends - starts
    order = np.argsort(-np.minimum(size, LONG + 1), kind="stable")
    begin, size = starts[order], size[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    n_long = int(np.searchsorted(-size, -LONG, "left"))
    at = begin[n_long:]
    some = crc[n_long:]
    live = np.searchsorted(-size[n_long:], -np.arange(1, LONG + 1), "right")
    for k, n in enumerate(live.tolist()):
        if not n:
            break
        some[:n] = _CRC[(some[:n] ^ data[at[:n] + k]) & np.uint32(255)] ^ (some[:n] >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for k in range(n_long):
        crc[k] = zlib.crc32(data[begin[k] : begin[k] + size[k]].tobytes())
    out = np.empty(len(order), np.uint32)
    out[order] = crc
    return out


def features(
    data: np.ndarray, offs: np.ndarray, ngram: int, buckets: int, across: bool | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all runs of up to ``ngram`` words, the row of each, and the rows' numbers of words.

    ``across``: only the runs that cross a newline (true), or only the others (false).
    """
    low = LOWER[data]
    starts, ends, at = word_spans(low, offs, NOT_ALNUM)
    words = np.diff(at)
    row = np.repeat(np.arange(len(words)), words)
    # The words side by side with one space between, so that a run is one span.
    sizes = ends - starts
    new = np.concatenate([[0], np.cumsum(sizes + 1)])
    joined = np.full(new[-1], 0x20, np.uint8)
    inside = np.ones(new[-1], bool)
    inside[new[1:] - 1] = False
    joined[inside] = low[~NOT_ALNUM[low]]
    line = None if across is None else np.searchsorted(np.flatnonzero(data == 10), starts)
    found, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in range(1, ngram + 1):
        first = np.arange(max(len(starts) - n + 1, 0))
        last = first + n - 1
        keep = row[first] == row[last]
        if line is not None:
            keep &= (line[first] != line[last]) == across
        first, last = first[keep], last[keep]
        found.append(span_crc32(joined, new[first], new[last + 1] - 1).astype(np.int64) % buckets)
        rows.append(row[first])
    return np.concatenate(found), np.concatenate(rows), words


def _sum_batches(ngram: int, buckets: int, across: bool):
    """``bucket, n`` over a partition of ``text, n``: the features of a text, times ``n``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for rows, data, offs in pieces(batches):
            found, row, _ = features(data, offs, ngram, buckets, across)
            times = rows.column("n").to_numpy()
            # Whole numbers below 2 ** 53 stay exact in the sums of one piece.
            total += np.bincount(found, times[row], buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: how many features of the column ``text`` fall into each bucket; null texts have none."""
    bounded_batches(texts.sparkSession)
    text = texts.select(F.col("text").cast("string").alias("text")).where("text is not null")
    lines = text.select(F.explode(F.split("text", "\n")).alias("text")).where("text != ''")
    distinct = lines.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    schema = "bucket long, n long"
    sums = distinct.mapInArrow(_sum_batches(ngram, buckets, False), schema)
    if ngram > 1:
        whole = text.where(F.contains("text", F.lit("\n"))).select("text", F.lit(1).cast("long").alias("n"))
        sums = sums.unionAll(whole.mapInArrow(_sum_batches(ngram, buckets, True), schema))
    return sums.groupBy("bucket").agg(F.sum("n").alias("n"))


def _dense(counts: DataFrame, buckets: int) -> np.ndarray:
    """At most ``buckets`` rows, on the driver."""
    out = np.zeros(buckets, np.int64)
    rows = counts.toPandas()
    out[rows.bucket.to_numpy(int)] = rows.n.to_numpy(int)
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of every bucket."""
    b, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    pairs = zip(corpus.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + b) / ((s + 1) * (t_all + b)))) for s, t in pairs], np.int64)


def _weight_batches(gain: np.ndarray, ngram: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in pieces(batches):
            found, row, words = features(data, offs, ngram, len(gain))
            n = np.bincount(row, minlength=len(words))
            weight = np.bincount(row, gain[found], len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(words), pa.array(n), pa.array(weight)],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    return run


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))), h from a hash of seed and id; a null id is the empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, draw: int) -> DataFrame:
    """``scored`` with ``rank`` 1, 2, 3, ... by ``score`` (highest first), ``doc_id`` (null last) and
    the stored row's number ``row``; null beyond ``draw``.

    Ranges are sorted apart and numbered from the sums of those before: no window over all rows, and
    as the row's number is part of the order, no hot key.
    """
    spark = scored.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    sorted_ = scored.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # The id is the partition's number and, in the lower 33 bits, the place in it.
    placed = stored(sorted_.withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per range, whatever the number of documents.
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_part", before.alias("_before")))
    rank = F.col("_before") + place + 1
    out = placed.withColumn("_part", part).join(starts, "_part")
    return out.withColumn("rank", F.when(rank <= draw, rank)).drop("_part", "_at", "_before")


def resample(
    docs: DataFrame,
    target: DataFrame,
    ngram: int = NGRAM,
    buckets: int = BUCKETS,
    seed: int = SEED,
    min_words: int = MIN_WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank``: one row per row of ``docs``.

    ``rank`` numbers the drawn rows: of the N with at least ``min_words`` words the
    floor(percent * N / 100) highest scores. Null and empty texts have no feature and weight 0. A null
    id is hashed as the empty text and comes last among equal scores; rows that repeat an id are drawn
    each. An empty target has count 0 in all buckets; empty ``docs`` give an empty result. Other
    columns are left out.
    """
    bounded_batches(docs.sparkSession)
    gain = gains(_dense(bucket_counts(docs, ngram, buckets), buckets), _dense(bucket_counts(target, ngram, buckets), buckets))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    weighed = rows.mapInArrow(_weight_batches(gain, ngram), "doc_id long, n_words long, n_features long, weight long")
    scored = stored(
        weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn(
            "row", F.monotonically_increasing_id()
        )
    )
    able = scored.where(F.col("n_words") >= min_words)
    draw = percent * able.count() // 100
    names = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked(able, draw).select(names).unionAll(rest.select(names))


#: CRC-32 in SQL: the table by its rule, then byte by byte over the distinct words.
ORACLE = f"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i))
), texts AS (
  SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
), words AS (
  SELECT side, id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w
  FROM texts
), kinds AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM words),
hashed AS (
  SELECT w, xor(list_reduce(
      [4294967295::BIGINT] || list_transform(range(len(h) // 2), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % {BUCKETS} AS bucket
  FROM kinds, crc_table
), counts AS (
  SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t
  FROM words JOIN hashed USING (w) GROUP BY bucket
), sums AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM counts),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (s_all + {BUCKETS}) / ((s + 1) * (t_all + {BUCKETS}))))::BIGINT AS g
  FROM counts, sums
), weighed AS (
  SELECT id AS doc_id, count(*) AS n, sum(g)::BIGINT AS weight
  FROM words JOIN hashed USING (w) JOIN gain USING (bucket) WHERE side = 0 GROUP BY id
), scored AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln(
      (('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM documents LEFT JOIN weighed USING (doc_id)
), able AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= {MIN_WORDS} ORDER BY score DESC, doc_id) AS place,
    count(*) FILTER (n_features >= {MIN_WORDS}) OVER () AS n_able
  FROM scored
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= {MIN_WORDS} AND place <= {PERCENT} * n_able // 100 THEN place END AS rank
FROM able
"""


@query("op11_resample", ORACLE)
def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
