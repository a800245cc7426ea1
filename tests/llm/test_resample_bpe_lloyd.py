"""Resampling, byte-level BPE and clustering against plain versions of themselves."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from pluvia.llm import bpe, lloyd, resample
from pluvia.llm.common import stored
from pluvia.llm.textarrays import raw_bytes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rnd = random.Random(3)


def prose(n, words="alpha beta gamma delta Épsilon zeta_eta 42 theta's".split()):
    return " ".join(rnd.choice(words) + rnd.choice(["", ".", "\n", "\n\n"]) for _ in range(n))


COMMON = "the same line stands in many texts of the table, with more than twenty words in it, " * 2
LONG = prose(40_000)
ROWS = [
    (1, prose(80), "en", "a", 1),
    (2, COMMON + "\n" + prose(30), "en", "a", 1),
    (3, prose(30) + "\n" + COMMON, None, None, None),
    (4, None, "en", "a", 1),
    (5, "", "en", "a", 1),
    (6, " \n\t\n ", "en", "a", 1),
    (7, COMMON, "en", "a", 1),
    (7, COMMON, "en", "a", 1),
    (7, COMMON, "en", "a", 1),
    (None, COMMON, "en", "a", 1),
    (None, None, None, None, None),
    (8, LONG, "en", "a", 1),
    (9, "x" * 5000 + " " + "日本語" * 300 + " 😀😀", "en", "a", 1),
    (10, "one two", "en", "a", 1),
]
CLASH = ["ids", "n", "bucket", "row", "score", "rank", "n_words", "weight", "tile", "block", "v", "h"]


@pytest.fixture(scope="module")
def docs(spark):
    return stored(spark.createDataFrame(ROWS, SCHEMA).repartition(3))


@pytest.fixture(scope="module")
def empty(spark):
    return stored(spark.createDataFrame([], SCHEMA))


def with_clashes(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH if c not in df.columns])


# --- resampling ------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, ngram):
    ws = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return ws, [" ".join(ws[i : i + n]) for n in range(1, ngram + 1) for i in range(len(ws) - n + 1)]


def plain_resample(rows, target, ngram, buckets, seed, min_words, percent):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(of(f) for _, text, *_ in rows for f in runs(text, ngram)[1])
    t = Counter(of(f) for text in target for f in runs(text, ngram)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text, *_ in rows:
        ws, fs = runs(text, ngram)
        weight = sum(gain[of(f)] for f in fs)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(ws), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0]))
    n = percent * len(able) // 100
    ranks = Counter()
    for k, r in enumerate(able):
        ranks[(*r, k + 1 if k < n else None)] += 1
    for r in out:
        if r[1] < min_words:
            ranks[(*r, None)] += 1
    return ranks


@pytest.mark.parametrize(("ngram", "buckets", "percent"), [(1, 10_000, 10), (3, 97, 50), (2, 1000, 100)])
def test_resample_equals_plain_version(spark, docs, ngram, buckets, percent):
    target = ["alpha beta gamma\ndelta 42", None, COMMON]
    frame = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(docs, frame, ngram, buckets, 7, 20, percent)
    assert Counter(map(tuple, got.collect())) == plain_resample(ROWS, target, ngram, buckets, 7, 20, percent)


def test_resample_empty_tables_and_clashing_columns(spark, docs, empty):
    assert resample.resample(empty, docs).count() == 0
    none = resample.resample(docs, empty)
    assert Counter(map(tuple, none.collect())) == plain_resample(ROWS, [], 1, 10_000, 2024, 20, 10)
    both = resample.resample(with_clashes(docs), with_clashes(docs))
    assert Counter(map(tuple, both.collect())) == Counter(map(tuple, resample.resample(docs, docs).collect()))


def test_distinct_lines_count_as_often_as_they_occur(docs):
    got = dict(map(tuple, resample.bucket_counts(docs, 2, 50).collect()))
    want = Counter(zlib.crc32(f.encode()) % 50 for _, text, *_ in ROWS for f in runs(text, 2)[1])
    assert got == dict(want)


def test_span_crc32():
    words = ["", "a", "ab" * 32, "ab" * 33, "é" * 500, "zebra"]
    data, offs = raw_bytes(__import__("pyarrow").array(words))
    assert resample.span_crc32(data, offs[:-1], offs[1:]).tolist() == [zlib.crc32(w.encode()) for w in words]


# --- byte-level BPE --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    ranks = bpe.read_ranks(bpe.default_path())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.default_path())


TRICKY = [
    "", " ", "a" * 3000, "ab" * 2000, "=-" * 3000, "\x00\x01  x\r\n\n", "<|endoftext|>", "I'll they'RE don't 's",
    "".join(rnd.choice("etaoinsr") for _ in range(20_000)),
    "".join(chr(rnd.randrange(32, 0x2FFF)) for _ in range(20_000)),
    "日本語テキスト 中文😀😀   x",
]


def test_ids_equal_the_library(encoder, library):
    texts = TRICKY + ["".join(rnd.choice("abcdeinrst ") for _ in range(rnd.randint(1, 40))) for _ in range(5000)]
    got = encoder.encode(texts)
    assert [g.tolist() for g in got] == [library.encode_ordinary(t) for t in texts]


def test_replay_follows_lower_ranks_that_a_merge_brings_up():
    # Ranks at random: a merge often makes a pair of a lower rank, which then goes first.
    for seed in range(60):
        r = random.Random(seed)
        made = {"".join(p) for n in (2, 3, 4, 5) for p in itertools.product("ab", repeat=n) if r.random() < 0.6}
        tokens = [bytes([b]) for b in range(256)] + [t.encode() for t in made]
        r.shuffle(tokens)
        ranks = {t: k for k, t in enumerate(tokens)}
        words = ["".join(r.choice("ab") for _ in range(r.randint(1, 30))) for _ in range(50)]
        data, offs = raw_bytes(__import__("pyarrow").array(words))
        ids, at = bpe.replay(bpe.Merges(ranks), data, offs, step=r.choice([1, 7, 1000]))
        for k, w in enumerate(words):
            parts = [bytes([b]) for b in w.encode()]
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 10**9), i))
                if parts[best] + parts[best + 1] not in ranks:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            assert ids[at[k] : at[k + 1]].tolist() == [ranks[p] for p in parts]


def test_words_forgotten_or_merged_in_parts_encode_alike(library, monkeypatch):
    monkeypatch.setattr(bpe, "REPLAY_BYTES", 40)
    small = bpe.Encoder(bpe.default_path(), table_words=50)
    texts = [prose(60) for _ in range(20)]
    for t in texts:
        assert small.encode([t])[0].tolist() == library.encode_ordinary(t)


def test_encode_and_decode_tables(spark, docs, empty, library):
    path = bpe.default_path()
    rows = bpe.decode(bpe.encode(with_clashes(docs), path), path).collect()
    want = Counter((r[0], tuple(library.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in ROWS)
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in rows) == want
    assert bpe.decode(bpe.encode(empty, path), path).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode(nulls, path).collect()] == [b"", b""]


def test_every_byte_needs_a_rank(tmp_path):
    path = tmp_path / "few.tiktoken"
    path.write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError, match="every byte"):
        bpe.Encoder(str(path))


def test_query_digests(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in bpe._op12(spark, sf).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = {k: library.encode_ordinary(t) for k, t in texts.items()}
    assert got == {k: (len(ids[k]), sha(" ".join(map(str, ids[k])).encode()), sha(t.encode())) for k, t in texts.items()}


# --- clustering ------------------------------------------------------------------------------


def plain_lloyd(rows, clusters, rounds, dimensions, scale, seed):
    kept = [
        (i, [math.floor(scale * float(x)) for x in v])
        for i, v in rows
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)
    ]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [v for _, v in first[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), k) for k, x in enumerate(c))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        c = [[sum(x) // len(groups[k]) for x in zip(*groups[k], strict=True)] if k in groups else c[k] for k in range(len(c))]
    return Counter((i, nearest(v)[1], nearest(v)[0]) for i, v in kept), dict(enumerate(c))


def vectors(n, dimensions, spread):
    r = np.random.RandomState(4)
    return [(k, [float(np.float32(x)) for x in r.normal(0, spread, dimensions)]) for k in range(n)]


@pytest.mark.parametrize(
    ("n", "clusters", "rounds", "dimensions", "columns", "tile", "spread"),
    [(300, 16, 3, 8, 3, 50, 1.0), (5, 16, 2, 4, 4, 2, 1.0), (200, 3, 4, 5, 1, 7, 3e5), (40, 4, 0, 6, 64, 4096, 0.1)],
)
def test_lloyd_equals_plain_version(spark, n, clusters, rounds, dimensions, columns, tile, spread):
    rows = vectors(n, dimensions, spread)
    one = rows[0][1]
    rows += [(1, one), (1, one), (1, rows[1][1]), (None, one), (None, None), (900, [*one[:-1], None]),
             (901, [*one[:-1], float("nan")]), (902, [*one[:-1], float("-inf")]), (903, one[:-1]), (904, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got, centroids = lloyd.cluster(with_clashes(frame), clusters, rounds, dimensions, 64, 1, columns, tile)
    want, c = plain_lloyd(rows, clusters, rounds, dimensions, 64, 1)
    assert Counter(map(tuple, got.collect())) == want
    assert {r.cluster: r.centroid for r in centroids.collect()} == c


def test_lloyd_without_vectors_and_out_of_range(spark):
    schema = "vec_id long, embedding array<float>"
    got, centroids = lloyd.cluster(spark.createDataFrame([(1, [1.0])], schema))
    assert got.count() == centroids.count() == 0
    with pytest.raises(Exception, match="no squared distance"):
        lloyd.cluster(spark.createDataFrame([(1, [1e30] * 64)], schema))[0].count()


def test_empty_clusters_keep_their_centroid(spark):
    # Copies of one vector begin two clusters: the second one of equal distance stays empty.
    rows = [(k, [0.5, 0.5]) for k in range(6)] + [(9, [3.0, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, centroids = lloyd.cluster(frame, 4, 2, 2, 64, 1, 1, 2)
    want, c = plain_lloyd(rows, 4, 2, 2, 64, 1)
    assert Counter(map(tuple, got.collect())) == want
    assert {r.cluster: r.centroid for r in centroids.collect()} == c
