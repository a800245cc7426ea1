"""Every corpus operator on hand-made rows and against plain versions of itself."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pluvia.llm import (
    charlm,
    decontaminate,
    hmm,
    language_id,
    mixing,
    quality,
    simhash,
    suffix_dedup,
    token_files,
    toxicity,
    url_filter,
)
from pluvia.llm.common import remainder, stored
from pluvia.llm.textarrays import pieces, raw_bytes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns whose names the operators use themselves.
CLASH = ["row", "f", "k", "kept", "epochs", "budget", "rejected", "part", "c0"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return WORD.findall(lower)


def prose(seed, n, vocabulary="alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()):
    rng = np.random.RandomState(seed)
    return " ".join(vocabulary[i] + str(rng.randint(40)) for i in rng.randint(0, len(vocabulary), n))


LONG = prose(99, 30_000)
SHARED = prose(7, 60)

ROWS = [
    (1, prose(1, 80), "en", "src1", 1),
    (2, prose(1, 80), "en", "src1", 1),
    (3, prose(1, 80) + " tail", None, "src2", None),
    (4, None, "en", "src0", None),
    (5, "", None, None, 0),
    (6, " \n\t ", "de", "odd", 4),
    (7, "one", "de", "src3", 3),
    (8, prose(2, 40) + "\n" + SHARED + "\n" + prose(3, 30), "de", "src0", 5),
    (9, prose(4, 25) + "\n" + SHARED, "de", "src0", 5),
    (10, "a b c d e " * 30, "en", "src4", 9),
    (11, "Ünïcödé  text\u00a0with\ttabs\r\n\r\nand <|endoftext|> it's #*$%&|<>", "de", "src5", 2),
    (11, prose(5, 20), "de", "src5", 2),
    (11, prose(5, 20), "de", "src5", 2),
    (None, prose(6, 30), "en", "src6", 2),
    (None, None, None, None, None),
    (12, LONG, "en", "src1", 3),
    (13, LONG[1000:], "en", "src1", 3),
    (14, "aaaa" * 100, "en", "src7", 3),
    (15, "12 + 34 = 46!", None, "src8", 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    return stored(spark.createDataFrame(ROWS, SCHEMA).repartition(3))


@pytest.fixture(scope="module")
def empty(spark):
    return stored(spark.createDataFrame([], SCHEMA))


@pytest.fixture(scope="module")
def clashing(docs):
    return stored(docs.select("*", *[F.lit("x").alias(c) for c in CLASH]))


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(("~" if v is None else repr(v)) for v in r))


# --- quality ---------------------------------------------------------------------------------


def plain_quality(text):
    text = text or ""
    ws = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    inside = {i + j for i in range(len(ws) - 4) if windows[tuple(ws[i : i + 5])] > 1 for j in range(5)}
    symbols = sum(c in quality.SYMBOLS for c in text)
    return len(ws), sum(map(len, ws)), symbols, len(lines) - len(set(lines)), len(inside)


def test_quality_counts(docs):
    got = Counter(tuple(r)[:6] for r in quality.judge(docs).collect())
    assert got == Counter((r[0], *plain_quality(r[1])) for r in ROWS)


def test_quality_verdict(docs, empty, clashing):
    rows = quality.judge(docs).collect()
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert {r.doc_id for r in rows if r.kept} >= {1, 2, 3, 8, 9, 12, 13}
    assert quality.judge(empty).count() == 0
    assert table(quality.judge(clashing)) == table(quality.judge(docs))


def test_cascade_takes_most_rejections_per_second_among_those_standing():
    # Rule 0 rejects what rule 1 rejects and costs more; rule 2 is dear but catches the rest.
    masks = [(0b011, 50), (0b010, 10), (0b100, 30), (0, 100)]
    assert quality.cascade_order([2.0, 1.0, 3.0], masks) == [1, 2, 0]
    assert quality.cascade_order([], []) == []


def test_order_of_rules_does_not_change_the_verdict(docs):
    one = {tuple(r) for r in quality.judge(docs, quality.RULES).collect()}
    assert one == {tuple(r) for r in quality.judge(docs, quality.RULES[::-1]).collect()}


# --- characters ------------------------------------------------------------------------------


def test_code_points_and_letters():
    texts = ["Añ ß€𝄞x", "", "a--b", "  ", "É"]
    data, offs = raw_bytes(pa.array(texts))
    cp, at = charlm.code_points(data, offs)
    assert cp.tolist() == [ord(c) for t in texts for c in t]
    assert np.diff(at).tolist() == [len(t) for t in texts]
    stream, at, has = charlm.letter_stream(data, offs, 2)
    rows = ["".join(map(chr, stream[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert [r[2:-1].strip() for r in rows] == ["añ ß x", "", "a b", "", "é"]
    assert all(r[:2] == "  " and r[-1] == " " for r in rows)
    assert has.tolist() == [True, False, True, False, True]


def test_pieces_cover_all_rows():
    texts = ["x" * n for n in (5, 0, 50, 3, 0, 0, 7)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    got = [(len(d), o.tolist()) for _, d, o in pieces([batch], limit=10)]
    assert sum(len(o) - 1 for _, o in got) == len(texts)
    assert sum(n for n, _ in got) == sum(map(len, texts))


def test_kneser_ney_is_a_distribution():
    table_ = charlm.alphabet_table(np.array([0x20, *map(ord, "abc")]), 3)
    data, offs = raw_bytes(pa.array(["abc abca", "bacab b"]))
    grams, _, _ = charlm.row_grams(data, offs, table_, 3)
    counts = [np.unique(grams, return_counts=True)]
    levels = charlm.kneser_ney(counts, 3, 4)
    bits = 20
    # From a seen context, the estimates of all continuations add up to one.
    top, ctx = levels[-1], levels[-1].contexts[0]

    def p(gram, k):
        level = levels[k - 1]
        at = np.searchsorted(level.grams, gram)
        if at < len(level.grams) and level.grams[at] == gram:
            return level.p[at, 0]
        c = gram >> np.uint64(bits)
        j = np.searchsorted(level.contexts, c)
        back = level.backoff[j, 0] if j < len(level.contexts) and level.contexts[j] == c else 1.0
        low = gram & np.uint64((1 << bits * (k - 1)) - 1)
        return back * (p(low, k - 1) if k > 1 else 1 / 5)

    unknown = [table_[5]]
    chars = [table_[c] for c in (0x20, *map(ord, "abc"))] + unknown
    assert sum(p(ctx << np.uint64(bits) | c, 3) for c in chars) == pytest.approx(1)
    assert len(top.grams) == len(counts[0][0])


# --- language and toxicity -------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.RandomState(3)
    vocab = {"xx": "shuf torp glim nard vex".split(), "yy": "aeo iua ouei eaai uoa".split()}
    rows = []
    for i in range(240):
        lang = ("xx", "yy")[i % 2]
        text = " ".join(vocab[lang][j] for j in rng.randint(0, 5, 40))
        bad = i % 5 == 0
        if bad:
            text += " grumbach " * 4
        rows.append((i, text, lang, "s", int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, toxic int")
    return stored(df)


def test_languages_are_told_apart(labelled):
    train = labelled.where(remainder(F.col("doc_id"), 3) != 1)
    model = language_id.fit(train)
    out = language_id.identify(labelled, model).join(labelled.select("doc_id", "lang"), "doc_id")
    assert out.where("lang_pred <> lang").count() == 0
    assert out.where("score < 0.5 or score > 1").count() == 0


def test_language_of_odd_texts(spark, labelled, docs, empty, clashing):
    model = language_id.fit(labelled)
    got = {r.doc_id: r for r in language_id.identify(docs.where("doc_id not in (11, 12, 13)"), model).collect()}
    assert [got[i].lang_pred for i in (4, 5, 6, 15)] == ["und"] * 4
    assert [got[i].score for i in (4, 5, 6, 15)] == [0.0] * 4
    assert all(got[i].rejected for i in (4, 5, 6, 15))
    assert language_id.identify(empty, model).count() == 0
    nothing = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}
    kept = language_id.keep_identified(clashing, model)
    assert kept.columns == clashing.columns
    assert set(table(kept)) <= set(table(clashing))


def test_rejection_is_calibrated(spark, labelled):
    model = language_id.fit(labelled)
    noise = "zzq qqz zqz " * 40
    rows = spark.createDataFrame([(1, noise), (2, "shuf torp glim nard " * 10)], "doc_id long, text string")
    got = {r.doc_id: r.rejected for r in language_id.identify(rows, model).collect()}
    assert got == {1: True, 2: False}


def test_rejection_stands_junk_and_few_texts(spark, labelled):
    rng = np.random.RandomState(8)

    def letters(n):
        return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz  "), n))

    langs = sorted(r.lang for r in labelled.select("lang").distinct().collect())
    n = labelled.count() // len(langs)
    junk = [(10_000 + k, letters(300), lang) for k, lang in enumerate(langs * (n // 8))]
    junk += [(20_000 + k, "vov kik pap " * 20, "rare") for k in range(3)]
    extra = spark.createDataFrame(junk, "doc_id long, text string, lang string")
    model = language_id.fit(labelled.select("doc_id", "text", "lang").union(extra))
    assert np.isfinite(model.limits).all()
    noise = [(k, letters(size)) for k, size in enumerate((60, 100, 200, 500) * 5)]
    foreign = [(100, "wekuvy jaxoqi ywuhu qijaxo vykuwe " * 10)]
    good = [(1000 + r.doc_id, r.text) for r in labelled.limit(50).collect()]
    rows = spark.createDataFrame(noise + foreign + good, "doc_id long, text string")
    rejected = {r.doc_id for r in language_id.identify(rows, model).collect() if r.rejected}
    assert rejected == {k for k, _ in noise + foreign}


def test_toxic_words_are_found(labelled):
    train = labelled.where(remainder(F.col("doc_id"), 5) != 0).select("doc_id", "toxic")
    model = toxicity.fit(labelled, train)
    out = toxicity.score(labelled, model).join(labelled.select("doc_id", "toxic"), "doc_id")
    held = out.where(remainder(F.col("doc_id"), 5) == 0)
    assert held.where("predicted <> toxic").count() == 0
    assert held.where("predicted <> cast(score >= 0.5 as int)").count() == 0


def test_toxicity_of_odd_texts(labelled, docs, empty, clashing):
    model = toxicity.fit(labelled, labelled.select("doc_id", "toxic"))
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    blank = {r.score for r in rows if r.doc_id in (4, 5, 6)}
    assert len(blank) == 1
    assert toxicity.score(empty, model).count() == 0
    assert table(toxicity.score(clashing, model)) == table(toxicity.score(docs, model))
    none = toxicity.fit(docs, labelled.select("doc_id", "toxic").where("false"))
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}


# --- decontamination -------------------------------------------------------------------------


def edits(pattern, text):
    """Fewest edits between the pattern and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def normal(text):
    return " ".join(re.findall(r"[^\W_]+", text.lower()))


def test_items_are_found_within_their_edits(spark):
    rng = np.random.RandomState(0)
    items = [(k, prose(100 + k, 12 + 5 * k)) for k in range(6)]
    rows, want = [], set()
    for n in range(60):
        k = n % 6
        item = list(items[k][1])
        for _ in range(rng.randint(0, len(item) // 8)):
            at, what = rng.randint(len(item)), rng.randint(3)
            if what == 0:
                item[at] = "q"
            elif what == 1:
                del item[at]
            else:
                item.insert(at, "j")
        text = f"{prose(n, 30)}. {''.join(item).upper()}, {prose(n + 500, 20)}"
        rows.append((n, text))
        for j, it in items:
            m = len(normal(it))
            e = edits(normal(it), normal(text))
            if e <= int(decontaminate.EDIT_RATE * m):
                want.add((n, j, e))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (50, "short"), (51, None), (None, items[0][1])], "item_id long, text string")
    got = {tuple(r) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == want and {e for _, _, e in want} > {0, 1}
    small = [decontaminate.make_block(*b) for b in decontaminate.benchmark_blocks(bench, limit=200)]
    assert len(small) > 1
    found = set()
    data, offs = raw_bytes(pa.array([t for _, t in rows]))
    for block in small:
        found |= set(decontaminate.find_items(data, offs, block))
    assert found == want


def test_decontamination_of_odd_tables(spark, docs, empty, clashing):
    bench = spark.createDataFrame([(1, SHARED), (1, SHARED)], "item_id long, text string")
    assert table(decontaminate.contaminated(docs, bench)) == [(8, 1, 0), (9, 1, 0)]
    none = bench.where("false")
    assert decontaminate.contaminated(docs, none).count() == 0
    assert decontaminate.contaminated(empty, bench).count() == 0
    clean = decontaminate.keep_clean(clashing, bench)
    assert clean.columns == clashing.columns
    assert table(clean) == table(clashing.where("doc_id is null or doc_id not in (8, 9)"))
    assert table(decontaminate.keep_clean(docs, none)) == table(docs)


def test_short_items(spark):
    items = {
        1: "What is a cat?", 2: "今天天气怎么样", 3: "7", 4: "how are you all doing", 5: "which way is it", 6: "near the old mill",
        7: "over the old mill road today", 8: "What is a CAT", 9: "?!", 10: "の",
    }
    rows = {
        1: "So: what is a cat", 2: "what is a cathedral", 3: "somewhat is a cat", 4: "问题今天天气怎么样。", 5: "room 7, floor 17",
        6: "x how are you al doing y", 7: "which way is itt", 8: "which way is it", 9: "near thee old mill", 10: "over the old mil road today",
        11: "", 12: None, 13: "near a nold mill", 14: "猫のcat", 15: "7",
    }
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {tuple(r) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {
        (1, 1, 0), (1, 8, 0), (4, 2, 0), (5, 3, 0), (15, 3, 0), (6, 4, 1), (8, 5, 0), (9, 6, 1), (10, 7, 1), (14, 10, 0),
    }
    clean = decontaminate.keep_clean(docs, bench).collect()
    assert {r.doc_id for r in clean} == {2, 3, 7, 11, 12, 13}


# --- token files -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_files.default_path())


def test_tokens_equal_the_library(spark, docs, empty, clashing, tokenizer):
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for doc_id, text, *_ in order:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = token_files.token_digest(docs, token_files.default_path())
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[1]) == want
    shards = token_files.write_shards(docs, token_files.default_path(), shard_tokens=500, partitions=2)
    assert shards.count() > 3
    assert table(token_files.read_documents(shards)) == table(got)
    assert token_files.token_digest(empty, token_files.default_path()).count() == 0
    assert table(token_files.token_digest(clashing, token_files.default_path())) == table(got)


def test_pieces_encode_like_whole_texts(tokenizer):
    texts = [
        "", " ", "  ", "a", " a", "a ", "a  b", "a\nb", "\n", "a\n", "\na", "a \n b", "a\n\nb", "x\ty z", "it's we'll",
        "don't\nstop, now", "\u2003a b", "a\u00a0b c", "名前 は\n何", "tab\t", "é" * 30 + " à", "<|endoftext|> a", "\x00 a b",
        "a\x0bb c\x0c d", "end. Next", "1234 56\n78", "a\r\nb c",
    ]
    t = token_files.Tokenizer(token_files.default_path())
    for _ in range(2):  # the second time from the table
        ids, offs = t.encode_all(texts, 9)
        for k, text in enumerate(texts):
            assert ids[offs[k] : offs[k + 1]].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 9], text


@pytest.mark.parametrize("seed", range(6))
def test_re_pair_round_trip(seed):
    rng = np.random.RandomState(seed)
    sizes = rng.randint(0, 300, 40)
    ids = rng.zipf(1.3, sizes.sum()) % (7, 50, 60_000)[seed % 3]
    ids[rng.rand(len(ids)) < 0.3] = 5
    offs = np.concatenate([[0], np.cumsum(sizes)])
    shard = token_files.Shard(token_files.pack_shard(ids.astype(np.uint32), offs))
    assert shard.all().tolist() == ids.tolist()
    for k in range(len(sizes)):
        assert shard.document(k).tolist() == ids[offs[k] : offs[k + 1]].tolist()
    for i in rng.randint(0, len(ids), 50):
        assert shard.token(int(i)) == ids[i]
    assert len(shard.seq) < 0.8 * len(ids)
    whole = np.diff(token_files.expansions(shard.rules, shard.base)[1])[shard.base :]
    assert shard.base == int(ids.max()) + 1 and shard.lengths.tolist() == whole.tolist() and (whole >= 2).all()


def test_re_pair_of_nothing():
    shard = token_files.Shard(token_files.pack_shard(np.zeros(0, np.uint32), np.zeros(1, np.int64)))
    assert len(shard.all()) == 0


# --- simhash ---------------------------------------------------------------------------------


def plain_fingerprint(text):
    w = words(text)
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(links):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def test_near_duplicates(docs, empty, clashing):
    prints = [plain_fingerprint(r[1]) for r in ROWS]
    ids = [r[0] if r[0] is not None else 1 << 62 for r in ROWS]
    close = [
        ((ids[a], a), (ids[b], b)) for a, b in itertools.product(range(len(ROWS)), repeat=2)
        if (prints[a] ^ prints[b]).bit_count() <= 3
    ]
    root = plain_components(close)
    want = Counter(
        (r[0], format(prints[k], "016x"), None if root[(ids[k], k)][0] == 1 << 62 else root[(ids[k], k)][0])
        for k, r in enumerate(ROWS)
    )
    found = simhash.near_duplicates(docs, partitions=3)
    got = found.select("doc_id", simhash.hexadecimal(F.col("f")), "component_id")
    assert Counter(tuple(r) for r in got.collect()) == want
    assert simhash.near_duplicates(empty, partitions=3).count() == 0
    kept = simhash.keep_first(clashing)
    assert kept.columns == clashing.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and ids.count(11) == 3


def test_links_of_tiles_connect_what_is_near():
    rng = np.random.RandomState(1)
    seeds = rng.randint(0, 1 << 62, 60).astype(np.uint64)
    values = set(seeds.tolist())
    for s in seeds.tolist():
        for _ in range(12):
            a, b = rng.randint(0, 64, 2).tolist()
            s ^= (1 << a) ^ (1 << b)
            values.add(s)
    values = np.array(sorted(values, key=lambda v: (v.bit_count(), (v & 0xFFFFFFFF).bit_count())), np.uint64)
    cut = len(values) // 2
    tiles = [values[:cut], values[cut:]]
    links = [
        pair for a, b in ((0, 0), (0, 1), (1, 1))
        for pair in zip(*(x.tolist() for x in simhash.near_links(tiles[a], tiles[b], 3, a == b)), strict=True)
    ]
    distance = np.bitwise_count(values[:, None] ^ values[None])
    near = [(int(values[i]), int(values[j])) for i, j in zip(*np.nonzero(distance <= 3), strict=True) if i != j]
    assert plain_components(links) == plain_components(near)
    assert len(links) < 3 * len(values)


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 90), (90, 95)] + [(5, 5)]
    df = spark.createDataFrame(links, "u long, v long")
    got = {r.node: r.root for r in simhash.components(df).collect()}
    assert got == {**{i: 0 for i in range(61)}, 90: 90, 95: 90, 100: 90}


# --- hidden Markov model ---------------------------------------------------------------------


@pytest.fixture
def tiny():
    rng = np.random.RandomState(1)
    return hmm.Hmm(np.array([0.3, 0.7]), np.array([[0.6, 0.4], [0.2, 0.8]]), rng.dirichlet(np.ones(4), 2).T)


def every_path(model, seq):
    for path in itertools.product(range(2), repeat=len(seq)):
        p = model.start[path[0]] * model.emit[seq[0], path[0]]
        for a, b, o in zip(path, path[1:], seq[1:]):
            p *= model.move[a, b] * model.emit[o, b]
        yield path, p


def test_recursions_equal_the_sum_over_paths(tiny):
    seqs = [[0, 1, 2, 3], [3], [2, 2, 3], [1, 0, 3, 3, 1]]
    x = hmm.Packed(np.concatenate(seqs), np.array([len(s) for s in seqs]))
    logs = hmm.forward(tiny, x)
    assert logs == pytest.approx([math.log(sum(p for _, p in every_path(tiny, s))) for s in seqs])
    start, move, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    for s in seqs:
        total = sum(p for _, p in every_path(tiny, s))
        for path, p in every_path(tiny, s):
            start[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                move[a, b] += p / total
            for a, o in zip(path, s, strict=True):
                emit[o, a] += p / total
    got = hmm.expected_counts(tiny, x)
    for a, b in zip(got, (start, move, emit), strict=True):
        assert a == pytest.approx(b, abs=1e-5)


def test_likelihoods(docs, empty, clashing):
    train = docs.where("doc_id is null or doc_id % 3 <> 0")
    model, vocabulary, counts = hmm.fit(train, states=2, head=20, iterations=1)
    c = Counter()
    for r in ROWS:
        if r[0] is None or r[0] % 3:
            c.update([*words(r[1]), None])
    n, v = sum(c.values()), len(c)
    got = hmm.score(docs, model, vocabulary, counts).collect()
    want = Counter()
    for r in ROWS:
        w = [*words(r[1]), None]
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        want[(r[0], len(w), sum(c[x] > 0 for x in w), n, round(base, 5))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert hmm.score(empty, model, vocabulary, counts).count() == 0
    assert hmm.score(clashing, model, vocabulary, counts).count() == len(ROWS)
    none = hmm.fit(empty, states=2, iterations=1)
    assert {r.base_score for r in hmm.score(docs.where("doc_id = 4"), *none).collect()} == {0.0}


def test_rare_words_do_not_change_with_the_head(docs):
    """The model stays a distribution: words outside the head share what the states give them."""
    train = docs.where("doc_id <= 3")
    for head in (1, 5, 1000):
        model, vocabulary, counts = hmm.fit(train, states=2, head=head, iterations=1)
        assert model.emit.sum(0) == pytest.approx([1, 1])
        assert vocabulary.rare_tokens + vocabulary.counts.sum() + 3 == vocabulary.n_tokens


def test_scores_do_not_change_with_the_head(docs):
    """Every word has its own emissions per state, wherever its counts are kept."""
    train = docs.where("doc_id is null or doc_id % 3 <> 0")
    scores = []
    for head in (1, 30, 1000):
        out = hmm.score(docs, *hmm.fit(train, states=2, head=head, iterations=1))
        scores.append(sorted((r.n_tokens, r.score) for r in out.collect()))
    for other in scores[1:]:
        assert [x for _, x in other] == pytest.approx([x for _, x in scores[0]], rel=1e-4)


# --- repeated strings ------------------------------------------------------------------------


def plain_repeats(rows):
    """Bytes, removed bytes, spans and what stays of ``(doc_id, text)`` in their order."""
    seen, out = set(), []
    for doc_id, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for o in range(len(b) - 99):
            w = b[o : o + 100]
            if w in seen:
                gone[o : o + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc_id, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_repeated_strings(spark, monkeypatch, small):
    if small:  # many pieces, so that all ways between them are taken
        monkeypatch.setattr(suffix_dedup, "HELD_BYTES", 4000)
        monkeypatch.setattr(suffix_dedup, "HOT_ROWS", 2)
        monkeypatch.setattr(suffix_dedup, "pieces", lambda b: pieces(b, limit=2500))
    rng = np.random.RandomState(4)
    rows = [(r[0], r[1]) for r in ROWS if r[0] not in (None, 11, 12, 13)]
    line = "All rights reserved by nobody in particular; see the notice that comes along with this text, if any does."
    for k in range(100, 160):
        a, b = sorted(rng.randint(0, 4000, 2))
        rows.append((k, f"{prose(k, 20)}\n{line}\n{LONG[a:b]} {prose(k + 1, 5)}"))
    rows.append((200, "ab" * 400))
    rows.append((201, line * 3))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = table(suffix_dedup.without_repeats(stored(df)))
    want = plain_repeats(sorted(rows))
    assert [r[:4] for r in got] == sorted((r[:4] for r in want), key=lambda r: tuple(map(repr, r)))
    assert {r[0]: bytes(r[4]) for r in got} == {r[0]: r[4] for r in want}
    assert sum(r[2] for r in want) > 50_000


def test_repeats_of_odd_tables(docs, empty, clashing):
    rows = suffix_dedup.without_repeats(docs, False).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(ROWS)
    assert by[4].kept == hashlib.sha256(b"").hexdigest() and by[4].n_bytes == 0
    assert by[1].n_removed == 0 and by[2].n_removed == by[2].n_bytes
    assert by[13].n_removed == by[13].n_bytes
    assert by[14].n_spans == 1 and by[14].n_removed == 399
    # Of two equal rows with one id the second is a repeat.
    assert sorted(r.n_removed > 0 for r in rows if r.doc_id == 11) == [False, False, True]
    assert suffix_dedup.without_repeats(empty).count() == 0
    assert table(suffix_dedup.without_repeats(clashing)) == table(suffix_dedup.without_repeats(docs))


# --- URLs ------------------------------------------------------------------------------------


def test_urls(spark):
    urls = {
        "http://a.org/x": ("a.org", "/x", "org/", "allow"),
        "HTTP://EXAMPLE.ORG/es/1": ("example.org", "/es/1", "example.org/es/", "block"),
        "https://b.example.org/en/17?q#f": ("b.example.org", "/en/17", "example.org/en/1", "block"),
        "https://myexample.org/es/": ("myexample.org", "/es/", "org/", "allow"),
        "http://org": ("org", "", None, "allow"),
        "http://org/": ("org", "/", "org/", "allow"),
        "x://c.com/fr/a": ("c.com", "/fr/a", "com/fr/", "allow"),
        "x://c.com/DE/a": ("c.com", "/DE/a", None, "allow"),
        "x://c.com/de/a": ("c.com", "/de/a", "com/de/", "block"),
        "a.org/x": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://n.net/a?page=2": ("n.net", "/a", None, "block"),
        "http://n.net/a?mypage=2": ("n.net", "/a", None, "allow"),
        "http://n.net/login": ("n.net", "/login", None, "block"),
        "http://n.net?x=://o.org/": ("n.net", "", None, "allow"),
    }
    rows = [(i, u, "h", "x") for i, u in enumerate(urls)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = url_filter.filter_urls(pages).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(
        (i, *want) for i, want in enumerate(urls.values()) for _ in range(2)
    )
    assert url_filter.filter_urls(pages.where("false")).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, (), ()).collect()} == {"allow"}


def test_rules_are_filed_under_their_rarest_token():
    rules = [url_filter.site_rule("block", "example.org", "/es/"), url_filter.site_rule("block", "org", "/")]
    index = url_filter.rarest_token_index(rules, {"example": 5, "org": 9, "es": 2})
    assert index == {"es": [0], "org": [1]}
    with pytest.raises(ValueError):
        url_filter.match_rules(None, [rules[0]] * (url_filter.MAX_RULES + 1))


# --- mixing ----------------------------------------------------------------------------------


def share(children, budget):
    """Plain water-filling: (weight, cap) by name to integer budgets."""
    full = {}
    rest = dict(children)
    while rest:
        weights = sum(w for w, _ in rest.values())
        over = {k for k, (w, cap) in rest.items() if cap * weights <= w * budget}
        if not over:
            break
        k = min(over, key=lambda k: (rest[k][1] / rest[k][0], k))
        full[k] = rest[k][1]
        budget -= rest.pop(k)[1]
    weights = sum(w for w, _ in rest.values())
    return full | {k: min(cap, w * budget // weights) for k, (w, cap) in rest.items()}


def test_budgets_go_down_the_tree(spark):
    leaves = [("d0", "en", "a", 100), ("d0", "en", "b", 5), ("d0", "de", "a", 7), ("d1", "en", "a", 1000), ("d1", "fr", "c", 0)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    got = {tuple(r)[:3]: r.budget for r in mixing.leaf_budgets(df, budget_percent=70, max_epochs=2).collect()}
    total = sum(x[3] for x in leaves)

    def cap(prefix):
        return 2 * sum(x[3] for x in leaves if x[: len(prefix)] == prefix)

    def weight(level, name):
        return mixing.WEIGHTS.get(level, {}).get(name, 1)

    want = {(): total * 70 // 100}
    for k, level in enumerate(mixing.LEVELS):
        now = {}
        for prefix, budget in want.items():
            names = {x[k] for x in leaves if x[:k] == prefix}
            got_ = share({n: (weight(level, n), cap((*prefix, n))) for n in names}, budget)
            now |= {(*prefix, n): b for n, b in got_.items()}
        want = now
    assert got == want
    # What the small domain cannot use goes to the large one.
    assert sum(got.values()) >= total * 70 // 100 - 5


def test_epochs_take_prefixes(docs, empty, clashing):
    out = mixing.mix(docs).collect()
    assert len(out) == len(ROWS)
    for leaf in {(r.domain, r.lang, r.source) for r in out}:
        rows = [r for r in out if (r.domain, r.lang, r.source) == leaf]
        assert max(r.epochs for r in rows) - min(r.epochs for r in rows) <= 1
        assert max(r.epochs for r in rows) <= mixing.MAX_EPOCHS + 1
        first = [r for r in rows if r.epochs == max(x.epochs for x in rows)]
        if len(first) < len(rows):
            whole = min(r.epochs for r in rows)
            key = lambda r: hashlib.md5(f"{mixing.SEED}:{whole}:{r.doc_id}".encode()).hexdigest()  # noqa: E731, B023
            assert max(map(key, first)) < min(key(r) for r in rows if r not in first)
    assert mixing.mix(empty).count() == 0
    assert table(mixing.mix(clashing)) == table(mixing.mix(docs))
    chosen = mixing.select_documents(clashing, budget_percent=90)
    assert chosen.columns == clashing.columns
    assert set(table(chosen)) < set(table(clashing))
    assert mixing.select_documents(docs, budget_percent=100).count() == len(ROWS)


def test_ranges_do_not_change_the_prefix(docs, monkeypatch):
    want = table(mixing.mix(docs))
    for digits in (1, 2):
        monkeypatch.setattr(mixing, "RANGE_DIGITS", digits)
        assert table(mixing.mix(docs)) == want
