"""Training, rules and bounds of the corpus operators against plain versions of themselves."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from pluvia.llm import charlm, decontaminate, hmm, language_id, quality, simhash, token_files
from pluvia.llm.common import stored
from pluvia.llm.textarrays import raw_bytes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(r.randint(0, 30)) for _ in range(n))


def frame(spark, rows):
    return stored(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(3))


# --- one row of each group -------------------------------------------------------------------


def test_one_row_of_each_group_stays(spark):
    a, b, c = (prose(k, 60) for k in (1, 2, 3))
    rows = [(1, a), (5, a), (5, b), (None, c), (None, c), (7, prose(4, 60)), (7, prose(4, 60)), (None, a)]
    kept = Counter((r.doc_id, r.text) for r in simhash.keep_first(frame(spark, rows)).collect())
    assert kept == Counter({(1, a): 1, (5, b): 1, (None, c): 1, (7, prose(4, 60)): 1})
    clash = frame(spark, rows).withColumn("_row0", F.lit("x"))
    assert simhash.keep_first(clash).columns[-1] == "_row0" and simhash.keep_first(clash).count() == 4


# --- token files -----------------------------------------------------------------------------


def test_re_pair_goes_on_until_nothing_repeats():
    one = np.random.RandomState(0).randint(0, 50_000, 4000).astype(np.uint32)
    seq, at, rules, base = token_files.re_pair(np.tile(one, 500), np.arange(501) * 4000)
    assert len(seq) == 500
    shard = token_files.Shard(token_files.pack_shard(np.tile(one, 500), np.arange(501) * 4000))
    assert (shard.document(321) == one).all() and shard.token(321 * 4000 + 17) == one[17]
    text = np.random.RandomState(1).zipf(1.3, 60_000).astype(np.uint32) % 3000
    seq, at, rules, base = token_files.re_pair(text, np.array([0, 60_000]))
    pairs = Counter()
    last = None
    for pair in zip(seq[:-1].tolist(), seq[1:].tolist(), strict=True):
        last = None if pair == last else pair  # pairs that overlap count once
        if last:
            pairs[pair] += 1
    assert max(pairs.values()) < token_files.MIN_USES


def test_repeated_and_missing_ids_are_dealt_over_all_ranges(spark):
    rows = frame(spark, [(None, "same words again")] * 400 + [(3, "x y")] * 200)
    shards = token_files.write_shards(rows, token_files.default_path(), partitions=8)
    assert shards.select("part").distinct().count() == 8
    assert token_files.read_documents(shards).count() == 600


def test_each_distinct_part_is_encoded_once_in_a_block(monkeypatch):
    texts = [prose(k % 40, 300) + f"\nnumber {k % 7}, it's" for k in range(400)] + ["", None, "<|endoftext|>", "a  b"]
    t = token_files.Tokenizer(token_files.default_path())
    want = [[*(t._direct(text or "")), 2] for text in texts]
    calls, model = Counter(), t.model

    class Counting:
        def tokenize(self, part):
            calls[part] += 1
            return model.tokenize(part)

    t.model = Counting()
    ids, offs = t.encode_all(pa.array(texts), 2)
    assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)] == want
    assert len(calls) > 50 and set(calls.values()) == {1}
    monkeypatch.setattr(token_files, "TEXTS_AT_ONCE", 7)
    monkeypatch.setattr(token_files, "WORDS_AT_ONCE", 1000)
    ids, offs = t.encode_all(pa.array(texts).slice(5).slice(390), 2)
    assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)] == want[395:]
    assert t.encode_all([], 2)[0].tolist() == []


def test_written_out_pattern_cuts_like_the_tokenizers_own():
    rng = random.Random(4)
    some = " \n'stredvml09²½ªßé,.;«" + "".join(chr(c) for c in range(0x100, 0x250, 7))
    for _ in range(300):
        text = "".join(rng.choice(some) for _ in range(60))
        own = regex.findall(public_tokenizers.PATTERN, text)
        assert token_files._plain_pattern(public_tokenizers.PATTERN).findall(text) == own


def test_small_batches_share_a_block(monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_BYTES", 100)
    batches = [pa.record_batch({"doc_id": [k, None], "text": ["x" * 9, None]}) for k in range(25)]
    batches.append(pa.record_batch({"doc_id": [25], "text": ["y" * 250]}))
    blocks = list(token_files._blocks(batches))
    assert [b.num_rows for b in blocks] == [22, 22, 6, 1]
    assert [i for b in blocks for i in b.column("doc_id").to_pylist() if i is not None] == list(range(26))


# --- quality ---------------------------------------------------------------------------------


def test_a_costly_rule_costs_more(spark):
    docs = frame(spark, [(k, prose(k, 300)) for k in range(300)])
    rules = [
        quality.Rule("nothing", "false"),
        quality.Rule("costly", "length(" + "regexp_replace(" * 6 + "text" + ", '[a-z]+([0-9])', '$1x')" * 6 + ") < 0"),
        quality.Rule("cheap", "n_words < 0"),
    ]
    for _ in range(3):
        seconds, masks = quality.measure_rules(quality.base_columns_cheap(docs), rules)
        assert seconds[1] > 5 * max(seconds[0], seconds[2])
        assert masks == [(0, 300)]


# --- letters and n-grams ---------------------------------------------------------------------


def test_symbols_of_all_planes_are_no_letters(spark):
    docs = frame(spark, [(k, prose(k, 40)) for k in range(40)])
    model = language_id.fit(docs)
    odd = frame(spark, [(1, "😀😀 🚀"), (2, "𝄞 12"), (3, "𐐀𐐁 word")])
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(odd, model).collect()}
    assert got[1] == got[2] == ("und", 0.0) and got[3][0] == "en"


def test_every_character_keeps_its_place():
    assert charlm.fitting_order(73, 7) == 7 and charlm.fitting_order(255, 7) == 6 and charlm.fitting_order(20_000, 7) == 4
    chars = np.array([0x20, *range(0x4E00, 0x4E00 + 5000), 0x20000, 0x20001])
    order = charlm.fitting_order(len(chars), 7)
    table = charlm.alphabet_table(chars, order)
    assert len(set(table[chars].tolist())) == len(chars) and order == 4
    with pytest.raises(ValueError):
        charlm.alphabet_table(chars, 7)
    one, two = (charlm.row_grams(*raw_bytes(pa.array([t])), table, order)[0] for t in ("\U00020000a", "\U00020001a"))
    assert (one != two).any()


@pytest.mark.parametrize("order", [2, 3])
def test_kneser_ney_values(order):
    texts = ["abc abca abd", "bacab b cab", "ab ab abc"]
    chars = sorted({c for t in texts for c in t})
    table = charlm.alphabet_table(np.array([ord(c) for c in chars]), order)
    grams, _, _ = charlm.row_grams(*raw_bytes(pa.array(texts)), table, order)
    levels = charlm.kneser_ney([np.unique(grams, return_counts=True)], order, len(chars))
    bits = 60 // order
    unpacked = [tuple((int(g) >> bits * (order - 1 - k)) & ((1 << bits) - 1) for k in range(order)) for g in grams]
    counts = {order: Counter(unpacked)}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def cut(k):
        n1, n2 = (sum(n == x for n in counts[k].values()) for x in (1, 2))
        return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    def p(g):
        k = len(g)
        if not k:
            return 1 / (len(chars) + 1)
        same = {x: n for x, n in counts[k].items() if x[:-1] == g[:-1]}
        total = sum(same.values())
        if not total:
            return p(g[1:])
        d = cut(k)
        rest = sum(min(n, d) for n in same.values()) / total
        return max(counts[k][g] - d, 0) / total + rest * p(g[1:])

    for k, level in enumerate(levels, 1):
        for g, value in zip(level.grams.tolist(), level.p[:, 0].tolist(), strict=True):
            own = tuple((g >> bits * (k - 1 - j)) & ((1 << bits) - 1) for j in range(k))
            assert value == pytest.approx(p(own))


# --- decontamination -------------------------------------------------------------------------


def test_items_with_one_preamble_need_little_memory():
    preamble = "choose the right answer to the following question and write down its letter only "
    items = [preamble + prose(k, 30) for k in range(5000)]
    block = decontaminate.make_block(list(range(5000)), items)
    text = " ".join(preamble + prose(10_000 + k, 2) for k in range(100)) + " " + items[4321]
    data, offs = raw_bytes(pa.array([text]))
    tracemalloc.start()
    found = decontaminate.find_items(data, offs, block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(0, 4321, 0)] and peak < 500e6


def test_a_very_long_item():
    r = random.Random(1)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(3000)]
    item = " ".join(words)
    assert len(item) > 20_000
    block = decontaminate.make_block([7], [item])
    for k in range(0, len(words), 50):
        words[k] = "x" + words[k][1:]
    texts = [item, "before " + " ".join(words) + " after", prose(2, 4000), "short " + item[:500]]
    data, offs = raw_bytes(pa.array(texts))
    assert [(row, k) for row, k, _ in decontaminate.find_items(data, offs, block)] == [(0, 7), (1, 7)]


# --- hidden Markov model ---------------------------------------------------------------------


def plain_hmm(train, texts, states, iterations):
    """Baum-Welch over whole texts with one table of all words."""
    tokens = lambda t: [*(t or "").lower().split(), None]
    seqs = [tokens(t) for t in train]
    c = Counter(w for s in seqs for w in s)
    vocabulary, mass = [*c, "?"], sum(c.values()) + len(c) + 1.0

    def noise(w):
        h = np.zeros(1, np.uint64) if w is None else hmm.piece_words(*raw_bytes(pa.array([w])))[0]
        return hmm.noise(h, states)[0]

    emit = {w: (c[w] + 1) * noise(w) for w in c} | {"?": np.ones(states)}
    uni = {w: (c[w] + 1) / mass for w in vocabulary}
    start, move = np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    total = sum(emit.values())

    def run(s):
        e = np.array([emit.get(w, emit["?"]) / total for w in s])
        a, scale = np.zeros(e.shape), np.zeros(len(s))
        for t in range(len(s)):
            a[t] = (start if t == 0 else a[t - 1] @ move) * e[t]
            scale[t] = a[t].sum()
            a[t] /= scale[t]
        return e, a, scale

    for _ in range(iterations):
        n_start, n_move, n_emit = np.zeros(states), np.zeros((states, states)), {w: np.zeros(states) for w in vocabulary}
        for s in seqs:
            e, a, scale = run(s)
            b = np.ones(states)
            for t in range(len(s) - 1, -1, -1):
                n_emit[s[t]] += a[t] * b
                if t:
                    n_move += np.outer(a[t - 1], e[t] * b / scale[t]) * move
                    b = move @ (e[t] * b / scale[t])
                else:
                    n_start += a[t] * b
        start = (n_start + 1) / (n_start + 1).sum()
        move = n_move + 1 / states
        move /= move.sum(1, keepdims=True)
        share = sum(n_emit.values()) + 1e-9
        share /= share.sum()
        emit = {w: n_emit[w] + share + hmm.SMOOTHING * uni[w] for w in vocabulary}
        total = sum(emit.values())
    return [np.log10(run(tokens(t))[2]).sum() for t in texts]


@pytest.mark.parametrize("head", [1, 1000])
def test_training_over_chunks_equals_plain_baum_welch(spark, monkeypatch, head):
    monkeypatch.setattr(hmm, "RUN_TOKENS", 60)
    monkeypatch.setattr(hmm, "RANGE_TOKENS", 40)
    monkeypatch.setattr(hmm, "PART_TOKENS", 25)
    texts = [prose(k, 5 + 7 * k % 40) for k in range(12)] + ["", None]
    train, more = texts[:9] + texts[12:], [*texts, "words nobody has seen"]
    fitted = hmm.fit(frame(spark, list(enumerate(train))), states=3, head=head, iterations=-6)
    assert head > 1 or fitted[1].ranges > 3
    got = {r.doc_id: r.score for r in hmm.score(frame(spark, list(enumerate(more))), *fitted).collect()}
    want = plain_hmm(train, more, 3, hmm.FIRST_ITERATIONS - 6)
    assert [got[k] for k in range(len(more))] == pytest.approx(want, rel=1e-5)
    assert not math.isnan(sum(want))


def test_sequences_in_parts_count_like_all_together(monkeypatch):
    rng = np.random.RandomState(3)
    model = hmm.Hmm(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(20), 3).T)
    sizes = np.array([1, 7, 40, 3, 1, 12, 90, 2])
    symbols = rng.randint(0, 20, sizes.sum()).astype(np.int32)
    whole = hmm.Packed(symbols, sizes)
    want, logs = hmm.expected_counts(model, whole), hmm.forward(model, whole)
    monkeypatch.setattr(hmm, "PART_TOKENS", 25)
    parts = list(hmm.packs(symbols, sizes))
    assert [len(p.symbols) for _, p in parts] == [8, 40, 16, 90, 2]
    assert np.concatenate([hmm.forward(model, p) for _, p in parts]) == pytest.approx(logs)
    for k, total in enumerate(want):
        assert sum(hmm.expected_counts(model, p)[k] for _, p in parts) == pytest.approx(total)


@pytest.mark.parametrize("least", [0.3, 1e-4, 1e-13])
def test_counts_of_seldom_scaled_recursions(least):
    rng = np.random.RandomState(4)
    k, sizes = 3, np.array([1, 30, 9, 64, 2])
    emit = rng.dirichlet(np.ones(12), k).T
    emit[:6, 0], emit[6:, 1] = emit[:6, 0] * least, emit[6:, 1] * least
    move = np.full((k, k), least / 2) + np.diag(np.full(k, 1 - 3 * least / 2))
    model = hmm.Hmm(rng.dirichlet(np.ones(k)), move, emit)
    x = hmm.Packed(rng.randint(0, 12, sizes.sum()).astype(np.int32), sizes)
    want = hmm.expected_counts(model, x)
    start, moves, found = np.zeros(k), np.zeros((k, k)), np.zeros((k, 12))
    hmm.add_counts(model, hmm.relative(emit, np.float32), x, start, moves, found)
    for a, b in zip((start, moves, found.T), want, strict=True):
        assert a == pytest.approx(b, rel=1e-3, abs=1e-4)
    assert start.sum() == pytest.approx(len(sizes)) and found.sum() == pytest.approx(sizes.sum(), rel=1e-5)


def test_chunks_hold_their_longest_texts_first(spark):
    texts = ["a b", "a b c d", None, "c", "b c d a b"]
    rows = frame(spark, list(enumerate(texts))).coalesce(1)
    words = hmm.vocabulary(spark.createDataFrame([(1, 2), (2, 3)], "w long, n long"), 5, 1)
    chunk = hmm._chunks(rows, words)[0].first()
    assert chunk.ids == [4, 1, 0, 3, 2] and chunk.sizes == [6, 5, 3, 2, 1]


def test_chunks_hold_symbols_as_the_recursions_take_them(spark, monkeypatch):
    monkeypatch.setattr(hmm, "PART_TOKENS", 9)
    texts = ["a b", "a b c d", None, "c", "b c d a b"]
    rows = frame(spark, list(enumerate(texts))).coalesce(1)
    words = hmm.vocabulary(spark.createDataFrame([(1, 2), (2, 3)], "w long, n long"), 5, 1)
    chunk = hmm._chunks(rows, words)[0].first().asDict()
    rare = {w: words.rare + 2 + k for k, w in enumerate(sorted("abcd", key=lambda w: hmm.piece_words(*raw_bytes(pa.array([w])))[0][0]))}
    symbols = np.array([rare.get(w, words.rare + 1) for k in chunk["ids"] for w in [*(texts[k] or "").split(), None]], np.int32)
    want = list(hmm.packs(symbols, np.array(chunk["sizes"])))
    got = list(hmm._laid(chunk))
    assert len(got) == len(want) > 1
    for (a, x), (b, y) in zip(got, want, strict=True):
        assert a == b and x.symbols.tolist() == y.symbols.tolist() and x.spans == y.spans
        assert x.added(np.ones(len(x.symbols), int)).tolist() == chunk["sizes"][a]


def test_likelihoods_of_seldom_scaled_steps():
    rng = np.random.RandomState(6)
    sizes = np.array([1, 30, 8, 64, 2, 16, 7, 9])
    model = hmm.Hmm(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(12), 3).T * 1e-13)
    x = hmm.Packed(rng.randint(0, 12, sizes.sum()).astype(np.int32), sizes)
    got = hmm.forward(model, x)
    assert np.isfinite(got).all() and got == pytest.approx(hmm.forward(model, x, every=1), rel=1e-12)


def test_numbering_pieces_takes_little_memory():
    words = prose(1, 3000).split()
    texts = pa.array([" ".join(words[k % 100 : k % 100 + 400]) for k in range(4000)], pa.large_string())
    tokenizer = token_files.Tokenizer(token_files.default_path())
    usual = pa.default_memory_pool()
    pool = pa.proxy_memory_pool(usual)
    pa.set_memory_pool(pool)
    try:
        ids, offs = tokenizer.encode_all(texts, 2)
    finally:
        pa.set_memory_pool(usual)
    assert len(offs) == 4001 and len(ids) == offs[-1]
    assert pool.max_memory() < 2.5 * texts.nbytes
