"""The pipeline, stage by stage, against plain versions on the smallest tables."""

import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pluvia.llm import decontaminate, language_id, mixing, token_files
from pluvia.llm.common import stored, table
from tests.llm.test_corpus import edits, normal, plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def plain_language(spark, rows):
    docs = table(spark, SF, "documents")
    found = language_id.identify(docs, language_id.fit(docs)).collect()
    bad = {r.doc_id for r in found if r.rejected}
    return [r for r in rows if r[0] not in bad]


def plain_duplicates(spark, rows):
    prints = {r[0]: plain_fingerprint(r[1]) for r in rows}
    near = [(a, b) for a in prints for b in prints if (prints[a] ^ prints[b]).bit_count() <= 3]
    root = plain_components(near)
    return [r for r in rows if root[r[0]] == r[0]]


def plain_benchmark(spark, rows):
    items = [normal(r.text) for r in table(spark, SF, "benchmark").collect()]
    items = [i for i in items if len(i) >= decontaminate.MIN_ITEM_CHARS]

    def holds(text):
        text = normal(text or "")
        # Without one of the item's k + 1 parts intact there are more than k edits.
        for item in items:
            k = int(decontaminate.EDIT_RATE * len(item))
            cut = np.linspace(0, len(item), k + 2).astype(int)
            if any(item[a:b] in text for a, b in zip(cut[:-1], cut[1:], strict=True)):
                for m in re.finditer("|".join(re.escape(item[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)), text):
                    part = text[max(0, m.start() - len(item) - k) : m.end() + len(item) + k]
                    if len(set(zip(part, part[1:])) & set(zip(item, item[1:]))) > 0.5 * len(set(zip(item, item[1:]))):
                        if edits(item, part) <= k:
                            return True
        return False

    exact = [r for r in rows if any(i in normal(r[1] or "") for i in items)]
    gone = {r[0] for r in exact}
    rng = np.random.RandomState(0)
    some = [r for r in rows if r[0] not in gone and len(r[1] or "") < 3000]
    for k in rng.permutation(len(some))[:5]:
        assert not holds(some[k][1])
    return [r for r in rows if r[0] not in gone]


def plain_mixing(spark, rows):
    con = duckdb.connect()
    cols = list(zip(*rows, strict=True))
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    con.register("documents", pa.table({n: list(c) for n, c in zip(names, cols, strict=True)}))
    sql = mixing.mixing_sql(percent=corpus_pipeline.MIXED_PERCENT, epochs=1)
    kept = {r[0] for r in con.execute(f"WITH {sql} SELECT doc_id FROM mixed WHERE epochs > 0").fetchall()}
    return [r for r in rows if r[0] in kept]


def plain_tokens(spark, rows):
    encode = Tokenizer.from_file(token_files.default_path()).encode
    out, start = [], 0
    for r in sorted(rows):
        ids = np.array([*encode(r[1] or "", add_special_tokens=False).ids, token_files.END_ID], "<u4")
        out.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


PLAIN = [plain_language, plain_duplicates, plain_benchmark, plain_mixing, plain_tokens]


def test_stages_equal_plain_versions(spark):
    docs = table(spark, SF, "documents")
    rows = sorted(tuple(r) for r in docs.collect())
    fields = docs.columns
    for (name, stage), plain in zip(corpus_pipeline.STAGES, PLAIN, strict=True):
        docs = stored(stage(spark, docs, SF))
        rows = plain(spark, rows)
        assert sorted(tuple(r) for r in docs.collect()) == sorted(rows), name
        if name != "tokens":
            assert docs.columns == fields
    assert [tuple(r) for r in corpus_pipeline.run(spark, SF).orderBy("doc_id").collect()] == rows
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_an_empty_table(spark, name):
    docs = stored(table(spark, SF, "documents").where("false"))
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, SF).count() == 0
