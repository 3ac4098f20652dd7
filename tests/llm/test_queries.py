"""The queries themselves, over their whole tables, against brute force."""

import os
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from glossweave.llm.html_blocks import blocks
from glossweave.llm.queries import QUERIES
from tests.llm import test_decontam, test_linededup, test_neardup, test_pii, test_quality
from tests.oracle import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.001"), reason="no tables")
SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def encoded(name, texts, end):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    return {k: np.array([*tok.encode(t, add_special_tokens=False).ids, end], "<u4") for k, t in texts.items()}


def test_packed(spark, documents):
    ids, pieces, windows = encoded("word_bpe_49k.json", documents, 1), defaultdict(list), defaultdict(list)
    for r in QUERIES["op1_packing"](spark, SF).collect():
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        windows[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for k, own in pieces.items():
        at = 0
        for start, n, crc, total in sorted(own):
            assert (start, total, crc) == (at, len(ids[k]), zlib.crc32(ids[k][at : at + n].tobytes()))
            at += n
        assert at == len(ids[k])
    used = []
    for own in windows.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at and n > 0
            at += n
        used.append(at)
    assert max(used) <= 2048
    padding = sum(2048 - n for n in used if n & (n - 1))
    assert padding < 0.02 * sum(used)


def test_personal_data(spark, documents):
    got = {r.doc_id: r for r in QUERIES["op2_pii"](spark, SF).collect()}
    assert set(got) == set(documents)
    for k, t in documents.items():
        base, r = test_pii.base(t), got[k]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[3] == x for s in base) for x in test_pii.PATTERNS]
        assert r.base_sha256 == test_pii.hashlib.sha256(test_pii.shown(base).encode()).hexdigest()
        assert {x for x in test_pii.shown(base).split(",") if x} <= set(r.spans.split(","))


def test_token_files(spark, documents):
    ids, start = encoded("byte_bpe_50k.json", documents, 2), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op5_token_files"](spark, SF).collect()}
    for k in sorted(ids):
        assert got.pop(k) == (start, len(ids[k]), zlib.crc32(ids[k].tobytes()))
        start += len(ids[k])
    assert not got


def test_quality_counts(spark, documents):
    got = {r.doc_id: r for r in QUERIES["op7_quality"](spark, SF).collect()}
    assert set(got) == set(documents)
    for k, t in documents.items():
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == test_quality.brute(t)
        assert not (r.kept and r.base_failed)


def test_extraction(spark):
    pages = {(r.page_id, r.url): r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {(r.page_id, r.url): r for r in QUERIES["op9_html_extraction"](spark, SF).collect()}
    assert set(got) == set(pages)
    for k, r in got.items():
        rest = iter([b.text for b in blocks(pages[k])])
        assert all(any(t == x for x in rest) for t in r.text.split("\n") if t), "blocks in page order"
        assert r.n_chars == len(r.text)
    assert sum(bool(r.text) for r in got.values()) > 0.9 * len(got)


def test_pipeline(spark, documents):
    """What each stage keeps of what the one before kept, by brute force from the third stage's input on."""
    import corpus_pipeline

    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs, kept = table, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), table.schema)
        kept.append({r.doc_id: r.text for r in docs.collect()})
        assert docs.columns == table.columns, name
    verdicts = {r.doc_id: r.kept for r in QUERIES["op7_quality"](spark, SF).collect()}
    assert set(kept[0]) == {k for k, v in verdicts.items() if v}
    assert all(kept[0][k] == documents[k] for k in kept[0])
    lines = {k: d for k, _, _, d in test_linededup.brute(list(kept[0].items()))}
    assert {k: test_pii.hashlib.sha256((t or "").encode()).hexdigest() for k, t in kept[1].items()} == lines
    groups = test_neardup.brute(list(kept[1].items()), 80)
    assert set(kept[2]) == {d for d, _, c in groups if d == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    passages = {tuple(w[i : i + 13]) for _, t in items if len(w := test_decontam.words(t)) >= 13 for i in range(len(w) - 12)}
    short = {tuple(w) for _, t in items if 0 < len(w := test_decontam.words(t)) < 13}

    def contaminated(text):
        w, hit = test_decontam.words(text), set()
        for n, held in [(13, passages), *((len(s), {s}) for s in short)]:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in held:
                    hit |= set(range(i, i + n))
        return bool(hit) and 20 * len(hit) >= len(w)

    assert set(kept[3]) == {k for k, t in kept[2].items() if not contaminated(t)}
    packed = defaultdict(int)
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect():
        packed[r.doc_id] += r.length
    assert {k: len(v) for k, v in encoded("word_bpe_49k.json", {k: t or "" for k, t in kept[3].items()}, 1).items()} == dict(packed)


def test_pipeline_with_odd_rows(spark):
    """Nulls, empty texts, repeated rows, shared and null doc_ids, clashing columns, and an empty table."""
    import corpus_pipeline

    text = test_quality.prose(8)
    rows = [(1, text[0]), (2, text[0]), (None, text[1]), (None, text[2]), (4, text[3]), (4, text[4]), (6, text[5]), (6, text[5]), (7, None), (8, ""), (9, "short")]
    df = spark.createDataFrame([(*r, "en", 7, "h", "x") for r in rows], "doc_id long, text string, lang string, k long, h string, n_hit string")
    for docs, expected in ((df, {(1, text[0]), (None, text[1]), (None, text[2]), (4, text[3]), (4, text[4]), (6, text[5])}), (df.where("false"), set())):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == df.columns
        assert sorted(((r.doc_id, r.text, r.k, r.h, r.n_hit) for r in docs.collect()), key=str) == sorted(((*e, 7, "h", "x") for e in expected), key=str)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == len({e[0] for e in expected})
