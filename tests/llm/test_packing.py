import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from glossweave.llm import packing
from glossweave.llm.packing import Packer, deal, difference, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.lists(st.integers(1, 60), max_size=40), st.integers(1, 7))
@settings(max_examples=60, deadline=None)
def test_difference_is_a_partition(lengths, k):
    assert sorted(i for s in difference(lengths, k) for i in s) == list(range(len(lengths)))
    sets = deal(lengths, 64)
    assert sorted(i for s in sets for i in s) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in s) <= 64 for s in sets)


def test_difference_is_even():
    sums = [sum(x) for x in ([[8, 7, 6, 5, 4][i] for i in s] for s in difference([8, 7, 6, 5, 4], 2))]
    assert sorted(sums) == [14, 16]  # the known result of differencing


@given(st.lists(st.integers(1, 900), max_size=60))
@settings(max_examples=60, deadline=None)
def test_each_id_once_and_no_gap(tokens):
    p = Packer(128, 4, 40, 2)
    rows = [x for i, n in enumerate(tokens) for x in p.add(i, n)] + list(p.end())
    docs, seqs = defaultdict(list), defaultdict(list)
    for doc, start, n, q, offset, size in rows:
        docs[doc].append((start, n))
        seqs[q].append((offset, n, size))
    for i, n in enumerate(tokens):
        at = 0
        for start, m in sorted(docs[i]):
            assert start == at and m > 0
            at += m
        assert at == n
    for parts in seqs.values():
        at = 0
        for offset, m, size in sorted(parts):
            assert offset == at
            at += m
        assert at == size <= 128


@pytest.mark.parametrize("partitions", [1, 16])
def test_windows_come_from_differencing(partitions, monkeypatch):
    """All windows of several pieces, but what is less than a window at the end."""
    r = random.Random(partitions)
    tokens = [int(r.lognormvariate(5.5, 1.2)) + 1 for _ in range(3200)]
    dealt, last, total = 0, 0, 0
    for p in range(partitions):
        packer, sets = Packer(), []
        monkeypatch.setattr(packing, "difference", lambda n, k: sets.extend(x := difference(n, k)) or x)
        rows = [x for i, n in enumerate(tokens[p::partitions]) for x in packer.add(i, n)] + list(packer.end())
        seqs = defaultdict(list)
        for doc, start, n, q, offset, size in rows:
            seqs[q].append((doc, start, n))
        found = {len(s) for s in sets}
        several = [q for q, x in seqs.items() if sum(n for _, _, n in x) > 1024 and x[0][2] < 2048]
        assert all(len(seqs[q]) in found for q in several)
        dealt += len(several)
        small = [sum(n for _, _, n in x) for q, x in seqs.items() if q not in several and x[0][2] < 2048]
        assert len(small) <= 11
        last += sum(small)
        total += sum(tokens[p::partitions])
        assert sum(2048 - sum(n for _, _, n in seqs[q]) for q in several) < 0.02 * 2048 * len(several)
    assert dealt > 250 / 2
    assert last < 0.02 * total * max(1, partitions / 4)


def test_documents_are_cut_only_for_balance():
    r = random.Random(7)
    tokens = [r.randint(1, 2000) for _ in range(2000)]
    packer = Packer()
    rows = [x for i, n in enumerate(tokens) for x in packer.add(i, n)] + list(packer.end())
    pieces = Counter(x[0] for x in rows)
    assert sum(pieces[i] == 1 for i, n in enumerate(tokens) if n <= 512) > 0.5 * sum(n <= 512 for n in tokens)
    assert sum(pieces[i] == 1 for i, n in enumerate(tokens) if n <= 320) > 0.9 * sum(n <= 320 for n in tokens)


def test_pack_whole_texts(spark):
    tok = Tokenizer.from_file(PATH)
    texts = {1: "Hello world, this is a test.", 2: "", 3: None, 4: "long text with words " * 3000, 5: "Hello world, this is a test.", None: "nothing"}
    df = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id long, text string, length string").coalesce(1)
    rows = pack(df, PATH).collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(texts)
    for k, own in pieces.items():
        ids = np.array([*tok.encode(texts[k] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert pack(df.where("false"), PATH).collect() == []


def test_little_padding(spark):
    df = spark.createDataFrame([(i, "some words of a text, repeated " * (1 + i * 37 % 90)) for i in range(3000)], "doc_id long, text string").coalesce(1)
    seqs = {r.sequence_id: r.sequence_length for r in pack(df, PATH).collect()}
    assert sum(2048 - n for n in seqs.values() if n & (n - 1)) < 0.01 * sum(seqs.values())
