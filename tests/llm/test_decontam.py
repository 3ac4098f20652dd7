import hashlib
import random
import re

import pytest

from glossweave.llm import decontam


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(text, items, size):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        n = min(size, len(b))
        for i in range(len(b) - n + 1) if b else ():
            for j in range(len(w) - n + 1):
                if w[j : j + n] == b[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add("" if item is None else str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("limit", [500_000, 0])
def test_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", limit)
    r = random.Random(4)
    text = lambda n: " ".join(r.choice(["A", "b", "Éa", "c-d", "e1", "ß", "the", "THE"]) for _ in range(n))
    items = [(10 + i, text(r.randint(1, 9))) for i in range(8)] + [(2, None), (3, " ,. "), (4, "one"), (None, "rare word pair"), (5, "rare word pair")]
    docs = [(i, text(r.randint(0, 40))) for i in range(40)] + [(7, None), (None, "a rare word pair"), (3, ""), (3, "b b b"), (3, "b b b"), (99, "one " * 3000)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, win string, n long")
    b = spark.createDataFrame([(*d, "x") for d in items], "item_id long, text string, word string")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.report(df, b, 4).collect())
    assert got == sorted((k is not None, k or 0, *brute(t, items, 4)) for k, t in docs)
    kept = decontam.cleaned(df, b, 4)
    assert kept.columns == df.columns
    assert kept.count() == sum(not brute(t, items, 4)[-1] for _, t in docs)
    assert decontam.report(df, b.where("false"), 4).where("n_hit > 0 or contaminated").count() == 0
    assert decontam.report(df.where("false"), b, 4).count() == 0


def test_own_columns_stay(spark):
    names = "doc_id long, text string, __k string, __c string, found string, k string, H string, n_hit string, hits string"
    df = spark.createDataFrame([(1, "one two three", *"abcdefg"), (2, "clean text of other words", *"abcdefg")], names)
    b = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert [tuple(r) for r in decontam.cleaned(df, b).collect()] == [(2, "clean text of other words", *"abcdefg")]
    m, _, added = decontam.matched(df, b)
    assert added == ["n_words", "n_hit_", "hits_", "contaminated"]
    assert m.columns == [*df.columns, *added]


def test_a_window_in_many_items_and_documents(spark):
    docs = spark.createDataFrame([(i, f"u{i} v{i} some shared words of a passage x{i}") for i in range(600)], "doc_id long, text string")
    b = spark.createDataFrame([(i, "some shared words of a passage") for i in range(50)], "item_id long, text string")
    got = decontam.report(docs, b).collect()
    assert {(r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got} == {(9, 6, 50, True)}
    assert len(got) == 600
