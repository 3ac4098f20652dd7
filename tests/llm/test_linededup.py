import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from glossweave.llm import linededup
from glossweave.llm.cuckoo import Cuckoo
from glossweave.llm.linededup import LineIndex, deduped, report
from glossweave.llm.mph import mix

LOW = {i: i + 32 for i in range(65, 91)}


def brute(rows):
    held = defaultdict(list)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    rank = lambda d: -(1 << 63) if d is None else d
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held[k].append(rank(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 20 and len(held[key(x)]) >= 3 and rank(d) != max(held[key(x)]))]
        out.append((rank(d), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def rows_of(seed, n=60, first=0):
    r = random.Random(seed)
    pool = [f"a line that repeats, number {i} é" for i in range(12)] + ["short", "", "  ", "é" * 19, "é" * 20, "\tA Line That Repeats, Number 1 é \r"]
    return [(first + i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 6)))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*x, "x", 1) for x in rows], "doc_id long, text string, key string, k1 long")


def got(df):
    return sorted((r.doc_id if r.doc_id is not None else -(1 << 63), r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("few", [250_000, 3])
def test_equals_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(linededup, "SLICE_KEYS", few)
    line = "a line that repeats, number 3 é"
    rows = rows_of(1) + [(None, line), (None, None), (7000, line + "\n" + line), (7000, line), (7001, "x" * 300000)]
    assert got(report(frame(spark, rows))) == brute(rows)
    assert got(report(frame(spark, rows).where("false"))) == []
    assert deduped(frame(spark, rows)).columns == ["doc_id", "text", "key", "k1", "n_lines", "n_dropped"]


def test_insertions_and_deletions_are_reversible(spark):
    a, b, c = rows_of(2), rows_of(3, 40, 100), rows_of(4, 30, 200)
    index = LineIndex(spark).insert(frame(spark, a)).insert(frame(spark, b)).insert(frame(spark, c))
    digest = lambda rows, i: sorted((r[0], r[4], r[5], hashlib.sha256(r[1].encode()).hexdigest()) for r in i.apply(frame(spark, rows)).collect())
    assert digest(a + b + c, index) == brute(a + b + c)
    index.delete(frame(spark, c))
    assert digest(a + b, index) == brute(a + b)
    index.delete(frame(spark, b)).insert(frame(spark, c))
    assert digest(a + c, index) == brute(a + c)


@pytest.mark.parametrize("few", [250_000, 3])
def test_filters_are_probed_at_any_size(spark, monkeypatch, few):
    monkeypatch.setattr(linededup, "SLICE_KEYS", few)
    rows = rows_of(5)
    index = LineIndex(spark).insert(frame(spark, rows))
    assert index.dropped(index.postings).count() > 0
    index.filters = index.filters.where("false")
    assert index.dropped(index.postings).count() == 0


def test_own_columns_stay(spark):
    line = "a line that repeats, number 3"
    df = spark.createDataFrame([(i, line, "own", "mine", "keys", 7) for i in range(4)], "doc_id long, text string, n_lines string, N_Dropped string, doc string, drop long")
    got = deduped(df)
    assert got.columns == [*df.columns, "n_lines_", "n_dropped_"]
    assert {(r.doc_id, r.text, r.n_lines, r.doc, r.drop, r.n_lines_, r.n_dropped_) for r in got.collect()} == {(i, line if i == 3 else "", "own", "keys", 7, 1, int(i < 3)) for i in range(4)}


def test_a_line_of_most_documents_is_broadcast(spark):
    line, other = "a line that every document has", "another line that a few documents have"
    rows = [(i, f"{line}\n{i}" + (f"\n{other}" if i % 500 == 0 else "")) for i in range(3000)]
    assert got(report(frame(spark, rows))) == brute(rows)


def test_cuckoo():
    keys = mix(np.arange(3000, dtype=np.uint64))
    f = Cuckoo.of(keys)
    assert f.has(keys).all()
    for k in keys[:1500]:
        assert f.delete(k)
    again = Cuckoo.read(f.write())
    assert again.has(keys[1500:]).all()
    assert again.has(keys[:1500]).mean() < 0.01
    assert again.has(mix(np.arange(10**6, 10**6 + 20000, dtype=np.uint64))).mean() < 0.002
