"""Queries that return all rows of their operator, on small made tables."""

import math
from collections import Counter

from glossweave.operators import dictionary
from glossweave.queries import QUERIES


def documents(spark, tmp_path, texts):
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_word_freq_doc_has_every_document(spark, tmp_path):
    d = documents(spark, tmp_path, [f"a b, a.\nc{i % 3} a" for i in range(30)])
    got = {(r.document, r.word): (r.frequency, r.collection, r.doc_len, r.idf) for r in QUERIES["word_freq_doc"](spark, d).collect()}
    df = {"a": 30, "b": 30, "c0": 10, "c1": 10, "c2": 10}
    assert got == {(str(i), w): (3 if w == "a" else 1, "s", 5, round(math.log10(31 / df[w]), 9)) for i in range(30) for w in ("a", "b", f"c{i % 3}")}


def test_training_rows_scores_every_pair(spark, tmp_path):
    texts = ["éñéñ aéñ", "ñé\nüüü", "不ü éñ"]
    kept = ["".join(c for c in line if ord(c) > 128) for t in texts for line in t.split("\n")]
    chars, pairs = Counter("".join(kept)), Counter(s[i : i + 2] for s in kept for i in range(len(s) - 1))
    expected = {}
    for p, n in pairs.items():
        both = n + (pairs[p[::-1]] if p != p[::-1] else 0)
        chance = chars[p[0]] * chars[p[1]] / sum(chars.values()) ** 2
        expected[p] = (round(math.log2(both / sum(pairs.values()) / chance), 9), int("不" in p), int(n % 3 != 0))
    got = {r.term: (r.mi, int(r.has_function_word), r.result) for r in QUERIES["training_rows"](spark, documents(spark, tmp_path, texts)).collect()}
    assert got == expected
    assert {x[2] for x in got.values()} == {0, 1}
    assert not all(t.startswith("é") for t in got)


def test_dict_merge_comes_from_the_merged_senses(spark, tmp_path, monkeypatch):
    rows = [(1, "red bolt", "B1", "T1", 1), (2, "red bolt", "B2", "T2", 2), (3, "blue nut", "B1", "T3", 3)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    found = lambda name: sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect())
    assert found("dict_merge") == [("blue nut", 3), ("red bolt", 2)]
    senses = [("B1", 2, "T1 red bolt|T3 blue nut"), ("blue nut", 1, "new T3 blue nut"), ("red bolt", 2, "new T1 red bolt|new T2 red bolt")]
    assert found("dict_merge_senses") == senses
    entries = dictionary.entries
    monkeypatch.setattr(dictionary, "entries", lambda x, merge: entries(x))
    assert found("dict_merge") != [("blue nut", 3), ("red bolt", 2)]
    assert found("dict_merge_senses") != senses
