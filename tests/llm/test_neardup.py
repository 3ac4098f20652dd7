import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glossweave.llm import neardup, shingles


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute(rows, percent=85):
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))
    rank = [d if d is not None else float("inf") for d, _ in rows]

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                label[max(a, b, key=lambda x: (rank[x], x))] = min(a, b, key=lambda x: (rank[x], x))
    return sorted((rank[i], len(sets[i]), rank[root(i)]) for i in range(len(rows)))


def corpus():
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdéxyz") for _ in range(r.randint(1, 7))) for _ in range(300)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, rows = text(60), []
    for _ in range(40):
        base = text(r.randint(5, 200)) + (passage if r.random() < 0.4 else [])
        for _ in range(r.randint(1, 5)):
            new = list(base)
            for _ in range(r.randint(0, 4)):
                new[r.randrange(len(new))] = r.choice(vocabulary)
            rows.append(" ".join(new))
    hot = text(150)
    for _ in range(150):
        new = list(hot)
        for _ in range(r.randint(0, 6)):
            new[r.randrange(len(new))] = r.choice(vocabulary)
        rows.append("\n".join(new).upper())
    rows += ["", None, " \n ", "one", "One", "one two", "a b c d e", "A B\tC  D E", "x " * 40000]
    r.shuffle(rows)
    return [(i * 3 % 1009, t) for i, t in enumerate(rows)]


def test_equals_brute_force(spark):
    rows = [*corpus(), (None, "one two"), (2000, "no twin of any kind is here")]
    df = spark.createDataFrame([(*x, "x", 1) for x in rows], "doc_id long, text string, sig string, doc long").repartition(3)
    inf = float("inf")
    got = neardup.grouped(df).collect()
    assert sorted((r.doc_id if r.doc_id is not None else inf, r.n_shingles, r.component_id if r.component_id is not None else inf) for r in got) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = neardup.deduped(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)
    assert neardup.grouped(df.where("false")).collect() == []


def test_shared_ids_lose_nothing(spark):
    copy, other, third = "a b c d e f g h", "quite another text with seven words", "and a third one of seven words"
    rows = [(1, copy), (None, copy), (5, copy), (None, other), (5, other), (5, third), (5, third), (None, None), (7, ""), (7, "")]
    df = spark.createDataFrame([(*x, "mine", "own", 3) for x in rows], "doc_id long, text string, __doc string, Doc string, h long")
    kept = neardup.deduped(df)
    assert kept.columns == df.columns
    got = sorted((r.doc_id if r.doc_id is not None else 99, r.text, r["__doc"], r["Doc"], r.h) for r in kept.where("text <> ''").collect())
    assert got == sorted((d, t, "mine", "own", 3) for d, t in [(1, copy), (5, other), (5, third)])
    assert kept.where("text is null or text = ''").count() == 3
    found = sorted(((r.doc_id, r.component_id) for r in neardup.grouped(df).collect()), key=str)
    assert found == sorted([(1, 1), (None, 1), (5, 1), (None, 5), (5, 5), (5, 5), (5, 5), (None, None), (7, 7), (7, 7)], key=str)


def test_a_star_of_one_component_is_not_compared_again(spark, monkeypatch):
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*words, *(f"v{i}x{j}" for j in range(r.randint(0, 8)))])) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(neardup, "common", None)  # no tile is made
    assert {x.component_id for x in neardup.grouped(df).collect()} == {0}


@pytest.mark.parametrize(("size", "pairs"), [(18, 400), (40, 400), (120, 400), (2000, 150)])
def test_recall_of_candidates_at_the_threshold(size, pairs):
    """Of pairs just at 0.85 and above, all share a band and pass the estimate."""
    r = np.random.default_rng(size)
    missed = 0
    for _ in range(pairs):
        union = np.unique(r.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, size, dtype=np.uint64))
        differ = int(0.15 * len(union))
        order = r.permutation(len(union))
        a, b = np.sort(union[order[: len(union) - differ // 2]]), np.sort(union[order[differ - differ // 2 :]])
        assert shingles.similar(a, b, 85)
        sig = shingles.signatures([a, b])
        keys, brief = shingles.band_keys(sig), shingles.short(sig)
        margin = neardup.MARGIN_FEW if max(len(a), len(b)) < neardup.FEW else neardup.MARGIN
        missed += not ((keys[0] == keys[1]).any() and (brief[0] == brief[1]).mean() >= 0.85 - margin)
    assert missed <= pairs // 200


def template(documents, pairs, fillings=20, same=5, words=1000):
    """Documents of one template, all at 0.82 to each other, and pairs among them at 0.86."""
    out = []
    for i in range(documents):
        t = [f"w{j}" for j in range(words)]
        for slot in range(fillings):
            own = i - i % 2 if i < 2 * pairs and slot < same else i
            t[10 + slot * 45] = f"f{own}x{slot}"
        out.append((i, " ".join(t)))
    random.Random(4).shuffle(out)
    return out


def test_links_inside_a_large_group(spark, monkeypatch):
    rows = template(300, 40)
    expected = brute(rows)
    assert sum(d != c for d, _, c in expected) == 40
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for part in (1024, 70):
        monkeypatch.setattr(neardup, "PART", part, raising=False)
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.grouped(df).collect()) == expected


@given(st.lists(st.text(alphabet="aB é\n\tc", max_size=30) | st.none(), max_size=6))
@settings(max_examples=80, deadline=None)
def test_set_sizes(texts):
    assert [len(s) for s in shingles.shingle_sets(texts)] == [len(shingle_set(t)) for t in texts]


def test_components_of_a_path(spark):
    n = 60
    ids = list(range(n))
    random.Random(2).shuffle(ids)
    links = spark.createDataFrame([(min(p), max(p)) for p in zip(ids, ids[1:], strict=False)], "a long, b long")
    assert {r.label for r in neardup.components(links).collect()} == {0}
    assert neardup.components(links.where("false")).collect() == []


def test_estimates_are_unbiased():
    r = np.random.default_rng(1)
    for size in (12, 150, 3000):
        errors = []
        for _ in range(60):
            pool = r.integers(0, 2**63, size, dtype=np.uint64)
            cut = size // 12
            a, b = np.unique(pool[cut:]), np.unique(pool[: size - cut])
            sig = shingles.signatures([a, b])
            errors.append((sig[0] == sig[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(errors)) < 0.04
