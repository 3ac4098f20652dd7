import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from glossweave.llm import quality
from glossweave.llm.quality import filtered, report


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    repeated = {j for i, x in enumerate(windows) if n[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated), failed


GOOD = "\n".join(f"Sentence {i} has words like a{i * 7} and b{i * 13}, which go on to c{i * 3}." for i in range(12))
TEXTS = [GOOD, GOOD + "\n" + GOOD, "", None, " \n\t ", "a b", "a b c", "a b c a b c", "x " * 5000, "é　ü ß\x0b\n" * 30, "a b a b a b a b", "a a a a", "# * $ % & | < > ! A", GOOD.replace(" ", "%%% "), "same line here\n" * 40, "w " + "long" * 60000]


def prose(n):
    r = random.Random(n)
    word = lambda: "".join(r.choice(["re", "to", "na", "li", "e", "ser"]) for _ in range(r.randint(1, 4)))
    return ["\n".join("A" + " ".join(word() for _ in range(14)) + "." for _ in range(10)) for _ in range(n)]


def frame(spark, texts):
    return spark.createDataFrame([(i if i != 3 else None, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, __q_other string, n_words long")


def test_counts_equal_brute_force(spark):
    got = {r.doc_id: r for r in report(frame(spark, TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i if i != 3 else None]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), (i, r)
        assert not (r.kept and r.base_failed)
    assert report(frame(spark, TEXTS).where("false")).collect() == []


def test_votes_find_what_is_bad(spark):
    good = prose(60)
    bad = [t.replace(" ", "%%% ") for t in good[:12]] + [t.upper().replace(" ", "!! ") for t in good[12:20]]
    df = frame(spark, good + bad)
    kept = {r.n_words for r in filtered(df).collect()}
    assert kept == set(range(len(good)))
    assert filtered(df).columns == df.columns


def test_clean_corpus_is_kept(spark):
    good = prose(60)
    assert filtered(frame(spark, good)).count() == 60


def test_own_columns_of_any_name_stay(spark):
    rows = [(i, t, "mine", 5) for i, t in enumerate(prose(20))]
    df = spark.createDataFrame(rows, "doc_id long, text string, __q_words string, __q_kept int")
    assert sorted(tuple(r) for r in filtered(df).collect()) == rows


def test_windows_are_compared_by_their_words(spark, monkeypatch):
    """With hashes of two bits nearly all windows have the hash of another one."""
    monkeypatch.setattr(quality, "_hashed", lambda *words: F.xxhash64(*words).bitwiseAND(3))
    for r in report(frame(spark, TEXTS[:12])).collect():
        t = TEXTS[r.doc_id if r.doc_id is not None else 3]
        assert r.n_repeat_words == brute(t)[4]


def test_posterior_of_votes(spark):
    """Ties and repeated rows are judged alike; an empty text is rejected."""
    df = frame(spark, prose(30) + [None, "", GOOD, GOOD])
    verdicts = {}
    for r in report(df).collect():
        assert verdicts.setdefault((r.n_words, r.word_chars, r.n_symbols), r.kept) == r.kept
    assert not verdicts[0, 0, 0]


def odd(seed):
    """Clean texts with one odd measure: a list without sentence ends, headings in capitals, a very long text of few words."""
    r = random.Random(seed)
    words = ["".join(r.choice(["re", "to", "na", "li", "e", "ser"]) for _ in range(r.randint(2, 4))) for _ in range(900)]
    line = lambda: " ".join(r.choice(words) for _ in range(12))
    headed = lambda: " ".join(w.upper() if i % 5 < 2 else w for i, w in enumerate(line().split()))
    return ["\n".join(line() for _ in range(14)), "\n".join(headed() + "." for _ in range(14)), "\n".join(line() + "." for _ in range(1000))]


def test_good_votes_outweigh_one_doubtful_vote(spark):
    texts = prose(60) + odd(1) + odd(2)
    df = frame(spark, texts)
    doubtful = [len([v for _, v in quality._votes(r[0]) if v > 0]) for r in quality.voted(quality.measured(df)).orderBy("n_words").select("__q_code").collect()]
    assert doubtful == [0] * 60 + [1] * 6
    assert filtered(df).count() == len(texts)


def test_bad_and_common_doubtful_votes_reject(spark):
    both = [t.upper() for t in odd(1)[:1] + odd(2)[:1]] + [t.replace(" ", " | ").replace("e", "&") for t in odd(3)[:1]]
    assert {r.n_words for r in filtered(frame(spark, prose(60) + both)).collect()} == set(range(60))


def test_fit_separates_classes():
    """A rule that is often doubtful alone learns so; patterns of all votes at once stay finite."""
    good = sum(4**k for k in range(len(quality.RULES)))
    for n in (1, 100, 10000):
        logs = quality._logs(quality.fit({good: 1000, good + 1: n, 0: 5, 4 ** len(quality.RULES) - 1: 3}))
        at = lambda code: quality._classes(logs, quality._votes(code))["good"]
        assert at(good) > 0.9 and at(good + 1) > 0.5 and at(4 ** len(quality.RULES) - 1) < 0.01 and at(good + 2) < 0.5
        assert all(abs(sum(math.exp(x) for x in v) - 1) < 1e-9 for v in logs["votes"].values())
    assert quality.fit({})["share"]["good"] > 0.8
