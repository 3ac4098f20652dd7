import hashlib
import random
import re
import time

from glossweave.llm.pii import detected, measured

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def shown(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def check(spark, texts):
    df = spark.createDataFrame([(i if i else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, spans string, base long")
    got = {r.doc_id: r for r in detected(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r, b = got[i or None], base(t)
        assert r.base_sha256 == hashlib.sha256(shown(b).encode()).hexdigest(), (t[:200], shown(b), r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[3] == k for s in b) for k in PATTERNS]
        assert {x for x in shown(b).split(",") if x} <= set(r.spans.split(","))
    return got


def test_base_equals_brute_force(spark):
    r = random.Random(6)
    parts = ["a@b.cd", "_x@y.zz", "@", ".", "-", " ", "\n", "1", "255", "256", "1.2.3.4", "4111 1111 1111 1111", "4111111111111111", "+1 (743) 555-3824", "+", "(", ")", "é", "\U00010400", "x", "%", "00012", "5-", "..", "a.b@c-d.e.f"]
    texts = ["", None, "none here"] + ["".join(r.choice(parts) for _ in range(r.randint(1, 12))) for _ in range(600)]
    check(spark, texts)


def test_very_long_texts(spark):
    check(spark, ["x", "a" * 20_000, "1" * 100_000, "1 " * 60_000, "1.2.3.4 " * 3000, "+1" + "(" * 50_000, "a@" * 10_000, "a@b" + ".c" * 40_000])


def test_contexts_give_identifiers_away(spark):
    r = random.Random(3)
    words = lambda: " ".join(r.choice(["one", "two", "red", "blue", "tree"]) for _ in range(6))
    texts = ["x"] + [f"{words()} please call {p} {words()}" for p in (f"+1 (743) 555-{i}824" for i in range(8))]
    texts += [f"{words()} please call (650) 555-1234 {words()}", f"{words()} in room 5551234 {words()}", f"{words()} tree 650 555 1234 {words()}", f"{words()} please call now {words()}"]
    got = check(spark, texts)
    assert sum(x.n_added for x in got.values()) == 1
    found = got[9].spans
    kind, a, b = found.split(":")
    assert (kind, texts[9][int(a) : int(b)]) == ("phone", "(650) 555-1234")


def test_time_is_nearly_linear(spark):
    def seconds(text):
        began = time.perf_counter()
        detected(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
        return time.perf_counter() - began

    seconds("1 a 12")
    few = seconds("12 a " * 100)
    assert seconds("12 a " * 32_000) < few + 4


def test_seeds_that_are_held_out_are_found_again(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijk") for _ in range(5))
    key = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    texts = [f"{word()} {word()} password: {key()} {word()}" for _ in range(60)] + [f"{word()} {word()} {r.randint(10, 10**6)} {word()}" for _ in range(300)]
    texts += [f"{word()} mail {word()}@{word()}.org {word()}" for _ in range(60)] + [f"{word()} digest {key()}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.kind: x for x in measured(df, 0.3).collect()}
    for kind in ("secret", "email"):
        assert got[kind].hidden > 5
        assert got[kind].found == got[kind].hidden - (kind == "secret" and got[kind].hidden > got[kind].found)
        assert got[kind].right == got[kind].told
    assert {x for k in ("ip", "card", "phone") for x in got[k][1:]} == {0}


def test_unseen_secrets_of_any_shape(spark):
    texts = [f"text token = \"{i:040x}f\" more" for i in range(10**40, 10**40 + 20)] + ['text token = "hunter22" more', "text 2024 more", "a b 12", "room 12"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: x for x in detected(df).collect()}
    assert got[20].spans == "secret:14:22"
    assert [got[i].n_added for i in range(24)] == [1] * 21 + [0] * 3


def test_doc_ids_of_any_value(spark):
    rows = [(None, "mail a@b.cd"), (None, "nothing"), (-(1 << 63), "mail a@b.cd now"), ((1 << 63) - 1, None)]
    got = detected(spark.createDataFrame([(*x, "own") for x in rows], "doc_id long, text string, h string")).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0, x.n_email) for x in got) == sorted((d is None, d or 0, int("@" in (t or ""))) for d, t in rows)


def test_empty(spark):
    assert detected(spark.createDataFrame([], "doc_id long, text string")).collect() == []
