import http.server
import json
import threading
import time
from functools import partial

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossweave.functions import distance, pinyin, scores, text
from glossweave.operators import colloc, convert, counts, dictionary, evaluate, prefix, ranking, rules, similarity, tokenize
from glossweave.sources import corpus, dictionaries, logs, tables
from glossweave.streaming import counts as streaming


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def native(spark, tmp_path, rows, **options):
    path = tmp_path / "d.tsv"
    path.write_text("# comment\n" + "".join("\t".join(r) + "\n" for r in rows), encoding="utf-8")
    return dictionary.entries(dictionaries.open_lines(spark, str(path)), **options)


def row(i, simp, trad, sound, english, headword=None):
    return [str(i), simp, trad, sound, english, "noun", "\\N", "\\N", "\\N", "\\N", "\\N", "\\N", "\\N", "\\N", "a note", str(headword or i)]


SHUO = [row(1, "说", "說", "shuō", "say"), row(2, "说", "說", "yuè", "explain", 1), row(3, "四", "\\N", "sì", "four"), row(4, "语", "語", "yǔ", "language")]


def test_characters_and_pairs(spark):
    lines = ["é x é", "", "ab", "\x80\x81", "𠺕中　 文", "中文\xa0"]
    assert column(spark, lines, text.characters) == [["é", "é"], [], [], ["\x81"], ["𠺕", "中", "　", "文"], ["中", "文", "\xa0"]]
    assert column(spark, lines, text.bigrams)[:3] == [["éé"], [], []]
    assert column(spark, ["　a b\xa0\x1c ", "\t"], text.strip) == ["a b", ""]


def test_boilerplate(spark):
    lines = ["A COPYRIGHT line", "CreativeCommons", "中文", "x\rcopyright", "Ünïx"]
    kept = column(spark, lines, lambda c: text.kept_line(c, ["copyright", "CreativeCommons", " ", "ÜNÏ"]))
    assert kept == [False, False, True, False, False]
    assert column(spark, lines, lambda c: text.kept_line(c, [])) == [True] * 5


def test_annotation(spark):
    assert column(spark, ["在、河、、之", "Note x", "tiger", "#", ""], text.annotation_line) == [True, False, False, False, False]
    assert column(spark, ["Error: 關雎 (false positive)", "x"], text.error_term) == ["關雎", None]
    assert column(spark, ["不在", "在"], text.has_function_word) == [1, 0]
    assert column(spark, ["在；河。(a)"], text.without_punctuation) == ["在河a"]


def test_greedy_with_no_dictionary(spark):
    none = spark.createDataFrame([], "word string")
    df = spark.createDataFrame([("四種廣說",), ("",), (None,)], "text string")
    for made in (tokenize.tokenize(df, none), tokenize.tokens_by_join(df, none)):
        assert {r.text: r.tokens for r in made.collect()} == {"四種廣說": list("四種廣說"), "": [], None: []}


def test_greedy(spark):
    words = spark.createDataFrame([("東家",), ("西家",)], "word string")
    df = spark.createDataFrame([("東家人死。西家人助哀。",), ("東家",)], "text string")
    got = {r.text: r.tokens for r in tokenize.tokenize(df, words).collect()}
    assert got["東家人死。西家人助哀。"] == ["東家", "人", "死", "。", "西家", "人", "助", "哀", "。"]
    assert {r.text: r.tokens for r in tokenize.tokenize(df, words, exclude_whole=True).collect()}["東家"] == ["東", "家"]


@given(st.lists(st.text("ab中𠺕", min_size=1, max_size=4), max_size=6), st.text("ab中𠺕c", max_size=14))
@settings(max_examples=80, deadline=None)
def test_greedy_is_lossless(words, chunk):
    held = frozenset(words)
    got = tokenize.greedy(held, tokenize.sizes(held), chunk)
    assert "".join(got) == chunk
    i = 0
    for t in got:
        assert not any(chunk.startswith(w, i) and len(w) > len(t) for w in held)
        i += len(t)


def test_dictionary(spark, tmp_path):
    e = dictionary.rolled_up(native(spark, tmp_path, SHUO))
    got = {r.key: r for r in e.collect()}
    assert set(got) == {"说", "說", "四", "语", "語"}
    assert (got["说"].english, got["说"].pinyin, got["说"].simplified, got["说"].traditional) == ("1. say; 2. explain", "shuō, yuè", "说", "說")
    assert (got["四"].english, got["四"].headword_id, got["四"].senses[0].notes) == ("four", 3, "a note")
    assert dictionary.lookup(e, "無").count() == 0
    short = native(spark, tmp_path, [row(1, "说", "說", "shuō", "say")[:10], ["1", "x"]], chinese_only=True)
    assert {(r.key, r.senses[0].pinyin) for r in short.collect()} == {("说", None), ("說", None)}


def test_dictionary_files(spark, tmp_path):
    a, b = tmp_path / "a.tsv", tmp_path / "b.tsv"
    a.write_text("\t".join(row(1, "说", "\\N", "shuō", "say")) + "\n")
    b.write_text("\t".join(row(9, "说", "\\N", "yuè", "explain")) + "\n")
    lines = dictionaries.open_lines(spark, [str(a), str(b)])
    assert dictionary.rolled_up(dictionary.entries(lines)).first().english == "1. say; 2. explain"
    assert dictionary.rolled_up(dictionary.entries(lines, merge="replace")).first().english == "explain"
    (tmp_path / "config.yaml").write_text("# x\nLUFiles: a.tsv, b.tsv\n")
    assert dictionaries.configured_paths(str(tmp_path)) == [f"{tmp_path}/data/a.tsv", f"{tmp_path}/data/b.tsv"]
    with pytest.raises(dictionaries.ConfigException):
        dictionaries.configured_paths("")


def test_dictionary_from_the_web(spark, tmp_path):
    native(spark, tmp_path, SHUO)
    handler = partial(http.server.SimpleHTTPRequestHandler, directory=str(tmp_path))
    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        lines = dictionaries.open_lines(spark, f"http://127.0.0.1:{server.server_port}/d.tsv")
        server.shutdown()
    assert {r.key for r in dictionary.entries(lines).collect()} == {"说", "說", "四", "语", "語"}


def test_scripts(spark, tmp_path):
    e = native(spark, tmp_path, SHUO)
    df = spark.createDataFrame([("四种说语",), ("x",), ("",)], "text string")
    assert {r.text: r.converted for r in dictionary.to_traditional(df, e).collect()} == {"四种说语": "四种說語", "x": "x", "": ""}
    got = {r.text: (r.simplified, r.traditional, r.pinyin) for r in dictionary.to_simplified(spark.createDataFrame([("四說",), ("四",), ("無",)], "text string"), e).collect()}
    assert got == {"四說": ("四说", "四說", "sìshuō"), "四": ("四", "\\N", "sì"), "無": ("無", "\\N", " ")}
    none = e.where("false")
    assert dictionary.to_traditional(spark.createDataFrame([("操作系统",)], "text string"), none).first().converted == "操作系统"
    assert dictionary.to_simplified(spark.createDataFrame([("四種廣說",)], "text string"), none).first().simplified == "四種廣說"


def test_new_entry(spark, tmp_path):
    native(spark, tmp_path, SHUO)
    lines = dictionaries.dictionary_lines(spark, [str(tmp_path / "d.tsv")])
    parts = spark.createDataFrame([(0, "說"), (1, "四")], "ord int, part string")
    r = dictionary.assembled(parts, lines, "to say four", "verb", "CC-CEDICT '說四'").first()
    assert (r.id, r.simplified, r.traditional, r.pinyin, r.notes, r.found) == (6, "说四", "說四", "shuōsì", "(CC-CEDICT '說四')", True)


def loop(word, keys, score, start, better):
    best, found = start, set()
    for k in keys:
        if k == word:
            continue
        s = score(word, k)
        if better(s, best) and len(k) >= 2:
            best, found = s, {k}
        elif s == best:
            found.add(k)
    return found


def py_hamming(a, b):
    return sum(x != y for x, y in zip(a, b, strict=False)) + max(0, len(a) - len(b))


def test_similarity_in_order(spark):
    keys = ["ab", "a", "b", "abc", "xb", "ax", "zz", "c", "abx"]
    rows = [(k, i, [(k, k, k)]) for i, k in enumerate(keys)]
    e = spark.createDataFrame(rows, "key string, ord long, senses array<struct<simplified:string,traditional:string,pinyin:string>>")
    for word in ("ab", "xx", "q", "abc"):
        got = {r.key for r in similarity.by_hamming(e, word, order_dependent=True).collect()}
        assert got == loop(word, keys, py_hamming, 100, lambda s, b: s < b), word
        got = {r.key for r in similarity.by_characters(e, word, order_dependent=True).collect()}
        assert got == loop(word, keys, lambda a, k: sum(c in k for c in a), 0, lambda s, b: s > b), word
    full = e.withColumn("senses", F.transform("senses", lambda s: s.withField("english", s["pinyin"])))
    assert {r.key for r in similarity.similar(full, "ab").collect()} >= {"abc", "abx"}
    assert similarity.by_pinyin(full, "none").count() == 0


@given(st.text("ab中", max_size=5), st.text("ab中", max_size=5))
@settings(max_examples=25, deadline=None)
def test_distances(spark, a, b):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(distance.hamming(F.col("a"), F.col("b")), distance.shared_characters(F.col("a"), F.col("b"))).first()
    assert tuple(r) == (py_hamming(a, b), sum(c in b for c in a))


def test_scores(spark):
    one = spark.range(1)
    lit = lambda x: F.lit(float(x))
    get = lambda c: one.select(c).first()[0]
    assert get(scores.pmi(lit(14), lit(83666199), lit(19), lit(23), lit(85519494))) == pytest.approx(21.417, abs=1e-3)
    assert get(scores.pmi(lit(8), lit(16), lit(0), lit(3), lit(9))) == -1.0
    assert get(scores.chi_square(lit(10), lit(0), lit(0), lit(10))) == pytest.approx(20)
    assert get(scores.bm25(lit(3), lit(1), lit(4497))) == pytest.approx(2.5 * 3 / 4.5)
    assert get(scores.sigmoid(lit(0))) == 0.5
    assert get(scores.linear([lit(1), lit(2)], [3.0, 4.0])) == 11


def test_mutual_information_is_symmetric(spark):
    c = spark.createDataFrame([("a", 4), ("b", 2)], "character string, n long")
    p = spark.createDataFrame([("ab", 1), ("ba", 2), ("aa", 3)], "bigram string, n long")
    t = spark.createDataFrame([("ab",), ("ba",), ("aa",), ("zz",), ("abc",)], "term string")
    got = {r.term: r.mi for r in colloc.mutual_information(c, p, t).collect()}
    assert set(got) == {"ab", "ba", "aa"}
    assert got["ab"] == got["ba"]


def test_prefixes(spark):
    words = spark.createDataFrame([(w,) for w in ("zha", "zhang", "zhan", "zhao", "fang")], "word string")
    assert {r.word for r in prefix.with_prefix(words, "zh").collect()} == {"zha", "zhang", "zhan", "zhao"}
    assert prefix.with_prefix(words, "q").count() == 0
    nodes = prefix.trie(words)
    assert {r.word for r in prefix.accepts(nodes, spark.createDataFrame([("zha",), ("zh",), ("",), ("q",)], "word string")).where("recognized").collect()} == {"zha"}
    assert prefix.trie_edges(nodes).count() == nodes.count() - 1
    m = prefix.Machine()
    m.add_transition(0, "1", m.new_state(), m.new_state(True))
    assert m.transition(0, "1") == {1, 2}
    assert m.transition(0, "2") == set()
    assert m.alphabet() == {"1"}
    with pytest.raises(prefix.FSMException):
        m.add_transition(0, "", 1)


def test_cedict(spark, tmp_path):
    path = tmp_path / "c.u8"
    path.write_text("# c\n說 说 [shuo1] /to say/\n說 说 [yue4] /explain/\nbad line\n大學 大学 [da4 xue2] /University of X/\n貓 猫 [mao1] /cat (loanword)/\n", encoding="utf-8")
    rows, bad = dictionaries.cedict_rows(spark, str(path))
    assert [r.line for r in bad.collect()] == ["bad line"]
    theirs = convert.entries(rows)
    ours = native(spark, tmp_path, [*SHUO, row(5, "大", "\\N", "dà", "big"), row(6, "学", "學", "xué", "study"), row(7, "猫", "貓", "māo", "cat")])
    missing = convert.absent(theirs, ours)
    assert {r.key: r.domain for r in missing.collect()} == {"大學": "教育\tEducation"}
    assert rules.summary(missing).first().absent == 1
    r = convert.candidates(missing, ours).first()
    assert (r.luid, r.simplified, r.traditional, r.pinyin, r.notes) == (6005842, "大学", "大學", "dàxué", "(CC-CEDICT '大學')")
    lines = {r.line for r in convert.cedict_lines(ours).collect()}
    assert "大 大 [da4] /big/" in lines
    assert any(x.startswith("說 说 [shuo") for x in lines)
    assert len([x for x in lines if "说" in x]) == 1


def test_formatters(spark):
    df = spark.createDataFrame([("(idiom, \"as said\") x",), ("x; y [ni3 hao3]",), ("Tibet (1950-1960), a place",), ("abc / CL:個|个[ge4]",), ("a" * 60 + " / " + "b" * 60,)], "english string")
    got = [r.formatted for r in convert.with_formatted_english(df).collect()]
    assert got == ["x", "x / y", "Tibet", "abc", "a" * 60]
    notes = [r[0] for r in df.select(convert.formatted_notes(F.col("english"), F.lit("字"))).collect()]
    assert notes[0] == "as said (CC-CEDICT '字')"
    assert notes[2] == "1950-1960; A place (CC-CEDICT '字')"


def test_pinyin(spark):
    assert column(spark, ["fēn", "shuō", "ma", ""], pinyin.numbered) == ["fen1", "shuo1", "ma", ""]
    assert column(spark, ["fēn", "shuō"], lambda c: pinyin.numbered(c, last_letter_only=True)) == ["fen", "shuo1"]


@pytest.mark.parametrize(("table", "column_of", "otherwise"), [(rules.DOMAIN, rules.domain, rules.DOMAIN_ELSE), (rules.SUBDOMAIN, rules.subdomain, rules.NOTHING_KNOWN), (rules.ENTITY_KIND, rules.entity_kind, rules.NOTHING_KNOWN)])
def test_each_rule_fires(spark, table, column_of, otherwise):
    rows, expected = [], []
    for result, keywords, *_ in table:
        for f, ks in keywords.items():
            k = ks[0]
            rows.append([k if f == n else "" for n in ("english", "simplified", "traditional")])
            first = next(r for r, words, *_ in table if any(x in rows[-1][("english", "simplified", "traditional").index(g)] for g, xs in words.items() for x in xs))
            expected.append(first)
            assert result in (first, result)
    df = spark.createDataFrame([(i, *x) for i, x in enumerate([*rows, ["", "", ""]])], "i int, english string, simplified string, traditional string")
    assert [r.y for r in df.select("i", column_of().alias("y")).orderBy("i").collect()] == [*expected, otherwise]


def test_grammar(spark):
    cases = {("hey!", "x"): "interjection", ("Paris", "x"): "proper noun", ("Idea idiom", "x"): "noun", ("a cat", "猫"): "noun", ("to go", "去"): "verb", ("quickly", "快"): "adverb", ("tired", "x"): "adjective", ("able", "x"): "adjective", ("x", "一二三四"): "set phrase", ("x", "一二三四五"): "phrase", ("", ""): "noun"}
    df = spark.createDataFrame([(e, s, s) for e, s in cases], "english string, simplified string, traditional string")
    assert {(r.english, r.simplified): r.g for r in df.withColumn("g", rules.grammar()).collect()} == cases


def test_logs(spark, tmp_path):
    good = "info: x: q ,0,term,1,0,2,3,1,0"
    lines = [{"textPayload": good}, {"textPayload": "no colon,1"}, {"textPayload": "x:q,zero,t,1,0,2,3,1,0"}, {"other": 1}, {"textPayload": "x:1,2"}]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, lines)))
    read = logs.read_logs(spark, str(tmp_path / "a.json"))
    assert [tuple(r) for r in logs.samples(read).collect()] == [("q", 1, "term", 1, 0, 2, 3, 1, 0)]
    assert logs.samples(read, relevant_at=7).first().is_relevant == 1


def test_tables(spark, tmp_path):
    counted = counts.character_counts(spark.createDataFrame([("中中文\"",)], "line string"))
    tables.write_lines(counted, str(tmp_path / "out"), "character", "n")
    back = tables.frequencies(spark, str(tmp_path / "out"))
    assert {r.key: r.n for r in back.collect()} == {"中": 2, "文": 1}
    assert tables.total(back).first()[0] == 3
    tables.write_table(back, str(tmp_path / "csv"))
    assert corpus.typed_csv(spark, str(tmp_path / "csv"), "key string, n long").count() == 2


def test_observed_counters(spark):
    """In a session of their own, as one that has observed can't train models after that."""
    counted = counts.character_counts(spark.newSession().createDataFrame([("中中文\"",)], "line string"))
    df, seen = counts.observed(counted, "chars")
    df.collect()
    assert seen.get == {"items": 3, "distinct_items": 2}


def test_ranking(spark):
    tokens = spark.createDataFrame([("c", "d1", "a"), ("c", "d1", "a"), ("c", "d1", "b"), ("c", "d2", "b")], "collection string, document string, word string")
    f = ranking.word_frequencies(tokens)
    assert {(r.word, r.document): (r.frequency, r.doc_len) for r in f.collect()} == {("a", "d1"): (2, 3), ("b", "d1"): (1, 3), ("b", "d2"): (1, 1)}
    assert [r.document for r in ranking.ranked(f, ["b"]).collect()] == ["d2", "d1"]
    assert [r.document for r in ranking.of_word(f, "b").collect()] == ["d1", "d2"]


def test_reports(spark):
    p = spark.createDataFrame([(0, 0)] * 3 + [(0, 1)] + [(1, 1)] * 2, "label int, prediction int")
    report = {r["class"]: r for r in evaluate.class_report(evaluate.confusion(p)).collect()}
    assert report["0"].recall == pytest.approx(0.75)
    assert report["1"].precision == pytest.approx(2 / 3)
    assert report["accuracy"].f1 == pytest.approx(5 / 6)
    assert report["weighted avg"].support == 6
    assert {tuple(r) for r in evaluate.confusion_matrix(p, [0, 1]).collect()} == {(0, 3, 1), (1, 0, 2)}
    assert evaluate.described(p, ["label"]).first().q3 == 0.75
    empty = evaluate.recall_precision(spark.createDataFrame([], "line string")).first()
    assert (empty.tokens, empty.recall) == (0, None)


def test_stream_counts_like_a_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("中文中\nx")
    q = streaming.start(streaming.counted_stream(streaming.line_stream(spark, str(tmp_path / "in")), "characters"), "so_far", str(tmp_path / "cp"))
    q.processAllAvailable()
    (tmp_path / "in/b.txt").write_text("文")
    q.processAllAvailable()
    got = {r.character: r.n for r in spark.table("so_far").collect()}
    q.stop()
    assert got == {"中": 2, "文": 2}


def test_long_words_and_choices(spark):
    m = prefix.Machine()
    end = m.new_state(True)
    for x in "ab":
        m.add_transition(0, x, 0)
        m.add_transition(end, x, end)
    m.add_transition(0, "a", end)
    nodes, edges = m.tables(spark)
    words = spark.createDataFrame([("b" * 999 + "a", True), ("b" * 1000, False), ("a" * 1000, True), ("", False), (None, None), ("abc", False)], "word string, Hit boolean")
    got = prefix.recognizes(nodes, edges, words)
    assert got.columns == ["word", "Hit", "recognized"]
    assert got.where("not (Hit <=> recognized)").count() == 0
    short = words.where("length(word) < 9 or word is null")
    assert prefix._joined(nodes, edges, short).where("not (Hit <=> recognized)").count() == 0
    long = spark.createDataFrame([("ab" * 10, True), ("b" * 20, False)], "word string, Hit boolean")
    assert prefix._joined(nodes, edges, long).where("not (Hit <=> recognized)").count() == 0
    assert (m.start(), m.states(), m.accepting_states()) == (0, {0, 1}, {1})
    assert m.transitions() == {(0, "a"): {0, 1}, (0, "b"): {0}, (1, "a"): {1}, (1, "b"): {1}}


def test_pairs_of_a_long_line(spark):
    line = "é中" * 100_000
    began = time.perf_counter()
    assert column(spark, [line], lambda c: F.size(text.bigrams(c))) == [199_999]
    assert time.perf_counter() - began < 20
    assert column(spark, [None, "é", "é\U00020e95中"], text.bigrams) == [None, [], ["é\U00020e95", "\U00020e95中"]]


def test_own_columns_stay(spark):
    words = spark.createDataFrame([("ab",)], "word string")
    df = spark.createDataFrame([("abc", "mine", "own")], "text string, t string, h string")
    for made in (tokenize.tokenize(df, words), tokenize.tokens_by_join(df, words), tokenize.tokenize(df, words, exclude_whole=True)):
        assert made.collect()[0].asDict() == {"text": "abc", "t": "mine", "h": "own", "tokens": ["ab", "c"]}
    again = df.withColumn("tokens", F.lit("old"))
    assert tokenize.tokens_by_join(again, words).first().tokens == tokenize.tokenize(again, words).first().tokens == ["ab", "c"]
    none = spark.createDataFrame([], "key string, senses array<struct<simplified:string,traditional:string,pinyin:string,english:string>>")
    both = df.withColumn("both", F.lit("x"))
    assert (dictionary.to_traditional(df, none).first().t, dictionary.to_simplified(both, none).first().both) == ("mine", "x")
    nodes = prefix.trie(words)
    assert prefix.accepts(nodes, words.withColumn("hit", F.lit(7))).first().hit == 7
    x = spark.createDataFrame([("to say", "mine")], "english string, __x string")
    assert convert.with_formatted_english(x).first().asDict() == {"english": "to say", "__x": "mine", "formatted": "to say"}


def test_index_comments_inside_a_line(spark):
    rows = spark.createDataFrame([("a\tb # c",), ("# x",), ("",), ("only",)], "line string")
    assert [tuple(r) for r in corpus.parsed_index(rows, ["x", "y"], cut_comments=True).collect()] == [("a", "b "), ("only", None)]
    assert [r.y for r in corpus.parsed_index(rows, ["x", "y"]).collect()] == ["b # c", None]


def test_typed_lines_end_at_comments(spark):
    found = ["1,a,2.5", "2,b # not,7", "# 3,c,1", "", " \t", None, '4,"d # e",1.5 # f', "x,g", "5,,3#", '6,"open # h']
    rows = spark.createDataFrame([(x,) for x in found], "line string")
    got = {(r.id, r.name, r.n) for r in corpus.typed_lines(rows, "id long, name string, n double").collect()}
    assert got == {(1, "a", 2.5), (2, "b ", None), (4, "d # e", 1.5), (None, "g", None), (5, None, 3.0), (6, "open # h", None)}
    assert corpus.typed_lines(rows.where("false"), "id long").columns == ["id"]


def test_rules_by_example(spark):
    """Guesses written down by hand, apart from the tables of keywords."""
    rows = [
        ("大学", "University of Somewhere", "教育\tEducation", "\\N\t\\N", "大学\tUniversity", "proper noun", True),
        ("发烧", "to have a fever", "现代汉语\tModern Chinese", "医学\tMedicine", "\\N\t\\N", "verb", False),
        ("四字成语", "lit. four words (idiom)", "成语\tIdiom", "\\N\t\\N", "\\N\t\\N", "set phrase", False),
        ("白鹭", "little egret (bird species of China)", "现代汉语\tModern Chinese", "中国\tChina", "鸟\tBird", "noun", False),
        ("某县", "county in Sichuan", "地方\tPlaces", "中国\tChina", "县\tCounty", "noun", False),
        ("公司", "an Airlines company", "商务\tCommerce", "\\N\t\\N", "公司\tCompany", "noun", True),
        ("奥运", "Olympic Games, held since 1896", "历史\tHistory", "\\N\t\\N", "\\N\t\\N", "proper noun", False),
    ]
    df = spark.createDataFrame([(s, s, e) for s, e, *_ in rows], "simplified string, traditional string, english string")
    got = {r.simplified: (r.domain, r.subdomain, r.entity_kind, r.grammar, r.is_modern_named_entity) for r in rules.analyzed(df).collect()}
    assert got == {s: tuple(x) for s, _, *x in rows}
