"""One query for each operator, over the test tables, with its SQL.

The tables have no Chinese, so parts play the dictionary: a part's name is a simplified
form, its brand a traditional one, its type the English.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.functions import distance, scores, text
from glossweave.functions.pinyin import MARKED, PLAIN, TONES, numbered
from glossweave.operators import colloc, convert, counts, dictionary, evaluate, learn, prefix, ranking, rules, similarity, tokenize
from glossweave.sources import corpus, dictionaries, logs, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
IGNORED = ["license", "token"]
SYLLABLES = ["the", "th", "tion", "ing", "ein", "der", "que", "ción", "ment", "en", "é", "ou"]
WORD, PREFIX = "red bolt", "re"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    """A new folder for files that a query writes and reads back; it goes when Python ends, while the session lives."""
    path = f"{tables.checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"

    def remove() -> None:
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

    atexit.register(remove)
    return path


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line"))


_LINES = "lines as (select unnest(string_split(text, chr(10))) as line from documents)"
_CHARS = "chars as (select unnest(string_split(regexp_replace(line, '[\\x00-\\x{80}]', '', 'g'), '')) as character from lines)"
_PAIRS = "s as (select regexp_replace(line, '[\\x00-\\x{80}]', '', 'g') as s from lines), pairs as (select substring(s, i, 2) as bigram from (select s, unnest(range(1, length(s))) as i from s where length(s) > 1))"


@query(f"with {_LINES}, {_CHARS} select character, count(*) as n from chars where character <> '' group by all")
def char_count(spark, d):
    return counts.character_counts(lines(spark, d))


@query(f"with {_LINES}, {_PAIRS} select bigram, count(*) as n from pairs group by all")
def bigram_count(spark, d):
    return counts.bigram_counts(lines(spark, d))


@query(f"with {_LINES}, {_CHARS} select cast(count(*) as bigint) as items, count(distinct character) as distinct_items from chars where character <> ''")
def char_totals(spark, d):
    return counts.character_counts(lines(spark, d)).agg(F.sum("n").alias("items"), F.count("*").alias("distinct_items"))


@query(f"with {_LINES}, {_CHARS} select cast(count(*) as bigint) as items, count(distinct character) as distinct_items from chars where character <> ''")
def observed_counters(spark, d):
    """What a job that counts characters has observed, in a session of its own: one that has observed can't train models after that."""
    df, seen = counts.observed(counts.character_counts(lines(spark.newSession(), d)), "characters")
    df.write.format("noop").mode("overwrite").save()
    return spark.range(1).select(*(F.lit(seen.get[c]).cast("long").alias(c) for c in ("items", "distinct_items")))


@query(f"with {_LINES} select line, count(*) as n from lines where not regexp_matches(line, 'license|token', 'i') group by all")
def boilerplate_filter(spark, d):
    return counts.without_boilerplate(lines(spark, d), IGNORED).groupBy("line").agg(F.count("*").alias("n"))


_SYLLABLE_PATTERN = "|".join(sorted(SYLLABLES, key=lambda w: (-len(w), w))) + "|(?s:.)"


@query(f"with {_LINES} select term, count(*) as n from (select unnest(regexp_extract_all(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '{_SYLLABLE_PATTERN}')) as term from lines) group by all")
def term_count(spark, d):
    kept = lines(spark, d).select(text.strip(F.col("line")).alias("line"))
    return counts.term_counts(kept.withColumn("tokens", tokenize.tokens_by_pattern(F.col("line"), SYLLABLES)))


def _words(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()


@query("""with words as (select string_agg(word, '|' order by length(word) desc, word) || '|(?s:.)' as p from (select distinct unnest(string_split(p_name, ' ')) as word from part))
select p_partkey, array_to_string(regexp_extract_all(p_name, p), '/') as tokens from part, words""")
def tokenize_longest(spark, d):
    out = tokenize.tokenize(table(spark, d, "part"), _words(spark, d), "p_name")
    return out.select("p_partkey", F.array_join("tokens", "/").alias("tokens"))


@query("""with names as (select distinct p_name from part), words as (select distinct unnest(string_split(p_name, ' ')) as word from part union select p_name from names),
pattern as (select p_name, string_agg(word, '|' order by length(word) desc, word) || '|(?s:.)' as p from names, words where word <> p_name group by p_name)
select p_partkey, array_to_string(regexp_extract_all(part.p_name, p), '/') as tokens from part join pattern using (p_name)""")
def tokenize_exclude_whole(spark, d):
    words = _words(spark, d).union(table(spark, d, "part").select("p_name")).distinct()
    out = tokenize.tokenize(table(spark, d, "part"), words, "p_name", exclude_whole=True)
    return out.select("p_partkey", F.array_join("tokens", "/").alias("tokens"))


@query(f"""with {_LINES}, {_CHARS}, c as (select character, count(*) as n from chars where character <> '' group by all), {_PAIRS}, b as (select bigram, count(*) as n from pairs group by all),
t as (select bigram as term, substring(bigram, 1, 1) as x, substring(bigram, 2, 1) as y from b)
select term, round(log2(((coalesce(f.n, 0) + case when term <> y || x then coalesce(r.n, 0) else 0 end) / (select sum(n) from b)) / (cx.n / (select sum(n) from c) * (cy.n / (select sum(n) from c)))), 9) as mi
from t join c cx on cx.character = x join c cy on cy.character = y left join b f on f.bigram = term left join b r on r.bigram = y || x""")
def mutual_info(spark, d):
    k = lines(spark, d)
    pairs = counts.bigram_counts(k)
    return colloc.mutual_information(counts.character_counts(k), pairs, pairs.select(F.col("bigram").alias("term"))).select("term", F.round("mi", 9).alias("mi"))


@query("""select p_size, round((p_size / 1000.0 - p_size / 500.0 * (p_size / 400.0)) / sqrt(p_size / 1000.0 / 1000.0), 9) as t, round(1 / (1 + exp(-(0.5 + 0.1 * p_size))), 9) as s, 2.0 * p_size - 1.5 as line,
round((32 + p_size) * pow(p_size * 20.0 - 5 * 7, 2) / ((p_size + 5.0) * (p_size + 7) * (5 + 20.0) * (7 + 20)), 9) as chi from (select distinct p_size from part)""")
def association_scores(spark, d):
    p = table(spark, d, "part").select("p_size").distinct()
    n, x, lit = F.col("p_size"), F.col("p_size").cast("double"), lambda v: F.lit(float(v))
    t = scores.t_value(x, lit(1000), x / 500, x / 400, lit(1))
    chi = scores.chi_square(x, lit(5), lit(7), lit(20))
    return p.select("p_size", F.round(t, 9).alias("t"), F.round(scores.sigmoid(n, 0.5, 0.1), 9).alias("s"), scores.linear([x, lit(1.5)], [2.0, -1.0]).alias("line"), F.round(chi, 9).alias("chi"))


@query("select '在' || role as term, arg_max(turn % 2, conv_id * 1000 + turn) as result from conversations group by role")
def last_label_wins(spark, d):
    """Odd turns give a term as a token, even ones as a false positive."""
    term = F.concat(F.lit("在"), "role")
    line = F.when(F.col("turn") % 2 == 1, term).otherwise(F.concat(F.lit("Error: "), term, F.lit(" (false positive)")))
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), line.alias("line"))
    return evaluate.labelled_terms(c).select("term", "result")


def _annotated(spark, d) -> DataFrame:
    """Lines like those of an annotated text, out of conversations."""
    c = table(spark, d, "conversations")
    note = F.concat(F.lit("Error: "), "role", F.lit(" ("), F.when(F.col("turn") % 3 == 0, "false negative").otherwise("false positive"), F.lit(")"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.when(F.col("turn") % 4 == 3, note).otherwise(F.concat(F.lit("在、"), "role", F.lit("、、河。、"))).alias("line"))


@query("""with n as (select sum(case when turn % 4 = 3 then 0 else 3 end) as tokens, count(*) filter (turn % 4 = 3 and turn % 3 = 0) as fn, count(*) filter (turn % 4 = 3 and turn % 3 <> 0) as fp from conversations)
select cast(tokens as bigint) as tokens, fn as false_negatives, fp as false_positives, round(tokens / (tokens + fn), 4) as recall, round(tokens / (tokens + fp), 4) as precision from n""")
def eval_precision_recall(spark, d):
    out = evaluate.recall_precision(_annotated(spark, d))
    return out.withColumns({"recall": F.round("recall", 4), "precision": F.round("precision", 4)})


@query("""with t as (select conv_id * 1000 + turn as o, unnest(case when turn % 4 = 3 then [role] else ['在', role, '河'] end) as term, unnest(case when turn % 4 = 3 then [0] else [1, 1, 1] end) as result from conversations where turn % 4 <> 3 or turn % 3 <> 0)
select term, arg_max(result, o) as result from t group by term""")
def labelled_terms(spark, d):
    return evaluate.labelled_terms(_annotated(spark, d)).select("term", "result")


@query(f"""with {_LINES}, {_CHARS}, c as (select character, count(*) as n from chars where character <> '' group by all), {_PAIRS}, b as (select bigram, count(*) as n from pairs group by all),
t as (select bigram as term, substring(bigram, 1, 1) as x, substring(bigram, 2, 1) as y from b)
select term, round(log2(((coalesce(f.n, 0) + case when term <> y || x then coalesce(r.n, 0) else 0 end) / (select sum(n) from b)) / (cx.n / (select sum(n) from c) * (cy.n / (select sum(n) from c)))), 9) as mi, cast(regexp_matches(term, '[有不無下上為後]') as int) as has_function_word, cast(f.n % 3 <> 0 as int) as result
from t join c cx on cx.character = x join c cy on cy.character = y left join b f on f.bigram = term left join b r on r.bigram = y || x""")
def training_rows(spark, d):
    """Rows of all pairs of the documents, with their mutual information; labels of both kinds."""
    k = lines(spark, d)
    pairs = counts.bigram_counts(k)
    terms = pairs.select(F.col("bigram").alias("term"), (F.col("n") % 3 != 0).cast("int").alias("result"), F.lit(0).alias("ord"))
    information = colloc.mutual_information(counts.character_counts(k), pairs, terms)
    return evaluate.training_rows(terms, information)[0].withColumn("mi", F.round("mi", 9)).drop("ord")


@query("select quality as label, toxic as prediction, count(*) as n from labels group by all")
def confusion(spark, d):
    return evaluate.confusion(table(spark, d, "labels"), "quality", "toxic")


@query("""with c as (select unnest([0, 1]) as k), p as (select k, count(*) filter (quality = k and toxic = k) as tp, count(*) filter (quality = k) as support, count(*) filter (toxic = k) as predicted from labels, c group by k),
m as (select k, coalesce(tp / nullif(predicted, 0), 0) as precision, coalesce(tp / nullif(support, 0), 0) as recall, support, tp from p),
f as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1 from m),
a as (select cast(k as varchar) as class, precision, recall, f1, support from f
union all select 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) from f
union all select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) from f
union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) from f)
select class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, cast(support as bigint) as support from a""")
def class_report(spark, d):
    out = evaluate.class_report(evaluate.confusion(table(spark, d, "labels"), "quality", "toxic"))
    return out.select("class", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


@query("select round(avg(cast(quality = toxic as double)), 9) as accuracy from labels")
def accuracy(spark, d):
    return evaluate.accuracy(table(spark, d, "labels"), "quality", "toxic").select(F.round("accuracy", 9).alias("accuracy"))


@query(f"with {_LINES} select replace(replace(line, '(', ''), ')', '') as stripped, cast(regexp_matches(line, '[有不無下上為後]') as int) as has_function_word, count(*) as n from lines group by all")
def strip_punctuation(spark, d):
    return lines(spark, d).groupBy(text.without_punctuation(F.col("line")).alias("stripped"), text.has_function_word(F.col("line")).alias("has_function_word")).agg(F.count("*").alias("n"))


@query("""with a as (select conv_id, turn, '在、' || role || '、、河。、' as line from conversations where turn % 4 <> 3)
select conv_id, turn, cast(len(list_filter(string_split(line, '、'), lambda t: trim(t) <> '')) as int) as tokens from a""")
def token_split(spark, d):
    a = _annotated(spark, d).where(text.annotation_line(F.col("line")))
    return a.select((F.col("ord") / 1000).cast("long").alias("conv_id"), (F.col("ord") % 1000).alias("turn"), F.size(text.annotated_tokens(F.col("line"))).alias("tokens"))


@query("select count(*) as n from conversations where turn % 4 = 3 and turn % 3 <> 0 having count(*) >= 0")
def error_slice(spark, d):
    """Lines of false positives, by the slice of rows told wrongly."""
    a = _annotated(spark, d).withColumn("result", F.contains("line", F.lit("false positive")).cast("int") * -1 + 1)
    return evaluate.errors(a).agg(F.count("*").alias("n"))


def part_lines(spark, d) -> DataFrame:
    """Parts as dictionary lines."""
    p = table(spark, d, "part")
    none = F.lit(None).cast("string")
    return p.select(
        F.col("p_partkey").alias("ord"), F.lit(0).alias("file"), F.col("p_partkey").alias("id"), F.col("p_name").alias("simplified"),
        F.when(F.col("p_size") % 2 == 0, "\\N").otherwise(F.col("p_brand")).alias("traditional"), F.translate("p_name", "aeiou", "āéǐòu").alias("pinyin"),
        F.concat_ws(" ", "p_type", "p_name").alias("english"), none.alias("grammar"), none.alias("notes"), F.col("p_partkey").alias("headword"),
    )


def part_entries(spark, d) -> DataFrame:
    return dictionary.entries(part_lines(spark, d))


_ENTRY = """lines as (select p_partkey as o, p_name as simplified, case when p_size % 2 = 0 then '\\N' else p_brand end as traditional, translate(p_name, 'aeiou', 'āéǐòu') as pinyin, p_type || ' ' || p_name as english from part),
keyed as (select simplified as key, * from lines union all select traditional, * from lines where traditional <> '\\N' and traditional <> simplified),
entry as (select key, min(o) as o, count(*) as n, case when count(*) = 1 then min(english) else string_agg(r || '. ' || english, '; ' order by o) end as english,
  array_to_string(list_sort(list_distinct(list(pinyin))), ', ') as pinyin
  from (select *, row_number() over (partition by key order by o) as r from keyed) group by key)"""


@query(f"with {_ENTRY} select key, o as headword_id, cast(n as bigint) as n_senses from entry")
def dict_group_senses(spark, d):
    return part_entries(spark, d).select("key", "headword_id", F.size("senses").cast("long").alias("n_senses"))


@query(f"with {_ENTRY} select key, english, pinyin from entry")
def dict_rollup(spark, d):
    return dictionary.rolled_up(part_entries(spark, d)).select("key", "english", "pinyin")


@query(f"with {_ENTRY} select key, english from entry where key = '{WORD}'")
def dict_lookup(spark, d):
    return dictionary.rolled_up(dictionary.lookup(part_entries(spark, d), WORD)).select("key", "english")


_THEIRS = "theirs as (select p_brand || ' ' || p_size as key, count(*) as n from part group by 1)"


def _theirs(spark, d) -> DataFrame:
    """Parts as entries of another dictionary."""
    p = table(spark, d, "part")
    return convert.entries(p.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("simplified"), F.concat_ws(" ", "p_brand", "p_size").alias("traditional"), F.lit("x").alias("pinyin"), F.col("p_type").alias("english")))


@query(f"with {_THEIRS} select key, cast(n as int) as n_senses from theirs where key not in (select distinct p_brand || ' ' || p_size from part where p_size % 3 = 0)")
def dict_antijoin(spark, d):
    """Entries of another dictionary that ours, of some sizes only, doesn't have."""
    ours = _theirs(spark, d).where(F.split("key", " ")[1].cast("int") % 3 == 0)
    return convert.absent(_theirs(spark, d), ours).select("key", "n_senses")


@query("""with words as (select string_agg(word, '|' order by length(word) desc, word) || '|(?s:.)' as p from (select distinct unnest(string_split(p_name, ' ')) as word from part))
select p_partkey, array_to_string(regexp_extract_all(p_name, p), '/') as tokens from part, words""")
def dict_semijoin(spark, d):
    """Tokens by the semi-join of pieces with the words, the way of dictionaries too large to send."""
    out = tokenize.tokens_by_join(table(spark, d, "part"), _words(spark, d), "p_name")
    return out.select("p_partkey", F.array_join("tokens", "/").alias("tokens"))


@query("""with words as (select string_agg(word, '|' order by length(word) desc, word) || '|(?s:.)' as p from (select distinct cast(o_orderkey as varchar) as word from orders)),
t as (select p_partkey, p_partkey || '-' || p_partkey * 37 || p_size as x from part)
select p_partkey, array_to_string(regexp_extract_all(x, p), '/') as tokens from t, words""")
def tokenize_dictionary(spark, d):
    """A dictionary of as many words as there are orders."""
    words = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("word"))
    x = F.concat(F.col("p_partkey").cast("string"), F.lit("-"), (F.col("p_partkey") * 37).cast("string"), F.col("p_size").cast("string"))
    out = tokenize.tokenize(table(spark, d, "part").select("p_partkey", x.alias("x")), words, "x")
    return out.select("p_partkey", F.array_join("tokens", "/").alias("tokens"))


@query("select p_name as key, max(p_partkey) as last from part group by p_name")
def dict_merge(spark, d):
    """Two files of which the later one replaces entries; numbers of the first are larger, so a sense of it would show."""
    e = dictionary.entries(_two_files(spark, d), merge="replace").where(F.col("key").contains(" "))
    return e.select("key", F.array_max(F.transform("senses", lambda s: s["notes"].cast("long"))).alias("last"))


def _two_files(spark, d) -> DataFrame:
    """Parts as two dictionary files, with their numbers as notes; the second has no traditional forms."""
    first = part_lines(spark, d)
    second = first.withColumns({"file": F.lit(1), "ord": F.col("ord") + (1 << 40), "traditional": F.lit("\\N"), "english": F.concat(F.lit("new "), "english")})
    return first.withColumn("notes", (F.col("id") + (1 << 40)).cast("string")).unionByName(second.withColumn("notes", F.col("id").cast("string")))


@query("""with l as (select p_name as key, p_partkey as o, 'new ' || p_type || ' ' || p_name as e from part union all
select p_brand, p_partkey, p_type || ' ' || p_name from part where p_size % 2 <> 0 and p_brand <> p_name and p_brand not in (select p_name from part))
select key, count(*) as n, string_agg(e, '|' order by o) as content from l group by key""")
def dict_merge_senses(spark, d):
    """Number and content of the senses that a merge leaves."""
    e = dictionary.entries(_two_files(spark, d), merge="replace")
    return e.select("key", F.size("senses").cast("long").alias("n"), F.array_join(F.transform("senses", lambda s: s["english"]), "|").alias("content"))


def _letters(spark) -> DataFrame:
    rows = [(i, 0, i, s, t, p, e, None, None, i) for i, (s, t, p, e) in enumerate([("e", "é", "Ē", "letter e"), ("a", "\\N", "ā", "letter a"), ("n", "ñ", "ně", "letter n"), ("o", "ö", "o", "letter o")])]
    return dictionary.entries(spark.createDataFrame(rows, "ord long, file int, id long, simplified string, traditional string, pinyin string, english string, grammar string, notes string, headword long"))


@query("select p_partkey, translate(p_name, 'eno', 'éñö') as converted from part")
def to_traditional(spark, d):
    return dictionary.to_traditional(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("text")), _letters(spark)).select("p_partkey", "converted")


@query("""with x as (select p_partkey, translate(p_name, 'eno', 'éñö') as t, string_split(translate(p_name, 'eno', 'éñö'), '') as c from part),
y as (select p_partkey, t, list_transform(c, lambda z: case z when 'é' then 'ē' when 'a' then 'ā' when 'ñ' then 'ně' when 'ö' then 'o' when 'e' then 'ē' else ' ' end) as p from x)
select p_partkey, translate(t, 'éñö', 'eno') as simplified, case when translate(t, 'éñö', 'eno') = t then '\\N' else t end as traditional, case when len(p) > 3 then array_to_string(p, ' ') else array_to_string(p, '') end as pinyin from y""")
def to_simplified(spark, d):
    made = table(spark, d, "part").select("p_partkey", F.translate("p_name", "eno", "éñö").alias("text"))
    return dictionary.to_simplified(made, _letters(spark)).select("p_partkey", "simplified", "traditional", "pinyin")


@query(f"select distinct translate(x, '{MARKED}', '{PLAIN}') || translate(right(regexp_replace(x, '[^{MARKED}]', '', 'g'), 1), '{MARKED}', '{TONES}') as numbered, x as syllable from (select translate(p_name, 'aeio', 'āéǐò') as x from part)")
def numeric_pinyin(spark, d):
    x = F.translate("p_name", "aeio", "āéǐò")
    return table(spark, d, "part").select(numbered(x).alias("numbered"), x.alias("syllable")).distinct()


@query("""with lines as (select p_partkey as o, p_name as s, case when p_size % 2 = 0 then '\\N' else p_brand end as t, translate(p_name, 'aeiou', 'āéǐòu') as p from part),
parts as (select * from (values (0, 'red bolt'), (1, 'Brand#11'), (2, 'Brand#12')) as v(i, part)),
byt as (select t as part, min(o) as o from lines group by 1), bys as (select s as part, min(o) as o from lines group by 1),
met as (select i, part, byt.o is not null as as_t, coalesce(byt.o, bys.o) as o from parts left join byt using (part) left join bys using (part)),
v as (select i, met.o is not null as found, coalesce(s, '') as s, coalesce(case when as_t then t else s end, '') as t, replace(coalesce(p, ''), ' ', '') as p from met left join lines on lines.o = met.o)
select (select count(*) + 2 from part) as id, string_agg(s, '' order by i) as simplified, case when string_agg(s, '' order by i) = string_agg(t, '' order by i) then '\\N' else string_agg(t, '' order by i) end as traditional, string_agg(p, '' order by i) as pinyin, bool_and(found) as found from v""")
def find_or_fallback(spark, d):
    """A new entry: each part by its traditional form, else by its simplified one."""
    parts = spark.createDataFrame([(0, "red bolt"), (1, "Brand#11"), (2, "Brand#12")], "ord int, part string")
    return dictionary.assembled(parts, part_lines(spark, d), "made", "noun").select("id", "simplified", "traditional", "pinyin", "found")


@query("""select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: translate(w, 'aeiou', 'āéǐòu')), ' ') as sound from part""")
def pinyin_reformat(spark, d):
    """Sounds of texts by the words they are made of."""
    none, w = F.lit(None).cast("string"), _words(spark, d)
    rows = w.select(F.xxhash64("word").alias("ord"), F.lit(0).alias("file"), F.lit(0).alias("id"), F.col("word").alias("simplified"), F.lit("\\N").alias("traditional"), F.translate("word", "aeiou", "āéǐòu").alias("pinyin"), none.alias("english"), none.alias("grammar"), none.alias("notes"), F.lit(0).alias("headword"))
    texts = table(spark, d, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("·")).alias("simplified"))
    return convert.with_formatted_pinyin(texts, dictionary.entries(rows)).select("p_partkey", "sound")


@query("select p_name as line, count(*) as n from part group by all")
def text_scan(spark, d):
    """Lines that end in carriage returns too."""
    path = folder(spark)
    table(spark, d, "part").select(F.concat("p_name", F.lit("\r"))).write.text(path)
    return corpus.lines(spark, path).groupBy("line").agg(F.count("*").alias("n"))


@query("select p_name || ' of ' || p_brand as line, count(*) as n from part where p_brand in ('Brand#11', 'Brand#12', 'Brand#13') group by all")
def indexed_scan(spark, d):
    """A collection index that names an index of documents, which names files; files that no index names stay out."""
    home = folder(spark)
    p = table(spark, d, "part").where("p_brand < 'Brand#20'")
    files = [f"b{i}" for i in (11, 12, 13)]
    for i, name in enumerate(["b11", "b12", "b13", "b14"]):
        p.where(f"p_brand = 'Brand#{11 + i}'").select(F.concat_ws(" of ", "p_name", "p_brand")).write.text(f"{home}/texts/{name}")
    written = lambda lines, where: spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{home}/data/corpus/{where}")
    written(["# collections", "one.csv\tgloss\ttitle", "two.csv\tgloss\ttitle"], "collections.csv")
    written(["# documents", *(f"{x}\tgloss\ttitle" for x in files[:2])], "one.csv")
    written([f"{x}\tgloss\ttitle" for x in files[2:]], "two.csv")
    return corpus.indexed_lines(spark, home, "texts").groupBy("line").agg(F.count("*").alias("n"))


@query("select p_brand as key, count(*) as n, sum(count(*)) over () as total from part group by p_brand")
def count_files(spark, d):
    """Counts written as text and read back, with their total."""
    path = folder(spark)
    tables.write_lines(table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n")), path, "p_brand", "n")
    back = tables.frequencies(spark, path)
    return back.crossJoin(F.broadcast(tables.total(back)))


@query("select p_type as term, round(avg(p_size) - 20, 6) as mi from part group by p_type")
def score_files(spark, d):
    path = folder(spark)
    tables.write_lines(table(spark, d, "part").groupBy("p_type").agg(F.round(F.avg("p_size") - 20, 6).alias("mi")), path, "p_type", "mi")
    return tables.mutual_information(spark, path)


@query("select p_type as term, p_size / 8 as mi, p_size % 2 as has_function_word, p_size % 3 as result, count(*) as n from part group by all")
def training_files(spark, d):
    """Rows of training files, which begin with a header."""
    path = folder(spark)
    p = table(spark, d, "part")
    rows = p.select("p_type", (F.col("p_size") / 8).alias("mi"), (F.col("p_size") % 2).alias("f"), (F.col("p_size") % 3).alias("r"))
    tables.write_lines(rows.unionByName(spark.createDataFrame([("# Term", 0.0, 0, 0)], "p_type string, mi double, f int, r int")), path, "p_type", "mi", "f", "r")
    back = tables.tokenizer_training(spark, path)
    return back.groupBy(*back.columns).agg(F.count("*").alias("n"))


@query("""select user_id as query, event_type as term, cast(json_extract(props, '$.k') as int) as hamming, count(*) as n from events group by all""")
def sample_files(spark, d):
    """Samples as CSV, read by place."""
    path = folder(spark)
    k = F.get_json_object("props", "$.k").alias("Hamming")
    zero = [F.lit(0).alias(c) for c in ("Pinyin Match", "In Notes", "Unigram Count")]
    tables.write_table(table(spark, d, "events").select(F.col("user_id").alias("Query"), F.lit(1).alias("Rank"), F.col("event_type").alias("Term"), *zero, k, F.lit(0).alias("Is Substring"), F.lit(1).alias("Relevant")), path)
    back = tables.similarity_samples(spark, path).where("is_relevant = 1 and rank = 1")
    return back.groupBy(F.col("query").cast("long").alias("query"), "term", "hamming").agg(F.count("*").alias("n"))


@query("select word, frequency, collection, document, round(idf, 9) as idf, doc_len from (with " + r"""tokens as (select c_mktsegment as collection, c_name as document, unnest(string_split(c_name, '#')) as word from customer),
tf as (select collection, document, word, count(*) as frequency from tokens group by all), dl as (select document, cast(sum(frequency) as bigint) as doc_len from tf group by all), df as (select word, count(*) as df from tf group by all)
select word, frequency, collection, document, log10(((select count(*) from dl) + 1) / df) as idf, doc_len from tf join dl using (document) join df using (word))""")
def frequency_files(spark, d):
    """Word frequencies of customers' names, written and read back."""
    path = folder(spark)
    tokens = table(spark, d, "customer").select(F.col("c_mktsegment").alias("collection"), F.col("c_name").alias("document"), F.explode(F.split("c_name", "#")).alias("word"))
    f = ranking.word_frequencies(tokens)
    tables.write_lines(f, path, *f.columns)
    return tables.word_frequencies(spark, path).withColumn("idf", F.round("idf", 9))


@query("select s_suppkey, s_name, s_acctbal from supplier where s_suppkey % 5 <> 0")
def typed_files(spark, d):
    """A typed table as text, some lines of which are comments."""
    path = folder(spark)
    name = F.when(F.col("s_suppkey") % 5 == 0, F.lit("#")).otherwise("")
    tables.write_lines(table(spark, d, "supplier").select(F.concat(name, F.col("s_suppkey").cast("string")).alias("s_suppkey"), "s_name", "s_acctbal"), path, "s_suppkey", "s_name", "s_acctbal")
    return corpus.typed_csv(spark, path, "s_suppkey long, s_name string, s_acctbal double", sep="\t", header=False, comment="#")


@query("select s_suppkey, s_acctbal, split_part(s_name, '#', 1) as s_name, cast(null as bigint) as s_nationkey from supplier where s_suppkey % 5 <> 0")
def typed_lines(spark, d):
    """The same with comments inside lines: a # ends names, and the field behind them goes with it."""
    path = folder(spark)
    start = F.when(F.col("s_suppkey") % 5 == 0, F.lit("#")).otherwise("")
    rows = table(spark, d, "supplier").select(F.concat(start, F.col("s_suppkey").cast("string")).alias("s_suppkey"), "s_acctbal", "s_name", "s_nationkey")
    tables.write_lines(rows, path, *rows.columns)
    return corpus.typed_lines(corpus.lines(spark, path), "s_suppkey long, s_acctbal double, s_name string, s_nationkey long", sep="\t")


@query("""with l as (select p_name as key, p_type as e, 0 as f, p_partkey as o from part where p_size % 2 = 0 union all select p_name, p_type, 1, p_partkey from part where p_size % 2 = 1
union all select p_brand, p_type, 1, p_partkey from part where p_size % 2 = 1)
select key, count(*) as n_senses, string_agg(distinct f, ',' order by f) as files from l group by key""")
def dictionary_files(spark, d):
    """Two files in the native format, put together."""
    path, p = folder(spark), table(spark, d, "part")
    none = [F.lit("\\N").alias(f"c{i}") for i in range(9)]
    for i in (0, 1):
        rows = p.where(f"p_size % 2 = {i}").select("p_partkey", "p_name", F.lit("\\N").alias("t") if i == 0 else F.col("p_brand").alias("t"), F.lit("x").alias("p"), F.concat_ws(" ", "p_type", F.lit(f"@{i}")).alias("e"), *none, F.lit("").alias("notes"), F.col("p_partkey").alias("headword"))
        tables.write_lines(rows, f"{path}/{i}", *rows.columns)
    e = dictionary.entries(dictionaries.open_lines(spark, [f"{path}/0", f"{path}/1"]))
    files = F.array_sort(F.array_distinct(F.transform("senses", lambda s: F.substring_index(s["english"], "@", -1))))
    return e.select("key", F.size("senses").cast("long").alias("n_senses"), F.array_join(files, ",").alias("files"))


@query("""select 'q' || user_id as query, event_type as term, cast(user_id % 5 as int) as unigram_count, count(*) as n from events where event_id % 3 <> 0 group by all""")
def log_files(spark, d):
    """Events as lines of JSON."""
    path, e = folder(spark), table(spark, d, "events")
    row = F.concat_ws(",", F.concat(F.lit(" q"), "user_id"), F.lit("1"), "event_type", F.lit("0"), F.lit("0"), F.col("user_id") % 5, F.lit("2"), F.lit("1"), F.lit("0"))
    payload = F.when(F.col("event_id") % 3 == 0, "x:1,2").otherwise(F.concat(F.lit("info: "), row))
    e.select(payload.alias("textPayload"), "event_id").write.json(path)
    return logs.samples(logs.read_logs(spark, path)).groupBy("query", "term", "unigram_count").agg(F.count("*").alias("n"))


@query("select 0 as src, substring(r_name, 1, 1) as symbol, r_regionkey + 1 as dst from region where r_regionkey % 2 = 0")
def fsm_transitions(spark, d):
    """Steps of a machine from the start, by the first letters of even regions."""
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("k"), F.substring("r_name", 1, 1).alias("symbol"))
    edges = r.select(F.lit(0).cast("long").alias("src"), "symbol", (F.col("k") + 1).alias("dst")).where("dst % 2 = 1")
    return prefix.transitions(edges, edges.select("src", "symbol").distinct()).where("dst % 2 = 1")


@query("""with l as (select p_partkey as ord, case when p_size % 10 = 0 then 'bad ' || p_name else p_brand || ' ' || p_name || ' [' || p_size || '] /' || p_type || '/' end as line from part)
select ord, regexp_extract(line, '(.*) (.*) \\[(.*)\\] /(.*)/', 1) as traditional, regexp_extract(line, '(.*) (.*) \\[(.*)\\] /(.*)/', 2) as simplified, regexp_extract(line, '(.*) (.*) \\[(.*)\\] /(.*)/', 3) as pinyin, regexp_extract(line, '(.*) (.*) \\[(.*)\\] /(.*)/', 4) as english
from l where regexp_matches(line, '(.*) (.*) \\[(.*)\\] /(.*)/')""")
def cedict_parse(spark, d):
    """Parts as lines of the other format, some of which do not parse."""
    good = F.concat("p_brand", F.lit(" "), "p_name", F.lit(" ["), "p_size", F.lit("] /"), "p_type", F.lit("/"))
    line = F.when(F.col("p_size") % 10 == 0, F.concat(F.lit("bad "), "p_name")).otherwise(good)
    return dictionaries.parsed_cedict(table(spark, d, "part").select(F.col("p_partkey").alias("ord"), line.alias("line")))[0]


@query("""select p_partkey, array_to_string(list_filter(list_transform(string_split(p_name, ''), lambda c: case c when 'e' then 'ē' when 'a' then 'a1' when 'n' then 'ne3' when 'o' then 'o' end), lambda x: x is not null), ' ') as numbered from part""")
def numbered_characters(spark, d):
    """Numbered sounds of the characters that are known."""
    return convert.numbered_pinyin(table(spark, d, "part"), _letters(spark), "p_name").select("p_partkey", F.lower("numbered").alias("numbered"))


def _names(spark, d) -> DataFrame:
    return part_entries(spark, d).where(F.col("key").contains(" "))


_HAMMING = "len(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: substring({a}, i, 1) <> substring({b}, i, 1))) + greatest(length({a}) - length({b}), 0)"
_NAMES = "names as (select distinct p_name as key from part)"


@query(f"with {_NAMES}, s as (select key, {_HAMMING.format(a=repr(WORD), b='key')} as score from names where key <> '{WORD}') select key, score from s where score = (select min(score) from s)")
def similar_hamming(spark, d):
    return similarity.by_hamming(_names(spark, d), WORD)


_SHARED = "len(list_filter(string_split('" + WORD + "', ''), lambda c: c <> '' and contains(key, c)))"


@query(f"with {_NAMES}, s as (select key, {_SHARED} as score from names where key <> '{WORD}') select key, score from s where score = (select max(score) from s)")
def similar_chars(spark, d):
    return similarity.by_characters(_names(spark, d), WORD)


@query(f"with {_NAMES}, s as (select key, {_HAMMING.format(a='o', b='p')} as score from (select key, translate(key, 'aeiou', 'āéǐòu') as p, translate('{WORD}', 'aeiou', 'āéǐòu') as o from names where key <> '{WORD}')) select key, score from s where score = (select min(score) from s)")
def similar_pinyin(spark, d):
    return similarity.by_pinyin(_names(spark, d), WORD)


@query(f"with {_NAMES}, s as (select key, {_HAMMING.format(a=repr(WORD), b='key')} as h, {_SHARED} as c from names where key <> '{WORD}') select key from s where h = (select min(h) from s) or c = (select max(c) from s)")
def similar_all(spark, d):
    return similarity.similar(_names(spark, d), WORD)


@query(f"select distinct p_name as word from part where starts_with(p_name, '{PREFIX}')")
def prefix_search(spark, d):
    return prefix.with_prefix(table(spark, d, "part").select(F.col("p_name").alias("word")), PREFIX)


@query("select distinct s_name as word, s_suppkey % 2 = 0 as recognized from supplier")
def trie_accept(spark, d):
    s = table(spark, d, "supplier")
    nodes = prefix.trie(s.where("s_suppkey % 2 = 0").select(F.col("s_name").alias("word")))
    return prefix.accepts(nodes, s.select(F.col("s_name").alias("word")))


@query("select distinct p_type as word, regexp_matches(p_type, '^(.*M.*)$') as recognized from part")
def fsm_recognizes(spark, d):
    """A machine with a choice in it: any text with an M."""
    m = prefix.Machine()
    end = m.new_state(accepting=True)
    for x in "ABCDEFGHIJKLMNOPQRSTUVWXYZ ":
        m.add_transition(0, x, 0)
        m.add_transition(end, x, end)
    m.add_transition(0, "M", end)
    nodes, edges = m.tables(spark)
    return prefix.recognizes(nodes, edges, table(spark, d, "part").select(F.col("p_type").alias("word")).distinct())


def _frequencies(spark, d) -> DataFrame:
    words = F.array_remove(F.split("text", r"[\s,.]+"), "")
    return ranking.word_frequencies(table(spark, d, "documents").select(F.col("source").alias("collection"), F.col("doc_id").cast("string").alias("document"), F.explode(words).alias("word")))


_FREQ = r"""tokens as (select source as collection, cast(doc_id as varchar) as document, unnest(regexp_split_to_array(text, '[\s,.]+')) as word from documents),
tf as (select collection, document, word, count(*) as frequency from tokens where word <> '' group by all),
dl as (select document, cast(sum(frequency) as bigint) as doc_len from tf group by all), df as (select word, count(*) as df from tf group by all),
wf as (select word, frequency, collection, document, log10(((select count(*) from dl) + 1) / df) as idf, doc_len from tf join dl using (document) join df using (word))"""


@query(f"with {_FREQ} select word, frequency, collection, document, round(idf, 9) as idf, doc_len from wf")
def word_freq_doc(spark, d):
    return _frequencies(spark, d).withColumn("idf", F.round("idf", 9))


@query(f"with {_FREQ} select document, round(sum(2.5 * frequency * idf / (frequency + 1.5 * (0.35 + 0.65 * (doc_len / 4497.0)))), 6) as bm25 from wf where word in ('tion', 'of', 'que') group by document order by sum(2.5 * frequency * idf / (frequency + 1.5 * (0.35 + 0.65 * (doc_len / 4497.0)))) desc, document limit 5000")
def bm25_topk(spark, d):
    return ranking.ranked(_frequencies(spark, d), ["tion", "of", "que"]).withColumn("bm25", F.round("bm25", 6))


@query(f"with {_FREQ} select document, frequency, doc_len from wf where word = 'the' order by frequency desc, document limit 2000")
def word_topk(spark, d):
    return ranking.of_word(_frequencies(spark, d), "the").select("document", "frequency", "doc_len")


#: English texts in which rules find something, by size of the part.
TEXTS = [
    "University of {n}", "to {n}", "variant of {n} (idiom)", "{n} (loanword from {b}); see also {t}", "county in {n}, 1956", "a {n} disease; {b} fever", "Buddha of {n} [ni2 hao3] (old)", "lit. {n} (idiom, {b} said)",
    "{n} Airlines, abbr. for {b}", "{n}able/ CL:{b}", "(Chinese unit of {n}) / also pr. {b}", "film director {n} (1920-1999), {t}", "City of {n} in Xinjiang", "{n} (Tw) (coll.); {b} sauce", "{n}ly!", "Hong Kong actor {n} 2015",
]


def _english(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    texts = F.element_at(F.array(*map(F.lit, TEXTS)), (F.col("p_partkey") % len(TEXTS)).cast("int") + 1)
    english = F.replace(F.replace(F.replace(texts, F.lit("{n}"), F.col("p_name")), F.lit("{b}"), F.col("p_brand")), F.lit("{t}"), F.col("p_type"))
    zh = F.element_at(F.array(*map(F.lit, ["寺", "一二三四", "县", "猫", "一二三四五", "麵茶"])), (F.col("p_partkey") % 6).cast("int") + 1)
    return p.select("p_partkey", english.alias("english"), zh.alias("simplified"), zh.alias("traditional"), (F.col("p_partkey") % 3).alias("n_senses"))


_TEXTS_SQL = "e as (select p_partkey, replace(replace(replace([" + ", ".join(f"'{t}'" for t in TEXTS) + f"][p_partkey % {len(TEXTS)} + 1], '{{n}}', p_name), '{{b}}', p_brand), '{{t}}', p_type) as english, ['寺', '一二三四', '县', '猫', '一二三四五', '麵茶'][p_partkey % 6 + 1] as simplified, p_partkey % 3 as n_senses from part), entries as (select *, simplified as traditional from e)"
_RULES = {"domain": (rules.DOMAIN, rules.DOMAIN_ELSE), "subdomain": (rules.SUBDOMAIN, rules.NOTHING_KNOWN), "entity_kind": (rules.ENTITY_KIND, rules.NOTHING_KNOWN), "grammar": (rules.GRAMMAR, rules.GRAMMAR_ELSE)}
_FLAGS = {
    "contains_alphanum": "regexp_matches(simplified, '[a-zA-Z0-9]')", "refers_to_variant": "starts_with(english, 'variant') or starts_with(english, 'see')", "contains_notes": "length(english) > 70",
    "contains_punctuation": "contains(simplified, '、') or contains(simplified, '，')", "ignored": rules.rule_sql([("y", rules.IGNORED)], "n") + " = 'y'",
    "is_modern_named_entity": "not (contains(english, 'idiom') or regexp_matches(english, '1[678][0-9][0-9]')) and (regexp_matches(english, '19[0-9][0-9]|2[0-2][0-9][0-9]') or (" + rules.rule_sql([("y", {"english": rules.ENTITY_WORDS})], "n") + " = 'y') or (length(simplified) > 6 and regexp_matches(english, '^\\p{Lu}.')))",
}


@query(f"with {_TEXTS_SQL} select p_partkey, " + ", ".join(f"{rules.rule_sql(*r)} as {k}" for k, r in _RULES.items()) + " from entries")
def rule_guesses(spark, d):
    return rules.analyzed(_english(spark, d)).select("p_partkey", *_RULES)


@query(f"with {_TEXTS_SQL} select p_partkey, " + ", ".join(f"({v}) as {k}" for k, v in _FLAGS.items()) + " from entries")
def rule_flags(spark, d):
    return rules.analyzed(_english(spark, d)).select("p_partkey", *_FLAGS)


@query(f"with {_TEXTS_SQL} select count(*) as absent, count(*) filter ({_FLAGS['contains_alphanum']}) as contain_alphanum, count(*) filter (length(simplified) = 1) as single_char, count(*) filter (n_senses > 1) as multiple_senses, count(*) filter ({_FLAGS['contains_notes']}) as contain_notes, count(*) filter ({_FLAGS['refers_to_variant']}) as refer_to_variant, count(*) filter ({_FLAGS['is_modern_named_entity']}) as modern_named_entities, count(*) filter ({_FLAGS['ignored']}) as ignored, count(*) filter ({_FLAGS['contains_punctuation']}) as contain_punctuation from entries")
def diff_summary(spark, d):
    return rules.summary(rules.analyzed(_english(spark, d)))


def _group_sql(x: str, pattern: str, n: int = 1) -> str:
    p = pattern.replace("'", "''")
    return f"case when regexp_matches({x}, '{p}') then regexp_extract({x}, '{p}', {n}) end"


def _english_sql(entries: str) -> str:
    """The steps of convert.with_formatted_english, each a query over the one before, up to xs (p_partkey, formatted)."""
    out, at = [f"{entries}, x0 as (select p_partkey, case when contains(english, '; ') then replace(english, ';', '/') else english end as x from entries)"], 0

    def step(sql: str) -> None:
        nonlocal at
        at += 1
        out.append(f"x{at} as (select p_partkey, {sql} as x from x{at - 1})")

    def without(part: str) -> str:
        return f"case when coalesce({part}, '') <> '' then replace(x, {part}, '') else x end"

    one = lambda p: _group_sql("x", p)
    both = lambda p: f"(({_group_sql('x', p, 1)}) || ({_group_sql('x', p, 2)}))"
    for part in (one(convert.PLACE), f"('(idiom, ' || ({one(convert.IDIOM)}) || ')')", f"('(' || ({one(convert.LOANWORD)}) || ')')", both(convert.ABBREVIATION), one(convert.CLASSIFIER), both(convert.ALSO), f"('(' || ({one(convert.UNIT)}) || ')')", one(convert.SAID)):
        step(without(f"({part})"))
    step(f"coalesce({one(convert.YEAR)}, x)")
    for t in convert.REMOVED:
        step(f"case when contains(x, '{t}') then trim(replace(x, '{t}', '')) else x end")
    step(without(f"({one(convert.BRACKETS)})"))
    step("trim(array_to_string(list_transform(string_split(x, '/'), lambda s: trim(s)), ' / '))")
    step("case when length(x) > 100 and contains(x, ' / ') then array_to_string(string_split(x, ' / ')[1 : len(string_split(x, ' / ')) - 1], ' / ') else x end")
    return f"with {', '.join(out)}, xs as (select p_partkey, x as formatted from x{at})"


@query(_english_sql(_TEXTS_SQL) + " select p_partkey, formatted from xs")
def english_reformat(spark, d):
    return convert.with_formatted_english(_english(spark, d)).select("p_partkey", "formatted")


def _notes_sql() -> str:
    """convert.formatted_notes over x (english, traditional)."""
    g = lambda p, n=1: _group_sql("english", p, n)
    raised = lambda e: f"upper(substring({e}, 1, 1)) || substring({e}, 2)"
    after, year = g(convert.YEAR, 3), g(convert.YEAR, 2)
    also = f"trim(substring({g(convert.ALSO, 1)}, 2) || {g(convert.ALSO, 2)})"
    rest = f"case when starts_with({after}, ',') then trim(substring({after}, 2)) else {after} end"
    notes = [raised(f"({g(convert.PLACE)})"), f"replace({raised(f'({g(convert.IDIOM)})')}, '\"', '')", raised(f"({g(convert.LOANWORD)})"), f"'Abbreviation ' || ({g(convert.ABBREVIATION, 2)})", raised(f"({also})"), g(convert.UNIT)]
    notes += [f"case when contains(english, '{t}') then '{n}' end" for t, n in convert.TAGS]
    notes.append(f"case when ({after}) = '' then {year} else ({year}) || '; ' || ({raised(f'({rest})')}) end")
    kept = f"list_filter([{', '.join(f'({n})' for n in notes)}], lambda n: n is not null)"
    first = f"y as (select p_partkey, case when len({kept}) > 0 then array_to_string({kept}, '; ') || ' ' else '' end || '(CC-CEDICT ''' || traditional || ''')' as t from entries)"
    without = lambda p: f"case when coalesce({_group_sql('t', p)}, '') <> '' then replace(t, {_group_sql('t', p)}, '') else t end as t"
    return f"{first}, z as (select p_partkey, {without(convert.BRACKETS)} from y) select p_partkey, {without(convert.PIPE).removesuffix(' as t')} as notes from z"


@query(f"with {_TEXTS_SQL}, {_notes_sql()}")
def notes_format(spark, d):
    return _english(spark, d).select("p_partkey", convert.formatted_notes(F.col("english"), F.col("traditional")).alias("notes"))


@query(_english_sql(f"""{_TEXTS_SQL.replace("entries as (select *, simplified as traditional from e)", "every as (select *, simplified || p_partkey as traditional from e), entries as (select * from every where p_partkey % 3 <> 0 and length(traditional) > 1 and not (starts_with(english, 'variant') or starts_with(english, 'see')) order by p_partkey limit 10)")}""")
+ " select 6005841 + row_number() over (order by p_partkey) as luid, simplified, traditional, formatted as english from xs join entries using (p_partkey)")
def diff_candidates(spark, d):
    """The first entries of another dictionary that could be added to ours."""
    e = _english(spark, d).withColumn("traditional", F.concat("traditional", F.col("p_partkey").cast("string"))).withColumn("ord", F.col("p_partkey"))
    theirs = convert.entries(e.withColumn("pinyin", F.lit("x")))
    ours = e.where("p_partkey % 3 = 0").select(F.col("traditional").alias("key"), F.array(F.struct(F.lit("x").alias("pinyin"))).alias("senses"))
    return convert.candidates(convert.absent(theirs, ours), ours).select("luid", "simplified", "traditional", "english")


@query("""with recursive lines as (select p_partkey as o, p_name as simplified, case when p_size % 2 = 0 then '\\N' else p_brand end as traditional, p_type || ' ' || p_name as english from part),
keyed as (select simplified as key, * from lines union all select traditional, * from lines where traditional <> '\\N' and traditional <> simplified),
s as (select key, string_agg(simplified, '、' order by o) as simplified from (select key, simplified, min(o) as o from keyed group by 1, 2) group by key),
t as (select key, string_agg(traditional, '、' order by o) as traditional from (select key, traditional, min(o) as o from keyed group by 1, 2) group by key),
n as (select key, min(o) as o, case when count(*) = 1 then min(english) else string_agg(r || '. ' || english, '; ' order by o) end as english from (select *, row_number() over (partition by key order by o) as r from keyed) group by key),
e as (select row_number() over (order by o, key) as i, simplified as s, case when traditional = '\\N' then simplified else traditional end as t, english from n join s using (key) join t using (key)),
f as (select cast(0 as bigint) as i, cast([] as varchar[]) as done, false as taken
  union all select f.i + 1, case when list_contains(done, s) or list_contains(done, t) then done else list_concat(done, [s, t]) end, not (list_contains(done, s) or list_contains(done, t)) from f join e on e.i = f.i + 1)
select t || ' ' || s || ' [] /' || english || '/' as line from e join f using (i) where taken""")
def cedict_text(spark, d):
    """Part entries as lines of the other format."""
    return convert.cedict_lines(part_entries(spark, d)).select("line")


@query("""with v as (select event_id, user_id, cast(json_extract(props, '$.k') as int) as k, event_type as t from events)
select 'q' || user_id as query, k + 1 as rank, t as term, cast(user_id % 2 as int) as pinyin_match, 0 as in_notes, cast(user_id % 5 as int) as unigram_count, k as hamming, 1 as is_substring, 0 as is_relevant from v where event_id % 3 <> 0""")
def log_samples(spark, d):
    """Events written as log lines, some of them too short."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    row = F.concat_ws(",", F.concat(F.lit(" q"), "user_id"), "k", "event_type", F.col("user_id") % 2, F.lit("0"), F.col("user_id") % 5, "k", F.lit("1"), F.lit("0"))
    payload = F.when(F.col("event_id") % 3 == 0, "x:1,2").otherwise(F.concat(F.lit("2024: info: "), row))
    return logs.samples(e.select(payload.alias("textPayload")))


def _samples(spark, d) -> DataFrame:
    l, x = table(spark, d, "labels"), table(spark, d, "documents")
    return x.join(l, "doc_id").select("doc_id", F.col("source").alias("query"), (F.col("doc_id") % 7).cast("int").alias("unigram_count"), (F.col("doc_id") % 11).cast("int").alias("hamming"), F.col("quality").alias("is_relevant"), "n_chars")


@query("select doc_id, length(source) as query_length, round((doc_id % 7) / length(source), 9) as unigram_ratio, round((doc_id % 11) / length(source), 9) as hamming_ratio from documents join labels using (doc_id)")
def features(spark, d):
    return learn.ratio_features(_samples(spark, d)).select("doc_id", "query_length", F.round("unigram_ratio", 9).alias("unigram_ratio"), F.round("hamming_ratio", 9).alias("hamming_ratio"))


@query("select 'n_chars' as column, count(*) as count, round(avg(n_chars), 6) as mean, round(stddev(n_chars), 6) as stddev, cast(min(n_chars) as double) as min, quantile_cont(n_chars, 0.25) as q1, quantile_cont(n_chars, 0.5) as median, quantile_cont(n_chars, 0.75) as q3, cast(max(n_chars) as double) as max from documents")
def describe(spark, d):
    out = evaluate.described(table(spark, d, "documents"), ["n_chars"])
    return out.withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 6)})


@query("select 'quality' as column, 'int' as type, count(quality) as present from labels union all select 'doc_id', 'bigint', count(doc_id) from labels union all select 'toxic', 'int', count(toxic) from labels")
def info(spark, d):
    return evaluate.info(table(spark, d, "labels"))


@query("select hamming_distance as d, count(*) as n from (select least(p_size, 3) as hamming_distance from part) group by all having false union all select " + _HAMMING.format(a="p_name", b="p_brand") + ", count(*) from part group by 1")
def hamming_histogram(spark, d):
    return table(spark, d, "part").groupBy(distance.hamming(F.col("p_name"), F.col("p_brand")).alias("d")).agg(F.count("*").alias("n"))


@query("select p_name || '/' || p_brand as path, 'x' as gloss from part where not starts_with(p_name, 'red')")
def index_paths(spark, d):
    """An index of parts, with those of one colour as comments."""
    line = F.concat(F.when(F.col("p_name").startswith("red"), "#").otherwise(""), "p_name", F.lit("/"), "p_brand", F.lit("\tx\t"), "p_type")
    rows = corpus.parsed_index(table(spark, d, "part").select(line.alias("line")), corpus.DOCUMENT_COLUMNS)
    return rows.select(corpus.joined_path(F.col("source_file")).alias("path"), F.col("gloss_file").alias("gloss"))


@query()
def dt_relevance(spark, d):
    rows = _samples(spark, d)
    model = learn.decision_tree(learn.raw_features(rows), ["unigram_count", "hamming", "query_length", "n_chars"], "is_relevant")
    return evaluate.confusion(learn.predicted(model, learn.raw_features(rows)), "is_relevant")


@query()
def lr_relevance(spark, d):
    rows = learn.raw_features(_samples(spark, d))
    model = learn.logistic_regression(rows, ["unigram_count", "hamming", "n_chars"], "is_relevant")
    return evaluate.confusion(learn.predicted(model, rows), "is_relevant")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From lines to the mutual information of their character pairs."""
    return mutual_info(spark, sf_dir)
