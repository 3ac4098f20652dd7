"""Between dictionary formats: entries of CC-CEDICT, their differences, and their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossweave.functions.names import unused
from glossweave.functions.pinyin import numbered
from glossweave.functions.text import strip
from glossweave.operators import dictionary, rules
from glossweave.operators.tokenize import tokenize
from glossweave.sources.dictionaries import NOTHING

# Notes that end an English text, and what is taken out of it, in order.
TAGS = [("(loanword)", "Loanword"), ("(Tw)", "Taiwanese usage"), ("(Cantonese)", "Cantonese"), ("(Internet slang)", "Internet slang"), ("(derog.)", "Derogatory"), ("(bird species of China)", "Bird species of China")]
REMOVED = ['"', "(accountancy)", "(accounting)", "(agriculture)", "(anatomy)", "(archaic term)", "(arch.)", "(archaic)", "(archeology)", "(archaeology)", "(art)", "(astrology)", "(astron.)", "(astronomy)", "(athletics)", "(biochemistry)", "(biology)", "(bird species of China)", "(botany)", "(Buddhism)", "(Cantonese)", "(chemistry)", "(Chinese medicine)", "(Christian ceremony)", "(classical)", "(computing)", "(computer)", "(coll.)", "(colloquial)", "(constellation)", "(drug)", "(dialect)", "(dialectal)", "(dance)", "(derog.)", "(economics)", "(elec.)", "(electrical engineering)", "(electronics)", "ethnic minority", "(fig.)", "fig.", "(finance)", "(geography)", "(geology)", "(geometry)", "(grammar)", "(history)", "(idiom)", "in Xinjiang", "(interjection)", "(Internet slang)", ", Jilin", "(law)", "(language)", "(linguistics)", "(lit.)", "lit.", "(literary)", "(loanword)", "- Martial Art", "(math.)", "(math)", "(medical term)", "(medicine)", "(military)", "(molecular biology)", "(music)", "(mythology)", "of Beijing", "of Hong Kong", "(old)", "(old usage)", "(onom.)", "(philosopher)", "(philosophy)", "(photography)", "(proverb)", "(psychology)", "(physics)", ", Shanghai", "(slang)", "(sport)", "(sports)", "(statistics)", "/ Taiwan pr.", ",  Tibet", "(Tw)", "(zoology)"]
# Patterns whose groups are moved or dropped.
PLACE = r"(?i)^.*(county in.+|county of.+|county level city.+|prefecture level city.+|prefecture-level city.+|district of.+|district in.+|Lake in.+|town in.+|township in.+)$"
IDIOM, LOANWORD = r"(?i)^.*\(idiom, (.*)\)", r"(?i)^.*\((loanword.*)\)"
ABBREVIATION = r"^.*(/.?abbr. |\(abbr. |, abbr. )(.+)$"
CLASSIFIER, ALSO = r"^.*(/ CL:.+)$", r"^.*(/.?also written|/.?see also|/.?same as)(.+)$"
UNIT, SAID = r"^.*\((Chinese unit .+)\)", r"^.*(/ also pr.+)$"
YEAR = r"^(.*)\((.*[0-9][0-9][0-9].*)\)(.*)"
BRACKETS, PIPE = r"^.*(\[.*\]).*", r"^.* (.+\|).*"
FIRST_ID = 6005842


def entries(rows: DataFrame) -> DataFrame:
    """(key, ord, headword, senses) by traditional form; the headword is the first simplified form."""
    sense = F.struct("ord", "simplified", "traditional", "pinyin", "english")
    out = rows.groupBy(F.col("traditional").alias("key")).agg(F.min("ord").alias("ord"), F.min_by("simplified", "ord").alias("headword"), F.sort_array(F.collect_list(sense)).alias("senses"))
    return out.withColumn("senses", F.transform("senses", lambda s: s.dropFields("ord")))


def absent(theirs: DataFrame, ours: DataFrame) -> DataFrame:
    """Rolled-up entries whose key we don't have, with n_senses and their analysis."""
    rest = dictionary.rolled_up(theirs.join(ours.select("key"), "key", "left_anti")).withColumn("n_senses", F.size("senses"))
    return rules.analyzed(rest)


def _group(text: Column, pattern: str, n: int = 1) -> Column:
    """The group, null where the pattern doesn't match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, n))


def _raised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def _without(text: Column, part: Column) -> Column:
    """Every copy of part taken out, where there is one."""
    return F.when(part.isNotNull() & (part != ""), F.replace(text, part, F.lit(""))).otherwise(text)


def formatted_notes(english: Column, traditional: Column) -> Column:
    """What an English text says beside the meaning, and where the entry is from."""
    after = _group(english, YEAR, 3)
    rest = F.when(after.startswith(","), strip(F.substring(after, 2, 1 << 30))).otherwise(after)
    year = _group(english, YEAR, 2)
    also = strip(F.concat(F.substring(_group(english, ALSO, 1), 2, 1 << 30), _group(english, ALSO, 2)))
    notes = [
        _raised(_group(english, PLACE)),
        F.replace(_raised(_group(english, IDIOM)), F.lit('"'), F.lit("")),
        _raised(_group(english, LOANWORD)),
        F.concat(F.lit("Abbreviation "), _group(english, ABBREVIATION, 2)),
        _raised(also),
        _group(english, UNIT),
        *(F.when(F.contains(english, F.lit(tag)), F.lit(note)) for tag, note in TAGS),
        F.when(after == "", year).otherwise(F.concat(year, F.lit("; "), _raised(rest))),
    ]
    kept = F.array_compact(F.array(*notes))
    text = F.concat(F.when(F.size(kept) > 0, F.concat(F.array_join(kept, "; "), F.lit(" "))).otherwise(""), F.lit("(CC-CEDICT '"), traditional, F.lit("')"))
    text = _without(text, _group(text, BRACKETS))
    return _without(text, _group(text, PIPE))


def shortened(english: Column) -> Column:
    parts = F.split(english, " / ")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), " / ")).otherwise(english)


def with_formatted_english(df: DataFrame, english: str = "english", out: str = "formatted") -> DataFrame:
    """Adds the bare meaning.  Each step is a column of its own, as later steps read earlier results."""
    (name,) = unused(df, "__x")
    x = F.col(name)
    df = df.withColumn(name, F.when(F.contains(english, F.lit("; ")), F.replace(F.col(english), F.lit(";"), F.lit("/"))).otherwise(F.col(english)))
    closed = lambda head, pattern: F.concat(F.lit(head), _group(x, pattern), F.lit(")"))
    whole = lambda pattern: F.concat(_group(x, pattern, 1), _group(x, pattern, 2))
    for part in (_group(x, PLACE), closed("(idiom, ", IDIOM), closed("(", LOANWORD), whole(ABBREVIATION), _group(x, CLASSIFIER), whole(ALSO), closed("(", UNIT), _group(x, SAID)):
        df = df.withColumn(name, _without(x, part))
    df = df.withColumn(name, F.coalesce(_group(x, YEAR), x))
    removed = F.aggregate(F.array(*map(F.lit, REMOVED)), x, lambda a, t: F.when(F.contains(a, t), strip(F.replace(a, t, F.lit("")))).otherwise(a))
    df = df.withColumn(name, removed)
    df = df.withColumn(name, _without(x, _group(x, BRACKETS)))
    df = df.withColumn(name, strip(F.array_join(F.transform(F.split(x, "/"), strip), " / ")))
    return df.withColumn(out, F.when(F.length(x) > 100, shortened(x)).otherwise(x)).drop(name)


def with_formatted_pinyin(df: DataFrame, ours: DataFrame, out: str = "sound") -> DataFrame:
    """Adds pinyin of ``simplified`` by its words; null where a word is unknown."""
    words = ours.select(F.col("key").alias("word"))
    told = tokenize(df.select(F.col("simplified").alias("text")).distinct(), words, exclude_whole=True)
    parts = told.select("text", F.posexplode("tokens").alias("i", "word")).where("word <> '·'")
    met = parts.join(ours.select(F.col("key").alias("word"), F.col("senses")[0]["pinyin"].alias("p")), "word", "left")
    met = met.withColumn("p", F.when(F.col("word") == "，", ", ").otherwise(F.col("p")))
    rows = met.groupBy("text").agg(F.bool_and(F.col("p").isNotNull()).alias("ok"), F.transform(F.sort_array(F.collect_list(F.struct("i", "p"))), lambda s: s["p"]).alias("ps"))
    apart = F.replace(F.replace(F.array_join("ps", " "), F.lit(" , "), F.lit(", ")), F.lit(",  "), F.lit(", "))
    rows = rows.select(F.col("text").alias("simplified"), F.when(F.col("ok"), F.when(F.length("text") > 3, apart).otherwise(F.array_join("ps", ""))).alias(out))
    return df.join(rows, "simplified", "left")


def candidates(missing: DataFrame, ours: DataFrame, n: int = 10) -> DataFrame:
    """The first n absent entries that could be added, as rows of the native format with new ids."""
    some = missing.where("not contains_alphanum and length(key) > 1 and not refers_to_variant").orderBy("ord").limit(n)
    some = with_formatted_pinyin(with_formatted_english(some), ours)
    luid = F.row_number().over(Window.orderBy("ord")) + F.lit(FIRST_ID - 1)
    out = some.withColumn("luid", luid.cast("long"))
    shown = F.when(F.col("simplified") == F.col("key"), NOTHING).otherwise(F.col("key"))
    return out.select("luid", "simplified", shown.alias("traditional"), F.col("sound").alias("pinyin"), F.col("formatted").alias("english"), "grammar", "entity_kind", "domain", "subdomain", F.lit(rules.NOTHING_KNOWN).alias("none"), formatted_notes(F.col("english"), F.col("key")).alias("notes"), F.col("luid").alias("headword"))


def numbered_pinyin(df: DataFrame, ours: DataFrame, text: str = "simplified", last_letter_only: bool = False) -> DataFrame:
    """Adds ``numbered``: syllables of the characters that are known, with numbers, apart."""
    known = dictionary.characters_known(dictionary.rolled_up(ours), numbered(F.col("pinyin"), last_letter_only))
    told = dictionary._converted(df, text, known, lambda t, k: " ".join(k[c] for c in t if k.get(c) is not None), "string")
    return df.withColumn("numbered", F.coalesce(told, F.lit("")))


def cedict_lines(ours: DataFrame, last_letter_only: bool = False) -> DataFrame:
    """(ord, line) in CC-CEDICT format; of entries that share a form with an earlier written one, none.

    That choice depends on the order of the whole dictionary: the entries' two forms are
    gathered and folded once, which a dictionary's size allows.
    """
    e = dictionary.rolled_up(ours).where(F.col("english") != NOTHING)
    e = e.withColumn("traditional", F.when(F.col("traditional") == NOTHING, F.col("simplified")).otherwise(F.col("traditional")))
    # Entries that share no form with another decide for themselves; only the rest is folded.
    forms = e.select("ord", "key", F.explode(F.array_distinct(F.array("simplified", "traditional"))).alias("form"))
    shared = forms.groupBy("form").agg(F.count("*").alias("n")).where("n > 1").select("form")
    bound = forms.join(shared, "form", "left_semi").select("ord", "key").distinct()
    done, chosen = set(), []
    for r in e.join(bound, ["ord", "key"], "left_semi").select("ord", "key", "simplified", "traditional").orderBy("ord", "key").toLocalIterator():
        if r.simplified not in done and r.traditional not in done:
            done |= {r.simplified, r.traditional}
            chosen.append((r.ord, r.key))
    kept = e.sparkSession.createDataFrame(chosen, "ord long, key string")
    out = e.join(bound, ["ord", "key"], "left_anti").unionByName(e.join(kept, ["ord", "key"], "left_semi"))
    out = numbered_pinyin(out, ours, "simplified", last_letter_only)
    return out.select("ord", F.format_string("%s %s [%s] /%s/", "traditional", "simplified", "numbered", "english").alias("line"))
