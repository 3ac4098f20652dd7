"""Classification of dictionary entries by ordered rules; the first that holds decides.

A rule is (result, keywords by field, and optionally a SQL condition).  It holds if any
keyword is in its field, case and all, or the condition does.  Entries need simplified,
traditional and english.  Rules become one CASE expression.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.functions.text import any_of, has_latin_or_digit, has_listing_mark, is_long, is_reference

E, S, T = "english", "simplified", "traditional"

# Results, keywords (spaces count) and conditions, in their order.
DOMAIN = [
    ("佛教\tBuddhism", {E: ["Buddha", "Buddhism"], S: ["寺"]}),
    ("商务\tCommerce", {E: ["Airlines", "Bank", "brand", "CEO", "Company", "company", "Commerce", "Corp", "Corporation", "Inc.", "publisher", "state-run", "website"]}),
    ("计算机科学\tComputer Science", {E: ["algorithm", "byte", "computer", "computing", "network", "server", "software"]}),
    ("戏剧\tDrama", {E: [" actor", "actress", "anime", "film", "Hong Kong act"]}),
    ("教育\tEducation", {E: ["Academy", "College", "Institute of Technology", "University"]}),
    ("历史\tHistory", {}, "english rlike '1[678][0-9][0-9]|19[0-5][0-9]'"),
    ("历史\tHistory", {E: ["19th century", "archaeological", "Battle", "Cultural Revolution", "Declaration", "Dynasty", "dynasty", "empire", "Empire", "(history)", "historical", "Incident", "Khan ", "Mao ", "Tang "]}),
    ("成语\tIdiom", {}, "contains(english, 'idiom') and length(simplified) = 4"),
    ("政府\tGovernment", {E: ["Administration", "Agency", "bureau", "Committee", "CPC", "Communist", "Commission", "Department", "Education", "government", "Ministry", "Nation", "Patriotic", "People's"]}),
    ("语言学\tLinguistics", {E: ["linguistics", "phonetics", "phonology"]}),
    ("文言文\tLiterary Chinese", {E: ["(arch.)", "archaic", "(classical)", "(literary)", "(old)", "(old usage)"]}),
    ("文学\tLiterature", {E: ["author of", "novel by", "novelist", "writer"]}),
    ("媒体\tMedia", {E: ["Daily", "newspaper", "News", "Publishing", "Press", "Times", "TV"]}),
    ("音乐\tMusic", {E: ["pop singer"]}),
    ("地方\tPlaces", {E: ["Archipelago", "banner", "Bay ", "capital ", " city", "city ", "City", "county", "County", "Desert", "Hotel", "Indonesia", "Island", "Kurdistan", "Lake", "Macau", "Manhattan", "Mongolia", "Morocco", "mountain range", "mountains", "Peninsula", "place in", "place name", "region", "republic", "River", "Myanmar", "prefecture", "province", "town", "Tower", "UK", "US state", " valley", "Vietnam"], S: ["庙", "湾", "区", "县", "镇"]}),
    ("政治\tPolitics", {E: ["politician", "political"]}),
    ("谚语\tProverb", {E: ["(proverb)"]}),
    ("谚语\tProverb", {}, "contains(english, '(idiom)') and length(simplified) > 4"),
    ("机科学\tScience", {E: ["physicist"]}),
    ("体育\tSport", {E: ["Athletics", "basketball", "Chinese athlete", "Games", "Olympic medalist", "soccer player", "tennis player"]}),
]
DOMAIN_ELSE = "现代汉语\tModern Chinese"

ENTITY_KIND = [
    ("学院\tAcademy", {E: ["Academy"]}),
    ("动物\tAnimal", {S: ["驼", "蟹", "猫", "狸", "獾", "猿"]}),
    ("作者\tAuthor", {E: ["novelist"]}),
    ("银行\tBank", {E: ["Bank"]}),
    ("鸟\tBird", {E: ["bird species"], S: ["鹭", "鸟", "鹉", "隼"]}),
    ("书名\tBook Title", {E: ["novel by"]}),
    ("星座\tConstellation", {E: ["constellation"]}),
    ("公司\tCompany", {E: ["Airlines", "Company", "company", "Corp", "Corporation", "Inc.", "Press", "publisher", "Publishing", "state-run"]}),
    ("地区\tDistrict", {E: ["district", "District"]}),
    ("城市\tCity", {E: ["capital", " city", "City", "city in"]}),
    ("县\tCounty", {E: ["county", "County"]}),
    ("民族\tEthnic Group", {E: ["ethnic group", "ethnic minority"]}),
    ("鱼\tFish", {E: ["(fish)", "shark"]}),
    ("昆虫\tInsect", {S: ["虫", "蛾", "蜂"]}),
    ("湖\tLake", {E: ["Lake"]}),
    ("药品\tMedication", {E: ["(drug)"]}),
    ("矿物\tMineral", {E: ["(mineral)"]}),
    ("星云\tNebula", {E: ["nebula"]}),
    ("报纸\tNewspaper", {E: ["Daily", "newspaper", "Times"]}),
    ("人\tPerson", {E: ["activist", "actor", "adventurer", "adviser", "ambassador", "artist", "astronomer", "author", "brother", "CEO", "chemist", "composer", "dictator", "diplomat", "doctor", "economist", "educator", "explorer", "founder", "inventor", "Khan ", "leader", "loyalist", "mathematician", "martyr", "minister", "missionary", "officer", "painter", "person name", "philosopher", "pioneer", "poet", "pop singer", "physicist", "politician", "priest", "psychologist", "president", "psychiatrist", "scientist", "Secretary", "sociologist", "theorist", "warlord", "writer"]}),
    ("地名\tPlace Name", {E: ["Archipelago", "banner", "Bay ", "Indonesia", "Islands", "Macau", "Morocco", "Mt", "prefecture", "mountains", "mountain range", "place in", "place name", "republic", "town", "prefecture", "province", "Tower", "US state", " valley"], S: ["县", "庙", "镇"]}),
    ("产品\tProduct", {E: ["brand"]}),
    ("水名\tRiver", {E: ["River"]}),
    ("姓氏\tSurname", {E: ["surname"]}),
    ("寺庙\tTemple", {S: ["寺"]}),
    ("树\tTree", {S: ["栎"]}),
    ("大学\tUniversity", {E: ["Institute of Technology", "Medical College", "University"]}),
]
SUBDOMAIN = [
    ("非洲\tAfrica", {E: ["Africa", "Botswana", "Congo", "Ethiopia", "Morocco", "Zimbabwe"]}),
    ("农业\tAgriculture", {E: ["agriculture", "farming"]}),
    ("考古学\tArchaeology", {E: ["archeology", "archaeology"]}),
    ("艺术\tArt", {E: ["(art)", "fine arts"]}),
    ("亚洲\tAsia", {E: ["Afghan", "Asia", "Azerbaijan", "Bangladesh", "Cambodia", "Himalayas", "India", "Indonesia", "Kazakhstan", "Korea", "Kurdistan", "Malaysia", "Myanmar", "Singapore", "Tajikistan", "Thailand", "Vietnam"]}),
    ("占星术\tAstrology", {E: ["astrology", "divination"]}),
    ("天文\tAstronomy", {E: ["astronomy", "constellation", "galaxy", "nebula", "Nebula", "(star)"], S: ["天文"]}),
    ("澳大利亚\tAustralia", {E: ["Australia"]}),
    ("生物学\tBiology", {E: ["bacteria", "biology", "(cell)", "chromosome", "genetic", "organism", "osterone"], S: ["胞", "脂肪"]}),
    ("植物学\tBotany", {E: ["botany"], S: ["栎"]}),
    ("化学\tChemistry", {E: ["acid", "C2", "C3", "C4", "C5", "alcohol", "biochemistry", "chemical", "chemistry", "chloride", "fluoride", "hydrate", "lactose", "molecular", "oxide", "sodium", "sulfur"], S: ["毒素"]}),
    ("中国\tChina", {E: ["Anhui", "Beijing", "China", "Chinese", "Chongqing", "CPC", "cultural revolution", "Cultural Revolution", "Fujian", "Gansu", "Guangdong", "Guizhou", "Guangxi", "Hainan", "Han dynasty", "Harbin", "Hangzhou", "Hebei", "Heilongjiang", "Henan", "Hong Kong", "Hubei", "Hunan", "Inner Mongolia", "Jiangsu", "Jiangxi", "Jilin", "Lhasa", "Liaoning", "Macau", "Mao", "Nanjing", "Ningxia", "PRC", "Qing", "Shandong", "Shanxi", "Shaanxi", "Shanghai", "Sichuan", "Tang ", "Tianjin", "Tibet", "Xiamen", "Xinjiang", "Yunnan", "Zhejiang"]}),
    ("中医\tChinese Medicine", {E: ["acupuncture", "(Chinese medicine)", "TCM"]}),
    ("基督教\tChristianity", {E: ["Bible", "biblical", "Christian", "(Christian ceremony)", "Corinthians", "epistle", "Gospel", "Revelation", "Testament"]}),
    ("服装\tClothing", {S: ["裤", "衫", "襟", "裙", "鞋"]}),
    ("方言\tDialect", {E: ["Cantonese", "dialect", "erhua variant", "Shanghainese"]}),
    ("经济\tEconomics", {E: ["economics"]}),
    ("电子工程\tElectronic Engineering", {E: ["circuit", "(electronics)", "(elec.)", "(electrical engineering)", "semiconductor"]}),
    ("英国\tEngland", {E: ["Britain", "British", "England", "English", "London", "UK"]}),
    ("欧洲\tEurope", {E: ["Austria", "Belgian", "Belgium", "Croatia", "Czech", "Dutch", "France", "French", "German", "Holland", "Hungary", "Irish", "Italy", "Italian", "Netherlands", "Norway", "Polish", "Portugal", "Roman", "Russia", "Scandinavian", "Scottish", "Soviet", "Spain", "Spanish", "Swedish", "Ukraine"]}),
    ("财会\tFinance and Accounting", {E: ["accountancy", "accounting", "finance"]}),
    ("饮食\tFood and Drink", {E: ["cuisine", "milk", " sauce"], S: ["饼", "餐", "茶", "蛋糕", "葱", "果", "酱", "酒", "咖啡", "辣椒", "巧克力", "蒜", "汤", "土豆"], T: ["麵"]}),
    ("地理\tGeography", {E: ["geography", "Ocean", "ocean", "peninsula"]}),
    ("地质\tGeology", {E: ["geological", "geology", "mineral"]}),
    ("几何\tGeometry", {E: ["geometry"]}),
    ("语法\tGrammar", {E: ["grammar"], S: ["句"]}),
    ("日本\tJapan", {E: ["Japan", "Tokyo"]}),
    ("法律\tLaw", {E: ["judicial", "(law)"], S: ["法官", "律师"]}),
    ("武术\tMartial Arts", {E: ["Martial Art"]}),
    ("数学\tMathematics", {E: ["algebra", "calculus", "equation", "math"], S: ["函数"]}),
    ("中东\tMiddle East", {E: ["Iran", "Iraq"]}),
    ("医学\tMedicine", {E: ["anatomy", "cancer", "coronary", "disease", "disorder", "(drug)", "erosis", "fever", "itis", "medical", "medicine", "(med.)", "paralysis", "psychiatry", "physiology", "surgery", "syndrome", "therapy", "vaccine", "virus"], S: ["病", "激素", "炎", "症"]}),
    ("音乐\tMusic", {E: ["guitar", "music", "(opera)"], S: ["歌", "琴", "樂器"]}),
    ("神话\tMythology", {E: ["deity", "mythology"]}),
    ("名字\tNames", {E: ["(name)"]}),
    ("北美\tNorth America", {E: ["Canada"]}),
    ("光学\tOptics", {E: ["(name)"]}),
    ("古生物学\tPaleontology", {E: ["dinosaur", "fossil", "paleo", "saurus"]}),
    ("语音学\tPhonetics", {E: ["phonetics"]}),
    ("摄影术\tPhotography", {E: ["photography"]}),
    ("政治\tPolitics", {E: ["political", "(politics)"]}),
    ("心理学\tPsychology", {E: ["(psych.)", "psychology"]}),
    ("物理\tPhysics", {E: ["(cosmology)", "(mechanics)", "physics", "thermodynamics"]}),
    ("宗教\tReligion", {E: ["religion"]}),
    ("俚语\tSlang", {E: ["curse", "netspeak", "slang"]}),
    ("航天\tSpace Flight", {S: ["航天", "宇航"]}),
    ("口语\tSpoken Language", {E: ["(coll.)(colloquial)"]}),
    ("体育\tSport", {E: ["(athletics)", "baseball", "basketball", "boxing", "football", "(golf)", "gymnastics", "soccer", " sport"]}),
    ("统计学\tStatistics", {E: ["statistics"]}),
    ("南美\tSouth America", {E: ["Argentina", "Brazil", "Venezuela"]}),
    ("美国\tUnited States", {E: ["America", "Boston", "California", "Colorado", "Hawaii", "Iowa", "Manhattan", "Massachusetts", "Nevada", "New York", "Pennsylvania", "Rhode Island", "Texas", "United States", "US"]}),
    ("动物学\tZoology", {E: ["bird family", "bird species", "(fish)", "whale", "shark", "zoology"], S: ["猫", "虫", "隼", "蛾", "蜂", "蟹", "鹭", "狸", "鸟", "驼", "鹉", "獾", "鲨", "猿"]}),
]
NOTHING_KNOWN = "\\N\t\\N"
#: Rules that can't hold as they stand, as they were meant.
MEANT = {"光学\tOptics": {E: ["optical", "optics"]}, "口语\tSpoken Language": {E: ["(coll.)", "(colloquial)"]}}
GRAMMAR = [
    ("interjection", {}, "english like '%!'"),
    ("proper noun", {}, r"english rlike '^\\p{Lu}' and not contains(english, 'idiom')"),
    ("onomatopoeia", {E: ["(onom.)"]}),
    ("interjection", {E: ["(interjection)"]}),
    ("phrase", {}, "length(simplified) > 4"),
    ("set phrase", {}, "length(simplified) = 4"),
    ("noun", {}, "startswith(english, 'a ')"),
    ("verb", {}, "startswith(english, 'to ')"),
    ("adverb", {}, "endswith(english, 'ly')"),
    ("adjective", {}, "english rlike '(ed|ing|ive|ious|able)$'"),
]
GRAMMAR_ELSE = "noun"
IGNORED = {E: ["erhua variant"], T: ["皇太後", "入團", "麵的", "正太", "李洪志", "法輪功"]}
ENTITY_WORDS = ["actress", "Administration", "Afghan", "Airlines", "Albania", "Algeria", "Angola", "America", "anime", "Anguilla", "Australia", "Austria", "Bahamas", "Bahrain", "basketball player", "Belgian", "brand", "Brazil", "British", "Business", "Cameroon", "Canadian", "Canada", "Cape Verde", "capital of", "Caribbean", "Carolina", "Catholic", "Chapel", "character", "Chinese diplomat", "Chinese politician", "Club", "Colorado", "Colombia", "Commission", "Company", "company", "comic", "Corporation", "corporation", "Council", "Croatia", "Cuba", "Cyprus", "Czech", "Dominica", "Dutch", "Egypt", "England", "English", "Ethiopia", "Europe", "female singer", "film director", "Film Festival", "Finland", "football player", "France", "French", "Gambia", "German", "given name", "Greece", "Greek", "Group", "Guomindang", "Harry Potter", "Hawaii", "HK-born", "Hong Kong actor", "Holland", "hotel chain", "Hungarian", "Idaho", "Iowa", "Iran", "Iraq", "Ireland", "Israel", "Italy", "Jewish", "Journal", "journalist and writer", "Kansas", "Kenya", "Kiribati", "Kyrgyzstan", "male name", "(name)", "Lebanon", "Lesotho", "London", "Manhattan", "manufacturer", "Mecca", "Mexican", "Ministry", "Morocco", "Mozambique", "NBA", "Netherlands", "Nevada", "New Caledonia", "New York", "New Zealand", "Nicaragua", "Niger", "Norway", "Palestine", "Palestinian", "Paris", "Party", "performing artist", "person name", "PLA", "Poland", "pop idol", "pop singer", "pop star", "Portugal", "proper name", "Pennsylvania", "Philippine", "PRC", "Qatar", "Russia", "Rwanda", "Saudi Arabia", "Scotland", "singer-songwriter", "singer and actor", "South Africa", "Spain", "Sudan", "supermarket", "surname", "Sweden", "Swiss", "Switzerland", "Syria", "Taiwanese politician", "Tanzania", "Tokyo", "Turkey", "United States", "(U.S.)", "US", "UK", "TV", "Ukraine", "University", "Uzbekistan", "Venice", "video game", "website", "Wyoming", "Zambia", "Zimbabwe"]


def _holds(keywords: dict[str, list[str]], condition: str | None = None) -> Column:
    tests = [any_of(F.col(f), k) for f, k in keywords.items()]
    return reduce(lambda a, b: a | b, tests + ([F.expr(condition)] if condition else []))


def decided(rules: list[tuple], otherwise: str, meant: bool = False) -> Column:
    out = F
    for rule in rules:
        result, keywords, *condition = rule
        out = out.when(_holds(MEANT.get(result, keywords) if meant else keywords, *condition), result)
    return out.otherwise(otherwise)


def domain() -> Column:
    return decided(DOMAIN, DOMAIN_ELSE)


def subdomain(meant: bool = False) -> Column:
    """meant: two rules that can never hold as they stand take the keywords they were meant to have."""
    return decided(SUBDOMAIN, NOTHING_KNOWN, meant)


def entity_kind() -> Column:
    return decided(ENTITY_KIND, NOTHING_KNOWN)


def grammar() -> Column:
    return decided(GRAMMAR, GRAMMAR_ELSE)


def ignored() -> Column:
    return _holds(IGNORED)


def modern_named_entity() -> Column:
    early = F.contains(E, F.lit("idiom")) | F.col(E).rlike("1[678][0-9][0-9]")
    named = F.col(E).rlike("19[0-9][0-9]|2[0-2][0-9][0-9]") | any_of(F.col(E), ENTITY_WORDS)
    return ~early & (named | ((F.length(S) > 6) & F.col(E).rlike(r"^\p{Lu}.")))


def analyzed(entries: DataFrame, meant: bool = False) -> DataFrame:
    """Adds the flags and guesses of each entry."""
    return entries.withColumns({
        "contains_alphanum": has_latin_or_digit(F.col(S)), "refers_to_variant": is_reference(F.col(E)),
        "contains_notes": is_long(F.col(E)), "contains_punctuation": has_listing_mark(F.col(S)),
        "is_modern_named_entity": modern_named_entity(), "ignored": ignored(), "grammar": grammar(),
        "domain": domain(), "subdomain": subdomain(meant), "entity_kind": entity_kind(),
    })


def summary(analysis: DataFrame) -> DataFrame:
    """One row of counts over analyzed entries (which also have n_senses)."""
    return analysis.agg(
        F.count("*").alias("absent"), F.count_if("contains_alphanum").alias("contain_alphanum"), F.count_if(F.length(S) == 1).alias("single_char"),
        F.count_if(F.col("n_senses") > 1).alias("multiple_senses"), F.count_if("contains_notes").alias("contain_notes"), F.count_if("refers_to_variant").alias("refer_to_variant"),
        F.count_if("is_modern_named_entity").alias("modern_named_entities"), F.count_if("ignored").alias("ignored"), F.count_if("contains_punctuation").alias("contain_punctuation"),
    )


def rule_sql(rules: list[tuple], otherwise: str) -> str:
    """The CASE of ANSI SQL for the same rules."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    out = []
    for result, keywords, *condition in rules:
        tests = [f"contains({f}, {q(k)})" for f, ks in keywords.items() for k in ks] + [sql_condition(c) for c in condition]
        out.append(f"when {' or '.join(tests)} then {q(result)}")
    return f"case {' '.join(out)} else {q(otherwise)} end"


def sql_condition(c: str) -> str:
    """A condition in the dialect that has regexp_matches for rlike."""
    import re

    c = re.sub(r"(\w+) rlike ('[^']*')", r"regexp_matches(\1, \2)", c)
    return "(" + c.replace("\\\\p", "\\p").replace("startswith", "starts_with").replace("endswith", "ends_with") + ")"
