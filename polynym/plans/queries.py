"""Queries over the given tables, one for each operator, and the same in DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polynym.functions.script import detect_script, is_same_script
from polynym.functions.similarity import char_ngrams, cosine
from polynym.functions.text import id_from_uri, language_pair, normalize_for_matching, normalize_title, strip_diacritics
from polynym.functions.translit import transliterate_to_latin
from polynym.operators import metrics, negatives, reports
from polynym.operators.cascade import Cascade
from polynym.operators.cluster import cluster_sizes as sizes_of
from polynym.operators.cluster import collect_clusters, gold_clusters
from polynym.operators.materialize import materialize
from polynym.plans.resolver import Resolver
from polynym.sources.entities import sitelink_pairs as joined_sitelinks
from polynym.sources.entities import stratified

Query = Callable[[SparkSession, str], DataFrame]
TIERS = Cascade(0.85, 0.82, 0.5)

# Transliterations that have to come out so.
PINS = (
    ("Путин", "", "Putin"), ("Барак Обама", "", "Barak Obama"), ("百度", "zh", "bai du"), ("习近平", "zh", "xi jin ping"), ("輝瑞", "zh", "hui rui"),
    ("新少林寺/SHAOLIN", "zh", "xin shao lin si/SHAOLIN"), ("安倍晋三", "ja", "abe shinzou"), ("東京タワー", "", "toukyou tawaa"), ("安倍晋三", "", "an bei jin san"),
    ("율리야 리프니츠카야", "", "yulriya ripeunicheukaya"), ("말뫼", "", "malmoe"), ("مالمو", "", "malmw"), ("فلاديمير بوتين", "", "fladymyr bwtyn"), ("Malmö", "", "Malmö"),
)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(c: str | F.Column, alias: str) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(alias)


# -- text ------------------------------------------------------------------


def normalize_names(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", normalize_for_matching(F.col("text")).alias("norm"))


def diacritics(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", strip_diacritics(F.col("text")).alias("plain"))


def title_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", normalize_title(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


def url_tail(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", id_from_uri(F.col("url")).alias("tail"))


def script_profile(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").groupBy("lang", detect_script(F.col("text")).alias("script")).agg(F.count("*").alias("n"))


def language_pairs(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    both = docs.alias("a").join(docs.alias("b"), "source").where("a.lang < b.lang")
    return both.groupBy(language_pair(F.col("b.lang"), F.col("a.lang")).alias("pair")).agg(F.sum(F.least("a.n", "b.n")).alias("n"))


def transliterate_pins(spark: SparkSession, d: str) -> DataFrame:
    """Every part takes one of the pinned names by its key."""
    pins = F.array(*(F.struct(F.lit(a).alias("name"), F.lit(b).alias("lang")) for a, b, _ in PINS))
    rows = _t(spark, d, "part").select("p_partkey", F.get(pins, (F.col("p_partkey") % len(PINS)).cast("int")).alias("pin"))
    return rows.select("p_partkey", transliterate_to_latin(F.col("pin.name"), F.col("pin.lang"), spark).alias("latin"))


def name_trigrams(spark: SparkSession, d: str) -> DataFrame:
    names = _t(spark, d, "part").select("p_name").distinct()
    return names.select("p_name", F.explode(char_ngrams(F.lower("p_name"))).alias("gram")).groupBy("p_name", "gram").agg(F.count("*").alias("tf"))


# Letters that are written as one letter each, and how the queries respell names in other scripts.
LETTERS, CYRILLIC = "abvgdziklmnoprstufye", "абвгдзиклмнопрстуфйэ"
HANGUL = "".join(chr(0xAC00 + 28 * k) for k in range(len(LETTERS)))
ARABIC = "".join(chr(c) for c in range(0x627, 0x627 + len(LETTERS)))


def _respelt(spark: SparkSession, d: str) -> DataFrame:
    """Part names, less all other letters (``plain``), and as Latin, Cyrillic, Hangul or Arabic by turns."""
    plain = F.regexp_replace("p_name", f"[^{LETTERS} ]", "")
    turn = F.col("p_partkey") % 4
    text = F.when(turn == 1, F.translate(plain, LETTERS, CYRILLIC)).when(turn == 2, F.translate(plain, LETTERS, HANGUL)).when(turn == 3, F.translate(plain, LETTERS, ARABIC)).otherwise(plain)
    return _t(spark, d, "part").select("p_partkey", plain.alias("plain"), text.alias("text"))


def respelt_scripts(spark: SparkSession, d: str) -> DataFrame:
    return _respelt(spark, d).select("p_partkey", detect_script(F.col("text")).alias("script"), is_same_script(F.col("text"), F.col("plain")).alias("same"))


def respelt_latin(spark: SparkSession, d: str) -> DataFrame:
    rows = _respelt(spark, d).where("p_partkey % 4 < 2")
    return rows.select("p_partkey", transliterate_to_latin(F.col("text"), F.lit("ru"), spark).alias("latin"))


#: Words of part names in other scripts, each with what it is in Latin letters.
RUSSIAN = {"large": "Щука", "small": "Ёж", "red": "объезд", "blue": "Юля", "hot": "Чехия", "cold": "хвоя", "old": "Жюль", "new": "Цыц"}
JAPANESE = {"ring": ("指輪", "yubiwa"), "bolt": ("ボルト", "boruto"), "plate": ("皿", "sara"), "gear": ("歯車", "haguruma"), "widget": ("部品", "buhin"), "rod": ("棒", "bou"), "gizmo": ("きょう", "kyou"), "anvil": ("ばね", "bane")}


def _word(column: str, table: dict[str, str], otherwise: F.Column) -> F.Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col(column)), otherwise)


def spelt_cyrillic(spark: SparkSession, d: str) -> DataFrame:
    """Letters that are written as several, as none, and capitals: a word of every part, and its key in Cyrillic letters."""
    part = _t(spark, d, "part").withColumn("w", F.substring_index("p_name", " ", 1))
    text = F.concat(_word("w", RUSSIAN, F.lit("щи")), F.translate(_code("p_partkey"), "0123456789abcdef", "щШюЯъЁЖцЧхЬыэЙФл"))
    return part.select("p_partkey", transliterate_to_latin(text, F.lit("ru"), spark).alias("latin"))


def spelt_hangul(spark: SparkSession, d: str) -> DataFrame:
    """Two syllables of all 11172, with and without final letters, by key."""
    place = (F.col("p_partkey") * 7919) % 11172
    text = F.expr("concat(decode(unhex(lpad(hex(44032 + (p_partkey * 7919) % 11172), 4, '0')), 'UTF-16BE'), decode(unhex(lpad(hex(44032 + (p_partkey * 104729) % 11172), 4, '0')), 'UTF-16BE'))")
    return _t(spark, d, "part").select("p_partkey", place.alias("place"), transliterate_to_latin(text, F.lit("ko"), spark).alias("latin"))


def spelt_arabic(spark: SparkSession, d: str) -> DataFrame:
    """Keys in Arabic letters that are written as one, two or none."""
    text = F.translate(_code("p_partkey"), "0123456789abcdef", "اثخذشضغقةآؤءَپچژ")
    return _t(spark, d, "part").select("p_partkey", transliterate_to_latin(text, F.lit("ar"), spark).alias("latin"))


def spelt_japanese(spark: SparkSession, d: str) -> DataFrame:
    """Words of a given lexicon, and kana."""
    part = _t(spark, d, "part").withColumn("w", F.substring_index("p_name", " ", -1))
    words = {a: r for a, r in JAPANESE.values() if not re.fullmatch("[ぁ-ヺー]+", a)}
    text = F.concat(_word("w", {k: a for k, (a, _) in JAPANESE.items()}, F.lit("皿")), F.lit("の"), F.when(F.col("p_partkey") % 2 == 0, "指輪").otherwise("シャツ"))
    return part.select("p_partkey", transliterate_to_latin(text, F.lit("ja"), spark, words=words).alias("latin"))


def behaviour(spark: SparkSession, d: str) -> DataFrame:
    rows = _respelt(spark, d).where("p_partkey % 4 < 2").select(F.when(F.col("p_partkey") % 5 == 0, F.lit("")).otherwise(F.col("text")).alias("l2_title"))
    return reports.transliteration_behaviour(rows)


def cross_script_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Tiers 0, 3 and 4: names against themselves in capitals, in Cyrillic, in Cyrillic with the words swapped, and against nothing."""
    part = _respelt(spark, d)
    turn, plain = F.col("p_partkey") % 4, F.col("plain")
    cyrillic = F.translate(plain, LETTERS, CYRILLIC)
    swapped = F.concat(F.substring_index(plain, " ", -1), F.lit(" "), F.substring_index(plain, " ", 1))
    a = F.when(turn == 0, F.upper(plain)).when(turn == 3, F.lit("")).otherwise(cyrillic)
    b = F.when(turn == 2, swapped).otherwise(plain)
    pairs = part.select(a.alias("name_a"), b.alias("name_b"), F.when(turn == 0, "en").otherwise("ru").alias("lang_a"), F.lit("en").alias("lang_b"), F.lit("").alias("type_a"), F.lit("").alias("type_b")).distinct()
    return TIERS.match_pairs(pairs).select("name_a", "name_b", "is_match", "tier", "method", _r("score", "score"))


# -- pairs and clusters ----------------------------------------------------


def _part_keys(spark: SparkSession, d: str, types: bool = True) -> DataFrame:
    part = _t(spark, d, "part")
    keys = part.groupBy("p_name", *(["p_type"] if types else [])).agg(F.min("p_partkey").alias("kid"))
    typed = keys.withColumnRenamed("p_type", "entity_type") if types else keys.withColumn("entity_type", F.lit(""))
    return TIERS.derive(typed.select("kid", F.col("p_name").alias("name"), F.lit("en").alias("lang"), "entity_type"))


def jw_pairs(spark: SparkSession, d: str) -> DataFrame:
    found = TIERS.fuzzy_links(_part_keys(spark, d, types=False), "norm", 0.85, 2)
    return found.select("src", "dst", _r("score", "score"))


def trigram_cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    return TIERS.gram_scores(_part_keys(spark, d, types=False)).where("score >= 0.5").select("src", "dst", _r("score", "score"))


def cascade_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The full report of the cascade for all pairs of part names that share a type, and each with the next type's."""
    keys = _t(spark, d, "part").select("p_name", "p_type").distinct()
    a, b = (keys.select(F.col("p_name").alias(f"name_{s}"), F.lit("en").alias(f"lang_{s}"), F.col("p_type").alias(f"type_{s}")) for s in ("a", "b"))
    pairs = a.join(b, F.col("type_a") == F.col("type_b")).where("name_a < name_b")
    mixed = a.join(b, F.col("name_a") == F.col("name_b")).where("type_a < type_b")
    found = TIERS.match_pairs(pairs.unionByName(mixed))
    return found.select("name_a", "name_b", "type_a", "type_b", "is_match", "tier", "method", _r("score", "score"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part")
    return part.select(F.col("p_partkey").alias("idx"), F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.lit("en").alias("lang"), F.col("p_type").alias("entity_type"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return Resolver(TIERS.tier2, TIERS.tier3, 0.7).label(_records(spark, d))


def resolve_labels(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select("idx", "id", "cluster_id")


def resolve_clusters(spark: SparkSession, d: str) -> DataFrame:
    return collect_clusters(_labels(spark, d)).select("cluster_id", F.array_join("members", ",").alias("members"))


def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    return sizes_of(_labels(spark, d))


def gold_members(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part")
    rows = part.select(F.col("p_partkey").alias("idx"), F.col("p_brand").alias("id"), F.col("p_name").alias("name"), F.lit("en").alias("lang"))
    return gold_clusters(rows).select("id", F.array_join(F.col("members.name"), "|").alias("names"))


def dense_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Vectors and, of each, a second one without its first component, so that there are near pairs to find."""
    rows = _t(spark, d, "embeddings").select(F.col("vec_id").alias("kid"), F.col("label").cast("string").alias("etype"), F.col("embedding").alias("vector"))
    first = F.lit(0).cast("float")
    other = rows.select((F.col("kid") + 1_000_000).alias("kid"), "etype", F.concat(F.array(first), F.slice("vector", F.lit(2), F.size("vector") - 1)).alias("vector"))
    return Cascade(tier4=0.95, backend="vector").last_links(rows.union(other)).select("src", "dst", _r("score", "score"))


def label_centre_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's cosine with the first vector of its label."""
    v = _t(spark, d, "embeddings")
    first = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    return v.join(first, "label").select("vec_id", _r(cosine(F.col("embedding"), F.col("first")), "score"))


# -- negatives -------------------------------------------------------------


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Labelled pairs of part names: the second title swaps the words, or doubles the first one's end."""
    w1, w2 = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    l2 = F.when(F.col("p_partkey") % 3 == 0, F.concat(w2, F.lit(" "), w1)).when(F.col("p_partkey") % 3 == 1, F.concat(w1, F.lit("s "), w2)).otherwise(F.concat(w1, F.lit(" of the "), w2))
    return _t(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_brand").alias("qid"), F.col("p_name").alias("l1_title"), l2.alias("l2_title"), F.col("p_type").alias("bucket"))


def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    return negatives.hard_negatives(_pairs(spark, d)).withColumn("l1_jw_to_source", F.round("l1_jw_to_source", 6))


def _code(key: str) -> F.Column:
    return F.md5(F.col(key).cast("string"))


def lev_negatives(spark: SparkSession, d: str) -> DataFrame:
    """First titles have up to five further characters, so that distances from 0 to 5 occur and nearly all titles are distinct."""
    more = F.substring(_code("idx"), F.lit(1), (F.col("idx") % 6).cast("int"))
    edited = F.concat(F.substring("l1_title", 1, 3), more, F.substring(F.col("l1_title"), F.lit(4), F.length("l1_title")))
    return negatives.adversarial_negatives(_pairs(spark, d).withColumn("l1_title", edited))


def _names(spark: SparkSession, d: str) -> DataFrame:
    """Parts with names of their own: seven letters from the key, and the second word of the name."""
    own = F.translate(F.substring(_code("p_partkey"), 1, 7), "0123456789", "ghijklmnop")
    return _t(spark, d, "part").select("p_partkey", "p_brand", "p_type", F.concat(own, F.lit(" "), F.substring_index("p_name", " ", -1)).alias("name"))


def jw_distinct_names(spark: SparkSession, d: str) -> DataFrame:
    """Names that occur once each (20000 of them at sf0.1)."""
    names = _names(spark, d).groupBy("name").agg(F.min("p_partkey").alias("kid"))
    keys = Cascade().derive(names.withColumns({"lang": F.lit("en"), "entity_type": F.lit("")}))
    return Cascade().fuzzy_links(keys, "norm", 0.92, 2).select("src", "dst", _r("score", "score"))


def hard_negatives_names(spark: SparkSession, d: str) -> DataFrame:
    """The most similar name of the same brand and another type."""
    rows = _names(spark, d).select(F.col("p_partkey").alias("idx"), F.col("p_type").alias("qid"), F.col("name").alias("l1_title"), F.col("name").alias("l2_title"), F.col("p_brand").alias("bucket"))
    return negatives.hard_negatives(rows).select("idx", "bucket", "l2_title", "negative_qid", _r("l1_jw_to_source", "jw"))


def lev_histogram(spark: SparkSession, d: str) -> DataFrame:
    return lev_negatives(spark, d).groupBy("l1_levenshtein").agg(F.count("*").alias("n"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    pos = _pairs(spark, d).select("idx", "l1_title", "l2_title", "bucket", F.lit(True).alias("positive"))
    neg = negatives.hard_negatives(_pairs(spark, d)).select("idx", "l1_title", "l2_title", "bucket", F.lit(False).alias("positive"))
    rows = pos.unionByName(neg)
    # A pair of titles is scored once, however often it occurs. Scores are written, since a filter on them would be
    # rewritten in terms of the titles: expressions so large that the driver plans for minutes, whatever the tables' size.
    titles = rows.select("l1_title", "l2_title").distinct()
    return rows.join(materialize(reports.score_pairs(titles, TIERS), "scores"), ["l1_title", "l2_title"])


def scored_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("idx", "positive", "l1", "l2", "bucket", "t3_hit", _r("t4_score", "t4_score"), "same_script")


def missed_pairs(spark: SparkSession, d: str) -> DataFrame:
    found = reports.missed_by_both(_scored(spark, d))
    return found.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("ascii").alias("ascii"), F.count_if("has_latin").alias("latin"), F.count_if("has_kana").alias("kana"))


def missed_kinds(spark: SparkSession, d: str) -> DataFrame:
    """What second titles of several scripts look like where no tier found them; hits and scores follow from the key."""
    k = F.col("p_partkey")
    l2 = F.when(k % 4 == 0, F.col("p_name")).when(k % 4 == 1, F.concat(F.lit("カ "), "p_name")).when(k % 4 == 2, F.lit("ひらがな")).otherwise(F.lit("имя é"))
    rows = _t(spark, d, "part").select(F.col("p_type").alias("bucket"), l2.alias("l2"), (k % 3 == 0).alias("t3_hit"), ((k % 100) / 100).alias("t4_score"))
    return reports.missed_by_both(rows).groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("ascii").alias("ascii"), F.count_if("has_latin").alias("latin"), F.count_if("has_kana").alias("kana"))


def spacing(spark: SparkSession, d: str) -> DataFrame:
    """Second titles as they are, and with a space after the first letter."""
    pairs = _pairs(spark, d).withColumn("spaced", F.regexp_replace("l2_title", "^(.)(.)", "$1 $2"))
    found = reports.spacing_effect(pairs, "l1_title", "l2_title", "spaced")
    return found.select(_r("standard_recall", "standard_recall"), _r("spaced_recall", "spaced_recall"), "spaced_only", "standard_only", "missed", "near", "far")


def report_deltas(spark: SparkSession, d: str) -> DataFrame:
    """What a lower threshold changes in each bucket's outcomes."""
    pos = _scored(spark, d).where("positive")
    before, after = (reports.outcomes(pos, F.lit(t), ["bucket"]) for t in (0.75, 0.6))
    return reports.deltas(before, after, "bucket", ["both", "t4_only", "neither"])


def _rates(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(*extra, "tier", "tp", "fp", "tn", "fn", _r("precision", "precision"), _r("recall", "recall"), _r("f1", "f1"))


def confusion_by_tier(spark: SparkSession, d: str) -> DataFrame:
    return _rates(metrics.confusion(_scored(spark, d), reports.tiers(0.75)))


def per_bucket_f1(spark: SparkSession, d: str) -> DataFrame:
    return _rates(metrics.confusion(_scored(spark, d), reports.tiers(0.75), ["bucket"]), "bucket")


def tier_winner(spark: SparkSession, d: str) -> DataFrame:
    per = metrics.confusion(_scored(spark, d), reports.tiers(0.75), ["bucket"])
    return metrics.tier_winner(per.where("tier <> 'combined_ungated'").withColumns({c: F.round(c, 6) for c in ("f1", "precision")}), ["bucket"]).select("bucket", "winner", "f1")


def f1_heatmap(spark: SparkSession, d: str) -> DataFrame:
    """Rows are buckets, columns two halves of the pairs, by the parity of their index."""
    scored = _scored(spark, d).withColumn("pair", F.when(F.col("idx") % 2 == 0, "even").otherwise("odd"))
    per = metrics.confusion(scored, reports.tiers(0.75), ["bucket", "pair"])
    return metrics.heatmap(per, ["even", "odd"]).select("bucket", _r("even", "even"), _r("odd", "odd"))


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    found = reports.sweep(_scored(spark, d).where("positive"))
    rates = ("t3_recall", "t4_recall", "combined_recall", "t3_marginal_over_t4")
    return found.select("t4_threshold", "both", "t3_only", "t4_only", "neither", *(_r(c, c) for c in rates), reports.decision(F.col("t3_marginal_over_t4")).alias("decision"))


def outcomes_by_bucket(spark: SparkSession, d: str) -> DataFrame:
    return reports.outcomes(_scored(spark, d).where("positive"), 0.75, ["bucket"]).select("bucket", "both", "t3_only", "t4_only", "neither", _r("t4_marginal_over_t3", "t4_marginal"))


def t3_only_stats(spark: SparkSession, d: str) -> DataFrame:
    only = reports.phonetic_only(_scored(spark, d).withColumn("t4_score", F.round("t4_score", 6)), 0.75)
    return metrics.ranks_median(only, "t4_score", ["bucket"])


def topk_low(spark: SparkSession, d: str) -> DataFrame:
    """The ten lowest scores: a top-k report."""
    rows = reports.phonetic_only(_scored(spark, d).withColumn("t4_score", F.round("t4_score", 6)).withColumn("tie", F.concat(F.lpad(F.col("idx").cast("string"), 12, "0"), F.col("positive").cast("string"))), 0.75)
    return reports.lowest(rows, 10, "tie").select("idx", "positive", "l1", "l2", "t4_score")


def near_threshold(spark: SparkSession, d: str) -> DataFrame:
    return reports.near_threshold(_scored(spark, d).withColumn("t4_score", F.round("t4_score", 6)), 0.75, 0.05)


# -- metrics ---------------------------------------------------------------


def pairwise_prf(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part")
    predicted = part.select(F.concat_ws("|", "p_name", "p_type").alias("cluster"), F.col("p_partkey").alias("id"))
    gold = part.select(F.col("p_name").alias("cluster"), F.col("p_partkey").alias("id"))
    return metrics.pairwise_prf(predicted, gold).select(_r("precision", "precision"), _r("recall", "recall"), _r("f1", "f1"))


def cluster_prf(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part")

    def clusters(by: str) -> DataFrame:
        ords = part.groupBy(by).agg(F.min("p_partkey").alias("ord"))
        return part.join(ords, by).select("ord", F.col("p_partkey").alias("id"))

    return metrics.cluster_prf(clusters("p_name"), clusters("p_brand")).select("tp", "fp", "fn", _r("precision", "precision"), _r("recall", "recall"), _r("f1", "f1"))


def lang_pair_report(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    predicted = docs.select(F.md5("text").alias("cluster"), F.col("doc_id").alias("id"))
    gold = docs.select(F.md5(F.lower("text")).alias("cluster"), F.col("doc_id").alias("id"))
    records = docs.select(F.col("doc_id").alias("id"), "lang", F.col("doc_id").alias("idx"))
    return metrics.language_report(predicted, gold, records).select("pair", _r("precision", "precision"), _r("recall", "recall"), _r("f1", "f1"))


# -- sources ---------------------------------------------------------------


def sitelink_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Nations as entities: customers give their titles in one language, suppliers in another, regions their types."""
    c = _t(spark, d, "customer").select(F.concat(F.lit("http://x/"), F.col("c_nationkey").cast("string")).alias("entity"), F.lit("en").alias("lang"), F.col("c_name").alias("title"))
    s = _t(spark, d, "supplier").select(F.concat(F.lit("http://x/"), F.col("s_nationkey").cast("string")).alias("entity"), F.lit("de").alias("lang"), F.col("s_name").alias("title"))
    n = _t(spark, d, "nation").select(F.concat(F.lit("http://x/"), F.col("n_nationkey").cast("string")).alias("entity"), F.concat(F.lit("t/"), F.col("n_regionkey").cast("string")).alias("type"))
    r = _t(spark, d, "region").where("r_regionkey > 0").select(F.concat(F.lit("t/"), F.col("r_regionkey").cast("string")).alias("type"), F.col("r_name").alias("label"))
    return joined_sitelinks(c.union(s), n, r, "en", "de")


def stratified_extract(spark: SparkSession, d: str) -> DataFrame:
    """Fifty rows of each bucket at most: the extraction's own limit."""
    return stratified(_t(spark, d, "part").select(F.col("p_partkey").alias("qid"), F.col("p_type").alias("bucket"), "p_name"), 50)


def labels_pivot(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id")
    return docs.groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("toxic") == 1).alias("toxic"))


QUERIES: tuple[Query, ...] = (
    normalize_names, diacritics, title_normalize, url_tail, script_profile, language_pairs, transliterate_pins, name_trigrams, jw_pairs, trigram_cosine_pairs, cascade_pairs,
    respelt_scripts, respelt_latin, spelt_cyrillic, spelt_hangul, spelt_arabic, spelt_japanese, behaviour, cross_script_cascade, missed_pairs, missed_kinds, spacing, report_deltas,
    resolve_labels, resolve_clusters, cluster_sizes, gold_members, dense_pairs, label_centre_cosine, hard_negatives, hard_negatives_names, jw_distinct_names, lev_negatives, lev_histogram, scored_pairs, confusion_by_tier, per_bucket_f1,
    tier_winner, f1_heatmap, threshold_sweep, outcomes_by_bucket, t3_only_stats, topk_low, near_threshold, pairwise_prf, cluster_prf, lang_pair_report, sitelink_pairs, stratified_extract, labels_pivot,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


# -- the same in SQL ---------------------------------------------------------

SP = r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _norm(c: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(lower(nfc_normalize({c})), '^[{SP}]+|[{SP}]+$', '', 'g'), '[{SP}]+', ' ', 'g'), '[^\p{{L}}\p{{N}}_''\-{SP}]', '', 'g')"


def _grams(names: str) -> str:
    """Trigram counts and norms of the names in a table with a column nm."""
    return f"""
grams AS (SELECT nm, substr('#' || lower(nm) || '#', i, 3) AS gram, count(*)::DOUBLE AS tf FROM {names}, LATERAL (SELECT unnest(range(1, length(nm) + 1)) AS i) GROUP BY ALL),
norms AS (SELECT nm, sum(tf * tf) AS sq FROM grams GROUP BY 1)"""


def _cos(a: str, b: str) -> str:
    return f"coalesce((SELECT sum(x.tf * y.tf) FROM grams x JOIN grams y USING (gram) WHERE x.nm = {a} AND y.nm = {b}), 0) / (sqrt((SELECT sq FROM norms WHERE nm = {a})) * sqrt((SELECT sq FROM norms WHERE nm = {b})))"


PLAIN = f"regexp_replace(p_name, '[^{LETTERS} ]', '', 'g')"
PART_NAMES = "names AS (SELECT p_name AS nm, min(p_partkey) AS kid FROM part GROUP BY 1)"
PRF = "CASE WHEN p = 0 AND g = 0 THEN 1.0 ELSE coalesce(tp / nullif(p, 0), 0.0) END AS precision, CASE WHEN p = 0 AND g = 0 THEN 1.0 ELSE coalesce(tp / nullif(g, 0), 0.0) END AS recall"
F1 = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1"

LINKS = f"""
{PART_NAMES}, keys AS (SELECT p_name AS nm, p_type AS ty, min(p_partkey) AS kid FROM part GROUP BY ALL),{_grams("names")},
scores AS (SELECT a.nm AS x, b.nm AS y, jaro_winkler_similarity(a.nm, b.nm) AS jw, {_cos("a.nm", "b.nm")} AS cos FROM names a JOIN names b ON a.nm < b.nm),
edges AS (SELECT a.kid AS s, b.kid AS d FROM keys a JOIN keys b USING (ty) JOIN scores ON x = a.nm AND y = b.nm WHERE jw >= 0.85 OR cos >= 0.7),
sym AS (SELECT s, d FROM edges UNION SELECT d, s FROM edges),
reach AS (SELECT kid AS n, kid AS r FROM keys UNION SELECT reach.n, sym.d FROM reach JOIN sym ON sym.s = reach.r),
roots AS (SELECT n, min(r) AS root FROM reach GROUP BY 1),
labelled AS (SELECT p_partkey AS idx, CAST(p_partkey AS VARCHAR) AS id, root AS cluster_id FROM part JOIN keys ON nm = p_name AND ty = p_type JOIN roots ON n = kid)"""

PAIRS = """
pairs AS (SELECT p_partkey AS idx, p_brand AS qid, p_name AS l1_title,
  CASE p_partkey % 3 WHEN 0 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) WHEN 1 THEN split_part(p_name, ' ', 1) || 's ' || split_part(p_name, ' ', 2)
  ELSE split_part(p_name, ' ', 1) || ' of the ' || split_part(p_name, ' ', 2) END AS l2_title, p_type AS bucket FROM part)"""
NEGATIVES = f"""{PAIRS},
tj AS (SELECT x.t AS a, y.t AS b, CASE WHEN x.t = y.t THEN 1.0 ELSE jaro_winkler_similarity(least(x.t, y.t), greatest(x.t, y.t)) END AS jw FROM (SELECT DISTINCT l1_title AS t FROM pairs) x, (SELECT DISTINCT l1_title AS t FROM pairs) y),
best AS (SELECT p.idx, p.l1_title, p.bucket, p.qid, arg_max(struct_pack(q := q.idx, l2 := q.l2_title, o := q.qid, jw := jw), struct_pack(a := jw, b := -q.idx)) AS m
  FROM pairs p JOIN pairs q ON p.bucket = q.bucket AND p.qid <> q.qid JOIN tj ON a = p.l1_title AND b = q.l1_title GROUP BY ALL)"""
SCORED = f"""{NEGATIVES},
labelled AS (SELECT idx, l1_title AS l1, l2_title AS l2, bucket, true AS positive FROM pairs UNION ALL SELECT idx, l1_title, m.l2, bucket, false FROM best),
tn AS (SELECT l1 AS nm FROM labelled UNION SELECT l2 FROM labelled),{_grams("tn")},
tp2 AS (SELECT DISTINCT l1, l2 FROM labelled),
dots AS (SELECT l1, l2, sum(x.tf * y.tf) AS dot FROM tp2 JOIN grams x ON x.nm = l1 JOIN grams y ON y.nm = l2 AND y.gram = x.gram GROUP BY ALL),
ts AS (SELECT l1, l2, jaro_winkler_similarity(l1, l2) >= 0.82 AS t3_hit, coalesce(dot, 0) / (sqrt(a.sq) * sqrt(b.sq)) AS t4_raw, round(t4_raw, 6) AS t4_score FROM tp2 LEFT JOIN dots USING (l1, l2) JOIN norms a ON a.nm = l1 JOIN norms b ON b.nm = l2),
scored AS (SELECT labelled.*, t3_hit, t4_raw, t4_score, true AS same_script FROM labelled JOIN ts USING (l1, l2))"""
NAMES = """own AS (SELECT *, translate(md5(CAST(p_partkey AS VARCHAR))[1:7], '0123456789', 'ghijklmnop') || ' ' || split_part(p_name, ' ', -1) AS nm FROM part)"""
LEV = f"""WITH {PAIRS.replace("pairs AS", "plain AS")}, pairs AS (SELECT * REPLACE (l1_title[1:3] || md5(CAST(idx AS VARCHAR))[1:idx % 6] || l1_title[4:] AS l1_title) FROM plain), l AS (SELECT x.t AS a, y.t AS b, levenshtein(x.t, y.t) AS d FROM (SELECT DISTINCT l1_title AS t FROM pairs) x, (SELECT DISTINCT l1_title AS t FROM pairs) y),
n AS (SELECT p.idx, row_number() OVER (PARTITION BY p.idx ORDER BY d, q.idx) AS rank, p.l1_title, q.l2_title, p.bucket AS bucket_positive, q.bucket AS bucket_negative, p.qid AS positive_qid, q.qid AS negative_qid, d AS l1_levenshtein, 'negative' AS label
  FROM pairs p JOIN l ON l.a = p.l1_title AND d <= 5 JOIN pairs q ON q.l1_title = l.b AND q.qid <> p.qid)"""
TALLY = """
tiers AS (SELECT *, unnest([struct_pack(tier := 't3', hit := t3_hit), struct_pack(tier := 't4', hit := t4_score >= 0.75), struct_pack(tier := 'combined', hit := (t3_hit AND NOT same_script) OR t4_score >= 0.75), struct_pack(tier := 'combined_ungated', hit := t3_hit OR t4_score >= 0.75)]) AS t FROM scored)"""


def _tally(by: str, extra: str = "") -> str:
    g = f"{by}, " if by else ""
    return f"""WITH {SCORED}, {TALLY},
c AS (SELECT {g}{extra}t.tier AS tier, count(*) FILTER (positive AND t.hit) AS tp, count(*) FILTER (NOT positive AND t.hit) AS fp, count(*) FILTER (NOT positive AND NOT t.hit) AS tn, count(*) FILTER (positive AND NOT t.hit) AS fn FROM tiers GROUP BY ALL),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall FROM c),
f AS (SELECT * EXCLUDE (precision, recall), {F1} FROM r)"""


def _outcomes(by: str, source: str, threshold: str) -> str:
    return f"""o AS (SELECT {by}, count(*) FILTER (t3_hit AND t4_score >= {threshold}) AS "both", count(*) FILTER (t3_hit AND NOT t4_score >= {threshold}) AS t3_only, count(*) FILTER (NOT t3_hit AND t4_score >= {threshold}) AS t4_only,
  count(*) FILTER (NOT t3_hit AND NOT t4_score >= {threshold}) AS neither, count(*) AS n FROM {source} GROUP BY ALL)"""


def _spelt(letters: list[str]) -> str:
    """The hexadecimal digits of a part's hashed key, each written as told."""
    return f"array_to_string(list_transform(string_split(md5(CAST(p_partkey AS VARCHAR)), ''), lambda c: [{', '.join(map(repr, letters))}][position(c IN '0123456789abcdef')]), '')"


def _pairs_of(name: str, cluster: str, more: str = "") -> str:
    return f"{name} AS (SELECT DISTINCT x.p_partkey AS a, y.p_partkey AS b FROM part x JOIN part y USING ({cluster}) WHERE x.p_partkey < y.p_partkey)"


def oracle_sql() -> dict[str, str]:
    decided = "CASE WHEN t3_only / n >= 0.15 THEN 'PROCEED' WHEN t3_only / n < 0.05 THEN 'REFRAME' ELSE 'AMBIG' END AS decision"
    return {
        "normalize_names": f"SELECT doc_id, {_norm('text')} AS norm FROM documents",
        "diacritics": "SELECT doc_id, strip_accents(text) AS plain FROM documents",
        "title_normalize": rf"SELECT page_id, regexp_replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[{SP}]*\([^()]*\)[{SP}]*$', ''), '^([^{SP}]+),[{SP}]+([^{SP}].*)$', '\2 \1') AS title FROM pages",
        "url_tail": "SELECT page_id, string_split(url, '/')[-1] AS tail FROM pages",
        "script_profile": r"SELECT lang, CASE WHEN regexp_matches(text, '[A-Za-z\x{c0}-\x{24f}]') THEN 'Latin' ELSE 'Other' END AS script, count(*) AS n FROM documents GROUP BY ALL",
        "language_pairs": "WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) SELECT a.lang || '-' || b.lang AS pair, sum(least(a.n, b.n)) AS n FROM c a JOIN c b USING (source) WHERE a.lang < b.lang GROUP BY 1",
        "transliterate_pins": f"SELECT p_partkey, [{', '.join(repr(c) for _, _, c in PINS)}][p_partkey % {len(PINS)} + 1] AS latin FROM part",
        "spelt_cyrillic": f"""SELECT p_partkey, CASE split_part(p_name, ' ', 1) WHEN 'large' THEN 'Shchuka' WHEN 'small' THEN 'Yozh' WHEN 'red' THEN 'obyezd' WHEN 'blue' THEN 'Yulya' WHEN 'hot' THEN 'Chyekhiya' WHEN 'cold' THEN 'khvoya' WHEN 'old' THEN 'Zhyul' WHEN 'new' THEN 'Tsyts' ELSE 'shchi' END
  || {_spelt(['shch', 'Sh', 'yu', 'Ya', '', 'Yo', 'Zh', 'ts', 'Ch', 'kh', '', 'y', 'e', 'Y', 'F', 'l'])} AS latin FROM part""",
        "spelt_arabic": f"SELECT p_partkey, {_spelt(['a', 'th', 'kh', 'dh', 'sh', 'd', 'gh', 'q', 'a', 'a', 'w', '', '', 'p', 'ch', 'zh'])} AS latin FROM part",
        "spelt_hangul": """WITH s AS (SELECT p_partkey, (p_partkey * 7919) % 11172 AS place, (p_partkey * 104729) % 11172 AS other, string_split('g kk n d tt r m b pp s ss  j jj ch k t p h', ' ') AS i,
  string_split('a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i', ' ') AS m, string_split(' g kk gs n nj nh d l lg lm lb ls lt lp lh m b bs s ss ng j ch k t p h', ' ') AS f FROM part)
SELECT p_partkey, place, i[place // 588 + 1] || m[place // 28 % 21 + 1] || f[place % 28 + 1] || i[other // 588 + 1] || m[other // 28 % 21 + 1] || f[other % 28 + 1] AS latin FROM s""",
        "spelt_japanese": "SELECT p_partkey, CASE split_part(p_name, ' ', -1) " + " ".join(f"WHEN '{k}' THEN '{r}{'no' if k in ('gizmo', 'anvil') else ' no'}'" for k, (_, r) in JAPANESE.items()) + " ELSE 'sara no' END || CASE WHEN p_partkey % 2 = 0 THEN ' yubiwa' ELSE ' shatsu' END AS latin FROM part",
        "name_trigrams": f"WITH {PART_NAMES}, {_grams('names')} SELECT nm AS p_name, gram, CAST(tf AS BIGINT) AS tf FROM grams",
        "jw_pairs": f"WITH {PART_NAMES} SELECT least(a.kid, b.kid) AS src, greatest(a.kid, b.kid) AS dst, round(jaro_winkler_similarity(a.nm, b.nm), 6) AS score FROM names a JOIN names b ON a.nm < b.nm WHERE jaro_winkler_similarity(a.nm, b.nm) >= 0.85",
        "trigram_cosine_pairs": f"WITH {PART_NAMES}, {_grams('names')}, s AS (SELECT least(a.kid, b.kid) AS src, greatest(a.kid, b.kid) AS dst, {_cos('a.nm', 'b.nm')} AS score FROM names a JOIN names b ON a.nm < b.nm) SELECT src, dst, round(score, 6) AS score FROM s WHERE score >= 0.5",
        "cascade_pairs": f"""WITH {PART_NAMES}, {_grams("names")}, keys AS (SELECT DISTINCT p_name, p_type FROM part),
s AS (SELECT a.nm AS x, b.nm AS y, jaro_winkler_similarity(a.nm, b.nm) AS jw, {_cos("a.nm", "b.nm")} AS cos FROM names a JOIN names b ON a.nm < b.nm)
SELECT a.p_name AS name_a, b.p_name AS name_b, a.p_type AS type_a, b.p_type AS type_b, jw >= 0.85 OR cos >= 0.5 AS is_match, CASE WHEN jw >= 0.85 THEN 2 ELSE 4 END AS tier,
  CASE WHEN jw >= 0.85 THEN 'Cascade/same-script-fuzzy' ELSE 'EmbeddingMatcher' END AS method, round(CASE WHEN jw >= 0.85 THEN jw ELSE cos END, 6) AS score
FROM keys a JOIN keys b USING (p_type) JOIN s ON x = a.p_name AND y = b.p_name
UNION ALL SELECT a.p_name, b.p_name, a.p_type, b.p_type, false, 1, 'Cascade/type-mismatch', 0.0 FROM keys a JOIN keys b USING (p_name) WHERE a.p_type < b.p_type""",
        "resolve_labels": f"WITH RECURSIVE {LINKS} SELECT idx, id, cluster_id FROM labelled",
        "resolve_clusters": f"WITH RECURSIVE {LINKS} SELECT cluster_id, string_agg(id, ',' ORDER BY idx) AS members FROM labelled GROUP BY 1",
        "cluster_sizes": f"WITH RECURSIVE {LINKS} SELECT size, count(*) AS clusters FROM (SELECT cluster_id, count(*) AS size FROM labelled GROUP BY 1) GROUP BY 1",
        "gold_members": "SELECT p_brand AS id, string_agg(p_name, '|' ORDER BY p_partkey) AS names FROM part GROUP BY 1",
        "dense_pairs": "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings UNION ALL SELECT vec_id + 1000000, label, list_concat([0.0::DOUBLE], (embedding::DOUBLE[])[2:]) FROM embeddings) SELECT a.vec_id AS src, b.vec_id AS dst, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.95",
        "respelt_scripts": "SELECT p_partkey, ['Latin', 'Cyrillic', 'Hangul', 'Arabic'][p_partkey % 4 + 1] AS script, p_partkey % 4 = 0 AS same FROM part",
        "respelt_latin": f"SELECT p_partkey, {PLAIN} AS latin FROM part WHERE p_partkey % 4 < 2",
        "behaviour": "SELECT CASE WHEN p_partkey % 5 = 0 THEN 'empty' WHEN p_partkey % 4 = 0 THEN 'passthrough' ELSE 'changed' END AS behaviour, count(*) AS n FROM part WHERE p_partkey % 4 < 2 GROUP BY 1",
        "cross_script_cascade": f"""WITH t AS (SELECT DISTINCT p_partkey % 4 AS turn, {PLAIN} AS plain FROM part),
u AS (SELECT turn, CASE turn WHEN 0 THEN upper(plain) WHEN 3 THEN '' ELSE translate(plain, '{LETTERS}', '{CYRILLIC}') END AS name_a, CASE turn WHEN 2 THEN split_part(plain, ' ', -1) || ' ' || split_part(plain, ' ', 1) ELSE plain END AS name_b, jaro_winkler_similarity(plain, name_b) AS jw FROM t)
SELECT name_a, name_b, CASE turn WHEN 3 THEN false WHEN 2 THEN jw >= 0.82 ELSE true END AS is_match, CASE WHEN turn IN (0, 3) THEN 0 WHEN turn = 1 OR jw >= 0.82 THEN 3 ELSE 4 END AS tier,
  CASE WHEN turn = 0 THEN 'Cascade/exact' WHEN turn = 3 THEN 'Cascade/empty' WHEN turn = 1 OR jw >= 0.82 THEN 'PhoneticMatcher' ELSE 'EmbeddingMatcher' END AS method,
  round(CASE WHEN turn = 3 THEN 0.0 WHEN turn IN (0, 1) THEN 1.0 WHEN jw >= 0.82 THEN jw ELSE 0.0 END, 6) AS score FROM u""",
        "missed_pairs": f"WITH {SCORED} SELECT bucket, count(*) AS n, count(*) AS ascii, count(*) AS latin, CAST(0 AS BIGINT) AS kana FROM scored WHERE NOT t3_hit AND t4_score < 0.75 GROUP BY 1",
        "missed_kinds": "SELECT p_type AS bucket, count(*) AS n, count(*) FILTER (p_partkey % 4 = 0) AS ascii, count(*) FILTER (p_partkey % 4 < 2) AS latin, count(*) FILTER (p_partkey % 4 IN (1, 2)) AS kana FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 100 < 75 GROUP BY 1",
        "spacing": f"""WITH {PAIRS}, j AS (SELECT jaro_winkler_similarity(lower(l1_title), l2_title) AS s, jaro_winkler_similarity(lower(l1_title), regexp_replace(l2_title, '^(.)(.)', '\\1 \\2')) AS t FROM pairs)
SELECT round(count(*) FILTER (s >= 0.82) / count(*), 6) AS standard_recall, round(count(*) FILTER (t >= 0.82) / count(*), 6) AS spaced_recall, count(*) FILTER (t >= 0.82 AND s < 0.82) AS spaced_only, count(*) FILTER (s >= 0.82 AND t < 0.82) AS standard_only,
  count(*) FILTER (s < 0.82 AND t < 0.82) AS missed, count(*) FILTER (s < 0.82 AND t < 0.82 AND greatest(s, t) >= 0.7) AS near, count(*) FILTER (s < 0.82 AND t < 0.82 AND greatest(s, t) < 0.5) AS far FROM j""",
        "report_deltas": f"""WITH {SCORED}, pos AS (SELECT * FROM scored WHERE positive)
SELECT bucket, count(*) FILTER (t3_hit AND t4_raw >= 0.6) - count(*) FILTER (t3_hit AND t4_raw >= 0.75) AS delta_both, count(*) FILTER (NOT t3_hit AND t4_raw >= 0.6) - count(*) FILTER (NOT t3_hit AND t4_raw >= 0.75) AS delta_t4_only,
  count(*) FILTER (NOT t3_hit AND t4_raw < 0.6) - count(*) FILTER (NOT t3_hit AND t4_raw < 0.75) AS delta_neither FROM pos GROUP BY 1""",
        "label_centre_cosine": "WITH f AS (SELECT label, arg_min(embedding, vec_id) AS first FROM embeddings GROUP BY 1) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], first::DOUBLE[]), 6) AS score FROM embeddings JOIN f USING (label)",
        "hard_negatives": f"WITH {NEGATIVES} SELECT idx, l1_title, m.l2 AS l2_title, bucket, qid AS positive_qid, m.o AS negative_qid, round(m.jw, 6) AS l1_jw_to_source, 'negative' AS label FROM best",
        "jw_distinct_names": f"WITH {NAMES}, names AS (SELECT nm, min(p_partkey) AS kid FROM own GROUP BY 1) SELECT least(a.kid, b.kid) AS src, greatest(a.kid, b.kid) AS dst, round(jaro_winkler_similarity(a.nm, b.nm), 6) AS score FROM names a JOIN names b ON a.nm < b.nm WHERE jaro_winkler_similarity(a.nm, b.nm) >= 0.92",
        "hard_negatives_names": f"""WITH {NAMES}, best AS (SELECT p.p_partkey AS idx, p.p_brand AS bucket, arg_max(struct_pack(l2 := q.nm, o := q.p_type, jw := jaro_winkler_similarity(least(p.nm, q.nm), greatest(p.nm, q.nm))), struct_pack(a := jaro_winkler_similarity(least(p.nm, q.nm), greatest(p.nm, q.nm)), b := -q.p_partkey)) AS m
  FROM own p JOIN own q ON p.p_brand = q.p_brand AND p.p_type <> q.p_type GROUP BY ALL) SELECT idx, bucket, m.l2 AS l2_title, m.o AS negative_qid, round(m.jw, 6) AS jw FROM best""",
        "lev_negatives": f"{LEV} SELECT * FROM n WHERE rank <= 3",
        "lev_histogram": f"{LEV} SELECT l1_levenshtein, count(*) AS n FROM n WHERE rank <= 3 GROUP BY 1",
        "scored_pairs": f"WITH {SCORED} SELECT idx, positive, l1, l2, bucket, t3_hit, t4_score, same_script FROM scored",
        "confusion_by_tier": f"{_tally('')} SELECT * FROM f",
        "per_bucket_f1": f"{_tally('bucket')} SELECT * FROM f",
        "tier_winner": f"{_tally('bucket')} SELECT bucket, arg_max(tier, struct_pack(a := f1, b := precision, c := tier)) AS winner, max(f1) AS f1 FROM f WHERE tier <> 'combined_ungated' GROUP BY 1",
        "f1_heatmap": f"{_tally('bucket', 'idx % 2 AS half, ')} SELECT bucket, max(f1) FILTER (half = 0) AS even, max(f1) FILTER (half = 1) AS odd FROM f WHERE tier = 'combined' GROUP BY 1",
        "threshold_sweep": f"""WITH {SCORED}, told AS (SELECT * REPLACE (t4_raw AS t4_score), unnest([0.5, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9]::DOUBLE[]) AS t4_threshold FROM scored WHERE positive), {_outcomes('t4_threshold', 'told', 't4_threshold')} SELECT t4_threshold, "both", t3_only, t4_only, neither, round((t3_only + "both") / n, 6) AS t3_recall, round((t4_only + "both") / n, 6) AS t4_recall, round((n - neither) / n, 6) AS combined_recall, round(t3_only / n, 6) AS t3_marginal_over_t4, {decided} FROM o""",
        "outcomes_by_bucket": f"""WITH {SCORED}, pos AS (SELECT * FROM scored WHERE positive), {_outcomes('bucket', 'pos', '0.75')} SELECT bucket, "both", t3_only, t4_only, neither, round(t4_only / n, 6) AS t4_marginal FROM o""",
        "t3_only_stats": f"WITH {SCORED} SELECT bucket, min(t4_score) AS min, list_sort(list(t4_score))[count(*) // 2 + 1] AS median, max(t4_score) AS max FROM scored WHERE t3_hit AND t4_score < 0.75 GROUP BY 1",
        "topk_low": f"WITH {SCORED} SELECT idx, positive, l1, l2, t4_score FROM scored WHERE t3_hit AND t4_score < 0.75 ORDER BY t4_score, idx, positive LIMIT 10",
        "near_threshold": f"WITH {SCORED} SELECT count(*) FILTER (t3_hit AND t4_score >= 0.7 AND t4_score < 0.75) AS near FROM scored",
        "pairwise_prf": f"WITH {_pairs_of('pp', 'p_name, p_type')}, {_pairs_of('gg', 'p_name')}, k AS (SELECT (SELECT count(*) FROM pp JOIN gg USING (a, b)) AS tp, (SELECT count(*) FROM pp) AS p, (SELECT count(*) FROM gg) AS g), r AS (SELECT {PRF} FROM k) SELECT {F1} FROM r",
        "cluster_prf": f"""WITH pc AS (SELECT p_name AS k, min(p_partkey) AS ord, count(*) AS n FROM part GROUP BY 1), gc AS (SELECT p_brand AS k, min(p_partkey) AS gold, count(*) AS n FROM part GROUP BY 1),
ov AS (SELECT ord, gold, count(*) AS shared FROM part JOIN pc ON pc.k = p_name JOIN gc ON gc.k = p_brand GROUP BY ALL),
bst AS (SELECT ord, arg_max(gold, struct_pack(a := shared, b := -gold)) AS gold, max(shared) AS shared FROM ov GROUP BY 1),
al AS (SELECT shared AS tp, pc.n - shared AS fp, gc.n - shared AS fn FROM bst JOIN pc USING (ord) JOIN gc USING (gold) UNION ALL SELECT 0, 0, n FROM gc WHERE gold NOT IN (SELECT gold FROM bst)),
k AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM al), r AS (SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM k) SELECT tp, fp, fn, {F1} FROM r""",
        "lang_pair_report": f"""WITH langs AS (SELECT DISTINCT lang FROM documents), lp AS (SELECT a.lang AS la, b.lang AS lb, a.lang || '-' || b.lang AS pair FROM langs a JOIN langs b ON a.lang <= b.lang),
pp AS (SELECT x.doc_id AS a, y.doc_id AS b, x.lang AS l1, y.lang AS l2 FROM documents x JOIN documents y ON md5(x.text) = md5(y.text) AND x.doc_id < y.doc_id),
gg AS (SELECT x.doc_id AS a, y.doc_id AS b, x.lang AS l1, y.lang AS l2 FROM documents x JOIN documents y ON md5(lower(x.text)) = md5(lower(y.text)) AND x.doc_id < y.doc_id),
pl AS (SELECT pair, a, b FROM pp JOIN lp ON l1 IN (la, lb) AND l2 IN (la, lb) UNION ALL SELECT 'overall', a, b FROM pp), gl AS (SELECT pair, a, b FROM gg JOIN lp ON l1 IN (la, lb) AND l2 IN (la, lb) UNION ALL SELECT 'overall', a, b FROM gg),
k AS (SELECT pair, count(pl.a) FILTER (gl.a IS NOT NULL) AS tp, count(pl.a) AS p, count(gl.a) AS g FROM pl FULL JOIN gl USING (pair, a, b) GROUP BY 1), r AS (SELECT pair, {PRF} FROM k WHERE g > 0 OR pair = 'overall') SELECT pair, {F1} FROM r""",
        "sitelink_pairs": "SELECT CAST(n_nationkey AS VARCHAR) AS qid, c_name AS l1_title, s_name AS l2_title, CAST(n_regionkey AS VARCHAR) AS wikidata_type, coalesce(CASE WHEN r_regionkey > 0 THEN r_name END, '') AS type_label FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN region ON r_regionkey = n_regionkey",
        "stratified_extract": "SELECT p_partkey AS qid, p_type AS bucket, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS rn FROM part) WHERE rn <= 50",
        "labels_pivot": "SELECT lang, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad, count(*) FILTER (toxic = 1) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY 1",
    }
