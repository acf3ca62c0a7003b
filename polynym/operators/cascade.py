"""The matching cascade, on given pairs and as joins over all records.

Order of decisions for a pair: an empty name matches nothing; two different
types match nothing; equal normal forms match; within one script, Jaro-Winkler
of the normal forms; across scripts, Jaro-Winkler of the Latin forms; else
cosine of character trigrams (or of vectors).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from polynym.functions.lexicon import LexiconSource
from polynym.functions.script import detect_script
from polynym.functions.similarity import char_ngrams, cosine, jaro_winkler, may_reach_jaro_winkler
from polynym.functions.text import normalize_for_matching
from polynym.functions.translit import transliterate_to_latin
from polynym.operators.dense import Model, encode, keyed_by_angle
from polynym.operators.materialize import materialize
from polynym.operators.similarity_join import keyed_by_jaro_winkler, mate

if TYPE_CHECKING:
    from polynym.operators.matchers import Matcher


@dataclass(frozen=True)
class Cascade:
    """Thresholds, and the last tier's backend.

    ``ngram``: trigrams. ``vector``: a column of arrays of one length. ``model``: vectors that
    ``model`` makes of the names. ``more``: matchers that are tried, in their order, on pairs
    that no tier has matched.
    """

    tier2: float = 0.85
    tier3: float = 0.82
    tier4: float = 0.75
    backend: str = "ngram"
    full_readings: bool = True
    words: dict[str, str] | LexiconSource = field(default_factory=dict, hash=False)
    model: Model | None = field(default=None, hash=False)
    more: tuple[Matcher, ...] = ()

    def __post_init__(self) -> None:
        if self.backend not in ("ngram", "vector", "model") or (self.backend == "model") != (self.model is not None):
            raise ValueError("backend is ngram, vector or model; a model goes with the last, and only with it")

    @property
    def embedding_backend(self) -> str:
        return self.backend

    # -- derived columns ---------------------------------------------------

    def derive(self, records: DataFrame) -> DataFrame:
        """``records`` (name, lang, entity_type) with ``norm``, ``script`` and ``latin``, once per record."""
        name, lang = F.coalesce("name", F.lit("")), F.coalesce("lang", F.lit(""))
        latin = transliterate_to_latin(name, lang, records.sparkSession, self.full_readings, self.words)
        return records.withColumns({"norm": normalize_for_matching(name), "script": detect_script(name), "latin": normalize_for_matching(latin), "etype": F.coalesce("entity_type", F.lit(""))})

    # -- given pairs -------------------------------------------------------

    def match_pairs(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (name_a, name_b, lang_a, lang_b, type_a, type_b) with is_match, score, tier, method and details.

        With the vector backend also vector_a and vector_b. Tiers are columns of
        one projection; names are derived once per side, whatever the tiers need.
        A pair that nothing matches has the score of the last tier.
        """
        out = pairs if self.model is None else self._encoded_pairs(pairs)
        for s in ("a", "b"):
            name, lang = F.coalesce(f"name_{s}", F.lit("")), F.coalesce(f"lang_{s}", F.lit(""))
            latin = transliterate_to_latin(name, lang, pairs.sparkSession, self.full_readings, self.words)
            out = out.withColumns({f"_norm_{s}": normalize_for_matching(name), f"_script_{s}": detect_script(name), f"_latin_{s}": normalize_for_matching(latin), f"_type_{s}": F.coalesce(f"type_{s}", F.lit(""))})
        same = F.col("_script_a") == F.col("_script_b")
        # One call: which forms are compared depends on the scripts.
        left, right = (F.when(same, F.col(f"_norm_{s}")).otherwise(F.col(f"_latin_{s}")) for s in ("a", "b"))
        out = out.withColumn("_jw", F.when((left == "") | (right == ""), 0.0).otherwise(jaro_winkler(left, right)))
        out = out.withColumn("_cos", self.pair_cosine("name_a", "name_b"))
        empty = (F.col("_norm_a") == "") | (F.col("_norm_b") == "")
        mismatch = (F.col("_type_a") != "") & (F.col("_type_b") != "") & (F.col("_type_a") != F.col("_type_b"))
        exact = F.col("_norm_a") == F.col("_norm_b")
        fuzzy, phonetic = same & (F.col("_jw") >= self.tier2), ~same & (F.col("_jw") >= self.tier3)
        lit = F.lit
        none = F.create_map().cast("map<string,string>")
        Row = lambda when, match, score, tier, method, details: (when, {"is_match": lit(match), "score": score, "tier": lit(tier), "method": lit(method), "details": details})
        last = F.create_map(lit("backend"), lit(self.backend))
        rows = [
            Row(empty, False, lit(0.0), 0, "Cascade/empty", none),
            Row(mismatch, False, lit(0.0), 1, "Cascade/type-mismatch", F.create_map(lit("type_a"), "type_a", lit("type_b"), "type_b")),
            Row(exact, True, lit(1.0), 0, "Cascade/exact", none),
            Row(fuzzy, True, F.col("_jw"), 2, "Cascade/same-script-fuzzy", F.create_map(lit("jaro_winkler"), F.col("_jw").cast("string"))),
            Row(phonetic, True, F.col("_jw"), 3, "PhoneticMatcher", F.create_map(lit("transliterated_a"), "_latin_a", lit("transliterated_b"), "_latin_b")),
            Row(F.col("_cos") >= self.tier4, True, F.col("_cos"), 4, "EmbeddingMatcher", last),
        ]
        rest = Row(None, False, F.col("_cos"), 4, "EmbeddingMatcher", last)
        for k, matcher in enumerate(self.more):
            out = out.withColumn(f"_more_{k}", matcher.score(out))
            score, tier = F.col(f"_more_{k}"), matcher.number(5 + k)
            rows.append(Row(score >= matcher.threshold, True, score, tier, matcher.method, none))
            rest = Row(None, False, score, tier, matcher.method, none)
        chosen = []
        for name in ("is_match", "score", "tier", "method", "details"):
            value = F.when(rows[0][0], rows[0][1][name])
            for when, values in rows[1:]:
                value = value.when(when, values[name])
            chosen.append(value.otherwise(rest[1][name]).alias(name))
        return out.select(*pairs.columns, *chosen)

    def _encoded_pairs(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` with vector_a and vector_b; each distinct name is encoded once, whatever side it is on."""
        names = pairs.select(F.coalesce("name_a", F.lit("")).alias("name")).union(pairs.select(F.coalesce("name_b", F.lit("")).alias("name")))
        vectors = encode(names, self.model)
        out = pairs
        for s in ("a", "b"):
            one = vectors.select(F.col("name").alias(f"_name_{s}"), F.col("vector").alias(f"vector_{s}"))
            out = out.join(one, F.coalesce(f"name_{s}", F.lit("")) == F.col(f"_name_{s}"))
        return out

    def pair_cosine(self, a: str, b: str) -> Column:
        """The last tier's score of a pair; names are only lower-cased."""
        if self.backend != "ngram":
            return F.coalesce(cosine(F.col("vector_a"), F.col("vector_b")), F.lit(0.0))
        x, y = (char_ngrams(F.lower(F.coalesce(c, F.lit("")))) for c in (a, b))
        count = lambda grams, g: F.size(F.filter(grams, lambda v: v == g)).cast("double")
        dot = lambda p, q: F.aggregate(p, F.lit(0.0), lambda s, g: s + count(q, g))
        size = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
        return F.when(size == 0, 0.0).otherwise(dot(x, y) / size)

    # -- all records -------------------------------------------------------

    def links(self, keys: DataFrame, seen: dict[int, Observation] | None = None) -> DataFrame:
        """``(src, dst, tier, score)``: matches among distinct keys (kid, norm, script, latin, etype, name, lang).

        Each tier is a set of equi-joins that holds all its matches (vectors: see
        ``dense``), then the score itself. Equal normal forms are linked as stars. Rows tell
        the tier by which a pair first matches; pairs that a star joins indirectly
        have no row of their own. ``seen`` gets, for each tier, counts of what it compared and
        matched, which are taken while the links are computed.
        """
        # Exact links are stars within each normal form and would join whatever else joins their members.
        rows = materialize(keys.where("norm <> ''"), "keys")
        tiers = [(0, self.exact_links(rows), 1.0), (2, self.fuzzy_scores(rows, "norm", self.tier2, 2), self.tier2), (3, self.fuzzy_scores(rows, "latin", self.tier3, 3), self.tier3), (4, self.last_scores(rows), self.tier4)]
        tiers += [(m.number(5 + k), self.more_scores(rows, m), m.threshold) for k, m in enumerate(self.more)]
        found = None
        for number, scored, threshold in tiers:
            matches = F.col("score") >= threshold
            if seen is not None:
                seen[number] = Observation()
                scored = scored.observe(seen[number], F.count(F.lit(1)).alias("comparisons"), F.count_if(matches).alias("matches"))
            part = scored.where(matches).select("src", "dst", F.lit(number).alias("tier"), "score")
            found = part if found is None else found.union(part)
        best = F.min(F.struct("tier", (-F.col("score")).alias("less")))
        return found.groupBy("src", "dst").agg(best.alias("best")).select("src", "dst", F.col("best.tier").alias("tier"), (-F.col("best.less")).alias("score"))

    def more_scores(self, rows: DataFrame, matcher: Matcher) -> DataFrame:
        """``(src, dst, score)`` of a matcher's candidates of compatible types."""
        lang = F.col("lang") if "lang" in rows.columns else F.lit("")
        a, b = (rows.select(F.col("kid").alias(n), F.col("name").alias(f"name_{s}"), lang.alias(f"lang_{s}"), F.col("etype").alias(f"type_{s}")) for n, s in (("src", "a"), ("dst", "b")))
        pairs = matcher.candidates(rows).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src < dst").distinct()
        pairs = pairs.join(a, "src").join(b, "dst").where("type_a = '' or type_b = '' or type_a = type_b")
        return pairs.select("src", "dst", matcher.score(pairs).alias("score"))

    def exact_links(self, rows: DataFrame) -> DataFrame:
        lead = rows.groupBy("norm", "etype").agg(F.min("kid").alias("lead"))
        same = rows.join(lead, ["norm", "etype"]).where("kid <> lead").select(F.col("lead").alias("src"), F.col("kid").alias("dst"))
        free = lead.where("etype = ''").select("norm", F.col("lead").alias("src"))
        typed = lead.where("etype <> ''").join(free, "norm").select(F.least("src", "lead").alias("src"), F.greatest("src", "lead").alias("dst"))
        return same.union(typed).select("src", "dst", F.lit(1.0).alias("score"))

    def fuzzy_links(self, rows: DataFrame, form: str, threshold: float, tier: int) -> DataFrame:
        """Jaro-Winkler at the threshold or more: within scripts by normal form, across them by Latin form."""
        return self.fuzzy_scores(rows, form, threshold, tier).where(F.col("score") >= threshold).select("src", "dst", F.lit(tier).alias("tier"), "score")

    def fuzzy_scores(self, rows: DataFrame, form: str, threshold: float, tier: int) -> DataFrame:
        side = rows.select("kid", "norm", "script", "etype", F.col(form).alias("form")).where("form <> ''")
        candidates = self.jaro_winkler_candidates(side, threshold, ["script"] if tier == 2 else [])
        a, b = (side.select(*(F.col(c).alias(f"{c}_{s}") for c in side.columns)) for s in ("a", "b"))
        pairs = candidates.join(a, F.col("src") == F.col("kid_a")).join(b, F.col("dst") == F.col("kid_b")).where("norm_a <> norm_b")
        pairs = pairs.where("script_a = script_b" if tier == 2 else "script_a <> script_b")
        pairs = pairs.where(may_reach_jaro_winkler(F.col("form_a"), F.col("form_b"), threshold))
        return pairs.select("src", "dst", jaro_winkler(F.col("form_a"), F.col("form_b")).alias("score"))

    def jaro_winkler_candidates(self, side: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
        """Pairs (src < dst) that hold every pair of the threshold or more, types compatible: an equi-join on prefixes, lengths and rare letters."""
        tokens = keyed_by_jaro_winkler(side.select("kid", "etype", *keys, "form"), "form", threshold)
        tokens = tokens.drop("form")
        return self.typed_pairs(tokens, [*keys, "token"], tokens.withColumn("token", mate(F.col("token"))))

    @staticmethod
    def typed_pairs(rows: DataFrame, on: list[str], other: DataFrame | None = None) -> DataFrame:
        """Pairs of equal ``on`` whose types are equal or of which one has none, as equi-joins; ``other``: the same rows as the second of a pair has them."""
        a, b = rows.withColumnRenamed("kid", "src"), (rows if other is None else other).withColumnRenamed("kid", "dst")
        typed = a.where("etype <> ''").join(b.where("etype <> ''"), [*on, "etype"]).where("src < dst").select("src", "dst")
        # Of two without a type each is on both sides, so one order is enough.
        free = a.where("etype = ''").select("src", *on).join(b.select("dst", "etype", *on), on).where("src < dst or etype <> '' and src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        return typed.union(free).distinct()

    def last_links(self, rows: DataFrame) -> DataFrame:
        return self.last_scores(rows).where(F.col("score") >= self.tier4).select("src", "dst", F.lit(4).alias("tier"), "score")

    def last_scores(self, rows: DataFrame) -> DataFrame:
        """``(src, dst, score)`` of pairs that hold all matches of the last tier."""
        if self.backend == "ngram":
            return self.gram_scores(rows)
        if self.backend == "model":
            rows = rows.drop("vector").join(encode(rows, self.model), "name")
        rows = materialize(rows.select("kid", "etype", "vector"), "vectors")
        keyed = keyed_by_angle(rows, self.tier4) if self.tier4 > 0 else rows.withColumn("token", F.lit(0))
        pairs = self.typed_pairs(keyed.select("kid", "etype", "token"), ["token"])
        a, b = (rows.select(F.col("kid").alias(n), F.col("vector").alias(f"vector_{s}")) for n, s in (("src", "a"), ("dst", "b")))
        return pairs.join(a, "src").join(b, "dst").select("src", "dst", F.coalesce(cosine(F.col("vector_a"), F.col("vector_b")), F.lit(0.0)).alias("score"))

    def gram_scores(self, rows: DataFrame) -> DataFrame:
        """``(src, dst, score)`` of all pairs whose trigram cosine reaches tier 4 (at 0 or below: of all pairs)."""
        grams = rows.select("kid", "etype", F.explode(char_ngrams(F.lower("name"))).alias("gram")).groupBy("kid", "etype", "gram").agg(F.count("*").cast("double").alias("tf"))
        grams = materialize(grams, "grams")
        norms = grams.groupBy("kid").agg(F.sum(F.col("tf") * F.col("tf")).alias("sq"))
        if self.tier4 <= 0:
            pairs = self.typed_pairs(rows.select("kid", "etype", F.lit(0).alias("token")), ["token"])
        else:
            # The rarest common gram of a pair lies where the grams after it are too light for the threshold.
            often = grams.groupBy("gram").agg(F.count("*").alias("df"))
            rarest = Window.partitionBy("kid").orderBy(F.desc("df"), F.desc("gram")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
            light = grams.join(often, "gram").join(norms, "kid").withColumn("rest", F.sum(F.col("tf") * F.col("tf")).over(rarest))
            prefix = light.where(F.col("rest") >= self.tier4 * self.tier4 * F.col("sq") * (1 - 1e-9))
            pairs = self.typed_pairs(prefix.select("kid", "etype", "gram"), ["gram"])
        a, b = (grams.select(F.col("kid").alias(n), "gram", F.col("tf").alias(f"tf_{n}")) for n in ("src", "dst"))
        dots = pairs.join(a, "src").join(b, ["dst", "gram"]).groupBy("src", "dst").agg(F.sum(F.col("tf_src") * F.col("tf_dst")).alias("dot"))
        x, y = (norms.select(F.col("kid").alias(n), F.col("sq").alias(f"sq_{n}")) for n in ("src", "dst"))
        scored = pairs.join(dots, ["src", "dst"], "left").join(x, "src", "left").join(y, "dst", "left")
        return scored.select("src", "dst", F.coalesce(F.col("dot") / (F.sqrt("sq_src") * F.sqrt("sq_dst")), F.lit(0.0)).alias("score"))

