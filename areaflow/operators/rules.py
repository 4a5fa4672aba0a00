"""Regulation text to rules, and matching rules to storeys and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Keyword lists in two languages, coefficient phrases, comparators.
HEIGHT_WORDS = ["结构层高", "层高", "story height", "storey height"]
ENCLOSURE_WORDS = ["阳台", "封闭", "未封闭", "雨棚", "雨篷", "飘窗", "凸窗", "balcony", "enclosed", "unenclosed",
                   "canopy", "bay window"]
SPECIAL_WORDS = ["地下室", "变形缝", "basement", "shared area", "fire refuge", "equipment room", "parking",
                 "auxiliary room", "deformation joint"]
EXCLUDED_PHRASES = "不计入|不计算|不应计算|不应计入|不予计算|excluded|not counted|not be counted|not be included"
HALF_PHRASES = "1/2|50%|half"
FULL_PHRASES = "全面积|合并.*计算|full area|100%"
# Comparators before and after a length; a negated one holds the plain one, so all are tried longest first.
BEFORE_LENGTH = {
    ">=": ["not less than", "no less than", "not lower than", "not below", "at least", "above", ">=", "≥", "不小于", "不低于",
           "不少于"],
    "<=": ["not more than", "no more than", "not greater than", "not above", "not exceeding", "at most", "up to", "<=", "≤",
           "不大于", "不高于", "不超过"],
    ">": ["more than", "greater than", "higher than", "exceeding", "over", ">", "大于", "高于", "超过"],
    "<": ["below", "under", "less than", "lower than", "<", "低于", "小于", "不足"]}
AFTER_LENGTH = {">=": ["及以上", "以上", "and above", "or above", "and over", "or more"],
                "<=": ["及以下", "and below", "or below", "or less"], "<": ["以下"]}
CLAUSE_START = r"\n(?=\s*\d+\.\d+\.\d+\s)"
CLAUSE = r"(?s)^\s*(\d+\.\d+\.\d+)\s+(.*)$"


def _any(words: dict[str, list[str]]) -> str:
    return "|".join(sorted((w for ws in words.values() for w in ws), key=len, reverse=True))


THRESHOLD = (rf"(?i)(?:({_any(BEFORE_LENGTH)})\s*)?(\d+(?:\.\d+)?)\s*(?:met(?:re|er)s?|m|米)(?![A-Za-z])"
             rf"\s*({_any(AFTER_LENGTH)})?")
SECTION_TITLES = {"height": "Height Requirements", "enclosure": "Enclosure Requirements",
                  "special_use": "Special Space Requirements"}
DEFAULT_BALCONY = 0.5


def clauses(texts: DataFrame) -> DataFrame:
    """Numbered clauses of each text; the number is the citation."""
    parts = F.split(F.concat(F.lit("\n"), "text"), CLAUSE_START)
    rows = texts.select("doc_id", F.posexplode(parts).alias("clause_ord", "raw"))
    return rows.where(F.col("raw").rlike(CLAUSE)).select(
        "doc_id", "clause_ord", F.regexp_extract("raw", CLAUSE, 1).alias("citation"),
        F.trim(F.regexp_replace(F.regexp_extract("raw", CLAUSE, 2), r"\s+$", "")).alias("body"))


def words_hit(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.lower(text).contains(w)
    return hit


def category_of(text: Column) -> Column:
    """R2: height, enclosure or special_use by the first keyword list that hits."""
    return F.when(words_hit(text, HEIGHT_WORDS), "height").when(
        words_hit(text, ENCLOSURE_WORDS), "enclosure").when(words_hit(text, SPECIAL_WORDS), "special_use")


def coefficient_of(text: Column) -> Column:
    """R4."""
    t = F.lower(text)
    return F.when(t.rlike(EXCLUDED_PHRASES), 0.0).when(t.rlike(HALF_PHRASES), 0.5).when(t.rlike(FULL_PHRASES), 1.0)


def sub_clauses(clause_rows: DataFrame) -> DataFrame:
    """Conditions of a clause, one row each, cut at sentence and list marks."""
    parts = F.filter(F.transform(F.split("body", r"[;；。]|\.(?=\s|$)"), lambda p: F.trim(p)), lambda p: F.length(p) > 0)
    return clause_rows.select("*", F.posexplode(parts).alias("sub_ord", "sub"))


def comparator(before: Column, after: Column) -> Column:
    sign = F.lit(None).cast("string")
    for words, found in ((AFTER_LENGTH, after), (BEFORE_LENGTH, before)):
        for op, listed in words.items():
            sign = F.when(F.lower(found).isin(listed), op).otherwise(sign)
    return sign


def compared_lengths(sub: Column) -> Column:
    """Array of (comparator, num, metres): every 'number m' of a text that has a comparator, in order."""
    hits = F.arrays_zip(F.regexp_extract_all(sub, F.lit(THRESHOLD), 1).alias("before"),
                        F.regexp_extract_all(sub, F.lit(THRESHOLD), 2).alias("num"),
                        F.regexp_extract_all(sub, F.lit(THRESHOLD), 3).alias("after"))
    found = F.transform(hits, lambda t: F.struct(
        comparator(t["before"], t["after"]).alias("comparator"), t["num"].alias("num"),
        t["num"].try_cast("double").alias("metres")))
    return F.filter(found, lambda t: t["comparator"].isNotNull() & t["metres"].isNotNull())


def thresholds(subs: DataFrame) -> DataFrame:
    """Every 'number m' with a comparator: metres, comparator and condition."""
    rows = subs.select("*", F.posexplode(compared_lengths(F.col("sub"))).alias("hit_ord", "t"))
    return rows.select(*subs.columns, "hit_ord", "t.comparator", "t.metres", F.concat_ws(
        " ", F.lit("h"), "t.comparator", "t.num").alias("condition_logic"))


def conditions(subs: DataFrame) -> DataFrame:
    """Conditions of each sub-clause: a lower bound followed by a higher upper bound is one range."""
    rows = subs.withColumn("_t", compared_lengths(F.col("sub")))
    lower, upper = (">", ">="), ("<", "<=")

    def text(t: Column) -> Column:
        return F.concat_ws(" ", F.lit("h"), t["comparator"], t["num"])

    def range_of(a: Column, b: Column) -> Column:
        return a["comparator"].isin(*lower) & b["comparator"].isin(*upper) & (a["metres"] <= b["metres"])

    def one(t: Column, i: Column) -> Column:
        after, before = F.get("_t", i + 1), F.get("_t", i - 1)
        return F.when(range_of(t, after), F.concat_ws(" and ", text(t), text(after))).when(
            (i > 0) & range_of(before, t), F.lit(None)).otherwise(text(t))

    return rows.select(*subs.columns, F.posexplode(F.transform("_t", one)).alias("hit_ord", "condition_logic")).where(
        "condition_logic is not null")


def extract_rules(texts: DataFrame) -> DataFrame:
    """Rule rows of every text; a condition without a coefficient gives no rule."""
    subs = sub_clauses(clauses(texts))
    keys = ["doc_id", "clause_ord", "sub_ord"]
    found = conditions(subs).select(*keys, "hit_ord", "condition_logic")
    category = F.coalesce(category_of(F.col("sub")), category_of(F.col("body")))
    return subs.withColumn("coefficient", coefficient_of(F.col("sub"))).withColumn("category", category).where(
        "coefficient is not null and category is not null").join(found, keys, "left").select(
        *keys, F.coalesce("hit_ord", F.lit(0)).alias("hit_ord"), "category", F.col("sub").alias("description"),
        F.coalesce("condition_logic", F.lit("")).alias("condition_logic"), "coefficient", "citation")


def rejects(texts: DataFrame) -> DataFrame:
    """Texts that hold nothing: no rules come from them."""
    return texts.where(F.coalesce(F.length(F.trim("text")), F.lit(0)) == 0).select(
        "doc_id", F.lit("No text extracted").alias("error"))


def rule_set(rules: DataFrame, key: str) -> DataFrame:
    """Three rule lists per regulation and a short trace.

    The caller passes rules keyed by the text they come from, so a list holds no
    more than the clauses of one text.
    """
    row = F.struct("rule_ord", "description", "condition_logic", "coefficient", "citation")

    def part(name: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("category") == name, row)))

    lists = rules.groupBy(key).agg(
        part("height").alias("height_requirements"), part("enclosure").alias("enclosure_requirements"),
        part("special_use").alias("special_space_requirements"))
    return lists.withColumn("reasoning_trace", F.format_string(
        "%d height, %d enclosure, %d special rules", F.size("height_requirements"),
        F.size("enclosure_requirements"), F.size("special_space_requirements")))


def rule_context(rules: DataFrame) -> DataFrame:
    """The rules of a region as one titled text."""
    line = F.concat(F.lit("- "), "description", F.lit(" (Logic: "), "condition_logic", F.lit(")\n"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rule_ord", line.alias("line")))), lambda r: r["line"])
    sections = rules.groupBy("region", "category").agg(F.array_join(lines, "").alias("body"))
    text = F.concat(F.lit("Regulation Context: "), "region", F.lit("\n"))
    one = {c: F.max(F.when(F.col("category") == c, F.col("body"))).alias(c) for c in SECTION_TITLES}
    wide = sections.groupBy("region").agg(*one.values())
    for c, title in SECTION_TITLES.items():
        text = F.concat(text, F.coalesce(F.concat(F.lit(f"\n[{title}]\n"), F.col(c)), F.lit("")))
    return wide.select("region", text.alias("rule_context"))


# --- conditions as bounds; nothing is ever evaluated as code ---

_NUM = r"(-?\d+(?:\.\d+)?)"
_COMPARE = rf"(?:(?:{_NUM}\s*(<=|>=|<|>)\s*)?\bh\s*(<=|>=|<|>|==)\s*{_NUM}|{_NUM}\s*(<=|>=|<|>)\s*h\b)"
_EMPTY = (0.0, False, 0.0, False)  # bounds that nothing meets


def _holds(op: Column, x: Column, y: Column) -> Column:
    return F.when(op == "<", x < y).when(op == "<=", x <= y).when(op == ">", x > y).when(op == ">=", x >= y).otherwise(x == y)


def _reduced(formula: Column) -> Column:
    """A formula over T, F, !, &, | and brackets with one more round of its innermost parts worked out."""
    for pattern, result in ((r"\(([TF])\)", "$1"), ("!!", ""), ("!T", "f"), ("!F", "t")):
        formula = F.regexp_replace(formula, pattern, result)
    formula = F.translate(formula, "tf", "TF")
    for pattern, result in (("T&T", "T"), ("[TF]&F|F&[TF]", "F")):
        formula = F.regexp_replace(formula, pattern, result)
    # `or` waits for an `and` or `not` beside it.
    for pattern, result in (r"(?<![&!])(?:T\|[TF]|[TF]\|T)(?!&)", "T"), (r"(?<![&!])F\|F(?!&)", "F"):
        formula = F.regexp_replace(formula, pattern, result)
    return formula


def condition_bounds(conditions: DataFrame) -> DataFrame:
    """condition_logic, parsed, lo, lo_incl, hi, hi_incl: the heights at which each condition (distinct) holds, an interval a row.

    Conditions compare h with numbers and join comparisons by and, or, not and brackets
    of any depth.  A condition can change only at its numbers, so it is worked out at
    each of them, between neighbours and beyond the ends, and neighbouring places where
    it holds become one interval.  The text is never evaluated as code; anything else
    in it leaves it unparsed, with null bounds.
    """
    text = F.lower("condition_logic")
    groups = [F.regexp_extract_all(text, F.lit(_COMPARE), k).alias(f"g{k}") for k in range(1, 7)]
    frame = F.regexp_replace(text, _COMPARE, "@")
    for word, sign in ((r"\band\b", "&"), (r"\bor\b", "|"), (r"\bnot\b", "!"), (r"\s+", "")):
        frame = F.regexp_replace(frame, word, sign)
    read = conditions.select("condition_logic", frame.alias("frame"), *groups)
    tests = F.transform(F.arrays_zip(*[f"g{k}" for k in range(1, 7)]), lambda c: F.struct(
        F.nullif(c["g1"], F.lit("")).cast("double").alias("a"), c["g2"].alias("ao"),
        F.coalesce(F.nullif(c["g4"], F.lit("")), F.nullif(c["g5"], F.lit(""))).cast("double").alias("b"),
        F.when(c["g4"] != "", c["g3"]).otherwise(F.translate(c["g6"], "<>", "><")).alias("bo")))
    numbers = F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform("tests", lambda t: F.array(t["a"], t["b"]))), lambda v: v.isNotNull())))
    made = read.withColumn("tests", tests).withColumn("v", numbers)

    def place(i: Column) -> Column:
        """Place 2k is below number k, place 2k + 1 is number k itself."""
        k = (i / 2).cast("int")
        lo, hi = F.get("v", k - 1), F.get("v", k)
        h = F.when(i % 2 == 1, hi).when(lo.isNull(), hi - 1).when(hi.isNull(), lo + 1).otherwise((lo + hi) / 2)
        return F.struct(i.alias("i"), h.alias("h"), F.when(i % 2 == 1, hi).otherwise(lo).alias("lo"), hi.alias("hi"), (i % 2 == 1).alias("incl"))

    places = made.where((F.size("tests") > 0) & F.col("frame").rlike(r"^[@&|!()]+$")).withColumn(
        "p", F.explode(F.transform(F.sequence(F.lit(0), 2 * F.size("v")), place)))
    met = F.transform("tests", lambda t: F.when(
        (t["a"].isNull() | _holds(t["ao"], t["a"], F.col("p.h"))) & _holds(t["bo"], F.col("p.h"), t["b"]), "T").otherwise("F"))
    formula = F.array_join(F.zip_with(F.split("frame", "@"), F.concat(met, F.array(F.lit(""))), lambda x, y: F.concat(x, y)), "")
    worked = F.aggregate(F.sequence(F.lit(1), F.length("frame")), F.col("formula"), lambda f, _: _reduced(f))
    judged = places.withColumn("formula", formula).select("condition_logic", "p.*", worked.alias("value"))
    every = Window.partitionBy("condition_logic")
    order = every.orderBy("i")
    known = judged.withColumn("parsed", F.bool_and(F.col("value").isin("T", "F")).over(every)).where("parsed")
    starts = known.withColumn("on", F.col("value") == "T").withColumn("island", F.sum(
        F.when(F.col("on") & ~F.coalesce(F.lag("on").over(order), F.lit(False)), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = starts.where("on").groupBy("condition_logic", "island").agg(
        F.min_by("lo", "i").alias("lo"), F.min_by("incl", "i").alias("lo_incl"), F.max_by("hi", "i").alias("hi"), F.max_by("incl", "i").alias("hi_incl"))
    bounds = spans.select("condition_logic", "lo", F.when(F.col("lo").isNotNull(), F.col("lo_incl")).alias("lo_incl"),
                          "hi", F.when(F.col("hi").isNotNull(), F.col("hi_incl")).alias("hi_incl"), F.lit(True).alias("some"))
    whole = known.select("condition_logic", "parsed").distinct().join(bounds, "condition_logic", "left")
    never = [F.when(F.col("some"), F.col(c)).otherwise(F.lit(e)).alias(c) for c, e in zip(("lo", "lo_incl", "hi", "hi_incl"), _EMPTY)]
    return conditions.join(whole.select("condition_logic", "parsed", *never), "condition_logic", "left").withColumn(
        "parsed", F.coalesce("parsed", F.lit(False)))


def with_bounds(rules: DataFrame) -> DataFrame:
    """Add parsed, lo, lo_incl, hi, hi_incl for conditions on h: a row for each interval; one without bounds where it is not parsed."""
    found = condition_bounds(rules.select("condition_logic").where("condition_logic is not null").distinct())
    bounds = found.withColumnRenamed("condition_logic", "_logic")
    return rules.join(bounds, F.col("condition_logic") == F.col("_logic"), "left").select(
        *rules.columns, F.coalesce("parsed", F.lit(False)).alias("parsed"), "lo", "lo_incl", "hi", "hi_incl")


def unparsed(rules: DataFrame) -> DataFrame:
    """Side table: height conditions that are not plain comparisons and so never match."""
    return with_bounds(rules.where("category = 'height'")).where("not parsed").select(*rules.columns)


def height_coefficients(storeys: DataFrame, rules: DataFrame) -> DataFrame:
    """Last height rule whose bounds hold wins, else 1.0.

    Distinct (region, height) pairs meet the rules of their region; storeys then
    look their pair up, so the theta join grows with distinct heights only.
    """
    pairs = storeys.select("region", "height").distinct()
    bounds = with_bounds(rules.where("category = 'height'")).where("parsed").select(
        F.col("region").alias("r_region"), "rule_ord", "coefficient", "lo", "lo_incl", "hi", "hi_incl")
    h = F.col("height")
    holds = (F.col("lo").isNull() | (h > F.col("lo")) | (F.col("lo_incl") & (h == F.col("lo")))) & (
        F.col("hi").isNull() | (h < F.col("hi")) | (F.col("hi_incl") & (h == F.col("hi"))))
    last = pairs.join(bounds, (F.col("region") == F.col("r_region")) & holds).groupBy(
        F.col("region").alias("c_region"), F.col("height").alias("c_height")).agg(
        F.max_by("coefficient", "rule_ord").alias("c"))
    return storeys.join(last, (F.col("region") == F.col("c_region")) & (h == F.col("c_height")), "left").withColumn(
        "height_coef", F.coalesce("c", F.lit(1.0))).drop("c", "c_region", "c_height")


def balcony_coefficients(storeys: DataFrame, rules: DataFrame) -> DataFrame:
    """First enclosure rule of the region that mentions a balcony, else 0.5."""
    hit = rules.where((F.col("category") == "enclosure") & F.upper("description").contains("BALCONY")).groupBy(
        "region").agg(F.min_by(F.coalesce("coefficient", F.lit(DEFAULT_BALCONY)), "rule_ord").alias("c"))
    return storeys.join(hit, "region", "left").withColumn(
        "balcony_coef", F.coalesce("c", F.lit(DEFAULT_BALCONY))).drop("c")


def special_matches(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """First special rule whose description holds the category or is held by it.

    `pairs` are distinct (region, category); an empty description matches all, and a
    rule without a coefficient counts whole.
    """
    special = rules.where("category = 'special_use'").select(
        F.col("region").alias("r_region"), "rule_ord", "description", "coefficient")
    text = F.upper(F.coalesce("description", F.lit("")))
    near = (F.col("region") == F.col("r_region")) & (F.contains(F.col("category"), text) | F.contains(text, F.col("category")))
    return pairs.join(special, near).groupBy("region", "category").agg(
        F.min_by(F.coalesce("coefficient", F.lit(1.0)), "rule_ord").alias("special_coef"),
        F.min_by(F.coalesce("description", F.lit("")), "rule_ord").alias("special_description"))
