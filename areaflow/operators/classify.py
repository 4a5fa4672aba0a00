"""Mode, candidates, prompts, replies, calibrated confidence and the alignment table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areaflow.functions.numbers import rounded

# The category taxonomy (name, classes it is valid for), in order.
_VOLUMES = ["IfcSpace", "IfcOpeningElement", "IfcBuildingElementProxy"]
TAXONOMY = [
    ("INTERIOR_FLOOR_SLAB", ["IfcSlab"]), ("ROOF_SLAB", ["IfcSlab", "IfcRoof"]), ("BALCONY", ["IfcSlab"]),
    ("GENERAL_ROOM", _VOLUMES), ("CORRIDOR", ["IfcSpace"]), ("ATRIUM", _VOLUMES), ("ELEVATOR_SHAFT", _VOLUMES),
    ("STAIRWELL", _VOLUMES), ("FUNCTIONAL_SHAFT", _VOLUMES)]
DYNAMIC_NAMES = ["parking", "auxiliary_room", "deformation_joint", "basement", "shared_area", "fire_refuge",
                 "equipment_room"]
DYNAMIC_TYPES = ["IfcSpace", "IfcBuildingElementProxy", "IfcSlab"]
VERTICAL_TYPES = ["IfcOpeningElement", "IfcBuildingElementProxy"]
VERTICAL_NAME_WORDS = ["shaft", "atrium", "void", "riser", "lift"]
VERTICAL_CATEGORY_WORDS = ["SHAFT", "ATRIUM", "STAIRWELL", "ELEVATOR", "VOID"]
STRONG_TYPES = ["ROOF", "BEAM", "COLUMN", "FLOOR", "BASESLAB", "STAIR", "RAMP"]
WEAK_TYPES = ["NOTDEFINED", "USERDEFINED", "None"]
REVIEW_THRESHOLD = 0.65
REPLY_SCHEMA = "category string, confidence string, reasoning string, broken string"


def any_word(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def base_categories(regions: DataFrame) -> DataFrame:
    """The fixed taxonomy for every region."""
    rows = F.array(*[F.struct(F.lit(i).alias("cat_ord"), F.lit(name).alias("name"),
                              F.array(*[F.lit(t) for t in types]).alias("valid_types"))
                     for i, (name, types) in enumerate(TAXONOMY, 1)])
    return regions.select("region").distinct().select("region", F.explode(rows).alias("c")).select("region", "c.*")


def dynamic_name(description: Column, logic: Column) -> Column:
    """First listed name found as words in the description or as is in the logic."""
    found = F.lit(None).cast("string")
    for name in reversed(DYNAMIC_NAMES):
        hit = F.lower(description).contains(name.replace("_", " ")) | F.lower(logic).contains(name)
        found = F.when(F.coalesce(hit, F.lit(False)), name.upper()).otherwise(found)
    return found


def active_categories(regions: DataFrame, rules: DataFrame) -> DataFrame:
    """Base taxonomy of every region plus the names its special-use rules bring in, first wins."""
    found = rules.where("category = 'special_use'").select(
        "region", "rule_ord", dynamic_name(F.col("description"), F.col("condition_logic")).alias("name"))
    # At most one row per region and listed name is left before the numbering.
    new = found.where(F.col("name").isNotNull() & ~F.col("name").isin([n for n, _ in TAXONOMY])).groupBy(
        "region", "name").agg(F.min("rule_ord").alias("first_ord"))
    names = F.array_sort(F.collect_list(F.struct("first_ord", "name")))
    placed = new.groupBy("region").agg(names.alias("names")).select("region", F.posexplode("names").alias("i", "n"))
    added = placed.select("region", (F.col("i") + 1 + len(TAXONOMY)).alias("cat_ord"), F.col("n.name").alias("name"),
                          F.array(*[F.lit(t) for t in DYNAMIC_TYPES]).alias("valid_types"))
    return base_categories(regions).unionByName(added)


def class_mode(ifc_type: Column, span: Column, name: Column) -> Column:
    """VERTICAL for openings and proxies, tall spaces and spaces named like a shaft."""
    vertical = ifc_type.isin(VERTICAL_TYPES) | ((ifc_type == "IfcSpace") & (
        (span >= 1.5) | any_word(F.lower(name), VERTICAL_NAME_WORDS)))
    return F.when(vertical, "VERTICAL").otherwise("GENERAL")


def candidate_table(categories: DataFrame) -> DataFrame:
    """candidate names per (region, class, mode); a few rows per region."""
    per_type = categories.select("region", "cat_ord", "name", F.explode("valid_types").alias("ifc_type"))
    modes = per_type.withColumn("mode", F.explode(F.array(F.lit("GENERAL"), F.lit("VERTICAL"))))
    fits = (F.col("mode") == "GENERAL") | any_word(F.upper("name"), VERTICAL_CATEGORY_WORDS) | (
        F.col("name") == "GENERAL_ROOM")
    names = F.array_sort(F.collect_list(F.struct("cat_ord", "name")))
    return modes.where(fits).groupBy("region", "ifc_type", "mode").agg(
        F.transform(names, lambda c: c["name"]).alias("candidates"))


def with_candidates(elements: DataFrame, categories: DataFrame) -> DataFrame:
    """Elements (with region and mode) with their candidates, or GENERIC_ELEMENT."""
    return elements.join(candidate_table(categories), ["region", "ifc_type", "mode"], "left").withColumn(
        "candidates", F.coalesce("candidates", F.array(F.lit("GENERIC_ELEMENT"))))


def prompt_rows(features: DataFrame, pset_chars: int | None = None) -> DataFrame:
    """One request text per element for the pluggable scorer; `pset_chars` cuts the properties for one with a limit."""
    properties = F.coalesce("psets_text", F.lit("{}"))
    properties = F.substring(properties, 1, pset_chars) if pset_chars else properties
    dims = F.to_json(F.struct("height", "width", "depth", "area", "volume", "thickness", "aspect_ratio",
                              F.array("bbox_dx", "bbox_dy", "bbox_dz").alias("bbox_dims")))
    allowed = F.to_json("candidates")
    answer = 'Answer with JSON: {"category": ..., "confidence": 0.0-1.0, "reasoning": ...}'
    general = F.concat_ws("\n", F.concat(F.lit("Rules in force: "), "rule_context"),
                          F.concat(F.lit("Class: "), "ifc_type"),
                          F.concat(F.lit("Predefined type: "), F.coalesce("predefined_type", F.lit("None"))),
                          F.concat(F.lit("External: "), "is_external"), F.concat(F.lit("Name: "), "name"),
                          F.concat(F.lit("Dimensions: "), dims),
                          F.concat(F.lit("Properties: "), properties),
                          F.concat(F.lit("Choose one functional category from: "), allowed), F.lit(answer))
    vertical = F.concat_ws("\n", F.concat(F.lit("Rules in force: "), "rule_context"),
                           F.concat(F.lit("Class: "), "ifc_type"), F.concat(F.lit("Name: "), "name"),
                           F.format_string("Height %.2f m, area %.2f m2, aspect %.1f, spans %.1f floors",
                                           "height", "area", "aspect_ratio", "floor_span"),
                           F.format_string("Stair %s, elevator %s, services %s, enclosure %s",
                                           "contains_stair", "contains_transport", "contains_mep", "boundary_material"),
                           F.concat(F.lit("Shaft or atrium? Choose from: "), allowed), F.lit(answer))
    return features.select("model_id", "guid", "mode", F.when(
        F.col("mode") == "GENERAL", general).otherwise(vertical).alias("prompt"))


def parse_replies(replies: DataFrame) -> DataFrame:
    """Strip code fences and read JSON; a broken reply becomes ERROR with confidence 0."""
    text = F.replace(F.replace(F.trim("content"), F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))
    parsed = replies.withColumn("r", F.from_json(
        F.trim(F.regexp_replace(text, "\\s+$", "")), REPLY_SCHEMA, {"columnNameOfCorruptRecord": "broken"}))
    confidence = F.col("r.confidence").try_cast("double")  # a number may come as text
    failed = F.col("r").isNull() | F.col("r.broken").isNotNull() | (F.col("r.confidence").isNotNull() & confidence.isNull())
    return parsed.select(
        "model_id", "guid", failed.alias("failed"),
        F.when(failed, "ERROR").otherwise(F.col("r.category")).alias("category"),
        F.when(failed, 0.0).otherwise(F.coalesce(confidence, F.lit(0.5))).alias("raw_confidence"),
        F.when(failed, "reply is not valid JSON").otherwise(F.col("r.reasoning")).alias("reasoning"))


def calibrate_general(f: dict[str, Column]) -> Column:
    """C4. `f` holds raw, category, name, ifc_type, predefined_type, is_external, area."""
    category, name = f["category"], F.upper(f["name"])
    area = F.when(f["ifc_type"] == "IfcSpace", f["area"]).otherwise(0.0)
    s = 0.5 + (f["raw"] - 0.5) * 0.5
    kind = f["predefined_type"]
    s = s + F.when((F.length(kind) > 0) & ~kind.isin(WEAK_TYPES),
                   F.when(kind.isin(STRONG_TYPES), 0.20).otherwise(0.10)).otherwise(0.0)
    s = s + F.when(f["is_external"].isin("TRUE", "FALSE"), 0.08).otherwise(0.0)
    clean = F.replace(F.replace(category, F.lit("_"), F.lit("")), F.lit(" "), F.lit(""))
    s = s + F.when(F.replace(name, F.lit(" "), F.lit("")).contains(clean) | category.contains(name), 0.12).otherwise(0.0)
    s = s + F.when(area > 0.1, 0.05).otherwise(0.0)
    s = F.when(category == "GENERIC_ELEMENT", F.least(s - 0.15, F.lit(0.75))).otherwise(s)
    s = s - F.when(area == 0, 0.30).otherwise(0.0)
    s = s - F.when(F.length(name) < 3, 0.05).otherwise(0.0)
    return rounded(F.greatest(F.lit(0.1), F.least(s, F.lit(0.99))), 2)


def calibrate_vertical(f: dict[str, Column]) -> Column:
    """C5. As C4 plus contains_stair, contains_transport, boundary_material; caps depend on the order."""
    category, name, area = F.upper(f["category"]), F.lower(f["name"]), f["area"]
    s = f["raw"]
    fallback = category.isin("GENERAL_ROOM", "GENERIC_ELEMENT", "UNKNOWN")
    s = s - F.when(fallback, F.when(any_word(name, ["opening", "void", "hole"]), 0.45).when(
        area < 2.5, 0.3).otherwise(0.0)).otherwise(0.0)
    s = F.when(fallback & ~any_word(name, ["room", "office"]), F.least(s, F.lit(0.7))).otherwise(s)
    s = s - F.when((category == "ATRIUM") & (area < 15.0), 0.5).otherwise(0.0)
    evidence = f["contains_stair"] | f["contains_transport"] | (f["boundary_material"] == "WALL") | name.contains("shaft")
    s = F.when(category.contains("SHAFT") & ~evidence, F.least(s - 0.25, F.lit(0.65))).otherwise(s)
    named = F.upper(F.replace(name, F.lit("-"), F.lit(""))).contains(F.replace(category, F.lit("_"), F.lit("")))
    s = s + F.when(named, 0.15).otherwise(0.0)
    s = s + F.when((category == "STAIRWELL") & f["contains_stair"], 0.25).when(
        (category == "ATRIUM") & (f["boundary_material"] == "RAILING"), 0.2).otherwise(0.0)
    return rounded(F.greatest(F.lit(0.2), F.least(s, F.lit(0.99))), 2)


def feature_columns() -> dict[str, Column]:
    names = ("category", "name", "ifc_type", "predefined_type", "is_external", "area", "contains_stair",
             "contains_transport", "boundary_material")
    return {"raw": F.col("raw_confidence")} | {n: F.col(n) for n in names}


def review_status(confidence: Column) -> Column:
    """F2."""
    return F.when(confidence >= REVIEW_THRESHOLD, "AUTO_MAPPED").otherwise("NEEDS_REVIEW")


def baseline_classify(features: DataFrame) -> DataFrame:
    """Rule-based scorer in the place of a remote model; same columns as a parsed reply."""
    ladder = F.when(F.col("floor_span") < 1.5, F.when(F.lower("name").contains("corridor"), "CORRIDOR").otherwise(
        "GENERAL_ROOM")).when(F.col("contains_stair"), "STAIRWELL").when(
        F.col("contains_transport"), "ELEVATOR_SHAFT").when(F.col("contains_mep"), "MEP_SHAFT").when(
        F.col("boundary_material") == "RAILING", "ATRIUM").when(
        F.col("boundary_material") == "WALL", "FUNCTIONAL_SHAFT")
    squeezed = F.replace(F.replace(F.upper("name"), F.lit(" "), F.lit("")), F.lit("-"), F.lit(""))
    by_name = F.get(F.filter("candidates", lambda c: squeezed.contains(F.replace(c, F.lit("_"), F.lit("")))), 0)
    guess = F.when(F.col("mode") == "VERTICAL", ladder).otherwise(by_name)
    hit = guess.isNotNull() & F.array_contains("candidates", F.coalesce(guess, F.lit("")))
    return features.select(
        "model_id", "guid", F.lit(False).alias("failed"),
        F.when(hit, guess).otherwise(F.get("candidates", 0)).alias("category"),
        F.when(hit, 0.8).otherwise(0.5).alias("raw_confidence"),
        F.when(hit, "rule").otherwise("first candidate").alias("reasoning"))


def align(features: DataFrame, answers: DataFrame) -> DataFrame:
    """Features with parsed answers -> category, calibrated confidence, status.

    A failed reply keeps ERROR and 0.0; an answer without category or reasoning is skipped.
    """
    joined = features.join(answers, ["model_id", "guid"]).where(
        F.col("category").isNotNull() & F.col("reasoning").isNotNull())
    cols = feature_columns()
    confidence = F.when(F.col("failed"), 0.0).when(F.col("mode") == "GENERAL", calibrate_general(cols)).otherwise(
        calibrate_vertical(cols))
    scored = joined.withColumn("confidence", confidence)
    return scored.withColumn("status", review_status(F.col("confidence"))).withColumnRenamed(
        "category", "semantic_category")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """U4: last write wins; combined map-side, no sort of a key's history."""
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return newest.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def alignment_meta(elements: DataFrame, alignment: DataFrame) -> DataFrame:
    """A10: all elements count, failed or skipped ones too; share mapped without review."""
    total = elements.groupBy("model_id").agg(F.count(F.lit(1)).alias("total"))
    review = alignment.groupBy("model_id").agg(
        F.count_if(F.col("status") == "NEEDS_REVIEW").alias("needs_review"),
        F.count_if(F.col("status") == "AUTO_MAPPED").alias("auto_mapped"))
    return total.join(review, "model_id", "left").select(
        "model_id", "total", F.coalesce("needs_review", F.lit(0)).alias("needs_review"),
        rounded(F.coalesce("auto_mapped", F.lit(0)) / F.col("total"), 4).alias("auto_share"))


def confidence_hist(alignment: DataFrame) -> DataFrame:
    """Counts and percent above 80 %, 50-80 % and below 50 %."""
    bucket = F.when(F.col("confidence") > 0.8, "high").when(F.col("confidence") >= 0.5, "medium").otherwise("low")
    counts = alignment.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over the three bucket rows
    return counts.select("bucket", "n", rounded(F.col("n") * 100.0 / total, 1).alias("percent"))


def element_factor(category: Column, manual: Column) -> Column:
    """P14."""
    return F.coalesce(manual, F.when(category == "BALCONY", 0.5).otherwise(1.0))


def treatment_counts(alignment: DataFrame) -> DataFrame:
    """Elements counted in full, by half, not at all, or otherwise."""
    f = element_factor(F.col("semantic_category"), F.col("manual_factor"))
    kind = F.when(f == 1.0, "full").when(f == 0.5, "half").when(f == 0.0, "excluded").otherwise("other")
    return alignment.groupBy(kind.alias("treatment")).agg(F.count(F.lit(1)).alias("n"))


def review_impact(alignment: DataFrame) -> DataFrame:
    """Largest change of a model's area, in percent, if every element under review flips."""
    f = element_factor(F.col("semantic_category"), F.col("manual_factor"))
    spread = F.greatest(F.abs(f), F.abs(1.0 - f))
    pending = F.when(F.col("status") == "NEEDS_REVIEW", F.col("area") * spread).otherwise(0.0)
    sums = alignment.groupBy("model_id").agg(
        F.count_if(F.col("status") == "NEEDS_REVIEW").alias("n_pending"),
        F.sum(pending.cast("decimal(18,4)")).cast("double").alias("at_stake"),
        F.sum((F.col("area") * f).cast("decimal(18,4)")).cast("double").alias("total"))
    return sums.select("model_id", "n_pending", F.when(F.col("total") > 0, rounded(
        F.col("at_stake") * 100.0 / F.col("total"), 2)).alias("impact_percent"))
