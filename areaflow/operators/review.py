"""Human review: approve and update actions folded onto the alignment table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaflow.operators.classify import element_factor

NOT_ANALYSED = "Analysis not run yet. Please click 'Run Analysis' first."
KEY = ["model_id", "guid"]


def manual_factor(new_type: Column) -> Column:
    """Factor an edited type brings; null removes the factor."""
    t = F.upper(new_type)
    return F.when(t.contains("BALCONY"), 0.5).when(t.contains("EXTERIOR") & t.contains("SLAB"), 0.0)


def fold_actions(actions: DataFrame) -> DataFrame:
    """One row per element: number of actions, last update by seq, and its edit notes as rows kept apart.

    max_by combines map-side, so an element with very many actions costs no more
    than one row per task.
    """
    update = F.col("op") == "update"
    order = F.when(update, F.col("seq"))
    return actions.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_actions"), F.count_if(update).alias("n_updates"),
        F.max_by("new_type", order).alias("last_type"), F.max("seq").alias("last_seq"))


def edit_notes(actions: DataFrame) -> DataFrame:
    """Non-empty reasons of updates, in order of seq, as one text per element."""
    notes = actions.where((F.col("op") == "update") & (F.length("reason") > 0)).select(
        *KEY, "seq", F.concat(F.lit(" [Manual Edit: "), "reason", F.lit("]")).alias("note"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "note")))
    return notes.groupBy(*KEY).agg(F.array_join(F.transform(ordered, lambda n: n["note"]), "").alias("notes"))


def apply_actions(alignment: DataFrame, actions: DataFrame) -> DataFrame:
    """H1, H2: reviewed alignment; actions on unknown elements have no effect here."""
    known = actions.join(alignment.select(*KEY), KEY, "left_semi")
    out = alignment.join(fold_actions(known), KEY, "left").join(edit_notes(known), KEY, "left")
    return apply_fold(out)


def apply_fold(joined: DataFrame) -> DataFrame:
    """Turn alignment rows with folded action columns into reviewed rows."""
    edited = F.col("n_updates") > 0
    reviewed = F.col("n_actions") > 0
    return joined.withColumns({
        "semantic_category": F.when(edited, F.col("last_type")).otherwise(F.col("semantic_category")),
        "status": F.when(reviewed, "VERIFIED").otherwise(F.col("status")),
        "manual_factor": F.when(edited, manual_factor(F.col("last_type"))).otherwise(F.col("manual_factor")),
        "reasoning": F.concat("reasoning", F.coalesce("notes", F.lit("")))}).drop(
        "n_actions", "n_updates", "last_type", "last_seq", "notes")


def rejected_actions(alignment: DataFrame, actions: DataFrame) -> DataFrame:
    """H1: actions on elements that were never analysed."""
    return actions.join(alignment.select(*KEY), KEY, "left_anti")


def review_queue(alignment: DataFrame) -> DataFrame:
    """Rows that need a person, with the aliases the review screen reads."""
    return alignment.where("status = 'NEEDS_REVIEW'").withColumn("type", F.col("ifc_type")).withColumn(
        "reason", F.col("reasoning"))


def queue_after_review(alignment: DataFrame, actions: DataFrame) -> DataFrame:
    """The queue without the elements that were reviewed."""
    return review_queue(alignment).join(actions.select(*KEY).distinct(), KEY, "left_anti")


def review_counts(alignment: DataFrame, actions: DataFrame) -> DataFrame:
    """H3: elements still to review per model, never below zero."""
    queue = alignment.groupBy("model_id").agg(F.count_if(F.col("status") == "NEEDS_REVIEW").alias("n"))
    done = actions.join(alignment.select(*KEY), KEY, "left_semi").select(*KEY).distinct().groupBy("model_id").agg(
        F.count(F.lit(1)).alias("reviewed"))
    return queue.join(done, "model_id", "left").select("model_id", F.greatest(
        F.lit(0), F.col("n") - F.coalesce("reviewed", F.lit(0))).alias("needs_review"))


def element_view(elements: DataFrame, alignment: DataFrame) -> DataFrame:
    """Factor, reason and review mark of every element; a default where nothing was analysed."""
    a = alignment.select(*KEY, "semantic_category", "confidence", "status", "reasoning", "manual_factor",
                         F.lit(True).alias("known"))
    known = F.col("known").isNotNull()
    reason = F.concat(F.lit("Agent 2 Identified as "), F.coalesce("semantic_category", F.lit("None")), F.lit(" ("),
                      F.col("confidence").cast("string"), F.lit(").\nReasoning: "), "reasoning")
    return elements.select("model_id", "guid", "express_id", "ifc_type").join(a, KEY, "left").select(
        "model_id", "guid", "express_id", F.when(known, F.col("ifc_type")).alias("type"),
        F.when(known, element_factor(F.col("semantic_category"), F.col("manual_factor"))).otherwise(0.0).alias("calc_factor"),
        F.when(known, reason).otherwise(NOT_ANALYSED).alias("reason"),
        F.when(known, F.col("status") == "NEEDS_REVIEW").alias("is_dirty"))
