"""Mesh, property-set, containment and page-text sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def axis(verts: Column, offset: int) -> Column:
    """Every third number of a flat coordinate array."""
    return F.filter(verts, lambda v, i: i % 3 == offset)


def vertices(meshes: DataFrame) -> DataFrame:
    """One row per vertex: model_id, express_id, v, x, y, z."""
    triples = F.transform(F.sequence(F.lit(0), F.floor(F.size("verts") / 3).cast("int") - 1), lambda i: F.struct(
        i.alias("v"), *[F.get("verts", i * 3 + k).alias(n) for k, n in enumerate("xyz")]))
    return meshes.where(F.size("verts") >= 3).select(
        "model_id", "express_id", F.explode(triples).alias("p")).select("model_id", "express_id", "p.*")


def triangles(meshes: DataFrame) -> DataFrame:
    """S3: one row per face with its three corners; faces with an index out of range are left out."""
    n = F.floor(F.size("verts") / 3)
    corners = [F.struct(*[F.get("verts", F.get("faces", F.col("f") * 3 + c) * 3 + k).alias(a)
                          for k, a in enumerate("xyz")]).alias(f"p{c + 1}") for c in range(3)]
    numbered = meshes.where(F.size("faces") >= 3).withColumn(
        "f", F.explode(F.sequence(F.lit(0), F.floor(F.size("faces") / 3).cast("int") - 1)))
    index = [F.get("faces", F.col("f") * 3 + c) for c in range(3)]
    valid = (F.greatest(*index) < n) & (F.least(*index) >= 0)
    carried = [c for c in meshes.columns if c not in ("verts", "faces")]
    return numbered.where(valid).select(*carried, F.col("f").alias("face"), *corners)


def flatten_psets(psets: DataFrame) -> DataFrame:
    """One row per property; a missing value shows as '-'."""
    return psets.select("model_id", "express_id", F.coalesce("pset", F.lit("Property Set")).alias("pset"),
                        F.explode("props").alias("prop", "value")).withColumn(
        "value", F.coalesce("value", F.lit("-")))


def containment_edges(rel_contained: DataFrame) -> DataFrame:
    """Parent to child edges of the containment relation."""
    return rel_contained.select("model_id", "parent_id", F.explode("related_ids").alias("child_id"))


def document_text(pages: DataFrame, cap: int | None = None) -> DataFrame:
    """Pages joined by newline in page order; with `cap`, the first characters only, for a scorer with a limit."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    joined = F.concat(F.array_join(F.transform(ordered, lambda p: F.coalesce(p["text"], F.lit(""))), "\n"), F.lit("\n"))
    return pages.groupBy("doc_id").agg((F.substring(joined, 1, cap) if cap else joined).alias("text"))
