"""Building tables derived from the star-schema test tables.

Every table grows linearly with its source table.  Integer arithmetic comes
first and one division last, so any SQL engine gives the same doubles.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the derivation.
STOREYS_PER_MODEL = 12
IFC_TYPES = ["IfcSpace", "IfcSlab", "IfcWall", "IfcRoof", "IfcCovering", "IfcOpeningElement",
             "IfcBuildingElementProxy"]
PREDEFINED = ["FLOOR", "ROOF", "NOTDEFINED", "LANDING", None, "BASESLAB"]
NAME_SUFFIX = [" shaft", " atrium", " room", " opening", " balcony", " corridor", " void",
               "-interior floor slab", "", "", "", "", ""]
REPLY_CATEGORIES = ["INTERIOR_FLOOR_SLAB", "ROOF_SLAB", "BALCONY", "GENERAL_ROOM", "CORRIDOR",
                    "ATRIUM", "ELEVATOR_SHAFT", "STAIRWELL", "FUNCTIONAL_SHAFT", "PARKING",
                    "GENERIC_ELEMENT"]
AREA_CATEGORIES = ["BALCONY", "VOID", "ATRIUM", "SHAFT", "STAIRWELL", "PARKING", "BASEMENT",
                   "GENERAL_ROOM", "CORRIDOR", "EQUIPMENT ROOM", "ELEVATOR_SHAFT"]
NEW_TYPES = ["BALCONY", "EXTERIOR_FLOOR_SLAB", "CORRIDOR", "GENERAL_ROOM"]
CONTENT_TYPES = ["IfcStair", "IfcRamp", "IfcTransportElement", "IfcElevator", "IfcFlowSegment",
                 "IfcFlowTerminal", "IfcFurniture", "IfcDoor", "IfcWindow", "IfcFurnishingElement",
                 "IfcBeam"]
BOUNDARY_TYPES = ["IfcWall", "IfcWallStandardCase", "IfcRailing", "IfcRailing", None]

# (category, rule_ord, description, condition_logic, coefficient, citation)
BASE_RULES = [
    ("height", 1, "Storey height below 2.2 m", "h < 2.2", 0.5, "3.0.2"),
    ("height", 2, "Storey height below 1.2 m", "h < 1.2", 0.0, "3.0.2"),
    ("height", 3, "Mezzanine by use", "by actual use", 0.5, "3.0.5"),
    ("height", 4, "Storey height of 2.2 m and above", "h >= 2.2", 1.0, "3.0.2"),
    ("enclosure", 1, "Canopy without columns", "canopy", 0.0, "3.0.16"),
    ("enclosure", 2, "Unenclosed Balcony", "balcony outside main structure", 0.5, "3.0.21"),
    ("enclosure", 3, "Enclosed Balcony", "balcony inside main structure", 1.0, "3.0.21"),
    ("special_use", 1, "Parking", "use = parking", 0.5, "3.0.10"),
    ("special_use", 2, "Auxiliary Room", "use = auxiliary_room", 1.0, "3.0.19"),
    ("special_use", 3, "Deformation Joint", "use = deformation_joint", 1.0, "3.0.24"),
    ("special_use", 4, "Basement", "use = basement", 0.5, "3.0.5"),
    ("special_use", 5, "Shared Area", "use = shared_area", 1.0, "3.0.7"),
    ("special_use", 6, "Fire Refuge", "use = fire_refuge", 0.0, "3.0.25"),
    ("special_use", 7, "Equipment Room", "use = equipment_room", 1.0, "3.0.26"),
]


def pick(index: Column, values: list) -> Column:
    """values[index] with a zero-based index column."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (index + 1).cast("int"))


@dataclass
class Buildings:
    """Lazy building tables over one folder of parquet files."""

    spark: SparkSession
    folder: str
    opened: dict[str, DataFrame] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        if name not in self.opened:
            self.opened[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self.opened[name]

    # Row counts come from parquet footers; no data is read.
    @cached_property
    def n_parts(self) -> int:
        return self.table("part").count()

    @cached_property
    def n_models(self) -> int:
        return -(-self.n_parts // STOREYS_PER_MODEL)

    @cached_property
    def n_orders(self) -> int:
        return self.table("orders").count()

    @cached_property
    def n_events(self) -> int:
        return self.table("events").count()

    def models(self) -> DataFrame:
        model = F.expr(f"p_partkey div {STOREYS_PER_MODEL}")
        first = self.table("part").where(F.col("p_partkey") % STOREYS_PER_MODEL == 0).select(
            model.alias("model_id"))
        region = self.table("region")
        return first.join(region, F.col("model_id") % 5 == F.col("r_regionkey")).select(
            "model_id", F.col("r_name").alias("region"), unit_scale().alias("unit_scale"))

    def storeys_raw(self) -> DataFrame:
        part = self.table("part").select(
            F.expr(f"p_partkey div {STOREYS_PER_MODEL}").alias("model_id"),
            F.col("p_partkey").alias("storey_id"),
            (F.col("p_partkey") % STOREYS_PER_MODEL).alias("j"), "p_size", "p_type")
        cm = storey_cm(F.col("j"), F.col("p_size"))
        return part.select(
            "model_id", "storey_id",
            F.when(F.col("storey_id") % 29 == 0, None).when(F.col("j") == 11, "ROOF").otherwise(
                F.concat_ws(" ", "p_type", F.col("j").cast("string"))).alias("name"),
            (cm.cast("double") / 100.0 / unit_scale()).alias("raw_elevation"),
            (F.col("storey_id") * 4 + 1).alias("placement_id"))

    def element_base(self) -> DataFrame:
        """One row per order with every derived number of an element."""
        np, nm = self.n_parts, self.n_models
        o, c = F.col("o_orderkey"), F.col("o_custkey")
        base = self.table("orders").select(
            (o % nm).alias("model_id"), o.alias("express_id"), F.concat(F.lit("E"), o).alias("guid"),
            pick(o % 7, IFC_TYPES).alias("ifc_type"), pick(c % 6, PREDEFINED).alias("predefined_type"),
            (c * 7 % 3700).alias("z_cm"), (20 + c % 350).alias("h_cm"),
            (c % 40).alias("gx"), (o % 30).alias("gy"), (2 + o % 8).alias("gw"), (1 + c % 6).alias("gd"),
            c.alias("custkey"), (F.col("o_orderstatus") == "F").alias("is_contained"))
        in_model = F.least(F.lit(STOREYS_PER_MODEL), np - F.col("model_id") * STOREYS_PER_MODEL)
        return base.withColumn(
            "home_storey", F.col("model_id") * STOREYS_PER_MODEL + F.col("custkey") % in_model)

    def elements(self) -> DataFrame:
        part = self.table("part").select("p_partkey", "p_name")
        e = F.col("express_id")
        return self.element_base().join(part, e % self.n_parts == F.col("p_partkey")).select(
            "model_id", "express_id", "guid", "ifc_type", "predefined_type",
            F.when(e % 31 == 0, "").otherwise(
                F.concat("p_name", pick(e % 13, NAME_SUFFIX))).alias("name"),
            (e * 4 + 2).alias("placement_id"))

    def element_z(self) -> DataFrame:
        """Global height of every element in metres."""
        return self.element_base().select(
            "model_id", "express_id", "guid", "ifc_type", (F.col("z_cm") / 100.0).alias("z_m"))

    def placements(self) -> DataFrame:
        """Element -> storey -> root for contained elements, element -> root for the others."""
        scale = unit_scale()
        storeys = self.storeys_raw().select(
            "model_id", "placement_id", (F.col("model_id") * 4).alias("parent_id"),
            F.col("raw_elevation").alias("dz"))
        roots = storeys.where(F.expr(f"(placement_id - 1) div 4 % {STOREYS_PER_MODEL} = 0")).select(
            "model_id", F.col("parent_id").alias("placement_id"),
            F.lit(None).cast("bigint").alias("parent_id"), F.lit(0.0).alias("dz"))
        part = self.table("part").select("p_partkey", "p_size")
        elements = self.element_base().join(part, F.col("home_storey") == F.col("p_partkey"))
        home_cm = storey_cm(F.col("home_storey") % STOREYS_PER_MODEL, F.col("p_size"))
        elements = elements.select(
            "model_id", (F.col("express_id") * 4 + 2).alias("placement_id"),
            F.when(F.col("is_contained"), F.col("home_storey") * 4 + 1).otherwise(
                F.col("model_id") * 4).alias("parent_id"),
            ((F.col("z_cm") - F.when(F.col("is_contained"), home_cm).otherwise(0)).cast("double")
             / 100.0 / scale).alias("dz"))
        return roots.unionByName(storeys).unionByName(elements)

    def contained_in(self) -> DataFrame:
        return self.element_base().where("is_contained").select(
            "model_id", F.col("home_storey").alias("parent_id"), F.col("express_id").alias("child_id"))

    def rel_contained(self) -> DataFrame:
        """Relation rows with an array of children: one or two per row."""
        e = F.col("express_id")
        return self.element_base().where("is_contained").select(
            "model_id", F.col("home_storey").alias("parent_id"),
            F.when(e % 2 == 0, F.array(e)).otherwise(F.array(e, -e)).alias("related_ids"))

    def space_contents(self) -> DataFrame:
        l = self.table("lineitem").where("l_orderkey % 7 = 0")
        return l.select(
            (F.col("l_orderkey") % self.n_models).alias("model_id"),
            F.col("l_orderkey").alias("space_id"),
            pick(F.col("l_partkey") % 11, CONTENT_TYPES).alias("child_type"))

    def bounded_by(self) -> DataFrame:
        l = self.table("lineitem").where("l_orderkey % 7 = 0")
        kind = pick(F.col("l_suppkey") % 5, BOUNDARY_TYPES)
        return l.select(
            (F.col("l_orderkey") % self.n_models).alias("model_id"),
            F.col("l_orderkey").alias("space_id"),
            F.when(kind.isNotNull(), F.col("l_partkey")).alias("element_id"),
            kind.alias("element_type"))

    def footprints(self) -> DataFrame:
        """Rectangles: slabs in layer 'slab', envelope classes in layer 'wall'."""
        x, y = F.col("gx") * 0.5, F.col("gy") * 0.5
        w, d = F.col("gw") * 0.5, F.col("gd") * 0.5
        kind = F.when(F.col("ifc_type") == "IfcSlab", "slab").when(
            F.col("ifc_type").isin("IfcWall", "IfcCovering", "IfcBuildingElementProxy"), "wall")
        return self.element_base().select(
            "model_id", F.col("home_storey").alias("storey_id"), kind.alias("layer"),
            F.col("express_id").alias("poly_id"), rect_ring(x, y, w, d).alias("ring")
        ).where(F.col("layer").isNotNull())

    def meshes(self) -> DataFrame:
        """The footprint as a box of 8 vertices and 12 triangles, in metres."""
        x0, y0 = F.col("gx") * 0.5, F.col("gy") * 0.5
        x1, y1 = (F.col("gx") + F.col("gw")) * 0.5, (F.col("gy") + F.col("gd")) * 0.5
        z0, z1 = F.col("z_cm") / 100.0, (F.col("z_cm") + F.col("h_cm")) / 100.0
        corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
        verts = [v for z in (z0, z1) for (x, y) in corners for v in (x, y, z)]
        return self.element_base().select(
            "model_id", "express_id", "ifc_type", F.array(*verts).alias("verts"),
            F.array(*[F.lit(i) for i in BOX_FACES]).alias("faces"))

    def psets(self) -> DataFrame:
        e = F.col("express_id")
        flag = F.when(e % 3 == 0, "true").when(e % 3 == 1, "false")
        base = self.element_base().select("model_id", "express_id", "ifc_type")
        events = self.table("events").select("event_id", "props")
        custom = base.join(events, e % self.n_events == F.col("event_id")).select(
            "model_id", "express_id", F.lit(0).alias("pset_ord"), F.lit("Pset_Custom").alias("pset"),
            F.from_json("props", "map<string,string>").alias("props"))
        common = base.where(flag.isNotNull()).select(
            "model_id", "express_id", F.lit(1).alias("pset_ord"),
            F.concat(F.lit("Pset_"), F.substring("ifc_type", 4, 40), F.lit("Common")).alias("pset"),
            F.create_map(F.lit("IsExternal"), flag, F.lit("Reference"),
                         F.when(e % 2 == 0, F.concat(F.lit("R"), e))).alias("props"))
        return custom.unionByName(common)

    def replies(self) -> DataFrame:
        """Model replies: some fenced, some malformed, some without a confidence."""
        e = F.col("express_id")
        conf = e * 37 % 101
        text = F.concat(F.when(conf == 100, "1.").otherwise("0."), F.lpad((conf % 100).cast("string"), 2, "0"))
        body = F.concat(
            F.lit('{"category": "'), pick(e % 11, REPLY_CATEGORIES), F.lit('"'),
            F.when(e % 23 == 0, "").otherwise(F.concat(F.lit(', "confidence": '), text)),
            F.lit(', "reasoning": "r'), e, F.lit('"}'))
        content = F.when(e % 17 == 0, F.concat(F.lit("no json "), e)).when(
            e % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
        return self.element_base().select("model_id", "guid", content.alias("content"))

    def rules(self) -> DataFrame:
        """The base rules for every region; even region keys list the balcony rules the other way."""
        rows = F.array(*[
            F.struct(F.lit(c).alias("category"), F.lit(o).alias("rule_ord"), F.lit(d).alias("description"),
                     F.lit(l).alias("condition_logic"), F.lit(k).alias("coefficient"),
                     F.lit(s).alias("citation")) for c, o, d, l, k, s in BASE_RULES])
        flip = (F.col("r_regionkey") % 2 == 0) & (F.col("rule.category") == "enclosure")
        return self.table("region").select("r_regionkey", "r_name", F.explode(rows).alias("rule")).select(
            F.col("r_name").alias("region"), "rule.category",
            F.when(flip, 4 - F.col("rule.rule_ord")).otherwise(F.col("rule.rule_ord")).alias("rule_ord"),
            "rule.description", "rule.condition_logic", "rule.coefficient", "rule.citation")

    def alignment(self) -> DataFrame:
        """Stage-2 output for spaces and slabs, with areas and some manual factors."""
        e = F.col("express_id")
        conf = e * 37 % 101
        return self.element_base().where(F.col("ifc_type").isin("IfcSpace", "IfcSlab")).select(
            "model_id", "express_id", "guid", "ifc_type",
            F.when(e % 41 == 0, None).otherwise(pick(e % 11, AREA_CATEGORIES)).alias("semantic_category"),
            (conf / 100.0).alias("confidence"),
            F.when(conf >= 65, "AUTO_MAPPED").otherwise("NEEDS_REVIEW").alias("status"),
            F.concat(F.lit("r"), e).alias("reasoning"),
            (F.col("gw") * F.col("gd") / 4.0).alias("area"),
            F.when(e % 19 == 0, 0.5).when(e % 23 == 0, 0.0).alias("manual_factor"),
            (F.col("z_cm") / 100.0).alias("z_m"))

    def review_actions(self) -> DataFrame:
        ev = F.col("event_id")
        return self.table("events").where(F.col("event_type").isin("click", "purchase")).select(
            (ev * 7 % self.n_orders % self.n_models).alias("model_id"), ev.alias("seq"),
            F.when(ev % 50 == 0, F.concat(F.lit("missing"), ev)).otherwise(
                F.concat(F.lit("E"), ev * 7 % self.n_orders)).alias("guid"),
            F.when(F.col("event_type") == "click", "approve").otherwise("update").alias("op"),
            F.when(F.col("event_type") == "purchase", pick(ev % 4, NEW_TYPES)).alias("new_type"),
            F.when(F.col("event_type") == "purchase", F.when(ev % 3 == 0, "").otherwise(
                F.concat(F.lit("why "), ev))).alias("reason"),
            "ts")

    def reg_pages(self) -> DataFrame:
        """Every line of a document is a page; one height clause is appended as the last page."""
        docs = self.table("documents").select("doc_id", "text")
        d = F.col("doc_id")
        clause = F.concat(F.lit("3.0."), (d % 30).cast("string"), F.lit(" Storey height below 2."),
                          (d % 5).cast("string"), F.lit(" m counts 1/2 area"))
        lines = F.split(F.concat("text", F.lit("\n"), clause), "\n")
        return docs.select("doc_id", F.posexplode(lines).alias("page", "text"))

    def reg_texts(self) -> DataFrame:
        """Document text with an appended block of regulation clauses."""
        d = F.col("doc_id")
        clause = F.concat(
            F.lit("\n3.0."), (d % 30).cast("string"), F.lit(" Storey height below 2."),
            (d % 5).cast("string"), F.lit(" m counts 1/2 area; height of 2."), (d % 5).cast("string"),
            F.lit(" m and above counts full area."),
            F.lit("\n3.1."), (d % 9).cast("string"), F.lit(" "),
            pick(d % 8, ["阳台应计算1/2面积；封闭阳台应计算全面积。", "结构层高在2.20m及以上的，应计算全面积；结构层高在2.20m以下的，应计算1/2面积。",
                         "Parking and basement areas are excluded.", "建筑物内的变形缝，应合并计算。",
                         "Storey height not less than 2.2 m counts full area.",
                         "层高不低于2.20m的，应计算全面积；结构层高在1.20m及以上至2.10m以下的，应计算1/2面积。",
                         "层高大于4.50米的部分不应计算面积。",
                         "Basement parts of more than 3.5 metres or not more than 1.2 meters are excluded."]))
        return self.table("documents").select("doc_id", F.concat("text", clause).alias("text"))

    def wall_curves(self) -> DataFrame:
        ev = F.col("event_id")
        return self.table("events").select(
            F.col("user_id").alias("wall_id"), ev.alias("pt_ord"),
            (ev * 3 % 100 / 10.0).alias("x"), (F.col("value") / 10.0).alias("y"))

    def area_inputs(self) -> DataFrame:
        """Base and outside area per storey as plain numbers; some storeys have no outline."""
        s = F.col("p_partkey")
        return self.table("part").select(
            F.expr(f"p_partkey div {STOREYS_PER_MODEL}").alias("model_id"), s.alias("storey_id"),
            F.when(s % 37 == 0, 0.0).otherwise(60.0 + F.col("p_size")).alias("base_area"),
            F.when(s % 37 == 0, 0.0).otherwise((s % 5) * 2.5).alias("outside_area"))


# Two triangles per side of a box, outward normals; fixed values.
BOX_FACES = [0, 2, 1, 0, 3, 2, 4, 5, 6, 4, 6, 7, 0, 1, 5, 0, 5, 4,
             1, 2, 6, 1, 6, 5, 2, 3, 7, 2, 7, 6, 3, 0, 4, 3, 4, 7]


def unit_scale() -> Column:
    return F.when(F.col("model_id") % 2 == 0, 1.0).otherwise(0.001)


def storey_cm(j: Column, size: Column) -> Column:
    return j * 300 + size % 10 * 10 - F.when(j % 4 == 3, 290).otherwise(0)


def rect_ring(x: Column, y: Column, w: Column, d: Column) -> Column:
    def point(px, py):
        return F.struct(px.alias("x"), py.alias("y"))

    return F.array(point(x, y), point(x + w, y), point(x + w, y + d), point(x, y + d))
