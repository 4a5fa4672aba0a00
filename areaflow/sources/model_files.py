"""Entity scan of building-model exchange files (STEP text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areaflow.session import cut_lineage

# Fixed patterns of the exchange format.  Strings double their quotes; lists nest as deep as they are found to.
MAX_DEPTH = 400
QUOTED = r"'(?:[^']++|'')*+'"
COMMENT = r"/\*(?s:.*?)\*/"
STATEMENT = rf"{QUOTED}|{COMMENT}|(#\d+\s*=(?:[^';/]++|{QUOTED}|{COMMENT}|/)*+);"
INSTANCE = r"#\d+\s*="
ENTITY = r"(?s)^#(\d+)\s*=\s*([A-Za-z0-9_]+)\s*\((.*)\)\s*$"


def argument_pattern(depth: int) -> str:
    """One argument at the top: a string, a list (with a type name or not) of at most `depth` levels, or anything else."""
    inner = rf"(?:[^()']++|{QUOTED})*+"
    for _ in range(depth - 1):
        inner = rf"(?:[^()']++|{QUOTED}|\({inner}\))*+"
    return rf"({QUOTED}|[A-Za-z0-9_]*\({inner}\)|[^,()'\s]+(?:\s+[^,()'\s]+)*)"


def nesting_depth(statements: DataFrame) -> int:
    """Levels of the deepest list in the arguments of any statement.

    What is left of a statement without its strings and all but its brackets is
    stripped of its innermost lists, eight levels a job, until nothing goes.  Only
    the distinct remains are looked at, in which neighbouring lists are one.
    """
    bare = F.regexp_replace(without_comments(F.col("statement")), rf"{QUOTED}|[^()']", "")
    shapes = cut_lineage(statements.select(F.regexp_replace(bare, r"(?:\(\))+", "()").alias("s")).distinct())
    depth = 0
    while depth <= MAX_DEPTH:
        levels = [F.col("s")]
        for _ in range(8):
            levels.append(F.regexp_replace(levels[-1], r"(?:\(\))+", ""))
        went = sum(((F.length(b) < F.length(a)).cast("int") for a, b in zip(levels, levels[1:])), F.lit(0))
        deepest = shapes.agg(F.max(went)).first()[0] or 0
        depth += deepest
        if deepest < 8:
            break
        shapes = cut_lineage(shapes.select(levels[-1].alias("s")).distinct())
    return max(1, depth - 1)  # the outermost brackets hold the arguments


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """Instance statements (file, statement) of all files below the path.

    A line that ends in ';' ends a statement, because strings hold no line ends, so
    files split into rows and tasks there; a row is then cut into whole statements by
    a pattern that knows strings and comments.  What looks like an instance but is not
    whole comes as it is and ends among the rejected statements.  The first line tells the line end;
    files with another one are still read right, but whole.
    """
    first = spark.read.option("lineSep", "\n").text(path).limit(1).collect()
    line_end = "\r\n" if first and first[0]["value"].endswith("\r") else "\n"
    rows = spark.read.option("lineSep", f";{line_end}").text(path)
    text = F.concat("value", F.lit(";"))
    cut = F.filter(F.regexp_extract_all(text, F.lit(STATEMENT), 1), lambda s: F.length(s) > 0)
    rest = F.regexp_replace(text, STATEMENT, "")
    broken = F.when(rest.rlike(INSTANCE), F.array(F.trim(rest))).otherwise(F.array().cast("array<string>"))
    return rows.select(F.input_file_name().alias("file"), F.explode(F.concat(cut, broken)).alias("statement"))


def without_comments(statement: Column) -> Column:
    return F.trim(F.regexp_replace(statement, rf"({QUOTED})|{COMMENT}", "$1"))


def parse_entities(statements: DataFrame, depth: int | None = None) -> DataFrame:
    """entity_id, entity_type (upper case) and the top-level arguments of each instance statement.

    Lists may be nested to any depth up to MAX_DEPTH, which is measured unless given;
    statements with deeper ones are among the rejected statements.
    """
    keep = [c for c in statements.columns if c != "statement"]
    whole = _cut(statements, min(MAX_DEPTH, depth or nesting_depth(statements))).where("is_whole")
    return whole.select(*keep, F.regexp_extract("statement", ENTITY, 1).try_cast("bigint").alias("entity_id"),
                        F.upper(F.regexp_extract("statement", ENTITY, 2)).alias("entity_type"), "args")


def _cut(statements: DataFrame, depth: int) -> DataFrame:
    """statement without comments, its arguments, and whether it is one whole entity whose arguments account for all of it."""
    keep = [c for c in statements.columns if c != "statement"]
    pattern = argument_pattern(depth)
    inner = F.regexp_extract("statement", ENTITY, 3)
    bare = statements.select(*keep, F.col("statement").alias("_raw"), without_comments(F.col("statement")).alias("statement"))
    cut = bare.withColumn("args", F.regexp_extract_all(inner, F.lit(pattern), 1))
    rest = F.regexp_replace(inner, pattern, "")
    return cut.withColumn("is_whole", F.coalesce(is_entity(F.col("statement")) & rest.rlike(r"^[\s,]*$"), F.lit(False)))


def is_entity(statement: Column) -> Column:
    return statement.rlike(ENTITY) & F.regexp_extract(statement, ENTITY, 1).try_cast("bigint").isNotNull()


def rejected_statements(statements: DataFrame, depth: int | None = None) -> DataFrame:
    """Side table: instance statements that are no single whole entity, such as those without or with too deep an argument list."""
    judged = _cut(statements, min(MAX_DEPTH, depth or nesting_depth(statements))).where("not is_whole")
    return judged.select(*[c for c in statements.columns if c != "statement"], F.col("_raw").alias("statement"))


def by_type(table: DataFrame, types: list[str], column: str = "ifc_type") -> DataFrame:
    """Rows of the listed classes; the filter reaches the scan."""
    return table.where(F.col(column).isin(types))
