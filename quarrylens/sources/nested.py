"""Nested documents as VARIANT: leaves, level by level, and the merge of two documents, all in the JVM.

A text becomes a variant once. Each level of a document is one lateral explode, in which leaves stay as they are, so
a table of documents is read once whatever their depth, and rows fan out without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .readers import DEPTH, ITEMS, METHODS

#: Levels to which two documents are merged; below, the second one's value counts whole.
MERGED = 8


def parsed(c: Column | str) -> Column:
    """A JSON text as a variant; what does not parse is null."""
    return F.try_parse_json(F.col(c) if isinstance(c, str) else c)


def members(v: Column) -> Column:
    """An object's members by name; null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def value_text(v: Column) -> Column:
    """A leaf as text: null is empty, truth values with a capital, numbers as JSON has them without trailing zeros."""
    kind = F.schema_of_variant(v)
    return F.when(kind == "VOID", "").when(kind == "BOOLEAN", F.initcap(v.cast("string"))).otherwise(F.coalesce(v.cast("string"), F.lit("")))


def leaves(rows: DataFrame, keys: list[str], value: str, depth: int = DEPTH, items: int = ITEMS) -> DataFrame:
    """Each leaf's path (``a.b[0].c``) and text. What is nested deeper than ``depth``, and a list's items past the first
    ``items``, are left out; so are empty objects and lists, and rows that are no variant. A bare value has an empty path.
    """
    kind = F.schema_of_variant("v")
    open_ = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    at = rows.select(*keys, F.lit("").alias("path"), F.col(value).alias("v")).where("v is not null").withColumn("_open", open_)
    spark = rows.sparkSession
    for _ in range(depth):
        below = at.alias("r").lateralJoin(spark.tvf.variant_explode_outer(F.when(F.col("r._open"), F.col("r.v")).outer()).alias("e"))
        name = F.when(F.col("e.key").isNull(), F.concat("r.path", F.lit("["), F.col("e.pos").cast("string"), F.lit("]"))).when(F.col("r.path") == "", F.col("e.key")).otherwise(F.concat("r.path", F.lit("."), "e.key"))
        below = below.where(~F.col("r._open") | F.col("e.key").isNotNull() | (F.col("e.pos") < items))  # an empty one opens to nothing
        at = below.select(*[F.col(f"r.{k}").alias(k) for k in keys], F.when(F.col("r._open"), name).otherwise(F.col("r.path")).alias("path"), F.when(F.col("r._open"), F.col("e.value")).otherwise(F.col("r.v")).alias("v"))
        at = at.withColumn("_open", open_)
    return at.where(~F.col("_open")).select(*keys, "path", value_text(F.col("v")).alias("value"))


def merged(base: Column, override: Column, levels: int = MERGED) -> Column:
    """Two objects in one: members of both, and where both have objects these in turn, else the second one's value.

    A null member of the second counts as a value. If one is no variant (SQL null), the other one; if one is no object,
    the second.
    """
    if levels == 0:
        return F.coalesce(override, base)
    both = F.map_zip_with(members(base), members(override), lambda _, x, y: F.when(y.isNull(), x).when(x.isNull(), y).otherwise(merged(x, y, levels - 1)))
    return F.when(members(base).isNull() | members(override).isNull(), F.coalesce(override, base)).otherwise(F.to_variant_object(both))


def operations(specs: DataFrame, keys: list[str], spec: str) -> DataFrame:
    """A row for each operation of API descriptions: path, method, name, and the schemes that it asks for (``security``).

    The operation's own security counts, else the description's; an empty list, or none at all, is no authentication.
    """
    spark = specs.sparkSession
    names = lambda v: F.flatten(F.transform(F.try_variant_get(v, "$", "array<map<string,variant>>"), F.map_keys))
    rows = specs.select(*keys, members(F.col(spec)).alias("_m")).where("_m is not null")
    rows = rows.select(*keys, F.try_element_at("_m", F.lit("paths")).alias("_paths"), F.try_element_at("_m", F.lit("security")).alias("_own"))
    paths = rows.alias("r").lateralJoin(spark.tvf.variant_explode(F.col("r._paths").outer()).alias("p")).select(*[F.col(f"r.{k}").alias(k) for k in keys], "r._own", F.col("p.key").alias("path"), F.col("p.value").alias("_methods"))
    each = paths.alias("r").lateralJoin(spark.tvf.variant_explode(F.col("r._methods").outer()).alias("m")).select(*[F.col(f"r.{k}").alias(k) for k in keys], "r._own", "r.path", F.lower("m.key").alias("method"), members(F.col("m.value")).alias("_op"))
    each = each.where(F.col("method").isin(list(METHODS)) & F.col("_op").isNotNull())
    text = lambda k: F.try_element_at("_op", F.lit(k)).cast("string")
    asked = F.coalesce(names(F.try_element_at("_op", F.lit("security"))), names(F.col("_own")), F.array().cast("array<string>"))
    return each.select(*keys, "path", F.upper("method").alias("method"), F.coalesce(text("summary"), text("operationId"), F.lit("")).alias("name"), F.array_sort(asked).alias("security"))


def outlines(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Documents of one JSON object each as lines of path and value, in order of their paths; any other text as it is."""
    v = parsed(text)
    objects = rows.select(*keys, text, v.alias("_v"), members(v).isNotNull().alias("_object"))
    lines = leaves(objects.where("_object"), keys, "_v").groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), "path", F.lit(": "), "value"))), "\n").alias("_lines"))
    return objects.join(lines, keys, "left").select(*keys, F.when(F.col("_object"), F.coalesce("_lines", F.lit(""))).otherwise(T.text(text)).alias("text"))
