"""Nested JSON as VARIANT: a path that holds a list, an object or nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flattened(df: DataFrame, doc: str, path: str) -> DataFrame:
    """Rows with ``item``, one for each object of the list at the path, or for the object there, and ``listed``, whether it is a list.

    Elements that aren't objects are passed over. A text that isn't JSON, a missing path, another value at it and a list without objects give one row
    with a null item, so that no document is lost.
    """
    at = F.try_variant_get(F.try_parse_json(doc), path, "variant")
    kind = lambda v: F.schema_of_variant(v)
    many = F.try_variant_get(at, "$", "array<variant>")
    objects = F.filter(many, lambda v: F.startswith(kind(v), F.lit("OBJECT")))
    one = F.when(F.startswith(kind(at), F.lit("OBJECT")), F.array(at))
    return df.withColumn("items_", F.coalesce(objects, one)).select("*", F.explode_outer("items_").alias("item"), F.coalesce(F.col("items_").isNotNull() & many.isNotNull(), F.lit(False)).alias("listed")).drop("items_")


def field(name: str, kind: str) -> Column:
    """A field of the item, null where it is missing or of another kind."""
    return F.try_variant_get("item", f"$.{name}", kind)


def number(name: str) -> Column:
    """A field as a number, whether it is one or a text of one; null where it is neither."""
    text = F.trim(field(name, "string"))
    return F.when(F.regexp_like(text, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), text.try_cast("double"))


def first_positive(*names: str) -> Column:
    """The first field that is a number and not 0; the last one whatever it is."""
    return F.coalesce(*[F.when(number(n) != 0, number(n)) for n in names[:-1]], number(names[-1]))
