"""Nested records as flat columns, from the schema alone: one projection, and one explode if a field repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accordant.functions import values as V
from accordant.functions.naming import ordered_columns

PREFERRED_REPEATED = "extracted_facts"


def flat_columns(name: str, col: Column, data_type: T.DataType) -> list[tuple[str, Column]]:
    """(name, column) pairs. Structs become their fields; lists a count and, of plain values, a joined text; else itself."""
    if isinstance(data_type, T.StructType):
        return [pair for f in data_type.fields for pair in flat_columns(f"{name}_{f.name}", col.getField(f.name), f.dataType)]
    if isinstance(data_type, T.ArrayType):
        out = [(f"{name}_count", F.when(col.isNotNull(), F.size(col)))]
        item = data_type.elementType
        if not isinstance(item, (T.StructType, T.ArrayType, T.MapType)):
            out.append((name, F.when(F.size(col) > 0, F.array_join(F.transform(col, lambda x: F.coalesce(V.text(x, item), F.lit("None"))), "|"))))
        return out
    if isinstance(data_type, T.MapType):
        return [(name, F.to_json(col))]
    return [(name, col)]


def repeated_fields(schema: T.StructType) -> list[str]:
    """Top-level lists of records."""
    return [f.name for f in schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]


def choose_repeated_field(df: DataFrame) -> str | None:
    """The preferred field if it is a list, else the list of records with the most items in all; the first one on a tie."""
    if any(f.name == PREFERRED_REPEATED and isinstance(f.dataType, T.ArrayType) for f in df.schema.fields):
        return PREFERRED_REPEATED
    names = repeated_fields(df.schema)
    if not names:
        return None
    sizes = df.agg(*[F.sum(F.greatest(F.size(F.col(f"`{n}`")), F.lit(0))).alias(n) for n in names]).first()
    best = max(names, key=lambda n: sizes[n] or 0)
    return best if sizes[best] else None


def flatten(df: DataFrame, repeated: str | None = None, first: list[str] | None = None) -> DataFrame:
    """One row for each item of the repeated field (one with nulls if it has none), record columns repeated; first: columns that come first."""
    pairs: dict[str, Column] = {}
    source = df
    if repeated:
        item_type = df.schema[repeated].dataType.elementType
        source = df.withColumn("_item", F.explode_outer(F.col(f"`{repeated}`")))
    for f in df.schema.fields:
        if f.name != repeated:
            pairs |= dict(flat_columns(f.name, F.col(f"`{f.name}`"), f.dataType))
    if repeated:
        if isinstance(item_type, T.StructType):
            for f in item_type.fields:
                pairs |= dict(flat_columns(f"fact_{f.name}", F.col("_item").getField(f.name), f.dataType))
        else:
            pairs[f"fact_{repeated.rstrip('s')}"] = F.col("_item")
    names = ordered_columns(list(pairs), first or [])
    return source.select(*[pairs[n].alias(n) for n in names])


def flatten_for_profile(df: DataFrame, first: list[str] | None = None) -> tuple[DataFrame, dict[str, str | None]]:
    repeated = choose_repeated_field(df)
    return flatten(df, repeated, first), {"flatten_mode": "exploded_repeated_items" if repeated else "record_level_fallback", "repeated_field": repeated}


def missing_markers(df: DataFrame, markers: list[str]) -> list[str]:
    """Expected top-level names that the records don't have, sorted."""
    return sorted(set(markers) - set(df.columns))
