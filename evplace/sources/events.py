"""Event tables: columns found by name, batch and streaming sources, sensor size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names under which recordings keep each column, first match first.
ALIASES = {
    "t": ("t", "timestamp", "timestamps", "time", "times"),
    "x": ("x", "x_coordinate", "x_coordinates", "u", "col", "column"),
    "y": ("y", "y_coordinate", "y_coordinates", "v", "row"),
    "p": ("p", "polarity", "polarities", "pol", "polarity_bit", "polarity_bits"),
}


def find_column(schema: T.StructType, names: tuple[str, ...], path: tuple[str, ...] = ()) -> str | None:
    """The first of ``names`` (in any case) in a group, or in its subgroups, in order of their names, depth first."""
    here = {f.name.lower(): f.name for f in schema.fields if not isinstance(f.dataType, T.StructType)}
    for name in names:
        if name in here:
            return ".".join(f"`{x}`" for x in (*path, here[name]))
    groups = sorted((f for f in schema.fields if isinstance(f.dataType, T.StructType)), key=lambda f: f.name)
    return next((found for g in groups if (found := find_column(g.dataType, names, (*path, g.name)))), None)


def find_columns(schema: T.StructType) -> dict[str, str | None]:
    """The path of each column, looked up on its own: in the group ``events`` if there is one, else in the whole table."""
    group = next((f for f in schema.fields if f.name == "events" and isinstance(f.dataType, T.StructType)), None)
    root, path = (group.dataType, ("events",)) if group else (schema, ())
    return {role: find_column(root, names, path) for role, names in ALIASES.items()}


def resolve_event_columns(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """t, x, y (long), p (int) of a table whose columns go by any known name, in one group or several; ``keep`` names more columns to carry. No job runs."""
    found = find_columns(df.schema)
    missing = [role for role, path in found.items() if path is None]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)} in {df.columns}; known names are {[ALIASES[m] for m in missing]}")
    return df.select(*keep, *[F.col(found[c]).cast("int" if c == "p" else "long").alias(c) for c in "txyp"])


def read_events(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """A batch source in any format of Spark's readers, with event columns resolved."""
    reader = spark.read.format(fmt).options(**options)
    return resolve_event_columns((reader.schema(schema) if schema else reader).load(path), keep)


def stream_events(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files: int = 1, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """A streaming source over files that arrive in a folder, ``files`` in a micro-batch."""
    return resolve_event_columns(spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files).options(**options).load(path), keep)


def infer_resolution(ev: DataFrame, first_n: int | None = None) -> DataFrame:
    """One row: h, w. All events count, or the first ``first_n`` by time; no events give 0, 0."""
    if first_n is not None:
        ev = ev.orderBy("t").limit(first_n)
    return ev.agg(F.coalesce(F.max("y") + 1, F.lit(0)).cast("long").alias("h"), F.coalesce(F.max("x") + 1, F.lit(0)).cast("long").alias("w"))
