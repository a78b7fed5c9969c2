"""Sources and sinks: edge lists, boundaries, strict JSON, parquet, no-overwrite output."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import must_be_empty, repeated

EDGE_SCHEMA = "source string, target string, edge_id string, time_s string, length_m string"
#: A positive integer or fraction p/q.
POSITIVE = r"^[1-9][0-9]*(/[1-9][0-9]*)?$"


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated edges; malformed lines, weights that are not positive and repeated ids are errors.

    Weights stay text (fractions beyond DECIMAL(38) occur).
    """
    rows = spark.read.option("sep", "\t").option("mode", "FAILFAST").csv(path, schema=EDGE_SCHEMA)
    wrong = ~F.coalesce(F.col("time_s").rlike(POSITIVE) & F.col("length_m").rlike(POSITIVE), F.lit(False))
    must_be_empty(rows.where(wrong), "weights must be positive")
    must_be_empty(repeated(rows, "edge_id"), "repeated edge ids")
    return rows


def write_edge_list(edges: DataFrame, path: str) -> None:
    """Tab-separated edges; refuses to overwrite."""
    edges.select("source", "target", "edge_id", "time_s", "length_m").write.option("sep", "\t").mode("errorifexists").csv(path)


STRICT = {"mode": "FAILFAST", "allowNonNumericNumbers": "false"}


def _closed(texts: DataFrame, names: list[str]) -> None:
    """Refuses JSON objects (value) with a key twice or one that isn't named."""
    keys = texts.select(F.json_object_keys("value").alias("k"))
    must_be_empty(keys.where(F.size("k") != F.size(F.array_distinct("k"))), "a key stands twice")
    must_be_empty(keys.select(F.explode("k").alias("k")).distinct().where(~F.col("k").isin(*names)), "fields outside the schema")


def read_strict_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a closed schema: malformed rows, NaN, keys that stand twice and fields that the schema lacks are errors."""
    rows = spark.read.options(**STRICT).schema(schema).json(path)
    _closed(spark.read.text(path), rows.columns)
    return rows


def read_pretty_array(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """Objects of the one array ``key`` of an indented JSON file, under a closed schema; any other layout is an error.

    The file is cut where an object opens, so that tasks read it in pieces and hold one object at a time.  The array
    holds at least one object.
    """
    pieces = spark.read.option("lineSep", "\n    {\n").text(path)
    head = F.col("value").rlike(r'(?s)^\{\n  "' + re.escape(key) + r'": \[$')
    inner, last = r"(?s)^((?:      [^\n]*\n)+)    \},$", r"(?s)^((?:      [^\n]*\n)+)    \}\n  \]\n\}\s*$"
    body = F.coalesce(*[F.nullif(F.regexp_extract("value", p, 1), F.lit("")) for p in (inner, last)])
    seen = pieces.agg(F.count_if(head).alias("heads"), F.count_if(F.col("value").rlike(last)).alias("lasts"), F.count_if(~head & body.isNull()).alias("others")).first()
    if tuple(seen) != (1, 1, 0):
        raise ValueError(f"not one indented array {key!r}: {seen}")
    texts = pieces.where(~head).select(F.concat(F.lit("{"), body, F.lit("}")).alias("value"))
    rows = texts.select(F.from_json("value", schema, STRICT).alias("r")).select("r.*")
    _closed(texts, rows.columns)
    return rows


def read_boundary(spark: SparkSession, path: str) -> DataFrame:
    """(ring, hole, seq, lon, lat) of a .poly file: sections end with END, holes start with '!'.

    A boundary file is small by nature; its lines are numbered as one text.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("seq", "line"))
    text = lines.withColumn("line", F.trim("line")).where("line <> ''")
    sections = text.selectExpr("seq", "line", "sum(CASE WHEN line = 'END' THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS ring")
    names = sections.where("line <> 'END' AND seq > 0").groupBy("ring").agg(F.min_by("line", "seq").startswith("!").alias("hole"))
    parts = F.split("line", r"\s+")
    # the first line names the file and the first line of a section the ring; all others are two numbers
    inside = sections.where("line <> 'END' AND seq > 0").join(sections.where("line <> 'END' AND seq > 0").groupBy("ring").agg(F.min("seq").alias("head")), "ring").where("seq > head")
    number = lambda k: F.try_element_at(parts, F.lit(k)).try_cast("double")
    must_be_empty(inside.where((F.size(parts) != 2) | number(1).isNull() | number(2).isNull()), "coordinate lines hold two numbers")
    coordinates = inside.drop("head")
    return coordinates.join(names, "ring").select("ring", "hole", "seq", parts[0].cast("double").alias("lon"), parts[1].cast("double").alias("lat"))


def write_parquet(df: DataFrame, path: str, **options: str) -> None:
    """Zstandard Parquet that refuses to overwrite."""
    df.write.mode("errorifexists").options(compression="zstd", **options).parquet(path)


def missing_roles(manifest: DataFrame, required: DataFrame) -> DataFrame:
    """Required roles that a manifest (role, path, bytes, sha256) lacks."""
    return required.join(manifest, "role", "left_anti")
