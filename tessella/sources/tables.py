"""Tables from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.fields import VALUE

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def read(spark: SparkSession, path: str, format: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """Files of any format that Spark reads; JSON and CSV should come with their schema, or it costs a scan."""
    r = spark.read.format(format).options(**options)
    return (r.schema(schema) if schema else r).load(path)


def dynamic_from_json(lines: DataFrame, text: str = "value", key: str = "_id") -> DataFrame:
    """A dynamic table from JSON objects, one in each row of a text column; the key field names the record."""
    entries = lines.select(F.get_json_object(text, f"$.{key}").alias("_id"), F.variant_get(F.parse_json(F.col(text)), "$", "map<string,variant>").alias("m"))

    def value(x):
        kind = F.schema_of_variant(x)
        t = F.when(F.is_variant_null(x), "none").when(kind == "BOOLEAN", "bool").when(kind == "BIGINT", "int").when(kind.rlike("^(DOUBLE|DECIMAL|FLOAT)"), "float").when(kind == "STRING", "string").when(kind.startswith("ARRAY"), "array").otherwise("object")
        return F.struct(
            t.alias("t"), F.when(t == "bool", F.try_variant_get(x, "$", "boolean")).alias("b"), F.when(t == "int", F.try_variant_get(x, "$", "bigint")).alias("i"), F.when(t == "float", F.try_variant_get(x, "$", "double")).alias("f"),
            F.when(t == "string", F.try_variant_get(x, "$", "string")).when(t.isin("array", "object"), F.to_json(x)).alias("s"), F.when(t == "array", F.try_variant_get(x, "$", "array<double>")).alias("v"),
        )

    own = F.map_filter("m", lambda k, _: k != key)
    return entries.select("_id", F.transform_values(own, lambda _, x: value(x)).cast(f"map<string,{VALUE}>").alias("fields"))


def to_json_lines(df: DataFrame) -> DataFrame:
    """Typed rows as JSON objects; missing fields have no key."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value"))
