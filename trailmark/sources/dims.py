"""Dimension (seed) tables: CSV reader and the small inline fixtures used by tests and queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

COUNTRY_SCHEMA = "alpha_2 string, name string, region string"
LANGUAGE_SCHEMA = "lang_tag string, name string"
ISO_639_2T_SCHEMA = "iso_639_1_code string, iso_639_2t_code string, name string"
ISO_639_3_SCHEMA = "iso_639_3_code string, name string"


def read_seed_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A seed CSV with a header row.  Pass ``schema`` to skip inference on large seeds."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path)


def fixture_dims(spark: SparkSession) -> dict[str, DataFrame]:
    """Inline dimension rows (FIXTURES.md §4)."""
    return {
        "country": spark.createDataFrame(
            [("GB", "United Kingdom", "Europe"), ("US", "United States", "Americas"),
             ("FR", "France", "Europe")], COUNTRY_SCHEMA),
        "language": spark.createDataFrame(
            [("en-us", "English (US)"), ("fr", "French"), ("de", "German")], LANGUAGE_SCHEMA),
        "iso_639_2t": spark.createDataFrame(
            [("en", "eng", "English"), ("fr", "fra", "French")], ISO_639_2T_SCHEMA),
        "iso_639_3": spark.createDataFrame(
            [("gsw", "Swiss German"), ("gsw", "Alemannic")], ISO_639_3_SCHEMA),
    }
