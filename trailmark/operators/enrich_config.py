"""Enrichment configurations from a directory, and the step that each names.

A configuration is one JSON file, ``{"schema": ..., "data": {"name", "enabled",
"parameters"}}``.  ``read_configs`` loads a folder by name, ``put_config``
replaces one, and ``run`` applies the enabled ones in the fixed order of
``enrich.event_pipeline``.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.operators import enrich as E
from trailmark.operators import lookups as L

# FIXED VALUES: configuration name -> step.
CONFIG_STEPS = {
    "campaign_attribution": "campaign_attribution",
    "event_fingerprint_config": "event_fingerprint",
    "referer_parser": "referer_parser",
    "cross_navigation_config": "cross_navigation",
    "cookie_extractor_config": "cookie_extractor",
    "http_header_extractor_config": "http_header_extractor",
    "currency_conversion_config": "currency_conversion",
    "ip_lookups": "ip_lookups",
    "iab_spiders_and_robots_enrichment": "iab_spiders_and_robots",
    "sql_query_enrichment_config": "sql_query",
    "anon_ip": "anon_ip",
    "javascript_script_config": "custom_script",
    "pii_enrichment_config": "pii_enrichment",
}
REFERER_FILE = "map<string, map<string, struct<domains: array<string>>>>"


@dataclass
class Resources:
    """What the steps look up beside their parameters; each is needed only where its step is enabled."""

    rates: DataFrame | None = None  # currency, rate_date, rate
    ip_ranges: DataFrame | None = None  # lo, hi and the columns of ``ip_outputs``
    ip_outputs: list[str] = field(default_factory=list)
    script: Callable | None = None  # pandas.DataFrame of ``script_inputs`` -> pandas.Series of text
    script_inputs: list[str] = field(default_factory=list)

    def need(self, name: str):
        value = getattr(self, name)
        if value is None or (isinstance(value, list) and not value):
            raise ValueError(f"an enabled enrichment needs the resource {name}")
        return value


def read_configs(spark: SparkSession, folder: str) -> dict[str, dict]:
    """``data`` objects by name; of several files with one name the last in order of file name counts."""
    files = spark.read.text(f"{folder.rstrip('/')}/*.json", wholetext=True).select(
        F.input_file_name().alias("file"), "value").collect()  # configurations: a few kilobytes each
    out = {}
    for r in sorted(files, key=lambda r: r["file"]):
        data = json.loads(r["value"])["data"]
        out[data["name"]] = data
    return out


def put_config(configs: dict[str, dict], config: dict) -> dict[str, dict]:
    """``configs`` with one more, which replaces that of the same name."""
    return {**configs, config["data"]["name"]: config["data"]}


def read_referers(spark: SparkSession, path: str) -> DataFrame:
    """(host, medium, source) of a referer database: JSON medium -> source -> domains."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", REFERER_FILE).alias("m"))
    by_medium = text.select(F.explode("m").alias("medium", "sources"))
    by_source = by_medium.select("medium", F.explode("sources").alias("source", "s"))
    return by_source.select(F.explode("s.domains").alias("host"), "medium", "source")


def _path(conf: dict) -> str:
    return f"{conf['uri'].rstrip('/')}/{conf['database']}"


def iab_lists(spark: SparkSession, params: dict) -> dict[str, DataFrame]:
    """The robot lists that a configuration names by folder and file."""
    return {"exclude": L.read_iab_list(spark, _path(params["excludeUseragentFile"]), "exclude"),
            "include": L.read_iab_list(spark, _path(params["includeUseragentFile"]), "include"),
            "cidr": L.read_cidr_list(spark, _path(params["ipFile"]))}


def script_column(df: DataFrame, fn: Callable, inputs: list[str], out: str = "script_context") -> DataFrame:
    """User code over Arrow batches of ``inputs`` only; its text becomes one more column."""
    def run(pdf: pd.DataFrame) -> pd.Series:
        return fn(pdf)

    # the types themselves: annotations are text here
    run.__annotations__ = {"pdf": pd.DataFrame, "return": pd.Series}
    return df.withColumn(out, F.pandas_udf(run, "string")(F.struct(*inputs)))


def steps(spark: SparkSession, resources: Resources) -> dict[str, Callable]:
    """``fn(df, parameters) -> df`` of every step."""
    return {
        "campaign_attribution": E.campaign_attribution,
        "event_fingerprint": E.event_fingerprint,
        "referer_parser": lambda df, p: E.referer_parser(df, read_referers(spark, _path(p)), p),
        "cross_navigation": E.cross_navigation,
        "cookie_extractor": E.cookie_extractor,
        "http_header_extractor": E.http_header_extractor,
        "currency_conversion": lambda df, p: L.currency_conversion(df, resources.need("rates"), p),
        "ip_lookups": lambda df, p: L.ip_range_lookup(df, resources.need("ip_ranges"), resources.need("ip_outputs")),
        "iab_spiders_and_robots": lambda df, p: L.iab_spiders_robots(df, iab_lists(spark, p)),
        "sql_query": L.sql_query_enrichment,
        "anon_ip": E.anon_ip,
        "custom_script": lambda df, p: script_column(df, resources.need("script"), resources.need("script_inputs")),
        "pii_enrichment": E.pii_pseudonymize,
    }


def run(df: DataFrame, configs: dict[str, dict], resources: Resources | None = None) -> DataFrame:
    """The enabled enrichments of ``configs`` applied to ``df``; one of an unknown name must be registered, or raises."""
    named = {CONFIG_STEPS.get(name, name): conf for name, conf in configs.items()}
    return E.event_pipeline(df, named, steps(df.sparkSession, resources or Resources()))
