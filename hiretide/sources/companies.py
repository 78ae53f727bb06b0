"""The company dimension and the board settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hiretide.schemas import COMPANY_SCHEMA, SOURCE_CONFIG_SCHEMA


def with_defaults(dim: DataFrame) -> DataFrame:
    """Optional attributes filled in; other columns ride along."""
    none = F.array().cast("array<string>")
    return dim.withColumns({
        "scraper": F.coalesce("scraper", F.lit("custom")),
        "salary_range": F.coalesce("salary_range", F.lit("")),
        "top100": F.coalesce("top100", F.lit(False)),
        "titles": F.coalesce("titles", none),
        "stack": F.coalesce("stack", none),
        "locations": F.coalesce("locations", none),
    })


def read_companies(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return with_defaults(spark.read.schema(COMPANY_SCHEMA).format(fmt).load(path))


def read_source_config(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(SOURCE_CONFIG_SCHEMA).format(fmt).load(path)
