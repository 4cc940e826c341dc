"""All registered queries of the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomledger.operators import urls
from loomledger.sources.tables import url_records


def _modules() -> list:
    from loomledger.plans import admission_queries, derived_queries, layout_queries, page_queries, recon_queries, source_queries, stats_queries, text_queries, url_queries

    return [url_queries, text_queries, stats_queries, recon_queries, page_queries, derived_queries, admission_queries, layout_queries, source_queries]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical addresses, merged, with their kinds, counted by domain."""
    merged = urls.first_wins(urls.canonicalize(url_records(spark, sf_dir)).where("reject is null"), "canonical_url", "line")
    kinds = urls.classify_kind(merged, "canonical_url")
    counted = kinds.groupBy("domain").agg(F.count(F.lit(1)).alias("urls"), *(F.count_if(F.col("kind") == k).alias(k) for k in ("listing", "detail", "sitemap", "unknown")))
    return counted.orderBy(F.desc("urls"), "domain")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for module in _modules() for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in module.ORACLE.items()}
