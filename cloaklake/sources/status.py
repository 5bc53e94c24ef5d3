"""Health and info as one-row DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .config import Config
from .languages import supported


def health(spark: SparkSession, config: Config, detector_ready: bool) -> DataFrame:
    """status healthy or degraded: degraded only if detection is enabled and its detector isn't ready."""
    ok = detector_ready or not config.pii_detection.enabled
    rows = [("healthy" if ok else "degraded", config.pii_detection.enabled, detector_ready)]
    return spark.createDataFrame(rows, "status string, pii_enabled boolean, detector_ready boolean")


def info(spark: SparkSession, config: Config) -> DataFrame:
    sets = supported(list(config.pii_detection.languages))
    rows = [(config.mode, sets["available"], sets["missing"], config.pii_detection.fallback_language, float(config.pii_detection.score_threshold), list(config.pii_detection.entities), config.secrets_detection.action, list(config.secrets_detection.entities), config.local.model if config.local else None)]
    return spark.createDataFrame(rows, "mode string, languages array<string>, missing_languages array<string>, fallback_language string, score_threshold double, entities array<string>, secrets_action string, secret_types array<string>, local_model string")


def providers(spark: SparkSession, config: Config, healthy: bool | None = None) -> DataFrame:
    """provider, role, type, base_url, model, healthy: where requests can go. healthy is what a probe of the local provider said
    (null: not asked); upstream providers aren't probed."""
    rows = [(p, "upstream", None, None, None, None) for p in ("openai", "anthropic")]
    if config.local:
        rows.append(("local", "local", config.local.type, config.local.base_url, config.local.model, healthy))
    return spark.createDataFrame(rows, "provider string, role string, type string, base_url string, model string, healthy boolean")
