"""Decisions by row: block, mask or route; response headers, errors, and what is logged of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.config import Config


def secret_outcome(types: Column, action: str, enabled: bool = True) -> Column:
    """struct(detected, blocked, blocked_reason, blocked_types, masked, route_local) from the types of a request's secrets."""
    found = F.lit(enabled) & (F.size(types) > 0)
    return F.struct(
        found.alias("detected"),
        (found & F.lit(action == "block")).alias("blocked"),
        F.when(found & F.lit(action == "block"), F.lit("secrets_detected")).alias("blocked_reason"),
        F.when(found & F.lit(action == "block"), F.array_join(types, ",")).alias("blocked_types"),
        (found & F.lit(action == "mask")).alias("masked"),
        (found & F.lit(action == "route_local")).alias("route_local"),
    )


def target(has_pii: Column, secrets_detected: Column, config: Config) -> Column:
    """local or upstream: in route mode, local if there is personal data, or a secret that is to stay local; else upstream."""
    local = has_pii | (secrets_detected & F.lit(config.secrets_detection.action == "route_local"))
    return F.when(F.lit(config.mode == "route") & F.coalesce(local, F.lit(False)), "local").otherwise("upstream")


def status_of(blocked: Column) -> Column:
    return F.when(blocked, 400).otherwise(200)


def headers(mode: str, provider: Column, has_pii: Column, language: Column, fallback: Column, secret_types: Column, masked: Column, prefix: str = "X-Guard") -> Column:
    """The response's header map, without those that don't apply."""
    yes = F.lit("true")
    found = F.size(secret_types) > 0
    rows = {
        "Mode": F.lit(mode),
        "Provider": provider,
        "PII-Detected": has_pii.cast("string"),
        "Language": language,
        "Language-Fallback": F.when(fallback, yes),
        "PII-Masked": F.when(has_pii & F.lit(mode == "mask"), yes),
        "Secrets-Detected": F.when(found, yes),
        "Secrets-Types": F.when(found, F.array_join(secret_types, ",")),
        "Secrets-Masked": F.when(masked, yes),
    }
    made = F.create_map(*[x for k, v in rows.items() for x in (F.lit(f"{prefix}-{k}"), v)])
    return F.map_filter(made, lambda _, v: v.isNotNull())


def blocked_headers(secret_types: Column, prefix: str = "X-Guard") -> Column:
    return F.create_map(F.lit(f"{prefix}-Secrets-Detected"), F.lit("true"), F.lit(f"{prefix}-Secrets-Types"), F.array_join(secret_types, ","))


def error_body(dialect: str, message: Column, kind: Column, code: Column | None = None) -> Column:
    """The error JSON of either dialect."""
    if dialect == "A":
        inner = F.struct(message.alias("message"), kind.alias("type"), F.lit(None).cast("string").alias("param"), (code if code is not None else F.lit(None).cast("string")).alias("code"))
        return F.to_json(F.struct(inner.alias("error")), {"ignoreNullFields": "false"})
    return F.to_json(F.struct(F.lit("error").alias("type"), F.struct(kind.alias("type"), message.alias("message")).alias("error")))


def error_message(body: Column, most: int = 500) -> Column:
    """What a provider says went wrong: error.message of a JSON body, else the body, cut after `most` characters."""
    cut = F.when(F.length(body) > most, F.concat(F.substring(body, 1, most), F.lit("..."))).otherwise(body)
    return F.coalesce(F.try_variant_get(F.try_parse_json(body), "$.error.message", "string"), cut)


def provider_status(status: Column) -> Column:
    """A provider's own status; 502 where it never answered."""
    return F.coalesce(status, F.lit(502))
