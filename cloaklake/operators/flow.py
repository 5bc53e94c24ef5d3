"""The whole way of a chat request: secrets, personal data, masking, and where it goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import placeholders
from ..functions.patterns import HIT, no_hits
from ..sources import requests as source
from ..sources.config import Config
from . import policy
from .detect import hits_in, language_in, resolved_pii, resolved_secrets, role_scanned, secret_hits
from .extract import KEYS, log_text, rebuilt, span_list

RESULT = (
    "status int, target string, blocked_types string, has_pii boolean, entity_types array<string>, language string, language_fallback boolean, detected_language string,"
    " secrets_detected boolean, secrets_types array<string>, pii map<string,string>, secrets map<string,string>"
)


def _types(hits: Column) -> Column:
    """Types of an array of hits for each span, in the order of their first hit."""
    return F.array_distinct(F.transform(F.flatten(hits), lambda h: h.entity_type))


def guard(requests: DataFrame, config: Config, dialect: str) -> DataFrame:
    """One row for each of the validated requests: request_id, status, target, body (what is passed on), blocked_types, has_pii,
    entity_types, language, language_fallback, detected_language, secrets_detected, secrets_types, masked_content (for the log,
    in mask mode), pii and secrets (maps that restore the response: personal data first, then secrets).

    Secrets come first: a request is blocked, masked, or kept local, as the action says. Personal data is looked for in what is
    left, and masked in mask mode. A blocked or invalid request has status 400, and neither target nor body.

    A request's spans are made in its row, without an exchange; all that follows are columns of that row, and bodies are rebuilt in one pass.
    """
    secrets, pii, action = config.secrets_detection, config.pii_detection, config.secrets_detection.action
    df = requests.select("request_id", "body", (F.size("errors") > 0).alias("_bad"), span_list(dialect).alias("_s"))
    own = lambda x: F.when(role_scanned(secrets.scan_roles, x.role), secret_hits(x.text, secrets)).otherwise(no_hits())
    df = df.withColumn("_s", F.transform("_s", lambda x: F.struct(*[x[k].alias(k) for k in (*KEYS, "role", "text")], own(x).alias("secrets"))))
    df = df.withColumn("secrets_types", F.coalesce(_types(F.transform("_s", lambda x: x.secrets)), F.array().cast("array<string>")))
    df = df.withColumn("_o", policy.secret_outcome(F.col("secrets_types"), action, secrets.enabled)).withColumn("status", policy.status_of(F.col("_bad") | F.col("_o.blocked")))
    df = df.withColumn("_s", F.coalesce(F.when(F.col("status") == 200, F.col("_s")), F.array().cast(df.schema["_s"].dataType)))

    empty = F.create_map().cast("map<string,string>")
    if secrets.enabled and action == "mask":
        df = placeholders.masked(df, F.transform("_s", lambda x: F.struct(x.text.alias("text"), resolved_secrets(x.secrets).alias("hits"))), "_secret")
        df = df.withColumns({"_t": F.col("_secret.texts"), "secrets": placeholders.mapping(F.col("_secret.context"))})
    else:
        df = df.withColumns({"_t": F.transform("_s", lambda x: F.coalesce(x.text, F.lit(""))), "secrets": empty})

    df = df.withColumn("_p", F.zip_with("_s", "_t", lambda x, t: F.struct(x.role.alias("role"), x.message_idx.alias("message_idx"), t.alias("text"))))
    df = df.withColumn("_l", language_in(F.col("_p"), pii)).withColumn("_h", hits_in(F.col("_p"), F.col("_l.language"), pii, config.masking.whitelist))
    df = df.withColumns({"entity_types": _types(F.col("_h")), "has_pii": F.exists("_h", lambda hs: F.size(hs) > 0), "_h": F.col("_h").cast(f"array<{HIT}>")})
    if config.mode == "mask":
        df = placeholders.masked(df, F.zip_with("_p", "_h", lambda x, hs: F.struct(x.text.alias("text"), resolved_pii(hs).alias("hits"))), "_pii")
        df = df.withColumns({"_t": F.col("_pii.texts"), "pii": placeholders.mapping(F.col("_pii.context"))})
    else:
        df = df.withColumn("pii", empty)

    changed = F.filter(F.zip_with("_s", "_t", lambda x, t: F.struct(*[x[k].alias(k) for k in KEYS], t.alias("text"), (x.text != t).alias("new"))), lambda x: x.new)
    result = {
        "status": F.col("status"), "target": F.when(F.col("status") == 200, policy.target(F.col("has_pii"), F.col("_o.detected"), config)), "blocked_types": F.col("_o.blocked_types"),
        "has_pii": F.col("has_pii"), "entity_types": F.col("entity_types"), "language": F.col("_l.language"), "language_fallback": F.col("_l.used_fallback"), "detected_language": F.col("_l.detected"),
        "secrets_detected": F.col("_o.detected"), "secrets_types": F.col("secrets_types"), "pii": F.col("pii"), "secrets": F.col("secrets"),
    }
    body = F.when(F.col("status") == 200, F.col("body")).alias("body")
    if config.mode != "mask" and not (secrets.enabled and action == "mask"):  # no text changes, so bodies pass as they are
        return df.select("request_id", body, F.lit(None).cast("string").alias("masked_content"), *[c.alias(n) for n, c in result.items()])
    rest = F.to_json(F.struct(*[c.alias(n) for n, c in result.items()]))  # what is found goes along as one string
    out = rebuilt(df.select("request_id", body, changed.alias("_spans"), rest.alias("_rest")), dialect, "_rest")
    if config.mode == "mask":
        out = log_text(source.parsed(out), dialect, "body", "_rest").withColumnRenamed("log_text", "masked_content")
    else:
        out = out.withColumn("masked_content", F.lit(None).cast("string"))
    out = out.withColumn("_rest", F.from_json("_rest", RESULT))
    return out.select("request_id", "body", "masked_content", "_rest.*")
