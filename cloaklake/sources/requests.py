"""Request sources: chat requests of two dialects as JSON, and plain texts. Bad requests become errors in a column, not exceptions.

Dialect A keeps all turns in messages; dialect B has a system text of its own, and blocks of several kinds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROLES = {"A": ["system", "developer", "user", "assistant", "tool", "function"], "B": ["user", "assistant"]}
ERROR = "array<struct<path:string,message:string>>"


def get(v: str, path: str, kind: str = "variant") -> Column:
    return F.expr(f"try_variant_get({v}, '{path}', '{kind}')")


def kind_of(v: Column | str) -> Column:
    """STRING, ARRAY, OBJECT, BIGINT ... of a variant, VOID for JSON null; null where there is none."""
    return F.regexp_extract(F.schema_of_variant(v), "^([A-Z]+)", 1)


def parsed(df: DataFrame, body: str = "body") -> DataFrame:
    """df with request (variant, null if body isn't JSON) and messages (array of variants, null if there is none)."""
    out = df.withColumn("request", F.try_parse_json(body))
    return out.withColumn("messages", get("request", "$.messages", "array<variant>"))


def _error(bad: Column, path: str, message: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(message).alias("message")))


def validated(df: DataFrame, dialect: str, body: str = "body") -> DataFrame:
    """Parsed requests with errors (path, message); a request is valid if that is empty."""
    df = parsed(df, body)
    count = F.coalesce(F.size("messages"), F.lit(0))
    role = lambda m: F.try_variant_get(m, "$.role", "string")
    checks = [
        _error(F.col("request").isNull(), "", "invalid JSON"),
        _error(F.col("request").isNotNull() & ((count < 1) | F.col("messages").isNull()), "messages", "a nonempty list is needed"),
        _error(F.exists("messages", lambda m: ~F.coalesce(role(m).isin(ROLES[dialect]), F.lit(False))), "messages.role", "unknown role"),
    ]
    if dialect == "B":
        checks += [
            _error(F.col("request").isNotNull() & get("request", "$.model", "string").isNull(), "model", "required"),
            _error(F.col("request").isNotNull() & get("request", "$.max_tokens", "double").isNull(), "max_tokens", "required"),
        ]
    return df.withColumn("errors", F.array_compact(F.array(*checks)))


def numbered(bodies: DataFrame, source: Column | None = None) -> DataFrame:
    """request_id and body of rows with a body: each row is a request of its own. The id is its source, if one is given, and a number that no
    other row has in one reading."""
    n = F.monotonically_increasing_id().cast("string")
    return bodies.select((F.concat(source, F.lit(":"), n) if source is not None else n).alias("request_id"), "body")


def read_requests(spark: SparkSession, path: str, dialect: str, id_path: str | None = None) -> DataFrame:
    """One JSON request a line: request_id, client_id, body, request, messages, errors.

    Each line is a request of its own, also where bodies are alike, as retries and common prompts are: request_id is the line's
    file and a number that no other line has in one reading (write the rows to keep it). client_id is what the request itself
    gives as its id, at id_path (such as '$.metadata.request_id'); a client may repeat it, so nothing is grouped by it.
    """
    lines = spark.read.text(path).select(F.col("value").alias("body"), F.col("_metadata.file_name").alias("file"))
    out = validated(numbered(lines, F.col("file")), dialect)
    return out.withColumn("client_id", get("request", id_path, "string") if id_path else F.lit(None).cast("string"))


def read_texts(df: DataFrame, body: str = "body") -> DataFrame:
    """Plain-text requests: text (trimmed), language, start_from, detect, and the status that they get (200 or 400)."""
    out = df.withColumn("request", F.try_parse_json(body))
    out = out.withColumns({
        "text": F.trim(get("request", "$.text", "string")),
        "given_language": get("request", "$.language", "string"),
        "start_from": get("request", "$.startFrom", "map<string,int>"),
        "detect": get("request", "$.detect", "array<string>"),
    })
    known = F.coalesce(F.forall("detect", lambda x: x.isin("pii", "secrets")), F.lit(True))
    bad = F.array_compact(F.array(
        _error(F.col("request").isNull(), "", "invalid JSON"),
        _error(F.col("request").isNotNull() & (kind_of(get("request", "$.text")) != "STRING"), "text", "must be a string"),
        _error(F.col("request").isNotNull() & (F.coalesce(F.col("text"), F.lit("")) == ""), "text", "required"),
        _error(~known, "detect", "must be of pii, secrets"),
    ))
    return out.withColumn("errors", bad).withColumn("status", F.when(F.size("errors") > 0, 400).otherwise(200))


def forwarded(df: DataFrame, dialect: str, local_model: str | None = None) -> DataFrame:
    """What is passed on: the token limit's name upstream (dialect A), and the model, which a local target replaces."""
    limit = F.coalesce(get("request", "$.max_completion_tokens", "long"), get("request", "$.max_tokens", "long"))
    model = get("request", "$.model", "string")
    return df.withColumns({
        "limit_name": F.when(limit.isNotNull(), F.lit("max_completion_tokens" if dialect == "A" else "max_tokens")),
        "limit": limit,
        "model": F.when(F.col("target") == "local", F.coalesce(F.lit(local_model), model)).otherwise(model) if "target" in df.columns else model,
    })
