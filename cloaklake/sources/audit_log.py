"""The audit log: its schema, rows from outcomes, appending, reading whatever columns older files lack, and retention."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.config import Config

LOG = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("mode", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("pii_detected", T.IntegerType()),
        T.StructField("entities", T.StringType()),
        T.StructField("latency_ms", T.LongType()),
        T.StructField("scan_time_ms", T.LongType()),
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("language_fallback", T.IntegerType()),
        T.StructField("detected_language", T.StringType()),
        T.StructField("masked_content", T.StringType()),
        T.StructField("secrets_detected", T.IntegerType()),
        T.StructField("secrets_types", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("error_message", T.StringType()),
    ]
)


def iso(ts: Column) -> Column:
    """A timestamp as ISO 8601 in UTC with milliseconds (sessions run in UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def conform(df: DataFrame) -> DataFrame:
    """All columns of the log in order; those that df lacks are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in LOG.fields])


def log_rows(outcomes: DataFrame, config: Config) -> DataFrame:
    """Log rows of request outcomes. Any of these columns may be absent or null: id, timestamp, provider, model, has_pii,
    entity_types (array), latency_ms, scan_time_ms, language, language_fallback, detected_language, masked_content,
    secrets_detected (boolean), secrets_types (array), status_code, error_message, user_agent, created_at.

    A masked content is kept only if it isn't empty, no secret was found, and the configuration says so.
    """
    have = set(outcomes.columns)
    col = lambda c, kind: F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
    flag = lambda c: F.when(col(c, "boolean").isNotNull(), col(c, "boolean").cast("int"))
    packed = lambda c: F.array_join(F.coalesce(col(c, "array<string>"), F.array().cast("array<string>")), ",")
    found = F.coalesce(col("secrets_detected", "boolean"), F.lit(False))
    content = F.when(F.lit(config.logging.log_masked_content) & ~found & (col("masked_content", "string") != ""), col("masked_content", "string"))
    types = F.when(F.lit(config.secrets_detection.log_detected_types) & (packed("secrets_types") != ""), packed("secrets_types"))
    out = outcomes.select(
        col("id", "long").alias("id"), col("timestamp", "timestamp").alias("timestamp"), F.lit(config.mode).alias("mode"), col("provider", "string").alias("provider"),
        F.coalesce(F.nullif(col("model", "string"), F.lit("")), F.lit("unknown")).alias("model"),
        F.coalesce(flag("has_pii"), F.lit(0)).alias("pii_detected"), packed("entity_types").alias("entities"),
        F.coalesce(col("latency_ms", "long"), F.lit(0)).alias("latency_ms"), F.coalesce(col("scan_time_ms", "long"), F.lit(0)).alias("scan_time_ms"),
        col("prompt_tokens", "long").alias("prompt_tokens"), col("completion_tokens", "long").alias("completion_tokens"), col("user_agent", "string").alias("user_agent"),
        F.coalesce(col("language", "string"), F.lit(config.pii_detection.fallback_language)).alias("language"),
        F.coalesce(flag("language_fallback"), F.lit(0)).alias("language_fallback"), col("detected_language", "string").alias("detected_language"),
        content.alias("masked_content"), flag("secrets_detected").alias("secrets_detected"), types.alias("secrets_types"),
        F.coalesce(col("created_at", "timestamp"), col("timestamp", "timestamp")).alias("created_at"), col("status_code", "int").alias("status_code"), col("error_message", "string").alias("error_message"),
    )
    return conform(out)


#: Names the attempt that wrote a row; null for rows appended directly. Of the attempts of a batch at most one is committed.
ATTEMPT = "attempt"


def commits_of(path: str) -> str:
    """The folder of commit records, beside the log's."""
    return path.rstrip("/") + "-commits"


def append_log(rows: DataFrame, path: str, attempt: str | None = None) -> None:
    """Append rows, in folders by day, so that retention and recent statistics touch few of them."""
    out = conform(rows).withColumns({ATTEMPT: F.lit(attempt).cast("string"), "log_date": F.to_date("timestamp")})
    out.write.mode("append").partitionBy("log_date").parquet(path)


def append_batch(path: str, query: str = "log"):
    """For foreachBatch: appends a micro-batch once, however often it is given.

    The rows carry a name of this attempt, and a record of (query, batch id) that names the attempt commits them: made in one step,
    after the rows, and never
    replaced. Readers leave out what isn't committed, so neither a batch that is given again (after a
    restart from the query's checkpoint) nor one that was stopped midway is seen twice or in part. Queries that write to one log
    need names of their own.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        jvm, record = spark.sparkContext._jvm, f"{commits_of(path)}/{query}/{batch_id}"
        at = jvm.org.apache.hadoop.fs.Path(record)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(at):
            return
        attempt = uuid.uuid4().hex
        append_log(batch, path, attempt)
        draft = jvm.org.apache.hadoop.fs.Path(f"{commits_of(path)}/.{query}-{batch_id}-{attempt}")
        stream = fs.create(draft)
        stream.write(bytearray(attempt.encode()))
        stream.close()
        fs.mkdirs(at.getParent())
        fs.rename(draft, at)  # whole or not at all
        spark.catalog.refreshByPath(path)

    return append


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the log with log_date, but those of attempts that weren't committed."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    if ATTEMPT not in rows.columns:
        return rows
    records = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(commits_of(path))
    if not records.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(records):
        return rows.filter(F.col(ATTEMPT).isNull())
    commits = spark.read.option("recursiveFileLookup", "true").schema("value string").text(commits_of(path)).select(F.col("value").alias("committed"))
    known = rows.filter(F.col(ATTEMPT).isNotNull()).join(commits, F.col(ATTEMPT) == F.col("committed"), "left_semi")
    return rows.filter(F.col(ATTEMPT).isNull()).unionByName(known)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return conform(_raw(spark, path))


def days_of(spark: SparkSession, path: str) -> list[str]:
    """The days that a log has folders for, latest first."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/log_date=*")
    found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(folder) or []
    return sorted((f.getPath().getName().removeprefix("log_date=") for f in found), reverse=True)


def page_after(spark: SparkSession, path: str, limit: int = 100, cursor: tuple | None = None) -> tuple[DataFrame, tuple | None]:
    """The page of `limit` rows that follow the cursor (timestamp, id), latest first, and the next cursor; None at the log's end.

    Rows stand by timestamp, then id, both descending; a row without either can't be a cursor and isn't paged. The
    walk begins at the cursor's day, and reads no further back than it has to: one day's folder, then twice as many as before, until the page is full. A page costs what its
    days hold, wherever it lies, while an offset costs all rows before it.
    """
    known = [d for d in days_of(spark, path) if d != "__HIVE_DEFAULT_PARTITION__"]
    if cursor is not None:
        first = spark.range(1).select(F.to_date(F.lit(cursor[0]).cast("timestamp")).cast("string").alias("d")).first().d
        known = [d for d in known if d <= first]
    before = F.lit(True) if cursor is None else F.struct("timestamp", "id") < F.struct(F.lit(cursor[0]).cast("timestamp").alias("timestamp"), F.lit(cursor[1]).cast("long").alias("id"))
    taken = 0
    while True:
        taken = min(len(known), max(1, 2 * taken))
        rows = _raw(spark, path).filter(F.col("log_date").isin([datetime.date.fromisoformat(d) for d in known[:taken]])).filter(before & F.col("timestamp").isNotNull() & F.col("id").isNotNull())
        page = conform(rows).orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)
        found = page.select("timestamp", "id").collect()  # at most `limit` rows of two values
        if len(found) == limit or taken == len(known):
            break
    return page, (found[-1].timestamp, found[-1].id) if len(found) == limit and limit else None


def expired(log: DataFrame, retention_days: int, as_of: Column) -> Column:
    """Whether a row is older than the retention; 0 days keep all."""
    return F.lit(False) if retention_days <= 0 else F.col("timestamp") < as_of - F.make_dt_interval(F.lit(retention_days))


def cleanup(log: DataFrame, retention_days: int, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and one row: how many go."""
    gone = F.coalesce(expired(log, retention_days, as_of), F.lit(False))
    return log.filter(~gone), log.agg(F.count_if(gone).alias("removed"))


def repair(spark: SparkSession, path: str) -> None:
    """Put back a day that drop_expired() had set aside when it was stopped; what it has replaced already is removed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    for found in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/_old-*")) or []:
        day = jvm.org.apache.hadoop.fs.Path(f"{path}/log_date={found.getPath().getName().removeprefix('_old-')}")
        fs.delete(found.getPath(), True) if fs.exists(day) else fs.rename(found.getPath(), day)
    for rest in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/_rest-*")) or []:
        fs.delete(rest.getPath(), True)


def drop_expired(spark: SparkSession, path: str, retention_days: int, as_of: str) -> int:
    """Remove expired rows from a log folder, day by day: whole days as folders, the day of the limit by rewriting it. Returns their number."""
    if retention_days <= 0:
        return 0
    repair(spark, path)
    log = _raw(spark, path)
    limit = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(retention_days))
    old = log.filter((F.col("timestamp") < limit) & (F.col("log_date") <= F.to_date(limit)))
    days = [(r.log_date, r.n) for r in old.groupBy("log_date").agg(F.count("*").alias("n")).collect()]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    edge = spark.range(1).select(F.to_date(limit).alias("d")).first().d
    for day, _ in days:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/log_date={day}")
        fs = folder.getFileSystem(conf)
        if day == edge:
            stay = log.filter((F.col("log_date") == F.lit(day)) & (F.col("timestamp") >= limit)).drop("log_date")
            aside, old_day = f"{path}/_rest-{day}", f"{path}/_old-{day}"
            stay.write.mode("overwrite").parquet(aside)
            # the old day stays, under another name, until the new one is in place; repair() finishes what a crash leaves
            fs.rename(folder, jvm.org.apache.hadoop.fs.Path(old_day))
            fs.rename(jvm.org.apache.hadoop.fs.Path(aside), folder)
            fs.delete(jvm.org.apache.hadoop.fs.Path(old_day), True)
        else:
            fs.delete(folder, True)
    spark.catalog.refreshByPath(path)
    return sum(n for _, n in days)
