import datetime

import pytest
from pyspark.sql import functions as F

from cloaklake.functions import language
from cloaklake.operators import audit, evaluate, policy
from cloaklake.sources import audit_log, config, fixtures, languages, requests, status


def ts(text):
    return datetime.datetime.fromisoformat(text)


def log(spark, rows):
    return audit_log.conform(spark.createDataFrame([(i, ts(t), p, d, e, n, c) for i, (t, p, d, e, n, c) in enumerate(rows)], "id long, timestamp timestamp, provider string, pii_detected int, entities string, scan_time_ms long, prompt_tokens long"))


NOW = "2024-01-31 12:00:00"
ROWS = [
    ("2024-01-31 11:00:00", "openai", 1, "PERSON, EMAIL_ADDRESS,", 10, 5), ("2024-01-31 10:59:59", "anthropic", 0, "", 11, None), ("2024-01-31 11:30:00", "local", 1, "PERSON", 10, 7),
    ("2024-01-01 00:00:00", "api", 0, None, 11, None), ("2024-01-31 11:30:00", "api", 0, " , ", 0, 1),
]


def test_stats_breakdown_and_pages(spark):
    df, now = log(spark, ROWS), F.lit(NOW).cast("timestamp")
    r = audit.stats(df, now).first().asDict()
    assert r == {"total_requests": 5, "pii_requests": 2, "pii_percentage": 40.0, "proxy_requests": 2, "local_requests": 1, "api_requests": 2, "avg_scan_time_ms": 8, "total_tokens": 13, "requests_last_hour": 3}
    assert [tuple(x) for x in audit.entity_stats(df).collect()] == [("PERSON", 2), ("EMAIL_ADDRESS", 1)]
    assert [x.id for x in audit.page(df, 2, 1).collect()] == [2, 0]
    assert tuple(audit.page_info(audit.page(df, 2, 4), 2, 4).first()) == (2, 4, 1)
    assert tuple(audit.provider_split(audit.stats(df, now)).first()) == (67, 33)
    assert [(x.entity, x.width) for x in audit.top_entities(audit.entity_stats(df)).collect()] == [("PERSON", 100.0), ("EMAIL_ADDRESS", 50.0)]
    with pytest.raises(ValueError):
        audit.page(df, 1001)
    empty = audit.stats(df.limit(0), now).first()
    assert (empty.total_requests, empty.pii_percentage, empty.avg_scan_time_ms, empty.total_tokens) == (0, 0.0, 0, 0)
    assert tuple(audit.provider_split(audit.stats(df.limit(0), now)).first()) == (50, 50)


def test_stats_read_the_log_once(spark):
    plan = audit.stats(log(spark, ROWS), F.lit(NOW).cast("timestamp"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1


def test_retention(spark, tmp_path):
    df, now = log(spark, ROWS), F.lit(NOW).cast("timestamp")
    stay, gone = audit_log.cleanup(df, 7, now)
    assert (stay.count(), gone.first().removed) == (4, 1)
    assert audit_log.cleanup(df, 0, now)[0].count() == 5
    path = str(tmp_path / "log")
    audit_log.append_log(df.limit(3), path)
    audit_log.append_batch(path)(df.filter("id >= 3"), 0)
    spark.createDataFrame([(99, ts("2024-01-30 00:00:00"), "2024-01-30")], "id long, timestamp timestamp, log_date string").write.mode("append").partitionBy("log_date").parquet(path)
    assert audit_log.read_log(spark, path).count() == 6 and audit_log.read_log(spark, path).columns == audit_log.LOG.names
    assert audit_log.drop_expired(spark, path, 7, NOW) == 1
    assert audit_log.drop_expired(spark, path, 1, "2024-02-01 11:15:00") == 3
    assert sorted(r.id for r in audit_log.read_log(spark, path).collect()) == [2, 4]
    assert audit_log.drop_expired(spark, path, 0, NOW) == 0


def test_a_batch_given_again_is_appended_once(spark, tmp_path):
    path = str(tmp_path / "log")
    df = log(spark, ROWS)
    append = audit_log.append_batch(path, "q")
    append(df.limit(2), 7)
    before = sorted(map(tuple, audit_log.read_log(spark, path).collect()), key=repr)
    append(df.limit(2), 7)
    assert sorted(map(tuple, audit_log.read_log(spark, path).collect()), key=repr) == before and len(before) == 2
    audit_log.append_log(df.limit(1), path, "stopped before its commit")
    assert audit_log.read_log(spark, path).count() == 2
    audit_log.append_log(df.limit(1), path)  # appended directly
    audit_log.append_batch(path, "other")(df.limit(2), 7)  # another query's batch of the same number
    assert audit_log.read_log(spark, path).count() == 5
    audit_log.drop_expired(spark, path, 1, "2024-02-01 11:15:00")
    left = audit_log.read_log(spark, path).count()
    append(df.limit(2), 7)
    assert audit_log.read_log(spark, path).count() == left


def test_a_stream_started_again_leaves_the_log_as_it_is(spark, tmp_path):
    """The query's checkpoint loses its last commit, as when it stops between the sink and that; the batch comes again."""
    path, state, source = str(tmp_path / "log"), tmp_path / "state", tmp_path / "in"
    source.mkdir()
    (source / "0.json").write_text('{"id":1,"timestamp":"2024-02-01 10:00:00"}\n{"id":2,"timestamp":"2024-02-01 11:00:00"}\n')

    def run():
        rows = spark.readStream.schema("id long, timestamp timestamp").json(str(source))
        q = rows.writeStream.foreachBatch(audit_log.append_batch(path, "q")).option("checkpointLocation", str(state)).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    (state / "commits" / "0").unlink()
    for crc in (state / "commits").glob(".*crc"):
        crc.unlink()
    run()
    assert sorted(r.id for r in audit_log.read_log(spark, path).collect()) == [1, 2]


def test_pages_by_cursor_equal_pages_by_offset(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(i, f"2024-01-{1 + (i * 7) % 20:02d} 0{i % 3}:00:00") for i in range(90)] + [(None, "2024-01-05 00:00:00"), (500, None)]
    audit_log.append_log(spark.createDataFrame(rows, "id long, timestamp string").withColumn("timestamp", F.col("timestamp").cast("timestamp")), path)
    whole = audit_log.read_log(spark, path).filter("id is not null and timestamp is not null")
    cursor, seen = None, 0
    while True:
        page, cursor = audit_log.page_after(spark, path, 7, cursor)
        assert [r.id for r in page.collect()] == [r.id for r in audit.page(whole, 7, seen).collect()]
        seen += page.count()
        if cursor is None:
            break
    assert seen == 90
    page, _ = audit_log.page_after(spark, path, 3, (ts("2024-01-10 02:00:00"), 10_000))
    assert len(page.inputFiles()) and all("log_date=2024-01-10" in f for f in page.inputFiles())


def test_a_stopped_cleanup_is_repaired(spark, tmp_path):
    path, day = tmp_path / "log", "log_date=2024-01-31"
    audit_log.append_log(log(spark, ROWS), str(path))
    (path / day).rename(path / "_old-2024-01-31")  # stopped after the day was set aside
    (path / "_rest-2024-01-31").mkdir()
    audit_log.repair(spark, str(path))
    assert audit_log.read_log(spark, str(path)).count() == 5 and not list(path.glob("_old-*")) and not list(path.glob("_rest-*"))
    (path / "_old-2024-01-31").mkdir()  # stopped before what was replaced was removed
    audit_log.repair(spark, str(path))
    assert audit_log.read_log(spark, str(path)).count() == 5 and not list(path.glob("_old-*"))


CONFIG = config.from_tree({"local": {"model": "l"}, "pii_detection": {"fallback_language": "de", "languages": "de, en"}})


def test_log_rows(spark):
    rows = [("openai", "", True, ["PERSON", "IP_ADDRESS"], "masked", False, []), ("api", "m", False, [], "masked", True, ["JWT_TOKEN"]), ("local", None, None, None, "", None, None)]
    df = spark.createDataFrame(rows, "provider string, model string, has_pii boolean, entity_types array<string>, masked_content string, secrets_detected boolean, secrets_types array<string>")
    got = {r.provider: r for r in audit_log.log_rows(df, CONFIG).collect()}
    a, b, c = got["openai"], got["api"], got["local"]
    assert (a.model, a.pii_detected, a.entities, a.masked_content, a.secrets_detected, a.secrets_types, a.language) == ("unknown", 1, "PERSON,IP_ADDRESS", "masked", 0, None, "de")
    assert (b.model, b.masked_content, b.secrets_detected, b.secrets_types) == ("m", None, 1, "JWT_TOKEN")
    assert (c.pii_detected, c.entities, c.masked_content, c.secrets_detected) == (0, "", None, None)
    quiet = config.from_tree({"local": {"model": "l"}, "logging": {"log_masked_content": False}, "secrets_detection": {"log_detected_types": False}})
    assert {(r.masked_content, r.secrets_types) for r in audit_log.log_rows(df, quiet).collect()} == {(None, None)}
    assert spark.range(1).select(audit_log.iso(F.lit("2024-01-02 03:04:05.678").cast("timestamp"))).first()[0] == "2024-01-02T03:04:05.678Z"


def test_config():
    c = config.from_tree({"mode": "mask", "pii_detection": {"score_threshold": "${T:-0.5}"}, "masking": {"whitelist": ["x"]}, "secrets_detection": {"max_scan_chars": "10"}}, {"T": ""})
    assert (c.pii_detection.score_threshold, c.secrets_detection.max_scan_chars, c.masking.whitelist) == (0.5, 10, (*config.WHITELIST, "x"))
    with pytest.warns(UserWarning):
        assert config.substitute("a${NONE}b", {}) == "ab"
    assert config.substitute_all([{"a": "${X}"}, 5], {"X": "y"}) == [{"a": "y"}, 5]
    for bad in ({}, {"mode": "mask", "secrets_detection": {"action": "route_local"}}, {"mode": "x"}, {"mode": "mask", "pii_detection": {"languages": ["xx"]}}, {"mode": "mask", "secrets_detection": {"entities": ["NO"]}}, {"mode": "mask", "pii_detection": {"score_threshold": 2}}, {"mode": "mask", "logging": {"retention_days": -1}}, {"mode": "mask", "logging": {"retention_days": 1.5}}):
        with pytest.raises(config.ConfigError):
            config.from_tree(bad)


def test_config_files(tmp_path):
    with pytest.raises(config.ConfigError):
        config.load_config(str(tmp_path))
    with pytest.raises(config.ConfigError):
        config.load_config(str(tmp_path / "none.yaml"))
    (tmp_path / "c.yaml").write_text("mode: route\nlocal:\n  model: ${M:-big}\n")
    assert config.load_config(str(tmp_path / "c.yaml")).local.model == "big"


def test_registry_health_and_info(spark):
    assert len(languages.REGISTRY) == 24 and languages.supported(["en", "xx"]) == {"available": ["en"], "missing": ["xx"]}
    setup = languages.recognizer_setup(["en", "de"])
    assert len(setup) == 6 and "context" in setup[2]["supported_languages"][0] and "context" not in setup[0]["supported_languages"][0]
    with pytest.raises(ValueError):
        languages.recognizer_setup(["xx"])
    assert languages.registry_table(spark).count() == 24
    models = languages.model_setup(["en", "nb"])
    assert [m["model_name"] for m in models["models"]] == ["en_core_web_lg", "nb_core_news_lg"] and models["low_score_labels"] == ["ORG"]
    assert languages.analyzer_setup(["en"]) == {"supported_languages": ["en"], "default_score_threshold": 0}
    assert [(r.provider, r.healthy) for r in status.providers(spark, CONFIG, True).collect()] == [("openai", None), ("anthropic", None), ("local", True)]
    assert status.health(spark, CONFIG, False).first().status == "degraded" and status.health(spark, CONFIG, True).first().status == "healthy"
    assert status.info(spark, CONFIG).first().languages == ["de", "en"]


def test_language(spark):
    texts = [("der Hund und die Katze", "de", False), ("og det er ikke på", "en", True), ("zzz", "en", True), ("", "en", True), (None, "en", True)]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(texts)], "i int, t string")
    got = df.orderBy("i").select(language.detect_language(df.t, ["de", "en"]).alias("l")).collect()
    assert [(r.l.language, r.l.used_fallback) for r in got] == [(x, y) for _, x, y in texts] and got[1].l.detected == "nb"
    r = df.limit(1).select(language.request_language(F.lit("en"), F.col("t"), ["en", "de"]).alias("a"), language.request_language(F.lit("fr"), F.lit("der die das"), ["en", "de"]).alias("b")).first()
    assert (r.a.language, r.b.language) == ("en", "de")


def test_decisions(spark):
    one = spark.range(1)
    types = F.array(F.lit("JWT_TOKEN"))
    none = F.array().cast("array<string>")
    out = one.select(policy.secret_outcome(types, "block").alias("b"), policy.secret_outcome(types, "mask").alias("m"), policy.secret_outcome(none, "block").alias("n"), policy.secret_outcome(types, "block", False).alias("d")).first()
    assert (out.b.blocked, out.b.blocked_types, out.m.masked, out.m.blocked, out.n.blocked, out.d.detected) == (True, "JWT_TOKEN", True, False, False, False)
    masking = config.from_tree({"mode": "mask"})
    r = one.select(policy.target(F.lit(True), F.lit(False), CONFIG).alias("a"), policy.target(F.lit(False), F.lit(True), CONFIG).alias("b"), policy.target(F.lit(True), F.lit(True), masking).alias("c")).first()
    assert tuple(r) == ("local", "upstream", "upstream")
    h = one.select(policy.headers("route", F.lit("local"), F.lit(True), F.lit("en"), F.lit(False), none, F.lit(False)).alias("h"), policy.blocked_headers(types).alias("b")).first()
    assert h.h == {"X-Guard-Mode": "route", "X-Guard-Provider": "local", "X-Guard-PII-Detected": "true", "X-Guard-Language": "en"} and h.b["X-Guard-Secrets-Types"] == "JWT_TOKEN"
    e = one.select(policy.error_message(F.lit('{"error":{"message":"no"}}')).alias("a"), policy.error_message(F.lit("y" * 501)).alias("b"), policy.provider_status(F.lit(None).cast("int")).alias("c"), audit.highlighted(F.lit("<a> & [[X_1]]")).alias("d")).first()
    assert (e.a, e.b, e.c, e.d) == ("no", "y" * 500 + "...", 502, "&lt;a&gt; &amp; <mark>[[X_1]]</mark>")


def test_forwarding(spark):
    df = requests.parsed(spark.createDataFrame([('{"model":"m","max_tokens":7,"messages":[]}', "local"), ('{"model":"m","max_completion_tokens":8}', "upstream")], "body string, target string"))
    got = [(r.limit_name, r["limit"], r.model) for r in requests.forwarded(df, "A", "small").collect()]
    assert got == [("max_completion_tokens", 7, "small"), ("max_completion_tokens", 8, "m")]


def test_evaluation(spark, tmp_path):
    (tmp_path / "en.yaml").write_text("test_cases:\n- {id: b, text: t, language: en, expected: [{type: P, text: ada}]}\n- {id: a, text: t, language: de, expected: []}\n")
    assert [r.id for r in fixtures.read_cases(spark, str(tmp_path)).collect()] == ["a", "b"]
    assert [r.id for r in fixtures.read_cases(spark, str(tmp_path), ["en"]).collect()] == ["b"]
    d = lambda t, x: (t, x, 0, len(x), 0.9)
    rows = [
        ("1", "en", [("P", " Ada "), ("P", "bob")], [d("P", "ADA L"), d("P", "Bob"), d("L", "Rome")]), ("2", "en", [("P", "ada"), ("P", "ada")], [d("P", "ada")]),
        ("3", "de", [], []), ("4", "de", [("E", "x@y")], [d("E", "x@y")]),
    ]
    df = spark.createDataFrame(rows, "id string, language string, expected array<struct<type:string,text:string>>, detected array<struct<type:string,text:string,start:int,end:int,score:double>>")
    v = evaluate.verdicts(df)
    m = {(r.scope, r.key): r for r in evaluate.metrics(v).collect()}
    whole = m["all", "all"]
    assert (whole.total, whole.passed, whole.failed, whole.tp, whole.fp, whole.fn) == (4, 2, 2, 4, 1, 1)
    assert (round(whole.precision, 3), round(whole.recall, 3), round(whole.f1, 3)) == (0.8, 0.8, 0.8)
    assert (m["type", "L"].precision, m["type", "L"].recall, m["type", "L"].f1, m["language", "de"].f1) == (0.0, 1.0, 0.0, 1.0)
    assert [(r.id, r.text) for r in evaluate.misses(v).collect()] == [("2", "ada")] and evaluate.misses(v, "FP").first().type == "L"
