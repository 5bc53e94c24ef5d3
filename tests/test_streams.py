import json
import os
import random
import time

import pytest

from cloaklake.functions import placeholders
from cloaklake.sources import sse
from cloaklake.streaming import unmask

PII = {"[[PERSON_1]]": "Ada", "[[PERSON_11]]": "Bob $1", "[[EMAIL_ADDRESS_1]]": "a@b.c"}
SECRETS = {"[[API_KEY_SK_1]]": "sk-secret"}
TEXT = "Hi [[PERSON_1]] and [[PERSON_11]], mail [[EMAIL_ADDRESS_1]] key [[API_KEY_SK_1]] [x] [[NOPE_1]] end [["
WANT = "Hi Ada and Bob $1, mail a@b.c key sk-secret [x] [[NOPE_1]] end [["


def chunks(text, rnd):
    cuts = sorted(rnd.sample(range(1, len(text)), rnd.randrange(1, 30)))
    return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]


def event(dialect, text):
    tree = {"choices": [{"index": 0, "delta": {"content": text}}]} if dialect == "A" else {"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": text}}
    return "data: " + json.dumps(tree)


def text_of(lines, dialect):
    out = ""
    for x in lines:
        if x.startswith("data: {"):
            t = json.loads(x[6:])
            out += t["choices"][0]["delta"].get("content", "") if dialect == "A" else t.get("delta", {}).get("text", "")
    return out


@pytest.mark.parametrize("dialect", ["A", "B"])
def test_any_split_gives_the_whole(dialect):
    rnd = random.Random(1)
    for _ in range(60):
        u, out = unmask.Unmasker(dialect, PII, SECRETS), []
        for c in chunks(TEXT, rnd):
            out += u.feed(event(dialect, c))
        end = "data: [DONE]" if dialect == "A" else 'data: {"type":"message_stop"}'
        out += u.feed(end)
        assert text_of(out, dialect) == WANT and out[-1] == end


@pytest.mark.parametrize("line", ["event: ping", "", "data: not json", 'data: {"choices":[{"delta":{"role":"assistant"}}]}', 'data: {"type":"ping"}', "data: 5", ": comment"])
def test_other_lines_pass(line):
    for d in ("A", "B"):
        assert unmask.Unmasker(d, PII, {}).feed(line) == [line]


def test_parts_are_apart_and_marked():
    u = unmask.Unmasker("A", PII, {}, marker="*")
    both = {"choices": [{"index": 0, "delta": {"content": "[[PERSON"}}, {"index": 1, "delta": {"content": "[[EMAIL_ADDRESS_1]]"}}]}
    first = json.loads(u.feed("data: " + json.dumps(both))[0][6:])
    assert [c["delta"]["content"] for c in first["choices"]] == ["", "*a@b.c"]
    assert text_of(u.feed(event("A", "_1]]!")), "A") == "*Ada!"


@pytest.mark.parametrize(("text", "want"), [("Hello [[PERSON", 6), ("Hello", -1), ("[[A_1]] x", -1), ("[[A_1]] [[", 8), ("a [b", -1), ("", -1)])
def test_partial_start(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(placeholders.partial_start(df.t)).first()[0] == want


def test_stream_equals_batch(spark, tmp_path):
    rnd, rows = random.Random(3), []
    for s in range(4):
        for i, c in enumerate([*chunks(TEXT, rnd), None]):
            rows.append((f"s{s}", i, event("A", c) if c is not None else "data: [DONE]"))
    contexts = spark.createDataFrame([(f"s{s}", k, p, v) for s in range(4) for k, m in (("pii", PII), ("secret", SECRETS)) for p, v in m.items()], "stream_id string, kind string, placeholder string, value string")
    batch = unmask.unmask_batch(unmask.with_contexts(spark.createDataFrame(rows, "stream_id string, seq long, line string"), contexts), "A")
    got = {}
    for r in batch.orderBy("stream_id", "seq", "part").collect():
        got.setdefault(r.stream_id, []).append(r.line)
    assert all(text_of(x, "A") == WANT for x in got.values()) and len(got) == 4
    (tmp_path / "in").mkdir()
    for n in range(3):
        with open(tmp_path / "in" / f"{n}.json", "w") as f:
            f.writelines(json.dumps({"stream_id": s, "seq": i, "line": x}) + "\n" for s, i, x in rows if min(2, i // 10) == n)
        os.utime(tmp_path / "in" / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))  # files are read in this order
    lines = spark.readStream.schema("stream_id string, seq long, line string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = unmask.unmask_stream(unmask.with_contexts(lines, contexts), "A").writeStream.format("memory").queryName("restored").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {}
    for r in spark.sql("select * from restored order by stream_id, seq, part").collect():
        got.setdefault(r.stream_id, []).append(r.line)
    assert all(text_of(x, "A") == WANT for x in got.values()) and len(got) == 4


def test_lines_as_columns(spark):
    rows = [("s", 0, event("A", "x")), ("s", 1, "data: [DONE]"), ("s", 2, "event: y")]
    df = sse.parsed(spark.createDataFrame(rows, "stream_id string, seq long, line string"))
    got = df.orderBy("seq").select(sse.delta_text("event", "A").alias("t"), "is_done", sse.framed(df.line, "A").alias("f")).collect()
    assert [r.t for r in got] == ["x", None, None] and [r.is_done for r in got] == [False, True, False]
    assert got[1].f == "data: [DONE]\n\n" and got[2].f == "event: y\n"


def test_raw_bodies_to_lines_and_back(spark, tmp_path):
    body = 'event: ping\ndata: {"choices":[{"index":0,"delta":{"content":"a"}}]}\n\ndata: {"choices":[{"index":0,"delta":{"content":"b [[PERSON_1]]"}}]}\n\ndata: [DONE]\n\n'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one").write_text(body)
    read = [r.line for r in sse.read_bodies(spark, str(tmp_path / "in"), streaming=False).orderBy("seq").collect()]
    assert read == [x for x in body.split("\n") if x]
    chunks = spark.createDataFrame([("one", i, body[a : a + 7]) for i, a in enumerate(range(0, len(body), 7))], "stream_id string, n int, chunk string")
    lines = sse.lines_of_chunks(chunks)
    assert [r.line for r in lines.orderBy("seq").collect()] == read
    assert sse.bodies_of(lines, "A").first().body == body
    maps = spark.createDataFrame([("one", {"[[PERSON_1]]": "Ada"}, None)], "stream_id string, pii map<string,string>, secrets map<string,string>")
    assert unmask.restored_streams(lines.join(maps, "stream_id"), "A", "*").first().text == "ab *Ada"
    stream = sse.read_bodies(spark, str(tmp_path / "in"))
    q = sse.write_lines(stream, str(tmp_path / "out"), "A", str(tmp_path / "state"))
    q.processAllAvailable()
    q.stop()
    written = "".join(p.read_text() for p in sorted((tmp_path / "out" / "stream_id=one").glob("part-*")))
    assert written == body


def test_several_choices_are_restored_apart(spark):
    both = {"choices": [{"index": 0, "delta": {"content": "x [[PER"}}, {"index": 1, "delta": {"content": "y"}}]}
    more = {"choices": [{"index": 1, "delta": {"content": " [[PERSON_1]]"}}, {"index": 0, "delta": {"content": "SON_1]]"}}, {"delta": {"role": "assistant"}}]}
    rows = [("s", i, "data: " + json.dumps(x), PII, None) for i, x in enumerate((both, more))]
    got = unmask.restored_streams(spark.createDataFrame(rows, "stream_id string, seq long, line string, pii map<string,string>, secrets map<string,string>"), "A")
    assert [(r.part, r.text) for r in got.orderBy("part").collect()] == [(0, "x Ada"), (1, "y Ada")]


ODD = [5, None, "x", [], {}, [None, 3], {"index": "x"}, True, 1.5, "[[PERSON_1]]"]


@pytest.mark.parametrize("dialect", ["A", "B"])
def test_events_of_any_shape_pass(spark, dialect):
    """Every field in turn of every odd type: nothing fails, nothing but text events is changed, and the flush at the end works."""
    base = {"choices": [{"index": 0, "delta": {"content": "a [[PER"}, "finish_reason": None}], "type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": "a [[PER"}}
    paths = [("choices",), ("choices", 0), ("choices", 0, "index"), ("choices", 0, "delta"), ("choices", 0, "delta", "content"), ("choices", 0, "finish_reason"), ("type",), ("index",), ("delta",), ("delta", "type"), ("delta", "text")]
    lines = []
    for path in paths:
        for odd in ODD:
            tree = json.loads(json.dumps(base))
            at = tree
            for p in path[:-1]:
                at = at[p]
            at[path[-1]] = odd
            lines.append("data: " + json.dumps(tree))
    lines += ["data: " + json.dumps(x) for x in ODD] + ['data: {"type":"content_block_stop","index":null}', "data: " + "[" * 100_000, 'data: {"choices":[{"delta":{"content":"\\ud800"}}]}', None, ""]
    end = "data: [DONE]" if dialect == "A" else 'data: {"type":"message_stop"}'
    for line in lines:
        u = unmask.Unmasker(dialect, PII, SECRETS)
        out = u.feed(line) + u.feed(event(dialect, "SON_1]]")) + u.feed(end)
        assert out[-1] == end and all(x.encode() is not None for x in out)
    rows = [("s", i, x) for i, x in enumerate([*lines, end])]
    maps = spark.createDataFrame([("s", PII, SECRETS)], "stream_id string, pii map<string,string>, secrets map<string,string>")
    got = unmask.unmask_batch(spark.createDataFrame(rows, "stream_id string, seq long, line string").join(maps, "stream_id"), dialect)
    assert got.filter(got.line == end).count() == 1
    assert unmask.restored_streams(spark.createDataFrame(rows, "stream_id string, seq long, line string").join(maps, "stream_id"), dialect).count() > 0


@pytest.mark.parametrize("seed", range(4))
def test_any_split_of_crowded_brackets_gives_the_whole(seed):
    """Values without brackets, texts full of them: events cut anywhere give what restoring the whole text gives."""
    rnd = random.Random(seed)
    values = {"[[A_1]]": "B_1", "[[B_1]]": "bob", "[[C]]": "", "[[A_11]]": "x y"}
    for _ in range(150):
        text = "".join(rnd.choice(["[", "[[", "]", "]]", "A_1", "B_1", "C", "[[A_1]]", "[[C]]", "[[A_11]]", " ", "w"]) for _ in range(rnd.randint(2, 14)))
        if len(text) < 3:
            continue
        cuts = sorted(rnd.sample(range(1, len(text)), rnd.randrange(1, len(text))))
        u, out = unmask.Unmasker("A", values, {}), []
        for c in (text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)):
            out += u.feed(event("A", c))
        assert text_of(out + u.feed("data: [DONE]"), "A") == unmask.restore(text, values), (text, cuts)


def body_of(rnd):
    events = [event("A", c) for c in chunks(TEXT + " é日𝄞", rnd)]
    return rnd.choice(["\n\n", "\r\n\r\n"]).join([*events, ": comment é", "data: [DONE]", ""])


@pytest.mark.parametrize("seed", range(3))
def test_any_byte_split_gives_the_same_lines(spark, seed):
    rnd = random.Random(seed)
    bodies = [(f"s{i}", body_of(rnd)) for i in range(4)] + [("no end", "data: 1\nrest \U0001d11e"), ("empty", ""), ("breaks", "\n\r\n\n")]
    rows = []
    for name, body in bodies:
        raw = body.encode()
        cuts = sorted(rnd.sample(range(1, len(raw)), min(len(raw) - 1, 40))) if len(raw) > 1 else []
        rows += [(name, n, raw[a:b]) for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(raw)], strict=True))]
    rows += [rows[3], ("s0", 10_000, None)]
    rnd.shuffle(rows)
    got = sorted(map(tuple, sse.lines_of_chunks(spark.createDataFrame(rows, "stream_id string, n int, chunk binary").selectExpr("*", "1 AS Line")).collect()))
    want = sorted(map(tuple, sse.lines_of(spark.createDataFrame(bodies, "stream_id string, body string")).collect()))
    assert got == want
    assert sse.lines_of_chunks(spark.createDataFrame([], "stream_id string, n int, chunk binary")).collect() == []


def streamed(spark, tmp_path, rows, schema, start, name, files=4, wait=True):
    """What a stream gives of rows dealt out over micro-batches as they come."""
    source = tmp_path / name
    source.mkdir()
    for n in range(files):
        path = source / f"{n}.json"
        path.write_text("".join(json.dumps(dict(zip(schema, r, strict=True))) + "\n" for r in rows[n::files]))
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
    names = {"stream_id": "string", "seq": "long", "n": "long", "line": "string", "chunk": "string", "pii": "map<string,string>", "secrets": "map<string,string>"}
    given = spark.readStream.schema(", ".join(f"{c} {names[c]}" for c in schema)).option("maxFilesPerTrigger", 1).json(str(source))
    q = start(given).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-state")).outputMode("append").start()
    if wait:  # a query with timers always has another batch to do
        q.processAllAvailable()
    return q


def test_a_shuffled_stream_over_micro_batches_equals_the_batch(spark, tmp_path):
    """Lines out of order, some twice, dealt out over micro-batches: all that the batch gives, in its order."""
    rnd, rows = random.Random(5), []
    for s in range(3):
        lines = [event("A", c) for c in chunks(TEXT, rnd)] + ["data: [DONE]"]
        rows += [(f"s{s}", i, x, PII, SECRETS) for i, x in enumerate(lines)]
    schema = ("stream_id", "seq", "line", "pii", "secrets")
    batch = unmask.unmask_batch(spark.createDataFrame(rows, "stream_id string, seq long, line string, pii map<string,string>, secrets map<string,string>"), "A")
    want = sorted(map(tuple, batch.collect()))
    mixed = rows + rnd.sample(rows, 15)
    rnd.shuffle(mixed)
    q = streamed(spark, tmp_path, mixed, schema, lambda df: unmask.unmask_stream(df, "A"), "shuffled")
    q.stop()
    assert sorted(map(tuple, spark.sql("select stream_id, seq, part, line from shuffled").collect())) == want


def test_chunks_over_micro_batches_give_what_whole_bodies_give(spark, tmp_path):
    rnd, rows, bodies = random.Random(6), [], []
    for s in range(2):
        body = body_of(rnd)
        bodies.append((f"s{s}", body))
        cuts = sorted(rnd.sample(range(1, len(body)), 30))
        rows += [(f"s{s}", n, body[a:b], PII, SECRETS) for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(body)], strict=True))]
    maps = spark.createDataFrame([(f"s{s}", PII, SECRETS) for s in range(2)], "stream_id string, pii map<string,string>, secrets map<string,string>")
    batch = unmask.unmask_batch(sse.lines_of(spark.createDataFrame(bodies, "stream_id string, body string")).join(maps, "stream_id"), "A")
    want = sorted(map(tuple, batch.collect()))
    rnd.shuffle(rows)
    q = streamed(spark, tmp_path, rows, ("stream_id", "n", "chunk", "pii", "secrets"), lambda df: unmask.unmask_chunks(df, "A"), "chunked")
    q.stop()
    assert sorted(map(tuple, spark.sql("select stream_id, seq, part, line from chunked").collect())) == want


def test_silence_ends_a_stream_with_a_gap(spark, tmp_path):
    rows = [("s", i, event("A", t), PII, {}) for i, t in ((0, "a [[PER"), (2, "!"), (3, "end [["))]
    q = streamed(spark, tmp_path, rows, ("stream_id", "seq", "line", "pii", "secrets"), lambda df: unmask.unmask_stream(df, "A", silence="2 seconds"), "silent", 1, wait=False)
    for _ in range(40):
        if spark.sql("select * from silent").count() > 2:
            break
        time.sleep(1)
    q.stop()
    said = text_of([r.line for r in spark.sql("select * from silent order by seq, part").collect()], "A")
    assert said == "a [[PER!end [["
