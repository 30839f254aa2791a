"""Readers and writers on files made here."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from larkspur.plans import reader_queries, source_queries
from larkspur.plans.registry import Tables
from larkspur.sources import readers, writers


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_markdown_files(spark, tmp_path):
    write(tmp_path / "MEMORY.md", "a")
    write(tmp_path / "memory/x.md", "é")
    write(tmp_path / "memory/y.txt", "no")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.size) for r in readers.markdown_files(spark, str(tmp_path)).collect()}
    assert got == {"MEMORY.md": ("a", 1), "x.md": ("é", 2)}


def test_transcripts(spark, tmp_path):
    m = lambda role, content: json.dumps({"type": "message", "message": {"role": role, "content": content}})
    rows = ['{"type":"session"}', '{"type":"custom"}', "", m("user", "Hello\n  world"), "not json", m("assistant", [{"type": "text", "text": "Hi there"}, {"type": "image"}]), m("user", "Tell me a joke"), m("system", "no")]
    write(tmp_path / "s.jsonl", "\n".join(rows))
    messages = readers.transcript(spark, str(tmp_path / "s.jsonl"))
    (entry,) = readers.session_entry(messages).collect()
    assert entry.content == "User: Hello world\nAssistant: Hi there\nUser: Tell me a joke"
    assert entry.line_map == [4, 6, 7]


def test_run_logs(spark, tmp_path):
    rows = [json.dumps({"ts": t, "jobId": j, "action": a, "model": model, "usage": {"input_tokens": 5}}) for t, j, a, model in ((1, "a", "finished", "m"), (2, "b", "finished", " "), (3, "a", "finished", "m"), (4, "a", "started", "m"), (5, " ", "finished", "m"))]
    write(tmp_path / "r.jsonl", "\n".join([*rows, "oops"]))
    runs = readers.run_log(spark, str(tmp_path / "r.jsonl"))
    assert [(r.ts, r.model) for r in runs.orderBy("ts").collect()] == [(1, "m"), (2, None), (3, "m")]
    assert [r.ts for r in readers.newest_runs(runs, 1).collect()] == [3]
    assert readers.newest_runs(runs, 9, "none").collect() == []


def test_log_lines_and_tail(spark):
    line = json.dumps({"0": "hello", "1": "world", "time": "T", "_meta": json.dumps({"logLevelName": "INFO", "name": json.dumps({"subsystem": "s"})})})
    rows = readers.log_lines(spark.createDataFrame([(line,), ("bad",)], "value string")).collect()
    assert (rows[0].message, rows[0].level, rows[0].subsystem, rows[0].time) == ("hello world", "info", "s", "T")
    assert rows[1].time is None and rows[1].raw == "bad"
    log = spark.createDataFrame([("aa\nbb\ncc\n",)], "text string")
    got = lambda *a: sorted(r.line for r in readers.tail(log, *a)[0].collect())
    assert got(3, 10, 100) == ["bb", "cc"] and got(0, 1, 100) == ["cc"]
    assert got(99, 10, 5) == ["cc"]  # beyond the end: the last 5 bytes, whose first line is cut off
    assert readers.tail(log, 0, 1, 100)[1] == 9


def test_lines_that_are_no_json_have_an_empty_message(spark):
    """Not a null one, which the catalog's test takes for the same."""
    rows = readers.log_lines(spark.createDataFrame([("boot",), ('{"time": "T"}',), (None,)], "value string")).collect()
    assert [(r.message, r.level, r.subsystem) for r in rows] == [("", None, None)] * 3
    rows = reader_queries.jsn2_log_lines(Tables(spark, "/root/testdata/sf0.001")).where("time is null").collect()
    assert rows and {r.message for r in rows} == {""}


def test_noisy_json(spark):
    assert readers.first_json_array('log [1] x [{"a": "]"}]') == "[1]"
    assert readers.first_json_array('x [{"a": "]\\""}, 2] y') == '[{"a": "]\\""}, 2]'
    assert readers.first_json_array("no [open") is None
    got = spark.createDataFrame([('junk [{"docid": "d", "score": 1}]',), ("no results",)], "raw string").select(readers.json_hits(F.col("raw")).alias("h")).collect()
    assert [len(r.h) for r in got] == [1, 0]


def test_repair_and_batches(spark):
    raw = spark.createDataFrame([("a", 1, '{"type":"session"}'), ("a", 2, "bad"), ("a", 3, '{"type":"message"}'), ("b", 1, '{"type":"message"}')], "path string, line int, value string")
    assert [(r.path, r.line) for r in readers.repaired(raw).orderBy("line").collect()] == [("a", 1), ("a", 3)]
    requests = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "custom_id string")
    outputs = spark.createDataFrame([("1", [0.5], None, 200), ("2", None, "limit", 200), ("3", None, None, 500)], "custom_id string, embedding array<double>, message string, status int")
    assert [r.error for r in readers.batch_output(requests, outputs).orderBy("custom_id").collect()] == [None, "limit", "status 500", "missing"]


def test_archive_and_back(spark, tmp_path):
    d = spark.sql("SELECT 'm1' id, 'text' content, timestamp'2026-02-01 00:00:00' ts UNION ALL SELECT 'm2', 'more', timestamp'2026-03-01 00:00:00'")
    writers.archive(d, str(tmp_path / "cold"))
    assert (tmp_path / "cold/year=2026/month=02").exists()
    back = writers.rehydrated(spark, str(tmp_path / "cold"), "id string, content string, ts timestamp, importance double")
    assert sorted((r.id, r.importance, r.intact) for r in back.collect()) == [("m1", 0.5, True), ("m2", 0.5, True)]


def test_csv(spark, tmp_path):
    d = spark.createDataFrame([(1, 'a "q", b', None)], "n int, s string, x string")
    writers.csv(d.coalesce(1), str(tmp_path / "c"))
    (part,) = (tmp_path / "c").glob("part-*")
    assert part.read_text() == 'n,s,x\n1,"a ""q"", b",\n'


def test_versions_survive_a_failed_rebuild(spark, tmp_path):
    first = writers.replaced(spark.range(3), str(tmp_path / "index"))
    try:
        writers.replaced(spark.range(3).selectExpr("raise_error('no') AS id"), str(tmp_path / "index"))
    except Exception:
        pass
    assert spark.read.parquet(first).count() == 3


def test_retention(spark):
    now = F.lit("2026-02-10 00:00:00")
    s = spark.sql("SELECT * FROM VALUES ('agent:a:cron:j:run:1', timestamp'2026-02-01 00:00:00', 's1'), ('agent:a:cron:j:run:2', timestamp'2026-02-01 00:00:00', 's2'), ('agent:a:main', timestamp'2026-02-01 00:00:00', 's2'), ('agent:a:cron:j:run:3', timestamp'2026-02-09 23:00:00', 's3') AS t(key, updated, session_id)")
    assert [r.session_id for r in writers.swept(s, now, 24).collect()] == ["s1"]
    assert {r.session_id for r in writers.fresh(s, "updated", now, 1).collect()} == {"s3"}


def test_overflow_summary(spark):
    d = spark.createDataFrame([("q", 1, "one"), ("q", 2, "two"), ("r", 1, "x")], "queue string, seq int, line string")
    got = {r.queue: r.summary for r in writers.overflow_summary(d, "queue", "seq", "message").collect()}
    assert got == {"q": "[Queue overflow] Dropped 2 messages due to cap.\n- one\n- two", "r": "[Queue overflow] Dropped 1 message due to cap.\n- x"}


def test_latest_log_and_batches(spark):
    files = spark.sql("SELECT * FROM VALUES ('a', timestamp'2026-01-01'), ('b', timestamp'2026-01-03'), ('c', timestamp'2026-01-02') AS t(path, mtime)")
    assert readers.latest_log(files) == "b"
    batches = readers.numbered_batches(spark.range(100).selectExpr("CAST(id AS STRING) AS id"), "id", 7)
    sizes = [r["count"] for r in batches.groupBy("batch").count().collect()]
    assert sum(sizes) == 100 and max(sizes) <= 7


def test_memory_files_of_a_workspace(spark, tmp_path):
    write(tmp_path / "MEMORY.md", "a")
    write(tmp_path / "other.md", "no")
    write(tmp_path / "memory/deep/x.md", "b")
    write(tmp_path / "memory/y.txt", "no")
    write(tmp_path / "extra/z.md", "c")
    (tmp_path / "memory/link.md").symlink_to(tmp_path / "other.md")
    names = lambda *extra: sorted(r.path.rsplit("/", 1)[1] for r in readers.memory_files(spark, str(tmp_path), extra).collect())
    assert names() == ["MEMORY.md", "x.md"]
    assert names("extra", "MEMORY.md", str(tmp_path / "other.md"), "missing") == ["MEMORY.md", "other.md", "x.md", "z.md"]
    assert readers.memory_files(spark, str(tmp_path / "nothing")).collect() == []


def test_session_files_and_repair(spark, tmp_path):
    write(tmp_path / "in/s.jsonl", '{"type":"session"}\nbroken\n{"type":"message"}\n')
    write(tmp_path / "in/t.jsonl", '{"type":"message"}\n')
    write(tmp_path / "in/u.txt", "no")
    got = {r.path.rsplit("/", 1)[1]: r["size"] for r in readers.session_files(spark, str(tmp_path / "in")).collect()}
    assert got == {"s.jsonl": 45, "t.jsonl": 19}
    assert readers.repair(spark, str(tmp_path / "in/*.jsonl"), str(tmp_path / "out")) == 2
    assert [r.value for r in spark.read.text(str(tmp_path / "out/file=s.jsonl")).collect()] == ['{"type":"session"}', '{"type":"message"}']


def test_lines_of_files_in_several_splits(spark, tmp_path):
    write(tmp_path / "a.log", "".join(f"line {i}\n" if i % 5 else "\n" for i in range(1, 2001)))
    write(tmp_path / "b.log", "x\r\ny")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = readers.lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(r.value == f"line {r.line}" for r in rows if r.path.endswith("a.log")) and len(rows) == 1602
    assert sorted((r.line, r.value) for r in rows if r.path.endswith("b.log")) == [(1, "x"), (2, "y")]


def test_tail_of_a_file(spark, tmp_path):
    write(tmp_path / "l.log", "aa\nbb\ncc\n")
    got = lambda *a: readers.tail_file(spark, str(tmp_path / "l.log"), *a)
    assert got() == (["aa", "bb", "cc"], 9) and got(3) == (["bb", "cc"], 9) and got(0, 1) == (["cc"], 9)
    assert got(99, 10, 5) == (["cc"], 9) and got(9) == ([], 9)


def test_transcripts_are_redacted(spark, tmp_path):
    write(tmp_path / "s.jsonl", json.dumps({"type": "message", "message": {"role": "user", "content": "TOKEN=abcdef1234567890ghij"}}))
    assert [r.text for r in readers.transcript(spark, str(tmp_path / "s.jsonl")).collect()] == ["TOKEN=abcdef…ghij"]


def test_streams_of_transcripts(spark, tmp_path):
    write(tmp_path / "in/s.jsonl", "one\ntwo")
    out = readers.transcript_stream(spark, str(tmp_path / "in"))
    out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert sorted(r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["one", "two"]


def test_files_of_conversations_share_folders(spark, tmp_path):
    rows = [(c, i, "user", f"é {c} {i}") for c in range(600) for i in range(1 + c % 3)] + [(-7, i, "assistant", "x" * 50) for i in range(25_000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    path = Path(source_queries.transcripts(Tables(spark, str(tmp_path))).removeprefix("file://"))
    files = [p for p in path.rglob("*.*") if p.is_file()]
    assert {p.name for p in files} == {f"conv_id={c}.jsonl" for c in [-7, *range(600)]}
    assert len(list(path.iterdir())) <= 256
    assert len(next(p for p in files if "=-7." in p.name).read_text().splitlines()) == 25_000
    got = source_queries.R.queries["src4_transcripts"](spark, str(tmp_path))
    assert sorted(map(tuple, got.where("conv_id >= 0").collect())) == [(c, i + 1, "user") for c in range(600) for i in range(1 + c % 3)]
    assert sorted(r.line for r in got.where("conv_id = -7").collect()) == list(range(1, 25_001))


def test_files_by_where_a_file_was_written_before(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k long, value string").coalesce(1).sortWithinPartitions("k", "value")
    for _ in range(2):
        writers.files_by(rows, f"file://{tmp_path}/out")
    assert {p.name: p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()} == {"k=1.jsonl": "a\nb\n", "k=.jsonl": "c\n"}


def test_session_files_take_conversations_without_an_id(spark, tmp_path):
    spark.createDataFrame([(None, 0, "user", "a"), (-3, 0, "user", "b"), (5, 0, "user", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = source_queries.R.queries["src3_session_files"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, True), (-3, True), (5, True)], key=str)
