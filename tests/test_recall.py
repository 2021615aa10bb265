from pyspark.sql import functions as F

from noteloom.operators import recall
from noteloom.streaming import recall as stream

HITS = "session string, name string, category string, score double"


def test_pick(spark):
    hits = spark.createDataFrame([("s", "alpha", "f", 0.9), ("s", "alpha", "f", 0.8), ("s", "low", "f", 0.2), ("s", "other", None, 0.9), (None, "n", "f", 0.9)], HITS)
    none = hits.where("false")
    assert [(r.session, r.name) for r in recall.pick(hits, none, 0.5, ("f",)).collect() if r.session] == [("s", "alpha")]
    assert not [r for r in recall.pick(hits, hits, 0.5).collect() if r.session]


def events(spark):
    rows = [(1, "s", "commit", 0), (2, "s", "commit", 60), (3, "s", "commit", 1799), (4, "s", "commit", 1800), (5, "s", "push", 61), (6, "t", "commit", 61), (7, "s", "commit", 3601)]
    return spark.createDataFrame(rows, "event_id long, session string, kind string, t long").withColumn("ts", F.timestamp_seconds("t"))


WANT = {1: False, 2: True, 3: True, 4: False, 5: False, 6: False, 7: False}


def test_gates(spark):
    assert {r.event_id: r.passed for r in recall.gates(events(spark)).collect()} == WANT


def test_gate_stream_keeps_its_state(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = str(tmp_path / "in")
    plain = events(spark).select("event_id", "session", "kind", "ts")
    plain.where("event_id <= 3").coalesce(1).write.parquet(source)

    def drain():
        out = stream.gate_stream(spark.readStream.schema(plain.schema).parquet(source))
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    drain()
    plain.where("event_id > 3").coalesce(1).write.mode("append").parquet(source)
    drain()
    got = {r.event_id: bool(r.passed) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.event_id: r.passed for r in recall.gates(events(spark)).collect()}


def test_first_edits(spark):
    rows = [(1, "s", "/a/x.py", 5), (2, "s", "/a/x.py", 3), (3, "s", "/a/.git/x.py", 1), (4, "s", "/a/x.md", 1), (5, "t", "C:\\a\\x.py", 9)]
    df = spark.createDataFrame(rows, "event_id long, session string, path string, t long").withColumn("ts", F.timestamp_seconds("t"))
    assert sorted(r.event_id for r in recall.first_edits(df).collect()) == [2, 5]


def test_queries(spark):
    df = spark.createDataFrame([("/r/src/core/engine.py", "a  b\nc", "commit", ["/x/one.py", "/y/two.sql"], 'git commit -m "done it"')], "p string, c string, k string, f array<string>, m string")
    row = df.select(recall.edit_query(F.col("p"), F.col("c")), recall.bash_query(F.col("k"), F.col("f"), F.col("m"))).first()
    assert row[0] == "src core engine a b c" and row[1].endswith("one two done it") and row[1].startswith("commit")


def test_last_files_in_batch_and_as_a_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(i, "s" if i % 3 else "t", f"/a/f{i}.py", i) for i in range(12)]
    edits = spark.createDataFrame(rows, "event_id long, session string, path string, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    want = {r.event_id: r.files for r in recall.last_files(edits, 3).collect()}
    assert want[11] == ["/a/f8.py", "/a/f10.py", "/a/f11.py"] and want[0] == ["/a/f0.py"]
    source = str(tmp_path / "in")
    for part in (edits.where("event_id < 7"), edits.where("event_id >= 7")):
        part.coalesce(1).write.mode("append").parquet(source)
        out = stream.last_files_stream(spark.readStream.schema(edits.schema).parquet(source), 3)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert {r.event_id: list(r.files) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_snapshot_is_kept_for_its_time(spark):
    now, loads = [0.0], []

    def load():
        loads.append(now[0])
        if now[0] == 300:
            raise RuntimeError("gone")
        return spark.createDataFrame([(int(now[0]),)], "n int")

    held = stream.TimedSnapshot(load, 300, lambda: now[0])
    seen = []
    for now[0] in (0, 299, 300, 301, 599, 600):
        seen.append(held.get().first().n)
    assert seen == [0, 0, 0, 0, 0, 600] and loads == [0, 300, 600]


def test_moments(spark):
    import json

    from noteloom.operators import moments

    lines = [json.dumps(x) for x in (
        {"event_id": 1, "ts": "2024-01-01 00:00:00", "session_id": "s", "prompt": "a prompt of some length"},
        {"event_id": 2, "ts": "2024-01-01 00:00:01", "session_id": "s", "tool_input": {"file_path": "C:\\r\\src\\one.py", "new_string": "x"}},
        {"event_id": 3, "ts": "2024-01-01 00:00:02", "session_id": "s", "tool_input": {"file_path": "C:\\r\\src\\one.py", "new_string": "y"}},
        {"event_id": 4, "ts": "2024-01-01 00:00:03", "session_id": "s", "tool_input": {"command": "git push -m 'm'"}},
        {"event_id": 5, "ts": "2024-01-01 00:00:04", "session_id": "s", "tool_input": {"command": "git push"}},
        {"event_id": 6, "ts": "2024-01-01 00:00:05", "tool_input": {"command": "git commit"}},
        {"event_id": 7, "ts": "2024-01-01 00:00:06", "session_id": "s", "tool_input": {"file_path": "/a/readme.md"}},
    )] + ["", "garbage", "3", "{}"]
    got = {r.event_id: (r.session, r.moment, r.text) for r in moments.asked(moments.hook_events(spark.createDataFrame([(x,) for x in lines], "value string"))).collect()}
    assert set(got) == {1, 2, 4, 6}
    assert got[2] == ("s", "edit", "r src one x") and got[4][:2] == ("s", "push") and got[4][2].endswith(" one m") and got[6][0] == "unknown"


def test_rendered(spark):
    picked = spark.createDataFrame([("s", "b", 0.5, "x", "sec", "text", 2), ("s", "a", 0.75, "failures", None, None, 1)], "session string, name string, score double, category string, section string, snippet string, rank int")
    text = recall.rendered(picked, "head", ("failures",)).first().text
    assert text == "head\n1. [failure] **a** (score=0.75) §  — \n2. **b** (score=0.50) § sec — text"
