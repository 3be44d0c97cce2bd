"""Streaming forms give the batch result on the same rows."""

import json
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from tracegrain.operators import facts
from tracegrain.registry import streams
from tracegrain.sources import logs
from tracegrain.streaming import jobs


def drain(query):
    query.processAllAvailable()
    query.stop()


def test_projection_stream_equals_batch(spark, tmp_path):
    rows = [("s", i, i * 10, "goal.created" if i % 2 else "task.proposed", "ann", json.dumps({"title": f"g{i % 3}", "taskId": f"t{i}"}), "h") for i in range(1, 21)]
    schema = "session string, seq bigint, ts_us bigint, type string, actor string, payload string, hash string"
    for part in range(2):
        spark.createDataFrame(rows[part * 10:part * 10 + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.project_events(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = facts.versions(spark.read.parquet(str(tmp_path / "out")).drop("batch_id"))
    want = facts.versions(facts.entities(spark.createDataFrame(rows, schema)))
    key = lambda df: sorted((r["entity_type"], r["name"], r["valid_from"], r["valid_to"] or 0) for r in df.collect())
    assert key(got) == key(want)


def test_window_counts_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-01 0{i % 8}:00:00", "a" if i % 3 else "b", i) for i in range(30)]
    df = spark.createDataFrame(rows, "ts string, type string, cents bigint").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = jobs.windowed_counts(stream, "tumbling", "type", size="1 hour", watermark="1 hour").writeStream.outputMode("complete").format("memory").queryName("wc").start()
    drain(q)
    want = sorted(tuple(r) for r in jobs.windowed_counts(df, "tumbling", "type", size="1 hour").collect())
    assert sorted(tuple(r) for r in spark.sql("SELECT * FROM wc").collect()) == want


def test_verify_stream_waits_for_gaps_and_marks_late_rows(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    batch = spark.createDataFrame([("s", q, f"d{q}") for q in range(1, 7)], "session string, seq bigint, digest string")
    sealed = logs.seal(batch).withColumn("seal_ok", logs.link(F.col("prev_hash"), F.col("digest")) == F.col("hash")).drop("digest").cache()
    for i, want in enumerate(([1, 2, 4], [3, 5, 2])):
        sealed.filter(F.col("seq").isin(*want)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(sealed.schema).parquet(str(tmp_path / "in"))
        jobs.append_batches(jobs.verify_stream(stream), lambda b: b, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(180)
    got = sorted((r["seq"], r["verdict"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "verified"), (2, "late"), (2, "verified"), (3, "verified"), (4, "verified"), (5, "verified")]


class Cell:
    """A state variable that counts calls."""

    def __init__(self, calls):
        self.calls, self.held = calls, {}

    def __getattr__(self, name):
        def call(key=None, value=None):
            self.calls.append(name)
            if name in ("exists", "containsKey"):
                return key in self.held
            if name in ("get", "getValue"):
                return self.held[key]
            if name == "removeKey":
                return self.held.pop(key)
            if name == "update":
                key, value = None, key
            self.held[key] = value
        return call


def test_verifier_asks_the_state_by_runs_of_rows(monkeypatch):
    monkeypatch.setattr(jobs, "WAIT_ROWS", 100, raising=False)
    monkeypatch.setattr(jobs, "HELD_ROWS", 700, raising=False)
    calls = []
    verifier = jobs.ChainVerifier()
    verifier.init(SimpleNamespace(getValueState=lambda *_: Cell(calls), getMapState=lambda *_: Cell(calls)))
    row = lambda q: (q, f"h{q}", f"h{q - 1}" if q > 1 else None, q != 77)
    got = []
    for want in ([q for q in range(1, 1001) if q % 3], range(600, 1001, 3), range(3, 600, 3), [5]):
        frames = [pd.DataFrame([row(q) for q in want[i:i + 250]], columns=["seq", "hash", "prev_hash", "seal_ok"]) for i in range(0, len(want), 250)]
        for pdf in verifier.handleInputRows(("s",), iter(frames), None):
            got += pdf.itertuples(index=False, name=None)
    assert got == [("s", q, "hash mismatch" if q == 77 else "verified") for q in range(1, 1001)] + [("s", 5, "late")]
    assert not verifier.waiting.held and len(calls) < 200  # one row a call would be 2,000 and more


def test_stream_files_are_made_once_by_all_tasks(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    rows = spark.range(4000, numPartitions=4).mapInPandas(count, "id long")
    stream = streams._files(SimpleNamespace(spark=spark), rows)
    q = stream.writeStream.trigger(availableNow=True).format("memory").queryName("sets").start()
    q.awaitTermination(120)
    assert made.value == 4000
    assert sorted(r["id"] for r in spark.sql("SELECT * FROM sets").collect()) == list(range(4000))
    assert len([p for p in q.recentProgress if p["numInputRows"]]) == 3
