"""The log data source by ranges and offsets, and the deferred queue against its batch form."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracegrain.sources import log_source as S
from tracegrain.streaming import jobs
from tracegrain.streaming import reinforcement as Q

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def record(i, text=""):
    return json.dumps({"seq": i, "timestamp": "2026-01-02T03:04:05Z", "type": "note", "actor": "u", "thread": "t", "payload": {"text": text}, "hash": f"h{i}"}, ensure_ascii=False)


@pytest.mark.parametrize("range_bytes", [1, 7, 64, 1_000_000])
def test_every_line_is_read_once_wherever_borders_fall(spark, tmp_path, monkeypatch, range_bytes):
    lines = {"a.jsonl": ["first", "", "é" * 30, "x", "  ", "last without break"], "sub/b.jsonl": ["only"], "empty.jsonl": [], "other.txt": ["no"]}
    for name, own in lines.items():
        file = tmp_path / name
        file.parent.mkdir(exist_ok=True)
        file.write_bytes("\n".join(own).encode())
    monkeypatch.setattr(S, "BLOCK_BYTES", 5)
    got = S.lines(spark, str(tmp_path), range_bytes=range_bytes).collect()
    assert sorted(r.line for r in got) == sorted(["first", "é" * 30, "x", "last without break", "only"])
    raw = (tmp_path / "a.jsonl").read_bytes()
    assert all(raw[r.start:].startswith(r.line.encode()) for r in got if r.file.endswith("a.jsonl"))


def test_empty_folder(spark, tmp_path):
    assert S.lines(spark, str(tmp_path)).count() == 0


def test_stream_resumes_at_the_byte_and_waits_for_whole_lines(spark, tmp_path):
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    file = tmp_path / "in" / "s1.jsonl"

    def run():
        stream = S.lines(spark, folder, stream=True, range_bytes=50)
        jobs.append_batches(stream, S.events, out, mark).awaitTermination(120)
        return sorted((r.seq, r.session) for r in spark.read.parquet(out).collect())

    whole = record(3, "é" * 20).encode()
    file.write_bytes(f"{record(1)}\n{record(2)}\n".encode() + whole[:40])
    assert run() == [(1, "s1"), (2, "s1")]
    with file.open("ab") as f:
        f.write(whole[40:] + b"\n")
    (tmp_path / "in" / "s2.jsonl").write_text(record(9) + "\n")
    assert run() == [(1, "s1"), (2, "s1"), (3, "s1"), (9, "s2")]


def feedback(n, seed):
    rng = random.Random(seed)
    kinds = (*Q.KINDS, "unknown")
    return [(f"m{rng.randrange(5)}", rng.choice(kinds), rng.choice((None, 0.5, 2.0)), 1_700_000_000 + rng.randrange(3600)) for _ in range(n)]


def test_deferred_rows_equal_the_batch_fold_and_survive_a_failing_sink(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    schema = "target string, kind string, weight double, s bigint"
    rows = feedback(120, 3)
    frame = lambda own: spark.createDataFrame(own, schema).withColumn("ts", F.timestamp_seconds("s")).drop("s")
    path, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for part in (rows[:50], rows[50:], [("end", "surfaced", 1.0, 1_700_100_000)], [("end", "surfaced", 1.0, 1_700_200_000)]):
        frame(part).coalesce(1).write.mode("append").parquet(path)
    failed = []

    def sink(batch, batch_id):
        if batch_id == 2 and not failed:
            failed.append(batch_id)
            raise OSError("sink is down")
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    def run():
        stream = spark.readStream.schema(frame([]).schema).option("maxFilesPerTrigger", 1).parquet(path)
        Q.deliver(Q.deferred(stream, 600_000, "2 hours"), sink, mark).awaitTermination(180)

    with pytest.raises(Exception, match="sink is down"):
        run()
    run()
    got = sorted(map(tuple, spark.read.parquet(out).drop("batch_id").filter("target <> 'end'").collect()))
    want = sorted(map(tuple, Q.coalesced(frame(rows), 600_000).select(*spark.read.parquet(out).drop("batch_id").columns).collect()))
    assert failed and got == want
