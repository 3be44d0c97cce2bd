"""Hash embeddings against plain Python."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrain.operators import vectors as V


def test_embedding_moves_nothing_for_unique_keys(spark, monkeypatch):
    monkeypatch.setattr(V, "EMBED_BYTES", 8)
    texts = {1: "One two  two", 2: None, 3: "", 4: " \t\n", 5: " lead and trail ", 6: "Äpfel ÄPFEL", 7: "a\x0bb c"}
    rows = spark.createDataFrame([(k, t) for k, t in texts.items()] + [(8, "x y"), (8, "y z")], "id int, text string")

    def plain(*parts):
        v = np.zeros(16)
        for text in parts:
            tokens = [t for t in (text or "").lower().replace("\t", " ").replace("\n", " ").replace("\x0b", " ").split(" ") if t]
            for t in tokens or [""]:
                h = hashlib.sha256(t.encode()).hexdigest()
                v[int(h[:8], 16) % 16] += 1 if int(h[9], 16) % 2 else -1
        n = np.sqrt((v * v).sum())
        return v / n if n else v

    got = {r["id"]: r["vector"] for r in V.hash_embedding(rows, "id", F.col("text"), 16).collect()}
    assert got.keys() == {*texts, 8}
    for key, text in texts.items():
        assert got[key] == pytest.approx(plain(text))
    assert got[8] == pytest.approx(plain("x y", "y z"))
    alone = V.hash_embedding(rows.filter("id < 8"), "id", F.col("text"), 16, unique=True)
    assert {r["id"]: r["vector"] for r in alone.collect()} == {k: v for k, v in got.items() if k < 8}
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()
