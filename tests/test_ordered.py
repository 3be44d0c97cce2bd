"""Sliced ordered work equals a plain fold, wherever the slice borders fall."""

import random

from pyspark.sql import functions as F

from tracegrain import ordered as O


def rows(spark, n=300, seed=3):
    rnd = random.Random(seed)
    keys = ["hot"] * n + ["a"] * 7 + ["b"]
    data, pos = [], {}
    for k in keys:
        pos[k] = pos.get(k, 0) + 1
        data.append((k, pos[k], rnd.randint(-3, 9), None if rnd.random() < 0.6 else rnd.randint(0, 99)))
    return data, spark.createDataFrame(data, "key string, seq bigint, x int, v int").withColumn("_slice", O.slice_of("seq", 16))


def by_key(data):
    out = {}
    for r in sorted(data, key=lambda r: (r[0], r[1])):
        out.setdefault(r[0], []).append(r)
    return out


def test_row_numbers(spark):
    data, df = rows(spark)
    got = {(r["key"], r["seq"]): r["n"] for r in O.row_numbers(df, ["key"], ["seq"], out="n", partitions=7).collect()}
    assert got == {(r[0], r[1]): r[1] for r in data}


def test_neighbour_running_sum_and_carry(spark):
    data, df = rows(spark)
    out = O.neighbour(df, ["key"], ["seq"], F.col("x"), "prev")
    out = O.neighbour(out, ["key"], ["seq"], F.col("x"), "next", forward=True)
    out = O.running_sum(out, ["key"], ["seq"], F.col("x"), "total")
    out = O.carry_forward(out, ["key"], ["seq"], F.col("v"), "last")
    got = {(r["key"], r["seq"]): (r["prev"], r["next"], r["total"], r["last"]) for r in out.collect()}
    for key, items in by_key(data).items():
        total, last = 0, None
        for i, r in enumerate(items):
            total += r[2]
            want = (items[i - 1][2] if i else None, items[i + 1][2] if i + 1 < len(items) else None, total, last)
            assert got[(key, r[1])] == want
            last = r[3] if r[3] is not None else last


def test_halo_gives_whole_neighbourhoods(spark):
    _, df = rows(spark)
    from pyspark.sql import Window
    spread = O.halo(df.drop("_slice"), "seq", after=3, width=8)
    w = Window.partitionBy("key", "_slice").orderBy("seq").rowsBetween(0, 3)
    got = spread.withColumn("n", F.count("*").over(w)).filter("_own").filter("key = 'hot' AND seq <= 297")
    assert got.filter("n <> 4").count() == 0 and got.count() == 297


def test_tree_fold_keeps_order(spark):
    data, df = rows(spark)
    out = O.tree_fold(df, ["key"], "seq", F.col("x").cast("string"), lambda a, b: F.concat(a, b), F.lit(""), "s", width=8, levels=4)
    got = {r["key"]: r["s"] for r in out.collect()}
    assert got == {k: "".join(str(r[2]) for r in items) for k, items in by_key(data).items()}


def test_salted_join_equals_join(spark):
    left = spark.createDataFrame([("k", i) for i in range(50)] + [("z", 1)], "k string, i int")
    right = spark.createDataFrame([("k", "a"), ("k", "b")], "k string, r string")
    assert O.salted_join(left, right, ["k"], salts=4).count() == 100
    assert O.salted_join(left, right, ["k"], "left_anti", salts=4).count() == 1
