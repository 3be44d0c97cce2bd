"""Membership filter, bootstrap intervals and core-sets against their guarantees."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrain.operators import bootstrap, coresets, membership
from tracegrain.operators import vectors as V


def terms(spark, low, high, name="term"):
    return spark.range(low, high).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias(name))


@pytest.mark.parametrize("rate", [0.1, 0.01, 0.001])
def test_filter_keeps_all_terms_and_its_rate(spark, rate):
    held = membership.build(terms(spark, 0, 20_000), rate=rate)
    assert membership.might_contain(terms(spark, 0, 20_000), "term", held).filter("not maybe").count() == 0
    wrong = membership.might_contain(terms(spark, 20_000, 220_000), "term", held).filter("maybe").count() / 200_000
    assert rate / 2 < wrong < rate * 2
    assert held.blocks < 20_000 * 40 / 512  # some bits a term


def test_filters_merge_in_any_parts(spark, monkeypatch):
    blocks = membership.blocks_for(3000, 0.01)
    whole = membership.build(terms(spark, 0, 3000), blocks=blocks)
    parts = [membership.build(terms(spark, i * 1000, i * 1000 + 1000), blocks=blocks) for i in (2, 0, 1)]
    assert sorted(map(tuple, membership.merge(*parts).rows.collect())) == sorted(map(tuple, whole.rows.collect()))
    monkeypatch.setattr(membership, "BROADCAST_BLOCKS", 0)  # joined by block instead
    asked = terms(spark, 2990, 3010).withColumn("w0", F.lit("own column")).union(spark.createDataFrame([(None, "x")], "term string, w0 string"))
    got = {r.term: r.maybe for r in membership.might_contain(asked, "term", whole).collect()}
    assert all(got[f"t{i}"] for i in range(2990, 3000)) and got[None] is False
    with pytest.raises(ValueError):
        membership.merge(whole, membership.build(terms(spark, 0, 9), blocks=blocks + 1))
    empty = membership.build(terms(spark, 0, 0))
    assert membership.might_contain(terms(spark, 0, 5), "term", empty).filter("maybe").count() == 0


def test_weights_are_poisson_and_repeatable(spark):
    rows = spark.range(50_000).select(F.explode(bootstrap.weights(F.col("id"), F.lit(3))).alias("w"))
    got = {r.w: r["count"] / 200_000 for r in rows.groupBy("w").count().collect()}
    want = np.exp(-1) / np.cumprod([1, 1, 2, 3, 4])
    assert all(abs(got[k] - p) < 0.005 for k, p in enumerate(want))
    assert rows.agg(F.sum("w")).first()[0] == rows.repartition(7).agg(F.sum("w")).first()[0]


def test_intervals_cover_the_true_mean(spark):
    rng = np.random.default_rng(11)
    rows = [(g, i, float(x)) for g in range(80) for i, x in enumerate(rng.exponential(2.0, 150))]
    df = spark.createDataFrame(rows, "g int, i int, x double").withColumn("key", F.concat_ws("/", "g", "i"))
    got = bootstrap.intervals(df, ["g"], F.col("key"), F.col("x"), count=200).collect()
    covered = sum(r.low <= 2.0 <= r.high for r in got) / len(got)
    assert len(got) == 80 and 0.86 <= covered <= 1
    widths = [r.high - r.low for r in got]
    assert 0.4 < np.mean(widths) / (2 * 1.96 * 2.0 / np.sqrt(150)) < 1.3
    again = bootstrap.intervals(df.repartition(5, "x"), ["g"], F.col("key"), F.col("x"), count=200).collect()
    assert np.allclose(sorted(map(tuple, again)), sorted(map(tuple, got)))


def radius(units, centres):
    return np.sqrt(np.maximum(0, 2 - 2 * (units @ units[centres].T).max(axis=1))).max()


def test_core_sets_stay_within_their_factor(spark):
    rng = np.random.default_rng(2)
    raw = rng.normal(size=(600, 5)) + 3 * rng.normal(size=(12, 5))[rng.integers(0, 12, 600)]
    df = spark.createDataFrame([("g" if i % 4 else "h", i, v.tolist()) for i, v in enumerate(raw)], "label string, vec_id long, vector array<double>")
    units = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    one = sorted(map(tuple, coresets.k_centres(df, "label", 6).collect()))
    exact = sorted(map(tuple, V.k_centres(df, "label", 6).select("label", "position", "vec_id").collect()))
    assert one == exact  # a group of one block
    for block_rows, factor in ((64, 4), (16, 8)):
        got = coresets.k_centres(df, "label", 6, block_rows=block_rows).collect()
        for label in "gh":
            own = np.array([i for i in range(600) if ("g" if i % 4 else "h") == label])
            at = {v: j for j, v in enumerate(own)}
            pick = lambda rows: [at[v] for g, _, v in rows if g == label]
            assert len(pick(got)) == 6
            assert radius(units[own], pick(map(tuple, got))) <= factor * radius(units[own], pick(exact))
    with pytest.raises(ValueError):
        coresets.k_centres(df, "label", 6, block_rows=8)


def test_core_sets_propose_and_a_test_makes_them_exact(spark):
    rng = np.random.default_rng(5)
    raw = rng.normal(size=(300, 4))
    df = spark.createDataFrame([("g" if i % 4 else "h", i, v.tolist()) for i, v in enumerate(raw)], "label string, vec_id long, vector array<double>")
    plain = lambda rows: sorted((r.label, r.position, r.vec_id) for r in rows)
    exact = plain(V.k_centres(df, "label", 4).collect())
    assert plain(coresets.k_centres(df, "label", 4, block_rows=16).collect()) != exact  # what the query returned for large groups
    assert plain(coresets.exact_k_centres(df, "label", 4, block_rows=16).collect()) == exact
