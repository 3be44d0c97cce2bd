"""De-duplication, novelty and set operators across result lanes and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key under `order`, as a map-side combined minimum."""
    rest = [c for c in rows.columns if c not in keys]
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_r")).select(*keys, "_r.*")


def unseen(rows: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key was not recorded before."""
    return rows.join(known.select(*keys).distinct(), list(keys), "left_anti")


def drop_superseded(source_rows: DataFrame, preferences: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raw rows older than a recorded preference for the same key are dropped."""
    newest = preferences.groupBy(*keys).agg(F.max("seq").alias("_newest"))
    return source_rows.join(newest, list(keys), "left").filter("_newest IS NULL OR seq > _newest").drop("_newest")


# label values written for one purpose only, and the fields that may hold them (fixed values)
PURPOSE_LABELS = ("churn_risk", "customer_escalation", "legal_obligation", "roadmap_commitment", "security_warning")
LABEL_FIELDS = ("purpose_label", "semantic_label", "entity_type", "label")


def normal_label(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), "[- ]", "_")


def label_audit(events: DataFrame) -> DataFrame:
    """Payloads that already carry purpose-specific labels, with the labels found."""
    top = F.from_json("payload", "map<string,string>")
    listed = F.coalesce(F.from_json(top["labels"], "array<string>"), F.array().cast("array<string>"))
    values = F.transform(F.concat(F.array(*[top[f] for f in LABEL_FIELDS]), listed), lambda v: normal_label(v))
    found = F.array_sort(F.array_intersect(values, F.array(*[F.lit(x) for x in PURPOSE_LABELS])))
    return events.withColumn("labels", found).filter(F.size("labels") > 0)


def purpose_views(neutral: DataFrame, profiles: Sequence[tuple[str, str]]) -> DataFrame:
    """One view per neutral record and profile (profile, label), the neutral row untouched."""
    options = F.array(*[F.struct(F.lit(p).alias("profile"), F.lit(x).alias("label")) for p, x in profiles])
    rows = neutral.withColumn("_p", F.explode(options)).withColumns({
        "profile": F.regexp_replace(F.lower(F.trim("_p.profile")), " ", "-"), "label": normal_label(F.col("_p.label"))}).drop("_p")
    return rows.withColumn("projection_id", F.concat_ws(":", F.lit("purpose"), "profile", "label", "substrate_id"))
