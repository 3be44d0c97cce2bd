"""Fleet memory lifecycle: promotions, reviews, supersession and rollback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# scope ranks and the widest scope a tier may propose (fixed values)
SCOPES = ("session", "fleet", "global")
MAX_SCOPE = {"untrusted": "session", "member": "fleet", "trusted": "global", "steward": "global"}
_DECISIONS = {"accepted": "active", "rejected": "rejected", "deferred": "deferred"}
_ID = ["fleet", "pid"]


def fleet_state(events: DataFrame) -> DataFrame:
    """Last effective status per promotion.

    Events: fleet, seq, kind (promoted / reviewed / superseded / rolled_back), pid, other (superseding id),
    decision, plus the promotion's own columns memory_kind, conflict_key, conflict_value, initial.
    The first promotion record is canonical and events before it are inert.  A promotion's status depends
    only on its own last event, except that losing to `w` is undone by a later rollback of `w`; that is one
    join on the winner, so no fleet is ever replayed in one task.
    """
    record = F.struct("seq", "memory_kind", "conflict_key", "conflict_value", "initial")
    first = events.filter("kind = 'promoted'").groupBy(*_ID).agg(F.min(record).alias("_r")).select(
        *_ID, F.col("_r.seq").alias("first_seq"), "_r.memory_kind", "_r.conflict_key", "_r.conflict_value", "_r.initial")
    outcome = F.when(F.col("kind") == "reviewed", F.element_at(F.create_map(*[F.lit(x) for kv in _DECISIONS.items() for x in kv]), F.col("decision")))
    outcome = outcome.when(F.col("kind") == "superseded", F.lit("superseded")).when(F.col("kind") == "rolled_back", F.lit("rolled_back"))
    later = (events.filter("kind <> 'promoted'").withColumn("outcome", outcome).filter("outcome IS NOT NULL")
             .join(first.select(*_ID, "first_seq"), _ID).filter("seq > first_seq"))
    last = later.groupBy(*_ID).agg(F.max_by(F.struct("seq", "outcome", "other"), "seq").alias("_l")).select(
        *_ID, F.col("_l.seq").alias("last_seq"), F.col("_l.outcome").alias("outcome"), F.col("_l.other").alias("other"))
    undone = later.filter("kind = 'rolled_back'").groupBy("fleet", F.col("pid").alias("other")).agg(F.max("seq").alias("_undone"))
    state = first.join(last, _ID, "left").join(undone, ["fleet", "other"], "left")
    status = (F.when(F.col("outcome").isNull(), F.when(F.col("initial") == "active", "active").otherwise("pending"))
              .when((F.col("outcome") == "superseded") & (F.col("_undone") > F.col("last_seq")), "active").otherwise(F.col("outcome")))
    return state.select(*_ID, "memory_kind", "conflict_key", "conflict_value", "first_seq", status.alias("status"),
                        F.when(F.col("outcome") == "superseded", F.col("other")).alias("superseded_by"))


def active_skills(state: DataFrame) -> DataFrame:
    return state.filter("status = 'active' AND memory_kind = 'skill'")


def fleet_brief(state: DataFrame) -> DataFrame:
    """Counts by status and kind per fleet."""
    return state.groupBy("fleet").agg(
        F.count(F.lit(1)).alias("memories"), *[F.count_if(F.col("status") == s).alias(s) for s in
                                                ("active", "pending", "rejected", "deferred", "superseded", "rolled_back")],
        F.count_if((F.col("status") == "active") & (F.col("memory_kind") == "skill")).alias("active_skills"))


def contested_actives(state: DataFrame) -> DataFrame:
    """Active memories in a fleet whose conflict key is held with another value too.

    The opposing values are summarised per key (distinct count), not paired row by row.
    """
    live = state.filter("status = 'active' AND conflict_key IS NOT NULL")
    keys = live.groupBy("fleet", "conflict_key").agg(F.count_distinct("conflict_value").alias("values"), F.count(F.lit(1)).alias("_n"))
    same = live.groupBy("fleet", "conflict_key", "conflict_value").agg(F.count(F.lit(1)).alias("_same"))
    return (live.join(keys.filter("values > 1"), ["fleet", "conflict_key"]).join(same, ["fleet", "conflict_key", "conflict_value"])
            .select("fleet", "pid", "conflict_key", "conflict_value", "values", (F.col("_n") - F.col("_same")).alias("opponents")))


def visible_scopes(rows: DataFrame, tier: str = "trust_tier", scope: str = "scope") -> DataFrame:
    """Rows whose scope does not exceed what their trust tier may propose."""
    rank = F.create_map(*[x for i, s in enumerate(SCOPES) for x in (F.lit(s), F.lit(i))])
    ceiling = F.create_map(*[x for t, s in MAX_SCOPE.items() for x in (F.lit(t), F.lit(SCOPES.index(s)))])
    return rows.filter(rank[F.col(scope)] <= ceiling[F.col(tier)])
