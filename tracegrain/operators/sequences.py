"""Ordered-sequence operators: windows, runs, n-grams, horizons and groupings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import long_words
from ..ordered import halo, running_sum, slice_of, top_k


def positions(rows: DataFrame, out: str = "pos") -> DataFrame:
    """Gap-free position of each row inside its session, in seq order."""
    return running_sum(rows.withColumn("_slice", slice_of("seq")), ["session"], ["seq"], F.lit(1), out).drop("_slice")


def consolidation_windows(events: DataFrame, size: int = 8) -> DataFrame:
    """Blocks of `size` consecutive actionable events of a session, with type counts and a stable id."""
    placed = positions(events).withColumn("block", F.floor((F.col("pos") - 1) / size))
    counts = placed.groupBy("session", "block", "type").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    out = counts.groupBy("session", "block").agg(
        F.sum("n").alias("events"), F.min("lo").alias("first_seq"), F.max("hi").alias("last_seq"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("type_counts"))
    return out.withColumn("segment_id", F.format_string("segment:%s:%06d-%06d", F.col("session"), F.col("first_seq"), F.col("last_seq")))


def consolidation_proposals(windows: DataFrame) -> DataFrame:
    """Episode always; claim and procedure where the window's event types signal one."""
    kinds = F.map_keys("type_counts")
    some = lambda *prefixes: F.exists(kinds, lambda k: F.greatest(*[F.startswith(k, F.lit(p)) for p in prefixes], F.lit(False)))
    claim = (F.col("events") >= 2) & some("file.edit.", "task.", "coordination.")
    steps = (F.coalesce(F.try_element_at("type_counts", F.lit("tool.call.completed")), F.lit(0)) >= 2) | (
        some("file.edit.") & some("tool.call.", "command.", "task."))
    row = lambda kind, confidence, method: F.struct(F.lit(kind).alias("candidate_type"), F.lit(confidence).alias("confidence"), F.lit(method).alias("method"))
    options = F.array_compact(F.array(
        row("episode", 0.68, "deterministic_episode_segment_v1"), F.when(claim, row("claim", 0.62, "deterministic_claim_signal_v1")),
        F.when(steps, row("procedure", 0.58, "deterministic_procedure_trace_v1"))))
    return windows.withColumn("_p", F.explode(options)).select("session", "segment_id", "first_seq", "last_seq", "events", "_p.*")


def session_traces(events: DataFrame, step: Column, ok: Column) -> DataFrame:
    """Ordered tool and command steps per session with a success flag; a nameless step is unsuccessful."""
    rows = events.select("session", "seq", "hash", F.coalesce(step, "type").alias("step"), (ok & step.isNotNull()).alias("ok"))
    return positions(rows)


def successful_runs(traces: DataFrame) -> DataFrame:
    """Steps with a run number: the number of failures before them in the session."""
    rows = traces.withColumn("_slice", slice_of("pos"))
    return running_sum(rows, ["session"], ["pos"], F.when(F.col("ok"), 0).otherwise(1), "run").drop("_slice")


def procedure_ngrams(traces: DataFrame, min_length: int = 2, max_length: int = 8) -> DataFrame:
    """All contiguous n-grams inside successful runs: session, gram, first_seq.

    Positions near a slice border are copied to the slice before, so each n-gram window is whole inside its
    slice and no session is ordered in one task.
    """
    spread = halo(traces, "pos", after=max_length - 1)
    ahead = Window.partitionBy("session", "_slice").orderBy("pos").rowsBetween(0, max_length - 1)
    rows = spread.select("session", "pos", "seq", "_own", "_slice", F.collect_list(F.when(F.col("ok"), F.col("step")).otherwise(F.lit("\x00"))).over(ahead).alias("_ahead"))
    stop = F.array_position("_ahead", "\x00")
    usable = F.when(stop > 0, stop - 1).otherwise(F.size("_ahead")).cast("int")
    rows = rows.filter("_own").withColumn("_len", usable).filter(F.col("_len") >= min_length)
    return rows.withColumn("_n", F.explode(F.sequence(F.lit(min_length), F.col("_len")))).select(
        "session", F.col("seq").alias("first_seq"), F.slice("_ahead", F.lit(1), F.col("_n")).alias("gram"))


def mine_procedures(traces: DataFrame, min_support: int = 2, min_length: int = 2, max_length: int = 8) -> DataFrame:
    """N-grams seen in at least `min_support` sessions; one contained in a longer one with the same sessions is dropped.

    The session set travels as its size and two commutative digests, not as a list.  Containment is tested
    by listing the at most 28 shorter pieces of each mined n-gram and an anti join, never by pairing n-grams.
    """
    per_session = procedure_ngrams(traces, min_length, max_length).groupBy("gram", "session").agg(
        F.count(F.lit(1)).alias("n"), F.min("first_seq").alias("first_seq"))
    digest = lambda seed: F.sum((F.xxhash64(F.lit(seed), "session") % F.lit(1_000_000_007)).cast("bigint"))
    mined = per_session.groupBy("gram").agg(
        F.count(F.lit(1)).alias("support"), F.sum("n").alias("occurrences"), F.min(F.struct("first_seq", "session")).alias("first"),
        F.struct(digest(1).alias("a"), digest(2).alias("b")).alias("sessions")).filter(F.col("support") >= min_support)
    size = F.size("gram")
    pieces = F.flatten(F.transform(F.sequence(F.lit(min_length), size - 1), lambda n: F.transform(
        F.sequence(F.lit(1), size - n + 1), lambda s: F.slice("gram", s, n))))
    longer = mined.filter(size > min_length).select(F.explode(pieces).alias("gram"), "support", "sessions").distinct()
    kept = mined.join(longer, ["gram", "support", "sessions"], "left_anti")
    confidence = F.round(F.least(F.lit(0.85), 0.50 + 0.05 * (F.col("support") - 2)), 2)
    return kept.select("gram", F.array_join("gram", ">").alias("steps"), F.size("gram").alias("length"), "support", "occurrences",
                       F.col("first.first_seq").alias("first_seq"), F.col("first.session").alias("first_session"), confidence.alias("confidence"))


def temporal_program(programs: DataFrame, rows: DataFrame) -> DataFrame:
    """Keep rows strictly before or after a boundary row chosen by term hits; reason per excluded row.

    Programs: program, terms, direction, distinct; rows: program, event_id, ord, label, raw_span, source_group,
    event_date, identity, exclude_reason.
    """
    joined = rows.join(programs, "program")
    text = F.lower(F.concat_ws(" ", "label", "raw_span"))
    hits = F.size(F.filter("terms", lambda t: F.contains(text, F.lower(t))))
    joined = joined.withColumn("_hits", hits)
    best = (joined.filter("event_date IS NOT NULL AND _hits > 0").groupBy("program")
            .agg(F.min(F.struct((-F.col("_hits")).alias("h"), "source_group", "ord", "event_id", "event_date")).alias("b"))
            .select("program", F.col("b.event_id").alias("_bid"), F.col("b.event_date").alias("_bdate")))
    out = joined.join(best, "program", "left")
    outside = F.when(F.col("direction") == "before", F.col("event_date") >= F.col("_bdate")).when(
        F.col("direction") == "after", F.col("event_date") <= F.col("_bdate"))
    reason = (F.when(F.col("exclude_reason").isNotNull(), F.col("exclude_reason")).when(F.col("event_id") == F.col("_bid"), "temporal_count_target")
              .when(F.col("event_date").isNull(), "missing_temporal_count_date").when(F.coalesce(outside, F.lit(False)), "temporal_count_outside_window"))
    out = out.withColumn("reason", reason).withColumn("_key", F.coalesce("identity", F.col("event_id").cast("string")))
    first = out.filter("reason IS NULL").groupBy("program", "_key").agg(F.min("ord").alias("_first"))
    out = out.join(first, ["program", "_key"], "left")
    repeat = F.col("reason").isNull() & F.col("distinct") & (F.col("ord") > F.col("_first"))
    return out.withColumn("reason", F.when(repeat, "duplicate_identity").otherwise(F.col("reason"))).select(
        "program", "event_id", "event_date", (F.col("event_id") == F.col("_bid")).alias("boundary"), "reason", F.col("reason").isNull().alias("included"))


# weights of the remote tier (fixed values)
W_OVERLAP, W_SPAN, W_PROXIMITY, W_PRIOR, SPAN_FULL = 0.40, 0.25, 0.20, 0.15, 8


def horizon_split(log: DataFrame, recent: int) -> DataFrame:
    """Per session: last seq outside the recent window, or null when all history is recent."""
    total = log.groupBy("session").agg(F.max("seq").alias("_n"))
    return total.select("session", F.when(F.col("_n") > recent, F.col("_n") - recent).alias("split_seq"), F.least("_n", F.lit(recent)).alias("recent_events"))


def long_horizon(candidates: DataFrame, splits: DataFrame, queries: DataFrame, budget: int | None = None) -> DataFrame:
    """Remote-tier items per session query, scored by overlap, span, proximity and prior.

    Candidates: session, item_id, text, sources, max_seq, confidence; queries: session, query_id, text.
    """
    rows = candidates.join(splits.filter("split_seq IS NOT NULL"), "session").filter("max_seq <= split_seq")
    rows = rows.withColumn("_words", F.array_distinct(long_words(F.col("text")))).drop("text")
    asked = queries.withColumn("_q", F.array_distinct(long_words(F.col("text")))).drop("text")
    out = rows.join(asked, "session")
    overlap = F.when(F.size("_q") > 0, F.size(F.array_intersect("_q", "_words")) / F.size("_q")).otherwise(F.lit(0.0))
    score = (W_OVERLAP * overlap + W_SPAN * F.least(F.lit(1.0), F.col("sources") / SPAN_FULL)
             + W_PROXIMITY * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("max_seq") / F.col("split_seq")))
             + W_PRIOR * F.coalesce("confidence", F.lit(0.5)))
    out = out.withColumn("score", F.round(score, 6))
    if budget is not None:
        out = top_k(out, ["session", "query_id"], [F.desc("score"), F.col("item_id")], budget)
    return out.drop("_words", "_q")


def evidence_groups(rows: DataFrame) -> DataFrame:
    """Per (query, source): distinct rows, citations, lanes, top score and the first snippet.

    Rows: query_id, source_id, citation, lane, score, ord, snippet.  Lanes are a fixed handful, so their list stays small.
    """
    once = rows.groupBy("query_id", "source_id", "citation", "lane", "snippet").agg(F.max("score").alias("score"), F.min("ord").alias("ord"))
    return once.groupBy("query_id", "source_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("citation").alias("citations"),
        F.array_join(F.array_sort(F.collect_set("lane")), ",").alias("lanes"), F.max("score").alias("top_score"),
        F.min_by("snippet", "ord").alias("snippet"))


def working_set(events: DataFrame, contexts: DataFrame, n: int) -> DataFrame:
    """First n distinct (category, summary, citation) rows per session, events before retrieved rows."""
    both = events.withColumn("_lane", F.lit(0)).unionByName(contexts.withColumn("_lane", F.lit(1)))
    once = both.groupBy("session", "category", "summary", "citation").agg(F.min(F.struct("_lane", "ord")).alias("o"))
    return top_k(once, ["session"], [F.col("o"), F.col("citation")], n).drop("o")
