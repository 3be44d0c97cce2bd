"""Typed evidence: mention extraction, ledgers and their reductions.

Ledger rows: question, fact_id, source_group, kind, value, unit, label, identity, relevance, ord, include_reason, exclude_reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import long_words
from ..ordered import top_k
from ..session import cut

# mention patterns (fixed values)
MENTIONS = {
    "currency": r"\$\s?(\d[\d,]*(?:\.\d{1,2})?)",
    "duration": r"(\d+(?:\.\d+)?[ -](?:minutes?|hours?|days?|weeks?|months?|years?))\b",
    "quantity": r"(\d+(?:\.\d+)? (?:items?|units?|pieces?|copies|people|times))\b",
    "date_iso": r"\b(\d{4}-\d{2}-\d{2})\b",
    "date_month": r"\b((?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2})\b",
    "date_relative": r"\b(\d+ (?:days?|weeks?) ago)\b",
}
UNIT_MINUTES = {"minute": 1, "hour": 60, "day": 1440, "week": 10080, "month": 43200, "year": 525600}
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def mentions(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row per typed mention: kind, order in the text, raw span.  All kinds come from one pass over the text."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(text, F.lit(p), 1).alias("spans")) for k, p in MENTIONS.items()])
    rows = texts.select(*[c for c in texts.columns if c != text], F.explode(kinds).alias("_k"))
    return rows.select("*", F.posexplode("_k.spans").alias("pos", "raw_span")).withColumn("kind", F.col("_k.kind")).drop("_k")


def mention_values(rows: DataFrame, session_date: Column) -> DataFrame:
    """Mentions with a typed value: amount in cents, minutes, count or date (relative and month dates from the session date)."""
    number = F.regexp_replace(F.regexp_extract("raw_span", r"^[\d,.]*\d", 0), ",", "").cast("decimal(18,4)")
    unit = F.regexp_replace(F.regexp_extract("raw_span", r"([a-z]+)(?: ago)?$", 1), "s$", "")
    minutes = F.create_map(*[F.lit(x) for kv in UNIT_MINUTES.items() for x in kv])[unit]
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.regexp_extract("raw_span", r"^([A-Z][a-z]+)", 1)).cast("int")
    day = F.regexp_extract("raw_span", r"(\d{1,2})$", 1).try_cast("int")
    back = F.regexp_extract("raw_span", r"^(\d+)", 1).try_cast("int") * F.when(unit == "week", 7).otherwise(1)
    date = (F.when(F.col("kind") == "date_iso", F.try_to_date("raw_span", "yyyy-MM-dd"))
            .when(F.col("kind") == "date_month", F.try_to_date(F.format_string("%04d-%02d-%02d", F.year(session_date), month, day), "yyyy-MM-dd"))
            .when(F.col("kind") == "date_relative", F.date_sub(session_date, back)))
    amount = (F.when(F.col("kind") == "currency", (number * 100).cast("bigint")).when(F.col("kind") == "duration", (number * minutes).cast("bigint"))
              .when(F.col("kind") == "quantity", number.cast("bigint")))
    return rows.withColumns({"amount": amount, "unit": F.when(F.col("kind").isin("duration", "quantity"), unit), "event_date": date})


def included(ledger: DataFrame) -> DataFrame:
    return ledger.filter("exclude_reason IS NULL")


def numeric_results(ledger: DataFrame) -> DataFrame:
    """Sum, average, difference and maximum of included rows per question and kind, with source counts."""
    return included(ledger).groupBy("question", "kind").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("value").alias("total"), F.round(F.avg("value"), 4).alias("average"),
        (F.max("value") - F.min("value")).alias("difference"), F.max("value").alias("largest"),
        F.max_by("label", F.struct("value", "fact_id")).alias("largest_label"), F.count_distinct("source_group").alias("sources"))


def dedupe_currency(ledger: DataFrame) -> DataFrame:
    """The same amount in the same source group counts once per question; later rows are excluded with a reason."""
    key = ["question", "source_group", "value"]
    money = ledger.filter("kind = 'currency' AND exclude_reason IS NULL")
    first = money.groupBy(*key).agg(F.min("ord").alias("_first"))
    rows = ledger.join(first, key, "left")
    repeat = (F.col("kind") == "currency") & (F.col("ord") > F.col("_first"))
    return rows.withColumn("exclude_reason", F.when(repeat, "duplicate_source_value").otherwise(F.col("exclude_reason"))).drop("_first")


def duration_totals(ledger: DataFrame, preferred_unit: str | None = None) -> DataFrame:
    """Total minutes per question; repeats of (source, value, unit) count once; rows of a preferred unit win where present."""
    minutes = F.create_map(*[F.lit(x) for kv in UNIT_MINUTES.items() for x in kv])
    rows = included(ledger).filter(F.col("unit").isin(*UNIT_MINUTES)).groupBy("question", "source_group", "value", "unit").agg(F.min("ord").alias("ord"))
    if preferred_unit is not None:
        has = rows.groupBy("question").agg(F.max(F.col("unit") == preferred_unit).alias("_has"))
        rows = rows.join(has, "question").filter(~F.col("_has") | (F.col("unit") == preferred_unit))
    return rows.groupBy("question").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("value") * minutes[F.col("unit")]).alias("minutes"),
                                        F.count_distinct("source_group").alias("sources"))


def count_threshold(ledger: DataFrame, threshold: int) -> DataFrame:
    weak = F.col("exclude_reason").isNull() & (F.col("relevance") < threshold)
    return ledger.withColumn("exclude_reason", F.when(weak, "query_focus_mismatch").otherwise(F.col("exclude_reason")))


def distinct_counts(ledger: DataFrame) -> DataFrame:
    return included(ledger).groupBy("question").agg(F.count_distinct("identity").alias("items"), F.count_distinct("source_group").alias("sources"))


def distinct_items(ledger: DataFrame) -> DataFrame:
    """The counted items themselves, one row per (question, identity)."""
    return included(ledger).groupBy("question", "identity").agg(F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("mentions"))


def numeric_state(ledger: DataFrame) -> DataFrame:
    """Last stated total plus later increments; without a total, the sum of increments; first-to-last change.

    Totals are one map-side combined aggregate per question, joined back to add the increments after the last one.
    """
    rows = included(ledger).filter("kind = 'numeric_state'")
    total = F.col("include_reason") == "stated_total"
    ends = rows.groupBy("question").agg(
        F.max(F.when(total, F.col("ord"))).alias("last_ord"), F.max_by(F.when(total, F.col("value")), F.when(total, F.col("ord"))).alias("last_total"),
        F.min_by(F.when(total, F.col("value")), F.when(total, F.col("ord"))).alias("first_total"), F.count_if(total).alias("totals"))
    later = (rows.join(ends, "question").filter((F.col("include_reason") == "incremental_update") & (F.col("last_ord").isNull() | (F.col("ord") > F.col("last_ord"))))
             .groupBy("question").agg(F.sum("value").alias("increments"), F.count(F.lit(1)).alias("increment_rows")))
    out = ends.join(later, "question", "left").fillna(0, ["increments", "increment_rows"])
    return out.withColumn("answer", F.coalesce("last_total", F.lit(0)) + F.col("increments")).withColumn(
        "difference", F.when(F.col("totals") >= 2, F.col("last_total") - F.col("first_total"))).drop("last_ord")


def evidence_policy(requirements: DataFrame, evidence: DataFrame, text: str = "text") -> DataFrame:
    """Per profile and required term: is it met by some evidence row of the profile?"""
    found = evidence.select("profile", F.explode(F.array_distinct(long_words(F.col(text)))).alias("term")).distinct().withColumn("satisfied", F.lit(True))
    return requirements.join(found, ["profile", "term"], "left").fillna(False, ["satisfied"])


def slot_coverage(slots: DataFrame, ledger: DataFrame) -> DataFrame:
    """Slot (question, slot, kind, min_rows, min_groups) met by enough included rows from enough sources."""
    have = included(ledger).groupBy("question", "kind").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("source_group").alias("groups"))
    return slots.join(have, ["question", "kind"], "left").fillna(0, ["rows", "groups"]).withColumn(
        "covered", (F.col("rows") >= F.col("min_rows")) & (F.col("groups") >= F.col("min_groups")))


def derived_values(ledger: DataFrame) -> DataFrame:
    """Unit price = total / count, total = quantity x unit price, points value, from the best operand per kind."""
    best = included(ledger).filter(F.col("kind").isin("total", "count", "quantity", "unit_price", "points", "point_rate"))
    order = F.struct("relevance", (-F.col("ord")).alias("o"))
    operand = lambda k: F.max_by(F.when(F.col("kind") == k, F.col("value")), F.when(F.col("kind") == k, order)).alias(k)
    wide = best.groupBy("question").agg(*[operand(k) for k in ("total", "count", "quantity", "unit_price", "points", "point_rate")])
    money = lambda c: c.cast("decimal(28,4)")
    return wide.select(
        "question", F.round(money(F.col("total")) / F.when(F.col("count") != 0, F.col("count")), 4).cast("double").alias("unit_price"),
        (F.col("quantity") * F.col("unit_price")).alias("sales_total"), (F.col("points") * F.col("point_rate")).alias("points_value"))


def preference_profile(rows: DataFrame) -> DataFrame:
    """Per question: distinct preferences, sources and confidence min(.95, .56 + .1 min(n, 3) + .03 overlap)."""
    out = included(rows).groupBy("question").agg(F.count_distinct("identity").alias("preferences"), F.count_distinct("source_group").alias("sources"), F.max("relevance").alias("overlap"))
    return out.withColumn("confidence", F.round(F.least(F.lit(0.95), 0.56 + 0.1 * F.least("preferences", F.lit(3)) + 0.03 * F.col("overlap")), 4))


def _gaps(two: DataFrame, max_days: int) -> DataFrame:
    """Best pair score per (question, gap in days); days meet inside buckets of `max_days` + 1."""
    two = two.withColumn("_day", F.unix_date("event_date")).withColumn("_b", F.floor(F.col("_day") / (max_days + 1)))
    right = two.select("question", F.col("source_group").alias("_src2"), F.col("r").alias("_r2"), F.col("o").alias("_o2"), F.col("_day").alias("_d2"), "_b")
    left = two.withColumn("_b", F.explode(F.array(F.col("_b"), F.col("_b") + 1)))
    days = F.col("_d2") - F.col("_day")
    pairs = left.join(right, ["question", "_b"]).filter(days.between(1, max_days) & (F.col("source_group") != F.col("_src2")))
    return pairs.groupBy("question", days.alias("days")).agg(
        F.min(F.struct((F.col("r") + F.col("_r2")).alias("r"), (F.col("o") + F.col("_o2")).alias("o"))).alias("k"))


def date_intervals(ledger: DataFrame, max_days: int = 366, best: int = 5, pool: int = 256) -> DataFrame:
    """Best-scored pair of dated rows from different sources, 1 to `max_days` apart, per distinct gap; first `best` gaps.

    Only the two best sources of a date can take part in a best pair.  A question is first solved on its `pool`
    best rows; a row outside the pool cannot beat first row + last pool row, so if the last gap found is better than
    that bound the answer is final.  Only questions that fail the test meet all their dates.
    """
    rows = included(ledger).filter("event_date IS NOT NULL").groupBy("question", "event_date", "source_group").agg(
        F.min(F.struct((-F.col("relevance")).alias("r"), F.col("ord").alias("o"))).alias("s"))
    two = top_k(rows, ["question", "event_date"], [F.col("s"), F.col("source_group")], 2, out="_r").select(
        "question", "event_date", "source_group", "s", F.col("s.r").alias("r"), F.col("s.o").alias("o"))
    two = cut(two)
    near = cut(top_k(two, ["question"], [F.col("s"), F.col("source_group")], pool, out="_r"))
    order = [F.col("k"), F.col("days")]
    quick = cut(top_k(_gaps(near, max_days), ["question"], order, best))
    edge = near.groupBy("question").agg(F.min("s").alias("a"), F.max("s").alias("z"), F.count(F.lit(1)).alias("n"))
    last = quick.groupBy("question").agg(F.max("k").alias("k"), F.count(F.lit(1)).alias("found"))
    bound = F.struct((F.col("a.r") + F.col("z.r")).alias("r"), (F.col("a.o") + F.col("z.o")).alias("o"))
    done = edge.join(last, "question", "left").filter((F.col("n") < pool) | ((F.col("found") == best) & (F.col("k") < bound))).select("question")
    slow = top_k(_gaps(two.join(done, "question", "left_anti"), max_days), ["question"], order, best)
    ranked = quick.join(done, "question", "left_semi").unionByName(slow)
    return ranked.select("question", "rank", "days", F.when(F.col("days") % 7 == 0, F.col("days") / 7).cast("bigint").alias("weeks"), (-F.col("k.r")).alias("relevance"))


def temporal_sequence(ledger: DataFrame) -> DataFrame:
    """De-duplicated events in date order; `position` counts distinct dates, computed over the day table only."""
    from pyspark.sql import Window
    once = included(ledger).filter("event_date IS NOT NULL").groupBy("question", "identity").agg(
        F.min(F.struct("event_date", "ord")).alias("e")).select("question", "identity", F.col("e.event_date").alias("event_date"))
    days = once.select("question", "event_date").distinct().withColumn("position", F.row_number().over(Window.partitionBy("question").orderBy("event_date")))
    return once.join(days, ["question", "event_date"])


def most_recent_value(rows: DataFrame) -> DataFrame:
    return rows.groupBy("question").agg(F.min_by("value", F.struct("days_ago", "ord")).alias("value"), F.min("days_ago").alias("days_ago"))


def titled_durations(rows: DataFrame) -> DataFrame:
    """Quoted titles with start and finish dates: whole weeks each (rows: question, title, role, event_date, relevance, ord)."""
    order = F.struct("relevance", (-F.col("ord")).alias("o"))
    role = lambda r: F.max_by(F.when(F.col("role") == r, F.col("event_date")), F.when(F.col("role") == r, order)).alias(f"{r}_date")
    spans = rows.groupBy("question", "title").agg(role("start"), role("finish")).filter("start_date IS NOT NULL AND finish_date >= start_date")
    return spans.withColumn("weeks", F.floor(F.date_diff("finish_date", "start_date") / 7))


def titled_total(spans: DataFrame) -> DataFrame:
    return spans.groupBy("question").agg(F.count(F.lit(1)).alias("titles"), F.sum("weeks").alias("weeks"))


def missing_terms(queries: DataFrame, corpus: DataFrame, term: Column, key: str = "query_id") -> DataFrame:
    """Query terms that occur in no corpus row."""
    asked = queries.select(key, F.explode(term).alias("term"))
    known = corpus.select("term").distinct()
    return asked.join(known, "term", "left_anti").select(key, "term")
