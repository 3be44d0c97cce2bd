"""Event to bitemporal fact projection: extraction, versioning, edges and their audits."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ordered import neighbour, slice_of
from ..session import cut, kept
from .rules import BUILT_IN, Edge, Entity, Rule

_TEMPLATE = T.ArrayType(T.ArrayType(T.StringType()))
_ITEM = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("idx", T.IntegerType()), T.StructField("kind", T.StringType()),
    T.StructField("a", _TEMPLATE), T.StructField("b", _TEMPLATE), T.StructField("c", _TEMPLATE),
    T.StructField("parts", T.ArrayType(_TEMPLATE)), T.StructField("prop_keys", T.ArrayType(T.StringType())),
    T.StructField("prop_values", T.ArrayType(_TEMPLATE)), T.StructField("each", T.ArrayType(T.StringType())),
    T.StructField("inferred", T.BooleanType()), T.StructField("require", T.ArrayType(T.StringType())),
])
# payload keys whose nested keys a rule may read (fixed values)
_NESTED = ("source", "target", "purpose", "reverts", "evidence", "usage_counts", "handoff_event_ref", "support_packet",
           "answer_candidate")
# payload keys left out of a generic summary (fixed values)
_HIDDEN_KEYS = ("secret", "token", "password", "api_key", "access_token")
# in any case; the Kelvin sign is the one letter outside ASCII whose lower case lies inside
_HIDDEN = r"\A(?i:" + "|".join(_HIDDEN_KEYS).replace("k", r"[k\x{212A}]") + r")\z"

GENERIC = "*"


def _template(text: str | None) -> list[list[str]] | None:
    return None if text is None else [alt.split("+") for alt in text.split("|")]


def _generic_rule() -> Rule:
    from .rules import RETENTION, _name
    return Rule(GENERIC, (Entity(_name("'event:", "$type", "':", "$seq"), "'event",
                                 ("$actor", "'emitted", "$type", "$payload_summary"), RETENTION),))


class RuleBook:
    """Rules per event type: the built-in ones plus the caller's own, last registration wins."""

    def __init__(self, rules: Iterable[Rule] = BUILT_IN):
        self._rules = {rule.event_type: rule for rule in rules}
        self._frames: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, rule: Rule) -> None:
        self._frames.pop(rule.event_type, None)
        self._rules[rule.event_type] = rule

    def register_frame(self, event_type: str, fn: Callable[[DataFrame], DataFrame]) -> None:
        """Install a DataFrame function returning entity rows (see `entities`) for one event type."""
        self._rules[event_type] = Rule(event_type, ())
        self._frames[event_type] = fn

    @property
    def event_types(self) -> list[str]:
        return sorted(self._rules)

    def frames(self) -> dict[str, Callable[[DataFrame], DataFrame]]:
        return dict(self._frames)

    def items(self, spark: SparkSession) -> DataFrame:
        """The rules as a table; its size is the number of rules, not of rows."""
        rows = []
        for rule in (*self._rules.values(), _generic_rule()):
            for idx, item in enumerate(rule.items):
                if isinstance(item, Entity):
                    head = ("entity", _template(item.name), _template(item.type), None, [_template(s) for s in item.summary])
                    props, inferred = item.props, False
                else:
                    extra = [_template(t) for t in (item.confidence, item.method, item.valid_from, item.valid_to)]
                    head = ("edge", _template(item.source), _template(item.target), _template(item.relation), extra)
                    props, inferred = item.evidence, item.inferred
                rows.append((rule.event_type, idx, *head, list(props), [_template(v) for v in props.values()],
                             item.each.split("/") if item.each else None, inferred, list(rule.require)))
        return spark.createDataFrame(rows, _ITEM)


_PART = """CASE
  WHEN p LIKE "'%" THEN substring(p, 2)
  WHEN p LIKE '#%' THEN cast(json_array_length(ctx[substring(p, 2)]) AS string)
  WHEN p LIKE '~%' THEN CASE WHEN try_cast(ctx[substring(p, 2)] AS double) IS NOT NULL
       THEN cast(least(1D, greatest(0D, try_cast(ctx[substring(p, 2)] AS double))) AS string) END
  WHEN p LIKE '^%' THEN CASE WHEN try_cast(ctx[substring(p, 2)] AS bigint) > 0
       THEN cast(try_cast(ctx[substring(p, 2)] AS bigint) AS string) END
  ELSE get(filter(array(trim(ctx[p])), v -> v <> ''), 0) END"""  # nullif would look the key up twice


def _pick(template: str) -> str:
    """SQL text of the first complete alternative of a template column; later alternatives are not evaluated."""
    text = f"aggregate(alt, '', (acc, p) -> CASE WHEN acc IS NOT NULL THEN concat(acc, {_PART}) END)"
    return f"aggregate({template}, CAST(NULL AS STRING), (found, alt) -> CASE WHEN found IS NOT NULL THEN found ELSE {text} END)"


def _prefixed(fields: Column, prefix: str) -> Column:
    """A map with a prefix on its keys; an empty map for null."""
    return F.coalesce(F.transform_keys(fields, lambda k, _v: F.concat(F.lit(prefix), k)), F.create_map().cast("map<string,string>"))


def _context(events: DataFrame, generic: Column) -> DataFrame:
    """Events with `ctx`, the one map every template reads; the generic summary is built only for `generic` rows."""
    top = F.from_json("payload", "map<string,string>")
    out = events.withColumn("_top", F.coalesce(top, F.create_map().cast("map<string,string>")))
    nested = [_prefixed(F.from_json(F.col("_top")[key], "map<string,string>"), key + ".") for key in _NESTED]
    texts = F.transform(
        F.filter(F.array_sort(F.map_entries("_top")),
                 lambda e: ~e["key"].rlike(_HIDDEN) & (F.trim(e["value"]) != "") & ~e["value"].startswith("{")),
        lambda e: F.when(e["value"].startswith("["), F.array_join(F.from_json(e["value"], "array<string>"), " "))
        .otherwise(F.concat(e["key"], F.lit("="), F.trim(e["value"]))))
    review = (F.when(F.col("_top")["decision"] == "accepted", "active").when(F.col("_top")["decision"] == "rejected", "rejected")
              .when(F.col("_top")["decision"] == "deferred", "deferred").otherwise("pending"))
    candidate = F.from_json(F.col("_top")["answer_candidate"], "answer string, rank string, type string")
    reviewed = F.from_json(F.col("_top")["reverts"], "event_type string, candidate_id string, to_status string")
    envelope = F.map_from_entries(F.filter(F.array(*[
        F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in {
            "$seq": F.col("seq"), "$type": F.col("type"), "$actor": F.col("actor"), "$thread": F.col("session"),
            "$timestamp": F.col("ts_us"), "$payload_summary": F.when(generic, F.array_join(texts, " ")), "$review_state": review,
            "$ref": F.concat(F.lit("log://"), "session", F.lit("/events/"), F.col("seq").cast("string"), F.lit("#"), "hash"),
            "$candidate_digest": F.substring(F.sha2(F.to_json(candidate, {"ignoreNullFields": "false"}), 256), 1, 16),
            "reverts.review_candidate_id": F.when((reviewed["event_type"] == "consolidation.candidate.reviewed")
                                                  & reviewed["to_status"].isNotNull(), reviewed["candidate_id"]),
        }.items()]), lambda e: e["value"].isNotNull()))
    return out.withColumn("ctx", F.map_concat(envelope, "_top", *nested)).drop("_top")


def _expand(events: DataFrame, book: RuleBook) -> DataFrame:
    """Join each event to the rule items of its type, with list-driven items exploded."""
    spark = events.sparkSession
    known = F.col("type").isin(*book.event_types)
    keyed = _context(events, ~known).withColumn("_rule", F.when(known, F.col("type")).otherwise(F.lit(GENERIC)))
    items = book.items(spark).withColumnRenamed("type", "_rule")
    rows = keyed.join(F.broadcast(items), "_rule")
    ok = F.forall("require", lambda r: F.when(
        F.contains(r, F.lit("=")), F.col("ctx")[F.substring_index(r, "=", 1)] == F.substring_index(r, "=", -1)
    ).otherwise(F.trim(F.col("ctx")[r]) != ""))
    rows = rows.filter(F.coalesce(ok, F.lit(False)))
    listed = F.from_json(F.col("ctx")[F.col("each")[0]], "array<string>")
    rows = rows.withColumn("_el", F.explode(F.when(F.col("each").isNull(), F.array(F.lit(None).cast("string"))).otherwise(listed)))
    # parsed once; a list's plain strings are no objects, and the parser would raise and drop an error for each
    rows = rows.withColumn("_fields", F.when(F.col("_el").rlike(r"\A\s*\{"), F.from_json("_el", "map<string,string>")))
    fields = F.col("_fields")
    inner = F.from_json(fields[F.get("each", F.lit(1))], "array<string>")
    rows = rows.withColumn("_sub", F.explode(
        F.when(F.size("each") > 1, inner).otherwise(F.array(F.lit(None).cast("string")))))
    digest = F.substring(F.sha2(F.to_json(F.from_json("_el", "answer string, rank string, type string"),
                                          {"ignoreNullFields": "false"}), 256), 1, 16)
    element = F.map_concat(
        _prefixed(fields, "@"),
        F.create_map(F.lit("@"), F.when(fields.isNull(), F.col("_el")), F.lit("@support"), F.col("_sub"),
                     F.lit("@digest"), digest,
                     F.lit("@citation_digest"), F.substring(F.sha2(fields["citation"], 256), 1, 16)))
    return rows.withColumn("ctx", F.when(F.col("each").isNull(), F.col("ctx")).otherwise(F.map_concat("ctx", element)))


_PROPS = ("map_from_entries(filter(transform(arrays_zip(prop_keys, prop_values), kv -> struct(kv.prop_keys AS key, "
          + _pick("kv.prop_values") + " AS value)), e -> e.value IS NOT NULL AND e.value <> '[]'))")
_SUMMARY = ("nullif(array_join(filter(transform(parts, t -> " + _pick("t") + "), v -> v IS NOT NULL AND v <> ''), ' '), '')")


def extract(events: DataFrame, book: RuleBook | None = None) -> DataFrame:
    """All extracted items, one row each, from one scan of the log.

    Events need (session, seq, ts_us, type, actor, payload, hash).  `kind` is entity or edge.
    """
    book = book or RuleBook()
    rows = _expand(events, book)
    texts = F.struct(
        F.expr(_pick("a")).alias("name"), F.expr(_pick("b")).alias("second"), F.expr(_pick("c")).alias("relation"),
        F.when(F.col("kind") == "entity", F.expr(_SUMMARY)).alias("_summary"),
        F.when(F.col("kind") == "edge", F.expr(f"transform(parts, t -> {_pick('t')})")).alias("_edge"),
        F.expr(_PROPS).alias("props"))
    # a plain filter would be moved below the templates and fill in the names twice, as would the callers' filters on what comes out
    whole = F.filter(F.array(texts), lambda t: t["name"].isNotNull() & t["second"].isNotNull())
    return rows.select("session", "seq", "idx", "ts_us", F.col("hash").alias("source_hash"), "kind", "inferred", F.inline(whole))


def flatten_list_text(text: Column) -> Column:
    """A summary part that is a JSON list counts as its items."""
    return F.when(text.startswith("["), F.coalesce(F.array_join(F.from_json(text, "array<string>"), " "), text)).otherwise(text)


def _entity_rows(items: DataFrame) -> DataFrame:
    return items.filter("kind = 'entity'").select(
        "session", "seq", "idx", "ts_us", "source_hash", "name", F.col("second").alias("entity_type"),
        flatten_list_text(F.col("_summary")).alias("summary"), "props")


def _edge_rows(items: DataFrame) -> DataFrame:
    part = F.col("_edge")
    return items.filter("kind = 'edge' AND relation IS NOT NULL").select(
        "session", "seq", "idx", "source_hash", F.col("name").alias("source"), F.col("second").alias("target"), "relation",
        F.coalesce(part[2].try_cast("bigint"), F.col("ts_us")).alias("valid_from"),
        part[3].try_cast("bigint").alias("valid_to"), "inferred", part[0].cast("double").alias("confidence"),
        part[1].alias("method"), F.col("props").alias("evidence"),
    ).filter("confidence BETWEEN 0 AND 1")


def _with_frames(built: DataFrame, events: DataFrame, book: RuleBook) -> DataFrame:
    for event_type, fn in book.frames().items():
        built = built.unionByName(fn(events.filter(F.col("type") == event_type)))
    return built


def entities(events: DataFrame, book: RuleBook | None = None) -> DataFrame:
    """Entity assertions (session, seq, idx, ts_us, source_hash, name, entity_type, summary, props)."""
    book = book or RuleBook()
    return _with_frames(_entity_rows(extract(events, book)), events, book)


def edges(events: DataFrame, book: RuleBook | None = None) -> DataFrame:
    """Edge assertions with endpoint types, validity and inference metadata."""
    return _edge_rows(extract(events, book))


def entities_and_edges(events: DataFrame, book: RuleBook | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables from one extraction, written once to the checkpoint folder."""
    book = book or RuleBook()
    items = cut(extract(events, book))
    return _with_frames(_entity_rows(items), events, book), _edge_rows(items)


# ---------------------------------------------------------------------------------------------------------------------
# versions

_KEY = ("session", "entity_type", "name")


def props_text(props: Column) -> Column:
    """Canonical text of a property map (sorted keys)."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(props)),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def points(assertions: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """What each event says of a key: the key, seq, ts_us, source_hash, summary, props_text, gone (a tombstone)."""
    last = F.max_by(F.struct("ts_us", "source_hash", "summary", "props_text"), "idx")
    rows = (
        assertions.withColumn("props_text", props_text(F.col("props")))
        .groupBy(*_KEY, "seq").agg(last.alias("s"))
        .select(*_KEY, "seq", "s.*", F.lit(False).alias("gone"))
    )
    if tombstones is not None:
        rows = rows.unionByName(
            tombstones.select(*_KEY, "seq", "ts_us", F.lit(True).alias("gone")), allowMissingColumns=True)
    return rows


def changes(rows: DataFrame) -> DataFrame:
    """Points with `changed` (not a repetition of the active state)."""
    state = F.when(~F.col("gone"), F.struct("summary", "props_text"))
    # each neighbour pass reads its input twice, so extraction and the first pass are stored instead of run again
    rows = kept(rows if "_slice" in rows.columns else rows.withColumn("_slice", slice_of("seq")), "sliced")
    rows = neighbour(rows, _KEY, ["seq", "gone"], state, "_prev")
    return rows.withColumn("changed", F.col("gone") | F.col("_prev").isNull() | ~F.col("_prev").eqNullSafe(state)).drop("_prev")


def versions(assertions: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """SCD-2 history per (session, entity_type, name) ordered by seq.

    An assertion equal to the *active* state is a no-op.  A tombstone (key, seq, ts_us) closes the open
    window, and the same state asserted after it opens a new one, because tombstones take part in the
    ordered sequence before states are compared.
    """
    found = cut(changes(points(assertions, tombstones)).filter("changed").drop("changed"))
    found = neighbour(found, _KEY, ["seq", "gone"], F.col("ts_us"), "valid_to", forward=True)
    return found.filter("NOT gone").select(
        *_KEY, "summary", "props_text", F.col("ts_us").alias("valid_from"), "valid_to",
        F.col("seq").alias("source_seq"), "source_hash")


def as_of(rows: DataFrame, t: Column | int | None = None) -> DataFrame:
    """Rows valid at `t` (half-open windows, null end is open); with no `t`, the open rows."""
    if t is None:
        return rows.filter("valid_to IS NULL")
    point = t if isinstance(t, Column) else F.lit(t)
    return rows.filter((F.col("valid_from") <= point) & (F.col("valid_to").isNull() | (point < F.col("valid_to"))))


def as_of_seq(rows: DataFrame, seq: int, column: str = "source_seq") -> DataFrame:
    return rows.filter(F.col(column).isNull() | (F.col(column) <= seq))


def invalidate(history: DataFrame, targets: DataFrame) -> DataFrame:
    """Close open windows named by `targets` (session, entity_type, name, invalid_at)."""
    return (
        history.join(targets.groupBy(*_KEY).agg(F.min("invalid_at").alias("_at")), list(_KEY), "left")
        .withColumn("valid_to", F.when(F.col("valid_to").isNull(), F.col("_at")).otherwise(F.col("valid_to"))).drop("_at"))


def retire_source(history: DataFrame, edge_table: DataFrame, retired: DataFrame, path_of: Column) -> tuple[DataFrame, DataFrame]:
    """Close open entities referencing a retired source path and open edges touching such an entity.

    `retired` holds (session, path, invalid_at); `path_of` reads the path from a history row.
    """
    paths = retired.groupBy("session", "path").agg(F.min("invalid_at").alias("_at"))
    closed = (
        history.withColumn("path", path_of).join(paths, ["session", "path"], "left")
        .withColumn("_hit", F.col("valid_to").isNull() & F.col("_at").isNotNull())
        .withColumn("valid_to", F.when(F.col("_hit"), F.col("_at")).otherwise(F.col("valid_to"))))
    gone = closed.filter("_hit").groupBy("session", "entity_type", F.col("name").alias("_n")).agg(F.min("_at").alias("_t"))
    out = edge_table
    for end in ("source", "target"):
        side = gone.select("session", F.col("entity_type").alias(f"{end}_type"), F.col("_n").alias(end), F.col("_t").alias(f"_{end}_at"))
        out = out.join(side, ["session", f"{end}_type", end], "left")
    at = F.least("_source_at", "_target_at")
    out = out.withColumn("valid_to", F.when(F.col("valid_to").isNull(), at).otherwise(F.col("valid_to")))
    return closed.drop("_hit", "_at", "path"), out.drop("_source_at", "_target_at")


def typed_edges(edge_rows: DataFrame, assertions: DataFrame) -> DataFrame:
    """Edges with endpoint types taken from the same event's entities; an edge lacking an endpoint is dropped."""
    kinds = assertions.groupBy("session", "seq", "name").agg(F.max_by("entity_type", "idx").alias("kind"))
    out = edge_rows
    for end in ("source", "target"):
        side = kinds.select("session", "seq", F.col("name").alias(end), F.col("kind").alias(f"{end}_type"))
        out = out.join(side, ["session", "seq", end])
    return out


def upsert_edges(edge_rows: DataFrame) -> DataFrame:
    """Last writer per (session, source, relation, target).

    Edges reference logical entities, not versions, so an edge follows its endpoints to their next version
    without any copy; `edges_as_of` tests both ends' windows.
    """
    key = ["session", "source_type", "source", "relation", "target_type", "target"]
    rest = ["valid_from", "valid_to", "inferred", "confidence", "method", "seq", "source_hash"]
    return (edge_rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("seq", "idx")).alias("s"))
            .select(*key, "s.*").withColumnRenamed("seq", "source_seq"))


def edges_as_of(edge_table: DataFrame, history: DataFrame, t: int | None = None) -> DataFrame:
    """Edges valid at `t` whose source and target versions are valid at `t`, with both summaries."""
    live = as_of(history, t).select("session", "entity_type", "name", "summary", "source_seq")
    out = as_of(edge_table, t).drop("source_seq", "source_hash")
    for end in ("source", "target"):
        side = live.select("session", F.col("entity_type").alias(f"{end}_type"), F.col("name").alias(end),
                           F.col("summary").alias(f"{end}_summary"), F.col("source_seq").alias(f"{end}_seq"))
        out = out.join(side, ["session", f"{end}_type", end])
    return out


# ---------------------------------------------------------------------------------------------------------------------
# inferred edges

_CITED = ("taskId string, task_id string, task string, decision string, decision_name string, decision_event_seq string, "
          "decision_event_hash string, source struct<name:string,entity_type:string>, target struct<name:string,entity_type:string>, "
          "cause struct<name:string,entity_type:string>, effect struct<name:string,entity_type:string>, relation_type string, "
          "valid_from string, original_event_seq string, original_event_hash string, reason string, confidence string, "
          "evidence struct<source_event_seq:string,source_event_hash:string,reason:string>")


def _text(path: str) -> Column:
    return F.nullif(F.trim(F.col(f"_p.{path}")), F.lit(""))


def _first(*paths: str) -> Column:
    return F.coalesce(*[_text(p) for p in paths])


def _positive(path: str) -> Column:
    value = _text(path).try_cast("bigint")
    return F.when(value > 0, value)


def _digest(path: str) -> Column:
    value = _text(path)
    return F.when(value.rlike("^[0-9a-f]{64}$"), value)


# relation names a causal edge may carry (fixed values)
CAUSAL_RELATIONS = ("caused", "enabled", "blocked", "prevented", "regressed", "fixed", "explained")
_INFERRED = ["session", "seq", "hash", "event_type", "source", "source_type", "target", "target_type", "relation",
             "confidence", "method", "valid_from", "valid_to", "cited_seq", "cited_hash", "reason"]


def inferred_edge_events(events: DataFrame, task_confidence: float = 0.86,
                         causal_relations: tuple[str, ...] = CAUSAL_RELATIONS) -> DataFrame:
    """Edges derived only from explicit cited references, one narrow pass over three event types."""
    done, wrong, outcome = "task.completed", "inference.edge.contradicted", "outcome.explained"
    kind = F.col("type")

    def by(task: Column, contradiction: Column, cause: Column) -> Column:
        return F.when(kind == done, task).when(kind == wrong, contradiction).when(kind == outcome, cause)

    out = events.filter(kind.isin(done, wrong, outcome)).withColumn("_p", F.from_json("payload", _CITED)).select(
        "session", "seq", "hash",
        by(F.lit("inference.edge.generated"), F.lit("inference.edge.retracted"), F.lit("causal.edge.generated")).alias("event_type"),
        by(_first("taskId", "task_id", "task"), _text("source.name"), _text("cause.name")).alias("source"),
        by(F.lit("task"), _text("source.entity_type"), _text("cause.entity_type")).alias("source_type"),
        by(_first("decision", "decision_name"), _text("target.name"), _text("effect.name")).alias("target"),
        by(F.lit("decision"), _text("target.entity_type"), _text("effect.entity_type")).alias("target_type"),
        by(F.lit("likely_implemented_decision"), _text("relation_type"),
           F.when(_text("relation_type").isin(*causal_relations), _text("relation_type"))).alias("relation"),
        by(F.lit(task_confidence), F.lit(0.0), F.when(_text("confidence").try_cast("double").between(0, 1),
                                                       _text("confidence").try_cast("double"))).alias("confidence"),
        by(F.lit("task_completed_decision_citation_v1"), F.lit("contradicting_evidence_retraction_v1"), F.lit("explicit_outcome_explanation_v1")).alias("method"),
        by(F.col("ts_us").cast("string"), _text("valid_from"), F.col("ts_us").cast("string")).alias("valid_from"),
        F.when(kind == wrong, F.col("ts_us")).alias("valid_to"),
        by(_positive("decision_event_seq"), _positive("original_event_seq"), _positive("evidence.source_event_seq")).alias("cited_seq"),
        by(_digest("decision_event_hash"), _digest("original_event_hash"), _digest("evidence.source_event_hash")).alias("cited_hash"),
        by(F.lit("completion cites a decision event"), _text("reason"),
           F.coalesce(_text("evidence.reason"), F.lit("outcome cites its evidence"))).alias("reason"),
    )
    return out.dropna(subset=["source", "source_type", "target", "target_type", "relation", "confidence", "valid_from",
                              "cited_seq", "cited_hash", "reason"]).select(*_INFERRED)


def close_retracted(edge_rows: DataFrame, retractions: DataFrame) -> DataFrame:
    """Close generated edges named by a retraction on (session, source, relation, target, valid_from)."""
    key = ["session", "source", "relation", "target", "valid_from"]
    ends = retractions.groupBy(*key).agg(F.min("valid_to").alias("_end"))
    return edge_rows.join(ends, key, "left").withColumn("valid_to", F.coalesce("valid_to", "_end")).drop("_end")


def projection_status(log: DataFrame, projected: DataFrame) -> DataFrame:
    """Per session: projected count, latest seq and hash against the log, missing and expected chain links."""
    head = lambda rows, p: rows.groupBy("session").agg(
        F.count(F.lit(1)).alias(f"{p}_events"), F.max("seq").alias(f"{p}_seq"), F.max_by("hash", "seq").alias(f"{p}_hash"))
    missing = (
        projected.filter("prev_hash IS NOT NULL")
        .join(projected.select("session", F.col("hash").alias("prev_hash")), ["session", "prev_hash"], "left_anti")
        .groupBy("session").agg(F.count(F.lit(1)).alias("missing_links")))
    return (
        head(log, "log").join(head(projected, "projected"), "session", "left").join(missing, "session", "left")
        .select("session", "log_events", F.coalesce("projected_events", F.lit(0)).alias("projected_events"),
                (F.col("log_seq") - F.coalesce("projected_seq", F.lit(0))).alias("lag"),
                F.col("log_hash").eqNullSafe(F.col("projected_hash")).alias("current"),
                F.greatest(F.coalesce("projected_events", F.lit(0)) - 1, F.lit(0)).alias("expected_links"),
                F.coalesce("missing_links", F.lit(0)).alias("missing_links")))


def inferred_edge_audit(edge_table: DataFrame) -> DataFrame:
    """Per method: edges, mean and lowest confidence, relation types, evidence coverage."""
    return edge_table.filter("inferred").groupBy("method").agg(
        F.count(F.lit(1)).alias("edges"), F.avg("confidence").alias("mean_confidence"), F.min("confidence").alias("min_confidence"),
        F.array_join(F.array_sort(F.collect_set("relation")), ",").alias("relations"),
        F.avg(F.when(F.col("cited_hash").isNotNull(), 1.0).otherwise(0.0)).alias("evidence_coverage"))
