"""Lookups and resolution joins over log, fact and code tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ordered import carry_forward, slice_of, top_k

CITATION = r"log://([^/\s]+)/events/(\d+)#([0-9a-f]{12,64})"


def exact_lookup(queries: DataFrame, entities: DataFrame, limit: int | None = None) -> DataFrame:
    """Entities whose name (and type, if the query gives one) equals the query's, newest first.

    Queries: query_id, name, entity_type (nullable).
    """
    q = queries.select("query_id", "name", F.col("entity_type").alias("_want"))
    hits = q.join(entities, "name").filter("_want IS NULL OR _want = entity_type").drop("_want")
    if limit is not None:
        hits = top_k(hits, ["query_id"], [F.desc("valid_from"), F.col("session"), F.col("entity_type"), F.desc("source_seq")], limit)
    return hits


def previous_event(log: DataFrame) -> DataFrame:
    """Link each event to the event whose hash it names, by (session, prev_hash)."""
    before = log.select("session", F.col("hash").alias("prev_hash"), F.col("seq").alias("previous_seq"))
    return log.join(before, ["session", "prev_hash"], "left")


def resolve_citations(citations: DataFrame, events: DataFrame, column: str = "citation") -> DataFrame:
    """Events named by `log://session/events/seq#hash` texts; the hash may be a 12-character or longer fragment."""
    part = lambda i: F.regexp_extract(column, CITATION, i)
    parsed = citations.withColumns({"session": part(1), "seq": part(2).try_cast("bigint"), "_frag": part(3)})
    hits = parsed.join(events.select("session", "seq", "hash", "type"), ["session", "seq"], "left")
    ok = F.startswith(F.coalesce("hash", F.lit("")), F.col("_frag")) & (F.col("_frag") != "")
    return hits.withColumns({"resolved": ok, "type": F.when(ok, F.col("type"))}).drop("_frag", "hash")


# span kinds by event type (fixed values)
SPAN_KINDS = {"coordination.mission.created": "mission", "coordination.finding.reported": "finding", "coordination.finding.reviewed": "review",
              "coordination.finding.promoted": "promotion", "coordination.handoff.created": "handoff", "memory.checkout.completed": "checkout",
              "model.call.requested": "model_call", "tool.call.completed": "tool_call", "transcript.turn": "transcript"}


def trace_spans(events: DataFrame) -> DataFrame:
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in SPAN_KINDS.items() for x in kv])[F.col("type")],
                      F.when(F.col("type").startswith("coordination."), "coordination").otherwise("event"))
    return events.withColumns({"span_id": F.format_string("event:%s:%d", F.col("session"), F.col("seq")), "kind": kind})


def trace_edges(events: DataFrame) -> DataFrame:
    """Edges contains, observed_tool_call, responded_with, reviews and promotes between spans.

    Events: session, seq, ts_us, type, mission_id, finding_id.  The model call of a tool call or turn is the
    latest earlier one of the session; mission and finding spans are the latest created before the event.
    """
    spans = trace_spans(events).withColumn("at", F.struct("ts_us", "session", "seq"))
    calls = spans.withColumn("_slice", slice_of("seq"))
    calls = carry_forward(calls, ["session"], ["seq"], F.when(F.col("kind") == "model_call", F.col("span_id")), "model_span")
    after_call = calls.filter("kind IN ('tool_call', 'transcript') AND model_span IS NOT NULL").select(
        F.col("model_span").alias("source"), F.col("span_id").alias("target"),
        F.when(F.col("kind") == "tool_call", "observed_tool_call").otherwise("responded_with").alias("relation"))

    def latest_before(rows: DataFrame, made: DataFrame, key: str) -> DataFrame:
        """Latest span of `made` with the same key that precedes each row; a key is created once or a few times."""
        hits = rows.join(made, key).filter(F.col("made_at") < F.col("at"))
        return hits.groupBy("span_id", "kind").agg(F.max_by("made_span", "made_at").alias("made_span"))

    missions = spans.filter("kind = 'mission' AND mission_id IS NOT NULL").select(
        F.col("mission_id").alias("key"), F.col("at").alias("made_at"), F.col("span_id").alias("made_span"))
    rows = spans.filter("kind <> 'mission'")
    by_id = latest_before(rows.withColumn("key", F.col("mission_id")), missions, "key")
    by_session = latest_before(rows.withColumn("key", F.col("session")), missions, "key")
    contains = by_id.unionByName(by_session.join(by_id.select("span_id"), "span_id", "left_anti")).select(
        F.col("made_span").alias("source"), F.col("span_id").alias("target"), F.lit("contains").alias("relation"))

    findings = spans.filter("kind = 'finding' AND finding_id IS NOT NULL").select(
        F.col("finding_id").alias("key"), F.col("at").alias("made_at"), F.col("span_id").alias("made_span"))
    judged = latest_before(spans.filter("kind IN ('review', 'promotion')").withColumn("key", F.col("finding_id")), findings, "key").select(
        F.col("span_id").alias("source"), F.col("made_span").alias("target"),
        F.when(F.col("kind") == "review", "reviews").otherwise("promotes").alias("relation"))
    return after_call.unionByName(contains).unionByName(judged).distinct()


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Module name to the first existing candidate path: plain, package init, then both under src/.

    Imports: path, module, line; a module starting with `.` is relative to the importing file's folder.
    """
    folder = F.regexp_replace("path", "/[^/]+$", "")
    plain = F.translate(F.col("module"), ".", "/")
    base = F.when(F.col("module").startswith("."), F.concat(folder, F.lit("/"), F.translate(F.ltrim(F.lit("."), F.col("module")), ".", "/"))).otherwise(plain)
    paths = F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")),
                    F.concat(F.lit("src/"), base, F.lit(".py")), F.concat(F.lit("src/"), base, F.lit("/__init__.py")))
    wanted = imports.select("module", folder.alias("_f"), paths.alias("_paths")).filter("module IS NOT NULL")
    # one lookup per distinct candidate list, not per import row
    lists = wanted.select("_paths").distinct().select("_paths", F.posexplode("_paths").alias("_rank", "target_path"))
    found = lists.join(files.select(F.col("path").alias("target_path")).distinct(), "target_path").groupBy("_paths").agg(
        F.min_by("target_path", "_rank").alias("target_path"), F.min("_rank").alias("_rank"))
    how = F.when(F.col("_rank") < 2, "module").when(F.col("_rank") >= 2, "src_module").otherwise("unresolved")
    return imports.withColumn("_paths", paths).join(found, "_paths", "left").withColumn("resolution", how).drop("_paths", "_rank")


def resolve_calls(calls: DataFrame, symbols: DataFrame, imported: DataFrame) -> DataFrame:
    """Call to symbol: same file by full then short name, then imported by full then short name.

    Calls: path, callee, line, ...; symbols: path, name, qualified_name; imported: path, name, target_path, target_name.
    Both lookups are folded to one row per (path, name), so a call row is never multiplied.
    """
    same = symbols.select("path", "name", F.struct("path", F.col("qualified_name").alias("name")).alias("same"))
    other = imported.select("path", "name", F.struct(F.col("target_path").alias("path"), F.col("target_name").alias("name")).alias("other"))
    both = same.unionByName(other, allowMissingColumns=True).groupBy("path", "name").agg(F.min("same").alias("same"), F.min("other").alias("other"))
    full = both.select("path", F.col("name").alias("callee"), F.col("same").alias("_s1"), F.col("other").alias("_o1"))
    short = both.select("path", F.col("name").alias("_short"), F.col("same").alias("_s2"), F.col("other").alias("_o2"))
    rows = calls.withColumn("_short", F.substring_index("callee", ".", -1)).join(full, ["path", "callee"], "left").join(short, ["path", "_short"], "left")
    target = F.coalesce("_s1", "_s2", "_o1", "_o2")
    how = F.when(F.coalesce("_s1", "_s2").isNotNull(), "same_file_symbol").when(target.isNotNull(), "imported_symbol").otherwise("unresolved")
    return rows.withColumns({"target_path": target["path"], "target_name": target["name"], "resolution": how}).drop(
        "_short", "_s1", "_s2", "_o1", "_o2")


def coverage_links(test_calls: DataFrame, imported: DataFrame) -> DataFrame:
    """Calls made in tests to imported symbols, distinct by (test path, target path, symbol, line)."""
    hits = test_calls.withColumn("name", F.substring_index("callee", ".", -1)).join(imported, ["path", "name"])
    return hits.select("path", "target_path", "target_name", "line").distinct()


def resolve_refs(updates: DataFrame) -> DataFrame:
    """Latest target per ref name (updates: name, seq, session, target_seq, target_hash)."""
    return updates.groupBy("name").agg(F.max_by(F.struct("session", "target_seq", "target_hash"), "seq").alias("t")).select("name", "t.*")


def events_at_ref(log: DataFrame, refs: DataFrame) -> DataFrame:
    """Events visible at each ref: same session, seq not after the ref's target."""
    return log.join(refs.select("name", "session", "target_seq"), "session").filter("seq <= target_seq")


ALIAS = r"(?i:\bmy)\s+([a-z]+)(?:,|\s+(?i:named|called))?\s+([A-Z][A-Za-z0-9]+)"


def possessive_aliases(texts: DataFrame, text: str = "text") -> DataFrame:
    """(target, alias) introduced as `my dog Rex`, `my dog named Rex`, `my dog, Rex`."""
    found = F.explode(F.regexp_extract_all(text, F.lit(ALIAS), 0))
    return texts.withColumn("_m", found).select(
        *[c for c in texts.columns if c != text], F.lower(F.regexp_extract("_m", ALIAS, 1)).alias("target"),
        F.regexp_extract("_m", ALIAS, 2).alias("alias"))


def bridge_queries(queries: DataFrame, aliases: DataFrame, limit: int = 3) -> DataFrame:
    """Queries naming a possessive target widened by the target's first `limit` aliases.

    Aliases: session, seq, target, alias.  Each (session, target) is cut to its first aliases before the join.
    """
    first = aliases.groupBy("session", "target", F.lower("alias").alias("_key")).agg(F.min(F.struct("seq", "alias")).alias("a"))
    kept = top_k(first.select("session", "target", "a.*"), ["session", "target"], [F.col("seq"), F.col("alias")], limit, out="_r")
    want = queries.select("*", F.lower(F.regexp_extract("query", r"(?i)\bmy ([a-z]+)", 1)).alias("target"))
    names = kept.groupBy("session", "target").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "alias"))), lambda x: x["alias"]), " ").alias("_names"))
    out = want.join(names, ["session", "target"], "left")
    return out.withColumn("widened", F.concat_ws(" ", "query", "_names")).withColumn("aliases", F.coalesce("_names", F.lit(""))).drop("_names")
