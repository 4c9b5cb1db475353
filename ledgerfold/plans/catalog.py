"""The registered queries: each takes (spark, folder of tables) and gives a frame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.functions import codecs, validation
from ledgerfold.operators import admission, custom, fold, gate, journal, replies, search, service, state
from ledgerfold.operators.cells import uncut
from ledgerfold.operators.specs import DEPARTMENT, USER
from ledgerfold.schemas import DEPARTMENT_JOURNAL, USER_JOURNAL, USER_VIEW
from ledgerfold.session import stored, work_path
from ledgerfold.sources import derived, topics
from ledgerfold.sources.lookup import Completions, Postings
from ledgerfold.sources.pages import SortedHits
from ledgerfold.sources.store import ViewSearch, ViewStore, read_journal, read_snapshots, write_journal, write_snapshots
from ledgerfold.sources.tables import SCHEMAS, stream_files, table, write_in_time_order
from ledgerfold.streaming import gate as streaming_gate
from ledgerfold.streaming import keyed
from ledgerfold.streaming import views as streaming_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CUT = "2024-01-16 00:00:00"
SNAPSHOT_EVERY = 20
RANK_QUERY = "the par und"
ALL_QUERY = "the and with"
PHRASE = "of the"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _stamp(name: str, alias: str | None = None) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(alias or name)


def _address(prefix: str = "address") -> list[Column]:
    return [F.col(f"{prefix}.{n}").alias(n) for n in ("street", "number", "zip", "city", "state", "country")]


def _department() -> Column:
    return F.col("department.id").alias("department_id")


def _user_rows(rows: DataFrame, *extra: str) -> DataFrame:
    return rows.select(*extra, "id", "username", "email", *_address(), _department())


def _events(rows: DataFrame) -> DataFrame:
    return rows.select(
        "entity_id", "seq_nr", _stamp("ts"), "kind", "username", "email", *_address(), _department(), "tag", "timebucket"
    )


def _user_journal(spark: SparkSession, folder: str) -> DataFrame:
    return derived.user_journal(spark, folder)


def _planned(spark: SparkSession, folder: str):
    return derived.planned_user_journal(spark, folder)


def _user_view(spark: SparkSession, folder: str) -> DataFrame:
    return fold.view_fold(_user_journal(spark, folder), USER)


def _department_view(spark: SparkSession, folder: str) -> DataFrame:
    return fold.view_fold(derived.department_journal(spark, folder), DEPARTMENT)


def _user_commands(spark: SparkSession, folder: str) -> DataFrame:
    return derived.user_commands(table(spark, folder, "events"))


def _department_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return gate.department_gate(derived.department_commands(table(spark, folder, "orders")))


def _lifecycle(spark: SparkSession, folder: str) -> DataFrame:
    """Department lifecycle events, written out first: the user gate reads them several
    times, as it would read a department journal."""
    return stored(gate.lifecycle_events(gate.events(_department_decisions(spark, folder), gate.DEPARTMENT_GATE)), "departments")


def _user_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return gate.user_gate(_user_commands(spark, folder), _lifecycle(spark, folder))


# Journal relations


@query
def journal_scan(spark, folder):
    return _events(_user_journal(spark, folder))


@query
def department_journal_scan(spark, folder):
    rows = derived.department_journal(spark, folder)
    return rows.select("entity_id", "seq_nr", _stamp("ts"), "kind", "name", "description", "tag", "timebucket")


@query
def events_by_entity(spark, folder):
    return _events(journal.by_entity(_user_journal(spark, folder), USER, "42", from_seq=5))


@query
def events_by_tag(spark, folder):
    return _events(journal.by_tag(_user_journal(spark, folder), "UserEvent1"))


@query
def events_from_offset(spark, folder):
    """Resume every entity at its last event of the first half; the rest starts at 0."""
    rows, plan = _planned(spark, folder)
    offsets = rows.filter(F.col("ts") < F.lit(CUT).cast("timestamp_ntz")).groupBy("entity_id").agg(F.max("seq_nr").alias("offset"))
    return _events(journal.from_offsets(rows, offsets, plan))


@query
def events_since_bucket(spark, folder):
    return _events(journal.since(_user_journal(spark, folder), "20240120T00:00"))


@query
def event_envelopes(spark, folder):
    return journal.envelopes(_user_journal(spark, folder)).select("entity_id", "offset", _stamp("created_at"))


@query
def oneof_events(spark, folder):
    """Nested one-of events to flat rows."""
    rows = derived.user_events(table(spark, folder, "events"))
    kind = F.col("kind")
    nested = rows.select(
        "event_id", "entity_id", "ts",
        F.when(kind == "created", F.struct("username", "email", "pass", "address", "department")).alias("created"),
        F.when(kind == "removed", F.struct(F.lit("").alias("at"))).alias("removed"),
        F.when(kind == "addressUpdated", F.struct("address")).alias("addressUpdated"),
        F.when(F.lit(False), F.struct("pass")).alias("passwordUpdated"),
        F.when(kind == "emailUpdated", F.struct("email")).alias("emailUpdated"),
        F.when(kind == "departmentUpdated", F.struct("department")).alias("departmentUpdated"),
    )
    variants = {
        "created": ["username", "email", "address", "department"], "removed": [], "addressUpdated": ["address"],
        "passwordUpdated": [], "emailUpdated": ["email"], "departmentUpdated": ["department"],
    }
    flat = codecs.flatten_variants(nested, variants, ["event_id", "entity_id"])
    return flat.select("event_id", "entity_id", "kind", "username", "email", *_address(), _department())


@query
def timestamp_codec(spark, folder):
    """Event time to seconds and nanos, and back."""
    at = F.timestamp_micros(codecs.utc_micros("ts"))
    parts = table(spark, folder, "events").select("event_id", at.alias("at"), codecs.instant_parts(at).alias("p"))
    back = codecs.instant(F.col("p.seconds"), F.col("p.nanos"))
    return parts.select("event_id", F.col("p.seconds").alias("seconds"), F.col("p.nanos").alias("nanos"), (back == F.col("at")).alias("same"))


@query
def shard_tags(spark, folder):
    return journal.entity_ids(_user_journal(spark, folder)).select(
        "entity_id", journal.shard_tag(F.col("entity_id"), USER.base_tag).alias("tag")
    )


@query
def tag_view(spark, folder):
    return journal.tag_view(*_planned(spark, folder)).select(
        "tag", "timebucket", "entity_id", "seq_nr", "tag_pid_sequence_nr", _stamp("ts")
    )


@query
def tag_write_progress(spark, folder):
    rows = journal.tag_write_progress(journal.tag_view(*_planned(spark, folder)))
    return rows.select("entity_id", "tag", "seq_nr", "tag_pid_sequence_nr", _stamp("offset"))


@query
def entity_ids(spark, folder):
    return journal.entity_ids(_user_journal(spark, folder))


@query
def projection_offsets(spark, folder):
    users = journal.projection_offsets(_user_journal(spark, folder), USER)
    departments = journal.projection_offsets(derived.department_journal(spark, folder), DEPARTMENT)
    return users.unionByName(departments).select("projection", "tag", _stamp("ts"), "entity_id", "seq_nr")


@query
def time_buckets(spark, folder):
    return journal.time_buckets(_user_journal(spark, folder))


@query
def union_of_tags(spark, folder):
    return _events(journal.union_of_tags(_user_journal(spark, folder), USER))


@query
def text_id_tags(spark, folder):
    """Tags of text ids, as the hash gives them and with a shard for every id."""
    ids, tag = journal.entity_ids(derived.text_id_journal(spark, folder)), journal.shard_tag
    return ids.select("entity_id", tag(F.col("entity_id"), USER.base_tag).alias("tag"), tag(F.col("entity_id"), USER.base_tag, safe=True).alias("safe_tag"))


def _stored_text_ids(spark: SparkSession, folder: str, safe: bool) -> DataFrame:
    path = work_path(spark, "text-ids")
    write_journal(journal.with_tags(derived.text_id_journal(spark, folder), USER, safe=safe), path, partitions=("tag",))
    return read_journal(spark, path)


@query
def text_id_union(spark, folder):
    """All shards of a stored journal together are the journal."""
    return journal.union_of_tags(_stored_text_ids(spark, folder, False), USER).select("entity_id", "seq_nr", "tag")


@query
def text_id_lookup(spark, folder):
    """Single entities of a journal stored with safe tags."""
    rows = _stored_text_ids(spark, folder, True)
    found = [journal.by_entity(rows, USER, i) for i in ("polygenelubricants", "user id 42", "user id 1")]
    return found[0].union(found[1]).union(found[2]).select("entity_id", "seq_nr", "tag")


@query
def tag_counts(spark, folder):
    """Every tag of users, with its events."""
    events = _user_journal(spark, folder).groupBy("tag").count()
    return journal.tags_of(spark, USER).join(events, "tag", "left").select("tag", F.coalesce("count", F.lit(0)).alias("events"))


# Folds


@query
def user_view(spark, folder):
    return _user_rows(_user_view(spark, folder))


@query
def department_view(spark, folder):
    return _department_view(spark, folder)


@query
def incremental_view(spark, folder):
    """The view from two separately folded halves of the journal."""
    rows = _user_journal(spark, folder)
    early = F.col("ts") < F.lit(CUT).cast("timestamp_ntz")
    halves = fold.summarise(rows.filter(early), USER).unionByName(fold.summarise(rows.filter(~early), USER))
    return _user_rows(fold.finish(fold.merge(halves, USER), USER))


@query
def merged_view(spark, folder):
    """The stored view of the first half, with the rows that the second half touches
    replaced or deleted. Of these rows only what the first half left is read again."""
    rows = _user_journal(spark, folder)
    early = F.col("ts") < F.lit(CUT).cast("timestamp_ntz")
    first = stored(fold.summarise(rows.filter(early), USER), "first-half")
    second = fold.summarise(rows.filter(~early), USER)
    touched = first.join(second.select("entity_id"), "entity_id", "left_semi").unionByName(second)
    changed = fold.merge(touched, USER)
    gone = changed.filter(F.col("last_seq") <= F.col("removed_seq")).select(F.col("entity_id").alias("id"))
    delta = fold.finish(changed, USER).withColumn("deleted", F.lit(False)).unionByName(gone.withColumn("deleted", F.lit(True)), allowMissingColumns=True)
    return _user_rows(fold.merge_view(fold.finish(first, USER), delta))


@query
def user_state(spark, folder):
    rows, plan = _planned(spark, folder)
    return _user_rows(state.state_fold(rows, USER, plan=plan), "last_seq")


@query
def department_state(spark, folder):
    rows, plan = derived.planned_department_journal(spark, folder)
    return state.state_fold(rows, DEPARTMENT, plan=plan)


@query
def user_state_as_of(spark, folder):
    rows, plan = _planned(spark, folder)
    return _user_rows(state.state_as_of(rows, USER, ts=CUT, plan=plan), "last_seq")


@query
def read_user_state(spark, folder):
    return _user_rows(state.read_state(_user_journal(spark, folder), USER, "42"), "last_seq")


@query
def user_history(spark, folder):
    rows, plan = _planned(spark, folder)
    rows = state.history(rows, USER, plan=plan)
    return rows.select("entity_id", "seq_nr", "kind", "present", "username", "email", *_address(), _department())


@query
def custom_fold_runs(spark, folder):
    """A fold in user code: every user's longest run of events of one kind."""
    rows, plan = _planned(spark, folder)
    return custom.fold(rows, custom.longest_run(), plan=plan)


@query
def snapshot_points(spark, folder):
    rows, plan = _planned(spark, folder)
    rows = state.snapshots(rows, USER, every=SNAPSHOT_EVERY, plan=plan)
    return rows.select("entity_id", "seq_nr", "present", "username", "email", *_address(), _department())


@query
def recover_from_snapshot(spark, folder):
    """The snapshots are written out first, as they would be found after a restart."""
    rows, plan = _planned(spark, folder)
    taken = stored(state.snapshots(rows, USER, every=SNAPSHOT_EVERY, plan=plan), "snapshots")
    return _user_rows(state.recover(taken, rows, USER, plan=plan), "last_seq")


@query
def recover_tail(spark, folder):
    """A checkpoint of all entities and the buckets of a stored journal after it."""
    path = work_path(spark, "recovery")
    rows, plan = _planned(spark, folder)
    write_journal(uncut(rows).drop("event_id"), f"{path}/journal")
    write_snapshots(state.checkpoint(rows, USER, CUT, plan), f"{path}/snapshots", 1, USER, keep=1)
    tail = journal.after(read_journal(spark, f"{path}/journal"), CUT)
    return _user_rows(state.resume(read_snapshots(spark, f"{path}/snapshots", USER), tail, USER), "last_seq")


# Validation, admission, gates


@query
def validate_address(spark, folder):
    rows = _user_commands(spark, folder)
    return rows.select("cmd_id", validation.joined(validation.address_errors(F.col("address"))).alias("errors"))


@query
def validate_fields(spark, folder):
    """Field rules over requests some of whose texts break one."""
    rows, event = _user_commands(spark, folder), F.col("cmd_id")
    sent = rows.select(
        "cmd_id", "kind",
        F.when(event % 7 == 0, "ab").otherwise(F.col("username")).alias("username"),
        F.when(event % 5 == 0, F.replace("email", F.lit("@"), F.lit("."))).otherwise(F.col("email")).alias("email"),
        F.when(event % 8 == 0, "abc").otherwise(F.col("pass")).alias("pass"),
        F.struct(F.when(event % 3 == 0, "U").otherwise(F.col("address.country")).alias("country")).alias("address"),
    )
    return sent.select("cmd_id", validation.joined(admission.rule_errors(admission.RULES["user"])).alias("errors"))


def _mixed(spark: SparkSession, folder: str) -> DataFrame:
    return derived.mixed_commands(table(spark, folder, "events"))


@query
def authz_rejects(spark, folder):
    """Commands turned away ahead of the entity, and why."""
    checked = admission.admit(codecs.with_default_id(_mixed(spark, folder), always_username=True), "user", "grpc")
    return admission.rejected(checked).select("cmd_id", "entity_id", "kind", "reply_kind", validation.joined(F.col("errors")).alias("errors"))


@query
def dept_exists_as_of(spark, folder):
    rows = gate.with_department_exists(_user_commands(spark, folder), _lifecycle(spark, folder))
    return rows.select("cmd_id", "kind", _department(), "department_exists")


@query
def department_gate_events(spark, folder):
    rows = gate.events(_department_decisions(spark, folder), gate.DEPARTMENT_GATE)
    return rows.select("entity_id", "seq_nr", _stamp("ts"), "kind", "name", "description")


@query
def department_gate_replies(spark, folder):
    return replies.replies(_department_decisions(spark, folder), "department")


@query
def user_gate_events(spark, folder):
    rows = gate.events(_user_decisions(spark, folder), gate.USER_GATE)
    return rows.select("entity_id", "seq_nr", _stamp("ts"), "kind", "username", "email", *_address(), _department())


@query
def user_gate_replies(spark, folder):
    return _user_decisions(spark, folder).select(
        "cmd_id", "entity_id", "present", "event_kind", "reply_kind", validation.joined(F.col("errors")).alias("errors")
    )


@query
def replied_states(spark, folder):
    """The user as a read right after each command would see it."""
    commands = _user_commands(spark, folder)
    plan = gate.plan_commands(commands)
    decided = gate.user_gate(commands, _lifecycle(spark, folder), plan=plan)
    rows = gate.with_state(decided, gate.USER_GATE, plan)
    state_of = F.col("state")
    return rows.select(
        "cmd_id", "entity_id", state_of.isNotNull().alias("found"), F.col("state.username").alias("username"),
        F.col("state.email").alias("email"), *_address("state.address"), F.col("state.department.id").alias("department_id"),
    )


@query
def reply_messages(spark, folder):
    return replies.replies(_user_decisions(spark, folder))


@query
def reply_messages_rest(spark, folder):
    return replies.replies(_user_decisions(spark, folder), surface="rest")


@query
def service_replies(spark, folder):
    """All checks in a row: caller, fields, gate; one reply per command."""
    _, answers = service.handle(_mixed(spark, folder), departments=_lifecycle(spark, folder))
    return answers


@query
def secured_events(spark, folder):
    """Events of the admitted commands, with a digest in place of the password."""
    events, _ = service.handle(_mixed(spark, folder), departments=_lifecycle(spark, folder), salt="pepper")
    return events.select("entity_id", "seq_nr", "kind", "email", "pass")


@query
def gated_state(spark, folder):
    """The view of the events that the gate itself wrote."""
    return _user_rows(fold.view_fold(gate.events(_user_decisions(spark, folder), gate.USER_GATE), USER))


# View queries


@query
def get_user(spark, folder):
    return _user_rows(search.find(_user_view(spark, folder), "42"))


@query
def list_users(spark, folder):
    return _user_rows(search.find_all(derived.customer_view(spark, folder)))


@query
def get_department(spark, folder):
    return search.find(_department_view(spark, folder), "d1")


@query
def search_all_page(spark, folder):
    """A blank query is no query; the order comes as a name and a direction."""
    items, _ = ViewSearch(_user_view(spark, folder)).search("  ", 0, 10, [codecs.sort_of("username", "ASC")])
    return _user_rows(items)


@query
def search_far_page(spark, folder):
    """A page beyond what tasks keep for the front ones."""
    hits = search.matching(derived.customer_view(spark, folder), None)
    return _user_rows(search.page_of(hits, 6, 20, [("address.city", False)], deep=50))


@query
def search_terms(spark, folder):
    return _user_rows(search.matching(derived.customer_view(spark, folder), "machinery d3"))


@query
def search_all_terms(spark, folder):
    return _user_rows(search.matching(derived.customer_view(spark, folder), "d3 machinery", mode="all"))


@query
def search_phrase(spark, folder):
    """Terms side by side in one field; the same terms the other way round match nothing."""
    view = derived.customer_view(spark, folder)
    there = search.matching(view, "city 7", mode="phrase")
    return _user_rows(there.unionByName(search.matching(view, "7 city", mode="phrase")))


@query
def search_phrase_documents(spark, folder):
    return search.matching(table(spark, folder, "documents"), PHRASE, fields=("text",), mode="phrase").select("doc_id")


@query
def search_prefix(spark, folder):
    return _user_rows(search.matching(derived.customer_view(spark, folder), "mach", mode="prefix"))


@query
def search_phrase_prefix(spark, folder):
    return _user_rows(search.matching(derived.customer_view(spark, folder), "city 1", mode="prefix"))


@query
def search_field(spark, folder):
    return _user_rows(search.matching(derived.customer_view(spark, folder), "12", fields=("address.number",)))


@query
def search_field_sorted(spark, folder):
    sorts = [codecs.parse_sort("address.city:desc"), codecs.parse_sort("username")]
    items, _ = search.search(derived.customer_view(spark, folder), "machinery", 2, 20, sorts, fields=("email",))
    return _user_rows(items)


@query
def search_count(spark, folder):
    _, count = search.search(derived.customer_view(spark, folder), "machinery d3", 0, 10)
    return count


@query
def search_departments(spark, folder):
    return search.matching(_department_view(spark, folder), "d2 dep3 dep9", fields=search.DEPARTMENT_FIELDS)


@query
def search_documents(spark, folder):
    """Term match over whole texts."""
    hits = search.matching(table(spark, folder, "documents"), ALL_QUERY, fields=("text",), mode="all")
    return hits.select("doc_id", "lang", "source")


@query
def search_stream_pages(spark, folder):
    hits = search.matching(derived.customer_view(spark, folder), "machinery d3")
    return search.all_pages(hits, [("username", False)]).select("page", "id", "username")


@query
def search_seek_pages(spark, folder):
    """Three pages by continuation over a mixed order, and one behind a key of no row."""
    hits = search.matching(derived.customer_view(spark, folder), "machinery d3")
    arranged = SortedHits(spark, work_path(spark, "hits"), [("department.id", False), ("username", True)], block=64).write(hits)
    page, rows = arranged.page(("d3", "customer#000000050x", "0")), []
    pages = [page.select(F.lit(99).alias("page"), "id", "username")]
    for number in range(3):
        page = arranged.page(arranged.key_of(rows[-1]) if rows else None)
        rows = page.collect()
        pages.append(page.select(F.lit(number).alias("page"), "id", "username"))
        if not rows:
            break
    return reduce(DataFrame.unionByName, pages)


@query
def suggest_users(spark, folder):
    return search.suggest(derived.customer_view(spark, folder), "C").select("property", "rank", "text", "score", "freq")


@query
def lookup_suggest_users(spark, folder):
    """Suggestions from the sorted table, after a batch that renames, one that corrects and
    removes, and one that brings back."""
    view = derived.customer_view(spark, folder)
    kept = Completions(spark, work_path(spark, "completions"))
    kept.apply(view.withColumn("username", F.concat(F.lit("C0"), "username")), 0)
    kept.compact()
    third = F.pmod(F.crc32("id"), F.lit(3)) == 0
    kept.apply(view.filter(~third), 1, removed=view.filter(third))
    kept.apply(view.filter(third), 2)
    return kept.suggest("C").select("property", "rank", "text", "score", "freq")


def _document_postings(spark, folder):
    docs = table(spark, folder, "documents")
    kept = Postings(spark, work_path(spark, "postings"), ("text",), "doc_id", "bigint")
    kept.apply(docs, 0)
    return docs, kept


@query
def lookup_search_documents(spark, folder):
    """All terms, from the postings of every document."""
    docs, kept = _document_postings(spark, folder)
    return kept.matching(docs, ALL_QUERY, "all").select("doc_id", "lang", "source")


@query
def lookup_phrase_documents(spark, folder):
    docs, kept = _document_postings(spark, folder)
    return kept.matching(docs, PHRASE, "phrase").select("doc_id")


@query
def suggest_lists(spark, folder):
    """One list per property: completions of a prefix, and none of a missing one."""
    view = derived.customer_view(spark, folder)
    lists = [ViewSearch(view).suggest(codecs.prefix_or_empty(p)).withColumn("prefix", F.lit(p or "")) for p in ("c1", None)]
    rows = lists[0].unionByName(lists[1])
    return rows.select("prefix", "property", F.array_join("suggestions.text", ",").alias("texts"))


@query
def bm25_documents(spark, folder):
    scored = search.ranked(table(spark, folder, "documents"), RANK_QUERY)
    return scored.select("doc_id", F.round("score", 6).alias("score"))


@query
def bm25_top(spark, folder):
    """The page of the most relevant documents: default order when no sort is given."""
    scored = search.ranked(table(spark, folder, "documents"), RANK_QUERY)
    best = scored.select("doc_id", F.round("score", 6).alias("score"))
    return best.orderBy(F.col("score").desc(), "doc_id").limit(10)


@query
def search_relevance(spark, folder):
    """The second page by relevance."""
    page = search.relevant(derived.customer_view(spark, folder), "machinery d3 city 7", 1, 20)
    return _user_rows(page, "score")


@query
def dangling_departments(spark, folder):
    return _user_rows(search.dangling(_user_view(spark, folder), _department_view(spark, folder)))


@query
def placed_departments(spark, folder):
    return _user_rows(search.placed(_user_view(spark, folder), _department_view(spark, folder)))


# Documents, records, streams


@query
def view_documents(spark, folder):
    view = _user_view(spark, folder)
    return view.select("id", codecs.document_json(view, list(search.SUGGESTED)).alias("document"))


@query
def view_documents_decoded(spark, folder):
    view = _user_view(spark, folder)
    encoded = view.select(codecs.document_json(view, list(search.SUGGESTED)).alias("document"))
    return _user_rows(encoded.select(codecs.document_from_json(F.col("document"), USER_VIEW).alias("u")).select("u.*"))


@query
def republish_records(spark, folder):
    return topics.records(_user_journal(spark, folder), USER, topics.USER_TOPIC)


@query
def republish_department_records(spark, folder):
    return topics.records(derived.department_journal(spark, folder), DEPARTMENT, topics.DEPARTMENT_TOPIC)


@query
def stored_journal_lookup(spark, folder):
    """One entity out of a written journal: partitions and row groups are pruned."""
    path = work_path(spark, "journal")
    write_journal(_user_journal(spark, folder), path, partitions=("tag",))
    return _events(journal.by_entity(read_journal(spark, path), USER, "42"))


@query
def stored_view(spark, folder):
    """A read model fed by two batches, merged into a base after the first."""
    rows = _user_journal(spark, folder)
    early = F.col("ts") < F.lit(CUT).cast("timestamp_ntz")
    store = ViewStore(spark, work_path(spark, "stored-view"), USER)
    store.create_or_extend()
    store.apply(rows.filter(early), 0)
    store.compact()
    store.apply(rows.filter(~early), 1)
    return _user_rows(store.all())


def _event_stream(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """The events as a stream of eight slices of time, one for each micro-batch."""
    files = write_in_time_order(table(spark, folder, "events"), f"{path}/events", "ts", "user_id")
    return stream_files(spark, f"{path}/events", SCHEMAS["events"], files)


def _department_stream(spark: SparkSession, folder: str, path: str) -> DataFrame:
    files = write_in_time_order(derived.department_journal(spark, folder), f"{path}/journal", "ts", "entity_id")
    return stream_files(spark, f"{path}/journal", DEPARTMENT_JOURNAL, files)


@query
def stream_user_view(spark, folder):
    path = work_path(spark, "user-view")
    store = ViewStore(spark, f"{path}/view", USER)
    stream = derived.user_journal_stream(_event_stream(spark, folder, path))
    streaming_views.build_view(stream, store, f"{path}/checkpoint", compact_every=3).awaitTermination()
    return _user_rows(store.all())


@query
def stream_resumed_view(spark, folder):
    """The stream stops after half of its files and goes on where it was."""
    path = work_path(spark, "resumed-view")
    store = ViewStore(spark, f"{path}/view", USER)
    events = table(spark, folder, "events")
    late = F.col("ts") >= F.lit(CUT).cast("timestamp_ntz")
    for part in (events.filter(~late), events.filter(late)):
        files = write_in_time_order(part, f"{path}/events", "ts", "user_id", 4)
        stream = derived.user_journal_stream(stream_files(spark, f"{path}/events", SCHEMAS["events"], files))
        streaming_views.build_view(stream, store, f"{path}/checkpoint").awaitTermination()
    return _user_rows(store.all())


@query
def stream_department_view(spark, folder):
    path = work_path(spark, "department-view")
    store = ViewStore(spark, f"{path}/view", DEPARTMENT)
    streaming_views.build_view(_department_stream(spark, folder, path), store, f"{path}/checkpoint").awaitTermination()
    return store.all()


def _republished(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("topic string, key string, value string").parquet(f"{path}/records")


@query
def stream_republish(spark, folder):
    path = work_path(spark, "republish")
    stream = derived.user_journal_stream(_event_stream(spark, folder, path))
    streaming_views.republish(stream, USER, topics.USER_TOPIC, f"{path}/checkpoint", path=f"{path}/records").awaitTermination()
    return _republished(spark, path)


@query
def stream_republish_departments(spark, folder):
    path = work_path(spark, "republish-departments")
    stream = _department_stream(spark, folder, path)
    streaming_views.republish(stream, DEPARTMENT, topics.DEPARTMENT_TOPIC, f"{path}/checkpoint", path=f"{path}/records").awaitTermination()
    return _republished(spark, path)


@query
def stream_gate(spark, folder):
    """The departments are read anew for every batch of commands."""
    path = work_path(spark, "gate")
    commands = derived.user_commands(_event_stream(spark, folder, path))
    journal_rows = gate.events(_department_decisions(spark, folder), gate.DEPARTMENT_GATE)
    journal_rows.write.parquet(f"{path}/departments")

    def decide(batch: DataFrame, carried: DataFrame) -> DataFrame:
        departments = spark.read.schema(journal_rows.schema).parquet(f"{path}/departments")
        return gate.user_gate(batch, gate.lifecycle_events(departments), carried)

    streaming_gate.run(commands, gate.USER_GATE, decide, path, f"{path}/checkpoint", compact_every=3).awaitTermination()
    rows = gate.events(streaming_gate.decisions(spark, path), gate.USER_GATE)
    return rows.select("entity_id", "seq_nr", _stamp("ts"), "kind", "username", "email", *_address(), _department())


@query
def stream_keyed_gate(spark, folder):
    """The gate with its state per entity in the state store, stopped half way."""
    path = work_path(spark, "keyed-gate")
    departments = stored(gate.lifecycle_events(gate.events(_department_decisions(spark, folder), gate.DEPARTMENT_GATE)), "lifecycles")
    events = table(spark, folder, "events")
    late = F.col("ts") >= F.lit(CUT).cast("timestamp_ntz")
    for part in (events.filter(~late), events.filter(late)):
        files = write_in_time_order(part, f"{path}/events", "ts", "user_id", 4)
        commands = derived.user_commands(stream_files(spark, f"{path}/events", SCHEMAS["events"], files))
        keyed.run(keyed.user_commands(commands, departments), gate.USER_GATE, path, f"{path}/checkpoint").awaitTermination()
    rows = gate.events(keyed.decisions(spark, path), gate.USER_GATE)
    return rows.select("entity_id", "seq_nr", _stamp("ts"), "kind", "username", "email", *_address(), _department())


def _untidy_events(spark: SparkSession, folder: str, path: str, part: int) -> DataFrame:
    """The events as files out of order: the later half first, then the earlier half with
    a third of the later one once more."""
    events = table(spark, folder, "events")
    late = F.col("ts") >= F.lit(CUT).cast("timestamp_ntz")
    rows = events.filter(late) if part == 0 else events.filter(~late | (F.col("event_id") % 3 == 0))
    files = write_in_time_order(rows, f"{path}/events", "ts", "user_id", 4)
    return derived.user_journal_stream(stream_files(spark, f"{path}/events", SCHEMAS["events"], files))


@query
def stream_state_view(spark, folder):
    """The view folded in the state store, of late and repeated files, stopped half way."""
    path = work_path(spark, "state-view")
    store = ViewStore(spark, f"{path}/view", USER)
    for part in (0, 1):
        stream = _untidy_events(spark, folder, path, part)
        streaming_views.fold_view(stream, store, f"{path}/checkpoint", compact_every=3).awaitTermination()
    return _user_rows(store.all())


@query
def stream_republish_once(spark, folder):
    """Repeated events give one record each, also after a stop."""
    path = work_path(spark, "republish-once")
    for part in (0, 1):
        stream = _untidy_events(spark, folder, path, part)
        streaming_views.republish(stream, USER, topics.USER_TOPIC, f"{path}/checkpoint", unique=True, path=f"{path}/records").awaitTermination()
    return _republished(spark, path)


def _tailed(spark: SparkSession, folder: str, label: str, read: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """What ``read(live journal, journal)`` gives of a journal that comes as a stream."""
    path = work_path(spark, label)
    rows = stored(_user_journal(spark, folder), "journal")
    files = write_in_time_order(rows, f"{path}/journal", "ts", "entity_id")
    live = read(stream_files(spark, f"{path}/journal", USER_JOURNAL, files), rows)
    topics.write_stream(live, f"{path}/checkpoint", path=f"{path}/read").awaitTermination()
    return _events(spark.read.schema(USER_JOURNAL).parquet(f"{path}/read"))


@query
def stream_from_offsets(spark, folder):
    """A live read that starts at the stored offset of every entity."""
    def read(live: DataFrame, rows: DataFrame) -> DataFrame:
        offsets = rows.filter(F.col("ts") < F.lit(CUT).cast("timestamp_ntz")).groupBy("entity_id").agg(F.max("seq_nr").alias("offset"))
        return journal.from_offsets(live, stored(offsets, "offsets"))

    return _tailed(spark, folder, "tail", read)


@query
def stream_events_by_entity(spark, folder):
    """Live events of one entity."""
    return _tailed(spark, folder, "live-entity", lambda live, _: journal.by_entity(live, USER, "7", from_seq=5))


@query
def stream_events_by_tag(spark, folder):
    """Live events of one shard."""
    return _tailed(spark, folder, "live-tag", lambda live, _: journal.by_tag(live, "UserEvent1"))


def _ledger(spark: SparkSession, folder: str, label: str, restart: bool) -> tuple[DataFrame, ViewStore]:
    """The journal and a read model that keeps its offsets, fed with the journal's first
    half and, with ``restart``, by a second query that has no checkpoint but the offsets."""
    path = work_path(spark, label)
    rows = stored(_user_journal(spark, folder), "journal")
    store = ViewStore(spark, f"{path}/view", USER)
    early = F.col("ts") < F.lit(CUT).cast("timestamp_ntz")
    files = write_in_time_order(rows.filter(early), f"{path}/journal", "ts", "entity_id", 4)
    live = stream_files(spark, f"{path}/journal", USER_JOURNAL, files)
    streaming_views.build_view(live, store, f"{path}/checkpoint", compact_every=3, ledger=True).awaitTermination()
    if restart:
        files = write_in_time_order(rows.filter(~early), f"{path}/journal", "ts", "entity_id", 4)
        reached = stored(store.offsets(), "offsets")
        rest = journal.beyond(stream_files(spark, f"{path}/journal", USER_JOURNAL, files), reached)
        streaming_views.build_view(rest, store, f"{path}/checkpoint-2", compact_every=3, ledger=True, first_batch=store.next_batch()).awaitTermination()
    return rows, store


@query
def projection_ledger(spark, folder):
    """The offsets that a projection has committed, after a start without its checkpoint."""
    _, store = _ledger(spark, folder, "ledger", True)
    return store.offsets().select(F.lit("userView").alias("projection"), "tag", _stamp("ts"), "entity_id", "seq_nr")


@query
def projection_ledger_view(spark, folder):
    """The read model beside that ledger."""
    return _user_rows(_ledger(spark, folder, "ledger-view", True)[1].all())


@query
def projection_lag(spark, folder):
    """What a projection lacks that has read half of the journal."""
    rows, store = _ledger(spark, folder, "lag", False)
    return journal.lag(rows, store.offsets()).select(F.lit("userView").alias("projection"), "tag", "lag")
