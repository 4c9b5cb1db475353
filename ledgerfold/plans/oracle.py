"""The same queries as ANSI SQL over the tables, written apart from the library: plain
windows and joins, without cells, partial folds or carried state."""

from __future__ import annotations

from ledgerfold.plans.catalog import ALL_QUERY, CUT, PHRASE, RANK_QUERY, SNAPSHOT_EVERY

STAMP = "'%Y-%m-%d %H:%M:%S.%f'"
ADDRESS = "address.street AS street, address.number AS number, address.zip AS zip, address.city AS city, " \
          "address.state AS state, address.country AS country"
USER_COLUMNS = f"id, username, email, {ADDRESS}, department_id"


def _tag(column: str, base: str, lowest: int = -2) -> str:
    """Over UTF-16 units; ``lowest`` is the shard of the hash without an absolute value."""
    units = "CASE WHEN unicode(c) < 65536 THEN [unicode(c)::BIGINT] ELSE [55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024] END"
    codes = f"flatten(list_transform(string_split({column}, ''), lambda c: {units}))"
    rolled = f"list_reduce(list_prepend(0::BIGINT, {codes}), lambda a, u: (a * 31 + u) % 4294967296)"
    signed = f"CASE WHEN {rolled} > 2147483647 THEN {rolled} - 4294967296 ELSE {rolled} END"
    return f"'{base}' || CASE WHEN {rolled} = 2147483648 THEN {lowest} ELSE abs({signed}) % 3 END::VARCHAR"


def _country(event: str) -> str:
    return f"CASE {event} % 5 WHEN 0 THEN 'CA' WHEN 1 THEN 'UK' WHEN 2 THEN 'UA' WHEN 3 THEN 'US' ELSE 'MX' END"


def _address(zip_code: str) -> str:
    return (
        "{'street': 'street ' || (event_id % 100), 'number': (event_id % 50)::VARCHAR, 'zip': " + zip_code
        + ", 'city': 'city ' || (event_id % 20), 'state': 'state ' || (event_id % 10), 'country': " + _country("event_id") + "}"
    )


_ZIP = "CASE WHEN event_id % 7 = 0 THEN 'bad' ELSE lpad((event_id % 100000)::VARCHAR, 5, '0') END"

UJ = f"""uj AS (
  SELECT *, {_tag('entity_id', 'UserEvent')} AS tag, strftime(ts, '%Y%m%dT%H:00') AS timebucket
  FROM (
    SELECT event_id, user_id::VARCHAR AS entity_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq_nr, ts,
           CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'emailUpdated' WHEN 'click' THEN 'addressUpdated'
                WHEN 'purchase' THEN 'departmentUpdated' ELSE 'removed' END AS kind,
           'user' || user_id AS username, 'u' || event_id || '@test.com' AS email,
           CASE WHEN event_id % 11 <> 0 THEN {_address(_ZIP)} END AS address,
           'd' || (event_id % 4 + 1) AS department_id
    FROM events) e)"""

DEPARTMENT_TIME = "TIMESTAMP '2024-01-01' + INTERVAL 18 MINUTE * datediff('day', TIMESTAMP '1995-01-01', o_orderdate)"

DJ = f"""dj AS (
  SELECT *, {_tag('entity_id', 'DepartmentEvent')} AS tag, strftime(ts, '%Y%m%dT%H:00') AS timebucket
  FROM (
    SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY ts, o_orderkey) AS seq_nr, ts, kind, name, description
    FROM (SELECT o_orderkey, 'd' || (o_orderkey % 6 + 1) AS entity_id, {DEPARTMENT_TIME} AS ts,
                 CASE o_orderstatus WHEN 'O' THEN 'created' WHEN 'P' THEN 'updated' WHEN 'F' THEN 'removed' END AS kind,
                 'dep' || (o_orderkey % 10) AS name, 'department ' || o_orderkey AS description
          FROM orders) o) d)"""

JOURNAL_COLUMNS = f"entity_id, seq_nr, strftime(ts, {STAMP}) AS ts, kind, username, email, {ADDRESS}, department_id, tag, timebucket"


def _user_view(source: str, name: str = "uv") -> str:
    """Upsert fold: the rows after the last removal, per field the last that set it."""
    return f"""{name} AS (
  SELECT entity_id AS id, coalesce(max(username) FILTER (kind = 'created'), '') AS username,
         coalesce(arg_max(email, seq_nr) FILTER (kind IN ('created', 'emailUpdated')), '') AS email,
         (arg_max({{'v': address}}, seq_nr) FILTER (kind IN ('created', 'addressUpdated'))).v AS address,
         (arg_max({{'v': department_id}}, seq_nr) FILTER (kind IN ('created', 'departmentUpdated'))).v AS department_id
  FROM (SELECT j.* FROM {source} j LEFT JOIN
          (SELECT entity_id, max(seq_nr) AS rm FROM {source} WHERE kind = 'removed' GROUP BY entity_id) r USING (entity_id)
        WHERE j.seq_nr > coalesce(rm, 0)) alive
  GROUP BY entity_id)"""


DV = """dv AS (
  SELECT entity_id AS id, coalesce(arg_max(name, seq_nr) FILTER (kind IN ('created', 'updated')), '') AS name,
         coalesce(arg_max(description, seq_nr) FILTER (kind IN ('created', 'updated')), '') AS description
  FROM (SELECT j.* FROM dj j LEFT JOIN
          (SELECT entity_id, max(seq_nr) AS rm FROM dj WHERE kind = 'removed' GROUP BY entity_id) r USING (entity_id)
        WHERE j.seq_nr > coalesce(rm, 0)) alive
  GROUP BY entity_id)"""


def _marked(source: str, name: str) -> str:
    """Every event with whether the entity was there before it."""
    return f"""{name} AS (
  SELECT *, (kind = 'created') <> present AS effective FROM (
    SELECT *, coalesce(last_value(CASE WHEN kind IN ('created', 'removed') THEN kind END IGNORE NULLS) OVER (
             PARTITION BY entity_id ORDER BY seq_nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'created', false) AS present
    FROM {source}) b)"""


def _user_history(source: str) -> str:
    frame = "PARTITION BY entity_id ORDER BY seq_nr ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

    def last(column: str, kinds: str) -> str:
        return f"(last_value(CASE WHEN effective AND kind IN ({kinds}) THEN {{'v': {column}}} END IGNORE NULLS) OVER ({frame})).v"

    return f"""{_marked(source, 'marked')}, hist AS (
  SELECT entity_id, seq_nr, kind, alive AS present, CASE WHEN alive THEN n END AS username, CASE WHEN alive THEN e END AS email,
         CASE WHEN alive THEN a END AS address, CASE WHEN alive THEN d END AS department_id
  FROM (SELECT *, CASE kind WHEN 'created' THEN true WHEN 'removed' THEN false ELSE present END AS alive,
               {last('username', "'created'")} AS n, {last('email', "'created', 'emailUpdated'")} AS e,
               {last('address', "'created', 'addressUpdated'")} AS a, {last('department_id', "'created', 'departmentUpdated'")} AS d
        FROM marked) h)"""


def _user_state(source: str) -> str:
    """The last row of the history, where it is alive."""
    return f"""WITH {UJ}, src AS ({source}), {_user_history('src')}
SELECT entity_id AS id, seq_nr AS last_seq, username, email, {ADDRESS}, department_id
FROM (SELECT *, max(seq_nr) OVER (PARTITION BY entity_id) AS mx FROM hist) h WHERE seq_nr = mx AND present"""


DEPARTMENT_DECISIONS = f"""dc AS (
  SELECT o_orderkey AS cmd_id, 'd' || (o_orderkey % 6 + 1) AS entity_id, {DEPARTMENT_TIME} AS ts,
         CASE o_orderstatus WHEN 'O' THEN 'create' WHEN 'P' THEN 'update' WHEN 'F' THEN 'remove' END AS kind,
         'dep' || (o_orderkey % 10) AS name, 'department ' || o_orderkey AS description
  FROM orders),
dd AS (
  SELECT *, CASE WHEN NOT present THEN CASE kind WHEN 'create' THEN 'Created' ELSE 'NotExists' END
                 ELSE CASE kind WHEN 'create' THEN 'AlreadyExists' WHEN 'update' THEN 'Updated' ELSE 'Removed' END END AS reply_kind,
            CASE WHEN NOT present THEN CASE kind WHEN 'create' THEN 'created' END
                 ELSE CASE kind WHEN 'update' THEN 'updated' WHEN 'remove' THEN 'removed' END END AS event_kind
  FROM (SELECT *, coalesce(last_value(CASE WHEN kind IN ('create', 'remove') THEN kind END IGNORE NULLS) OVER (
                    PARTITION BY entity_id ORDER BY ts, cmd_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'create', false) AS present
        FROM dc) b),
de AS (
  SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY ts, cmd_id) AS seq_nr, ts, event_kind AS kind,
         CASE WHEN event_kind <> 'removed' THEN name END AS name,
         CASE WHEN event_kind <> 'removed' THEN description END AS description
  FROM dd WHERE event_kind IS NOT NULL)"""

_COMMAND_ZIP = "CASE WHEN event_id % 7 = 0 THEN 'bad' ELSE '12345' END"

COMMANDS = f"""uc AS (
  SELECT event_id AS cmd_id, ts, user_id::VARCHAR AS entity_id,
         CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'changeEmail' WHEN 'click' THEN 'changeAddress'
              WHEN 'purchase' THEN 'changeDepartment' WHEN 'error' THEN 'remove' END AS kind,
         'user' || user_id AS username, 'u' || event_id || '@test.com' AS email, {_address(_COMMAND_ZIP)} AS address,
         'd' || (event_id % 7 + 1) AS department_id, event_id % 13 <> 0 AS known
  FROM events)"""

MIXED = COMMANDS.replace("uc AS (", "plain AS (", 1) + """,
uc AS (
  SELECT cmd_id, ts, CASE WHEN kind <> 'create' THEN username ELSE name END AS entity_id,
         CASE WHEN kind = 'changeEmail' AND cmd_id % 5 = 0 THEN 'changePassword' WHEN kind = 'changeAddress' AND cmd_id % 4 = 0 THEN 'get' ELSE kind END AS kind,
         name AS username, CASE WHEN cmd_id % 19 = 0 THEN replace(email, '@', '.') ELSE email END AS email, address, department_id,
         known AND cmd_id % 23 <> 0 AS known
  FROM (SELECT *, CASE WHEN cmd_id % 17 = 0 THEN 'ab' ELSE username END AS name FROM plain) p)"""

BROKEN = """concat_ws(', ', CASE WHEN kind = 'create' AND length(username) < 4 THEN 'username must have at least 4 characters' END,
  CASE WHEN kind IN ('create', 'changeEmail') AND NOT contains(email, '@') THEN 'email must be an email address' END)"""

ADDRESS_ERRORS = (
    "CASE WHEN NOT regexp_full_match(address.zip, '\\d{5}([-\\s]\\d{4})?') THEN ['Zip: ' || address.zip || ' is not valid'] ELSE [] END || "
    "CASE WHEN address.country NOT IN ('CA', 'UA', 'US', 'MX') THEN ['Country: ' || address.country || ' is not valid ISO country'] ELSE [] END"
)

AS_OF = f"""marks AS (
  SELECT entity_id AS dept, ts AS mark_ts, arg_max(kind, seq_nr) AS mark FROM de WHERE kind IN ('created', 'removed') GROUP BY entity_id, ts),
seen AS (
  SELECT uc.*, CASE WHEN kind IN ('create', 'changeDepartment') THEN coalesce(mark = 'created', false) END AS department_exists
  FROM uc ASOF LEFT JOIN marks ON uc.department_id = marks.dept AND uc.ts >= marks.mark_ts)"""


def _user_decisions(condition: str = "true", commands: str = COMMANDS) -> str:
    return f"""{DEPARTMENT_DECISIONS}, {commands}, {AS_OF},
checked AS (
  SELECT *, CASE WHEN kind IN ('create', 'changeAddress') THEN {ADDRESS_ERRORS} ELSE [] END
         || CASE WHEN kind IN ('create', 'changeDepartment') AND NOT department_exists
                 THEN ['Department: ' || department_id || ' not found'] ELSE [] END AS errs
  FROM seen WHERE {condition}),
ud AS (
  SELECT *, array_to_string(errs, ', ') AS errors,
         CASE WHEN NOT present THEN CASE WHEN kind <> 'create' THEN 'NotExists' WHEN len(errs) > 0 THEN 'CreatedFailed' ELSE 'Created' END
              ELSE CASE kind WHEN 'create' THEN 'AlreadyExists' WHEN 'changeEmail' THEN 'EmailChanged'
                   WHEN 'changeAddress' THEN CASE WHEN len(errs) > 0 THEN 'AddressChangedFailed' ELSE 'AddressChanged' END
                   WHEN 'changeDepartment' THEN CASE WHEN len(errs) > 0 THEN 'DepartmentChangedFailed' ELSE 'DepartmentChanged' END
                   WHEN 'changePassword' THEN 'PasswordChanged' WHEN 'get' THEN 'State' ELSE 'Removed' END END AS reply_kind
  FROM (SELECT *, coalesce(last_value(CASE WHEN kind = 'create' AND len(errs) = 0 THEN 'created' WHEN kind = 'remove' THEN 'removed' END
                    IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY ts, cmd_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'created', false) AS present FROM checked) b),
decided AS (
  SELECT *, CASE reply_kind WHEN 'Created' THEN 'created' WHEN 'EmailChanged' THEN 'emailUpdated' WHEN 'AddressChanged' THEN 'addressUpdated'
              WHEN 'DepartmentChanged' THEN 'departmentUpdated' WHEN 'PasswordChanged' THEN 'passwordUpdated' WHEN 'Removed' THEN 'removed' END AS event_kind FROM ud),
ue AS (
  SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY ts, cmd_id) AS seq_nr, ts, event_kind AS kind,
         CASE WHEN event_kind = 'created' THEN username END AS username,
         CASE WHEN event_kind IN ('created', 'emailUpdated') THEN email END AS email,
         CASE WHEN event_kind IN ('created', 'addressUpdated') THEN address END AS address,
         CASE WHEN event_kind IN ('created', 'departmentUpdated') THEN department_id END AS department_id
  FROM decided WHERE event_kind IS NOT NULL)"""


GRPC_MESSAGE = """CASE reply_kind WHEN 'Created' THEN 'User registered' WHEN 'Removed' THEN 'User removed' WHEN 'EmailChanged' THEN 'User email updated'
  WHEN 'AddressChanged' THEN 'User address updated' WHEN 'DepartmentChanged' THEN 'User department updated'
  WHEN 'PasswordChanged' THEN 'User password updated' WHEN 'State' THEN ''
  WHEN 'AlreadyExists' THEN 'User already exists' WHEN 'NotExists' THEN CASE WHEN kind = 'get' THEN 'NotExists' ELSE 'User not exists' END
  WHEN 'CreatedFailed' THEN 'User register error (' || errors || ')'
  WHEN 'AddressChangedFailed' THEN 'User address update error (' || errors || ')'
  WHEN 'DepartmentChangedFailed' THEN 'User department update error (' || errors || ')' END"""
OK = "reply_kind IN ('Created', 'Removed', 'EmailChanged', 'PasswordChanged', 'AddressChanged', 'DepartmentChanged', 'State')"

CV = """cv AS (
  SELECT c_custkey::VARCHAR AS id, c_name AS username, 'c' || c_custkey || '@' || lower(c_mktsegment) || '.com' AS email,
         {'street': 'street ' || (c_custkey % 100), 'number': (c_custkey % 50)::VARCHAR, 'zip': lpad((c_custkey % 100000)::VARCHAR, 5, '0'),
          'city': 'city ' || (c_custkey % 20), 'state': 'state ' || (c_custkey % 10), 'country': n_name} AS address,
         'd' || (c_custkey % 4 + 1) AS department_id
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)"""

_FIELDS = ("id", "username", "email", "address.street", "address.number", "address.city", "address.state", "address.zip",
           "address.country", "department_id")


def _tokens(column: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({column}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def _any(terms: list[str], fields=_FIELDS) -> str:
    wanted = "[" + ", ".join(f"'{t}'" for t in terms) + "]"
    return " OR ".join(f"list_has_any({_tokens(f)}, {wanted})" for f in fields)


def _bm25(query: str = RANK_QUERY, source: str = "documents", key: str = "doc_id", before: str = "") -> str:
    terms = ", ".join(f"('{t}')" for t in query.split())
    return f"""WITH {before} tok AS (SELECT {key}, unnest({_tokens('text')}) AS t FROM {source}),
len AS (SELECT {key}, len({_tokens('text')}) AS n FROM {source}),
tf AS (SELECT {key}, t, count(*) AS tf FROM tok WHERE t IN (SELECT * FROM (VALUES {terms}) v(t)) GROUP BY {key}, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
corpus AS (SELECT count(*) AS docs, avg(n) AS mean FROM len),
scored AS (
  SELECT {key}, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score
  FROM tf JOIN df USING (t) JOIN len USING ({key}), corpus GROUP BY {key})"""


def _json(source: str, topic: str, payload: str) -> str:
    at = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')"
    value = f"to_json({{'entity_id': entity_id, 'seq_nr': {source}, 'ts': {at}, 'kind': kind, {payload}}})::VARCHAR"
    return f"SELECT '{topic}' AS topic, entity_id AS key, {value} AS value"


_USER_PAYLOAD = (
    "'username': CASE WHEN kind = 'created' THEN username END, 'email': CASE WHEN kind IN ('created', 'emailUpdated') THEN email END, "
    "'address': CASE WHEN kind IN ('created', 'addressUpdated') THEN address END, "
    "'department': CASE WHEN kind IN ('created', 'departmentUpdated') THEN {'id': department_id} END"
)
_DEPARTMENT_PAYLOAD = (
    "'name': CASE WHEN kind <> 'removed' THEN name END, 'description': CASE WHEN kind <> 'removed' THEN description END"
)
_EVENT_COLUMNS = f"entity_id, seq_nr, strftime(ts, {STAMP}) AS ts, kind, username, email, {ADDRESS}, department_id"


def _suggest(name: str, prefix: str = "c") -> str:
    return (
        f"SELECT '{name}' AS property, (row_number() OVER (ORDER BY {name}, id))::INTEGER AS rank, {name} AS text, 1.0::DOUBLE AS score, 1 AS freq "
        f"FROM cv WHERE starts_with(lower({name}), '{prefix}') QUALIFY rank <= 5"
    )


def _last_set(column: str, kinds: str) -> str:
    """The value that the events so far set, for commands."""
    return (
        f"(last_value(CASE WHEN event_kind IN ({kinds}) THEN {{'v': {column}}} END IGNORE NULLS) OVER ("
        "PARTITION BY entity_id ORDER BY ts, cmd_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)).v"
    )


def statements() -> dict[str, str]:
    view = f"WITH {UJ}, {_user_view('uj')} SELECT {USER_COLUMNS} FROM uv"
    both = f"WITH {UJ}, {DJ}, {_user_view('uj')}, {DV}"
    state = _user_state("SELECT * FROM uj")
    department_view = f"WITH {DJ}, {DV} SELECT id, name, description FROM dv"
    decisions = f"WITH {_user_decisions()}"
    gate_events = f"{decisions} SELECT {_EVENT_COLUMNS} FROM ue"
    customers = f"WITH {CV} SELECT {USER_COLUMNS} FROM cv"
    document = (
        "to_json({'id': id, 'username': username, 'email': email, 'address': address, 'department': CASE WHEN department_id IS NOT NULL "
        "THEN {'id': department_id} END, 'username_sugg': username, 'email_sugg': email})::VARCHAR"
    )
    denied = "NOT known AND kind NOT IN ('create', 'get')"
    admitted = f"NOT ({denied}) AND {BROKEN} = ''"
    rejected = f"""SELECT *, CASE WHEN {denied} THEN 'Unauthenticated' ELSE 'Invalid' END AS reply_kind, CASE WHEN {denied} THEN '' ELSE {BROKEN} END AS errors
  FROM uc WHERE NOT ({admitted})"""
    mixed = f"WITH {_user_decisions(admitted, MIXED)}, rej AS ({rejected})"
    text_ids = f"""ti AS (SELECT CASE WHEN user_id % 50 = 7 THEN 'polygenelubricants' WHEN user_id % 50 = 8 THEN chr(128512) || ' ' || user_id
    ELSE 'user id ' || user_id END AS entity_id, event_id + 1 AS seq_nr FROM events)"""
    records = f"WITH {UJ} {_json('event_id + 1', 'c-user', _USER_PAYLOAD)} FROM uj"
    resumed = f"""WITH {UJ}, off AS (SELECT entity_id, max(seq_nr) AS o FROM uj WHERE ts < TIMESTAMP '{CUT}' GROUP BY entity_id)
SELECT {JOURNAL_COLUMNS} FROM uj LEFT JOIN off USING (entity_id) WHERE seq_nr >= coalesce(o, 0)"""
    one_tag = f"WITH {UJ} SELECT {JOURNAL_COLUMNS} FROM uj WHERE tag = 'UserEvent1'"
    phrase_documents = (
        "SELECT doc_id FROM documents WHERE regexp_matches(lower(coalesce(text, '')), "
        f"'(^|[^\\p{{L}}\\p{{N}}]){'[^\\p{L}\\p{N}]+'.join(PHRASE.split())}($|[^\\p{{L}}\\p{{N}}])')"
    )
    all_documents = f"SELECT doc_id, lang, source FROM documents WHERE list_has_all({_tokens('text')}, {ALL_QUERY.split()})"
    suggested = f"WITH {CV} ({_suggest('username')}) UNION ALL ({_suggest('email')})"
    return {
        "journal_scan": f"WITH {UJ} SELECT {JOURNAL_COLUMNS} FROM uj",
        "department_journal_scan": f"WITH {DJ} SELECT entity_id, seq_nr, strftime(ts, {STAMP}) AS ts, kind, name, description, tag, timebucket FROM dj",
        "events_by_entity": f"WITH {UJ} SELECT {JOURNAL_COLUMNS} FROM uj WHERE entity_id = '42' AND seq_nr >= 5 ORDER BY seq_nr",
        "events_by_tag": one_tag,
        "events_from_offset": resumed,
        "events_since_bucket": f"WITH {UJ} SELECT {JOURNAL_COLUMNS} FROM uj WHERE ts >= TIMESTAMP '2024-01-20'",
        "event_envelopes": f'WITH {UJ} SELECT entity_id, seq_nr AS "offset", strftime(ts, {STAMP}) AS created_at FROM uj',
        "oneof_events": f"""WITH {UJ}, k AS (SELECT event_id, entity_id, kind, CASE WHEN kind = 'created' THEN username END AS username,
  CASE WHEN kind IN ('created', 'emailUpdated') THEN email END AS email, CASE WHEN kind IN ('created', 'addressUpdated') THEN address END AS address,
  CASE WHEN kind IN ('created', 'departmentUpdated') THEN department_id END AS department_id FROM uj)
SELECT event_id, entity_id, kind, username, email, {ADDRESS}, department_id FROM k""",
        "timestamp_codec": "SELECT event_id, epoch_us(ts) // 1000000 AS seconds, (epoch_us(ts) % 1000000 * 1000)::INTEGER AS nanos, true AS same FROM events",
        "shard_tags": f"WITH {UJ} SELECT DISTINCT entity_id, tag FROM uj",
        "tag_view": f"""WITH {UJ} SELECT tag, timebucket, entity_id, seq_nr,
  row_number() OVER (PARTITION BY tag, entity_id ORDER BY seq_nr) AS tag_pid_sequence_nr, strftime(ts, {STAMP}) AS ts FROM uj""",
        "tag_write_progress": f"""WITH {UJ} SELECT entity_id, tag, max(seq_nr) AS seq_nr, count(*) AS tag_pid_sequence_nr,
  strftime(max(ts), {STAMP}) AS "offset" FROM uj GROUP BY entity_id, tag""",
        "entity_ids": "SELECT DISTINCT user_id::VARCHAR AS entity_id FROM events",
        "projection_offsets": f"""WITH {UJ}, {DJ}, lasts AS (
  SELECT tag, max({{'ts': ts, 'id': entity_id, 'nr': seq_nr}}) AS m FROM uj GROUP BY tag
  UNION ALL SELECT tag, max({{'ts': ts, 'id': entity_id, 'nr': seq_nr}}) FROM dj GROUP BY tag)
SELECT p AS projection, tag, strftime(m.ts, {STAMP}) AS ts, m.id AS entity_id, m.nr AS seq_nr
FROM lasts JOIN (VALUES ('userView'), ('userKafka'), ('departmentView'), ('departmentKafka')) v(p) ON lower(tag[1]) = p[1]""",
        "time_buckets": f"WITH {UJ} SELECT tag, timebucket, count(*) AS events FROM uj GROUP BY tag, timebucket",
        "union_of_tags": f"WITH {UJ} SELECT {JOURNAL_COLUMNS} FROM uj",
        "text_id_tags": f"WITH {text_ids} SELECT DISTINCT entity_id, {_tag('entity_id', 'UserEvent')} AS tag, {_tag('entity_id', 'UserEvent', 2)} AS safe_tag FROM ti",
        "text_id_union": f"WITH {text_ids} SELECT entity_id, seq_nr, {_tag('entity_id', 'UserEvent')} AS tag FROM ti",
        "text_id_lookup": f"""WITH {text_ids} SELECT entity_id, seq_nr, {_tag('entity_id', 'UserEvent', 2)} AS tag FROM ti
  WHERE entity_id IN ('polygenelubricants', 'user id 42', 'user id 1')""",
        "tag_counts": f"""WITH {UJ} SELECT 'UserEvent' || n AS tag, (SELECT count(*) FROM uj WHERE tag = 'UserEvent' || n) AS events FROM range(3) r(n)""",
        "user_view": view,
        "department_view": department_view,
        "incremental_view": view,
        "merged_view": view,
        "user_state": state,
        "department_state": f"""WITH {DJ}, {_marked('dj', 'marked')}, eff AS (
  SELECT *, max(seq_nr) OVER (PARTITION BY entity_id) AS mx FROM marked)
SELECT entity_id AS id, max(mx) AS last_seq, arg_max(name, seq_nr) FILTER (effective AND kind <> 'removed') AS name,
       arg_max(description, seq_nr) FILTER (effective AND kind <> 'removed') AS description
FROM eff GROUP BY entity_id HAVING arg_max(kind, seq_nr) FILTER (kind IN ('created', 'removed')) = 'created'""",
        "user_state_as_of": _user_state(f"SELECT * FROM uj WHERE ts <= TIMESTAMP '{CUT}'"),
        "read_user_state": _user_state("SELECT * FROM uj WHERE entity_id = '42'"),
        "user_history": f"WITH {UJ}, {_user_history('uj')} SELECT entity_id, seq_nr, kind, present, username, email, {ADDRESS}, department_id FROM hist",
        "snapshot_points": f"""WITH {UJ}, {_user_history('uj')}
SELECT entity_id, seq_nr, present, username, email, {ADDRESS}, department_id FROM hist WHERE seq_nr % {SNAPSHOT_EVERY} = 0
QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY seq_nr DESC) <= 2""",
        "recover_from_snapshot": state,
        "recover_tail": state,
        "validate_address": f"WITH {COMMANDS} SELECT cmd_id, array_to_string({ADDRESS_ERRORS}, ', ') AS errors FROM uc",
        "validate_fields": f"""WITH {COMMANDS}, sent AS (
  SELECT cmd_id, kind, CASE WHEN cmd_id % 7 = 0 THEN 'ab' ELSE username END AS username,
         CASE WHEN cmd_id % 5 = 0 THEN replace(email, '@', '.') ELSE email END AS email,
         CASE WHEN cmd_id % 8 = 0 THEN 'abc' ELSE 'pass' || cmd_id END AS pass, CASE WHEN cmd_id % 3 = 0 THEN 'U' ELSE address.country END AS country FROM uc)
SELECT cmd_id, concat_ws(', ',
  CASE WHEN kind = 'create' AND length(username) < 4 THEN 'username must have at least 4 characters' END,
  CASE WHEN kind IN ('create', 'changeEmail') AND NOT contains(email, '@') THEN 'email must be an email address' END,
  CASE WHEN kind = 'create' AND length(pass) < 4 THEN 'pass must have at least 4 characters' END,
  CASE WHEN kind IN ('create', 'changeAddress') AND length(country) < 2 THEN 'address.country must have at least 2 characters' END) AS errors
FROM sent""",
        "authz_rejects": f"{mixed} SELECT cmd_id, entity_id, kind, reply_kind, errors FROM rej",
        "dept_exists_as_of": f"WITH {DEPARTMENT_DECISIONS}, {COMMANDS}, {AS_OF} SELECT cmd_id, kind, department_id, department_exists FROM seen",
        "department_gate_events": f"WITH {DEPARTMENT_DECISIONS} SELECT entity_id, seq_nr, strftime(ts, {STAMP}) AS ts, kind, name, description FROM de",
        "department_gate_replies": f"""WITH {DEPARTMENT_DECISIONS}
SELECT cmd_id, entity_id, reply_kind, reply_kind IN ('Created', 'Updated', 'Removed') AS ok,
  CASE reply_kind WHEN 'AlreadyExists' THEN 'Department already exists' WHEN 'NotExists' THEN 'Department not exists'
       ELSE 'Department ' || lower(reply_kind) END AS message FROM dd""",
        "user_gate_events": gate_events,
        "user_gate_replies": f"{decisions} SELECT cmd_id, entity_id, present, event_kind, reply_kind, errors FROM decided",
        "replied_states": f"""{decisions}, seen_after AS (
  SELECT cmd_id, entity_id, coalesce(event_kind = 'created', false) OR (present AND event_kind IS DISTINCT FROM 'removed') AS found,
         {_last_set('username', "'created'")} AS n, {_last_set('email', "'created', 'emailUpdated'")} AS e,
         {_last_set('address', "'created', 'addressUpdated'")} AS a, {_last_set('department_id', "'created', 'departmentUpdated'")} AS d
  FROM decided)
SELECT cmd_id, entity_id, found, {ADDRESS}, CASE WHEN found THEN n END AS username, CASE WHEN found THEN e END AS email,
       CASE WHEN found THEN d END AS department_id FROM (SELECT *, CASE WHEN found THEN a END AS address FROM seen_after) s""",
        "reply_messages": f"{decisions} SELECT cmd_id, entity_id, reply_kind, {OK} AS ok, {GRPC_MESSAGE} AS message FROM decided",
        "reply_messages_rest": f"""{decisions} SELECT cmd_id, entity_id, reply_kind, {OK} AS ok,
  CASE WHEN {OK} THEN entity_id ELSE {GRPC_MESSAGE} END AS message,
  CASE WHEN {OK} THEN 200 WHEN kind = 'remove' THEN 404 ELSE 400 END AS status FROM decided""",
        "service_replies": f"""{mixed} SELECT cmd_id, entity_id, reply_kind, {OK} AS ok, {GRPC_MESSAGE} AS message FROM decided
UNION ALL SELECT cmd_id, entity_id, reply_kind, false AS ok, CASE WHEN reply_kind = 'Unauthenticated' THEN reply_kind
  WHEN kind = 'create' THEN 'User register error (' || errors || ')' ELSE 'User email update error (' || errors || ')' END AS message FROM rej""",
        "secured_events": f"""{mixed}
SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY ts, cmd_id) AS seq_nr, event_kind AS kind,
       CASE WHEN event_kind IN ('created', 'emailUpdated') THEN email END AS email,
       CASE WHEN event_kind IN ('created', 'passwordUpdated') THEN sha256('pepper' || 'pass' || cmd_id) END AS pass FROM decided WHERE event_kind IS NOT NULL""",
        "gated_state": f"WITH {_user_decisions()}, {_user_view('ue')} SELECT {USER_COLUMNS} FROM uv",
        "get_user": f"{view} WHERE id = '42'",
        "list_users": customers,
        "get_department": f"{department_view} WHERE id = 'd1'",
        "search_all_page": f"{view} ORDER BY lower(username), id LIMIT 10",
        "search_terms": f"{customers} WHERE {_any(['machinery', 'd3'])}",
        "search_all_terms": f"{customers} WHERE ({_any(['machinery'])}) AND ({_any(['d3'])})",
        "search_phrase": f"{customers} WHERE " + " OR ".join(
            f"regexp_matches(lower(coalesce({f}, '')), '(^|[^\\p{{L}}\\p{{N}}])city[^\\p{{L}}\\p{{N}}]+7($|[^\\p{{L}}\\p{{N}}])')" for f in _FIELDS),
        "search_phrase_documents": phrase_documents,
        "lookup_phrase_documents": phrase_documents,
        "search_prefix": f"{customers} WHERE " + " OR ".join(
            f"len(list_filter({_tokens(f)}, lambda w: starts_with(w, 'mach'))) > 0" for f in _FIELDS),
        "search_phrase_prefix": f"{customers} WHERE regexp_matches(address.city, '^city 1')",
        "search_far_page": f"{customers} ORDER BY lower(address.city) DESC, id LIMIT 20 OFFSET 120",
        "search_field": f"{customers} WHERE {_any(['12'], ('address.number',))}",
        "search_field_sorted": f"{customers} WHERE {_any(['machinery'], ('email',))} ORDER BY lower(address.city) DESC, lower(username), id LIMIT 20 OFFSET 40",
        "search_count": f"WITH {CV} SELECT count(*) AS count FROM cv WHERE {_any(['machinery', 'd3'])}",
        "search_departments": f"{department_view} WHERE {_any(['d2', 'dep3', 'dep9'], ('id', 'name', 'description'))}",
        "search_documents": all_documents,
        "lookup_search_documents": all_documents,
        "search_stream_pages": f"""WITH {CV}, hits AS (SELECT * FROM cv WHERE {_any(['machinery', 'd3'])})
SELECT ((row_number() OVER (ORDER BY lower(username) DESC, id) - 1) // 20)::INTEGER AS page, id, username FROM hits""",
        "search_seek_pages": f"""WITH {CV}, hits AS (SELECT id, username, department_id AS d FROM cv WHERE {_any(['machinery', 'd3'])}),
placed AS (SELECT *, row_number() OVER (ORDER BY d DESC, lower(username), id) - 1 AS position FROM hits),
behind AS (SELECT * FROM placed WHERE d < 'd3' OR (d = 'd3' AND lower(username) > 'customer#000000050x') ORDER BY position LIMIT 20)
SELECT (position // 20)::INTEGER AS page, id, username FROM placed WHERE position < 60 UNION ALL SELECT 99, id, username FROM behind""",
        "custom_fold_runs": f"""WITH {UJ}, marked AS (
  SELECT entity_id, kind, seq_nr, seq_nr - row_number() OVER (PARTITION BY entity_id, kind ORDER BY seq_nr) AS island FROM uj),
runs AS (SELECT entity_id, kind, count(*) AS n, min(seq_nr) AS first_seq FROM marked GROUP BY entity_id, kind, island)
SELECT entity_id, kind, n, first_seq FROM runs QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, first_seq) = 1""",
        "suggest_users": suggested,
        "lookup_suggest_users": suggested,
        "suggest_lists": f"""WITH {CV}, s AS (({_suggest('username', 'c1')}) UNION ALL ({_suggest('email', 'c1')}))
SELECT prefix, property, coalesce((SELECT string_agg(text, ',' ORDER BY rank) FROM s WHERE s.property = p.property AND prefix = 'c1'), '') AS texts
FROM (VALUES ('username'), ('email')) p(property), (VALUES ('c1'), ('')) x(prefix)""",
        "bm25_documents": f"{_bm25()} SELECT doc_id, score FROM scored",
        "bm25_top": f"{_bm25()} SELECT doc_id, score FROM scored ORDER BY score DESC, doc_id LIMIT 10",
        "search_relevance": _bm25(
            "machinery d3 city 7", "texts", "id", f"{CV}, texts AS (SELECT id, concat_ws(' ', {', '.join(_FIELDS)}) AS text FROM cv),"
        ) + f" SELECT {USER_COLUMNS}, score FROM scored JOIN cv USING (id) ORDER BY score DESC, id LIMIT 20 OFFSET 20",
        "dangling_departments": f"{both} SELECT {USER_COLUMNS} FROM uv WHERE department_id IS NOT NULL AND department_id NOT IN (SELECT id FROM dv)",
        "placed_departments": f"{both} SELECT {USER_COLUMNS} FROM uv WHERE department_id IN (SELECT id FROM dv)",
        "view_documents": f"WITH {UJ}, {_user_view('uj')} SELECT id, {document} AS document FROM uv",
        "view_documents_decoded": view,
        "republish_records": f"WITH {UJ} {_json('seq_nr', 'c-user', _USER_PAYLOAD)} FROM uj",
        "republish_department_records": f"WITH {DJ} {_json('seq_nr', 'c-department', _DEPARTMENT_PAYLOAD)} FROM dj",
        "stored_journal_lookup": f"WITH {UJ} SELECT {JOURNAL_COLUMNS} FROM uj WHERE entity_id = '42'",
        "stored_view": view,
        "stream_user_view": view,
        "stream_resumed_view": view,
        "stream_department_view": department_view,
        "stream_republish": records,
        "stream_republish_departments": f"WITH {DJ} {_json('seq_nr', 'c-department', _DEPARTMENT_PAYLOAD)} FROM dj",
        "stream_gate": gate_events,
        "stream_keyed_gate": gate_events,
        "stream_state_view": view,
        "stream_republish_once": records,
        "stream_from_offsets": resumed,
        "stream_events_by_entity": f"WITH {UJ} SELECT {JOURNAL_COLUMNS} FROM uj WHERE entity_id = '7' AND seq_nr >= 5",
        "stream_events_by_tag": one_tag,
        "projection_ledger": f"""WITH {UJ}, lasts AS (SELECT tag, max({{'ts': ts, 'id': entity_id, 'nr': seq_nr}}) AS m FROM uj GROUP BY tag)
SELECT 'userView' AS projection, tag, strftime(m.ts, {STAMP}) AS ts, m.id AS entity_id, m.nr AS seq_nr FROM lasts""",
        "projection_ledger_view": view,
        "projection_lag": f"WITH {UJ} SELECT 'userView' AS projection, tag, count(*) FILTER (ts >= TIMESTAMP '{CUT}') AS lag FROM uj GROUP BY tag",
    }
