"""Text, evidence and scalar function queries."""

from pyspark.sql import functions as F

from stintwise.constants import QUALI_LIKE, SESSION_KEYS, WEEKEND_KEYS
from stintwise.functions import expressions as X
from stintwise.functions import text_rules as R
from stintwise.operators import evidence as V
from stintwise.operators import pace as P
from stintwise.operators import text as T
from stintwise.plans.columns import rounded, sql_text
from stintwise.plans.registry import ORACLES, query
from stintwise.plans.season import LABEL
from stintwise.plans.telemetry import GK
from stintwise.sources.notes import incident_messages

RESULT = [*SESSION_KEYS, "driver"]


def sql_list(items) -> str:
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


# --- scalar functions -------------------------------------------------------


@query(
    "fn_points",
    f"""SELECT {GK}, driver, coalesce([25,18,15,12,10,8,6,4,2,1][position], 0) AS race_points, coalesce([8,7,6,5,4,3,2,1][position], 0) AS sprint_points,
    CASE session_type WHEN 'SPRINT' THEN coalesce([8,7,6,5,4,3,2,1][position], 0) ELSE coalesce([25,18,15,12,10,8,6,4,2,1][position], 0) END AS points FROM results""",
)
def _(t):
    p = F.col("position")
    return t.results.select(
        *RESULT,
        X.race_points(p).alias("race_points"),
        X.sprint_points(p).alias("sprint_points"),
        X.points_for_session(F.col("session_type"), p).alias("points"),
    )


@query(
    "fn_compound_letter",
    f"""SELECT {GK}, driver, lap_number, CASE WHEN tyre_age = 3 THEN '?' WHEN tyre_age = 5 THEN 'H' WHEN tyre_age = 6 THEN 'I' ELSE left(compound, 1) END AS letter FROM laps""",
)
def _(t):
    age = F.col("tyre_age")
    compound = (
        F.when(age == 3, F.lit(None))
        .when(age == 5, "hypersoft")
        .when(age == 6, "Intermediate")
        .otherwise(F.col("compound"))
    )
    return t.laps.select(*RESULT, "lap_number", X.compound_letter(compound).alias("letter"))


@query(
    "fn_compound_tags",
    """SELECT year, round, session_type, constructor, string_agg(left(compound, 1), ',' ORDER BY seen) AS compounds
    FROM (SELECT year, round, session_type, constructor, compound, min(stint_number * 1000000 + driver) AS seen FROM laps GROUP BY ALL) GROUP BY ALL""",
)
def _(t):
    return P.compound_tags(t.laps, P.TEAM_KEYS)


@query(
    "fn_total_time",
    f"""SELECT {GK}, driver, CASE WHEN clock_s >= 3600 THEN printf('%d:%02d:%06.3f', CAST(floor(clock_s / 3600) AS INT), CAST(floor(clock_s % 3600 / 60) AS INT), clock_s % 60)
    ELSE printf('%d:%06.3f', CAST(floor(clock_s % 3600 / 60) AS INT), clock_s % 60) END AS total_time FROM done""",
)
def _(t):
    clock = t.laps.groupBy(*RESULT).agg(F.max("session_time_s").alias("clock_s"))
    return clock.select(*RESULT, X.format_total_time(F.col("clock_s")).alias("total_time"))


@query(
    "fn_laps_down",
    f"""SELECT {GK}, driver, coalesce(status = 'Lapped', false) OR laps < leader_laps AS lapped,
    CASE WHEN leader_laps > laps THEN CAST(leader_laps - laps AS INT) END AS laps_down FROM results""",
)
def _(t):
    status, laps, lead = F.col("status"), F.col("laps"), F.col("leader_laps")
    return t.results.select(
        *RESULT,
        X.is_lapped(status, laps, lead).alias("lapped"),
        X.laps_down(laps, lead).alias("laps_down"),
    )


@query("fn_gap_label", f"SELECT {GK}, driver, {LABEL} AS gap_label FROM results")
def _(t):
    label = X.format_gap_label(
        F.col("position"), F.col("gap_to_leader_s"), F.col("laps"), F.col("leader_laps"), F.col("status")
    )
    return t.results.select(*RESULT, label.alias("gap_label"))


@query("fn_mph", "SELECT lap_id, sample_idx, round(speed_kmh * CAST(0.621371 AS DOUBLE), 6) AS mph FROM tel")
def _(t):
    speeds = F.posexplode("speed_kmh").alias("_i", "v")
    rows = t.telemetry.select("lap_id", speeds)
    return rounded(
        rows.select("lap_id", (F.col("_i") + 1).alias("sample_idx"), X.mph(F.col("v")).alias("mph"))
    )


@query(
    "fn_safe_cast",
    """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k, TRY_CAST(event_type AS INT) AS bad_int,
    TRY_CAST(props AS DOUBLE) AS bad_double FROM events""",
)
def _(t):
    return t.raw("events").select(
        "event_id",
        F.get_json_object("props", "$.k").try_cast("int").alias("k"),
        F.col("event_type").try_cast("int").alias("bad_int"),
        F.col("props").try_cast("double").alias("bad_double"),
    )


@query(
    "fn_round_prose_numbers",
    """SELECT doc_id, constructor || ' ran ' || CASE WHEN big >= 50 THEN rtrim(rtrim(printf('%.1f', big), '0'), '.') ELSE rtrim(rtrim(printf('%.3f', big), '0'), '.') END
      || ' and ' || rtrim(rtrim(printf('%.3f', small), '0'), '.') || ' of 1.25' AS text
    FROM (SELECT doc_id, constructor, CAST(printf('%.7f', gap_s * 40 + 0.0123457) AS DOUBLE) AS big, CAST(printf('%.6f', gap_s + 0.000321) AS DOUBLE) AS small FROM note_rows)""",
)
def _(t):
    text = F.format_string(
        "%s ran %.7f and %.6f of 1.25",
        "constructor",
        F.col("gap_s") * 40 + F.lit(0.0123457),
        F.col("gap_s") + F.lit(0.000321),
    )
    return t.note_rows.select("doc_id", T.round_prose_numbers(text).alias("text"))


@query(
    "fn_format_lap_times",
    f"""SELECT {GK}, driver, lap_number, 'Lap of ' || CAST(floor(lap_time_s / 60) AS INT) || ':' || printf('%06.3f', lap_time_s % 60) || ' and ' || printf('%.3f', sector1_s + 1e-9) || ' seconds in sector 1'
    AS text FROM laps""",
)
def _(t):
    text = F.format_string(
        "Lap of %.3f seconds and %.3f seconds in sector 1",
        "lap_time_s",
        F.col("sector1_s") + F.lit(1e-9),
    )
    return t.laps.select(*RESULT, "lap_number", T.format_lap_times(text).alias("text"))


DASHES = """replace(replace(replace(replace({0}, ' — ', ', '), '—', ', '), ' – ', ' - '), '–', '-')"""


@query(
    "fn_strip_dashes",
    f"""SELECT doc_id, {DASHES.format("replace(text, ' de ', ' — ') || '–'")} AS text FROM texts""",
)
def _(t):
    dashed = F.concat(F.replace("text", F.lit(" de "), F.lit(" — ")), F.lit("–"))
    return t.texts.select("doc_id", T.strip_em_dashes(dashed).alias("text"))


@query(
    "fn_first_sentence",
    r"""SELECT doc_id, CASE WHEN regexp_matches(x, '(?s)^.*?[.!?][ \t\n\r\f\v]') THEN regexp_extract(x, '(?s)^(.*?[.!?])[ \t\n\r\f\v]', 1) ELSE x END AS sentence
    FROM (SELECT doc_id, regexp_replace(text, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g') AS x FROM texts)""",
)
def _(t):
    return t.texts.select("doc_id", T.first_sentence(F.col("text")).alias("sentence"))


@query(
    "fn_bind_units",
    r"""SELECT doc_id, regexp_replace(text, '(~?\d[\d.,]*)\s+(seconds?|sec|metres?|meters?|km/h|kph|mph|m/s²|m|s|%)\b', '\1' || chr(160) || '\2', 'gi') AS text FROM texts""",
)
def _(t):
    return t.texts.select("doc_id", T.bind_units(F.col("text")).alias("text"))


@query("fn_measurement_tokens")
def _(t):
    tokens = F.posexplode(T.measurement_tokens(F.col("text"))).alias("nth", "token")
    return t.texts.select("doc_id", tokens)


@query(
    "fn_driver_name",
    """SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'Max Verstappen' WHEN 1 THEN 'Lando Norris' WHEN 2 THEN 'ZZZ' ELSE '' END AS driver_name FROM events""",
)
def _(t):
    u = F.col("user_id") % 4
    code = F.when(u == 0, "VER").when(u == 1, "NOR").when(u == 2, "ZZZ")
    return t.raw("events").select("event_id", X.driver_name(code).alias("driver_name"))


MAIL = """CASE event_id % 4 WHEN 0 THEN ' User' || user_id || '@Example.COM ' WHEN 1 THEN 'user' || user_id || '@host' WHEN 2 THEN 'a b' || user_id || '@example.org' ELSE 'u.' || user_id || '@mail.example.org' END"""


@query(
    "fn_normalize_email",
    rf"""SELECT event_id, CASE WHEN length(m) <= 254 AND regexp_full_match(m, '[^@\s]{{1,64}}@[^@\s.]+(\.[^@\s.]+)+') THEN m END AS email
    FROM (SELECT event_id, lower(trim({MAIL})) AS m FROM events)""",
)
def _(t):
    return t.raw("events").select(
        "event_id", X.normalize_email(F.expr(MAIL)).alias("email")
    )


@query("fn_token_hash", "SELECT event_id, sha256(event_type || event_id) AS token_hash FROM events")
def _(t):
    token = F.concat("event_type", F.col("event_id").cast("string"))
    return t.raw("events").select("event_id", F.sha2(token, 256).alias("token_hash"))


@query(
    "fn_json_items",
    """SELECT event_id, s AS slot, CASE s WHEN 1 THEN event_type ELSE 'user ]' || user_id END AS header FROM events, (VALUES (1), (2)) v(s) WHERE event_id % 3 <> 0""",
)
def _(t):
    events = t.raw("events")
    broken = F.col("event_id") % 3 == 0
    text = F.format_string(
        'Here they are: [{"header": "%s"}, {"%s": "user ]%d"}] note [x] {',
        F.col("event_type"),
        F.when(broken, "other").otherwise("header"),
        F.col("user_id"),
    )
    good, _ = T.parsed_items(events.select("event_id", text.alias("text")), ["header"], 2)
    return good


@query(
    "fn_json_rejects",
    """SELECT event_id FROM events WHERE event_id % 3 = 0""",
)
def _(t):
    broken = F.col("event_id") % 3 == 0
    text = F.when(broken, '[{"header": "a"}').otherwise('[{"header": "a"}] end')
    _, bad = T.parsed_items(
        t.raw("events").select("event_id", text.alias("text")), ["header"], 1
    )
    return bad.select("event_id")


@query(
    "fn_to_json",
    f"""SELECT {GK}, driver, '{{"driver":' || driver || ',"constructor":"' || constructor || '","refs":[' || position || ',' || CAST(laps AS INT) || ']}}' AS refs FROM results""",
)
def _(t):
    refs = F.to_json(
        F.struct(
            "driver", "constructor", F.array("position", F.col("laps").cast("int")).alias("refs")
        )
    )
    return t.results.select(*RESULT, refs.alias("refs"))


@query(
    "fn_int_map_keys",
    "SELECT lap_id, corner_number, round(min_speed_kmh, 6) AS kmh FROM corner_speed WHERE lap_id IN (SELECT lap_id FROM fast_rep)",
)
def _(t):
    text_map = F.map_from_entries(
        F.collect_list(F.struct(F.col("corner_number").cast("string"), "min_speed_kmh"))
    )
    maps = t.quali_corners.groupBy("lap_id").agg(F.to_json(text_map).alias("stored"))
    numbered = F.transform_keys(
        F.from_json("stored", "map<string, double>"), lambda k, v: k.cast("int")
    )
    return rounded(maps.select("lap_id", F.explode(numbered).alias("corner_number", "kmh")))


# --- flags ------------------------------------------------------------------


def phrase_sql(phrases: list[str]) -> str:
    return f"""SELECT doc_id, 'phrase' AS rule, detail FROM texts, (SELECT unnest({sql_list(phrases)}) AS detail) WHERE contains(lower(text), detail)"""


PHRASE_SQL = phrase_sql(R.PHRASES)
WATCHED = [*R.PHRASES, "license", "whst the"]


@query("phrase_flags", phrase_sql(WATCHED))
def _(t):
    return T.phrase_flags(t.texts, WATCHED)


@query("pattern_flags")
def _(t):
    return T.pattern_flags(t.texts)


@query(
    "lap_context_flags",
    r"""SELECT doc_id, 'lap_context' AS rule, regexp_extract(lower(text), 'on lap \d+') AS detail FROM notes WHERE regexp_matches(lower(text), 'on lap \d+')
    AND NOT regexp_matches(lower(text), 'collision|noted') AND regexp_matches(lower(text), 'retired|overtook')""",
)
def _(t):
    return T.lap_context_flags(t.texts)


HINT_SQL = "\n".join(
    f"WHEN lower(detail) = {sql_text(k)} THEN {sql_text(v)}" for k, v in R.PHRASE_HINTS.items()
) + "\n" + "\n".join(
    f"WHEN contains(lower(detail), {sql_text(k)}) THEN {sql_text(v)}" for k, v in R.ISSUE_HINTS
)


@query(
    "fix_hints",
    rf"""WITH f AS (SELECT doc_id, detail FROM ({PHRASE_SQL}) UNION ALL SELECT doc_id, {sql_text(R.ISSUES['session_code'])} FROM notes WHERE regexp_matches(text, '\b(?:SQ|Q)\b'))
    SELECT DISTINCT doc_id, hint FROM (SELECT doc_id, CASE {HINT_SQL} END AS hint FROM f) WHERE hint IS NOT NULL""",
)
def _(t):
    flags = T.phrase_flags(t.texts).unionByName(V.session_codes(t.notes))
    return T.fix_hints(flags)


@query(
    "incident_events",
    """WITH m AS (SELECT CAST(month(ts) AS INT) AS round, event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(user_id % 60 + 1 AS INT) END AS lap,
      CASE WHEN event_type <> 'signup' THEN printf('D%02d', user_id % 100) END AS driver,
      CASE event_type WHEN 'error' THEN 'collision' WHEN 'purchase' THEN 'penalty' WHEN 'signup' THEN 'safety_car' WHEN 'view' THEN 'retirement' END AS kind,
      CASE event_type WHEN 'error' THEN printf('TURN 4 INCIDENT INVOLVING CAR (D%02d) NOTED - CAUSING A COLLISION', user_id % 100) WHEN 'purchase' THEN printf('5 SECOND TIME PENALTY FOR CAR (D%02d)', user_id % 100)
        WHEN 'signup' THEN 'SAFETY CAR DEPLOYED' ELSE printf('CAR (D%02d) STOPPED ON TRACK', user_id % 100) END AS message FROM events WHERE event_type <> 'click')
    SELECT round, lap, driver, kind, message FROM m QUALIFY row_number() OVER (PARTITION BY round, driver, kind, message ORDER BY event_id) = 1""",
)
def _(t):
    return T.incident_events(incident_messages(t.raw("events")), ["round"])


@query(
    "dedup_events",
    """SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL""",
)
def _(t):
    from stintwise.functions.skew import first_by

    events = t.raw("events").select("user_id", "event_type", "event_id")
    return first_by(events, ["user_id", "event_type"], "event_id")


@query(
    "events_by_lap",
    f"""SELECT round, driver, lap, kind, message, row_number() OVER (PARTITION BY round, driver ORDER BY lap NULLS LAST, kind, message) AS nth
    FROM ({ORACLES["incident_events"]})""",
)
def _(t):
    """Every car's notable messages in the order of laps, from the incident table."""
    incidents = T.incident_events(incident_messages(t.raw("events")), ["round"])
    return T.events_by_lap(incidents, ["round"])


# --- evidence ---------------------------------------------------------------


@query("prose_quantities", "SELECT doc_id, nth, value FROM quantities")
def _(t):
    return V.prose_quantities(t.texts)


@query("evidence_numbers", "SELECT doc_id, tool, value FROM numbers")
def _(t):
    return V.evidence_numbers(t.evidence)


@query(
    "untraceable_numbers",
    r"""WITH q AS (SELECT DISTINCT doc_id, value FROM quantities),
    flat AS (SELECT doc_id, CAST(unnest(regexp_extract_all(item, '[-+]?(?:\d+\.\d+|\d+)(?:[eE][-+]?\d+)?')) AS DOUBLE) AS n FROM evidence)
    SELECT doc_id, value FROM q WHERE doc_id IN (SELECT doc_id FROM evidence)
    AND NOT EXISTS (SELECT 1 FROM flat f WHERE f.doc_id = q.doc_id AND abs(f.n - q.value) <= greatest(1e-4 * greatest(abs(f.n), abs(q.value)), 1e-3))
    AND NOT EXISTS (SELECT 1 FROM evidence e WHERE e.doc_id = q.doc_id AND (contains(e.item, q.value::VARCHAR) OR contains(e.item, printf('%.1f', q.value)) OR contains(e.item, printf('%.2f', q.value))
        OR contains(e.item, printf('%.3f', q.value)) OR contains(e.item, round_even(q.value, 1)::VARCHAR) OR (q.value = floor(q.value) AND contains(e.item, CAST(q.value AS BIGINT)::VARCHAR))))""",
)
def _(t):
    return V.untraceable_numbers(t.texts, t.evidence)


def source_sql(narrow: str, rule: str) -> str:
    return f"""WITH q AS (SELECT DISTINCT doc_id, value FROM quantities), h AS (SELECT q.doc_id, q.value, coalesce(bool_or({narrow}), false) AS n_in, coalesce(bool_or(NOT ({narrow})), false) AS n_out
      FROM q LEFT JOIN numbers n ON n.doc_id = q.doc_id AND abs(n.value - q.value) <= greatest(1e-4 * greatest(abs(n.value), abs(q.value)), 1e-2) GROUP BY ALL)
    SELECT doc_id, '{rule}' AS rule, {sql_text(R.ISSUES[rule])} AS detail FROM h GROUP BY doc_id HAVING bool_and(n_in) AND NOT bool_or(n_out)"""


@query("results_only_flags", source_sql("tool IN ('get_session_results', 'get_race_control_events')", "results_only"))
def _(t):
    return V.single_source(t.texts, t.evidence, V.from_results(), "results_only")


@query("qualifying_only_flags", source_sql("tool IN ('get_quali_character', 'get_deployment')", "qualifying_only"))
def _(t):
    return V.single_source(t.texts, t.evidence, V.from_qualifying(), "qualifying_only")


@query(
    "false_causation",
    f"""SELECT doc_id, 'false_causation' AS rule, {sql_text(R.ISSUES['false_causation'])} AS detail FROM notes WHERE contains(text, 'retirement traces')
    AND doc_id NOT IN (SELECT doc_id FROM evidence WHERE tool = 'get_race_control_events' AND contains(item, 'collision'))""",
)
def _(t):
    return V.false_causation(t.texts, t.evidence)


@query(
    "sector_context_mismatch",
    f"""SELECT doc_id, 'sector_context' AS rule, {sql_text(R.ISSUES['sector_context'])} AS detail FROM notes WHERE contains(text, 'seconds off in qualifying through sector')""",
)
def _(t):
    return V.sector_context_mismatch(t.texts, t.evidence)


@query(
    "false_superlative",
    """SELECT doc_id, 'false_superlative' AS rule, printf('lowest-clip/deployment claim (%.1fm) but field minimum total_clip_m is %.1fm in tool trace', driver % 50 + 300.0, least(320.0, driver % 40 + 280.0)) AS detail
    FROM notes WHERE driver % 10 = 6 AND driver % 50 + 300 > least(320, driver % 40 + 280) + 0.5""",
)
def _(t):
    return V.false_superlative(t.texts, t.evidence)


@query(
    "weak_cluster",
    f"""SELECT doc_id, 'weak_cluster' AS rule, {sql_text(R.ISSUES['weak_cluster'])} AS detail FROM notes WHERE driver % 20 = 17 AND abs((driver % 90 + 340) - (driver % 7 + 300)) <= 100""",
)
def _(t):
    return V.weak_cluster(t.texts)


@query(
    "session_code_flags",
    rf"""SELECT doc_id, 'session_code' AS rule, {sql_text(R.ISSUES['session_code'])} AS detail FROM texts WHERE regexp_matches(text, '(?i)\b(?:\bin\s+)?(?:SQ|Q)\b|\bin\s+R\b|\b(?-i:SPRINT)\b')""",
)
def _(t):
    return V.session_codes(t.texts)


@query(
    "header_figure_flags",
    f"""SELECT doc_id, 'header_figure' AS rule, {sql_text(R.ISSUES['header_figure'])} AS detail FROM notes WHERE driver % 4 = 0""",
)
def _(t):
    return V.header_figures(t.notes)


TEAMS = [f"NATION_{k}" for k in range(25)]


@query(
    "cross_doc_conflict",
    f"""WITH r AS (SELECT year, round, doc_id, subject, CASE WHEN regexp_matches(l, 'slowest|lowest top speed|straight-line deficit') THEN 'slow' WHEN regexp_matches(l, 'fastest|highest top speed') THEN 'fast' END AS polarity,
       CASE WHEN contains(l, 'qualifying') OR contains(l, ' in q') OR starts_with(l, 'q ') THEN 1 ELSE 0 END + CASE WHEN contains(l, 'sprint') THEN 2 ELSE 0 END + CASE WHEN contains(l, ' race') THEN 4 ELSE 0 END AS tags
     FROM (SELECT *, lower(text) AS l FROM notes), (SELECT unnest({sql_list(TEAMS)}) AS subject) WHERE contains(l, lower(subject))),
    rr AS (SELECT * FROM r WHERE polarity IS NOT NULL),
    g AS (SELECT s.year, s.round, s.subject, bool_or(s.tags > 0 AND f.tags > 0 AND s.tags & f.tags = 0) AS apart FROM (SELECT * FROM rr WHERE polarity = 'slow') s JOIN (SELECT * FROM rr WHERE polarity = 'fast') f USING (year, round, subject) GROUP BY ALL)
    SELECT year, round, subject, doc_id, polarity FROM rr JOIN g USING (year, round, subject) WHERE NOT apart""",
)
def _(t):
    return V.cross_doc_conflict(t.notes, WEEKEND_KEYS, TEAMS)


def every_flag(t):
    evidence = t.evidence
    texts = lambda check: T.suspected(t.suspects, check)
    conflicts = V.cross_doc_conflict(t.notes, WEEKEND_KEYS, TEAMS).select(
        "doc_id", F.lit("conflict").alias("rule"), F.col("subject").alias("detail")
    )
    parts = [
        T.phrase_flags(texts("phrase")),
        T.pattern_flags(texts("pattern")),
        T.lap_context_flags(texts("lap_context")),
        V.false_causation(texts("false_causation"), evidence),
        V.sector_context_mismatch(texts("sector_context"), evidence),
        V.false_superlative(texts("false_superlative"), evidence),
        V.weak_cluster(texts("weak_cluster")),
        V.session_codes(texts("session_code")),
        V.header_figures(t.notes),
        V.single_source(texts("quantity"), evidence, V.from_results(), "results_only"),
        V.single_source(texts("quantity"), evidence, V.from_qualifying(), "qualifying_only"),
        conflicts,
    ]
    return V.doc_flags(texts("quantity"), evidence, parts)


@query("doc_flags")
def _(t):
    return every_flag(t)


@query(
    "trace_pairs",
    """SELECT c.conv_id AS run_id, c.turn, CAST(0 AS INT) AS nth, c.conv_id || '-' || c.turn AS call_id, c.role AS tool, r.text AS result
    FROM conversations c LEFT JOIN conversations r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1 AND r.role <> 'user' WHERE c.role = 'user'""",
)
def _(t):
    turns = t.raw("conversations")
    call_id = lambda turn: F.concat_ws("-", F.col("conv_id"), turn)
    calls = turns.where(F.col("role") == "user").select(
        F.col("conv_id").alias("run_id"),
        "turn",
        F.array(
            F.struct(call_id(F.col("turn")).alias("call_id"), F.col("role").alias("tool"))
        ).alias("calls"),
    )
    results = turns.where(F.col("role") != "user").select(
        F.col("conv_id").alias("run_id"),
        call_id(F.col("turn") - 1).alias("call_id"),
        F.col("text").alias("result"),
    )
    return V.trace_pairs(calls, results).select(
        "run_id", "turn", "nth", "call_id", "tool", "result"
    )


def cited_sql(pattern: str) -> str:
    plain, option = pattern.removeprefix("(?i)"), ", 'i'" if pattern.startswith("(?i)") else ", ''"
    return f"SELECT year, round, doc_id, unnest(regexp_extract_all(text, {sql_text(plain)}, 1{option}))::DOUBLE AS cited FROM notes"


def matched_sql(kind: str, pattern: str, measured: str, tol: float, missing: str, least: int = 0) -> str:
    return f"""SELECT year, round, '{kind}' AS kind, CASE WHEN EXISTS (SELECT 1 FROM ({measured}) v WHERE v.year = c.year AND v.round = c.round AND abs(v.m - cited) <= {tol}) THEN 'OK' ELSE {missing} END AS severity
      FROM ({cited_sql(pattern)}) c WHERE cited >= {least}"""


@query(
    "claim_audit",
    f"""WITH c AS (SELECT *, row_number() OVER () AS n FROM ({cited_sql(R.PACE_CLAIM)})),
    near AS (SELECT c.year, c.round, n, cited, arg_min(p.gap_s, (abs(p.gap_s - cited), p.constructor)) AS gap_s FROM c JOIN team_pace p USING (year, round) WHERE p.session_type = 'R' GROUP BY ALL),
    s AS (SELECT year, round, 'pace' AS kind, CASE WHEN abs(gap_s - cited) <= 0.02 THEN 'OK' WHEN abs(gap_s - cited) <= 0.1 THEN 'WARN' ELSE 'FAIL' END AS severity FROM near
      UNION ALL {matched_sql("speed", R.SPEED_CLAIM, "SELECT year, round, top_speed_kmh AS m FROM quali_row WHERE session_type IN ('Q', 'SQ')", 0.6, "'FAIL'")}
      UNION ALL {matched_sql("clip", R.CLIP_CLAIM, "SELECT year, round, total_clip_m AS m FROM clip_total WHERE session_type IN ('Q', 'SQ')", 2.0, "CASE WHEN cited >= 100 THEN 'WARN' END", 50)}
      UNION ALL {matched_sql("finish", R.FINISH_CLAIM, "SELECT year, round, gap_to_leader_s AS m FROM results WHERE session_type = 'R' AND gap_to_leader_s <> 0", 0.15, "'WARN'")})
    SELECT year, round, kind, severity, count(*) AS claims FROM s WHERE severity IS NOT NULL GROUP BY ALL""",
)
def _(t):
    def measured(rows, column: str, types: list[str]):
        return rows.where(F.col("session_type").isin(types)).select(*WEEKEND_KEYS, F.col(column).alias("measured"))

    race = t.team_pace.where(F.col("session_type") == "R").select(*WEEKEND_KEYS, "constructor", "gap_s")
    claims = V.audited_claims(
        t.notes,
        WEEKEND_KEYS,
        race,
        measured(t.quali_rows, "top_speed_kmh", QUALI_LIKE),
        measured(t.clips, "total_clip_m", QUALI_LIKE),
        measured(t.results, "gap_to_leader_s", ["R"]),
    )
    return V.claim_audit(claims, WEEKEND_KEYS)
