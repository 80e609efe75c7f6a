"""Checks that numbers and claims in texts trace to evidence rows.

Texts are (doc_id, group keys, header, text); evidence is (doc_id, tool, item) with one JSON record
per row. A text's few quantities travel to its evidence rows as one array, so evidence is scanned
once, nothing is gathered per text, and no quantity-by-number pairs become rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintwise.functions import text_rules as R
from stintwise.functions.expressions import isclose

from stintwise.operators.reads import nearest_value, tolerance_match
from stintwise.operators.text import matches, matches_in_context

STRINGS = r'"(?:\\.|[^"\\])*"'


def quantity_values(text: Column) -> Column:
    """Numbers with units, in order; the second group is a speed in parentheses."""
    first, second = matches(text, R.QUANTITY, 1), matches(text, R.QUANTITY, 2)
    return F.zip_with(first, second, lambda a, b: F.when(a != "", a).otherwise(b).cast("double"))


def prose_quantities(texts: DataFrame) -> DataFrame:
    return texts.select("doc_id", F.posexplode(quantity_values(F.col("text"))).alias("_i", "value")).select(
        "doc_id", (F.col("_i") + 1).alias("nth"), "value"
    )


def flat_numbers(item: Column) -> Column:
    """Every number in the record's text, those inside strings too."""
    return F.transform(matches(item, R.JSON_NUMBER), lambda n: n.cast("double"))


def leaf_numbers(item: Column) -> Column:
    """Numeric values of the record only, to three decimals."""
    bare = F.regexp_replace(item, STRINGS, '""')
    return F.transform(matches(bare, R.JSON_NUMBER), lambda n: F.bround(n.cast("double"), 3))


def evidence_numbers(evidence: DataFrame) -> DataFrame:
    return evidence.select("doc_id", "tool", F.explode(leaf_numbers(F.col("item"))).alias("value"))


def number_variants(value: Column) -> Column:
    whole = F.when(value == F.floor(value), F.floor(value).cast("string"))
    return F.filter(
        F.array(
            value.cast("string"),
            F.format_string("%.1f", value),
            F.format_string("%.2f", value),
            F.format_string("%.3f", value),
            F.bround(value, 1).cast("string"),
            whole,
        ),
        lambda v: v.isNotNull(),
    )


def cited(texts: DataFrame) -> DataFrame:
    """(doc_id, cited): the distinct quantities of each text that has any."""
    values = F.array_distinct(quantity_values(F.col("text")))
    return texts.select("doc_id", values.alias("cited")).where(F.size("cited") > 0)


def bound(value: Column, use) -> Column:
    """`use(value)` with `value` worked out once per row, though `use` is called per element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def untraceable_numbers(texts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Quantities found in no evidence of their text, for texts that have evidence."""
    quantities = cited(texts)
    written = quantities.select(
        "doc_id",
        F.transform(
            "cited", lambda q: F.struct(q.alias("value"), number_variants(q).alias("variants"))
        ).alias("cited"),
    )

    def traced(q: Column, numbers: Column) -> Column:
        return F.exists(q["variants"], lambda v: F.contains(F.col("item"), v)) | F.exists(
            numbers, lambda n: isclose(q["value"], n, 1e-4, 1e-3)
        )

    hits = bound(
        flat_numbers(F.col("item")), lambda ns: F.filter("cited", lambda q: traced(q, ns))
    )
    found = (
        evidence.join(written, "doc_id")
        .select("doc_id", F.explode(hits).alias("_q"))
        .select("doc_id", F.col("_q.value").alias("value"))
        .distinct()
    )
    backed = evidence.select("doc_id").distinct()
    return (
        quantities.select("doc_id", F.explode("cited").alias("value"))
        .join(backed, "doc_id", "left_semi")
        .join(found, ["doc_id", "value"], "left_anti")
    )


def candidate_session(item: Column) -> Column:
    """Session of a candidate's references, whether a record, a list or a wrapped list."""
    paths = [
        "$.source_refs.session_type",
        "$.source_refs[0].session_type",
        "$.source_refs.refs[0].session_type",
    ]
    return F.coalesce(*[F.get_json_object(item, p) for p in paths])


def from_qualifying() -> Column:
    category = F.get_json_object("item", "$.category")
    candidate = (F.col("tool") == "get_candidate_insights") & (
        (category == "quali_character")
        | ((category == "deployment") & candidate_session(F.col("item")).isin("Q", "SQ"))
    )
    return F.col("tool").isin(R.QUALIFYING_TOOLS) | F.coalesce(candidate, F.lit(False))


def from_results() -> Column:
    return F.col("tool").isin(R.RESULT_TOOLS)


def single_source(texts: DataFrame, evidence: DataFrame, narrow: Column, rule: str) -> DataFrame:
    """Texts all of whose quantities are in `narrow` evidence and none in any other."""
    held = bound(
        leaf_numbers(F.col("item")),
        lambda ns: F.filter(
            "cited", lambda q: F.exists(ns, lambda n: isclose(q, n, 1e-4, 1e-2))
        ),
    )
    hits = (
        evidence.withColumn("_narrow", narrow)
        .join(cited(texts), "doc_id")
        .select(
            "doc_id",
            "_narrow",
            F.size("cited").alias("_all"),
            F.explode(held).alias("value"),
        )
        .groupBy("doc_id", "value")
        .agg(
            F.max("_all").alias("_all"),
            F.bool_or("_narrow").alias("_in"),
            F.bool_or(~F.col("_narrow")).alias("_out"),
        )
    )
    return (
        hits.groupBy("doc_id")
        .agg(
            F.max("_all").alias("_all"),
            F.count_if("_in").alias("_in"),
            F.count_if("_out").alias("_out"),
        )
        .where((F.col("_in") == F.col("_all")) & (F.col("_out") == 0))
        .select("doc_id", F.lit(rule).alias("rule"), F.lit(R.ISSUES[rule]).alias("detail"))
    )


def false_causation(texts: DataFrame, evidence: DataFrame) -> DataFrame:
    """A retirement tied to a cause when race control only noted incidents."""
    low = F.lower("text")
    claims = texts.where(
        F.rlike(low, F.lit(R.RETIREMENT)) & F.rlike(low, F.lit(R.CAUSAL))
    ).select("doc_id", F.rlike(low, F.lit(r"\bincident\b")).alias("_says_incident"))
    kind = F.get_json_object("item", "$.kind")
    kinds = (
        evidence.where(F.col("tool") == "get_race_control_events")
        .groupBy("doc_id")
        .agg(
            F.bool_or(F.coalesce(kind.isin(R.CAUSE_KINDS), F.lit(False))).alias("_cause"),
            F.bool_and(F.coalesce(kind.isin(R.PLAIN_KINDS), F.lit(True))).alias("_plain"),
            F.bool_or(F.coalesce(kind == "incident", F.lit(False))).alias("_incident"),
        )
    )
    return (
        claims.join(kinds, "doc_id")
        .where(
            ~F.col("_cause")
            & F.col("_plain")
            & (F.col("_incident") | F.col("_says_incident"))
        )
        .select(
            "doc_id",
            F.lit("false_causation").alias("rule"),
            F.lit(R.ISSUES["false_causation"]).alias("detail"),
        )
    )


def practice_deficits(item: Column) -> Column:
    """Deficits of practice sector findings inside a candidate's references."""
    ref = "struct<type: string, deficit_s: double>"
    refs = F.coalesce(
        F.from_json(F.get_json_object(item, "$.source_refs.refs"), f"array<{ref}>"),
        F.from_json(F.get_json_object(item, "$.source_refs"), f"array<{ref}>"),
    )
    sector = F.filter(
        refs, lambda r: (r["type"] == "sector_delta") & r["deficit_s"].isNotNull()
    )
    return F.transform(sector, lambda r: F.bround(r["deficit_s"], 3))


def sector_context_mismatch(texts: DataFrame, evidence: DataFrame, width: int = 150) -> DataFrame:
    """A practice sector deficit told as a qualifying weakness."""
    found = matches_in_context(F.col("text"), R.SECTOR_DEFICIT, width)
    low = F.lower("_m.context")
    claims = (
        texts.select("doc_id", F.explode(found).alias("_m"))
        .where(
            F.rlike(low, F.lit(R.QUALIFYING_CONTEXT))
            & ~F.rlike(low, F.lit(R.PRACTICE_CONTEXT))
            & F.rlike(low, F.lit(R.SECTOR_CONTEXT))
        )
        .groupBy("doc_id")
        .agg(
            F.collect_set(
                F.regexp_extract("_m.match", R.SECTOR_DEFICIT, 1).cast("double")
            ).alias("_claimed")
        )
    )
    known = practice_deficits(F.col("item"))
    same = F.exists(
        "_claimed", lambda c: F.exists(known, lambda d: isclose(c, d, 1e-9, 1e-3))
    )
    return (
        evidence.where(F.col("tool") == "get_candidate_insights")
        .join(claims, "doc_id")
        .where(F.coalesce(same, F.lit(False)))
        .select("doc_id")
        .distinct()
        .select(
            "doc_id",
            F.lit("sector_context").alias("rule"),
            F.lit(R.ISSUES["sector_context"]).alias("detail"),
        )
    )


def metres(text: Column) -> Column:
    return F.transform(matches(text, R.CLIP_METRES, 1), lambda m: m.cast("double"))


def false_superlative(texts: DataFrame, evidence: DataFrame) -> DataFrame:
    """"Lowest" or "shortest" clip claims above the field's minimum."""
    low = F.lower("text")
    shortest = F.rlike(low, F.lit(R.SHORTEST_CLIP))
    lowest = F.rlike(F.col("text"), F.lit(R.FIELD_SUPERLATIVE)) | F.rlike(
        low, F.lit(R.CLIP_SUPERLATIVE)
    )
    total = F.get_json_object("item", "$.total_clip_m").cast("double")
    longest = F.get_json_object("item", "$.max_clip_m").cast("double")
    field = (
        evidence.where((F.col("tool") == "get_deployment") & total.isNotNull())
        .groupBy("doc_id")
        .agg(F.count("*").alias("_n"), F.min(total).alias("_total"), F.min(longest).alias("_max"))
        .where(F.col("_n") >= 2)
    )
    claims = texts.select(
        "doc_id",
        shortest.alias("_shortest"),
        lowest.alias("_lowest"),
        metres(F.col("text")).alias("_metres"),
    ).where(F.col("_shortest") | F.col("_lowest"))

    def verdict(m: Column) -> Column:
        return (
            F.when(m < 50, F.lit(None))
            .when(
                F.col("_shortest") & (m > F.col("_max") + 0.5),
                F.format_string(
                    "shortest-clip claim (%sm) but field minimum max_clip_m is %sm in tool trace",
                    m,
                    "_max",
                ),
            )
            .when(
                F.col("_lowest") & (m > F.col("_total") + 0.5),
                F.format_string(
                    "lowest-clip/deployment claim (%sm) but field minimum total_clip_m is %sm in "
                    "tool trace",
                    m,
                    "_total",
                ),
            )
        )

    first = F.get(F.filter(F.transform("_metres", verdict), lambda v: v.isNotNull()), F.lit(0))
    return (
        claims.join(field, "doc_id")
        .select("doc_id", F.lit("false_superlative").alias("rule"), first.alias("detail"))
        .where(F.col("detail").isNotNull())
    )


def flag(texts: DataFrame, test: Column, rule: str) -> DataFrame:
    return texts.where(test).select(
        "doc_id", F.lit(rule).alias("rule"), F.lit(R.ISSUES[rule]).alias("detail")
    )


def weak_cluster(texts: DataFrame) -> DataFrame:
    found = metres(F.col("text"))
    test = (
        F.rlike(F.col("text"), F.lit(R.CLIP_TOPIC))
        & (F.size(found) >= 2)
        & (F.array_max(found) - F.array_min(found) <= 100)
    )
    return flag(texts, test, "weak_cluster")


def session_codes(texts: DataFrame) -> DataFrame:
    return flag(texts, F.rlike(F.col("text"), F.lit(R.SESSION_CODE)), "session_code")


def header_figures(texts: DataFrame) -> DataFrame:
    return flag(texts, F.rlike(F.col("header"), F.lit(R.HEADER_FIGURE)), "header_figure")


def has_any(low: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def session_tags(low: Column) -> Column:
    """Sessions a text speaks of, as bits: qualifying 1, sprint 2, race 4."""
    qualifying = has_any(low, ["qualifying", " in q"]) | F.startswith(low, F.lit("q "))
    race = has_any(low, [" race", "in the race"])
    bit = lambda test, n: F.when(test, n).otherwise(0)
    return bit(qualifying, 1) + bit(F.contains(low, F.lit("sprint")), 2) + bit(race, 4)


def cross_doc_conflict(
    texts: DataFrame, keys: list[str], subjects: list[str] = R.CONSTRUCTORS
) -> DataFrame:
    """Texts of one group that call the same subject slow and fast, unless some slow and some fast
    text speak of different sessions. Sessions are three bits, so a subject's readings reduce to at
    most eight values a side and texts are never paired."""
    low = F.lower("text")
    polarity = F.when(has_any(low, R.SLOW_WORDS), "slow").when(has_any(low, R.FAST_WORDS), "fast")
    named = F.filter(
        F.array(*[F.lit(s) for s in subjects]), lambda s: F.contains(low, F.lower(s))
    )
    readings = (
        texts.select(
            *keys, "doc_id", polarity.alias("polarity"), session_tags(low).alias("_tags"),
            F.explode(named).alias("subject"),
        )
        .where(F.col("polarity").isNotNull())
    )
    tags_of = lambda side: F.collect_set(
        F.when(F.col("polarity") == side, F.col("_tags"))
    )
    apart = F.exists(
        "_slow",
        lambda a: F.exists("_fast", lambda b: (a > 0) & (b > 0) & (a.bitwiseAND(b) == 0)),
    )
    conflicts = (
        readings.groupBy(*keys, "subject")
        .agg(tags_of("slow").alias("_slow"), tags_of("fast").alias("_fast"))
        .where((F.size("_slow") > 0) & (F.size("_fast") > 0) & ~apart)
        .select(*keys, "subject")
    )
    return readings.join(conflicts, [*keys, "subject"]).select(
        *keys, "subject", "doc_id", "polarity"
    )


def doc_flags(texts: DataFrame, evidence: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """All flags of all checks as (doc_id, rule, detail)."""
    untraced = untraceable_numbers(texts, evidence).select(
        "doc_id", F.lit("untraceable").alias("rule"), F.col("value").cast("string").alias("detail")
    )
    out = untraced
    for part in parts:
        out = out.unionByName(part)
    return out.distinct()


def trace_pairs(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Each tool call with its result by call id, in order."""
    ordered = calls.select("run_id", "turn", F.posexplode("calls").alias("nth", "_call"))
    return ordered.select("run_id", "turn", "nth", "_call.*").join(
        results, ["run_id", "call_id"], "left"
    )


def pace_severity(gap: Column, cited_value: Column) -> Column:
    off = F.abs(gap - cited_value)
    return F.when(off <= 0.02, "OK").when(off <= 0.1, "WARN").otherwise("FAIL")


def cited_numbers(texts: DataFrame, keys: list[str], pattern: str) -> DataFrame:
    """(keys, cite_id, cited): every number that a pattern's first group finds in a text."""
    found = matches(F.col("text"), pattern, 1)
    return texts.select(*keys, "doc_id", F.posexplode(found).alias("_i", "_v")).select(
        *keys, F.concat_ws("#", "doc_id", "_i").alias("cite_id"), F.col("_v").cast("double").alias("cited")
    )


def audited_claims(
    texts: DataFrame, keys: list[str], pace: DataFrame, speeds: DataFrame, clips: DataFrame, gaps: DataFrame
) -> DataFrame:
    """(keys, kind, severity) of every claim of the texts that can be held against measured values:
    pace gaps against the nearest team's, speeds, clip lengths and finish gaps against any within the
    claim's tolerance. `speeds`, `clips` and `gaps` have (keys, measured). Lengths below 50 m are no
    clip claims, unmatched ones below 100 m are not judged."""
    near = nearest_value(cited_numbers(texts, keys, R.PACE_CLAIM), pace, keys)
    paced = near.select(
        *keys, F.lit("pace").alias("kind"), pace_severity(F.col("gap_s"), F.col("cited")).alias("severity")
    )

    def matched(kind: str, pattern: str, measured: DataFrame, tol: float, missing: Column, least: float = 0.0) -> DataFrame:
        cited = cited_numbers(texts, keys, pattern).where(F.col("cited") >= least)
        severity = F.when(F.col("matched"), "OK").otherwise(missing)
        return (
            tolerance_match(cited, measured.where(F.col("measured").isNotNull()), keys, tol)
            .select(*keys, F.lit(kind).alias("kind"), severity.alias("severity"))
            .where(F.col("severity").isNotNull())
        )

    far_clip = F.when(F.col("cited") >= 100, "WARN")
    return (
        paced.unionByName(matched("speed", R.SPEED_CLAIM, speeds, 0.6, F.lit("FAIL")))
        .unionByName(matched("clip", R.CLIP_CLAIM, clips, 2.0, far_clip, 50.0))
        .unionByName(matched("finish", R.FINISH_CLAIM, gaps.where(F.col("measured") != 0), 0.15, F.lit("WARN")))
    )


def claim_audit(claims: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of OK, WARN and FAIL claims of each kind per group."""
    return claims.groupBy(*keys, "kind", "severity").agg(F.count("*").alias("claims"))
