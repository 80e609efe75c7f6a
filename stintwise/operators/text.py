"""Text functions, phrase and pattern flags, and incident messages. One row per text."""

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from stintwise.functions import text_rules as R
from stintwise.functions.skew import first_by, row_numbers


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def pieces(text: Column, pattern: str) -> Column:
    return F.split(text, pattern, -1)


def replace_matches(text: Column, pattern: str, group: int, to) -> Column:
    """Replace every match of `pattern` by `to(group text)`, each at its own place."""
    between, found = pieces(text, pattern), matches(text, pattern, group)
    joined = F.zip_with(
        between, found, lambda a, b: F.concat(a, F.when(b.isNull(), "").otherwise(to(b)))
    )
    return F.when(F.size(found) > 0, F.array_join(joined, "")).otherwise(text)


def matches_in_context(text: Column, pattern: str, width: int, shortest: int = 4) -> Column:
    """array<struct<match, context>>: each match with `width` characters on either side. A match has
    `shortest` characters or more, so the few parts of the text about it are enough, wherever it
    stands."""
    between, found = pieces(text, pattern), matches(text, pattern)
    reach = 2 * (width // shortest + 1)
    parts = F.flatten(F.zip_with(between, found, lambda a, b: F.array(a, F.coalesce(b, F.lit("")))))

    def one(match: Column, i: Column) -> Column:
        at = 2 * i + 1  # the parts before the match
        before = F.slice(parts, F.greatest(at - reach, F.lit(0)) + 1, F.least(at, F.lit(reach)))
        after = F.slice(parts, at + 2, reach)
        return F.struct(
            match.alias("match"),
            F.concat(
                F.right(F.array_join(before, ""), F.lit(width)),
                match,
                F.left(F.array_join(after, ""), F.lit(width)),
            ).alias("context"),
        )

    return F.transform(found, one)


def trimmed_number(value: Column, decimals: Column) -> Column:
    text = F.when(decimals == 1, F.format_string("%.1f", value)).otherwise(
        F.format_string("%.3f", value)
    )
    return F.regexp_replace(text, r"\.?0+$", "")


def round_prose_numbers(text: Column) -> Column:
    """Over-precise decimals to one place from 50 up, else three, without trailing zeros."""
    def shown(number: Column) -> Column:
        value = number.cast("double")
        return trimmed_number(value, F.when(value >= 50, 1).otherwise(3))

    return replace_matches(text, R.LONG_DECIMAL, 1, shown)


def format_lap_times(text: Column) -> Column:
    """Lap times of a minute or more as M:SS.mmm; shorter times stay as they are. The unit is
    dropped only with a change, so both kinds are matched together with it."""
    pattern = R.LAP_SECONDS.replace(r"(\d{2,3}\.\d{1,3})", r"\d{2,3}\.\d{1,3}")

    def clock(match: Column) -> Column:
        whole = F.regexp_extract(match, r"^(\d+)\.", 1).cast("int")
        part = F.regexp_extract(match, r"\.(\d+)", 1)
        minutes, seconds = F.floor(whole / 60), whole % 60
        return F.when(whole < 60, match).otherwise(
            F.format_string("%d:%02d.%s", minutes, seconds, part)
        )

    return replace_matches(text, pattern, 0, clock)


def strip_em_dashes(text: Column) -> Column:
    out = text
    for dash in R.LONG_DASHES:
        out = F.replace(F.replace(out, F.lit(f" {dash} "), F.lit(", ")), F.lit(dash), F.lit(", "))
    spaced = F.replace(out, F.lit(f" {R.EN_DASH} "), F.lit(" - "))
    return F.replace(spaced, F.lit(R.EN_DASH), F.lit("-"))


def first_sentence(text: Column) -> Column:
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.element_at(F.split(trimmed, r"(?<=[.!?])\s+", 2), 1)


def bind_units(text: Column) -> Column:
    """A no-break space between a number and its unit."""
    pattern = rf"(?i)(~?\d[\d.,]*)\s+({R.METRIC_UNIT})(?=\b)"
    return F.regexp_replace(text, pattern, "$1\u00a0$2")


def measurement_tokens(text: Column) -> Column:
    return matches(text, R.MEASUREMENT, 1)


def first_json_array(text: Column, schema: str) -> Column:
    """The first array in a text, parsed; whatever follows it is ignored. Null when unreadable."""
    at = F.locate("[", text)
    return F.when(at > 0, F.from_json(F.substring(text, at, F.length(text)), schema))


def parsed_items(texts: DataFrame, fields: list[str], count: int) -> tuple[DataFrame, DataFrame]:
    """The first `count` items of each text's array, and the texts turned away for having too few or
    for items without a required field."""
    schema = "array<map<string, string>>"
    head = F.slice("_items", 1, count)
    whole = F.forall(
        head, lambda i: F.lit(True) if not fields else _all_present(i, fields)
    )
    judged = texts.withColumn("_items", first_json_array(F.col("text"), schema)).withColumn(
        "_ok", F.coalesce((F.size("_items") >= count) & whole, F.lit(False))
    )
    keys = [c for c in texts.columns if c != "text"]
    good = judged.where(F.col("_ok")).select(*keys, F.posexplode(head).alias("_i", "_item"))
    return (
        good.select(
            *keys, (F.col("_i") + 1).alias("slot"), *[F.col("_item")[f].alias(f) for f in fields]
        ),
        judged.where(~F.col("_ok")).select(*texts.columns),
    )


def _all_present(item: Column, fields: list[str]) -> Column:
    out = F.lit(True)
    for f in fields:
        out = out & F.map_contains_key(item, f)
    return out


# --- flags ------------------------------------------------------------------

DOTTED = "\u0130"


def suspects(texts: DataFrame, needed: dict[str, list[str]] = R.NEEDED) -> DataFrame:
    """`texts` with `may`, a bit for each check of `needed` that may tell something of the text; texts that
    no check can tell of are left out. Every text is read whole, once for all checks, by a linear matcher."""
    either = "|".join(p for patterns in needed.values() for p in patterns)

    def found(text: pa.Array, pattern: str) -> pa.Array:
        return pc.fill_null(pc.match_substring_regex(text, rf"(?i)(?:{pattern})|{DOTTED}"), False)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(found(batch.column("text"), either))
            text = some.column("text")
            may = np.zeros(len(text), np.int32)
            for i, patterns in enumerate(needed.values()):
                hit = reduce(pc.and_, [found(text, p) for p in patterns])
                may |= hit.to_numpy(zero_copy_only=False).astype(np.int32) << i
            out = pa.RecordBatch.from_arrays([*some.columns, pa.array(may)], [*some.schema.names, "may"])
            yield out.filter(pa.array(may != 0))

    return texts.mapInArrow(run, StructType([*texts.schema, StructField("may", IntegerType())]))


def suspected(rows: DataFrame, check: str) -> DataFrame:
    """The texts among `suspects` that `check` may tell something of."""
    bit = 1 << list(R.NEEDED).index(check)
    return rows.where(F.col("may").bitwiseAND(bit) != 0).drop("may")


def phrase_flags(texts: DataFrame, phrases: list[str] = R.PHRASES) -> DataFrame:
    """(doc_id, rule, detail) for each listed phrase in a text. The list is a literal: one pass over
    each row, no join."""
    listed = F.array(*[F.lit(p) for p in phrases])
    # The lower-cased text is bound as a lambda argument, so it is made once per text and not once
    # per phrase.
    hits = F.transform(
        F.array(F.lower("text")), lambda low: F.filter(listed, lambda p: F.contains(low, p))
    )
    return texts.select("doc_id", F.explode(F.flatten(hits)).alias("detail")).select(
        "doc_id", F.lit("phrase").alias("rule"), "detail"
    )


def pattern_flags(texts: DataFrame) -> DataFrame:
    low = F.lower("text")
    found = F.array(
        *[
            F.struct(F.lit(rule).alias("rule"), matches(low, pattern).alias("hits"))
            for rule, pattern in R.PATTERNS.items()
        ]
    )
    return (
        texts.select("doc_id", F.inline(found))
        .select("doc_id", "rule", F.explode("hits").alias("detail"))
        .select("doc_id", "rule", "detail")
    )


def lap_context_flags(texts: DataFrame, width: int = 60) -> DataFrame:
    """"on lap N" near retirement or overtaking words, unless race control words are near as well."""
    at = matches_in_context(F.lower("text"), R.ON_LAP, width)
    context = F.col("_m.context")
    return (
        texts.select("doc_id", F.explode(at).alias("_m"))
        .where(
            ~F.rlike(context, F.lit(R.INCIDENT_CONTEXT))
            & (
                F.rlike(context, F.lit(R.RETIREMENT_CONTEXT))
                | F.rlike(context, F.lit(R.OVERTAKE_CONTEXT))
            )
        )
        .select("doc_id", F.lit("lap_context").alias("rule"), F.col("_m.match").alias("detail"))
    )


def fix_hints(flags: DataFrame) -> DataFrame:
    """(doc_id, hint): the rewrite hints of a text's flags, each once. Rules are literals."""
    key = F.lower("detail")
    known = F.create_map(*[F.lit(x) for pair in R.PHRASE_HINTS.items() for x in pair])
    general = F.lit(None).cast("string")
    for part, hint in reversed(R.ISSUE_HINTS):
        general = F.when(F.contains(key, F.lit(part)), hint).otherwise(general)
    return (
        flags.select("doc_id", F.coalesce(F.try_element_at(known, key), general).alias("hint"))
        .where(F.col("hint").isNotNull())
        .distinct()
    )


# --- incident messages ------------------------------------------------------


def message_kind(message: Column) -> Column:
    """The first kind of `MESSAGE_KINDS` whose terms are all in the message; null for noise. The message is
    put in upper case once."""

    def kind(upper: Column) -> Column:
        has = lambda term: F.contains(upper, F.lit(term))
        out = F.lit(None).cast("string")
        for name, terms in reversed(R.MESSAGE_KINDS):
            out = F.when(reduce(lambda a, b: a & b, map(has, terms)), name).otherwise(out)
        noise = reduce(lambda a, b: a | b, map(has, R.MESSAGE_NOISE))
        return F.when(~noise, out)

    return F.transform(F.array(F.upper(message)), kind)[0]


def incident_events(messages: DataFrame, keys: list[str]) -> DataFrame:
    """Notable messages, one row per car named, repeats dropped in favour of the first lap.
    `messages` carries `lap_text`, `message` and an order column `seq`."""
    rows = (
        messages.withColumn("message", F.trim("message"))
        .withColumn("kind", message_kind(F.col("message")))
        .where(F.col("kind").isNotNull())
        .withColumn("driver", F.explode_outer(matches(F.col("message"), r"\((\w{3})\)", 1)))
        .withColumn("lap", F.trim("lap_text").try_cast("int"))
        .withColumn("_driver", F.coalesce("driver", F.lit("")))
    )
    first = first_by(
        rows.select(*keys, "_driver", "driver", "kind", "message", "lap", "seq"),
        [*keys, "_driver", "kind", "message"],
        "seq",
    )
    return first.select(*keys, "lap", "driver", "kind", "message")


def events_by_lap(events: DataFrame, keys: list[str], driver: str | None = None) -> DataFrame:
    """Notable messages by lap, those without a lap last, numbered from 1 for each car named; messages that
    name no car are a group of their own. `driver` picks one car. A car may have any number of them."""
    if driver is not None:
        events = events.where(F.col("driver") == driver)
    order = [F.asc_nulls_last("lap"), F.col("kind"), F.col("message")]
    return row_numbers(events, [*keys, "driver"], order, "nth")
