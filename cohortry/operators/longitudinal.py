"""Per-patient features from encounter, condition, medication, observation and
event tables.

Every child table is reduced to one row per patient before any join, all joins
use the patient id, so the aggregates and the joins share one partitioning.
Partial aggregation runs before each shuffle; `row_number() <= n` filters run
as a group limit on the map side, so a hot patient ships only n rows per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortry.functions.clinical import CONCEPTS, concept_field, concept_index
from cohortry.functions.numeric import duration_days, flag, to_number
from cohortry.operators.ranks import exact_quantiles


@dataclass(frozen=True)
class EventKind:
    """One kind of timeline event inside a table."""

    name: str
    date: str
    label: str
    where: str | None = None


def encounter_features(enc: DataFrame, emergency: str = "emergency") -> DataFrame:
    """enc: patient, start, stop, class."""
    e = joined_once(
        enc.select("patient", "start", "stop", "class", duration_days(F.col("start"), F.col("stop")).alias("duration_days"))
    )
    base = e.groupBy("patient").agg(
        F.count(F.lit(1)).alias("n_encounters"),
        F.count_distinct("class").alias("unique_encounter_classes"),
        F.min("start").alias("first_encounter_start"),
        F.max("stop").alias("last_encounter_end"),
        F.avg("duration_days").alias("avg_encounter_duration_days"),
        F.count_if(F.lower("class") == emergency).alias("emergency_encounter_count"),
    )
    med = exact_quantiles(e, ["duration_days"], [0.5], ["patient"]).select(
        "patient", F.col("q0").alias("median_encounter_duration_days")
    )
    return base.join(med, "patient", "left")


@dataclass(frozen=True)
class CodeCounts:
    """Output names of one family of coded events, and which rows belong to it."""

    n: str
    n_codes: str
    n_open: str
    where: str | None = None


def code_features(events: DataFrame, families: Sequence[CodeCounts]) -> DataFrame:
    """events: patient, code, stop; an open event has no stop. All families that lie
    in one table are counted in one pass, per code first, so that rows with the same code
    meet once; a patient without any row of a family gets a null there."""
    per_code, aggs = [], []
    for i, f in enumerate(families):
        hit = F.expr(f.where) if f.where else F.lit(True)
        per_code += [F.count_if(hit).alias(f"__n{i}"), F.count_if(hit & F.col("stop").isNull()).alias(f"__o{i}")]
        n = F.sum(f"__n{i}")
        present = lambda c, n=n: F.when(n > 0, c)
        aggs += [
            present(n).alias(f.n),
            present(F.count_if((F.col(f"__n{i}") > 0) & F.col("code").isNotNull())).alias(f.n_codes),
            present(F.sum(f"__o{i}")).alias(f.n_open),
        ]
    return events.groupBy("patient", "code").agg(*per_code).groupBy("patient").agg(*aggs)


def summary_list(
    events: DataFrame, value: str, order: Sequence[str | Column], out: str, limit: int = 5
) -> DataFrame:
    """First values of a patient joined by ` | `, with `(+N more)` beyond the limit."""
    return summary_lists(events, value, order, {out: None}, limit)


def summary_lists(
    events: DataFrame, value: str, order: Sequence[str | Column], lists: Mapping[str, str | None], limit: int = 5
) -> DataFrame:
    """Several lists of one table: name and the rows that belong to it (None: all). Rows of
    the same lists are limited together before they move, so a row moves once; a patient
    without a row of a list gets a null there."""
    ok = events.filter(F.col(value).isNotNull() & (F.col(value) != ""))
    hits = [F.coalesce(F.expr(w), F.lit(False)) if w else F.lit(True) for w in lists.values()]
    ok = ok.withColumn("__in", reduce(lambda a, b: a + b, [h.cast("int") * (1 << i) for i, h in enumerate(hits)]))
    if None not in lists.values():
        ok = ok.filter("__in > 0")
    mine = [F.col("__in").bitwiseAND(F.lit(1 << i)) > 0 for i in range(len(lists))]
    totals = ok.groupBy("patient").agg(*[F.count_if(m).alias(f"__n{i}") for i, m in enumerate(mine)])
    first = F.row_number().over(Window.partitionBy("patient", "__in").orderBy(*order))
    head = ok.withColumn("__r", first).filter(F.col("__r") <= limit)
    upto = Window.partitionBy("patient").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    head = head.select("patient", F.col(value).alias("v"), "__in", *[F.count_if(m).over(upto).alias(f"__r{i}") for i, m in enumerate(mine)])
    kept = [F.when(m & (F.col(f"__r{i}") <= limit), F.struct(F.col(f"__r{i}").alias("r"), "v")) for i, m in enumerate(mine)]
    texts = head.groupBy("patient").agg(*[F.array_sort(F.collect_list(k)).alias(f"__l{i}") for i, k in enumerate(kept)])
    cols = []
    for i, name in enumerate(lists):
        text = F.array_join(F.transform(f"__l{i}", lambda s: s["v"]), " | ")
        extra = F.col(f"__n{i}") - limit
        text = F.when(extra > 0, F.concat(text, F.lit(" | (+"), extra.cast("string"), F.lit(" more)"))).otherwise(text)
        cols.append(F.when(F.col(f"__n{i}") > 0, text).alias(name))
    return texts.join(totals, "patient").select("patient", *cols)


def dominant_domain(events: DataFrame, text: str, out: str = "dominant_condition_domain") -> DataFrame:
    """Most frequent concept domain of a patient, ignoring the general one."""
    idx = events.select("patient", concept_index(f"coalesce({text}, '')").alias("__c"))
    counts = idx.groupBy("patient", "__c").agg(F.count(F.lit(1)).alias("__n"))
    named = counts.withColumn("domain", concept_field(F.col("__c"), "domain"))
    specific = F.col("__c") < len(CONCEPTS)
    return named.groupBy("patient").agg(
        F.coalesce(
            F.min_by("domain", F.when(specific, F.struct((-F.col("__n")).alias("n"), "domain"))),
            F.lit("General"),
        ).alias(out)
    )


def observation_features(obs: DataFrame, codes: Mapping[str, str], tie: str = "id") -> DataFrame:
    """obs: patient, code, ts, value (text or number), and a unique tie column.
    All codes in one aggregate: count of numbers, and mean/max/min/last per code."""
    o = obs.select("patient", "code", "ts", tie, to_number(F.col("value")).alias("v"))
    aggs = [F.count("v").alias("numeric_observation_count")]
    for code, name in codes.items():
        here = F.when(F.col("code") == code, F.col("v"))
        latest = F.when((F.col("code") == code) & F.col("v").isNotNull(), F.struct("ts", tie))
        aggs += [
            F.avg(here).alias(f"{name}_mean"),
            F.max(here).alias(f"{name}_max"),
            F.min(here).alias(f"{name}_min"),
            F.max_by("v", latest).alias(f"{name}_last"),
        ]
    return o.groupBy("patient").agg(*aggs)


def timeline(sources: Sequence[tuple[DataFrame, Sequence[EventKind]]]) -> DataFrame:
    """Union of event tables into (patient, event_date, event_type, event_label). A
    table that feeds several kinds is read once; undated events drop out."""
    out = None
    for df, kinds in sources:
        items = [
            F.when(
                (F.expr(k.where) if k.where else F.lit(True)) & F.col(k.date).isNotNull(),
                F.struct(
                    F.col(k.date).alias("event_date"),
                    F.lit(k.name).alias("event_type"),
                    F.coalesce(F.col(k.label), F.lit("unknown")).alias("event_label"),
                ),
            )
            for k in kinds
        ]
        p = df.select("patient", F.inline(F.array_compact(F.array(*items))))
        out = p if out is None else out.unionByName(p)
    return out


def first_events(tl: DataFrame, limit: int = 50) -> DataFrame:
    """The first events of each patient by date; ties by type, then label."""
    w = Window.partitionBy("patient").orderBy("event_date", "event_type", "event_label")
    return tl.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit)


def event_summary(tl: DataFrame, limit: int = 50) -> DataFrame:
    """Ordered array of the first events of each patient as one JSON text."""
    item = F.struct(
        "position",
        F.date_format("event_date", "yyyy-MM-dd'T'HH:mm:ss").alias("date"),
        F.col("event_type").alias("type"),
        F.col("event_label").alias("label"),
    )
    arr = F.array_sort(F.collect_list(item))
    return first_events(tl, limit).groupBy("patient").agg(
        F.to_json(F.transform(arr, lambda s: F.struct(s["date"].alias("date"), s["type"].alias("type"), s["label"].alias("label")))).alias(
            "temporal_event_summary"
        )
    )


def joined_once(df: DataFrame) -> DataFrame:
    """Every column for every reader. Readers of a join that need different columns would
    each shuffle their own narrower copy of it; behind this they all read the same exchanges."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def attach(patients: DataFrame, parts: Sequence[DataFrame]) -> DataFrame:
    """Left-join chain of one-row-per-patient tables onto the patient table."""
    out = patients
    for p in parts:
        out = out.join(p, "patient", "left")
    return out


def add_outcomes(df: DataFrame) -> DataFrame:
    """Span, complexity and the rule target from the joined features."""
    from cohortry.functions.numeric import complexity_score, high_utilization, span_days

    counts = (F.col("n_encounters"), F.col("n_chronic_conditions"), F.col("n_active_medications"))
    return (
        df.withColumn(
            "encounter_time_span_days",
            span_days(F.col("first_encounter_start"), F.col("last_encounter_end")),
        )
        .withColumn("longitudinal_complexity_score", complexity_score(*counts))
        .withColumn("target", high_utilization(*counts, F.col("encounter_time_span_days")))
    )


def active_flag(stop: Column) -> Column:
    return flag(stop.isNull())
