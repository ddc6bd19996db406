"""Aggregations of the audit and flight modules.

Every aggregate here is decomposable (sum, count, min, max), so Spark
combines map-side before the shuffle: a hot carrier or operator holding a
third of the rows still ships one partial row per task. Group keys are
filtered to non-null first, as a pandas group-by drops null keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import (category_of, label_decimal1, label_int, label_pct, ratio_1dp,
                         retention_rate, round_ratio_half_up)
from ..functions.classify import DEFAULT_RULES, Rules
from ..functions.rates import axis_limit, rate_band
from ..functions.text import parsed_once
from .cleaning import with_month_abbr, with_period, with_weekday
from .filters import audit_predicate, in_range, last_days, month_of, previous_window

# Funnel stage labels, in display order.
FUNNEL_STAGES = ["Veículos na Portaria", "🟢 Liberados (Viagem)", "🔴 Retidos (Malha Fina)"]
DEFAULT_GOAL = 225
PROJECTION_DAYS = 30


def _non_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    pred = None
    for k in keys:
        p = F.col(k).isNotNull()
        pred = p if pred is None else pred & p
    return df if pred is None else df.where(pred)


def _kpi_columns(released: Column, retained: Column, total_col: Column, prefix: str = "") -> list[Column]:
    """released, retained, total (TOTAL column if its sum > 0, else the sum)
    and the global retention rate over that total."""
    total = F.when(total_col > 0, total_col).otherwise(released + retained)
    return [
        released.alias(f"{prefix}released"),
        retained.alias(f"{prefix}retained"),
        total.alias(f"{prefix}total"),
        round_ratio_half_up(retained, total, 100, 2).alias(f"{prefix}retention_rate"),
    ]


# ---------------------------------------------------------------- audit KPIs

def audit_kpis(df: DataFrame) -> DataFrame:
    """A1/A2: one-row KPIs in a single scan."""
    sums = df.agg(F.coalesce(F.sum("released"), F.lit(0)).alias("r"),
                  F.coalesce(F.sum("retained"), F.lit(0)).alias("m"),
                  F.sum("total").alias("t"))
    return sums.select(*_kpi_columns(F.col("r"), F.col("m"), F.col("t")))


def kpi_deltas(df: DataFrame, years=None, start=None, end=None,
               operations=None, carriers=None) -> DataFrame:
    """A3: current KPIs, previous-period KPIs and their deltas in ONE scan.

    The previous period keeps operation and carrier filters but not the year
    filter. The scan reads only rows of either period.
    """
    cur = audit_predicate(years, start, end, operations, carriers)
    ps, pe = previous_window(start, end)
    prev = audit_predicate(None, ps, pe, operations, carriers)

    def s(col: str, pred: Column) -> Column:
        return F.coalesce(F.sum(F.when(pred, F.col(col))), F.lit(0))

    sums = df.where(cur | prev).agg(
        s("released", cur).alias("r"), s("retained", cur).alias("m"),
        F.sum(F.when(cur, F.col("total"))).alias("t"),
        s("released", prev).alias("pr"), s("retained", prev).alias("pm"),
        F.sum(F.when(prev, F.col("total"))).alias("pt"),
    )
    k = sums.select(*_kpi_columns(F.col("r"), F.col("m"), F.col("t")),
                    *_kpi_columns(F.col("pr"), F.col("pm"), F.col("pt"), prefix="prev_"))
    return k.select(
        "*",
        (F.col("total") - F.col("prev_total")).alias("delta_total"),
        (F.col("released") - F.col("prev_released")).alias("delta_released"),
        (F.col("retained") - F.col("prev_retained")).alias("delta_retained"),
        rate_band("retention_rate").alias("rate_band"),
        axis_limit("retention_rate").alias("axis_limit"),
    )


def funnel(df: DataFrame) -> DataFrame:
    """Three stages (gate, released, retained) with pt-BR labels."""
    k = audit_kpis(df)
    stack = ", ".join(f"{i}, '{s}', {c}" for i, (s, c) in
                      enumerate(zip(FUNNEL_STAGES, ["total", "released", "retained"])))
    out = k.selectExpr(f"stack(3, {stack}) AS (stage_order, stage, number)")
    return out.withColumn("number_label", label_int("number"))


# ---------------------------------------------------------------- audit group-bys

def _volume_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (_non_null_keys(df, keys).groupBy(*keys)
            .agg(F.sum("released").alias("released"), F.sum("retained").alias("retained")))


def rank_released(df: DataFrame) -> DataFrame:
    """A4: released volume per carrier, ascending."""
    out = _volume_by(df, ["carrier"]).select("carrier", "released")
    return out.withColumn("released_label", label_int("released")) \
        .orderBy(F.col("released").asc(), F.col("carrier").asc())


def rank_retained(df: DataFrame) -> DataFrame:
    """A5: retained volume per carrier, ascending."""
    out = _volume_by(df, ["carrier"]).select("carrier", "retained")
    return out.withColumn("retained_label", label_int("retained")) \
        .orderBy(F.col("retained").asc(), F.col("carrier").asc())


def rate_by(df: DataFrame, key: str, by: str = "carrier") -> DataFrame:
    """(key, carrier) volumes and retention rate.

    ``key`` may be 'audit_date', 'year_month' or 'year'; the period columns
    are derived when missing.
    """
    if key not in df.columns and key in ("year_month", "year"):
        df = with_period(df)
    out = _volume_by(df, [key, by])
    out = out.withColumn("retained_pct", retention_rate("released", "retained"))
    return (out.withColumn("released_label", label_int("released"))
               .withColumn("retained_pct_label", label_pct("retained_pct")))


def heat_weekday(df: DataFrame) -> DataFrame:
    """Weekday x carrier retention (Monday-first order index)."""
    wd = with_weekday(df)
    out = _volume_by(wd, ["weekday", "weekday_idx", "carrier"])
    return out.withColumn("retained_pct", retention_rate("released", "retained"))


def volume_by_day(df: DataFrame) -> DataFrame:
    """One bar per source row: date, carrier, released and its label."""
    return df.select("audit_date", "carrier", "operation", "released",
                     label_int("released").alias("released_label"))


def share(df: DataFrame, key: str, measure: str = "released") -> DataFrame:
    """Share (percent, 2 decimals) of ``measure`` per ``key``.

    The grand total is a scalar subquery over the (small) grouped result, so
    there is no join, no global window and no second scan of the fact.
    """
    grouped = (_non_null_keys(df, [key]).groupBy(key)
               .agg(F.sum(measure).alias(measure)))
    total = grouped.select(F.sum(measure)).scalar()
    return grouped.withColumn("share_pct", round_ratio_half_up(F.col(measure), total, 100, 2))


# ---------------------------------------------------------------- flight metrics

def production(df: DataFrame, keys: Sequence[str] = ("operator",)) -> DataFrame:
    """Routes and flights summed per key."""
    keys = list(keys)
    if "month_abbr" in keys and "month_abbr" not in df.columns:
        df = with_month_abbr(df)
    return (_non_null_keys(df, keys).groupBy(*keys)
            .agg(F.sum("routes").alias("routes"), F.sum("flights").alias("flights")))


def flight_kpis(df: DataFrame) -> DataFrame:
    """Whole flights, whole routes and distinct operators."""
    return df.agg(
        F.coalesce(F.sum("flights"), F.lit(0)).cast("long").alias("total_flights"),
        F.coalesce(F.sum("routes"), F.lit(0)).cast("long").alias("total_routes"),
        F.countDistinct("operator").alias("operators"),
    )


def daily_production(df: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Production per operator over the trailing window."""
    return production(last_days(df, as_of, days), ["operator"])


def goal_progress(df: DataFrame, as_of, goal: int = DEFAULT_GOAL) -> DataFrame:
    """Flights this calendar month per operator vs. a goal, capped at 1."""
    per_op = production(month_of(df, as_of), ["operator"]).select("operator", "flights")
    return per_op.withColumn("goal", F.lit(goal)) \
        .withColumn("progress", F.least(F.col("flights") / F.lit(float(goal)), F.lit(1.0)))


def month_projection(df: DataFrame, as_of) -> DataFrame:
    """Flights so far this month / max(day, 1) * 30, truncated."""
    import datetime as _dt
    day = max(_dt.date.fromisoformat(str(as_of)).day, 1)
    return month_of(df, as_of).agg(
        F.floor(F.coalesce(F.sum("flights"), F.lit(0.0)) / F.lit(float(day))
                * F.lit(float(PROJECTION_DAYS))).cast("long").alias("projection"))


def efficiency(df: DataFrame) -> DataFrame:
    """Routes per flight per operator (flights > 0), 1 decimal, descending."""
    per_op = production(df, ["operator"]).where(F.col("flights") > 0)
    out = per_op.withColumn("routes_per_flight", ratio_1dp("routes", "flights"))
    return (out.withColumn("routes_per_flight_label", label_decimal1("routes_per_flight"))
               .orderBy(F.col("routes_per_flight").desc(), F.col("operator").asc()))


# ---------------------------------------------------------------- text

def with_category(df: DataFrame, rules: Rules = DEFAULT_RULES,
                  text_col: str = "notes") -> DataFrame:
    """Category of each note (null note -> excluded upstream).

    Filters on the category read the column and do not classify again."""
    return parsed_once(df.withColumn("category", category_of(text_col, rules)))


def count_categories(df: DataFrame, rules: Rules = DEFAULT_RULES,
                     text_col: str = "notes") -> DataFrame:
    """Occurrences per detected category, most frequent first."""
    cat = with_category(df.where(F.col(text_col).isNotNull()), rules, text_col)
    return (cat.where(F.col("category").isNotNull()).groupBy("category")
               .agg(F.count(F.lit(1)).alias("occurrences"))
               .orderBy(F.col("occurrences").desc(), F.col("category").asc()))


# ---------------------------------------------------------------- maintenance report

def merge_report(old: DataFrame, new: DataFrame, date_col: str | None = None) -> DataFrame:
    """Rows before and after an exact-dedupe merge, and duplicates ignored.

    One aggregation: count copies per distinct row, then sum the counts. With
    ``date_col`` as in ``merge_import``: stored rows outside the import's date
    range are counted where they are, and only the others are grouped.
    """
    if date_col is not None:
        near = in_range(old, new, date_col)
        far = old.where(~near).select(F.count(F.lit(1))).scalar()
        met = merge_report(old.where(near), new)
        return met.withColumns({c: F.col(c) + far for c in ("rows_before", "rows_after")})
    combined = old.unionByName(new, allowMissingColumns=True)
    per_row = combined.groupBy(*combined.columns).agg(F.count(F.lit(1)).alias("_copies"))
    return per_row.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).cast("long").alias("rows_before"),
        F.count(F.lit(1)).cast("long").alias("rows_after"),
    ).withColumn("duplicates_ignored", F.col("rows_before") - F.col("rows_after"))


# ---------------------------------------------------------------- ranking

# Medals of the daily ranking.
MEDALS = ["🥇", "🥈", "🥉"]


def top_operators(df: DataFrame, k: int = 5) -> DataFrame:
    """Top-k operators by flights (ties by name); gold, silver, then bronze.

    ``orderBy().limit(k)`` runs as a per-task top-k; the rank window only
    ever sees those k rows.
    """
    top = (production(df, ["operator"])
           .orderBy(F.col("flights").desc(), F.col("operator").asc()).limit(k))
    w = Window.orderBy(F.col("flights").desc(), F.col("operator").asc())
    ranked = top.withColumn("rank", F.row_number().over(w))
    return ranked.withColumn(
        "medal", F.when(F.col("rank") == 1, F.lit(MEDALS[0]))
        .when(F.col("rank") == 2, F.lit(MEDALS[1])).otherwise(F.lit(MEDALS[2])))
