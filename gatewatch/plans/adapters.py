"""Adapter views: the driver's star-schema test tables seen as the audit and
flight-log tables this library works on.

Each view is plain Spark over the whole input tables and has a twin DuckDB
CTE in ``gatewatch.plans.oracle`` that must compute the same rows.

- ``audit``: line items per ship date, supplier (carrier) and order
  priority (operation); returned items count as retained, others released.
- ``audit_raw``: line items rendered as messy upload text (mixed date
  formats, spreadsheet serials, pt-BR numbers, junk).
- ``flights``: orders as flight-log rows.
- ``flights_raw``: events as a spreadsheet with merged date cells.
- ``notes``: documents as flight-log rows with free-text notes.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaning import type_audit
from ..sources.readers import read_table


#: Session setting by which a caller deals the input rows to so many tasks.
INPUT_PARTITIONS = "spark.gatewatch.inputPartitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table. Only if the caller sets ``INPUT_PARTITIONS`` (the bench
    does, as the tables are single files that do not split), rows are dealt
    out to that many tasks."""
    df = read_table(spark, os.path.join(sf_dir, f"{name}.parquet"))
    wanted = spark.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(wanted)) if wanted else df


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (ship date, carrier, operation) with released / retained /
    total counts; some line items name no carrier.

    The supplier side goes through the planner's size check
    (``autoBroadcastJoinThreshold``): broadcast while small, sort-merge
    beyond. The order join shuffles on the order key (AQE splits skewed
    keys); the group-by combines map-side before its shuffle.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    joined = (li.join(supplier, li.l_suppkey == supplier.s_suppkey)
                .join(orders, li.l_orderkey == orders.o_orderkey))
    returned = F.col("l_returnflag") == "R"
    return (joined.groupBy(F.to_date("l_shipdate").alias("audit_date"),
                           F.when(F.col("l_suppkey") % 37 != 5, F.col("s_name")).alias("carrier"),
                           F.col("o_orderpriority").alias("operation"))
            .agg(F.count_if(~returned).alias("released"),
                 F.count_if(returned).alias("retained"),
                 F.count(F.lit(1)).alias("total")))


def audit_with_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``audit`` with an explicit row identity (its natural key as text)."""
    a = audit(spark, sf_dir)
    return a.withColumn("row_id", F.concat_ws("|", F.col("audit_date").cast("string"),
                                              "carrier", "operation"))


def audit_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a raw upload: every field text, headers as typed by
    people (with stray blanks and lower case)."""
    li = table(spark, sf_dir, "lineitem")
    d = F.to_date("l_shipdate")
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 5
    odd_line = F.col("l_linenumber") % 2 == 1
    serial = F.datediff(d, F.lit("1899-12-30").cast("date")).cast("string")
    form = F.col("l_orderkey") % 5
    typed = (F.when(form == 0, F.date_format(d, "dd/MM/yyyy"))
             .when(form == 1, F.date_format(d, "dd/MM/yyyy' 00:00:00'"))
             .when(form == 2, F.date_format(d, "dd-MM-yyyy"))
             .when(form == 3, F.date_format(d, "dd.MM.yyyy' 14:30'"))
             .otherwise(F.date_format(d, "dd/MM/yy")))
    date_text = (
        F.when(k == 0, typed)
        .when(k == 1, F.concat(F.lit(" "), F.dayofmonth(d).cast("string"), F.lit("/"),
                               F.month(d).cast("string"), F.lit("/"), F.year(d).cast("string"), F.lit(" ")))
        .when(k == 2, F.when(odd_line, F.concat(serial, F.lit(".75"))).otherwise(serial))
        .when(k == 3, F.concat(F.lit("31/09/"), F.year(d).cast("string")))
        .when(odd_line, F.lit("sem data"))
        .otherwise(F.date_format(d, "yyyy-MM-dd"))
    )
    q = F.col("l_quantity").cast("long") * 100
    thousands = F.when(q >= 1000, F.concat((q / 1000).cast("long").cast("string"), F.lit("."),
                                           F.lpad((q % 1000).cast("string"), 3, "0"))) \
        .otherwise(q.cast("string"))
    m3 = F.col("l_orderkey") % 3
    released_text = (
        F.when(m3 == 0, thousands)
        .when(m3 == 1, F.replace(F.col("l_quantity").cast("string"), F.lit("."), F.lit(",")))
        .when(F.col("l_partkey") % 7 == 0, F.lit("x"))
        .otherwise(q.cast("string"))
    )
    return li.select(
        F.col("l_orderkey").alias("src_order"),
        F.col("l_linenumber").alias("src_line"),
        date_text.alias(" data "),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("Transportadora"),
        F.when(F.col("l_linestatus") == "F", F.lit("Direta")).otherwise(F.lit("LML")).alias("operação"),
        released_text.alias("LIBERADOS"),
        F.when(F.col("l_returnflag") == "R", F.lit("1")).otherwise(F.lit("0")).alias("MALHA"),
    )


def audit_clean_from_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``audit_raw`` typed (undated rows still present)."""
    return type_audit(audit_raw(spark, sf_dir))


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as flight-log rows: one operator per customer, some without."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.to_date("o_orderdate").alias("flight_date"),
        F.when(F.col("o_custkey") % 41 != 7, F.concat(F.lit("OP-"), F.col("o_custkey").cast("string"))).alias("operator"),
        F.when(F.col("o_custkey") % 4 == 0, F.lit("RESERVA")).otherwise(F.lit("FIXO")).alias("shift_type"),
        F.floor(F.col("o_totalprice") / 1000).cast("double").alias("routes"),
        (F.col("o_orderkey") % 3).cast("double").alias("flights"),
        F.lit(None).cast("string").alias("notes"),
    )


NBSP = "\u00a0"


def flights_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an imported spreadsheet: the date only on the first row of
    each merged block (others blank or empty), padded operator names, numbers
    as text. ``file_id`` stands for the source file, ``row_no`` for the row
    order in it; some rows have no file."""
    e = table(spark, sf_dir, "events")
    k5, form = F.col("event_id") % 5, F.col("event_id") % 4
    text = (F.when(form == 0, F.date_format("ts", "dd/MM/yyyy")).when(form == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
            .when(form == 2, F.date_format("ts", "dd-MM-yy")).otherwise(F.date_format("ts", "dd.MM.yyyy")))
    return e.select(
        F.when(F.col("user_id") % 30 != 7, F.col("user_id")).alias("file_id"),
        F.col("event_id").alias("row_no"),
        F.when(k5 == 0, text)
         .when(k5 == 1, F.lit("   ")).alias("Data"),
        F.when(F.col("event_id") % 7 == 3, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit(" OP-"), (F.col("user_id") % 20).cast("string"), F.lit(NBSP)))
         .alias("Operador"),
        F.when(F.col("user_id") % 4 == 0, F.lit("RESERVA")).otherwise(F.lit("FIXO")).alias("Tipo"),
        F.when(F.col("event_id") % 11 == 0, F.lit("n/d"))
         .otherwise(F.format_string("%.2f", F.col("value"))).alias("Rotas"),
        (F.col("event_id") % 4).cast("string").alias("Voos"),
        F.col("event_type").alias("Obs"),
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as flight-log rows whose note is the whole document text;
    some end with a remark as operators write it, some rows have no note or no
    operator."""
    d = table(spark, sf_dir, "documents")
    remark = F.col("doc_id") % 11
    note = F.concat(F.col("text"), F.when(remark == 3, F.lit(" Chuva forte")).when(remark == 4, F.lit(" hélice quebrada"))
                    .when(remark == 5, F.lit(" falta")).when(remark == 6, F.lit(" fogos")).otherwise(F.lit("")))
    return d.select(
        F.col("doc_id").alias("note_id"),
        F.date_add(F.lit("2025-01-01").cast("date"), (F.col("doc_id") % 400).cast("int")).alias("flight_date"),
        F.when(F.col("doc_id") % 23 != 0, F.col("source")).alias("operator"),
        F.lit("FIXO").alias("shift_type"),
        F.lit(0.0).alias("routes"),
        F.lit(0.0).alias("flights"),
        F.when(F.col("doc_id") % 17 != 0, note).alias("notes"),
    )
