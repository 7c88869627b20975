"""Parquet tables as records."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loglathe.operators.records import Records, from_table


def events(spark: SparkSession, folder: str, since: int | None = None, until: int | None = None) -> Records:
    df = spark.read.parquet(f"{folder}/events.parquet")
    return from_table(df, "ts", ["event_type", "user_id"], ["value"], F.col("event_id") + 1, since, until)


def lineitem(spark: SparkSession, folder: str, since: int | None = None, until: int | None = None) -> Records:
    df = spark.read.parquet(f"{folder}/lineitem.parquet")
    return from_table(df, "l_shipdate", ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], F.col("l_orderkey") * 8 + F.col("l_linenumber"), since, until)


def orders(spark: SparkSession, folder: str, since: int | None = None, until: int | None = None) -> Records:
    df = spark.read.parquet(f"{folder}/orders.parquet")
    return from_table(df, "o_orderdate", ["o_orderstatus", "o_orderpriority"], ["o_totalprice"], "o_orderkey", since, until)
