"""The driver's tables as articles: a dated event chain (ordered, shipped, received) with journals, types and keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagframe.functions import dates
from lagframe.operators import filters

#: Total order of rows that share a title.
TIE = ["issn_linking", "l_suppkey", "l_extendedprice", "l_quantity", "accepted"]
MEGA = ["Brand#11", "Brand#22", "Brand#33"]
SINCE, UNTIL = "1996-01-01", "2001-06-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, o, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    df = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    accepted = F.col("l_shipdate").cast("date")
    return df.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("title"),
        F.col("o_orderdate").cast("date").alias("received"),
        accepted.alias("accepted"),
        F.date_add(accepted, F.col("l_quantity").cast("int")).alias("article_date"),
        F.col("p_brand").alias("journal"),
        F.col("p_type").alias("discipline"),
        F.col("l_partkey").alias("issn_linking"),
        F.col("p_brand").isin(*MEGA).alias("is_mega"),
        F.col("p_name").alias("keywords"),
        "p_size", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_linenumber",
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with dates in order and their delays."""
    df = filters.date_order(facts(spark, sf_dir))
    df = df.withColumns({"acceptance_delay": dates.delay_days(F.col("received"), F.col("accepted")), "publication_delay": dates.publication_delay(F.col("accepted"), F.col("article_date"))})
    return filters.sane_delays(df)


def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.analysis_window(articles(spark, sf_dir), SINCE, UNTIL)


#: The same three views for DuckDB, as common table expressions.
FACTS_SQL = """
    facts AS (
        SELECT l_orderkey || '-' || l_linenumber AS title, CAST(o_orderdate AS DATE) AS received, CAST(l_shipdate AS DATE) AS accepted,
               CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) AS article_date, p_brand AS journal, p_type AS discipline,
               l_partkey AS issn_linking, p_brand IN ('Brand#11', 'Brand#22', 'Brand#33') AS is_mega, p_name AS keywords,
               p_size, l_suppkey, l_extendedprice, l_quantity, l_returnflag, l_linenumber
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
    articles AS (
        SELECT *, CAST(date_diff('day', received, accepted) AS INTEGER) AS acceptance_delay,
               CAST(date_diff('day', accepted, article_date) AS INTEGER) AS publication_delay
        FROM facts WHERE received < article_date AND accepted < article_date AND accepted > received),
    windowed AS (
        SELECT * FROM articles WHERE acceptance_delay BETWEEN 1 AND 1095 AND publication_delay BETWEEN 1 AND 1095
        AND article_date BETWEEN DATE '1996-01-01' AND DATE '2001-06-01')"""
