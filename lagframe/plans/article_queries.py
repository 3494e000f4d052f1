"""The article pipeline and its sinks over the driver's tables: raw records and the five reference lists are bound to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagframe.functions import dates, flags
from lagframe.operators import reshape, summary
from lagframe.schema import ARTICLE_COLUMNS
from lagframe.sources import readers, writers

from . import articles as plan
from .facts import facts, table, windowed
from .file_queries import _folder
from .queries import query

SINCE, LISTED_SINCE, NEWEST = "1996-01-01", "1998-01-01", 2001
#: Total order of the rows of one title.
ORDER = ["ordinal", "issn_linking", "acceptance_delay", "publication_delay", "retraction_date", "reason", "retraction_nature", "article_date"]
DAYS = ("received", "article_date", "retraction_date")


def _issn(key: Column) -> Column:
    digits = F.lpad(key.cast("string"), 8, "0")
    return F.concat_ws("-", F.left(digits, F.lit(4)), F.right(digits, F.lit(4)))


def raw_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as raw records: dates as text (some without a day), coded types, ISSNs with hyphens."""
    l, o, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    df = l.join(o, F.expr("l_orderkey = o_orderkey")).join(p, F.expr("l_partkey = p_partkey"))
    iso = lambda d: (F.col(d) if isinstance(d, str) else d).cast("date").cast("string")
    article = iso(F.date_add(F.col("l_shipdate").cast("date"), F.col("l_quantity").cast("int")))
    none = F.lit(None).cast("string")
    return df.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("title"),
        F.col("p_brand").alias("journal"),
        F.col("o_orderpriority").alias("country"),
        F.when(F.col("l_orderkey") % 5 != 0, F.concat(F.lit("d"), "l_orderkey")).alias("doi"),
        F.when(F.col("l_suppkey") % 10 == 3, "NA").otherwise(_issn(F.col("l_suppkey"))).alias("issn_linking"),
        F.concat("p_name", F.when(F.col("p_size") == 7, "; covid-19").otherwise("")).alias("keywords"),
        F.concat(F.when(F.col("l_linenumber") == 7, "D1:Letter").otherwise("D1:Journal Article"), F.lit("; D2:"), "p_type").alias("publication_types"),
        none.alias("pubdate"),
        F.when(F.col("l_orderkey") % 9 == 0, F.left(article, F.lit(7))).otherwise(article).alias("article_date"),
        F.struct(iso("o_orderdate").alias("received"), iso("l_shipdate").alias("accepted"), none.alias("pubmed"), none.alias("medline"), none.alias("entrez")).alias("history"),
        F.col("l_partkey").alias("ordinal"),
    )


def reference_lists(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The five lists as they are read, with the source position of each row."""
    s = table(spark, sf_dir, "supplier").withColumn("issn", _issn(F.col("s_suppkey"))).withColumn("ordinal", F.col("s_suppkey"))
    years = s.withColumn("year", F.explode(F.sequence(F.lit(1995), F.lit(NEWEST))))
    shards = years.select("ordinal", "year", (F.col("s_suppkey") % 50).cast("string").alias("rank"), F.concat_ws(", ", "issn", _issn(F.col("s_suppkey") + 1)).alias("issn"), F.concat(F.col("s_suppkey") % 7, F.lit(",5")).alias("sjr"), F.when((F.col("s_suppkey") + F.col("year")) % 6 == 0, "-").otherwise(F.concat(F.lit("Q"), (F.col("s_suppkey") + F.col("year")) % 4 + 1)).alias("sjr_best_quartile"), F.col("s_nationkey").cast("string").alias("h_index"))
    codes = [F.col("s_suppkey") * 37 % 2700 + 1000, F.col("s_suppkey") % 10 + 3200]
    asjc = F.when(F.col("s_suppkey") % 4 == 1, F.concat_ws("; ", codes[1], codes[0])).otherwise(F.concat_ws("; ", *codes))
    classes = s.select("ordinal", F.col("issn").alias("print_issn"), F.lit(None).cast("string").alias("e_issn"), F.expr("if(s_suppkey % 8 = 0, 'Book Series', 'Journal')").alias("source_type"), asjc.alias("asjc"), F.expr("if(s_suppkey % 3 = 0, 'Unpaywall Open Acess', null)").alias("open_access_status"))
    doaj = s.where("s_suppkey % 2 = 0").select("ordinal", F.lit("").alias("print_issn"), F.col("issn").alias("e_issn"), F.expr("if(s_suppkey % 6 = 0, 'Yes', 'No')").alias("apc"), F.concat("s_nationkey", F.lit(" EUR")).alias("apc_amount"), F.expr("if(s_suppkey % 4 = 0, 'Yes', 'No')").alias("doaj_compliant"))
    level = lambda n: ((F.col("s_suppkey") + n) % 3).cast("string")
    national = s.where("s_suppkey % 9 <> 0").select("ordinal", F.col("issn").alias("print_issn"), F.col("issn").alias("e_issn"), F.expr("if(s_suppkey % 5 = 0, 'DOAJ', 'No')").alias("npi_open_access"), F.expr("if(s_suppkey % 2 = 0, 'Health Sciences', 'Humanities')").alias("npi_discipline"), F.concat(F.lit("field "), F.col("s_suppkey") % 11).alias("npi_field"), F.expr("if(s_suppkey % 7 = 0, '1', '0')").alias("is_conference"), F.expr("s_suppkey % 13 = 0").alias("is_series"), (F.col("s_suppkey") % 90 + 1900).alias("established"), level(0).alias("npi_level_00"), level(1).alias("npi_level_01"))
    us = lambda d: F.date_format(d, "M/d/yyyy H:mm")
    r = table(spark, sf_dir, "lineitem").where("l_linenumber = 1 and l_quantity > 45")
    retractions = r.select(F.col("l_returnflag").alias("retraction_nature"), F.col("l_linestatus").alias("reason"), us(F.date_add("l_shipdate", 100)).alias("retraction_date"), us(F.date_add("l_shipdate", 1)).alias("original_date"), F.when(F.col("l_partkey") % 3 != 0, F.concat(F.lit("d"), "l_orderkey")).alias("doi"), F.concat(F.lit("d"), "l_orderkey").alias("retraction_doi"))
    return {"shards": shards, "classes": classes, "doaj": doaj, "national": national, "retractions": retractions}


def processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = reference_lists(spark, sf_dir)
    done = plan.enrich_articles(
        plan.clean_articles(raw_articles(spark, sf_dir)),
        plan.quartile_list(lists["shards"], NEWEST),
        plan.classification_list(lists["classes"]),
        plan.open_access_list(lists["doaj"]),
        plan.national_list(lists["national"]),
        plan.retraction_list(lists["retractions"], LISTED_SINCE, LISTED_SINCE),
        since=SINCE,
        last_year=NEWEST,
    )
    return plan.distinct_articles(done, ORDER).select(ARTICLE_COLUMNS)


_BOUNDS_SQL = "CASE " + " ".join(f"WHEN asjc <= {b} THEN '{d}'" for b, d in flags.DISCIPLINE_BOUNDS) + " END"
_QUARTILES_SQL = f"""
    sh AS (SELECT s_suppkey AS k, year, CAST(s_suppkey % 50 AS INTEGER) AS rank, s_suppkey % 7 + 0.5 AS sjr, s_nationkey AS h_index,
                  CASE WHEN (s_suppkey + year) % 6 <> 0 THEN 'Q' || ((s_suppkey + year) % 4 + 1) END AS quartile
           FROM supplier, (SELECT unnest(range(1995, {NEWEST + 1})) AS year)),
    qk AS (SELECT *, lpad(CAST(j AS VARCHAR), 8, '0') AS issn_linking FROM (SELECT *, unnest([k, k + 1]) AS j FROM sh)
           WHERE year <> {NEWEST} OR quartile IS NOT NULL),
    q AS (SELECT issn_linking, year, rank, CAST(sjr AS DOUBLE) AS sjr, quartile, h_index
          FROM (SELECT *, row_number() OVER (PARTITION BY issn_linking, year ORDER BY k) AS rn FROM qk)
          WHERE rn = 1 AND issn_linking IN (SELECT issn_linking FROM qk WHERE year = {NEWEST}))"""

PROCESSED_SQL = f"""
    {_QUARTILES_SQL},
    raw AS (SELECT l_orderkey || '-' || l_linenumber AS title, p_brand AS journal, o_orderpriority AS country,
                   CASE WHEN l_orderkey % 5 <> 0 THEN 'd' || l_orderkey END AS doi,
                   CASE WHEN l_suppkey % 10 <> 3 THEN lpad(CAST(l_suppkey AS VARCHAR), 8, '0') END AS issn_linking,
                   p_name || CASE WHEN p_size = 7 THEN ', covid-19' ELSE '' END AS keywords, p_size = 7 AS is_covid,
                   'Journal Article, ' || p_type AS publication_types, CAST(o_orderdate AS DATE) AS received, CAST(l_shipdate AS DATE) AS accepted,
                   CASE WHEN l_orderkey % 9 = 0 THEN CAST(date_trunc('month', CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER)) AS DATE)
                        ELSE CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) END AS article_date, l_partkey AS ordinal, l_linenumber
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
    cln AS (SELECT *, CAST(date_diff('day', received, accepted) AS INTEGER) AS acceptance_delay,
                   CAST(date_diff('day', accepted, article_date) AS INTEGER) AS publication_delay
            FROM raw WHERE issn_linking IS NOT NULL AND l_linenumber <> 7 AND received < article_date AND accepted < article_date AND accepted > received),
    cls AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS issn_linking,
                   CAST(CASE WHEN s_suppkey % 4 = 1 THEN s_suppkey % 10 + 3200 ELSE s_suppkey * 37 % 2700 + 1000 END AS INTEGER) AS asjc, s_suppkey % 3 = 0 AS wos_open
            FROM supplier WHERE s_suppkey % 8 <> 0),
    dj AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS issn_linking, CASE WHEN s_suppkey % 6 = 0 THEN 'Yes' ELSE 'No' END AS apc,
                  s_nationkey || ' EUR' AS apc_amount, s_suppkey % 4 = 0 AS doaj_open FROM supplier WHERE s_suppkey % 2 = 0),
    nat AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS issn_linking, s_suppkey % 5 = 0 AS npi_open,
                   CASE WHEN s_suppkey % 2 = 0 THEN 'Health Sciences' ELSE 'Humanities' END AS npi_discipline, 'field ' || s_suppkey % 11 AS npi_field,
                   s_suppkey % 13 = 0 AS is_series, CAST(s_suppkey % 90 + 1900 AS INTEGER) AS established,
                   CAST(s_suppkey % 3 AS INTEGER) AS level_2000, CAST((s_suppkey + 1) % 3 AS INTEGER) AS level_2001
            FROM supplier WHERE s_suppkey % 9 <> 0 AND s_suppkey % 7 <> 0),
    ret AS (SELECT l_returnflag AS retraction_nature, l_linestatus AS reason, CAST(l_shipdate AS DATE) + 100 AS retraction_date,
                   CAST(l_shipdate AS DATE) + 1 AS original_date, 'd' || l_orderkey AS merge_key
            FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 45 AND CAST(l_shipdate AS DATE) + 1 >= DATE '{LISTED_SINCE}'),
    done AS (SELECT c.* EXCLUDE (article_date, accepted, l_linenumber), coalesce(original_date, article_date) AS article_date,
                    asjc BETWEEN 3200 AND 3207 AS is_psych, FALSE AS is_mega, q.h_index AS h_index_year, q.quartile AS quartile_year, q.rank AS rank_year,
                    coalesce(doaj_open, FALSE) OR coalesce(wos_open, FALSE) OR npi_open AS open_access, {_BOUNDS_SQL} AS discipline, asjc,
                    npi_discipline, npi_field, CASE least(year(article_date), {NEWEST}) WHEN 2000 THEN level_2000 WHEN 2001 THEN level_2001 END AS npi_year,
                    is_series, established, apc, apc_amount, retraction_nature, reason, retraction_date, reason IS NOT NULL AS is_retracted
             FROM cln c LEFT JOIN cls ON c.issn_linking = cls.issn_linking LEFT JOIN dj ON c.issn_linking = dj.issn_linking
             JOIN nat ON c.issn_linking = nat.issn_linking LEFT JOIN q ON c.issn_linking = q.issn_linking AND least(year(article_date), {NEWEST}) = q.year
             LEFT JOIN ret ON c.doi = ret.merge_key WHERE received >= DATE '{SINCE}'),
    processed AS (SELECT {", ".join(ARTICLE_COLUMNS)} FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY {", ".join(f"{c} NULLS FIRST" for c in ORDER)}) AS rn FROM done) WHERE rn = 1)"""


@query(f"WITH {PROCESSED_SQL} SELECT * FROM processed", days=DAYS)
def article_pipeline(spark, sf_dir):
    return processed(spark, sf_dir)


@query(f"WITH {_QUARTILES_SQL} SELECT * FROM q")
def quartile_base_list(spark, sf_dir):
    return plan.quartile_list(reference_lists(spark, sf_dir)["shards"], NEWEST)


@query(f"WITH {PROCESSED_SQL} SELECT * FROM processed", days=DAYS)
def processed_round_trip(spark, sf_dir):
    """Processed articles written as tab-separated text and read by the fixed schema."""
    path = _folder(spark)
    writers.write_processed(processed(spark, sf_dir), path)
    return readers.read_processed(spark, path).select(ARTICLE_COLUMNS)


@query("SELECT year(article_date) AS article_year, count(*) AS n, CAST(sum(acceptance_delay) AS BIGINT) AS days FROM windowed GROUP BY 1", views=True)
def article_sink(spark, sf_dir):
    """Articles written as Parquet by year and read again."""
    path = _folder(spark)
    writers.write_articles(windowed(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("article_year").agg(F.count("*").alias("n"), F.sum("acceptance_delay").alias("days"))


@query("SELECT year(article_date) AS article_year, count(*) AS n, CAST(sum(CASE WHEN year(article_date) % 2 = 0 THEN 2 ELSE 1 END * acceptance_delay) AS BIGINT) AS days FROM windowed GROUP BY 1", views=True)
def article_sink_rerun(spark, sf_dir):
    """Articles written by year, then even years written anew with twice the delay over what is there."""
    path = _folder(spark)
    df = windowed(spark, sf_dir)
    writers.write_articles(df, path)
    even = df.where(F.year("article_date") % 2 == 0).withColumn("acceptance_delay", F.col("acceptance_delay") * 2)
    for _ in range(2):
        writers.write_articles(even, path, replace=True)
    return spark.read.parquet(path).groupBy("article_year").agg(F.count("*").alias("n"), F.sum("acceptance_delay").alias("days"))


@query("+ c AS (SELECT journal, count(*) AS n FROM windowed GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY journal) AS VARCHAR) AS row, journal, CAST(n AS VARCHAR) AS n FROM c", views=True)
def table_sink(spark, sf_dir):
    """A small result table written as CSV with row numbers and read again."""
    path = _folder(spark)
    writers.write_table(summary.counts_by(windowed(spark, sf_dir), F.col("journal"), "journal"), path, ["journal"], row_number=True)
    return readers.read_csv_na(spark, path)


@query("SELECT c_nationkey || '' AS c_nationkey, c_custkey || '' AS c_custkey, c_name FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey DESC) AS rn FROM customer) WHERE rn = 1")
def keep_first_listed(spark, sf_dir):
    """The first row of each nation in the order of files and of rows within them."""
    path = _folder(spark)
    table(spark, sf_dir, "customer").repartition("c_mktsegment").sortWithinPartitions("c_mktsegment", F.desc("c_custkey")).write.partitionBy("c_mktsegment").option("header", True).csv(path)
    listed = reshape.with_ordinal(spark.read.option("header", True).csv(f"{path}/c_mktsegment=*"))
    return plan.dedupe.keep_first(listed, ["c_nationkey"], ["file", "block", "ordinal"]).select("c_nationkey", "c_custkey", "c_name")


@query(
    """SELECT title, CAST(date_diff('day', accepted, coalesce(CASE WHEN l_quantity > 25 THEN article_date END, date_trunc('month', article_date)::DATE)) AS INTEGER) AS delay,
              date_trunc('year', article_date)::DATE AS year FROM facts""",
    views=True, days=("year",),
)
def publication_delay_fallback(spark, sf_dir):
    """Delays to the article's own date, or to the issue's date (a year and month) where it has none."""
    df = facts(spark, sf_dir)
    issue = dates.parse_partial_date(F.date_format("article_date", "yyyy-MM"))
    own = F.when(F.col("l_quantity") > 25, F.col("article_date"))
    return df.select("title", dates.publication_delay(F.col("accepted"), own, issue).alias("delay"), dates.floor_year(F.col("article_date")).alias("year"))
