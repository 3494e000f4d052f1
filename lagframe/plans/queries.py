"""Named queries over the driver's tables, each with its DuckDB twin where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagframe.functions import dates, flags, text
from lagframe.operators import dedupe, distribution, filters, joins, model, reshape, rules, splines, summary

from .facts import FACTS_SQL, TIE, articles, facts, table, windowed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, views: bool = False, days: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query under its function's name; with ``views`` the SQL reads the fact views.

    ``days`` are date columns, returned as ISO text on both sides: engines' clients differ in what they make of dates.
    """

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in days})

        QUERIES[f.__name__] = run if days else f
        if sql is not None:
            whole = f"WITH {FACTS_SQL}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().removeprefix('+')}" if views else sql
            SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in days)}) FROM ({whole})" if days else whole
        return f

    return add


def _year() -> Column:
    return dates.year_label(F.col("article_date"))


_LE = lambda c, p: ", ".join(f"count(*) FILTER (WHERE {c} <= {d}) / count(*) AS {p}_le_{d}" for d in summary.LIMITS)
_DELAYS_SQL = "count(*) AS n, avg(acceptance_delay) AS mean_acc, median(acceptance_delay) AS median_acc, avg(publication_delay) AS mean_pub, median(publication_delay) AS median_pub"
_THRESHOLDS_SQL = f"{_DELAYS_SQL}, {_LE('acceptance_delay', 'acc')}, {_LE('publication_delay', 'pub')}"


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Sums of doubles depend on their order; both sides of a comparison are rounded."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Delay tables


@query("SELECT date_trunc('month', article_date)::DATE AS month, count(*) AS n, avg(acceptance_delay) AS mean_acc_delay, avg(publication_delay) AS mean_pub_delay FROM windowed GROUP BY 1", views=True, days=('month',))
def delay_monthly(spark, sf_dir):
    return summary.monthly_delays(windowed(spark, sf_dir))


@query(f"SELECT CAST(year(article_date) AS VARCHAR) AS article_year, {_DELAYS_SQL} FROM windowed GROUP BY 1", views=True)
def delay_yearly(spark, sf_dir):
    return summary.yearly_delays(windowed(spark, sf_dir), _year())


def _overall_sql() -> str:
    rows = ["SELECT 'n' AS variable, CAST(count(*) AS DOUBLE) AS value FROM windowed"]
    for c, n in (("acceptance_delay", "acceptance"), ("publication_delay", "publication")):
        stats = {"mean": f"avg({c})", "sd": f"stddev_samp({c})", "median": f"median({c})", "q25": f"quantile_cont({c}, 0.25)", "q75": f"quantile_cont({c}, 0.75)", "min": f"CAST(min({c}) AS DOUBLE)", "max": f"CAST(max({c}) AS DOUBLE)", "iqr": f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"}
        stats |= {f"le_{d}": f"count(*) FILTER (WHERE {c} <= {d}) / count(*)" for d in (60, 90, 180, 365)}
        rows += [f"SELECT '{n}_{k}', round({v}, 6) FROM windowed" for k, v in stats.items()]
    return " UNION ALL ".join(rows)


@query(_overall_sql(), views=True)
def delay_overall_long(spark, sf_dir):
    return _rounded(summary.overall_delays(windowed(spark, sf_dir)), "value")


def _by(column: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = windowed(spark, sf_dir).withColumn("is_flag", text.keyword_flag(F.col("keywords"), F.col("keywords"), ["ring", "hot"]))
        return summary.delays_by(df, column)

    run.__name__ = f"delay_by_{column.removeprefix('is_')}"
    shown = column if column != "is_flag" else r"regexp_matches(keywords, '(?i)\b(?:ring|hot)\b') AS is_flag"
    query(f"SELECT {shown}, {_THRESHOLDS_SQL} FROM windowed GROUP BY 1", views=True)(run)


for _column in ("discipline", "is_mega", "is_flag", "journal"):
    _by(_column)


@query(
    f"""SELECT CASE WHEN discipline IS NOT NULL THEN 'discipline' WHEN journal IS NOT NULL THEN 'journal' ELSE 'is_mega' END AS variable,
        coalesce(discipline, journal, CAST(is_mega AS VARCHAR)) AS level, {_THRESHOLDS_SQL}
        FROM windowed GROUP BY GROUPING SETS ((discipline), (journal), (is_mega))""",
    views=True,
)
def delay_grouping_sets(spark, sf_dir):
    return summary.delays_by_each(windowed(spark, sf_dir), ["discipline", "journal", "is_mega"])


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A yearly list: quartile of each supplier's order volume by year, long."""
    volume = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey"), F.year("l_shipdate").alias("year")).agg(F.count("*").alias("c"))
    return volume.select("l_suppkey", "year", F.concat(F.lit("Q"), F.pmod("c", F.lit(4)) + 1).alias("quartile"))


_LEVELS_SQL = "levels AS (SELECT l_suppkey, year(l_shipdate) AS year, 'Q' || (count(*) % 4 + 1) AS quartile FROM lineitem GROUP BY 1, 2)"


@query(
    f"""+ {_LEVELS_SQL} SELECT CAST(year(article_date) AS VARCHAR) AS article_year, quartile, {_THRESHOLDS_SQL}
        FROM windowed a LEFT JOIN levels v ON a.l_suppkey = v.l_suppkey AND least(year(article_date), 2000) = v.year
        WHERE quartile IS NOT NULL GROUP BY 1, 2""",
    views=True,
)
def delay_year_quartile(spark, sf_dir):
    df = joins.year_lookup(windowed(spark, sf_dir), _levels(spark, sf_dir), "l_suppkey", F.year("article_date"), 2000, ["quartile"])
    return summary.delays_by(df.withColumn("article_year", _year()), "article_year", "quartile")


# Shares


@query("SELECT CAST(year(article_date) AS VARCHAR) AS article_year, count(*) AS article_number, (SELECT count(*) FROM windowed) AS all_articles, count(*) / (SELECT count(*) FROM windowed) * 100 AS percentage FROM windowed GROUP BY 1", views=True)
def share_yearly(spark, sf_dir):
    return summary.yearly_share(windowed(spark, sf_dir), _year())


@query(
    """+ t AS (SELECT count(*) AS all_articles, count(*) FILTER (WHERE is_mega) AS all_flagged FROM windowed)
       SELECT CAST(year(article_date) AS VARCHAR) AS article_year, any_value(all_articles) AS all_articles, any_value(all_flagged) AS all_flagged, count(*) AS all_this_year,
              count(*) FILTER (WHERE is_mega) AS flagged, flagged / any_value(all_flagged) * 100 AS percentage_flagged,
              flagged / any_value(all_articles) * 100 AS percentage_all, flagged / count(*) * 100 AS percentage_this_year
       FROM windowed, t GROUP BY 1""",
    views=True,
)
def flag_share_yearly(spark, sf_dir):
    return summary.flag_share(windowed(spark, sf_dir), F.col("is_mega"), _year())


def _with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles whose discipline is unknown for small parts."""
    known = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("issn_linking"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"))
    return joins.left_enrich(windowed(spark, sf_dir), known, "issn_linking", "_part")


_GAPS_SQL = "gaps AS (SELECT w.*, p_type AS kind, k.p_size AS size FROM windowed w LEFT JOIN (SELECT * FROM part WHERE p_size > 10) k ON w.issn_linking = k.p_partkey)"


@query(f"+ {_GAPS_SQL} SELECT kind, count(*) AS n, (SELECT count(*) FROM gaps) AS all_articles, count(*) / (SELECT count(*) FROM gaps) * 100 AS percentage_all FROM gaps GROUP BY 1", views=True)
def category_share_with_null(spark, sf_dir):
    return summary.category_share(_with_gaps(spark, sf_dir), "kind")


@query(
    f"""+ {_GAPS_SQL}, c AS (SELECT CAST(year(article_date) AS VARCHAR) AS article_year, kind, count(*) AS n FROM gaps GROUP BY 1, 2)
       SELECT article_year, kind, n, CAST(sum(n) OVER y AS BIGINT) AS all_this_year, n / sum(n) OVER y * 100 AS percentage_year,
              CASE WHEN kind IS NOT NULL THEN n / (sum(n) FILTER (WHERE kind IS NOT NULL) OVER y) * 100 END AS percentage_known
       FROM c WINDOW y AS (PARTITION BY article_year)""",
    views=True,
)
def level_share_by_year(spark, sf_dir):
    return summary.level_share(_with_gaps(spark, sf_dir), _year(), "kind")


@query("+ c AS (SELECT discipline, count(*) AS n FROM windowed GROUP BY 1) SELECT c.discipline, journal, count(*) AS m, any_value(n) AS total FROM windowed w JOIN c ON w.discipline = c.discipline GROUP BY 1, 2", views=True)
def totals_join(spark, sf_dir):
    counts = windowed(spark, sf_dir).groupBy("discipline", "journal").agg(F.count("*").alias("m"))
    return joins.with_totals(counts, "discipline", "m", "total")


# Profiles and subsets


def _with_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _with_gaps(spark, sf_dir)
    return df.withColumns({"is_large": flags.in_interval(F.col("size"), 30, 50), "is_ring": text.keyword_flag(F.col("keywords"), F.col("kind"), ["ring"])})


@query(
    f"""+ {_GAPS_SQL}, f AS (SELECT is_mega, size BETWEEN 30 AND 50 AS is_large,
            regexp_matches(keywords, '(?i)\\bring\\b') OR regexp_matches(kind, '(?i)\\bring\\b') AS is_ring FROM gaps)
       """
    + " UNION ALL ".join(f"SELECT '{c}' AS variable, count(*) FILTER (WHERE NOT {c}) AS is_false, count(*) FILTER (WHERE {c}) AS is_true, count(*) FILTER (WHERE {c} IS NULL) AS is_na FROM f" for c in ("is_mega", "is_large", "is_ring")),
    views=True,
)
def logical_profile(spark, sf_dir):
    return summary.logical_profile(_with_flags(spark, sf_dir), ["is_mega", "is_large", "is_ring"])


@query(
    f"+ {_GAPS_SQL} "
    + " UNION ALL ".join(f"SELECT '{c}' AS variable, CAST(min({c}) AS DOUBLE) AS min, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, round(avg({c}), 6) AS mean, median(CAST({c} AS DOUBLE)) AS median, round(stddev_samp({c}), 6) AS sd, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3, CAST(max({c}) AS DOUBLE) AS max, quantile_cont(CAST({c} AS DOUBLE), 0.75) - quantile_cont(CAST({c} AS DOUBLE), 0.25) AS iqr FROM gaps" for c in ("acceptance_delay", "publication_delay", "size")),
    views=True,
)
def numeric_profile(spark, sf_dir):
    return _rounded(summary.numeric_profile(_with_gaps(spark, sf_dir), ["acceptance_delay", "publication_delay", "size"]), "mean", "sd")


YEARS = [1995, 1996, 1997, 1998, 1999, 2000, 2001]


def _wide_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each supplier by year, a column a year."""
    long = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(F.count("*").alias("c"))
    return reshape.long_to_wide(long, "l_suppkey", "year", YEARS, ["c"], base_year=2000)


_WIDE_SQL = "long AS (SELECT l_suppkey, year(l_shipdate) AS year, count(*) AS c FROM lineitem GROUP BY 1, 2), base AS (SELECT l_suppkey FROM long WHERE year = 2000)"


@query(f"WITH {_WIDE_SQL} SELECT l_suppkey, " + ", ".join(f"max(c) FILTER (WHERE year = {y}) AS c_{y}" for y in YEARS) + " FROM long WHERE l_suppkey IN (SELECT l_suppkey FROM base) GROUP BY 1")
def year_columns(spark, sf_dir):
    return _wide_counts(spark, sf_dir)


@query(f"WITH {_WIDE_SQL} SELECT l_suppkey, CAST(max(c) FILTER (WHERE year = 2001) AS DOUBLE) AS latest, round_even(avg(c), 3) AS pooled_mean FROM long WHERE l_suppkey IN (SELECT l_suppkey FROM base) GROUP BY 1")
def latest_vs_pooled_mean(spark, sf_dir):
    return summary.latest_vs_pooled(_wide_counts(spark, sf_dir), "l_suppkey", "c_", "c_2001")


@query("SELECT count(*) AS n, avg(acceptance_delay) AS mean_acc, median(acceptance_delay) AS median_acc, round(stddev_samp(acceptance_delay), 6) AS sd_acc, avg(publication_delay) AS mean_pub, median(publication_delay) AS median_pub, round(stddev_samp(publication_delay), 6) AS sd_pub FROM windowed WHERE l_returnflag = 'R'", views=True)
def subset_summary(spark, sf_dir):
    return _rounded(summary.subset_delays(windowed(spark, sf_dir), F.col("l_returnflag") == "R"), "sd_acc", "sd_pub")


@query("SELECT year(article_date) AS article_year, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM windowed WHERE l_returnflag = 'R' GROUP BY 1", views=True)
def subset_freq_year(spark, sf_dir):
    return summary.subset_frequency(windowed(spark, sf_dir), F.col("l_returnflag") == "R", F.year("article_date"), "article_year")


@query("SELECT journal, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM windowed WHERE l_returnflag = 'R' GROUP BY 1", views=True)
def subset_freq_group(spark, sf_dir):
    return summary.subset_frequency(windowed(spark, sf_dir), F.col("l_returnflag") == "R", F.col("journal"), "journal")


_TENTHS = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]"


@query(f"+ q AS (SELECT date_trunc('month', article_date)::DATE AS month, quantile_cont(acceptance_delay, {_TENTHS}) AS q FROM windowed GROUP BY 1) SELECT month, i / 10.0::DOUBLE AS decile, round(q[i], 6) AS value FROM (SELECT month, q, CAST(unnest(range(1, 10)) AS INTEGER) AS i FROM q)", views=True, days=('month',))
def monthly_deciles(spark, sf_dir):
    return _rounded(summary.monthly_deciles(windowed(spark, sf_dir), "article_date", "acceptance_delay"), "value")


@query("SELECT " + ", ".join(f"count(*) FILTER (WHERE {c} <= 1) AS {c}_low, count(*) FILTER (WHERE {c} >= 1095) AS {c}_high, count(*) FILTER (WHERE {c} <= 1 OR {c} >= 1095) AS {c}_either" for c in summary.DELAYS) + " FROM articles", views=True)
def outlier_counts(spark, sf_dir):
    return summary.outliers(articles(spark, sf_dir))


# Counts


@query("SELECT count(DISTINCT o_custkey) AS n FROM orders")
def distinct_groups(spark, sf_dir):
    return summary.distinct_groups(table(spark, sf_dir, "orders"), "o_custkey")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def group_sizes(spark, sf_dir):
    return summary.group_sizes(table(spark, sf_dir, "orders"), "o_custkey")


@query("WITH s AS (SELECT count(*) AS n FROM orders GROUP BY o_custkey) SELECT count(*) FILTER (WHERE n < 10) AS small, count(*) AS groups, round_even(count(*) FILTER (WHERE n < 10) / count(*) * 100, 2) AS percentage FROM s")
def small_group_share(spark, sf_dir):
    return summary.small_group_share(table(spark, sf_dir, "orders"), "o_custkey")


@query("SELECT year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1")
def counts_year(spark, sf_dir):
    return summary.counts_by(table(spark, sf_dir, "orders"), F.year("o_orderdate"), "year")


@query("SELECT year(o_orderdate) || '-' || month(o_orderdate) || '-01' AS month_label, count(*) AS n FROM orders GROUP BY 1")
def counts_month_label(spark, sf_dir):
    return summary.counts_by(table(spark, sf_dir, "orders"), dates.month_label(F.col("o_orderdate")), "month_label")


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1", days=('day',))
def counts_day(spark, sf_dir):
    return summary.counts_by(table(spark, sf_dir, "events"), F.col("ts").cast("date"), "day")


@query("WITH g AS (SELECT coalesce(CAST(year(nullif(o_orderdate::DATE, DATE '1996-02-29')) AS VARCHAR), 'NA') AS label FROM orders) SELECT label, count(*) AS n FROM g GROUP BY 1")
def counts_year_label_na(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    label = dates.year_label(F.nullif(day, F.lit("1996-02-29").cast("date")), keep_null=True)
    return summary.counts_by(table(spark, sf_dir, "orders"), label, "label")


@query("SELECT count(*) FILTER (WHERE is_mega AND article_date >= DATE '2000-01-01') AS flagged, count(*) AS total, round_even(count(*) FILTER (WHERE is_mega AND article_date >= DATE '2000-01-01') / count(*) * 100, 3) AS percentage FROM windowed", views=True)
def flag_since_date(spark, sf_dir):
    return summary.flag_since(windowed(spark, sf_dir), F.col("is_mega"), "article_date", "2000-01-01")


@query("SELECT year(article_date) AS year, month(article_date) AS month, avg(acceptance_delay) AS mean_delay, count(*) AS n FROM windowed GROUP BY 1, 2", views=True)
def month_year_matrix(spark, sf_dir):
    return summary.delay_by_year_and_month(windowed(spark, sf_dir))


@query("+ m AS (SELECT year(article_date) AS year, month(article_date) AS month, avg(acceptance_delay) AS d FROM windowed GROUP BY 1, 2) SELECT month, " + ", ".join(f'max(d) FILTER (WHERE year = {y}) AS "{y}"' for y in YEARS[1:]) + " FROM m GROUP BY 1", views=True)
def year_curves(spark, sf_dir):
    return distribution.year_curves(summary.delay_by_year_and_month(windowed(spark, sf_dir)), YEARS[1:])


# Two classifications

_PAIRS = [("ECONOMY", "AFRICA"), ("SMALL", "AMERICA"), ("LARGE", "ASIA"), ("PROMO", "EUROPE")]


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.expr("s_nationkey = n_nationkey")).join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    region = region.select(F.col("s_suppkey").alias("l_suppkey"), F.when(F.col("s_acctbal") > 0, F.upper("r_name")).alias("region"))
    return joins.left_enrich(windowed(spark, sf_dir), region, "l_suppkey", "_region")


_CLASSIFIED_SQL = "c AS (SELECT w.*, CASE WHEN s_acctbal > 0 THEN upper(r_name) END AS region FROM windowed w LEFT JOIN supplier ON w.l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"


@query(f"+ {_CLASSIFIED_SQL} SELECT region, count(*) AS n FROM c WHERE region IS NOT NULL GROUP BY 1", views=True)
def class_counts(spark, sf_dir):
    return summary.counts_by(_classified(spark, sf_dir), F.col("region"), "region")


_AGREE_SQL = " OR ".join(f"(discipline = '{a}' AND region = '{b}')" for a, b in _PAIRS)


@query(f"+ {_CLASSIFIED_SQL} SELECT count(*) FILTER (WHERE region IS NOT NULL AND discipline <> 'STANDARD' AND ({_AGREE_SQL})) AS agreement, count(*) AS total, count(*) FILTER (WHERE region IS NOT NULL AND discipline <> 'STANDARD' AND ({_AGREE_SQL})) / count(*) * 100 AS percentage FROM c", views=True)
def class_agreement(spark, sf_dir):
    counted = F.col("region").isNotNull() & F.col("discipline").isNotNull() & (F.col("discipline") != "STANDARD")
    return summary.agreement_rate(_classified(spark, sf_dir), flags.agreement(F.col("discipline"), F.col("region"), _PAIRS), counted)


@query(
    """SELECT l_linenumber, count(*) AS raw, count(*) FILTER (WHERE accepted > received) AS in_order,
              count(*) FILTER (WHERE accepted > received AND l_returnflag <> 'N') AS of_type,
              count(*) FILTER (WHERE accepted > received AND l_returnflag <> 'N' AND article_date >= DATE '1998-01-01') AS recent FROM facts GROUP BY 1""",
    views=True,
)
def attrition(spark, sf_dir):
    return summary.attrition(facts(spark, sf_dir), "l_linenumber", {"in_order": F.expr("accepted > received"), "of_type": F.expr("l_returnflag <> 'N'"), "recent": F.expr("article_date >= date'1998-01-01'")})


@query("SELECT count(*) AS raw, count(*) FILTER (WHERE accepted > received) AS in_order, count(*) FILTER (WHERE accepted > received AND l_returnflag <> 'N') AS of_type FROM facts", views=True)
def attrition_total(spark, sf_dir):
    per_file = summary.attrition(facts(spark, sf_dir), "l_linenumber", {"in_order": F.expr("accepted > received"), "of_type": F.expr("l_returnflag <> 'N'")})
    return summary.attrition_total(per_file, "l_linenumber")


# Deduplication

_TIE_SQL = ", ".join(TIE)


@query(f"SELECT title, journal, discipline, received, accepted, article_date FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY {_TIE_SQL}) AS rn FROM facts) WHERE rn = 1", views=True, days=('received', 'accepted', 'article_date'))
def dedupe_keep_first(spark, sf_dir):
    return dedupe.keep_first(facts(spark, sf_dir), ["title"], TIE).select("title", "journal", "discipline", "received", "accepted", "article_date")


@query("SELECT l_partkey, l_orderkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS rn FROM lineitem) WHERE rn = 1")
def first_per_key(spark, sf_dir):
    order = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]
    return dedupe.keep_first(table(spark, sf_dir, "lineitem"), ["l_partkey"], order).select("l_partkey", "l_orderkey", "l_suppkey", "l_quantity")


@query("SELECT title, count(*) AS n FROM facts GROUP BY 1 HAVING count(*) > 1", views=True)
def duplicated_titles(spark, sf_dir):
    return dedupe.is_duplicated(facts(spark, sf_dir), ["title"])


# Joins


@query("SELECT o_orderkey, o_custkey, c_name, c_acctbal, c_nationkey, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def enrich_chain(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    nation = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    region = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    df = joins.left_enrich(table(spark, sf_dir, "orders"), customer, "o_custkey", "_c")
    df = joins.left_enrich(joins.left_enrich(df, nation, "c_nationkey", "_n"), region, "n_regionkey", "_r")
    return df.select("o_orderkey", "o_custkey", "c_name", "c_acctbal", "c_nationkey", "n_name", "r_name")


@query(
    """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 997 <> 0 THEN o_orderkey END AS doi, CAST(o_orderdate AS DATE) AS article_date FROM orders),
       r AS (SELECT CASE WHEN l_partkey % 401 <> 0 THEN l_orderkey END AS merge_key, l_returnflag AS reason, CAST(l_shipdate AS DATE) AS original_date FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 45)
       SELECT o_orderkey, reason IS NOT NULL AS is_retracted, CASE WHEN original_date IS NOT NULL THEN original_date ELSE article_date END AS article_date
       FROM o LEFT JOIN r ON o.doi IS NOT DISTINCT FROM r.merge_key""", days=('article_date',))
def nullsafe_fanout_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("if(o_orderkey % 997 <> 0, o_orderkey, null)").alias("doi"), F.col("o_orderdate").cast("date").alias("article_date"))
    r = table(spark, sf_dir, "lineitem").where("l_linenumber = 1 and l_quantity > 45").select(F.expr("if(l_partkey % 401 <> 0, l_orderkey, null)").alias("merge_key"), F.col("l_returnflag").alias("reason"), F.col("l_shipdate").cast("date").alias("original_date"))
    df = joins.join_on_nullable(o, r, "doi", "merge_key", null_match=True)
    return df.select("o_orderkey", flags.is_retracted(F.col("reason"), F.lit(None)).alias("is_retracted"), flags.corrected_date(F.col("article_date"), F.col("original_date"), F.col("original_date")).alias("article_date"))


@query("SELECT title, journal, p.p_size AS is_conference FROM facts f LEFT JOIN (SELECT p_partkey, p_size % 5 AS p_size FROM part WHERE p_size > 10) p ON f.issn_linking = p.p_partkey WHERE p.p_size = 0 AND received >= DATE '1998-01-01'", views=True)
def outer_then_filter(spark, sf_dir):
    listed = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("issn_linking"), F.expr("p_size % 5").alias("is_conference"))
    df = joins.left_enrich(facts(spark, sf_dir), listed, "issn_linking", "_list")
    return filters.recent_non_conference(df, "1998-01-01").select("title", "journal", "is_conference")


@query(f"+ {_LEVELS_SQL} SELECT title, accepted, quartile FROM facts f LEFT JOIN levels v ON f.l_suppkey = v.l_suppkey AND year(article_date) = v.year", views=True, days=('accepted',))
def year_lookup_unclamped(spark, sf_dir):
    return joins.year_lookup(facts(spark, sf_dir), _levels(spark, sf_dir), "l_suppkey", F.year("article_date"), 2000, ["quartile"], clamp=False).select("title", "accepted", "quartile")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_pending(spark, sf_dir):
    return joins.pending(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query("SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def semi_complete(spark, sf_dir):
    return joins.present_in(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query("WITH f AS (SELECT l_linenumber AS file, nullif(l_returnflag, 'A') AS a, CASE WHEN l_linenumber < 6 THEN l_shipdate END AS b, l_orderkey FROM lineitem) SELECT file, count(*) AS n FROM f WHERE file IN (SELECT file FROM f GROUP BY file HAVING bool_or(a IS NOT NULL) AND bool_or(b IS NOT NULL)) GROUP BY 1")
def incomplete_files(spark, sf_dir):
    from lagframe.sources.readers import drop_incomplete_files

    df = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("file"), F.nullif("l_returnflag", F.lit("A")).alias("a"), F.expr("if(l_linenumber < 6, l_shipdate, null)").alias("b"))
    return drop_incomplete_files(df, ["a", "b"]).groupBy("file").agg(F.count("*").alias("n"))


# Reshaping


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def split_rows(spark, sf_dir):
    return reshape.split_rows(table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("word")), "word", " ")


@query("SELECT s_suppkey, replace(s_name, '-', '') AS issn_linking FROM supplier WHERE s_suppkey % 3 <> 0 UNION SELECT s_suppkey, s_nationkey || '1234' FROM supplier WHERE s_suppkey % 2 <> 0")
def key_builder(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr("if(s_suppkey % 3 <> 0, s_name, 'NA')").alias("p"), F.expr("if(s_suppkey % 2 <> 0, concat(s_nationkey, '-1234'), '')").alias("o"))
    return reshape.issn_keys(df, "p", "o").select("s_suppkey", "issn_linking")


@query("SELECT 'supplier' AS kind, s_suppkey AS key, s_acctbal AS balance, NULL AS segment FROM supplier UNION ALL SELECT 'customer', c_custkey, c_acctbal, c_mktsegment FROM customer")
def bind_rows(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return reshape.bind_rows(s, c)


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def unnest_struct(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").alias("history"))
    return reshape.unnest(df, "history").groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT r_regionkey AS \"region_key\", r_name AS name FROM region")
def canonical_names(spark, sf_dir):
    df = table(spark, sf_dir, "region")
    return reshape.canonical_columns(df.select(F.col("r_regionkey").alias("Region Key"), F.col("r_name").alias("Name"), F.lit("x").alias("NAME")))


@query("SELECT o_orderkey, nullif(o_orderstatus, 'O') AS status, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders")
def sentinel_null(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("if(o_orderstatus = 'O', '-', o_orderstatus)").alias("status"), F.expr("if(o_orderkey % 7 = 0, 'NA', o_orderpriority)").alias("priority"))
    return reshape.null_sentinels_everywhere(df)


@query("SELECT p_partkey, p_name, p_brand, p_type FROM part")
def drop_columns_like(spark, sf_dir):
    return reshape.drop_like(table(spark, sf_dir, "part"), "SIZE$|price")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 4 = 0 OR 1990 + s_nationkey <= 2005")
def still_running(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").withColumn("ceased", F.expr("if(s_suppkey % 4 = 0, null, 1990 + s_nationkey)"))
    return filters.not_ceased(df, 2005).select("s_suppkey", "s_name")


# Scalar functions


@query("SELECT p_partkey, starts_with(p_brand, 'Brand#1') AS is_first, substring(p_brand, 7) AS number, length(p_name) AS n FROM part")
def prefix_and_substring(spark, sf_dir):
    brand = F.col("p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", text.head_is(brand, "Brand#1").alias("is_first"), text.after(brand, 6).alias("number"), F.length("p_name").cast("long").alias("n"))


@query("WITH t AS (SELECT p_partkey, 'D01:' || p_name || ';D02:' || p_type AS types FROM part) SELECT p_partkey, array_to_string(regexp_extract_all(types, ':([^;]+)', 1), ', ') AS types FROM t")
def type_extract(spark, sf_dir):
    types = F.concat(F.lit("D01:"), "p_name", F.lit(";D02:"), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", text.extract_types(types).alias("types"))


@query(r"SELECT doc_id, regexp_matches(text, '(?i)\b(?:the thing|and|of)\b') OR regexp_matches(nullif(lang, 'en'), '(?i)\b(?:the thing|and|of)\b') AS flag FROM documents")
def keyword_flag(spark, sf_dir):
    flag = text.keyword_flag(F.col("text"), F.nullif(F.col("lang"), F.lit("en")), ["the thing", "and", "of"])
    return table(spark, sf_dir, "documents").select("doc_id", flag.alias("flag"))


@query(r"SELECT role, count(*) FILTER (WHERE regexp_matches(text, '(?i)\b(?:replication|replicating|replication of|replication study)\b')) AS n, count(*) FILTER (WHERE contains(text, 'tion')) AS with_tion FROM conversations GROUP BY 1")
def replication_flag(spark, sf_dir):
    df = table(spark, sf_dir, "conversations")
    return df.groupBy("role").agg(F.count_if(text.any_term(F.col("text"), text.REPLICATION_TERMS)).alias("n"), F.count_if(text.has_text(F.col("text"), "tion")).alias("with_tion"))


_CUTS = [4, 7, 10, 3]


@query("WITH t AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, [4, 7, 10, 3][1 + o_orderkey % 4] AS n, o_orderdate FROM orders), c AS (SELECT o_orderkey, left(d, n) AS s, o_orderdate FROM t) SELECT o_orderkey, CAST(coalesce(try_strptime(s, '%Y-%m-%d'), try_strptime(s, '%Y-%m'), CASE WHEN length(s) = 4 THEN try_strptime(s, '%Y') END) AS DATE) AS partial, CAST(o_orderdate AS DATE) AS us FROM c", days=('partial', 'us'))
def date_formats(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("s", F.left(F.date_format("o_orderdate", "yyyy-MM-dd"), F.element_at(F.array(*map(F.lit, _CUTS)), (F.col("o_orderkey") % 4 + 1).cast("int"))))
    us = dates.parse_us_timestamp(F.date_format("o_orderdate", "M/d/yyyy H:mm"))
    return df.select("o_orderkey", dates.parse_partial_date(F.col("s")).alias("partial"), us.alias("us"))


@query("SELECT p_partkey, CASE WHEN p_size <= 5 THEN 'tiny' WHEN p_size <= 20 THEN 'small' WHEN p_size <= 40 THEN 'middle' END AS size_class, CASE " + " ".join(f"WHEN 1000 + p_size * 55 <= {b} THEN '{d}'" for b, d in flags.DISCIPLINE_BOUNDS) + " END AS discipline FROM part")
def bucket_class(spark, sf_dir):
    bounds = [(5, "tiny"), (20, "small"), (40, "middle")]
    return table(spark, sf_dir, "part").select("p_partkey", flags.bucket(F.col("p_size"), bounds).alias("size_class"), flags.discipline((F.col("p_size") * 55 + 1000).cast("string")).alias("discipline"))


@query("SELECT p_partkey, nullif(p_size, 13) BETWEEN 10 AND 20 AS in_interval, coalesce(nullif(p_brand, 'Brand#12') IN ('Brand#11', 'Brand#12'), FALSE) AS in_set FROM part")
def interval_and_set_flag(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", flags.in_interval(F.nullif(F.col("p_size"), F.lit(13)), 10, 20).alias("in_interval"), flags.in_set(F.nullif(F.col("p_brand"), F.lit("Brand#12")), ["Brand#11", "Brand#12"]).alias("in_set"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN TRUE WHEN p_type = 'SMALL' THEN TRUE WHEN p_brand = 'Brand#11' THEN TRUE ELSE FALSE END AS open_access, coalesce(nullif(p_type, 'PROMO') <> '', FALSE) AS present FROM part")
def multi_source_flag(spark, sf_dir):
    doaj, wos, national = F.expr("if(p_size % 3 = 0, 'Yes', null)"), F.expr("if(p_type = 'SMALL', 'Unpaywall Open Acess', null)"), F.expr("if(p_brand = 'Brand#11', 'DOAJ', 'No')")
    return table(spark, sf_dir, "part").select("p_partkey", flags.open_access(doaj, wos, national).alias("open_access"), flags.present(F.nullif(F.col("p_type"), F.lit("PROMO"))).alias("present"))


@query("SELECT s_suppkey, 1 + s_suppkey % 4 AS quartile, s_suppkey + 0.25 AS decimal, round_even(s_suppkey / 8, 2) AS half_even, round(log10(s_suppkey + 1), 6) AS log FROM supplier")
def number_functions(spark, sf_dir):
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.quartile_number(F.concat(F.lit("Q"), key % 4 + 1)).cast("long").alias("quartile"), text.decimal_comma(F.concat(key, F.lit(",25"))).alias("decimal"), flags.half_even(key / 8, 2).alias("half_even"), F.round(flags.log10(key + 1), 6).alias("log"))


# Rules


@query(
    f"""+ {_GAPS_SQL}
        SELECT 'kind_known' AS rule, count(*) AS items, count(*) FILTER (WHERE kind IS NOT NULL) AS passes, count(*) FILTER (WHERE kind IS NULL) AS fails, 0::BIGINT AS n_null FROM gaps
        UNION ALL SELECT 'kind_known_if_mega', count(*), count(*) FILTER (WHERE kind IS NOT NULL), count(*) FILTER (WHERE kind IS NULL), 0 FROM gaps WHERE is_mega
        UNION ALL SELECT 'delay_range', count(*), count(*) FILTER (WHERE acceptance_delay BETWEEN 1 AND 365), count(*) FILTER (WHERE NOT acceptance_delay BETWEEN 1 AND 365), 0 FROM gaps
        UNION ALL SELECT 'size_range', count(*), count(*) FILTER (WHERE size BETWEEN 11 AND 40), count(*) FILTER (WHERE NOT size BETWEEN 11 AND 40), count(*) FILTER (WHERE size IS NULL) FROM gaps
        UNION ALL SELECT 'kind_set', count(*), count(*) FILTER (WHERE coalesce(kind IN ('SMALL', 'LARGE'), FALSE)), count(*) FILTER (WHERE NOT coalesce(kind IN ('SMALL', 'LARGE'), FALSE)), 0 FROM gaps
        UNION ALL SELECT 'kind_pattern', count(*), count(*) FILTER (WHERE coalesce(kind LIKE '%M%', FALSE)), count(*) FILTER (WHERE NOT coalesce(kind LIKE '%M%', FALSE)), 0 FROM gaps""",
    views=True,
)
def rule_summary(spark, sf_dir):
    wanted = [
        rules.not_missing("kind_known", "kind"),
        rules.not_missing("kind_known_if_mega", "kind", F.col("is_mega")),
        rules.in_range("delay_range", "acceptance_delay", 1, 365),
        rules.in_range("size_range", "size", 11, 40),
        rules.in_members("kind_set", "kind", ["SMALL", "LARGE"]),
        rules.matches("kind_pattern", "kind", "M"),
    ]
    return rules.check(_with_gaps(spark, sf_dir), wanted)


_KINDS = {"l_orderkey": {"integer", "long"}, "l_shipdate": {"date", "timestamp", "timestamp_ntz"}, "l_returnflag": {"string"}, "l_quantity": {"double", "float"}, "l_suppkey": {"string"}}


@query(
    """SELECT rule, 1::BIGINT AS items, CASE WHEN fits THEN 1 ELSE 0 END::BIGINT AS passes, CASE WHEN fits THEN 0 ELSE 1 END::BIGINT AS fails, 0::BIGINT AS n_null FROM (
           SELECT 'l_orderkey' AS rule, bool_and(typeof(l_orderkey) IN ('INTEGER', 'BIGINT')) AS fits FROM lineitem
           UNION ALL SELECT 'l_shipdate', bool_and(typeof(l_shipdate) LIKE 'TIMESTAMP%' OR typeof(l_shipdate) = 'DATE') FROM lineitem
           UNION ALL SELECT 'l_returnflag', bool_and(typeof(l_returnflag) = 'VARCHAR') FROM lineitem
           UNION ALL SELECT 'l_quantity', bool_and(typeof(l_quantity) IN ('DOUBLE', 'FLOAT')) FROM lineitem
           UNION ALL SELECT 'l_suppkey', bool_and(typeof(l_suppkey) = 'VARCHAR') FROM lineitem)
       UNION ALL SELECT 'l_comment', 1, 0, 1, 0
       UNION ALL SELECT 'l_tax_known', count(*), count(l_tax), count(*) - count(l_tax), 0 FROM lineitem"""
)
def rule_types(spark, sf_dir):
    """Type rules, one of which a column breaks and one of which names a column that isn't there, and a rule over the rows."""
    df = table(spark, sf_dir, "lineitem")
    return rules.check_types(df, _KINDS | {"l_comment": {"string"}}).union(rules.check(df, [rules.not_missing("l_tax_known", "l_tax")]))


@query("+ s AS (SELECT title, count(*) AS m FROM facts GROUP BY 1) SELECT 'title_unique' AS rule, CAST(sum(m) AS BIGINT) AS items, count(*) FILTER (WHERE m = 1) AS passes, CAST(sum(m) FILTER (WHERE m > 1) AS BIGINT) AS fails, 0::BIGINT AS n_null FROM s", views=True)
def rule_unique(spark, sf_dir):
    return rules.check_unique(facts(spark, sf_dir), ["title"], "title_unique")


# Distributions


@query(
    """+ d AS (SELECT date_diff('day', DATE '1970-01-01', article_date) AS d FROM windowed), e AS (SELECT min(d) AS lo, max(d) AS hi FROM d)
       SELECT CAST(least(30, floor((d - lo) * 30 / greatest(hi - lo, 1)) + 1) AS INTEGER) AS bin, count(*) AS n FROM d, e GROUP BY 1""",
    views=True,
)
def histogram(spark, sf_dir):
    return distribution.date_histogram(windowed(spark, sf_dir), "article_date")


def _density_sql(grid: str) -> str:
    return f"""s AS (SELECT grp, count(*) AS n, stddev_samp(v) AS sd, (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34 AS iqr FROM v GROUP BY 1),
        h AS (SELECT grp, n, 0.9 * CASE WHEN iqr > 0 THEN least(sd, iqr) ELSE sd END * pow(n, -0.2) AS h FROM s),
        c AS (SELECT grp, v, count(*) AS w FROM v GROUP BY 1, 2), g AS ({grid})
        SELECT c.grp, round(x, 6) AS x, round(sum(w * exp(-((x - v) / h) * ((x - v) / h) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 9) AS density
        FROM c JOIN h ON c.grp = h.grp AND h > 0, g GROUP BY c.grp, x"""


@query("+ v AS (SELECT year(article_date) AS grp, CAST(acceptance_delay AS DOUBLE) AS v FROM windowed WHERE acceptance_delay BETWEEN 0 AND 730), " + _density_sql("SELECT 0.0 + i * (730.0 - 0.0) / 63 AS x FROM range(64) t(i)"), views=True)
def density(spark, sf_dir):
    out = distribution.density(windowed(spark, sf_dir), F.col("acceptance_delay"), F.year("article_date"), points=64, low=0, high=730)
    return out.select("grp", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


@query("WITH v AS (SELECT 1 AS grp, log10(count(*)) AS v FROM orders GROUP BY o_custkey), " + _density_sql("SELECT lo + i * (hi - lo) / 63 AS x FROM (SELECT min(v) AS lo, max(v) AS hi FROM v), range(64) t(i)"))
def log_density(spark, sf_dir):
    sizes = summary.group_sizes(table(spark, sf_dir, "orders"), "o_custkey")
    out = distribution.density(sizes, flags.log10(F.col("n")), F.lit(1), points=64)
    return out.select("grp", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


@query("+ c AS (SELECT journal, count(*) AS n FROM windowed GROUP BY 1) SELECT journal, n, CAST(rank() OVER (ORDER BY n DESC) AS INTEGER) AS rank FROM c", views=True)
def freq_ranked(spark, sf_dir):
    return distribution.ranked_counts(windowed(spark, sf_dir), "journal")


@query("+ q AS (SELECT quantile_cont(acceptance_delay, 0.25) AS q1, quantile_cont(acceptance_delay, 0.75) AS q3 FROM windowed), c AS (SELECT journal, avg(acceptance_delay) AS m, median(acceptance_delay) AS d FROM windowed GROUP BY 1) SELECT journal, 'mean' AS statistic, m AS value, q1, q3 FROM c, q UNION ALL SELECT journal, 'median', d, q1, q3 FROM c, q", views=True)
def group_centres(spark, sf_dir):
    return distribution.group_centres(windowed(spark, sf_dir), "journal", "acceptance_delay")


@query(f"WITH {_LEVELS_SQL}, b AS (SELECT l_suppkey FROM levels WHERE year = 2000) SELECT year, quartile AS level, count(*) AS n FROM levels WHERE l_suppkey IN (SELECT l_suppkey FROM b) AND year BETWEEN 1995 AND 2001 GROUP BY 1, 2")
def quartile_by_year_long(spark, sf_dir):
    wide = reshape.long_to_wide(_levels(spark, sf_dir), "l_suppkey", "year", YEARS, ["quartile"], base_year=2000)
    return distribution.level_counts_by_year(wide, ["l_suppkey"], "quartile_")


# No SQL twin: an iterative fit


@query()
def seasonal_regression(spark, sf_dir):
    return model.seasonal_coefficients(windowed(spark, sf_dir), "acceptance_delay", "article_date", [1996.0, 1998.0, 2000.0])


@query()
def seasonal_splines(spark, sf_dir):
    """The smooth terms' summary: cyclic month and weekday, year."""
    return splines.seasonal_summary(windowed(spark, sf_dir), "acceptance_delay", "article_date")


@query()
def seasonal_effects(spark, sf_dir):
    return splines.seasonal_effects(windowed(spark, sf_dir), "acceptance_delay", "article_date")
