"""Cross-footing identities, the assembled article pipeline, sinks and the incremental ingest."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lagframe.operators import summary
from lagframe.plans import articles as plan
from lagframe.plans import file_queries
from lagframe.plans.facts import windowed
from lagframe.plans.queries import QUERIES, SQL
from lagframe.schema import ARTICLE_COLUMNS, RAW_ARTICLE_SCHEMA
from lagframe.sources import readers, writers
from lagframe.streaming.ingest import ingest_new

from .compare import DATA, database, rows


def test_totals_agree(spark):
    df = windowed(spark, DATA).cache()
    n = df.count()
    year = F.year("article_date").cast("string")
    total = lambda d, c="n": d.agg(F.sum(c)).first()[0]
    assert total(summary.monthly_delays(df)) == n
    assert total(summary.yearly_share(df, year), "article_number") == n
    assert total(summary.category_share(df, "discipline")) == n
    assert total(summary.level_share(df, year, "discipline")) == n
    flagged = summary.flag_share(df, F.col("is_mega"), year)
    assert total(flagged, "flagged") == flagged.first().all_flagged
    o = summary.outliers(df).first()
    assert o.acceptance_delay_low + o.acceptance_delay_high == o.acceptance_delay_either


def raw(spark):
    h = lambda r, a: {"received": r, "accepted": a, "pubmed": None, "medline": None, "entrez": None}
    types = "D1:Journal Article; D2:Review"
    rows = [
        ("Covid-19 and x", "J", "c", "d1", "1234-5678", "a;b", types, "2020", "2020-06-01", h("2020-01-01", "2020-03-01")),
        ("Covid-19 and x", "J2", "c", "d2", "1234-5678", "a", types, "2020", "2020-07-01", h("2020-01-01", "2020-03-01")),
        ("wrong order", "J", "c", "d3", "1234-5678", "a", types, "2020", "2020-06-01", h("2020-04-01", "2020-03-01")),
        ("conference", "J", "c", "d4", "9999-9999", "a", types, "2020", "2020-06-01", h("2020-01-01", "2020-03-01")),
        ("letter", "J", "c", "d5", "1234-5678", "a", "D3:Letter", "2020", "2020-06-01", h("2020-01-01", "2020-03-01")),
    ]
    return spark.createDataFrame([(*r, None) for r in rows], RAW_ARTICLE_SCHEMA).withColumn("file", F.lit("f")).withColumn("ordinal", F.monotonically_increasing_id())


def test_article_pipeline(spark):
    shards = spark.createDataFrame([(2020, "7", "1234-5678, 2222-2222", "1,5", "Q1", "30")], "year int, rank string, issn string, sjr string, sjr_best_quartile string, h_index string")
    classes = spark.createDataFrame([("1234-5678", None, "Journal", "3201; 1100", "x"), ("1234-5678", None, "Book", "1000", "x")], "print_issn string, e_issn string, source_type string, asjc string, open_access_status string")
    doaj = spark.createDataFrame([("1234-5678", "", "Yes", "100", "Yes")], "print_issn string, e_issn string, apc string, apc_amount string, doaj_compliant string")
    national = spark.createDataFrame([("1234-5678", None, "No", "Health Sciences", "F", "0", False, 1990, "1", "2"), ("9999-9999", None, "No", "H", "F", "1", False, 1990, "1", "1")], "print_issn string, e_issn string, npi_open_access string, npi_discipline string, npi_field string, is_conference string, is_series boolean, established int, npi_level_19 string, npi_level_20 string")
    retractions = spark.createDataFrame([("n", "r", "3/1/2021 0:00", "5/1/2020 0:00", None, "d1")], "retraction_nature string, reason string, retraction_date string, original_date string, doi string, retraction_doi string")
    done = plan.enrich_articles(plan.clean_articles(raw(spark)), plan.quartile_list(shards, 2020), plan.classification_list(classes), plan.open_access_list(doaj), plan.national_list(national), plan.retraction_list(retractions))
    out = plan.distinct_articles(done, ["file", "ordinal"]).select(ARTICLE_COLUMNS).collect()
    assert len(out) == 1
    a = out[0]
    assert (a.doi, a.is_covid, a.quartile_year, a.rank_year, a.h_index_year, a.npi_year, a.open_access, a.is_mega) == ("d1", True, "Q1", 7, 30, 2, True, False)
    assert (a.acceptance_delay, a.publication_delay, a.article_date, a.is_retracted) == (60, 92, dt.date(2020, 5, 1), True)
    assert (a.asjc, a.is_psych, a.discipline, a.publication_types, a.keywords) == (3201, True, "social_sciences_and_humanities", "Journal Article, Review", "a,b")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1)], "k string, n int")
    writers.write_table(df, f"file://{tmp_path}/t", ["k"], row_number=True)
    assert [tuple(r) for r in readers.read_csv_na(spark, f"file://{tmp_path}/t").collect()] == [("1", "a", "1"), ("2", "b", "2")]
    writers.write_articles(spark.createDataFrame([(dt.date(2020, 1, 1), 1)], "article_date date, x int"), f"file://{tmp_path}/a")
    assert spark.read.parquet(f"file://{tmp_path}/a").first().article_year == 2020


def test_incomplete_files(spark):
    df = spark.createDataFrame([("f", "x", None), ("f", None, "y"), ("g", "x", None)], "file string, a string, b string")
    assert readers.drop_incomplete_files(df, ["a", "b"]).count() == 2


def test_ingest_takes_each_file_once(spark, tmp_path):
    source, target, ledger = (f"file://{tmp_path}/{x}" for x in ("in", "out", "ledger"))
    spark.range(5).write.parquet(source)
    assert ingest_new(spark, source, target, ledger, "id long") == 5
    assert ingest_new(spark, source, target, ledger, "id long") == 0
    spark.range(5, 8).write.mode("append").parquet(source)
    assert ingest_new(spark, source, target, ledger, "id long", lambda d: d.where("id <> 6")) in (2, 3)  # a pushed filter may drop rows unread
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [0, 1, 2, 3, 4, 5, 7]


@pytest.mark.parametrize("name", ["json_valid", "checksum", "json_scan"])
def test_files_hold_a_bounded_number_of_rows(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(file_queries, "ROWS_A_FILE", 100, raising=False)
    monkeypatch.setattr(file_queries, "_folder", lambda spark: f"{tmp_path}/scan")
    got = QUERIES[name](spark, DATA).toPandas()
    want = database().sql(SQL[name]).df()
    assert rows(got) == rows(want)
    texts = [p.read_text() for p in (tmp_path / "scan").rglob("part-*") if "sums" not in p.parts]
    held = [t.count("\n") - 1 if name == "checksum" else t.count('{"event_id"' if name == "json_valid" else '{"doi"') for t in texts]
    assert max(held) <= 100 and sum(held) == database().sql(f"SELECT count(*) FROM {'events' if name == 'json_valid' else 'orders'}").fetchall()[0][0]
