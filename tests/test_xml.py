"""Long files of articles, which are split over tasks."""

import gzip

import pytest
from pyspark.sql import functions as F

from lagframe.sources import readers

HEAD = '<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE PubmedArticleSet PUBLIC "-//NLM" "http://localhost/x.dtd">\n<PubmedArticleSet>\n'
TAIL = "</PubmedArticleSet>\n"
N = 400


def article(i: int) -> str:
    heading = f'<MeshHeading><DescriptorName UI="D{i % 5}" MajorTopicYN="Y">é &amp; {i % 5}</DescriptorName><QualifierName UI="Q1">q</QualifierName></MeshHeading>'
    cite = f'<MedlineCitation><PMID Version="1">{i}</PMID><Article><ArticleTitle>T <i>{i}</i> &lt;x&gt; &#233;</ArticleTitle></Article><MeshHeadingList>{heading * (i % 3)}</MeshHeadingList></MedlineCitation>'
    return f'<PubmedArticle>\n  {cite}\n  <PubmedData><ArticleIdList><ArticleId IdType="doi">10/{i}</ArticleId></ArticleIdList></PubmedData>\n</PubmedArticle>\n'


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def largest_task(df) -> int:
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_subject_headings_of_a_long_file(spark, tmp_path, small_splits):
    (tmp_path / "a.xml").write_text(HEAD + "".join(map(article, range(N))) + TAIL)
    long = readers.read_mesh_xml(spark, f"file://{tmp_path}", whole=1 << 10)
    assert sorted(map(repr, long.collect())) == sorted(map(repr, readers.read_mesh_xml(spark, f"file://{tmp_path}").collect()))
    assert long.count() == sum(i % 3 for i in range(N)) and largest_task(long) < N // 4


def test_long_and_short_files_of_articles(spark, tmp_path, small_splits):
    every = "".join(map(article, range(N)))
    (tmp_path / "a.xml").write_text(HEAD + every + TAIL)
    (tmp_path / "b.xml").write_text(HEAD + article(N) + TAIL)
    (tmp_path / "c.xml").write_text((HEAD + every + TAIL).replace("\n", "\r\n").replace("</PubmedArticle>", "</PubmedArticle >"))
    (tmp_path / "d.nxml").write_text("<a>" + "<b/>" * 5000 + "</a>")
    with gzip.open(tmp_path / "e.xml.gz", "wt") as f:
        f.write(HEAD + every + TAIL)
    long = readers.read_articles_xml(spark, f"file://{tmp_path}", whole=1 << 13)
    want = readers.read_articles_xml(spark, f"file://{tmp_path}")
    assert long.schema == want.schema and long.count() == 3 * N + 1
    assert sorted(map(repr, long.collect())) == sorted(map(repr, want.collect()))
    assert largest_task(long.where(~F.col("file").endswith(".gz"))) < N // 4


def test_articles_between_other_elements_of_a_long_file(spark, tmp_path, small_splits):
    other = '<PubmedBookArticle><x/></PubmedBookArticle><PubmedArticle /><PubmedArticle/>'
    (tmp_path / "a.xml").write_text(HEAD + "".join(article(i) + other for i in range(N)) + "<DeleteCitation><PMID>1</PMID></DeleteCitation>" + TAIL)
    got = readers.read_articles_xml(spark, f"file://{tmp_path}", whole=1 << 10).select("doi", "title").collect()
    assert sorted(map(tuple, got)) == sorted((f"10/{i}", f"T <i>{i}</i> <x> é") for i in range(N))


@pytest.mark.parametrize("code", ["utf-16", "iso-8859-1"])
def test_a_long_file_of_another_encoding_is_an_error(spark, tmp_path, code):
    (tmp_path / "a.xml").write_bytes((HEAD.replace("utf-8", code) + "".join(map(article, range(N))) + TAIL).encode(code))
    assert readers.read_articles_xml(spark, f"file://{tmp_path}").count() == N
    with pytest.raises(Exception, match="not UTF-8"):
        readers.read_articles_xml(spark, f"file://{tmp_path}", whole=1 << 10).collect()


def test_a_long_file_as_spark_writes_it(spark, tmp_path, small_splits):
    day = lambda status, d: F.struct(F.lit(status).alias("_PubStatus"), F.year(d).alias("Year"), F.month(d).alias("Month"), F.dayofmonth(d).alias("Day"))
    d = F.date_add(F.lit("2019-01-01").cast("date"), F.col("id").cast("int"))
    history = F.struct(F.array(day("received", d), day("accepted", F.date_add(d, 30))).alias("PubMedPubDate"))
    ids = F.struct(F.array(F.struct(F.lit("doi").alias("_IdType"), F.concat(F.lit("10/<&>"), "id").alias("_VALUE"))).alias("ArticleId"))
    articles = spark.range(N).coalesce(1).select(F.struct(F.col("id").alias("PMID")).alias("MedlineCitation"), F.struct(history.alias("History"), ids.alias("ArticleIdList")).alias("PubmedData"))
    articles.write.format("xml").option("rootTag", "PubmedArticleSet").option("rowTag", "PubmedArticle").save(f"file://{tmp_path}/x")
    long = readers.read_articles_xml(spark, f"file://{tmp_path}/x", whole=1 << 10)
    assert sorted(map(repr, long.collect())) == sorted(map(repr, readers.read_articles_xml(spark, f"file://{tmp_path}/x").collect()))
    want = spark.range(N).select(F.concat(F.lit("10/<&>"), "id"), d.cast("string"), F.date_add(d, 30).cast("string"))
    assert sorted(long.select("doi", "history.received", "history.accepted").collect()) == sorted(want.collect())
    assert largest_task(long) < N // 4


def test_split_borders_at_every_byte_of_a_closing_tag(spark, tmp_path, small_splits):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    text = HEAD + "".join(map(article, range(4))) + TAIL
    at, tag = len(text[: text.index("</PubmedArticle>")].encode()), len("</PubmedArticle>")
    for k in range(-1, tag + 2):  # the first border is k bytes behind the tag's start
        name = f"{k + 1}.xml"
        (tmp_path / name).write_text(text.replace("<PubmedArticleSet>", f"<PubmedArticleSet><!--{'x' * (1024 - at - k - 7)}-->", 1))
        assert (tmp_path / name).read_bytes()[1024 - k :].startswith(b"</PubmedArticle>")
    got = readers.read_articles_xml(spark, f"file://{tmp_path}", whole=1 << 10).select(F.regexp_extract("file", r"(\d+)\.xml$", 1).cast("int"), "doi")
    assert sorted(map(tuple, got.collect())) == sorted((f, f"10/{i}") for f in range(tag + 3) for i in range(4))
