"""Named queries of the file scans: tables are written in a format to the shared folder and read with its reader."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagframe.functions.dates import parse_partial_date
from lagframe.sources import landed, readers
from lagframe.sources.shared import delete_at_end, shared_dir
from lagframe.streaming.ingest import ingest_new, set_aside

from .facts import table
from .queries import query


#: Rows that come together in one written file at most, whatever their keys.
ROWS_A_FILE = 50_000


def _part() -> Column:
    """A number that at most ``ROWS_A_FILE`` rows of a table share."""
    return F.floor(F.monotonically_increasing_id() / ROWS_A_FILE)


def _folder(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/scan-{uuid.uuid4().hex}"
    delete_at_end(spark, path)
    return path


@query(
    """SELECT o_orderkey || '' AS doi, 'Order ' || o_orderkey AS title, o_orderpriority AS journal, CAST(o_orderdate AS DATE) AS received,
       CAST(o_orderdate AS DATE) + 30 AS accepted, 'T1:Journal Article; T2:' || o_orderstatus AS publication_types FROM orders""",
    days=("received", "accepted"),
)
def xml_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda d, **more: F.struct(*[v.alias(k) for k, v in more.items()], F.year(d).cast("string").alias("Year"), F.month(d).cast("string").alias("Month"), F.dayofmonth(d).cast("string").alias("Day"))
    o = table(spark, sf_dir, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    article = F.struct(
        F.struct(F.col("o_orderpriority").alias("Title")).alias("Journal"),
        F.concat(F.lit("Order "), "o_orderkey").alias("ArticleTitle"),
        F.struct(F.array(F.struct(F.lit("T1").alias("_UI"), F.lit("Journal Article").alias("_VALUE")), F.struct(F.lit("T2").alias("_UI"), F.col("o_orderstatus").alias("_VALUE"))).alias("PublicationType")).alias("PublicationTypeList"),
    )
    cite = F.struct(F.col("o_orderkey").cast("string").alias("PMID"), article.alias("Article"))
    history = F.struct(F.array(day(F.col("d"), _PubStatus=F.lit("received")), day(F.date_add("d", 30), _PubStatus=F.lit("accepted"))).alias("PubMedPubDate"))
    ids = F.struct(F.array(F.struct(F.lit("doi").alias("_IdType"), F.col("o_orderkey").cast("string").alias("_VALUE"))).alias("ArticleId"))
    path = _folder(spark)
    o.select(cite.alias("MedlineCitation"), F.struct(history.alias("History"), ids.alias("ArticleIdList")).alias("PubmedData")).write.format("xml").option("rootTag", "PubmedArticleSet").option("rowTag", "PubmedArticle").save(path)
    df = readers.read_articles_xml(spark, path)
    return df.select("doi", "title", "journal", parse_partial_date(F.col("history.received")).alias("received"), parse_partial_date(F.col("history.accepted")).alias("accepted"), "publication_types")


def _mesh_articles(spark: SparkSession, sf_dir: str) -> str:
    """Parts as articles whose subject headings have no, one or two qualifiers (and every seventh article none at all); the folder."""
    term = lambda code, name, major=None: F.struct(code.alias("_UI"), (F.lit("N") if major is None else major).alias("_MajorTopicYN"), name.alias("_VALUE"))
    key = F.col("p_partkey")
    brand = F.struct(term(F.lit("D1"), F.col("p_brand"), F.when(key % 2 == 0, "Y").otherwise("N")).alias("DescriptorName"), F.array().cast("array<struct<_UI: string, _MajorTopicYN: string, _VALUE: string>>").alias("QualifierName"))
    kind = term(F.concat(F.lit("D"), key % 50 + 2), F.col("p_type"))
    marks = F.when(key % 3 == 0, F.array(term(F.lit("Q1"), F.lit("size")), term(F.lit("Q2"), F.lit("price"), F.lit("Y")))).when(key % 3 == 1, F.array(term(F.lit("Q1"), F.lit("size")))).otherwise(F.array().cast("array<struct<_UI: string, _MajorTopicYN: string, _VALUE: string>>"))
    headings = F.when(key % 7 != 0, F.struct(F.array(brand, F.struct(kind.alias("DescriptorName"), marks.alias("QualifierName"))).alias("MeshHeading")))
    cite = F.struct(key.cast("string").alias("PMID"), F.struct(F.col("p_name").alias("ArticleTitle")).alias("Article"), headings.alias("MeshHeadingList"))
    path = _folder(spark)
    table(spark, sf_dir, "part").select(cite.alias("MedlineCitation")).write.format("xml").option("rootTag", "PubmedArticleSet").option("rowTag", "PubmedArticle").save(path)
    return path


@query(
    """SELECT p_name AS title, CASE WHEN p_partkey % 7 <> 0 THEN 'D1:' || p_brand || '; D' || (p_partkey % 50 + 2) || ':' || p_type
           || CASE p_partkey % 3 WHEN 0 THEN ' / Q1:size / Q2:price' WHEN 1 THEN ' / Q1:size' ELSE '' END END AS mesh_terms, count(*) AS n FROM part GROUP BY 1, 2"""
)
def xml_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_articles_xml(spark, _mesh_articles(spark, sf_dir)).groupBy("title", "mesh_terms").agg(F.count("*").alias("n"))


@query(
    """WITH p AS (SELECT * FROM part WHERE p_partkey % 7 <> 0), h AS (
           SELECT 0 AS heading, 'D1' AS descriptor_code, p_brand AS descriptor, NULL AS qualifier_code, NULL AS qualifier, p_partkey % 2 = 0 AS is_major FROM p
           UNION ALL SELECT 1, 'D' || (p_partkey % 50 + 2), p_type, CASE WHEN p_partkey % 3 < 2 THEN 'Q1' END, CASE WHEN p_partkey % 3 < 2 THEN 'size' END, FALSE FROM p
           UNION ALL SELECT 1, 'D' || (p_partkey % 50 + 2), p_type, 'Q2', 'price', TRUE FROM p WHERE p_partkey % 3 = 0)
       SELECT *, count(*) AS n FROM h GROUP BY ALL"""
)
def mesh_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject headings in row form, counted by heading and qualifier."""
    rows = readers.read_mesh_xml(spark, _mesh_articles(spark, sf_dir))
    return rows.groupBy("heading", "descriptor_code", "descriptor", "qualifier_code", "qualifier", "is_major").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey || '' AS doi, 'Order ' || o_orderkey AS title, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS received FROM orders")
def json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("doi"), F.concat(F.lit("Order "), "o_orderkey").alias("title"), F.struct(F.col("o_orderdate").cast("date").cast("string").alias("received")).alias("history"), F.pmod("o_custkey", F.lit(50)).alias("file"), _part().alias("part"))
    path = _folder(spark)
    o.groupBy("file", "part").agg(F.to_json(F.collect_list(F.struct("doi", "title", "history"))).alias("value")).drop("part").write.partitionBy("file").option("maxRecordsPerFile", 1).text(path)
    return readers.read_articles_json(spark, f"{path}/file=*").select("doi", "title", "history.received")


@query("SELECT p_partkey || '' AS JrId, p_name || ': ' || p_type AS JournalTitle, CASE WHEN p_size > 25 THEN p_brand END AS NlmId FROM part")
def keyvalue_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    dashes = F.concat(F.repeat(F.lit("-"), (F.col("p_partkey") % 9 + 1).cast("int")), F.expr("if(p_partkey % 4 = 0, ' end: of record', '')"))
    parts = [F.concat(F.lit("JrId: "), "p_partkey"), F.concat(F.lit("JournalTitle:  "), "p_name", F.lit(": "), "p_type"), F.when(F.col("p_size") > 25, F.concat(F.lit("NlmId: "), "p_brand")), dashes]
    line = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws("\r\n", *parts)).otherwise(F.concat_ws("\n", *parts))
    path = _folder(spark)
    table(spark, sf_dir, "part").select(line.alias("value")).write.text(path)
    return readers.read_keyvalue_records(spark, path, ["JrId", "JournalTitle", "NlmId"])


@query("SELECT event_type, event_type <> 'error' AS valid FROM events GROUP BY 1")
def json_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "events").select("event_type", "event_id", "value", _part().alias("part")).groupBy("event_type", "part").agg(F.to_json(F.collect_list(F.struct("event_id", "value"))).alias("value")).drop("part")
    path = _folder(spark)
    parts.withColumn("value", F.when(F.col("event_type") == "error", F.concat("value", F.lit("]"))).otherwise(F.col("value"))).write.partitionBy("event_type").option("maxRecordsPerFile", 1).text(path)
    files = landed.validate_json_files(spark, f"{path}/event_type=*").select(F.regexp_extract("file", "event_type=([^/]+)", 1).alias("event_type"), "valid")
    return files.groupBy("event_type").agg(F.bool_and("valid").alias("valid"))


@query(
    """SELECT file_no, n, coalesce(line, 0) AS line, coalesce("column", 0) AS "column", line IS NULL AS valid FROM (
           SELECT p_partkey // 1000 AS file_no, count(*) AS n, CAST(min(place) FILTER (WHERE p_size = 7) AS BIGINT) AS line,
                  CAST(19 + length(arg_min(p_partkey, p_partkey) FILTER (WHERE p_size = 7) || '') AS BIGINT) AS "column" FROM (
               SELECT p_partkey, p_size, row_number() OVER (PARTITION BY p_partkey // 1000 ORDER BY p_partkey) + 1 AS place FROM part)
           GROUP BY 1)"""
)
def json_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of the first error in files of a thousand keys, one record a line: sizes of 7 are written as ``07``."""
    key, path = F.col("p_partkey"), _folder(spark)
    line = F.concat(F.lit('{"key": '), key, F.lit(', "size": '), F.when(F.col("p_size") == 7, "07").otherwise(F.col("p_size").cast("string")), F.lit("}"))
    p = table(spark, sf_dir, "part").groupBy(F.expr("p_partkey div 1000").alias("file_no")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("l"))))["l"].alias("lines"))  # a thousand keys
    text = F.concat(F.lit("[\n"), F.array_join("lines", ",\n"), F.lit("\n]"))
    p.select("file_no", text.alias("value")).write.partitionBy("file_no").option("maxRecordsPerFile", 1).text(path)
    found = landed.validate_json_files(spark, f"{path}/file_no=*").withColumn("file_no", F.regexp_extract("file", "file_no=([0-9]+)", 1).cast("long"))
    sizes = table(spark, sf_dir, "part").groupBy(F.expr("p_partkey div 1000").alias("file_no")).agg(F.count("*").alias("n"))
    return found.join(sizes, "file_no").select("file_no", "n", F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("column", F.lit(0)).alias("column"), "valid")


@query("SELECT count(*) AS files, count(*) FILTER (WHERE o_orderpriority NOT LIKE '1%') AS ok FROM (SELECT DISTINCT o_orderpriority FROM orders)")
def checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", _part().alias("part")).groupBy("o_orderpriority", "part").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")), "\n").alias("keys"))
    o.select(F.concat("o_orderpriority", F.lit("\n"), "keys")).write.option("maxRecordsPerFile", 1).text(f"{path}/files")
    files = spark.read.format("binaryFile").load(f"{path}/files")
    name = F.regexp_extract("path", "([^/]+)$", 1)
    digest = F.when(F.decode("content", "UTF-8").startswith("1"), F.md5(F.lit("other"))).otherwise(F.md5("content"))
    files.select(F.concat(F.lit("MD5("), name, F.lit(")= "), digest).alias("value")).write.text(f"{path}/sums")
    of = files.select(name.alias("name"), F.substring_index(F.decode("content", "UTF-8"), "\n", 1).alias("o_orderpriority"))
    checked = readers.verify_checksums(spark, f"{path}/files", f"{path}/sums").join(of, "name").groupBy("o_orderpriority").agg(F.bool_and("ok").alias("ok"))
    return checked.agg(F.count("*").alias("files"), F.count_if("ok").alias("ok"))


@query("SELECT year(o_orderdate) AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total, count(*) FILTER (WHERE o_orderstatus <> 'O') AS known FROM orders GROUP BY 1")
def csv2_year_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), "o_orderkey", F.replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")).alias("price"), F.expr("if(o_orderstatus = 'O', 'NA', o_orderstatus)").alias("status"))
    path = _folder(spark)
    o.write.partitionBy("y").option("header", True).option("sep", ";").csv(path)
    df = readers.read_year_shards(spark, f"{path}/y={{year}}", None, ("price",), "o_orderkey long, price string, status string")
    return df.groupBy("year").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"), F.count("status").alias("known"))


@query("SELECT c_mktsegment, count(*) AS n, count(*) FILTER (WHERE c_custkey % 10 <> 0) AS named FROM customer GROUP BY 1")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.expr("if(c_custkey % 10 = 0, 'NA', c_name)").alias("c_name")).write.option("header", True).csv(path)
    return readers.read_csv_na(spark, path).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count("c_name").alias("named"))


@query("SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def ingest_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that land in two lots, each taken in once by the incremental ingest, which runs three times."""
    path = _folder(spark)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    for lot in ("o_orderkey % 3 = 0", "o_orderkey % 3 <> 0", "false"):
        o.where(lot).write.mode("append").parquet(f"{path}/in")
        ingest_new(spark, f"{path}/in", f"{path}/out", f"{path}/ledger", "o_orderkey long, o_orderstatus string")
    return spark.read.parquet(f"{path}/out").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query(
    """SELECT kind, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS keys, min(day) AS first_day FROM (
           SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 OR p_partkey % 13 = 0 OR p_partkey % 17 = 0 THEN 'set apart' ELSE 'read' END AS kind,
                  CASE WHEN kind = 'read' AND p_size <> 7 THEN DATE '2020-01-01' + CAST(p_size AS INTEGER) END AS day FROM part) GROUP BY 1""",
    days=("first_day",),
)
def malformed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a bad date, a bad number or a field too many are set apart with their text, and the others are read by the schema."""
    path = _folder(spark)
    key = F.col("p_partkey")
    day = F.when(key % 11 == 0, "2020-13-45").when(F.col("p_size") == 7, "NA").otherwise(F.date_add(F.lit("2020-01-01").cast("date"), F.col("p_size").cast("int")).cast("string"))
    line = F.concat_ws("\t", key.cast("string"), day, F.when(key % 13 == 0, "many").otherwise(F.col("p_size").cast("string")), F.when(key % 17 == 0, "more"))
    table(spark, sf_dir, "part").select(line.alias("value")).write.text(f"{path}/in")
    checked = readers.read_checked(spark, f"{path}/in", "p_partkey long, day date, size int", header=False)
    good = readers.set_malformed_apart(checked, f"{path}/bad").select(F.lit("read").alias("kind"), "p_partkey", "day")
    apart = spark.read.parquet(f"{path}/bad").select(F.lit("set apart").alias("kind"), F.regexp_extract("malformed", "^([0-9]+)", 1).cast("long").alias("p_partkey"), F.lit(None).cast("date").alias("day"))
    return good.union(apart).groupBy("kind").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"), F.min("day").alias("first_day"))


def _copy(spark: SparkSession, source: str, target: str) -> None:
    """A folder copied with its files' names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = (jvm.org.apache.hadoop.fs.Path(x) for x in (source, target))
    jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)


@query("SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, 1::BIGINT AS broken FROM orders GROUP BY 1")
def ingest_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in small lots, some of them landing under the same names in a second folder before and after they are taken in,
    and one that is broken: each name counts once, and the broken file is reported, but no file that is whole and has no rows
    (as a task of a table's writer leaves where it has none)."""
    path = _folder(spark)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    take = lambda: ingest_new(spark, f"{path}/in/*", f"{path}/out", f"{path}/ledger", "o_orderkey long, o_orderstatus string", lot=1 << 16)
    o.where("o_orderkey % 3 = 0").write.parquet(f"{path}/in/a")
    _copy(spark, f"{path}/in/a", f"{path}/in/b")
    take()
    o.where("o_orderkey % 3 <> 0").write.parquet(f"{path}/in/c")
    spark.range(1).selectExpr("'no table' as value").coalesce(1).write.text(f"{path}/in/d")
    take()
    _copy(spark, f"{path}/in/c", f"{path}/in/e")
    take()
    bad = set_aside(spark, f"{path}/in/*", f"{path}/ledger", pathGlobFilter="part-*").agg(F.count_if(~F.col("empty")).alias("broken"))
    out = spark.read.parquet(f"{path}/out").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))
    return out.crossJoin(F.broadcast(bad))  # one row


@query("SELECT o_orderkey % 13 || '.xml.gz' AS name, count(*) AS n FROM orders WHERE o_orderkey % 13 NOT IN (2, 5) GROUP BY 1")
def ledger_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders").select(F.concat(F.lit("/in/"), F.expr("o_orderkey % 13"), F.lit(".xml.gz")).alias("path"))
    ledger = table(spark, sf_dir, "region").where("r_regionkey in (2, 5) or r_regionkey = 0").select(F.concat(F.when(F.col("r_regionkey") == 0, 5).otherwise(F.col("r_regionkey")), F.lit(".xml.gz")).alias("name"))
    return readers.pending_files(files, ledger).groupBy("name").agg(F.count("*").alias("n"))
