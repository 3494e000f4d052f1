"""Scans of article corpora, reference lists and side files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagframe.functions.text import decimal_comma
from lagframe.schema import ARTICLE_SCHEMA, MEDLINE_SCHEMA, RAW_ARTICLE_SCHEMA

from .landed import WHOLE, md5_of_files

#: Files of an article corpus.
XML_FILES = "*{.nxml,.xml,.xml.gz}"

#: Bytes of a plain file of articles that one task may read from end to end.
WHOLE_XML = 128 << 20


def _day(d: Column) -> Column:
    """``yyyy-MM-dd`` as far as the parts are there; month names are numbers."""
    name = F.date_format(F.try_to_timestamp(d["Month"], F.lit("MMM")), "MM")
    month = F.when(d["Month"].rlike("^[0-9]+$"), F.lpad(d["Month"], 2, "0")).otherwise(F.coalesce(name, F.lpad(d["Month"], 2, "0")))
    return F.concat_ws("-", d["Year"], month, F.when(month.isNotNull(), F.lpad(d["Day"], 2, "0")))


def _coded(term: Column) -> Column:
    """``code:name`` of a controlled term; a part that is missing is empty."""
    return F.concat_ws(":", F.coalesce(term["_UI"], F.lit("")), F.coalesce(term["_VALUE"], F.lit("")))


def mesh_text(headings: Column) -> Column:
    """Subject headings as ``; ``-separated text: each is its descriptor, then its qualifiers behind `` / ``, all as ``code:name``."""
    one = lambda h: F.concat_ws(" / ", _coded(h["DescriptorName"]), F.transform(h["QualifierName"], _coded))
    return F.nullif(F.array_join(F.transform(headings, one), "; "), F.lit(""))


def _read_medline(spark: SparkSession, path: str | list[str], whole: int) -> DataFrame:
    """A row for each ``PubmedArticle``, in the layout of :data:`~lagframe.schema.MEDLINE_SCHEMA`, with its ``file``.

    Spark's XML source reads a file from end to end in one task. A plain file of more than ``whole`` bytes is therefore read as text that is cut
    at the closing tags, which Spark splits over tasks. Such a file must be UTF-8, as MEDLINE's are (another one is an error), and
    have no ``PubmedArticle`` tags in comments or CDATA; an article closed in its own opening tag gives no row there.
    """
    of = lambda form, **more: spark.read.format(form).options(recursiveFileLookup=True, pathGlobFilter=XML_FILES, **more)
    long = (F.col("_metadata.file_size") > whole) & ~F.col("_metadata.file_name").endswith(".gz")
    short = of("xml", rowTag="PubmedArticle").schema(MEDLINE_SCHEMA).load(path).where(~long).select("*", F.input_file_name().alias("file"))
    text, tag = of("text", lineSep="</PubmedArticle").load(path).where(long), "<PubmedArticle"
    other = F.col("value").contains("\0") | F.col("value").rlike(r"""^\W*<\?xml[^>]*encoding\s*=\s*["'](?!(?i:utf-8|us-ascii)["'])""")
    value = F.when(other, F.raise_error(F.concat(F.lit("not UTF-8: "), F.input_file_name())).cast("string")).otherwise(F.col("value"))
    cut = text.select(value.alias("value"), F.input_file_name().alias("file")).where(F.col("value").contains(tag)).select(F.substring_index("value", tag, -1).alias("rest"), "file")
    xml = F.concat(F.lit(tag), "rest", F.lit("</PubmedArticle>"))
    each = cut.where(F.col("rest").rlike(r"^(?:\s[^>]*)?(?<!/)>")).select(F.from_xml(xml, MEDLINE_SCHEMA).alias("a"), "file")
    return short.unionByName(each.select("a.*", "file"))


def read_mesh_xml(spark: SparkSession, path: str | list[str], whole: int = WHOLE_XML) -> DataFrame:
    """Subject headings of MEDLINE files in row form: ``pmid``, ``heading`` (place in the article, from 0), ``descriptor_code``,
    ``descriptor``, ``qualifier_code``, ``qualifier``, ``is_major``, ``file``; a row for each qualifier, and one with null for a heading without any.

    ``is_major`` is the qualifier's mark, or the descriptor's where there is no qualifier.
    """
    headings = F.posexplode(F.col("MedlineCitation.MeshHeadingList.MeshHeading")).alias("heading", "h")
    one = _read_medline(spark, path, whole).select(F.col("MedlineCitation.PMID").alias("pmid"), headings, "file")
    each = one.select("pmid", "heading", F.col("h.DescriptorName").alias("d"), F.explode_outer("h.QualifierName").alias("q"), "file")
    major = F.coalesce(F.when(F.col("q").isNotNull(), F.col("q._MajorTopicYN")).otherwise(F.col("d._MajorTopicYN")) == "Y", F.lit(False))
    return each.select("pmid", "heading", F.col("d._UI").alias("descriptor_code"), F.col("d._VALUE").alias("descriptor"), F.col("q._UI").alias("qualifier_code"), F.col("q._VALUE").alias("qualifier"), major.alias("is_major"), "file")


def read_articles_xml(spark: SparkSession, path: str | list[str], whole: int = WHOLE_XML) -> DataFrame:
    """MEDLINE files, one row for each article, in the layout of :data:`~lagframe.schema.RAW_ARTICLE_SCHEMA` with its file.

    Folders are read recursively; plain files of more than ``whole`` bytes are split over tasks, gzip is read as it is, one task a file.
    """
    df = _read_medline(spark, path, whole)
    cite, article, more = F.col("MedlineCitation"), F.col("MedlineCitation.Article"), F.col("PubmedData")
    dates = F.map_from_entries(F.filter(F.transform(more["History"]["PubMedPubDate"], lambda d: F.struct(d["_PubStatus"], _day(d))), lambda e: e["_PubStatus"].isin("received", "accepted", "pubmed", "medline", "entrez")))
    ids = F.filter(more["ArticleIdList"]["ArticleId"], lambda i: i["_IdType"] == "doi")
    types = F.transform(article["PublicationTypeList"]["PublicationType"], lambda t: F.concat(t["_UI"], F.lit(":"), t["_VALUE"]))
    history = F.struct(*[F.try_element_at(dates, F.lit(s)).alias(s) for s in ("received", "accepted", "pubmed", "medline", "entrez")])
    return df.select(
        article["ArticleTitle"].alias("title"),
        article["Journal"]["Title"].alias("journal"),
        cite["MedlineJournalInfo"]["Country"].alias("country"),
        F.try_element_at(ids, F.lit(1))["_VALUE"].alias("doi"),
        cite["MedlineJournalInfo"]["ISSNLinking"].alias("issn_linking"),
        F.array_join(F.flatten(F.transform(cite["KeywordList"], lambda k: k["Keyword"])), "; ").alias("keywords"),
        F.array_join(types, "; ").alias("publication_types"),
        F.nullif(_day(article["Journal"]["JournalIssue"]["PubDate"]), F.lit("")).alias("pubdate"),
        F.nullif(_day(F.try_element_at(article["ArticleDate"], F.lit(1))), F.lit("")).alias("article_date"),
        history.alias("history"),
        mesh_text(cite["MeshHeadingList"]["MeshHeading"]).alias("mesh_terms"),
        "file",
    )


def read_articles_json(spark: SparkSession, path: str | list[str], schema: str = RAW_ARTICLE_SCHEMA) -> DataFrame:
    """Files that each hold an array of records, with the file of each record."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))


def drop_incomplete_files(df: DataFrame, required: list[str], file: str = "file") -> DataFrame:
    """Rows of files in which every required column (dotted names for fields) has a value somewhere."""
    seen = df.groupBy(file).agg(*[F.bool_or(F.col(c).isNotNull()).alias(f"_{i}") for i, c in enumerate(required)])
    for i in range(len(required)):
        seen = seen.where(f"_{i}")
    return df.join(seen.select(file), file, "left_semi")


def read_csv_na(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    """CSV with a header; empty fields and ``NA`` are null. Without a schema all columns are text."""
    reader = spark.read.option("header", True).option("nullValue", "NA").option("multiLine", True).option("escape", '"')
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.select(*[F.nullif(F.col(f"`{f.name}`"), F.lit("")).alias(f.name) if f.dataType.typeName() == "string" else F.col(f"`{f.name}`") for f in df.schema])


def read_csv2(spark: SparkSession, path: str | list[str], decimals: tuple[str, ...] = (), schema: str | None = None) -> DataFrame:
    """Semicolon-separated CSV with decimal commas in the named columns, which become doubles."""
    reader = spark.read.option("header", True).option("sep", ";").option("nullValue", "NA").option("escape", '"')
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.withColumns({c: decimal_comma(F.col(c)) for c in decimals}) if decimals else df


def read_year_shards(spark: SparkSession, pattern: str, years: range | list[int] | None, decimals: tuple[str, ...] = (), schema: str | None = None) -> DataFrame:
    """One file a year, named by ``pattern`` with ``{year}``, read as one scan with the year of each row from its file's name;
    without ``years`` all files that there are."""
    df = read_csv2(spark, [pattern.format(year=y) for y in (years or ["*"])], (), schema)
    path = F.url_decode(F.input_file_name())
    name = F.regexp_extract(path, r"([^/]+?)(?:/part-[^/]*)?$", 1)  # a shard may be a folder of parts
    df = df.withColumn("year", F.regexp_extract(name, r"(\d{4})\D*$", 1).try_cast("int"))
    return df.withColumns({c: decimal_comma(F.col(c)) for c in decimals}) if decimals else df


def read_processed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Processed articles as tab-separated text with a header, by the fixed schema."""
    return spark.read.option("header", True).option("sep", "\t").option("nullValue", "NA").schema(ARTICLE_SCHEMA).csv(path)


#: Name of the column that has a line's text where the line doesn't fit the schema.
MALFORMED = "malformed"


def read_checked(spark: SparkSession, path: str | list[str], schema: str = ARTICLE_SCHEMA, sep: str = "\t", **options) -> DataFrame:
    """Delimited text with a header by a schema, with ``malformed`` and ``file``: a line with too few or too many fields, or a
    field that isn't of its type, has its whole text in ``malformed`` (and nulls where a field can't be read); of others it is null."""
    reader = spark.read.options(**{"header": True, "sep": sep, "nullValue": "NA", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED, "columnPruning": False, **options})
    df = reader.schema(f"{schema}, {MALFORMED} string").csv(path)
    every = F.concat_ws("", *[F.col(f"`{c}`").cast("string") for c in df.columns if c != MALFORMED])
    text = F.concat(MALFORMED, F.left(every, F.lit(0)))  # Spark checks only the columns that are asked for
    return df.withColumns({MALFORMED: text, "file": F.col("_metadata.file_path")})


def well_formed(checked: DataFrame) -> DataFrame:
    """The lines that fit the schema, with its columns only."""
    return checked.where(F.col(MALFORMED).isNull()).drop(MALFORMED, "file")


def malformed_counts(checked: DataFrame) -> DataFrame:
    """``file``, ``n``, ``malformed``: lines of each file, and those that don't fit."""
    return checked.groupBy("file").agg(F.count("*").alias("n"), F.count(MALFORMED).alias("malformed"))


def set_malformed_apart(checked: DataFrame, path: str) -> DataFrame:
    """Write the lines that don't fit, with their files, to a quarantine table (Parquet, overwritten by a rerun); the others."""
    checked.where(F.col(MALFORMED).isNotNull()).select("file", MALFORMED).write.mode("overwrite").parquet(path)
    return well_formed(checked)


def read_keyvalue_records(spark: SparkSession, path: str | list[str], keys: list[str]) -> DataFrame:
    """``Key: value`` lines in records set apart by lines that start with ``-``; a column for each key.

    Lines end in LF or CRLF, are cut at the first colon and trimmed on both sides; the last record counts without a separator
    behind it too; records without any of the keys are left out. Of a repeated key the last value counts. What a separator
    line says behind its dash is no record's, unless it is one of the keys.
    """
    records = spark.read.option("lineSep", "\n-").text(path)
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]*):", 1)).alias("k"), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("v")))
    of = lambda key: F.try_element_at(F.filter("pairs", lambda p: p["k"] == key), F.lit(-1))["v"]
    out = records.select(pairs.alias("pairs")).select(*[of(k).alias(k) for k in keys])
    return out.dropna(how="all")


def verify_checksums(spark: SparkSession, files: str, manifests: str, whole: int = WHOLE) -> DataFrame:
    """``name``, ``expected``, ``actual``, ``ok`` of landed files against MD5 manifests.

    A manifest line is ``MD5(name)= digest`` or ``digest  name``, or a digest alone in a file called ``name.md5``.
    Files of more than ``whole`` bytes are streamed.
    """
    base = lambda c: F.regexp_extract(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), r"([^/]+)$", 1)
    actual = md5_of_files(spark, files, whole).select(base(F.col("file")).alias("name"), F.col("md5").alias("actual"))
    stated = [F.nullif(F.regexp_extract("value", r, 1), F.lit("")) for r in (r"\(([^()]+)\)", r"[0-9a-fA-F]{32}\s+\*?(\S+)\s*$")]
    lines = spark.read.text(manifests).select(F.lower(F.regexp_extract("value", r"\b([0-9a-fA-F]{32})\b", 1)).alias("expected"), F.coalesce(*stated, F.regexp_replace(base(F.input_file_name()), r"\.md5$", "")).alias("name")).where("expected <> ''")
    return lines.join(actual, "name", "left").withColumn("ok", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)))


def pending_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Of ``files(path)`` those whose base name isn't in ``ledger(name)``."""
    return files.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1)).join(ledger.select("name"), "name", "left_anti")
