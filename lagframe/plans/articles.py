"""The article pipeline: clean, enrich, deduplicate, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagframe.functions import dates, flags, text
from lagframe.operators import dedupe, filters, joins, reshape
from lagframe.schema import ARTICLE_COLUMNS, ARTICLE_SCHEMA

LAST_LIST_YEAR = 2024


def _source_order(df: DataFrame) -> list[str]:
    """The columns of :func:`~lagframe.operators.reshape.with_ordinal`, as far as a list has them."""
    return [c for c in ("file", "block", "ordinal") if c in df.columns]


def quartile_list(shards: DataFrame, newest: int = LAST_LIST_YEAR) -> DataFrame:
    """Journal ranks, long: ``issn_linking, year, rank, sjr, quartile, h_index``; the first listed row of a journal and year.

    The newest shard is the base: its rows without a quartile don't count, and journals that it lacks have no ranks at all.
    """
    order = _source_order(shards)
    long = shards.select(*order, F.col("year"), F.col("rank").cast("int").alias("rank"), F.col("issn").alias("issn_linking"), text.decimal_comma(F.col("sjr")).alias("sjr"), text.null_sentinels(F.col("sjr_best_quartile")).alias("quartile"), F.col("h_index").cast("int").alias("h_index"))
    keyed = reshape.split_rows(long, "issn_linking", ", ").withColumn("issn_linking", text.normal_issn(F.col("issn_linking"))).where("issn_linking is not null")
    keyed = keyed.where((F.col("year") != newest) | F.col("quartile").isNotNull())
    first = dedupe.keep_first(keyed, ["issn_linking", "year"], [*order, "rank", "h_index", "sjr", "quartile"]).drop(*order)
    return joins.present_in(first, keyed.where(F.col("year") == newest).select("issn_linking"), "issn_linking")


def classification_list(raw: DataFrame) -> DataFrame:
    """Source list: journals only, a row for each ISSN with the subject code that is listed first."""
    order = _source_order(raw)
    rows = reshape.issn_keys(filters.equals(raw, "source_type", "Journal"), "print_issn", "e_issn")
    rows = rows.select("*", F.posexplode_outer(F.split("asjc", "; ")).alias("_listed", "_code")).withColumn("asjc", F.trim("_code").try_cast("int"))
    first = dedupe.keep_first(rows.select("issn_linking", "asjc", "open_access_status", "_listed", *order), ["issn_linking"], [*order, "_listed", "asjc", "open_access_status"])
    return first.select("issn_linking", "asjc", flags.discipline(F.col("asjc")).alias("discipline"), "open_access_status")


def open_access_list(raw: DataFrame) -> DataFrame:
    order = _source_order(raw)
    rows = reshape.issn_keys(raw, "print_issn", "e_issn").select("issn_linking", "apc", "apc_amount", "doaj_compliant", *order)
    return dedupe.keep_first(rows, ["issn_linking"], [*order, "apc", "apc_amount", "doaj_compliant"]).drop(*order)


def national_list(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attributes by ISSN, and levels long: ``issn_linking, year, npi_year`` from columns ``npi_level_15``, ``npi_level_16``, ..."""
    order = _source_order(raw)
    rows = reshape.issn_keys(raw, "print_issn", "e_issn")
    rows = dedupe.keep_first(rows, ["issn_linking"], [*order, *[c for c in rows.columns if c not in ("issn_linking", *order)]]).drop(*order, "print_issn", "e_issn")
    levels = reshape.columns_like(rows, r"^npi_level_\d+$")
    long = reshape.wide_to_long(rows.select("issn_linking", *[F.col(c).try_cast("int").alias(c) for c in levels]), ["issn_linking"], levels, "year", "npi_year", "npi_level_")
    return rows.drop(*levels), long.withColumn("year", F.col("year").cast("int") + 2000)


def retraction_list(raw: DataFrame, retracted_since: str = "2015-01-01", published_since: str = "2013-01-01") -> DataFrame:
    rows = raw.select("retraction_nature", "reason", dates.parse_us_timestamp(F.col("retraction_date")).alias("retraction_date"), dates.parse_us_timestamp(F.col("original_date")).alias("original_date"), F.coalesce("doi", "retraction_doi").alias("merge_key"))
    return filters.retraction_window(rows, retracted_since, published_since)


def clean_articles(raw: DataFrame) -> DataFrame:
    """Parsed dates, delays, decoded types and keyword flags of raw records; what lacks a needed date or has them out of order goes."""
    days = {"received": "history.received", "accepted": "history.accepted", "pubdate": "pubdate", "article_date": "article_date"}
    parsed = F.struct(*[dates.parse_partial_date(F.col(c)).alias(name) for name, c in days.items()])
    # a generator of one row, so that filters on the dates don't parse them again below it
    df = raw.select(*[c for c in raw.columns if c not in ("history", *days)], F.inline(F.array(parsed)))
    df = df.withColumns({"keywords": text.semicolons_to_commas(F.col("keywords")), "publication_types": text.extract_types(F.col("publication_types")), "issn_linking": text.normal_issn(F.col("issn_linking"))})
    df = filters.date_order(filters.of_type(filters.require(df, "received", "accepted", "issn_linking"), "publication_types", "Journal Article"))
    df = df.withColumns({"acceptance_delay": dates.delay_days(F.col("received"), F.col("accepted")), "publication_delay": dates.publication_delay(F.col("accepted"), F.col("article_date"), F.col("pubdate"))})
    df = filters.sane_delays(df)
    return df.withColumn("is_covid", text.keyword_flag(F.col("title"), F.col("keywords"), text.PANDEMIC_TERMS))


def enrich_articles(df: DataFrame, quartiles: DataFrame, classes: DataFrame, open_access: DataFrame, national: tuple[DataFrame, DataFrame], retractions: DataFrame, null_match: bool = False, since: str = "2013-01-01", last_year: int = LAST_LIST_YEAR) -> DataFrame:
    """The 31 columns of a processed article, from cleaned articles and the reference lists; see SURVEY section 3 for the order."""
    attributes, levels = national
    df = joins.enrich_chain(df, [(classes, "_class"), (open_access, "_doaj"), (attributes, "_npi")], "issn_linking")
    year = F.year("article_date")
    ranks = quartiles.select("issn_linking", "year", F.col("quartile").alias("quartile_year"), F.col("rank").alias("rank_year"), F.col("h_index").alias("h_index_year"))
    df = joins.year_lookup(df, ranks, "issn_linking", year, last_year, ["quartile_year", "rank_year", "h_index_year"])
    df = joins.year_lookup(df, levels, "issn_linking", year, last_year, ["npi_year"])
    df = filters.recent_non_conference(df, since)
    df = df.withColumns({"is_psych": flags.in_interval(F.col("asjc"), *flags.PSYCHOLOGY_CODES), "is_mega": flags.in_set(F.col("issn_linking"), flags.MEGA_JOURNALS), "open_access": flags.open_access(F.col("doaj_compliant"), F.col("open_access_status"), F.col("npi_open_access"))})
    df = joins.join_on_nullable(df, retractions, "doi", "merge_key", null_match)
    df = df.withColumns({"is_retracted": flags.is_retracted(F.col("reason"), F.col("retraction_nature")), "article_date": flags.corrected_date(F.col("article_date"), F.col("retraction_date"), F.col("original_date"))})
    kinds = dict(part.split() for part in ARTICLE_SCHEMA.split(","))
    return df.select(*[F.col(c).cast(kinds[c]).alias(c) for c in ARTICLE_COLUMNS], *_source_order(df))


def distinct_articles(df: DataFrame, order: list[str]) -> DataFrame:
    """The first article of each title over all files."""
    return dedupe.keep_first(df, ["title"], order)
