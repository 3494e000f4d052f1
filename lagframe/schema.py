"""Schemas that scans state instead of inferring them."""

from __future__ import annotations

#: The processed article table, in order.
ARTICLE_SCHEMA = """
    is_covid boolean, received date, article_date date, acceptance_delay int, is_psych boolean, is_mega boolean,
    issn_linking string, h_index_year int, open_access boolean, publication_delay int, publication_types string,
    title string, journal string, quartile_year string, rank_year int, discipline string, asjc int,
    npi_discipline string, npi_field string, npi_year int, is_series boolean, established int, country string,
    keywords string, apc string, apc_amount string, doi string, retraction_nature string, reason string,
    retraction_date date, is_retracted boolean
"""

ARTICLE_COLUMNS = [part.split()[0] for part in ARTICLE_SCHEMA.split(",")]

#: One record of an article file.
RAW_ARTICLE_SCHEMA = """
    title string, journal string, country string, doi string, issn_linking string, keywords string,
    publication_types string, pubdate string, article_date string,
    history struct<received: string, accepted: string, pubmed: string, medline: string, entrez: string>,
    mesh_terms string
"""

_DAY = "struct<Year: string, Month: string, Day: string>"

_TERM = "struct<_UI: string, _MajorTopicYN: string, _VALUE: string>"

#: The parts of a MEDLINE record that are read, after the public document type.
MEDLINE_SCHEMA = f"""
    MedlineCitation struct<
        PMID: string,
        Article: struct<
            Journal: struct<Title: string, JournalIssue: struct<PubDate: {_DAY}>>,
            ArticleTitle: string,
            ArticleDate: array<{_DAY}>,
            PublicationTypeList: struct<PublicationType: array<struct<_UI: string, _VALUE: string>>>
        >,
        MedlineJournalInfo: struct<Country: string, ISSNLinking: string>,
        KeywordList: array<struct<Keyword: array<string>>>,
        MeshHeadingList: struct<MeshHeading: array<struct<DescriptorName: {_TERM}, QualifierName: array<{_TERM}>>>>
    >,
    PubmedData struct<
        History: struct<PubMedPubDate: array<struct<_PubStatus: string, Year: string, Month: string, Day: string>>>,
        ArticleIdList: struct<ArticleId: array<struct<_IdType: string, _VALUE: string>>>
    >
"""

JOURNAL_RANK_SCHEMA = "rank int, title string, issn string, sjr string, sjr_best_quartile string, h_index int"
