"""Each stage of the pipeline against brute force on its own input, and the SQL twins."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lagframe.llm import mixing, queries, stages, toxicity

from ..compare import DATA, database, rows
from .test_joins_and_dedup import components, removed


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_twin(spark, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), database().sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want) and len(got) > 0


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    extra = docs.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars").limit(1)
    docs = docs.union(extra)
    toxic = stages.drop_toxic(spark, docs, DATA)
    model = toxicity.learn(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(docs, model).where("score >= 0.7").collect()}
    every = sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    assert toxic.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in toxic.collect()) == [r for r in every if r[0] not in {str(i) for i in bad}]
    near = stages.drop_near_duplicates(spark, docs, DATA)
    comps = components([(r.doc_id, r.text) for r in docs.collect()], 5, "0.8")
    kept = {r.doc_id for r in near.collect()}
    assert near.columns == docs.columns and kept == {None} | {i for i, (_, c) in comps.items() if c == i}
    cut = {r.doc_id: r for r in stages.drop_repeated_passages(spark, docs.where("doc_id is not null"), DATA).collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    for i, _, n, _, rest in removed([(i, t) for i, t in before.items() if i is not None], 50):
        if n and not rest:
            assert i not in cut
        else:
            assert cut[i].text == (rest if n else before[i]) and cut[i].n_chars == len(cut[i].text)
    mixed = stages.mix_to_weights(spark, docs, DATA)
    rated = mixing.mix(docs, mixing.quality_domains(spark.read.parquet(f"{DATA}/labels.parquet")), stages.WEIGHTS, stages.BUDGET)
    thinned = {str(r.doc_id) for r in rated.where("copies = 0").collect()}
    assert mixed.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in mixed.collect()) == [r for r in every if r[0] not in thinned]


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "mixing", "packing"]
    out = corpus_pipeline.run(spark, DATA).toPandas()
    assert len(out) > 100 and out.groupby("sequence_id").length.sum().max() <= 2048


def test_rows_without_an_id(spark):
    folder = "/root/testdata/sf0.01"  # few documents are rejected on the smallest tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    caught = docs.join(stages.drop_toxic(spark, docs, folder), "doc_id", "left_anti")
    toxic = caught.join(labels.where("toxic = 1"), "doc_id", "left_semi").orderBy("doc_id").first().text
    clean = "the quiet river runs along the old mill " * 20
    bare = lambda t: spark.createDataFrame([(None, t, "en", "s", len(t))], docs.schema)
    more = docs.union(bare(toxic)).union(bare(clean))
    assert [r.text for r in stages.drop_toxic(spark, more, folder).where("doc_id is null").collect()] == [clean]
    assert [r.text for r in stages.mix_to_weights(spark, docs.union(bare(clean)), folder).where("doc_id is null").distinct().collect()] == [clean]


def test_near_duplicates_of_one_id_with_two_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(80)) for c in "ab")
    rows = [(2, f"{a} end"), (5, a), (5, b), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = stages.drop_near_duplicates(spark, docs, DATA)
    assert kept.columns == docs.columns and {(r.doc_id, r.text) for r in kept.collect()} == {rows[0], rows[2], rows[3]}
