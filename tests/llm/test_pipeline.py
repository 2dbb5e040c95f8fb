"""The pipeline on a small corpus, each stage against what its operator says alone."""

import corpus_pipeline
import __spark_entry__
from test_text_operators import SCHEMA, brute_components, labelled_corpus
from tachado.llm import credentials, quality, tiling
from tachado.llm.tables import table


def test_stages_keep_clean_documents(spark, tmp_path):
    docs, labels = labelled_corpus(600)
    item = " ".join(f"q{i}" for i in range(20))
    docs += [(1000, docs[0][1] + " more", "en", "s1", 5), (1001, docs[1][1] + " " + item, "en", "s1", 5), (1002, docs[2][1] + " password=abcdefghijklmnop1", "en", "s1", 5), docs[3]]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d, now = str(tmp_path), table(spark, str(tmp_path), "documents")
    kept = corpus_pipeline.classify(spark, now, d)
    model = quality.train(now, table(spark, d, "labels"))
    assert kept.count() == quality.score(now, model).where("keep").count() and kept.columns == now.columns
    one = corpus_pipeline.one_of_each(spark, now, d)
    assert {r.doc_id for r in one.collect()} == {c for _, c in brute_components([r[:2] for r in docs]).values()}
    clean = corpus_pipeline.decontaminate(spark, now, d)
    assert {r.doc_id for r in now.collect()} - {r.doc_id for r in clean.collect()} == {1001}
    masked = corpus_pipeline.mask_secrets(spark, now, d)
    assert masked.columns == now.columns and {r.doc_id: r.text for r in masked.collect()}[1002].endswith("[SECRET assign]")
    packed = corpus_pipeline.run(spark, d)
    want = set()
    for r in tiling.clean(corpus_pipeline.one_of_each(spark, kept, d), table(spark, d, "benchmark")).collect():
        credentials.masked(r.text)
        want.add(r.doc_id)
    assert {r.doc_id for r in packed.collect()} == want


def test_near_copies_by_runs_of_five_words(spark):
    words = [f"w{i}" for i in range(150)]
    edited = lambda *at: " ".join("edit" if i in at else w for i, w in enumerate(words))
    # Three edits in 150 words: 131 of 161 runs of five, but 139 of 157 triples.  Four: 126 of 166, too few for either.
    docs = [(1, edited(), "en", "s", 5), (2, edited(30, 70, 110), "en", "s", 5), (3, edited(15, 50, 90, 130), "en", "s", 5), (4, "eins zwei", "en", "s", 5)]
    kept = corpus_pipeline.one_of_each(spark, spark.createDataFrame(docs, SCHEMA), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in names if k.startswith("op") and k[2].isdigit()} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
