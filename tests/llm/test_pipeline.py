"""The pipeline's stages on a small planted corpus."""

import corpus_pipeline
from logweave.llm import cap_filters, ngram_join
from pyspark.sql import functions as F


def test_stages_take_effect(spark, tmp_path):
    rng_words = [f"lorem{k}x" for k in range(50)]
    text = lambda k: " ".join(rng_words[(k * 7 + j * (k % 5 + 1)) % 50] for j in range(60)) + f" tail{k}"
    rows = [(k, text(k), "en", f"src{k % 3}", 1) for k in range(120)]
    rows += [(200, text(3), "en", "src1", 1), (201, text(4) + " again", "en", None, 1), (202, None, None, None, None), (203, "12 34 !!", "en", "src0", 8), (None, text(9), "en", "src0", 1)]
    rows += [(300 + k, text(k) + " snork snork blarg", "en", "src0", 1) for k in range(60)]
    rows += [(400, "lorem1x lorem2x write to a.b@c.org or 10.2.3.4 " + text(31), "en", "src0", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(120)] + [(300 + k, 1, 1) for k in range(60)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = docs
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, str(tmp_path))
        kept.write.parquet(f"{tmp_path}/{name}")
        kept = after[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert kept.columns == docs.columns
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in after.items()}
    assert {202, 203} & ids["language_id"] == set() and set(range(120)) <= ids["language_id"]
    assert set(range(120)) <= ids["toxicity"] and not ids["toxicity"] & set(range(300, 360))
    assert 200 not in ids["ngram_jaccard"] and 201 not in ids["ngram_jaccard"] and 3 in ids["ngram_jaccard"] and None in ids["ngram_jaccard"]
    clean = after["pseudonyms"].filter("doc_id = 400").first().text
    assert "a.b@c.org" not in clean and "10.2.3.4" not in clean
    assert ids["packing"] == ids["pseudonyms"]
    assert corpus_pipeline.run(spark, str(tmp_path)).select(F.count("*")).first()[0] == after["packing"].count()


def test_rows_go_by_their_own_text(spark):
    """Rows that share an id, equal rows, and a null id: no text without a representative goes, and copies stay once."""
    text = lambda k: " ".join(f"w{(k * 31 + j * (k + 3)) % 97}x{k}" for j in range(40))
    near = text(2) + " and one more"
    rows = [(1, text(1)), (2, text(1)), (2, text(2)), (5, near), (7, text(7)), (7, text(7)), (None, text(7)), (8, None), (8, None), (9, ""), (9, " \t")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("lang", F.concat("lang", F.monotonically_increasing_id().cast("string")))
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    left = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect()))
    assert left == sorted([(False, 1, text(1)), (False, 2, text(2)), (False, 7, text(7)), (True, 0, text(7)), (False, 8, ""), (False, 8, ""), (False, 9, ""), (False, 9, " \t")])
    assert ngram_join.one_of_each(docs.limit(0)).count() == 0


def test_empty_tables_go_through_all_stages(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_stage_leaves_the_tables_of_others_alone(spark):
    vectors = spark.createDataFrame([(k, [float(k % 3), 1.0], 0) for k in range(9)], "vec_id bigint, embedding array<float>, label int")
    held = cap_filters.near_duplicates(vectors)
    docs = spark.createDataFrame([(1, "some words of a text that is clean", "en", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _ in range(2):
        corpus_pipeline.without_personal_data(spark, docs, "")
    assert held.count() == 9
