"""The pipeline's stages, each against what its operator decides."""

from pyspark.sql import functions as F

import corpus_pipeline
from keystrata.llm import decontamination, near_dups


def test_stages_keep_columns_and_decide(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        kept.append(out.checkpoint())
    language, near, clean, secret = kept[1:]
    assert language.count() == docs.where("text rlike '[^\\\\W\\\\d_]'").count()
    classes = near_dups.classes(language)
    assert near.count() == classes.select("class_id").distinct().count()
    assert near.join(classes.where("doc_id = class_id"), "doc_id").count() == near.count()
    bad = decontamination.overlaps(near, spark.read.parquet(f"{sf}/benchmark.parquet")).select("doc_id").distinct()
    assert clean.count() == near.count() - bad.count()
    assert secret.count() == clean.count()
    changed = secret.alias("a").join(clean.alias("b"), "doc_id").where("a.text <> b.text")
    assert changed.count() > 0 and changed.where("a.n_chars <> length(a.text)").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, secret, sf)
    assert packed.select("doc_id").distinct().count() == secret.count()
    assert corpus_pipeline.run(spark, sf).count() == packed.count()


def test_an_unlabelled_or_empty_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    assert corpus_pipeline.identify_language(spark, docs.limit(0), sf).count() == 0
    blank = docs.withColumn("text", docs["text"].substr(1, 0))
    assert corpus_pipeline.identify_language(spark, blank, sf).count() == 0
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_an_unlabelled_corpus_passes_whole(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.identify_language(spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() == docs.where("text rlike '[^\\\\W\\\\d_]'").count() > 100


def test_repeated_and_missing_ids_and_clashing_names(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    base = table.where("length(text) > 300 AND lang = 'en'").orderBy("doc_id").limit(30)
    # one id for all, or none, and columns that operators use within
    docs = base.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.lit(7)).cast("long")).withColumns({"score": F.lit("s"), "class_id": F.lit(1), "at": F.lit(2.5), "overlapping_id": F.col("text")})
    nothing = spark.createDataFrame([(7, None, None, None, None, "s", 1, 0.5, None), (7, "", "en", "x", 0, "s", 1, 0.5, None)], docs.schema)
    docs = docs.unionByName(nothing)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        docs = out.checkpoint()
    distinct = near_dups.classes(base).select("class_id").distinct().count()
    leaks = decontamination.overlaps(base, spark.read.parquet(f"{sf}/benchmark.parquet")).select("doc_id").distinct()
    assert leaks.count() or docs.count() == distinct  # no text is lost but near copies and leaks
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).select("doc_id").distinct().count() <= 2
