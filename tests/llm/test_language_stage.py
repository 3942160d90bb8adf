"""The pipeline's first stage rejects what has no language, and nothing else."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline

SOUNDS = {lang: [a + b for a in heads for b in tails] for lang, heads, tails in (("en", ("th", "wh", "sh", "ing"), ("e", "at", "ough")), ("de", ("sch", "pf", "z"), ("ung", "eit", "ö")), ("es", ("ñ", "ll", "qu"), ("ado", "ción", "ía")))}


def test_language_stage_rejects_texts_of_no_language(spark, sf):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(SOUNDS[lang], 60)), lang, "a", 1) for i, lang in enumerate(sorted(SOUNDS) * 60)]
    mixed = [(1000 + i, " ".join(rng.permutation([w for lang in SOUNDS for w in rng.choice(SOUNDS[lang], 20)])), None, "a", 1) for i in range(30)]
    table = spark.createDataFrame(rows + mixed, "doc_id long, text string, lang string, source string, n_chars int")
    kept = {r["doc_id"] for r in corpus_pipeline.identify(spark, table, sf).collect()}
    assert {i for i, *_ in rows} <= kept and len(kept) < len(rows) + len(mixed)
    unlabelled = table.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.identify(spark, unlabelled, sf).count() == len(rows) + len(mixed)
