"""Recall on vectors of other shapes, repeated query ids, and the pipeline's stages on labels and ids that mislead."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideway.llm import language, near_dedup, vectors

WORDS = {"en": "the and of that with from this have which people would there about", "de": "und der die nicht mit auch wird sich einer nach wurde durch", "und": "qux zorp blat fleem grix snood vark plim drost wug"}


def generated(kind: str, n: int) -> np.ndarray:
    """Vectors of 64 columns with falling variance, and norms of their own or clusters."""
    rng = np.random.default_rng(len(kind) + n)
    x = rng.normal(size=(n, 64)) * (np.arange(1, 65) ** (-1.0 if "steep" in kind else -0.6))
    if "norms" in kind:
        x *= np.exp(rng.normal(0, 1.0 if "wide" in kind else 0.7, (n, 1)))
    if "clusters" in kind:
        x = x * 0.3 + rng.normal(size=(40, 64))[rng.integers(0, 40, n)]
    return x


@pytest.mark.parametrize("kind, n", [("norms", 6000), ("steep norms", 6000), ("wide norms", 4000), ("clusters", 6000), ("even", 2000)])
def test_recall_on_other_vectors(spark, kind, n):
    x = generated(kind, n)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in vectors.nearest(table, F.col("vec_id") % 20 == 0).select("query_id", "vec_id").collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for query, found in got.items():
        score = x @ x[query]
        score[query] = -np.inf
        hits += len(found & set(np.argpartition(-score, 20)[:20].tolist()))
    assert len(got) == n // 20 and hits / (20 * len(got)) >= 0.9


def test_a_repeated_query_id_asks_for_its_smallest_vector(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [5.0, 1.0]), (2, [1.0, 4.0])]
    for order in (rows, rows[::-1]):
        (row,) = vectors.nearest(spark.createDataFrame(order, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 1).collect()
        assert (row["query_id"], row["vec_id"], row["score"]) == (0, 2, 4.0)


def labelled(n: int):
    rng = np.random.default_rng(8)
    return [(i, " ".join(rng.choice(WORDS[lang].split(), 40)), lang) for i, lang in enumerate(sorted(WORDS) * n)]


def test_language_stage_keeps_labelled_texts_and_labels_the_others(spark):
    rows = labelled(80)
    held = [(1000 + i, text, None) for i, text, _ in labelled(10)]
    odd = [(2000, None, "en"), (2001, " 12 ", "en"), (2002, "", None), (2003, "the people", None)]
    table = spark.createDataFrame([(t, i, lang, None, len(t or "")) for i, t, lang in rows + held + odd], "text string, doc_id long, lang string, source string, n_chars int")
    kept = {r["doc_id"]: r["lang"] for r in language.keep_known_languages(table).collect()}
    assert set(kept) == {i for i, *_ in rows + held} | {2003}
    assert all(kept[i] == lang for i, _, lang in rows)
    truth = [lang for _, _, lang in labelled(10)]
    assert np.mean([kept[1000 + i] == lang for i, lang in enumerate(truth)]) > 0.9
    chosen = {r["doc_id"] for r in language.keep_known_languages(table, wanted=("de",), least_score=0.5).collect()}
    of = dict((i, lang) for i, _, lang in rows)
    assert np.mean([of[i] == "de" for i in chosen if i in of]) > 0.95 and len([i for i in chosen if i in of]) > 70
    unlabelled = table.withColumn("lang", F.lit(None).cast("string"))
    assert language.keep_known_languages(unlabelled, wanted=("de",)).count() == 0 and language.keep_known_languages(unlabelled).count() == len(kept)


def test_near_copies_under_one_id_leave_one(spark):
    words = np.random.default_rng(1).choice("one two three four five six seven eight nine ten eleven twelve".split(), 5000).tolist()
    near = [" ".join([*words, *tail]) for tail in ([], ["x"], ["y"], ["z", "z"])]
    prints = [near_dedup.simhash(t.encode()) for t in near]
    assert all((a ^ b).bit_count() <= 4 for a in prints for b in prints)
    rows = [(5, near[0]), (5, near[1]), (5, near[2]), (9, near[3]), (1, "something else entirely stands here"), (None, near[1])]
    found = near_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in found) == [1, 5]
