from __future__ import annotations

import zlib

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import langid
from fieldloom.llm.shared import table
from tests.llm import odd

MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = table(spark, MIDDLE, "documents")
    return langid.fit_language_model(docs.where(~langid.held_out()))


def test_held_out_accuracy(spark, model):
    docs = table(spark, MIDDLE, "documents")
    rows = langid.identify(docs, model, langid.held_out().alias("held_out"), F.col("lang")).where("held_out and lang is not null").toPandas()
    known = rows[rows.lang_pred != "und"]
    assert len(rows) > 200 and (known.lang == known.lang_pred).mean() > 0.97
    assert ((rows.score >= 0) & (rows.score <= 1)).all()


def test_several_centroids_of_length_one(model):
    assert len(model.languages) > len(set(model.languages))
    np.testing.assert_allclose((model.centroids**2).sum(1), 1, rtol=1e-4)


def test_the_fold_is_that_of_zlib(spark):
    df = spark.range(200).withColumnRenamed("id", "doc_id").withColumn("h", langid.held_out())
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in df.collect())


def test_odd_rows(spark, model):
    docs = odd.documents(spark)
    rows = langid.identify(docs, model)
    assert odd.sorted_rows(rows) == odd.sorted_rows(langid.identify(odd.crowded(docs), model))
    for r in rows.collect():
        text = [t for i, t, *_ in odd.TEXTS if i == r.doc_id]
        if all(t is None or not any(c.isalpha() for c in t) for t in text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, False)
    by_id = {r.doc_id: r for r in rows.collect()}
    assert by_id[12].lang_pred in model.languages


def test_labels_and_ids_are_no_inputs(spark, model):
    docs = odd.documents(spark)
    other = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None).cast("string"))
    assert odd.sorted_rows(langid.identify(docs, model)) == odd.sorted_rows(langid.identify(other, model))


def test_nothing_to_learn_from(spark):
    for docs in (odd.empty(spark), odd.documents(spark, [(1, None, "en", "a"), (2, "some text", None, "a")])):
        model = langid.fit_language_model(docs)
        assert model.languages == []
        assert {r.lang_pred for r in langid.identify(odd.documents(spark), model).collect()} == {"und"}
    assert langid.identify(odd.empty(spark), langid.fit_language_model(odd.documents(spark))).count() == 0


def test_trigram_vectors_by_hand():
    text = "Ab ÉÑ, 12 né"
    folded = "".join(c.lower() if c.isalpha() else " " for c in text).encode()
    want = np.zeros(langid.SIZE)
    for i in range(len(folded) - 2):
        if folded[i : i + 2] != b"  ":
            code = (int.from_bytes(folded[i : i + 3], "big") * 2654435761) % 2**32
            want[code >> (32 - langid.BITS)] += 1
    raw = text.encode()
    (_, counts), *_ = langid.trigram_counts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    np.testing.assert_array_equal(counts[0], want)


def test_far_text_is_rejected(spark, model):
    docs = odd.documents(spark, [(1, "qzx xqz zzq qqx " * 40, None, None)])
    assert langid.identify(docs, model).first().rejected


def vector_by_hand(text: str, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of folded byte trigrams, one by one, scaled to length 1."""

    def fold(c: str) -> str:
        if ord(c) < 128:
            return c.lower() if c.isalpha() else " "
        return chr(ord(c) + 32) if 0xC0 <= ord(c) <= 0xDE and ord(c) != 0xD7 else c

    raw, out = "".join(map(fold, text)).encode(), np.zeros(langid.SIZE)
    for gram, n in Counter(raw[i : i + 3] for i in range(len(raw) - 2) if raw[i : i + 2] != b"  ").items():
        out[(int.from_bytes(gram, "big") * 2654435761) % 2**32 >> (32 - langid.BITS)] += n
    out = np.log1p(out) * idf
    return out / max(np.sqrt((out * out).sum()), 1e-12)


@pytest.mark.parametrize("where", ["odd", "table"])
def test_predictions_by_hand(spark, model, where):
    """Every whole text against every centroid: the nearest one's language, its cosine, and whether it is too far."""
    docs = odd.documents(spark) if where == "odd" else table(spark, "/root/testdata/sf0.001", "documents")
    got = sorted(map(tuple, langid.identify(docs, model).select("doc_id", "lang_pred", "score", "rejected").collect()), key=str)
    want = []
    for r in docs.select("doc_id", "text").collect():
        if r.text is None or not any(c.isalpha() for c in r.text):
            want.append((r.doc_id, "und", 0.0, False))
            continue
        cosine = model.centroids @ vector_by_hand(r.text, model.idf)
        c = int(cosine.argmax())
        want.append((r.doc_id, model.languages[c], min(1.0, max(0.0, float(cosine[c]))), bool(1 - cosine[c] > model.limits[c])))
    for (i, lang, score, rejected), (j, theirs, cosine, far) in zip(got, sorted(want, key=str), strict=True):
        assert (i, lang) == (j, theirs) and score == pytest.approx(cosine, abs=1e-5) and (rejected == far)


def invented(lang: int, k: int) -> str:
    """A text of a language with syllables of its own."""
    rng = np.random.default_rng([lang, 1])
    syllables = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 3)) for _ in range(12)]
    own = np.random.default_rng([lang, 2, k])
    return " ".join("".join(own.choice(syllables, 3)) for _ in range(12))


@pytest.mark.parametrize("name", [None, 7])
def test_ids_that_are_null_or_all_the_same(spark, name):
    """20,000 rows: an exact number of each language is learned, and half the table being one repeated row changes nothing."""
    rows = [(name, invented(k % 4, k % 2000), f"l{k % 4}") for k in range(10_000)] + [(name, invented(0, 0), "l0")] * 10_000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.fit_language_model(df)
    assert sorted(set(model.languages)) == ["l0", "l1", "l2", "l3"]
    fresh = spark.createDataFrame([(name, invented(k % 4, 5000 + k), f"l{k % 4}") for k in range(400)], df.schema)
    assert langid.identify(fresh, model, F.col("lang")).where("lang = lang_pred").count() >= 396
    again = langid.fit_language_model(df.where("lang <> 'l0'").union(df.where("lang = 'l0'").distinct()))
    np.testing.assert_allclose(model.centroids, again.centroids, atol=1e-6)


def test_many_languages_share_the_rows_and_the_rarest_stay_out(spark):
    rows = [(k, invented(k % 300, k), f"l{k % 300:03}") for k in range(6000)] + [(k, invented(999, k), f"once{k}") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.fit_language_model(df, most_rows=3000, most_languages=300)
    assert sorted(set(model.languages)) == [f"l{k:03}" for k in range(300)]
    fresh = spark.createDataFrame([(k, invented(k % 300, 9000 + k), f"l{k % 300:03}") for k in range(600)], df.schema)
    assert langid.identify(fresh, model, F.col("lang")).where("lang = lang_pred").count() >= 590


def test_exact_numbers_by_least_hashes(spark):
    rows = [("a", h, None) for h in range(0, 2**62, 2**52)] + [("b", 5, None)] * 5000 + [("b", 2**61, None)]
    df = spark.createDataFrame([(a, h) for a, h, _ in rows], "lang string, _h long")
    assert langid._least_hashes(df, 3, {"a": 1024, "b": 5001}) == {"a": 2 * 2**52, "b": 2**61}
