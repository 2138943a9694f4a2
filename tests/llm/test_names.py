"""Ids that are texts, and columns with the names of results."""

import pytest

from sparcel.llm import decontaminate, licenses, quality, toxicity


def frames(spark):
    docs = [(f"d{i}", "you are vile scum and awful. " * (i % 3) + "a calm day by the sea with friends. " * 4, "mine") for i in range(40)]
    labels = [(f"d{i}", int(i % 3 == 0), int(i % 3 > 0)) for i in range(40)]
    return spark.createDataFrame(docs, "doc_id string, text string, other string"), spark.createDataFrame(labels, "doc_id string, quality int, toxic int")


def test_text_ids(spark):
    docs, labels = frames(spark)
    model = toxicity.fit_toxicity(docs, labels)
    assert toxicity.score_toxicity(docs, model).count() == 40
    assert quality.score_quality(docs, quality.fit_quality(docs, labels)).count() == 40


@pytest.mark.parametrize("name", ["leaks", "licenses", "toxicity", "quality_score"])
def test_a_taken_name_is_refused(spark, name):
    docs, labels = frames(spark)
    taken = docs.withColumnRenamed("other", name.upper())
    benchmark = spark.createDataFrame([(1, "an item of the benchmark")], "item_id long, text string")
    run = {
        "leaks": lambda d: decontaminate.find_contamination(d, benchmark), "licenses": licenses.scan_licenses,
        "toxicity": lambda d: toxicity.score_toxicity(d, toxicity.Model(share=0.5)), "quality_score": lambda d: quality.score_quality(d, quality.Model(share=0.5)),
    }[name]
    with pytest.raises(ValueError, match="already"):
        run(taken)
    assert run(docs).count() == 40


def test_template_with_an_apostrophe(spark):
    text = "permission is hereby granted to anyone who reads this author's notice to copy it"
    found = licenses.scan_licenses(spark.createDataFrame([(1, f"x {text} y")], "doc_id long, text string"), {"author's": text})
    assert found.first().licenses[0].license == "author's"
