"""The sample the language model is fitted on."""

import inspect

from riskloom.llm.language import _share, fit


def test_sample_of_20_000(spark):
    size = inspect.signature(fit).parameters["fit_docs"].default
    docs = spark.range(15_000).selectExpr("id AS doc_id", "'some text' AS text", "'en' AS lang")
    assert _share(docs, "doc_id", "text", "lang", size, 200_000_000).count() == 15_000
    part = _share(docs, "doc_id", "text", "lang", size, 15_000 * 9 // 3).count()
    assert 4_600 < part < 5_400
