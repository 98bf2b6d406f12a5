"""Every domain of the documents is one of the model's, with a target and a rate, labelled or not."""

import pytest
from pyspark.sql import functions as F

from bitloom.llm import mixing

WORDS = {"en": "the cat and the dog", "de": "der hund und die katze", "fr": "le chien avec un chat", "fi": "koira ja kissa talossa"}


def documents(spark):
    lang = lambda i: "fi" if i % 500 == 1 else ("fr" if i % 100 == 2 else ("de" if i % 5 == 0 else "en"))
    return spark.createDataFrame([(i, (WORDS[lang(i)] + " ") * 8 + str(i), lang(i)) for i in range(3000)], "doc_id long, text string, lang string")


def test_rare_and_unlabelled_domains_exist(spark):
    docs = documents(spark)
    labels = docs.where("lang <> 'fi' and doc_id < 1000").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    got = mixing.mixture(docs, labels, mixing.Params(rows=200)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["domain"] == got["lang"]).mean() > 0.99 and set(got["domain"]) == set(WORDS)
    rate = got.groupby("lang")["rate"].mean()
    assert rate["fi"] > rate["fr"] > rate["de"] > rate["en"]


def test_too_many_domains_are_refused(spark):
    docs = documents(spark)
    with pytest.raises(ValueError, match="more than 3"):
        mixing.fit(docs, docs.limit(0).select("doc_id", F.lit(1).alias("quality")), mixing.Params(max_domains=3))
