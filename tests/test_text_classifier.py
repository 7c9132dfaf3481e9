"""The text classifier splits its texts once: fitting and scoring read written word counts."""

import random

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StringIndexer
from pyspark.sql import functions as F

from tidemark.operators import learning


def test_counts_are_written_and_give_what_one_pipeline_over_texts_gives(spark):
    rng = random.Random(2)
    words = {"en": ["the", "of", "and", "house"], "fr": ["le", "de", "et", "maison"], "de": ["der", "von", "und", "Haus"]}
    rows = [(i, " ".join(rng.choice(words[g] + ["x1", "Été"]) for _ in range(rng.randrange(12))), g, 0.9) for i, g in enumerate(["en", "fr", "de"] * 30)]
    rows += [(90, None, "en", 0.9), (91, "", "fr", 0.9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, weight double").filter("text is not null")
    whole = Pipeline(
        stages=[
            StringIndexer(inputCol="lang", outputCol="_label", handleInvalid="skip", stringOrderType="alphabetAsc"),
            RegexTokenizer(inputCol="text", outputCol="_words", pattern="[^0-9a-zA-ZÀ-ÿ]+"),
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=1 << 16),
            IDF(inputCol="_tf", outputCol="_tfidf"),
            LogisticRegression(featuresCol="_tfidf", labelCol="_label", maxIter=20, regParam=0.01, weightCol="weight"),
        ]
    )
    counted = learning.term_counts(docs, "text")
    assert counted.inputFiles() and "text" not in counted.columns
    fits = (whole.fit(docs), docs), (learning.text_classifier("lang", "weight").fit(counted), counted)
    want, got = (
        {r.doc_id: (r.predicted, r.c) for r in learning.classify(m, df).select("doc_id", "predicted", F.round("confidence", 4).alias("c")).collect()}
        for m, df in fits
    )
    assert got == want and len(got) == 91 and sum(got[i][0] == g for i, _, g, _ in rows if i in got) > 80
