"""N-grams of whole documents against the same steps over rows."""

import random

import pytest
from processgraph.operators import spans, text
from processgraph.plans import catalogue
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORDS = "river engine Engine, turns 'turns' the of of, --house-- house well---known --- , — _ (a b) [c] {d \"so\" . end. stop! café CAFÉ naïve -'-'-'- '--abc x-.-.-yes İnce a b _river_ ne\u0000ar near".split(" ")


def odd(seed: int) -> str:
    rng = random.Random(seed)
    out = []
    for _ in range(rng.choice([1, 3, 160])):
        out.append(rng.choice([" ", "  ", " ", " "]).join(rng.choice(WORDS) for _ in range(rng.choice([1, 4, 30]))) + rng.choice([".", "!", "", " "]))
    return rng.choice(["\n\n", " ", "\n"]).join(out)


@pytest.fixture(scope="module")
def docs(spark):
    body = "\n\n".join("The fast engine turns slowly today and the quiet river bends near houses." for _ in range(100))
    rows = [(k, odd(k)) for k in range(40)] + [(100, ""), (101, None), (102, "word"), (103, body), (104, " \n\n ")]
    return spark.createDataFrame(rows, "doc_id long, text string").cache()


@pytest.fixture(scope="module")
def grams(spark, docs):
    return text.ngrams(docs).cache()


def rows(df, columns):
    own = [F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.select(*columns).dtypes]
    return sorted(map(repr, map(tuple, df.select(*own).collect())))


FORMS = {
    "fast_slow": lambda docs, grams: text.fast_slow(grams),
    "intentional_tokens": lambda docs, grams: text.intentional_tokens(grams, text.fragment_rows(docs).where("sentence = 1").select("doc_id", "fragment")),
    "gaps": lambda docs, grams: text.intentional(text.gaps(grams), text.lengths(grams)),
    "anomalies": lambda docs, grams: text.anomalies(grams),
    "coactivation": lambda docs, grams: text.coactivation(grams),
    "ngram_table": lambda docs, grams: text.ngram_table(grams),
    "running_scores": lambda docs, grams: text.running_ngram_scores(docs),
}


@pytest.mark.parametrize("name", FORMS)
def test_documents_give_what_rows_give(docs, grams, name):
    got, want = getattr(spans, name)(docs), FORMS[name](docs, grams)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, got.columns) == rows(want, got.columns) and got.count() > 100


def test_small_chunks_and_vocabularies(docs, grams, monkeypatch):
    monkeypatch.setattr(spans, "CHUNK", 100)
    monkeypatch.setattr(spans, "MOST_WORDS", 10)
    got = spans.anomalies(docs)
    assert rows(got, got.columns) == rows(text.anomalies(grams), got.columns)


SHUFFLED = "fast_slow intentional_tokens ngram_gaps ngram_anomalies coactivation ngram_frequencies running_ngrams".split()


@pytest.mark.parametrize("name", SHUFFLED)
def test_only_texts_are_shuffled(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "Aggregate" not in plan
