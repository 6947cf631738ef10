"""Sentence scores of whole documents against the same steps over rows."""

import random

import pytest
from processgraph.operators import scores, text
from processgraph.plans import built, catalogue
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORDS = "river Engine turns, turns. of (house) [x] <b>bold</b> café CAFÉ İnce ΣΑΣ a b   x\u000by end! so? <a 1.5".split(" ")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [(k, "".join(rng.choice(WORDS) + rng.choice([" ", "  ", "\n", "\t", "\r\n", ". ", "\u000b"]) for _ in range(rng.choice([1, 20, 700])))) for k in range(40)]
    return spark.createDataFrame(rows + [(100, ""), (101, None), (102, " \n "), (103, "One. One. One.")], "doc_id long, text string").cache()


def rows(df, columns):
    own = [F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.select(*columns).dtypes]
    return sorted(map(repr, map(tuple, df.select(*own).collect())))


FORMS = {
    "text_to_notes": (lambda d: scores.to_notes(d, "c"), lambda d: text.to_notes(d, "c")),
    "significant_sentences": (scores.significant, text.significant),
    "running_score": (scores.running_ranks, lambda d: text.running_ranks(text.sentences(d))),
    "significant_static": (lambda d: scores.top_static(d, 25.0), lambda d: text.select_top(text.static_ranks(text.sentences(d)), 25.0).drop("score")),
    "static_score": (scores.static_ranks, lambda d: text.static_ranks(text.sentences(d))),
}


@pytest.mark.parametrize("name", FORMS)
def test_documents_give_what_rows_give(docs, name):
    got, want = (f(docs) for f in FORMS[name])
    assert rows(got, got.columns) == rows(want, got.columns) and got.count() > 30


@pytest.mark.parametrize("name", FORMS)
def test_only_texts_are_shuffled(spark, name):
    assert built.significant_sentences
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "Aggregate" not in plan
