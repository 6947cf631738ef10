import corpus_pipeline
import pytest
from processgraph.llm import bpe, langid, neardup, packing, pii, quality

SF = "/root/testdata/sf0.001"


def test_stages_in_order_and_by_hand(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "language_id", "near_duplicates", "personal_data", "packing"]
    raw = spark.read.parquet(f"{SF}/documents.parquet").cache()
    docs, ids = raw, [r.doc_id for r in raw.select("doc_id").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        out = stage(spark, docs, SF)
        assert out.columns == raw.columns
        after = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "quality_classifier":
            p = quality.classify(docs, quality.fit(raw, spark.read.parquet(f"{SF}/labels.parquet")))
            assert after == {r.doc_id for r in p.collect() if r.prob >= 0.5}
        elif name == "language_id":
            m = langid.fit(docs)
            assert after == {r.doc_id for r in langid.identify(docs, m).collect() if r.lang in m["langs"] and r.share >= 0.5}
        elif name == "near_duplicates":
            assert after == {r.group_id for r in neardup.near_duplicates(docs).collect()}
        else:
            want = {r.doc_id: r.text for r in pii.find(docs, pii.fit(docs)).collect()}
            assert {r.doc_id: r.text for r in out.collect()} == want
        assert after <= before
        docs = spark.createDataFrame(out.collect(), raw.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sum(r.n_tokens for r in packed) == len(bpe.Coder(bpe.load()).encode([r.text for r in docs.collect()])[0])
    assert max(r.position + r.n_tokens for r in packed) <= packing.CAPACITY
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(ids) > len(after) and sum(labels.get(d) == 1 for d in after) > 0


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_no_documents(spark, stage):
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    out = stage(spark, spark.createDataFrame([], raw.schema), SF)
    assert out.count() == 0


def _naive_groups(texts, threshold=0.5):
    """The least id of each chain of texts that share at least the threshold of their word shingles."""
    sets = {}
    for d, t in texts.items():
        w = t.lower().split()
        sets[d] = {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in texts}


def test_duplicates_of_the_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    naive = _naive_groups({d: t for d, t in texts.items() if t})
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF).collect()}
    assert kept == {d for d in texts if naive.get(d, d) == d}


def test_rows_that_are_odd(spark):
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    good = raw.orderBy("doc_id").limit(40)
    names = ["__gone", "__nth", "__id", "__good", "gone", "nth", "r", "i", "t", "row", "n", "shard"]
    odd = [(None, None, None, None, None), (900_001, "", "en", "s", 0), (900_002, None, "en", "s", None), (900_003, "word " * 60_000, None, "s", 300_000), (900_004, "\u0000 \u0001", "en", None, 3), (None, "no id but a text of some words", "en", "s", 30)]
    docs = good.unionAll(good.limit(3)).unionAll(spark.createDataFrame(odd, raw.schema)).cache()
    for c in names:
        docs = docs.withColumn(c, docs["n_chars"])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert 0 < out.count() <= docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).where("n_tokens is null or doc_id is null").count() == 0
