"""The pipeline's stages on a small corpus: what must go goes, what is clean stays, all columns are kept."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(3)
    clean = lambda n: [f"w{r.randrange(4000)}" for _ in range(n)]
    rows, toxic = [], []
    for i in range(300):
        w = clean(60)
        if i % 5 == 0:
            w[10:10] = ["you", "utter", "blockhead"]
            toxic.append(i)
        rows.append((i, " ".join(w)))
    item = " ".join(clean(25))
    rows += [(1000, " ".join(clean(40)) + " " + item), (1001, rows[1][1]), (1002, rows[1][1] + " extra"), (1003, ""), (1004, None), (None, " ".join(clean(30))), (2, rows[2][1])]
    at = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), F.lit(7).alias("score"), F.lit(8).alias("n_hit"), F.lit(9).alias("a.b"))
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), set(toxic), docs.columns


def test_stages(spark, corpus):
    at, toxic, columns = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((x.doc_id is None, x.doc_id or 0) for x in df.select("doc_id").collect())
    everyone = ids(docs)
    kept = steps["toxicity"](spark, docs, at)
    assert kept.columns == columns and ids(kept) == [x for x in everyone if x[1] not in toxic or x[0]]
    assert {tuple(x) for x in kept.select("score", "n_hit", "`a.b`").collect()} == {(7, 8, 9)}
    single = steps["near_duplicates"](spark, docs, at)
    assert single.columns == columns and ids(single) == sorted(set(x for x in everyone if x[1] not in (1001, 1002)))
    # rows of one id with texts that do not link all stay
    more = docs.where("doc_id = 5").withColumn("text", F.lit("another text of the same id that links with nothing at all"))
    assert steps["near_duplicates"](spark, docs.unionByName(more).unionByName(more), at).where("doc_id = 5").count() == 2
    unseen = steps["decontamination"](spark, docs, at)
    assert unseen.columns == columns and ids(unseen) == [x for x in everyone if x[1] != 1000]


def test_run(spark, corpus):
    at, toxic, _ = corpus
    out = corpus_pipeline.run(spark, at).collect()
    got = {x.doc_id for x in out}
    assert not got & (toxic | {1000, 1001, 1002}) and {1003, 1004, None, 2} <= got and len(out) == len(got)
    assert all(x.round_trip for x in out) and len(corpus_pipeline.STAGES) == 4 and corpus_pipeline.ORACLE_SQL is None


def test_empty_and_unlabelled(spark, corpus, tmp_path):
    at, _, columns = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == docs.count()
    for name, step in corpus_pipeline.STAGES[:-1]:
        none = step(spark, docs.limit(0), str(tmp_path))
        assert none.columns == columns and none.count() == 0, name
    assert corpus_pipeline.tokenise(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_very_long_text(spark, corpus):
    at, _, columns = corpus
    long_text = " ".join(f"v{i % 5000}" for i in range(120_000))
    docs = spark.createDataFrame([(1, long_text, "en", "s", len(long_text), 7, 8, 9), (2, long_text + " more", "en", "s", 0, 7, 8, 9)], ",".join(f"`{c}` {t}" for c, t in zip(columns, ["long", "string", "string", "string", "long", "int", "int", "int"], strict=True)))
    assert [x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, at).collect()] == [1]
    assert corpus_pipeline.drop_contaminated(spark, docs, at).count() == 2
    assert all(x.round_trip and x.n_tokens >= 120_000 for x in corpus_pipeline.tokenise(spark, docs, at).collect())
