"""The pipeline: each stage keeps the columns, its decisions take effect, and the result is whole."""

import corpus_pipeline
from vecloom.llm.secrets import find_secrets

SF_DIR = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF_DIR), "stage")
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0 and counts[3] == counts[4]
    assert find_secrets(docs).where("size(secrets) > 0").count() == 0
    assert corpus_pipeline.run(spark, SF_DIR).count() == counts[-1]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id int, _key int, _text_key int, x0 double, _cuts int, label int"


def odd_rows(spark):
    """Nulls, empty, blank, long, repeated rows, ties, a benchmark item, a secret, and columns of names the stages use inside."""
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    item = benchmark.orderBy("item_id").head()["text"]
    # Prose that is far from toxic, without benchmark items and secrets.
    scored = corpus_pipeline.score_toxicity(spark.read.parquet(f"{SF_DIR}/documents.parquet"), corpus_pipeline.toxicity_model(spark, SF_DIR))
    fine = find_secrets(corpus_pipeline.without_leaks(scored, benchmark)).where("size(secrets) = 0 and n_chars > 600").orderBy("score", "doc_id").limit(12).collect()
    plain, long = " ".join(fine[0]["text"].split()[:80]), " ".join(" ".join(f"{w}" for w in r["text"].split()) for r in fine[1:] * 40)
    texts = [
        (1, None), (2, ""), (3, " \n\t"), (3, " \n\t"), (4, plain), (4, plain), (5, plain), (None, plain), (None, None), (6, plain + " tail"),
        (7, long), (8, f"{' '.join(fine[2]['text'].split()[:30])} {item}"), (9, f"{' '.join(fine[3]['text'].split()[:40])} password = hunter2222 end"),
    ]
    rows = [(i, t, None if i == 1 else "en", "s", None if t is None else len(t), 1, 2, 3, 4.0, 5, 6) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def test_stages_on_odd_rows(spark):
    docs, seen = odd_rows(spark), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF_DIR), "odd")
        seen[name] = docs.collect()
    ids = {name: sorted((r["doc_id"] or 0) for r in rows) for name, rows in seen.items()}
    assert ids["toxicity"] == [0, 0, 1, 2, 3, 3, 4, 4, 5, 6, 7, 8, 9]
    # The plain text and its near copy leave the smallest id; blank texts all stay.
    assert ids["near_duplicates"] == [0, 1, 2, 3, 3, 4, 7, 8, 9]
    assert ids["decontamination"] == [0, 1, 2, 3, 3, 4, 7, 9] == ids["secrets"] == ids["encoding"]
    masked = {r["doc_id"]: r for r in seen["secrets"]}
    assert masked[9]["text"].endswith(" [SECRET] end") and masked[9]["n_chars"] == len(masked[9]["text"]) and masked[1]["n_chars"] is None
    tokens = {r["doc_id"]: r["n_tokens"] for r in seen["encoding"]}
    assert tokens[1] == tokens[2] == 0 and tokens[7] > 20_000


def test_stages_on_no_rows(spark):
    docs = odd_rows(spark).where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF_DIR), "none")
        assert docs.count() == 0


def test_operators_keep_columns_of_any_name(spark):
    docs = odd_rows(spark)
    model = corpus_pipeline.toxicity_model(spark, SF_DIR)
    scored = corpus_pipeline.score_toxicity(docs.drop("label"), model)
    assert scored.columns == [*docs.drop("label").columns, "score", "predicted"] and scored.where("x0 = 4.0").count() == docs.count()
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    clean = corpus_pipeline.without_leaks(docs, benchmark)
    assert clean.columns == docs.columns and clean.where("_id = 1 and _key = 2 and _text_key = 3").count() == docs.count() - 1
    masked = corpus_pipeline.redact(find_secrets(docs))
    assert masked.columns == [*docs.columns, "secrets"] and masked.where("_cuts = 5").count() == docs.count()
