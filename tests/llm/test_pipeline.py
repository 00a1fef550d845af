import corpus_pipeline
from annoframe.llm import decontam, toxicity
from tests.llm import cases
from tests.llm.test_tokens import check_packing


def test_every_stage_against_plain_versions(spark, tmp_path):
    base = cases.prose(1, 80)
    texts = cases.odd_texts() + [base, base, base + " end", *(f"{cases.prose(700 + k, 30)} vile {cases.prose(800 + k, 30)}" for k in range(40))]
    labels = [(k, 1, int("vile" in (t or ""))) for k, t in enumerate(texts)]
    folder = cases.write(tmp_path, texts, labels=labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    results = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        results[name] = ({r["doc_id"]: r["text"] for r in before.collect()}, {r["doc_id"]: r["text"] for r in docs.collect()})
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect() if r["text"] is not None)

    given, left = results["toxicity"]
    source = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit(source, spark.read.parquet(f"{folder}/labels.parquet"), toxicity.not_held_out())
    scores = {r["doc_id"]: r["__score"] for r in toxicity.score(source, model).collect()}
    assert left == {k: t for k, t in given.items() if scores[k] < toxicity.THRESHOLD}

    given, left = results["line_dedup"]
    import hashlib

    kept = {doc: digest for doc, _, _, digest in cases.lines_plain(list(given.items()))}
    assert {k: hashlib.sha256((t or "").encode()).hexdigest() for k, t in left.items()} == kept

    given, left = results["ngram_jaccard_join"]
    assert left == {doc: given[doc] for doc, _, least in cases.groups_plain(list(given.items())) if doc == least}

    given, left = results["benchmark_decontamination"]
    hits = {doc: (n, hit) for doc, n, hit, _ in cases.hits_plain(list(given.items()), cases.odd_items())}
    assert set(left) == {k for k, (n, hit) in hits.items() if hit <= 0.5 * n}
    assert all(left[k] == given[k] for k in left if not hits[k][1])
    assert not any(hit for _, _, hit, _ in cases.hits_plain(list(left.items()), cases.odd_items()))

    packed = [r.asDict() for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()]
    check_packing(list(left.items()), packed)
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()}
    assert decontam.WINDOW == 10


def test_repeated_rows_null_ids_and_more_columns(spark, tmp_path):
    text = cases.prose(3, 40)
    folder = cases.write(tmp_path, [], [(1, cases.prose(50, 25))], [])
    rows = [(1, text, 1), (1, text, 1), (2, text, 2), (None, text, 3), (None, None, 4), (3, None, 5), (3, None, 5), (4, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `__class` int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str) == sorted([(1, text), (None, None), (3, None), (4, "")], key=str)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == 4


def test_one_document_of_a_group_stays(spark):
    """Also where an id stands at two texts, or is missing."""
    text, other = cases.prose(3, 60), cases.prose(4, 60)
    near = text + " end"
    rows = [(7, text), (7, near), (None, text), (None, near + " more"), (9, other), (8, other + " end"), (None, None), (None, None), (5, "alone")]
    docs = spark.createDataFrame([(a, b, len(b or "")) for a, b in rows], "doc_id long, text string, n_chars int").repartition(4)
    left = [(r["doc_id"], r["text"], r["n_chars"]) for r in corpus_pipeline.ngram_jaccard_join(spark, docs, "").collect()]
    assert len(left) == 4 and all(n == len(t or "") for _, t, n in left)
    assert {(a, None if a == 7 else t) for a, t, _ in left} == {(7, None), (8, other + " end"), (None, None), (5, "alone")}
