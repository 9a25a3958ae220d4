"""Every operator on nulls, repeated rows, empty, blank and very long texts, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewater.llm import decontamination, embedding_dedup, mixing, quality, secrets, simhash_dedup, substring_dedup, suffix_dedup, token_counts, toxicity
from tidewater.llm.token_counts import MODEL, Unigram


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(0, "one two three four five six seven"), (1, None), (2, ""), (None, "zß東京🙂 ünïcode")], "item_id long, text string")


def operators(benchmark, labels):
    return {
        "secrets": secrets.secret_report,
        "redact": secrets.redact,
        "toxicity": lambda d: toxicity.toxicity_scores(d, labels),
        "substring": substring_dedup.remove_repeats,
        "tokens": lambda d: token_counts.token_counts(d, Unigram.from_model(MODEL)),
        "mixing": mixing.mix,
        "suffix": suffix_dedup.remove_later_copies,
        "quality": lambda d: quality.quality_scores(d, labels),
        "simhash": simhash_dedup.simhash_components,
    }


NAMES = ["secrets", "redact", "toxicity", "substring", "tokens", "mixing", "suffix", "quality", "simhash"]


@pytest.mark.parametrize("name", NAMES)
def test_one_row_for_each_odd_row(name, odd_docs, benchmark, labels):
    rows = operators(benchmark, labels)[name](odd_docs).collect()
    assert len(rows) == 8
    assert sorted(str(r.doc_id) for r in rows) == sorted(["1", "1", "None", "2", "3", "4", "5", "6"])


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(name, no_docs, benchmark, labels):
    assert operators(benchmark, labels)[name](no_docs).collect() == []


def test_filters_keep_columns_and_rows(odd_docs, no_docs, benchmark, labels):
    kept = decontamination.clean(odd_docs, benchmark)
    # the seven words are in three rows (the one of eight words has a window of seven), the item without an id in one
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.select("doc_id").collect()) == ["2", "3", "4", "5"]
    assert decontamination.clean(no_docs, benchmark).collect() == []
    one = simhash_dedup.one_of_each(odd_docs)
    assert one.columns == odd_docs.columns
    # the repeated row goes; null, empty and blank texts are one group
    assert sorted(str(r.doc_id) for r in one.select("doc_id").collect()) == ["1", "2", "5", "6", "None"]
    assert quality.accepted(odd_docs, labels).columns == odd_docs.columns
    assert quality.accepted(no_docs, labels).collect() == []


def test_findings(odd_docs, no_docs, benchmark, spark):
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(odd_docs, benchmark).collect()}
    assert found == {(1, 0), (None, 0), (6, None)}
    assert decontamination.contaminated(no_docs, benchmark).collect() == []
    assert decontamination.contaminated(odd_docs, benchmark.where("false")).collect() == []


def test_defined_results(odd_docs):
    words = {r.doc_id: r for r in substring_dedup.remove_repeats(odd_docs).collect()}
    assert words[5].n_removed == words[5].n_words == 30000 and words[5].kept == ""
    assert words[2].n_words == words[3].n_words == words[4].n_words == 0
    data = {r.doc_id: r for r in suffix_dedup.remove_later_copies(odd_docs).collect()}
    # the first window stays, all that follow repeat it
    assert data[5].n_bytes == 150000 and bytes(data[5].kept) == (b"word " * 30000)[:104][: data[5].n_bytes - data[5].n_removed]
    prints = simhash_dedup.simhash_components(odd_docs).where("doc_id in (2, 3, 4)").select("fingerprint", "component_id").distinct().collect()
    assert [tuple(r) for r in prints] == [("0" * 16, 2)]


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, []), (9, [1.0, 0.0, 0.0]), (None, [0.0, 1.0]), (10, [1e200, 1e190])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit(1)).withColumn("v", F.lit("x"))
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embedding_dedup.embedding_components(df).collect())
    want = [("1", 3, "1", True), ("2", 3, "1", False), ("2", 3, "1", False), ("10", 3, "1", False), *((str(i), 0, str(i), True) for i in (3, 4, 5, 6, 7, 8, 9)), ("None", 0, "None", True)]
    assert got == sorted(want)
    assert embedding_dedup.embedding_components(df.where("false")).collect() == []


def test_short_items_in_long_documents(spark, tmp_path):
    items = [(1, "red"), (2, "blue fox"), (3, "a b c"), (4, "p q r s"), (5, "x y"), (6, "one two three four five six"), (7, "fox")]
    texts = ["w0 w1 a b c w2 w3 a b c w4", "w0 w1 w2 w3 p q r s", "blue fox w1 w2 w3 w4 w5 blue fox", "u v w red", "x", "y x x\ny", "blue w fox w w", "one two three four five six"]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.item_id, r.start_word, r.n_words, r.distance, r.similarity) for r in decontamination.op8_benchmark_decontamination(spark, str(tmp_path)).collect()}
    words, want = [t.split() for t in texts], set()
    for i, t in items:
        n = len(t.split())
        for d, w in enumerate(words):
            at = [p for p in range(len(w) - n + 1) if w[p : p + n] == t.split()]
            want |= {(d, i, at[0], n, 0, 1.0)} if at else set()
    assert len(want) == 8 and got == want
    kept = corpus_pipeline.decontamination_stage(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {4}


def test_clashing_columns_of_labels_and_benchmark(spark, odd_docs, labels, benchmark):
    """Columns that the operators use inside, in the second table."""
    more = labels.selectExpr("*", *(f"cast(null as long) as {c}" for c in ("id", "y", "_id", "_y", "_doc", "f", "text", "score")))
    assert toxicity.toxicity_scores(odd_docs, more).count() == 8 and quality.quality_scores(odd_docs, more).count() == 8
    items = benchmark.selectExpr("*", *(f"cast(null as long) as {c}" for c in ("item", "n", "fp", "data", "h", "at", "uid")))
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(odd_docs, items).collect()} == {(1, 0), (None, 0), (6, None)}


def test_no_labels_and_no_items(odd_docs, labels, benchmark):
    for rows in (toxicity.toxicity_scores(odd_docs, labels.where("false")), quality.quality_scores(odd_docs, labels.where("false"))):
        assert {r.score for r in rows.collect()} == {0.5}
    assert decontamination.clean(odd_docs, benchmark.where("false")).count() == 8


LONG = ["x" * 1_500_000, " ".join(f"w{i}" for i in range(120_000)), "tail words"]


@pytest.mark.parametrize("name", NAMES)
def test_long_word_and_many_words(name, write_docs, benchmark, labels):
    """A word of over a megabyte, and a megabyte of different words."""
    rows = operators(benchmark, labels)[name](write_docs(LONG)).collect()
    assert sorted(r.doc_id for r in rows) == [0, 1, 2]
    by = {r.doc_id: r for r in rows}
    if name == "suffix":
        # all windows but the first repeat it, and cover all bytes but the first
        assert (by[0].n_bytes, by[0].n_removed, bytes(by[0].kept)) == (1_500_000, 1_499_999, b"x")
    if name == "substring":
        assert by[1].n_words == 120_000 and by[1].n_removed == 0 and by[0].n_words == 1
    if name == "mixing":
        assert by[1].size == 120_000 and by[0].size == 1


@pytest.fixture(scope="module")
def odd_dir(tmp_path_factory, odd_docs, no_docs, labels, benchmark):
    """Odd and empty tables in files, as the pipeline reads them."""
    out = {}
    for kind, docs in (("odd", odd_docs), ("empty", no_docs)):
        path = str(tmp_path_factory.mktemp(kind))
        docs.write.parquet(f"{path}/documents.parquet")
        labels.write.parquet(f"{path}/labels.parquet")
        benchmark.write.parquet(f"{path}/benchmark.parquet")
        out[kind] = path
    return out


def test_pipeline_on_odd_and_empty_tables(spark, odd_dir, odd_docs):
    assert corpus_pipeline.run(spark, odd_dir["empty"]).collect() == []
    docs = spark.read.parquet(f"{odd_dir['odd']}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, odd_dir["odd"])
        assert out.count() <= 8, name
        if name != "mixing":
            assert out.columns == odd_docs.columns, name
    rows = corpus_pipeline.run(spark, odd_dir["odd"])
    assert rows.count() <= 8 and {"taken", "first_slot", "n_slots"} <= set(rows.columns)


def test_megabyte_texts_in_stages(spark, write_docs, labels, benchmark, tmp_path):
    """A word of over a megabyte, a megabyte of words, and an item in the middle of one, through what the stages call."""
    hit = " ".join([LONG[1], "one two three four five six seven", LONG[1][::-1]])
    docs = write_docs([*LONG, hit])
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, benchmark).collect()} == {(3, 0)}
    assert sorted(r.doc_id for r in decontamination.clean(docs, benchmark).collect()) == [0, 1, 2]
    assert sorted(r.doc_id for r in simhash_dedup.one_of_each(docs).collect()) == [0, 1, 2, 3]
    assert quality.accepted(docs, labels.where("false")).count() == 4 and mixing.mixed(docs).count() == 4
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {0, 1, 2}


def test_mixing_is_several_small_plans(write_docs):
    """The driver holds one plan at a time; sums of groups, slots and uses in one plan took 32 exchanges."""
    docs = write_docs(["word " * (i % 50) for i in range(300)], [f"s{i % 4}" for i in range(300)])
    for df in (mixing.mix(docs), mixing.mixed(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") < 8
