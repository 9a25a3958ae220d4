import pytest
from pyspark.sql import types as T

ODD = [
    (1, "one two three four five six seven", "en", "a", 1),
    (1, "one two three four five six seven", "en", "a", 1),
    (None, "one two three four five six seven eight", "en", None, 2),
    (2, None, None, "b", None),
    (3, "", "en", "b", 0),
    (4, " \n\t ", "en", "b", 3),
    (5, "word " * 30000, "en", "a", 9),
    (6, "zß東京🙂 ünïcode  double  spaces\n\nlines", "de", "c", 5),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with names that the operators use inside.
CLASHING = "_uid long, id long, fp long, part int, bucket int, row string, at long, score double, size long, taken long, kind int, value double, found string"


@pytest.fixture(scope="session")
def odd_docs(spark, tmp_path_factory):
    """Nulls, repeated rows, empty, blank and very long texts, and clashing extra columns, as files."""
    path = str(tmp_path_factory.mktemp("odd") / "docs")
    extra = [f.strip() for f in CLASHING.split(",")]
    df = spark.createDataFrame(ODD, COLUMNS)
    for f in extra:
        name, kind = f.split()
        df = df.selectExpr("*", f"cast(null as {kind}) as {name}")
    df.coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 7)] + [(None, 1, 0), (2, None, None)], T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "quality", "toxic")]))


@pytest.fixture(scope="session")
def write_docs(spark, tmp_path_factory):
    """Texts as a table of documents in files, numbered from 0."""

    def write(texts, sources=None):
        path = str(tmp_path_factory.mktemp("docs") / "d")
        rows = [(i, t, "en", sources[i] if sources else "s", len(t or "")) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return write
