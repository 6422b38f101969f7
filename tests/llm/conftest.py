import pytest

#: Columns whose names the operators use inside.
CLASHING = "hits array<int>, items string, n_words string, node int, fp int, bucket int, draws int, found int, base int, lang_pred int, tox_score int, c0 string, host int, `a.b` string"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text, ...) rows, with columns that could clash."""

    def make(rows, kind="doc_id long, text string, lang string, source string", clash=False):
        width = kind.count(",") + 1
        filled = [tuple(r) + (None,) * (width - len(r)) for r in rows]
        if clash:
            return spark.createDataFrame([r + (None,) * (CLASHING.count(",") + 1) for r in filled], f"{kind}, {CLASHING}")
        return spark.createDataFrame(filled, kind)

    return make


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """A folder of Parquet tables, for the registered queries."""

    def make(**tables):
        path = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.write.parquet(f"{path}/{name}.parquet")
        return str(path)

    return make
