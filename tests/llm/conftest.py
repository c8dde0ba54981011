import pytest

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 997}x{i % 13}" for i in range(60_000))
# names that operators use themselves stand among the columns of these rows
ODD = ("doc_id bigint, text string, lang string, source string, n_chars bigint, node string, "
       "score double, length int, part int, rid bigint, th int, n bigint")


def odd_rows():
    said = "The house by the lake is old, and the road to it is long. " * 6
    rows = [(1, said, "en"), (2, None, None), (3, "", "en"), (None, said + "And more.", "en"),
            (4, "!!! ...", None), (5, "one", "en"), (6, LONG, "en"), (1, said, "en"),
            (1, "another text with the same id", "en"), (7, "été où ça, ﬁn 😀 \u0000 x", "fr"),
            (8, said.upper(), "en"), (9, "a b c d", "de")]
    return [(i, t, lang, "s", None if t is None else len(t), "n", 0.5, 7, 3, 9, 1, 2)
            for i, t, lang in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], ODD)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
