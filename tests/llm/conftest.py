import pytest
from samples import ODD

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double, root string, bucket string"


def rows(texts, lang="en"):
    return [(i, t, lang, "s", None if t is None else len(t), 7, 0.5, "r", "b") for i, t in texts]


@pytest.fixture(scope="session")
def make(spark):
    """Documents with columns whose names clash with those that operators use inside."""
    return lambda texts, lang="en": spark.createDataFrame(rows(texts, lang), SCHEMA)


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD)


@pytest.fixture(scope="session")
def none(make):
    return make([])
