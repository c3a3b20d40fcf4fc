import public_tokenizers
import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, bands string, queue string, score double"


@pytest.fixture(scope="session")
def make(spark):
    """Documents of texts, with columns whose names clash with those the operators make."""

    def build(texts, ids=None, langs=None, sources=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, (langs or {}).get(i, "en"), (sources or {}).get(i, "s"), len(t or ""), "n", "b", "q", 0.5) for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(rows, SCHEMA)

    return build


@pytest.fixture(scope="session")
def vocabulary():
    return public_tokenizers.path
