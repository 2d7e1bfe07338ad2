import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """Documents from texts or (text, lang, source) tuples; ids count from 0 unless given."""

    def make(rows, extra=""):
        full = []
        for i, r in enumerate(rows):
            if not isinstance(r, tuple):
                r = (i, r, "en", f"src{i % 3}")
            full.append((*r[:4], len(r[1]) if r[1] else 0, *r[4:]))
        return spark.createDataFrame(full, DOCS + extra)

    return make
