import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    def make(*rows, schema=DOCUMENT, defaults=("en", "src0", 0)):
        """Rows are texts, or tuples whose missing columns take the defaults."""
        full = []
        for i, row in enumerate(rows):
            row = row if isinstance(row, tuple) else (i, row)
            full.append((*row, *defaults[len(row) - 2 :]))
        return spark.createDataFrame(full, schema)

    return make
