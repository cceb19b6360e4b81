import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> list[str]:
    """Pseudo-random words."""
    import random

    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n)]


@pytest.fixture
def docs_of(spark):
    """A documents table of (doc_id, text) rows, with extra columns whose names clash with inner ones."""

    def make(rows, extra=True):
        full = [(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(full, DOC)
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumns({"d": F.lit(1), "pos": F.lit("x"), "label": F.lit(2.0), "spans": F.lit("s")})
        return df.repartition(3)

    return make
