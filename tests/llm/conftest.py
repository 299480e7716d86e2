import pytest
from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture
def make(spark):
    """Documents from (id, text) pairs, with columns whose names clash with the operators' own."""

    def of(rows):
        df = spark.createDataFrame(list(rows), "doc_id long, text string")
        clash = {c: F.lit(1) for c in ("id", "c", "n", "label", "cluster", "token", "shard", "keep", "item", "h", "votes", "spans", "bucket")}
        return df.withColumns(clash)

    return of


@pytest.fixture
def documents(spark, tmp_path):
    """Writes (id, text) pairs as a table folder and returns its path."""

    def of(rows):
        spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return of
