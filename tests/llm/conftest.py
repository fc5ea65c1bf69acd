import random

import pytest
from pyspark.sql import functions as F

WORDS = "river stone amber quiet lantern meadow copper signal harvest winter orchard velvet thunder pebble garden compass".split()
#: Columns that carry the names operators use inside or return.
CLASHING = ("_id", "_text", "_key", "_row", "kept", "node", "bucket", "n", "spans", "component_id", "keep_id", "host_", "run")


def prose(seed: int, n: int, extra: int = 0) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(extra)) if extra else "") for _ in range(n))


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table (doc_id, text and columns with clashing names) of some rows, in several partitions."""

    def make(rows, id_col="doc_id", text_col="text"):
        df = spark.createDataFrame([(i, t) for i, t in rows], f"{id_col} long, {text_col} string").repartition(3)
        return df.select("*", *[F.lit("x").alias(c) for c in CLASHING])

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and blank texts, repeated rows, an id used twice, a very long text."""
    long_text = prose(1, 30_000, 50)
    return [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "one"), (5, prose(2, 40)), (None, prose(2, 40)), (None, None), (6, "Ünï▁ ✓ \U0001f600 " * 4), (7, long_text), (8, long_text)]
