import pytest

from pyspark.sql import types as T

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    """n words that depend on the seed alone."""
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def edge_rows():
    """Null, empty, blank, very long, repeated and tied texts, with other scripts and markers."""
    long_text = prose(1, 20_000)
    shared = prose(2, 60)
    near = shared.split()
    near[30] = "changed"
    return [
        (1, None), (2, ""), (3, "   \t "), (4, "one"), (5, "one two"), (6, "One  two\nthree"), (7, long_text), (8, long_text),
        (9, shared), (9, shared), (10, " ".join(near)), (11, prose(3, 30) + "\n" + shared), (12, "x" * 3000),
        (13, "<|endoftext|> a<|endoftext|>b"), (14, "été naïve 東京 \U0001F600 ok   x\r\n\r\n\tz"),
        (15, "\n\n\n"), (16, prose(4, 9)), (17, prose(4, 9)), (18, "\x00\x01 \x1c \x85 ctl"), (19, "'s 're don't 12345 ===="),
        (None, "text without id " + prose(5, 20)),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """The edge rows with columns whose names the operators use themselves."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
                          + [T.StructField(c, T.StringType()) for c in ("lang", "id", "list", "h", "key", "row", "kept", "n_tokens", "score")])
    return spark.createDataFrame([(*r, "en" if r[0] and r[0] % 2 else None, *"abcdefgh") for r in edge_rows()], schema)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def sample_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
