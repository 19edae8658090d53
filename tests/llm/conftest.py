import pytest
from pyspark.sql import functions as F

from shellsieve.llm.storage import ship_package

CLASHES = (
    "fp root component_id least key choice q part kept n_words spans score predicted label matches found "
    "rate copies n_tokens posterior shard slot lost a b id v size block ask rank n last _a _b _n __a __b __n"
).split()


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def edge_rows():
    """Null ids and texts, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 997}x{i % 89}" for i in range(60_000))
    shared = "one shared line of more than twenty signs"
    return [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, long), (5, long), (6, f"{shared}\nown a"), (7, f"{shared}\nown b"),
        (8, shared.upper()), (8, shared.upper()), (9, "x"), (None, f"{shared}\nown c"), (None, None), (10, "été ß ＡＢ 😀 fin"),
    ]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    """The edge rows with extra columns named like those that the operators make."""
    frame = spark.createDataFrame(edge_rows, "doc_id long, text string")
    return frame.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)
