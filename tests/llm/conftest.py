import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


#: Texts that any operator must take: null, empty, very long, repeated rows, ties, a null id.
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (6, "Straße ÉCOLE café 😀 x\x1cy\x85z"), (6, "Straße ÉCOLE café 😀 x\x1cy\x85z"),
    (7, "lorem ipsum dolor " * 3000), (8, "lorem ipsum dolor " * 3000 + "sit"), (None, "a null id"), (9, "a\x00b <|endoftext|> it's  I'll   tab\tend "), (10, "一二三 四五六 " * 40),
]


@pytest.fixture()
def odd(spark):
    """ODD with extra columns whose names operators may use themselves."""
    rows = [(i, t, "x", "y", 1) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, component string, n int")


@pytest.fixture()
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture()
def empty(odd):
    return odd.where("false")
