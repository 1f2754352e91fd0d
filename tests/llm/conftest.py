import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: extra columns with names that the operators use themselves
CLASH = ("id", "row", "key", "kept", "__key", "__f", "budget")
SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()),
                     StructField("lang", StringType()), StructField("source", StringType()),
                     *[StructField(c, StringType()) for c in CLASH]])
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
BASE = " ".join(f"Word{i}" for i in range(120))
NEAR = BASE.replace("Word60 ", "other ")


def messy_rows():
    x = ("x",) * len(CLASH)
    return [
        (1, BASE, "en", "src0", *x), (2, BASE.upper(), "en", "src0", *x), (3, NEAR, "en", "src0", *x),
        (4, None, None, None, *(None,) * len(CLASH)), (5, "", "de", "src1", *x), (6, " \n\t ", "de", "src1", *x),
        (7, LONG, "fr", "src2", *x), (8, LONG + " end", "fr", "src2", *x), (9, "two words", "en", "src0", *x),
        (10, "two words", "en", "src0", *x), (None, BASE, "en", "src0", *x), (11, NEAR, "en", "src0", *x),
        (11, NEAR, "en", "src0", *x), (12, "Ünï çödé   line\nline\nline", "es", "src3", *x),
        (13, " ".join(f"lone{i}" for i in range(80)) + "\n" + " ".join(f"Word{i}" for i in range(20, 50)), "es", None, *x),
    ]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
