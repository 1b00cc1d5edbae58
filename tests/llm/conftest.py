import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

ROOT = Path(__file__).resolve().parents[2]
for folder in (ROOT, ROOT / "tests", ROOT / "tests" / "llm"):
    if str(folder) not in sys.path:
        sys.path.insert(0, str(folder))

from odd_rows import ODD_TEXTS, SF  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with NULLs, empty, long and repeated texts, and extra columns whose names operators use themselves."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("token", T.StringType()), T.StructField("clean_text", T.StringType()), T.StructField("ids", T.LongType()), T.StructField("n", T.DoubleType())])
    return spark.createDataFrame([(k, t, None, None if k == 4 else "s", None, "k", "t", "c", 5, 0.5) for k, t in ODD_TEXTS], schema)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
