import sys
from pathlib import Path

import pandas as pd
import pytest

HERE = Path(__file__).resolve().parent
for folder in (HERE.parent, HERE):
    if str(folder) not in sys.path:
        sys.path.insert(0, str(folder))

from helpers import walk  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from tickloom.session import build_session

    session = build_session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame():
    """Two symbols of different length, interleaved and shuffled."""
    both = pd.concat([walk(900, 1, "AAA"), walk(400, 2, "BBB")])
    return both.sample(frac=1, random_state=3).reset_index(drop=True)


@pytest.fixture(scope="session")
def bars(spark, frame):
    return spark.createDataFrame(frame).persist()
