import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera.session import session

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    spark = session(4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, (np.ndarray, list, tuple)):
        return [plain(v) for v in value]
    if value is None or value is pd.NaT or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, np.generic):
        return plain(value.item())
    return str(pd.Timestamp(value)) if hasattr(value, "isoformat") else value


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(repr([plain(v) for v in r]) for r in frame[columns].astype(object).values.tolist())
