import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark():
    from corpusmill.session import local_session

    session = local_session("4", shuffle_partitions=4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def files(spark):
    """(path, content) pairs to a table of files."""
    from pyspark.sql import functions as F

    from corpusmill.sources.files import scan_table

    def build(*pairs):
        df = spark.createDataFrame(list(pairs), "p string, t string")
        return scan_table(df, "t", F.col("p"))

    return build
