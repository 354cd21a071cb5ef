import pytest

from tidewright.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.maxMetadataStringLength", 10000)
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


def rows(df, *cols):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def ts(text):
    from pyspark.sql import functions as F

    return F.lit(text).cast("timestamp_ntz")
