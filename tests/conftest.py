import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from siltscope.session import local_spark  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_spark(4, shuffle_partitions=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def sf():
    return SF


def rows(df, *cols):
    """Rows as sorted tuples."""
    df = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def files(spark):
    def make(*items, repo="r"):
        data = [(repo, p, c) if not isinstance(p, tuple) else (*p, c) for p, c in items]
        return spark.createDataFrame(data, "repo_id string, path string, content string")

    return make
