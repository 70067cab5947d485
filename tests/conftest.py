import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="matloom-tests-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def ws(spark):
    from matloom import Workspace

    return Workspace(spark)


def matrix(spark, rows, **kw):
    """A SparseMatrix from a list of lists; zeros are not stored."""
    from matloom import SparseMatrix

    cells = [(i, j, float(v)) for i, row in enumerate(rows) for j, v in enumerate(row) if v]
    return SparseMatrix(
        spark.createDataFrame(cells, "i long, j long, v double"), len(rows), len(rows[0]), **kw
    )


def vector(spark, values):
    from matloom import Vector

    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, v double")
    return Vector(df, len(values))


def dense(m):
    """A numpy array from a SparseMatrix or DenseMatrix."""
    import numpy as np

    out = np.zeros((m.nrows, m.ncols))
    for r in m.df.collect():
        out[r["i"], r["j"]] += r["v"]
    return out


def values(x):
    return [r["v"] for r in x.df.orderBy("i").collect()]
