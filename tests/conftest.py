import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from equigroup.session import get_spark
    s = get_spark("local[4]", app="equigroup-tests", shuffle_partitions=4,
                  extra={"spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_small():
    if not os.path.isdir(SF_SMALL):
        pytest.skip("test tables not available")
    return SF_SMALL


def matrix_df(spark, names, m):
    rows = [(names[i], names[j], float(m[i][j])) for i in range(len(names)) for j in range(i + 1, len(names))]
    return spark.createDataFrame([(min(a, b), max(a, b), v) for a, b, v in rows],
                                 "fi string, fj string, dissimilarity double")


EXAMPLE_NAMES = ["A", "B", "C", "D"]
EXAMPLE = [[0, 0.2, 0.9, 0.8], [0.2, 0, 0.85, 0.75], [0.9, 0.85, 0, 0.1], [0.8, 0.75, 0.1, 0]]
