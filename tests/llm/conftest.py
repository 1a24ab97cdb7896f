import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def spark():
    from affinity.session import build_session
    s = build_session("local[4]", shuffle_partitions=4, app_name="llm-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make(spark):
    def build(rows, schema, extra=True, parts=3):
        """A DataFrame of the rows with extra columns whose names may clash with internal ones."""
        df = spark.createDataFrame(rows, schema)
        if extra:
            for name in ("key", "n", "name", "part", "block", "_x", "copy_no", "_parts", "_source", "_lead_id", "_lead_name", "_own_name", "_hit_id",
                         "_own_k1", "_score", "_row", "_id", "_text", "_w", "place2"):
                if name not in df.columns:
                    df = df.selectExpr("*", f"'x' AS `{name}`")
        return df.repartition(parts)
    return build
