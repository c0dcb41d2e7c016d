import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sylvan.session import local_session

    session = local_session("tests", cores="4", partitions=4, memory="4g")
    session.sparkContext.setLogLevel("OFF")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(f"file://{tmp_path_factory.mktemp('shared')}")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def oracle():
    """compare(df, sql, sf): both sides equal as sorted rows of sorted columns."""
    import glob

    import duckdb
    import pandas as pd

    def compare(df, sql, sf="sf0.001"):
        con = duckdb.connect()
        for p in glob.glob(f"/root/testdata/{sf}/*.parquet"):
            con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
        ours, theirs = df.toPandas(), con.sql(sql).df()
        columns = sorted(ours.columns)
        assert columns == sorted(theirs.columns)

        def rows(d):
            def plain(v):
                if v is None or v is pd.NA or v != v:
                    return None
                return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

            return sorted(repr(tuple(plain(v) for v in r)) for r in d[columns].astype(object).itertuples(index=False, name=None))

        assert rows(ours) == rows(theirs)
        return ours

    return compare
