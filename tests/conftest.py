import os
import sys
from pathlib import Path

import pytest

os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
os.environ.setdefault("TZ", "UTC")
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from lodestack.session import build

    session = build("tests", "4", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SOURCE = "struct<relative:string,repo:string,package:string,path:string,size:bigint,sha256:string>"


@pytest.fixture(scope="session")
def programs(spark):
    """Builds program reports from (report_id, relative, sha256, soname, needed, arrived_at[, analyzed_at])."""

    def make(rows):
        data = [(r[0], None if r[1] is None and r[2] is None else (r[1], None, None, None, 70000, r[2]), r[3], r[4], r[5], r[6] if len(r) > 6 else r[5], "x") for r in rows]
        ddl = f"report_id bigint, source {SOURCE}, soname string, needed array<string>, arrived_at timestamp_ntz, analyzed_at timestamp_ntz, key string"
        return spark.createDataFrame(data, ddl)

    return make
