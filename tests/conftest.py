import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from optelem.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("local[8]", "optelem-tests", **{
        "spark.sql.shuffle.partitions": "4",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    })
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SMALL


def rows(df, *columns):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def events(spark, data):
    """(tenant_id, service_id, user_id, event_id, 'yyyy-mm-dd hh:mm:ss', status_code, latency_ms) as telemetry."""
    df = spark.createDataFrame(data, "tenant_id string, service_id string, user_id long, event_id long, at string, status_code int, latency_ms double")
    return df.selectExpr("tenant_id", "service_id", "user_id", "event_id", "CAST(at AS timestamp_ntz) AS event_time", "status_code", "latency_ms")
