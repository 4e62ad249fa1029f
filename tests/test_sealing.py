import os

import pytest
from pyspark.sql import functions as F

from optelem.operators import sealing
from tests.conftest import rows

K1, K2 = bytes(range(32)), bytes(range(32, 64))
SCHEMA = "email string, amount double"


def ring(spark, *keys):
    return spark.createDataFrame(list(keys), "kid string, key binary, created_at string, is_active boolean").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@pytest.fixture
def keyring(spark):
    return ring(spark, ("k1", K1, "2024-01-01 00:00:00", True))


@pytest.fixture
def sealed(spark, keyring, tmp_path):
    df = spark.createDataFrame([(1, "t", "a@x.org", 1.5), (2, "t", None, 2.5), (3, "u", "ü", None)], "event_id long, tenant_id string, email string, amount double")
    sealing.seal_columns(df, keyring, ["email", "amount"], "store", "sensor").write.parquet(str(tmp_path / "sealed"))
    return spark.read.parquet(str(tmp_path / "sealed"))


def test_round_trip(sealed, keyring):
    good, bad = sealing.open_columns(sealed, keyring, SCHEMA)
    assert rows(good, "event_id", "email", "amount") == [(1, "a@x.org", 1.5), (2, None, 2.5), (3, "ü", None)] and bad.count() == 0
    assert sealed.select("nonce").distinct().count() == 3
    assert "email" not in sealed.columns


def test_keys_are_no_plan_literals(sealed, keyring, spark, tmp_path):
    keyring.write.parquet(str(tmp_path / "ring"))
    good, _ = sealing.open_columns(sealed, spark.read.parquet(str(tmp_path / "ring")), SCHEMA)
    assert K1.hex().upper() not in good._jdf.queryExecution().toString().upper()


def test_tampering_and_unknown_kid(sealed, keyring):
    changed = (sealed.withColumn("ctx", F.when(F.col("event_id") == 1, "elsewhere").otherwise(F.col("ctx")))
               .withColumn("kid", F.when(F.col("event_id") == 2, "k9").otherwise(F.col("kid")))
               .withColumn("ciphertext", F.when(F.col("event_id") == 3, F.substring("ciphertext", 1, 8)).otherwise(F.col("ciphertext"))))
    good, bad = sealing.open_columns(changed, keyring, SCHEMA)
    assert good.count() == 0 and rows(bad, "event_id", "reason") == [(1, "not_authentic"), (2, "unknown_kid"), (3, "not_authentic")]


def test_header_fields_cannot_trade_text(spark, keyring, tmp_path):
    df = spark.createDataFrame([(1, "t|a", "x"), (1, "t", "x"), (1, None, "x")], "event_id long, tenant_id string, email string")
    sealing.seal_columns(df, keyring, ["email"], "store", "sensor").write.parquet(str(tmp_path / "s"))
    sealed = spark.read.parquet(str(tmp_path / "s"))
    assert sealed.select("jti").distinct().count() == 3
    assert sealed.columns == ["event_id", "tenant_id", *sealing.HEADER, "nonce", "ciphertext"]
    assert all(set(r["nonce"] + r["ciphertext"]) <= set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_") and r["iat"] > 1_700_000_000 for r in sealed.collect())
    swapped = sealed.withColumn("ctx", F.lit("storesen")).withColumn("sender", F.lit("sor"))
    assert sealing.open_columns(swapped, keyring, "email string")[0].count() == 0
    assert sealing.open_columns(sealed, keyring, "email string")[0].count() == 3


def test_modes(sealed, keyring):
    mixed = sealed.withColumn("plain", F.when(F.col("event_id") > 1, '{"email":"p","amount":1.0}')).withColumn(
        "ciphertext", F.when(F.col("event_id") < 3, F.col("ciphertext")))
    assert rows(sealing.open_columns(mixed, keyring, SCHEMA)[1], "event_id", "reason") == [(3, "plaintext_refused")]
    assert rows(sealing.open_columns(mixed, keyring, SCHEMA, "optional")[0], "event_id", "email") == [(1, "a@x.org"), (2, None), (3, "p")]
    good, bad = sealing.open_columns(mixed, keyring, SCHEMA, "disabled")
    assert rows(good, "event_id", "email") == [(2, "p"), (3, "p")] and rows(bad, "event_id", "reason") == [(1, "no_plaintext")]
    with pytest.raises(ValueError):
        sealing.open_columns(mixed, keyring, SCHEMA, "maybe")


def test_no_active_key(sealed, spark):
    with pytest.raises(ValueError):
        sealing.active_key(ring(spark, ("k1", K1, "2024-01-01 00:00:00", False)))


def test_rotation(sealed, spark):
    both = ring(spark, ("k1", K1, "2024-01-01 00:00:00", False), ("k2", K2, "2024-03-01 00:00:00", True))
    out = sealing.rotate_keys(sealed, both, ["k1"])
    assert rows(out, "kid") == [("k2",)] * 3
    only_new = both.where("kid = 'k2'")
    assert rows(sealing.open_columns(out, only_new, SCHEMA)[0], "event_id", "email", "amount") == [(1, "a@x.org", 1.5), (2, None, 2.5), (3, "ü", None)]
    broken = sealed.withColumn("jti", F.lit("x"))
    with pytest.raises(RuntimeError):
        sealing.rotate_keys(broken, both, ["k1"])


def test_due(spark):
    keys = ring(spark, ("a", os.urandom(32), "2024-01-01 00:00:00", True), ("b", os.urandom(32), "2024-01-02 00:00:00", True), ("c", os.urandom(32), "2023-01-01 00:00:00", False))
    assert rows(sealing.keys_due(keys, "2024-01-31 00:00:00")) == [("a", 30)]
