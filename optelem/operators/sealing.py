"""Column encryption with AES-256-GCM: seal, open, rotate.

A keyring is a table (kid, key binary(32), created_at, is_active). It is joined, so keys never
appear as literals in a plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optelem.plans.digests import framed
from optelem.plans.lookups import lookup_side, settle

# fixed values: envelope version, algorithm names and fields
ENVELOPE_VERSION = 1
ALGORITHM, ENCRYPTION = "dir", "A256GCM"
HEADER = ("v", "kid", "alg", "enc", "ctx", "sender", "iat", "jti")
MODES = ("required", "optional", "disabled")


def base64url(blob: Column) -> Column:
    return F.regexp_replace(F.translate(F.base64(blob), "+/", "-_"), "[=\r\n]", "")


def from_base64url(text: Column) -> Column:
    return F.unbase64(F.translate(text, "-_", "+/"))


def active_key(keyring: DataFrame) -> DataFrame:
    """The newest active key; sealing without one fails."""
    active = keyring.where("is_active").orderBy(F.desc("created_at"), F.asc("kid")).limit(1).select("kid", "key")
    if active.count() != 1:
        raise ValueError("no active key in the keyring")
    return active


def _sealed(headed: DataFrame, keyring: DataFrame, body: Column) -> DataFrame:
    """Encrypt `body` under the active key; `headed` carries the header fields except kid."""
    key = F.broadcast(active_key(keyring).withColumn("_seal", F.lit(ENVELOPE_VERSION)))  # one row, see active_key
    keyed = headed.withColumn("_body", body).join(key, F.col("v") == F.col("_seal"))
    blob = F.call_function("aes_encrypt", F.col("_body").cast("binary"), F.col("key"), F.lit("GCM"), F.lit("DEFAULT"),
                           F.lit("").cast("binary"), framed(*HEADER).cast("binary"))
    return (keyed.withColumn("_blob", blob).withColumn("nonce", base64url(F.substring("_blob", 1, 12)))
            .withColumn("ciphertext", base64url(F.expr("substring(_blob, 13)"))).drop("_seal", "_blob", "_body", "key"))


def seal_columns(df: DataFrame, keyring: DataFrame, payload: Sequence[str], ctx: str, sender: str, identity: Sequence[str] = ("tenant_id", "event_id"),
                 issued_at: Column | None = None) -> DataFrame:
    """Replace `payload` by an envelope: v, kid, alg, enc, ctx, sender, iat, jti, nonce, ciphertext.

    All but the last two are authenticated. `jti` is a hash of `ctx` and the columns that identify the event, `iat`
    the time in epoch seconds (now, or `issued_at`). Spark draws a fresh 96-bit nonce per row and puts it in front of the ciphertext. The result
    differs on every evaluation: write it before reading it twice.
    """
    issued = F.unix_timestamp(F.current_timestamp()) if issued_at is None else issued_at.cast("long")
    headed = (df.withColumn("v", F.lit(ENVELOPE_VERSION)).withColumn("alg", F.lit(ALGORITHM)).withColumn("enc", F.lit(ENCRYPTION))
              .withColumn("ctx", F.lit(ctx)).withColumn("sender", F.lit(sender)).withColumn("iat", issued)
              .withColumn("jti", F.sha2(framed("ctx", *identity), 256)))
    rest = [c for c in df.columns if c not in payload]
    return _sealed(headed, keyring, F.to_json(F.struct(*payload))).select(*rest, *HEADER, "nonce", "ciphertext")


def _judged(envelopes: DataFrame, keyring: DataFrame, mode: str, plain: str) -> DataFrame:
    """Envelopes with `_body` (the opened JSON) and `reason`."""
    if mode not in MODES:
        raise ValueError(f"mode {mode} is none of {MODES}")
    given = F.col(plain) if plain in envelopes.columns else F.lit(None).cast("string")
    if mode == "disabled":
        return envelopes.withColumn("_body", given).withColumn("reason", F.when(F.col("_body").isNull(), F.lit("no_plaintext")))
    keys = lookup_side(keyring.select("kid", "key"))
    blob = F.concat(from_base64url(F.col("nonce")), from_base64url(F.col("ciphertext")))
    opened = F.call_function("try_aes_decrypt", blob, F.col("key"), F.lit("GCM"), F.lit("DEFAULT"), framed(*HEADER).cast("binary")).cast("string")
    sealed = F.col("ciphertext").isNotNull()
    without = F.lit("plaintext_refused") if mode == "required" else F.when(given.isNull(), F.lit("no_plaintext"))
    body = F.when(sealed, opened) if mode == "required" else F.when(sealed, opened).otherwise(given)
    judged = envelopes.join(keys, "kid", "left").withColumn("_body", body)
    reason = (F.when(~sealed, without).when(F.col("key").isNull(), F.lit("unknown_kid"))
              .when(F.col("_body").isNull(), F.lit("not_authentic")))
    return judged.withColumn("reason", reason).drop("key")


def open_columns(envelopes: DataFrame, keyring: DataFrame, schema: str, mode: str = "required", plain: str = "plain") -> tuple[DataFrame, DataFrame]:
    """(opened rows, rejects with `reason`).

    mode `required` refuses rows without an envelope, `optional` also takes the JSON of column
    `plain`, `disabled` takes only that.
    """
    judged = _judged(envelopes, keyring, mode, plain).withColumn("_payload", F.from_json("_body", schema))
    keep = [c for c in envelopes.columns if c not in (*HEADER, "nonce", "ciphertext", plain)]
    good = judged.where(F.col("reason").isNull()).select(*keep, "jti", "_payload.*")
    bad = judged.where(F.col("reason").isNotNull()).select(*envelopes.columns, "reason")
    return good, bad


def keys_due(keyring: DataFrame, as_of: str, max_age_days: int = 30) -> DataFrame:
    """Active data keys at or past their age limit."""
    age = F.datediff(F.lit(as_of).cast("timestamp_ntz").cast("date"), F.to_date("created_at"))
    return keyring.where("is_active").select("kid", age.alias("age_days")).where(F.col("age_days") >= max_age_days)


def rotate_keys(envelopes: DataFrame, keyring: DataFrame, old_kids: Sequence[str]) -> DataFrame:
    """Re-seal the rows of `old_kids` under the active key; only they are written. Rows that do not open, or old keys left over, raise."""
    old = F.col("kid").isin(*old_kids)
    judged = _judged(envelopes.where(old), keyring, "required", "plain")
    if judged.where(F.col("reason").isNotNull()).limit(1).count():
        raise RuntimeError("some rows of the old keys do not open; nothing was rotated")
    renewed = _sealed(judged.drop("kid", "nonce", "ciphertext").withColumnRenamed("_body", "_open"), keyring, F.col("_open"))
    renewed = settle(renewed.select(*envelopes.columns))  # each evaluation would draw other nonces
    if renewed.where(old).limit(1).count():
        raise RuntimeError("rows under a retired key are left")
    return envelopes.where(~F.coalesce(old, F.lit(False))).unionByName(renewed)
