"""The signed chain of custody: appending and verifying."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightlens.operators.places import by_number, previous

#: Fixed value: what the first entry of a chain is linked to.
GENESIS = "GENESIS_BLOCK_000000000000000000000000"
BLOCK = 64


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hex with Spark's own hash functions; the key comes from the caller's configuration."""
    padded = (hashlib.sha256(key).digest() if len(key) > BLOCK else key).ljust(BLOCK, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in padded)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def payload(case_id: Column, ts: Column, actor: Column, action: Column, details: Column, item: Column, previous: Column) -> Column:
    """What an entry's signature covers."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in (case_id, ts, actor, action, details, item, previous)])


def chain_append(entries: DataFrame, key: bytes) -> DataFrame:
    """entries with previous_hash and signature, chained per case in entry_id order.

    A signature needs the one before it, so a case is signed by one task, in one pass over
    its sorted rows that keeps the last signature alone; cases run in parallel, and however
    many entries a case has, none is gathered.
    """
    signed = payload(*[F.col(c) for c in ("case_id", "ts_raw", "actor", "action", "details", "evidence_item_id")], F.lit(""))
    rows = entries.select("case_id", "entry_id", "ts_raw", "actor", "action", "details", "evidence_item_id", signed.alias("signed"))
    rows = rows.repartition("case_id").sortWithinPartitions("case_id", "entry_id")

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        case, last = object(), GENESIS
        for batch in batches:
            before, own = [], []
            for of, text in zip(batch["case_id"].tolist(), batch["signed"], strict=True):
                if of != case:
                    case, last = of, GENESIS
                before.append(last)
                last = hmac.new(key, (text + last).encode(), hashlib.sha256).hexdigest()
                own.append(last)
            yield batch.drop(columns="signed").assign(previous_hash=before, signature=own)

    fields = [f for f in rows.schema.fields if f.name != "signed"]
    return rows.mapInPandas(sign, T.StructType([*fields, T.StructField("previous_hash", T.StringType()), T.StructField("signature", T.StringType())]))


def chain_check(custody: DataFrame, key: bytes) -> DataFrame:
    """custody with linked (the previous hash is the previous signature) and genuine (the signature is right), in parallel."""
    linked = previous(custody, F.struct("signature"), "_before", ["case_id"], {"_stretch": by_number(F.col("entry_id"))}, "entry_id")
    signed = hmac_sha256(payload(*[F.col(c) for c in ("case_id", "ts_raw", "actor", "action", "details", "evidence_item_id", "previous_hash")]), key)
    return linked.withColumn("expected_previous", F.coalesce("_before.signature", F.lit(GENESIS))).drop("_before").withColumns(
        {"linked": F.coalesce(F.col("previous_hash") == F.col("expected_previous"), F.lit(False)), "genuine": F.coalesce(F.col("signature") == signed, F.lit(False))}
    )


def chain_verify(custody: DataFrame, key: bytes) -> DataFrame:
    """Per case whether its chain holds, and the first entry that breaks it."""
    bad = ~F.col("linked") | ~F.col("genuine")
    text = F.when(
        ~F.col("linked"), F.concat(F.lit("Broken chain at entry #"), "entry_id", F.lit(": expected prev_hash "), "expected_previous", F.lit(", found "), F.coalesce("previous_hash", F.lit("nothing")))
    ).otherwise(F.concat(F.lit("Tampered entry #"), "entry_id", F.lit(": signature mismatch. Integrity compromised.")))
    return chain_check(custody, key).groupBy("case_id").agg(
        F.bool_and(~bad).alias("valid"), F.min_by(F.when(bad, text), F.when(bad, F.col("entry_id"))).alias("message"), F.count("*").alias("entries")
    )


def link_table(entries: DataFrame) -> DataFrame:
    """Unsigned links: each entry with a digest of its own fields and that of the entry before it."""
    own = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("case_id", "entry_id", "actor", "action", "details")]), 256)
    linked = previous(entries.withColumn("entry_hash", own), F.struct("entry_hash"), "_before", ["case_id"], {"_stretch": by_number(F.col("entry_id"))}, "entry_id")
    return linked.withColumn("previous_entry_hash", F.coalesce("_before.entry_hash", F.lit(GENESIS))).select("case_id", "entry_id", "entry_hash", "previous_entry_hash")
