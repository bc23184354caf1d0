"""Run-once ledger and audit of rows that must not change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of keys whose digests are compared before any row is shuffled.
BUCKETS = 4096


def checksum(*columns: str) -> Column:
    """SHA-256 over the whole content; NULL and '' differ, and so do shifted borders."""
    if len(columns) == 1:
        return F.sha2(F.col(columns[0]).cast("string"), 256)
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def differing_buckets(now: DataFrame, then: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` of the keys among which two tables of ``key`` and ``checksum`` differ at all.

    Each side is read once. Rows become two hashes that are summed up per bucket, one side
    with a minus, so equal rows cancel out, repeated ones as often as they occur; a row or
    two per bucket and task is shuffled. Differing contents cancel by chance only (2**-128).
    Rows with a NULL key are left out.
    """

    def hashes(df: DataFrame, sign: int) -> DataFrame:
        whole = [(F.xxhash64(F.lit(seed), key, "checksum").cast("decimal(20,0)") * F.lit(sign)).alias(f"h{seed}") for seed in (1, 2)]
        return df.where(F.col(key).isNotNull()).select(_bucket(key, buckets).alias("bucket"), *whole)

    sums = hashes(now, 1).union(hashes(then, -1)).groupBy("bucket").agg(F.sum("h1").alias("h1"), F.sum("h2").alias("h2"))
    return sums.where("h1 != 0 OR h2 != 0").select("bucket")


def _unmatched(items: DataFrame, ledger: DataFrame, key: str, content: list[str], buckets: int) -> tuple[DataFrame, DataFrame]:
    """Item keys (not NULL) whose content is on no ledger row of the key, a row per item, and the ledger keys among which they may be."""
    # at most ``buckets`` numbers, whatever the tables' sizes
    now, then = ledger_rows(items, key, content), ledger.select(key, "checksum")
    differing = F.broadcast(differing_buckets(now, then, key, buckets))
    now, then = (side.join(differing, _bucket(key, buckets) == F.col("bucket"), "left_semi") for side in (now, then))
    then = then.select(F.col(key).alias("_key"), F.col("checksum").alias("_then"))
    same = (F.col(key) == F.col("_key")) & F.col("checksum").eqNullSafe(F.col("_then"))
    return now.join(then, same, "left_anti").select(key), then.select(F.col("_key").alias(key)).distinct()


def pending_items(items: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Items never applied. An applied item is not due again, whatever it holds now."""
    return items.join(ledger.select(key), key, "left_anti")


def changed_items(items: DataFrame, ledger: DataFrame, key: str, content: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Applied items whose checksum is not in the ledger's ``checksum`` column under their key.

    Texts are hashed where they are scanned. Only key and hash are shuffled, and only those
    of buckets whose digests differ: where nothing has changed, nothing is joined. A repeated
    item is judged row by row; of a key with several ledger rows each counts. NULL keys are
    never applied.
    """
    unmatched, known = _unmatched(items, ledger, key, content, buckets)
    return unmatched.join(known, key, "left_semi")


def due_items(items: DataFrame, ledger: DataFrame, key: str, content: list[str], buckets: int = BUCKETS) -> DataFrame:
    """What a run has to apply: new items and, for repeatable ones, changed items (as in ``changed_items``).

    Only the buckets that differ are joined. Items with a NULL key are always pending.
    """
    unmatched, known = _unmatched(items, ledger, key, content, buckets)
    reason = F.when(F.col("_known"), "changed").otherwise("pending").alias("reason")
    due = unmatched.join(known.withColumn("_known", F.lit(True)), key, "left").select(key, reason)
    return due.where(F.col(key).isNotNull()).union(items.where(F.col(key).isNull()).select(key, F.lit("pending")))


def ledger_rows(items: DataFrame, key: str, content: list[str]) -> DataFrame:
    return items.select(key, checksum(*content).alias("checksum"))


def altered_rows(baseline: DataFrame, current: DataFrame, key: str, content: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Keys of the baseline whose content differs now; added and removed rows pass."""
    return changed_items(current, ledger_rows(baseline, key, content), key, content, buckets)
