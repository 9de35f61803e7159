"""Messages delivered at least once: exactly one copy of each is kept.

The identity of a message is ``job_key`` (case and surrounding blanks ignored), ``sequence`` and
``emitted_at`` cut to the millisecond.  The copy with the smallest ``received_at``, then the
smallest ``log_id``, stays.

One hash aggregation with ``min_by`` does the choice.  What it orders by is a struct of delivery time
and tie-break, packed into one DECIMAL(38,0): a value of fixed width can be updated in the hash map,
where a struct would make Spark sort each task's rows first.  Copies are combined on the map side, so
a message that makes up a third of the log shuffles one partial row per task.  What is not chosen is
found by an anti join on the unique ``log_id``, which no hot message can skew.

Defined cases
    * a row with a null in any part of the identity can't be told to be a copy: it stays;
    * a null ``received_at`` counts as later than any time;
    * repeated ``log_id``: such rows share one fate, ``log_id`` is unique by contract;
    * other columns, whatever their names, are carried through unchanged.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blanks that surround a key without being part of it.
BLANKS = " \t\r\n\f "


def message_key(job_key: Column) -> Column:
    return F.lower(F.btrim(job_key, F.lit(BLANKS)))


def _identity() -> list[Column]:
    return [
        message_key(F.col("job_key")).alias("_key"),
        F.col("sequence").alias("_sequence"),
        F.date_trunc("millisecond", F.col("emitted_at")).alias("_emitted"),
    ]


#: More than the largest time in microseconds, and more than the range of ids.
_LATE, _IDS, _SHIFT = Decimal(9 * 10**17), Decimal(10**20), Decimal(2**63)


def delivery_order(received_at: Column, log_id: Column) -> Column:
    """Delivery time, then id, as one DECIMAL(38,0); a null time counts as later than any."""
    time = F.coalesce(F.unix_micros(received_at).cast("decimal(18,0)"), F.lit(_LATE)) * F.lit(_IDS)
    return (time + (log_id.cast("decimal(19,0)") + F.lit(_SHIFT))).cast("decimal(38,0)")


IDENTIFIED = "job_key is not null and sequence is not null and emitted_at is not null"


def kept_ids(log: DataFrame) -> DataFrame:
    """``log_id`` of the one copy that stays of each identified message."""
    rows = log.where(IDENTIFIED).select(*_identity(), delivery_order(F.col("received_at"), F.col("log_id")).alias("_order"), "log_id")
    chosen = rows.groupBy("_key", "_sequence", "_emitted").agg(F.min_by("log_id", "_order").alias("log_id"))
    return chosen.select("log_id")


def surplus_ids(log: DataFrame) -> DataFrame:
    """``log_id`` of each copy to drop."""
    return log.where(IDENTIFIED).select("log_id").join(kept_ids(log), "log_id", "left_anti")


def exactly_once(log: DataFrame) -> DataFrame:
    """The log with one copy of each message, all columns as they were: a semi join with the ids that
    stay, which are those chosen and those of rows without identity."""
    nameless = log.where(f"not ({IDENTIFIED})").select("log_id")
    return log.join(kept_ids(log).union(nameless), "log_id", "left_semi").select(*log.columns)
