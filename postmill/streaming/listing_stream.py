"""Listings as a Structured Streaming query: pages in, each listing once out, up to a limit for each site.

Whether a key was seen is kept in the state store, spread by site and key, so neither a site with a
third of all listings nor a long history ends up in one task or is read again.  The limit of each
site and the numbers of events need one row for each site from the epoch before.  Every epoch of
events is overwritten if its batch runs again, so a restart neither loses nor repeats a listing.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from postmill.operators import listings
from postmill.request import SearchRequest
from postmill.session import ensure_checkpoint_dir
from postmill.sources.mappers import map_raw
from postmill.sources.replay import _open

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class EventLog:
    """Epochs of numbered events in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def epochs(self) -> list[int]:
        from pyarrow import fs

        system, path = _open(f"{self.folder}/events")
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return sorted(int(i.base_name.removeprefix("epoch=")) for i in found if i.base_name.startswith("epoch="))

    def read(self) -> DataFrame | None:
        """All events, with their epoch."""
        return self.spark.read.parquet(f"{self.folder}/events") if self.epochs() else None

    def epoch(self, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/events/epoch={number}")

    def totals(self, number: int) -> DataFrame | None:
        """``site, held, last``: listings of each site and the last event number, up to an epoch."""
        path = f"{self.folder}/totals/epoch={number}"
        return self.spark.read.parquet(path) if number in self.epochs() else None

    def write(self, number: int, events: DataFrame, totals: DataFrame) -> None:
        """Totals first: an epoch counts once its events are there."""
        totals.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/totals/epoch={number}")
        events.write.mode("overwrite").parquet(f"{self.folder}/events/epoch={number}")


class FirstOfKey(StatefulProcessor):
    """Lets the first row of each key pass, once and for all."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "there boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        first = min(rows, key=lambda r: r.sequence)
        if not self.seen.exists():
            self.seen.update((True,))
            yield first

    def close(self) -> None:
        pass


def candidates(pages: DataFrame, request: SearchRequest, as_of: str) -> DataFrame:
    """Events of a stream of pages: new listings, warnings about unsound ones, and progress."""
    mapped = map_raw(pages.where("kind = 'listing'"), F.lit(as_of).cast("date"), list(request.sites), kind=request.description_format)
    checked = listings.validity(mapped)
    rejected = checked.where("invalid_reason is not null").select("site", F.lit("warning").alias("type"), "sequence", F.col("invalid_reason").alias("message"))
    sound = listings.normalize(checked.where("invalid_reason is null").drop("invalid_reason"), request.annual_salary, request.infer_salary, request.country)
    keyed = listings.with_key(sound)
    fresh = keyed.groupBy("site", "job_key").transformWithState(FirstOfKey(), keyed.schema, "append", "none")
    come = pages.where("kind = 'progress'").select("site", F.lit("progress").alias("type"), "sequence", "page", F.col("byte").alias("upto"))
    out = fresh.withColumn("type", F.lit("job"))
    return out.unionByName(rejected, allowMissingColumns=True).unionByName(come, allowMissingColumns=True)


def process(log: EventLog, request: SearchRequest, batch: DataFrame, epoch: int) -> None:
    """One micro-batch: its events, within the limits, become an epoch of the log."""
    before = log.totals(epoch - 1) if epoch else None
    held = before if before is not None else log.spark.createDataFrame([], "site string, held long, last long")
    # a row for each site
    started = (held.agg(F.max("last")).first()[0] or 0) if before is not None else 0
    counts = F.broadcast(held.select("site", "held"))
    jobs = listings.per_site_limit(batch.where("type = 'job'"), request.results_wanted, ["sequence"], rank="_rank").join(counts, "site", "left")
    taken = jobs.where(F.col("_rank") + F.coalesce("held", F.lit(0)) <= request.results_wanted).drop("_rank", "held")
    every = taken.unionByName(batch.where("type <> 'job'"))
    order = [F.col("site"), F.col("sequence"), F.col("type")]
    numbered = listings.numbered(every, order, "number").withColumn("number", F.col("number") + started)
    new = numbered.groupBy("site").agg(F.count_if(F.col("type") == "job").alias("more"), F.max("number").alias("upto"))
    totals = held.join(new, "site", "full_outer").select(
        "site", (F.coalesce("held", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("held"), F.greatest(F.coalesce("upto", F.lit(0)), F.coalesce("last", F.lit(0))).alias("last")
    )
    log.write(epoch, numbered, totals)


def start(spark: SparkSession, pages: DataFrame, request: SearchRequest, folder: str, as_of: str, drain: bool = True) -> StreamingQuery:
    """Run the stream of ``pages`` into the log below ``folder``; ``drain`` stops when nothing is left."""
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    log = EventLog(spark, f"{folder}/log")
    events = candidates(pages, request, as_of)
    writer = events.writeStream.option("checkpointLocation", f"{folder}/progress").foreachBatch(lambda batch, epoch: process(log, request, batch, epoch))
    return (writer.trigger(availableNow=True) if drain else writer).start()


def replayed(spark: SparkSession, path: str, sites: tuple[str, ...] = ()) -> DataFrame:
    return spark.readStream.format("listing_replay").option("path", path).option("sites", ",".join(sites)).load()


def run_to_end(spark: SparkSession, path: str, request: SearchRequest, folder: str, as_of: str) -> EventLog:
    """Take all pages that there are; run again, it goes on behind them."""
    start(spark, replayed(spark, path, request.sites), request, folder, as_of).awaitTermination()
    return EventLog(spark, f"{folder}/log")


def local_folder(path: str | Path) -> str:
    return f"file://{Path(path).resolve()}"
