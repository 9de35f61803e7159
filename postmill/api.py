"""Entry points: a request in, a table, an outcome or a stream of listings out."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.operators import listings
from postmill.outcome import Collector, Outcome, SearchFailed
from postmill.request import SearchRequest, unsupported
from postmill.session import ship_package
from postmill.sources.mappers import MAPPERS, map_raw
from postmill.sources.registry import Registry, default_registry
from postmill.streaming import listing_stream
from postmill.streaming.checkpoint import JsonStore, Store
from postmill.streaming.search import SearchStream
from postmill.vocabulary import POST_SCHEMA

__all__ = ["Outcome", "SearchFailed", "build_search_request", "collect_jobs", "scrape_jobs", "search", "search_table", "stream_jobs", "stream_search", "stream_to_log", "warnings_of"]


def build_search_request(request: SearchRequest | None = None, **options) -> SearchRequest:
    """A request as given, or made of options; not both."""
    if request is not None and options:
        raise TypeError(f"give a request or options, not both: {', '.join(sorted(options))}")
    return request or SearchRequest(**options)


# -- DataFrames over all recorded pages ------------------------------------------------------------------


def read_pages(spark: SparkSession, request: SearchRequest, source: str, path: str, registry: Registry | None = None) -> DataFrame:
    ship_package(spark)
    (registry or default_registry()).install(spark)
    reader = spark.read.format(source).option("path", path).option("sites", ",".join(request.sites))
    return reader.option("max_pages", str(request.max_pages)).load().where("kind = 'listing'")


def search(spark: SparkSession, request: SearchRequest, path: str, as_of: str, source: str = "listing_replay", registry: Registry | None = None) -> DataFrame:
    """All new listings of a search: offset, mapping, check, filters, dedup by site and key, limit."""
    raw = read_pages(spark, request, source, path, registry)
    raw = listings.skip_raw(raw, request.offset, ["sequence"])
    mapped = map_raw(raw, F.lit(as_of).cast("date"), list(request.sites), kind=request.description_format)
    sound = listings.validity(mapped).where("invalid_reason is null").drop("invalid_reason")
    sound = listings.normalize(sound, request.annual_salary, request.infer_salary, request.country)
    wanted = sound.where(listings.wanted_by(request, as_of))
    once = listings.first_seen(listings.with_key(wanted), ["site", "job_key"], ["sequence"])
    return listings.per_site_limit(once, request.results_wanted, ["sequence"])


def search_table(spark: SparkSession, path: str, as_of: str, request: SearchRequest | None = None, **options) -> DataFrame:
    """``search`` as the 37-column table, of any size; no outcome is worked out."""
    return listings.result_table(search(spark, build_search_request(request, **options), path, as_of))


def listings_of_rows(rows: DataFrame, site: str, request: SearchRequest, as_of: str) -> DataFrame:
    """Rows of a board's replay with the listing that each holds (``job``, ``job_key``,
    ``invalid_reason``); listings that the request filters out are left out."""
    kept = [c for c in rows.columns if c not in ("site", "sequence", "detail")]
    listed = F.when(F.col("kind") == "listing", F.col("raw"))
    packed = rows.select("site", "sequence", listed.alias("raw"), "detail", F.struct(*kept).alias("meta"))
    mapped = MAPPERS[site](packed, F.lit(as_of).cast("date"), kind=request.description_format)
    sound = listings.with_key(listings.normalize(listings.validity(mapped), request.annual_salary, request.infer_salary, request.country))
    other = (F.col("meta.kind") != "listing") | F.col("invalid_reason").isNotNull()
    fields = [c for c in mapped.columns if c not in ("site", "sequence", "meta")]
    return sound.where(other | listings.wanted_by(request, as_of)).select("sequence", "meta.*", "invalid_reason", "job_key", F.struct(*fields).alias("job"))


# -- events, acknowledged one by one -----------------------------------------------------------------------


def stream_search(
    spark: SparkSession, path: str, as_of: str, request: SearchRequest | None = None, *, registry: Registry | None = None, store: Store | None = None,
    checkpoint_path: str | None = None, resume: bool = True, queue_size: int = 128, max_retries: int = 1, retry_backoff: float = 0.5, ack: str = "implicit",
    cancel_event: threading.Event | None = None, cancel_callback: Callable[[], bool] | None = None, **options,
) -> SearchStream:
    """The events of a search over the recorded pages below ``path``; with a store or a path of a
    checkpoint a restart goes on behind the last event that was acknowledged."""
    made = build_search_request(request, **options)
    if store is not None and checkpoint_path is not None:
        raise ValueError("give a store or the path of a checkpoint, not both")
    if spark is not None:
        ship_package(spark)
    sources = registry or default_registry(path, as_of)
    if spark is not None:
        sources.install(spark)
    kept = JsonStore(checkpoint_path) if checkpoint_path is not None else store
    return SearchStream(spark, made, sources, kept, resume, queue_size, max_retries, retry_backoff, ack, cancel_event, cancel_callback)


def stream_jobs(spark: SparkSession, path: str, as_of: str, request: SearchRequest | None = None, raise_on_error: bool = False, **options) -> Iterator[Mapping[str, Any]]:
    """Listings alone; every event is acknowledged.  With ``raise_on_error`` the first failure ends it."""
    with stream_search(spark, path, as_of, request, **options) as stream:
        for event in stream:
            if event.type == "job":
                yield event.job
            stream.ack(event)
            if event.type == "error" and raise_on_error:
                raise RuntimeError(f"{event.site}: {event.message}")


def collect_jobs(spark: SparkSession, path: str, as_of: str, request: SearchRequest | None = None, strict: bool = False, **options) -> Outcome:
    """All listings of a search with an outcome for each site, in one pass."""
    with stream_search(spark, path, as_of, request, **options) as stream:
        collector = Collector(stream.request.sites, stream.completed_before)
        for event in stream:
            collector.accept(event)
            stream.ack(event)
    outcome = collector.finish()
    if strict and outcome.failures:
        raise SearchFailed(outcome)
    return outcome


def jobs_table(spark: SparkSession, outcome: Outcome, **how) -> DataFrame:
    """The listings of an outcome as the 37-column table, ordered by site and newest first."""
    names = [part.split(" ")[0] for part in POST_SCHEMA.replace(", ", "\n").split("\n")]
    plain = lambda v: {k: plain(x) for k, x in v.items()} if isinstance(v, Mapping) else list(v) if isinstance(v, tuple) else v
    rows = [(site, k, *(plain(job.get(n)) for n in names)) for k, (site, job) in enumerate(outcome.jobs)]
    return listings.result_table(spark.createDataFrame(rows, f"site string, sequence long, {POST_SCHEMA}"), **how)


def scrape_jobs(spark: SparkSession, path: str, as_of: str, request: SearchRequest | None = None, strict: bool = False, **options) -> DataFrame:
    """The 37-column table, ordered by site and newest first."""
    return jobs_table(spark, collect_jobs(spark, path, as_of, request, strict, **options))


# -- a log that grows ----------------------------------------------------------------------------------------


def stream_to_log(spark: SparkSession, path: str, folder: str, as_of: str, request: SearchRequest | None = None, **options) -> DataFrame:
    """Run the stream to its end and give the listings of its log; run again, it goes on where it stopped."""
    made = build_search_request(request, **options)
    ship_package(spark)
    default_registry(path, as_of).install(spark)
    events = listing_stream.run_to_end(spark, path, made, folder, as_of).read()
    return events.where("type = 'job'")


def warnings_of(request: SearchRequest, registry: Registry) -> dict[str, str]:
    """For each site what it can't filter by."""
    found = {s: unsupported(request, registry.capabilities(s).filters) for s in request.sites}
    return {s: w for s, w in found.items() if w}
