"""Operators over listings: normalising, identity, dedup, limits, flattening, and outcomes.

Listings carry ``site``, ``sequence`` (order of arrival) and the fields of POST_SCHEMA.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions import places, salary, text, url
from postmill.session import cut_lineage
from postmill.vocabulary import RESULT_FIELDS, RESULT_NAMES


def validity(df: DataFrame) -> DataFrame:
    """Adds ``invalid_reason``, null for sound listings; the first broken rule names it."""
    pay, source, proof = F.col("compensation"), F.col("salary_source"), F.col("salary_provenance")
    low, high = pay["min_amount"], pay["max_amount"]
    rules = [
        (F.coalesce(F.length(F.trim("title")), F.lit(0)) == 0, "title is empty"),
        (F.coalesce(F.length(F.trim("job_url")), F.lit(0)) == 0, "job_url is empty"),
        (~F.trim("job_url").rlike("^https?://"), "job_url is not http"),
        (pay.isNotNull() & low.isNull() & high.isNull(), "compensation has no amount"),
        (pay.isNotNull() & ((low < 0) | (high < 0)), "compensation is negative"),
        (pay.isNotNull() & (low > high), "compensation is out of order"),
        (pay.isNotNull() & salary.iso_currency(pay["currency"]).isNull(), "currency is unknown"),
        (pay.isNull() & (source.isNotNull() | proof.isNotNull()), "salary metadata without compensation"),
        ((source == "description") & proof.isNull(), "description salary without provenance"),
        (source != proof["source"], "salary sources differ"),
    ]
    reason = F.lit(None).cast("string")
    for broken, name in reversed(rules):
        reason = F.when(F.coalesce(broken, F.lit(False)), name).otherwise(reason)
    return df.withColumn("invalid_reason", reason)


def normalize(df: DataFrame, annual: bool = False, infer: bool = False, country: str | None = None) -> DataFrame:
    """Pay with source and provenance: structured pay wins; otherwise, if asked for, pay that the
    description states; by the year, if asked for.  Doing it again changes nothing."""
    given = F.col("compensation")
    if infer:
        hint = places.currency_hint(F.lit(country)) if country else F.lit(None).cast("string")
        # only texts without structured pay go to the Python workers' scan
        df = df.withColumn("_text", F.when(given.isNull(), F.col("description"))).withColumn("_said", salary.parse_pay(F.col("_text"), hint))
        said = F.col("_said")
        found = F.struct(*[said[c].alias(c) for c in ("interval", "min_amount", "max_amount", "currency")])
        compensation = F.coalesce(given, F.when(said.isNotNull(), found))
        source = F.when(given.isNotNull(), F.coalesce("salary_source", F.lit("direct_data"))).otherwise(
            F.when(said.isNotNull(), "description").otherwise(F.col("salary_source"))
        )
        evidence = F.when(given.isNull(), said["evidence"]).otherwise(F.col("salary_provenance.evidence"))
    else:
        compensation = given
        source = F.when(given.isNotNull(), F.coalesce("salary_source", F.lit("direct_data"))).otherwise(F.col("salary_source"))
        evidence = F.col("salary_provenance.evidence")
    proof = F.when(compensation.isNotNull(), salary.provenance(source, evidence)).otherwise(F.col("salary_provenance"))
    out = df.withColumns(
        {
            "salary_provenance": proof,
            "salary_source": source,
            "compensation": salary.annualized(compensation) if annual else compensation,
        }
    )
    return out.drop("_text", "_said")


def with_key(df: DataFrame) -> DataFrame:
    """Adds ``job_key``, the identity of a listing at its site."""
    return df.withColumn("job_key", url.stable_id(F.col("site"), url.key_source(F.col("id"), F.col("job_url"))))


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key.

    One aggregation with ``min_by``: copies are combined before the shuffle, so a hot key costs a row
    per task and is never gathered in one place.  Whole rows are carried along in structs, for which
    Spark sorts the rows of a task by key instead of hashing them; choosing ids by hash first would
    need a second shuffle of the whole rows.
    """
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return first.select(*keys, "_row.*").select(*df.columns)


def per_site_limit(df: DataFrame, wanted: int, order: list[str], site: str = "site", rank: str | None = None) -> DataFrame:
    """The first ``wanted`` rows of each site; 0 gives none.  ``rank`` names a column for their place.

    A bounded window per site: Spark keeps the top rows of each map partition ahead of the shuffle
    (window group limit), so a site with a third of all rows sends ``wanted`` rows per task.
    """
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(site).orderBy(*order))).where(F.col(name) <= wanted)
    return ranked if rank else ranked.drop(name)


def skip_raw(df: DataFrame, offset: int, order: list[str], site: str = "site") -> DataFrame:
    """All but the first ``offset`` raw rows of each site; those are few, and anti-joined away."""
    if offset <= 0:
        return df
    head = per_site_limit(df.select(site, *order), offset, order, site)
    return df.join(head, [site, *order], "left_anti").select(*df.columns)


def unseen(df: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't among those acknowledged before."""
    return df.join(history.select(*keys).distinct(), keys, "left_anti").select(*df.columns)


def with_details(df: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """A lookup of details for each listing; listings without stay, with nulls."""
    return df.join(details, key, "left")


def union_sites(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def flatten(df: DataFrame) -> DataFrame:
    """The 37 columns of the result table, missing ones as null."""
    made: dict[str, Column] = {
        "company": F.col("company_name"),
        "location": places.shown(F.col("location")),
        "job_type": text.join_list(F.col("job_type")),
        "emails": text.join_list(F.col("emails")),
        "skills": text.join_list(F.col("skills")),
        "salary_confidence": F.col("salary_provenance.confidence"),
        "salary_evidence": F.col("salary_provenance.evidence"),
        **{c: F.col(f"compensation.{c}") for c in ("interval", "min_amount", "max_amount", "currency")},
    }
    needed = {"company": "company_name", "salary_confidence": "salary_provenance", "salary_evidence": "salary_provenance"}
    needed |= dict.fromkeys(("interval", "min_amount", "max_amount", "currency"), "compensation")
    columns = []
    for name, kind in RESULT_FIELDS:
        if needed.get(name, name) in df.columns:
            columns.append(made.get(name, F.col(name)).cast(kind).alias(name))
        else:
            columns.append(F.lit(None).cast(kind).alias(name))
    return df.select(*columns, *[c for c in ("sequence",) if c in df.columns])


def _final_columns(df: DataFrame) -> list[Column]:
    ties = F.col("sequence").asc() if "sequence" in df.columns else F.col("id").asc_nulls_last()
    return [F.col("site").asc_nulls_last(), F.col("date_posted").desc_nulls_last(), ties]


def final_order(df: DataFrame) -> DataFrame:
    """By site, then newest first, unknown values last; ties in order of arrival."""
    return df.orderBy(*_final_columns(df))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``, from 1: where each row stands in an order.

    A range sort, then the rows ahead of each partition: no row number is made in one task, and
    only the counts of the partitions meet in one place.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    parted = cut_lineage(df.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_row": row}))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parted.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    starts = counts.select("_part", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_start"))
    # a row per partition of the sort
    placed = parted.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_row") + 1)
    return placed.select(*df.columns, name)


def with_place(df: DataFrame) -> DataFrame:
    """Adds ``place``: where each row stands in the final order."""
    return numbered(df, _final_columns(df), "place")


def failures_in_order(events: DataFrame) -> DataFrame:
    """The error events, with ``place`` by their sequence."""
    return numbered(events.where("type = 'error'"), [F.col("sequence").asc(), F.col("site").asc_nulls_last()], "place")


def wanted_by(request, as_of: str) -> Column:
    """What of a request's filters can be told from a listing itself.

    Boards evaluate words and places by rules of their own; here every word of the search term has to
    stand in title, employer or description, and the place in the place shown.  Listings that don't
    state what a filter asks for pass.  Distance and easy application can't be told.
    """
    keep = F.lit(True)
    if request.hours_old is not None:
        oldest = F.date_sub(F.lit(as_of).cast("date"), max(-(-request.hours_old // 24), 1))
        keep &= F.col("date_posted").isNull() | (F.col("date_posted") >= oldest)
    if request.job_type is not None:
        keep &= F.col("job_type").isNull() | F.array_contains("job_type", request.job_type)
    if request.is_remote:
        keep &= F.coalesce("is_remote", F.lit(False))
    said = F.lower(F.concat_ws(" ", "title", "company_name", "description"))
    for word in (request.search_term or "").lower().split():
        keep &= said.contains(word)
    if request.location and request.location.strip():
        shown = F.lower(places.shown(F.col("location")))
        keep &= shown.isNull() | (shown == "") | shown.contains(request.location.strip().lower())
    return keep


def result_table(df: DataFrame, **how) -> DataFrame:
    """Normalised, flattened and ordered; exactly the 37 columns."""
    return final_order(flatten(normalize(df, **how))).select(*RESULT_NAMES)


# -- outcomes ----------------------------------------------------------------------------------------


def progress(pages: DataFrame) -> DataFrame:
    """Running totals of raw and emitted rows by site and page."""
    upto = Window.partitionBy("site").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn("raw_seen", F.sum("raw").over(upto)).withColumn("emitted_total", F.sum("emitted").over(upto))


def site_summary(events: DataFrame, sites: DataFrame) -> DataFrame:
    """``site, jobs_emitted, failure_count, completed`` for each requested site.

    ``events`` has ``site``, ``type`` (job, error or site_complete) and ``sequence``; a site is
    completed if its last terminal event says so.
    """
    terminal = F.col("type").isin("error", "site_complete")
    seen = events.groupBy("site").agg(
        F.count_if(F.col("type") == "job").alias("jobs_emitted"),
        F.count_if(F.col("type") == "error").alias("failure_count"),
        F.max_by(F.col("type") == "site_complete", F.when(terminal, F.col("sequence"))).alias("completed"),
    )
    return sites.select("site").distinct().join(seen, "site", "left").select(
        "site",
        F.coalesce("jobs_emitted", F.lit(0)).alias("jobs_emitted"),
        F.coalesce("failure_count", F.lit(0)).alias("failure_count"),
        F.coalesce("completed", F.lit(False)).alias("completed"),
    )


def outcome(summary: DataFrame) -> DataFrame:
    """One row: totals, completion, and status succeeded, partial or failed."""
    totals = summary.agg(
        F.coalesce(F.sum("jobs_emitted"), F.lit(0)).alias("total_jobs"),
        F.coalesce(F.sum("failure_count"), F.lit(0)).alias("total_failures"),
        F.coalesce(F.bool_and("completed"), F.lit(True)).alias("completed"),
        F.coalesce(F.bool_or("completed"), F.lit(False)).alias("_any"),
    )
    status = F.when(F.col("completed"), "succeeded").when((F.col("total_jobs") > 0) | F.col("_any"), "partial").otherwise("failed")
    return totals.withColumn("status", status).drop("_any")


def broken_invariants(summary: DataFrame) -> DataFrame:
    """Sites whose summary contradicts itself: completed with failures, or neither."""
    return summary.where("(completed and failure_count > 0) or (not completed and failure_count = 0)")
