"""Queries of the operators in this subpackage, with SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import leaks, markup, mixing, names, neardup, pii, repetition
from postmill.session import table


def posting_text() -> Column:
    """Title, employer and description of a post, for posts with a description that isn't blank."""
    worded = F.col("description").rlike(r"(?U)\S")
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("company_name", F.lit("")), F.lit(" "), "description")
    return F.when(worded, text)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    found = markup.find_markup(table(spark, folder, "job_posts"), "post_id", "description")
    return found.select(F.col("record_id").alias("post_id"), F.explode("markup").alias("markup")).distinct()


def p1_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Each description as clean text, with what structure it has."""
    cleaned = markup.clean_markup(table(spark, folder, "job_posts"), "post_id", "description")
    return cleaned.withColumnRenamed("record_id", "post_id").withColumn("markup", F.array_join("markup", ","))


def _typed_names(spark: SparkSession, folder: str) -> DataFrame:
    posts = table(spark, folder, "job_posts").select(F.col("company_name").alias("name"))
    return posts.union(table(spark, folder, "job_rows").select(F.col("company").alias("name")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.name_pairs(names.link_names(_typed_names(spark, folder)))


def p3_employers(spark: SparkSession, folder: str) -> DataFrame:
    """Each spelling with its employer and the number of other spellings linked to it."""
    linked = names.link_names(_typed_names(spark, folder))
    sizes = linked.groupBy("employer").agg((F.count("name") - 1).alias("links"))
    return linked.join(sizes, "employer").select("name", "employer", "links")


def _post_links(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return neardup.link_classes(table(spark, folder, "job_posts"), "post_id", posting_text(), length=3, threshold=0.6)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = neardup.all_pairs(*_post_links(spark, folder))
    return pairs.select(F.col("a").alias("post_a"), F.col("b").alias("post_b"))


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each post with its class of copies and its number of linked classes, at five words and 0.8."""
    members, links = neardup.link_classes(table(spark, folder, "job_posts"), "post_id", posting_text())
    return neardup.membership(members, links).withColumnRenamed("id", "post_id")


def _towns(posts: DataFrame) -> DataFrame:
    return pii.towns_of((posts, F.col("location.city")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    posts, rows = table(spark, folder, "job_posts"), table(spark, folder, "job_rows")
    towns = _towns(posts)
    in_posts = pii.find_personal(posts, "post_id", "description", "job_posts", towns)
    return in_posts.union(pii.find_personal(rows, "row_id", "emails", "job_rows", towns)).distinct()


def p6_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Each description with typed placeholders in place of personal information."""
    posts = table(spark, folder, "job_posts")
    return pii.redact(posts, "post_id", "description", _towns(posts)).withColumnRenamed("record_id", "post_id")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    found = leaks.find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"), parts=("item_text",))
    return found.select("doc_id", "item_id").distinct()


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Each document of the mix with the number of times that it is in it."""
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached share of each source."""
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.repetitive(table(spark, folder, "documents"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of repeated runs of every document."""
    scored = repetition.score_repetition(table(spark, folder, "documents"))
    return scored.select("doc_id", "runs", "distinct_runs", F.round("repeated_share", 6).alias("repeated_share"))


QUERIES = {
    "p1_found": p1_found,
    "p1_clean": p1_clean,
    "p3_found": p3_found,
    "p3_employers": p3_employers,
    "p5_found": p5_found,
    "p5_classes": p5_classes,
    "p6_found": p6_found,
    "p6_redacted": p6_redacted,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_shares": p9_shares,
}

_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"

ORACLES = {
    "p5_found": f"""
        with w as (select post_id, {_WORDS.format("coalesce(title, '') || ' ' || coalesce(company_name, '') || ' ' || description")} as w from job_posts where regexp_matches(description, '\\S')),
        s as (select post_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) as s from w where len(w) >= 3),
        e as (select post_id, len(s) as n, unnest(s) as run from s)
        select x.post_id as post_a, y.post_id as post_b from e x join e y on x.run = y.run and x.post_id < y.post_id
        group by x.post_id, y.post_id, x.n, y.n having count(*) >= 0.6 * (x.n + y.n - count(*))""",
    "p9_shares": f"""
        with w as (select doc_id, coalesce({_WORDS.format("text")}, []) as w from documents),
        r as (select doc_id, list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4]) as runs from w)
        select doc_id, len(runs) as runs, len(list_distinct(runs)) as distinct_runs, round(case when len(runs) > 0 then (len(runs) - len(list_distinct(runs))) / len(runs) else 0 end, 6) as repeated_share from r""",
    "p9_found": f"""
        with w as (select doc_id, {_WORDS.format("text")} as w from documents where text is not null),
        r as (select doc_id, list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4]) as runs
              from w where len(w) >= 5)
        select doc_id from r
        where (len(runs) - len(list_distinct(runs))) / len(runs) >= 0.3""",
    "p7_found": f"""
        with i as (select item_id, {_WORDS.format("item_text")} as w from eval_items),
        k as (select item_id, unnest(list_transform(range(1, len(w) - 10), lambda j: list_aggregate(w[j:j+11], 'string_agg', ' '))) as run from i where len(w) >= 12),
        d as (select doc_id, {_WORDS.format("text")} as w from documents where text is not null),
        m as (select doc_id, unnest(list_transform(range(1, len(w) - 10), lambda j: list_aggregate(w[j:j+11], 'string_agg', ' '))) as run from d where len(w) >= 12)
        select distinct doc_id, item_id from m join k using (run)""",
}
