"""A mix of documents from several sources at target shares of the total size in tokens.

1.  Each text is counted once in tokens of a public tokenizer, whose file is a parameter, and given
    a quality weight: one less its share of repeated runs of five words.
2.  Budgets.  Of a total (by default all tokens there are) each source gets its target share, at
    most its own tokens times ``max_repeats``.  What such a limit leaves over goes to the other
    sources in proportion to their targets, until nothing changes.
3.  Complete epochs precede the fraction: a source whose budget is k times its size and a rest gives
    each document k times; the rest is a weighted sample without replacement after Efraimidis and
    Spirakis: documents in the order of exponential keys divided by their weight, taken as long as
    the running sum of tokens stays within the rest.

The running sum needs no sort of a whole source in one task.  Keys are mapped to 4096 buckets, the
tokens of each bucket are summed up, and only the bucket in which the rest runs out is looked at
again, in 4096 parts; a window then orders what is left, a part in 16 million of a source.

Defined cases: null and empty texts have no tokens and are never chosen; sources without a target, and
targets without documents, get nothing, the latter reported with share 0; labels are compared
without case and separators; equal keys are ordered by id; with a total of 0 nothing is chosen.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.repetition import exact_share
from postmill.llm.words import word_hashes
from postmill.session import cut_lineage

#: The file of a byte-level vocabulary, a base64 token and its rank in each line.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary's texts are split.  Fixed value.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

LEAST_WEIGHT = 0.05
BUCKETS = 4096
SIZED = "doc_id long, source string, tokens long, weight double"

_ENCODINGS: dict[str, object] = {}


def _encoding(path: str):
    if path not in _ENCODINGS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        _ENCODINGS[path] = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def label(source: Column) -> Column:
    """A label of a source without case and separators."""
    return F.regexp_replace(F.lower(source), r"[^\p{L}\p{N}]", "")


def sized_documents(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, tokens, weight`` of documents with tokens; ``source`` evened out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(tokenizer)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            tokens = [len(encoding.encode_ordinary(t)) for t in texts]
            weights = []
            for hashed in word_hashes(texts):
                n, d = exact_share(hashed)
                weights.append(max(LEAST_WEIGHT, d / n) if n else 1.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(tokens, pa.int64()), pa.array(weights, pa.float64())],
                ["doc_id", "source", "tokens", "weight"],
            )

    rows = documents.where("length(text) > 0").select(F.col("doc_id").cast("long").alias("doc_id"), label(F.col("source")).alias("source"), "text")
    return rows.mapInArrow(run, SIZED)


def budgets(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, float]:
    """Tokens that each source is to give."""
    limit = {s: float(sizes.get(s, 0) * max(0, r)) for s, (_, r) in targets.items()}
    wanted = float(sum(sizes.values()) if total is None else total)
    given: dict[str, float] = {}
    open_ = {s: t for s, (t, _) in targets.items() if t > 0}
    while open_:
        left, shares = wanted - sum(given.values()), sum(open_.values())
        full = [s for s, t in open_.items() if limit[s] <= left * t / shares]
        if not full:
            given |= {s: left * t / shares for s, t in open_.items()}
            break
        for s in full:
            given[s] = limit[s]
            del open_[s]
    return {s: given.get(s, 0.0) for s in targets}


def mix(
    documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, total: int | None = None, seed: int = 1
) -> tuple[DataFrame, DataFrame]:
    """``(chosen, report)``: ``chosen`` has ``doc_id, source, tokens, copies`` for each document that
    is in the mix; ``report`` has a row for each target."""
    spark = documents.sparkSession
    aims = targets.where("source is not null").groupBy(label(F.col("source")).alias("source")).agg(
        F.min(F.col("source")).alias("named"), F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats")
    )
    # a row per source of the mix; the sizes are one row for each of them
    aimed = {r.source: r for r in aims.collect()}
    uniform = (F.xxhash64(F.col("doc_id"), F.lit(seed)).cast("double") + 2.0**63) / 2.0**64
    key = -F.log(F.greatest(uniform, F.lit(1e-300))) / F.col("weight")
    sized = cut_lineage(
        sized_documents(documents, tokenizer).where(F.col("tokens") > 0).where(F.col("source").isin(list(aimed)))
        .withColumn("key", key).withColumn("at", 1.0 - F.exp(-F.col("key")))
    )
    sizes = {r.source: r.tokens for r in sized.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    given = budgets(sizes, {s: (float(r.share or 0), int(r.repeats or 0)) for s, r in aimed.items()}, total)
    plan = []
    for s, r in aimed.items():
        size = sizes.get(s, 0)
        epochs = int(given[s] // size + 1e-9) if size else 0
        plan.append((s, r.named, float(r.share or 0), int(r.repeats or 0), size, float(given[s]), epochs, float(given[s] - epochs * size)))
    plan_df = spark.createDataFrame(
        plan, "source string, named string, target_share double, max_repeats int, available long, budget double, epochs int, rest double"
    )
    # a row for each source of the mix, here and below
    rests = F.broadcast(plan_df.select("source", F.col("named"), "epochs", "rest"))
    rows = sized.join(rests, "source").withColumn("b", F.floor(F.col("at") * BUCKETS)).withColumn("fine", F.floor((F.col("at") * BUCKETS - F.col("b")) * BUCKETS))
    coarse = _runs_out(rows, "b", F.lit(0))
    inside = rows.join(F.broadcast(coarse), "source").where("b = edge")
    finer = _runs_out(inside, "fine", F.col("before")).select("source", F.col("edge").alias("fine_edge"), F.col("before").alias("fine_before"))
    edges = F.broadcast(cut_lineage(coarse.select("source", "edge").join(F.broadcast(finer), "source", "left")))
    # one pass: what lies ahead of the edge is in, what lies behind is out; only the rows of the edge itself,
    # a part in 16 million of a source, are summed up in order
    placed = rows.join(edges, "source")
    on_edge = (F.col("b") == F.col("edge")) & (F.col("fine") == F.col("fine_edge"))
    ahead = (F.col("b") < F.col("edge")) | ((F.col("b") == F.col("edge")) & (F.col("fine") < F.col("fine_edge")))
    order = Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    last = placed.where(on_edge).withColumn("more", (F.col("fine_before") + F.sum("tokens").over(order) <= F.col("rest")).cast("int"))
    others = placed.where(~F.coalesce(on_edge, F.lit(False))).withColumn("more", F.coalesce(ahead, F.lit(False)).cast("int"))
    columns = ["doc_id", F.col("named").alias("source"), "tokens", (F.col("epochs") + F.col("more")).alias("copies")]
    chosen = others.select(*columns).unionByName(last.select(*columns)).where("copies > 0")
    return chosen, _report(chosen, plan_df)


def _runs_out(rows: DataFrame, bucket: str, before: Column) -> DataFrame:
    """``source, edge, before``: for each source the bucket in which its rest runs out, and the
    tokens ahead of it.  A row for each source and bucket at most takes part in the window."""
    sums = rows.withColumn("_b", F.col(bucket)).groupBy("source", "_b").agg(
        F.sum("tokens").alias("n"), F.first("rest").alias("rest"), F.first(before).alias("start")
    )
    order = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    run = sums.withColumn("upto", F.col("start") + F.sum("n").over(order))
    over = run.where(F.col("upto") > F.col("rest"))
    return (
        run.groupBy("source").agg(F.max("_b").alias("last"), F.max("upto").alias("all"))
        .join(over.groupBy("source").agg(F.min_by(F.struct("_b", (F.col("upto") - F.col("n")).alias("ahead")), "_b").alias("o")), "source", "left")
        .select("source", F.coalesce("o._b", F.col("last") + 1).alias("edge"), F.coalesce("o.ahead", "all").alias("before"))
    )


def _report(chosen: DataFrame, plan: DataFrame) -> DataFrame:
    """Reached against target, a row for each target."""
    used = chosen.groupBy(F.col("source").alias("named")).agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("doc_id").alias("documents"), F.max("copies").alias("most_copies")
    )
    joined = plan.join(used, "named", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    whole = Window.partitionBy(F.lit(1))  # a row per source of the mix
    return joined.select(
        F.col("named").alias("source"),
        "target_share",
        F.round(F.col("tokens") / F.sum("tokens").over(whole), 6).alias("reached_share"),
        F.col("available").alias("available_tokens"),
        F.col("tokens").alias("chosen_tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        "max_repeats",
    )
