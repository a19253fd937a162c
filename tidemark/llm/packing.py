"""Packing (operator 8): optimal length buckets.

Dynamic programming over the histogram of all lengths chooses the bucket boundaries with the least padding.
Sequences are padded to the boundary of their bucket, and batches with a budget of padded tokens form inside
each bucket. Texts longer than the longest sequence are cut into several; nothing is dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import append_columns, materialize, table
from tidemark.llm.units import encoder, in_slices

MAX_LENGTH, STEP, BUCKETS, BUDGET = 4096, 1, 16, 65_536
#: Units of text that a task remembers; less than for files of ids, since a pipeline's tasks hold other things too.
UNITS = 250_000
SHARD = 50_000  # sequences that are numbered together


def boundaries(counts: dict[int, int], buckets: int) -> list[int]:
    """Ascending bucket boundaries, at most `buckets`, that minimise the padding of counts {length: sequences}.

    Every boundary is a length that occurs; the last is the greatest. Exact, in O(buckets x lengths^2);
    of equal optima the one with the fewest and then the smallest boundaries.
    """
    lengths = np.array(sorted(counts), np.int64)
    if not len(lengths):
        return []
    n = np.array([counts[x] for x in lengths.tolist()], np.int64)
    rows, tokens = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * lengths)])
    k = len(lengths)
    # padding(i, j): lengths i..j-1 padded to lengths[j-1]
    best = np.full(k + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    choices, costs = [], []
    for _ in range(min(buckets, k)):
        new, choice = np.full(k + 1, np.iinfo(np.int64).max // 4), np.zeros(k + 1, np.int64)
        for j in range(1, k + 1):
            cost = best[:j] + (rows[j] - rows[:j]) * lengths[j - 1] - (tokens[j] - tokens[:j])
            choice[j] = int(cost.argmin())
            new[j] = cost[choice[j]]
        best = new
        choices.append(choice)
        costs.append(int(best[k]))
    used = int(np.argmin(costs))
    out, j = [], k
    for choice in reversed(choices[: used + 1]):
        out.append(int(lengths[j - 1]))
        j = int(choice[j])
    return sorted(out)


def with_length(df: DataFrame, tokenizer: str, text: str = "text", name: str = "length", cache_units: int = UNITS) -> DataFrame:
    """df with the number of tokens of the whole text and its end token; a null text has the end token alone."""

    def make():
        enc = encoder(tokenizer, cache_units)

        def compute(batch: pa.RecordBatch) -> list:
            found = [enc.count(texts) for _, texts in in_slices(batch.column(text).to_pylist())]
            return [pa.array(1 + np.concatenate(found) if found else [], pa.int64())]

        return compute

    return append_columns(df, {name: "long"}, make)


def pack(df: DataFrame, id: str = "doc_id", length: str = "length", max_length: int = MAX_LENGTH, step: int = STEP, buckets: int = BUCKETS, budget: int = BUDGET, shard: int = SHARD) -> DataFrame:
    """One row per sequence: id, part, start, length, bucket (its padded length), batch (a string), slot.

    A document longer than max_length is cut into parts of max_length tokens and a rest; one of length zero or
    null gives one empty sequence, padded to the smallest boundary. Boundaries are multiples of step. A
    batch holds at most budget padded tokens, or one sequence. Sequences of a bucket are numbered by id
    within shards of about `shard` sequences, so that a bucket with any share of all rows is spread over
    tasks, whatever the ids: rows of a repeated or null id go to any shard; only the last batch of a shard can be short. Repeated ids stay. Other
    columns are ignored; an empty table gives an empty result. The driver holds a histogram of
    max_length / step lengths.
    """
    if max_length % step or budget < step:
        raise ValueError("max_length must be a multiple of step, and budget at least step")
    docs = df.select(F.col(id).alias("id"), F.coalesce(F.col(length).cast("long"), F.lit(0)).alias("tokens"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("tokens") / max_length)).cast("int")
    seqs = docs.select("id", "tokens", F.posexplode(F.sequence(F.lit(0), parts - 1)).alias("part", "__p")).select(
        "id",
        F.col("part").cast("long").alias("part"),
        (F.col("part").cast("long") * max_length).alias("start"),
        F.least(F.lit(max_length).cast("long"), F.col("tokens") - F.col("part").cast("long") * max_length).alias("length"),
    )
    seqs = seqs.withColumn("rounded", F.greatest(F.lit(step).cast("long"), F.ceil(F.col("length") / step) * step))
    seqs = materialize(seqs.withColumn("row", F.monotonically_increasing_id()), "sequences")
    counts = {r["rounded"]: r["n"] for r in seqs.groupBy("rounded").agg(F.count("*").alias("n")).collect()}
    edges = boundaries(counts, buckets)
    sizes = {b: 0 for b in edges}
    for x, n in counts.items():
        sizes[next(b for b in edges if b >= x)] += n
    bucket = F.lit(None).cast("long")
    shards = F.lit(1)
    for b in reversed(edges):
        bucket = F.when(F.col("rounded") <= b, F.lit(b).cast("long")).otherwise(bucket)
    for b, n in sizes.items():
        shards = F.when(F.col("bucket") == b, F.lit(max(1, -(-n // shard)))).otherwise(shards)
    placed = seqs.withColumn("bucket", bucket).withColumn("shard", F.pmod(F.xxhash64("id", "part", "row"), shards).cast("long"))
    order = Window.partitionBy("bucket", "shard").orderBy("id", "part", "length", "row")
    each = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("bucket")))
    numbered = placed.withColumn("at", (F.row_number().over(order) - 1).cast("long"))
    return numbered.select(
        F.col("id").alias(id),
        "part",
        "start",
        "length",
        "bucket",
        F.concat_ws("-", "bucket", "shard", F.floor(F.col("at") / each)).alias("batch"),
        (F.col("at") % each).alias("slot"),
    )


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """Sequences of all documents in tokens, packed into length buckets that minimise padding; odd rows: see pack()."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(with_length(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text"))
