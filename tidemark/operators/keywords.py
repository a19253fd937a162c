"""Keyword search over an index of character trigrams (C3e at scale).

An index is two Parquet tables, and an empty one with the records' columns. `rows` holds the records, each with a number, in FOLDERS folders. `postings` holds, for
each trigram and block of records, the numbers of the records whose lower-case text has it, as distances from the first;
it lies in SLOTS folders, sorted by trigram. A search reads the slots of a few trigrams, intersects their records, and
reads only the folders of what is left, where every word is looked for in the text itself; so its rows are those of
search.has_words() over all records.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.shared import cut, spread
from tidemark.operators.search import has_words

#: Folders of records and of trigrams; a prime number of the latter mixes all three characters.
FOLDERS, SLOTS = 256, 61
#: (record, trigram) pairs of a block, which a task holds at once; a longer text is a block of its own.
BLOCK = 1 << 21
#: Trigrams of a search that are intersected, the rarest ones; those left out only make the check of texts longer.
RAREST = 8
ROW, FOLDER = "__row", "__folder"


def trigrams(text: str) -> np.ndarray:
    """The distinct trigrams of a text, three code points of 21 bits in a number each."""
    x = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.unique(x[:-2] << 42 | x[1:-1] << 21 | x[2:]) if len(x) > 2 else np.zeros(0, np.int64)


def _block(rows: list[int], grams: list[np.ndarray]) -> pa.RecordBatch:
    """(gram, first, offsets): the records that hold each trigram, ascending."""
    gram, row = np.concatenate(grams), np.repeat(np.array(rows, np.int64), [len(g) for g in grams])
    order = np.lexsort((row, gram))
    gram, row = gram[order], row[order]
    start = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    ends = np.r_[start, len(gram)]
    offsets = row - np.repeat(row[start], np.diff(ends))
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(offsets))
    return pa.RecordBatch.from_arrays([pa.array(gram[start]), pa.array(row[start]), lists], names=["gram", "first", "offsets"])


def _postings(batches):
    rows, grams, held = [], [], 0
    for batch in batches:
        for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
            found = trigrams(text or "")
            if len(found):
                rows.append(row)
                grams.append(found)
                held += len(found)
            if held >= BLOCK:
                yield _block(rows, grams)
                rows, grams, held = [], [], 0
    if held:
        yield _block(rows, grams)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    columns = spark.read.parquet(f"{path}/columns").schema
    return spark.read.schema(T.StructType([*columns, T.StructField(ROW, T.LongType()), T.StructField(FOLDER, T.LongType())])).parquet(f"{path}/rows")


def build_index(records: DataFrame, path: str, text: str = "text") -> None:
    """Write the index of records to the folder at path, which must be new.

    All columns are kept, repeated rows too. Null texts and those of fewer than three characters have no trigrams and are
    found by searches that scan. A trigram that most records hold is a row per block, dealt over as many files as its
    blocks need.
    """
    row = F.monotonically_increasing_id()
    numbered = spread(records).withColumn(ROW, row).withColumn(FOLDER, F.shiftright(ROW, 33) % FOLDERS)
    numbered.write.partitionBy(FOLDER).parquet(f"{path}/rows")
    records.limit(0).write.parquet(f"{path}/columns")
    stored = _stored(records.sparkSession, path)  # numbers as written, whatever is computed anew
    blocks = stored.select(F.col(ROW).alias("row"), F.lower(F.col(text)).alias("text")).mapInArrow(_postings, "gram long, first long, offsets array<bigint>")
    blocks = blocks.withColumn("slot", F.pmod(F.col("gram"), F.lit(SLOTS)).cast("int")).withColumn("n", F.size("offsets"))
    blocks = cut(blocks, "blocks")  # ranges are found in one pass and filled in another
    blocks = blocks.repartitionByRange("slot", "gram", "first").sortWithinPartitions("slot", "gram", "first")
    blocks.write.partitionBy("slot").parquet(f"{path}/postings")


def wanted(words: str) -> np.ndarray:
    """The trigrams that a text with all the words holds."""
    found = [trigrams(w.lower()) for w in words.split()]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def postings_of(spark: SparkSession, path: str, grams: list[int]) -> DataFrame:
    """The blocks of some trigrams: other slots are not read, other parts of a slot's files are skipped by their bounds."""
    table = spark.read.schema("gram long, first long, offsets array<bigint>, n int, slot int").parquet(f"{path}/postings")
    return table.where(F.col("slot").isin(sorted({g % SLOTS for g in grams})) & F.col("gram").isin(grams))


def search_index(spark: SparkSession, path: str, words: str, text: str = "text") -> DataFrame:
    """C3e: the records whose text has every word, as has_words() finds them, with all their columns.

    A search whose words all have fewer than three characters has no trigram and scans all texts; one without words
    returns all records. The driver gets a row per trigram of the words and one per folder.
    """
    stored = _stored(spark, path)
    columns = [c for c in stored.columns if c not in (ROW, FOLDER)]
    grams = wanted(words).tolist()
    if grams:
        sizes = {r["gram"]: r["n"] for r in postings_of(spark, path, grams).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        if len(sizes) < len(grams):
            return stored.where(F.lit(False)).select(columns)
        rarest = sorted(grams, key=lambda g: (sizes[g], g))[:RAREST]
        rows = postings_of(spark, path, rarest).select(F.explode("offsets").alias("offset"), "first").select((F.col("first") + F.col("offset")).alias(ROW))
        candidates = rows.groupBy(ROW).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rarest)).select(ROW)
        folders = candidates.select((F.shiftright(ROW, 33) % FOLDERS).alias(FOLDER)).distinct().collect()
        stored = stored.where(F.col(FOLDER).isin([r[FOLDER] for r in folders])).join(candidates, ROW, "left_semi")
    return stored.where(has_words(F.col(text), words)).select(columns)
