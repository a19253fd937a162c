"""Token ids in binary files (operator 6).

Ids are replaced by their frequency rank over the whole corpus, and ranks are written in one to four
bytes each; a separate stream of control bytes holds four two-bit lengths a byte, and a document starts a
new control byte. A file's unit is a block of whole documents: its ids' control bytes and data bytes are
binary columns beside the documents' ids and sizes. Parquet is the container, so that Spark's committer makes
lost executors harmless and any store that Spark reads will do. Blocks follow one another in ascending document order.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenizers import Tokenizer

from tidemark.llm.common import map_arrow, materialize, new_path, partitions, table
from tidemark.llm.ranges import Ranges, ranges_of
from tidemark.llm.units import CACHE_UNITS, encoder, in_slices

BLOCK_IDS = 65_536
SLICE = 1 << 19  # ids that are coded at once
#: For each control byte the bytes of its four numbers.
SIZES = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)


def encode_numbers(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned numbers (16 or 32 bits) that come in runs of the given sizes, and the ends
    of the runs in both. A run starts a new control byte; what a run's last control byte has too many says nothing."""
    width, total = x.dtype.itemsize, len(x)
    length = np.ones(total, np.uint8)
    for bits in range(8, 8 * width, 8):
        length += x >= 1 << bits
    padded = -(-sizes // 4) * 4
    codes = np.zeros(int(padded.sum()), np.uint8)
    codes[np.arange(total) + np.repeat(np.cumsum(padded) - padded - np.cumsum(sizes) + sizes, sizes)] = length - np.uint8(1)
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = x.view(np.uint8).reshape(-1, width)[np.arange(width, dtype=np.uint8) < length[:, None]]
    data_ends = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])[np.cumsum(sizes)]
    return control, data, np.cumsum(padded) // 4, data_ends


def decode_numbers(control: bytes, data: bytes, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all runs, one after another, by a table of lengths."""
    padded, total = -(-sizes // 4) * 4, int(sizes.sum())
    length = SIZES[np.frombuffer(control, np.uint8)].ravel()
    length = length[np.arange(total) + np.repeat(np.cumsum(padded) - padded - np.cumsum(sizes) + sizes, sizes)]
    out = np.zeros((total, 4), np.uint8)
    out[np.arange(4, dtype=np.uint8) < length[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary value up to each end."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _tokens(docs: DataFrame, tokenizer: str, end_id: int, kind: str, ranges: Ranges, cache_units: int) -> DataFrame:
    """A row per document: bucket, id, n and its ids as numbers of `kind`; and a row per task with bucket -1, whose ids are
    pairs (id, number of times) as 64-bit numbers."""
    names = ["bucket", "id", "n", "ids"]

    def run(batches):
        enc, total = encoder(tokenizer, cache_units), np.zeros(0, np.int64)
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text").to_pylist()
            for at, some in in_slices(texts):
                flat, sizes = enc.encode(some)
                flat = np.insert(flat, np.cumsum(sizes), end_id).astype(kind)
                more = np.bincount(flat, minlength=len(total))
                more[: len(total)] += total
                total, here = more, ids.slice(at, len(some))
                yield pa.RecordBatch.from_arrays([pa.array(ranges.bucket_of(here, some), pa.int32()), here, pa.array(sizes + 1, pa.int32()), _binary(flat.view(np.uint8), np.cumsum(sizes + 1) * flat.itemsize)], names=names)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([None], pa.int64()), pa.array([0], pa.int32()), pa.array([np.stack([seen, total[seen]], axis=1).astype("<i8").tobytes()], pa.binary())], names=names)

    return map_arrow(docs, run, "bucket int, id long, n int, ids binary")


def write_token_files(df: DataFrame, tokenizer: str, path: str, end_id: int = 1, id: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS, files: int | None = None, cache_units: int = CACHE_UNITS) -> None:
    """Write the ids of every whole text, and end_id after each, to path/blocks in ascending id order, and
    the ranks to path/ranks (a row per id of the vocabulary at most).

    A null text is the empty one; a null id comes first. Rows with equal ids are ordered by their coded
    bytes, those of an id that fills several ranges alone by a hash of the text before that. Other columns are ignored.
    An empty table gives empty files. Every text is tokenized once; the driver holds the counts of a
    vocabulary and one split point per file.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    ranges = ranges_of(docs, "id", files or partitions(spark))
    kind = "<u2" if max(end_id, *Tokenizer.from_file(tokenizer).get_vocab().values()) < 1 << 16 else "<u4"
    tokens = materialize(_tokens(docs, tokenizer, end_id, kind, ranges, cache_units), "tokens")

    def count(batches):
        total: dict[int, int] = {}
        for batch in batches:
            for x in batch.column("ids").to_pylist():
                for token, n in np.frombuffer(x, "<i8").reshape(-1, 2).tolist():
                    total[token] = total.get(token, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["token", "n"])

    counts = map_arrow(tokens.filter("bucket = -1").select("ids"), count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    counts = counts.sort_values(["n", "token"], ascending=[False, True]).reset_index(drop=True)
    spark.createDataFrame(counts.assign(rank=counts.index)[["rank", "token", "n"]], "rank long, token long, n long").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(int(counts["token"].max()) + 1 if len(counts) else 0, kind)
    rank_of[counts["token"].to_numpy()] = counts.index.to_numpy()

    def code(batches):
        for batch in batches:
            n, ids = batch.column("n").to_numpy().astype(np.int64), batch.column("ids").to_pylist()
            for rows in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) // SLICE)) + 1):
                if len(rows):
                    a, b = int(rows[0]), int(rows[-1]) + 1
                    control, data, control_ends, data_ends = encode_numbers(rank_of[np.frombuffer(b"".join(ids[a:b]), kind)], n[a:b])
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("bucket", "id", "n")), _binary(control, control_ends), _binary(data, data_ends)], names=["bucket", "id", "n", "control", "data"])

    # documents travel coded; each goes to the file of its range of ids
    coded = map_arrow(tokens.filter("bucket >= 0"), code, "bucket int, id long, n int, control binary, data binary")
    placed = coded.repartitionById(ranges.count, "bucket").sortWithinPartitions("id", "bucket", "data", "control")
    names = ["bucket", "block", "start", "n", "ids", "sizes", "control", "data"]

    def blocks(batches):
        at, number, start, held, size = None, 0, 0, [], 0

        def block() -> pa.RecordBatch:
            row = [[at], [number], [start], [size], [[h[0] for h in held]], [[h[1] for h in held]], [b"".join(h[2] for h in held)], [b"".join(h[3] for h in held)]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=names)

        for batch in batches:
            for bucket, i, n, control, data in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (bucket != at or size + n > block_ids):
                    yield block()
                    number, start = (number + 1, start + size) if bucket == at else (0, 0)
                    held, size = [], 0
                at = bucket
                held.append((i, n, control, data))
                size += n
        if held:
            yield block()

    map_arrow(placed, blocks, "bucket int, block long, start long, n long, ids array<long>, sizes array<int>, control binary, data binary").write.option("compression", "zstd").parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before it), ids array<long>."""
    return _read(spark, path, "doc_id long, start long, ids array<long>", lambda ids: ids.tolist(), pa.list_(pa.int64()))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 of its ids as little-endian unsigned 32-bit integers."""
    found = _read(spark, path, "doc_id long, start long, x struct<n_tokens:long,ids_crc32:long>", lambda ids: {"n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4"))}, pa.struct([("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]))
    return found.select("doc_id", "start", "x.n_tokens", "x.ids_crc32")


def _read(spark: SparkSession, path: str, schema: str, result, kind: pa.DataType) -> DataFrame:
    blocks = spark.read.parquet(f"{path}/blocks")
    ranks = spark.read.parquet(f"{path}/ranks").toPandas().sort_values("rank")
    token_of = ranks["token"].to_numpy(np.int64)
    before, sums = {}, {r["bucket"]: r["n"] for r in blocks.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # a row per file
    total = 0
    for bucket in sorted(sums):
        before[bucket], total = total, total + sums[bucket]
    names = [x.split()[0] for x in schema.replace("struct<n_tokens:long,ids_crc32:long>", "x").split(", ")]

    def decode(batches):
        for batch in batches:
            for bucket, start, docs, sizes, control, data in zip(*(c.to_pylist() for c in batch.columns)):
                sizes = np.array(sizes, np.int64)
                ids = token_of[decode_numbers(control, data, sizes)]
                stops = np.cumsum(sizes)
                starts = stops - sizes
                out = [result(ids[a:b]) for a, b in zip(starts.tolist(), stops.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts + start + before[bucket], pa.int64()), pa.array(out, kind)], names=names)

    return map_arrow(blocks.select("bucket", "start", "ids", "sizes", "control", "data"), decode, schema)


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    path = new_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return read_digests(spark, path)
