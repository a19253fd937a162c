"""Document fingerprints (operator 2): a canonical exact digest.

Texts are folded (Unicode NFKC, case, white space) and digested by 128-bit xxhash. Inside each bucket of
equal digests the folded bytes are compared: should two different texts ever share a digest, every class
of the bucket gets its own suffix. Grouping combines on the map side, so a class of copies with a
third of all rows reaches the shuffle as a row per task.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import append_columns, map_arrow, materialize, partitions, table
from tidemark.llm.ranges import ranges_of

#: Hexadecimal digits of a digest by which rows are told that can't have an equal: the fewest, within these bounds, that give 32 or
#: more prefixes to a repeated digest. The table of prefixes has 16 ** digits bits, 2 MB at most.
PREFIX_DIGITS = (4, 6)
SLICE = 1 << 16  # bits of that table that a task packs at a time


def canonical(text: str | None) -> str:
    """NFKC, case folded, NFKC again, runs of white space as one space and none at the ends; null is empty."""
    if not text:
        return ""
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split())


def wide_digest(folded: str) -> str:
    return xxhash.xxh3_128_hexdigest(folded.encode("utf-8", "surrogatepass"))


def sha256(folded: str) -> bytes:
    return hashlib.sha256(folded.encode("utf-8", "surrogatepass")).digest()


def bitmap(numbers: DataFrame, size: int) -> bytes:
    """Packed bits, of which those at the numbers p (0 to size - 1, repeats allowed) are set; none for an empty table.

    Tasks pack a slice of at most SLICE distinct numbers each, so the driver gets the bits alone, size / 8 bytes.
    """
    width = min(size, SLICE)

    def pack(found: pd.DataFrame) -> pd.DataFrame:
        marks = np.zeros(width, bool)
        marks[found["p"].to_numpy() % width] = True
        return pd.DataFrame({"slice": [found["p"].iloc[0] // width], "bits": [np.packbits(marks).tobytes()]})

    slices = numbers.distinct().groupBy(F.floor(F.col("p") / width)).applyInPandas(pack, "slice long, bits binary")
    parts = {r["slice"]: r["bits"] for r in slices.collect()}  # size / SLICE rows
    return b"".join(parts.get(k, bytes(width // 8)) for k in range(size // width))


def split_classes(digests: DataFrame, texts: DataFrame, digest_of: Callable[[str], str] = wide_digest) -> DataFrame:
    """The classes (digest, folded bytes, class number) of buckets in which different texts share a digest.

    digests has a row per document with its digest; texts has the texts. Only documents whose
    digest's leading digits belong to a digest found more than once are compared. With some millions of repeated digests
    most documents are, and their texts cross the network again.
    """
    repeated = materialize(digests.groupBy("digest").count().filter("count > 1").select("digest"), "repeated")
    n, (least, most) = repeated.count(), PREFIX_DIGITS
    digits = next((d for d in range(least, most) if 16**d >= 32 * n), most)
    prefix = F.conv(F.substring("digest", 1, digits), 16, 10).cast("int")
    packed = bitmap(repeated.select(prefix.alias("p")), 16**digits)

    def fold(batches):
        marked, pack = np.unpackbits(np.frombuffer(packed, np.uint8)), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                digest = digest_of(folded := canonical(text))
                if marked[int(digest[:digits], 16)]:
                    rows.append((digest, pack.compress(folded.encode("utf-8", "surrogatepass")), sha256(folded)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.binary(), pa.binary()))], names=["digest", "bytes", "folded"])

    # equal bytes compress to equal bytes, and different ones to different ones
    classes = map_arrow(texts.select("text"), fold, "digest string, bytes binary, folded binary").groupBy("digest", "bytes").agg(F.min("folded").alias("folded"))
    clashing = classes.groupBy("digest").agg(F.array_sort(F.collect_list("folded")).alias("order")).filter(F.size("order") > 1)
    return clashing.select("digest", F.posexplode("order").alias("class", "folded"))


def resolve(df: DataFrame, classes: DataFrame, digest: str, folded: str, name: str) -> DataFrame:
    """df with the fingerprint for its columns of digests and of folded texts' SHA-256; digest and folded are dropped.

    A text in a clashing bucket that is none of the documents' gets a suffix of its own.
    """
    c = classes.select(F.col("digest").alias("__d"), F.col("folded").alias("__f"), F.col("class").cast("string").alias("__c"))
    clash = c.select(F.col("__d").alias("__e")).distinct()
    found = df.join(c, (F.col(digest) == F.col("__d")) & (F.col(folded) == F.col("__f")), "left").join(clash, F.col(digest) == F.col("__e"), "left")
    suffix = F.coalesce("__c", F.lower(F.hex(folded)))
    return found.withColumn(name, F.when(F.col("__e").isNull(), F.col(digest)).otherwise(F.concat_ws("-", F.col(digest), suffix))).drop("__d", "__e", "__f", "__c", digest, folded)


def resolved(df: DataFrame, classes: DataFrame, names: dict[str, tuple[str, str]]) -> DataFrame:
    """resolve() for every name: (digest, folded). Without a clash, which is the rule, digests are fingerprints and nothing is joined."""
    classes = materialize(classes, "classes")
    if classes.isEmpty():
        return df.withColumnsRenamed({digest: name for name, (digest, _) in names.items()}).drop(*[folded for _, folded in names.values()])
    for name, (digest, folded) in names.items():
        df = resolve(df, classes, digest, folded, name)
    return df


def fingerprint(df: DataFrame, id: str = "doc_id", text: str = "text", digest_of: Callable[[str], str] = wide_digest) -> DataFrame:
    """One row per row of df: id, n_chars, fingerprint.

    A fingerprint is the digest, with a suffix only in buckets where different folded texts share it, so
    equal fingerprints mean equal folded bytes. Null and empty texts are alike; other columns are ignored;
    repeated rows stay; an empty table gives an empty result.
    """

    def make():
        def compute(batch: pa.RecordBatch) -> list:
            texts = batch.column("text").to_pylist()
            folded = [canonical(t) for t in texts]
            return [pa.array([len(t or "") for t in texts], pa.int64()), pa.array([digest_of(f) for f in folded], pa.string()), pa.array([sha256(f) for f in folded], pa.binary())]

        return compute

    docs = df.select(F.col(id).alias("id"), F.col(text).alias("text"))
    found = materialize(append_columns(docs, {"n_chars": "long", "digest": "string", "folded": "binary"}, make).drop("text"), "digests")
    return resolved(found, split_classes(found, docs, digest_of), {"fingerprint": ("digest", "folded")}).withColumnRenamed("id", id)


def edited_text(text: str, following: str) -> str:
    """The last half of a text's characters replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(df: DataFrame, n: int | None = None, digest_of: Callable[[str], str] = wide_digest) -> DataFrame:
    """doc_id, n_chars, edited_sha256, and digest and folded (SHA-256 of the folded text) of the text, the
    next document's and the edited text, for df(doc_id, text). The next document has the next smaller
    doc_id, and the last one is followed by the first.

    Ties are ordered by their compressed bytes, where an id fills several ranges alone by a hash of the text before
    that; null ids come last. Texts cross the network once, compressed and in ranges of ids; a task streams over its
    range and hands only its first and last document to its neighbours.
    """
    spark = df.sparkSession
    docs = df.select(F.col("doc_id").cast("long").alias("id"), "text")
    ranges = ranges_of(docs, "id", n or partitions(spark))

    def packed():
        pack = zstandard.ZstdCompressor(level=3)

        def compute(batch: pa.RecordBatch) -> list:
            texts = batch.column("text").to_pylist()
            return [pa.array(ranges.bucket_of(batch.column("id"), texts), pa.int32()), pa.array([pack.compress((t or "").encode()) for t in texts], pa.binary())]

        return compute

    placed = append_columns(docs, {"bucket": "int", "packed": "binary"}, packed).select("bucket", "id", "packed").repartitionById(ranges.count, "bucket")
    placed = placed.sortWithinPartitions(F.desc("bucket"), F.desc_nulls_last("id"), "packed")
    kinds = {"kind": pa.string(), "bucket": pa.int32(), "id": pa.int64(), "n_chars": pa.int64(), "digest": pa.string(), "folded": pa.binary(), "next_digest": pa.string(), "next_folded": pa.binary(), "edited_sha256": pa.string(), "edited_digest": pa.string(), "edited_folded": pa.binary(), "packed": pa.binary()}
    schema = "kind string, bucket int, id long, n_chars long, digest string, folded binary, next_digest string, next_folded binary, edited_sha256 string, edited_digest string, edited_folded binary, packed binary"

    def digests(text: str) -> tuple[str, bytes]:
        return digest_of(folded := canonical(text)), sha256(folded)

    def row(a, b):
        (bucket, i, text, own), (_, _, following, others) = a, b
        edited = edited_text(text, following)
        return ("row", bucket, i, len(text), *own, *others, hashlib.sha256(edited.encode()).hexdigest(), *digests(edited), None)

    def record(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], names=list(kinds))

    def stream(batches):
        unpack, last, last_packed, rows = zstandard.ZstdDecompressor(), None, None, []
        for batch in batches:
            for bucket, i, x in zip(*(c.to_pylist() for c in batch.columns)):
                text = unpack.decompress(x).decode()
                here = (bucket, i, text, digests(text))
                rows.append(row(last, here) if last else ("head", bucket, i, len(text), *here[3], None, None, None, None, None, x))
                last, last_packed = here, x
                if len(rows) >= 4096:
                    yield record(rows)
                    rows = []
        if last:
            rows.append(("tail", last[0], last[1], len(last[2]), *last[3], None, None, None, None, None, last_packed))
        if rows:
            yield record(rows)

    done = materialize(map_arrow(placed, stream, schema), "neighbours")
    order = sorted((r["bucket"] for r in done.filter("kind = 'head'").select("bucket").collect()), reverse=True)  # a row per range of ids
    pairs = spark.createDataFrame([(b, order[(k + 1) % len(order)]) for k, b in enumerate(order)], "bucket int, next_bucket int")
    heads = done.filter("kind = 'head'").select(F.col("bucket").alias("next_bucket"), F.struct("packed", "digest", "folded").alias("h"))
    ends = done.filter("kind = 'tail'").join(pairs, "bucket").join(heads, "next_bucket").select(F.struct("bucket", "id", "packed", "digest", "folded").alias("t"), "h")

    def close(batches):
        unpack = zstandard.ZstdDecompressor()
        text = lambda x: unpack.decompress(x).decode()
        for batch in batches:
            found = list(zip(*(c.to_pylist() for c in batch.columns)))
            yield record([row((t["bucket"], t["id"], text(t["packed"]), (t["digest"], t["folded"])), (None, None, text(h["packed"]), (h["digest"], h["folded"]))) for t, h in found])

    both = done.filter("kind = 'row'").unionByName(map_arrow(ends, close, schema))
    return both.withColumnRenamed("id", "doc_id").drop("kind", "bucket", "packed")


def edited_fingerprints(df: DataFrame, digest_of: Callable[[str], str] = wide_digest) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for df(doc_id, text);
    see with_next() and fingerprint(). The likeness of exact digests is 1 or 0."""
    docs = df.select("doc_id", "text")
    found = with_next(docs, digest_of=digest_of)
    names = {"fingerprint": ("digest", "folded"), "next_fingerprint": ("next_digest", "next_folded"), "edited_fingerprint": ("edited_digest", "edited_folded")}
    alike = lambda other: ((F.col("digest") == F.col(f"{other}_digest")) & (F.col("folded") == F.col(f"{other}_folded"))).cast("double")
    classes = split_classes(found, docs, digest_of)
    found = resolved(found.withColumns({"near_edited": alike("edited"), "near_next": alike("next")}), classes, names)
    # an edited text is in no class; where it merely shares the digest of its document it gets a suffix of its own
    own = F.when((F.col("near_edited") == 0) & (F.col("edited_fingerprint") == F.col("fingerprint")), F.concat("edited_fingerprint", F.lit("-edited"))).otherwise(F.col("edited_fingerprint"))
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", own.alias("edited_fingerprint"), "near_edited", "near_next")


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with likenesses; nulls, ties and empty tables: see edited_fingerprints() and with_next()."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))
