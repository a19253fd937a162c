"""Importance resampling towards a target (operator 11), over hashed word n-grams.

A batch's texts are joined with separator sentinels and one regular expression pass finds all their words; searchsorted over
the documents' offsets tells each word's document and masks n-grams that would cross into the next one; bincount adds up buckets
over the batch and gains over documents. Two passes read the texts: the first counts buckets over all documents, the second weighs them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import append_columns, map_arrow, materialize, partitions, quoted, table, unused
from tidemark.llm.units import in_slices

N_GRAM, BUCKETS, MIN_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")  # over UTF-8 bytes: a letter or digit, and all bytes of characters beyond ASCII
_SENTINEL = b"\x00"
#: Words of a batch that are looked at together, and bytes of words that a task remembers the buckets of.
WORDS_AT_ONCE, REMEMBERED = 1 << 18, 32 << 20


class _Hashes(dict):
    """The crc32 of each word; forgets all when its words fill too many bytes."""

    held = 0

    def __missing__(self, word: bytes) -> int:
        self.held += len(word) + 100
        if self.held > REMEMBERED:
            self.clear()
            self.held = len(word) + 100
        self[word] = value = crc32(word)
        return value


def features(texts: list[str | None], hashes: _Hashes, n_gram: int = N_GRAM, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(documents of words, documents of features, buckets of features) in pieces of a batch of texts."""
    data = pc.ascii_lower(pa.array(texts, pa.string()).fill_null(""))
    sizes = pc.binary_length(data).to_numpy().astype(np.int64) + len(_SENTINEL)
    ends = np.cumsum(sizes)
    joined = _SENTINEL.join(data.cast(pa.binary()).to_pylist())
    found, kept = _WORD.finditer(joined), []
    while some := list(islice(found, WORDS_AT_ONCE)):
        fresh = len(kept)  # the last words of the piece before: n-grams may start there
        words = kept + [m[0] for m in some]
        at = np.fromiter((m.start() for m in some), np.int64, len(some))
        owner = np.searchsorted(ends, at, side="right")
        if fresh:
            owner = np.concatenate([before, owner])
        first = np.fromiter(map(hashes.__getitem__, words), np.int64, len(words))
        of, hashed = [owner[fresh:]], [first[fresh:]]
        run = first.tolist() if n_gram > 1 else []
        for n in range(2, n_gram + 1):
            run = [crc32(b" " + word, c) for word, c in zip(words[n - 1 :], run)]
            whole = owner[n - 1 :] == owner[: len(words) - n + 1]
            whole[: max(0, fresh - n + 1)] = False  # counted with the piece before
            of.append(owner[n - 1 :][whole])
            hashed.append(np.array(run, np.int64)[whole] if run else np.zeros(0, np.int64))
        yield owner[fresh:], np.concatenate(of), np.concatenate(hashed) % buckets
        if n_gram > 1:
            kept, before = words[1 - n_gram :], owner[1 - n_gram :]


def bucket_counts(df: DataFrame, text: str = "text", n_gram: int = N_GRAM, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts each bucket has. A task hands on a row per bucket, and `buckets` sums come to the driver."""

    def count(batches):
        total, hashes = np.zeros(buckets, np.int64), _Hashes()
        for batch in batches:
            for _, some in in_slices(batch.column("text").to_pylist()):
                for _, _, at in features(some, hashes, n_gram, buckets):
                    total += np.bincount(at, minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(total[full], pa.int64())], names=["bucket", "n"])

    sums = map_arrow(df.select(F.col(text).alias("text")), count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket: a thousand times the log ratio of its smoothed shares in target and source, floored."""
    all_source, all_target = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1) * all_source / ((s + 1) * all_target))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weigh(df: DataFrame, gain: np.ndarray, id: str = "doc_id", text: str = "text", n_gram: int = N_GRAM, seed: int = SEED) -> DataFrame:
    """df without its texts, with n_words, n_features, weight (floored mean gain of the features) and score (weight and Gumbel noise by the id), all long.

    A null or empty text has no words and weight 0; the noise of a null id is that of the empty string. Rows are independent, columns of df with these names are replaced.
    """
    buckets = len(gain)

    def make():
        hashes = _Hashes()

        def some(part: list[str | None]) -> tuple:
            words, count, total = (np.zeros(len(part), np.int64) for _ in range(3))
            for owner, of, at in features(part, hashes, n_gram, buckets):
                words += np.bincount(owner, minlength=len(part))
                count += np.bincount(of, minlength=len(part))
                total += np.bincount(of, weights=gain[at], minlength=len(part)).astype(np.int64)  # whole numbers far below 2^53
            return words, count, np.where(count > 0, total // np.maximum(1, count), 0)

        def compute(batch: pa.RecordBatch) -> list:
            found = [some(part) for _, part in in_slices(batch.column(text).to_pylist())]
            words, count, weight = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
            noise = np.array([math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) for h in batch.column(drawn).to_pylist()], np.int64)
            return [pa.array(x, pa.int64()) for x in (words, count, weight, weight + noise)]

        return compute

    drawn = unused(df, "drawn")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))).cast("binary"), 256)
    with_draw = df.withColumn(drawn, F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long"))
    return append_columns(with_draw, {k: "long" for k in ("n_words", "n_features", "weight", "score")}, make, without=(text, drawn))


def draw(weighed: DataFrame, id: str = "doc_id", percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """weighed with rank (1, 2, ...) for the documents drawn, null for the others: of those with min_words words or more, floor(percent %) with
    the highest scores, ties to the smaller id (null ids last); repeated rows each count.

    Scores are whole numbers within some ten thousands, so a count per score says where the draw ends. Drawn rows are sorted in
    ranges of (score, id), and the ranges' sizes, a row each, shift the places within them: no task sorts more than a range.
    """
    taken = {c: unused(weighed, c) for c in ("fits", "tie", "place")}
    fits, tie, place = taken.values()
    rows = materialize(weighed.withColumn(fits, F.col("n_words") >= min_words).withColumn(tie, F.monotonically_increasing_id()), "weighed")
    per_score = sorted(((r["score"], r["n"]) for r in rows.where(fits).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    wanted = percent * sum(n for _, n in per_score) // 100
    least, above = None, 0
    for score, n in per_score:
        if above >= wanted:
            break
        least, above = score, above + n
    if least is None:
        return rows.drop(fits, tie).withColumn("rank", F.lit(None).cast("long"))
    high = F.col(fits) & (F.col("score") >= least)
    order = [F.desc("score"), F.asc_nulls_last(id), F.asc(tie)]
    parts = partitions(rows.sparkSession)
    ranged = rows.where(high).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = materialize(ranged.withColumn(place, F.monotonically_increasing_id()), "drawn")
    sizes = placed.groupBy(F.shiftright(place, 33).cast("int").alias("range")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row per range
    before, so_far = {}, 0
    for r in sorted(sizes, key=lambda r: r["range"]):
        before[r["range"]] = so_far
        so_far += r["n"]
    shift = F.element_at(F.create_map(*[x for k, n in before.items() for x in (F.lit(k), F.lit(n).cast("long"))]), F.shiftright(place, 33).cast("int"))
    rank = shift + F.col(place).bitwiseAND((1 << 33) - 1) + 1
    ranked = placed.withColumn("rank", F.when(rank <= wanted, rank)).drop(place)
    return ranked.unionByName(rows.where(~high).withColumn("rank", F.lit(None).cast("long"))).drop(fits, tie)


def resample(source: DataFrame, target: DataFrame, percent: int = PERCENT, id: str = "doc_id", text: str = "text", n_gram: int = N_GRAM, buckets: int = BUCKETS, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """source without its texts, with n_words, n_features, weight, score and rank; see weigh() and draw(). target has the same text column. Empty tables: without a target
    all buckets are alike in it; an empty source gives an empty result."""
    gain = gains(bucket_counts(source, text, n_gram, buckets), bucket_counts(target, text, n_gram, buckets))
    kept = [c for c in source.columns if c.lower() != "rank"]
    return draw(weigh(source.select(quoted(kept)), gain, id, text, n_gram, seed), id, percent, min_words)


def op11_resampling(spark, sf_dir: str) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank in the draw of 10 % towards the texts of benchmark."""
    source, target = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text")
    return resample(source, target).select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 by its definition: eight shifts for each byte, for distinct words.
OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
dw AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(words) AS word FROM d) GROUP BY r, word),
bw AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM b) GROUP BY word),
v AS (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM bw)),
h AS (SELECT word, (xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(word)) + 1),
  lambda i: ('0x' || substr(hex(encode(word)), 2 * i - 1, 2))::BIGINT)),
  lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295) % 10000) AS bucket FROM v),
s AS (SELECT bucket, sum(n) AS n FROM dw JOIN h USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS n FROM bw JOIN h USING (word) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM dw) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM bw) + 10000)::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
f AS (SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM dw JOIN h USING (word) JOIN g USING (bucket) GROUP BY r),
x AS (SELECT r, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score FROM d LEFT JOIN f USING (r)),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM x WHERE n_features >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM x LEFT JOIN k USING (r)
"""
