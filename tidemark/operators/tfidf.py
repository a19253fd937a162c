"""TF-IDF of whole groups (G4): a group's documents lie in chunks, its terms in parts.

A chunk counts its documents' terms and hands the distinct ones on, each once, to the part that its words' hashes name. A part adds
up the documents of all chunks, which gives its share of the vocabulary, and hands each chunk the terms of it that are in there. So a term crosses the network
once per chunk that has it, not once per document, and Spark moves a few rows of arrays in place of a row per term of a document. pack_groups() leaves
the weights in their chunks, where clusters and the classifier work on them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.shared import cut, discard, shuffles_freed

#: Characters of a chunk and of the texts whose terms a part has, about; rows that leave a task at once.
CHARS, ROWS = 1 << 21, 1 << 16


@dataclass
class Packed:
    """Weights of whole groups, in one table `matrix` (grp, chunk, part, ids, blobs): part -1 has a chunk's documents and their cells (document, term and
    weight; documents in order, terms by their place among the chunk's own), the other parts the places in them of the chunk's own terms, in this order.
    vocabulary is (grp, part, terms), a part's terms by place."""

    matrix: DataFrame
    vocabulary: DataFrame

    def docs(self) -> DataFrame:
        """(grp, chunk, doc, id): documents and their numbers in the chunk."""
        return self.matrix.where("part < 0").select("grp", "chunk", F.posexplode("ids").alias("doc", "id")).toDF("grp", "chunk", "doc", "id")  # names of its own: it meets the matrix again

    def cells(self, some: DataFrame) -> DataFrame:
        """(grp, id, part, pos, w): the weights of some documents (grp, id)."""
        kind, key = (self.matrix.schema["grp"].dataType.simpleString(), self.matrix.schema["ids"].dataType.elementType.simpleString())
        asked = self.docs().join(some.select("grp", "id").distinct(), ["grp", "id"]).select("grp", "chunk", "doc")
        return self.matrix.groupBy("grp", "chunk").cogroup(asked.groupBy("grp", "chunk")).applyInArrow(_cells, f"grp {kind}, id {key}, part long, pos long, w double")


def weigh_groups(docs: DataFrame, min_df: int, max_df: float, min_docs: int, text: str, stop_words: tuple[str, ...], chars: int = CHARS) -> DataFrame:
    """(grp, id, term, w) for docs (grp, id and a text), a row per document; see text.tfidf()."""
    counted, spread, kind, key = _counted(docs, min_docs, text, stop_words, chars, chars, None)
    vocab = _words(counted, spread).applyInArrow(_vocabulary(min_df, max_df), f"grp {kind}, chunk long, terms array<string>, blobs array<binary>")
    rows = counted.where("part < 0").select("grp", "chunk", "ids", "blobs")
    return rows.repartition(spread, "grp", "chunk").groupBy("grp", "chunk").cogroup(vocab.repartition(spread, "grp", "chunk").groupBy("grp", "chunk")).applyInArrow(_weigh, f"grp {kind}, id {key}, term string, w double")


def pack_groups(docs: DataFrame, min_df: int, max_df: float, min_docs: int, text: str, stop_words: tuple[str, ...], chars: int = CHARS, part_chars: int = CHARS, learn: str | None = None) -> Packed:
    """The same weights, packed. Only documents whose column `learn` is true count for vocabulary and idf, all if it is not given; the others lie in
    chunks of their own, with odd numbers. Documents without weights stay in their chunks. Chunks and parts are of about `chars` and `part_chars` characters."""
    with shuffles_freed(docs.sparkSession):
        counted, spread, kind, key = _counted(docs, min_docs, text, stop_words, chars, part_chars, learn)
        vocab = cut(_words(counted, spread).applyInArrow(_numbered(min_df, max_df), f"grp {kind}, chunk long, part long, terms array<string>, blobs array<binary>"), "vocabulary")
        rows = counted.where("part < 0").select("grp", "chunk", "ids", "blobs")
        places = vocab.where("chunk >= 0").select("grp", "chunk", "part", "blobs").repartition(spread, "grp", "chunk")
        packed = rows.repartition(spread, "grp", "chunk").groupBy("grp", "chunk").cogroup(places.groupBy("grp", "chunk")).applyInArrow(_pack, f"grp {kind}, chunk long, part long, ids array<{key}>, blobs array<binary>")
        packed = cut(packed, "packed")
        discard(counted)
        terms = cut(vocab.where("chunk < 0").select("grp", "part", "terms"), "terms")
        discard(vocab)  # most of it are the chunks' places
    return Packed(packed, terms)


def _counted(docs: DataFrame, min_docs: int, text: str, stop_words: tuple[str, ...], chars: int, part_chars: int, learn: str | None) -> tuple[DataFrame, int, str, str]:
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes are much work here: partitions are not to be joined by size
    kind, key = (docs.schema[c].dataType.simpleString() for c in ("grp", "id"))
    docs = cut(docs.select("grp", "id", F.col(text).alias("text"), (F.lit(True) if learn is None else F.col(learn)).alias("learn")), "texts")
    held = F.sum(F.char_length("text")) + 1
    sizes = docs.groupBy("grp").agg(F.count_distinct(F.when(F.col("learn"), F.col("id"))).alias("n_docs"), F.ceil(held / chars).alias("chunks"), F.ceil(held / part_chars).alias("parts")).where(F.col("n_docs") >= min_docs)
    placed = docs.join(sizes, "grp").withColumn("chunk", F.pmod(F.xxhash64("id"), F.coalesce("chunks", F.lit(1)))).drop("chunks")
    if learn is not None:
        placed = placed.withColumn("chunk", 2 * F.col("chunk") + F.when(F.col("learn"), 0).otherwise(1))
    schema = f"grp {kind}, chunk long, part long, n_docs long, ids array<{key}>, terms array<string>, blobs array<binary>"
    counts = cut(placed.repartition(spread, "grp", "chunk").groupBy("grp", "chunk").applyInArrow(_count(stop_words), schema), "counts")
    discard(docs)
    return counts, spread, kind, key


def _words(counted: DataFrame, spread: int):
    words = counted.where("part >= 0").select("grp", "chunk", "part", "n_docs", "terms", "blobs")
    return words.repartition(spread, "grp", "part").groupBy("grp", "part")


def _blobs(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a, "i4" if a.dtype.kind in "iu" else "f8").tobytes() for a in arrays]


def _count(stop_words: tuple[str, ...]) -> Callable:
    def run(docs: pa.Table) -> pa.Table:
        """A chunk's documents by their terms, and for each part the terms with the documents that have them."""
        text = docs["text"].combine_chunks().cast(pa.large_string())
        listed = pc.split_pattern(text, " ")
        coded = listed.flatten().dictionary_encode()
        words = coded.dictionary
        good = pc.and_(pc.greater_equal(pc.utf8_length(words), 2), pc.invert(pc.is_in(words, pa.array(stop_words, pa.large_string())))).to_numpy(zero_copy_only=False)
        word, doc = coded.indices.to_numpy(), pc.list_parent_indices(listed).to_numpy()
        kept = good[word]
        word, doc = word[kept].astype("i8"), doc[kept].astype("i8")
        near, many = np.flatnonzero(doc[1:] == doc[:-1]), len(words)
        code, of = np.unique(np.concatenate([word, many * (1 + word[near]) + word[near + 1]]), return_inverse=True)
        cell, tf = np.unique(np.concatenate([doc, doc[near]]) * max(1, len(code)) + of, return_counts=True)
        doc, term = cell // max(1, len(code)), cell % max(1, len(code))
        df = np.bincount(term[docs["learn"].to_numpy()[doc]], minlength=len(code))
        single = int(np.searchsorted(code, many))
        left, right = words.take(pa.array(code[single:] // max(1, many) - 1)), words.take(pa.array(code[single:] % max(1, many)))
        terms = pa.concat_arrays([words.take(pa.array(code[:single])), pc.binary_join_element_wise(left, right, pa.scalar(" ", pa.large_string()))])
        hashed = np.array([zlib.crc32(w.encode()) for w in words.to_pylist()], "u8")
        parts, n_docs, chunk = docs["parts"][0].as_py() or 1, docs["n_docs"][0].as_py(), docs["chunk"][0].as_py()
        both = hashed[code[single:] // max(1, many) - 1] * np.uint64(0x9E3779B97F4A7C15) + hashed[code[single:] % max(1, many)]
        part = ((np.concatenate([hashed[code[:single]], both]) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        out = [(-1, docs["id"].to_pylist(), _blobs(np.bincount(doc, minlength=len(docs)), term, tf))]
        out += [(p, None, _blobs(order[a:b], df[order[a:b]])) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        lists = pa.ListArray.from_arrays(pa.array([0, *cuts], pa.int32()), terms.take(pa.array(order)).cast(pa.string()))  # the first row has none
        n = len(out)
        columns = [docs["grp"].combine_chunks().take(pa.array([0] * n)), pa.array([chunk] * n, pa.int64()), pa.array([o[0] for o in out], pa.int64()), pa.array([n_docs] * n, pa.int64())]
        columns += [pa.array([o[1] for o in out], pa.list_(docs.schema.field("id").type)), lists, pa.array([o[2] for o in out], pa.list_(pa.binary()))]
        return pa.table(columns, names=["grp", "chunk", "part", "n_docs", "ids", "terms", "blobs"])

    return run


def _flat(lists: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """All values of a column of lists, and where each list's begin, with the end of all."""
    lists = lists.combine_chunks()
    return lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype("i8")


def _vocabulary(min_df: int, max_df: float) -> Callable:
    def run(rows: pa.Table) -> pa.Table:
        """The part's terms in at least min_df and at most that part of the documents, as each chunk has them, with idf."""
        terms, _, place, fits, idf, cuts = _fitting(rows, min_df, max_df)
        ends = np.concatenate([[0], np.cumsum(fits)])[cuts]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), terms.filter(pa.array(fits)))
        out = [_blobs(place[a:b][fits[a:b]], idf[a:b][fits[a:b]]) for a, b in zip(cuts, cuts[1:])]
        return pa.table([rows["grp"], rows["chunk"], lists, pa.array(out, pa.list_(pa.binary()))], names=["grp", "chunk", "terms", "blobs"])

    return run


def _fitting(rows: pa.Table, min_df: int, max_df: float) -> tuple:
    """A part's terms as its chunks have them, their codes, places in the chunks, whether they are in the vocabulary, idf, and where each chunk's begin."""
    terms, cuts = _flat(rows["terms"])
    blobs, n = rows["blobs"].to_pylist(), rows["n_docs"][0].as_py()
    place, own = (np.concatenate([np.frombuffer(b[k], "i4") for b in blobs]) for k in range(2))
    coded = terms.dictionary_encode()
    of = coded.indices.to_numpy()
    df = np.bincount(of, own, len(coded.dictionary))
    fits = ((df >= min_df) & (df <= max_df * n))[of]
    idf = (np.log((1.0 + n) / (1.0 + df)) + 1.0)[of]
    return terms, coded, place, fits, idf, cuts


def _numbered(min_df: int, max_df: float) -> Callable:
    def run(rows: pa.Table) -> pa.Table:
        """The part's vocabulary, in order, as a row of chunk -1; for each chunk where it has the terms, idf and their places in the part."""
        _, coded, place, fits, idf, cuts = _fitting(rows, min_df, max_df)
        of = coded.indices.to_numpy()
        known = np.unique(of[fits])
        names = coded.dictionary.take(pa.array(known))
        order = pc.sort_indices(names).to_numpy()
        pos = np.full(len(coded.dictionary), -1)
        pos[known[order]] = np.arange(len(known))
        out = [None]
        for a, b in zip(cuts, cuts[1:]):
            at = np.flatnonzero(fits[a:b]) + a
            at = at[np.argsort(pos[of[at]], kind="stable")]
            out.append(_blobs(place[at], idf[at], pos[of[at]]))
        n = len(out)
        lists = pa.ListArray.from_arrays(pa.array([0] + [len(names)] * n, pa.int32()), names.take(pa.array(order)))
        group = rows["grp"].combine_chunks().take(pa.array([0] * n))
        columns = [group, pa.array([-1, *rows["chunk"].to_pylist()], pa.int64()), pa.array([rows["part"][0].as_py()] * n, pa.int64()), lists, pa.array(out, pa.list_(pa.binary()))]
        return pa.table(columns, names=["grp", "chunk", "part", "terms", "blobs"])

    return run


def _pack(rows: pa.Table, vocab: pa.Table) -> pa.Table:
    """A chunk's matrix by documents, of unit rows, and for each part the places of the terms that the chunk has."""
    sizes, term, tf = (np.frombuffer(b, "i4") for b in rows["blobs"][0].as_py())
    vocab = vocab.sort_by("part")
    doc, blobs = np.repeat(np.arange(len(sizes)), sizes), vocab["blobs"].to_pylist()
    place, idf = np.concatenate([np.frombuffer(b[0], "i4") for b in blobs]), np.concatenate([np.frombuffer(b[1], "f8") for b in blobs])
    at = np.full(1 + max(term.max(initial=0), place.max(initial=0)), -1)
    at[place] = np.arange(len(place))
    known = at[term] >= 0
    doc, at = doc[known], at[term[known]]
    w = tf[known] * idf[at]
    w /= np.sqrt(np.bincount(doc, w * w, len(sizes)))[doc]
    n = 1 + len(blobs)
    ids = pa.array([rows["ids"][0].as_py()] + [None] * (n - 1), rows.schema.field("ids").type)
    columns = [rows["grp"].combine_chunks().take(pa.array([0] * n)), pa.array([rows["chunk"][0].as_py()] * n, pa.int64()), pa.array([-1, *vocab["part"].to_pylist()], pa.int64()), ids]
    return pa.table([*columns, pa.array([_blobs(doc, at, w), *([np.frombuffer(b[2], "i4").astype("i8").tobytes()] for b in blobs)], pa.list_(pa.binary()))], names=["grp", "chunk", "part", "ids", "blobs"])


def opened(chunk: pa.Table) -> tuple:
    """Of a chunk's rows of the matrix: ids, documents, terms and weights of the cells; parts, their places, and where each part's terms begin."""
    chunk = chunk.sort_by("part")
    ids, blobs = chunk["ids"].combine_chunks()[:1].flatten(), chunk["blobs"].to_pylist()
    pos = [np.frombuffer(b[0], "i8") for b in blobs[1:]]
    return ids, *(np.frombuffer(b, t) for b, t in zip(blobs[0], ("i4", "i4", "f8"))), chunk["part"].to_numpy()[1:], pos, np.cumsum([0] + [len(p) for p in pos])


def _cells(chunk: pa.Table, asked: pa.Table) -> pa.Table:
    ids, doc, term, w, parts, pos, first = opened(chunk)
    wanted = np.zeros(len(ids), bool)
    wanted[asked["doc"].to_numpy()] = True
    cell = np.flatnonzero(wanted[doc])
    at = term[cell]
    part = np.repeat(parts, np.diff(first))[at]
    columns = [ids.take(pa.array(doc[cell])), pa.array(part, pa.int64()), pa.array(np.concatenate([*pos, np.zeros(0, "i8")])[at]), pa.array(w[cell])]
    return pa.table([chunk["grp"].combine_chunks().take(pa.array(np.zeros(len(cell), "i8"))), *columns], names=["grp", "id", "part", "pos", "w"])


def _weigh(rows: pa.Table, vocab: pa.Table) -> pa.Table:
    """Weights of a chunk's documents, of unit length."""
    ids, (sizes, term, tf) = rows["ids"].combine_chunks().flatten(), (np.frombuffer(b, "i4") for b in rows["blobs"][0].as_py())
    doc, blobs = np.repeat(np.arange(len(sizes)), sizes), vocab["blobs"].to_pylist()
    place, idf = np.concatenate([np.frombuffer(b[0], "i4") for b in blobs]), np.concatenate([np.frombuffer(b[1], "f8") for b in blobs])
    at = np.full(1 + max(term.max(initial=0), place.max(initial=0)), -1)
    at[place] = np.arange(len(place))
    known = at[term] >= 0
    doc, at = doc[known], at[term[known]]
    w = tf[known] * idf[at]
    w /= np.sqrt(np.bincount(doc, w * w, len(sizes)))[doc]
    names, out = _flat(vocab["terms"])[0], []
    for low in range(0, max(1, len(w)), ROWS):
        d, a = pa.array(doc[low : low + ROWS]), pa.array(at[low : low + ROWS])
        out.append(pa.table([rows["grp"].combine_chunks().take(pa.array(np.zeros(len(d), "i8"))), ids.take(d), names.take(a), pa.array(w[low : low + ROWS])], names=["grp", "id", "term", "w"]))
    return pa.concat_tables(out)
