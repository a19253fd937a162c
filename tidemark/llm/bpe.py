"""Byte-pair encoding and decoding (operator 4).

Words come from the tokenizers library through a cache of distinct units (units.py). A long piece that
no rule splits is encoded by tree concatenation: halves of at most `leaf` symbols are encoded in one parallel batch,
then every join re-encodes a window of tokens around it, doubling the window until its first token is
the left half's and its last token the right half's. All neighbouring tokens of the joined sequence are
then neighbours in some correct encoding, which makes the whole sequence the encoding of the whole piece.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tidemark.llm.common import append_columns, table
from tidemark.llm.units import CACHE_UNITS, encoder, in_slices

LEAF = 32


def tree_concatenate(pieces: list[str], encode_all, leaf: int) -> list[list[int]]:
    """Ids of unsplit pieces. encode_all(list of strings) gives one list of (id, string) per string."""
    leaves, shape = [], []
    for p in pieces:
        n = max(1, -(-len(p) // leaf))
        n = 1 << (n - 1).bit_length()  # a full binary tree
        cuts = [len(p) * i // n for i in range(n + 1)]
        shape.append(n)
        leaves += [p[a:b] for a, b in zip(cuts, cuts[1:])]
    encoded, at, nodes = encode_all(leaves), 0, []
    for n in shape:
        nodes.append(encoded[at : at + n])
        at += n
    while any(len(x) > 1 for x in nodes):  # one level of all trees at a time
        joins = [(i, j) for i, x in enumerate(nodes) for j in range(0, len(x) - 1, 2)]
        windows, joined = {k: 1 for k in joins}, {}
        while windows:
            tries = list(windows)
            around = []
            for i, j in tries:
                left, right, k = nodes[i][j], nodes[i][j + 1], windows[i, j]
                around.append("".join(s for _, s in left[-k:]) + "".join(s for _, s in right[:k]))
            for (i, j), new in zip(tries, encode_all(around), strict=True):
                left, right, k = nodes[i][j], nodes[i][j + 1], windows[i, j]
                left_agrees = k >= len(left) or (new and new[0] == left[-k])
                right_agrees = k >= len(right) or (new and new[-1] == right[k - 1])
                if left_agrees and right_agrees and len(new) >= 2 - (k >= len(left)) - (k >= len(right)):
                    joined[i, j] = left[:-k] + new + right[k:]
                    del windows[i, j]
                else:
                    windows[i, j] = 2 * k
        for i, x in enumerate(nodes):
            if len(x) > 1:
                nodes[i] = [joined[i, j] for j in range(0, len(x) - 1, 2)]
    return [[t for t, _ in x[0]] for x in nodes]


def _encode_long(leaf: int):
    """Encodes a long unit: the library's own split first, then the tree for what stays long."""
    bare: dict[int, Tokenizer] = {}

    def encode(tokenizer: Tokenizer, unit: str) -> list[int]:
        model = bare.setdefault(id(tokenizer), Tokenizer(tokenizer.model))  # no split: a string is one piece

        def encode_all(strings: list[str]) -> list[list[tuple[int, str]]]:
            os.environ["TOKENIZERS_PARALLELISM"] = "true" if len(strings) > 64 else "false"
            found = model.encode_batch_fast(strings, add_special_tokens=False)
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            return [[(i, model.id_to_token(i)) for i in e.ids] for e in found]

        pieces = [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(unit)]
        return [t for ids in tree_concatenate(pieces, encode_all, leaf) for t in ids]

    return encode


class ByteDecoder:
    """Ids to text by tables of the tokens' bytes; bytes that are not UTF-8 become replacement characters."""

    def __init__(self, tokenizer: Tokenizer):
        printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
        others = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        tokens = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
        for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
            tokens[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.sizes = np.array([len(t) for t in tokens])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        sizes = self.sizes[ids]
        stops = np.cumsum(sizes)
        if not len(stops):
            return ""
        return self.flat[np.arange(stops[-1]) + np.repeat(self.starts[ids] - (stops - sizes), sizes)].tobytes().decode("utf-8", "replace")


def encode_texts(df: DataFrame, path: str, text: str = "text", ids: str = "ids", leaf: int = LEAF, cache_units: int = CACHE_UNITS) -> DataFrame:
    """df with an array<int> column of token ids of the whole text; a null text is the empty one, without ids.

    Texts never leave their partition. Rows, ties and repeated rows are independent of one another; a
    column of df with the name of the result is replaced. An empty table gives an empty result.
    """

    def make():
        enc = encoder(path, cache_units, leaf, _encode_long(leaf))

        def compute(batch: pa.RecordBatch) -> list:
            flat, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
            for _, texts in in_slices(batch.column(text).to_pylist()):
                a, b = enc.encode(texts)
                flat.append(a)
                sizes.append(b)
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat).astype(np.int32)))]

        return compute

    return append_columns(df, {ids: "array<int>"}, make)


def decode_ids(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of an array<int> column of ids, special tokens included; null ids give the empty text."""

    def make():
        decoder = ByteDecoder(Tokenizer.from_file(path))
        return lambda batch: [pa.array([decoder.decode(np.asarray(x or [], np.int64)) for x in batch.column(ids).to_pylist()], pa.string())]

    return append_columns(df, {text: "string"}, make)


def roundtrip_digests(df: DataFrame, path: str, text: str = "text", leaf: int = LEAF, cache_units: int = CACHE_UNITS) -> DataFrame:
    """df with n_tokens, ids_sha256 and decoded_sha256: encode and decode in one pass, without keeping ids."""

    def make():
        enc = encoder(path, cache_units, leaf, _encode_long(leaf))
        decoder = ByteDecoder(enc.tokenizer)
        decimal = [str(i) for i in range(len(decoder.sizes))]

        def compute(batch: pa.RecordBatch) -> list:
            n, a, b = [], [], []
            for _, texts in in_slices(batch.column(text).to_pylist()):
                flat, sizes = enc.encode(texts)
                stops = np.cumsum(sizes)
                for start, stop in zip((stops - sizes).tolist(), stops.tolist(), strict=True):
                    ids = flat[start:stop]
                    n.append(stop - start)
                    a.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                    b.append(hashlib.sha256(decoder.decode(ids).encode()).hexdigest())
            return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]

        return compute

    return append_columns(df, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, make)


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    """Tokens of all documents by the byte-level vocabulary and the texts decoded from them, as digests: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return roundtrip_digests(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")
