"""Quality rules (operator 7): divergence of a document's histograms from those of its language.

References are sums over the corpus: for each language a histogram of character classes and one of its
common words with the share of all other words. A document is held against every language and judged by the one
it is nearest to, by Jensen-Shannon distance (the root of the divergence in bits), with an allowance for the
noise that a text of its length has by chance, and no such verdict below a minimum length.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import append_columns, map_arrow, table
from tidemark.llm.units import in_slices

MIN_WORDS, REPEATED_PERCENT = 50, 50
COMMON = 60
#: Words of a language that the second round counts; it counts all where these turn out not to decide the common ones.
CANDIDATES = 200
MAX_CHAR, MAX_WORD = 0.16, 0.10
ROWS_HELD = 1_000_000  # counts of words that a task holds before it hands them on
SYMBOLS = b"#*$%&|<>"
CLASSES = ("plain", "upper", "space", "line", "point", "mark", "symbol", "other", "beyond")


def _class_of() -> np.ndarray:
    """Byte to class; bytes that continue a character belong to none (-1)."""
    of = np.full(256, CLASSES.index("other"))
    for name, members in (("plain", b"abcdefghijklmnopqrstuvwxyz0123456789"), ("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("space", b" \t\r\x0b\x0c"), ("line", b"\n"), ("point", b".,;:'\"-()?"), ("mark", b"!"), ("symbol", SYMBOLS)):
        of[list(members)] = CLASSES.index(name)
    of[128:192], of[192:] = -1, CLASSES.index("beyond")
    return of


_OF = _class_of()
_MEMBERS = (_OF[:, None] == np.arange(len(CLASSES))).astype(np.int64)
_EDGES = ".,;:!?\"'()[]-#*$%&|<>"
_LENGTHS = (50, 70, 100, 140, 200, 280, 400, 800, 1600, 3200, 6400)


def char_histogram(data: bytes) -> np.ndarray:
    """Characters of each class."""
    return np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _MEMBERS


def js_distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Root of the Jensen-Shannon divergence, in bits, of each row of p and the histogram q; empty ones are at distance 1."""
    sums = p.sum(1)
    if not q.sum():
        return np.ones(len(p))
    p, q = p / np.maximum(1, sums)[:, None], q / q.sum()
    m = (p + q) / 2
    half = lambda x: (x * np.log2(np.where(x > 0, x, 1) / np.where(x > 0, m, 1))).sum(1)
    return np.where(sums > 0, np.sqrt(np.maximum(0, (half(p) + half(np.broadcast_to(q, p.shape))) / 2)), 1.0)


@dataclass
class Reference:
    """What a language's texts look like: character classes, common words and their places, counts of these and of the rest."""

    chars: np.ndarray
    words: list[str]
    counts: np.ndarray
    noise: np.ndarray = field(init=False)

    def __post_init__(self):
        self.noise = chance_distances(self.counts)

    def allowed(self, n_words: np.ndarray, max_word: float) -> np.ndarray:
        """The word distance that a text of so many words may have: max_word beyond what chance brings."""
        root = 1 / np.sqrt(np.maximum(1, n_words))
        return max_word + np.interp(root, 1 / np.sqrt(np.array(_LENGTHS[::-1])), self.noise[::-1])


def chance_distances(counts: np.ndarray, draws: int = 400) -> np.ndarray:
    """The mean distance to a histogram of texts of _LENGTHS words drawn from it."""
    rng, total = np.random.default_rng(5), counts.sum()
    if not total:
        return np.ones(len(_LENGTHS))
    return np.array([js_distances(rng.multinomial(n, counts / total, draws), counts).mean() for n in _LENGTHS])


class Texts:
    """A slice of texts: per text the number of words, characters of each class, and its words as numbers."""

    def __init__(self, texts: list[str | None]):
        self.data = [(t or "").encode() for t in texts]
        self.chars = np.stack([char_histogram(d) for d in self.data])
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.string()).fill_null(""))
        coded = lists.flatten().dictionary_encode()
        self.number, self.owner = coded.indices.to_numpy(), np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
        blank = pc.index(coded.dictionary, "").as_py()
        if blank >= 0:  # white space at the ends of a text
            self.owner, self.number = self.owner[self.number != blank], self.number[self.number != blank]
        self.kinds = len(coded.dictionary)
        self.n_words = np.bincount(self.owner, minlength=len(texts))
        # words as the histograms count them: lower case, without marks around them
        bare = pc.utf8_lower(pc.utf8_trim(coded.dictionary, characters=_EDGES)).dictionary_encode()
        self.bare, self.bare_of = bare.dictionary, bare.indices.to_numpy()

    def counts(self, columns: pa.Array) -> np.ndarray:
        """How often each text has each of some words."""
        place = pc.index_in(self.bare, value_set=columns).fill_null(-1).to_numpy()[self.bare_of][self.number]
        known = place >= 0
        return np.bincount(self.owner[known] * len(columns) + place[known], minlength=len(self.data) * len(columns)).reshape(len(self.data), len(columns))

    def sums(self, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, number of the bare word, count) over the texts of each group; group -1 is left out."""
        at = group[self.owner]
        n = np.bincount(at[at >= 0] * len(self.bare) + self.bare_of[self.number][at >= 0], minlength=groups * len(self.bare))
        found = np.flatnonzero(n)
        return found // len(self.bare), found % len(self.bare), n[found]

    def repeated_words(self) -> np.ndarray:
        """Words of each text inside three-word windows that the text has twice or more."""
        x, n = self.number.astype(np.int64), len(self.number)
        covered = np.zeros(n, bool)
        if n > 3:
            pair = x[:-1] * self.kinds + x[1:]
            if self.kinds > 2_000_000:  # else the product of three would not fit
                pair = np.unique(pair, return_inverse=True)[1]
            window = np.where(self.owner[2:] == self.owner[:-2], pair[:-1] * self.kinds + x[2:], -1)
            order = np.argsort(window, kind="stable")  # a text's equal windows are neighbours then
            a, b = order[:-1], order[1:]
            same = (window[a] == window[b]) & (window[a] >= 0) & (self.owner[a] == self.owner[b])
            found = np.zeros(len(window), bool)
            found[a[same]] = found[b[same]] = True
            for k in range(3):
                covered[k : k + len(window)] |= found
        return np.bincount(self.owner[covered], minlength=len(self.data))


class Judge:
    """Distances of texts to the references of all languages at once."""

    def __init__(self, known: dict[str | None, Reference], max_char: float = MAX_CHAR, max_word: float = MAX_WORD):
        self.known, self.max_char, self.max_word = known, max_char, max_word
        self.columns = pa.array(sorted({w for r in known.values() for w in r.words}), pa.string())
        self.place = {w: k for k, w in enumerate(self.columns.to_pylist())}

    def __call__(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Character and word distance of each text to its nearest language, and whether both are within their limits.
        Nearness is the larger of the two, each as a part of its limit. Without references all fit."""
        n = texts.n_words
        if not self.known:
            return np.zeros(len(n)), np.zeros(len(n)), np.ones(len(n), bool)
        counts, parts, pairs = texts.counts(self.columns), [], []
        for r in self.known.values():
            own = counts[:, [self.place[w] for w in r.words]]
            c, w = js_distances(texts.chars, r.chars), js_distances(np.concatenate([own, n[:, None] - own.sum(1, keepdims=True)], axis=1), r.counts)
            parts.append(np.maximum(c / self.max_char, w / r.allowed(n, self.max_word)))
            pairs.append((c, w))
        best, rows = np.argmin(parts, axis=0), np.arange(len(n))
        return np.array([c for c, _ in pairs])[best, rows], np.array([w for _, w in pairs])[best, rows], np.min(parts, axis=0) <= 1


def repeated_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = data.split(b"\n")
    if len(lines) < 2:
        return 0
    lines = [x for x in lines if x.strip(b" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def references(df: DataFrame, text: str = "text", lang: str = "lang", min_words: int = MIN_WORDS, common: int = COMMON, candidates: int = CANDIDATES) -> dict[str | None, Reference]:
    """A Reference for each language: its character classes, its `common` most frequent words and the rest.

    Sums over all texts of min_words words or more; a null language is a language of its own, equal counts are
    ordered by word, repeated rows count as often as they occur, an empty table has no references. A first round counts all words of all texts, a second those
    of the texts that the first one's references keep, so that the texts to be found do not shape what they are held against.
    The second counts the first one's `candidates` only and is repeated with all words should another word possibly be
    among the most frequent. What comes to the driver is `candidates` words and the classes for each language.
    """
    docs = df.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    first, listed = _sums(docs, {}, None, min_words, common, candidates)
    second, _ = _sums(docs, first, {l: [w for w, _ in found] for l, found in listed.items()}, min_words, common, candidates)
    for l, r in second.items():
        # a word beyond the candidates has at most the first round's count of the last of them
        if len(listed[l]) == candidates and (len(r.words) < common or r.counts[common - 1] <= listed[l][-1][1]):
            return _sums(docs, first, None, min_words, common, candidates)[0]
    return second


def _sums(docs: DataFrame, judges: dict, chosen: dict | None, min_words: int, common: int, candidates: int) -> tuple[dict, dict]:
    """References from the texts that the judges keep, counting the chosen words of each language or all, and the most frequent words with their counts."""

    def count(batches):
        judge, chars, total, held = Judge(judges), {}, {}, []
        names = ["lang", "kind", "item", "n"]
        sets = {l: pa.array(words, pa.string()) for l, words in (chosen or {}).items()}

        def words() -> pa.RecordBatch:
            summed = pa.Table.from_batches(held).group_by(["lang", "item"]).aggregate([("n", "sum")])
            held.clear()
            kind = pa.array(["word"] * len(summed), pa.string())
            return pa.RecordBatch.from_arrays([summed["lang"].combine_chunks(), kind, summed["item"].combine_chunks(), summed["n_sum"].combine_chunks()], names=names)

        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for at, some in in_slices(batch.column("text").to_pylist()):
                texts, of = Texts(some), langs[at : at + len(some)]
                good = (texts.n_words >= min_words) & judge(texts)[2]
                present = list(dict.fromkeys(of[good].tolist()))
                group = np.full(len(some), -1)
                for k, l in enumerate(present):
                    rows = good & np.array([x == l for x in of])
                    group[rows] = k
                    chars[l] = chars.get(l, 0) + texts.chars[rows].sum(0)
                    total[l] = total.get(l, 0) + int(texts.n_words[rows].sum())
                if chosen is None:
                    g, w, n = texts.sums(group, len(present))
                    held.append(pa.RecordBatch.from_arrays([pa.array(present, pa.string()).take(pa.array(g)), texts.bare.take(pa.array(w)), pa.array(n, pa.int64())], names=["lang", "item", "n"]))
                else:
                    for k, l in enumerate(present):
                        n = texts.counts(sets[l])[group == k].sum(0)
                        held.append(pa.RecordBatch.from_arrays([pa.array([l] * len(n), pa.string()), sets[l], pa.array(n, pa.int64())], names=["lang", "item", "n"]))
                if sum(b.num_rows for b in held) > ROWS_HELD:
                    yield words()
        if held:
            yield words()
        rows = [(l, "char", CLASSES[k], int(n)) for l, h in chars.items() for k, n in enumerate(h)] + [(l, "all", "", n) for l, n in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))], names=names)

    sums = map_arrow(docs, count, "lang string, kind string, item string, n long").filter("n > 0 AND (kind != 'word' OR item != '')").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    # the limit holds for all kinds, so that Spark applies it before a language's rows meet in a task
    place = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "item"))
    kept = sums.withColumn("place", place).filter(F.col("place") <= max(candidates, common, len(CLASSES))).collect()
    out, listed = {}, {}
    for r in sorted(kept, key=lambda r: r["place"]):
        chars, words, total = out.setdefault(r["lang"], ({}, [], []))
        if r["kind"] == "word":
            words.append((r["item"], r["n"]))
        else:
            (total.append(r["n"]) if r["kind"] == "all" else chars.__setitem__(r["item"], r["n"]))
    for l, (chars, words, total) in out.items():
        listed[l], top = words[:candidates], words[:common]
        out[l] = Reference(np.array([chars.get(c, 0) for c in CLASSES]), [w for w, _ in top], np.array([*(n for _, n in top), sum(total) - sum(n for _, n in top)]))
    return out, listed


def quality(df: DataFrame, known: dict[str | None, Reference], text: str = "text", min_words: int = MIN_WORDS, repeated_percent: int = REPEATED_PERCENT, max_char: float = MAX_CHAR, max_word: float = MAX_WORD, prefix: str = "") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, char_distance, word_distance, base_failed, kept, their names after `prefix`.

    Base rules: fewer than min_words words, or more than repeated_percent % of the words in repeated
    three-word windows. Beyond these a document is kept unless a distance to its nearest language
    exceeds its limit, for words beyond what chance brings at its length. A null text has no words; without references only the
    base rules decide. Rows are independent, so repeated rows and ties are judged alike; an empty table gives an empty result;
    columns of df with the names of results are replaced.
    """
    kinds = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "char_distance": "double", "word_distance": "double", "base_failed": "boolean", "kept": "boolean"}
    space = [CLASSES.index("space"), CLASSES.index("line")]

    def make():
        judge = Judge(known, max_char, max_word)

        def some(part: list[str | None]) -> list[np.ndarray]:
            texts = Texts(part)
            n, repeated = texts.n_words, texts.repeated_words()
            c, w, fits = judge(texts)
            failed = (n < min_words) | (100 * repeated > repeated_percent * n)
            lines = np.array([repeated_lines(d) for d in texts.data], np.int64)
            return [n, texts.chars.sum(1) - texts.chars[:, space].sum(1), texts.chars[:, CLASSES.index("symbol")], lines, repeated, c, w, failed, ~failed & fits]

        def compute(batch: pa.RecordBatch) -> list:
            found = [some(part) for _, part in in_slices(batch.column(text).to_pylist())]
            types = [{"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[k] for k in kinds.values()]
            return [pa.array(np.concatenate([f[k] for f in found]) if found else [], kind) for k, kind in enumerate(types)]

        return compute

    return append_columns(df, {prefix + k: kind for k, kind in kinds.items()}, make)


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Base measures and verdicts of all documents: see quality() for texts that are null, empty or short."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = quality(docs.drop("lang"), references(docs)).drop("text")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"))
