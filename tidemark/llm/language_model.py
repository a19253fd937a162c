"""Language-model scoring (operator 13): a log-bilinear neural model, trained in numpy by noise-contrastive estimation.

Words of the training documents are counted in full. The model predicts a symbol (one of the most frequent words, the end, or
one of the buckets that all other words fall into by their last two characters) from the three symbols before it: the context's
vectors, each times a vector of its place, add up to the predicted vector, and its products with all symbols' vectors are their
scores. A word of a bucket then has its share of the bucket's count, so the probabilities of all words, seen or not, add up to 1.

Training reads every training document once, in two rounds over half of them each: every task starts from the same model, learns from
its own documents against shared noise words, and the tasks' models are averaged by their number of tokens, as sums per parameter.
What is broadcast has fixed bounds: the model, and the words that make up a millionth of all tokens or more. Rarer
words meet their counts in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, materialize, table
from tidemark.llm.units import in_slices

WORDS, TAILS, WIDTH, CONTEXT = 95, 160, 16, 3
NOISE, BATCH, RATE, ROUNDS = 32, 2048, 0.02, 2
STEPS = 300  # steps of a task in a round at least: one with few texts reads them again
SCORED = 256  # places whose scores fit a processor's cache
#: A word with a SHARED-th of all tokens or more is broadcast unless it is longer than LONGEST bytes; there can be SHARED such words.
SHARED, LONGEST = 1 << 20, 64
FOLDS, HELD_FOLD = 5, 1
ROWS_HELD = 1_000_000  # counts of words that a task holds before it hands them on
END, START = WORDS, WORDS + 1 + TAILS  # symbols 0 to WORDS - 1 are words, then the end, then buckets; the start is in contexts alone
SYMBOLS = WORDS + 1 + TAILS


def held_out(id: Column, folds: int = FOLDS, fold: int = HELD_FOLD) -> Column:
    """Whether a document is kept from training; one without an id is not."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def tail_of(word: Column) -> Column:
    """The bucket of a rare word, by its last two characters."""
    return (F.crc32(F.right(word, F.lit(2)).cast("binary")) % TAILS).cast("int")


class Words:
    """A slice of texts: its distinct words, the words as numbers and each word's text."""

    def __init__(self, texts: list[str | None]):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.string()).fill_null("")))
        coded = lists.flatten().dictionary_encode()
        self.distinct, self.number, self.texts = coded.dictionary, coded.indices.to_numpy(), len(texts)
        self.owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
        blank = pc.index(self.distinct, "").as_py()
        if blank >= 0:  # white space at the ends of a text
            self.owner, self.number = self.owner[self.number != blank], self.number[self.number != blank]
        self.size = np.bincount(self.owner, minlength=len(texts))

    def symbols(self, frequent: pa.Array) -> np.ndarray:
        """The symbol of each distinct word."""
        at = pc.index_in(self.distinct, value_set=frequent).fill_null(-1).to_numpy()
        ends = pc.utf8_slice_codeunits(self.distinct, start=-2).dictionary_encode()
        tails = np.array([crc32(e.encode()) % TAILS for e in ends.dictionary.to_pylist()], np.int64)
        return np.where(at >= 0, at, END + 1 + tails[ends.indices.to_numpy()]) if len(at) else np.zeros(0, np.int64)

    def sequence(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' symbols in one row, each text after CONTEXT starts and before its end, and the text of each place."""
        length = self.size + CONTEXT + 1
        first = np.cumsum(length) - length
        row, of = np.full(int(length.sum()), START, np.int32), np.repeat(np.arange(self.texts), length)
        row[first[self.owner] + CONTEXT + np.arange(len(self.owner)) - (np.cumsum(self.size) - self.size)[self.owner]] = symbol[self.number]
        row[first + length - 1] = END
        return row, of


@dataclass
class Model:
    """Vectors of symbols in contexts and as targets, factors of the places before a target, and biases."""

    context: np.ndarray
    target: np.ndarray
    place: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, share: np.ndarray) -> "Model":
        """A small random model whose biases are the symbols' log shares."""
        rng = np.random.default_rng(13)
        with np.errstate(divide="ignore"):
            bias = np.log(share).astype("f4")
        return cls(rng.normal(0, 0.3, (SYMBOLS + 1, WIDTH)).astype("f4"), rng.normal(0, 0.3, (SYMBOLS, WIDTH)).astype("f4"), np.full((CONTEXT, WIDTH), 1 / CONTEXT, "f4"), bias)

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.target, self.place, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    @classmethod
    def of(cls, flat: np.ndarray) -> "Model":
        shapes = [(SYMBOLS + 1, WIDTH), (SYMBOLS, WIDTH), (CONTEXT, WIDTH), (SYMBOLS,)]
        cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        return cls(*[x.astype("f4").reshape(s) for x, s in zip(np.split(flat, cuts), shapes)])

    def predict(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Context vectors of a row's places and the predicted vectors from the CONTEXT-th place on."""
        vectors, n = self.context[row], len(row) - CONTEXT
        return vectors, sum(self.place[j] * vectors[CONTEXT - 1 - j : CONTEXT - 1 - j + n] for j in range(CONTEXT))

    def log_probabilities(self, row: np.ndarray) -> np.ndarray:
        """Natural log probability of each symbol of a row from the CONTEXT-th on, normalised over all symbols; 0 for starts.

        A score is a sum over the context's places, each of a product of two symbols' vectors. These come from one matrix product per
        place, and so do their exponentials: a token's are the products of its context's rows.
        """
        scores = np.stack([(self.context * p) @ self.target.T for p in self.place])
        scores[0] += self.bias
        low = scores.max(2, keepdims=True)
        factors = np.exp(scores - low)  # at most 1; a factor too small for a float adds nothing to a sum that holds larger ones
        out = []
        for a in range(0, len(row) - CONTEXT, SCORED):
            some = row[a : a + SCORED + CONTEXT]
            n = len(some) - CONTEXT
            places = [some[CONTEXT - 1 - j : CONTEXT - 1 - j + n] for j in range(CONTEXT)]
            product = factors[0].take(places[0], axis=0)
            for j in range(1, CONTEXT):
                product *= factors[j].take(places[j], axis=0)
            sums, to = product @ np.ones(SYMBOLS, "f4"), some[CONTEXT:]
            real = to != START
            at = np.where(real, to, 0)
            got = sum(scores[j][places[j], at].astype("f8") for j in range(CONTEXT))
            with np.errstate(divide="ignore"):
                whole = np.log(sums.astype("f8")) + sum(low[j][places[j], 0] for j in range(CONTEXT))
            for i in np.flatnonzero(sums < 1e-30):  # so far apart that floats lose them
                x = sum(scores[j][places[j][i]].astype("f8") for j in range(CONTEXT))
                whole[i] = x.max() + np.log(np.exp(x - x.max()).sum())
            out.append(np.where(real, got - whole, 0.0))
        return np.concatenate(out) if out else np.zeros(0)


class Learner:
    """Noise-contrastive estimation of a model by steps of Adam."""

    def __init__(self, model: Model, share: np.ndarray, seed: int, rate: float = RATE):
        self.model, self.rng, self.rate, self.step, self.tokens = model, np.random.default_rng(seed), rate, 0, 0
        self.cumulated, self.chance = np.cumsum(share), np.where(share > 0, np.log(np.maximum(NOISE * share, 1e-30)), 0).astype("f4")
        self.first, self.second = ([np.zeros_like(p) for p in model.parts()] for _ in range(2))

    def learn(self, row: np.ndarray) -> None:
        for a in range(0, len(row) - CONTEXT, BATCH):
            self._batch(row[a : a + BATCH + CONTEXT])

    def _batch(self, row: np.ndarray) -> None:
        m, to = self.model, row[CONTEXT:]
        real = to != START
        count = int(real.sum())
        if not count:
            return
        to, part = np.where(real, to, 0), (real / count).astype("f4")
        noise = np.minimum(np.searchsorted(self.cumulated, self.rng.random(NOISE)), SYMBOLS - 1)
        vectors, predicted = m.predict(row)
        # the odds that a word is a context's next one and not one of NOISE words drawn by their shares
        with np.errstate(over="ignore"):
            up = part - part / (1 + np.exp(self.chance[to] - m.bias[to] - np.einsum("ij,ij->i", predicted, m.target[to])))
            down = predicted @ -m.target[noise].T
            down += self.chance[noise] - m.bias[noise]
            np.exp(down, out=down)
        down += 1
        np.divide(-part[:, None], down, out=down)
        back = up[:, None] * m.target[to] + down @ m.target[noise]
        target = _sums(to, up[:, None] * predicted, SYMBOLS)
        np.add.at(target, noise, down.T @ predicted)
        bias = np.bincount(to, weights=up, minlength=SYMBOLS)
        np.add.at(bias, noise, down.sum(0))
        into, place = np.zeros_like(vectors), np.zeros_like(m.place)
        for j in range(CONTEXT):
            at = slice(CONTEXT - 1 - j, CONTEXT - 1 - j + len(back))
            into[at] += m.place[j] * back
            place[j] = np.einsum("ij,ij->j", vectors[at], back)
        self.step += 1
        self.tokens += count
        rate = self.rate / (1 + self.step / 500)
        for p, g, one, two in zip(m.parts(), (_sums(row, into, SYMBOLS + 1), target, place, bias), self.first, self.second):
            one += 0.1 * (g - one)
            two += 0.01 * (g * g - two)
            p += rate * (one / (1 - 0.9**self.step)) / (np.sqrt(two / (1 - 0.99**self.step)) + 1e-6)


def _sums(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sum of the rows of each of n places."""
    flat = (at.astype(np.int64)[:, None] * WIDTH + np.arange(WIDTH)).ravel()
    return np.bincount(flat, weights=rows.ravel(), minlength=n * WIDTH).reshape(n, WIDTH).astype("f4")


def _slices(batches, columns: tuple[str, ...]) -> Iterator[tuple[Words, list[np.ndarray]]]:
    """Words of slices of the batches' texts with the rows of other columns."""
    for batch in batches:
        others = [np.array(batch.column(c).to_pylist(), dtype=object) for c in columns]
        for at, some in in_slices(batch.column("text").to_pylist()):
            yield Words(some), [o[at : at + len(some)] for o in others]


def count_words(docs: DataFrame) -> DataFrame:
    """(word, train, n): how often each word occurs in training documents and in all, for docs(text, held). Counted in tasks and summed."""
    names = ["word", "train", "n"]

    def count(batches):
        held: list[pa.Table] = []

        def summed() -> pa.RecordBatch:
            total = pa.concat_tables(held).group_by("word").aggregate([("train", "sum"), ("n", "sum")])
            held.clear()
            return pa.RecordBatch.from_arrays([total[c].combine_chunks() for c in ("word", "train_sum", "n_sum")], names=names)

        for words, (out,) in _slices(batches, ("held",)):
            n = np.bincount(words.number, minlength=len(words.distinct))
            train = np.bincount(words.number[~out.astype(bool)[words.owner]], minlength=len(words.distinct))
            some = np.flatnonzero(n)
            held.append(pa.table([words.distinct.take(pa.array(some)), pa.array(train[some], pa.int64()), pa.array(n[some], pa.int64())], names=names))
            if sum(map(len, held)) > ROWS_HELD:
                yield summed()
        if held:
            yield summed()

    return map_arrow(docs.select("text", "held"), count, "word string, train long, n long").groupBy("word").agg(F.sum("train").alias("train"), F.sum("n").alias("n"))


@dataclass
class Counts:
    """What tasks know of the training tokens: all, distinct, the documents' ends, frequent words with their counts, and the tokens and words of each bucket."""

    tokens: int
    kinds: int
    ends: int
    frequent: pa.Array
    of_frequent: np.ndarray
    tail_tokens: np.ndarray
    tail_kinds: np.ndarray

    def share(self) -> np.ndarray:
        """The symbols' shares of training tokens, smoothed; symbols for more words than there are have none."""
        n = np.concatenate([self.of_frequent + 0.5, np.zeros(WORDS - len(self.of_frequent)), [self.ends + 0.5], self.tail_tokens + 0.5])
        return n / n.sum()


def gather(docs: DataFrame, words: DataFrame) -> Counts:
    """Counts from the table of all words and the number of training documents."""
    trained = words.where("train > 0")
    frequent = trained.orderBy(F.desc("train"), "word").limit(WORDS).collect()
    ends = docs.where(~F.col("held")).count()
    total = trained.agg(F.sum("train").alias("n"), F.count(F.lit(1)).alias("kinds")).first()
    tails = np.zeros((2, TAILS), np.int64)
    for r in trained.groupBy(tail_of(F.col("word")).alias("tail")).agg(F.sum("train").alias("n"), F.count(F.lit(1)).alias("kinds")).collect():
        tails[:, r["tail"]] = r["n"], r["kinds"]
    for r in frequent:
        tails[:, crc32(r["word"][-2:].encode()) % TAILS] -= r["train"], 1
    return Counts((total["n"] or 0) + ends, total["kinds"] + (ends > 0), ends, pa.array([r["word"] for r in frequent], pa.string()), np.array([r["train"] for r in frequent], np.int64), *tails)


def train(docs: DataFrame, counts: Counts, rounds: int = ROUNDS) -> Model:
    """The model of the training documents of docs(text, held, part); part tells in which round a document is read."""
    share = counts.share()
    model, frequent = Model.fresh(share), counts.frequent
    for k in range(rounds):
        flat = model.flat()

        def learn(batches, flat=flat, k=k):
            pid = TaskContext.get().partitionId()
            learner = Learner(Model.of(flat), share, pid, RATE / (1 + 2 * k))
            few = []
            for words, _ in _slices(batches, ()):
                row = words.sequence(words.symbols(frequent))[0]
                learner.learn(row)
                if learner.step < STEPS:
                    few.append(row)
            tokens = learner.tokens
            while 0 < learner.step < STEPS:
                learner.learn(few[learner.step % len(few)])
            if tokens:
                moved = learner.model.flat().astype("f8") * tokens
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(moved)), pa.int32()), pa.array(np.concatenate([[tokens], moved]))], names=["at", "x"])

        read = docs.where(~F.col("held") & (F.pmod(F.col("part"), F.lit(rounds)) == k)).select("text")
        sums = {r["at"]: r["x"] for r in map_arrow(read, learn, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()}  # a number per parameter
        if sums:
            model = Model.of(np.array([sums[i] for i in range(len(flat))]) / sums[-1])
    return model


def score(docs: DataFrame, counts: Counts, words: DataFrame, model: Model) -> DataFrame:
    """doc_id, held, n_tokens, n_known, base_score and score of docs(doc_id, text, held), in log10.

    A task scores its texts but for the counts of rare words; these meet the table of words and come back to their document's row. No word of that
    join makes up more than a SHARED-th of all tokens, or it is longer than LONGEST bytes.
    """
    spark = docs.sparkSession
    all_tokens = words.agg(F.sum("n")).first()[0] or 0
    common = words.where((F.col("n") * SHARED >= all_tokens) & (F.octet_length("word") <= LONGEST))
    common = common.select("word", "train").toArrow()  # at most SHARED words
    shared, of_shared = common["word"].combine_chunks(), common["train"].to_numpy()
    low, frequent = np.log10(counts.tokens + 0.5 * (counts.kinds + 1)), counts.frequent
    low_tail = np.log10(counts.tail_tokens + 0.5 * (counts.tail_kinds + 1))
    end = np.log10(counts.ends + 0.5) - low
    sent = spark.sparkContext.broadcast((shared, of_shared))
    names = ["row", "doc_id", "held", "n_tokens", "n_known", "base_score", "score", "word", "n", "both"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches):
        (shared, of_shared), row = sent.value, TaskContext.get().partitionId() << 33
        for words, (ids, held) in _slices(batches, ("doc_id", "held")):
            symbol, n, owner, number = words.symbols(frequent), words.texts, words.owner, words.number
            at = pc.index_in(words.distinct, value_set=shared).fill_null(-1).to_numpy()
            local = at >= 0
            count = np.where(local, of_shared[np.maximum(at, 0)], 0) if len(of_shared) else np.zeros(len(at))
            tail = symbol > END
            own = np.where(local, np.log10(count + 0.5), 0.0)  # the logarithm of a rare word's count is added by the join
            base, given = own - low, np.where(tail, own - low_tail[np.where(tail, symbol - END - 1, 0)], 0.0)
            sums = lambda x: np.bincount(owner, weights=x[number], minlength=n)
            line, of = words.sequence(symbol)
            lp = np.bincount(of[CONTEXT:], weights=model.log_probabilities(line), minlength=n) / np.log(10)
            known = np.bincount(owner[(local & (count > 0))[number]], minlength=n) + (counts.ends > 0)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((row + np.arange(n), ids.tolist(), held.tolist(), words.size + 1, known, sums(base) + end, sums(given) + lp, [None] * n, [None] * n, [None] * n), kinds)], names=names)
            rare = np.flatnonzero(~local[number])
            if len(rare):
                pair, times = np.unique(owner[rare] * np.int64(len(at)) + number[rare], return_counts=True)
                word = pair % len(at)
                columns = (row + pair // len(at), None, None, None, None, None, None, words.distinct.take(pa.array(word)), times, times * tail[word])
                yield pa.RecordBatch.from_arrays([pa.nulls(len(pair), t) if x is None else x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, kinds)], names=names)
            row += n

    schema = "row long, doc_id long, held boolean, n_tokens long, n_known long, base_score double, score double, word string, n long, both long"
    found = materialize(map_arrow(docs.select("doc_id", "text", "held"), run, schema), "scored")
    counted = F.coalesce(F.col("train"), F.lit(0))
    value = F.log10(counted + 0.5)
    rare = found.where("word IS NOT NULL").select("row", "word", "n", "both").join(words.select("word", "train"), "word", "left")
    more = rare.select("row", F.when(counted > 0, F.col("n")).otherwise(0).alias("n_known"), (value * F.col("n")).alias("base_score"), (value * F.col("both")).alias("score"))
    rows = found.where("word IS NULL").select("row", F.struct("doc_id", "held", "n_tokens").alias("of"), "n_known", "base_score", "score")
    both = rows.unionByName(more, allowMissingColumns=True).groupBy("row").agg(F.max("of").alias("of"), *[F.sum(c).alias(c) for c in ("n_known", "base_score", "score")])
    return both.select("of.doc_id", "of.held", "of.n_tokens", "n_known", "base_score", "score")


def language_model_scores(df: DataFrame, id: str = "doc_id", text: str = "text", folds: int = FOLDS, fold: int = HELD_FOLD) -> DataFrame:
    """One row per row of df: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    base_score is the log10 probability by smoothed counts of the training documents' words, score that by the neural model. A null
    text is empty: its end alone is scored. A null id belongs to the training documents. Repeated rows count and are scored each; other columns are ignored; an
    empty table gives an empty result, and without training documents all words are unknown.
    """
    docs = df.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"), held_out(F.col(id), folds, fold).alias("held"), F.xxhash64(id).alias("part"))
    words = materialize(count_words(docs), "words")
    counts = gather(docs, words)
    found = score(docs, counts, words, train(docs, counts))
    return found.select("doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(counts.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op13_language_model(spark, sf_dir: str) -> DataFrame:
    """All documents by a model of those outside the held-out fifth; nulls, odd texts and empty tables: see language_model_scores()."""
    return language_model_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
