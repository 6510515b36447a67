"""Text scores by a hidden Markov language model beside a unigram one.

Tokens are the words of a text and one end. Latent states emit symbols: each of the OWN most frequent words (and the
end) is a symbol of its own, all others share CLASSES symbols by their last bytes, inside which a word has its corpus
share. So the states' tables are of a fixed size and are broadcast, and the counts behind them cover every word of the
training rows: they are a table that grows with the corpus, the RANKED most frequent words are looked up where the
texts are, and all others are joined by word, none of which then has more than 1/RANKED of all tokens.

    P(text) = sum over state paths of  start * transitions * P(symbol | state)  *  product of P(word | symbol)

Baum-Welch: each round runs scaled forward and backward recursions over all training texts, in stretches of at most
STRETCH tokens, sums expected counts by partition and merges them by symbol in a group-by. Scoring runs the scaled
forward recursion over each whole text, which gives its likelihood exactly. Symbols of texts are stored once.

Defined results: null and empty texts are one end; a null doc_id is scored, never learned from, with a null held_out;
repeated rows each count and each get their row; without any training rows N = V = 0, the base is log10(0.1 / 0.1) = 0 a
token and the score that of the untrained states; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, utf8

OWN = 12_288  # words that are symbols of their own, besides the end
CLASSES = 4_096  # symbols of all other words, by their last bytes
SUFFIX = 3
RANKED = 65_536  # most frequent words, whose counts are broadcast
WORD_BYTES = 48  # of a word that is broadcast; longer ones are always joined
STATES = 8
ROUNDS = 6
STRETCH = 512
TOKENS = 1 << 18  # tokens whose recursions run side by side
SMOOTHING = 0.1  # fixed by the contract of the base
PRIOR = 2.0  # expected emissions a state is given by the corpus shares
STAY = 0.9  # of a state at the start of training


def words_of(text: bytes) -> list[bytes]:
    """Words of a text whose A-Z are lower-cased: exactly those that ASCII white space parts."""
    return text.lower().split()


def class_of(word: bytes, classes: int) -> int:
    return zlib.crc32(word[-SUFFIX:]) % classes


def _class_column(word: str, classes: int) -> Column:
    return (F.crc32(F.expr(f"substring({word}, -{SUFFIX})")) % classes).cast("int")


def _held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, c): tokens of the training rows, without their ends. Written once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                found.update(words_of(text))
            if len(found) > 200_000:
                yield _counts(found)
                found.clear()
        yield _counts(found)

    train = docs.where(~_held_out()).select(utf8().alias("text"))
    return materialize(train.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")), "vocabulary")


def _counts(found: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])


@dataclass
class Corpus:
    """What tasks need of the counts, of a bounded size: ranked words, and the totals of the classes.

    Symbol 0 is the end, the next ``own`` are words, all others classes.
    """

    own: int
    place: dict[bytes, int]  # of a ranked word
    count: np.ndarray  # by place
    symbol: np.ndarray  # by place
    class_tokens: np.ndarray  # tokens of the words of each class
    class_words: np.ndarray  # their number
    suffix: list[bytes]  # of each class
    total: int  # tokens with ends
    distinct: int  # with the end
    ends: int

    def share(self) -> np.ndarray:
        """log10 of the denominator of P(word | symbol) for each symbol of a class."""
        return np.log10(self.class_tokens + SMOOTHING * (self.class_words + 1))

    def symbol_of(self, word: bytes) -> int:
        """The symbol of a word that isn't ranked."""
        return 1 + self.own + class_of(word, len(self.class_tokens))

    def unigram(self) -> np.ndarray:
        """Smoothed corpus shares of the symbols."""
        n = np.zeros(1 + self.own + len(self.class_tokens))
        n[0] = self.ends
        own = self.symbol <= self.own
        n[self.symbol[own]] = self.count[own]
        n[1 + self.own :] = self.class_tokens
        return (n + SMOOTHING) / (n + SMOOTHING).sum()


def corpus_of(words: DataFrame, ends: int) -> Corpus:
    short = words.where(F.octet_length("word") <= WORD_BYTES)
    ranked = [(bytes(r["word"]), r["c"]) for r in short.orderBy(F.desc("c"), "word").limit(RANKED).collect()]
    symbol = np.array([1 + k if k < OWN else 1 + OWN + class_of(w, CLASSES) for k, (w, _) in enumerate(ranked)], np.int64)
    by_class = words.groupBy(_class_column("word", CLASSES).alias("class")).agg(F.sum("c").alias("c"), F.count("*").alias("v"), F.min(F.expr(f"substring(word, -{SUFFIX})")).alias("suffix"))
    tokens, number, suffix = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64), [b""] * CLASSES
    total = distinct = 0
    for r in by_class.collect():
        tokens[r["class"]], number[r["class"]], suffix[r["class"]] = r["c"], r["v"], bytes(r["suffix"])
        total, distinct = total + r["c"], distinct + r["v"]
    for word, c in ranked[:OWN]:
        tokens[class_of(word, CLASSES)] -= c
        number[class_of(word, CLASSES)] -= 1
    place = {w: k for k, (w, _) in enumerate(ranked)}
    return Corpus(OWN, place, np.array([c for _, c in ranked], np.int64), symbol, tokens, number, suffix, total + ends, distinct + (ends > 0), ends)


SYMBOL_ROWS = "doc_id long, train boolean, n_tokens long, n_known long, known double, shares double, symbols binary, rest array<struct<word: binary, n: int>>"


def as_symbols(docs: DataFrame, corpus: Corpus) -> DataFrame:
    """A row for each document: its symbols, sums over ranked words, and the other words with their counts.

    ``known`` sums log10(c + SMOOTHING) over ranked words and the end, ``shares`` those terms of P(word | symbol) that
    don't need the counts of other words. Written once, with a number for each row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(corpus)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        denominators, log_count, n = own.share(), np.log10(own.count + SMOOTHING), len(own.count)
        end = np.log10(own.ends + SMOOTHING)
        for batch in slices(batches):
            lists = [words_of(t) for t in batch.column("text").to_pylist()]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            found = pa.array([w for ws in lists for w in ws], pa.binary()).dictionary_encode()
            distinct, number = found.dictionary.to_pylist(), found.indices.to_numpy().astype(np.int64)
            place = np.array([own.place.get(w, n) for w in distinct], np.int64)
            ranked = place < n
            symbol = np.array([own.symbol[p] if p < n else own.symbol_of(w) for w, p in zip(distinct, place.tolist(), strict=True)], np.int64)
            log_c = np.where(ranked, np.append(log_count, 0)[place], 0)
            # A word of a class has log10(c + SMOOTHING) less the class's denominator; c of the others is joined later.
            share = np.where(symbol > own.own, log_c - np.append(np.zeros(1 + own.own), denominators)[symbol], 0)
            at = np.concatenate([[0], np.cumsum(sizes)])
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[number])])[at]) for x in (ranked.astype(np.int64), log_c, share)]
            sequence = symbol[number].astype("<u2")
            rare = np.flatnonzero(~ranked[number])
            key, times = np.unique(np.repeat(np.arange(len(lists)), sizes)[rare] * max(len(distinct), 1) + number[rare], return_counts=True)
            ends = np.searchsorted(key, np.arange(len(lists) + 1) * max(len(distinct), 1))
            rest = pa.StructArray.from_arrays([found.dictionary.take(pa.array(key % max(len(distinct), 1))), pa.array(times, pa.int32())], names=["word", "n"])
            symbols = [sequence[a:b].tobytes() + b"\0\0" for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            names = ["doc_id", "train", "n_tokens", "n_known", "known", "shares", "symbols", "rest"]
            columns = [batch.column("doc_id"), batch.column("train"), sizes + 1, sums[0] + (own.ends > 0), sums[1] + end, sums[2], pa.array(symbols, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rest)]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=names)

    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(~_held_out(), F.lit(False)).alias("train"), utf8().alias("text"))
    return materialize(typed.mapInArrow(convert, SYMBOL_ROWS).withColumn("row", F.monotonically_increasing_id()), "symbols", compression="zstd")


@dataclass
class Model:
    start: np.ndarray  # (states,)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (symbols, states)


def first_model(corpus: Corpus, states: int) -> Model:
    """States lean to words that look alike: fixed random directions of the byte pairs of a word, or of a class's last bytes."""
    rng = np.random.default_rng(0)
    directions = rng.normal(size=(65_536, states))

    def lean(word: bytes) -> np.ndarray:
        pairs = np.frombuffer(word, np.uint8).astype(np.int64)
        pairs = pairs[:-1] * 256 + pairs[1:]
        return directions[pairs].mean(axis=0) * np.sqrt(len(pairs)) if len(pairs) else np.zeros(states)

    leans = np.zeros((len(corpus.unigram()), states))
    for word, k in corpus.place.items():
        if corpus.symbol[k] <= corpus.own:
            leans[corpus.symbol[k]] = lean(word)
    leans[1 + corpus.own :] = [lean(s) for s in corpus.suffix]
    share = np.exp(leans - leans.max(axis=1, keepdims=True))
    emit = share / share.sum(axis=1, keepdims=True) * corpus.unigram()[:, None]
    move = np.full((states, states), (1 - STAY) / max(states - 1, 1))
    np.fill_diagonal(move, STAY if states > 1 else 1)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


class SideBySide:
    """Sequences whose recursions run together: token k of all of them before token k + 1, longer sequences first."""

    def __init__(self, sequences: list[np.ndarray]):
        self.order = np.argsort([-len(s) for s in sequences], kind="stable")
        size = np.array([len(sequences[k]) for k in self.order], np.int64)
        steps = int(size[0])
        #: Sequences that have a token k, and where those tokens begin.
        self.active = len(size) - np.searchsorted(size[::-1], np.arange(steps), "right")
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        starts = np.cumsum(size) - size
        flat = np.concatenate([sequences[k] for k in self.order]).astype(np.int64)
        step = np.repeat(np.arange(steps), self.active)
        within = np.arange(len(flat)) - self.at[step]
        self.symbols = flat[starts[within] + step]
        self.before = np.arange(len(flat))[self.active[0] :] - np.repeat(self.active[:-1], self.active[1:])  # the token before, of all but first ones
        self.within = within

    def forward(self, model: Model, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled state probabilities after each token, and the scales, whose product is the likelihood."""
        alpha, scale = np.empty_like(e), np.empty(len(e), e.dtype)
        move = model.move.astype(e.dtype)
        a = np.broadcast_to(model.start.astype(e.dtype), (self.active[0], e.shape[1]))
        for k, n in enumerate(self.active.tolist()):
            s = slice(self.at[k], self.at[k] + n)
            a = (a[:n] @ move if k else a[:n]) * e[s]
            c = a.sum(axis=1)
            a /= c[:, None]
            alpha[s], scale[s] = a, c
        return alpha, scale

    def likelihoods(self, model: Model) -> np.ndarray:
        """log10 of each sequence's probability, in the order given."""
        out, e = np.zeros(len(self.order)), model.emit[self.symbols]
        _, scale = self.forward(model, e)
        out[self.order] = np.bincount(self.within, weights=np.log10(scale), minlength=len(out))
        return out

    def expected(self, model: Model, emissions: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Expected starts and moves, and the log10 likelihood; expected emissions are added to ``emissions``."""
        e = model.emit[self.symbols]
        alpha, scale = self.forward(model, e)
        beta, back = np.ones_like(e), model.move.T.astype(e.dtype)
        e /= scale[:, None]
        for k in range(len(self.active) - 2, -1, -1):
            n, s = self.active[k + 1], slice(self.at[k + 1], self.at[k + 2])
            beta[self.at[k] : self.at[k] + n] = (e[s] * beta[s]) @ back
        onward = e * beta
        moves = (alpha[self.before].T @ onward[self.active[0] :]) * model.move
        alpha *= beta
        for state in range(e.shape[1]):
            emissions[:, state] += np.bincount(self.symbols, weights=alpha[:, state], minlength=len(emissions))
        return alpha[: self.active[0]].sum(axis=0).astype(np.float64), moves.astype(np.float64), float(np.log10(scale, dtype=np.float64).sum())


def _side_by_side(sequences: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[list[int], SideBySide]]:
    """Groups of numbered sequences of about TOKENS tokens."""
    numbers, held, n = [], [], 0
    for number, sequence in sequences:
        numbers.append(number)
        held.append(sequence)
        n += len(sequence)
        if n >= TOKENS:
            yield numbers, SideBySide(held)
            numbers, held, n = [], [], 0
    if held:
        yield numbers, SideBySide(held)


def _sequences(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for k, symbols in enumerate(batch.column("symbols")):
        yield k, np.frombuffer(symbols.as_buffer(), "<u2")


def one_round(rows: DataFrame, model: Model, unigram: np.ndarray) -> Model:
    """Expected counts of all training texts by the model, and the model that they make likeliest."""
    states = len(model.start)
    shared = rows.sparkSession.sparkContext.broadcast(Model(model.start, model.move, model.emit.astype(np.float32)))
    names = [f"c{k}" for k in range(states)]

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions, starts, moves = np.zeros((len(unigram), states)), np.zeros(states), np.zeros((states, states))
        stretches = ((0, s[at : at + STRETCH]) for batch in batches for _, s in _sequences(batch) for at in range(0, len(s), STRETCH))
        for _, some in _side_by_side(stretches):
            a, b, _ = some.expected(shared.value, emissions)
            starts, moves = starts + a, moves + b
        there = np.flatnonzero(emissions.any(axis=1))
        # Starts and moves take the numbers below those of symbols.
        number = np.concatenate([np.arange(-1 - states, 0), there]).astype(np.int32)
        values = np.vstack([moves, starts, emissions[there]])
        yield pa.RecordBatch.from_arrays([pa.array(number), *(pa.array(values[:, k]) for k in range(states))], names=["number", *names])

    merged = rows.where("train").select("symbols").mapInArrow(expect, ", ".join(["number int", *(f"{c} double" for c in names)]))
    merged = merged.groupBy("number").agg(*[F.sum(c).alias(c) for c in names])
    emissions, moves, starts = np.zeros((len(unigram), states)), np.zeros((states, states)), np.zeros(states)
    for r in merged.collect():  # at most a row for each symbol and state, and one more
        number, values = r["number"], [r[c] for c in names]
        if number >= 0:
            emissions[number] = values
        elif number == -1:
            starts[:] = values
        else:
            moves[number + 1 + states] = values
    shared.unpersist()
    emissions += PRIOR * unigram[:, None]
    moves, starts = moves + 0.1, starts + 0.1
    return Model(starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), emissions / emissions.sum(axis=0))


def fit(rows: DataFrame, corpus: Corpus, states: int, rounds: int) -> Model:
    model = first_model(corpus, states)
    for _ in range(rounds if corpus.ends else 0):
        model = one_round(rows, model, corpus.unigram())
    return model


def _paths(rows: DataFrame, model: Model) -> DataFrame:
    """The rows with ``path``: log10 of the probability of their symbols."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kept = ["row", "doc_id", "n_tokens", "n_known", "known", "shares"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            path = np.zeros(batch.num_rows)
            for numbers, some in _side_by_side(_sequences(batch)):
                path[numbers] = some.likelihoods(shared.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(path)], names=[*kept, "path"])

    return rows.select(*kept, "symbols").mapInArrow(score, "row long, doc_id long, n_tokens long, n_known long, known double, shares double, path double")


def score_texts(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    words = vocabulary(docs)
    corpus = corpus_of(words, docs.where(~_held_out()).count())
    rows = as_symbols(docs, corpus)
    model = fit(rows, corpus, states, rounds)
    other = rows.select("row", F.explode("rest").alias("x")).select("row", "x.word", "x.n")
    log_c = F.log10(F.coalesce(F.col("c"), F.lit(0)) + SMOOTHING)
    known = F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)
    sums = other.join(words.hint("merge"), "word", "left").groupBy("row").agg(F.sum(F.col("n") * log_c).alias("more"), F.sum(known).alias("more_known"))
    every = _paths(rows, model).join(sums, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    denominator = float(np.log10(corpus.total + SMOOTHING * (corpus.distinct + 1)))
    base, score = F.col("known") + more - F.col("n_tokens") * F.lit(denominator), F.col("path") + F.col("shares") + more
    return every.select(
        "doc_id", _held_out().alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(corpus.total).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"),
    )
