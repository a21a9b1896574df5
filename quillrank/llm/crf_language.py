"""Language ID by a linear-chain conditional random field (operator 7).

Every word of a text gets a label. A word's score for a language sums learned
weights of its hashed features: character n-grams, affixes (n-grams with a
word end), and lexicon membership (whether it is among a language's commonest
training words). Learned transition weights tie neighbouring words, so that
code-switched texts are labelled stretch by stretch. Posterior label
probabilities come from forward-backward over the whole text; their mean over
the words gives the text's language and its score.

The model is learned on the driver from a bounded sample: ``TRAIN_ROWS`` rows
a language (``TRAIN_TOTAL`` in all; the ``MAX_LANGUAGES`` commonest languages
unless ``languages`` names more), ``TRAIN_WORDS`` words of each, joined to sequences that switch
between languages. It has a fixed size (``DIMENSION`` weights a language) and
is broadcast. Prediction is a map over the documents without a shuffle.

Forward-backward runs for many texts at once: texts are cut into blocks of
``BLOCK`` words; products of the transfer matrices of all blocks, then the
chain over the blocks of each text, then the words within all blocks. This is
the exact recursion in another order of multiplication. The products take
memory by the square of the number of languages, so the words worked on at a
time are bounded by it; a text beyond that bound is gone through word by word,
from forward messages remembered every ``SEGMENT`` words, and holds no more.
The weights' table is smaller where there are many languages.

Words are letters (Unicode category L) with the marks that follow them;
numbers, such as one half or a circled two, are none.

Defined results: null texts and texts without a letter are ``und`` with score
0; so is everything when there is nothing to learn from; ties take the first
language in code point order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import col, texts

DIMENSION = 1 << 16
#: Weights of the model at most, unless it has more languages than that allows 2^10 features each.
WEIGHTS = 1 << 23
#: Rows of a language and of all, and words of a row, that are learned from.
TRAIN_ROWS = 600
TRAIN_TOTAL = 20_000
TRAIN_WORDS = 96
MAX_LANGUAGES = 500
LEXICON = 200
SEQUENCE = 48
EPOCHS = 4
RATE, DECAY = 0.3, 1e-3
BLOCK = 32
#: Scores (words times languages) worked on at a time, and remembered by a task.
LABELLED_SCORES = 1_600_000
#: Numbers in the products of blocks, and in the features of new words, at a time.
PRODUCTS = 1 << 22
SEGMENT = 256
CACHED_SCORES = 2_000_000
SEED = 7
UNKNOWN = "und"
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


_SALTS = {n: np.uint64(0x9E3779B97F4A7C15 + 2 * n) for n in (2, 3, 4)}


def feature_table(words: list[str], lexicon: dict[str, int], dimension: int = DIMENSION) -> tuple[np.ndarray, np.ndarray]:
    """Features of words, one word after the other, and where each word's begin.

    A word is bracketed, as in ``<word>``; its features are hashes of its 2-,
    3- and 4-grams (those with a bracket are its affixes) and its lexicons.
    The first number above the hashes stands for none, the others for sets of
    languages whose lexicon the word is in.
    """
    code = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    begin = np.flatnonzero(code == ord("<"))
    lengths = np.diff(np.concatenate([begin, [len(code)]]))
    left = np.repeat(begin + lengths, lengths) - np.arange(len(code))  # from each place to its word's end
    out = np.full((len(code), len(_SALTS) + 1), dimension, np.int64)
    for column, (n, salt) in enumerate(_SALTS.items()):
        if len(code) >= n:
            gram = np.zeros(len(code) - n + 1, np.uint64)
            for i in range(n):
                gram = (gram ^ code[i : i + len(gram)]) * salt
                gram ^= gram >> np.uint64(29)
            whole = left[: len(gram)] >= n
            out[: len(gram), column][whole] = (gram % np.uint64(dimension)).astype(np.int64)[whole]
    out[begin, -1] = [dimension + lexicon.get(w, 0) for w in words]
    return out.ravel(), begin * out.shape[1]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # feature, language
    transitions: np.ndarray  # from, to
    lexicon: dict[str, int]
    dimension: int = DIMENSION

    def scores(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.languages)))
        # Lexicon sets come behind the hashes and the place that stands for none.
        found, starts = feature_table(words, self.lexicon, self.dimension)
        ends = np.append(starts[1:], len(found))
        out, at = np.empty((len(words), len(self.languages))), 0
        while at < len(words):
            stop = max(at + 1, int(np.searchsorted(ends, starts[at] + PRODUCTS // len(self.languages), "right")))
            out[at:stop] = np.add.reduceat(self.weights[found[starts[at] : ends[stop - 1]]], starts[at:stop] - starts[at], axis=0)
            at = stop
        return out


def posteriors(scores: np.ndarray, transitions: np.ndarray, lengths: np.ndarray, block: int = BLOCK, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of all words of texts of the given lengths (each 1 or more); with ``pairs``, also the expected transitions in total.

    ``scores`` has a row for each word, text after text.
    """
    n, size = scores.shape
    step = np.exp(transitions - transitions.max())
    emit = np.exp(scores - scores.max(1, keepdims=True))
    blocks = -(-lengths // block)
    first = np.cumsum(blocks) - blocks  # first block of each text
    text = np.repeat(np.arange(len(lengths)), lengths)
    within = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row, column = first[text] + within // block, within % block
    total = int(blocks.sum())
    e, used = np.ones((block, total, size)), np.zeros((block, total), bool)
    e[column, row], used[column, row] = emit, True
    head = np.zeros(total, bool)
    head[first] = True  # the first word of a text has no transition before it
    empty = [np.flatnonzero(~used[t]) for t in range(block)]  # places behind the end of a text

    product = np.broadcast_to(np.eye(size), (total, size, size)).copy()
    for t in range(block if total > len(lengths) else 0):
        new = (product.reshape(-1, size) @ step).reshape(total, size, size)
        if t == 0:
            new[head] = product[head]
        new *= e[t][:, None, :]
        new[empty[t]] = product[empty[t]]
        product = new
        if t % 8 == 7 or t == block - 1:
            product /= product.sum((1, 2), keepdims=True)

    before, after = np.full((total, size), 1.0 / size), np.ones((total, size))
    for k in range(1, int(blocks.max())):
        at = first[blocks > k] + k
        v = np.einsum("bi,bij->bj", before[at - 1], product[at - 1])
        before[at] = v / v.sum(1, keepdims=True)
    for k in range(int(blocks.max()) - 2, -1, -1):
        at = first[blocks > k + 1] + k
        v = np.einsum("bij,bj->bi", product[at + 1], after[at + 1])
        after[at] = v / v.sum(1, keepdims=True)

    alpha, v = np.empty((block, total, size)), before
    for t in range(block):
        move = v @ step
        if t == 0:
            move[head] = v[head]
        move *= e[t]
        move /= move.sum(1, keepdims=True)
        move[empty[t]] = v[empty[t]]
        v = alpha[t] = move
    gamma, expected, back = np.empty((block, total, size)), np.zeros((size, size)), after
    for t in range(block - 1, -1, -1):
        g = alpha[t] * back
        gamma[t] = g / g.sum(1, keepdims=True)
        onward = e[t] * back
        if pairs:
            source = before if t == 0 else alpha[t - 1]
            linked = used[t] & ~head if t == 0 else used[t]
            pair = np.einsum("bi,ij,bj->bij", source[linked], step, onward[linked])
            expected += (pair / pair.sum((1, 2), keepdims=True)).sum(0) if len(pair) else 0
        lead = onward @ step.T
        lead /= lead.sum(1, keepdims=True)
        lead[empty[t]] = back[empty[t]]
        back = lead
    return gamma[column, row], expected


def long_mean(known: WordScores, numbers: np.ndarray) -> np.ndarray:
    """Mean label probabilities of the words of one long text: forward-backward with the forward messages remembered every ``SEGMENT`` words."""
    transitions = known.model.transitions
    step = np.exp(transitions - transitions.max())

    def emissions(at: int) -> np.ndarray:
        scores = known.scores(numbers[at : at + SEGMENT])
        return np.exp(scores - scores.max(1, keepdims=True))

    def forward(v: np.ndarray, e: np.ndarray, at: int) -> np.ndarray:
        out = np.empty_like(e)
        for t, row in enumerate(e):
            v = (v @ step if at + t else v) * row
            out[t] = v = v / v.sum()
        return out

    size = len(step)
    starts = range(0, len(numbers), SEGMENT)
    before = [np.full(size, 1.0 / size)]
    for at in starts:
        before.append(forward(before[-1], emissions(at), at)[-1])
    total, back = np.zeros(size), np.ones(size)
    for at, v in zip(reversed(starts), reversed(before[:-1]), strict=True):
        e = emissions(at)
        alpha = forward(v, e, at)
        for t in range(len(e) - 1, -1, -1):
            gamma = alpha[t] * back
            total += gamma / gamma.sum()
            back = step @ (e[t] * back)
            back /= back.sum()
    return total / len(numbers)


def train(samples: list[tuple[str, list[str]]], dimension: int = DIMENSION, epochs: int = EPOCHS, seed: int = SEED) -> Model | None:
    """Fit the weights by AdaGrad on the likelihood of sequences joined from samples of (language, words)."""
    samples = sorted((s, w) for s, w in samples if w)
    if not samples:
        return None
    languages = sorted({s for s, _ in samples})
    dimension = min(dimension, max(1 << 10, 1 << (WEIGHTS // len(languages)).bit_length() - 1))
    together = max(1, min(64, PRODUCTS // 2 // len(languages) ** 2))  # sequences of a step
    number = {s: i for i, s in enumerate(languages)}
    common: dict[str, Counter] = {s: Counter() for s in languages}
    for s, w in samples:
        common[s].update(w)
    within: dict[str, tuple[int, ...]] = {}
    for s in languages:
        for w, _ in sorted(common[s].items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            within[w] = (*within.get(w, ()), number[s])
    sets = {x: 1 + i for i, x in enumerate(sorted(set(within.values())))}
    lexicon = {w: sets[x] for w, x in within.items()}
    vocabulary = sorted({w for _, ws in samples for w in ws})
    place = {w: i for i, w in enumerate(vocabulary)}
    found, starts = feature_table(vocabulary, lexicon, dimension)
    none = found == dimension
    sizes = np.diff(np.concatenate([starts, [len(found)]]))
    size, draw = len(languages), np.random.default_rng(seed)
    rows = dimension + 1 + len(sets)
    weights, transitions = np.zeros((rows, size)), np.zeros((size, size))
    seen_w, seen_t = np.full((rows, size), 1e-6), np.full((size, size), 1e-6)
    pieces = [(number[s], [place[x] for x in w[i : i + SEQUENCE // 2]]) for s, w in samples for i in range(0, len(w), SEQUENCE // 2)]
    for _ in range(epochs):
        order = draw.permutation(len(pieces))
        # Two pieces at a time: a sequence switches where their languages differ.
        pairs = [order[i : i + 2] for i in range(0, len(order), 2)]
        for at in range(0, len(pairs), together):
            group = [[pieces[i] for i in pair] for pair in pairs[at : at + together]]
            ids = np.array([x for seq in group for _, w in seq for x in w])
            truth = np.array([s for seq in group for s, w in seq for _ in w])
            lengths = np.array([sum(len(w) for _, w in seq) for seq in group])
            used, back = np.unique(ids, return_inverse=True)
            take = np.concatenate([np.arange(starts[u], starts[u] + sizes[u]) for u in used])
            offsets = np.cumsum(sizes[used]) - sizes[used]
            scores = np.add.reduceat(weights[found[take]], offsets, axis=0)
            gamma, expected = posteriors(scores[back], transitions, lengths, pairs=True)
            slope = -gamma
            slope[np.arange(len(truth)), truth] += 1
            by_word = np.stack([np.bincount(back, slope[:, s], len(used)) for s in range(size)], 1)
            real_ones = ~none[take]
            touched, where = np.unique(found[take][real_ones], return_inverse=True)
            each = np.repeat(by_word, sizes[used], axis=0)[real_ones]
            gradient = np.stack([np.bincount(where, each[:, s], len(touched)) for s in range(size)], 1)
            gradient -= DECAY * weights[touched]
            seen_w[touched] += gradient**2
            weights[touched] += RATE * gradient / np.sqrt(seen_w[touched])
            real = np.zeros((size, size))
            ends = np.cumsum(lengths)
            inner = np.setdiff1d(np.arange(1, len(truth)), ends)
            np.add.at(real, (truth[inner - 1], truth[inner]), 1)
            change = real - expected
            seen_t += change**2
            transitions += RATE * change / np.sqrt(seen_t)
    return Model(languages, weights, transitions, lexicon, dimension)


def training_sample(docs: DataFrame, allowed: Column, id_col: str, text_col: str, lang_col: str, rows: int = TRAIN_ROWS, words: int = TRAIN_WORDS, languages: int = MAX_LANGUAGES) -> list[tuple[str, list[str]]]:
    """About ``rows`` texts of each of the ``languages`` commonest languages, chosen by a hash of the id, and a stretch of ``words`` words of each."""
    usable = docs.where(allowed & col(lang_col).isNotNull() & col(text_col).isNotNull())
    usable = usable.select(col(id_col).alias("id"), col(lang_col).cast("string").alias("lang"), col(text_col).cast("string").alias("text"))
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    rows = min(rows, TRAIN_TOTAL // max(1, len(counts)))
    share = usable.sparkSession.createDataFrame([(r["lang"], rows / r["count"]) for r in counts], "lang string, share double")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "id", "text"), 1).cast("double") / float(1 << 63)
    chosen = usable.join(F.broadcast(share), "lang").where(draw < F.col("share")).select("lang", "text", F.xxhash64("id", "text").alias("seed"))

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, seed in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                found = words_of(text)
                at = seed % max(1, len(found) - words + 1)
                out.append(found[at : at + words])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["lang", "words"])

    # The draw gives about TRAIN_TOTAL rows at most; twice that is the bound, of which the first by hash stay.
    found = chosen.orderBy("seed", "lang").limit(2 * TRAIN_TOTAL).mapInArrow(stretch, "lang string, words array<string>")
    return [(r["lang"], list(r["words"])) for r in found.collect()]


class WordScores(dict):
    """Numbers of words, given as they come, and the scores by number."""

    def __init__(self, model: Model):
        self.model, self.limit = model, max(10_000, CACHED_SCORES // len(model.languages))
        self.table, self.new = np.zeros((0, len(model.languages))), []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number

    def scores(self, numbers: np.ndarray) -> np.ndarray:
        if self.new:
            self.table = np.concatenate([self.table, self.model.scores(self.new)])
            self.new = []
        return self.table[numbers]

    def forget(self) -> None:
        """Drop all numbers, if there are many; those given before mean nothing then."""
        if len(self) > self.limit:
            self.clear()
            self.table, self.new = self.table[:0].copy(), []


def label_texts(known: WordScores, batch_texts: list[str]) -> tuple[list[str], list[float]]:
    """Language and score of each text, some texts at a time."""
    model = known.model
    labels, scores = [UNKNOWN] * len(batch_texts), [0.0] * len(batch_texts)
    held: list[tuple[int, np.ndarray]] = []
    size = len(model.languages)
    count, most = 0, max(1, min(LABELLED_SCORES // size, BLOCK * PRODUCTS // size**2))

    def flush() -> None:
        if not held:
            return
        lengths = np.array([len(x) for _, x in held])
        gamma, _ = posteriors(known.scores(np.concatenate([x for _, x in held])), model.transitions, lengths)
        means = np.add.reduceat(gamma, np.cumsum(lengths) - lengths, axis=0) / lengths[:, None]
        for (i, _), mean in zip(held, means, strict=True):
            set_label(i, mean)
        held.clear()
        known.forget()

    def set_label(i: int, mean: np.ndarray) -> None:
        best = int(np.argmax(mean))
        labels[i], scores[i] = model.languages[best], min(1.0, max(0.0, float(mean[best])))

    for i, text in enumerate(batch_texts):
        found = words_of(text)
        if len(found) > most:
            flush()
            count, numbers = 0, np.fromiter(map(known.__getitem__, found), np.int64, len(found))
            set_label(i, long_mean(known, numbers))
            known.forget()
        elif found:
            if count + len(found) > most:
                flush()
                count = 0
            held.append((i, np.fromiter(map(known.__getitem__, found), np.int64, len(found))))
            count += len(found)
            if count >= most:
                flush()
                count = 0
    flush()
    return labels, scores


def predict(docs: DataFrame, model: Model | None, carry: list[str], text_col: str = "text") -> DataFrame:
    """Struct ``doc`` of the ``carry`` columns, ``lang_pred`` and ``score`` of each row."""
    doc = F.struct(*[col(c).alias(c) for c in carry] or [F.lit(0)]).alias("doc")
    row = docs.select(doc, col(text_col).cast("string").alias("text"))
    if model is None:
        return row.select("doc", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = row.select("doc", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordScores(shared.value)
        for batch in batches:
            labels, scores = label_texts(known, texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=["doc", "lang_pred", "score"])

    return row.mapInArrow(run, schema)


def identify_languages(docs: DataFrame, allowed: Column, carry: list[str], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", languages: int = MAX_LANGUAGES) -> DataFrame:
    """Learn the ``languages`` commonest languages of the ``allowed`` rows and predict all rows of ``docs``."""
    return predict(docs, train(training_sample(docs, allowed, id_col, text_col, lang_col, languages=languages)), carry, text_col)
