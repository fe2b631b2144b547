"""Language identification by a linear-chain conditional random field over words.

A word's features are its character bigrams and trigrams with marks at its
ends, its affixes of three and four characters, and its place in the lexicon of
each language (the commonest training words). Together with learned transitions
between the languages of neighbouring words they label every word of a text, so
a text may change language. Posteriors come from forward-backward, exactly and
for whole texts: blocks of words run side by side and are joined by a scan over
blocks. A text's language is the one with the largest mean posterior.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.common import arrow_limits
from weft.llm.words import Cache, characters, groups, letter_words

#: The training sample: labelled documents a language, and the most characters of one.
TRAIN_DOCS, TRAIN_CHARS = 500, 20_000
FEATURE_BITS, LEXICON = 18, 2000
ROUNDS = 60
#: Training sequences are spliced from spans of different documents, of this mean length in words.
SPAN, SEQUENCE = 25, 200
_BLOCK = 32
#: Word types and sequences that training takes at once.
_TYPES, _SEQUENCES = 50_000, 500
UNKNOWN = "und"


def word_features(words: list[str], lexicon: dict[str, int], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers of all words, start of each word's features)."""
    codes, starts = characters(words)
    c = codes.astype(np.uint64)
    size = np.diff(np.append(starts, len(codes)))
    owner = np.repeat(np.arange(len(words)), size)
    left = size[owner] - (np.arange(len(c)) - starts[owner])  # characters from here to the word's end

    def gram(at: np.ndarray, n: int, kind: int) -> np.ndarray:
        h = np.full(len(at), kind * 0x9E3779B9 + n, np.uint64)
        for k in range(n):
            h = (h ^ c[at + k]) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(31)
        return (h >> np.uint64(64 - bits)).astype(np.int64)

    parts, owners = [], []
    for n in (2, 3):
        at = np.flatnonzero(left >= n)
        parts.append(gram(at, n, 0))
        owners.append(owner[at])
    for n in (4, 5):  # an affix of n - 1 characters and the mark
        w = np.flatnonzero(size > n)
        parts += [gram(starts[w], n, 1), gram(starts[w] + size[w] - n, n, 2)]
        owners += [w, w]
    known = np.array([lexicon.get(w, -1) for w in words], np.int64)
    w = np.flatnonzero(known >= 0)
    # lexicon features have numbers of their own, after the hashed ones
    parts.append(known[w] + (1 << bits))
    owners.append(w)
    feature, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return feature[order], np.searchsorted(owner[order], np.arange(len(words)))


def _sums(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(rows, starts, axis=0) if len(starts) else np.zeros((0, rows.shape[1]), rows.dtype)


@dataclass
class Crf:
    """langs in order; weights of features (rows) for languages; transitions as log potentials, from row to column."""

    langs: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray
    transitions: np.ndarray
    bits: int = FEATURE_BITS

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.langs)), np.float32)
        for at in range(0, len(words), 50_000):
            feature, starts = word_features(words[at : at + 50_000], self.lexicon, self.bits)
            out[at : at + 50_000] = _sums(self.weights[feature], starts)
        return out


def posteriors(emissions: np.ndarray, sizes: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Posterior of each language at each word; texts of ``sizes`` words (none 0) stand one after another.

    Forward-backward: a block's words are multiplied to one matrix, a scan over
    each text's blocks brings the messages to the edges of all blocks, and a
    pass within the blocks spreads them to the words.
    """
    n, labels = emissions.shape
    x = np.exp(emissions - emissions.max(axis=1, keepdims=True)).astype(np.float64)
    a = np.exp(transitions - transitions.max()).astype(np.float64)
    per_text = -(-sizes // _BLOCK)
    blocks = int(per_text.sum())
    text_of = np.repeat(np.arange(len(sizes)), per_text)
    first_block = np.cumsum(per_text) - per_text
    first_word = np.cumsum(sizes) - sizes
    at = (first_word[text_of] + (np.arange(blocks) - first_block[text_of]) * _BLOCK)[:, None] + np.arange(_BLOCK)
    valid = at < (first_word + sizes)[text_of][:, None]
    at = np.where(valid, at, 0)
    xs = np.where(valid[:, :, None], x[at], 1.0)

    product = np.broadcast_to(np.eye(labels), (blocks, labels, labels)).copy()
    for k in range(_BLOCK):
        step = (product.reshape(-1, labels) @ a).reshape(blocks, labels, labels) * xs[:, k, None, :]
        product = np.where(valid[:, k, None, None], step, product)
        product /= product.sum(axis=(1, 2), keepdims=True)

    order = np.argsort(-per_text, kind="stable")
    counts = per_text[order]
    into, out_of = np.empty((blocks, labels)), np.empty((blocks, labels))
    alpha = np.full((len(sizes), labels), 1.0 / labels)
    for j in range(int(counts[0]) if len(counts) else 0):
        live = int(np.searchsorted(-counts, -j, "left"))  # texts with more than j blocks
        b = first_block[order[:live]] + j
        into[b] = alpha[:live]
        alpha[:live] = np.einsum("tl,tlm->tm", alpha[:live], product[b])
        alpha[:live] /= alpha[:live].sum(axis=1, keepdims=True)
    beta = np.full((len(sizes), labels), 1.0)
    for j in range(int(counts[0]) - 1 if len(counts) else -1, -1, -1):
        live = int(np.searchsorted(-counts, -j, "left"))
        b = first_block[order[:live]] + j
        out_of[b] = beta[:live]
        beta[:live] = np.einsum("tlm,tm->tl", product[b], beta[:live])
        beta[:live] /= beta[:live].sum(axis=1, keepdims=True)

    forward = np.empty((blocks, _BLOCK, labels))
    alpha = into
    for k in range(_BLOCK):
        alpha = np.where(valid[:, k, None], (alpha @ a) * xs[:, k], alpha)
        alpha /= alpha.sum(axis=1, keepdims=True)
        forward[:, k] = alpha
    beta = out_of
    for k in range(_BLOCK - 1, -1, -1):
        forward[:, k] *= beta
        beta = np.where(valid[:, k, None], (xs[:, k] * beta) @ a.T, beta)
        beta /= beta.sum(axis=1, keepdims=True)
    out = forward[valid]
    return out / out.sum(axis=1, keepdims=True)


def _pair_posteriors(x: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """For sequences of one length (sequence, word, label): posteriors, summed pair posteriors, log partition."""
    n, steps, labels = x.shape
    top = x.max(axis=2, keepdims=True)
    e, a = np.exp(x - top), np.exp(transitions)
    alphas, scale = np.empty_like(e), np.empty((n, steps))
    alpha = np.full((n, labels), 1.0 / labels)
    for t in range(steps):
        alpha = (alpha @ a) * e[:, t]
        scale[:, t] = alpha.sum(axis=1)
        alpha = alpha / scale[:, t, None]
        alphas[:, t] = alpha
    pairs = np.zeros((labels, labels))
    beta = np.ones((n, labels))
    marginal = np.empty_like(e)
    for t in range(steps - 1, -1, -1):
        marginal[:, t] = alphas[:, t] * beta
        weighted = e[:, t] * beta / scale[:, t, None]
        before = alphas[:, t - 1] if t else np.full((n, labels), 1.0 / labels)
        pairs += (before.T @ weighted) * a
        beta = weighted @ a.T
    return marginal, pairs, float((np.log(scale) + top[:, :, 0]).sum())


def train(samples: list[tuple[str, str]], rounds: int = ROUNDS, bits: int = FEATURE_BITS, seed: int = 7) -> Crf:
    """Fit to (language, text) pairs. Sequences that change language are spliced from spans of the texts, so that transitions are learned."""
    langs = sorted({lang for lang, _ in samples})
    number = {lang: k for k, lang in enumerate(langs)}
    rng = np.random.default_rng(seed)
    spans: list[list[list[str]]] = [[] for _ in langs]
    common = [Counter() for _ in langs]
    for lang, text in sorted(samples):
        words = list(map(sys.intern, letter_words(text)))
        common[number[lang]].update(words)
        at = 0
        while at < len(words):
            size = 1 + int(rng.geometric(1 / SPAN))
            spans[number[lang]].append(words[at : at + size])
            at += size
    lexicon: dict[str, int] = {}
    for k, counts in enumerate(common):
        for word, _ in counts.most_common(LEXICON):
            lexicon.setdefault(word, k)
            if lexicon[word] != k and counts[word] > common[lexicon[word]][word]:
                lexicon[word] = k
    labels = len(langs)
    words, tags = [], []
    queue = [(k, s) for k, group in enumerate(spans) for s in group]
    for i in rng.permutation(len(queue)):
        k, span = queue[i]
        words += span
        tags += [k] * len(span)
    steps = min(SEQUENCE, len(words))
    n = len(words) // steps if steps else 0
    weights, transitions = np.zeros(((1 << bits) + labels, labels), np.float32), np.zeros((labels, labels))
    if not n:
        return Crf(langs, lexicon, weights, transitions, bits)
    words, tags = words[: n * steps], np.array(tags[: n * steps])
    types = sorted(set(words))
    place = {w: k for k, w in enumerate(types)}
    ids = np.array([place[w] for w in words])
    del words, spans, queue, place
    parts = [word_features(types[k : k + _TYPES], lexicon, bits) for k in range(0, len(types), _TYPES)]
    feature, before = np.concatenate([f.astype(np.int32) for f, _ in parts]), np.cumsum([0, *(len(f) for f, _ in parts)])
    starts = np.concatenate([s + b for (_, s), b in zip(parts, before)])
    del parts
    owner = np.repeat(np.arange(len(types), dtype=np.int32), np.diff(np.append(starts, len(feature))))
    y, ids = tags.reshape(n, steps), ids.reshape(n, steps).astype(np.int32)
    gold_pairs = np.zeros((labels, labels))
    np.add.at(gold_pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    gold_pairs += np.bincount(y[:, 0], minlength=labels)[None, :] / labels
    square, square_t = np.full(weights.shape, 1e-6, np.float32), np.full(transitions.shape, 1e-6)
    for _ in range(rounds):  # AdaGrad on the conditional likelihood
        scores = np.concatenate([_sums(weights[feature[starts[k] : starts[k + _TYPES] if k + _TYPES < len(starts) else None]], starts[k : k + _TYPES] - starts[k]) for k in range(0, len(starts), _TYPES)])
        by_type, pairs = np.zeros((len(types), labels)), np.zeros((labels, labels))
        for k in range(0, n, _SEQUENCES):  # some sequences and word types at a time: the driver holds little more than the features
            at = ids[k : k + _SEQUENCES]
            marginal, some, _ = _pair_posteriors(scores[at].astype(np.float64), transitions)
            pairs += some
            for j in range(labels):
                by_type[:, j] += np.bincount(at.ravel(), ((y[k : k + _SEQUENCES] == j) - marginal[:, :, j]).ravel(), len(types))
        grad = np.stack([np.bincount(feature, by_type[owner, j], len(weights)) for j in range(labels)], axis=1) / n - 1e-5 * weights
        grad_t = (gold_pairs - pairs) / n - 1e-4 * transitions
        square += grad.astype(np.float32) ** 2
        square_t += grad_t**2
        weights += (0.2 * grad / np.sqrt(square)).astype(np.float32)
        transitions += 0.2 * grad_t / np.sqrt(square_t)
    return Crf(langs, lexicon, weights, transitions, bits)


def classify(model: Crf, texts: list[str | None], cache: Cache | None = None) -> list[tuple[str, float]]:
    """(language, mean posterior) of each text."""
    cache = cache or Cache(model.emissions, len(model.langs))
    out: list[tuple[str, float]] = []
    for at, end in groups(texts):
        lists = [letter_words(t) for t in texts[at:end]]
        full = [k for k, words in enumerate(lists) if words]
        found = [(UNKNOWN, 0.0)] * len(lists)
        if full and model.langs:
            sizes = np.array([len(lists[k]) for k in full])
            post = posteriors(cache([lists[k] for k in full]), sizes, model.transitions)
            mean = np.add.reduceat(post, np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
            best = np.round(mean, 12).argmax(axis=1)
            for k, b, m in zip(full, best.tolist(), mean):
                found[k] = (model.langs[b], float(min(1.0, m[b])))
        out += found
    return out


def label_words(model: Crf, text: str | None) -> list[tuple[str, str, float]]:
    """(word, language, posterior) of each letter word of a text."""
    words = letter_words(text)
    if not words or not model.langs:
        return []
    post = posteriors(model.emissions(words), np.array([len(words)]), model.transitions)
    return [(w, model.langs[int(p.argmax())], float(p.max())) for w, p in zip(words, post)]


def training_sample(docs: DataFrame, fold: Column, text_col: str, lang_col: str, key: Column, per_lang: int = TRAIN_DOCS, most_chars: int = TRAIN_CHARS) -> list[tuple[str, str]]:
    """About ``per_lang`` texts of each language, drawn by a hash of ``key``; of a longer text the first ``most_chars`` characters.

    Counts a language first: a row is drawn if its hash falls under its language's rate. One pass, no shuffle of texts.
    """
    fits = docs.where(fold & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in fits.groupBy(F.col(lang_col)).count().collect()}
    if not counts:
        return []
    rate = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        rate = F.when(F.col(lang_col) == lang, F.lit(min(1.0, per_lang / n))).otherwise(rate)
    drawn = F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1_000_000)) / F.lit(1_000_000.0) < rate
    return [(r[0], r[1]) for r in fits.where(drawn).select(lang_col, F.substring(text_col, 1, most_chars)).collect()]


def _predict(batches: Iterator[pa.RecordBatch], shared, column: int, names: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    model = shared.value
    cache = Cache(model.emissions, max(1, len(model.langs)))
    for batch in batches:
        found = classify(model, batch.column(column).to_pylist(), cache)
        extra = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, *names])


def identify(docs: DataFrame, model: Crf, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "lang_score") -> DataFrame:
    """``docs`` with two more columns: the language of the whole text and its mean posterior over the words.

    ``und`` and 0 for a null text or one without a letter. A column of ``docs`` with one of the names is replaced.
    """
    arrow_limits(docs.sparkSession)
    rows = docs.drop(lang_out, score_out)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most (2**bits + languages) * languages weights
    at = rows.columns.index(text_col)
    schema = T.StructType([*rows.schema, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    return rows.mapInArrow(lambda it: _predict(it, shared, at, (lang_out, score_out)), schema)
