"""Toxicity by class-conditional Kneser-Ney models.

Each class, toxic and ordinary, has a character model of words of order 6:
interpolated Kneser-Ney, with counts of training documents that hold a word.
Orders 1 and 2 are shared: both classes back off to counts of all training
words together, so an expression that neither class knows says nothing. What is
compared are length-normalised log-likelihoods: of a text's distinct words, of
its best run of words, and of its most telling words. A logistic curve, fitted
on labelled documents that the models have not seen, turns them to a score.

Characters are numbered by how often the training words hold them: the
commonest ones have a number of their own, the others share the rest by hash.

Counting, the models and scoring all run on executors. Grams of up to three
characters are counted and smoothed in their own step, which grows with the
alphabet and not with the corpus. Longer grams are joined with the probability
of their last three characters and dealt by the three before the last: with
them come all of a gram's contexts and longer forms, so the recursion needs no
further shuffle. What is handed to every scoring task are the log-ratios of all
grams and contexts, none dropped, in order of their codes: ten bytes each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import arrow_limits, materialize, shuffle_partitions
from weft.llm.words import Cache, characters, groups, letter_words

ORDER, DISCOUNT = 6, 0.75
#: Bits of a character in a gram's code, and characters with a number of their own.
CHAR_BITS, OWN_NUMBERS = 10, 895
_FIELD = (1 << CHAR_BITS) - 1
#: Of the labelled documents that may be learned from, one in so many only calibrates, but about this many at most; all others are counted.
CALIBRATION_PART, CALIBRATION_DOCS = 4, 20_000
#: Grams that one group of the models is planned for: many contexts, each whole.
GROUP_GRAMS = 50_000
WINDOW = 20
FEATURES = ("mean", "window", "top1", "top2", "top3", "strong", "words")


def char_numbers(alphabet: list[int]) -> np.ndarray:
    """A number of CHAR_BITS bits, from 1 on, for each code point: those of ``alphabet`` in order, then shared ones."""
    first = 1 + len(alphabet)
    points = np.arange(0x110000, dtype=np.uint64)
    out = (first + (points * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(_FIELD + 1 - first)).astype(np.int64)
    out[alphabet] = np.arange(1, first)
    return out


def gram_codes(words: list[str], numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, order, word) of the longest gram that ends at each character but the first mark: up to ORDER characters, never across words."""
    points, starts = characters(words)
    c = numbers[points]
    owner = np.repeat(np.arange(len(words)), np.diff(np.append(starts, len(c))))
    place = np.arange(len(c)) - starts[owner]
    code = c.copy()
    for back in range(1, ORDER):
        code[back:] |= np.where(place[back:] >= back, c[:-back] << (CHAR_BITS * back), 0)
    inside = place > 0
    return code[inside], np.minimum(place[inside] + 1, ORDER), owner[inside]


def _mask(order: int) -> int:
    return (1 << (CHAR_BITS * order)) - 1


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic, ordinary): documents of each class that hold the word, for each batch."""
    for batch in batches:
        counts = Counter(), Counter()
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[0 if toxic else 1].update(set(letter_words(text)))
        words = list(counts[0] | counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in counts)], ["word", "toxic", "ordinary"])


def _char_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            points, n = np.unique(characters(batch.column(0).to_pylist())[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(points.astype(np.int64)), pa.array(n.astype(np.int64))], ["point", "n"])


def _gram_counts(batches: Iterator[pa.RecordBatch], alphabet: list[int]) -> Iterator[pa.RecordBatch]:
    numbers = char_numbers(alphabet)
    for batch in batches:
        if not batch.num_rows:
            continue
        code, _, owner = gram_codes(batch.column(0).to_pylist(), numbers)
        distinct, at = np.unique(code, return_inverse=True)
        sums = [np.bincount(at, batch.column(k).to_numpy()[owner], len(distinct)).astype(np.int64) for k in (1, 2)]
        yield pa.RecordBatch.from_arrays([pa.array(distinct), *map(pa.array, sums)], ["code", "toxic", "ordinary"])


def shared_bigrams(code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes of order 2, probability of the last character) from pooled counts: interpolated with the characters' own frequencies."""
    order = np.argsort(code)
    code, count = code[order], count[order].astype(float)
    last, context = code & _FIELD, code >> CHAR_BITS
    unigram = np.bincount(last, count, _FIELD + 1) + 0.1
    unigram /= unigram.sum()
    total, kinds = np.bincount(context, count, _FIELD + 1), np.bincount(context, minlength=_FIELD + 1)
    return code, (np.maximum(count - DISCOUNT, 0) + DISCOUNT * kinds[context] * unigram[last]) / total[context]


def orders(code: np.ndarray) -> np.ndarray:
    out = np.ones(len(code), np.int64)
    for k in range(1, ORDER):
        out += (code >> (CHAR_BITS * k)) > 0
    return out


def continued(code: np.ndarray, counts: np.ndarray, least: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(codes, counts) of each order down to ``least``: of longest grams as counted, and of shorter ones the grams that they continue."""
    order, levels = orders(code), {}
    above: tuple[np.ndarray, np.ndarray] | None = None
    for k in range(ORDER, least - 1, -1):
        c, n = code[order == k], counts[order == k].astype(float)
        if above is not None:
            short, at = np.unique(above[0] & _mask(k), return_inverse=True)
            held = np.stack([np.bincount(at, above[1][:, j] > 0, len(short)) for j in (0, 1)], axis=1)
            c, n = np.concatenate([c, short]), np.concatenate([n, held])
        by = np.argsort(c)
        levels[k] = above = c[by], n[by]
    return levels


def smooth(code: np.ndarray, counts: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probabilities of the last characters, contexts, their backoffs) of one order, a column for each class.

    code: sorted, with all grams of each context; below: probability of each without its first character.
    """
    contexts, at = np.unique(code >> CHAR_BITS, return_inverse=True)
    total = np.stack([np.bincount(at, counts[:, j], len(contexts)) for j in (0, 1)], axis=1)
    kinds = np.stack([np.bincount(at, counts[:, j] > 0, len(contexts)) for j in (0, 1)], axis=1)
    backoff = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
    return np.maximum(counts - DISCOUNT, 0) / np.maximum(total, 1)[at] + backoff[at] * below, contexts, backoff


def _log_ratio(p: np.ndarray) -> np.ndarray:
    return np.log(p[:, 0] / p[:, 1])


@dataclass
class Curve:
    """From a text's features to its score."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = (features - self.center) / self.scale @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Tables:
    """Codes of all grams and of all contexts, ascending, and their log-ratios; the alphabet that numbers the characters."""

    codes: tuple[np.ndarray, np.ndarray]
    values: tuple[np.ndarray, np.ndarray]
    alphabet: list[int]

    @cached_property
    def numbers(self) -> np.ndarray:
        return char_numbers(self.alphabet)

    def _look(self, kind: int, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes = self.codes[kind]
        if not len(codes):
            return np.zeros(len(code), bool), np.zeros(len(code), np.float32)
        order = np.argsort(code)
        at = np.empty(len(code), np.int64)
        at[order] = np.searchsorted(codes, code[order])
        at = np.minimum(at, len(codes) - 1)
        return codes[at] == code, self.values[kind][at].astype(np.float32)

    def log_ratios(self, words: list[str]) -> np.ndarray:
        """(log-likelihood toxic less ordinary, characters) of each word."""
        out = np.zeros((len(words), 2), np.float32)
        for at in range(0, len(words), 50_000):
            code, order, owner = gram_codes(words[at : at + 50_000], self.numbers)
            total = np.zeros(len(code))
            left = np.arange(len(code))
            for k in range(ORDER, 2, -1):
                now = left[order[left] >= k]
                c = code[now] & _mask(k)
                hit, value = self._look(0, c)
                total[now[hit]] += value[hit]
                miss = now[~hit]
                known, value = self._look(1, c[~hit] >> CHAR_BITS)
                total[miss[known]] += value[known]
                left = np.concatenate([left[order[left] < k], miss])
            n = min(50_000, len(words) - at)
            out[at : at + n, 0] = np.bincount(owner, total, n)
            out[at : at + n, 1] = np.bincount(owner, minlength=n)
        return out


def text_features(words: list[str], rows: np.ndarray) -> list[float]:
    """Length-normalised log-ratios of a text from those of its words (FEATURES); zeros without words."""
    if not words:
        return [0.0] * len(FEATURES)
    first = list({w: k for k, w in enumerate(words)}.values())  # a place of each distinct word
    ratio, size = rows[first, 0], rows[first, 1]
    n = min(WINDOW, len(words))
    sums = np.concatenate([[[0.0, 0.0]], np.cumsum(rows, axis=0, dtype=np.float64)])
    run = sums[n:] - sums[:-n]
    top = np.zeros(3)
    best = np.sort(ratio)[::-1][:3]
    top[: len(best)] = np.maximum(best, 0)
    return [float(ratio.sum() / size.sum()), float((run[:, 0] / run[:, 1]).max()), *top.tolist(), float(np.log1p(np.maximum(ratio - 3, 0).sum())), float(np.log(len(first)))]


def _features(texts: list[str | None], cache: Cache) -> np.ndarray:
    out = []
    for at, end in groups(texts):
        lists = [letter_words(t) for t in texts[at:end]]
        rows = cache(lists)
        ends = np.cumsum([len(x) for x in lists])
        out += [text_features(words, rows[e - len(words) : e]) for words, e in zip(lists, ends)]
    return np.array(out, float).reshape(-1, len(FEATURES))


def fit_logistic(features: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> Curve:
    """By Newton's method; a single class gives its base rate, no label a score of 0."""
    width = features.shape[1]
    if not len(labels):
        return Curve(np.zeros(width), np.ones(width), np.append(np.zeros(width), -1e9))
    center, scale = features.mean(axis=0), features.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    x = np.column_stack([(features - center) / scale, np.ones(len(labels))])
    penalty = np.append(np.full(width, ridge), 1e-3)
    w = np.zeros(width + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - labels) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return Curve(center, scale, w)


_MADE = "kind int, code long, value float, p_toxic double, p_ordinary double"


def _made(grams: list[tuple[np.ndarray, np.ndarray]], contexts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """Rows of grams (kind 0) and of contexts (kind 1) with their log-ratios, and the probabilities or backoffs."""
    code = np.concatenate([c for c, _ in (*grams, *contexts)]).astype(np.int64)
    p = np.concatenate([x for _, x in (*grams, *contexts)])
    kind = np.repeat(np.array([0, 1], np.int32), [sum(len(c) for c, _ in part) for part in (grams, contexts)])
    return pa.table({"kind": kind, "code": code, "value": _log_ratio(p).astype(np.float32), "p_toxic": p[:, 0], "p_ordinary": p[:, 1]})


def _columns(table: pa.Table, *names: str) -> np.ndarray:
    return np.stack([table.column(k).to_numpy() for k in names], axis=1)


def _trigrams(table: pa.Table, shared) -> pa.Table:
    """All trigrams of some contexts, smoothed by the shared bigrams."""
    table = table.sort_by("code")
    code = table.column("code").to_numpy()
    bigrams, probability = shared.value
    below = np.repeat(probability[np.searchsorted(bigrams, code & _mask(2))][:, None], 2, axis=1)
    p, contexts, backoff = smooth(code, _columns(table, "toxic", "ordinary").astype(float), below)
    return _made([(code, p)], [(contexts, backoff)])


def _longer(table: pa.Table) -> pa.Table:
    """All grams of four characters and more of some three characters before the last, smoothed by their trigrams."""
    code = table.column("code").to_numpy()
    lower, at = np.unique(code & _mask(3), return_index=True)
    lower_p = _columns(table, "p_toxic", "p_ordinary")[at]
    grams, contexts = [], []
    for k, (c, n) in sorted(continued(code, _columns(table, "toxic", "ordinary"), 4).items()):
        if len(c):
            p, ctx, backoff = smooth(c, n, lower_p[np.searchsorted(lower, c & _mask(k - 1))])
            grams.append((c, p))
            contexts.append((ctx, backoff))
            lower, lower_p = c, p
    return _made(grams, contexts)


def models(grams: DataFrame) -> DataFrame:
    """The log-ratios (``_MADE``) of all grams of three characters and more, and of their contexts, from counts of longest grams (code, toxic, ordinary)."""
    spark = grams.sparkSession
    suffix = lambda k: F.col("code").bitwiseAND(F.lit(_mask(k)))
    # at most one row for each pair of characters, 2**20 of them
    pairs = grams.groupBy(suffix(2).alias("c")).agg(F.sum(F.col("toxic") + F.col("ordinary")).alias("n")).toArrow().to_pandas()
    shared = spark.sparkContext.broadcast(shared_bigrams(pairs["c"].to_numpy(np.int64), pairs["n"].to_numpy(np.int64)))
    long = F.col("code") > F.lit(_mask(3))
    held = [F.max((F.col(c) > 0).cast("long")).alias(c) for c in ("toxic", "ordinary")]
    continued_by = grams.where(long).groupBy(suffix(4).alias("code")).agg(*held).select(suffix(3).alias("code"), "toxic", "ordinary")
    begin = grams.where(~long & (F.col("code") > F.lit(_mask(2))))
    threes = begin.unionByName(continued_by).groupBy("code").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    n = max(shuffle_partitions(spark), -(-grams.count() // GROUP_GRAMS))
    dealt = lambda k: F.pmod(F.xxhash64(F.shiftright("code", CHAR_BITS).bitwiseAND(F.lit(_mask(k)))), F.lit(n)).alias("bucket")
    trigrams = threes.groupBy(dealt(2)).applyInArrow(lambda t: _trigrams(t, shared), _MADE)
    trigrams = materialize(trigrams, "trigrams")
    below = trigrams.where("kind = 0").select(F.col("code").alias("three"), "p_toxic", "p_ordinary")
    joined = grams.where(long).withColumn("three", suffix(3)).join(below, "three")
    return trigrams.unionByName(joined.groupBy(dealt(3)).applyInArrow(_longer, _MADE))


def train(labelled: DataFrame, key: str, text_col: str, label_col: str):
    """(tables, as a broadcast; curve) from rows with a label of 0 or 1. Counts are of all of them but the part that calibrates."""
    spark = labelled.sparkSession
    arrow_limits(spark)
    part = F.pmod(F.xxhash64(F.col(key), F.lit(5)), F.lit(CALIBRATION_PART))
    rows = labelled.select(F.col(text_col).alias("t"), (F.col(label_col) == 1).alias("toxic"), part.alias("part"), F.xxhash64(F.col(key), F.lit(9)).alias("draw"))
    rows = materialize(rows, "labelled")
    n = rows.where("part = 0").count()
    draws = (F.col("part") == 0) & (F.pmod("draw", F.lit(1_000_000)) / F.lit(1_000_000.0) < F.lit(min(1.0, CALIBRATION_DOCS / max(n, 1))))
    words = rows.where(~draws).select("t", "toxic").mapInArrow(_word_counts, "word string, toxic long, ordinary long")
    words = words.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    words = materialize(words, "words")
    counts = words.select("word").mapInArrow(_char_counts, "point long, n long").groupBy("point").agg(F.sum("n").alias("n"))
    alphabet = [r[0] for r in counts.orderBy(F.desc("n"), "point").limit(OWN_NUMBERS).collect()]
    grams = words.mapInArrow(lambda it: _gram_counts(it, alphabet), "code long, toxic long, ordinary long").groupBy("code").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    grams = materialize(grams, "grams")
    made = models(grams).select("kind", "code", "value").toArrow()  # a row for each distinct gram and context: these grow as the vocabulary does
    kinds, codes, values = (made.column(k).to_numpy() for k in ("kind", "code", "value"))
    by = [own[np.argsort(codes[own])] for own in (np.flatnonzero(kinds == k) for k in (0, 1))]
    tables = Tables(tuple(codes[k] for k in by), tuple(values[k].astype(np.float16) for k in by), alphabet)
    handed = spark.sparkContext.broadcast(tables)
    seen = rows.where(draws).select("t", "toxic").mapInArrow(lambda it: _calibration(it, handed), "label double, " + ", ".join(f"{f} double" for f in FEATURES)).toArrow().to_pandas()
    seen = seen.sort_values(list(seen.columns), ignore_index=True)
    return handed, fit_logistic(seen[list(FEATURES)].to_numpy(float), seen["label"].to_numpy(float))


def _calibration(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    cache = Cache(shared.value.log_ratios, 2)
    for batch in batches:
        x = _features(batch.column(0).to_pylist(), cache)
        yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int8()).cast(pa.float64()), *(pa.array(c) for c in x.T)], ["label", *FEATURES])


def _score(batches: Iterator[pa.RecordBatch], shared, curve: Curve) -> Iterator[pa.RecordBatch]:
    cache = Cache(shared.value.log_ratios, 2)
    for batch in batches:
        scores = curve.scores(_features(batch.column(1).to_pylist(), cache))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3) -> DataFrame:
    """One row for each row of ``docs``: doc_id, score (0 to 1), predicted (1 if the score reaches ``threshold``).

    Learns from the rows of ``docs`` where ``learn`` holds and ``labels`` has a
    non-null label for the id (the larger, where it has several). A null text is
    empty; a text without letters gets the score of no evidence. Without a label
    to learn from all scores are 0, with labels of one class near 0 or 1. Repeated
    rows each give a row and are each learned from; other columns are not read. An
    empty table gives no row.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    marks = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label")).where("__label is not null and __id is not null").groupBy("__id").agg(F.max("__label").alias("__label"))
    rows = docs.where(learn).select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text"))
    # texts and labels are dealt by id whatever their number: one plan at every size
    shared, curve = train(rows.join(marks.hint("merge"), F.col("__doc") == F.col("__id")), "__doc", "__text", "__label")
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(lambda it: _score(it, shared, curve), "doc_id long, score double")
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
