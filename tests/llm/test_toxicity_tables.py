"""The scoring tables hold every gram, and all labelled rows but the calibration draw are counted."""

import random

import numpy as np
from pyspark.sql import functions as F

from weft.llm import toxicity
from weft.llm.words import letter_words


def labelled(n, r):
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(4, 9)))
    return [(i, " ".join(word() for _ in range(60)), i % 3 == 0) for i in range(n)]


def test_every_gram_and_context_is_kept(spark):
    data = labelled(900, random.Random(2))
    frame = spark.createDataFrame([(i, t, int(x)) for i, t, x in data], "doc_id long, text string, toxic int")
    key = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(toxicity.CALIBRATION_PART))
    counted = [x["text"] for x in frame.where(key != 0).collect()]
    words = sorted({w for t in counted for w in letter_words(t)})
    handed, _ = toxicity.train(frame, "doc_id", "text", "toxic")
    code, order, _ = toxicity.gram_codes(words, handed.value.numbers)
    seen = np.unique(code[order >= 3])
    assert len(seen) > 100_000
    assert handed.value._look(0, seen)[0].all()
    assert handed.value._look(1, np.unique(seen >> toxicity.CHAR_BITS))[0].all()
    assert not handed.value._look(0, np.array([toxicity.gram_codes(["qqqqqqqqqq"], handed.value.numbers)[0][-2]]))[0].any()


def test_rows_beyond_the_calibration_draw_are_counted(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "CALIBRATION_DOCS", 8)
    r = random.Random(4)
    data = [(i, "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=9)), i % 2) for i in range(240)]
    frame = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    handed, _ = toxicity.train(frame, "doc_id", "text", "toxic")
    last = np.array([toxicity.gram_codes([t], handed.value.numbers)[0][-1] for _, t, _ in data])
    assert handed.value._look(0, last)[0].sum() > 215


def plain_kneser_ney(words, order=toxicity.ORDER, d=toxicity.DISCOUNT):
    """Log-likelihood ratio of a word by the recursion as it is written down; words: {word: (toxic, ordinary)}."""
    marked = {"\x02" + w + "\x03": n for w, n in words.items()}
    raw = [{}, {}]
    for w, n in marked.items():
        for end in range(1, len(w)):
            g = w[max(0, end + 1 - order) : end + 1]
            for j in (0, 1):
                raw[j][g] = raw[j].get(g, 0) + n[j]
    counts = [[{} for _ in range(order + 1)] for _ in (0, 1)]
    for j in (0, 1):
        for k in range(order, 2, -1):
            at = counts[j][k]
            for g, n in raw[j].items():
                if len(g) == k:
                    at[g] = at.get(g, 0) + n
            if k < order:
                for g, n in counts[j][k + 1].items():
                    at[g[1:]] = at.get(g[1:], 0) + (n > 0)
    pairs, chars = {}, {}
    for j in (0, 1):
        for g, n in raw[j].items():
            pairs[g[-2:]] = pairs.get(g[-2:], 0) + n
    for g, n in pairs.items():
        chars[g[1]] = chars.get(g[1], 0) + n
    every = sum(chars.values()) + 0.1 * (toxicity._FIELD + 1)

    def p(j, g):
        if len(g) == 2:
            own = [n for h, n in pairs.items() if h[0] == g[0]]
            return (max(pairs.get(g, 0) - d, 0) + d * len(own) * (chars.get(g[1], 0) + 0.1) / every) / sum(own)
        own = [n for h, n in counts[j][len(g)].items() if h[:-1] == g[:-1]]
        if not sum(own):
            return p(j, g[1:])
        return max(counts[j][len(g)].get(g, 0) - d, 0) / sum(own) + d * sum(n > 0 for n in own) / sum(own) * p(j, g[1:])

    def ratio(word):
        w = "\x02" + word + "\x03"
        grams = [w[max(0, e + 1 - order) : e + 1] for e in range(2, len(w))]
        return sum(float(np.log(p(0, g) / p(1, g))) for g in grams)

    return ratio


def test_against_the_plain_recursion(spark):
    """Seen and unseen words, of one class or both, in two scripts."""
    r = random.Random(12)
    word = lambda: "".join(r.choices("abcя東", k=r.randint(1, 9)))
    counts = {word(): (r.randint(0, 3), r.randint(0, 3)) for _ in range(120)}
    counts = {w: n for w, n in counts.items() if any(n)}
    frame = spark.createDataFrame([(w, *n) for w, n in counts.items()], "word string, toxic long, ordinary long")
    alphabet = sorted(set(map(ord, "".join(counts)))) + [2, 3]
    grams = frame.mapInArrow(lambda it: toxicity._gram_counts(it, alphabet), "code long, toxic long, ordinary long").groupBy("code").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    made = toxicity.models(grams).toPandas().sort_values("code")
    pick = lambda k, c: made[made["kind"] == k][c].to_numpy()
    tables = toxicity.Tables((pick(0, "code"), pick(1, "code")), (pick(0, "value"), pick(1, "value")), alphabet)
    ratio = plain_kneser_ney(counts)
    words = list(counts)[:40] + [word() for _ in range(80)]
    assert np.allclose(tables.log_ratios(words)[:, 0], [ratio(w) for w in words], atol=1e-4)


def test_edges(spark):
    schema, score = "doc_id long, text string, score int, toxic int", lambda d, m: toxicity.toxicity(d, m, F.lit(True)).collect()
    r = random.Random(3)
    say = lambda bad: " ".join(r.choices(["мир", "слово", "東京", "кот"] + ["злоба"] * bad, k=30))
    data = [(i, say(i % 2), 1, 1) for i in range(120)] + [(7, say(1), 1, 1)] * 2 + [(None, say(1), 1, 1), (500, None, 1, 1), (501, "", 1, 1), (502, "злоба мир " * 200_000, 1, 1)]
    docs = spark.createDataFrame(data, schema)
    marks = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(3, 0), (None, 1)], "doc_id long, toxic int")
    got = score(docs, marks)
    assert len(got) == len(data) and all(0 <= x["score"] <= 1 for x in got)
    assert np.mean([x["predicted"] == x["doc_id"] % 2 for x in got if x["doc_id"] is not None and x["doc_id"] < 120]) > 0.95
    assert score(docs.limit(0), marks) == []
    assert max(x["score"] for x in score(docs, marks.limit(0))) < 1e-9
    assert min(x["score"] for x in score(docs, marks.where("toxic = 1 and doc_id <> 3"))) > 0.5
