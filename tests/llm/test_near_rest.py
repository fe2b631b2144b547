"""Large groups of texts that share much, but too little for a link: no link is lost and no pairs of all with all are made."""

import random

from test_near_duplicates import WORDS, plain_groups, sentence

from weft.llm import jaccard, simhash


def test_shared_passage(spark, monkeypatch):
    r = random.Random(5)
    passage = sentence(90, r)
    texts = [f"{passage} {sentence(22 + k % 9, r)}" for k in range(240)]  # similar by 0.6 or so
    for k in range(0, 240, 12):  # and some with a link among them
        words = texts[k].split()
        words[-r.randint(1, 9)] = "changed"
        texts.append(" ".join(words))
    counts = []
    write = jaccard.materialize

    def counted(df, name):
        out = write(df, name)
        if name == "candidates":
            counts.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "materialize", counted)
    root = plain_groups(texts, 5, 6, 0.8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = sorted(x["doc_id"] for x in simhash.keep_one(docs).collect())
    assert kept == sorted({root.index(x) for x in set(root)})
    assert max(counts) < 20 * len(texts), counts


def test_rest_pairs_hold_every_link(spark):
    r = random.Random(11)
    sets = []
    for k in range(60):
        base = r.sample(range(40 * k, 40 * k + 200), r.choice([1, 2, 4, 5, 9, 10, 27, 60, 100]))
        sets.append(base)
        for _ in range(6):
            gone = set(r.sample(base, r.randint(0, len(base) // 5)))
            sets.append([x for x in base if x not in gone] + r.sample(range(10**6, 10**6 + 300), r.randint(0, len(base) // 8)))
    sets = [set(x) for x in sets]
    roots = [r.randrange(100) for _ in sets]
    hashes = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "s long, hashes array<long>")
    rest = spark.createDataFrame(list(enumerate(roots)), "s long, root long").repartition(3)
    found = [tuple(x) for x in jaccard._rest_pairs(rest, hashes).distinct().collect()]
    links = {(i, j, roots[i], roots[j]) for j in range(len(sets)) for i in range(j) if roots[i] != roots[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert len(links) > 200 and links <= set(found)
    assert len(found) < 10 * len(links)
