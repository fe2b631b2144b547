"""The near-duplicate stage, with its own parameters, against all pairs compared."""

import random

from weft.llm import simhash

WORDS = ["".join(random.Random(k).choices("abcdefgh", k=2 + k % 6)) for k in range(400)]


def sentence(n, r):
    return " ".join(r.choices(WORDS, k=n))


def plain_groups(texts, words, most_bits, least):
    """Group number of each text: linked by fingerprint distance or exact Jaccard similarity of the shingle sets, all pairs compared."""
    def shingles(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).encode().split()
        return {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    sets, fps = [shingles(t) for t in texts], [simhash.fingerprint(t, words) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            near = (fps[i] ^ fps[j]).bit_count() <= most_bits
            if near or sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-6:
                a, b = root[i], root[j]
                root = [a if x == b else x for x in root]
    return root


def test_pipeline_near_duplicates(spark):
    import corpus_pipeline

    r = random.Random(31)
    texts = []
    for _ in range(25):  # single copies with spread edits
        words = sentence(r.randint(60, 200), r).split()
        texts.append(" ".join(words))
        for _ in range(r.randint(1, 5)):
            words[r.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    base = sentence(120, r).split()
    for _ in range(40):  # a large group, over jaccard.SMALL
        words = list(base)
        for _ in range(2):
            words[r.randrange(120)] = f"edit{r.randrange(10**6)}"
        texts.append(" ".join(words))
    root = plain_groups(texts, 5, 6, 0.8)
    bits_only = plain_groups(texts, 5, 6, 2)
    assert len(set(root)) < len(set(bits_only)) - 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = sorted(x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert kept == sorted({root.index(x) for x in set(root)})


def test_keep_one_by_id_and_text(spark):
    r = random.Random(7)
    a, b, c = (sentence(80, r) for _ in range(3))
    data = [(5, a), (3, a), (5, b), (None, c), (None, c), (None, c.replace(c.split()[0], "other", 1)), (8, b)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    kept = [(x["doc_id"], x["text"]) for x in simhash.keep_one(docs).collect()]
    assert (3, a) in kept and (5, b) in kept  # id 5 goes with text a, not with text b
    assert sum(i is None for i, _ in kept) == 1 and len(kept) == 3
