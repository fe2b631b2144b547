"""The q-gram filter against a full alignment of every passage, at every size of what is counted at once."""

import random
import resource

import numpy as np
import pytest

from weft.llm import decontaminate


def fewest_edits(text: str, items: list[tuple[int, str]]) -> dict[int, int]:
    """Each item's fewest edits over its passages, by the whole alignment matrix."""
    norm, out = decontaminate.normalize(text)[0], {}
    lanes = np.arange(len(norm) + 1)
    for item, t in items:
        codes = decontaminate.normalize(t)[0]
        for a, b in decontaminate.passages(codes):
            row = np.zeros(len(norm) + 1, int)
            for c in codes[a:b]:
                new = np.concatenate([[row[0] + 1], np.minimum(row[:-1] + (norm != c), row[1:] + 1)])
                row = np.minimum.accumulate(new - lanes) + lanes
            if row.min() <= decontaminate.budget(b - a):
                out[item] = min(out.get(item, 99), int(row.min()))
    return out


def edited(text: str, n: int, r: random.Random) -> str:
    s = list(text)
    for _ in range(n):
        p = r.randrange(len(s))
        s[p : p + 1] = r.choice([["x"], [s[p], "y"], []])
    return "".join(s)


@pytest.mark.parametrize("most", [1_000_000, 2000, 300])
def test_filter_equals_full_alignment(monkeypatch, most):
    monkeypatch.setattr(decontaminate, "_MATCHES", most)
    r = random.Random(4)
    prose = lambda n: "".join(r.choices("abcde fgh", k=n)).strip() or "a"
    items = [(i, prose(r.choice([40, 90, 150, 190]))) for i in range(5)] + [(10, "=-" * 60), (11, "ab" * 30 + prose(30))]
    texts = ["=-" * 200, "", "ab" * 200]
    for _ in range(25):  # around the edit budget, on both sides
        x = r.choice(items)[1]
        e = decontaminate.budget(min(len(x), decontaminate.PASSAGE))
        texts.append(f"{prose(r.randint(0, 150))} {edited(x, r.randint(max(0, e - 3), e + 3), r)} {prose(r.randint(0, 60))}")
    found = decontaminate.search(texts, decontaminate.Index(items))
    assert [{i: edits for i, edits, *_ in hits} for hits in found] == [fewest_edits(t, items) for t in texts]


def test_first_exact_span():
    item = "a passage of some forty letters, found twice"
    text = f"x {item} and {item.replace('twice', 'thrice')} and {item}"
    assert decontaminate.search([text], decontaminate.Index([(1, item)]))[0] == [(1, 0, 2, 2 + len(item))]


def test_repetitive_text_in_bounded_memory():
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    hits = decontaminate.search(["=-" * 15_000], decontaminate.Index([(1, "=-" * 150), (2, "=-" * 700)]))
    assert hits == [[(1, 0, 0, 160), (2, 0, 0, 160)]]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000


def test_blocks_do_not_matter(spark, monkeypatch):
    r = random.Random(9)
    item = lambda: "".join(r.choices("abcde fgh", k=90))
    items = [(k // 2, item()) for k in range(12)] + [(50, None), (None, item()), (51, "")]
    docs = [(k, f"some text {items[k][1]} {items[11 - k][1]} end", 1, 2) for k in range(6)] + [(7, None, 1, 2), (7, " ", 1, 2), (None, items[0][1], 1, 2), (8, items[3][1], 1, 2), (8, items[3][1], 1, 2)]
    d = spark.createDataFrame(docs, "doc_id long, text string, leaked_items int, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda df: sorted(map(str, df.collect()))
    got = []
    for size in (1_200_000, 300):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", size)
        marked = decontaminate.mark_leaks(d, b, items_out="items", edits_out="edits")
        assert marked.columns == ["doc_id", "text", "leaked_items", "item_id", "items", "edits"]
        got.append((rows(decontaminate.find_leaks(d, b)), rows(marked)))
    assert got[0] == got[1] and len(got[0][0]) > 12
    assert decontaminate.find_leaks(d.limit(0), b).count() == 0 and decontaminate.find_leaks(d, b.limit(0)).count() == 0
