"""Every excerpt of PASSAGE + STRIDE - 1 characters of a long item is found."""

import random

from weft.llm import decontaminate


def test_excerpts_of_the_stated_length():
    r = random.Random(3)
    item = "".join(r.choices("abcdefghijklmnopqrst", k=394))
    least = decontaminate.PASSAGE + decontaminate.STRIDE - 1
    assert least <= 180
    index = decontaminate.Index([(1, item)])
    pad = ["".join(r.choices("uvwxyz", k=300)) for _ in range(2)]
    texts = [pad[0] + item[a : a + least] + pad[1] for a in range(len(item) - least + 1)]
    assert all(found and found[0][:2] == (1, 0) for found in decontaminate.search(texts, index))
