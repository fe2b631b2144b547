"""Operators against brute force, round trips and held-out labels, on small tables with nulls, ties and repeats."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from weft.llm import components, decontaminate, exact_dedup, language_id, mixing, simhash, token_counts, token_output, tokens, toxicity, url_filter, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, host string"
rng = random.Random(5)
WORDS = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]


def sentence(n, r=rng):
    return " ".join(r.choices(WORDS, k=n))


def rows():
    r = random.Random(11)
    base = [sentence(60, r) for _ in range(30)]
    out = [(i, t, "en", f"s{i % 3}", 0, "x") for i, t in enumerate(base)]
    out += [(100 + i, base[i].upper(), "en", None, 0, None) for i in range(5)]
    out += [(200 + i, base[i].replace(base[i].split()[9], "zzz"), "de", "s1", 0, None) for i in range(8)]
    out += [(300, None, None, None, None, None), (301, "", "en", "s0", 0, None), (302, " \n\t ", "en", "s0", 0, None), (None, base[3], "en", "s1", 0, None)]
    out += [(7, base[7], "en", "s1", 0, "x")]  # a repeated row
    out += [(400, ("long é 東京 🙂  text\n" * 3000), "en", "s2", 0, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


LIBRARY = Tokenizer.from_file(tokens.default_vocab())


def whole(text):
    """Ids by an untouched call of the library."""
    return LIBRARY.encode(text, add_special_tokens=False).ids


def test_encoder_equals_whole_text():
    enc = tokens.PieceEncoder(tokens.default_vocab())
    odd = ["", " ", "a\n  b", " a  b\n\n c\t d ", "x\x1cy !\x1c a", "🙂 é　ö  \n", "<|endoftext|> a", "a\x85 b\xa0 c\xa0", "it's we'll", "\0a \1b", "a \n b\nc\n", "x<|endoftext|>", "été,12ß3-(naïve) d'ici O'x's 'tis Œuvre… «a» ½", "\nab", "\n\nab", " "]
    texts = odd + [t or "" for _, t, *_ in rows()]
    r = random.Random(3)
    texts += ["".join(r.choices(" \n\tab.,'é1\xa0\x1c", k=40)) for _ in range(300)]
    texts += [" ".join("".join(r.choices("abcdéßœ12.,-'(", k=r.randint(1, 9))) for _ in range(60)) for _ in range(100)]
    for _ in range(2):  # the second time from the cache
        assert [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode(texts)] == [whole(t) for t in texts]


def test_encoder_forgets_and_cuts(monkeypatch):
    monkeypatch.setattr(tokens, "_CACHE_PIECES", 100)
    monkeypatch.setattr(tokens, "_GROUP_CHARS", 3000)
    enc = tokens.PieceEncoder(tokens.default_vocab())
    texts = [sentence(90) + " " + sentence(2).upper() for _ in range(60)] + ["long  text\n" * 2000, "", "one"]
    for _ in range(2):
        assert [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode(texts)] == [whole(t) for t in texts]
    assert len(enc.slot) < 1000


def test_shard_order(spark):
    names = ["part-00009-ab-c000.txt", "part-20000-ab-c000.txt", "part-20000-ab-c999.txt", "part-20000-ab-c1000.txt", "part-99999-ab-c000.txt", "part-100000-ab-c000.txt"]
    frame = spark.createDataFrame([(f"file:/x/{n}",) for n in reversed(names)], "shard string")
    assert [r[0][8:] for r in frame.orderBy(*token_output.shard_order(frame["shard"])).collect()] == names


def test_token_output_round_trip(spark, docs, empty, tmp_path):
    out = token_output.token_output(docs, f"file://{tmp_path}/t").collect()
    assert len(out) == len(rows())
    expect = {}
    for i, t, *_ in rows():
        expect.setdefault(i, []).append([*whole(t or ""), 0])
    start = 0
    order = sorted(out, key=lambda r: r["start"])
    assert [r["doc_id"] for r in order] == sorted((i for i, *_ in rows()), key=lambda i: (i is not None, i))
    for r in order:
        ids = expect[r["doc_id"]]
        assert r["start"] == start and r["n_tokens"] in map(len, ids)
        assert r["ids_crc32"] in [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
        start += r["n_tokens"]
    index = token_output.read_index(spark, f"file://{tmp_path}/t")
    picked = {r["doc_id"]: list(r["ids"]) for r in token_output.read_records(spark, f"file://{tmp_path}/t", index.where("doc_id in (3, 400)")).collect()}
    assert picked == {3: expect[3][0], 400: expect[400][0]}
    assert token_output.token_output(empty, f"file://{tmp_path}/e").count() == 0
    data = token_output.frame(1, b"ab", False) + b"\n"
    with pytest.raises(ValueError):
        list(token_output.frames(data[:-3] + b"x" + data[-2:]))


def test_token_counts_against_the_library(spark):
    """Every section against the spans of the library's own tokens."""
    r = random.Random(8)
    texts = ["".join(r.choices(["\n", "\n", "  ", "é", "東", "a b", "word", "\t", "12"], k=60)) for _ in range(20)]
    got = {}
    for row in token_counts.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got.setdefault(row["doc_id"], []).append(row)
    for i, text in enumerate(texts):
        byte = lambda k: len(text[:k].encode())
        spans = [(byte(x["start_char"]), byte(x["end_char"]), x["section"]) for x in got[i]]
        held, begin = {x["section"]: 0 for x in got[i]}, 0
        for token in whole(text):
            end = begin + len(LIBRARY.id_to_token(token))
            held[max(spans, key=lambda s: (min(s[1], end) - max(s[0], begin), -s[2]))[2]] += 1
            begin = end
        assert begin == len(text.encode()) and held == {x["section"]: x["n_tokens"] for x in got[i]}


def test_token_counts(docs, empty):
    got = {}
    for r in token_counts.token_counts(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, t, *_ in rows():
        if i == 7:
            continue
        t = t or ""
        n = sum(r["n_tokens"] for r in got[i])
        assert n == len(whole(t))
        assert max(r["end_char"] for r in got[i]) == len(t)
    # by hand: tokens of 3, 4 and 2 bytes; sections start at bytes 0, 5 and 7
    size, bounds = np.array([3, 4, 2]), np.array([0, 5, 7])
    assert token_counts.attribute(size, bounds)[0].tolist() == [2, 0, 1]
    assert token_counts.attribute(size, bounds, "last")[0].tolist() == [1, 1, 1]
    assert token_counts.attribute(size, bounds)[1].tolist() == [1, 0, 0]
    by_field = token_counts.token_counts(docs.where("doc_id = 3"), fields=["source", "text"]).collect()
    assert sum(r["n_tokens"] for r in by_field) == len(whole("s0" + rows()[3][1]))
    assert token_counts.token_counts(empty).count() == 0


def brute_components(fps, most):
    ids = list(range(len(fps)))

    def find(x):
        while ids[x] != x:
            x = ids[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= most:
                x, y = find(a), find(b)
                ids[max(x, y)] = min(x, y)
    return [find(x) for x in ids]


def plain_fingerprint(text, n):
    import xxhash

    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty):
    got = simhash.simhash_components(docs).collect()
    data = rows()
    fps = [plain_fingerprint(t, 4) for _, t, *_ in data]
    roots = brute_components(fps, 4)
    least = {}
    for (i, *_), r in zip(data, roots):
        least[r] = min(x for x in (least.get(r), i) if x is not None) if (least.get(r), i) != (None, None) else None
    expect = sorted((str(i), f"{f:016x}", least[r]) for (i, *_), f, r in zip(data, fps, roots))
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == expect
    assert simhash.simhash_components(empty).count() == 0


@pytest.mark.parametrize("most,blocks,tile", [(4, 7, 4096), (6, 9, 4096), (4, 7, 5)])
def test_links_connect_what_brute_force_does(spark, most, blocks, tile):
    r = random.Random(most)
    centers = [r.getrandbits(64) for _ in range(20)]
    fps = set(centers)
    for _ in range(600):
        x = r.choice(centers[:3] if r.random() < 0.7 else centers)
        for _ in range(r.randint(0, 5)):
            x ^= 1 << r.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), most, blocks, tile).collect()
    assert all(((a["u"] ^ a["v"]) & (1 << 64) - 1).bit_count() <= most for a in links)
    got = {row["node"]: row["root"] for row in components.connected_components(spark.createDataFrame(links or [], "u long, v long")).collect()}
    groups = {}
    for x, root in zip(signed, brute_components(fps, most)):
        groups.setdefault(root, []).append(x)
    for members in groups.values():
        assert len({got.get(x, x) for x in members}) == 1
    assert len({got.get(x, x) for x in signed}) == len(groups)


def test_keep_one(docs):
    kept = simhash.keep_one(docs, words=4, max_distance=4, blocks=7)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(7) == 1 and 100 not in ids and None in ids and 400 in ids


def test_exact_dedup(docs, empty):
    data = rows()
    low = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "") for _, t, *_ in data]
    groups = {}
    for (i, *_), t in zip(data, low):
        groups.setdefault(t, []).append(i)
    expect = []
    for (i, *_), t in zip(data, low):
        keep = max((x for x in groups[t] if x is not None), default=None)
        expect.append((str(i), keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    got = [(str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_dedup(docs).collect()]
    assert sorted(got) == sorted(expect)
    assert exact_dedup.exact_dedup(empty).count() == 0
    data = random.Random(1).randbytes(300_000)
    ends = exact_dedup.cuts(data)
    assert ends[-1] == len(data) and max(np.diff([0, *ends])) <= exact_dedup.MOST
    # an insertion changes few chunks
    moved = data[:1000] + b"xyz" + data[1000:]
    chunks = lambda d: {d[a:b] for a, b in zip([0, *exact_dedup.cuts(d)], exact_dedup.cuts(d))}
    assert len(chunks(data) - chunks(moved)) < 6


def test_url_filter(spark):
    urls = [None, "no scheme", "http://a.NET", "http://a.net/", "https://example.net/en/x?q", "http://x.example.net/en", "HTTP://Example.com/de/#f", "http://a.b.org/fr/y", "http://org/fr/", "http://norg/fr/", "ftp://u.net?x=/", "http://b..net/z"]
    urls += [f"http://h{i}.example.{('net', 'com', 'org')[i % 3]}/{('en', 'de', 'fr')[i % 2]}/{i}" for i in range(200)]
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    table = url_filter.parse_rules(spark, rules)
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, table).collect()}
    joined = {r["page_id"]: r for r in url_filter.judge_urls(pages, table, block_rules=1).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = rest.split("#")[0].split("?")[0].split("/")[0].lower()
        path = rest.split("#")[0].split("?")[0][len(host) :]
        fits = [(r, a) for a, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        rule, verdict = max(fits, key=lambda x: len(x[0])) if fits else (None, "allow")
        for side in (got, joined):
            assert tuple(side[i])[1:] == (host, path, rule, verdict), u
    assert url_filter.judge_urls(pages, table.limit(0)).where("verdict = 'allow'").count() == len(urls)
    assert url_filter.judge_urls(pages.limit(0), table).count() == 0


def test_cascade_is_exact_for_many_keys(spark):
    universe = spark.range(6000).selectExpr("concat('k', id) as key")
    listed = spark.range(0, 6000, 3).selectExpr("concat('k', id) as key")
    cascade = url_filter.Cascade(universe, listed)
    assert len(cascade.levels) > 2
    rows_in = universe.where(cascade.contains(universe["key"], [level.words() for level in cascade.levels]))
    assert rows_in.count() == listed.count() == rows_in.join(listed, "key").count()


def test_banded_distance_against_full_alignment():
    r = random.Random(2)

    def full(p, t):
        row = [0] * (len(t) + 1)
        for a in p:
            new = [row[0] + 1]
            for j, b in enumerate(t, 1):
                new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    for _ in range(60):
        p = [r.randrange(4) for _ in range(r.randint(5, 30))]
        t = [r.randrange(4) for _ in range(10)] + [x for x in p if r.random() > 0.1] + [r.randrange(4) for _ in range(10)]
        most = 8
        got = decontaminate.banded_distance(np.array(p, np.uint32), np.array(t, np.uint32), -len(p), len(t) + len(p), most)
        assert (got[0] if got else most + 1) == min(full(p, t), most + 1)


def test_leaks_found_within_the_budget(spark):
    r = random.Random(9)
    items = [(k, sentence(30, r)) for k in range(12)] + [(50, None), (51, ""), (52, "tiny")]
    docs, expect = [], set()
    for i in range(60):
        text = sentence(80, r)
        if i % 3 == 0:
            k = i % 12
            item = list(items[k][1])
            for _ in range(i % 5):  # up to 4 edits
                at = r.randrange(len(item))
                item[at : at + 1] = r.choice([[], ["q"], [item[at], "q"]])
            text = text[:100] + " " + "".join(item).upper().replace(" ", "\n ") + " " + text[100:]
            expect.add((i, k))
        docs.append((i, text))
    docs += [(900, None), (901, ""), (902, "a tiny word")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_leaks(frame, bench).collect()
    assert {(f["doc_id"], f["item_id"]) for f in found} == expect | {(902, 52)}
    marked = decontaminate.mark_leaks(frame, bench)
    assert {x["doc_id"] for x in marked.where("size(leaked_items) > 0").collect()} == {i for i, _ in expect} | {902}
    assert decontaminate.find_leaks(frame, bench.limit(0)).count() == 0 and marked.count() == len(docs)


def test_forward_backward_against_plain_recursion():
    r = np.random.default_rng(0)
    sizes = np.array([1, 31, 32, 33, 200])
    e, t = r.normal(size=(sizes.sum(), 3)), r.normal(size=(3, 3))
    got = language_id.posteriors(e, sizes, t)
    at = 0
    for n in sizes:
        x, a = np.exp(e[at : at + n]), np.exp(t)
        alpha, rows_a = np.full(3, 1 / 3), []
        for k in range(n):
            alpha = (alpha @ a) * x[k]
            alpha /= alpha.sum()
            rows_a.append(alpha)
        beta = np.ones(3)
        for k in reversed(range(n)):
            p = rows_a[k] * beta
            assert np.allclose(got[at + k], p / p.sum())
            beta = a @ (x[k] * beta)
            beta /= beta.sum()
        at += n


def tongue(seed):
    r = random.Random(seed)
    parts = ["".join(r.choices("abcdefghijklmnop", k=2)) for _ in range(12)]
    return lambda n: " ".join("".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(n))


def test_language_id_held_out_and_code_switching(spark):
    speak = {"aa": tongue(1), "bb": tongue(2), "cc": tongue(3)}
    model = language_id.train([(k, f(60)) for k, f in speak.items() for _ in range(30)], rounds=30)
    texts = [(k, f(40)) for k, f in speak.items() for _ in range(20)]
    got = language_id.classify(model, [t for _, t in texts])
    assert np.mean([g[0] == k for g, (k, _) in zip(got, texts)]) > 0.95
    assert language_id.classify(model, [None, "", "123 !!"]) == [("und", 0.0)] * 3
    mixed = speak["aa"](20) + " " + speak["bb"](20)
    labels = [lang for _, lang, _ in language_id.label_words(model, mixed)]
    assert labels[:20].count("aa") > 16 and labels[20:].count("bb") > 16
    frame = spark.createDataFrame([(1, mixed, "old"), (2, None, "old")], "doc_id long, text string, lang_pred string")
    out = language_id.identify(frame, model)
    assert out.columns == ["doc_id", "text", "lang_pred", "lang_score"] and out.where("lang_pred = 'und'").count() == 1


def test_toxicity_held_out(spark):
    speak, r = tongue(4), random.Random(6)
    data, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        words = speak(40).split()
        if bad:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(["vile", "scum"]) + r.choice(["", "ness", "ish"]))
        data.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    data += [(900, None), (901, "...")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(None, 1), (5000, 1), (901, None)], "doc_id long, toxic int")
    from pyspark.sql import functions as F

    got = {x["doc_id"]: x for x in toxicity.toxicity(docs, marks, F.col("doc_id") % 4 != 2).collect()}
    held = [i for i, _ in labels if i % 4 == 2]
    assert np.mean([got[i]["predicted"] == labels[i][1] for i in held]) > 0.95
    assert len(got) == len(data) and all(0 <= x["score"] <= 1 for x in got.values())


def test_mixing_targets(spark, empty):
    r = random.Random(8)
    data = [(i, " ".join(["w"] * (1 + int(r.expovariate(0.02)))), r.choice(["a", "b", "c", "c", "c", None])) for i in range(3000)]
    data += [(9000, None, "a"), (9001, "", "z"), (1, "w w", "a"), (1, "w w", "a")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    out = mixing.mix_sources(docs).collect()
    assert len(out) == len(data)
    names = ["a", "b", "c", "z", None]
    size = {n: sum(len((t or "").split()) for _, t, s in data if s == n) for n in names}
    weight = dict(zip(names, [5, 2, 1, 5, 2]))
    total, capped = sum(size.values()), set()
    while True:  # as the contract has it: again and again
        left = total - sum(3 * size[n] for n in capped)
        w = sum(weight[n] for n in names if n not in capped)
        over = {n for n in names if n not in capped and left * weight[n] / w > 3 * size[n]}
        if not over:
            break
        capped |= over
    for n in names:
        rows_n = [x for x in out if x["source"] == n]
        target = 3 * size[n] if n in capped else left * weight[n] / w
        assert abs(rows_n[0]["target"] - target) < 1e-6 * max(1, target)
        assert abs(sum(x["taken"] for x in rows_n) - target) <= 0.01 * target + 1
        assert all(x["taken"] <= 3 * x["size"] for x in rows_n)
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    clash = docs.withColumn("__id", docs["source"]).withColumn("__WORDS", docs["doc_id"]).withColumn("__copies", docs["doc_id"])
    repeated = mixing.repeat_taken(clash)
    assert repeated.columns == clash.columns
    assert mixing.repeat_taken(empty).count() == 0
    assert repeated.count() == sum(x["copies"] for x in out)
    assert mixing.mix_sources(empty).count() == 0


@pytest.mark.parametrize("n", [40, 700])
def test_mixing_is_near_at_every_size(spark, n, monkeypatch):
    """Long documents in small sources; the same rule in one bucket and in many."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 100)
    r = random.Random(n)
    data = [(i, "w " * int(r.paretovariate(1.1) * 20), f"s{i % 3}") for i in range(n)] + [(None, "w w", "s1")] * 2
    out = mixing.mix_sources(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    for s in ("s0", "s1", "s2"):
        mine = [x for x in out if x["source"] == s]
        assert abs(sum(x["taken"] for x in mine) - mine[0]["target"]) <= 0.02 * mine[0]["target"]
        assert all(x["copies"] in (0, 1, 2, 3) and x["taken"] == x["copies"] * x["size"] for x in mine)


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://www.a.org/x?b=1#f", "<p>é\r\n\r\nWARC/1.1\r\n"), (2, "http://b.org/", "same"), (3, None, "same"), (4, "http://c.d/\r\nevil: 1", None), (5, "HTTP://A.org:80/x?b=1", "same"), (5, "http://e/", "same"), (None, "http://f/", "same"), (6, "u", "")]
    frame = spark.createDataFrame([(i, u, h, "clash") for i, u, h in pages], "page_id long, url string, html string, d string")
    out = warc.archive(frame, f"file://{tmp_path}/w").collect()
    import base64

    expect = []
    for i, _, h in pages:
        data = (h or "").encode()
        first = max((j for j, _, g in pages if (g or "") == (h or "") and j is not None), default=None)
        revisit = i is not None and i != first
        expect.append((str(i), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out) == sorted(expect)
    order = [(r["urlkey"], r["captured"]) for r in sorted(out, key=lambda r: (r["range"], r["place"]))]
    assert order == sorted(order)
    assert warc.archive(frame.limit(0), f"file://{tmp_path}/e").count() == 0


def test_loser_tree():
    r = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(r.randrange(50) for _ in range(r.randint(0, 20))) for _ in range(k)]
        assert list(warc.LoserTree([iter(x) for x in runs], lambda x: x)) == sorted(x for run in runs for x in run)


def test_pipeline_stages(spark):
    import corpus_pipeline

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, data)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        if name != "mix":
            assert 0.5 * n < docs.count() <= n
            n = docs.count()
    assert corpus_pipeline.STAGES[4][1](spark, docs, data).count() == docs.count()
