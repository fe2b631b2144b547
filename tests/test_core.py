"""Row functions and planner against hand-made cases; queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from weft import queries
from weft.functions import pages, scoring, text, urls
from weft.operators import chunking, frontier, ingest, retrieval, router
from weft.plans import planner
from weft.sources import files
from weft.streaming import progress

DATA = "/root/testdata/sf0.001"

GOLDEN = [
    ("How many products are there?", "count", "global", "product"), ("count of countries with a URL containing `/pages/`", "count", "global", "country"),
    ("Which products cost less than $100?", "filter", "global", "product"), ("What is the price of Product X?", "exact_lookup", "local", "product"),
    ("What does Product X do?", "semantic", "local", "product"), ("What is the cheapest product?", "sort", "global", "product"),
    ("Compare Product A and Product B.", "comparison", "local", "product"), ("Which products mention AI?", "list", "global", "product"),
    ("Can you name any countries present?", "list", "global", "country"),
]


@pytest.mark.parametrize("question,intent,scope,entity", GOLDEN)
def test_planner(question, intent, scope, entity):
    plan = planner.analyze(question)
    assert (plan.intent, plan.scope, plan.entity) == (intent, scope, entity)
    assert plan.structured_search == (scope == "global")


def test_planner_details():
    plan = planner.analyze("Which products cost less than $100?")
    assert plan.filters == {"price": {"operator": "lt", "value": 100.0}} and plan.exhaustive
    assert planner.analyze("What is the cheapest product?").sort_order == "asc"
    with pytest.raises(planner.PlanError):
        planner.validate(planner.QueryPlan("filter", "global", filters={"rating": 1}, rewritten_query="x"))
    asked = []

    def analyzer(q, r):
        asked.append(r)
        if len(asked) == 1:
            raise planner.PlanError("bad rewrite")
        return planner.analyze(q, r)

    assert planner.analyze_with_retry("How many pages?", "??", analyzer=analyzer).intent == "count" and asked == ["??", "How many pages?"]
    with pytest.raises(planner.PlanError, match="2 attempts"):
        planner.analyze_with_retry("x", attempts=2, analyzer=lambda q, r: planner.validate(planner.QueryPlan("count", "local", rewritten_query="x")))


def test_columns_agree_with_the_planner(spark):
    rows = spark.createDataFrame([(q,) for q, *_ in GOLDEN], "q string").select("q", planner.plan_struct(F.col("q")).alias("p")).collect()
    for r in rows:
        plan = planner.analyze(r["q"])
        assert (r["p"]["intent"], r["p"]["scope"], r["p"]["entity"]) == (plan.intent, plan.scope, plan.entity)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_text(spark):
    s = F.lit
    assert one(spark, text.price(s("now $1,299 only"))) == 129 and one(spark, text.price(s("now $1,299 only"), thousands=True)) == 1299
    assert one(spark, text.price(s("Price: 12.5"))) == 12.5 and one(spark, text.price(s("none"))) is None
    assert one(spark, text.glued_pairs(s("Top 12Rank 7Votes"))) == ["Top", "Rank: 12", "Votes: 7"]
    assert one(spark, text.glued_pairs(s("$12Rank"))) == ["$12Rank"]
    assert [one(spark, text.is_empty(s(x))) for x in ("", " \n", "..", "{{x}}", "[x]", "a")] == [True] * 5 + [False]
    assert one(spark, text.word_windows(s("a b c d e"), 3, 1)) == ["a b c", "c d e", "e"]
    assert one(spark, text.mentioned_url(s("see https://x.org/a).")) ) == "https://x.org/a"
    assert one(spark, text.fit_vector(F.array(s(1.0), s(2.0)), 3)) == [1.0, 2.0, 0.0]
    assert one(spark, text.holds_number(s("there are 12 of them"), s(12))) and not one(spark, text.holds_number(s("120"), s(12)))
    assert one(spark, text.is_unhelpful(s("I'm not sure."))) and one(spark, text.truncate(s("abcdefgh"), 6)) == "abc..."
    assert one(spark, text.heading_path(F.lit(None).cast("array<string>"), s("h"), s("t"), s("Part 1 of 2"))) == ["t", "h", "Part 1 of 2"]


def test_urls(spark):
    n = lambda u: one(spark, urls.normalize(F.lit(u)))
    assert [n(u) for u in ("https://a.org/", "https://a.org/x/", "https://a.org/x/?q=/", "https://a.org/x#y")] == ["https://a.org/", "https://a.org/x", "https://a.org/x?q=/", "https://a.org/x"]
    assert one(spark, urls.resolve(F.lit("https://a.org/x/y"), F.lit("../z"))) == "https://a.org/z"
    assert one(spark, urls.may_crawl(F.lit("https://a.org/b"), F.lit("https://a.org/"))) and not one(spark, urls.may_crawl(F.lit("https://a.org/b.PDF"), F.lit("https://a.org/")))
    assert one(spark, urls.is_scrapable(F.lit("https://a.org"))) and one(spark, urls.scrape_error(F.lit("http://a.org"))) is not None


PAGE = """<html lang="de"><head><title>Shop</title><meta name="description" content="d"><script type="application/ld+json">
{"@context":"https://schema.org","@graph":[{"@type":"Product","name":"Lamp","offers":{"price":9.5,"priceCurrency":"EUR"},},]}</script></head><body>
<nav><a href="/a">A</a></nav><main><h1>Overview</h1><p>An overview text that is long enough to be kept.<p>More of it<br>here
<h2>Stats</h2><div><span>1</span><span>Rank</span><span>15,239</span><span>Mentions</span></div>
<h2>Table</h2><table><thead><tr><th>Country</th><th>Capital</th></tr></thead><tr><td>A</td><td>a</td></tr><tr><td>B</td><td>b</td></tr></table>
<ul><li>first item here</li><li>second item here</li></ul></main></body></html>"""


def test_page_struct_and_chunks(spark):
    p = pages.page_struct(PAGE)
    assert p["title"] == "Shop" and p["meta"]["lang"] == "de" and p["links"] == ["/a"]
    assert p["entities"][0]["name"] == "Lamp" and p["entities"][0]["price"] == "9.5"
    assert p["sections"][0]["heading_path"] == ["Overview"] and p["sections"][0]["content"].startswith("[Overview]\n\nAn overview")
    assert p["tables"][0]["rows"] == [["Country", "Capital"], ["A", "a"], ["B", "b"]] and p["tables"][0]["heading"] == "Table"
    assert pages.merge_labels(["1", "Rank", "15,239", "0", "Mentions"]) == ["Rank: 1", "Mentions: 15,239"]
    assert pages.tolerant_json('```json\n{"a": [1, 2,], "b": "x') == {"a": [1, 2], "b": "x"} and pages.tolerant_json("no") is None
    assert pages.page_struct(None)["sections"] == []
    frame = spark.createDataFrame([(1, "https://x.org/", PAGE), (2, "u", None)], "page_id long, url string, html string")
    chunks = chunking.page_chunks(pages.parse_pages(frame)).collect()
    own = [c for c in chunks if c["page_id"] == 1]
    assert [c["chunk_index"] for c in sorted(own, key=lambda c: c["chunk_index"])] == list(range(len(own)))
    assert {c["entity_type"] for c in own if c["chunk_type"] == "table_row"} == {"country"}
    assert any(c["chunk_type"] == "mixed" and "Lamp" in c["content"] for c in own)
    assert [c["chunk_type"] for c in chunks if c["page_id"] == 2] == ["summary"]


def test_splitting():
    content = "\n\n".join(" ".join(f"w{i}" for i in range(n)) + "." for n in (300, 400, 2000, 10))
    parts = chunking.split_tokens(content)
    assert max(len(p.split()) for p in parts) <= chunking.MOST_TOKENS and parts[0].count("\n\n") == 1
    assert chunking.split_tokens("short") == ["short"]
    assert chunking.plain_chunks("# A\n" + "word " * 20 + "\n## B\n" + "term " * 20)[0]["heading_path"] == ["A", "B"]


def test_retrieval(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "id long, embedding array<float>")
    for arrow in (False, True):
        assert [(r["id"], r["similarity"]) for r in retrieval.vector_topk(v, [1.0, 0.0], 3, arrow=arrow).collect()] == [(1, 1.0), (2, 0.0)]
    assert one(spark, scoring.boost(F.lit(None).cast("string"), F.lit("faq"))) == 1.4 and one(spark, scoring.boost(F.lit("odd"), F.lit("odd"))) == 0.5
    d = spark.createDataFrame([(1, "a cat and a cat"), (2, "dog"), (3, "cat")], "id long, content string")
    assert [r["id"] for r in retrieval.keyword_topk(d, ["cat"]).collect()] == [1, 3]
    assert {r["id"] for r in retrieval.bm25(d, ["cat", "dog"], "id", "content").collect()} == {1, 2, 3}


def test_ingest_and_frontier(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "c")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert {r["url"]: r["depth"] for r in frontier.bfs(edges, seeds, 3, checkpoint=False).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    status = lambda s, r, stale: one(spark, ingest.next_status(F.lit(s), F.lit(r).cast("boolean"), F.lit(stale)))
    assert [status("FAILED", None, False), status("PROCESSING", None, True), status("PENDING", None, False), status("PROCESSING", True, False), status("COMPLETED", None, False)] == ["PENDING", "PENDING", "PROCESSING", "COMPLETED", "COMPLETED"]


def test_progress_automaton():
    state, seen = (None, None), []
    for stage, percent in [("crawling", 50), ("crawling", 10), ("chunking", 0), ("processing", 100), ("failed", 0), ("embedding", 100)]:
        state, accepted, delivered = progress.step(state, stage, percent)
        seen.append((accepted, delivered))
    assert state[0] == ("failed", 60)
    assert seen == [(True, True), (True, False), (True, True), (False, False), (True, True), (False, False)]
    # what is stored: any ingestion stage opens an ended chat, a failure does not overwrite one, nothing opens a failed one
    assert progress.next_state(("answered", 100), "chunking", 60) == (("chunking", 60), True)
    assert progress.next_state(("completed", 100), "failed", 0) == (("completed", 100), False)
    assert progress.next_state(("failed", 60), "crawling", 5) == (("failed", 60), False)
    # what is shown: after the end only an end
    assert not progress.deliver(("completed", 100), "crawling", 5)[1] and not progress.deliver(("completed", 100), "failed", 0)[1]
    assert progress.deliver(("completed", 100), "answered", 100)[1] and progress.deliver(("embedding", 90), "failed", 10)[1]


def test_sources(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("<meta charset=iso-8859-1>é\0".encode("latin-1"))
    (tmp_path / "b.html").write_bytes("é".encode())
    (tmp_path / "c.html").write_bytes("<meta charset=windows-1251>мир".encode("windows-1251"))
    (tmp_path / "d.html").write_bytes("<meta charset=shift_jis>日本".encode("shift_jis"))
    (tmp_path / "e.html").write_bytes("<meta charset=windows-1252>“q”".encode("windows-1252"))
    (tmp_path / "f.html").write_bytes("<meta charset=nonsense>\xe9".encode("latin-1"))
    got = sorted(r["html"] for r in files.saved_pages(spark, f"file://{tmp_path}").collect())
    assert got == sorted(["<meta charset=iso-8859-1>é", "é", "<meta charset=windows-1251>мир", "<meta charset=shift_jis>日本", "<meta charset=windows-1252>“q”", "<meta charset=nonsense>é"])
    assert one(spark, files.chunk_file(F.lit("https://x.org/a b"), F.lit("7"))) == "x.org/chunk_https_x.org_a_b_7.txt"


def test_queries_against_sql(spark):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    for name in ("vector_topk", "rrf_fusion", "keyword_topk", "intent_classify", "word_windows", "upsert_latest", "bfs_frontier", "url_normalize"):
        got = __spark_entry__.queries()[name](spark, DATA)
        want = con.sql(queries.SQL[name])
        order = sorted(got.columns)
        assert order == sorted(want.columns), name
        left = sorted(map(str, (tuple(r[c] for c in order) for r in got.collect())))
        right = sorted(map(str, con.sql(f"SELECT {', '.join(order)} FROM ({queries.SQL[name]})").fetchall()))
        assert left == right, name


def test_streams(spark):
    """The stream's rows against the same rules applied to each chat's events in order."""
    rows = {r["event_id"]: r for r in queries.stream_progress(spark, DATA).collect()}
    events = sorted(queries.stage_events(spark, DATA).collect(), key=lambda r: r["event_id"])
    assert len(rows) == len(events)
    states: dict = {}
    for e in events:
        state, accepted, delivered = progress.step(states.get(e["user_id"], (None, None)), e["stage"], e["percent"])
        states[e["user_id"]] = state
        r = rows[e["event_id"]]
        assert (r["stage"], r["progress"], r["accepted"], r["delivered"]) == (*state[0], accepted, delivered)


def test_url_rules(spark):
    kinds = {"https://x.org/docs/a": "documentation", "https://x.org/database/": None, "https://x.org/composter": None, "https://x.org/pricing/": "data_table", "https://x.org/shop/1": "ecommerce", "https://x.org/news/": "article"}
    assert {u: one(spark, urls.content_type(F.lit(u))) for u in kinds} == kinds
    logins = {"https://x.org/Sign-In/": True, "https://x.org/my-account": True, "https://x.org/?returnUrl=/": True, "https://www.github.com/?returnurl=/": False, "https://x.org/about": False}
    assert {u: one(spark, urls.looks_like_login(F.lit(u))) for u in logins} == logins


def test_ordinals_are_leftmost(spark):
    asked = {"what is the 5th item number 12": 5, "the third place 7": 3, "item number 9": 9, "item 0 of 2nd page": None, "the twelfth": 12, "the last one": -1}
    assert {q: one(spark, planner.ordinal(F.lit(q))) for q in asked} == asked


PARTS = """<html><body><article><div class="grid"><div class="x"><h3>One</h3><p>A first description</p><span class="price">$5</span><a href="/1">more</a></div><div class="x"><h3>Two</h3><p>Another text here</p></div>
<div class="x"><h3>Three</h3><p>Third text of a card</p></div><div class="x"><h3>Four</h3><p>Fourth text of a card</p></div></div><h2 class="step">Mix it</h2><p>Take a bowl.</p><ul><li>egg</li><li>milk</li></ul><h2 class="step">Bake it</h2><table><tr><td>a</td><td>b</td></tr></table></article>
<script type="application/ld+json">[{"@type": "FAQPage", "mainEntity": {"name": "Why?", "acceptedAnswer": {"text": "So."}}}, {"@type": ["Recipe"], "name": "Cake", "recipeIngredient": ["egg"], "recipeInstructions": ["Mix", {"text": "Bake"}], "offers": {"price": 3, "priceCurrency": "EUR"}}]</script></body></html>"""


def test_page_parts(spark):
    p = pages.page_struct(PARTS, "https://x.org/blog/1")
    by = {s["heading"]: s["content"] for s in p["sections"]}
    assert by["One"] == "[Untitled Page > One]\n\nName: One\nPrice: $5\nDescription: A first description\nURL: https://x.org/1"
    assert by["Mix it"].endswith("Take a bowl.\n\n• egg\n• milk") and by["Bake it"].endswith("Headers: a, b\na, b")
    assert p["json_ld"] == "Type: FAQPage\nQ: Why?\nA: So.\n\nType: Recipe\nName: Cake\nIngredients:\n  - egg\nInstructions:\n  1. Mix\n  2. Bake\nPrice: 3 EUR"
    frame = spark.createDataFrame([(1, "https://x.org/blog/1", PARTS), (2, "u", '<body><div id="root"></div></body>')], "page_id long, url string, html string")
    parsed = pages.parse_pages(frame)
    got = {r[0]: (r[1], r[2]) for r in parsed.select("page_id", pages.page_class(F.col("page")), pages.needs_rendering(F.col("page"))).collect()}
    # article: the tag and the url, 4 points; as many for the price and the grid, but it is named first
    assert got == {1: ("article", False), 2: ("article", True)}


def test_page_chunks_parse_once(spark):
    frame = spark.createDataFrame([(1, "u", PARTS)], "page_id long, url string, html string")
    plan = chunking.page_chunks(pages.parse_pages(frame))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_plain_chunks():
    long = " ".join(f"w{i}" for i in range(920))
    text_ = "Privacy Policy\n# A\n" + long + "\n# B\nshort\n# C\n" + "same words again and again until there are enough of them\n# D\nsame words  again and again until there are enough of them\n"
    got = chunking.plain_chunks(text_)
    assert [(c["chunk_index"], c["heading_path"], c["token_count"]) for c in got] == [(0, ["B"], 500), (1, ["B"], 470), (2, ["B"], 20), (4, ["D"], 11)]


def test_router(spark):
    schema = "id long, content string, embedding array<float>, category string, entity string, ordinal int, chunk_type string, information_density double, section_title string, heading_path array<string>, source_url string"
    row = lambda i, c, v, e="content", cat="main_content": (i, c, v, cat, e, i, "list_item", 1.0, None, [], "https://x.org/a/")
    chunks = spark.createDataFrame([row(1, "red apple", [1.0, 0.0]), row(2, "green pear", [0.9, 0.1]), row(3, "nothing", [0.0, 1.0], cat="excluded"), row(4, "plum Price: $5", [0.0, 1.0], "product"), row(5, "fig Price: $7", None, "product")], schema)
    empty = spark.createDataFrame([], "page_id long")
    rows, about = router.hybrid(router.scoped(chunks), [1.0, 0.0], "zebra")
    assert about.first()["strategy"] == "vector" and [r["id"] for r in rows.orderBy("rank").collect()][:2] == [1, 2]
    assert router.hybrid(router.scoped(chunks), [0.0, 0.0], "apple")[1].first().asDict() == {"strategy": "keyword", "lexical": True, "top": 1.0, "gap": 1.0, "confidence": 0.8, "accepted": True}
    assert router.hybrid(chunks.limit(0), [1.0, 0.0], "apple")[1].first()["accepted"] is False
    anchored = rows.withColumn("is_anchor", F.lit(False))
    assert router.may_answer(about, anchored).first()["answer"] is True and router.may_answer(about, anchored.limit(0)).first()["answer"] is False
    ask = lambda q, **k: [(r["content"], r["result"]) for r in router.answer(q, None, chunks, empty, **k).collect()]
    assert ask("How many products are there?") == [("Verified result: there are 2 products.", 2.0)]
    assert ask("How many faqs are there?", source_url="https://x.org/a") == [("Verified result: there are 0 faqs.", 0.0)]
    assert ask("average price of products") == [("Verified average product price: 6.00 across 2 products.", 6.0)]
    assert ask("most expensive product")[0][1] == 7.0 and ask("products under $6") == [("Name and price evidence:\nplum Price: $5", 5.0)]
    assert "closest thing" in one(spark, router.clarification(F.lit("a\nb"), F.lit(None).cast("string"), F.lit("u"), F.lit("e")))
