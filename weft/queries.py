"""Queries over the driver's tables and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import pages as page_functions
from weft.functions import scoring, text, urls
from weft.functions import media
from weft.operators import chats, chunking, collections, frontier, ingest, retrieval, router, store
from weft.plans import planner
from weft.session import shared_dir

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def question_vector(spark: SparkSession, d: str) -> list[float]:
    """The stored vector 0 stands for an embedded question."""
    return list(t(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0])


CATEGORIES = ["main_content", "header_nav", "footer", "sidebar", "excluded", "ui_summary"]
ENTITIES = ["product", "article_body", "faq", "table", "content"]


def chunks_of_vectors(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda names, c: F.element_at(F.array(*map(F.lit, names)), (c % len(names) + 1).cast("int"))
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", pick(CATEGORIES, F.col("vec_id")).alias("category"), pick(ENTITIES, F.col("label")).alias("entity"), "label")


SQL_CHUNKS = f"SELECT vec_id AS id, embedding, list_extract({CATEGORIES}, (vec_id % 6 + 1)::INT) AS category, list_extract({ENTITIES}, (label % 5 + 1)::INT) AS entity, label FROM embeddings"
SQL_VECTOR = "round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6)"
SQL_CAT = "CASE category WHEN 'main_content' THEN 1.0 WHEN 'header_nav' THEN 0.8 WHEN 'footer' THEN 0.7 WHEN 'sidebar' THEN 0.5 WHEN 'excluded' THEN 0.0 WHEN 'ui_summary' THEN 0.6 ELSE 0.5 END::DOUBLE"
SQL_ENT = "CASE entity WHEN 'product' THEN 1.3 WHEN 'article_body' THEN 1.2 WHEN 'faq' THEN 1.4 WHEN 'table' THEN 1.1 WHEN 'content' THEN 1.0 ELSE 1.0 END::DOUBLE"


@query(f"SELECT vec_id, {SQL_VECTOR} AS similarity FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 30")
def vector_topk(spark, d):
    rows = t(spark, d, "embeddings")
    return retrieval.vector_topk(rows, question_vector(spark, d), tie="vec_id").select("vec_id", "similarity")


@query(f"SELECT id, category, {SQL_VECTOR} AS similarity FROM ({SQL_CHUNKS}) WHERE category NOT IN ('excluded','filter','modal','cookie') AND coalesce(nullif(label, 3) / 200.0, 1.0) >= 0.01 AND entity = 'product' ORDER BY similarity DESC, id LIMIT 30")
def vector_topk_filtered(spark, d):
    density = F.nullif(F.col("label"), F.lit(3)) / F.lit(200.0)
    rows = chunks_of_vectors(spark, d).where(scoring.retrievable(F.col("category"), density) & (F.col("entity") == "product"))
    return retrieval.vector_topk(rows, question_vector(spark, d)).select("id", "category", "similarity")


@query(f"WITH v AS (SELECT *, {SQL_VECTOR} AS similarity FROM ({SQL_CHUNKS}) ORDER BY similarity DESC, id LIMIT 30) SELECT id, similarity, round(similarity * ({SQL_CAT} * {SQL_ENT}), 6) AS adjusted FROM v ORDER BY adjusted DESC, similarity DESC, id LIMIT 10")
def boosted_rerank(spark, d):
    top = retrieval.vector_topk(chunks_of_vectors(spark, d), question_vector(spark, d))
    return retrieval.rerank(top, "similarity", F.col("category"), F.col("entity"), 10, [F.desc("similarity"), "id"]).select("id", "similarity", "adjusted")


TERMS = retrieval.query_terms("What are the thing ering?")
SQL_TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
SQL_KEYWORD = f"SELECT doc_id AS id, len(list_filter({SQL_TOKENS}, lambda x: list_contains({TERMS}, x)))::DOUBLE AS similarity FROM documents WHERE list_has_all({SQL_TOKENS}, {TERMS}) ORDER BY similarity DESC, id LIMIT 30"


def keyword(spark, d):
    return retrieval.keyword_topk(t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), TERMS, content="text")


@query(SQL_KEYWORD)
def keyword_topk(spark, d):
    return keyword(spark, d).select("id", "similarity")


SQL_FUSED = f"""v AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS vector_rank FROM (SELECT vec_id AS id, {SQL_VECTOR} AS s FROM embeddings ORDER BY s DESC, id LIMIT 30)),
k AS (SELECT id, row_number() OVER (ORDER BY similarity DESC, id) AS keyword_rank FROM ({SQL_KEYWORD})),
f AS (SELECT coalesce(v.id, k.id) AS id, vector_rank, keyword_rank, coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + keyword_rank), 0) AS rrf FROM v FULL OUTER JOIN k ON v.id = k.id)"""


def fused(spark, d):
    vector = retrieval.vector_topk(t(spark, d, "embeddings").withColumnRenamed("vec_id", "id"), question_vector(spark, d))
    return retrieval.fuse(vector, keyword(spark, d))


@query(f"WITH {SQL_FUSED} SELECT id, vector_rank, keyword_rank, round(rrf, 8) AS rrf FROM f")
def rrf_fusion(spark, d):
    return fused(spark, d).select("id", "vector_rank", "keyword_rank", F.round("rrf", 8).alias("rrf"))


@query(f"""WITH {SQL_FUSED}, a AS (SELECT *, round(rrf, 6) AS adjusted FROM f), r AS (SELECT *, row_number() OVER (ORDER BY adjusted DESC, vector_rank NULLS LAST, keyword_rank NULLS LAST) AS r FROM a),
g AS (SELECT max(adjusted) FILTER (WHERE r = 1) AS top, max(adjusted) FILTER (WHERE r = 2) AS second, coalesce(bool_or(keyword_rank IS NOT NULL), false) AS lexical FROM r)
SELECT top, round(top - coalesce(second, 0), 6) AS gap, lexical, coalesce(top >= 0.02, false) AS accepted,
CASE WHEN top >= 0.02 THEN CASE WHEN lexical THEN 0.4 ELSE 0.0 END + CASE WHEN top > 0.05 THEN 0.3 ELSE 0.0 END + CASE WHEN round(top - coalesce(second, 0), 6) > 0.05 THEN 0.2 ELSE 0.0 END ELSE 0.0 END::DOUBLE AS confidence FROM g""")
def confidence_gate(spark, d):
    return retrieval.gate(fused(spark, d).withColumn("adjusted", F.round("rrf", 6)))


@query("SELECT doc_id, lang, source FROM documents WHERE contains(lower(text), 'licensed')")
def entity_filter_ilike(spark, d):
    return t(spark, d, "documents").where(F.col("text").ilike("%licensed%")).select("doc_id", "lang", "source")


@query("SELECT page_id, rtrim(coalesce(url, ''), '/') AS bare FROM pages WHERE rtrim(coalesce(url, ''), '/') IN (SELECT rtrim(url, '/') FROM pages WHERE contains(url, '/de/'))")
def source_url_filter(spark, d):
    rows = t(spark, d, "pages").select("page_id", urls.strip_slashes(F.col("url")).alias("bare"))
    return rows.join(rows.where(F.col("bare").contains("/de/")).select("bare").distinct(), "bare", "left_semi").select("page_id", "bare")


@query("SELECT count(*) AS n FROM pages")
def count_pages(spark, d):
    return t(spark, d, "pages").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, count(DISTINCT text) AS n FROM documents GROUP BY lang")
def count_distinct_content(spark, d):
    return t(spark, d, "documents").groupBy("lang").agg(F.countDistinct("text").alias("n"))


@query("SELECT min(doc_id) AS doc_id, md5(text) AS h FROM documents GROUP BY text")
def distinct_on_content(spark, d):
    return collections.first_of_each(t(spark, d, "documents"), "text", ["doc_id"]).select("doc_id", F.md5("text").alias("h"))


SQL_DOMINANT = "SELECT role, count(DISTINCT turn) AS span, count(*) AS n FROM conversations WHERE turn IS NOT NULL GROUP BY role"


@query(SQL_DOMINANT)
def collection_spans(spark, d):
    return collections.collections(t(spark, d, "conversations"), ["role"], "turn")


@query(f"SELECT * FROM ({SQL_DOMINANT}) ORDER BY span DESC, n DESC, CASE role WHEN 'user' THEN 0 ELSE 1 END, role LIMIT 1")
def dominant_collection(spark, d):
    return collections.dominant(t(spark, d, "conversations"), ["role"], "turn", F.when(F.col("role") == "user", 0).otherwise(1), least=1)


@query(f"SELECT count(DISTINCT turn) AS n FROM conversations WHERE role = (SELECT role FROM ({SQL_DOMINANT}) ORDER BY span DESC, n DESC, role LIMIT 1)")
def count_dominant(spark, d):
    rows = t(spark, d, "conversations")
    found = collections.dominant(rows, ["role"], "turn", least=1)
    return collections.of_dominant(rows, found, ["role"]).agg(F.countDistinct("turn").alias("n"))


SQL_RANKED = "SELECT conv_id, turn, role, dense_rank() OVER (ORDER BY turn) AS collection_rank FROM conversations WHERE turn IS NOT NULL"


@query(f"SELECT * FROM ({SQL_RANKED}) WHERE turn = 0 ORDER BY conv_id LIMIT 1")
def ordinal_first(spark, d):
    return collections.nth(t(spark, d, "conversations"), "turn", 1, ["conv_id"]).select("conv_id", "turn", "role", "collection_rank")


@query(f"SELECT * FROM ({SQL_RANKED}) WHERE turn = 2 ORDER BY conv_id LIMIT 1")
def ordinal_nth(spark, d):
    return collections.nth(t(spark, d, "conversations"), "turn", 3, ["conv_id"]).select("conv_id", "turn", "role", "collection_rank")


@query(f"SELECT * FROM ({SQL_RANKED}) ORDER BY turn DESC, conv_id LIMIT 1")
def ordinal_last(spark, d):
    return collections.nth(t(spark, d, "conversations"), "turn", -1, ["conv_id"]).select("conv_id", "turn", "role", "collection_rank")


@query("WITH x AS (SELECT turn, conv_id, role FROM conversations WHERE turn IS NOT NULL ORDER BY turn, conv_id, role LIMIT 60) SELECT string_agg((turn + 1)::VARCHAR || '. ' || role || conv_id::VARCHAR, chr(10) ORDER BY turn, conv_id, role) AS ranked, count(*) AS n FROM x")
def ranked_list(spark, d):
    return collections.ranked_list(t(spark, d, "conversations"), "turn", F.concat("role", F.col("conv_id").cast("string")), ["conv_id", "role"])


@query("""WITH r AS (SELECT conv_id, turn FROM conversations WHERE role = 'user' ORDER BY turn, conv_id LIMIT 10),
a AS (SELECT conv_id, turn FROM conversations WHERE role = 'assistant' OR turn = 0 ORDER BY CASE role WHEN 'assistant' THEN 0 ELSE 1 END, coalesce(turn, 0), conv_id LIMIT 3)
SELECT conv_id, turn, true AS is_anchor FROM a WHERE conv_id * 1000 + turn NOT IN (SELECT conv_id * 1000 + turn FROM r) UNION ALL SELECT conv_id, turn, false FROM r""")
def page_anchors(spark, d):
    rows = t(spark, d, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    result = rows.where("role = 'user'").orderBy("turn", "conv_id").limit(10)
    order = [F.when(F.col("role") == "assistant", 0).otherwise(1), F.coalesce("turn", F.lit(0)), "conv_id"]
    return retrieval.anchors(rows, result, (F.col("role") == "assistant") | (F.col("turn") == 0), order).select("conv_id", "turn", "is_anchor")


@query("""WITH r AS (SELECT event_id, event_id * 7919 % 1000 AS place, row_number() OVER (ORDER BY value DESC, event_id) AS rank FROM (SELECT * FROM events ORDER BY value DESC, event_id LIMIT 20)),
p AS (SELECT *, row_number() OVER (ORDER BY place DESC, rank) = 1 AS promoted FROM r) SELECT event_id, promoted, row_number() OVER (ORDER BY promoted DESC, rank) AS rank FROM p""")
def positional_promotion(spark, d):
    from pyspark.sql import Window

    top = t(spark, d, "events").orderBy(F.desc("value"), "event_id").limit(20).withColumn("place", F.col("event_id") * 7919 % 1000)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("value"), "event_id")))
    return retrieval.promote(top, "last", "place", "rank").select("event_id", "promoted", "rank")


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def category_counts(spark, d):
    return t(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, round(avg(n_chars), 4) AS mean, sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END)::BIGINT AS english, sum(CASE WHEN lang = 'xx' THEN 1 ELSE 0 END)::BIGINT AS other FROM documents")
def chunk_stats(spark, d):
    one = lambda lang: F.sum(F.when(F.col("lang") == lang, 1).otherwise(0))
    return t(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 4).alias("mean"), one("en").alias("english"), one("xx").alias("other"))


@query("SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type = 'purchase') AS completed, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) = count(*) FILTER (WHERE event_type = 'purchase') AS ready, count(*) FILTER (WHERE event_type = 'error') >= 3 AS is_failed, count(*) FILTER (WHERE event_type = 'error') >= 3 AND count(*) FILTER (WHERE event_type = 'purchase') > 0 AS warning FROM events GROUP BY user_id")
def document_readiness(spark, d):
    status = F.when(F.col("event_type") == "purchase", "COMPLETED").when(F.col("event_type") == "error", "FAILED").otherwise("PENDING")
    return ingest.readiness(t(spark, d, "events").withColumn("status", status), "user_id", "status")


@query("SELECT c_custkey, c_name, coalesce(n, 0) AS message_count, last_message_at FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last_message_at FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def chats_with_counts(spark, d):
    return chats.with_counts(t(spark, d, "customer").select("c_custkey", "c_name"), t(spark, d, "orders"), "c_custkey", "o_custkey", "o_orderdate")


@query("SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 20 OFFSET 40")
def message_page(spark, d):
    return chats.page(t(spark, d, "events"), ["ts", "event_id"], 20, 40).select("event_id", "ts")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def latest_messages(spark, d):
    return chats.latest(t(spark, d, "events"), ["ts", "event_id"], 20).select("event_id", "ts")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def last_message(spark, d):
    return chats.last_of_each(t(spark, d, "events"), "user_id", "ts", "event_id", ["event_id", "event_type"])


@query("SELECT c_mktsegment, o_orderstatus, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, o_orderstatus")
def three_way_join(spark, d):
    joined = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("SELECT s_suppkey, n_name, (SELECT count(*) FROM pages) AS pages FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def scalar_subquery_jobs(spark, d):
    n = t(spark, d, "pages").agg(F.count(F.lit(1))).scalar()
    return t(spark, d, "supplier").join(t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", n.alias("pages"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 2 DESC, ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_latest(spark, d):
    e = t(spark, d, "events")
    return ingest.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS h FROM documents WHERE doc_id % 2 = 1 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0) GROUP BY text")
def insert_ignore(spark, d):
    rows = t(spark, d, "documents").select("doc_id", text.sha256(F.col("text")).alias("h"))
    return ingest.insert_ignore(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1"), ["h"], [F.col("doc_id")]).select("doc_id", "h")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def cascade_delete(spark, d):
    c = t(spark, d, "customer")
    return ingest.cascade_delete(c, {"orders": t(spark, d, "orders")}, c.where("c_mktsegment = 'BUILDING'"), "c_custkey", "o_custkey")["orders"].select("o_orderkey")


SQL_PRICED = "SELECT p_partkey, 'Price: $' || printf('%.2f', p_retailprice) || ' for ' || p_name AS content FROM part"
SQL_PRICE = "TRY_CAST(replace(nullif(regexp_extract(content, '(?i)(?:price\\s*:\\s*[$€£]?\\s*|[$€£]\\s*)([0-9]+(?:[.,][0-9]{1,2})?)', 1), ''), ',', '') AS DOUBLE)"


def priced_parts(spark, d):
    return t(spark, d, "part").select("p_partkey", F.concat(F.lit("Price: $"), F.format_string("%.2f", "p_retailprice"), F.lit(" for "), "p_name").alias("content"))


@query(f"SELECT p_partkey, {SQL_PRICE} AS price FROM ({SQL_PRICED})")
def price_extract(spark, d):
    return priced_parts(spark, d).select("p_partkey", text.price(F.col("content")).alias("price"))


SQL_FIRST_PRICED = f"SELECT p_partkey, {SQL_PRICE} AS price FROM (SELECT content, min(p_partkey) AS p_partkey FROM ({SQL_PRICED}) GROUP BY content)"


@query(f"SELECT * FROM ({SQL_FIRST_PRICED}) WHERE price < 1000")
def price_filter(spark, d):
    return collections.price_filter(collections.priced(priced_parts(spark, d), "content", ["p_partkey"]), "lt", 1000.0).select("p_partkey", "price")


@query(f"SELECT * FROM ({SQL_FIRST_PRICED}) ORDER BY price, p_partkey LIMIT 25")
def price_sort(spark, d):
    return collections.priced(priced_parts(spark, d), "content", ["p_partkey"]).orderBy("price", "p_partkey").limit(25).select("p_partkey", "price")


@query(f"SELECT round(avg(price), 2) AS average_price, count(*) AS n FROM ({SQL_FIRST_PRICED})")
def price_average(spark, d):
    return collections.price_average(collections.priced(priced_parts(spark, d), "content", ["p_partkey"]))


#: Questions with known plans, and some more.
QUESTIONS = [
    "How many products are there?", "Which products cost less than $100?", "What is the price of Product X?", "What does Product X do?",
    "What is the cheapest product?", "Compare Product A and Product B.", "Which products mention AI?", "Can you name any countries present?",
    "average price over 12.50 of items", "Give me an overview of the 3rd item at https://x.org/pages/1.", "What ranked number 12 last year?",
    "the twelfth country", "best article", "position 7 please", "hello there", "what is the 5th item number 12", "the third place 7", "item 0 of 2nd page",
]
SQL_QUESTIONS = f"SELECT p_partkey, list_extract({QUESTIONS}, (p_partkey % {len(QUESTIONS)} + 1)::INT) AS q FROM part"


def questions(spark, d):
    return t(spark, d, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, QUESTIONS)), (F.col("p_partkey") % len(QUESTIONS) + 1).cast("int")).alias("q"))


def _case(column: str, cases: list[tuple[list[str], str]], other: str) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"regexp_matches({column}, '(?i){p}')" for p in patterns) + f" THEN '{name}'" for patterns, name in cases)
    return f"CASE {whens} ELSE '{other}' END"


P = planner
SQL_INTENT = _case("q", [([P.COUNT], "count"), ([P.AVERAGE], "aggregation"), ([P.CHEAPEST, P.COSTLIEST], "sort"), ([P.COMPARE], "comparison"), ([P.PRICE], "filter"), ([P.EXHAUSTIVE, P.NAMING], "list"), ([P.LOOKUP], "exact_lookup"), ([P.SUMMARY], "summary")], "semantic")
SQL_ENTITY = _case("regexp_replace(q, 'https?://\\S+', ' ', 'g')", [([p], e) for e, p in P.ENTITIES.items()], "content")


@query(f"WITH x AS (SELECT p_partkey, q, {SQL_INTENT} AS intent, {SQL_ENTITY} AS entity FROM ({SQL_QUESTIONS})) SELECT p_partkey, intent, entity, CASE WHEN intent IN ('count','list','filter','sort','aggregation') THEN 'global' ELSE 'local' END AS scope, nullif(regexp_extract(q, '(?i){P.PRICE}', 2), '')::DOUBLE AS price_value FROM x")
def intent_classify(spark, d):
    plan = planner.plan_struct(F.col("q"))
    return questions(spark, d).withColumn("p", plan).select("p_partkey", "p.intent", "p.entity", "p.scope", "p.price_value")


SQL_WORDS = str(list(P.ORDINAL_WORDS))


@query(f"""WITH x AS (SELECT p_partkey, q, regexp_extract(q, '(?i){P.ORDINAL_NTH}', ['a', 'b', 'c']) AS m FROM ({SQL_QUESTIONS}))
SELECT p_partkey, CASE WHEN regexp_matches(q, '(?i){P.ORDINAL_FIRST}') THEN 1 WHEN regexp_matches(q, '(?i){P.ORDINAL_LAST}') THEN -1 ELSE coalesce(nullif(greatest(coalesce(TRY_CAST(nullif(m.a, '') AS INT), TRY_CAST(nullif(m.b, '') AS INT), 0), 0), 0), nullif(list_position({SQL_WORDS}, lower(m.c)), 0)) END::INT AS position FROM x""")
def ordinal_intent(spark, d):
    return questions(spark, d).select("p_partkey", planner.ordinal(F.col("q")).alias("position"))


@query(f"SELECT p_partkey, CASE WHEN regexp_matches(lower(trim(q)), 'https?://[^\\s]+') THEN 'url' WHEN regexp_matches(lower(trim(q)), '^(what|who|where|when|why|how|is|are|can|could|does|do|did|will|would|should|which)\\b') OR trim(q) LIKE '%?' THEN 'question' ELSE 'message' END AS kind FROM ({SQL_QUESTIONS})")
def input_type(spark, d):
    return questions(spark, d).select("p_partkey", urls.input_type(F.col("q")).alias("kind"))


SQL_SPLIT = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"


@query(f"SELECT doc_id, sha256(text) AS chunk_hash, len({SQL_SPLIT})::INT AS token_count, len({SQL_TOKENS})::INT AS word_tokens FROM documents")
def content_hash_words(spark, d):
    c = F.col("text")
    return t(spark, d, "documents").select("doc_id", text.sha256(c).alias("chunk_hash"), text.word_count(c).alias("token_count"), text.word_tokens(c).alias("word_tokens"))


@query(f"SELECT doc_id, round(len({SQL_SPLIT}) / (len(list_filter({SQL_SPLIT}, lambda x: starts_with(x, 'http://') OR starts_with(x, 'https://'))) + 1.0::DOUBLE), 6) AS density FROM documents")
def info_density(spark, d):
    return t(spark, d, "documents").select("doc_id", F.round(text.information_density(F.col("text")), 6).alias("density"))


SQL_FLAGS = f"SELECT doc_id, len({SQL_TOKENS})::DOUBLE AS n, text, doc_id % 6 AS depth, doc_id % 3 = 0 AS t, doc_id % 5 = 0 AS l, doc_id % 4 = 0 AS i, doc_id % 7 = 0 AS s, list_extract(['content','table_row','list_item','product','summary','other'], (doc_id % 6 + 1)::INT) AS e, list_extract(['main_content','sidebar','footer','new'], (doc_id % 4 + 1)::INT) AS c FROM documents"


@query(f"""WITH f AS ({SQL_FLAGS}), p AS (SELECT *, least(1.0::DOUBLE, 0.35::DOUBLE * least(depth / 4.0::DOUBLE, 1.0) + 0.45::DOUBLE * CASE WHEN e IN ('table_row','list_item','card') THEN 1.0 ELSE least(n / 200.0::DOUBLE, 1.0) END + CASE WHEN t OR l OR i OR s THEN 0.2 ELSE 0 END::DOUBLE) AS base,
CASE c WHEN 'main_content' THEN 1.0 WHEN 'sidebar' THEN 0.5 WHEN 'footer' THEN 0.65 ELSE 0.5 END::DOUBLE AS cw, CASE e WHEN 'content' THEN 1.0 WHEN 'table_row' THEN 1.4 WHEN 'list_item' THEN 1.25 WHEN 'product' THEN 1.3 WHEN 'summary' THEN 0.6 ELSE 1.0 END::DOUBLE AS ew,
1.0::DOUBLE + CASE WHEN t THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN l THEN 0.15 ELSE 0 END::DOUBLE + CASE WHEN s THEN 0.25 ELSE 0 END::DOUBLE AS sb FROM f)
SELECT doc_id, round(base * cw * ew * sb, 9) AS relevance, round(least(1.0::DOUBLE, 0.5::DOUBLE * least(n / 160.0::DOUBLE, 1.0) + CASE WHEN t THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN l THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN s THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN regexp_matches(text, '\\S') THEN 0.1 ELSE 0 END::DOUBLE), 9) AS quality FROM p""")
def chunk_scores(spark, d):
    """At nine digits: the engines round ties at four differently."""
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % len(names) + 1).cast("int"))
    every = lambda k: F.col("doc_id") % k == 0
    n, entity, category = text.word_tokens(F.col("text")), pick("content", "table_row", "list_item", "product", "summary", "other"), pick("main_content", "sidebar", "footer", "new")
    relevance = scoring.relevance(n, F.col("doc_id") % 6, entity, category, every(3), every(5), every(4), every(7), digits=9)
    return t(spark, d, "documents").select("doc_id", relevance.alias("relevance"), scoring.quality(n, text.strip(F.col("text")) == "", every(3), every(5), every(7), digits=9).alias("quality"))


@query(f"SELECT doc_id, i AS place, array_to_string(list_slice(w, i * 450 + 1, i * 450 + 500), ' ') AS content FROM (SELECT doc_id, {SQL_SPLIT} AS w FROM documents), range(0, 1000000) r(i) WHERE i < ceil(len(w) / 450.0)")
def word_windows(spark, d):
    return t(spark, d, "documents").select("doc_id", F.posexplode(text.word_windows(F.col("text"), 500, 50)).alias("place", "content"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '^([^:/?#]+://[^/?#]*/[^?]*[^/?])/(\\?.*)?$', '\\1\\2') AS url, regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) AS origin FROM pages")
def url_normalize(spark, d):
    return t(spark, d, "pages").select("page_id", urls.normalize(F.col("url")).alias("url"), urls.origin(F.col("url")).alias("origin"))


SQL_ORIGIN = "regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1)"
SQL_LINKS = f"""SELECT DISTINCT page_id, regexp_replace(regexp_replace(CASE WHEN starts_with(link, '/') THEN {SQL_ORIGIN} || link ELSE link END, '#.*$', ''), '^([^:/?#]+://[^/?#]*/[^?]*[^/?])/(\\?.*)?$', '\\1\\2') AS link
FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages) WHERE link <> '' AND NOT regexp_matches(link, '^(#|javascript:|mailto:)')"""


def links(spark, d):
    """Links of each page, at most 500: absolute, normalised, of the page's own site."""
    found = F.filter(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))), lambda x: (x != "") & ~x.rlike("^(#|javascript:|mailto:)"))
    rows = t(spark, d, "pages").select("page_id", "url", F.explode(F.slice(found, 1, 500)).alias("raw"))
    whole = rows.withColumn("link", urls.normalize(urls.resolve(F.col("url"), F.col("raw"))))
    return whole.where(urls.is_internal(F.col("link"), F.col("url"))).select("page_id", "link").distinct()


@query(SQL_LINKS)
def link_extract(spark, d):
    return links(spark, d)


@query(f"SELECT page_id, count(*) AS n FROM ({SQL_LINKS}) GROUP BY page_id")
def link_histogram(spark, d):
    return links(spark, d).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


def parsed_pages(spark, d):
    return page_functions.parse_pages(t(spark, d, "pages"))


@query("SELECT page_id, replace(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g')), '&amp;', '&') AS title, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages")
def page_metadata(spark, d):
    """By the parser; the SQL reads the same from the markup."""
    return parsed_pages(spark, d).select("page_id", F.col("page.title").alias("title"), F.col("page.meta")["lang"].alias("lang"))


SQL_LISTS = "SELECT page_id, unnest(regexp_extract_all(html, '<ul>(.*?)</ul>', 1, 's')) AS body FROM pages"


@query(f"SELECT page_id, count(*) AS lists, sum(len(regexp_extract_all(body, '<li>')))::BIGINT AS items FROM ({SQL_LISTS}) GROUP BY page_id")
def page_list_sizes(spark, d):
    listed = parsed_pages(spark, d).select("page_id", F.explode("page.lists").alias("l"))
    return listed.groupBy("page_id").agg(F.count(F.lit(1)).alias("lists"), F.sum(F.size("l.items")).alias("items"))


@query()
def page_sections(spark, d):
    parsed = parsed_pages(spark, d)
    return parsed.select("page_id", F.posexplode("page.sections").alias("place", "s")).select("page_id", "place", "s.heading", "s.content")


@query()
def page_lists(spark, d):
    parsed = page_functions.parse_pages(t(spark, d, "pages"))
    rows = parsed.select("page_id", F.posexplode("page.lists").alias("place", "l")).select("page_id", "place", F.posexplode("l.items").alias("item_no", "item"))
    return chunking.ordinals(rows, "page_id", "place", "item_no", "item")


@query()
def page_chunks(spark, d):
    return chunking.page_chunks(page_functions.parse_pages(t(spark, d, "pages"))).select("page_id", "chunk_index", "chunk_type", "entity_type", "token_count", "chunk_hash", "relevance_score", "ordinal_index")


@query("""SELECT page_id, CASE WHEN a >= d AND a >= e AND a >= g AND a >= t THEN 'article' WHEN d >= e AND d >= g AND d >= t THEN 'documentation' WHEN e >= g AND e >= t THEN 'ecommerce' WHEN g >= t THEN 'card_listing' ELSE 'data_table' END AS page_class,
CASE WHEN contains(url, '/docs/') OR contains(url, '/documentation/') OR contains(url, '/api/') OR contains(url, '/reference/') THEN 'documentation' WHEN contains(url, '/blog/') OR contains(url, '/news/') OR contains(url, '/post/') OR contains(url, '/article/') THEN 'article'
WHEN contains(url, '/product/') OR contains(url, '/item/') OR contains(url, '/p/') OR contains(url, '/shop/') THEN 'ecommerce' WHEN contains(url, '/pricing/') OR contains(url, '/compare/') OR contains(url, '/features/') THEN 'data_table' END AS url_class
FROM (SELECT page_id, url, CASE WHEN contains(html, '<article') THEN 2 ELSE 0 END AS a, CASE WHEN regexp_matches(html, '(class|id)="[^"]*toc') THEN 2 ELSE 0 END AS d, CASE WHEN regexp_matches(html, 'class="[^"]*price') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(html, 'class="[^"]*(grid|cards)') THEN 1 ELSE 0 END AS e,
CASE WHEN regexp_matches(html, 'class="[^"]*(grid|cards)') AND NOT regexp_matches(html, 'class="[^"]*price') THEN 1 ELSE 0 END AS g, 0 AS t FROM pages)""")
def page_classes(spark, d):
    """The pages have an article each, which outweighs the text's share; the SQL knows the signals that they hold."""
    return parsed_pages(spark, d).select("page_id", page_functions.page_class(F.col("page")).alias("page_class"), urls.content_type(F.col("url")).alias("url_class"))


@query()
def token_budget_split(spark, d):
    return t(spark, d, "documents").select("doc_id", F.posexplode(chunking.split_column("text")).alias("part", "content"))


BIT_SUMS = ", ".join(f"sum(c * ((('0x' || substr(m, {k // 4 + 1}, 1))::INT >> {3 - k % 4}) & 1)) AS b{k}" for k in range(64))
BITS_SET = " + ".join(f"CASE WHEN 2 * b{k} > n THEN {1 << (63 - k)}::HUGEINT ELSE 0 END" for k in range(64))


@query(f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM documents), h AS (SELECT doc_id, md5(w) AS m, count(*) AS c FROM w GROUP BY doc_id, w),
b AS (SELECT doc_id, sum(c) AS n, {BIT_SUMS} FROM h GROUP BY doc_id), v AS (SELECT doc_id, {BITS_SET} AS u FROM b)
SELECT doc_id, coalesce(CASE WHEN u >= 9223372036854775808::HUGEINT THEN u - 18446744073709551616::HUGEINT ELSE u END, 0)::BIGINT AS simhash FROM documents LEFT JOIN v USING (doc_id)""")
def chunk_simhashes(spark, d):
    return t(spark, d, "documents").select("doc_id", text.chunk_simhash(F.col("text")).alias("simhash"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem), r AS (SELECT 1::BIGINT AS url, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON r.url = e.src WHERE r.depth < 3) SELECT url, min(depth)::INT AS depth FROM r GROUP BY url""")
def bfs_frontier(spark, d):
    edges = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return frontier.bfs(edges, spark.range(1, 2).withColumnRenamed("id", "url"), 3)


STAGE_OF = {"view": "crawling", "click": "processing", "signup": "chunking", "purchase": "embedding", "error": "failed"}
SQL_STAGE = "CASE event_type WHEN 'view' THEN 'crawling' WHEN 'click' THEN 'processing' WHEN 'signup' THEN 'chunking' WHEN 'purchase' THEN 'embedding' ELSE 'failed' END"
SQL_PROGRESS = f"SELECT event_id, user_id, {SQL_STAGE} AS stage, CASE event_type WHEN 'view' THEN 5 + floor((event_id % 101) / 100.0::DOUBLE * 25) WHEN 'click' THEN 30 + floor((event_id % 101) / 100.0::DOUBLE * 30) WHEN 'signup' THEN 60 + floor((event_id % 101) / 100.0::DOUBLE * 20) WHEN 'purchase' THEN 80 + floor((event_id % 101) / 100.0::DOUBLE * 20) END::INT AS progress FROM events"


def stage_events(spark, d):
    stage = F.element_at(F.create_map(*(F.lit(x) for kv in STAGE_OF.items() for x in kv)), F.col("event_type"))
    return t(spark, d, "events").select("event_id", "user_id", stage.alias("stage"), (F.col("event_id") % 101).cast("int").alias("percent"))


@query(SQL_PROGRESS)
def stage_progress(spark, d):
    return stage_events(spark, d).select("event_id", "user_id", "stage", ingest.stage_progress(F.col("stage"), F.col("percent")).alias("progress"))


@query(f"""WITH p AS (SELECT event_id, user_id, stage, list_position(['crawling','processing','chunking','embedding','failed'], stage) * 1000 + coalesce(progress, 0) AS point FROM ({SQL_PROGRESS})),
m AS (SELECT *, max(point) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM p)
SELECT event_id, (best // 1000)::INT AS best_stage, (best % 1000)::INT AS best_progress, stage = 'failed' OR best IS NULL OR point >= best AS passes FROM m""")
def monotone_progress(spark, d):
    rows = stage_events(spark, d).withColumn("progress", ingest.stage_progress(F.col("stage"), F.col("percent")))
    out = ingest.monotone(rows, "user_id", F.col("stage"), "progress", ["event_id"])
    return out.select("event_id", F.col("best.stage_no").cast("int").alias("best_stage"), F.col("best.progress").alias("best_progress"), "passes")


@query("SELECT user_id, least(round((count(*) FILTER (WHERE event_type = 'purchase') + 0.5::DOUBLE * count(*) FILTER (WHERE event_type = 'click')) / count(*) * 95), 95)::INT AS percent FROM events GROUP BY user_id")
def crawl_progress_pct(spark, d):
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    return t(spark, d, "events").groupBy("user_id").agg(ingest.crawl_percent(n("purchase"), n("click"), F.count(F.lit(1))).alias("percent"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 4 END, event_id) AS n FROM events) WHERE n = 1")
def status_dedupe(spark, d):
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "click", "processing").when(F.col("event_type") == "view", "pending").otherwise("failed")
    return ingest.first(t(spark, d, "events"), ["user_id"], [ingest.status_rank(status), F.col("event_id")]).select("user_id", "event_id")


@query()
def stream_progress(spark, d):
    """All events as one stream to its end, through the stateful operator; the written rows."""
    import uuid

    from weft.streaming import progress

    path = f"{shared_dir(spark)}/weft-stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(t(spark, d, "events").schema).format("parquet").option("pathGlobFilter", "*.parquet").load(f"{d}/events*.parquet")
    stage = F.element_at(F.create_map(*(F.lit(x) for kv in STAGE_OF.items() for x in kv)), F.col("event_type"))
    events = source.select(F.col("user_id").alias("chat_id"), "event_id", stage.alias("stage"), (F.col("event_id") % 101).cast("int").alias("percent"))
    progress.track(events).writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").format("parquet").start(f"{path}/out").awaitTermination()
    return spark.read.parquet(f"{path}/out")


SQL_STORED = "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'product' WHEN 1 THEN 'country' WHEN 2 THEN 'faq' ELSE 'content' END AS entity, 'Price: $' || printf('%.2f', p_retailprice) || ' for ' || p_name AS content FROM part"


def stored_chunks(spark, d):
    """Parts as stored chunks: four entities, a price in each text, two pages, positions of their own."""
    entity = F.element_at(F.array(*map(F.lit, ("product", "country", "faq", "content"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return priced_parts(spark, d).select(
        F.col("p_partkey").alias("id"), "content", entity.alias("entity"), F.lit("list_item").alias("chunk_type"), F.lit("main_content").alias("category"), F.lit(1.0).alias("information_density"), F.lit("Parts").alias("section_title"),
        F.array(F.lit("Parts")).alias("heading_path"), (F.col("p_partkey") % 50).cast("int").alias("ordinal"), F.when(F.col("p_partkey") % 2 == 0, "https://x.org/a/").otherwise("https://x.org/b").alias("source_url"),
    )


def asked(spark, d, question, **options):
    return router.answer(question, None, stored_chunks(spark, d), t(spark, d, "pages"), **options)


@query(f"SELECT 'structured' AS id, 'Verified result: there are ' || n || ' products.' AS content, n::DOUBLE AS result, 'count' AS operation FROM (SELECT count(DISTINCT content) AS n FROM ({SQL_STORED}) WHERE entity = 'product')")
def structured_count(spark, d):
    return asked(spark, d, "How many products are there?")


@query("SELECT 'structured' AS id, 'Verified result: there are ' || count(*) || ' pages.' AS content, count(*)::DOUBLE AS result, 'count' AS operation FROM pages")
def structured_count_pages(spark, d):
    return asked(spark, d, "How many pages are there?")


@query("SELECT 'structured' AS id, 'Verified result: there are 25 items.' AS content, 25.0::DOUBLE AS result, 'count' AS operation")
def structured_count_collection(spark, d):
    """No chunk is an article: the page's dominant collection is counted, 25 of the 50 positions."""
    return asked(spark, d, "How many articles are there?", source_url="https://x.org/a")


SQL_PRODUCTS = f"SELECT min(id) AS id, content, {SQL_PRICE} AS price FROM ({SQL_STORED}) WHERE entity = 'product' GROUP BY content"


@query(f"SELECT id::VARCHAR AS id, 'Name and price evidence:' || chr(10) || content AS content, price AS result, 'filter' AS operation FROM ({SQL_PRODUCTS}) WHERE price < 1000")
def structured_price_filter(spark, d):
    return asked(spark, d, "Which products are under $1000?")


@query(f"SELECT id::VARCHAR AS id, 'Name and price evidence:' || chr(10) || content AS content, price AS result, 'sort' AS operation FROM ({SQL_PRODUCTS}) WHERE price IS NOT NULL")
def structured_price_sort(spark, d):
    return asked(spark, d, "What is the cheapest product?")


@query(f"SELECT 'structured' AS id, 'Verified average product price: ' || printf('%.2f', round(avg(price), 2)) || ' across ' || count(*) || ' products.' AS content, round(avg(price), 2) AS result, 'average' AS operation FROM ({SQL_PRODUCTS}) WHERE price IS NOT NULL")
def structured_price_average(spark, d):
    return asked(spark, d, "What is the average price of the products?")


@query(f"SELECT min(id)::VARCHAR AS id, content, NULL::DOUBLE AS result, 'list' AS operation FROM ({SQL_STORED}) WHERE entity = 'country' GROUP BY content")
def structured_list(spark, d):
    return asked(spark, d, "Can you name any countries present?")


SQL_SCOPED = f"""chunks AS (SELECT c.*, text AS content FROM ({SQL_CHUNKS}) c JOIN documents ON id = doc_id WHERE category NOT IN ('excluded','filter','modal','cookie')),
v AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS vector_rank FROM (SELECT id, {SQL_VECTOR} AS s FROM chunks ORDER BY s DESC, id LIMIT 30)),
k AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS keyword_rank FROM (SELECT id, len(list_filter({SQL_TOKENS.replace('text', 'content')}, lambda x: list_contains({TERMS}, x)))::DOUBLE AS s FROM chunks WHERE list_has_all({SQL_TOKENS.replace('text', 'content')}, {TERMS}) ORDER BY s DESC, id LIMIT 30)),
f AS (SELECT coalesce(v.id, k.id) AS id, vector_rank, keyword_rank, coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + keyword_rank), 0) AS rrf FROM v FULL OUTER JOIN k ON v.id = k.id),
r AS (SELECT f.*, round(rrf * ({SQL_CAT} * {SQL_ENT}), 6) AS adjusted FROM f JOIN chunks USING (id)),
o AS (SELECT *, row_number() OVER (ORDER BY adjusted DESC, vector_rank NULLS LAST, keyword_rank NULLS LAST) AS rank FROM r)"""


def hybrid_rows(spark, d):
    """Vectors with the texts of the documents of the same number, as one chat's chunks."""
    chunks = chunks_of_vectors(spark, d).join(t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")), "id")
    rows = chunks.withColumns({"information_density": F.lit(1.0), "section_title": F.lit(None).cast("string"), "heading_path": F.array().cast("array<string>"), "source_url": F.lit("u"), "ordinal": F.lit(0)})
    return router.hybrid(router.scoped(rows), question_vector(spark, d), "What are the thing ering?")


@query(f"WITH {SQL_SCOPED} SELECT id, vector_rank, keyword_rank, adjusted, rank FROM o WHERE rank <= 10 AND (SELECT max(adjusted) FROM o) >= 0.02")
def hybrid_answer(spark, d):
    return hybrid_rows(spark, d)[0].select("id", "vector_rank", "keyword_rank", "adjusted", "rank")


@query(f"""WITH {SQL_SCOPED}, g AS (SELECT max(adjusted) FILTER (WHERE rank = 1) AS top, max(adjusted) FILTER (WHERE rank = 2) AS second FROM o)
SELECT 'fused' AS strategy, true AS lexical, top, round(top - second, 6) AS gap, CASE WHEN top >= 0.02 THEN 0.4 + CASE WHEN top > 0.05 THEN 0.3 ELSE 0 END + CASE WHEN round(top - second, 6) > 0.05 THEN 0.2 ELSE 0 END ELSE top END::DOUBLE AS confidence, top >= 0.02 AS accepted FROM g""")
def hybrid_gate(spark, d):
    return hybrid_rows(spark, d)[1]


SQL_STATE = "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'processing' WHEN 'error' THEN 'failed' ELSE 'pending' END"


def url_states(spark, d):
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "click", "processing").when(F.col("event_type") == "error", "failed").otherwise("pending")
    return t(spark, d, "events").select(F.col("user_id").alias("chat_id"), F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.concat(F.lit("https://x.org/"), F.col("event_id").cast("string")).alias("url"), status.alias("status"))


@query(f"SELECT user_id AS chat_id, count(*) AS total, count(*) FILTER (WHERE s = 'completed') AS completed, count(*) FILTER (WHERE s = 'processing') AS processing, count(*) FILTER (WHERE s = 'pending') AS pending, count(*) FILTER (WHERE s = 'failed') AS failed FROM (SELECT *, {SQL_STATE} AS s FROM events) GROUP BY user_id")
def status_counts(spark, d):
    return store.status_counts(url_states(spark, d), "chat_id")


@query(f"SELECT user_id AS chat_id, 'crawl_progress' AS type, count(*) AS total, least(round((count(*) FILTER (WHERE s = 'completed') + 0.5::DOUBLE * count(*) FILTER (WHERE s = 'processing')) / count(*) * 95), 95)::INT AS percent, arg_min('https://x.org/' || event_id, (ts, event_id)) AS first_url FROM (SELECT *, {SQL_STATE} AS s FROM events) GROUP BY user_id")
def crawl_events(spark, d):
    return store.crawl_event(url_states(spark, d)).select("chat_id", "type", "total", "percent", F.col("urls")[0]["url"].alias("first_url"))


@query(f"SELECT 'lang' AS kind, lang AS value, count(*) AS n, sum(len({SQL_SPLIT}))::BIGINT AS words FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*), sum(len({SQL_SPLIT}))::BIGINT FROM documents GROUP BY source")
def token_counts(spark, d):
    rows = t(spark, d, "documents").select(F.col("lang").alias("chunk_type"), F.col("source").alias("entity_type"), F.lit("x").alias("chunk_category"), text.word_count(F.col("text")).alias("token_count"))
    out = store.chunk_report(rows).where("kind <> 'chunk_category'")
    return out.withColumn("kind", F.when(F.col("kind") == "chunk_type", "lang").otherwise("source"))


@query(f"SELECT user_id AS chat_id, map_keys(m)::VARCHAR AS kinds, list_sum(map_values(m))::BIGINT AS n FROM (SELECT user_id, map_from_entries(list((s, n) ORDER BY s)) AS m FROM (SELECT user_id, {SQL_STATE} AS s, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY user_id)")
def category_maps(spark, d):
    counts = store.category_map(url_states(spark, d), "status", "chat_id")
    total = F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda a, x: a + x)
    return counts.select("chat_id", F.concat(F.lit("["), F.array_join(F.map_keys("counts"), ", "), F.lit("]")).alias("kinds"), total.alias("n"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'again' ELSE event_type END AS event_type, CASE WHEN event_type = 'error' THEN 0 ELSE value END AS value FROM events")
def conditional_update(spark, d):
    return store.update(t(spark, d, "events"), F.col("event_type") == "error", event_type="again", value=0.0).select("event_id", "event_type", "value")


@query("SELECT count(*) FILTER (WHERE event_type = 'error') AS affected FROM events")
def affected_rows(spark, d):
    return store.affected(t(spark, d, "events"), F.col("event_type") == "error")


@query("SELECT event_id, user_id FROM events WHERE user_id = 7 AND event_type IN ('view', 'click')")
def point_lookup(spark, d):
    return store.select(t(spark, d, "events"), user_id=7, event_type=["view", "click"], value=None).select("event_id", "user_id")


@query("SELECT user_id AS job_id, arg_max(event_type, event_id) AS status, max(event_id) AS last_event FROM events WHERE ts + INTERVAL 86000 SECONDS > (SELECT max(ts) - INTERVAL 10 DAY FROM events) GROUP BY user_id")
def job_states(spark, d):
    e = t(spark, d, "events")
    log = e.select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), F.col("event_id").alias("at"), (F.col("ts") + F.expr("INTERVAL 86000 SECONDS")).alias("expires_at"))
    now = e.agg((F.max("ts") - F.expr("INTERVAL 10 DAY")).alias("now")).scalar()
    return store.job_states(log, now).select("job_id", "status", F.col("at").alias("last_event"))


@query("SELECT conv_id, list_sort(list(turn)) AS users FROM (SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'assistant') QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY turn DESC) = 1) WHERE role = 'user' GROUP BY conv_id")
def presence(spark, d):
    rows = t(spark, d, "conversations").where("role in ('user', 'assistant')").select(F.col("conv_id"), F.col("turn").alias("user_id"), F.when(F.col("role") == "user", "user_joined").otherwise("user_left").alias("type"), F.col("turn").alias("at"))
    return store.presence(rows, "conv_id")


@query("SELECT conv_id, turn, CASE WHEN max(turn) OVER (PARTITION BY conv_id) > 0 THEN turn / max(turn) OVER (PARTITION BY conv_id)::DOUBLE ELSE 0 END AS relative_position FROM conversations")
def relative_positions(spark, d):
    return store.relative_position(t(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "relative_position")


@query("SELECT url, sha256(coalesce(html, '')) AS content_hash, strlen(coalesce(html, ''))::BIGINT AS response_size, 'PENDING' AS processing_status FROM pages")
def page_versions(spark, d):
    """Each crawled page as a version, and its version as a document to be processed."""
    made = store.versions(t(spark, d, "pages"), F.lit("2026-01-01"))
    documents = store.raw_documents(made)
    raw = F.col("raw_content")
    return documents.select("url", text.sha256(raw).alias("content_hash"), F.octet_length(raw).cast("long").alias("response_size"), "processing_status")


@query()
def page_assets(spark, d):
    return store.media_assets(parsed_pages(spark, d))


@query()
def page_markdown(spark, d):
    return parsed_pages(spark, d).select("page_id", media.markdown(F.col("page")).alias("markdown"))


@query()
def plain_text_chunks(spark, d):
    return t(spark, d, "documents").select("doc_id", F.explode(chunking.plain_chunk_column(F.col("text"))).alias("c")).select("doc_id", "c.*")
