"""Parsed pages to typed, scored, hashed chunks: one array of chunks a page, exploded once."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions import scoring, text

MOST_TOKENS, OVERLAP = 800, 50
PROMOTED_ITEMS, ITEM_CHARS, ITEM_FLOOR = 10, 10, 3
#: Chunk types as stored; others are text.
STORED_TYPES = {"section": "text", "table_summary": "table", "table_row": "table_row", "list": "list", "list_item": "list_item", "code": "code", "quote": "quote", "summary": "summary", "image_description": "image"}


def pack(parts: list[str], count, most: int, joint: str, split) -> list[str]:
    """Greedy packing of parts up to ``most`` tokens; a part that is too long is split on its own."""
    out, held, size = [], [], 0
    for p in parts:
        n = count(p)
        if held and (n > most or size + n > most):
            out.append(joint.join(held))
            held, size = [], 0
        if n > most:
            out += split(p)
        else:
            held.append(p)
            size += n
    return out + ([joint.join(held)] if held else [])


def split_tokens(content: str, most: int = MOST_TOKENS, overlap: int = OVERLAP) -> list[str]:
    """Parts of at most ``most`` word tokens: paragraphs, else sentences, else overlapping runs of words."""
    count = lambda s: len(re.findall(r"\b\w+\b", s))
    if count(content) <= most:
        return [content]

    def runs(s: str) -> list[str]:
        words, step = s.split(), max(1, most - overlap)
        last = max(0, -(-(len(words) - most) // step)) if len(words) > most else 0
        return [" ".join(words[i * step : i * step + most]) for i in range(last + 1)] if words else [s]

    sentences = lambda p: pack(re.split(r"(?<=[.!?])\s+", p), count, most, " ", runs) or [p]
    paragraphs = [p.strip() for p in content.split("\n\n") if p.strip()]
    return pack(paragraphs, count, most, "\n\n", sentences) or [content]


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_column(content: pd.Series) -> pd.Series:
    return content.map(lambda c: split_tokens(c or ""))


#: Standalone lines that are dropped, and whole chunks that are.
BOILERPLATE_LINES = (
    r"^©?\s*[^\n]*all rights reserved\s*$", r"^\s*(follow us|contact us|privacy policy|terms of service)\s*$",
    r"^\s*\[?(follow us|privacy policy|terms of service)\]?\s*$",
)
BOILERPLATE_CHUNKS = (
    r"^©?\s*[^\n]*all rights reserved$", r"^(follow us|contact us|privacy policy|terms of service)$",
    r"^\[?(follow us|privacy policy|terms of service)\]?\b", r"^(home|about us|services|company|menu|navigation)$",
)
PLAIN_CHUNK = "array<struct<chunk_index:int,heading_path:array<string>,content:string,token_count:int>>"


def is_useful(content: str) -> bool:
    """At least 8 words and 40 characters, and no known phrase."""
    plain = re.sub(r"\s+", " ", content).strip().lower()
    return len(plain.split()) >= 8 and len(plain) >= 40 and not any(re.search(p, plain) for p in BOILERPLATE_CHUNKS)


def plain_chunks(content: str, most: int = 500) -> list[dict]:
    """Chunks of plain text with markdown headings.

    A chunk ends at a heading and carries the path of the heading that ends it.
    Texts of over one and a half times ``most`` words are cut to overlapping
    windows; boilerplate lines and chunks that are not useful or repeat an
    earlier text are left out. chunk_index counts before they are.
    """
    lines = [x for x in content.split("\n") if not any(re.search(p, x.strip(), re.I) for p in BOILERPLATE_LINES)]
    path: list[str] = []
    blocks: list[tuple[list[str], str]] = []
    held: list[str] = []
    for line in [*lines, None]:
        m = re.match(r"(#{1,6})\s+(.+)$", line.strip()) if line is not None else None
        if m:
            path = path[: len(m[1]) - 1] + [m[2].strip()]
        if m or line is None:
            if body := "\n".join(held).strip():
                blocks.append((path, body))
            held = []
        elif line.strip() or held:
            held.append(line)
    step, parts = most - OVERLAP, []
    for at, body in blocks:
        words = body.split()
        windows = [body] if len(words) <= 1.5 * most else [" ".join(words[i : i + most]) for i in range(0, len(words), step)]
        parts += [(at, w) for w in windows]
    out, seen = [], set()
    for k, (at, body) in enumerate(parts):
        key = re.sub(r"\s+", " ", body).strip().lower()
        if is_useful(body) and key not in seen:
            seen.add(key)
            out.append({"chunk_index": k, "heading_path": at, "content": body, "token_count": len(body.split())})
    return out


def plain_chunk_column(content: Column) -> Column:
    return F.pandas_udf(lambda c: c.map(lambda x: plain_chunks(x or "")), PLAIN_CHUNK)(content)


def entity_type(content: Column, chunk_type: Column, ner: Column | None = None) -> Column:
    """Structure, then keywords, then what a name finder says (if any), then content."""
    low = F.lower(content)
    asked = sum((F.when(low.contains(w), 1).otherwise(0) for w in ("how", "what", "why", "when", "where")), F.lit(0))
    marks = F.length(content) - F.length(F.replace(content, F.lit("?"), F.lit("")))
    return (
        F.when(chunk_type.isin("table", "list", "card", "structured_data"), chunk_type).when(chunk_type.isin("image", "media_chunk"), "image")
        .when(content.rlike(r"(?is)\bcapital\s*:.*\bpopulation\s*:"), "country").when(content.rlike(r"(?i)\b(add to cart|in stock|sku\s*:|buy now|msrp\s*:|price\s*:)"), "product")
        .when(low.rlike(r"\b(faq|frequently asked)\b"), "faq").when((chunk_type == "code") | content.contains("```"), "code_example").when((marks >= 2) & (asked >= 2), "faq")
        .when(low.contains("@type") | low.contains("schema.org") | low.contains("json-ld"), "structured_data").otherwise(F.coalesce(ner if ner is not None else F.lit(None).cast("string"), F.lit("content")))
    )


def row_entity(title: Column, heading: Column, headers: Column) -> Column:
    s = F.lower(F.concat_ws(" ", title, heading, F.array_join(headers, " ")))
    return F.when(s.rlike("country|countries") | (s.contains("capital") & s.contains("population")), "country").when(s.rlike("sku|price|product|msrp"), "product").otherwise("table_row")


def dominant_label(labels: Column) -> Column:
    """The commonest label if it is at least 34 % of all; null otherwise."""
    distinct = F.array_sort(F.array_distinct(labels))
    counts = F.transform(distinct, lambda x: F.struct(F.size(F.filter(labels, lambda y: y == x)).alias("n"), x.alias("label")))
    top = F.array_max(counts)
    return F.when(top["n"] / F.size(labels) >= 0.34, top["label"])


CHUNK_FLAGS = ("has_table", "has_list", "has_images", "has_structured_data")


def _chunk(content: Column, kind: str, entity: Column, path: Column, ordinal: Column | None = None, *flags: str) -> Column:
    held = [F.lit(name.removeprefix("has_") in flags).alias(name) for name in CHUNK_FLAGS]
    at = F.lit(None).cast("int") if ordinal is None else ordinal.cast("int")
    return F.struct(content.alias("content"), F.lit(kind).alias("chunk_type"), entity.alias("entity_type"), path.alias("heading_path"), at.alias("ordinal_index"), *held)


def page_chunks(parsed: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """Chunks of parsed pages in stages: sections, tables with rows, lists with items, cards, images, structured data with entities, product page, fallback, page summary.

    Each page's chunks are one array, made by column expressions and exploded
    once. Adds chunk_index, hash, SimHash, word counts, density, relevance and
    quality. Rows of a table and items of a list carry their position as
    ordinal_index where the collection is large enough (3 rows, 8 items).
    """
    p = F.col("page")
    title = F.coalesce(F.nullif(p["title"], F.lit("")), F.lit("Untitled Page"))
    none = F.array().cast("array<string>")
    plus = lambda path, part: F.concat(path, F.array(part))
    number = lambda form, *n: F.format_string(form, *n)
    named = lambda label, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{label}: "), v))

    def of_section(x: Column) -> Column:
        n = F.size(x["parts"])
        kind = entity_type(x["content"], F.lit("section"))
        return F.transform(x["parts"], lambda part, j: _chunk(part, "section", kind, text.heading_path(x["heading_path"], x["heading"], title, F.when(n > 1, number("Part %d of %d", j + 1, n)))))

    def of_table(x: Column) -> Column:
        path, n = text.heading_path(none, x["heading"], title), F.size(x["row_texts"])
        first = F.transform(F.slice(x["row_texts"], 1, 3), lambda r, k: F.concat(number("  Row %d: ", k + 1), text.squeeze(r)))
        lines = F.array(F.when(F.size(x["headers"]) > 0, F.concat(F.lit("Columns: "), F.array_join(x["headers"], " | "))), F.concat(F.lit("Rows: "), n.cast("string")), F.array_join(first, "\n"), F.when(n > 3, number("  ... (%d more rows)", n - 3)))
        summary = _chunk(F.array_join(F.filter(lines, lambda v: v.isNotNull()), "\n"), "table_summary", F.lit("table"), path, None, "table")
        kept = F.filter(x["row_texts"], lambda r: ~text.is_empty(r))
        kind, m = row_entity(title, x["heading"], x["headers"]), F.size(kept)
        rows = F.transform(kept, lambda r, j: _chunk(F.concat(number("Table: %s — Row %d of %d\n", title, j + 1, m), r), "table_row", kind, plus(path, number("Row %d", j + 1)), F.when(m >= 3, j), "table"))
        return F.concat(F.array(summary), rows)

    def of_list(x: Column) -> Column:
        path, n = text.heading_path(none, x["heading"], title), F.size(x["items"])
        lines = F.array_join(F.transform(x["items"], lambda v, k: F.concat(number("  %d. ", k + 1), v)), "\n")
        whole = _chunk(F.concat(F.lit("List type: "), x["type"], number("\nItems (%d):\n", n), lines), "list", F.lit("list"), path, None, "list")
        items = F.transform(x["items"], lambda v, j: _chunk(F.concat(number("List item %d of %d\n", j + 1, n), F.trim(v)), "list_item", F.lit("list_item"), plus(path, number("Item %d", j + 1)), F.when(n >= 8, j), "list"))
        long = F.transform(x["items"], lambda v: F.length(F.trim(v)) >= F.when(n >= PROMOTED_ITEMS, ITEM_FLOOR).otherwise(ITEM_CHARS))
        kept = F.transform(F.filter(F.arrays_zip(items.alias("c"), long.alias("k")), lambda z: z["k"]), lambda z: z["c"])
        return F.when(n > 0, F.concat(F.array(whole), kept)).otherwise(F.array().cast(items_type))

    def of_card(x: Column) -> Column:
        told = F.array_join(F.filter(F.array(named("Card", x["name"]), named("Description", x["description"]), named("Price", x["price"]), named("Text", x["text"])), lambda v: v.isNotNull()), "\n")
        guess = entity_type(told, F.lit("text"))
        return _chunk(told, "card", F.when(x["is_product"], "product").when(guess == "content", "card").otherwise(guess), text.heading_path(none, x["name"], title))

    def of_image(x: Column) -> Column:
        told = F.array_join(F.filter(F.array(named("Image", x["alt"]), named("Section", x["heading"]), named("Source", x["src"])), lambda v: v.isNotNull()), "\n")
        return _chunk(told, "image", F.lit("image"), text.heading_path(none, x["heading"], title), None, "images")

    def of_entity(x: Column) -> Column:
        fields = (("Name", "name"), ("Description", "description"), ("Price", "price"), ("Currency", "currency"), ("SKU", "sku"), ("URL", "url"))
        told = F.array_join(F.filter(F.array(*(named(label, x[f]) for label, f in fields)), lambda v: v.isNotNull()), "\n")
        return _chunk(told, "mixed", x["entity_type"], F.array(title, F.initcap(x["entity_type"])), None, "structured_data")

    items_type = "array<struct<content:string,chunk_type:string,entity_type:string,heading_path:array<string>,ordinal_index:int,has_table:boolean,has_list:boolean,has_images:boolean,has_structured_data:boolean>>"
    has_ld = F.coalesce(p["json_ld"], F.lit("")) != ""
    empty = (F.size(p["sections"]) == 0) & (F.size(p["tables"]) == 0) & (F.size(p["lists"]) == 0) & (F.size(p["cards"]) == 0) & ~has_ld
    one = lambda chunk, holds: F.filter(F.array(chunk), lambda _: holds).cast(items_type)
    tops = F.array_join(F.transform(F.slice(p["sections"], 1, 3), lambda x: x["heading"]), " | ")
    told = F.concat_ws("\n", F.concat(F.lit("Page: "), title), named("URL", F.col(url)), number("Contains: %d sections, %d tables, %d lists, %d cards", *(F.size(p[x]) for x in ("sections", "tables", "lists", "cards"))), named("Top sections", tops))
    pictures = F.filter(p["images"], lambda x: ~x["is_decorative"] & (F.trim(x["alt"]) != ""))
    stages = [
        F.flatten(F.transform(p["sections"], of_section)), F.flatten(F.transform(p["tables"], of_table)), F.flatten(F.transform(p["lists"], of_list)), F.transform(p["cards"], of_card), F.transform(pictures, of_image),
        one(_chunk(F.concat(F.lit("Structured Data (Schema.org):\n"), p["json_ld"]), "structured_data", F.lit("structured_data"), F.array(title, F.lit("Structured Data")), None, "structured_data"), has_ld),
        F.transform(p["entities"], of_entity),
        one(_chunk(p["main_text"], "content", entity_type(p["main_text"], F.lit("")), F.array(title)), empty),
        one(_chunk(told, "summary", F.lit("summary"), F.array(title)), F.lit(True)),
    ]
    whole = F.filter(F.concat(*(x.cast(items_type) for x in stages)), lambda x: ~text.is_empty(x["content"]))
    return score(parsed.select(key, F.posexplode(whole).alias("chunk_index", "c")).select(key, "chunk_index", "c.*"))


def score(chunks: DataFrame) -> DataFrame:
    """Hash, SimHash, counts and scores of chunks (content, chunk_type, entity_type, heading_path, has_* flags)."""
    c, words = F.col("content"), text.word_tokens(F.col("content"))
    has = [F.col(x) for x in CHUNK_FLAGS]
    category = F.lit("main_content")
    return chunks.withColumns({
        "chunk_category": category, "chunk_hash": text.sha256(c), "chunk_simhash": text.chunk_simhash(c), "token_count": text.word_count(c), "information_density": text.information_density(c),
        "relevance_score": scoring.relevance(words, F.size("heading_path"), F.col("entity_type"), category, *has), "quality_score": scoring.quality(words, text.strip(c) == "", has[0], has[1], has[3]),
        "stored_type": F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in STORED_TYPES.items() for x in kv)), F.col("chunk_type")), F.lit("text")), "context_prefix": text.context_prefix(F.col("heading_path")),
    })


def ordinals(items: DataFrame, page: str, collection: str, position: str, content: str) -> DataFrame:
    """Universal ordinals: collections of a page share one running offset; equal items of a page share the first one's ordinal.

    Adds ordinal_index (as stored) and collection_rank (within its collection).
    """
    sizes = items.groupBy(page, collection).agg(F.count(F.lit(1)).alias("size"))
    offset = F.coalesce(F.sum("size").over(Window.partitionBy(page).orderBy(collection).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = items.join(sizes.withColumn("base", offset).drop("size"), [page, collection])
    rank = F.row_number().over(Window.partitionBy(page, collection).orderBy(position)) - 1
    ranked = placed.withColumn("collection_rank", rank).withColumn("own", F.col("base") + F.col("collection_rank"))
    same = Window.partitionBy(page, text.normalized_md5(F.col(content)))
    return ranked.withColumn("ordinal_index", F.when(text.squeeze(F.col(content)) != "", F.min("own").over(same))).drop("base", "own")


def dedupe_richest(sections: DataFrame, page: str, position: str) -> DataFrame:
    """Of the sections of a page with one last heading the richest stays: label lines, words, depth, then the first. Sections without a heading all stay."""
    leaf = F.trim(F.coalesce(F.try_element_at("heading_path", F.lit(-1)), F.lit("")))
    w = Window.partitionBy(page, leaf).orderBy(F.desc(text.label_lines(F.col("content"))), F.desc(text.word_count(F.col("content"))), F.desc(F.size("heading_path")), position)
    return sections.withColumn("__n", F.when(leaf == "", 1).otherwise(F.row_number().over(w))).where("__n = 1").drop("__n")
