"""Images and tables as text, and page structures as Markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.pages import DECORATIVE

LEAST_DESCRIPTION, LEAST_VISIBLE, MOST_IMAGE_BYTES = 80, 20, 10 << 20
#: First bytes of image files, in hex.
MAGIC = {"89504E47": "image/png", "FFD8FF": "image/jpeg", "47494638": "image/gif", "52494646": "image/webp"}


def decorative(src: Column, alt: Column) -> Column:
    told = F.lower(F.concat_ws(" ", src, alt))
    return F.exists(F.array(*map(F.lit, DECORATIVE)), lambda w: told.contains(w))


def describe_image(alt: Column, title: Column, src: Column) -> Column:
    """Alternative text, title, file name and source, each once."""
    name = F.regexp_extract(F.coalesce(src, F.lit("")), r"([^/?#]+)(?:[?#].*)?$", 1)
    parts = F.array_distinct(F.filter(F.array(alt, title, name, src), lambda x: x.isNotNull() & (F.trim(x) != "")))
    return F.array_join(parts, " | ")


def describe_table(rows: Column) -> Column:
    """The first ten rows."""
    return F.array_join(F.slice(rows, 1, 10), "\n")


def media_chunk(description: Column, visible: Column, entities: Column, is_decorative: Column) -> Column:
    """The text of an analysed image's chunk; null if it tells too little: no decoration, 80 characters, and entities or 20 visible ones."""
    enough = (F.length(F.trim(F.coalesce(description, F.lit("")))) >= LEAST_DESCRIPTION) & ((F.size(entities) > 0) | (F.length(F.trim(F.coalesce(visible, F.lit("")))) >= LEAST_VISIBLE))
    told = F.concat_ws("\n", F.concat(F.lit("Image: "), F.trim(description)), F.when(F.length(F.trim(visible)) > 0, F.concat(F.lit("Text: "), F.trim(visible))), F.when(F.size(entities) > 0, F.concat(F.lit("Entities: "), F.array_join(entities, ", "))))
    return F.when(~is_decorative & enough, told)


def image_bytes(data_uri: Column) -> Column:
    """The bytes of a ``data:`` uri; null for any other, or over ten megabytes."""
    body = F.try_to_binary(F.regexp_extract(data_uri, r"^data:[^,]*;base64,(.*)$", 1), F.lit("base64"))
    return F.when(data_uri.startswith("data:") & (F.octet_length(body) <= MOST_IMAGE_BYTES), body)


def mime_type(raw: Column) -> Column:
    out = F.lit(None).cast("string")
    for magic, kind in MAGIC.items():
        out = F.when(F.hex(F.substring(raw, 1, len(magic) // 2)) == magic, kind).otherwise(out)
    return out


def markdown_table(headers: Column, rows: Column) -> Column:
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rule = line(F.transform(headers, lambda _: F.lit("---")))
    return F.array_join(F.concat(F.array(line(headers), rule), F.transform(rows, line)), "\n")


def markdown(page: Column) -> Column:
    """A parsed page as Markdown: title, sections by depth, lists and tables."""
    body = lambda s: F.regexp_replace(s["content"], r"(?s)^\[[^\n]*\]\n\n", "")
    sections = F.transform(page["sections"], lambda s: F.concat(F.repeat(F.lit("#"), F.least(F.size(s["heading_path"]) + 1, F.lit(6))), F.lit(" "), s["heading"], F.lit("\n\n"), body(s)))
    lists = F.transform(page["lists"], lambda x: F.array_join(F.transform(x["items"], lambda v, k: F.concat(F.when(x["type"] == "ordered", F.concat((k + 1).cast("string"), F.lit(". "))).otherwise("- "), v)), "\n"))
    tables = F.transform(page["tables"], lambda x: markdown_table(x["headers"], x["rows"]))
    parts = F.concat(F.array(F.concat(F.lit("# "), page["title"])), sections, lists, tables)
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n\n")
