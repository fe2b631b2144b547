"""Pages to structs: one Arrow pass parses each page once; everything after it is column code.

The tree is permissive: void elements close at once, an unmatched end tag is
ignored, and paragraphs are not closed by what follows them.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from statistics import median

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from weft.functions.text import NOT_HEADINGS
from weft.session import ship_package

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset("script style noscript iframe template".split())
SKIPPED, SKIPPED_ROLES = frozenset("nav header footer aside".split()), frozenset("navigation banner contentinfo".split())
HEADINGS = {f"h{n}": n for n in range(1, 7)}
#: Selectors of the content root, in order, and ids of an application's mount node.
ROOTS = (
    "main", "article", "role=main", "#content", "#main", "#main-content", "#article-body", "#post-body", "#entry-content", "#page-content",
    ".content", ".main-content", ".post-content", ".article-body", ".entry-content", ".post-body", ".container",
)
MOUNTS = ("root", "app", "__next", "__nuxt")
#: Parts of an image's source or alternative text that mark it as decoration.
DECORATIVE = (
    "icon", "emoji", "logo", "sprite", "favicon", "spacer", "pixel", "blank.", "transparent.",
    "confetti", "arrow", "bullet", "chevron", "divider",
)
ROOT_WORDS, SECTION_CHARS, OWNED_ITEMS, FRAGMENT_CHARS, DESCRIPTION_CHARS = 200, 30, 5, 3, 60
#: Repeated children of a card group: least number, least share of all children, and how many are looked at.
GROUP_LEAST, GROUP_SHARE, GROUP_LOOK = 4, 0.6, 10
MOST_TABLES, MOST_CARDS, MOST_LINKS = 100, 200, 500

#: Signals of the page classifier, and the points that each gives to a class; ties go to the class named first.
SIGNALS = (
    "has_schema_product", "has_schema_article", "has_schema_faq", "has_product_price", "has_article_tag", "has_code_blocks", "has_table_of_contents",
    "has_card_grid", "has_breadcrumbs", "has_data_table", "has_pagination", "url_is_docs", "url_is_blog", "url_is_product",
)
CLASS_POINTS = {
    "article": {"has_schema_article": 3, "has_article_tag": 2, "url_is_blog": 2, "is_dense": 1},
    "documentation": {"has_code_blocks": 3, "has_table_of_contents": 2, "url_is_docs": 3},
    "ecommerce": {"has_schema_product": 3, "has_product_price": 3, "url_is_product": 2, "has_card_grid": 1},
    "card_listing": {"grid_with_pagination": 3, "grid_without_price": 1},
    "data_table": {"has_data_table": 3},
}
URL_PARTS = {
    "url_is_docs": ("/docs/", "/documentation/", "/api/", "/reference/"), "url_is_blog": ("/blog/", "/news/", "/post/", "/article/"),
    "url_is_product": ("/product/", "/item/", "/p/"),
}

PAGE = (
    "struct<title:string,page_type:string,words:int,scripts:int,main_text:string,links:array<string>,"
    "signals:struct<" + ",".join(f"{k}:boolean" for k in SIGNALS) + ",content_density:double,link_density:double>,"
    "headings:array<struct<level:int,text:string>>,"
    "sections:array<struct<heading:string,heading_path:array<string>,content:string,parts:array<string>>>,"
    "tables:array<struct<heading:string,headers:array<string>,rows:array<array<string>>,row_texts:array<string>>>,"
    "lists:array<struct<type:string,heading:string,items:array<string>>>,"
    "cards:array<struct<name:string,description:string,price:string,text:string,is_product:boolean>>,"
    "images:array<struct<src:string,alt:string,heading:string,is_decorative:boolean>>,json_ld:string,"
    "entities:array<struct<name:string,description:string,price:string,currency:string,sku:string,url:string,entity_type:string>>,"
    "meta:map<string,string>,data_attributes:map<string,array<string>>>"
)


class Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict, parent: "Node | None"):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator["Node | tuple[str, Node]"]:
        """Nodes and (text, parent) in document order, without recursion."""
        stack = list(reversed(self.children))
        while stack:
            x = stack.pop()
            yield x
            if isinstance(x, Node):
                stack.extend(reversed(x.children))

    def find(self, *tags: str) -> list["Node"]:
        return [x for x in self.walk() if isinstance(x, Node) and x.tag in tags]

    def kids(self, *tags: str) -> list["Node"]:
        return [x for x in self.children if isinstance(x, Node) and (not tags or x.tag in tags)]

    def text(self, sep: str = " ") -> str:
        parts = [x[0].strip() for x in self.walk() if isinstance(x, tuple) and x[1].tag not in NO_TEXT]
        return re.sub(r"[^\S\n]+", " ", sep.join(p for p in parts if p)).strip()

    def above(self) -> Iterator["Node"]:
        at = self.parent
        while at is not None:
            yield at
            at = at.parent

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def has_class(self, word: str) -> bool:
        return word in (self.attrs.get("class") or "").lower()


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        for node in (self.at, *self.at.above()):
            if node.tag == tag and node.parent is not None:
                self.at = node.parent
                return

    def handle_data(self, data):
        self.at.children.append((data, self.at))


def parse(html: str | None) -> Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def data_table(table: Node) -> tuple[list[str], list[list[str]]] | None:
    """(headers, rows) of a table that holds data; None for a layout table.

    At least two rows; 2 to 20 columns in the commonest row, which is 60 % of
    them or more; cells short; few block elements in them. A head row is also
    given as a data row.
    """
    rows = [[c for c in r.kids("td", "th")] for r in table.find("tr")]
    rows = [r for r in rows if r]
    if len(rows) < 2:
        return None
    width, n = Counter(map(len, rows)).most_common(1)[0]
    cells = [c for r in rows for c in r]
    sizes = [len(c.text()) for c in cells]
    blocks = sum(len(c.find("div", "p", "section", "article", "ul", "ol", "table")) for c in cells)
    if not 2 <= width <= 20 or n / len(rows) < 0.6 or median(sizes) > 120 or max(sizes) > 1500 or blocks / len(cells) > 0.5:
        return None
    texts = [[c.text() for c in r] for r in rows]
    return (texts[0], texts) if table.find("thead") else (texts[0], texts[1:])


def merge_labels(blocks: list[str], ahead: int = 2) -> list[str]:
    """Neighbouring numbers and labels as ``Label: number``; what stands between a pair is dropped, prose is not bridged."""
    kind = lambda s: "num" if re.match(r"^-?[\d,]+(?:\.\d+)?%?$", s) else "label" if re.match(r"^[A-Za-z][A-Za-z' \-]{0,29}$", s) else ""
    texts = [b.strip() for b in blocks]
    kinds, out, i = [kind(t) for t in texts], [], 0
    while i < len(texts):
        mate = None
        if kinds[i]:
            for j in range(i + 1, min(i + 1 + ahead, len(texts))):
                if {kinds[i], kinds[j]} == {"num", "label"}:
                    mate = j
                    break
                if not kinds[j] and len(texts[j]) > 40:
                    break
        if mate is None:
            out.append(texts[i])
            i += 1
        else:
            label, number = (i, mate) if kinds[i] == "label" else (mate, i)
            out.append(f"{texts[label]}: {texts[number]}")
            i = mate + 1
    return out


def _owned(parent: Node, data: set[int]) -> bool:
    """Whether another pass takes the text of ``parent``: looked for from its own parent upwards."""
    return parent.tag in NO_TEXT or parent.tag == "svg" or any(a.tag == "svg" or a.tag in NO_TEXT or id(a) in data or a.tag in ("ul", "ol") and len(a.kids("li")) >= OWNED_ITEMS for a in parent.above())


def _skipped(node: Node) -> bool:
    return any(a.tag in SKIPPED or a.attrs.get("role") in SKIPPED_ROLES for a in (node, *node.above()))


def _selects(rule: str, node: Node) -> bool:
    if rule.startswith("role="):
        return node.attrs.get("role") == rule[5:]
    if rule[0] == "#":
        return node.attrs.get("id") == rule[1:]
    return rule[1:] in node.classes() if rule[0] == "." else node.tag == rule


def _root(tree: Node) -> Node:
    for rule in ROOTS:
        for node in tree.walk():
            if isinstance(node, Node) and _selects(rule, node) and len(node.text().split()) >= ROOT_WORDS:
                return node
    return next(iter(tree.find("body")), tree)


def _heading_like(text: str) -> bool:
    low = text.lower()
    return 0 < len(text) <= 120 and not any(p in low for p in NOT_HEADINGS) and not re.match(r"\d{4}-\d{2}-\d{2}|[A-Z][a-z]+ \d{1,2}, \d{4}", text)


def _junk(text: str) -> bool:
    return len(text.strip()) <= 1 or re.fullmatch(r"""[.,;:!?()\[\]{}"' \n\t]*""", text) is not None


def _decorative(text: str, parent: Node) -> bool:
    """A short fragment that is no word, alone in a div without class."""
    if parent.tag != "div" or parent.attrs.get("class") or len(text) > FRAGMENT_CHARS or text.isalpha():
        return False
    return not parent.find("p", "span", "a", "img", "svg", "ul", "ol", "table")


def _key(content: str) -> str:
    return hashlib.md5(re.sub(r"\s+", " ", content).strip().lower().encode()).hexdigest()


def _section(heading: str, path: list[str], body: str) -> dict:
    return {"heading": heading, "heading_path": path, "content": f"[{' > '.join(path)}]\n\n{body}", "parts": None}


def prose_sections(root: Node, title: str, data: set[int]) -> list[dict]:
    """Text between headings, with the path of headings in front: the title first, cut at each heading's level."""
    path, heading = [title], title
    found, seen, held = [], set(), []

    def flush():
        body = "\n".join(merge_labels(held)).strip()
        held.clear()
        if len(body) >= SECTION_CHARS and not _junk(body) and (key := _key(body)) not in seen:
            seen.add(key)
            found.append(_section(heading, list(dict.fromkeys(path)), body))

    for x in root.walk():
        if isinstance(x, Node):
            if x.tag in HEADINGS and not _skipped(x) and _heading_like(name := x.text()):
                flush()
                heading, path = name, path[: HEADINGS[x.tag] - 1] + [name]
        elif (piece := x[0].strip()) and not any(a.tag in HEADINGS for a in (x[1], *x[1].above())) and not _skipped(x[1]) and not _owned(x[1], data) and not _decorative(piece, x[1]):
            held.append(re.sub(r"\s+", " ", piece))
    flush()
    return found


def _how_to_part(node: Node) -> str:
    if node.tag == "p":
        return t if len(t := node.text()) > 5 else ""
    if node.tag in ("ul", "ol"):
        return "\n".join(f"• {t}" for li in node.kids("li") if (t := li.text()))
    if node.tag == "div" and node.find("p", "li"):
        return node.text("\n")
    if node.tag == "table":
        rows = [", ".join(c.text() for c in r.kids("td", "th")) for r in node.find("tr")]
        return "\n".join([f"Headers: {rows[0]}", *rows]) if rows else ""
    return ""


def how_to_sections(tree: Node, title: str) -> list[dict]:
    """What stands beside the second- and third-level headings of the article, up to the next one; headings classed as parts or steps alone, where there are such."""
    tests = (lambda n: n.tag == "div" and n.attrs.get("id") == "main-content", lambda n: n.tag == "div" and "main-content" in n.classes(), lambda n: n.tag == "div" and n.attrs.get("id") == "article-body", lambda n: n.tag == "div" and "article-body" in n.classes(), lambda n: n.tag == "article", lambda n: n.tag == "main")
    nodes = lambda root: (x for x in root.walk() if isinstance(x, Node))
    root = next((n for t in tests for n in nodes(tree) if t(n)), tree)
    root = next((n for n in nodes(root) if n.tag == "div" and "steps" in n.classes()), root)
    heads = root.find("h2", "h3")
    heads = [h for h in heads if re.search("part|step", h.attrs.get("class", ""), re.I)] or heads
    out = []
    for head in heads:
        beside = head.parent.kids()
        after = beside[next(k for k, n in enumerate(beside) if n is head) + 1 :]
        stop = next((k for k, n in enumerate(after) if n.tag in ("h2", "h3")), len(after))
        parts = [t for n in after[:stop] if (t := _how_to_part(n))]
        if parts and (name := head.text()):
            out.append(_section(name, [title, name], "\n\n".join(parts)))
    return out


def card_group(container: Node) -> list[Node]:
    """The first repeated children below a node that look like cards: alike in tag and classes, with a link, a heading or a price in half of those looked at."""
    for box in container.find("div", "ul", "section"):
        kids = box.kids()
        kind = lambda n: (n.tag, " ".join(sorted(n.classes())))
        if len(kids) < GROUP_LEAST:
            continue
        top, n = Counter(map(kind, kids)).most_common(1)[0]
        if n < GROUP_LEAST or n / len(kids) < GROUP_SHARE:
            continue
        alike = [k for k in kids if kind(k) == top]
        looked = alike[:GROUP_LOOK]
        good = sum(len(t := c.text("")) >= 10 and (any(a.attrs.get("href") is not None for a in c.find("a")) or bool(c.find(*HEADINGS)) or re.search(r"[$£€]\s?\d", t) is not None) for c in looked)
        if good >= max(1, len(looked) // 2):
            return alike
    return []


def card_section(card: Node, url: str, title: str) -> dict | None:
    """A card as a section: its name, and price, description and link as lines."""
    named = lambda *words: next((x for x in card.walk() if isinstance(x, Node) and any(w in x.attrs.get("class", "") for w in words)), None)
    first = lambda *tags: next(iter(card.find(*tags)), None)
    said = lambda n: n.text("") if n else ""
    whole = card.text("\n")
    name = said(first(*HEADINGS) or named("title", "name", "model") or first("a")) or next((x.strip() for x in whole.split("\n") if x.strip()), "Card")
    price = said(named("price") or next((x for x in card.walk() if isinstance(x, Node) and "data-price" in x.attrs), None))
    told = said(next((x for x in card.walk() if isinstance(x, Node) and (x.tag == "p" or any(w in x.attrs.get("class", "") for w in ("desc", "summary")))), None))
    href = next((a.attrs["href"] for a in card.find("a") if a.attrs.get("href")), "")
    site = re.match(r"[^:/?#]+://[^/?#]*", url or "")
    link = href if href.startswith("http") or not href else (site[0] if site else "://") + href
    if price or told and told != name:
        fields = {"Name": name, "Price": price, "Description": told if told.lower() != name.lower() else "", "URL": link}
        rest = whole
        for v in (fields["Price"], fields["Description"], link):
            rest = rest.replace(v, "").strip() if v else rest
        fields["Details"] = rest if len(rest) > 10 else ""
        body = "\n".join(f"{k}: {v}" for k, v in fields.items() if v)
    else:
        body = whole + (f"\nURL: {link}" if link else "")
    return None if _junk(body) else _section(name, [title, name], body)


def card_sections(root: Node, url: str, title: str) -> list[dict]:
    out, seen = [], set()
    for box in (x for x in [root, *root.walk()] if isinstance(x, Node) and x.tag in ("div", "ul", "section", "main", "article")):
        if not _skipped(box):
            for card in card_group(box)[:MOST_CARDS]:
                made = card_section(card, url, title)
                if made and (key := _key(made["content"])) not in seen:
                    seen.add(key)
                    out.append(made)
    return out


def richest(found: list[dict]) -> list[dict]:
    """Of sections with one last heading the richest, in the place of the first: label lines, words, depth, then the earlier. Texts that repeat go first."""
    best: dict[str, tuple] = {}
    seen: set[str] = set()
    for k, x in enumerate(found):
        body = x["content"].split("]\n\n", 1)[-1]
        if (text_key := _key(body)) in seen:
            continue
        seen.add(text_key)
        leaf = (x["heading_path"] or [""])[-1].strip()
        labels = len(re.findall(r"(?m)^[A-Za-z][A-Za-z' \-]{1,25}:\s*-?[\d,]+(?:\.\d+)?%?\s*$", x["content"]))
        rank = (labels, len(x["content"].split()), len(x["heading_path"]), -k)
        key = leaf or f"\0{k}"
        if key not in best or rank > best[key][1]:
            best[key] = (best[key][0] if key in best else k, rank, x)
    return [x for _, _, x in sorted(best.values(), key=lambda v: v[0])]


def _named(v):
    """The name of a described thing, or of each of a list; text as it is."""
    if isinstance(v, list):
        return ", ".join(x.get("name", "") if isinstance(x, dict) else str(x) for x in v)
    return v.get("name") if isinstance(v, dict) else v


def _many(v) -> list:
    return v if isinstance(v, list) else [v] if v else []


def _offers(d: dict) -> list[str]:
    lines = []
    for o in _many(d.get("offers")):
        if isinstance(o, dict):
            price = o.get("price")
            parts = ["Price:", *([str(price)] if price is not None else []), str(o.get("priceCurrency") or ""), f"({o['availability']})" if o.get("availability") else ""]
            lines.append(" ".join(p for p in parts if p))
    return lines


def _rating(d: dict) -> list[str]:
    r = d.get("aggregateRating")
    if not isinstance(r, dict) or not r.get("ratingValue"):
        return []
    n = r.get("reviewCount") or r.get("ratingCount")
    return [f"Rating: {r['ratingValue']}" + (f" ({n} reviews)" if n else "")]


def _image(d: dict) -> list[str]:
    v = next(iter(_many(d.get("image"))), None)
    v = v.get("url") if isinstance(v, dict) else v
    return [f"Image: {v}"] if v else []


def _answers(d: dict) -> list[str]:
    out = []
    for q in _many(d.get("mainEntity")):
        if isinstance(q, dict):
            a = q.get("acceptedAnswer") or {}
            a = a.get("text", "") if isinstance(a, dict) else str(a)
            out += [f"{mark}: {t}" for mark, t in (("Q", q.get("name")), ("A", a)) if t]
    return out


def _steps(key: str, line: str, *names: str, head: str = ""):
    def lines(d: dict) -> list[str]:
        told = [(k, (next((x[n] for n in names if x.get(n)), "") if isinstance(x, dict) else str(x) if not head == "" else "")) for k, x in enumerate(_many(d.get(key)), 1)]
        made = [line.format(k, t) for k, t in told if t]
        return [head, *made] if head and _many(d.get(key)) else made

    return lines


def _reviewed(d: dict) -> list[str]:
    r = d.get("reviewRating")
    return [f"Rating: {r['ratingValue']}"] if isinstance(r, dict) and r.get("ratingValue") else []


def _ingredients(d: dict) -> list[str]:
    found = d.get("recipeIngredient") or d.get("ingredients") or []
    return ["Ingredients:", *(f"  - {x}" for x in found)] if isinstance(found, list) and found else []


def _leaves(value: dict, depth: int = 0) -> list[str]:
    """Lines of the plain values of an item of any other type: three levels, ten items of a list, values of 1 to 500 characters."""
    if depth > 3:
        return []
    out = []
    for k, v in value.items():
        if k in ("@context", "@id", "potentialAction", "mainEntityOfPage", *LD_TITLES):
            continue
        for x in v[:10] if isinstance(v, list) else [v]:
            if isinstance(x, dict):
                out += _leaves(x, depth + 1)
            elif isinstance(x, (str, int, float)) and str(x).strip() and len(str(x)) <= 500:
                out.append(f"{k}: {x}")
    return out


#: For each kind of JSON-LD item, in the order in which its type is looked for, the lines that tell it: (label, key), or a function.
LD_TITLES = ("name", "headline", "title", "description", "about", "abstract")
LD_LINES = {
    ("product",): (("Brand", "brand"), ("SKU", "sku"), ("GTIN", "gtin"), ("MPN", "mpn"), _rating, ("URL", "url"), _image, _offers),
    ("recipe",): (*((k, k) for k in ("prepTime", "cookTime", "totalTime", "recipeYield")), _ingredients, _steps("recipeInstructions", "  {}. {}", "text", "name", head="Instructions:")),
    ("faqpage",): (_answers,),
    ("howto",): (("TotalTime", "totalTime"), _steps("step", "Step {}: {}", "name", "text")),
    ("event",): (*((k, k) for k in ("startDate", "endDate", "eventStatus", "eventAttendanceMode")), ("Location", "location"), ("Organizer", "organizer"), _offers),
    ("review",): (("ItemReviewed", "itemReviewed"), ("Author", "author"), _reviewed, ("Review", "reviewBody")),
    ("article", "newsarticle", "blogposting"): (
        ("Author", "author"), ("Publisher", "publisher"), *((k, k) for k in ("datePublished", "dateModified", "articleSection")), ("WordCount", "wordCount"), ("Keywords", "keywords"),
    ),
    ("person", "organization"): (("URL", "url"), lambda d: [f"SameAs: {x}" for x in _many(d.get("sameAs"))[:5]]),
}


def json_ld_item(item: dict) -> str:
    """An item as lines: its type, its titles, and what its kind has to tell."""
    kind = ", ".join(map(str, _many(item.get("@type"))))
    lines = [f"Type: {kind}"] * bool(kind) + [f"{k.title()}: {item[k]}" for k in LD_TITLES if item.get(k)]
    rules = next((r for names, r in LD_LINES.items() if any(n in kind.lower() for n in names)), (_leaves,))
    for rule in rules:
        if callable(rule):
            lines += rule(item)
        elif told := _named(item.get(rule[1])):
            lines.append(f"{rule[0]}: {told}")
    return "\n".join(lines + ([] if _offers in rules else _offers(item)))


def json_ld_products(value) -> list[dict]:
    """Product entities anywhere in lists and graphs."""
    out, stack = [], [value]
    while stack:
        x = stack.pop()
        if isinstance(x, list):
            stack.extend(reversed(x))
        elif isinstance(x, dict):
            kind = x.get("@type")
            if "Product" in (kind if isinstance(kind, list) else [kind]):
                offer = x.get("offers") or {}
                offer = offer[0] if isinstance(offer, list) and offer else offer
                offer = offer if isinstance(offer, dict) else {}
                as_text = lambda v: None if v in (None, "") else str(v)
                out.append({"name": as_text(x.get("name")), "description": as_text(x.get("description")), "price": as_text(offer.get("price")), "currency": as_text(offer.get("priceCurrency")), "sku": as_text(x.get("sku")), "url": as_text(x.get("url")), "entity_type": "product"})
            stack.extend(v for v in reversed(list(x.values())) if isinstance(v, (list, dict)))
    return out


def tolerant_json(text: str | None):
    """The first JSON value of a text: without code fences, with trailing commas dropped and what is cut off closed; None if there is none."""
    body = re.sub(r"^```(?:json)?\s*|\s*```$", "", (text or "").strip())
    start = re.search(r"[\[{]", body)
    if not start:
        return None
    body, closing, quoted, end, skip = body[start.start() :], [], False, None, False
    for k, c in enumerate(body):
        if skip:
            skip = False
        elif quoted:
            skip = c == "\\"
            quoted = c != '"'
        elif c == '"':
            quoted = True
        elif c in "[{":
            closing.append("]" if c == "[" else "}")
        elif c in "]}" and closing:
            closing.pop()
            if not closing:
                end = k + 1
                break
    whole = body[:end] if end else body + '"' * quoted + "".join(reversed(closing))
    for candidate in (whole, re.sub(r",\s*([\]}])", r"\1", whole), re.sub(r"[,:]\s*([\]}])", r"\1", whole)):
        try:
            return json.loads(candidate)
        except ValueError:
            pass
    return None


def page_signals(tree: Node, html: str, url: str, ld: list) -> dict:
    """The classifier's signals."""
    nodes = [x for x in tree.walk() if isinstance(x, Node)]
    part = lambda word, key="class": any(word in n.attrs.get(key, "") for n in nodes)
    word = lambda *names: any(x in n.classes() for n in nodes for x in names)
    types = {t for v in ld for x in _many(v) if isinstance(x, dict) for t in [x.get("@type")] if isinstance(t, str)}
    chars = len("".join(x[0].strip() for x in tree.walk() if isinstance(x, tuple)))
    return {
        "has_schema_product": "Product" in types, "has_schema_article": bool(types & {"Article", "BlogPosting"}), "has_schema_faq": "FAQPage" in types,
        "has_product_price": part("price") or any(n.attrs.get("itemprop") == "price" for n in nodes), "has_article_tag": bool(tree.find("article")),
        "has_code_blocks": any(p.find("code") for p in tree.find("pre")) or word("highlight", "code-block"), "has_table_of_contents": part("toc") or part("toc", "id") or word("table-of-contents"),
        "has_card_grid": part("grid") or part("cards"), "has_breadcrumbs": part("breadcrumb"),
        "has_data_table": any(t in n.classes() for n in tree.find("table") for t in ("price-table", "comparison-table", "features")), "has_pagination": part("pagination") or word("next", "prev"),
        **{k: any(p in url for p in parts) for k, parts in URL_PARTS.items()},
        "content_density": chars / max(len(html), 1), "link_density": len(tree.find("a")) / max(chars, 1),
    }


def spa_shell(tree: Node) -> bool:
    """An application's shell: an empty mount node; a rendered root with under 100 words; under 50 words and more than five scripts."""
    nodes = [x for x in tree.walk() if isinstance(x, Node)]
    for name in MOUNTS:
        first = next((n for n in nodes if n.attrs.get("id") == name), None)
        if first and not first.text():
            return True
    body = next(iter(tree.find("body")), None)
    words = len(body.text().split()) if body else 0
    return body is not None and (any("data-reactroot" in n.attrs for n in nodes) and words < 100 or words < 50 and len(tree.find("script")) > 5)


def page_struct(html: str | None, url: str | None = None) -> dict:
    from weft.operators.chunking import split_tokens

    tree = parse(html)
    meta = {}
    for m in tree.find("meta"):
        key = m.attrs.get("name") or m.attrs.get("property")
        if key and key.lower() not in meta:
            meta[key.lower()] = m.attrs.get("content", "")
    for node in tree.find("link"):
        if "canonical" in node.attrs.get("rel", "").lower().split():
            meta.setdefault("canonical", node.attrs.get("href", ""))
    meta.setdefault("lang", next((h.attrs.get("lang") for h in tree.find("html")), None) or "en")
    first = lambda tag: next((t for n in tree.find(tag) if (t := n.text())), "")
    title = first("title") or first("h1") or meta.get("og:title", "")
    shell = spa_shell(tree)
    root = _root(tree)
    heading, near = "", {}
    for x in tree.walk():
        if isinstance(x, Node):
            if x.tag in HEADINGS and (t := x.text()):
                heading = t
            near[id(x)] = heading
    tables = [(t, d) for t in root.find("table")[:MOST_TABLES] if (d := data_table(t))]
    lists = tree.find("ul", "ol")
    cards = [n for n in tree.walk() if isinstance(n, Node) and n.tag in ("div", "li", "article", "section") and (n.has_class("card") or n.has_class("product")) and not any(a.has_class("card") or a.has_class("product") for a in n.above())][:MOST_CARDS]
    if len(cards) <= 2:
        cards = []
    ld = [v for s in tree.find("script") if s.attrs.get("type") == "application/ld+json" and (v := tolerant_json("".join(c[0] for c in s.children if isinstance(c, tuple)))) is not None]
    data_attributes: dict[str, list[str]] = {}
    for x in tree.walk():
        if isinstance(x, Node):
            for k, v in x.attrs.items():
                if k.startswith("data-") and v:
                    data_attributes.setdefault(k, []).append(v)

    def card(n: Node) -> dict:
        name = next((t for h in n.find(*HEADINGS, "strong") if (t := h.text())), "")
        price = next((t for p in n.walk() if isinstance(p, Node) and p.has_class("price") and (t := p.text())), "") or (re.search(r"[$€£]\s*\d[\d.,]*", n.text()) or [""])[0]
        return {"name": name, "description": next((t for p in n.find("p") if (t := p.text())), ""), "price": price, "text": n.text(), "is_product": bool(price) or n.has_class("product")}

    body = [x[0].strip() for x in tree.walk() if isinstance(x, tuple) and x[0].strip() and not any(a.tag in NO_TEXT or a.tag in ("header", "footer", "nav", "head") for a in (x[1], *x[1].above()))]
    links = [h for a in tree.find("a") if (h := a.attrs.get("href", "").strip()) and not re.match(r"#|javascript:|mailto:", h, re.I)]
    data = {id(t) for t, _ in tables}
    name = title or "Untitled Page"
    found = [] if shell else richest([*prose_sections(root, name, data), *how_to_sections(tree, name), *card_sections(root, url or "", name)])
    told = meta.get("description", "").strip()
    if not shell and len(told) >= DESCRIPTION_CHARS and told not in "\n\n".join(x["content"] for x in found):
        found.append(_section("Page Description", [name, "Page Description"], told))
    for x in found:
        x["parts"] = split_tokens(x["content"])
    items = [x for v in ld for x in (v if isinstance(v, list) else [v]) if isinstance(x, dict)]
    return {
        "title": title, "page_type": "spa_shell" if shell else "sectioned", "words": len(" ".join(body).split()), "scripts": len(tree.find("script")), "main_text": "\n".join(body),
        "links": list(dict.fromkeys(links))[:MOST_LINKS], "signals": page_signals(tree, html or "", url or "", ld), "headings": [{"level": HEADINGS[h.tag], "text": h.text()} for h in tree.find(*HEADINGS)],
        "sections": found,
        "tables": [{"heading": near[id(t)], "headers": d[0], "rows": d[1], "row_texts": ["\n".join(c for c in r if c) for r in d[1]]} for t, d in tables],
        "lists": [{"type": "ordered" if n.tag == "ol" else "unordered", "heading": near[id(n)], "items": [t for li in n.kids("li") if (t := li.text())]} for n in lists],
        "cards": [card(n) for n in cards],
        "images": [{"src": i.attrs.get("src", ""), "alt": i.attrs.get("alt", ""), "heading": near[id(i)], "is_decorative": any(w in (i.attrs.get("src", "") + " " + i.attrs.get("alt", "")).lower() for w in DECORATIVE)} for i in tree.find("img")],
        "json_ld": "\n\n".join(t for x in items if (t := json_ld_item(x))), "entities": [e for v in ld for e in json_ld_products(v)], "meta": meta, "data_attributes": data_attributes,
    }


def parse_pages(pages: DataFrame, html: str = "html", out: str = "page", url: str | None = "url") -> DataFrame:
    """``pages`` with the parsed struct ``out`` in place of the html column: one Arrow pass, no text between. ``url``: column that tells the page's kind, if there is one."""
    ship_package(pages.sparkSession)
    rest = [c for c in pages.columns if c not in (html, out)]
    made = T.StructType.fromDDL(f"x {PAGE}")["x"].dataType
    kind, places = to_arrow_type(made), [f.name for f in made if isinstance(f.dataType, T.MapType)]
    at = rest.index(url) if url in rest else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urls = b.column(at).to_pylist() if at is not None else [None] * b.num_rows
            structs = [page_struct(h, u) for h, u in zip(b.column(len(rest)).to_pylist(), urls)]
            for x in structs:
                x.update({k: list(x[k].items()) for k in places})
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(structs, kind)], [*rest, out])

    schema = T.StructType([*(pages.schema[c] for c in rest), T.StructField(out, made)])
    return pages.select(*rest, html).mapInArrow(run, schema)


def needs_rendering(page: Column) -> Column:
    return page["page_type"] == "spa_shell"


def page_class(page: Column) -> Column:
    """The class with the most points; the first named of equals."""
    s = page["signals"]
    holds = {k: s[k] for k in SIGNALS}
    holds |= {"is_dense": s["content_density"] > 0.3, "grid_with_pagination": s["has_card_grid"] & s["has_pagination"], "grid_without_price": s["has_card_grid"] & ~s["has_product_price"]}
    scores = []
    for k, (name, points) in enumerate(CLASS_POINTS.items()):
        total = sum((F.when(holds[x], n).otherwise(0) for x, n in points.items()), F.lit(0))
        scores.append(F.struct(total.alias("score"), F.lit(-k).alias("place"), F.lit(name).alias("name")))
    return F.array_max(F.array(*scores))["name"]


#: Phrases of challenge pages and of pages that block.
CHALLENGES = (
    "cf-browser-verification", "challenge-platform", "turnstile.api", "cloudflare-challenge", "cf-chl-widget", "cf_captcha", "captcha-bypass",
    "checking your browser", "please wait while your request is being verified", "verify you are human", "cf_clearance", "just a moment", "cf-ray",
    "data-cf-beacon", "cf-turnstile",
)
BLOCK_PHRASES = (
    "request blocked", "access denied", "you have been blocked", "ip address blocked", "suspicious activity", "automated request",
    "our systems have detected", "unusual traffic", "ddos protection", "access to this page has been denied", "waf", "challenge", "please verify you are human",
)


def blocked(status: Column, html: Column, headers: Column | None = None) -> Column:
    """What stands in the way of a fetched page: denied, challenge, captcha, rate_limited, firewall, or null. headers: a map of strings."""
    page = F.coalesce(html, F.lit(""))
    low = F.lower(page)
    holds = lambda phrases: F.exists(F.array(*map(F.lit, phrases)), lambda p: low.contains(p))
    out = F.when(status.isin(401, 403), "denied").when(holds(CHALLENGES), "challenge").when(page.rlike(r"(?i)<[^>]*class=[\"'][^\"']*captcha[^\"']*[\"']"), "captcha")
    if headers is not None:
        low_headers = F.transform_values(F.transform_keys(headers, lambda k, _: F.lower(k)), lambda _, v: F.lower(v))
        of = lambda name: F.try_element_at(low_headers, F.lit(name))
        out = out.when(F.coalesce(of("x-ratelimit-remaining") == "0", F.lit(False)) | of("retry-after").isNotNull(), "rate_limited")
        out = out.when((of("x-amzn-waf-action") == "challenge") | (of("x-cache") == "error from cloudfront"), "firewall")
    return out.when(holds(BLOCK_PHRASES), "firewall")
