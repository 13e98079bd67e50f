"""One pass over stored HTML, and what the audits read from it (A4, C5-C7, C16, G6) and curricula's leaf tables (K2-K4).

The pass takes time and gives output in proportion to the page, however its markup is nested or broken: text is collected in pieces, only the innermost
table is read, and headings have places in one text of the page. It builds the columns that a reader asks for.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from siteq.functions import urls as U
from siteq.operators.text import clean, norm

LINK = "struct<pos: int, tag: string, href: string, text: string, download: boolean>"
FIELD = "struct<id: string, type: string, name: string, aria: boolean>"
CELL = "struct<text: string, colspan: int, header: boolean>"
#: What the pass can give of a page.
PARTS = {
    "base": "string", "lang": "string", "title": "string", "visible_text": "string", "links": f"array<{LINK}>", "images": "array<struct<src: string, alt: string>>", "h1_count": "int",
    "fields": f"array<{FIELD}>", "labels": "array<string>", "forms": "array<struct<action: string, method: string, n_fields: int, values: array<struct<name: string, value: string>>>>",
    "metas": "array<struct<name: string, content: string>>", "has_media_query": "boolean", "embeds": "array<string>",
    "tables": f"array<struct<idx: int, label: string, title: string, rows: array<array<{CELL}>>, refs: array<array<string>>, classes: array<string>>>",
    "spans": "array<struct<id: string, text: string>>", "options": "array<struct<field: string, value: string, label: string, selected: boolean>>",
    "marks": "array<struct<pos: int, last: int, tag: string, heading: boolean, links: boolean, label: string, text: string, refs: array<string>, deep_unit: string, deep_program: string>>",
}
# Elements that start a line of text, those inside a table, and elements whose text isn't shown.
BLOCKS = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "nav", "td", "th", "form", "option", "title", "caption"}
TABLE_PARTS = {"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}
HIDDEN = {"script", "style", "noscript", "template"}
# Attributes that lead somewhere.
REFS = ("href", "onclick", "data-url", "data-href", "value")
# Inputs that a browser sends no value of, and those that it sends only when they are checked.
UNSENT = {"submit", "button", "image", "reset", "file"}
CHECKED = {"checkbox", "radio"}
# Elements and class words of headings, what the addresses of units and programs hold, elements without an end tag.
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "strong", "b", "legend", "th", "optgroup"}
HEADING_CLASSES = ("title", "heading", "header", "baslik", "unit")
UNIT_REF = "unit="
UNIT_NUMBER, PROGRAM_NUMBER = re.compile(r"(?i)curUnit=([0-9]+)"), re.compile(r"(?i)curSunit=([0-9]+)")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SPACES = re.compile("[ \t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_MARKUP = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|[!?/])")
_COMMENT_END = re.compile("--!?>")
_GAP = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
#: In an attribute a name needs its semicolon, for addresses have parameters such as &copy=.
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;)")
#: Elements without elements inside, and their end tags.
RAW = {t: re.compile(rf"(?i)</{t}(?=[\s/>])") for t in ("script", "style", "title", "textarea")}
#: Characters of text of a mark that neither leads to a unit or program itself nor is the outermost one that does: more than any name has.
MARK_TEXT = 100
#: Spans with an id that stand in so many others aren't read.
SPAN_DEPTH = 16
#: Characters of HTML that a batch of results is made of.
BATCH_CHARS = 1 << 20
#: Pages of a batch that are Python objects at a time.
BATCH_PAGES = 256


def _refs(a: dict) -> list[str]:
    """The attributes that lead somewhere; a value only with a parameter."""
    if not a:
        return []
    found = [(k, a[k].strip()) for k in REFS if k in a]
    return [v for k, v in found if v and v != "#" and not v.startswith("javascript:void") and (k != "value" or "=" in v)]


def _span(text: str) -> int:
    """A colspan as browsers read it: digits from 1 to 1000, else 1."""
    return min(int(text), 1000) if text.isascii() and text.isdigit() and len(text) < 10 and int(text) else 1


class _Marks:
    """Headings and elements that lead to a unit or program.

    Text without needless spaces and references are counted once for the page; a mark keeps where it starts and ends in them. deep_unit and deep_program are the
    numbers in the first references within that name one; `last` is the last mark within. A mark ends with its element, with one that it stands in, or with the page.
    """

    def __init__(self):
        self.rows: list[dict] = []
        self.open: list[int] = []  # places in rows, rising
        self.elements: dict[str, list[int | None]] = defaultdict(list)  # open elements by tag: the place of a mark, or None
        self.text: list[str] = []
        self.size, self.spaced, self.in_head, self.leads = 0, True, False, 0
        self.n_refs, self.n_links = 0, 0
        self.found: dict[re.Pattern, tuple[list[int], list[str]]] = {UNIT_NUMBER: ([], []), PROGRAM_NUMBER: ([], [])}

    def start(self, tag: str, a: dict) -> None:
        self.in_head = tag == "head" or (self.in_head and tag != "body")
        if tag in ("option", "optgroup"):  # these end where the next one starts
            self.end("option")
        refs = _refs(a)
        if self.open and tag in BLOCKS:
            self.data("\n")
        own = any(UNIT_REF in r.lower() for r in refs)
        heading = tag in HEADINGS or ("class" in a and any(w in a["class"].lower() for w in HEADING_CLASSES))
        mark = not self.in_head and tag not in ("script", "style") and (heading or own)
        self.n_links += tag == "a" or bool(a.get("onclick"))
        first = self.n_refs
        for r in refs:
            for pattern, (places, numbers) in self.found.items():
                if m := pattern.search(r):
                    places.append(self.n_refs)
                    numbers.append(m[1])
            self.n_refs += 1
        place = None
        if mark:
            place = len(self.rows)
            leads = own and any(0 < len(m[1].lstrip("0")) < 19 for r in refs for p in self.found if (m := p.search(r)))
            whole = leads and not self.leads  # the outermost one
            self.rows.append({"pos": place, "last": place, "tag": tag, "heading": heading, "label": a.get("label", ""), "refs": refs, "at": self.size, "ref": first, "link": self.n_links, "leads": leads, "whole": whole})
            if tag not in VOID:
                self.open.append(place)
                self.leads += leads
            else:
                self.close(self.rows[place])
        if tag not in VOID:
            self.elements[tag].append(place)

    def end(self, tag: str) -> None:
        self.in_head &= tag != "head"
        if (stack := self.elements.get(tag)) and (place := stack.pop()) is not None:
            k = bisect_left(self.open, place)
            if k < len(self.open) and self.open[k] == place:
                self.cut(k)

    def cut(self, k: int) -> None:
        """Ends the open marks from the k-th on."""
        for place in self.open[k:]:
            self.leads -= self.rows[place]["leads"]
            self.close(self.rows[place])
        del self.open[k:]

    def close(self, row: dict) -> None:
        row["last"], row["end"] = len(self.rows) - 1, self.size
        row["links"] = self.n_links > row["link"]
        for name, pattern in (("deep_unit", UNIT_NUMBER), ("deep_program", PROGRAM_NUMBER)):
            places, numbers = self.found[pattern]
            k = bisect_left(places, row["ref"])
            row[name] = numbers[k] if k < len(places) else None

    def data(self, text: str) -> None:
        text = SPACES.sub(" ", text)
        if self.spaced and text[:1] == " ":
            text = text[1:]
        if text:
            self.text.append(text)
            self.size += len(text)
            self.spaced = text[-1] == " "

    def done(self) -> list[dict]:
        self.cut(0)
        text = "".join(self.text)
        for r in self.rows:
            r["text"] = text[r["at"] : r["end"] if r["whole"] else min(r["end"], r["at"] + MARK_TEXT)]
        return self.rows


class _Page:
    """Collects the parts that are wanted; broken markup is read as far as it goes."""

    def __init__(self, want: tuple[str, ...], unclosed: frozenset[str]):
        self.want, self.unclosed = frozenset(want), unclosed
        self.out: dict = {c: [] if kind.startswith("array") else None for c, kind in PARTS.items()} | {"h1_count": 0, "has_media_query": False}
        self.marks = _Marks() if "marks" in self.want else None
        self.lines = not self.want.isdisjoint(("visible_text", "spans"))
        self.text: list[str] = []
        self.hidden: list[str] = []
        self.in_title, self.title = False, None
        self.link = self.form = self.area = self.choice = self.option = None
        self.select = ""
        self.spans: list[dict | None] = []  # open spans, those that aren't read as None
        self.n_spans = 0
        self.tables: list[dict] = []
        self.line: list[str] = []
        self.last_line = ""

    def feed(self, html: str) -> None:
        """Tags and the text between, each character looked at a few times at most.

        A tag or comment that the page ends in is dropped; of an attribute that comes twice the first counts; script, style, title and textarea end at their end tag only.
        """
        at, n = 0, len(html)
        while m := _MARKUP.search(html, at):
            if m.start() > at:
                text = html[at : m.start()]
                self.data(unescape(text) if "&" in text else text)
            at = m.end()
            if (tag := m[2]) is None:
                if m[0] == "<!--" and not html.startswith((">", "->"), at):
                    end = _COMMENT_END.search(html, at)
                    at = end.end() if end else n
                else:
                    at = html.find(">", at) + 1 or n
                continue
            tag, attributes = tag.lower(), {}
            if html.startswith(">", at):
                at += 1
            else:
                while a := _ATTRIBUTE.match(html, at):
                    at = a.end()
                    if (name := a[1].lower()) not in attributes:
                        value = a[a.lastindex] if a.lastindex > 1 else ""
                        attributes[name] = _REFERENCE.sub(lambda r: unescape(r[0]), value) if "&" in value else value
                at = _GAP.match(html, at).end() + 1
                if at > n:
                    return
            if m[1]:
                self.end_tag(tag)
                continue
            self.start_tag(tag, attributes)
            if tag in RAW:
                end = RAW[tag].search(html, at)
                text = html[at : end.start() if end else n]
                if text:
                    self.data(text if tag in HIDDEN else unescape(text))
                at = end.start() if end else n
        if at < n:
            self.data(unescape(html[at:]))

    def start_tag(self, tag: str, a: dict[str, str]) -> None:
        o = self.out
        if self.marks:
            self.marks.start(tag, a)
        if tag in HIDDEN and tag not in self.unclosed:
            self.hidden.append(tag)
        t = self.tables[-1] if self.tables else None
        if a and t and t["open"] and tag != "tr":
            t["row_refs"] += _refs(a)
        if tag in BLOCKS:
            self.block()
        if tag in TABLE_PARTS:
            if t and not t["nested"]:
                self.table_part(t, tag, a)
        elif tag == "html":
            o["lang"] = a.get("lang") or o["lang"]
        elif tag == "base" and o["base"] is None:
            o["base"] = a.get("href")
        elif tag == "title":
            self.in_title = self.title is None
        elif tag in ("a", "area") and "href" in a:
            self.link = {"pos": len(o["links"]), "tag": tag, "href": a["href"], "text": [], "download": "download" in a}
            o["links"].append(self.link)
        elif tag == "img":
            o["images"].append({"src": a.get("src"), "alt": a.get("alt")})
        elif tag == "h1":
            o["h1_count"] += 1
        elif tag == "label" and a.get("for"):
            o["labels"].append(a["for"])
        elif tag == "meta":
            o["metas"].append({"name": a.get("name", "").lower(), "content": a.get("content")})
        elif tag in ("iframe", "embed", "object") and (a.get("src") or a.get("data")):
            o["embeds"].append(a.get("src") or a.get("data"))
        elif tag == "form":
            self.form = {"action": a.get("action", ""), "method": (a.get("method") or "get").lower(), "n_fields": 0, "values": [], "at": {}}
            o["forms"].append(self.form)
        elif tag in ("input", "select", "textarea"):
            o["fields"].append({"id": a.get("id"), "type": a.get("type", "text" if tag == "input" else tag).lower(), "name": a.get("name"), "aria": bool(a.get("aria-label") or a.get("aria-labelledby"))})
            if self.form is not None:
                self.form["n_fields"] += 1
                self.default(tag, a)
            if tag == "select":
                self.select = a.get("name", "")
        elif tag == "span":
            span = {"id": a["id"], "at": len(self.text), "end": None} if a.get("id") and self.n_spans < SPAN_DEPTH else None
            self.spans.append(span)
            if span:
                self.n_spans += 1
                o["spans"].append(span)
        elif tag == "option":
            self.option = {"field": self.select, "value": a.get("value", ""), "label": [], "selected": "selected" in a, "bare": "value" not in a}
            o["options"].append(self.option)
        elif tag == "table":
            if t:  # a table around others isn't read
                self.tables[-1] = {"nested": True, "open": False}
            self.tables.append({"label": self.last_line, "caption": None, "rows": [], "refs": [], "classes": [], "row_refs": [], "open": False, "nested": False, "cell": None, "head": False, "in_caption": False})

    def table_part(self, t: dict, tag: str, a: dict) -> None:
        if tag in ("td", "th"):
            if not t["rows"]:
                self.row(t, t["row_refs"], "")
            t["cell"] = {"text": [], "colspan": _span(a.get("colspan", "")) if a else 1, "header": tag == "th" or t["head"]}
            t["rows"][-1].append(t["cell"])
        elif tag == "tr":
            self.row(t, _refs(a), a.get("class", ""))
            t["open"], t["cell"] = True, None
        elif tag == "caption":
            t["caption"], t["in_caption"] = [], True
        else:
            t["head"] = tag == "thead"

    @staticmethod
    def row(t: dict, refs: list[str], classes: str) -> None:
        t["row_refs"] = refs
        t["rows"].append([])
        t["refs"].append(refs)
        t["classes"].append(classes)

    def block(self) -> None:
        """A line of text ends."""
        if self.lines:
            self.text.append("\n")
        if self.line:
            if line := "".join(self.line).strip():
                self.last_line = " ".join(line.split())
            self.line = []

    def sent(self, name: str, value) -> None:
        self.form["at"].setdefault(name, []).append(len(self.form["values"]))
        self.form["values"].append({"name": name, "value": value})

    def default(self, tag: str, a: dict) -> None:
        """What a browser would send of a field; select and textarea are known at their end."""
        name, kind = a.get("name", ""), a.get("type", "").lower()
        if not name:
            return
        if tag == "input" and kind not in UNSENT and (kind not in CHECKED or "checked" in a):
            self.sent(name, a.get("value", "on" if kind in CHECKED else ""))
        elif tag == "select":
            self.choice = (self.form, name, len(self.out["options"]))
        elif tag == "textarea":
            self.area = []
            self.sent(name, self.area)

    def chosen(self) -> None:
        """The selected option of the select that ends, or its first one with a value, in place of what its name had before."""
        form, name, start = self.choice
        options = [(" ".join("".join(o["label"]).split()) if o["bare"] else o["value"], o["selected"]) for o in self.out["options"][start:]]
        value = next((v for v, on in options if on), next((v for v, _ in options if v), ""))
        for k in form["at"].pop(name, ()):
            form["values"][k] = None
        form["at"][name] = [len(form["values"])]
        form["values"].append({"name": name, "value": value})
        self.choice = None

    def end_tag(self, tag: str) -> None:
        if self.marks:
            self.marks.end(tag)
        if self.hidden and tag == self.hidden[-1]:
            self.hidden.pop()
        if tag in BLOCKS:
            self.block()
        t = self.tables[-1] if self.tables else None
        if tag in TABLE_PARTS:
            if t and not t["nested"]:
                if tag in ("td", "th"):
                    t["cell"] = None
                elif tag == "tr":
                    t["open"] = False
                elif tag == "thead":
                    t["head"] = False
                elif tag == "caption":
                    t["in_caption"] = False
        elif tag == "title":
            self.in_title = False
        elif tag in ("a", "area"):
            self.link = None
        elif tag == "form":
            self.form = None
        elif tag == "textarea":
            self.area = None
        elif tag == "span":
            if self.spans and (span := self.spans.pop()):
                self.n_spans -= 1
                span["end"] = len(self.text)
        elif tag in ("option", "select"):
            self.option = None
            self.select = "" if tag == "select" else self.select
            if tag == "select" and self.choice:
                self.chosen()
        elif t and tag == "table":
            self.tables.pop()
            if not t["nested"]:
                self.leaf(t)

    def leaf(self, t: dict) -> None:
        rows, title = [[{**c, "text": " ".join("".join(c["text"]).split())} for c in r] for r in t["rows"]], ""
        if len(rows) > 1 and len(rows[0]) == 1 and rows[0][0]["colspan"] > 1:  # a first row over the whole width is the title
            title = rows[0][0]["text"]
            del rows[0], t["refs"][0], t["classes"][0]
        label = " ".join("".join(t["caption"] or ()).split()) or t["label"]
        self.out["tables"].append({"idx": len(self.out["tables"]), "label": label, "title": title, "rows": rows, "refs": t["refs"], "classes": t["classes"]})
        self.line, self.last_line = [], ""  # the next table's label is after this one

    def data(self, data: str) -> None:
        if self.in_title:
            self.title = self.title if self.title is not None else []
            self.title.append(data)
        if self.hidden:
            if self.hidden[-1] == "style" and "@media" in data:
                self.out["has_media_query"] = True
            return
        if not self.in_title:
            if self.lines:
                self.text.append(data)
            first, *more = data.split("\n") if "\n" in data else (data,)
            self.line.append(first)
            for x in more:
                if line := "".join(self.line).strip():
                    self.last_line = " ".join(line.split())
                self.line = [x]
        if self.link is not None:
            self.link["text"].append(data)
        if self.option is not None:
            self.option["label"].append(data)
        if self.area is not None:
            self.area.append(data)
        if self.marks and self.marks.open:
            self.marks.data(data)
        if self.tables:
            t = self.tables[-1]
            if not t["nested"]:
                if t["cell"] is not None:
                    t["cell"]["text"].append(data)
                elif t["in_caption"]:
                    t["caption"].append(data)

    def done(self) -> dict:
        o = self.out
        text = lambda x: "".join(x) if isinstance(x, list) else x
        o["title"] = text(self.title)
        for x in o["links"]:
            x["text"] = text(x["text"])
        for x in o["options"]:
            x["label"] = text(x["label"])
        for f in o["forms"]:
            f["values"] = [{"name": v["name"], "value": text(v["value"])} for v in f["values"] if v]
        if "spans" in self.want:
            for s in o["spans"]:
                s["text"] = text(self.text[s["at"] : s["end"]])
        if "visible_text" in self.want:
            o["visible_text"] = "\n".join(x for x in (" ".join(s.split()) for s in text(self.text).split("\n")) if x)
        if self.marks:
            o["marks"] = self.marks.done()
        return {c: o[c] for c in self.want}


def parse_page(html: str | None, *want: str) -> dict:
    """The wanted parts of a page, all without any. A null html is an empty page."""
    small = (html or "").lower()
    unclosed = frozenset(t for t in ("noscript", "template") if f"</{t}" not in small)  # hides nothing, for all of the page would be gone
    p = _Page(want or tuple(PARTS), unclosed)
    p.feed(html or "")
    return p.done()


def parse_pages(pages: DataFrame, *want: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each page (page_id, url, html) with the wanted parts, all without any, and the columns to carry. A null html is an empty page.

    Only what is asked for is built and leaves the task. Pages that come in fewer parts than there are cores, as from one file, are dealt out first.
    """
    spark = pages.sparkSession
    want = want or tuple(PARTS)
    rows = pages.select("page_id", "url", *carry, "html")
    schema = StructType([*rows.drop("html").schema.fields, *StructType.fromDDL(", ".join(f"{c} {PARTS[c]}" for c in want)).fields])
    if rows.rdd.getNumPartitions() < (cores := spark.sparkContext.defaultParallelism):
        rows = rows.repartition(cores)
    arrow = to_arrow_schema(schema)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, size = [], 0
            for start in range(0, batch.num_rows, BATCH_PAGES):
                for row in batch.slice(start, BATCH_PAGES).to_pylist():
                    html = row.pop("html")
                    part.append(row | parse_page(html, *want))
                    size += len(html or "")
                    if size > BATCH_CHARS:
                        yield pa.RecordBatch.from_pylist(part, arrow)
                        part, size = [], 0
            if part:
                yield pa.RecordBatch.from_pylist(part, arrow)

    return rows.mapInArrow(parsed, schema)


def page_links(parsed: DataFrame) -> DataFrame:
    """(page_id, pos, tag, href, text): anchors, areas and actions of GET forms, resolved against <base>."""
    get = F.transform(F.filter("forms", lambda f: (f["method"] == "get") & (f["action"] != "")), lambda f: F.struct(F.lit(-1).alias("pos"), F.lit("form").alias("tag"), f["action"].alias("href"), F.lit("").alias("text"), F.lit(False).alias("download")))
    base = F.coalesce(U.resolve(F.col("base"), F.col("url")), F.col("url"))
    return parsed.withColumn("_b", base).select("page_id", "_b", F.inline(F.concat("links", get))).select("page_id", "pos", "tag", "href", clean(F.col("text")).alias("text"), U.normalize_url(F.col("href"), F.col("_b")).alias("url"))


def accessibility(parsed: DataFrame) -> DataFrame:
    """Images and images without alt, headings, form fields without a label, language and title of each page."""
    bare = F.filter("images", lambda i: F.trim(F.coalesce(i["alt"], F.lit(""))) == "")
    unlabelled = F.filter("fields", lambda f: ~f["type"].isin("hidden", "submit", "button") & ~f["aria"] & ~F.coalesce(F.array_contains("labels", F.coalesce(f["id"], F.lit(""))), F.lit(False)))
    return parsed.select("page_id", F.size("images").alias("images_total"), F.size(bare).alias("images_without_alt"), "h1_count", (F.col("h1_count") == 0).alias("missing_h1"), (F.col("h1_count") > 1).alias("multiple_h1"), F.size(unlabelled).alias("unlabeled_form_fields"), (F.coalesce("lang", F.lit("")) != "").alias("has_lang"), clean(F.coalesce("title", F.lit(""))).alias("title"))


def forms(parsed: DataFrame) -> DataFrame:
    return parsed.select("page_id", F.inline("forms")).drop("values")


def form_defaults(parsed: DataFrame) -> DataFrame:
    """(page_id, form, action, pos, name, value): what a browser would send of each form as it stands, in document order."""
    rows = parsed.select("page_id", F.posexplode("forms").alias("form", "f"))
    return rows.select("page_id", "form", "f.action", F.posexplode("f.values").alias("pos", "v")).select("page_id", "form", "action", "pos", "v.name", "v.value")


def responsive(parsed: DataFrame) -> DataFrame:
    return parsed.select("page_id", F.exists("metas", lambda m: m["name"] == "viewport").alias("has_viewport_meta"), F.col("has_media_query").alias("has_media_queries"))


def document_refs(parsed: DataFrame) -> DataFrame:
    """(page_id, url, source, text): links with download or a document ending, file: links, and embedded documents."""
    ends = lambda h: U.ends_with_any(F.lower(F.regexp_replace(h, "[?#].*$", "")), U.DOCUMENT_ENDINGS)
    links = F.filter("links", lambda x: x["download"] | ends(x["href"]) | F.lower(x["href"]).startswith("file:"))
    rows = F.transform(links, lambda x: F.struct(x["href"].alias("url"), F.when(F.lower(x["href"]).startswith("file:"), "dom(file:)").otherwise("dom").alias("source"), x["text"].alias("text")))
    inside = F.transform(F.filter("embeds", ends), lambda e: F.struct(e.alias("url"), F.lit("dom").alias("source"), F.lit("(gomulu icerik)").alias("text")))
    return parsed.select("page_id", F.inline(F.concat(rows, inside)))


def visible_text(parsed: DataFrame) -> DataFrame:
    return parsed.select("page_id", "visible_text")


def html_tables(parsed: DataFrame) -> DataFrame:
    """(page_id, idx, label, title, rows, refs, classes): the tables without tables inside, in document order.

    label is the caption or the last line before the table, title a first row that spans the table; refs and classes go by row.
    """
    return parsed.select("page_id", F.inline("tables"))


def table_kv(tables: DataFrame) -> DataFrame:
    """(page_id, idx, key, value): rows of two or four cells read as pairs; a colon at the end of a key is dropped."""
    pair = lambda r, k: F.struct(F.regexp_replace(F.get(r, F.lit(k))["text"], r"\s*:\s*$", "").alias("key"), F.get(r, F.lit(k + 1))["text"].alias("value"))
    pairs = F.flatten(F.transform("rows", lambda r: F.when(F.size(r) == 2, F.array(pair(r, 0))).when(F.size(r) == 4, F.array(pair(r, 0), pair(r, 2))).otherwise(F.array().cast("array<struct<key: string, value: string>>"))))
    return tables.select("page_id", "idx", F.inline(F.filter(pairs, lambda p: p["key"] != "")))


def table_headers(tables: DataFrame, words: list[str]) -> DataFrame:
    """(page_id, idx, row, col, header): the first of a table's first four rows with a cell that holds one of the words, folded."""
    hit = lambda c: U.any_of(norm(c["text"]).contains(w) for w in words)
    at = F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.lit(-1), lambda acc, i: F.when((acc < 0) & F.coalesce(F.exists(F.get("rows", i), hit), F.lit(False)), i).otherwise(acc))
    return tables.withColumn("row", at).where("row >= 0").select("page_id", "idx", "row", F.posexplode(F.get("rows", F.col("row"))).alias("col", "c")).select("page_id", "idx", "row", "col", norm(F.col("c.text")).alias("header"))


def numbered_items(text: Column, most: int = 60) -> Column:
    """Items 1, 2, 3 ... of a text such as `1. Analiz eder. 2) Tasarlar`: consecutive numbers only, null below two. The last ends at a line end."""
    parts = F.regexp_extract_all(F.concat(F.lit(" "), text), F.lit(r"(?<=[\s])([0-9]{1,2})[.)](?=\s)"), F.lit(1))
    spots = F.split(F.concat(F.lit(" "), text), r"(?<=[\s])[0-9]{1,2}[.)](?=\s)")
    found = F.struct(parts.alias("parts"), spots.alias("spots"))
    return U.let(found, lambda x: U.let(_items(x["parts"], x["spots"], most), lambda items: _described(items)))


def _items(parts: Column, spots: Column, most: int) -> Column:
    """The first items; what comes after the one that follows them changes none."""
    step = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))),
        F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("items")),
        lambda acc, i: F.when(acc["n"] > most, acc).when(
            F.get(parts, i - 1).cast("int") == acc["n"] + 1, F.struct((acc["n"] + 1).alias("n"), F.concat(acc["items"], F.array(F.get(spots, i))).alias("items"))
        ).when(
            F.size(acc["items"]) > 0,
            F.struct(acc["n"].alias("n"), F.concat(F.slice(acc["items"], 1, F.size(acc["items"]) - 1), F.array(F.concat(F.element_at(acc["items"], -1), F.coalesce(F.get(parts, i - 1), F.lit("")), F.lit("."), F.coalesce(F.get(spots, i), F.lit(""))))).alias("items")),
        ).otherwise(acc),
    )
    return F.slice(step["items"], 1, most)


def _described(items: Column) -> Column:
    last = F.regexp_replace(F.element_at(items, -1), r"(?s)\n.*$", "")
    done = F.transform(F.concat(F.slice(items, 1, F.size(items) - 1), F.array(last)), lambda s: F.regexp_replace(clean(s), r"[.]$", ""))
    return F.when(F.size(items) >= 2, done)
