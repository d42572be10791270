"""Server-rendered markup as records: a page's elements that a selector finds, and in each the texts, links and records of others.

A selector is a small part of CSS: alternatives with commas, each a chain of descendants of tag, .class, [attribute], [attribute=value] and [attribute*=part]."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import escape, unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.html import text_of

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Markup whose elements are held at once, in characters; a longer page is read alone.
MOST_CHARS = 1_000_000
PART = re.compile(r"""\[([\w-]+)(?:(\*?=)['"]?([^'"\]]*)['"]?)?\]|([.]?[\w-]+)""")


@dataclass(frozen=True)
class Field:
    """The first element that css finds in its record (every: all of them, as an array): its words, its "html" as readable text, or an attribute."""

    css: str
    take: str = "text"
    every: bool = False

    @property
    def ddl(self) -> str:
        return "array<string>" if self.every else "string"

    @property
    def arrow(self) -> pa.DataType:
        return pa.list_(pa.string()) if self.every else pa.string()


@dataclass(frozen=True)
class Record:
    """All elements that css finds, each with its fields; own names attributes of the element itself."""

    css: str
    fields: dict[str, Field | Record]
    own: tuple[str, ...] = ()

    @property
    def struct(self) -> str:
        return "struct<" + ", ".join([f"{n}: {f.ddl}" for n, f in self.fields.items()] + [f"`@{a}`: string" for a in self.own]) + ">"

    @property
    def ddl(self) -> str:
        return f"array<{self.struct}>"

    @property
    def arrow(self) -> pa.DataType:
        return pa.list_(pa.struct([(n, f.arrow) for n, f in self.fields.items()] + [(f"@{a}", pa.string()) for a in self.own]))


def compiled(css: str) -> list[list[list[tuple[str, str, str]]]]:
    """Alternatives of chains of elements of (name, test, value)."""
    return [[[(a, op or "has", v) if a else (("class" if w[0] == "." else "tag"), "is", w.lstrip(".").lower() if w[0] != "." else w[1:]) for a, op, v, w in PART.findall(one)]
             for one in re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", chain)] for chain in css.split(",")]


def fits(element: tuple[str, dict], tests: list[tuple[str, str, str]]) -> bool:
    tag, attributes = element
    for name, test, value in tests:
        held = attributes.get(name)
        if test == "is":
            ok = tag == value if name == "tag" else value in (attributes.get("class") or "").split()
        else:
            ok = name in attributes if test == "has" else held == value if test == "=" else value in (held or "")
        if not ok:
            return False
    return True


def matches(stack: list[tuple[str, dict]], css) -> bool:
    """Whether the last element of the stack is what css finds; the others may be any of its ancestors."""
    for chain in css:
        if fits(stack[-1], chain[-1]):
            left = chain[:-1]
            for element in reversed(stack[:-1]):
                if left and fits(element, left[-1]):
                    left = left[:-1]
            if not left:
                return True
    return False


def filed(fields: dict[str, Field | Record], rules: dict[str, list]) -> dict[str, list[tuple]]:
    """Fields by the .class or the tag that an element must have to be found; those of attributes alone under ""."""
    out: dict[str, list[tuple]] = {}
    for name, f in fields.items():
        for chain in rules[f.css]:
            asked = {n: v for n, test, v in reversed(chain[-1]) if test == "is"}
            out.setdefault(f".{asked['class']}" if "class" in asked else asked.get("tag", ""), []).append((name, f, [chain]))
    return out


# Plain markup: start tags whose attributes are in double quotes or bare, end tags, text. All else is left to the parser of the standard library.
TOKEN = re.compile(r'<([a-zA-Z][a-zA-Z0-9-]*)((?:[ \t\n\r\f]+[a-zA-Z_][\w-]*(?:=(?:"[^"<>&]*"|[^\s"\'=<>`/&]+))?)*)[ \t\n\r\f]*>|</([a-zA-Z][a-zA-Z0-9-]*)>|([^<]+)', re.ASCII)
ATTRIBUTE = re.compile(r'([a-zA-Z_][\w-]*)(?:=(?:"([^"]*)"|([^\s"]+)))?', re.ASCII)
OWN_RULES = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext", "svg", "math"}


@dataclass
class _Open:
    """A record or a field's text that is being read, down to the depth at which its element lies."""

    depth: int
    values: dict | None = None
    fields: dict | None = None
    raw: bool = False
    parts: list[str] = field(default_factory=list)
    into: tuple[dict, str, bool] | None = None


class _Reader(HTMLParser):
    def __init__(self, root: dict[str, Field | Record], rules: dict[str, list], files: dict[int, dict]):
        super().__init__(convert_charrefs=True)
        self.rules, self.files, self.stack, self.values, self.told = rules, files, [], {}, ""
        self.records, self.texts = [self._record(root, -1, self.values)], []

    def updatepos(self, i, j):  # nobody asks for lines
        return j

    def _record(self, fields: dict, depth: int, values: dict) -> _Open:
        values |= {n: [] if isinstance(f, Record) or f.every else None for n, f in fields.items()}
        if id(fields) not in self.files:  # of records, which outlive their readers
            self.files[id(fields)] = filed(fields, self.rules)
        return _Open(depth, values, self.files[id(fields)])

    def handle_starttag(self, tag, attrs):
        attributes = dict(attrs)
        depth = len(self.stack)
        self.stack.append((tag, attributes))
        for o in self.texts:
            if o.raw:
                o.parts.append(self.told or self.get_starttag_text() or "")
        asked = ["", tag]
        if attributes.get("class"):
            asked += [f".{c}" for c in attributes["class"].split()]
        for o in self.records[:]:
            found = [x for a in asked if a in o.fields for x in o.fields[a]]
            seen = set()
            for name, f, css in found:
                if name in seen or not matches(self.stack, css):
                    continue
                seen.add(name)
                if isinstance(f, Record):
                    made = {f"@{a}": attributes.get(a) or "" for a in f.own}
                    o.values[name].append(made)
                    self.records.append(self._record(f.fields, depth, made))
                elif f.every or o.values[name] is None:
                    if f.take not in ("text", "html"):
                        self._put((o.values, name, f.every), attributes.get(f.take) or "")
                    else:
                        if not f.every:
                            o.values[name] = ""
                        self.texts.append(_Open(depth, raw=f.take == "html", into=(o.values, name, f.every)))
        if tag in VOID:
            self._close(depth)

    @staticmethod
    def _put(into: tuple[dict, str, bool], value: str) -> None:
        values, name, every = into
        if every:
            values[name].append(value)
        else:
            values[name] = value

    def _close(self, depth: int) -> None:
        del self.stack[depth:]
        while self.records and self.records[-1].depth >= depth:  # both are open in the order of their depths
            self.records.pop()
        at = len(self.texts)
        while at and self.texts[at - 1].depth >= depth:
            at -= 1
        closed, self.texts[at:] = self.texts[at:], []
        for o in closed:
            self._put(o.into, text_of("".join(o.parts)) if o.raw else " ".join(" ".join(o.parts).split()))

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag), None)
        if at is not None:
            for o in self.texts:
                if o.raw and o.depth < at:
                    o.parts.append(f"</{tag}>")
            self._close(at)

    def handle_data(self, data):
        for o in self.texts:
            o.parts.append(escape(data, quote=False) if o.raw else data)

    def _plainly(self, markup: str) -> bool:
        """Reads plain markup as feed() does, token by token; other markup is not touched."""
        tokens, end = [], 0
        for m in TOKEN.finditer(markup):
            if m.start() != end or (m[1] or "").lower() in OWN_RULES:
                return False
            tokens.append(m)
            end = m.end()
        if end != len(markup) or (tokens and tokens[-1][4] and "&" in tokens[-1][4]):
            return False
        for m in tokens:
            tag, attributes, closed, data = m.groups()
            if tag:
                self.told = m[0]
                self.handle_starttag(tag.lower(), [(k.lower(), q if q is not None else v) for k, q, v in (x.groups() for x in ATTRIBUTE.finditer(attributes))] if attributes else ())
            elif closed:
                self.handle_endtag(closed.lower())
            elif self.texts:
                self.handle_data(unescape(data) if "&" in data else data)
        return True

    def read(self, markup: str) -> dict:
        if not self._plainly(markup):
            self.feed(markup)
            self.close()
        self._close(0)
        return self.values


def _css(record: Record) -> set[str]:
    return {record.css}.union(*({f.css} if isinstance(f, Field) else _css(f) for f in record.fields.values()))


def elements(pages: DataFrame, html_col: str, record: Record, keep: list[str], place: str = "nth") -> DataFrame:
    """A row for each element of a page that record finds, in its order (place, from 0): the columns keep, place, the record's fields.

    What a page lacks is null, text is trimmed and has single spaces; null and unreadable markup has no elements."""
    rules = {css: compiled(css) for css in _css(record)}
    names = [*record.fields, *(f"@{a}" for a in record.own)]
    shown = [*record.fields, *(f"own_{a}" for a in record.own)]
    kinds = [*(f.arrow for f in record.fields.values()), *(pa.string() for _ in record.own)]
    root = {"all": record}

    def run(batches):
        files: dict[int, dict] = {}

        def made(batch, at, nth, found):
            kept = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(len(keep))]
            read = [pa.array([r[n] for r in found], k) for n, k in zip(names, kinds)]
            return pa.RecordBatch.from_arrays([*kept, pa.array(nth, pa.int32()), *read], names=[*keep, place, *shown])

        for batch in batches:  # as many rows as Spark likes, of any size: what they hold is given out piece by piece
            at, nth, found, chars = [], [], [], 0
            for k, markup in enumerate(batch.column(len(keep))):
                markup = markup.as_py() or ""
                for n, r in enumerate(_Reader(root, rules, files).read(markup)["all"]):
                    at.append(k)
                    nth.append(n)
                    found.append(r)
                chars += len(markup)
                if chars > MOST_CHARS:
                    yield made(batch, at, nth, found)
                    at, nth, found, chars = [], [], [], 0
            if found:
                yield made(batch, at, nth, found)

    told = T.StructType.fromDDL(", ".join([f"`{place}` int", *(f"`{n}` {f.ddl}" for n, f in record.fields.items()), *(f"`own_{a}` string" for a in record.own)]))
    asked = pages.select(*keep, F.col(html_col).alias("markup_"))
    return asked.mapInArrow(run, T.StructType([*asked.schema.fields[:-1], *told.fields]))


def cards(pages: DataFrame, key: str, html_col: str, card: str, fields: dict[str, str]) -> DataFrame:
    """key, and one column per field, of every element of class `card`. A field is a class, or class@attribute; what is missing is empty."""
    of = lambda c: Field("." + c.split("@")[0], c.partition("@")[2] or "text")
    found = elements(pages, html_col, Record("." + card, {n: of(c) for n, c in fields.items()}), [key])
    return found.select(key, *[F.coalesce(n, F.lit("")).alias(n) for n in fields])
