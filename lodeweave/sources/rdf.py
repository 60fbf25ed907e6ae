"""Readers and writers of triple files: N-Triples, N-Quads, TSV, Turtle, TriG, RDF/XML, TriX, JSON-LD, SQL dumps, parquet."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import quote, urljoin

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions.matching import TERM_TYPE, interval_term, printed, printed_uri, term

QUADS = f"s string, p string, o {TERM_TYPE}, g string"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
#: Suffixes of formats and of compressions.
FORMATS = {"nt": "nt", "nq": "nq", "ttl": "ttl", "trig": "trig", "rdf": "rdfxml", "xml": "rdfxml", "owl": "rdfxml", "trix": "trix", "jsonld": "jsonld", "json": "jsonld", "tsv": "tsv", "sql": "sql", "cache": "parquet", "parquet": "parquet"}
COMPRESSIONS = {"gz": "gzip", "bz2": "bzip2"}
#: Prefixes that TSV literals may use.
TSV_PREFIXES = {"rdf": RDF, "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "xsd": XSD, "owl": "http://www.w3.org/2002/07/owl#"}
#: Numeric datatypes.
_NUMBERS = {XSD + t for t in ("integer", "int", "long", "short", "byte", "decimal", "double", "float", "nonNegativeInteger", "positiveInteger", "negativeInteger", "nonPositiveInteger", "unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte")}
#: Letters of escapes.
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}
_INTERVAL = re.compile(r"^\s*([\[(])\s*([-+.\deE]+)\s*;\s*([-+.\deE]+)\s*([\])])\s*$")


def format_of(path: str) -> tuple[str, str | None]:
    """(format, compression) by the last suffix, or the last two if the file is compressed."""
    parts = path.lower().rsplit("/", 1)[-1].split(".")
    packed = COMPRESSIONS.get(parts[-1])
    suffix = parts[-2] if packed and len(parts) > 1 else parts[-1]
    if suffix not in FORMATS:
        raise ValueError(f"unknown format: {path}")
    return FORMATS[suffix], packed


def literal(text: str, datatype: str | None = None) -> tuple:
    """A term (kind, value, num, lo, hi, lo_open, hi_open) from a lexical form and its datatype."""
    if datatype in _NUMBERS:
        try:
            return ("number", text, float(text.replace("INF", "inf")), None, None, None, None)
        except ValueError:
            pass
    if datatype == XSD + "boolean" and text in ("true", "false", "1", "0"):
        return ("boolean", "true" if text in ("true", "1") else "false", None, None, None, None, None)
    if m := _INTERVAL.match(text):
        try:
            return ("interval", text, None, float(m[2]), float(m[3]), m[1] == "(", m[4] == ")")
        except ValueError:
            pass
    return ("text", text, None, None, None, None, None)


def resource(name: str) -> tuple:
    return ("bnode" if name.startswith("_:") else "uri", name, None, None, None, None, None)


#: A pair of surrogates, one escape, or a stretch without any.
_PIECES = r"(\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}|\\[^uU]|\\|[^\\]+)"


def _unescaped(c: Column) -> Column:
    """Escapes replaced in one pass from left to right, so that an escaped backslash starts no other. What is no character (a lone
    surrogate, a number beyond the last one) becomes U+FFFD."""
    utf16 = lambda digits: F.decode(F.unhex(digits), "UTF-16BE")

    def plain(x: Column) -> Column:
        digits = F.regexp_replace(x, r"\\[uU]", "")
        lone = x.rlike(r"^\\u[dD][89a-fA-F]")
        point = F.conv(digits, 16, 10).cast("long")
        high = F.hex((F.lit(0xD800) + F.floor((point - 0x10000) / 1024)).cast("long"))
        low = F.hex((F.lit(0xDC00) + F.pmod(point - 0x10000, F.lit(1024))).cast("long"))
        out = F.when(F.length(x) == 12, utf16(digits)).when(lone, F.lit("\ufffd")).when(x.startswith("\\u") & (F.length(x) == 6), utf16(digits))
        wide = F.when((point > 0x10FFFF) | point.between(0xD800, 0xDFFF), F.lit("\ufffd")).when(point > 0xFFFF, utf16(F.concat(high, low))).otherwise(utf16(F.substring(digits, 5, 4)))
        out = out.when(x.startswith("\\U") & (F.length(x) == 10), wide)
        for letter, char in _ESCAPES.items():
            out = out.when(x == "\\" + letter, F.lit(char))
        return out.when(x.startswith("\\") & (F.length(x) == 2), F.substring(x, 2, 1)).otherwise(x)

    return F.when(c.contains("\\"), F.array_join(F.transform(F.regexp_extract_all(c, F.lit(_PIECES), F.lit(0)), plain), "")).otherwise(c)


def _literal_column(text: Column, datatype: Column) -> Column:
    num = F.replace(text, F.lit("INF"), F.lit("Infinity")).try_cast("double")
    m = lambda k: F.regexp_extract(text, r"^\s*([\[(])\s*([-+.\deE]+)\s*;\s*([-+.\deE]+)\s*([\])])\s*$", k)
    iv = interval_term(m(2).try_cast("double"), m(3).try_cast("double"), m(1) == "(", m(4) == ")")
    number = datatype.isin(sorted(_NUMBERS)) & num.isNotNull()
    boolean = (datatype == XSD + "boolean") & text.isin("true", "false", "1", "0")
    out = F.when(number, term("number", text, num)).when(boolean, term("boolean", F.when(text.isin("true", "1"), "true").otherwise("false")))
    return out.when(m(2).try_cast("double").isNotNull() & m(3).try_cast("double").isNotNull(), iv).otherwise(term("text", text))


_IRI = r"<[^>]*>"
_BNODE = r"_:[\p{L}\p{N}_:](?:[\p{L}\p{N}_:·.-]*[\p{L}\p{N}_:·-])?"
_TEXT = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_NQ = rf"^\s*({_IRI}|{_BNODE})\s*({_IRI})\s*({_IRI}|{_BNODE}|{_TEXT}(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^{_IRI})?)\s*({_IRI}|{_BNODE})?\s*\.\s*(?:#.*)?$"


def read_lines(spark: SparkSession, path: str, quads: bool) -> DataFrame:
    """N-Triples or N-Quads, line by line, so that large files are split. Lines of another form are left out; ``rejected_lines`` has them."""
    v = F.col("value")
    part = lambda k: F.regexp_extract(v, _NQ, k)
    bare = lambda c: F.when(c.startswith("<"), _unescaped(F.regexp_extract(c, "^<(.*)>$", 1))).otherwise(c)
    o = part(3)
    text = _unescaped(F.regexp_extract(o, f"^{_TEXT}", 0).substr(F.lit(2), F.length(F.regexp_extract(o, f"^{_TEXT}", 0)) - 2))
    datatype = F.regexp_extract(o, r"\^\^<([^>]*)>$", 1)
    obj = F.when(o.startswith('"'), _literal_column(text, datatype)).when(o.startswith("_:"), term("bnode", o)).otherwise(term("uri", bare(o)))
    return spark.read.text(path).where(v.rlike(_NQ)).select(bare(part(1)).alias("s"), bare(part(2)).alias("p"), obj.alias("o"), (bare(part(4)) if quads else F.lit("")).alias("g"))


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """(``value``): the lines of an N-Triples or N-Quads file that hold something else than a statement, a comment or blanks."""
    v = F.col("value")
    return spark.read.text(path).where(~v.rlike(_NQ) & ~v.rlike(r"^\s*(?:#.*)?$"))


def read_tsv(spark: SparkSession, path: str, mode: str = "raw") -> DataFrame:
    """Lines of three tab-separated fields, a final dot stripped; others are left out.

    ``mode``: raw (all are URIs as written), parsed_uris (``<...>`` and known prefixes resolved), parsed_literals (objects
    may also be quoted texts, typed literals and numbers).
    """
    f = F.split(F.col("value"), "\t")
    rows = spark.read.text(path).select(f.alias("f")).where(F.size("f") == 3)
    s, p = F.trim(F.get("f", F.lit(0))), F.trim(F.get("f", F.lit(1)))
    o = F.trim(F.regexp_replace(F.get("f", F.lit(2)), r"\s*\.\s*$", ""))
    if mode == "raw":
        return rows.select(s.alias("s"), p.alias("p"), term("uri", o).alias("o"), F.lit("").alias("g"))

    def uri(c: Column) -> Column:
        out = F.when(c.rlike("^<.*>$"), F.regexp_extract(c, "^<(.*)>$", 1))
        for prefix, ns in TSV_PREFIXES.items():
            out = out.when(c.startswith(prefix + ":"), F.concat(F.lit(ns), F.substring_index(c, ":", -1)))
        return out.otherwise(c)

    kind = lambda c: F.when(c.startswith("_:"), "bnode").otherwise("uri")
    obj = term(kind(o), uri(o))
    if mode == "parsed_literals":
        quoted_part = F.regexp_extract(o, f"^{_TEXT}", 0)
        text = _unescaped(quoted_part.substr(F.lit(2), F.length(quoted_part) - 2))
        number = o.try_cast("double")
        typed = F.regexp_extract(o, r'"\^\^(\S+)$', 1)
        quoted = F.when((typed != "") & text.try_cast("double").isNotNull(), term("number", text, text.try_cast("double"))).otherwise(_literal_column(text, uri(typed)))
        prefixed = F.lit(False)
        for prefix in (*TSV_PREFIXES, "_"):
            prefixed = prefixed | o.startswith(prefix + ":")
        obj = F.when(o.rlike("^<.*>$"), obj).when(o.rlike(f"^{_TEXT}"), quoted).when(prefixed, obj).when(number.isNotNull(), term("number", o, number)).otherwise(obj)
    return rows.select(uri(s).alias("s"), uri(p).alias("p"), obj.alias("o"), F.lit("").alias("g"))


_TTL_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)|(?P<text>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)|(?P<number>[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?(?=[\s;,.)\]]|$))|(?P<name>(?:[\w-]*(?:\.[\w-]+)*:(?:[\w:%\\-]|\.(?=[\w:%\\-]))*)|_:[\w.-]*\w)|(?P<word>[A-Za-z]+)|(?P<mark>[\[\](){};,.=])""",
    re.S,
)


def _plain_text(s: str) -> str:
    body = s[3:-3] if s[:3] in ('"""', "'''") else s[1:-1]
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES.get(m[3], m[3]), body, flags=re.S)


class Turtle:
    """Turtle and TriG by recursive descent; ``prefixes`` are those declared."""

    def __init__(self, text: str, base: str = ""):
        self.tokens = [(m.lastgroup, m[0]) for m in _TTL_TOKEN.finditer(text) if m.lastgroup]
        self.at, self.base, self.prefixes, self.n, self.graph = 0, base, {}, 0, ""
        self.quads: list[tuple] = []

    def _next(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise ValueError("file ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def _peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def _take(self, mark: str) -> bool:
        hit = self._peek() == mark
        self.at += hit
        return hit

    def _blank(self) -> str:
        self.n += 1
        return f"_:gen{self.n}"

    def parse(self) -> list[tuple]:
        while self.at < len(self.tokens):
            word = self._peek().lower()
            if word in ("@prefix", "prefix", "@base", "base"):
                self.at += 1
                if word.endswith("prefix"):
                    name = self._next()[1]
                    self.prefixes[name.rstrip(":") if name != ":" else ""] = urljoin(self.base, self._next()[1][1:-1])
                else:
                    self.base = urljoin(self.base, self._next()[1][1:-1])
                self._take(".")
            elif word == "graph" or word == "{":
                self.at += word == "graph"
                self._block("" if self._peek() == "{" else self._node()[1])
            elif self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] == "{":
                self._block(self._node()[1])
            else:
                self._statement()
                self._take(".")
        return self.quads

    def _block(self, graph: str) -> None:
        self.graph = graph
        self._take("{")
        while not self._take("}"):
            self._statement()
            self._take(".")
        self.graph = ""

    def _statement(self) -> None:
        alone = self._peek() == "["
        s = self._node()[1]
        if not (alone and self._peek() in (".", "}")):
            self._properties(s)

    def _properties(self, s: str) -> None:
        while True:
            kind, text = self._next()
            p = RDF + "type" if (kind, text) == ("word", "a") else self._name(kind, text)
            while True:
                self.quads.append((s, p, self._node(), self.graph))
                if not self._take(","):
                    break
            if not self._take(";"):
                return
            while self._take(";"):
                pass
            if self._peek() in (".", "]", "}", ""):
                return

    def _name(self, kind: str, text: str) -> str:
        if kind == "iri":
            return urljoin(self.base, text[1:-1]) if self.base else text[1:-1]
        if kind == "name":
            if text.startswith("_:"):
                return text
            prefix, local = text.split(":", 1)
            if prefix not in self.prefixes:
                raise ValueError(f"unknown prefix {prefix!r}")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise ValueError(f"unexpected {text!r}")

    def _node(self) -> tuple:
        kind, text = self._next()
        if text == "[":
            b = self._blank()
            if not self._take("]"):
                self._properties(b)
                self._take("]")
            return resource(b)
        if text == "(":
            items = []
            while not self._take(")"):
                items.append(self._node())
            nodes = [self._blank() for _ in items] + [RDF + "nil"]
            for i, x in enumerate(items):
                self.quads += [(nodes[i], RDF + "first", x, self.graph), (nodes[i], RDF + "rest", resource(nodes[i + 1]), self.graph)]
            return resource(nodes[0])
        if kind == "text":
            value = _plain_text(text)
            if self._take("^^"):
                return literal(value, self._name(*self._next()))
            if self.at < len(self.tokens) and self.tokens[self.at][0] == "lang":
                self.at += 1
            return literal(value)
        if kind == "number":
            return literal(text, XSD + "double")
        if kind == "word" and text in ("true", "false"):
            return literal(text, XSD + "boolean")
        return resource(self._name(kind, text))


def _rdf_xml(text: str) -> Iterator[tuple]:
    count = 0
    xml_base = "{http://www.w3.org/XML/1998/namespace}base"

    def uri(tag: str) -> str:
        return tag[1:].replace("}", "") if tag.startswith("{") else tag

    def node(e: ET.Element, base: str) -> Iterator[tuple]:
        nonlocal count
        base = e.get(xml_base, base)
        r = f"{{{RDF}}}"
        if (about := e.get(r + "about")) is not None:
            s = urljoin(base, about)
        elif e.get(r + "ID"):
            s = f"{base}#{e.get(r + 'ID')}"
        elif e.get(r + "nodeID"):
            s = "_:" + e.get(r + "nodeID")
        else:
            count += 1
            s = f"_:gen{count}"
        e.set("_subject", s)
        if e.tag != r + "Description":
            yield (s, RDF + "type", resource(uri(e.tag)), "")
        for k, v in e.attrib.items():
            if k.startswith("{") and not k.startswith((r, "{http://www.w3.org/XML/")):
                yield (s, uri(k), literal(v), "")
        for i, c in enumerate(e):
            p = RDF + f"_{i + 1}" if c.tag == r + "li" else uri(c.tag)
            if c.get(r + "resource") is not None:
                yield (s, p, resource(urljoin(base, c.get(r + "resource"))), "")
            elif c.get(r + "nodeID"):
                yield (s, p, resource("_:" + c.get(r + "nodeID")), "")
            elif c.get(r + "parseType") == "Resource":
                inner = ET.Element(r + "Description")
                inner.extend(list(c))
                yield from node(inner, base)
                yield (s, p, resource(inner.get("_subject")), "")
            elif len(c):
                kids = list(c)
                for kid in kids:
                    yield from node(kid, base)
                if c.get(r + "parseType") == "Collection":
                    names = []
                    for _ in kids:
                        count += 1
                        names.append(f"_:gen{count}")
                    names.append(RDF + "nil")
                    yield (s, p, resource(names[0]), "")
                    for i2, kid in enumerate(kids):
                        yield (names[i2], RDF + "first", resource(kid.get("_subject")), "")
                        yield (names[i2], RDF + "rest", resource(names[i2 + 1]), "")
                else:
                    for kid in kids:
                        yield (s, p, resource(kid.get("_subject")), "")
            else:
                yield (s, p, literal(c.text or "", c.get(r + "datatype")), "")

    root = ET.fromstring(text)
    base = root.get(xml_base, "")
    for e in list(root) if root.tag == f"{{{RDF}}}RDF" else [root]:
        yield from node(e, base)


def _trix(text: str) -> Iterator[tuple]:
    def part(e: ET.Element) -> tuple:
        tag = e.tag.split("}")[-1]
        value = (e.text or "").strip() if tag in ("uri", "id") else e.text or ""
        return resource("_:" + value if tag == "id" else value) if tag in ("uri", "id") else literal(value, e.get("datatype"))

    for graph in ET.fromstring(text).iter():
        if graph.tag.split("}")[-1] != "graph":
            continue
        name = next(((c.text or "").strip() for c in graph if c.tag.split("}")[-1] == "uri"), "")
        for t in graph:
            if t.tag.split("}")[-1] == "triple":
                s, p, o = (part(x) for x in t)
                yield (s[1], p[1], o, name)


def _json_ld(text: str) -> Iterator[tuple]:
    """Flattened and compacted JSON-LD with a local context: @id, @type, @value, @list, @graph, nested nodes."""
    doc = json.loads(text)
    count = 0

    def expand(name: str, ctx: dict) -> str:
        v = ctx.get(name)
        v = v.get("@id") if isinstance(v, dict) else v
        if v and v != name:
            return expand(v, ctx)
        if ":" in name and not name.startswith("_:"):
            prefix, local = name.split(":", 1)
            if prefix in ctx and not local.startswith("//"):
                return expand(prefix, ctx) + local
            return name
        return name if name.startswith("_:") else ctx.get("@vocab", "") + name

    def walk(x, ctx: dict, graph: str) -> Iterator[tuple]:
        nonlocal count
        for n in x if isinstance(x, list) else [x]:
            own = ctx | (n.get("@context") or {}) if isinstance(n.get("@context", {}), dict) else ctx
            ident = n.get("@id")
            if ident is None and "@graph" in n:
                yield from walk(n["@graph"], own, graph)
                continue
            if ident is None:
                count += 1
                ident = f"_:gen{count}"
                n["@id"] = ident
            s = expand(ident, own) if ":" in ident else urljoin(own.get("@base", ""), ident)
            if "@graph" in n:
                yield from walk(n["@graph"], own, s)
            for k, v in n.items():
                if k in ("@context", "@id", "@graph"):
                    continue
                defined = own.get(k) if isinstance(own.get(k), dict) else {}
                for one in v if isinstance(v, list) else [v]:
                    if k == "@type":
                        yield (s, RDF + "type", resource(expand(one, own)), graph)
                        continue
                    p = expand(k, own)
                    if isinstance(one, dict) and "@value" in one:
                        value = one["@value"]
                        yield (s, p, _json_value(value, one.get("@type") and expand(one["@type"], own)), graph)
                    elif isinstance(one, dict):
                        yield from walk(one, own, graph) if set(one) - {"@id"} else ()
                        yield (s, p, resource(expand(one["@id"], own)), graph)
                    elif defined.get("@type") == "@id":
                        yield (s, p, resource(expand(one, own)), graph)
                    else:
                        yield (s, p, _json_value(one, defined.get("@type") and expand(defined["@type"], own)), graph)

    yield from walk(doc, {}, "")


def _json_value(v, datatype: str | None) -> tuple:
    if isinstance(v, bool):
        return literal("true" if v else "false", XSD + "boolean")
    if isinstance(v, (int, float)):
        return literal(str(v), XSD + "double")
    return literal(str(v), datatype or None)


_CREATE = re.compile(r"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[`\"\[]?([\w.]+)[`\"\]]?\s*\((.*?)\)\s*(?:ENGINE[^;]*|WITHOUT\s+ROWID)?;", re.I | re.S)
_INSERT = re.compile(r"INSERT\s+INTO\s+[`\"\[]?([\w.]+)[`\"\]]?\s*(?:\(([^)]*)\))?\s*VALUES\s*", re.I)
_KEY = re.compile(r"PRIMARY\s+KEY\s*\(\s*[`\"]?(\w+)", re.I)
_FOREIGN = re.compile(r"FOREIGN\s+KEY\s*(?:\w+\s*)?\(\s*[`\"]?(\w+)[`\"]?[^)]*\)\s*REFERENCES\s+[`\"]?(\w+)[`\"]?\s*\(\s*[`\"]?(\w+)", re.I)
_INLINE = re.compile(r"REFERENCES\s+[`\"]?(\w+)[`\"]?\s*\(\s*[`\"]?(\w+)", re.I)
_NUMERIC = re.compile(r"^(?:tiny|small|medium|big)?int|^integer|^float|^double|^decimal|^numeric|^real", re.I)


def _pieces(text: str) -> list[str]:
    """Parts between commas outside of brackets and quotes."""
    out, depth, quoted, part, i = [], 0, "", "", 0
    while i < len(text):
        c = text[i]
        if quoted:
            if c == "\\" and i + 1 < len(text):
                part += c + text[i + 1]
                i += 2
                continue
            if c == quoted:
                quoted = ""
        elif c in "'\"`":
            quoted = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "," and not depth:
            out.append(part.strip())
            part, i = "", i + 1
            continue
        part += c
        i += 1
    return [*out, part.strip()] if part.strip() else out


def _sql_value(v: str) -> str | None:
    if v.upper() == "NULL":
        return None
    if v[:1] in "'\"":
        return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), v[1:-1].replace(v[0] * 2, v[0]))
    return v


def _sql_dump(text: str) -> Iterator[tuple]:
    """CREATE TABLE and INSERT statements as triples; rows without primary key give nothing."""
    tables: dict[str, dict] = {}
    for m in _CREATE.finditer(text):
        cols, types, key, foreign = [], {}, None, {}
        for part in _pieces(m[2]):
            if re.match(r"(?:CONSTRAINT\s+\S+\s+)?(?:PRIMARY|FOREIGN|UNIQUE|KEY|INDEX|CHECK|FULLTEXT)\b", part, re.I):
                if k := _KEY.search(part):
                    key = k[1]
                if f := _FOREIGN.search(part):
                    foreign[f[1]] = (f[2], f[3])
                continue
            name, *rest = part.split(None, 1)
            name, kind = name.strip("`\"[]"), rest[0] if rest else "text"
            cols.append(name)
            types[name] = kind
            if re.search(r"PRIMARY\s+KEY", kind, re.I):
                key = name
            if f := _INLINE.search(kind):
                foreign[name] = (f[1], f[2])
        tables[m[1]] = {"cols": cols, "types": types, "key": key, "foreign": foreign}
    url = lambda *x: "/".join(quote(str(y), safe="") for y in x)
    for m in _INSERT.finditer(text):
        t = tables.get(m[1])
        if not t or not t["key"]:
            continue
        cols = [c.strip().strip("`\"[]") for c in m[2].split(",")] if m[2] else t["cols"]
        end = _statement_end(text, m.end())
        for row in _pieces(text[m.end() : end]):
            values = dict(zip(cols, map(_sql_value, _pieces(row.strip()[1:-1]))))
            if values.get(t["key"]) is None:
                continue
            s = url(m[1], t["key"], values[t["key"]])
            for c, v in values.items():
                if v is None or c == t["key"]:
                    continue
                if c in t["foreign"]:
                    o = resource(url(*t["foreign"][c], v))
                elif re.match(r"bool", t["types"].get(c, ""), re.I):
                    o = literal("true" if v.lower() in ("1", "true") else "false", XSD + "boolean")
                else:
                    o = literal(v, XSD + "double" if _NUMERIC.match(t["types"].get(c, "")) else None)
                yield (s, url(c), o, "")


def _statement_end(text: str, at: int) -> int:
    quoted = ""
    while at < len(text):
        c = text[at]
        if quoted:
            at += c == "\\"
            if c == quoted:
                quoted = ""
        elif c in "'\"":
            quoted = c
        elif c == ";":
            return at
        at += 1
    return at


PARSERS = {"ttl": lambda t: Turtle(t).parse(), "trig": lambda t: Turtle(t).parse(), "rdfxml": _rdf_xml, "trix": _trix, "jsonld": _json_ld, "sql": _sql_dump}


def _parse_files(kind: str, packed: str | None):
    def parse(frames):
        import bz2
        import gzip

        import pandas as pd

        for pdf in frames:
            for data in pdf["content"]:
                raw = gzip.decompress(data) if packed == "gzip" else bz2.decompress(data) if packed == "bzip2" else data
                rows = list(PARSERS[kind](raw.decode("utf-8")))
                names = ("kind", "value", "num", "lo", "hi", "lo_open", "hi_open")
                yield pd.DataFrame({"s": [r[0] for r in rows], "p": [r[1] for r in rows], "o": [dict(zip(names, r[2])) for r in rows], "g": [r[3] for r in rows]})

    return parse


def read_quads(spark: SparkSession, path: str, kind: str | None = None, graph: str | None = None, tsv_mode: str = "raw") -> DataFrame:
    """Quads (``s``, ``p``, ``o``, ``g``) of files in the format of ``kind`` or of the path's suffix. Line formats are split; each file
    of the others is parsed by one task. ``graph`` names the graph of all rows."""
    found, packed = format_of(path) if kind is None else (kind, format_of(path)[1] if path.rsplit(".", 1)[-1].lower() in COMPRESSIONS else None)
    if found == "parquet":
        out = spark.read.parquet(path)
    elif found in ("nt", "nq"):
        out = read_lines(spark, path, found == "nq")
    elif found == "tsv":
        out = read_tsv(spark, path, tsv_mode)
    else:
        out = spark.read.format("binaryFile").load(path).select("content").mapInPandas(_parse_files(found, packed), QUADS)
    return out if graph is None else out.withColumn("g", F.lit(graph))


def read_prefixes(spark: SparkSession, path: str) -> DataFrame:
    """(``prefix``, ``ns``) declared in a Turtle file."""
    rows = spark.read.text(path, wholetext=True).collect()  # prefix files are small by nature
    found = {}
    for r in rows:
        t = Turtle(r["value"])
        t.parse()
        found |= t.prefixes
    return spark.createDataFrame(sorted(found.items()), "prefix string, ns string")


def _escaped(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def quad_lines(quads: DataFrame, kind: str = "nt", keep: list[str] = []) -> DataFrame:
    """One column of lines: nt, ttl (graphs lost) or nq."""
    o = F.col("o")
    typed = lambda t: F.concat(F.lit('"'), o["value"], F.lit(f'"^^<{XSD}{t}>'))
    obj = F.when(o["kind"].isin("uri", "bnode"), printed_uri(o["value"])).when(o["kind"] == "number", typed("double")).when(o["kind"] == "boolean", typed("boolean"))
    obj = obj.otherwise(F.concat(F.lit('"'), _escaped(o["value"]), F.lit('"')))
    g = F.when(F.coalesce(F.col("g"), F.lit("")) != "", F.concat(F.lit(" "), printed_uri(F.col("g")))).otherwise("") if kind == "nq" else F.lit("")
    return quads.select(F.concat(printed_uri(F.col("s")), F.lit(" <"), F.col("p"), F.lit("> "), obj, g, F.lit(" .")).alias("value"), *keep)


def write_quads(quads: DataFrame, path: str, kind: str, compression: str | None = None, tsv_mode: str = "raw") -> None:
    """Writes a folder of part files: nt, nq, ttl, trig, trix, tsv or parquet; there is no writer of SQL dumps.

    Part files of trig hold each statement in a block of its graph, those of trix are documents of their own.
    """
    if kind == "parquet":
        quads.write.mode("overwrite").parquet(path)
        return
    if kind == "tsv":
        raw = tsv_mode == "raw"
        cols = [F.col("s"), F.col("p"), F.col("o.value")] if raw else [printed_uri(F.col("s")), printed_uri(F.col("p")), printed(F.col("o"))]
        lines = quads.select(F.concat_ws("\t", *cols).alias("value"))
    elif kind in ("nt", "nq", "ttl"):
        lines = quad_lines(quads, kind)
    elif kind == "trig":
        g = F.coalesce(F.col("g"), F.lit(""))
        block = F.when(g != "", F.concat(printed_uri(g), F.lit(" "))).otherwise("")
        triple = quad_lines(quads.withColumn("_block", block), "ttl", keep=["_block"])
        lines = triple.select(F.concat("_block", F.lit("{ "), "value", F.lit(" }")).alias("value"))
    elif kind == "trix":
        lines = quads.select("s", "p", "o", "g").mapInPandas(_trix_documents, "value string")
    else:
        raise ValueError(f"no writer for {kind}")
    writer = lines.write.mode("overwrite")
    (writer.option("compression", compression) if compression else writer).text(path)


def _trix_documents(frames):
    """One document for each part: a graph element for each run of statements of one graph."""
    from xml.sax.saxutils import escape

    import pandas as pd

    def item(kind: str, value: str) -> str:
        if kind in ("number", "boolean"):
            return f'<typedLiteral datatype="{XSD}{"double" if kind == "number" else kind}">{escape(value)}</typedLiteral>'
        return f"<id>{escape(value[2:])}</id>" if kind == "bnode" else f"<uri>{escape(value)}</uri>" if kind == "uri" else f"<plainLiteral>{escape(value)}</plainLiteral>"

    name = lambda x: item("bnode" if x.startswith("_:") else "uri", x)
    yield pd.DataFrame({"value": ['<TriX xmlns="http://www.w3.org/2004/03/trix/trix-1/">']})
    for pdf in frames:
        rows = [f"<graph>{name(g) if g else ''}<triple>{name(s)}{item('uri', p)}{item(o['kind'], o['value'])}</triple></graph>" for s, p, o, g in zip(pdf["s"], pdf["p"], pdf["o"], pdf["g"].fillna(""))]
        yield pd.DataFrame({"value": rows})
    yield pd.DataFrame({"value": ["</TriX>"]})
