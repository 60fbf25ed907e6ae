"""Matchers, mappers and arithmetic on quads as Column expressions.

A quad row has ``s``, ``p``, ``g`` (URIs or bnodes as strings) and ``o``, a term struct.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERM_TYPE = "struct<kind:string,value:string,num:double,lo:double,hi:double,lo_open:boolean,hi_open:boolean>"
_INTERVAL = re.compile(r"^\s*([\[(])\s*(\S+)\s*;\s*(\S+)\s*([\])])\s*$")
_PLACES = "spog"


def term(kind: Column | str, value: Column, num: Column | None = None) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    none = F.lit(None).cast("double")
    flag = F.lit(None).cast("boolean")
    return F.struct(kind.alias("kind"), value.alias("value"), (none if num is None else num).alias("num"), none.alias("lo"), none.alias("hi"), flag.alias("lo_open"), flag.alias("hi_open"))


def interval_term(lo: Column, hi: Column, lo_open: Column, hi_open: Column) -> Column:
    text = F.concat(F.when(lo_open, "(").otherwise("["), F.lit(" "), lo.cast("string"), F.lit(" ; "), hi.cast("string"), F.lit(" "), F.when(hi_open, ")").otherwise("]"))
    none = F.lit(None).cast("double")
    return F.struct(F.lit("interval").alias("kind"), text.alias("value"), none.alias("num"), lo.alias("lo"), hi.alias("hi"), lo_open.alias("lo_open"), hi_open.alias("hi_open"))


def printed_uri(c: Column) -> Column:
    return F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))


def printed(o: Column) -> Column:
    """The form in which a term is written and matched."""
    return F.when(o["kind"].isin("uri", "bnode"), printed_uri(o["value"])).when(o["kind"] == "text", F.concat(F.lit('"'), o["value"], F.lit('"'))).otherwise(o["value"])


def number_matcher(pattern: str, num: Column) -> Column:
    """A number, a comparison (``>= 2``) or a range (``[1 ; 2)``)."""
    pattern = pattern.strip()
    if m := re.match(r"^(>=|<=|>|<)\s*(\S+)$", pattern):
        x = F.lit(float(m[2]))
        return {">": num > x, "<": num < x, ">=": num >= x, "<=": num <= x}[m[1]]
    if m := _INTERVAL.match(pattern):
        lo, hi = F.lit(float(m[2])), F.lit(float(m[3]))
        return ((num > lo) if m[1] == "(" else (num >= lo)) & ((num < hi) if m[4] == ")" else (num <= hi))
    return num == F.lit(float(pattern))


def object_matcher(pattern: str, o: Column) -> Column:
    """``<regex>`` matches resources, ``"regex"`` texts, numbers and their comparisons and ranges numbers, true and
    false booleans, ``i[a ; b)`` an interval, ``_:regex`` bnodes; the whole printed form must match."""
    if pattern.startswith("<") and pattern.endswith(">"):
        return (o["kind"] == "uri") & printed(o).rlike(f"^<(?:{pattern[1:-1]})>$")
    if pattern.startswith('"') and pattern.endswith('"') and len(pattern) > 1:
        return (o["kind"] == "text") & o["value"].rlike(f"^(?:{pattern[1:-1]})$")
    if pattern.startswith("_:"):
        return (o["kind"] == "bnode") & o["value"].rlike(f"^(?:{pattern})$")
    if pattern in ("true", "false"):
        return (o["kind"] == "boolean") & (o["value"] == pattern)
    if pattern.startswith("i") and (m := _INTERVAL.match(pattern[1:])):
        return (o["kind"] == "interval") & (o["lo"] == float(m[2])) & (o["hi"] == float(m[3])) & (o["lo_open"] == (m[1] == "(")) & (o["hi_open"] == (m[4] == ")"))
    return (o["kind"] == "number") & number_matcher(pattern, o["num"])


def uri_matcher(pattern: str, c: Column) -> Column:
    bare = pattern[1:-1] if pattern.startswith("<") and pattern.endswith(">") else pattern
    return c.rlike(f"^(?:{bare})$")


@dataclass(frozen=True)
class QuadMatcher:
    """Patterns of the four places; a missing pattern matches anything, all must match."""

    subject: str | None = None
    predicate: str | None = None
    object: str | None = None
    graph: str | None = None
    inverse: bool = False

    def column(self) -> Column:
        out = F.lit(True)
        for c, pattern in (("s", self.subject), ("p", self.predicate), ("g", self.graph)):
            if pattern is not None:
                out = out & F.coalesce(uri_matcher(pattern, F.col(c)), F.lit(False))
        if self.object is not None:
            out = out & F.coalesce(object_matcher(self.object, F.col("o")), F.lit(False))
        return ~out if self.inverse else out


def any_match(matchers: list[QuadMatcher]) -> Column:
    out = F.lit(False)
    for m in matchers:
        out = out | m.column()
    return out


def filter_quads(quads: DataFrame, matchers: list[QuadMatcher]) -> DataFrame:
    """Quads that at least one matcher (turned round by its ``inverse``) accepts."""
    return quads.where(any_match(matchers))


class Arithmetic:
    """``+ - * /`` with brackets over numbers and names, read once into a Column."""

    _TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)|(\$?\w+)|([-+*/()]))")

    def __init__(self, text: str, names: Mapping[str, Column]):
        self.tokens, self.names, at = [], names, 0
        while at < len(text.rstrip()):
            m = self._TOKEN.match(text, at)
            if not m:
                raise ValueError(f"unexpected {text[at:]!r}")
            self.tokens.append(m)
            at = m.end()
        self.at = 0
        self.column = self._sum()
        if self.at != len(self.tokens):
            raise ValueError(f"unexpected end of {text!r}")

    def _peek(self) -> str | None:
        return self.tokens[self.at][3] if self.at < len(self.tokens) else None

    def _sum(self) -> Column:
        out = self._product()
        while (sign := self._peek()) in ("+", "-"):
            self.at += 1
            right = self._product()
            out = out + right if sign == "+" else out - right
        return out

    def _product(self) -> Column:
        out = self._value()
        while (sign := self._peek()) in ("*", "/"):
            self.at += 1
            right = self._value()
            out = out * right if sign == "*" else out / right
        return out

    def _value(self) -> Column:
        if self.at >= len(self.tokens):
            raise ValueError("expression ends too early")
        number, name, sign = self.tokens[self.at].groups()
        self.at += 1
        if number:
            return F.lit(float(number))
        if name:
            return self.names[name]
        if sign == "-":
            return -self._value()
        if sign == "(":
            out = self._sum()
            if self._peek() != ")":
                raise ValueError("bracket is missing")
            self.at += 1
            return out
        raise ValueError(f"unexpected {sign}")


def _filled(template: str, groups: dict[str, Column]) -> Column:
    parts = re.split(r"(\$[spog]?\d+)", template)
    cols = [groups.get(x, F.lit("")) if x.startswith("$") else F.lit(x) for x in parts if x]
    return F.concat(*[F.coalesce(c, F.lit("")) for c in cols]) if cols else F.lit("")


def map_quads(quads: DataFrame, matcher: QuadMatcher, subject: str | None = None, predicate: str | None = None, object: str | None = None, graph: str | None = None) -> DataFrame:  # noqa: A002
    """Replaces parts of matching quads. In replacements ``$s1`` .. ``$g1`` are groups of the pattern of that place, ``$1`` those
    of the replaced place, ``$0`` its whole text. An object replacement is ``<uri>``, ``"text"``, ``_:id``, true, false, an
    interval, or arithmetic, in which ``$o0`` is the number itself."""
    patterns = {"s": matcher.subject, "p": matcher.predicate, "o": matcher.object, "g": matcher.graph}
    texts = {"s": F.col("s"), "p": F.col("p"), "g": F.col("g"), "o": F.col("o.value")}

    def groups(place: str) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for c in _PLACES:
            bare = re.sub(r'^[<"](.*)[>"]$', r"\1", patterns[c] or "")
            out[f"${c}0"] = texts[c]
            try:
                n = re.compile(bare).groups if patterns[c] else 0
            except re.error:
                n = 0
            for k in range(1, n + 1):
                out[f"${c}{k}"] = F.regexp_extract(texts[c], f"^(?:{bare})$", k)
        return out | {f"${k[2:]}": v for k, v in out.items() if k[1] == place}

    hit = matcher.column()
    cols = {}
    for c, template in (("s", subject), ("p", predicate), ("g", graph)):
        if template is not None:
            bare = template[1:-1] if template.startswith("<") and template.endswith(">") else template
            cols[c] = F.when(hit, _filled(bare, groups(c))).otherwise(F.col(c))
    if object is not None:
        cols["o"] = F.when(hit, _object(object, groups("o"))).otherwise(F.col("o"))
    return quads.select(*[cols.get(c, F.col(c)).alias(c) for c in quads.columns])


def _object(template: str, groups: dict[str, Column]) -> Column:
    if template.startswith("<") and template.endswith(">"):
        return term("uri", _filled(template[1:-1], groups))
    if template.startswith('"') and template.endswith('"') and len(template) > 1:
        return term("text", _filled(template[1:-1], groups))
    if template.startswith("_:"):
        return term("bnode", _filled(template, groups))
    if template in ("true", "false"):
        return term("boolean", F.lit(template))
    if m := _INTERVAL.match(template):
        return interval_term(F.lit(float(m[2])), F.lit(float(m[3])), F.lit(m[1] == "("), F.lit(m[4] == ")"))
    names = {k: v.try_cast("double") for k, v in groups.items()} | {"$o0": F.col("o.num"), "$0": F.col("o.num")}
    num = Arithmetic(template, names).column
    return F.when(num.isNotNull(), term("number", num.cast("string"), num)).otherwise(F.col("o"))
