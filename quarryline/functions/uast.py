"""Syntax trees of files, XPath queries over them, and their tokens.

A tree is XML in UTF-8: an element per node, named by its type, with attributes internalType, token, startPosition and one
role<Name> for each role; a text of HTML that isn't written as its token, as with character references, has it as written in source. Python is read by the standard ast module, HTML by html.parser; other languages give no tree.
The functions are Arrow UDFs: parsing a file has no built-in counterpart, and batches cross to Python in columns. Trees are built
and written without recursion where their depth is the file's choice, so nesting is kept however deep; Python source nested deeper than
its own parser allows gives no tree.
"""

from __future__ import annotations

import ast
import html
import re
import warnings
from collections.abc import Callable
from functools import lru_cache
from html.parser import HTMLParser
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UNPRINTABLE = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")
# Roles by type of node, and the field that holds a node's token.
ROLES = {
    "Name": ("Identifier", "Expression"), "Attribute": ("Identifier", "Expression"), "arg": ("Identifier", "Argument"), "alias": ("Identifier", "Import"), "Import": ("Import", "Statement"),
    "ImportFrom": ("Import", "Statement"), "FunctionDef": ("Function", "Declaration"), "AsyncFunctionDef": ("Function", "Declaration"), "ClassDef": ("Type", "Declaration"), "Constant": ("Literal", "Expression"),
    "Call": ("Call", "Expression"), "Assign": ("Assignment", "Statement"), "Return": ("Return", "Statement"), "If": ("If", "Statement"), "For": ("For", "Statement"), "While": ("While", "Statement"), "With": ("Block", "Statement"),
}
TOKENS = {"Name": "id", "Attribute": "attr", "arg": "arg", "alias": "name", "FunctionDef": "name", "AsyncFunctionDef": "name", "ClassDef": "name", "Constant": "value"}
#: Rows of a batch that are Python objects at once.
AT_ONCE = 64
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def _element(kind: str, token: object = None, roles: tuple[str, ...] = (), line: int | None = None) -> ET.Element:
    attributes = {"internalType": kind}
    if token is not None:
        attributes["token"] = _UNPRINTABLE.sub("\ufffd", str(token))
    if line is not None:
        attributes["startPosition"] = str(line)
    return ET.Element(kind, attributes | {f"role{r}": "true" for r in roles})


def _python(source: str) -> ET.Element:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        root = ast.parse(source)

    def build(node: ast.AST) -> ET.Element:
        kind = type(node).__name__
        out = _element(kind, getattr(node, TOKENS[kind], None) if kind in TOKENS else None, ROLES.get(kind, ()), getattr(node, "lineno", None))
        out.extend(build(child) for child in ast.iter_child_nodes(node) if not isinstance(child, ast.expr_context))
        return out

    tree = build(root)
    tree.set("roleFile", "true")
    return tree


class _Html(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.open = [_element("Document", roles=("File",))]
        self._text: ET.Element | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        name = re.sub(r"[^\w.-]", "_", tag) if re.match(r"[A-Za-z_]", tag) else "element"
        node = _element(name, tag, ("Identifier",), self.getpos()[0])
        for key, value in attrs:
            node.append(_element("attribute", f"{key}={value or ''}", ("Literal",)))
        self.open[-1].append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].get("token") == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._text = _element("text", data.strip(), ("Literal",), self.getpos()[0])
            self.open[-1].append(self._text)

    def updatepos(self, i: int, j: int) -> int:
        """Called by the parser behind each piece of the file."""
        text, self._text = self._text, None
        if text is not None and (source := _UNPRINTABLE.sub("\ufffd", self.rawdata[i:j])) != text.get("token"):
            text.set("source", source)
        return super().updatepos(i, j)


def _html(source: str) -> ET.Element:
    parser = _Html()
    parser.feed(source)
    parser.close()
    return parser.open[0]


_ESCAPES = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "\r": "&#13;", "\n": "&#10;", "\t": "&#09;"})


def serialized(root: ET.Element) -> bytes:
    """A tree as XML; its elements hold attributes and elements only."""
    out, open_ = [], [(root, None)]
    while open_:
        node, rest = open_.pop()
        if rest is None:
            attributes = "".join(f' {k}="{v.translate(_ESCAPES)}"' for k, v in node.items())
            out.append(f"<{node.tag}{attributes}>" if len(node) else f"<{node.tag}{attributes}/>")
            if not len(node):
                continue
            rest = iter(node)
        child = next(rest, None)
        if child is None:
            out.append(f"</{node.tag}>")
        else:
            open_ += (node, rest), (child, None)
    return "".join(out).encode()


PARSERS: dict[str, Callable[[str], ET.Element]] = {"python": _python, "html": _html}


def parse(path: str | None, content: bytes | None, lang: str | None) -> list[bytes]:
    """The tree of a file as a list of one root; empty for no content, an unsupported language or a file that doesn't parse."""
    if not content:
        return []
    if lang is None and path:
        lang = {"py": "python", "html": "html", "htm": "html"}.get(path.rpartition(".")[2].lower())
        if lang is None and re.match(rb"#!.*\bpython", content):
            lang = "python"
    parser = PARSERS.get((lang or "").lower())
    if parser is None:
        return []
    try:
        return [serialized(parser(bytes(content).decode("utf-8")))]
    except (SyntaxError, ValueError, RecursionError, MemoryError, ET.ParseError):
        return []


def parse_uast_node(node: bytes) -> ET.Element:
    """A node as an object."""
    return ET.fromstring(node)


_STEP = re.compile(r"(//?)([\w.-]+|\*)((?:\[[^\]]*\])*)")
_TEST = re.compile(r"\s*(not\s*\(|[()]|and\b|or\b|@([\w.-]+)(?:\s*=\s*(?:'([^']*)'|\"([^\"]*)\"))?)\s*")
_TOKEN = re.compile(rb'<[^>]*?\stoken="([^"]*)"')
_SOURCE = re.compile(rb'<[^>]*?\ssource="([^"]*)"')
Test = Callable[[ET.Element], bool]


def _condition(text: str) -> Test:
    """A predicate of attribute tests joined by and, or and not(...)."""
    words, at = [], 0
    while at < len(text):
        m = _TEST.match(text, at)
        if not m:
            raise ValueError(f"unsupported predicate [{text}]")
        words.append((m[1].split("(")[0].strip() + "(" if m[1].endswith("(") else m[1], m[2], m[3] if m[3] is not None else m[4]))
        at = m.end()
    words.reverse()

    def one() -> Test:
        word, name, value = words.pop() if words else ("", None, None)
        if word in ("not(", "("):
            inner = some()
            if not words or words.pop()[0] != ")":
                raise ValueError(f"unsupported predicate [{text}]")
            return (lambda node: not inner(node)) if word == "not(" else inner
        if name is None:
            raise ValueError(f"unsupported predicate [{text}]")
        return (lambda node: node.get(name) is not None) if value is None else (lambda node: node.get(name) == value)

    def joined(sign: str, part: Callable[[], Test], of: Callable[[list[bool]], bool]) -> Test:
        parts = [part()]
        while words and words[-1][0] == sign:
            words.pop()
            parts.append(part())
        return parts[0] if len(parts) == 1 else lambda node: of(p(node) for p in parts)

    some = lambda: joined("or", lambda: joined("and", one, all), any)
    test = some()
    if words:
        raise ValueError(f"unsupported predicate [{text}]")
    return test


@lru_cache(maxsize=128)
def _steps(query: str) -> list[tuple[str, str, list[Test]]]:
    """(axis, name, predicates) of each step of a path."""
    steps = _STEP.findall(query)
    if not steps or "".join("".join(s) for s in steps) != query:
        raise ValueError(f"unsupported XPath {query!r}")
    return [(axis, name, [_condition(p) for p in re.findall(r"\[([^\]]*)\]", predicates)]) for axis, name, predicates in steps]


def xpath(node: ET.Element, query: str) -> list[ET.Element]:
    """The elements that a path of / and // steps with attribute predicates selects, in document order."""
    above = ET.Element("root")
    above.append(node)
    found = [above]
    for axis, name, tests in _steps(query):
        seen: dict[int, ET.Element] = {}
        for base in found:
            for x in (d for d in base.iter() if d is not base) if axis == "//" else base:
                if name in ("*", x.tag) and all(t(x) for t in tests):
                    seen.setdefault(id(x), x)
        found = list(seen.values())
    if len(found) < 2:
        return found
    order = {id(x): i for i, x in enumerate(above.iter())}
    return sorted(found, key=lambda x: order[id(x)])


def query_nodes(nodes: list[bytes] | None, query: str | None) -> list[bytes] | None:
    if nodes is None or query is None:
        return None
    return [serialized(x) for n in nodes for x in xpath(ET.fromstring(n), query)]


def node_tokens(nodes: list[bytes] | None) -> list[str]:
    """One token per node, empty where a node has none: the attribute in the node's own first tag."""
    return [html.unescape(m[1].decode()) if (m := _TOKEN.match(n)) else "" for n in nodes or []]


def node_sources(nodes: list[bytes] | None) -> list[str]:
    """One text per node as its file has it; the token where that is the same."""
    return [html.unescape(m[1].decode()) if (m := _SOURCE.match(n) or _TOKEN.match(n)) else "" for n in nodes or []]


def _columns(f: Callable, kind: pa.DataType) -> Callable[..., pa.Array]:
    """f by rows; only AT_ONCE of them are Python objects at a time, whatever the batch."""

    def run(*columns: pa.Array) -> pa.Array:
        parts = [pa.array([], kind)]
        for i in range(0, len(columns[0]), AT_ONCE):
            parts.append(pa.array([f(*row) for row in zip(*(c.slice(i, AT_ONCE).to_pylist() for c in columns), strict=True)], kind))
        return pa.concat_arrays(parts)

    return run


def _extract(path: pa.Array, content: pa.Array, lang: pa.Array) -> pa.Array:
    return _columns(parse, pa.list_(pa.binary()))(path, content, lang)


def _query(nodes: pa.Array, query: pa.Array) -> pa.Array:
    return _columns(query_nodes, pa.list_(pa.binary()))(nodes, query)


def _tokens(nodes: pa.Array) -> pa.Array:
    return _columns(node_tokens, pa.list_(pa.string()))(nodes)


def _sources(nodes: pa.Array) -> pa.Array:
    return _columns(node_sources, pa.list_(pa.string()))(nodes)


# UDFs are made when they are used: building one needs the session of a driver.
def extract_uasts(path: Column, content: Column, lang: Column) -> Column:
    return F.arrow_udf(_extract, "array<binary>")(path, content, lang)


def query_xpath(nodes: Column, query: Column) -> Column:
    return F.arrow_udf(_query, "array<binary>")(nodes, query)


def extract_tokens(nodes: Column, as_written: bool = False) -> Column:
    return F.arrow_udf(_sources if as_written else _tokens, "array<string>")(nodes)


def _ready(df: DataFrame, verb: str, needed: tuple[str, ...], output: str) -> None:
    if missing := [c for c in needed if c not in df.columns]:
        raise ValueError(f"{verb} can not be applied: the frame lacks {', '.join(missing)}")
    if output in df.columns:
        raise ValueError(f"{verb} can not be applied: the frame already has a column {output}")


def extract(df: DataFrame) -> DataFrame:
    """df with a column uast; its column lang says what a file is, where it has one."""
    _ready(df, "extract_uasts", ("path", "content"), "uast")
    lang: Column = F.col("lang") if "lang" in df.columns else F.lit(None).cast("string")
    return df.withColumn("uast", extract_uasts(F.col("path"), F.col("content"), lang))


def query(df: DataFrame, path: str, query_col: str = "uast", output_col: str = "result") -> DataFrame:
    """df with the nodes that an XPath selects from the nodes in query_col."""
    _ready(df, "query_uast", (query_col,), output_col)
    return df.withColumn(output_col, query_xpath(F.col(query_col), F.lit(path)))


def tokens(df: DataFrame, input_col: str = "result", output_col: str = "tokens", as_written: bool = False) -> DataFrame:
    """df with the tokens of the nodes in input_col; as_written: as their files have them, character references included."""
    _ready(df, "extract_tokens", (input_col,), output_col)
    return df.withColumn(output_col, extract_tokens(F.col(input_col), as_written))


def register(spark: SparkSession) -> None:
    spark.udf.register("extractUASTs", F.arrow_udf(_extract, "array<binary>"))
    spark.udf.register("queryXPath", F.arrow_udf(_query, "array<binary>"))
    spark.udf.register("extractTokens", F.arrow_udf(_tokens, "array<string>"))

