"""Values inside XML text.

A path of plain steps (``/a/b`` or ``/a/b/@c``) is followed while the text is checked, in one parse.  Any other path
goes to Spark's own ``xpath_*`` functions.  They raise on malformed input and accept a DOCTYPE, so the check runs
first, and only text that passes it reaches them.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Mapping, Sequence
from xml.etree import ElementTree
from xml.parsers import expat

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicspark.functions.formats import value_format

# The check travels with the query, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MALFORMED = "Error: malformed XML"


def _refuse_doctype(*_):
    raise expat.ExpatError("DOCTYPE is not allowed")


def _parser() -> expat.XMLParserType:
    parser = expat.ParserCreate("UTF-8")
    parser.StartDoctypeDeclHandler = _refuse_doctype
    return parser


def _well_formed(text: str | None) -> bool | None:
    if text is None:
        return None
    try:
        _parser().Parse(text, True)
        return True
    except (expat.ExpatError, UnicodeEncodeError):
        return False


def _child_names(text: str | None) -> list[str] | None:
    if text is None:
        return None
    names: dict[str, None] = {}
    depth = 0

    def start(name, _attributes):
        nonlocal depth
        depth += 1
        if depth == 2:
            names[name] = None

    def end(_name):
        nonlocal depth
        depth -= 1

    parser = _parser()
    parser.StartElementHandler = start
    parser.EndElementHandler = end
    try:
        parser.Parse(text, True)
    except (expat.ExpatError, UnicodeEncodeError):
        return []
    return list(names)


class _Node:
    """A step of the searched paths: the steps below it, and the (place, attribute) asked for at it."""

    def __init__(self):
        self.below: dict[str, _Node] = {}
        self.asked: list[tuple[int, str | None]] = []


def _tree(plain: Sequence[tuple[list[str], str | None]]) -> _Node:
    top = _Node()
    for place, (steps, attribute) in enumerate(plain):
        node = top
        for step in steps:
            node = node.below.setdefault(step, _Node())
        node.asked.append((place, attribute))
    return top


def _texts(text: str, top: _Node, n: int) -> list[str | None] | None:
    """Text (or attribute) of the first element at each of ``n`` paths, in one parse; None for malformed text."""
    found: list[list[str] | None] = [None] * n
    stack: list[_Node | None] = [top]
    reading: list[tuple[int, list[str]]] = []  # (depth, parts) of the elements whose text is being taken
    parser = _parser()

    def start(name, attributes):
        node = stack[-1].below.get(name) if stack[-1] is not None else None
        stack.append(node)
        if node is not None:
            for place, attribute in node.asked:
                if found[place] is None and attribute is None:
                    found[place] = []
                    reading.append((len(stack), found[place]))
                    parser.CharacterDataHandler = take
                elif found[place] is None and attribute in attributes:
                    found[place] = [attributes[attribute]]

    def take(data):
        for _, parts in reading:
            parts.append(data)

    def end(_name):
        while reading and reading[-1][0] == len(stack):
            reading.pop()
        stack.pop()
        if not reading:
            parser.CharacterDataHandler = None
            if None not in found:  # the rest of the text is only checked
                parser.StartElementHandler = parser.EndElementHandler = None

    parser.StartElementHandler = start
    parser.EndElementHandler = end
    try:
        parser.Parse(text, True)
    except (expat.ExpatError, UnicodeEncodeError):
        return None
    return [None if parts is None else "".join(parts) for parts in found]


_PLAIN_PATH = re.compile(r"((?:/[A-Za-z_][\w.-]*)+)(?:/@([A-Za-z_][\w.-]*))?")


def _plain(path: str) -> tuple[list[str], str | None] | None:
    """Steps and attribute of a plain path, or None for any other path."""
    plain = _PLAIN_PATH.fullmatch(path)
    return None if plain is None else (plain[1][1:].split("/"), plain[2])


def _follow(text: Column, path: str, missing: str | None, malformed: str | None) -> Column | None:
    """Column that follows a plain path, or None for any other path."""
    plain = _plain(path)
    if plain is None:
        return None
    top = _tree([plain])

    def first(value: str | None) -> str | None:
        if value is None:
            return None
        texts = _texts(value, top, 1)
        return malformed if texts is None else missing if texts[0] is None else texts[0]

    @F.pandas_udf(T.StringType())
    def follow(values: pd.Series) -> pd.Series:
        return values.map(first).astype("object")

    return follow(_markup(text))


@F.pandas_udf(T.BooleanType())
def _well_formed_udf(text: pd.Series) -> pd.Series:
    return text.map(_well_formed).astype("object")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _child_names_udf(text: pd.Series) -> pd.Series:
    return text.map(_child_names)


@F.pandas_udf(T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("names", T.ArrayType(T.StringType()))]))
def _outline_udf(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"ok": text.map(_well_formed).astype("object"), "names": text.map(_child_names)})


def xml_outline(col: Column | str) -> Column:
    """``ok`` (as ``xml_ok``) and ``names`` (as ``xml_children``) of a text that starts like XML, null for others."""
    text = F.col(col) if isinstance(col, str) else col
    return _outline_udf(_markup(text))


def _markup(col: Column) -> Column:
    """The text if it starts like XML: nothing else needs to travel to the check."""
    return F.when(value_format(col) == "XML", col)


def xml_ok(col: Column | str) -> Column:
    """True for well-formed XML without a DOCTYPE, false for any other text, null for null."""
    text = F.col(col) if isinstance(col, str) else col
    return F.when(text.isNotNull(), F.coalesce(_well_formed_udf(_markup(text)), F.lit(False)))


def xml_children(col: Column | str) -> Column:
    """Distinct names of the root's child elements, in document order; empty for malformed XML."""
    text = F.col(col) if isinstance(col, str) else col
    return F.coalesce(_child_names_udf(_markup(text)), F.array().cast("array<string>"))


def xpath_valid(path: str, nodes: bool = True) -> bool:
    """Whether Spark's XPath engine accepts ``path`` (and, with ``nodes``, whether it selects nodes)."""
    spark = SparkSession.active()
    probe = "size(xpath('<a/>', :path))" if nodes else "xpath_string('<a/>', :path)"
    try:
        spark.sql(f"SELECT {probe}", args={"path": path}).collect()
        return True
    except Exception:
        return False


def xml_extract(col: Column | str, path: str) -> Column:
    """Text of the first node at ``path``.

    Null for null or blank text and when nothing matches; an ``Error: ..`` text for malformed XML or a DOCTYPE.
    """
    if not xpath_valid(path):
        raise ValueError(f"not a node-selecting XPath: {path!r}")
    text = F.col(col) if isinstance(col, str) else col
    blank = ~text.rlike(r"[^\s]")
    found = F.when(text.isNull() | blank, F.lit(None))
    followed = _follow(text, path, missing=None, malformed=MALFORMED)
    if followed is not None:
        return found.when(value_format(text) == "XML", followed).otherwise(F.lit(MALFORMED))
    value = F.xpath_string(text, F.lit(path))
    # An empty text is that of an empty node, or of no node at all.
    node = F.when(value != "", value).when(F.xpath_boolean(text, F.lit(path)), value)
    return found.when(xml_ok(text), node).otherwise(F.lit(MALFORMED))


def xml_extract_all(col: Column | str, paths: Mapping[str, str]) -> Column:
    """Struct of the ``xml_extract`` of every path, under its name; plain paths share one parse of the text."""
    text = F.col(col) if isinstance(col, str) else col
    plain = {name: _plain(path) for name, path in paths.items() if _plain(path) is not None}
    if not plain:
        return F.struct(*[xml_extract(text, path).alias(name) for name, path in paths.items()])
    top, n = _tree(list(plain.values())), len(plain)
    nothing, malformed = [None] * n, [MALFORMED] * n

    @F.pandas_udf(T.StructType([T.StructField(f"p{i}", T.StringType()) for i in range(n)]))
    def follow(values: pd.Series) -> pd.DataFrame:
        rows = (nothing if value is None else _texts(value, top, n) or malformed for value in values)
        return pd.DataFrame(rows, columns=[f"p{i}" for i in range(n)], dtype="object")

    followed, markup = follow(_markup(text)), value_format(text) == "XML"
    empty = text.isNull() | ~text.rlike(r"[^\s]")
    fields = []
    for name, path in paths.items():
        if name in plain:
            at = followed.getField(f"p{list(plain).index(name)}")
            value = F.when(empty, F.lit(None)).when(markup, at).otherwise(F.lit(MALFORMED))
        else:
            value = xml_extract(text, path)
        fields.append(value.alias(name))
    return F.struct(*fields)


_TREE_PATH = re.compile(r"(//?)([^/]+(?:/{1,2}[^/@]+)*?)(?:/@([A-Za-z_][\w.-]*))?")


def _search(text: str, path: str) -> str | None:
    """Text of the first node at a path of steps, ``//``, ``*`` and simple predicates, in well-formed text."""
    shape = _TREE_PATH.fullmatch(path.removesuffix("/text()"))
    if shape is None:
        raise ValueError(f"XmlExtract does not support this path in SQL, use xml_extract: {path!r}")
    lead, steps, attribute = shape.groups()
    document = ElementTree.Element("document")
    document.append(ElementTree.fromstring(text))
    try:
        nodes = document.iterfind(f".{lead}{steps}")
        if attribute is not None:
            return next((node.attrib[attribute] for node in nodes if attribute in node.attrib), None)
        node = next(iter(nodes), None)
    except (SyntaxError, KeyError):
        raise ValueError(f"XmlExtract does not support this path in SQL, use xml_extract: {path!r}") from None
    return None if node is None else "".join(node.itertext())


def _sql_extract(text: str | None, path: str | None, trees: dict[str, _Node | None]) -> str | None:
    if text is None or path is None or not text.strip():
        return None
    if path not in trees:
        plain = _plain(path)
        trees[path] = None if plain is None else _tree([plain])
    if not text.lstrip().startswith("<"):
        return MALFORMED
    if trees[path] is None:
        return _search(text, path) if _well_formed(text) else MALFORMED
    texts = _texts(text, trees[path], 1)
    return MALFORMED if texts is None else texts[0]


@F.pandas_udf(T.StringType())
def xml_extract_sql(texts: pd.Series, paths: pd.Series) -> pd.Series:
    """``XmlExtract(text, path)`` for SQL texts: plain paths, ``//``, ``*`` and simple predicates."""
    trees: dict[str, _Node | None] = {}
    found = [_sql_extract(text, path, trees) for text, path in zip(texts, paths, strict=True)]
    return pd.Series(found, dtype="object")


def xml_text(col: Column | str, path: str) -> Column:
    """XPath string value, ``''`` when nothing matches; null for malformed XML or an invalid path."""
    if not xpath_valid(path, nodes=False):
        return F.lit(None).cast("string")
    text = F.col(col) if isinstance(col, str) else col
    followed = _follow(text, path, missing="", malformed=None)
    return F.when(xml_ok(text), F.xpath_string(text, F.lit(path))) if followed is None else followed
