"""Turtle: a file is read as a stream by one task, since prefixes and blank nodes carry state from its start to its end.

A small helper turns the stream into statement tuples, a batch at a time; everything after
that is the same DataFrame work as for N-Triples.  What is held is a chunk of text, the longest token, a batch of
statements, and the prefixes; a nested node or a list is held until it ends.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..scratch import stored
from .documents import opened_text
from .ranges import spread
from .rdf_lines import _ESCAPE, _PLAIN

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
COLUMNS = ["s_kind", "s_value", "predicate", "o_kind", "o_value", "o_datatype", "o_language"]
CHUNK = 1 << 20
ROWS = 10_000
#: No token needs more than this many characters after it, but for dots, to be known as whole.
_AHEAD = 4
# What stands before a token and the inside of a string are possessive: what is cut off is not read as something shorter.
_TOKEN = re.compile(
    r"""\s*+(?:\#[^\n]*+\s*+)*+(?:
    (?P<iri><[^<>"{}|^`\\\s]*>)
  | (?P<long>\"\"\"(?:\"{0,2}+(?:[^\"\\]++|\\.))*+\"\"\"|'''(?:'{0,2}+(?:[^'\\]++|\\.))*+''')
  | (?P<string>"(?:[^"\\\n\r]++|\\.)*+"|'(?:[^'\\\n\r]++|\\.)*+')
  | (?P<directive>@prefix\b|@base\b|(?i:PREFIX|BASE)\b(?=\s))
  | (?P<language>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  | (?P<blank>_:[^\s<"\[\](),;]+)
  | (?P<number>[+-]?(?:[0-9]*\.[0-9]+(?:[eE][+-]?[0-9]+)?|[0-9]+(?:\.?[eE][+-]?[0-9]+)?))
  | (?P<word>true\b|false\b|a(?=[\s<"']))
  | (?P<name>[^\s:<>"'()\[\],;.@#^]*:[^\s<>"'()\[\],;#]*[^\s<>"'()\[\],;.#]|[^\s:<>"'()\[\],;.@#^]*:)
  | (?P<mark>\^\^|[.,;()\[\]])
  | (?P<end>\Z))""",
    re.VERBOSE | re.DOTALL,
)


class TurtleError(ValueError):
    pass


class Turtle:
    """Statements of one document, in reading order; nested ones come before the statement that holds them.

    ``source`` is a text, or reads the next so many characters.
    """

    def __init__(self, source: str | Callable[[int], str]):
        self.read = io.StringIO(source).read if isinstance(source, str) else source
        self.text, self.at, self.gone, self.ended = "", 0, 0, False
        self.prefixes, self.base, self.blanks = {}, "", 0
        self.out: list[tuple] = []
        self._next()

    def _more(self, size: int) -> None:
        chunk = self.read(size)
        self.ended = not chunk
        self.gone += self.at
        self.text, self.at = self.text[self.at :] + chunk, 0

    def _whole(self, m: re.Match | None) -> bool:
        """Whether what follows in the stream can change nothing about a token."""
        if m is None or m.end() == len(self.text):
            return False
        if m.end() + _AHEAD > len(self.text) or self.text[m.end()] == ".":
            after = m.end()
            while self.text[after : after + 1] == ".":
                after += 1
            if after + _AHEAD > len(self.text):
                return False
        # Two quotes before a third begin a long string whose end is still to come.
        return m.lastgroup != "string" or len(m["string"]) > 2 or self.text[m.end()] != m["string"][0]

    def _next(self) -> tuple[str, str]:
        before = getattr(self, "token", None)
        m, size = _TOKEN.match(self.text, self.at), CHUNK
        while not self.ended and not self._whole(m):
            self._more(size)
            m, size = _TOKEN.match(self.text, self.at), size * 2  # a long token is tried a few times, not once for each chunk
        if not m:
            raise TurtleError(f"unexpected text at {self.gone + self.at}: {self.text[self.at : self.at + 20]!r}")
        self.at = m.end()
        self.token = (m.lastgroup, m[m.lastgroup])
        return before

    def _take(self, mark: str) -> bool:
        if self.token == ("mark", mark):
            self._next()
            return True
        return False

    def _need(self, mark: str) -> None:
        if not self._take(mark):
            raise TurtleError(f"expected {mark!r} before {self.token[1]!r} at {self.gone + self.at}")

    def statements(self) -> list[tuple]:
        return [row for batch in self.batches() for row in batch]

    def batches(self, rows: int = ROWS) -> Iterator[list[tuple]]:
        """The statements, some ``rows`` at a time, as they are read."""
        while self.token[0] != "end":
            if self.token[0] == "directive":
                self._directive(self._next()[1])
                continue
            nested = self.token == ("mark", "[")
            subject = self._term(literals=False)
            if nested and self.token == ("mark", "."):
                raise TurtleError("a blank node alone is no statement")
            for _ in self._objects(subject):
                if len(self.out) >= rows:
                    yield self.out
                    self.out = []
            self._need(".")
        if self.out:
            yield self.out
            self.out = []

    def _directive(self, word: str) -> None:
        prefix = None
        if word.lower().endswith("prefix"):
            kind, prefix = self._next()
            if kind != "name" or not prefix.endswith(":"):
                raise TurtleError(f"expected a prefix, not {prefix!r}")
        kind, iri = self._next()
        if kind != "iri":
            raise TurtleError(f"expected an IRI, not {iri!r}")
        if prefix is None:
            self.base = self._resolve(iri[1:-1])
        else:
            self.prefixes[prefix[:-1]] = self._resolve(iri[1:-1])
        if word.startswith("@"):
            self._need(".")

    def _resolve(self, iri: str) -> str:
        return iri if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri) else self.base + iri

    def _predicates(self, subject: tuple) -> None:
        for _ in self._objects(subject):
            pass

    def _objects(self, subject: tuple) -> Iterator[None]:
        """Reads what is said of a subject, and stops after each object."""
        while True:
            if self.token == ("word", "a"):
                self._next()
                predicate = RDF + "type"
            else:
                term = self._term(literals=False)
                if term[0] != "iri":
                    raise TurtleError("a predicate must be an IRI")
                predicate = term[1]
            while True:
                value = self._term()
                self.out.append((*subject[:2], predicate, *value))
                yield
                if not self._take(","):
                    break
            if not self._take(";") or self.token in (("mark", "."), ("mark", "]")):
                return

    def _blank(self) -> tuple:
        self.blanks += 1
        return ("bnode", f"_bnl{self.blanks}", None, None)

    def _term(self, literals: bool = True) -> tuple:
        kind, text = self._next()
        if kind == "iri":
            return ("iri", self._resolve(text[1:-1]), None, None)
        if kind == "name":
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise TurtleError(f"unknown prefix {prefix!r}")
            return ("iri", self.prefixes[prefix] + local, None, None)
        if kind == "blank":
            return ("bnode", "u_" + text[2:], None, None)
        if (kind, text) == ("mark", "["):
            node = self._blank()
            if not self._take("]"):
                self._predicates(node)
                self._need("]")
            return node
        if (kind, text) == ("mark", "("):
            return self._list()
        if literals and kind in ("string", "long"):
            return self._literal(text[3:-3] if kind == "long" else text[1:-1])
        if literals and kind == "number":
            name = "double" if "e" in text.lower() else "decimal" if "." in text else "integer"
            return ("literal", text, XSD + name, None)
        if literals and kind == "word" and text != "a":
            return ("literal", text, XSD + "boolean", None)
        raise TurtleError(f"unexpected {text!r} at {self.gone + self.at}")

    def _list(self) -> tuple:
        items = []
        while not self._take(")"):
            if self.token[0] == "end":
                raise TurtleError("unterminated list")
            items.append(self._term())
        rest = ("iri", RDF + "nil", None, None)
        nodes = [self._blank() for _ in items]
        for i, (node, item) in enumerate(zip(nodes, items)):
            self.out.append((*node[:2], RDF + "first", *item))
            self.out.append((*node[:2], RDF + "rest", *(nodes[i + 1] if i + 1 < len(nodes) else rest)))
        return nodes[0] if nodes else rest

    def _literal(self, body: str) -> tuple:
        value = _ESCAPE.sub(_decoded, body) if "\\" in body else body
        if self._take("^^"):
            return ("literal", value, self._term(literals=False)[1], None)
        if self.token[0] == "language":
            return ("literal", value, None, self._next()[1][1:])
        return ("literal", value, None, None)


def _decoded(m: re.Match) -> str:
    code = m[1]
    if code[:1] in ("u", "U") and len(code) > 1:
        point = int(code[1:], 16)
        if 0xD800 <= point <= 0xDFFF or point > 0x10FFFF:
            raise TurtleError(f"invalid code point in {m[0]}")
        return chr(point)
    if code not in _PLAIN:
        raise TurtleError(f"unknown escape {m[0]}")
    return _PLAIN[code]


_SCHEMA = "ordinal long, " + ", ".join(f"{c} string" for c in [*COLUMNS, "graph"])


def _frames(batches: Iterable[list[tuple]]) -> Iterator[pd.DataFrame]:
    first = 1
    for batch in batches:
        rows = pd.DataFrame(batch, columns=COLUMNS)
        rows.insert(0, "ordinal", range(first, first + len(rows)))
        first += len(rows)
        yield rows.assign(graph=None)


def parse_documents(texts: DataFrame, text_col: str = "value") -> DataFrame:
    """(ordinal, statement columns, graph) of every document of ``texts``; ordinals count within a document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch[text_col]:
                yield from _frames(Turtle(text).batches())

    return texts.select(text_col).mapInPandas(run, _SCHEMA)


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """The same of every file of a read, of any length; each file is one task's stream, compressed ones too."""
    files = stored(spark.read.format("binaryFile").load(path).select("path"), "files")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["path"]:
                with opened_text(name, errors="replace") as text:
                    yield from _frames(Turtle(text.read).batches())

    return spread(files).mapInPandas(run, _SCHEMA)
