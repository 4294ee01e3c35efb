"""Option specs: ``COL=type``, ``SRC=DST``, ``TGT=[a]_[b]`` and ``EDGE:FROM->TO``."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

RESERVED = ("_key", "_from", "_to", "_id")
TYPES = ("string", "number", "boolean")


class OptionError(ValueError):
    pass


def _pair(spec: str, what: str) -> tuple[str, str]:
    name, equals, value = spec.partition("=")
    if not equals or not name or not value:
        raise OptionError(f"{what} '{spec}': expected NAME=VALUE")
    return name, value


def parse_datatype(spec: str) -> tuple[str, str]:
    name, kind = _pair(spec, "--datatype")
    if kind not in TYPES:
        raise OptionError(f"--datatype '{spec}': unknown type '{kind}'; known: {', '.join(TYPES)}")
    return name, kind


def parse_translate(spec: str) -> tuple[str, str]:
    return _pair(spec, "--translate")


def parse_merge(spec: str) -> tuple[str, list[tuple[str, str]]]:
    """Target and parts, each ``("text", ...)`` or ``("column", ...)``; at least one column is needed."""
    target, template = _pair(spec, "--merge-attributes")
    parts, at = [], 0
    for m in re.finditer(r"\[([^\]]*)\]", template):
        if m.start() > at:
            parts.append(("text", template[at : m.start()]))
        if not m[1]:
            raise OptionError(f"--merge-attributes '{spec}': empty []")
        parts.append(("column", m[1]))
        at = m.end()
    if "[" in template[at:]:
        raise OptionError(f"--merge-attributes '{spec}': unclosed [")
    if at < len(template):
        parts.append(("text", template[at:]))
    if not any(kind == "column" for kind, _ in parts):
        raise OptionError(f"--merge-attributes '{spec}': no [column]")
    return target, parts


@dataclass(frozen=True)
class Reshape:
    """Column options of an import; specs are checked when the object is made."""

    datatypes: tuple[str, ...] = ()
    translate: tuple[str, ...] = ()
    merge: tuple[str, ...] = ()
    remove: tuple[str, ...] = ()
    parsed: dict = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "parsed", {
            "datatypes": dict(map(parse_datatype, self.datatypes)),
            "translate": dict(map(parse_translate, self.translate)),
            "merge": [parse_merge(s) for s in self.merge],
        })

    @property
    def any(self) -> bool:
        return bool(self.datatypes or self.translate or self.merge or self.remove)


def check_batching(max_bytes: int, in_flight_bytes: int, workers: int) -> None:
    if workers < 1:
        raise OptionError("workers must be at least 1")
    if max_bytes > in_flight_bytes:
        raise OptionError("a batch may not exceed the bytes in flight")


def parse_edge_definition(spec: str) -> dict:
    """``knows:people,robots->people`` to its collection and its from and to sides."""
    name, colon, sides = spec.partition(":")
    if not colon:
        raise OptionError(f"edge definition '{spec}': no ':'")
    left, arrow, right = sides.partition("->")
    if not arrow:
        raise OptionError(f"edge definition '{spec}': no '->'")
    if not name.strip():
        raise OptionError(f"edge definition '{spec}': no edge collection")
    out = {"collection": name.strip()}
    for side, text in (("from", left), ("to", right)):
        out[side] = [x.strip() for x in text.split(",") if x.strip()]
        if not out[side]:
            raise OptionError(f"edge definition '{spec}': no '{side}' collection")
    return out


# File name endings of the formats and codecs.
DOCUMENT_FORMATS = {"jsonl": "jsonl", "ndjson": "jsonl", "json": "json", "csv": "csv", "tsv": "tsv", "tab": "tsv"}
RDF_FORMATS = {"nt": "ntriples", "nq": "nquads", "ttl": "turtle"}
CODECS = {"gz": "gzip", "gzip": "gzip", "zst": "zstd", "zstd": "zstd"}
SCHEMES = {"file": "file", "s3": "s3a", "seaweed+s3": "s3a", "gs": "gs", "az": "abfss"}


def infer_document_format(path: str) -> str:
    """Format by the file name's ending, whatever its case, after a codec's ending is taken off."""
    stem = path.lower()
    if stem.rpartition(".")[2] in CODECS:
        stem = stem.rpartition(".")[0]
    ending = stem.rpartition(".")[2]
    if ending not in DOCUMENT_FORMATS:
        raise OptionError(f"cannot tell the format of '{path}'; name it")
    return DOCUMENT_FORMATS[ending]


def infer_rdf_format(path: str) -> str:
    stem = re.sub(r"\.(gz|zst)\Z", "", path)
    ending = stem.rpartition(".")[2].lower()
    if ending not in RDF_FORMATS:
        raise OptionError(f"cannot tell the RDF format of '{path}'; name it")
    return RDF_FORMATS[ending]


def infer_codec(path: str) -> str | None:
    return CODECS.get(path.lower().rpartition(".")[2])


def spark_path(uri: str) -> str:
    """A storage URI as Spark reads it; plain paths stay."""
    scheme, mark, rest = uri.partition("://")
    if not mark:
        return uri
    if scheme not in SCHEMES:
        raise OptionError(f"unknown storage scheme '{scheme}'")
    return f"{SCHEMES[scheme]}://{rest}"


_TEXT = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*\"""")
_LOGIN = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*://)[^/@\s]+@")


def redacted(message: str, values: list[str] = ()) -> str:
    """A message without the texts that a query's literals hold, bound ``values``, and the logins of addresses."""
    message = _LOGIN.sub(r"\1***@", message)
    for value in sorted({v for v in values if v}, key=len, reverse=True):
        message = message.replace(value, "***")
    return _TEXT.sub("'***'", message)
