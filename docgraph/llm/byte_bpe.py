"""Byte-level BPE ids with a bounded cache of the parts between spaces and line ends.

A single space always begins a pre-token, and a single line end (or two of them
before other text) is one of its own, so a text is encoded part by part and
repeated parts are looked up.  Texts with longer runs of white space are encoded
in one go, and texts that hold a special token's string go through ``tokenizers``
itself.  So do all texts where the file asks for another normaliser, another cut, or merges in
an order that its ids do not show.
"""

from __future__ import annotations

import json
import re
from array import array

# Fixed value: the pattern that byte-level pre-tokenizing cuts by.
USUAL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_PARTS = 1_000_000
LONGEST_PART = 64
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_RUNS = re.compile(r"[^\S\n]\s|\s[^\S\n]|\n\n\n|\n\n\Z")


class ByteBpe:
    _known: dict[str | None, "ByteBpe"] = {}

    @classmethod
    def of(cls, path: str | None) -> "ByteBpe":
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def __init__(self, path: str | None = None):
        import public_tokenizers as public
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path or public.path("byte_bpe_50k.json"))
        added = {t.content: i for i, t in self.whole.get_added_tokens_decoder().items()}
        self.special = tuple(added)
        unicode_to_byte = {c: b for b, c in _byte_letters().items()}
        ranks = {
            bytes(unicode_to_byte[c] for c in piece): i
            for piece, i in self.whole.get_vocab(with_added_tokens=True).items()
            if piece not in added
        }
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.parts: dict[str, bytes] = {}
        self.most_parts = CACHED_PARTS
        self.plain = None
        self.bytes_of = {i: piece for piece, i in ranks.items()}
        self.usual = _usual(json.loads(self.whole.to_str()), public.PATTERN)

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        if not self.usual or any(s in text for s in self.special):
            return _packed(self.whole.encode(text, add_special_tokens=False).ids)
        return self._by_parts(text)

    def encode_plain(self, text: str) -> bytes:
        """The ids of ``text``, in which the strings of special tokens are ordinary text."""
        if self.usual:
            return self._by_parts(text)
        if self.plain is None:
            from tokenizers import Tokenizer

            self.plain = Tokenizer.from_str(self.whole.to_str())
            self.plain.encode_special_tokens = True
        return _packed(self.plain.encode(text, add_special_tokens=False).ids)

    def _by_parts(self, text: str) -> bytes:
        if not _single_spaced(text):
            return _packed(self.fast.encode_ordinary(text))
        first, *rest = text.replace("\n", " \n").split(" ")
        found = list(map(self.parts.get, rest))
        if None in found:
            found = [ids or self._encode_part(p) for ids, p in zip(found, rest)]
        return _packed(self.fast.encode_ordinary(first)) + b"".join(found)

    def _encode_part(self, part: str) -> bytes:
        ids = _packed(self.fast.encode_ordinary(part if part[:1] == "\n" else " " + part))
        if len(part) <= LONGEST_PART and len(self.parts) < self.most_parts:
            self.parts[part] = ids
        return ids


def _usual(settings: dict, pattern: str) -> bool:
    """Whether a tokenizer works as the fast path does: byte letters, the usual pattern, merges in the order of their ids."""
    before, model = settings.get("pre_tokenizer") or {}, settings["model"]
    if settings.get("normalizer") or settings.get("post_processor") or settings.get("truncation") or settings.get("padding"):
        return False
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or pattern != USUAL_PATTERN:
        return False
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    if model.get("type") != "BPE" or any(model.get(k) for k in odd):
        return False
    ids = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    return all(a < b for a, b in zip(ids, ids[1:])) and max(model["vocab"][c] for c in _byte_letters().values()) < min(ids, default=1 << 31)


def _single_spaced(text: str) -> bool:
    if "  " in text or " \n" in text or "\n " in text or "\n\n\n" in text or text.endswith("\n\n"):
        return False
    return not (_OTHER_SPACE.search(text) and _RUNS.search(text))


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}
