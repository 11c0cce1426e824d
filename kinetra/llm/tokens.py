"""Token ids of whole texts with a public tokenizer file.

Ids are those of tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False). For a tokenizer that
drops white space and never joins over it (checked when the file is read), ids of a text are the ids of its parts
between spaces and line breaks in order, so each worker keeps the ids of parts it has met, in a table of bounded
size, and encodes only new ones. Any other tokenizer encodes each text as a whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import regex

#: Entries of a worker's tables (each keeps up to twice as many, of about 200 bytes): parts of texts, and words.
PARTS, WORDS = 100_000, 250_000
CACHED_LENGTH = 64

#: Characters that normalization leaves alone but for lower-casing each: printable ASCII and Latin letters.
_PLAIN = regex.compile("[\x21-\x7e\xa1-\xac\xae-\u012f\u0131-\u024f]+")


def _byte_table() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself if printable, else the next free from 256."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return {b: chr(b if b in kept else next(free)) for b in range(256)}


_BYTES = _byte_table()



class _Cache(dict):
    """A table that makes its missing entries. When it is full it becomes the old one, from which used entries return."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most
        self.old: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHED_LENGTH:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Encodes texts to packed little-endian ids; dtype is the narrowest unsigned type that holds every id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.apart = self._splits_at_white_space(spec)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.parts = _Cache(self._part, PARTS)
        self.words = _Cache(self._word, WORDS)
        if self.apart:
            self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])

    @staticmethod
    def _splits_at_white_space(spec: dict) -> bool:
        """Whether the file's own pre-tokenizer takes only runs free of white space, and special tokens hold none."""
        kinds = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        first = kinds[0]
        drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and first.get("pattern", {}).get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        drops = drops and len(kinds) == 2 and kinds[1].get("type") == "ByteLevel" and not kinds[1]["add_prefix_space"] and not kinds[1]["use_regex"]
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        plain = all(" " not in t["content"] and "\n" not in t["content"] and not t["single_word"] for t in spec.get("added_tokens", []))
        return drops and steps == ["NFC", "Replace", "Lowercase"] and plain and spec.get("post_processor") is None

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of one word of the pre-tokenizer, by the file's model."""
        return self._pack([t.id for t in self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(_BYTES))])

    def _part(self, part: str) -> bytes:
        """Ids of a part without spaces. Plain Latin parts skip the normalizer, which only lower-cases them."""
        if part.isascii() or _PLAIN.fullmatch(part):
            if part.isalpha():
                return self.words[part.lower()]
            head, last = part[:-1], part[-1:]
            if head.isalpha() and "!" <= last <= "~":
                return self.words[head.lower()] + self.words[last]
        if _PLAIN.fullmatch(part) and not any(t in part for t in self.special):
            return b"".join([self.words[w] for w in self.pattern.findall(part.lower())])
        return self._pack(self.tokenizer.encode(part, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        if not self.apart:
            return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        parts = self.parts
        return b"".join([parts[p] for p in text.replace("\n", " ").split(" ")])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; its table of parts lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def public(name: str) -> str:
    """Path of a public tokenizer file by name."""
    import public_tokenizers

    return public_tokenizers.path(name)
