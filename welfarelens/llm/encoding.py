"""Token ids of whole texts with a public tokenizer, fast for texts that repeat their words.

The pieces between white space are encoded once per worker and looked up afterwards; words of letters only go straight
to the library's model, which spares the library's bookkeeping for whole texts. This gives the ids of the whole
text because neither of the two supported kinds of tokenizer merges across such a boundary:

* ``byte``: byte-level pieces carry one leading space. A text is cut before every single space that stands between
  two characters that are no white space.
* ``word``: white space is dropped. A text is cut at any white space.

Texts with white space other than single spaces and line ends or with marks of special tokens are encoded whole, and so
is every text of any other kind of tokenizer.
"""

from __future__ import annotations

import array
import json
import os
import re
import string
import sys

from welfarelens.llm.kept import at_work

#: Pieces kept per worker; beyond that the memory starts anew, which changes no result.
KEPT_PIECES = 600_000
#: Longer pieces are not kept.
KEPT_LENGTH = 64

_RARE_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_BEYOND_LATIN = re.compile("[^\x00-\u02ff]")
_ENCODERS: dict[str, "Encoder"] = {}


def little_endian(ids) -> bytes:
    out = array.array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def kind(spec: dict) -> str:
    """``byte``, ``word`` or ``whole`` from a tokenizer's description."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
        return "byte"
    first = (pre.get("pretokenizers") or [{}])[0]
    steps = [x.get("type") for x in norm.get("normalizers", [])]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    if first.get("type") == "Split" and first.get("invert") and r"[^\s" in pattern and steps == ["NFC", "Replace", "Lowercase"]:
        return "word"
    return "whole"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class Pieces(dict):
    """Ids of pieces that stand at the start of a text or line (``spaced`` false) or after a space, made when first asked for."""

    def __init__(self, encoder: "Encoder", spaced: bool):
        super().__init__()
        self.encoder, self.spaced = encoder, spaced

    def __missing__(self, piece: str) -> bytes:
        ids = self.encoder.piece(piece, self)
        if len(piece) <= KEPT_LENGTH:
            self[piece] = ids
        return ids


class Encoder:
    def __init__(self, description: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(description)
        self.tokenizer = Tokenizer.from_str(description)
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.kind = kind(spec)
        self.marks = [x["content"] for x in spec.get("added_tokens", [])]
        self.size = self.tokenizer.get_vocab_size()
        self.letters = str.maketrans(dict(enumerate(byte_letters())))
        self.bare, self.after = Pieces(self, False), Pieces(self, True)
        self.space = self.letters[32]

    @classmethod
    def of(cls, description: str) -> "Encoder":
        """One encoder per worker and tokenizer."""
        if description not in _ENCODERS:
            _ENCODERS[description] = cls(description)
        return _ENCODERS[description]

    def _whole(self, text: str) -> bytes:
        return little_endian(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def word_ids(self, word: str, spaced: bool) -> list[int]:
        """Ids of a normalized word of letters only, from the model's merges."""
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(self.space + spelled if spaced else spelled)]

    def piece(self, piece: str, kin: Pieces) -> bytes:
        """Ids of a piece from the model's merges of its words. ``kin``: the pieces it belongs to."""
        word = piece
        if self.kind == "word":
            # characters below U+0300 do not combine, and their lower case depends on none beside them
            word = piece.lower() if piece.isascii() or not _BEYOND_LATIN.search(piece) else self.normalizer.normalize_str(piece)
        if word.isalpha():
            return little_endian(self.word_ids(word, kin.spaced))
        core = word.rstrip(string.punctuation)
        if core != word and core.isalpha():  # both kinds of tokenizers cut between a word and punctuation
            return kin[core] + self.bare[word[len(core) :]]
        if "\n" in piece and (lines := piece.split("\n")) == piece.split():  # and on both sides of a single line end
            return kin[lines[0]] + b"".join([self._whole("\n") + self.bare[x] for x in lines[1:]])
        return self._whole(" " + piece if kin.spaced else piece)

    def _encode(self, text: str) -> bytes:
        if self.kind == "whole" or any(m in text for m in self.marks):
            return self._whole(text)
        rare = _RARE_SPACE.search(text)
        if self.kind == "word":
            return self._whole(text) if rare else b"".join(map(self.bare.__getitem__, text.split()))
        if rare or "  " in text or " \n" in text or "\n " in text or not text:
            return self._whole(text)
        first, *rest = text.split(" ")
        return (self.bare[first] if first else b"") + b"".join(map(self.after.__getitem__, rest))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers; a null is an empty text."""
        at_work("pieces", _ENCODERS.clear)
        if len(self.bare) + len(self.after) > KEPT_PIECES:
            self.bare.clear()
            self.after.clear()
        return [self._encode(t or "") for t in texts]


def read_description(path: str) -> str:
    """The tokenizer's file, read by the driver; it is a few MB and goes to the workers as a broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()
