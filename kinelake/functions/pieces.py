"""Texts to tokens and back by a look-up of pieces, as the library of a tokenizer's file gives them.

A text's tokens are those of its pre-tokens, in order, and a token of a
byte-level vocabulary stands for bytes. Pre-tokens are found with the pattern
of byte-level vocabularies, written out for the characters of everyday texts;
texts with any other character (controls, marks, rare scripts) or with a
special string go to the library whole, as do all texts if the file splits or
normalises them in another way.
"""

from __future__ import annotations

import codecs
import json
import os
import re
from array import array
from collections.abc import Callable

import numpy as np

#: The characters of everyday texts, by kind; a text with any other goes to the library whole.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ȳΑ-ΡΣ-ϵϷ-ϿЀ-ҁぁ-ゖァ-ヺ一-龥가-힣"
NUMBERS = "0-9²³¹¼-¾"
SPACES = "\t\n\r \xa0"
OTHERS = "!-/:-@\\[-`{-~¡-©«-±´¶-¸»¿×÷϶‐-‧‰-⁞€"
PLAIN = re.compile(f"[{LETTERS}{NUMBERS}{SPACES}{OTHERS}]*")
#: The pattern by which byte-level vocabularies of this kind split texts, for these characters.
PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[{OTHERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
#: Byte-level vocabularies write a byte as the Latin-1 character if that is visible, else as the next one from U+0100 on.
VISIBLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTES = {b: 0x100 + i for i, b in enumerate(b for b in range(0x100) if b not in VISIBLE)}
CHARS = "".join(chr(BYTES.get(b, b)) for b in range(0x100))


def loaded(spec: str):
    """The tokenizer, without the truncation and padding that its file may ask for."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(spec)
    tok.no_truncation()
    tok.no_padding()
    return tok


def splits_by_pattern(spec: str) -> bool:
    """Whether the file takes texts as they are and splits them by ``PATTERN``."""
    file = json.loads(spec)
    split = file.get("pre_tokenizer") or {}
    return not file.get("normalizer") and split.get("type") == "ByteLevel" and not split.get("add_prefix_space", True) and split.get("use_regex", True)


def specials(spec: str) -> re.Pattern:
    """What finds a special string of the file."""
    special = [t["content"] for t in json.loads(spec).get("added_tokens") or []]
    return re.compile("|".join(map(re.escape, special)) or "(?!)")


def written(piece: str) -> str:
    """A pre-token as byte-level vocabularies write it."""
    return codecs.charmap_decode(piece.encode("utf-8", "surrogatepass"), "strict", CHARS)[0]


class Tokens(dict):
    """The tokens of pre-tokens, as bytes of 32-bit numbers. About ``entries`` of those used last are kept, in two generations."""

    def __init__(self, tok, entries: int):
        super().__init__()
        self.encode, self.most, self.old = tok.model.tokenize, entries // 2, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        found = self.old.get(piece)
        if found is None:
            found = array("i", [t.id for t in self.encode(written(piece))]).tobytes()
        self[piece] = found
        return found


def encoder(tok, spec: str, entries: int = 1 << 19) -> Callable[[list[str]], list[np.ndarray]]:
    """Tokens of texts, without added special tokens."""

    def whole(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    if not splits_by_pattern(spec) or json.loads(spec)["model"].get("dropout"):
        return whole
    plain, special, findall, tokens = PLAIN.fullmatch, specials(spec).search, PATTERN.findall, Tokens(tok, entries).__getitem__

    def encode(texts: list[str]) -> list[np.ndarray]:
        pieces = [findall(t) if plain(t) and not special(t) else None for t in texts]
        others = iter(whole([t for t, p in zip(texts, pieces) if p is None]))
        return [next(others) if p is None else np.frombuffer(b"".join(map(tokens, p)), np.int32) for p in pieces]

    return encode


def decoder(tok, spec: str, most: int = 1 << 16) -> Callable[[list[np.ndarray]], list[str]]:
    """Texts of tokens, special ones included; of a long text, ``most`` tokens at a time."""

    def whole(tokens: list[np.ndarray]) -> list[str]:
        return tok.decode_batch([x.tolist() for x in tokens], skip_special_tokens=False)

    if (json.loads(spec).get("decoder") or {}).get("type") != "ByteLevel":
        return whole
    names = [tok.id_to_token(i) or "" for i in range(max(tok.get_vocab(with_added_tokens=True).values(), default=-1) + 1)]
    pieces = [bytes(map(CHARS.index, t)) if set(CHARS).issuperset(t) else t.encode() for t in names]
    data, sizes = np.frombuffer(b"".join(pieces), np.uint8), np.array([*map(len, pieces)], np.int64)
    starts = np.cumsum(sizes) - sizes

    def raw(x: np.ndarray) -> bytes:
        n = sizes[x]
        end = np.cumsum(n)
        return data[np.repeat(starts[x] - end + n, n) + np.arange(end[-1])].tobytes()

    def decode(xs: list[np.ndarray]) -> list[str]:
        """What isn't a token's number is the library's to judge."""
        known = [not len(x) or (0 <= x.min() and x.max() < len(sizes)) for x in xs]
        others = iter(whole([x for x, k in zip(xs, known) if not k]))
        return [b"".join(raw(x[i : i + most]) for i in range(0, len(x), most)).decode("utf-8", "replace") if k else next(others) for x, k in zip(xs, known)]

    return decode


_files: dict[str, tuple] = {}


def both_ways(key: str, is_model: bool, data: bytes) -> tuple[Callable, Callable]:
    """``encode`` and ``decode`` over lists of texts and of arrays, by a file of the tokenizers or SentencePiece libraries.

    A worker process keeps those of one file, by its ``key``.
    """
    if key not in _files:
        _files.clear()
        if is_model:
            from sentencepiece import SentencePieceProcessor

            sp = SentencePieceProcessor(model_proto=data)
            _files[key] = (lambda ts: [np.array(sp.encode(t), np.int32) for t in ts]), (lambda xs: [sp.decode(x.tolist()) for x in xs])
        else:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel ones
            spec = data.decode("utf-8")
            tok = loaded(spec)
            _files[key] = encoder(tok, spec), decoder(tok, spec)
    return _files[key]
