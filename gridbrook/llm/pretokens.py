"""Vocabulary files of public tokenizers and their pre-splitting rules."""

from __future__ import annotations

import functools
import json
import re

#: Letters, numbers and white space among the code points that the fast path takes
#: (U+0000 to U+017F and the dashes and quotes of U+2010 to U+2027), as \p{L}, \p{N} and \s have them.
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ſ"
NUMBER = "0-9²³¹¼-¾"
SPACE = "\t-\r \u0085 "
SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
_OTHER = re.compile("[^\u0000-ſ‐-‧]")
_BYTE_WORDS = re.compile(f"{SUFFIXES}| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_LOWER_WORDS = re.compile(f"{SUFFIXES}|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


BYTE_CHAR = byte_alphabet()
CHAR_BYTE = {c: b for b, c in enumerate(BYTE_CHAR)}


class TokenizerFile:
    """A .json file of the tokenizers library: vocabulary, ranked merges, special tokens and pre-splitting."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        self.path, self.vocab, self.suffix = path, model["vocab"], model["end_of_word_suffix"] or ""
        self.merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.lowers = told["normalizer"] is not None
        pre = told["pre_tokenizer"] or {}
        #: Whether words are split by the byte-level rule alone, on texts as they are.
        self.byte_level = not self.lowers and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space", True) and pre.get("use_regex", True) and not any(" " in t for t in self.special)
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def segments(self, text: str) -> list[tuple[str, int | None]]:
        """Stretches of ordinary text (id None) and the special tokens between them."""
        if not self._split or "<|" not in text:
            return [(text, None)]
        return [(x, self.special.get(x)) for x in self._split.split(text) if x]

    def pieces(self, text: str) -> list[str]:
        """Words of a stretch without special tokens, as the library pre-splits them."""
        if _OTHER.search(text) is None:
            return _LOWER_WORDS.findall(text.lower()) if self.lowers else _BYTE_WORDS.findall(text)
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        return [bytes(CHAR_BYTE[c] for c in x).decode("utf-8", "surrogateescape") for x, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def symbols(self, piece: str) -> list[str]:
        """Initial symbols of a word: a character for each byte, the last with the end-of-word suffix."""
        out = [BYTE_CHAR[b] for b in piece.encode("utf-8", "surrogateescape")]
        if out and self.suffix:
            out[-1] += self.suffix
        return out


@functools.lru_cache(maxsize=8)
def load(path: str) -> TokenizerFile:
    """The file, parsed once for each Python worker."""
    return TokenizerFile(path)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Table(dict):
    """key -> value by ``make``, None where not known without it; of at most 2 * ``most`` entries those not asked for longest go first."""

    def __init__(self, most: int, make=None):
        super().__init__()
        self.most, self.make, self.older = most, make, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None and self.make:
            value = self.make(key)
        if value is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        if len(key) <= 200:
            self[key] = value
