"""Byte-level BPE ids by the tokenizers library, with a memory of the words that a task has met.

Byte-level pre-tokenization always begins a token at a single space between two other characters, so a text may be cut
there and its words encoded apart.  A word that is not remembered is cut into pre-tokens and each new pre-token goes
through the library's merge model.  Texts that name a special token, and tokenizers of any other make, are encoded by the
library in one go.

The memory has two generations: when the younger is full, it becomes the older and the words of the older that were not
met since are forgotten.  So it is bounded, and frequent words stay.
"""

from __future__ import annotations

import json
import re
from array import array

import regex
from tokenizers import Tokenizer

KEPT_WORDS = 800_000
# The pattern that byte-level pre-tokenization splits by, and the characters that stand for bytes.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SINGLE = re.compile(r"(?<=\S) (?=\S)")
_MARKS = ",.;:!?"


def byte_characters() -> dict[int, str]:
    """The character of each byte: itself if printed, the others from 256 on."""
    others = [b for b in range(256) if b not in PRINTED]
    return {b: chr(b) for b in PRINTED} | {b: chr(256 + i) for i, b in enumerate(others)}


def plain(text: str) -> bool:
    """Whether all white space is single spaces and single line ends between other characters."""
    if not text or text[0] in " \n" or text[-1] in " \n":
        return False
    return text.replace("\n", "").isprintable() and not any(run in text for run in ("  ", " \n", "\n ", "\n\n"))


class Words(dict):
    """Ids by word; a word that is not here comes from the older generation or is encoded."""

    __slots__ = ("encoder", "older")

    def __init__(self, encoder: Encoder, older: dict[str, bytes]):
        super().__init__()
        self.encoder, self.older = encoder, older

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.encoder.word(word)
        self[word] = found
        return found


class Encoder:
    """Ids of texts, each followed by the end id, as little-endian 32-bit numbers."""

    def __init__(self, path: str, end_id: int, kept_words: int = KEPT_WORDS):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as source:
            made = json.load(source)
        before = made.get("pre_tokenizer") or {}
        self.by_words = made.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True) and made["model"].get("type") == "BPE"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merges, self.split, self.characters = self.tokenizer.model.tokenize, regex.compile(PRE_TOKENS).findall, byte_characters()
        self.kept_words = kept_words
        self.young, self.marks = Words(self, {}), {}
        self.end = array("I", [end_id]).tobytes()

    def part(self, piece: str) -> bytes:
        """Ids of one pre-token."""
        known = self.merges(piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.characters))
        return array("I", [t.id for t in known]).tobytes()

    def word(self, word: str) -> bytes:
        """Ids of a word with the space before it, or with the line end that it begins with."""
        if word.isalpha():
            return self.part(" " + word)
        core = word.rstrip(_MARKS)
        if core.isalpha():
            return self.young[core] + self.mark(word[len(core) :])
        return b"".join(map(self.part, self.split(word if word[:1] == "\n" else " " + word)))

    def mark(self, marks: str) -> bytes:
        found = self.marks.get(marks)
        if found is None:
            found = self.part(marks)
            if len(self.marks) < 1000:
                self.marks[marks] = found
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        cut: list[list[str] | None] = []
        for text in texts:
            if not self.by_words or any(s in text for s in self.special):
                cut.append(None)
            elif plain(text):
                # a line end between two other characters is a token of its own as well
                cut.append(text.replace("\n", " \n").split(" "))
            else:
                cut.append(_SINGLE.split(text))
        heads = [None if words is None else words.pop(0) for words in cut]
        if len(self.young) > self.kept_words:
            self.young = Words(self, dict(self.young))
        known, head = self.young.__getitem__, lambda w: b"".join(map(self.part, self.split(w)))
        return [(self.whole(text) if words is None else head(first) + b"".join(map(known, words))) + self.end for text, first, words in zip(texts, heads, cut)]

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """The encoder of this process, kept from task to task."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]
