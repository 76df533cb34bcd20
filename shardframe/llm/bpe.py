"""Token ids of whole texts by a table of words: the library merges a word once, later ones are looked up.

A byte-pair encoding works on one pre-token at a time, so a text's ids are those of its pre-tokens in order; and a
pre-token never reaches across the space before a word. So a text is cut at its spaces, and what a word encodes to is
kept in a bounded table. The classes of characters beyond Latin Extended-A depend on the Unicode version, so a word that
has one goes to the library whole, and the others stay with the table; runs of white space go by pre-token.
"""

from __future__ import annotations

import re
import sys
from array import array

import public_tokenizers
from tokenizers import Tokenizer

#: Letters, digits and white space among the characters up to U+017F.
LETTER, DIGIT, SPACE = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
CONTRACTION = "'(?:s|t|re|ve|m|ll|d)"
#: The pre-tokens of the byte-level and of the word vocabulary.
BYTE_LEVEL = rf"{CONTRACTION}| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^{SPACE}{LETTER}{DIGIT}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
WORD_LEVEL = rf"{CONTRACTION}|[{LETTER}]+|[{DIGIT}]|[^{SPACE}{LETTER}{DIGIT}]+"
#: Of the characters up to U+017F only İ becomes two in lower case. str.split() takes 28 to 31 as white space, the library not.
RARE = re.compile("[^\x00-\x1b\x20-įı-ſ]")
#: Characters that are or once were white space beyond those.
WHITE = "\x1c-\x1f\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
#: Where a pre-token ends whatever the characters around: before a single space between two that are no white space.
CUT = re.compile(rf"(?<=[^{SPACE}{WHITE}])(?= [^{SPACE}{WHITE}])")
#: A space beside other white space: there a run's pre-tokens reach across it.
RUN = re.compile(rf" [{SPACE}]|[\t-\r\x85\xa0] ")

#: Words in each of the two generations of a worker's table.
KEPT = 400_000


class Words(dict):
    """Word -> value, filled by make, in two generations: the older one goes when the younger is full."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= 64:
            if len(self) >= KEPT:
                self.old = dict(self)
                self.clear()
            self[word] = value
        return value


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes in order from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Ids of whole texts as the library gives them: special strings as its default, none added, nothing cut."""

    def __init__(self, name: str):
        self.library = Tokenizer.from_file(public_tokenizers.path(name))
        self.library.no_truncation()
        self.library.no_padding()
        self.merge = self.library.model.tokenize
        self.alphabet = byte_letters()
        self.lower = self.library.normalizer is not None
        self.findall = re.compile(WORD_LEVEL if self.lower else BYTE_LEVEL).findall
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")")
        self.specials = {s: self.by_library(s) for s in special}

    def by_library(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def piece(self, piece: str) -> list[int]:
        """The ids of one pre-token."""
        return [t.id for t in self.merge(piece.encode().decode("latin-1").translate(self.alphabet))]

    def tables(self, pack) -> None:
        """The tables of words and of pre-tokens: pack makes a value of one pre-token, values add up."""
        before = "" if self.lower else " "
        ends = {p: pack(p) for p in ",.;:!?"}
        add = b"".join if isinstance(ends["."], bytes) else sum

        def make(word: str):
            if word.isalpha():
                return pack(before + word)
            if word[-1:] in ends and word[:-1].isalpha():
                return self.words(word[:-1]) + ends[word[-1]]
            return add(map(pack, self.findall(before + word)))

        self.words, self.runs = Words(make).__getitem__, Words(pack).__getitem__

    def parts(self, text: str, rare, special, words, runs) -> list:
        """The values of a text's parts in order: rare for a word with rare characters, special for a special string, words
        for the words of a part, runs for the pre-tokens of a part with runs of white space."""
        if "<|" not in text:
            return self.pieces(text, rare, words, runs)
        out: list = []
        for part in self.special.split(text):
            out += [special(part)] if part in self.specials else self.pieces(part, rare, words, runs)
        return out

    def pieces(self, text: str, rare, words, runs) -> list:
        if not RARE.search(text):
            return self.plain(text, words, runs)
        out, held = [], []
        for piece in CUT.split(text):
            if RARE.search(piece):
                if held:
                    out += self.plain("".join(held), words, runs)
                    held = []
                out.append(rare(piece))
            else:
                held.append(piece)
        return out + (self.plain("".join(held), words, runs) if held else [])

    def plain(self, text: str, words, runs) -> list:
        if self.lower:
            return list(map(words, text.lower().split()))
        if RUN.search(text):
            return list(map(runs, self.findall(text)))
        first, *others = text.split(" ")
        return [*map(runs, self.findall(first)), *map(words, others)]


class ByteEncoder(Encoder):
    """Ids as little-endian bytes."""

    def __init__(self, name: str, code: str = "I"):
        super().__init__(name)
        self.code, self.width = code, array(code).itemsize
        self.tables(lambda piece: self.packed(self.piece(piece)))
        self.rare = lambda text: self.packed(self.by_library(text))
        self.one = {s: self.packed(ids) for s, ids in self.specials.items()}.__getitem__

    def packed(self, ids: list[int]) -> bytes:
        found = array(self.code, ids)
        if sys.byteorder == "big":
            found.byteswap()
        return found.tobytes()

    def __call__(self, text: str) -> bytes:
        return b"".join(self.parts(text, self.rare, self.one, self.words, self.runs))


_encoders: dict[tuple[str, str], ByteEncoder] = {}


def byte_encoder(name: str, code: str = "I") -> ByteEncoder:
    """One encoder per worker process, vocabulary and width (array's code: I for 4 bytes, H for 2)."""
    if (name, code) not in _encoders:
        _encoders[name, code] = ByteEncoder(name, code)
    return _encoders[name, code]
