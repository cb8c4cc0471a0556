"""Characters that look the same: equalities, transitive classes, folding.

``fold`` gives text the one form all matching in this package compares.  It does
NFC, maps look-alike letters and full-width forms, turns every space into U+0020
and drops invisible characters.  Letters, case, signs and the script of digits
stay as they are, so texts that differ visibly stay different.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Letters of other scripts drawn like Latin ones.
LOOK_ALIKE_LETTERS = dict(
    zip(
        "АВЕЅІЈКМНОРСТХУаеѕіјорсухһԁԛԝ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο",
        "ABESIJKMHOPCTXYaesijopcyxhdqw" "ABEZHIKMNOPTYXo",
        strict=True,
    )
)

# Sequences drawn like one character, or like another sequence.
LOOK_ALIKE_SEQUENCES = [
    ("अा", "आ"),
    ("अो", "ओ"),
    ("अौ", "औ"),
    ("अाे", "ओ"),
    ("अाै", "औ"),
    ("एे", "ऐ"),
    ("ाे", "ो"),
    ("ाै", "ौ"),
    ("ाॅ", "ॉ"),
    ("अाॅ", "ऑ"),
    ("आॅ", "ऑ"),
    ("अॉ", "ऑ"),
    ("र्‍", "ऱ्"),
    ("અા", "આ"),
    ("ાે", "ો"),
    ("ાૈ", "ૌ"),
    ("‐", "-"),
    ("‑", "-"),
    ("\r\n", "\n"),
]

VIRAMAS = "्્"
NUKTAS = "\u093c\u0abc"
JOINERS = "‌‍"


def invisible(c: str) -> bool:
    """Format characters, variation selectors, fillers and others that leave no mark on the page."""
    cp = ord(c)
    return unicodedata.category(c) == "Cf" and not 0x600 <= cp <= 0x8FF or c in "͏ᅟᅠ឴឵ㅤﾠ" or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or 0x180B <= cp <= 0x180F


@lru_cache(maxsize=1)
def equalities() -> list[tuple[str, str]]:
    """Pairs of strings that look the same, from the character database and the lists above."""
    pairs = [*LOOK_ALIKE_LETTERS.items(), *LOOK_ALIKE_SEQUENCES]
    for cp in range(0x80, 0x110000):
        if 0xD800 <= cp < 0xF900 or 0x3400 <= cp < 0xD7A4 or 0x1F000 <= cp < 0xE0000 or cp >= 0xE0200:  # surrogates, ideographs, pictures, private use
            continue
        c = chr(cp)
        kind, _, rest = unicodedata.decomposition(c).partition(" ")
        if kind in ("<wide>", "<narrow>", "<noBreak>") and " " not in (plain := unicodedata.normalize("NFKC", c)):
            pairs.append((c, plain))
        if unicodedata.category(c) == "Zs" or cp == 0x2800:  # the braille pattern without dots is a blank
            pairs.append((c, " "))
        elif invisible(c):
            pairs.append((c, ""))
    # A joiner after a virama shapes the letter: it is seen, so it stays.
    pairs += [(v + j, v + j) for v in VIRAMAS for j in JOINERS]
    return [(unicodedata.normalize("NFC", a), unicodedata.normalize("NFC", b)) for a, b in pairs]


def classes(pairs: list[tuple[str, str]]) -> list[list[str]]:
    """Transitive classes by union-find with path halving and union by size."""
    parent: dict[str, str] = {}
    size: dict[str, int] = {}

    def root(x: str) -> str:
        parent.setdefault(x, x)
        size.setdefault(x, 1)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            if size[ra] < size[rb]:
                ra, rb = rb, ra
            parent[rb] = ra
            size[ra] += size[rb]
    groups: dict[str, list[str]] = {}
    for x in parent:
        groups.setdefault(root(x), []).append(x)
    return [sorted(g) for g in groups.values()]


def rewriting(freq: dict[str, int] | None = None) -> dict[str, str]:
    """Each member of a class to the class's most frequent member.

    The empty string leads its class whatever the counts; without counts, ASCII leads,
    then the shortest.  A string that is its own representative is kept only when it
    protects a sequence (length over one)."""
    freq = freq or {}
    out = {}
    for group in classes(equalities()):
        rep = "" if "" in group else min(group, key=lambda s: (-freq.get(s, 0), not s.isascii(), len(s), s))
        for s in group:
            if s and (s != rep or len(s) > 1):
                out[s] = rep
    return out


class Rewriter:
    """Greedy leftmost-longest rewriting of a text with an Aho-Corasick automaton."""

    def __init__(self, mapping: dict[str, str]):
        import ahocorasick

        self.mapping = mapping
        self.automaton = ahocorasick.Automaton()
        for s, rep in mapping.items():
            self.automaton.add_word(s, (len(s), rep))
        self.automaton.make_automaton()
        # A class of the basic plane is a table; one with characters beyond it would be searched one by one.
        firsts = "".join(sorted({s[0] for s in mapping if len(s) == 1 and s < "\U00010000"}))
        self.single = re.compile("[" + re.escape(firsts) + "]").search
        self.beyond = re.compile("[\U00010000-\U0010ffff]").search
        self.longer = [s for s in mapping if len(s) > 1 and mapping[s] != s and s[0] not in firsts]

    def touched(self, text: str) -> bool:
        return not text.isascii() and (self.single(text) is not None or self.beyond(text) is not None) or any(s in text for s in self.longer)

    def __call__(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        for _ in range(len(text) + 1):  # a rewriting may complete a longer sequence; each shortens the text or settles it
            if not self.touched(text):
                return text
            out, at = [], 0
            for end, (n, rep) in self.automaton.iter_long(text):
                out.append(text[at : end + 1 - n])
                out.append(rep)
                at = end + 1
            out.append(text[at:])
            new = unicodedata.normalize("NFC", "".join(out))
            if new == text:
                return text
            text = new
        return text


@lru_cache(maxsize=1)
def default_rewriter() -> Rewriter:
    return Rewriter(rewriting())


def fold(text: str) -> str:
    """The one form of ``text`` used for matching; see the module docstring."""
    return default_rewriter()(text)


@lru_cache(maxsize=1)
def loose_table() -> dict[int, int | None]:
    """For ``str.translate``: digits of any script to ASCII, anything but letters, marks and digits to a space."""
    table: dict[int, int | None] = {}
    for cp in range(0x3100):
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind == "Nd":
            table[cp] = 48 + unicodedata.digit(c)
        elif kind[0] not in "LM":
            table[cp] = 32
    return table


#: Everything that is a digit of a script in use here, as a regular-expression class.
DIGIT = "0-9०-९૦-૯"


@lru_cache(maxsize=1)
def _flags():
    """Per code point: 1 may need folding, 2 may begin and 4 may end a look-alike sequence; 16 is a nukta, 8 changes before one."""
    import numpy as np

    flags = np.zeros(0x110000, dtype=np.uint8)
    r = default_rewriter()
    for cp in range(0x80, 0x10000):
        c = chr(cp)
        if not 0xD800 <= cp < 0xE000 and (r.mapping.get(c, c) != c or unicodedata.normalize("NFC", c) != c):
            flags[cp] = 1
        if unicodedata.combining(c) and c not in VIRAMAS:
            flags[cp] |= 16 if c in NUKTAS else 1
        if not 0xD800 <= cp < 0xE000 and (unicodedata.combining(c) or any(unicodedata.normalize("NFC", c + x) != c + x for x in NUKTAS)):
            flags[cp] |= 8
    flags[0x10000:] |= 1
    for s in r.longer:
        flags[ord(s[0])] |= 2
        flags[ord(s[-1])] |= 4
    # The nukta is common in plain text: only after letters that compose with it, and after other marks, does it matter.
    return flags


@lru_cache(maxsize=1)
def _sequences():
    """What look-alike sequences begin with: both code points as one number.  Those of a letter, a virama and a joiner are told by the joiner."""
    import numpy as np

    return np.array(sorted({ord(s[0]) << 21 | ord(s[1]) for s in default_rewriter().longer if len(s) == 2 or s[2] != "\u200d"}), dtype=np.int64)


#: Characters that ``fold_all`` looks at in one go: few enough that its arrays are made in memory already touched.
AT_ONCE = 200_000


def fold_all(texts: list[str]) -> list[str]:
    """``fold`` of each text, calling it only for texts that hold a character it may change."""
    out: list[str] = []
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t) + 1
        if held >= AT_ONCE:
            out += _fold_some(texts[start : i + 1])
            start, held = i + 1, 0
    return out + _fold_some(texts[start:])


def _fold_some(texts: list[str]) -> list[str]:
    import numpy as np

    if not texts:
        return []
    joined = "\n".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    flags = _flags()[codes]
    before, after = flags[:-1], flags[1:]
    # A joiner is a hit by itself, so that sequences with one need no look of their own.
    hit = flags & 1
    hit[1:] |= (before >> 3) & (after >> 4) & 1
    pair = np.flatnonzero((before >> 1) & (after >> 2) & 1)
    hit[pair[np.isin(codes[pair].astype(np.int64) << 21 | codes[pair + 1], _sequences())] + 1] = 1
    at = np.flatnonzero(hit)
    if not len(at):
        return texts
    starts = np.zeros(len(texts), dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts[:-1]], out=starts[1:])
    of = np.searchsorted(starts, at, "right") - 1
    out = list(texts)
    for i, own in zip(of[(first := np.flatnonzero(np.diff(of, prepend=-1)))].tolist(), np.split(at, first[1:])):
        out[i] = _fold_lines(texts[i], (own - starts[i]).tolist())
    return out


def _fold_lines(text: str, at: list[int]) -> str:
    """``fold`` of a text whose changes all lie in lines with a place of ``at``; a line ends with its line feed, before which nothing is joined with what follows."""
    out, done = [], 0
    for i in at:
        if done <= i < len(text):  # after the text stands what parts it from the next
            start, end = text.rfind("\n", 0, i) + 1, text.find("\n", i) + 1 or len(text)
            out += [text[done:start], fold(text[start:end])]
            done = end
    return "".join(out) + text[done:]
