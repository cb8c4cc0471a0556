"""A unigram tokenizer over a table of pieces, and byte-pair encoding with byte fallback."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words whose ids are remembered in a worker.
REMEMBERED = 500_000


class Unigram:
    """Cuts words into listed pieces with the highest sum of scores; a character that is no piece is its UTF-8 bytes.

    A word is what stands between white space, with a mark before it.  Of cuts with equal sums the one of fewer tokens counts."""

    def __init__(self, pieces: list[tuple[int, str, str, float]], mark: str = "▁", byte_score: float = -20.0):
        self.ids = {p: (i, s) for i, p, kind, s in pieces if kind == "piece"}
        self.bytes = {int(p[3:5], 16): i for i, p, kind, _ in pieces if kind == "byte"}
        self.byte_score = min((s for *_, kind, s in pieces if kind == "byte"), default=byte_score)
        self.longest = max(map(len, self.ids), default=1)
        self.mark = mark
        self.known: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        text = self.mark + word
        best: list[tuple[float, int, int, list[int]]] = [(0.0, 0, 0, [])] + [(-math.inf, 0, 0, [])] * len(text)
        for i, c in enumerate(text):
            score, n = best[i][:2]
            if c not in self.ids:
                own = [self.bytes.get(b, 0) for b in c.encode("utf-8", "surrogatepass")]
                best[i + 1] = max(best[i + 1], (score + len(own) * self.byte_score, n - len(own), i, own), key=lambda x: x[:2])
            for j in range(i + 1, min(len(text), i + self.longest) + 1):
                piece = self.ids.get(text[i:j])
                if piece and (score + piece[1], n - 1) > best[j][:2]:
                    best[j] = (score + piece[1], n - 1, i, [piece[0]])
        out: list[list[int]] = []
        at = len(text)
        while at:
            out.append(best[at][3])
            at = best[at][2]
        return [i for part in reversed(out) for i in part]

    def encode(self, text: str) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        out: list[int] = []
        for w in text.split():
            ids = self.known.get(w)
            if ids is None:
                ids = self.known[w] = self.word(w)
            out += ids
        return out


def piece_encoder(pieces: list[tuple[int, str, str, float]]):
    """A maker of encoders for ``packing.encode_with``."""
    return lambda: Unigram(pieces).encode


class BytePairs:
    """Byte-pair encoding by merges in order; characters outside the alphabet are bytes, so every text comes back.

    Ids: special symbols, the 256 bytes, the alphabet, then what merges make."""

    def __init__(self, alphabet: list[str], merges: list[tuple[str, str]], special: tuple[str, ...] = ()):
        made = [a + b for a, b in merges]
        names = [*special, *(f"<0x{b:02X}>" for b in range(256)), *dict.fromkeys([*alphabet, "▁", *made])]
        self.id = {x: i for i, x in enumerate(names)}
        self.name, self.special = names, special
        self.rank = {m: k for k, m in enumerate(merges)}
        self.alphabet = frozenset(alphabet) | {"▁"}

    def word(self, word: str) -> list[str]:
        parts: list[str] = []
        for c in word:
            parts += [c] if c in self.alphabet else [f"<0x{b:02X}>" for b in c.encode("utf-8", "surrogatepass")]
        while len(parts) > 1:
            k = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), math.inf))
            if (parts[k], parts[k + 1]) not in self.rank:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def encode(self, text: str) -> list[int]:
        """Ids; a mark stands for a space, special symbols in the text are one id each."""
        import re

        out: list[int] = []
        for part in re.split("(" + "|".join(map(re.escape, self.special)) + ")", text) if self.special else [text]:
            if part in self.special:
                out.append(self.id[part])
            else:
                for w in re.findall(r" ?[^ ]+| ", part):
                    out += [self.id[x] for x in self.word(w.replace(" ", "▁"))]
        return out

    def decode(self, ids: list[int]) -> str:
        raw = b""
        for i in ids:
            x = self.name[i]
            byte = x.startswith("<0x") and len(x) == 6 and i < len(self.special) + 256
            raw += bytes([int(x[3:5], 16)]) if byte else x.replace("▁", " ").encode("utf-8", "surrogatepass")
        return raw.decode("utf-8", "surrogatepass")


def token_count(ids: Column) -> Column:
    return F.size(ids).cast("bigint")
