"""Byte-pair merges of counted words, held in arrays in files: memory does not grow with the words."""

from __future__ import annotations

import heapq
import os
import tempfile
from collections.abc import Iterable, Iterator

#: Pairs, and places of pairs, that are indexed at a time; what is beyond is counted anew when its turn comes.
INDEXED_PAIRS, INDEXED_PLACES = 100_000, 4_000_000
#: Symbols looked at in one go, and words taken in one.
SYMBOLS, WORDS = 2_000_000, 50_000
#: Places that are no symbol: ends of words, what is never merged, and what a merge has taken in.
END, OTHER, GONE = -1, -2, -3


def learned(words: Iterable[tuple[str, int]], merges: int, alphabet: list[str] | None = None, pairs: int = INDEXED_PAIRS, places: int = INDEXED_PLACES) -> list[tuple[str, str]]:
    """The merges in order; ties go to the smaller pair, and a pair seen once is none.

    All words count.  Only the first pairs in order are indexed with their places; when they are
    used up, all pairs are counted again, so ``pairs`` and ``places`` do not change what is learned."""
    with tempfile.TemporaryDirectory() as folder:
        m = _Merger(folder, pairs, places)
        m.read(words, alphabet)
        return m.run(merges)


def _grouped(keys, weights):
    """(distinct keys, their sums, the order that sorts the keys, where each begins in it)."""
    import numpy as np

    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, dtype=np.int64)
    return k[first], np.add.reduceat(weights[order], first) if len(k) else weights[:0], order, first


class _Merger:
    def __init__(self, folder: str, pairs: int, places: int):
        self.folder, self.most_pairs, self.most_places = folder, pairs, places
        self.tokens: list[str] = []
        self.ids: dict[str, int] = {}

    def _id(self, token: str) -> int:
        if token not in self.ids:
            self.ids[token] = len(self.tokens)
            self.tokens.append(token)
        return self.ids[token]

    def _mapped(self, name: str, dtype: str):
        import numpy as np

        return np.asarray(np.memmap(os.path.join(self.folder, name), dtype=dtype, mode="r+"))

    def read(self, words: Iterable[tuple[str, int]], alphabet: list[str] | None) -> None:
        """Writes each word as an end and its symbols, and for each place its word; a last end closes."""
        import numpy as np

        known = None if alphabet is None else frozenset(alphabet)
        start = self._id("▁")
        of = np.full(0x110000, GONE, dtype=np.int32)
        of[0], of[10] = OTHER, END
        n_words = 0
        with open(os.path.join(self.folder, "symbols0"), "wb") as symbols, open(os.path.join(self.folder, "word0"), "wb") as word, open(os.path.join(self.folder, "n"), "wb") as counts:
            for some in self._taken(words):
                # No word holds a line feed, which is white space.
                codes = np.frombuffer("".join(["\n▁" + w for w, _ in some]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                for c in np.unique(codes[of[codes] == GONE]).tolist():
                    of[c] = self._id(chr(c)) if known is None or chr(c) in known else OTHER
                got = of[codes]
                ends = np.flatnonzero(got == END)
                got[ends + 1] = start
                symbols.write(got.tobytes())
                word.write(np.repeat(np.arange(n_words, n_words + len(some), dtype=np.int32), np.diff(np.append(ends, len(got)))).tobytes())
                counts.write(np.array([n for _, n in some], dtype=np.int64).tobytes())
                n_words += len(some)
            symbols.write(np.array([END], dtype=np.int32).tobytes())
            word.write(np.zeros(1, dtype=np.int32).tobytes())
        self.round = 0
        self.n = self._mapped("n", "int64") if n_words else np.zeros(1, dtype=np.int64)
        self.sym, self.word = self._mapped("symbols0", "int32"), self._mapped("word0", "int32")

    @staticmethod
    def _taken(words: Iterable[tuple[str, int]]) -> Iterator[list[tuple[str, int]]]:
        some: list[tuple[str, int]] = []
        for w in words:
            some.append(w)
            if len(some) == WORDS:
                yield some
                some = []
        if some:
            yield some

    def _blocks(self) -> Iterator[tuple[int, int]]:
        return ((a, min(a + SYMBOLS, len(self.sym))) for a in range(0, len(self.sym), SYMBOLS))

    def _close_up(self) -> None:
        """Leaves out places that merges have taken in; from here on each symbol is one place long."""
        import numpy as np

        if self.round:
            old, new = self.round - 1, self.round
            with open(os.path.join(self.folder, f"symbols{new}"), "wb") as symbols, open(os.path.join(self.folder, f"word{new}"), "wb") as word:
                for a, b in self._blocks():
                    sym, of = np.array(self.sym[a:b]), np.array(self.word[a:b])
                    stays = sym != GONE
                    symbols.write(sym[stays].tobytes())
                    word.write(of[stays].tobytes())
            self.sym = self.word = self.length = None
            for name in ("symbols", "word", "length"):
                os.remove(os.path.join(self.folder, f"{name}{old}"))
            self.sym, self.word = self._mapped(f"symbols{new}", "int32"), self._mapped(f"word{new}", "int32")
        with open(os.path.join(self.folder, f"length{self.round}"), "wb") as f:
            for a, b in self._blocks():
                f.write(np.ones(b - a, dtype=np.int32).tobytes())
        self.length = self._mapped(f"length{self.round}", "int32")
        self.round += 1

    def _pairs_at(self, at):
        """(places of ``at`` where a pair begins, its key, its word's count)."""
        import numpy as np

        left, right = self.sym[at], self.sym[at + self.length[at]]
        ok = (left >= 0) & (right >= 0)
        at = at[ok]
        return at, left[ok].astype(np.int64) << 32 | right[ok], self.n[self.word[at]]

    def _index(self) -> None:
        """Counts all pairs and indexes the first in order."""
        import numpy as np

        self._close_up()
        keys = counts = held = np.zeros(0, dtype=np.int64)
        for a, b in self._blocks():
            at, k, n = self._pairs_at(np.arange(a, min(b, len(self.sym) - 1)))
            k, n, _, first = _grouped(k, n)
            size = np.diff(np.append(first, len(at)))
            keys, sums, order, first = _grouped(np.concatenate([keys, k]), np.concatenate([counts, n]))
            held = np.add.reduceat(np.concatenate([held, size])[order], first) if len(order) else held
            counts = sums
        more = counts > 1
        keys, counts, held = keys[more], counts[more], held[more]
        rank = np.empty(len(self.tokens), dtype=np.int64)
        rank[sorted(range(len(self.tokens)), key=self.tokens.__getitem__)] = np.arange(len(self.tokens))
        order = np.lexsort((rank[keys & 0xFFFFFFFF], rank[keys >> 32], -counts))
        most = max(1, min(self.most_pairs, int(np.searchsorted(np.cumsum(held[order]), self.most_places, "right"))))
        chosen = order[:most]
        #: The last pair in order that is indexed; None if all are.
        self.last = None
        self.least = 2
        if most < len(keys):
            k, self.least = int(keys[chosen[-1]]), int(counts[chosen[-1]])
            self.last = (-self.least, self.tokens[k >> 32], self.tokens[k & 0xFFFFFFFF])
        known = np.sort(keys[chosen])
        self.count = dict(zip(keys[chosen].tolist(), counts[chosen].tolist()))
        self.at: dict[int, list] = {}
        del keys, counts, held, order, chosen
        found_at, found = [], []
        for a, b in self._blocks() if len(known) else ():
            at, k, _ = self._pairs_at(np.arange(a, min(b, len(self.sym) - 1)))
            place = np.minimum(np.searchsorted(known, k), len(known) - 1)
            mine = known[place] == k
            found_at.append(at[mine])
            found.append(place[mine].astype(np.int32))
        if found:
            at, place = np.concatenate(found_at), np.concatenate(found)
            del found_at, found
            order = np.argsort(place, kind="stable")
            ends = np.cumsum(np.bincount(place, minlength=len(known)))
            at = at[order]
            for k, a, b in zip(known.tolist(), [0, *ends[:-1].tolist()], ends.tolist()):
                self.at[k] = [at[a:b]]
        self.heap = [self._entry(k, n) for k, n in self.count.items()]
        heapq.heapify(self.heap)

    def _entry(self, key: int, n: int) -> tuple[int, str, str, int]:
        return -n, self.tokens[key >> 32], self.tokens[key & 0xFFFFFFFF], key

    def _within(self, entry: tuple[int, str, str, int]) -> bool:
        return entry[0] < -1 and (self.last is None or entry[:3] <= self.last)

    def run(self, merges: int) -> list[tuple[str, str]]:
        out: list[tuple[str, str]] = []
        self.last, self.heap = (), []
        while len(out) < merges:
            if not self.heap:
                if self.last is None:
                    break
                self._index()
                if not self.heap:
                    break
            entry = heapq.heappop(self.heap)
            key, n = entry[3], self.count.get(entry[3])
            if n is None:
                continue
            if n != -entry[0]:
                # Counts fall unseen; a pair that is not among the first any more waits for the next index.
                now = self._entry(key, n)
                if self._within(now):
                    heapq.heappush(self.heap, now)
                else:
                    del self.count[key], self.at[key]
                continue
            del self.count[key]
            out.append(entry[1:3])
            self._merge(key >> 32, key & 0xFFFFFFFF, self.at.pop(key))
        return out

    def _merge(self, a: int, b: int, at: list) -> None:
        import numpy as np

        sym, length = self.sym, self.length
        left = at[0] if len(at) == 1 else np.unique(np.concatenate(at))
        left = left[sym[left] == a]
        right = left + length[left]
        ok = sym[right] == b
        left, right = left[ok], right[ok]
        if a == b and len(left) > 1:
            # In a run of one symbol each second pair overlaps the one before.
            i = np.arange(len(left))
            opens = np.concatenate([[True], right[:-1] != left[1:]])
            apart = (i - np.maximum.accumulate(np.where(opens, i, 0))) % 2 == 0
            left, right = left[apart], right[apart]
        _, keys, n = self._pairs_at(np.unique(np.concatenate([left - length[left - 1], left, right])))
        keys, n, _, _ = _grouped(keys, n)
        for k, x in zip(keys.tolist(), n.tolist()):
            if k in self.count:
                self.count[k] -= x
        token = self.tokens[a] + self.tokens[b]
        again = token in self.ids
        new = self._id(token)
        whole = length[left] + length[right]
        last = right + length[right] - 1
        sym[left], sym[right] = new, GONE
        length[left] = length[last] = whole
        if again:
            # A symbol made of other parts before: pairs with it are counted wherever it stands.
            left = np.concatenate([s + np.flatnonzero(sym[s:e] == new) for s, e in self._blocks()])
        places, keys, n = self._pairs_at(np.unique(np.concatenate([left - length[left - 1], left])))
        keys, n, order, first = _grouped(keys, n)
        ends = np.append(first[1:], len(order))
        for i in np.flatnonzero(n >= self.least).tolist():
            entry = self._entry(int(keys[i]), int(n[i]))
            if self._within(entry):
                self.count[entry[3]] = -entry[0]
                self.at[entry[3]] = [places[order[first[i] : ends[i]]]]
                heapq.heappush(self.heap, entry)
