"""Evaluation texts leaking into training text (problem 7).

Passages of the held-out items are weighed by TF-IDF, the document frequencies counted over all
documents, and reduced by a distributed randomised SVD (subspace iteration: partitions hold the
passages, only words x rank blocks move).  Windows of every document are folded into that
space; a window whose cosine with a passage is high makes a candidate, and an alignment of the
document with the item (longest common subsequence, then a local alignment that counts other
words) decides.  Items with a passage of too few weighty words for that go to the alignment with
every document that holds enough of their words.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chars import fold_all, loose_table
from .common import by_batch
from .pairs import lcs

#: Items per block; each block's word vectors are what goes to the workers.
ITEMS_PER_BLOCK = 4_000
#: Words in more of the documents than this carry no weight; see ``Searcher.faint`` for items made of them.
MOST_DOCS = 0.1
#: Length and step of an item's passages, and of a document's blocks (a window is three blocks), in words.
PASSAGE, STEP, BLOCK = 16, 8, 8
RANK, EXTRA, ROUNDS = 256, 16, 2
LEAST_COSINE, LEAST_WEIGHTY = 0.4, 3
#: What makes a leak: words of the item, share of the item, other words among ten.
LEAST_WORDS, LEAST_SHARE, OTHERS = 15, 0.4, 0.1
#: What makes a paraphrase: share of a passage's words in order, and of its answers.
PARAPHRASE_WORDS, PARAPHRASE_ANSWERS = 0.5, 0.8
REPORT = "doc_id bigint, item_id bigint, how string, answers double"


_SIGNS = re.compile(r"[^\wऀ-૿]+|_")


def words_of(text: str) -> list[str]:
    """Lower-case words of a folded text, digits of every script as ASCII ones."""
    text = _SIGNS.sub(" ", text.lower())
    if not text.isascii() and _DIGITS.search(text):
        text = _DIGITS.sub(lambda m: m[0].translate(loose_table()), text)
    return text.split()


_DIGITS = re.compile(r"[०-९૦-૯]+")


def document_frequencies(df: DataFrame, vocabulary: list[str], text: str = "text") -> DataFrame:
    """``(word, n)``: in how many documents each word of a bounded vocabulary stands; all documents count."""
    wanted = frozenset(vocabulary)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        got: Counter = Counter()
        for t in fold_all([x for x in batch.column(0).to_pylist() if x]):
            got.update(wanted.intersection(words_of(t)))
        return pa.RecordBatch.from_pydict({"word": list(got), "n": list(got.values())}, schema=schema)

    return by_batch(df.select(text), count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def passages_of(items: list[tuple[int, list[str]]]) -> list[tuple[int, list[str]]]:
    """(item's place, words) of overlapping passages that cover each item."""
    out = []
    for i, (_, words) in enumerate(items):
        starts = list(range(0, max(1, len(words) - PASSAGE + 1), STEP))
        if words and starts[-1] + PASSAGE < len(words):
            starts.append(len(words) - PASSAGE)
        out += [(i, words[a : a + PASSAGE]) for a in starts if words]
    return out


def randomised_svd(rows: DataFrame, width: int, rank: int = RANK, extra: int = EXTRA, rounds: int = ROUNDS, seed: int = 7):
    """The leading right singular vectors (width x rank) of a sparse matrix with rows ``(words array<int>, weights array<float>)``.

    Subspace iteration: each round sends the width x (rank + extra) basis out, and partitions
    send back their share of A'A times it, summed by row of the basis."""
    import numpy as np

    size = min(rank + extra, width)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, size)))[0].astype(np.float32)
    schema = pa.schema([("word", pa.int32()), ("row", pa.binary())])

    def shares(basis):
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            total: dict[int, np.ndarray] = {}
            for ids, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                y = np.array(w, dtype=np.float32) @ basis[ids]
                for i, x in zip(ids, w):
                    if i in total:
                        total[i] += x * y
                    else:
                        total[i] = x * y
            return pa.RecordBatch.from_pydict({"word": list(total), "row": [v.astype(np.float32).tobytes() for v in total.values()]}, schema=schema)

        return run

    def add(pdf):
        import numpy as np
        import pandas as pd

        rows = np.sum([np.frombuffer(x, dtype=np.float32) for x in pdf["row"]], axis=0, dtype=np.float32)
        return pd.DataFrame({"word": [pdf["word"].iloc[0]], "row": [rows.tobytes()]})

    for _ in range(rounds + 1):
        product = np.zeros((width, size), dtype=np.float32)
        for r in by_batch(rows, shares(basis), "word int, row binary").groupBy("word").applyInPandas(add, "word int, row binary").collect():
            product[r["word"]] = np.frombuffer(r["row"], dtype=np.float32)
        small = basis.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        if _ < rounds:
            basis = np.linalg.qr(product)[0].astype(np.float32)
    best = np.argsort(-values)[:rank]
    return np.ascontiguousarray(basis @ turn[:, best]).astype(np.float32)


def aligned(item: list[str], doc: list[str], cost: int = 3) -> tuple[int, int]:
    """(words of the item held, other words among them) of the best local alignment, order kept.

    A word of the item missing in the document, a word of the document between, or one for the
    other, each count as one other word, at the given cost; ends are free."""
    score = [(0, 0, 0)] * (len(doc) + 1)
    best = (0, 0, 0)
    for x in item:
        left, new = (0, 0, 0), [(0, 0, 0)]
        for j, y in enumerate(doc):
            s, m, o = score[j]
            if x == y:
                c = (s + 1, m + 1, o)
            else:
                c = (s - cost, m, o + 1)
                up = score[j + 1]
                if up[0] > c[0] + cost:
                    c = (up[0] - cost, up[1], up[2] + 1)
                if left[0] - cost > c[0]:
                    c = (left[0] - cost, left[1], left[2] + 1)
                if c[0] <= 0:
                    c = (0, 0, 0)
            new.append(c)
            left = c
            if c > best:
                best = c
        score = new
    return best[1], best[2]


def dense(part: list[str], have: set[str], need: int) -> list[list[str]]:
    """Stretches of ``part`` where windows of a passage's length hold enough of the item's words.

    A passage of ``need`` words with one other word in ten has at least nine tenths of ``need``
    words of the item in any stretch of its own length, so no leak lies outside."""
    wide = need + 1
    if len(part) <= wide:
        return [part]
    least = (1 - OTHERS) * need - 1
    sums = [0]
    for w in part:
        sums.append(sums[-1] + (w in have))
    out: list[list[int]] = []
    for a in range(len(part) - wide + 1):
        if sums[a + wide] - sums[a] >= least:
            if out and a <= out[-1][1]:
                out[-1][1] = a + wide
            else:
                out.append([a, a + wide])
    return [part[max(0, a - 2) : z + 2] for a, z in out]


class Searcher:
    """Finds the items of one block in documents."""

    def __init__(self, items: list[tuple[int, list[str]]], ids: dict[str, int], weights, vectors):
        import numpy as np

        self.np, self.items, self.ids, self.weights = np, items, ids, weights
        self.vectors = vectors * weights[:, None]
        of, rows = [], []
        for i, words in passages_of(items):
            row = sum((self.vectors[ids[w]] for w in words if w in ids), np.zeros(vectors.shape[1], dtype=np.float32))
            if (n := float(np.linalg.norm(row))) > 0:
                of.append(i)
                rows.append(row / n)
        self.of = np.array(of, dtype=np.int64)
        self.passages = np.array(rows, dtype=np.float32).reshape(len(rows), vectors.shape[1])
        self.need = [len(w) if len(w) < LEAST_WORDS else max(LEAST_WORDS, math.ceil(LEAST_SHARE * len(w) - 1e-9)) for _, w in items]
        #: Of items that vectors may miss: place, words, and how many different ones a document must hold.
        self.faint = [(i, frozenset(w), self.least_different(w, self.need[i])) for i, (_, w) in enumerate(items) if w and self.is_faint(w, self.need[i])]

    def is_faint(self, item: list[str], need: int) -> bool:
        """Whether a leak of the item may show fewer than ``LEAST_WEIGHTY`` words that have a vector."""
        has = [w in self.ids for w in item]
        return min(sum(has[a : a + need]) for a in range(len(item) - need + 1)) - int(OTHERS * need) - 1 < LEAST_WEIGHTY

    @staticmethod
    def least_different(item: list[str], need: int) -> int:
        """How many different words of the item any leak holds at least."""
        left, k = (1 - OTHERS) * need, 0
        for _, n in Counter(item).most_common():
            if left <= 0:
                break
            left, k = left - n, k + 1
        return k

    def candidates(self, docs: list[list[str]]) -> set[tuple[int, int, int]]:
        """(document, item, window) whose cosine is high enough."""
        np = self.np
        get = self.ids.get
        flat, at, blocks, total = [], [], [], 0
        for words in docs:
            got = [get(w, -1) for w in words]
            flat += got
            blocks.append((total, (len(words) + BLOCK - 1) // BLOCK))
            at.append(len(words))
            total += blocks[-1][1] + 2  # two empty blocks part the documents
        if not flat or not len(self.passages):
            return set()
        ids = np.array(flat, dtype=np.int32)
        place = np.concatenate([first + np.arange(n) // BLOCK for (first, _), n in zip(blocks, at)])
        kept = ids >= 0
        ids, place = ids[kept], place[kept]
        if not len(ids):
            return set()
        owner = np.repeat(np.arange(len(docs)), [n + 2 for _, n in blocks])
        found: set[tuple[int, int, int]] = set()
        starts = np.flatnonzero(np.diff(place, prepend=-1))
        used = place[starts]
        count, norm = np.zeros(total + 2, dtype=np.int32), np.zeros(total + 2, dtype=np.float32)
        np.add.at(count, place, 1)
        np.add.at(norm, place, self.weights[ids] ** 2)
        row_of = np.full(total + 2, -1, dtype=np.int64)
        row_of[used] = np.arange(len(used))
        window = np.flatnonzero((count[:-2] + count[1:-1] + count[2:]) >= LEAST_WEIGHTY)
        wide = norm[:-2] + norm[1:-1] + norm[2:]
        bounds = np.append(starts, len(ids))
        for a in range(0, len(window), 2048):
            ws = window[a : a + 2048]
            lo, hi = ws[0], min(ws[-1] + 3, total + 2)
            rows = np.unique(np.clip(row_of[lo:hi], -1, None))
            rows = rows[rows >= 0]
            first, last = bounds[rows[0]], bounds[rows[-1] + 1]
            sums = np.add.reduceat(self.vectors[ids[first:last]], bounds[rows] - first, axis=0)
            local = np.zeros((hi - lo + 2, sums.shape[1]), dtype=np.float32)
            local[used[rows] - lo] = sums
            k = ws - lo
            x = local[k] + local[k + 1] + local[k + 2]
            cosine = (x @ self.passages.T) / np.sqrt(wide[ws])[:, None]
            w, p = np.nonzero(cosine >= LEAST_COSINE)
            for d, i, b in zip(owner[np.minimum(ws[w] + 1, len(owner) - 1)].tolist(), self.of[p].tolist(), ws[w].tolist()):
                found.add((d, i, b - blocks[d][0]))
        return found

    @staticmethod
    def holds(item: list[str], need: int, part: list[str]) -> bool:
        if f" {' '.join(item)} " in f" {' '.join(part)} ":
            return True
        if lcs(item, part) < (1 - OTHERS) * need:
            return False
        # A low cost reaches over another word near an end, a high one keeps what follows out.
        for cost in (3, 2, 1):
            held, others = aligned(item, part, cost)
            # A word in ten may be another one, at an end of the passage too.
            spare = int(OTHERS * (held + others + 1) + 1e-9) - others
            if held + others + max(0, min(1, spare)) >= need and spare >= 0:
                return True
        return False

    def answers(self, item: list[str]) -> frozenset[str]:
        """What an item is about: its figures, and the rarer half of its words that have a weight."""
        known = sorted({w for w in item if w in self.ids}, key=lambda w: -self.weights[self.ids[w]])
        return frozenset(known[: (len(known) + 1) // 2]) | {w for w in item if w.isdigit()}

    def told(self, item: list[str], need: int, part: list[str]) -> float:
        """How a part of a document tells the item in other words: the share of the answers of the item's best passage that it
        holds, if it holds half of the passage's words in order; 0 otherwise."""
        best = 0.0
        for a in range(0, max(1, len(item) - need + 1), STEP):
            passage = item[a : a + need]
            answers = self.answers(passage)
            if answers and lcs(passage, part) >= PARAPHRASE_WORDS * len(passage):
                best = max(best, len(answers.intersection(part)) / len(answers))
        return best

    def search(self, docs: list[list[str]], paraphrases: list | None = None) -> list[tuple[int, int]]:
        """(document, item's key) of each leak; ``paraphrases`` takes (document, item's key, share of answers) of the other candidates that hold the item's answers."""
        near: dict[tuple[int, int], list[int]] = {}
        for d, i, b in self.candidates(docs):
            near.setdefault((d, i), []).append(b)
        out = []
        for d, words in enumerate(docs if self.faint else []):
            held = set(words)
            for i, have, different in self.faint:
                near.pop((d, i), None)
                if len(have & held) >= different and any(self.holds(self.items[i][1], self.need[i], part) for part in dense(words, have, self.need[i])):
                    out.append((d, self.items[i][0]))
        for (d, i), at in sorted(near.items()):
            key, item = self.items[i]
            need = self.need[i]
            words = docs[d]
            reach = len(item) + len(item) // 5 + BLOCK
            spans: list[list[int]] = []
            for b in sorted(at):
                a, z = max(0, b * BLOCK - reach), min(len(words), (b + 3) * BLOCK + reach)
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = z
                else:
                    spans.append([a, z])
            have = set(item)
            for a, z in spans:
                if any(self.holds(item, need, part) for part in dense(words[a:z], have, need)):
                    out.append((d, key))
                    break
            else:
                if paraphrases is not None and (share := max(self.told(item, need, words[a:z]) for a, z in spans)) >= PARAPHRASE_ANSWERS:
                    paraphrases.append((d, key, share))
        return out


def leaks(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id)`` of every document that holds an item, or a long enough passage of it.

    Items are taken in blocks of ``ITEMS_PER_BLOCK``, each against all documents.  Null or blank
    documents and items hold nothing."""
    return _searched(df, items, key, text, item_key, item_text, False).select("doc_id", "item_id")


def leak_report(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, how, answers)``: the leaks, as ``passage``, and as ``paraphrase`` what is near an item, holds half of a passage's words in order and the ``answers`` share of its answers (figures and rare words)."""
    return _searched(df, items, key, text, item_key, item_text, True)


def _searched(df: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str, paraphrases: bool) -> DataFrame:
    spark = df.sparkSession
    rows = items.select(F.col(item_key).cast("bigint"), item_text).where(F.col(item_text).rlike("\\S")).orderBy(item_key)
    n = rows.count()
    out = None
    docs = df.count()
    for block in range((n + ITEMS_PER_BLOCK - 1) // ITEMS_PER_BLOCK):
        got = rows.offset(block * ITEMS_PER_BLOCK).limit(ITEMS_PER_BLOCK).collect()
        found = _leaks_of_block(df, [(r[0], words_of(t)) for r, t in zip(got, fold_all([r[1] for r in got]))], docs, key, text, paraphrases)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], REPORT)


def _leaks_of_block(df: DataFrame, items: list[tuple[int, list[str]]], docs: int, key: str, text: str, paraphrases: bool) -> DataFrame:
    import numpy as np

    spark = df.sparkSession
    vocabulary = sorted({w for _, words in items for w in words})
    n = {r["word"]: r["n"] for r in document_frequencies(df, vocabulary, text).collect()}
    kept = [w for w in vocabulary if n.get(w, 0) <= max(MOST_DOCS * docs, 20)]
    ids = {w: i for i, w in enumerate(kept)}
    weights = np.array([math.log((docs + 1) / (n.get(w, 0) + 0.5)) for w in kept], dtype=np.float32)
    passages = []
    for _, words in passages_of(items):
        tf: dict[int, float] = {}
        for w in words:
            if w in ids:
                tf[ids[w]] = tf.get(ids[w], 0.0) + float(weights[ids[w]])
        if tf:
            passages.append((list(tf), list(tf.values())))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("how", pa.string()), ("answers", pa.float64())])
    if passages:
        matrix = spark.createDataFrame(passages, "words array<int>, weights array<float>").repartition(max(1, min(64, len(passages) // 500)))
        vectors = randomised_svd(matrix, len(kept))
    else:
        vectors = np.zeros((len(kept), 1), dtype=np.float32)
    shared = spark.sparkContext.broadcast((items, ids, weights, vectors))
    made = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = made.get("s") or made.setdefault("s", Searcher(*shared.value))
        keys = batch.column(0).to_pylist()
        out: list[tuple[int, int, str, float]] = []
        for a in range(0, len(keys), 1000):
            words = [words_of(t) for t in fold_all([t or "" for t in batch.column(1).slice(a, 1000).to_pylist()])]
            told: list[tuple[int, int, float]] | None = [] if paraphrases else None
            out += [(keys[a + d], i, "passage", 1.0) for d, i in s.search(words, told)]
            out += [(keys[a + d], i, "paraphrase", x) for d, i, x in told or ()]
        return pa.RecordBatch.from_pydict({k: [r[j] for r in out] for j, k in enumerate(schema.names)}, schema=schema)

    return by_batch(df.select(F.col(key).cast("bigint"), text), run, REPORT)
