"""Languages of documents and of the segments in them (problem 5).

The script of a word narrows its candidate languages; within them a character model trained on
labelled samples scores the word; Viterbi decoding with a switching penalty labels the spans of
a text.  A document's language is that of most of its words, ``und`` if it has no text in any.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chars import fold, fold_all
from .common import by_batch

UND = "und"
ORDER = 4
#: The chance of a character before any is seen.
BASE = 1 / 150
#: Log chance a character under noise, and of noise at all.
NOISE_CHAR = math.log(1 / 80)
NOISE = -5.0
#: What one word may add to the distance of two languages, and what a change of language costs.
CLIP = 6.0
SWITCH = 7.0
#: Labelled rows used to fit the word model at most.
SAMPLE_ROWS = 20_000

# Spellings and codes of the languages.
SPELLINGS = {
    "mr": "mr mar marathi mar_deva mr_in mr_deva mr_latn mar_latn मराठी",
    "hi": "hi hin hindi hin_deva hi_in hi_deva हिन्दी हिंदी",
    "en": "en eng english en_in en_us en_gb eng_latn",
    "gu": "gu guj gujarati gu_in guj_gujr ગુજરાતી",
    "ne": "ne nep nepali ne_np npi npi_deva nep_deva नेपाली",
    "und": "und zxx",
    "": "unk unknown none null na n_a mis mul xx",
}


def label_column(label) -> F.Column:
    """A label's language code, ``und`` among them; null where it is missing or says that it is unknown, ``?`` where it names none of the known languages."""
    plain = F.regexp_replace(F.lower(F.trim(label)), "[^\\p{L}\\p{M}\\p{N}]+", "_")
    known = F.coalesce(*[F.when(plain.isin(names.split()), F.lit(code)) for code, names in SPELLINGS.items()])
    return F.when(label.isNull() | (plain == "") | (known == ""), F.lit(None)).otherwise(F.coalesce(known, F.lit("?")))


def script(word: str) -> str:
    """The script most of a word's letters are in: d, g, l, o (another) or an empty string (no letter)."""
    d = g = latin = other = 0
    for c in word:
        if "ऀ" <= c <= "ॿ":
            d += not "०" <= c <= "९"
        elif "઀" <= c <= "૿":
            g += not "૦" <= c <= "૯"
        elif c.isascii():
            latin += c.isalpha()
        elif c.isalpha():
            latin += 0xC0 <= ord(c) < 0x250 and c not in "àÂâÃÅ"
            other += not 0xC0 <= ord(c) < 0x250 or c in "àÂâÃÅ"
    top = max(d, g, latin, other)
    return "" if not top else "dglo"[(d, g, latin, other).index(top)]


EDGE = re.compile(r"^[^\wऀ-૿]+|[^\wऀ-૿]+$")
DIGITS = re.compile(r"\d")
INSIDE = re.compile(r"[^\wऀ-૿'’./-]|[A-Za-z]\d|\d[A-Za-z]|[a-z][A-Z]|_")
CODE = re.compile(r"[{}<>]|&#?\w+;|\w\(|==|\]\[|\w=[\['\"]")
JOINS = re.compile(r"[,;|=:·•→।॥]+")


@dataclass
class WordModel:
    """Log chances of words per state, a state being a language in one script.

    Characters are predicted from up to three before them, with Witten-Bell smoothing."""

    states: list[tuple[str, str]]
    counts: list[dict[str, float]] = field(default_factory=list)

    @property
    def names(self) -> list[str]:
        return [lang for lang, _ in self.states] + [UND]

    @classmethod
    def fit(cls, samples: list[tuple[str, str]], words: list[tuple[str, str, int]] = ()) -> WordModel:
        """From labelled texts ``(lang, text)`` and frequent words ``(lang, word, rank)``."""
        grams: dict[tuple[str, str], dict[str, float]] = defaultdict(lambda: defaultdict(float))

        def add(lang: str, word: str, n: float) -> None:
            word = EDGE.sub("", word).lower()
            s = script(word)
            if s in ("d", "g", "l") and not INSIDE.search(word):
                own, padded = grams[lang, s], "   " + word + " "
                for i in range(ORDER - 1, len(padded)):
                    for k in range(ORDER):
                        own[padded[i - k : i + 1]] += n

        for lang, text in samples:
            for w in fold(text).split():
                add(lang, w, 1.0)
        for lang, word, rank in words:
            add(lang, fold(word), 20.0 / (rank + 3))
        total = {k: sum(n for g, n in own.items() if len(g) == 1) for k, own in grams.items()}
        # Stray words of another script, such as names quoted in Latin letters, make no state.
        states = sorted(k for k in grams if total[k] > 0.1 * max(n for (_, s), n in total.items() if s == k[1]))
        out = []
        for k in states:
            own = dict(grams[k])
            # After a context: how much was seen, and how many kinds.
            for g in list(own):
                own["\0" + g[:-1]] = own.get("\0" + g[:-1], 0.0) + own[g]
                own["\1" + g[:-1]] = own.get("\1" + g[:-1], 0.0) + 1
            out.append(own)
        return cls(states, out)

    def _word(self, word: str, own: dict[str, float]) -> float:
        padded, total = "   " + word + " ", 0.0
        for i in range(ORDER - 1, len(padded)):
            p = BASE
            for k in range(ORDER):
                context = padded[i - k : i]
                seen = own.get("\0" + context)
                if not seen:
                    break
                kinds = own["\1" + context]
                p = (own.get(context + padded[i], 0.0) + kinds * p) / (seen + kinds)
            total += math.log(p)
        return total

    def scores(self, raw: str) -> list[float]:
        """Per state and noise, the log chance below the best, at most CLIP; all 0 for a word of no letters.

        Words joined by signs, as in the cells of a table, are scored apart and averaged."""
        n = len(self.states) + 1
        if "@" in raw or "://" in raw:
            return [0.0] * n
        if CODE.search(raw):
            return [-CLIP] * (n - 1) + [0.0]
        parts = [x for x in JOINS.split(raw) if x]
        if len(parts) > 1:
            got = [x for p in parts if any(x := self.scores(p))]
            return [sum(x) / len(got) for x in zip(*got)] if got else [0.0] * n
        bare = EDGE.sub("", raw)
        word = bare.lower()
        s = script(word)
        if not s:
            return [0.0] * n
        got = [self._word(word, own) if of == s else -1e9 for (_, of), own in zip(self.states, self.counts)]
        got.append(NOISE + NOISE_CHAR * len(word) + 3.0 * len(INSIDE.findall(bare)))
        top = max(got)
        return [max(x - top, -CLIP) for x in got]


def fit_word_model(samples: DataFrame, common_words: DataFrame | None = None, rows: int = SAMPLE_ROWS) -> WordModel:
    """Fit on at most ``rows`` labelled rows ``(lang, text)``, of more a sample by hash, and as many frequent words ``(lang, word, freq_rank)``, the most frequent first."""
    labelled = samples.select("lang", "text").where("lang is not null and text is not null")
    got = labelled.orderBy(F.xxhash64("text"), "text", "lang").limit(rows).collect()
    words = common_words.select("lang", "word", "freq_rank").where("lang is not null and word is not null").orderBy("freq_rank", "lang", "word").limit(rows).collect() if common_words is not None else []
    return WordModel.fit([tuple(r) for r in got], [(r[0], r[1], r[2] or 99) for r in words])


class Decoder:
    """Labels the words of many texts at once."""

    CACHE = 400_000

    def __init__(self, model: WordModel):
        import numpy as np

        self.np, self.model = np, model
        self.reset()

    def reset(self) -> None:
        self.ids: dict[str, int] = {}
        self.rows: list[list[float]] = []
        self.table = self.np.zeros((0, len(self.model.states) + 1), dtype=self.np.float32)

    def word_ids(self, words: list[str]) -> list[int]:
        ids, rows, out = self.ids, self.rows, []
        for w in words:
            i = ids.get(w)
            if i is None:
                # Figures don't tell languages apart, so one entry serves all of them.
                key = DIGITS.sub("0", w) if w[0].isdigit() or w[-1].isdigit() else w
                i = ids.get(key)
                if i is None:
                    i = ids[key] = len(rows)
                    rows.append(self.model.scores(w))
                ids[w] = i
            out.append(i)
        return out

    def decode(self, docs: list[list[int]]) -> list:
        """The state of every word of every document, by Viterbi with SWITCH as the price of a change.

        Documents of like length run side by side, one step for all of them."""
        np = self.np
        if len(self.rows) > len(self.table):
            self.table = np.array(self.rows, dtype=np.float32)
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        out: list = [None] * len(docs)
        for at in range(0, len(order), 512):
            part = order[at : at + 512]
            n, longest = len(part), len(docs[part[0]])
            lengths = np.array([len(docs[i]) for i in part])
            if not longest:
                for i in part:
                    out[i] = np.zeros(0, dtype=np.int8)
                continue
            ids = np.zeros((longest, n), dtype=np.int32)
            for k, i in enumerate(part):
                ids[: len(docs[i]), k] = docs[i]
            active = n - np.searchsorted(lengths[::-1], np.arange(longest), side="right")
            came = np.zeros((longest, n, self.table.shape[1]), dtype=np.int8)
            score = self.table[ids[0]].copy()
            stay = np.arange(self.table.shape[1], dtype=np.int8)[None, :]
            for t in range(1, longest):
                m = active[t]
                s = score[:m]
                best = s.argmax(1)
                jump = s[np.arange(m), best][:, None] - SWITCH
                came[t, :m] = np.where(s >= jump, stay, best[:, None].astype(np.int8))
                score[:m] = np.maximum(s, jump) + self.table[ids[t, :m]]
            path = np.zeros((longest, n), dtype=np.int8)
            state = score.argmax(1).astype(np.int8)
            for t in range(longest - 1, -1, -1):
                m = active[t]
                path[t, :m] = state[:m]
                if t:
                    state[:m] = came[t, np.arange(m), state[:m]]
            for k, i in enumerate(part):
                out[i] = path[: lengths[k], k]
        return out

    def label(self, texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, str, float]]]]:
        """Per text: language, confidence, and for each line of words ``(line_no, words, language, confidence)``."""
        np = self.np
        if len(self.ids) > self.CACHE:
            self.reset()
        words, lines = [], []
        for t in fold_all(texts):
            own, spans = [], []
            for no, line in enumerate(t.split("\n")):
                got = line.split()
                if got:
                    spans.append((no, len(got)))
                    own += self.word_ids(got)
            words.append(own)
            lines.append(spans)
        paths = self.decode(words)
        names = self.model.names
        und = len(names) - 1
        # Only words with letters speak for a language.
        spoken = (self.table != 0).any(1) if len(self.table) else np.zeros(0, dtype=bool)
        langs = sorted(set(names[:-1]))
        of = np.array([langs.index(x) if x != UND else len(langs) for x in names])
        out = []
        for own, spans, path in zip(words, lines, paths):
            if not own:
                out.append((UND, 0.0, []))
                continue
            ids = np.array(own)
            lang = of[path]
            speak = spoken[ids]
            votes = np.bincount(lang[speak], minlength=len(langs) + 1)
            doc, conf = self._winner(votes, langs, len(own))
            found = []
            ends = np.cumsum([n for _, n in spans])
            for (no, n), end in zip(spans, ends):
                sl = slice(end - n, end)
                first = lang[end - n]
                if (lang[sl] == first).all():
                    v = int(speak[sl].sum())
                    name = langs[first] if first < len(langs) and v else UND
                    found.append((no, n, name, v / n))
                else:
                    v = np.bincount(lang[sl][speak[sl]], minlength=len(langs) + 1)
                    found.append((no, n, *self._winner(v, langs, n)))
            out.append((doc, conf, found))
        return out

    @staticmethod
    def _winner(votes, langs: list[str], words: int) -> tuple[str, float]:
        """The language of most words, with its share of the words in any language or noise."""
        known = votes[: len(langs)]
        if not known.sum() or known.sum() < 0.3 * (votes.sum() + 0.5 * (words - votes.sum())):
            return UND, float(1 - known.sum() / max(1, words))
        top = int(known.argmax())
        return langs[top], float(known[top] / votes.sum())


def label_languages(df: DataFrame, model: WordModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, lang, confidence, lines array<struct<line_no, words, lang, confidence>>)`` for every row.

    ``lines`` holds the lines in another language than the document's.  Null or blank text:
    ``und`` with confidence 0 and no lines.  Ties go to the language first in the alphabet."""
    made = {}
    line = pa.struct([("line_no", pa.int32()), ("words", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())])
    schema = pa.schema([("key", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64()), ("lines", pa.list_(line))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        d = made.get("d") or made.setdefault("d", Decoder(model))
        got = d.label([t or "" for t in batch.column(1).to_pylist()])
        cols = {
            "key": batch.column(0),
            "lang": [g[0] for g in got],
            "confidence": [g[1] for g in got],
            "lines": [[dict(zip(("line_no", "words", "lang", "confidence"), x)) for x in g[2] if x[2] not in (g[0], UND)] for g in got],
        }
        return pa.RecordBatch.from_pydict(cols, schema=schema)

    out = "key bigint, lang string, confidence double, lines array<struct<line_no int, words int, lang string, confidence double>>"
    return by_batch(df.select(F.col(key).cast("bigint"), text), run, out)


def language_cases(df: DataFrame, model: WordModel, least_words: int = 10) -> DataFrame:
    """``(doc_id, line_no, lang)``: documents whose label is missing or wrong (line_no -1), and foreign lines of ``least_words`` or more."""
    usable = df.where(F.col("text").rlike("\\S"))
    made = {}
    schema = pa.schema([("doc_id", pa.int64()), ("line_no", pa.int32()), ("lang", pa.string())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        d = made.get("d") or made.setdefault("d", Decoder(model))
        ids, label = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        out: list[tuple[int, int, str]] = []
        for i, given, (lang, _, lines) in zip(ids, label, d.label(batch.column(1).to_pylist())):
            if given != lang:
                out.append((i, -1, lang))
            out += [(i, no, of) for no, n, of, _ in lines if n >= least_words and of not in (lang, UND)]
        a, b, c = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_pydict({"doc_id": list(a), "line_no": list(b), "lang": list(c)}, schema=schema)

    cols = usable.select(F.col("doc_id").cast("bigint"), "text", label_column(F.col("lang")).alias("label"))
    return by_batch(cols, run, "doc_id bigint, line_no int, lang string")
