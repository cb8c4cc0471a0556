"""Personal information in free text (problem 6): detection, and typed keyed surrogates.

Structured kinds are found by patterns over folded text (any script's digits, wide forms,
spelled-out numbers, obscured at-signs).  Names are found with a gazetteer of given names and
surnames learned from all documents: cues such as honorifics and bylines show names, and what
they show is then found without a cue; a name not learned is found at its own cue.  Each value is replaced by a placeholder that holds
its kind and a keyed surrogate of the value's own gender, script and format; equal values get
equal surrogates, different values different ones.
"""

from __future__ import annotations

import bisect
import hashlib
import os
import re
import shutil
import tempfile
import unicodedata
import uuid
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chars import DIGIT as D
from .chars import fold, fold_all
from .common import by_batch, cut, rows_bound

KINDS = ("email", "phone", "id_number", "address", "name")
#: Names that are held in memory at most; if there are more, all lie in sorted files that every worker has.
MOST_NAMES = 50_000
#: Folders of such files, which are served from there until the driver ends.
_SERVED: list[tempfile.TemporaryDirectory] = []

AT = r"(?:\s?@\s?|\s?[\[(]\s?at\s?[\])]\s?)"
DOT = r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?)"
#: What an at-sign looks like where there is none.
AT_HINT = re.compile(r"[\[(]\s?at\s?[\])]", re.I)
EMAIL = re.compile(rf"(?:mailto:)?[A-Za-z0-9_%+][A-Za-z0-9._%+\-]{{0,63}}{AT}[A-Za-z0-9\-]+(?:{DOT}[A-Za-z][A-Za-z0-9\-]*)+", re.I)

FREE = rf"(?<![{D}A-Za-z+/])(?<![{D}][.,\-/])"
END = rf"(?![{D}A-Za-z])(?![\-/][{D}])"
MOBILE = rf"[6-9६-९૬-૯](?:[{D}]{{9}}|[{D}]{{4}}[ \-][{D}]{{5}}|[{D}]{{2}}[. \-][{D}]{{3}}[. \-][{D}]{{4}}|[{D}](?:[ \-][{D}]{{2}}){{4}}|[{D}]{{3}} [{D}]{{3}} [{D}]{{3}})"
COUNTRY = r"(?:\([+＋]?[9९૯][1१૧]\)|\+[9९૯][1१૧]|[0०૦]{2}[9९૯][1१૧]|[9९૯][1१૧](?=[ \-])|[0०૦])[ \-]?"
LANDLINE = rf"(?:\([0०૦][{D}]{{2,4}}\)|[0०૦][{D}]{{2,4}})[ \-][1-8१-८૧-૮][{D}]{{5,7}}"
PHONE = re.compile(rf"(?<![{D}A-Za-z+/])(?<![{D}][.,\-/])(?:{COUNTRY})?{MOBILE}{END}|{FREE}{LANDLINE}{END}")

# The digits' names, for numbers that are spelled out.
DIGIT_WORDS = (
    "शून्य एक दोन तीन चार पाच सहा सात आठ नऊ दो पाँच पांच छह छः नौ दुई पाँच छ नौ सुन्ना "
    "zero one two three four five six seven eight nine શૂન્ય એક બે ત્રણ ચાર પાંચ છ સાત આઠ નવ"
).split()
_WORD = "(?:" + "|".join(sorted(set(DIGIT_WORDS), key=len, reverse=True)) + ")"
SPELLED = re.compile(rf"(?<!\S){_WORD}(?:[ ,\-]+{_WORD}){{6,13}}(?!\w)", re.I)
_IS_NUMBER = frozenset(DIGIT_WORDS).__contains__


def may_spell(text: str) -> bool:
    """Whether ``text`` holds as many number words as a spelled-out number, but for its last, which a sign may follow."""
    return sum(map(_IS_NUMBER, text.lower().replace(",", " ").replace("-", " ").split())) >= 6


ID_NUMBER = re.compile(
    rf"{FREE}(?:[{D}]{{12}}|[{D}]{{4}}([ \-])[{D}]{{4}}\1[{D}]{{4}}){END}"
    rf"|(?<![A-Za-z{D}])(?:[A-Z]{{5}}[{D}]{{4}}[A-Z]|[A-Z]{{3}}[ /\-]?[{D}]{{7}}|[A-Z]{{2}}[ \-]?[{D}]{{2}}[ \-]?[{D}]{{11}})(?![A-Za-z{D}])",
    re.I,
)

# Words before a house number.
HOUSE = "सदनिका|दुकान क्रमांक|दुकान नं\\.?|प्लॉट नं\\.?|प्लॉट क्र\\.?|घर क्र\\.?|घर नं\\.?|घर क्रमांक|फ्लॅट|फ्लैट|मकान नं\\.?|मकान|फ्लॅट नं\\.?|Flat|Plot|House|Shop|Apt\\.?|ઘર નં\\.?|ફ્લેટ|ફ્લેટ નં\\.?|પ્લોટ|દુકાન|પ્લોટ નં\\.?|घर नम्बर|घर नं"
PIN = rf"(?:\s*[,–\-]?\s*(?:पिन|pin|PIN|પિન)?\s*[{D}]{{3}}\s?[{D}]{{3}}(?![{D}]))"
PLACE = r"(?:मु\.\s*पो\.\s*)?[^\s,।.\n;|\"”]+(?: [^\s,।.\n;|\"”]+){0,3}"
ADDRESS = re.compile(
    rf"(?:(?:{HOUSE})\s*(?:No\.?\s*)?[{D}]{{1,5}}(?:/[\w{D}ऀ-૿]+)?|(?<![{D}/])[{D}]{{1,4}}/[अ-हઅ-હA-Za-z])\s*,\s*{PLACE}"
    rf"(?:\s*,\s*{PLACE}(?=\s*,))*(?:\s*,\s*(?:मु\.\s*पो\.\s*)?[^\s,।.\n;|\"”{D}]+)?{PIN}?",
    re.I,
)
ADDRESS_HINT = re.compile(rf"(?:{HOUSE})\s*(?:No\.?\s*)?[{D}]|[{D}]/[अ-हઅ-હA-Za-z]\s*,", re.I)

# What stands before or after a person's name.
BEFORE = (
    "श्री\\.?|सौ\\.|श्रीमती|कु\\.|डॉ\\.|Mr\\.?|Mrs\\.?|Ms\\.?|Shri|Smt\\.?|શ્રી|શ્રીમતી|"
    "Words:|By|शब्दांकन:|वार्ताहर:|लेखन –|लेखन:|लेखक:|माहिती देणारे:|Contact person:|जानकारी देने वाले:|નામ:|नाव=|नाम=|Name="
)
AFTER = "यांजकडून|यांनी|यांच्या|यांचे|म्हणाली|म्हणाला|ने|कहते|\\| Staff Writer|\\| [^|\\n]{2,25} प्रतिनिधी"
_TOKEN = r"[^\W\d_][\w'’ऀ-૿]{2,}"
_INITIAL = r"(?:[^\W\d_][ऀ-૿]{0,3}\.\s?)"
_NAME = rf"((?:{_TOKEN}|{_INITIAL}{{1,2}})(?:\s(?:{_TOKEN}|{_INITIAL}))?)\s({_TOKEN})"
CUED_BEFORE = re.compile(rf"(?<![\wऀ-૿])(?:{BEFORE})\s*{_NAME}(?![\wऀ-૿])(?=\s*(?:[,(|\]\n!.*–-]|$|हे\b|यां|has|यहाँ))", re.M)
CUED_AFTER = re.compile(rf"(?:^|[.।\n\]\[>*-]\s*){_NAME}\s(?:{AFTER})(?![\wऀ-૿])", re.M)
#: A sign that a text may hold a cue; cheaper to search than the cues.
CUE_HINT = re.compile(rf"({BEFORE})|\s(?:{AFTER})")
#: What the cues begin with, those of ``AFTER`` behind white space.
CUE_STARTS = {x.split("\\")[0] for x in BEFORE.split("|")} | {c + x for c in map(chr, range(0x3001)) if c.isspace() for x in ("यां", "म्हण", "ने", "कहते", "|")}
# What is also said after other words than names; it shows a name after an initial only.
LOOSE_AFTER = re.compile(r"\s(?:म्हणाली|म्हणाला|ने|कहते)")
WORDS = re.compile(r"[\wऀ-૿'’‌‍]+")
ONE_LETTER = re.compile(r"^(?:[A-Za-z]|[अ-हઅ-હ][ा-ौંँઃા-ૌ्]*|[ओऔऑ])$")


#: Titles, which are no given names.
TITLES = {"mr", "mrs", "ms", "dr", "shri", "smt", "by", "the", "words"}
#: Abbreviations that look like initials.
NOT_INITIALS = {"मु", "पो", "क्र", "नं", "ता", "जि", "डॉ", "सौ", "कु", "रु"}


class NameFile:
    """A set of names as a file, sorted, with the places where each begins after them; of its memory only pages in use count."""

    def __init__(self, file: str, n: int):
        self.file, self.n = file, n
        self._mapped = None
        self._known = lru_cache(maxsize=100_000)(self._search)

    def __reduce__(self):
        return NameFile, (self.file, self.n)

    @classmethod
    def write(cls, spark: SparkSession, words: Iterable[str]) -> NameFile:
        """Of words in order, none twice; the file goes to every worker."""
        _SERVED.append(tempfile.TemporaryDirectory(prefix="granthika-names-"))
        path, n, end = os.path.join(_SERVED[-1].name, uuid.uuid4().hex), 0, 0
        with open(path, "wb") as f, tempfile.TemporaryFile() as places:
            places.write(end.to_bytes(8, "little"))
            for w in words:
                end += f.write(w.encode())
                n += 1
                places.write(end.to_bytes(8, "little"))
            places.seek(0)
            shutil.copyfileobj(places, f)
        spark.sparkContext.addFile(path)
        return cls(os.path.basename(path), n)

    def _at(self, i: int) -> bytes:
        if self._mapped is None:
            import numpy as np

            raw = np.memmap(SparkFiles.get(self.file), dtype=np.uint8, mode="r")
            self._mapped = memoryview(raw), len(raw) - 8 * (self.n + 1)
        raw, places = self._mapped
        a, b = (int.from_bytes(raw[places + 8 * k : places + 8 * k + 8], "little") for k in (i, i + 1))
        return bytes(raw[a:b])

    def _search(self, word: str) -> bool:
        w = word.encode("utf-8", "surrogatepass")
        i = bisect.bisect_left(range(self.n), w, key=self._at)
        return i < self.n and self._at(i) == w

    def __contains__(self, word: str) -> bool:
        return self._known(word)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> str:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return self._at(i).decode()


class Gazetteer:
    """Given names and surnames, in lower case and folded; sets, or files if they are many."""

    def __init__(self, given: set[str] | NameFile, surnames: set[str] | NameFile):
        self.given, self.surnames = given, surnames
        self.in_files = isinstance(given, NameFile)
        self.all = frozenset() if self.in_files else frozenset(surnames | given)
        self._automaton = None

    def __reduce__(self):
        return Gazetteer, (self.given, self.surnames)

    @classmethod
    def of(cls, names: DataFrame) -> Gazetteer:
        """From ``(word, given)``, a row a word; all of them, in memory if they are few."""
        rows = rows_bound(names.select("word", "given"), MOST_NAMES)
        if rows is not None:
            return cls({w for w, given in rows if given}, {w for w, given in rows if not given})
        return cls(*(NameFile.write(names.sparkSession, (r["word"] for r in names.where(role).select("word").orderBy("word").toLocalIterator())) for role in ("given", "not given")))

    def lines_with_names(self, text: str) -> Iterator[tuple[int, str]]:
        """(offset, line) of the lines that hold a known name, or a longer word with one in it."""
        if self.in_files:
            at = 0
            for line in text.split("\n"):
                if any((w := m.lower()) in self.surnames or w in self.given for m in WORDS.findall(line)):
                    yield at, line
                at += len(line) + 1
            return
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for w in self.all:
                self._automaton.add_word(w)
            if self.all:
                self._automaton.make_automaton()
        if not self.all:
            return
        low = text.lower()
        if len(low) != len(text):  # a few letters grow when lowered: line by line then
            at = 0
            for line in text.split("\n"):
                if next(self._automaton.iter(line.lower()), None) is not None:
                    yield at, line
                at += len(line) + 1
            return
        end = -1
        for i, _ in self._automaton.iter(low):
            if i > end:
                start = text.rfind("\n", 0, i) + 1
                end = text.find("\n", i)
                end = len(text) if end < 0 else end
                yield start, text[start:end]


@lru_cache(maxsize=1)
def _cue_starts():
    import ahocorasick

    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for x in CUE_STARTS:
        automaton.add_word(x)
    automaton.make_automaton()
    return automaton


def cue_hints(text: str) -> Iterator[re.Match]:
    """What ``CUE_HINT`` matches, one after the other; tried only where a cue begins."""
    done = 0
    for start in sorted({end + 1 - n for end, n in _cue_starts().iter(text)}):
        if start >= done and (m := CUE_HINT.match(text, start)):
            done = m.end()
            yield m


def _cued(text: str) -> Iterator[tuple[re.Match, bool]]:
    """What cues show, and whether the cue stands after it.  A cue before a name is tried where its sign is; for one after, its line is searched."""
    shown: list[tuple[int, int]] = []
    done = 0
    for m in cue_hints(text):
        if m[1]:
            x = CUED_BEFORE.match(text, m.start())
            if x:
                shown.append((x.start(1), x.end(2)))
                yield x, False
        elif m.end() > done:
            end = text.find("\n", m.end())
            done = len(text) if end < 0 else end
            start = max(text.rfind("\n", 0, m.start() + 1), 0)
            for x in CUED_AFTER.finditer(text, start, done):
                if all(x.end(2) <= a or b <= x.start(1) for a, b in shown):
                    yield x, True


def shown_names(text: str, known: Gazetteer | None) -> Iterator[tuple[str, str]]:
    """(role, word) of names that cues show, or, with a first gazetteer, that stand beside known names."""
    if known is None:
        for m, _ in _cued(text):
            yield "surname", m[2].lower()
            for w in m[1].split():
                if "." not in w:
                    yield "given", w.lower()
        return
    for _, line in known.lines_with_names(text):
        at = [(m.start(), m.end(), m[0].lower()) for m in WORDS.finditer(line)]
        for (_, b, v), (c, _, w) in zip(at, at[1:]):
            if line[b:c] == " " and len(v) > 2 and len(w) > 2:
                if w in known.surnames or v in known.given and w in known.given:
                    yield "given", v
                if v in known.given and w not in known.given:
                    yield "surname", w


def cued_names(text: str) -> Iterator[tuple[int, int]]:
    """Names that stand at a cue which is said of persons only, known or not."""
    for m, after in _cued(text):
        start, end = m.start(1), m.end(2)
        words = text[start:end].split(" ")
        while len(words) > 2 and (words[0].rstrip(".") in NOT_INITIALS or words[0].rstrip(".").lower() in TITLES):
            start += len(words.pop(0)) + 1
        if any(not w or "\n" in w or w[0].isascii() and not w[0].isupper() for w in words) or words[0].rstrip(".").lower() in TITLES:
            continue
        if after and "." not in m[1] and LOOSE_AFTER.match(text, end):
            continue
        yield start, end


def name_counts(df: DataFrame, text: str = "text", known: Gazetteer | None = None) -> DataFrame:
    """``(role, word, n)`` of the names shown in ``df``; without ``known`` also how often each word of ``df`` occurs at all, as ``other``."""
    schema = pa.schema([("role", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        got: Counter = Counter()
        words: Counter = Counter()
        tokens: Counter = Counter()
        for t in fold_all([x for x in batch.column(0).to_pylist() if x]):
            if known is None:
                tokens.update(t.lower().split())
            got.update(shown_names(t, known))
        # No word holds white space, so each token is searched for its words once a batch.
        for t, n in tokens.items():
            for w in WORDS.findall(t):
                words[w] += n
        keys = list(got)
        return pa.RecordBatch.from_pydict(
            {"role": [k[0] for k in keys] + ["other"] * len(words), "word": [k[1] for k in keys] + list(words), "n": [got[k] for k in keys] + list(words.values())}, schema=schema
        )

    return by_batch(df.select(text), count, "role string, word string, n bigint").groupBy("role", "word").agg(F.sum("n").alias("n"))


def fit_gazetteer(df: DataFrame, text: str = "text", least: int = 3, share: float = 0.3) -> Gazetteer:
    """Learn names from all documents, in two rounds: at cues, then beside the names learned there.

    A word is kept that was shown ``least`` times and in ``share`` of all its occurrences in
    ``df``; it is a given name if shown as one as often as a surname.  The first round goes first."""
    cues = cut(name_counts(df, text))
    other = cues.where("role = 'other'").select("word", F.col("n").alias("of"))
    found = names = None

    def shown_as(role: str):
        return F.coalesce(F.max(F.when(F.col("role") == role, F.col("n"))), F.lit(0))

    for _ in range(2):
        shown = (cues if found is None else name_counts(df, text, found)).where((F.col("role") != "other") & (F.col("n") >= least))
        kept = shown.join(other, "word").where(F.col("n") >= share * F.col("of")).groupBy("word").agg((shown_as("given") >= shown_as("surname")).alias("given"))
        names = cut(kept if names is None else names.join(kept.withColumnRenamed("given", "later"), "word", "full").select("word", F.coalesce("given", "later").alias("given")))
        found = Gazetteer.of(names)
    return found


class Detector:
    """Finds values of each kind in folded text."""

    def __init__(self, names: Gazetteer):
        self.names = names
        self.number = re.compile(rf"[{D}](?:[ ().\-–/]{{0,2}}[{D}]){{6}}").search
        self.digit = re.compile(f"[{D}]").search
        self.lettered = re.compile(rf"[{D}]{{4}}[A-Za-z]").search
        self.housed = re.compile(rf"[{D}](?:/[^\s,]{{1,6}})?\s*,").search

    def structured(self, text: str) -> list[tuple[int, int, str]]:
        """Values of all kinds but names: (start, end, kind); no two overlap."""
        at = "@" in text or AT_HINT.search(text)
        spelled = may_spell(text)
        if not (at or spelled or self.number(text) or self.lettered(text) or self.housed(text)):
            return []
        got: list[tuple[int, int, str]] = []
        start = 0
        # Values stand within lines; only lines that show a sign of one are searched.
        for line in text.split("\n"):
            if not (at or spelled or self.digit(line)):
                start += len(line) + 1
                continue
            own: list[tuple[int, int, str]] = []

            def add(pattern: re.Pattern, kind: str) -> None:
                for m in pattern.finditer(line):
                    a, b = m.span()
                    if all(b <= x or y <= a for x, y, _ in own):
                        own.append((a, b, kind))

            if self.housed(line) and ADDRESS_HINT.search(line):
                add(ADDRESS, "address")
            if at and ("@" in line or AT_HINT.search(line)):
                add(EMAIL, "email")
            if self.number(line):
                add(PHONE, "phone")
                add(ID_NUMBER, "id_number")
            elif self.lettered(line):
                add(ID_NUMBER, "id_number")
            if spelled and may_spell(line):
                add(SPELLED, "phone")
            got += [(start + a, start + b, k) for a, b, k in own]
            start += len(line) + 1
        return got

    def people(self, text: str) -> Iterator[tuple[int, int]]:
        """Names: given names or initials with a surname, and what cues show; in order, no two overlap."""
        spans = [*self._known_people(text), *cued_names(text)]
        if len(spans) < 2:
            yield from spans
            return
        spans.sort()
        start, end = spans[0]
        for a, b in spans[1:]:
            if a < end:
                end = max(end, b)
            else:
                yield start, end
                start, end = a, b
        yield start, end

    def _known_people(self, text: str) -> Iterator[tuple[int, int]]:
        for start, line in self.names.lines_with_names(text):
            for a, b in self._people_of(line):
                yield start + a, start + b

    def _people_of(self, text: str) -> Iterator[tuple[int, int]]:
        surnames, given = self.names.surnames, self.names.given
        at = [(m.start(), m.end(), m[0].lower()) for m in WORDS.finditer(text)]
        done = -1
        for i, (start, end, w) in enumerate(at):
            if w not in surnames:
                # In Latin letters a capital shows that a word after a known given name is the surname.
                c = text[start]
                if not (c.isascii() and c.isupper() and len(w) > 3 and i and at[i - 1][2] in given and w not in given):
                    continue
            j = i
            while j - 1 > done and j > i - 4:
                a, b, v = at[j - 1]
                gap = text[b : at[j][0]]
                if gap and not gap.strip(" ") and (v in given or j == i and text[a].isascii() and text[a].isupper() and v not in TITLES and v not in surnames):
                    j -= 1
                elif ONE_LETTER.match(v) and v not in NOT_INITIALS and gap.strip(" ") == ".":
                    j -= 1
                else:
                    break
            if j < i:
                done = i
                yield at[j][0], end

    def find(self, text: str) -> list[tuple[int, int, str]]:
        spans = self.structured(text)
        for a, b in self.people(text):
            if all(b <= x or y <= a for x, y, _ in spans):
                spans.append((a, b, "name"))
        return sorted(spans)


def find_lines(d: Detector, texts: list[str]) -> list[set[tuple[int, str]]]:
    """Per folded text, the (line number, kind) of its values."""
    out = []
    for t in texts:
        got = set()
        spans = d.structured(t)
        spans += [(a, b, "name") for a, b in d.people(t) if all(b <= x or y <= a for x, y, _ in spans)]
        for a, b, kind in spans:
            first = t.count("\n", 0, a)
            for k in range(first, first + 1 + t.count("\n", a, b)):
                got.add((k, kind))
        out.append(got)
    return out


def pii_lines(df: DataFrame, names: Gazetteer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, line_no, kind)``: lines that hold a value of a kind; null and blank texts give no row."""
    made = {}
    schema = pa.schema([("doc_id", pa.int64()), ("line_no", pa.int32()), ("kind", pa.string())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        d = made.get("d") or made.setdefault("d", Detector(names))
        got = find_lines(d, fold_all([t or "" for t in batch.column(1).to_pylist()]))
        rows = [(i, no, kind) for i, found in zip(batch.column(0).to_pylist(), got) for no, kind in sorted(found)]
        a, b, c = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_pydict({"doc_id": list(a), "line_no": list(b), "kind": list(c)}, schema=schema)

    return by_batch(df.select(F.col(key).cast("bigint"), text), run, "doc_id bigint, line_no int, kind string")


def original_offsets(raw: str, folded: str) -> list[int]:
    """For each offset of ``folded`` (and its end) the offset in ``raw`` it comes from."""
    if raw == folded:
        return list(range(len(raw) + 1))
    out: list[int] = []
    # Long tokens are mapped in pieces, so that the work stays in proportion to the text.
    for m in re.finditer(r"\r\n|\S{1,64}|\s", raw):
        token = m[0]
        if token.isascii() or fold(token) == token:
            out += range(m.start(), m.end() if token != "\r\n" else m.start() + 1)
            continue
        have = len(fold(token))
        reach = [min(have, len(fold(token[:k]))) for k in range(1, len(token) + 1)]
        reach[-1] = have
        at = 0
        for k, r in enumerate(reach):
            while at < r:
                out.append(m.start() + k)
                at += 1
    out = out[: len(folded)] + [len(raw)] * (len(folded) - len(out))
    return [*out, len(raw)]


# The digits' names by language, and what surrogates of names and places are drawn from where none were learned.
NUMBER_WORDS = [
    x.split()
    for x in (
        "शून्य एक दोन तीन चार पाच सहा सात आठ नऊ",
        "शून्य एक दो तीन चार पाँच छह सात आठ नौ",
        "शून्य एक दो तीन चार पांच छः सात आठ नौ",
        "सुन्ना एक दुई तीन चार पाँच छ सात आठ नौ",
        "zero one two three four five six seven eight nine",
        "શૂન્ય એક બે ત્રણ ચાર પાંચ છ સાત આઠ નવ",
    )
]
NAMES = {
    ("given", "d", "m"): "आरव मयंक तुषार रोहन विवान", ("given", "d", "f"): "अवनी मालती रागिणी शाल्मली दामिनी", ("surname", "d", ""): "कासवे तळवडे देवरुखे मांजरे वेळापुरे",
    ("given", "g", "m"): "આરવ મયંક તુષાર રોહન વિવાન", ("given", "g", "f"): "અવની માલતી રાગિણી શાલ્મલી દામિની", ("surname", "g", ""): "કાસવે તળવડે દેવરુખે માંજરે વેળાપુરે",
    ("given", "l", "m"): "aarav mayank tushar rohan vivaan", ("given", "l", "f"): "avani malati ragini shalmali damini", ("surname", "l", ""): "kasave talavade devarukhe manjare velapure",
}
PLACES = {
    "d": [a + b for a in "आंबे चिंच कमळ देव सोन मोर शिव वेळ तांब खैर पिंप राज".split() for b in "वाडी गाव पूर नगर खेड वली घर तळे".split()],
    "g": [a + b for a in "આંબા ચિંચ કમળ દેવ સોન મોર શિવ વેળ તાંબ ખેર પીપ રાજ".split() for b in "વાડી ગામ પુર નગર ખેડા વલી ઘર તળાવ".split()],
}
LETTERS = {"d": "कखगघचजझटडतथदधनपबभमयरलवशसह", "g": "કખગઘચજઝટડતથદધનપબભમયરલવશસહ"}
# Words of an address that say what a part is, and stay.
KEPT_IN_ADDRESS = set(re.sub(r"[\\?.]", "", HOUSE.replace("|", " ")).split()) | set(
    "मु पो पिन પિન नं क्र क्रमांक नम्बर चौक गल्ली रस्ता मार्ग रोड पेठ कॉलनी अपार्टमेंट सोसायटी जवळ समोर मागे गली सड़क के पास ચોક ગલી રસ્તો માર્ગ રોડ સોસાયટી પાસે".split()
)
_INDIC = re.compile(r"(?![०-९૦-૯।॥])[ऀ-૿](?:(?![०-९૦-૯।॥])[ऀ-૿\u200b-\u200d])*")


class Pool:
    """Some of an ordered collection of names, by their places."""

    def __init__(self, names: list[str] | NameFile, at: array):
        self.names, self.at = names, at

    def __len__(self) -> int:
        return len(self.at)

    def __getitem__(self, i: int) -> str:
        return self.names[self.at[i]]


class Surrogates:
    """Keyed replacements of one kind, script and format; see ``surrogate``."""

    def __init__(self, names: Gazetteer, key: str):
        self.key = hashlib.blake2b(key.encode()).digest()
        self.pools: dict[tuple[str, str, str], Pool] = {}
        for role, of in (("given", names.given), ("surname", names.surnames)):
            ordered = of if isinstance(of, NameFile) else sorted(of)
            places: dict[tuple[str, str, str], array] = defaultdict(lambda: array("q"))
            for i, w in enumerate(ordered):
                places[role, self.script(w), self.gender(w) if role == "given" else ""].append(i)
            self.pools |= {k: Pool(ordered, at) for k, at in places.items()}

    @staticmethod
    def script(w: str) -> str:
        return "l" if w[:1] < "ऀ" else "g" if "઀" <= w[0] <= "૿" else "d"

    @staticmethod
    def gender(w: str) -> str:
        """By the ending usual in the names of this region: long i is feminine."""
        return "f" if w.endswith(("ी", "ee", "i", "ી", "या", "ya", "ती")) else "m"

    def number(self, value: str, more: str = "") -> int:
        return int.from_bytes(hashlib.blake2b((value + more).encode(), key=self.key[:64], digest_size=8).digest(), "big")

    def tag(self, value: str, kind: str, size: int) -> str:
        return hashlib.blake2b(f"{kind}:{value}".encode(), key=self.key[:64], digest_size=size // 2).hexdigest()

    def digits(self, value: str, more: str = "", keep: frozenset[int] = frozenset(), leading: frozenset[int] = frozenset(), low: int = 1) -> str:
        """Each digit and letter, but those of Indian scripts, replaced within its own script and case; signs and the places of ``keep`` stay, digits at ``leading`` places are ``low`` or more."""
        n = self.number(re.sub(r"\W", "", fold(value)).lower(), more)
        out = []
        for i, c in enumerate(value):
            n, r = divmod(n, 26) if n > 1 << 20 else (self.number(value, f"{more}{i}"), self.number(value, f"{more}r{i}") % 26)
            zero = next((z for z in "0०૦０" if 0 <= ord(c) - ord(z) <= 9), None)
            if i in keep or not (zero or c.isalpha() and not _INDIC.match(c)):
                out.append(c)
            elif zero:
                out.append(chr(ord(zero) + (low + r % (10 - low) if i in leading else r % 10)))
            else:
                out.append(chr((65 if c.isupper() else 97) + r))
        return "".join(out)

    def phone(self, value: str, more: str = "") -> str:
        """A number that can be dialled as the other: country code and trunk prefix stay, a mobile number begins with six or more."""
        at = [i for i, c in enumerate(value) if c.isdecimal()]
        own = at[-10:] if len(at) >= 10 and unicodedata.digit(value[at[-10]]) >= 6 else at[1:]
        return self.digits(value, more, frozenset(at) - frozenset(own), frozenset(own[:1]), 6 if len(own) == 10 else 1)

    def id_number(self, value: str, more: str = "") -> str:
        """Another number of the same pattern; one of digits only begins with two or more."""
        return self.digits(value, more, leading=frozenset([0] if value[:1].isdecimal() else []), low=2)

    def email(self, value: str, more: str = "") -> str:
        """Another address: the words for the signs and the last part of the domain stay."""
        kept = [m.span() for m in re.finditer(r"mailto:|[\[(]\s?(?:at|dot)\s?[\])]|[^\W\d_]+\Z", value, re.I)]
        return self.digits(value, more, frozenset(i for a, b in kept for i in range(a, b)))

    def letter(self, w: str, more: str) -> str:
        """Another letter of the script of ``w``, which is one letter, in its case."""
        of = LETTERS.get(self.script(w)) or "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        i = self.number(w.lower(), more) % len(of)
        new = of[i] if of[i] != w[0].upper() else of[(i + 1) % len(of)]
        return new.lower() if w.islower() else new

    def other(self, pool: list[str] | Pool, w: str, more: str) -> str | None:
        """One of the pool that is not ``w``, if there is one."""
        i = self.number(w, more) % len(pool) if pool else 0
        return next((x for k in (i, i + 1)[: len(pool)] if (x := pool[k % len(pool)]) != w), None)

    def name(self, value: str) -> str:
        parts = re.split(r"(\s+|\.\s*)", value)
        words = [i for i, p in enumerate(parts) if p.strip(" .")]
        for i in words:
            w = fold(parts[i]).lower()
            if ONE_LETTER.match(w):
                parts[i] = self.letter(parts[i], "initial")
                continue
            role = "surname" if i == words[-1] else "given"
            of = (role, self.script(w), self.gender(w) if role == "given" else "")
            new = self.other(self.pools.get(of, []), w, role) or self.other(NAMES[of].split(), w, role)
            parts[i] = new.upper() if parts[i].isupper() and parts[i].isascii() else new.title() if new.isascii() else new
        return "".join(parts)

    def spelled(self, value: str, more: str = "") -> str:
        """A number in words: each word another digit's of the language that has most of them."""
        words = [w.lower() for w in re.findall(r"[^\s,\-]+", fold(value))]
        of = max(NUMBER_WORDS, key=lambda x: sum(w in x for w in words))
        n = iter(range(len(value)))

        def digit(m: re.Match) -> str:
            new = of[self.number(" ".join(words), f"{more}{next(n)}") % 10]
            return new.upper() if m[0].isupper() else new.title() if m[0].istitle() else new

        return re.sub(r"[^\s,\-]+", digit, value)

    def address(self, value: str, more: str = "") -> str:
        """Digits and letters replaced, words of Indian scripts by places of the same script; words such as house and street stay."""

        def word(m: re.Match) -> str:
            w = fold(m[0])
            if w in KEPT_IN_ADDRESS:
                return m[0]
            return self.letter(w, "letter") if ONE_LETTER.match(w) else self.other(PLACES.get(self.script(w)) or PLACES["d"], w, "place")

        return _INDIC.sub(word, self.digits(value, more))

    def surrogate(self, kind: str, value: str) -> str:
        """What stands for ``value``; never the value itself."""
        if kind == "name":
            return self.name(value)
        make = getattr(self, "spelled" if kind == "phone" and not re.search(r"\d", value) else kind)
        return next(new for k in range(1_000) if (new := make(value, more=f"again{k}" if k else "")) != value)


#: Hexadecimal digits of a tag, and those tried if a tag is found to stand for two values.
TAG_SIZES = (12, 24)


def redact(d: Detector, s: Surrogates, raw: str, size: int = TAG_SIZES[0]) -> tuple[str, dict[str, int], list[tuple[str, str]]]:
    """``raw`` with each value as ``[KIND:surrogate#tag]``, all else unchanged, the number of values by kind, and ``(mark, value)`` of each.

    The tag is a keyed hash of the folded value: it keeps values distinct whose surrogates
    collide, and the same value recognisable across a corpus without giving it away."""
    folded = fold(raw)
    spans = d.find(folded)
    if not spans:
        return raw, {}, []
    at = original_offsets(raw, folded)
    out, done, n, marks = [], 0, Counter(), []
    for a, b, kind in spans:
        x, y = at[a], at[b - 1] + 1 if b else 0
        value = re.sub(r"\s+", " ", folded[a:b]).lower()
        mark = f"[{kind.upper()}:{s.surrogate(kind, raw[x:y])}#{s.tag(value, kind, size)}]"
        out += [raw[done:x], mark]
        done = y
        n[kind] += 1
        marks.append((mark.rpartition("#")[2] + kind, value))
    return "".join(out) + raw[done:], dict(n), marks


def contested_tags(df: DataFrame, names: Gazetteer, secret: str, size: int, text: str = "text") -> DataFrame:
    """``(tag)`` of the tags that stand for more than one value in ``df``; values travel as keyed hashes."""
    made = {}
    schema = pa.schema([("tag", pa.string()), ("low", pa.int64()), ("high", pa.int64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made["d"], made["s"] = Detector(names), Surrogates(names, secret)
        low: dict[str, int] = {}
        high: dict[str, int] = {}
        for t in batch.column(0).to_pylist():
            for tag, value in redact(made["d"], made["s"], t, size)[2] if t else ():
                h = made["s"].number(value, "collision") >> 1
                low[tag], high[tag] = min(h, low.get(tag, h)), max(h, high.get(tag, h))
        return pa.RecordBatch.from_pydict({"tag": list(low), "low": list(low.values()), "high": [high[t] for t in low]}, schema=schema)

    tags = by_batch(df.select(text), run, "tag string, low bigint, high bigint")
    return tags.groupBy("tag").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("tag")


def redact_documents(df: DataFrame, names: Gazetteer, secret: str, text: str = "text") -> DataFrame:
    """``df`` with ``redacted`` and ``pii_counts`` (map of kind to number); null text gives nulls.

    ``secret`` keys surrogates and tags: who lacks it cannot tell a value from its mark.  Tags are
    checked over all of ``df`` before: if one stands for two values, longer ones are taken."""
    made = {}
    if not secret:
        raise ValueError("surrogates need a secret key")
    size = next((n for n in TAG_SIZES[:-1] if contested_tags(df, names, secret, n, text).isEmpty()), TAG_SIZES[-1])

    @F.pandas_udf("struct<redacted string, pii_counts map<string,int>>")
    def run(texts):
        import pandas as pd

        if "d" not in made:
            made["d"], made["s"] = Detector(names), Surrogates(names, secret)
        got = [(None, None) if t is None else redact(made["d"], made["s"], t, size)[:2] for t in texts]
        return pd.DataFrame({"redacted": [g[0] for g in got], "pii_counts": [g[1] for g in got]})

    return df.withColumn("_pii", run(F.col(text))).withColumns({"redacted": F.col("_pii.redacted"), "pii_counts": F.col("_pii.pii_counts")}).drop("_pii")
