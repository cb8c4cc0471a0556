"""Broken prompt and response pairs (problem 3).

Prompt and response are aligned by word shingles and longest common subsequence: a response
that is nothing but its prompt is a copy.  Refusals are found by aligning the sentences of the
response with refusal templates over the roles of words.  The remaining defects: no answer content, an end within a sentence, word
or list, and another language than the prompt's that was not asked for.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chars import fold_all
from .common import by_batch
from .language import UND, Decoder, WordModel

DEFECTS = ("empty", "truncated", "refusal", "copy", "other_lang")
#: Showings from which a sentence end, a list item is known, and the least share of a word's showings that are ends.
LEAST_ENDS, LEAST_ITEMS, END_SHARE = 5, 2, 0.6
#: Share of the response's shingles that the prompt holds, and of the prompt that the response gives back, in a copy.
COPY_RESPONSE, COPY_PROMPT = 0.75, 0.6
#: Share of a sentence's words that have a role in refusals, and the most words of one.
REFUSAL_SHARE, REFUSAL_WORDS = 0.7, 24

# Answers that say there is none, and labels before an answer.
NO_ANSWER = {
    "na", "n a", "none", "null", "nil", "nan", "no answer", "answer", "response", "todo", "tbd", "उत्तर", "उत्तर नाही", "उत्तर नहीं",
    "जवाब", "कोई उत्तर नहीं", "जवाब नहीं", "उत्तर छैन", "જવાબ", "જવાબ નથી", "ઉત્તર", "लागू नाही", "माहिती नाही",
}

# What the words of refusals do, in the languages of the project: the one who speaks, being able, not, helping or
# telling, what was asked for, having or knowing, declining, fit and unfit, and excuses.
ROLES = {
    "self": "i we i'm my me our us मी आम्ही मला आम्हाला माझ्याकडे आमच्याकडे माझ्यासाठी मजकडे मैं हम मुझे हमें मेरे हमारे मेरी मुझसे हमसे હું અમે મને અમને મારા મારી મારાથી અમારાથી म हामी मलाई हामीलाई मसँग हामीसँग मैले",
    "able": "can able unable cannot can't could couldn't possible impossible शकत शकतो शकते शकणार शक्य अशक्य येणार येत सकता सकती सकते सकूँगा सकूँगी सकेंगे संभव सम्भव असंभव पाऊँगा पाऊँगी શકતો શકતી શકું શકીશ શકતા શક્ય અશક્ય सक्दिनँ सक्दिन सक्दैन सक्दैनौं सक्नेछैन सम्भव असम्भव",
    "not": "not no cannot can't couldn't don't won't didn't doesn't unable impossible नाही नाहीत नको असमर्थ अशक्य नहीं नही न असंभव નથી નહીં નહિ અસમર્થ અશક્ય छैन छैनन् होइन सक्दिनँ सक्दिन सक्दैन सक्दैनौं गर्दिनँ दिन्नँ असम्भव",
    "will": "will won't would going work do works काम करत करणार करता करती करते करूँगा કરતો કરતી કરીશ गर्दिनँ गर्छु",
    "help": "answer answers answering helping assisting providing writing sharing discussing responding respond reply help assist assistance provide write share discuss talk comply fulfil fulfill complete support create generate offer give say tell explain do उत्तर उत्तरे मदत सहाय्य माहिती देऊ देता देणे करू करता करणे सांगू सांगता देण्यास करण्यास सांगण्यास लिहिण्यास लिहू लिहून लिहिणे पूर्ण चर्चा जवाब मदद सहायता जानकारी दे देना देने कर करना करने बता बताना लिख लिखना लिखकर पूरा चर्चा कह मददગાર મદદ જવાબ માહિતી આપી આપવી આપવો કરી કરવી કહી લખી લખવું પૂરી ચર્ચા उत्तर जवाफ मद्दत सहयोग जानकारी दिन गर्न भन्न लेख्न पूरा",
    "asked": "this that it these those something anything request requests question questions topic kind type such या हा ही हे अशा असे त्या यात याबाबत याविषयी विनंती विनंतीवर विनंत्या प्रश्न प्रश्नाचे प्रश्नाला विषयावर इस इसका इसमें ऐसे ऐसी यह सवाल सवालों प्रश्न अनुरोध बारे विषय આ આનો આમાં આવી આવા વિનંતી પ્રશ્ન પ્રશ્નનો વિષય यो यस यसमा यस्तो यसको प्रश्न प्रश्नको अनुरोध विषयमा",
    "known": "have access information know knowledge data available माहिती उपलब्ध माहीत ठाऊक जानकारी पता मालूम उपलब्ध માહિતી જાણકારી ખબર ઉપલબ્ધ जानकारी थाहा उपलब्ध",
    "decline": "decline refuse declining refusing नकार अस्वीकार इनकार इन्कार मना ઇનકાર ना અસ્વીકાર अस्वीकार",
    "fit": "comfortable appropriate right allowed permitted uncomfortable inappropriate योग्य उचित परवानगी ठीक उचित अनुमति સહી યોગ્ય ઉચિત પરવાનગી उचित ठीक अनुमति",
    "sorry": "sorry apologise apologize apologies unfortunately afraid regret माफ क्षमस्व क्षमा खेद दिलगीर माफ़ माफी माफ़ी दुर्भाग्य માફ દિલગીર ક્ષમા ખેદ माफ क्षमा",
    "plain": "as an assistant ai but and so must am be is are the a to with of for in on about at your you who language model एक म्हणून सहायक आणि पण त्यामुळे करा आहे देणे वाटत वाटते काही आता देखील तरी है हूँ हैं का की के को में से पर और इसलिए कुछ लेकिन मॉडल कीजिए करें लगता देकर हे કે છે પણ માટે કરજો કરો માં નો ની ને એક गर्नुहोस् हुनुहोस् छ तर को लाई मा",
}
# What a refusal says, as roles in order; a slash parts roles either of which will do.
REFUSALS = [
    "self able not help", "self not able help", "self help able not", "help self able not", "asked self help able not", "self asked help able not",
    "self not help asked", "self not will asked", "asked self will not", "asked self not will", "self asked will not", "asked self not help", "help able not self", "asked help able not",
    "self help not able", "help self not able", "not asked self able help", "self not known help/decline", "known self not able", "self known not help/able", "asked known self not",
    "self decline", "self help decline", "self not fit help", "help self fit not", "asked help self fit not", "self asked help fit not", "asked self not help", "sorry self able not", "sorry not able help", "sorry asked help able not",
]


# Names of languages, by which a prompt asks for one, and words for translating.
LANGUAGE_NAMES = {
    "en": "english इंग्रजी इंग्रजीत अंग्रेज़ी अंग्रेजी અંગ્રેજી अङ्ग्रेजी",
    "hi": "hindi हिंदी हिन्दी हिंदीत હિન્દી",
    "mr": "marathi मराठी मराठीत મરાઠી",
    "gu": "gujarati गुजराती गुजरातीत ગુજરાતી",
    "ne": "nepali नेपाळी नेपाली નેપાળી",
}
# Number words a prompt may use for the length of a list.
NUMBERS = {2: "दोन दो two બે दुई", 3: "तीन three ત્રણ", 4: "चार four ચાર", 5: "पाच पाँच पांच five પાંચ", 6: "सहा छह six છ", 7: "सात seven સાત", 8: "आठ eight આઠ", 9: "नऊ नौ nine નવ", 10: "दहा दस ten દસ"}
_COUNT = {w: n for n, words in NUMBERS.items() for w in words.split()}
LISTING = re.compile(r"यादी|सूची|list\b|યાદી|सुची", re.I)

STOPS = ".।॥?!…"
CLOSERS = "\"'”’)]}»*_"
MARKER = re.compile(r"^\s*(?:[-*•–]|\(?[0-9०-९૦-૯]{1,3}[.)])\s*")
_SIGNS = re.compile(r"[^\wऀ-૿]+|_")


def words_of(text: str) -> list[str]:
    return _SIGNS.sub(" ", text.lower()).split()


_APOSTROPHES = re.compile(r"(?<=[a-z])[’'](?=[a-z])")


def spoken_words(text: str) -> list[str]:
    """Words of a sentence, contractions whole."""
    return _SIGNS.sub(" ", _APOSTROPHES.sub("\0", text.lower()).replace("\0", "ʼ")).replace("ʼ", "'").split()


_QUOTED = re.compile(r"‘[^‘’\n]*’|“[^“”\n]*”|\"[^\"\n]*\"")


def without_quotes(text: str) -> str:
    """A text without what it quotes, or as it is if it does nothing but quote."""
    own = _QUOTED.sub(" ", text) if _QUOTED.search(text) else text
    return own if len(own.split()) > 1 else text


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for y in b:
        if m := where.get(y):
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def shingles(words: list[str], n: int = 2) -> Counter:
    return Counter(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def is_copy(prompt: list[str], response: list[str]) -> bool:
    if not prompt or not response:
        return False
    if prompt == response:
        return True
    if len(response) < 2 or len(prompt) < 2:
        return False
    p, r = shingles(prompt), shingles(response)
    back = sum(n for s, n in r.items() if s in p) / sum(r.values())
    if back < COPY_RESPONSE:
        return False
    return lcs(prompt, response) >= COPY_PROMPT * len(prompt)


class Refusals:
    """Alignment with refusal templates, which name the roles of words and not the words.

    A sentence refuses if nearly all of its words have a role in refusals and a template is a
    subsequence of their roles; a word may have several."""

    def __init__(self, templates: list[str] = REFUSALS, share: float = REFUSAL_SHARE):
        self.roles: dict[str, frozenset[str]] = {}
        for role, words in ROLES.items():
            for w in words.split():
                self.roles[w] = self.roles.get(w, frozenset()) | {role}
        self.templates = [[frozenset(r.split("/")) for r in t.split()] for t in templates]
        self.share = share
        self.denies = frozenset(w for role in ("not", "decline") for w in ROLES[role].split())

    def __call__(self, sentences: list[list[str]]) -> bool:
        for s in sentences:
            if len(s) > REFUSAL_WORDS or self.denies.isdisjoint(s):
                continue
            roles = [self.roles[w] for w in s if w in self.roles]
            if len(roles) >= self.share * len(s) and any(self.follows(t, roles) for t in self.templates):
                return True
        return False

    @staticmethod
    def follows(template: list[frozenset[str]], roles: list[frozenset[str]]) -> bool:
        """Whether the template is a common subsequence as long as itself; words that deny and enable at once fill both places."""
        at = 0
        for have in roles:
            steps = 0
            while at < len(template) and template[at] & have and steps < 2:
                if steps and not (template[at] | template[at - 1]) <= {"able", "not", "will", "decline"}:
                    break
                at, steps = at + 1, steps + 1
        return at == len(template)


def last_words(df: DataFrame, response: str = "response") -> dict[str, set[str]]:
    """Words that end sentences and items of lists, learned from all responses; only those known reach the driver."""
    schema = pa.schema([("kind", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("ends", pa.int64())])

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        ends, seen, items = Counter(), Counter(), Counter()
        for text in fold_all([x for x in batch.column(0).to_pylist() if x is not None]):
            for w in text.split():
                bare = w.rstrip(STOPS + CLOSERS)
                if bare and not bare.isdigit():
                    seen[bare] += 1
                    if w != bare and w.rstrip(CLOSERS)[-1:] in STOPS and w.rstrip(CLOSERS):
                        ends[bare] += 1
            items.update(MARKER.sub("", x).strip().rstrip(STOPS) for x in text.split("\n")[:-1] if MARKER.match(x))
        kinds, words = ["word"] * len(seen) + ["item"] * len(items), [*seen, *items]
        return pa.RecordBatch.from_pydict({"kind": kinds, "word": words, "n": [*seen.values(), *items.values()], "ends": [ends[w] for w in seen] + [0] * len(items)}, schema=schema)

    counts = by_batch(df.select(response), count, "kind string, word string, n bigint, ends bigint").groupBy("kind", "word").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    is_end = (F.col("kind") == "word") & (F.col("ends") >= LEAST_ENDS) & (F.col("ends") >= END_SHARE * F.col("n"))
    known = counts.where(is_end | (F.col("kind") == "item") & (F.col("n") >= LEAST_ITEMS)).select("kind", "word").collect()
    return {"ends": {r["word"] for r in known if r["kind"] == "word"}, "items": {r["word"] for r in known if r["kind"] == "item"}}


def is_truncated(prompt: str, response: str, known: dict[str, set[str]]) -> bool:
    """Whether a response that holds an answer stops within a sentence, word or list."""
    text = response.strip()
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) > 1 and sum(bool(MARKER.match(x)) for x in lines) >= 0.6 * len(lines):
        last = MARKER.sub("", lines[-1]).strip()
        asked = next((_COUNT[w] for w in words_of(prompt) if w in _COUNT), 0) if LISTING.search(prompt) else 0
        if not last or last[-1] in ",-:;" or len(lines) < asked:
            return True
        bare = last.rstrip(STOPS)
        if last[-1] in STOPS or bare in known["items"]:
            return False
        order = known["order"] if "order" in known else sorted(known["items"])
        after = bisect_right(order, bare)  # items that go on where this one stops come next in order
        return after < len(order) and order[after].startswith(bare)
    end = text.rstrip(CLOSERS)
    if not end or end[-1] in STOPS:
        # A lone list number or an opened quotation mark is no end of a sentence.
        return bool(re.search(r"(?:^|\n)\s*[0-9०-९૦-૯]{1,2}[.)]$", text)) and len(lines) > 1
    words = end.split()
    if end[-1] in ",;:-–(“" or len(words) > 1 and words[-1].startswith(("“", "(")) and text == end:
        return True
    if len(words) <= 4 and not any(c in end[:-1] for c in STOPS):
        return False
    return words[-1] not in known["ends"]


def asked_languages(prompt: str) -> set[str]:
    have = set(words_of(prompt))
    return {code for code, names in LANGUAGE_NAMES.items() if have & set(words_of(names))}


def pair_defects(df: DataFrame, model: WordModel, known: dict[str, set[str]], key: str = "pair_id", instruction: str = "instruction", response: str = "response") -> DataFrame:
    """``(pair_id, defect)``: each defect of each pair; a sound pair gives no row.

    A null, blank or signs-only response is ``empty`` and nothing else.  A null instruction
    reads as an empty one: its response can be empty, truncated or a refusal only."""
    made = {}
    schema = pa.schema([("pair_id", pa.int64()), ("defect", pa.string())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.update(d=Decoder(model), refusals=Refusals(), known={**known, "order": sorted(known["items"])})
        refused = made["refusals"]
        ids = batch.column(0).to_pylist()
        prompts = fold_all([x or "" for x in batch.column(1).to_pylist()])
        answers = fold_all([x or "" for x in batch.column(2).to_pylist()])
        lp = [(x[0], x[1]) for x in made["d"].label([p.replace("\n", " ") for p in prompts])]
        la = [(x[0], x[1]) for x in made["d"].label([MARKER.sub("", a).replace("\n", " ") for a in answers])]
        out: list[tuple[int, str]] = []
        for i, p, a, (lang_p, _), (lang_a, _) in zip(ids, prompts, answers, lp, la):
            said = words_of(a)
            if not said or " ".join(said) in NO_ANSWER:
                out.append((i, "empty"))
                continue
            asked_words = words_of(p)
            copy = is_copy(asked_words, said)
            refusal = refused([spoken_words(s) for s in re.split(r"[.।?!\n]+", without_quotes(a)) if s.strip()])
            if refusal:
                out.append((i, "refusal"))
            if copy:
                out.append((i, "copy"))
                continue
            if not refusal and is_truncated(p, a, made["known"]):
                out.append((i, "truncated"))
            if lang_p != UND and lang_a not in (UND, lang_p) and len(said) >= 3 and lang_a not in asked_languages(p):
                out.append((i, "other_lang"))
        a, b = zip(*out) if out else ((), ())
        return pa.RecordBatch.from_pydict({"pair_id": list(a), "defect": list(b)}, schema=schema)

    return by_batch(df.select(F.col(key).cast("bigint"), instruction, response), run, "pair_id bigint, defect string")
