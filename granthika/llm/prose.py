"""Per-document text quality statistics, and rules that tell prose from the rest (problem 2).

Statistics are built-in SQL expressions.  An ordered rule list over them is induced by
incremental reduced-error pruning: each rule is grown on one part of the labelled documents,
pruned on the other, kept while it helps, and what it covers is set aside.  The learned
thresholds are exported to a SQL CASE expression, which labels all documents natively.

Labelled documents are made from clean samples of known language: their sentences set as prose,
verse and dialogue, their phrases as lists and tables, and junk by general means: programs and
markup from small grammars, encoded bytes, random signs, wrong decodings, random letters and
stuffed keywords.  Forms of each kind can be held out, to measure how the rules do on forms they
were not learned from.
"""

from __future__ import annotations

import base64
import random
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("table", "list", "junk")
#: Labelled documents made, and the seed of their making and of the induction.
TRAINING_DOCS, SEED = 4_000, 11
#: (covered right - covered wrong) / covered, on the pruning part, that a rule needs.
LEAST_WORTH = 0.95
#: Rule lists induced from different divisions, of which the one best on further made documents is taken.
LISTS = 10
#: Divisions tried in vain before a kind is done.
RETRIES = 4

BLANKS = " \\t\\u00a0\\u2009\\u202f\\u200b\\u2060"
#: A statistic is (pattern counted, what it is divided by).
_COUNTS = {
    "n_lines": "(?m)^[^\\n]*[^\\s][^\\n]*$",
    "n_symbols": "[\\p{S}\\p{P}&&[^.,;:!?'\"()\\u0964\\u0965\\u2010-\\u201f\\u2026-]]",
    "n_digits": "[0-9\\u0966-\\u096f\\u0ae6-\\u0aef]",
    "n_latin1": "[\\u0080-\\u009f\\u00a1-\\u00aa\\u00ac-\\u00af\\u00b1-\\u00b6\\u00b8-\\u00ff]",
    "n_ended": f"(?m)[.\\u0964!?…,;][\"”’')\\]*-]*[{BLANKS}\\r]*$",
    "n_items": f"(?m)^[{BLANKS}]*(?:[-*•○◦▪→·]|\\(?[0-9\\u0966-\\u096f\\u0ae6-\\u0aef]{{1,3}}[.)])[{BLANKS}]+[^\\s]",
    "n_leaders": f"(?m)(?:\\.{{3,}}|:|–|-)[{BLANKS}]*[0-9\\u0966-\\u096f\\u0ae6-\\u0aef]+[{BLANKS}\\r]*$",
    "n_cells": "(?m)^(?:[^\\t\\n]*\\t[^\\t\\n]*\\t|[^\\n]*\\|[^|\\n]*\\||[^;\\n]*;[^\\s;][^;\\n]*;[^\\s;]|[^\\n]*?[^\\s] {3,}[^\\s][^\\n]*? {3,}[^\\s]|[^=\\n]*=[^=\\n]+=|[^,\\n]{1,28}(?:,[^\\s,][^,\\n]{0,27}|,-){2,}[^,\\n]*\\r?$)",
    "n_bare_short": f"(?m)^[{BLANKS}]*[^\\s]+(?:[{BLANKS}]+[^\\s]+){{0,4}}(?<![.\\u0964!?,;\"”])[{BLANKS}\\r]*$",
    "n_separated": " [·•|/»] |[,;] ",
    "n_code": "(?:[;{}\\]>)]\\r?\\n)|&#?[a-z0-9]+;|</|\\(\\)|\\]\\(|\\w\\[|=\\S|\\)\\{|\"[:,}\\]]|://",
    "n_names": "[A-Za-z0-9]_[A-Za-z0-9]|[a-z][A-Z]|[A-Za-z]\\(|[A-Za-z][0-9]|[0-9][A-Za-z]",
}


#: What is counted in a text, while the statistics are taken.
_COUNTED = "_granthika_counted"


def _once(value: Column, fn) -> Column:
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _counts(text: str, common_words: list[str]) -> Column:
    """All counts of a text as one struct; arrays are bound once."""
    t = F.coalesce(F.col(text), F.lit(""))
    common = F.array(*[F.lit(w) for w in common_words]).cast("array<string>")

    def of_lengths(lengths: Column) -> Column:
        return F.struct(
            F.size(F.filter(lengths, lambda n: n > 0)).alias("n_words"),
            F.size(F.filter(lengths, lambda n: n >= 13)).alias("n_long_words"),
            F.size(F.filter(lengths, lambda n: n >= 28)).alias("n_long_tokens"),
            F.aggregate(lengths, F.lit(0), lambda total, n: total + n).alias("n_letters"),
        )

    def of_different(words: Column) -> Column:
        return F.struct(F.size(words).alias("n_different"), F.size(F.array_intersect(words, common)).alias("n_common"))

    def of_words(words: Column) -> Column:
        return F.struct(_once(F.transform(words, lambda w: F.length(w)), of_lengths).alias("l"), _once(F.array_distinct(words), of_different).alias("d"))

    tokens = F.split(F.lower(t), "[\\s\\u00a0\\u2009\\u202f]+")
    return F.struct(*[F.regexp_count(t, F.lit(p)).alias(k) for k, p in _COUNTS.items()], _once(tokens, of_words).alias("w"))


def statistics() -> dict[str, Column]:
    """The statistics of a text as named expressions over what ``with_statistics`` counts; of null text all are 0.

    ``words``, ``mean_word_length``, ``symbol_ratio`` (signs a word), ``ended_lines`` (share of
    lines that end in punctuation), ``common_words`` (share of the different words that are
    common in a language) and further shares of lines and words."""
    at = lambda path: F.col(f"{_COUNTED}.{path}").cast("double")
    n = {k: at(k) for k in _COUNTS} | {k: at(f"w.l.{k}") for k in ("n_words", "n_long_words", "n_long_tokens")}
    different, common, letters = at("w.d.n_different"), at("w.d.n_common"), at("w.l.n_letters")
    words = F.greatest(n["n_words"], F.lit(1.0))
    lines = F.greatest(n["n_lines"], F.lit(1.0))
    return {
        "words": n["n_words"],
        "mean_word_length": letters / words,
        "symbol_ratio": n["n_symbols"] / words,
        "ended_lines": n["n_ended"] / lines,
        "common_words": common / F.greatest(different, F.lit(1.0)),
        "words_a_line": n["n_words"] / lines,
        "digit_share": n["n_digits"] / F.greatest(letters, F.lit(1.0)),
        "latin1_share": n["n_latin1"] / F.greatest(letters, F.lit(1.0)),
        "long_tokens": n["n_long_tokens"] / words,
        "long_words": n["n_long_words"] / words,
        # Different words over the root of all words: it hardly depends on length.
        "different_words": different / F.sqrt(words),
        "item_lines": n["n_items"] / lines,
        "leader_lines": n["n_leaders"] / lines,
        "cell_lines": n["n_cells"] / lines,
        "bare_short_lines": n["n_bare_short"] / lines,
        # Lines that look like an entry in any of these ways; a leader or item may be bare as well.
        "listed_lines": F.greatest(n["n_items"] + n["n_leaders"], n["n_bare_short"] + n["n_leaders"] * 0.2, n["n_items"]) / lines,
        "separated": n["n_separated"] / words,
        "code_signs": n["n_code"] / lines,
        "joined_names": n["n_names"] / words,
    }


def with_statistics(df: DataFrame, common_words: list[str], text: str = "text") -> DataFrame:
    """``df`` with a column of each statistic; columns of clashing names are replaced."""
    # A generated column: a filter on the statistics can't be pushed below it, which would count again.
    counted = df.withColumn(_COUNTED, F.explode(F.array(_counts(text, common_words))))
    return counted.withColumns(statistics()).drop(_COUNTED)


# ---------------------------------------------------------------- induction


@dataclass(frozen=True)
class Test:
    feature: int
    at_least: bool
    threshold: float


def _covers(rule: list[Test], x):
    import numpy as np

    hit = np.ones(len(x), dtype=bool)
    for t in rule:
        hit &= x[:, t.feature] >= t.threshold if t.at_least else x[:, t.feature] <= t.threshold
    return hit


def _grow(x, y, most: int = 6) -> list[Test]:
    """Add the test of greatest information gain until the rule covers no negative."""
    import numpy as np

    rule: list[Test] = []
    inside = np.ones(len(x), dtype=bool)
    while len(rule) < most and (y[inside] == 0).any() and y[inside].any():
        xi, yi = x[inside], y[inside]
        p0, n0 = yi.sum(), len(yi) - yi.sum()
        base = np.log2(p0 / (p0 + n0))
        best = (1e-9, None)
        for f in range(x.shape[1]):
            order = np.argsort(xi[:, f], kind="stable")
            v, w = xi[order, f], yi[order]
            edge = np.flatnonzero(v[1:] > v[:-1])
            if not len(edge):
                continue
            below = np.cumsum(w)[edge]
            count = edge + 1
            middle = (v[edge] + v[edge + 1]) / 2
            for at_least, p, n in ((False, below, count - below), (True, p0 - below, (len(w) - count) - (p0 - below))):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), Test(f, at_least, float(middle[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        t = best[1]
        inside &= x[:, t.feature] >= t.threshold if t.at_least else x[:, t.feature] <= t.threshold
    return rule


def _worth(rule: list[Test], x, y) -> float:
    hit = _covers(rule, x)
    p, n = int(y[hit].sum()), int((1 - y[hit]).sum())
    return (p - n) / (p + n) if p + n else -1.0


def induce(x, labels: list[str], order=KINDS, seed: int = SEED) -> list[tuple[str, list[Test]]]:
    """The ordered rule list; what no rule covers is prose."""
    import numpy as np

    rng = np.random.default_rng(seed)
    labels = np.array(labels)
    left = np.ones(len(x), dtype=bool)
    out: list[tuple[str, list[Test]]] = []
    for kind in order:
        failed = 0
        while failed < RETRIES:
            at = np.flatnonzero(left)
            y = (labels[at] == kind).astype(int)
            if y.sum() < 4:
                break
            grow = rng.random(len(at)) < 2 / 3
            rule = _grow(x[at][grow], y[grow])
            px, py = x[at][~grow], y[~grow]
            # Prune: the beginning of the rule that is worth most on the other part, the longer of equals.
            worth = [(_worth(rule[: k + 1], px, py), k) for k in range(len(rule))]
            best, k = max(worth, default=(-1.0, 0))
            hit = _covers(rule[: k + 1], x[at])
            if best < LEAST_WORTH or not y[hit].any():
                failed += 1  # another division may yield a rule that holds
                continue
            out.append((kind, rule[: k + 1]))
            left[at[hit]] = False
    return out


def to_sql(rules: list[tuple[str, list[Test]]], names: list[str]) -> str:
    """The rules as a CASE expression over columns of the statistics."""
    if not rules:
        return "'prose'"
    whens = []
    for kind, rule in rules:
        tests = " AND ".join(f"{names[t.feature]} {'>=' if t.at_least else '<='} {t.threshold!r}D" for t in rule)
        whens.append(f"WHEN {tests or 'TRUE'} THEN '{kind}'")
    return "CASE " + " ".join(whens) + " ELSE 'prose' END"


# ------------------------------------------------------- labelled documents


def _phrases(texts: list[str]) -> list[str]:
    out = []
    for t in texts:
        w = [x.strip(".,।?!\"“”()") for x in t.split()]
        out += [" ".join(w[i : i + k]) for k in (1, 1, 2, 3) for i in range(0, len(w) - k + 1, 3) if all(w[i : i + k])]
    return out


def _wrap(text: str, width: int) -> str:
    lines, now = [], ""
    for w in text.split():
        if now and len(now) + len(w) > width:
            lines.append(now)
            now = w
        else:
            now = f"{now} {w}".strip()
    return "\n".join([*lines, now])


def _number(r: random.Random) -> str:
    n = r.choice([str(r.randint(0, 9999)), f"{r.uniform(0, 100):.1f}", f"{r.uniform(0, 100):.2f}%", "-"])
    return n.translate({48 + i: 0x966 + i for i in range(10)}) if r.random() < 0.2 else n


def _name(r: random.Random) -> str:
    """An identifier as programs have them."""
    part = lambda: "".join(r.choice("bcdfghklmnprstvz") + r.choice("aeiou") for _ in range(r.randint(1, 3)))
    kind = r.randint(0, 4)
    if kind == 0:
        return part() + "_" + part()
    if kind == 1:
        return part() + part().title()
    return r.choice("abcdefijknxy") if kind == 2 else part() + (str(r.randint(0, 99)) if kind == 3 else "")


def _value(r: random.Random, depth: int = 0) -> str:
    """An expression."""
    kind = r.randint(0, 6 if depth < 2 else 2)
    inner = lambda: _value(r, depth + 1)
    return [
        lambda: str(r.randint(0, 999)), lambda: _name(r), lambda: r.choice("'\"") + _name(r) + "'", lambda: f"{inner()} {r.choice('+-*/<>%')} {inner()}",
        lambda: f"{_name(r)}({', '.join(inner() for _ in range(r.randint(0, 3)))})", lambda: f"{_name(r)}[{inner()}]", lambda: f"{_name(r)}.{_name(r)}",
    ][kind]()


def _thing(r: random.Random) -> str:
    """An address, mark or number as they stand in running text."""
    a, b, n = _name(r), _name(r), r.randint(1, 9999)
    return r.choice([f"{a}{n}@{b}.org", f"{a}_{b} @ {b}.net", f"www.{a}{b}.com/{b}_{n}", f"#{a}{b.title()}", f"({a[:1].upper()}{n})", f"{a.upper()}-{n}", f"@{a}_{n}", f"{n}{a[:2]}", f"{a.title()}({n})", f"+{n} {n} {n}"])


#: Statements of a few kinds of programs, markup and records, by form.
_CODE = {
    "braces": lambda r: r.choice([lambda: f"{_name(r)} = {_value(r)};", lambda: f"if ({_value(r)}) {{", lambda: "}", lambda: f"for ({_name(r)} = 0; {_name(r)} < {_value(r)}; {_name(r)}++) {{", lambda: f"return {_value(r)};", lambda: f"{_name(r)}({_value(r)});"])(),
    "markup": lambda r: r.choice([lambda: f"<{_name(r)}>{_name(r)}</{_name(r)}>", lambda: f"<{_name(r)} {_name(r)}=\"{_name(r)}\">", lambda: f"</{_name(r)}>", lambda: f"&{_name(r)};" * r.randint(1, 4), lambda: f"<{_name(r)} {_name(r)}='{r.randint(1, 99)}'/>"])(),
    "rules": lambda r: f"{r.choice(['#', '.', ''])}{_name(r)} {{ " + " ".join(f"{_name(r)}: {r.randint(0, 99)}{r.choice(['em', '%', 'pt', ''])};" for _ in range(r.randint(1, 4))) + " }",
    "minified": lambda r: "".join(f"{_name(r)}={_value(r)};".replace(" ", "") for _ in range(r.randint(1, 6))),
    "records": lambda r: "{" + ", ".join(f'"{_name(r)}": {r.choice([str(r.randint(0, 999)), chr(34) + _name(r) + chr(34), "null", "[]"])}' for _ in range(r.randint(1, 5))) + "}",
    "indented": lambda r: " " * (4 * r.randint(0, 3)) + r.choice([lambda: f"def {_name(r)}({_name(r)}, {_name(r)}):", lambda: f"{_name(r)} = {_value(r)}", lambda: f"if {_value(r)}:", lambda: f"return {_value(r)}", lambda: f"import {_name(r)}"])(),
    "queries": lambda r: r.choice([lambda: f"SELECT {_name(r)}, COUNT({_name(r)}) FROM {_name(r)} WHERE {_name(r)} = {_value(r)};", lambda: f"INSERT INTO {_name(r)} ({_name(r)}) VALUES ({_value(r)});", lambda: f"CREATE TABLE {_name(r)} ({_name(r)} INT, {_name(r)} VARCHAR({r.randint(1, 255)}));"])(),
    "log": lambda r: f"20{r.randint(10, 30)}-0{r.randint(1, 9)}-{r.randint(10, 28)}T{r.randint(10, 23)}:{r.randint(10, 59)} [{_name(r)}] {r.choice(['INFO', 'WARN', 'ERROR'])} {_name(r)}.{_name(r)}: {_name(r)}={_value(r)}",
}
_BYTES = {
    "base64": lambda r, b: base64.b64encode(b).decode(),
    "hex": lambda r, b: b.hex(),
    "ascii85": lambda r, b: base64.b85encode(b).decode(),
    "escaped": lambda r, b: "".join(f"%{x:02X}" for x in b),
}


def _set(form: str, r: random.Random, texts: list[str], phrases: list[str]) -> str:
    """One text in a form."""
    kind, _, how = form.partition(":")
    if kind == "prose":
        said = [r.choice(texts) for _ in range(r.choice([1, 1, 2, 3, 5, 8, 20, 40]))]
        if how == "verse":
            lines = []
            for t in said:
                w, i = t.split(), 0
                while i < len(w):
                    k = r.randint(3, 8)
                    lines.append(" ".join(w[i : i + k]).rstrip(".,।") + r.choice([",", ".", "!", "", ""]))
                    i += k
            return ("\n\n" if r.random() < 0.4 else "\n").join(lines)
        if how == "dialogue":
            mark = r.choice([("“", "”"), ("– ", ""), ("- ", ""), ('"', '"')])
            return "\n".join(mark[0] + t + mark[1] for t in said for t in t.replace("।", "।|").replace(". ", ". |").split("|") if t.strip())
        if how == "note":
            told = r.choice(texts).split(".")[0][:200] + r.choice([".", ""])
            if r.random() < 0.5:
                few = [r.choice(phrases) for _ in range(r.randint(2, 4))]
                told = f"{few[0]} {r.randint(1, 200)}, {', '.join(few[1:])} {told}" if r.random() < 0.5 else f"{told} {few[0]}: {r.randint(6000000000, 9999999999)}"
            return told
        if how == "listing":  # prose with a short list in it
            return "\n".join(said + [f"- {r.choice(phrases)}" for _ in range(r.randint(1, 3))] + [r.choice(texts)])
        if how == "wrapped":
            return _wrap(" ".join(said), r.randint(55, 110)).replace("\n", "\n\n" if r.random() < 0.3 else "\n")
        return ("\n\n" if how == "spaced" else "\n").join(said)
    if kind == "list":
        items = [r.choice(phrases) for _ in range(r.randint(5, 40))]
        if how == "bullet":
            mark = r.choice("-*•○→▪·")
            return "\n".join(f"{mark} {x}" for x in items)
        if how == "number":
            deva, style = r.random() < 0.4, r.choice(["{}. ", "{}) ", "({}) "])
            return "\n".join(style.format(str(i + 1).translate({48 + k: 0x966 + k for k in range(10)}) if deva else i + 1) + x for i, x in enumerate(items))
        if how == "inline":
            sep, k = r.choice([", ", " · ", " | ", "; ", " / ", " • "]), r.randint(6, 40)
            return "\n".join(sep.join(items[i : i + k]) for i in range(0, len(items), k))
        if how == "leader":
            lead = r.choice(["." * r.randint(3, 8), ":", "–", "-"])
            return "\n".join(f"{x} {lead} {r.randint(1, 400)}" for x in items)
        return "\n".join(items)
    if kind == "table":
        cols, rows, numbers = r.randint(3, 6), r.randint(4, 20), r.random()
        cells = [[r.choice(phrases) for _ in range(cols)]] + [[r.choice(phrases), *[_number(r) if r.random() < numbers else r.choice(phrases) for _ in range(cols - 1)]] for _ in range(rows)]
        if how == "wide":
            widths = [max(len(row[i]) for row in cells) + r.randint(3, 6) for i in range(cols)]
            return "\n".join("".join(c.ljust(n) for c, n in zip(row, widths)) for row in cells)
        if how == "pairs":
            return "\n".join(" ".join(f"{h}={c}" for h, c in zip(cells[0], row)) for row in cells[1:])
        if how == "pipe":
            rule = ["|" + "---|" * cols] if r.random() < 0.5 else []
            lines = ["| " + " | ".join(row) + " |" for row in cells]
            return "\n".join([lines[0], *rule, *lines[1:]])
        return "\n".join({"tab": "\t", "semicolon": ";", "comma": ","}[how].join(row) for row in cells)
    if how in _CODE:
        return "\n".join(_CODE[how](r) for _ in range(r.randint(4, 30)))
    if how in _BYTES:
        b, k = _BYTES[how](r, r.randbytes(r.randint(80, 900))), r.randint(40, 100)
        return "\n".join(b[i : i + k] for i in range(0, len(b), k))
    if how == "signs":
        some = r.sample(string.punctuation, r.randint(6, len(string.punctuation)))
        return "\n".join("".join(" " if r.random() < 0.05 else r.choice(some) for _ in range(r.randint(20, 100))) for _ in range(r.randint(3, 12)))
    if how in ("latin-1", "cp1252", "mac_roman", "cp850"):
        t = " ".join(r.choice(texts) for _ in range(r.randint(1, 4)))
        t = t if not t.isascii() else " ".join(r.choice([x for x in texts if not x.isascii()] or ["“—”…" * 30]) for _ in range(2))
        return "\n".join(x.encode().decode(how, "replace") for x in _wrap(t, r.randint(50, 90)).split("\n"))
    if how in ("letters", "shuffled"):
        pool = r.choice(texts)
        letters = [c for c in pool if not c.isspace()]
        if how == "shuffled":  # a text's own letters in any order
            r.shuffle(letters)
            it, lengths = iter(letters), [len(w) for w in pool.split()]
            return _wrap(" ".join("".join(c for c, _ in zip(it, range(n))) for n in lengths), r.randint(50, 90))
        kinds = sorted({c for c in letters if c.isalpha() or ord(c) > 0x900}) or ["x"]  # any of its letters and marks, all alike
        return "\n".join(" ".join("".join(r.choice(kinds) for _ in range(r.randint(1, 2 + 2 * r.randint(1, 9)))) for _ in range(r.randint(4, 14))) for _ in range(r.randint(2, 10)))
    few = [r.choice(phrases) for _ in range(r.randint(1, 4))]
    if how == "shuffled_words":
        return _wrap(" ".join(r.choice(few) for _ in range(r.randint(30, 150))), r.randint(50, 100))
    line = " ".join(few * r.randint(5, 20))
    return "\n".join([line] * r.randint(1, 8)) if r.random() < 0.7 else _wrap(" ".join([line] * 4), r.randint(60, 110))


#: The forms of each kind; those named often are made often.
FORMS = {
    "prose": ["plain", "plain", "wrapped", "wrapped", "wrapped", "wrapped", "verse", "verse", "dialogue", "note", "spaced", "listing"],
    "list": ["bullet", "bullet", "number", "plain", "plain", "inline", "inline", "leader", "leader"],
    "table": ["tab", "pipe", "semicolon", "comma", "wide", "pairs"],
    "junk": ["base64", "hex", "ascii85", "escaped", "braces", "markup", "rules", "minified", "records", "indented", "queries", "log", "signs", "signs", "latin-1", "cp1252", "mac_roman", "cp850", "letters", "letters", "letters", "shuffled", "stuffed", "stuffed", "stuffed", "shuffled_words"],
}


def labelled_documents(texts: list[str], n: int = TRAINING_DOCS, seed: int = SEED, without: frozenset[str] = frozenset(), only: frozenset[str] = frozenset()) -> list[tuple[str, str]]:
    """``(kind, text)`` made from clean texts; some get lines of a page's frame before or after.

    ``without`` leaves forms out, ``only`` keeps these alone (written ``kind:form``)."""
    r = random.Random(seed)
    # Texts in letters that are rare among the samples, such as romanised ones, come up as often as others.
    latin = [t for t in texts if t.isascii()]
    texts = texts + latin * max(0, len(texts) // (2 * max(1, len(latin))))
    phrases = _phrases(texts)
    forms = {k: kept for k, of in FORMS.items() if (kept := [f for f in of if f"{k}:{f}" not in without and (not only or f"{k}:{f}" in only)])}
    kinds = [k for k in ("prose", "prose", "prose", "list", "table", "junk") if k in forms]
    out = []
    for _ in range(n):
        kind = r.choice(kinds)
        body = _set(f"{kind}:{r.choice(forms[kind])}", r, texts, phrases).split("\n")
        if r.random() < 0.35:  # addresses, marks and numbers of things stand in any kind of text
            for _ in range(r.randint(1, 4)):
                i, thing = r.randrange(len(body)), _thing(r)
                body[i] = r.choice([f"{body[i]} {thing}", f"{thing} {body[i]}", body[i].replace(" ", f" {thing} ", 1)])
        if r.random() < 0.6:
            for _ in range(r.randint(1, 4)):
                date = r.choice(["{d}/{m}/{y}", "{y}-{m:02d}-{d:02d}", "{d}.{m}.{y}, {h}:{d:02d}", "{h}:{d:02d} {d}-{m}-{y}"]).format(d=r.randint(1, 28), m=r.randint(1, 12), y=r.randint(1990, 2035), h=r.randint(0, 23))
                frame = r.choice([
                    r.choice([" | ", " > ", " / ", " · "]).join(r.choice(phrases) for _ in range(r.randint(2, 4))), r.choice(texts)[: r.randint(30, 80)], f"{r.choice(phrases)}: {date}", f"{r.choice(phrases)} {date}",
                    r.choice(texts).split(".")[0] + ".", r.choice(phrases),
                ])
                body.insert(r.choice([0, 0, len(body), r.randint(0, len(body))]), frame)
        out.append((kind, "\n".join(body)))
    return out


def apply_rules(rules: list[tuple[str, list[Test]]], x):
    """The kind of each row of statistics, as the exported CASE expression gives it."""
    import numpy as np

    got = np.array(["prose"] * len(x), dtype=object)
    left = np.ones(len(x), dtype=bool)
    for kind, rule in rules:
        hit = _covers(rule, x) & left
        got[hit] = kind
        left &= ~hit
    return got


def learn_rules(spark: SparkSession, samples: DataFrame, common_words: list[str], n: int = TRAINING_DOCS, text: str = "text", without: frozenset[str] = frozenset()) -> tuple[list[tuple[str, list[Test]]], list[str]]:
    """Rules and names of the statistics, learned on ``n`` documents made from at most ``n`` samples (of more a sample by hash), and chosen on half as many more."""
    import numpy as np

    texts = sorted(r[0] for r in samples.where(F.col(text).rlike("\\S")).orderBy(F.xxhash64(text), text).limit(n).select(text).collect())
    if not texts:
        return [], list(statistics())
    made = labelled_documents(texts, n + n // 2, without=without)
    names = list(statistics())
    rows = with_statistics(spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(made)], "place int, kind string, text string"), common_words).select("place", "kind", *names).collect()
    rows.sort()
    x, kinds = np.array([r[2:] for r in rows], dtype=float), [r[1] for r in rows]
    lists = [induce(x[:n], kinds[:n], seed=SEED + k) for k in range(LISTS)]
    return max(lists, key=lambda rules: float((apply_rules(rules, x[n:]) == np.array(kinds[n:], dtype=object)).mean())), names


def label_kinds(df: DataFrame, rules: list[tuple[str, list[Test]]], names: list[str], common_words: list[str], text: str = "text", out: str = "kind") -> DataFrame:
    """``df`` with the statistics and ``out``: prose, list, table or junk, null for null or blank text."""
    blank = F.col(text).isNull() | ~F.col(text).rlike("\\S")
    return with_statistics(df, common_words, text).withColumn(out, F.when(blank, F.lit(None)).otherwise(F.expr(to_sql(rules, names))))
