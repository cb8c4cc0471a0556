"""The training-data operators on small fixtures: brute force, round trips, and odd inputs."""

import random
import re

import pytest

from granthika.llm import chars, language, leakage, lookalike, mixture, pairs, pii, prose, shared_lines, tokens

MR = ["या भागात मातीची भांडी तयार करतात आणि हे काम कठीण आहे.", "लेखक म्हणतात की अशी संधी पुन्हा येणार नाही.", "जेव्हा पाऊस लांबतो तेव्हा शेतकरी वाट पाहतात."] * 4
HI = ["इस इलाक़े में मिट्टी के बर्तन बनाते हैं और यह काम कठिन है।", "लेखक कहते हैं कि ऐसा मौक़ा फिर नहीं आएगा।", "जब बारिश देर से आती है तब किसान राह देखते हैं।"] * 4
EN = ["In this area the potters make clay pots and the work is hard.", "The writers say that such a chance will not come again.", "When the rain is late the farmers wait for it."] * 4


@pytest.fixture(scope="module")
def model():
    return language.WordModel.fit([("mr", t) for t in MR] + [("hi", t) for t in HI] + [("en", t) for t in EN])


@pytest.fixture(scope="module")
def names():
    return pii.Gazetteer({"सारंग", "nayanika", "ओवी"}, {"रानवटे", "moravande"})


# ------------------------------------------------------------------ look-alikes


def test_fold_all_folds_only_lines_that_change(monkeypatch):
    """Equal to ``fold`` of each text on random marks, nuktas, joiners and line ends; plain text with nuktas is left alone."""
    r = random.Random(2)
    pool = [*map(chr, [*range(0x900, 0x980), *range(0xA80, 0xB00)]), *"\r\n\u200c\u200dae\u0301\u093c\u093c\u094d\u0abcरर ，"]
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 7))) for _ in range(20_000)]
    fold = chars.fold
    assert chars.fold_all(texts) == [fold(t) for t in texts] and chars.fold_all([""]) == [""] and chars.fold_all([]) == []
    called = []
    monkeypatch.setattr(chars, "fold", lambda t: called.append(t) or fold(t))
    plain = "लड़का पढ़ता रहा\nराजा बोले\n"
    assert chars.fold_all([plain, plain + "ａ\n" + plain]) == [plain, plain + "a\n" + plain] and called == ["ａ\n"]


def test_fold_makes_equal_what_reads_equal():
    same = [("ａｂｃ", "abc"), ("сору", "copy"), ("a​b", "ab"), ("a b", "a b"), ("साे", "सो"), ("अा", "आ"), ("é", "é"), ("र्‍य", "ऱ्य"), ("a‑b", "a-b"), ("x\r\ny", "x\ny"), ("a\ufe0fb\u3164\U000e0101", "ab"), ("a\u2800b", "a b"), ("ा" + "े\u200b" * 9, "ो" + "े" * 8)]
    for a, b in same:
        assert chars.fold(a) == chars.fold(b), (a, b)
    for a, b in [("a", "A"), ("१", "1"), ("a", "b"), ("a ", "a"), ("क", "ख"), ("-", "–")]:
        assert chars.fold(a) != chars.fold(b)
    texts = [a for a, _ in same] + ["", "plain", "दऱ्या"]
    assert chars.fold_all(texts) == [chars.fold(t) for t in texts]
    assert all(chars.fold(chars.fold(t)) == chars.fold(t) for t in texts)


def test_classes_are_transitive():
    assert sorted(map(tuple, chars.classes([("a", "b"), ("c", "b"), ("d", "e")]))) == [("a", "b", "c"), ("d", "e")]


def test_look_alike_pairs_equal_brute_force(spark):
    r = random.Random(1)
    base = ["The old copy", "जुनी पुस्तके", "a-b c", "  ", None, ""]
    swaps = [("o", "о"), (" ", " "), ("ी", "ी​"), ("-", "‐")]
    rows = []
    for i in range(60):
        t = r.choice(base)
        for a, b in swaps:
            if t and r.random() < 0.4:
                t = t.replace(a, b)
        rows.append((i, t, "x"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, same string")
    got = {tuple(x) for x in lookalike.look_alike_pairs(df).collect()}
    use = [(i, t) for i, t, _ in rows if t and not t.isspace()]
    assert got == {(i, j) for i, a in use for j, b in use if i < j and a != b and chars.fold(a) == chars.fold(b)}
    assert {tuple(x) for x in lookalike.look_alike_pairs(df, block=3).collect()} == got
    links = {i: sum(i in p for p in got) for i, _ in use}
    classes = lookalike.look_alike_classes(df).collect()
    assert {r["doc_id"]: r["links"] for r in classes} == links
    assert all(chars.fold(rows[r["doc_id"]][1]) == chars.fold(rows[r["class_id"]][1]) for r in classes)
    empty = spark.createDataFrame([], df.schema)
    assert lookalike.look_alike_pairs(empty).count() == 0


# --------------------------------------------------------------------- language


def test_languages_of_documents_and_lines(spark, model):
    rows = [(1, "hi", MR[0] + "\n" + HI[0] + "\n" + MR[1] + " " + MR[2]), (2, None, EN[0]), (3, "Marathi", MR[1]), (4, "mr", "x9Kd/+aQ7ZtR2bVw8LmP" * 4), (5, "mr", None), (6, "mr", " \n "), (7, "und", "12 34 ... 56"), (8, "unk", "12 34 ... 56"), (9, "UND", MR[0])]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    got = {tuple(r) for r in language.language_cases(df, model).collect()}
    assert got == {(1, -1, "mr"), (1, 1, "hi"), (2, -1, "en"), (4, -1, "und"), (8, -1, "und"), (9, -1, "mr")}
    labels = {r["key"]: (r["lang"], r["confidence"]) for r in language.label_languages(df, model).collect()}
    assert labels[5] == labels[6] == ("und", 0.0) and labels[3][0] == "mr" and labels[3][1] > 0.9


def test_decoding_equals_a_plain_viterbi(model):
    d = language.Decoder(model)
    r = random.Random(2)
    words = [w for t in MR + HI + EN for w in t.split()]
    docs = [[r.choice(words) for _ in range(r.randint(0, 30))] for _ in range(20)]
    ids = [d.word_ids(x) for x in docs]
    got = d.decode(ids)
    for own, path in zip(ids, got):
        score = [0.0] * len(d.rows[0]) if own else []
        paths = [[] for _ in score]
        for k, i in enumerate(own):
            best = max(range(len(score)), key=lambda s: (score[s], -s))
            new, np_ = [], []
            for s in range(len(score)):
                stay = k == 0 or score[s] >= score[best] - language.SWITCH
                new.append((score[s] if stay else score[best] - language.SWITCH) + d.rows[i][s])
                np_.append((paths[s] if stay else paths[best]) + [s])
            score, paths = new, np_
        if own:
            total = lambda p: sum(d.rows[i][s] for i, s in zip(own, p)) - language.SWITCH * sum(a != b for a, b in zip(p, p[1:]))
            assert abs(total(list(path)) - max(score)) < 1e-3


# ------------------------------------------------------------------------- PII


def test_kinds_of_personal_data(names):
    d = pii.Detector(names)
    cases = {
        "email": ["a.b+c@x.co.in", "asmin [at] mail [dot] example", "x (at) y (dot) org", "a_b @ mail.example"],
        "phone": ["+91 98765 43210", "९००२७८१८३२", "80 03 75 00 75", "900.485.5483", "(+91) 6002 732 525", "(0292) 2476358", "सात शून्य शून्य चार तीन सहा सात नऊ सात नऊ"],
        "id_number": ["1234 5678 9012", "१२३४-५६७८-९०१२", "ABCDE1234F", "ZXS9672521", "ZXD/4288961", "ZZ30 20325095267"],
        "address": ["सदनिका 117, वाकणेखेड अपार्टमेंट, शाळेजवळ, कुरणेकोट 417 826", "94/अ, जुनी पेठ, मु. पो. शेलणेसरे, पिन 570872", "Flat 52, Lonamal Heights, Navanegav Road, 592508"],
        "name": ["सारंग रानवटे", "क. म. रानवटे", "Nayanika K. Moravande", "NAYANIKA MORAVANDE"],
    }
    for kind, values in cases.items():
        for v in values:
            text = chars.fold(f"पहा: {v} असे")
            assert [(text[a:b], k) for a, b, k in d.find(text)] == [(chars.fold(v), kind)], v
    for no in ["लेखक@संपादक", "@gav_3243", "क्र. 1581285112", "978-63-67199-769", "8093897759347", "2024-01-27", "रानवटे विद्यालय", "12/05/2020"]:
        assert d.find(no) == [], no


def test_redaction_keeps_the_rest_and_is_consistent(names):
    d, s = pii.Detector(names), pii.Surrogates(names, "k")
    raw = "अ​आ  सारंग रानवटे, फोन ९००२७८१८३२\r\nपुन्हा सारंग रानवटे"
    out, n, _ = pii.redact(d, s, raw)
    marks = re.findall(r"\[(\w+):([^\]]*)#(\w+)\]", out)
    assert n == {"name": 2, "phone": 1} and marks[0] == marks[2] and marks[1][0] == "PHONE"
    assert re.sub(r"\[[^\]]*\]", "*", out) == "अ​आ  *, फोन *\r\nपुन्हा *"
    assert all("०" <= c <= "९" for c in marks[1][1]) and "९००२७८१८३२" not in out
    assert pii.redact(d, s, "कुणी नाही") == ("कुणी नाही", {}, [])


def test_pii_lines_of_odd_rows(spark, names):
    df = spark.createDataFrame([(1, "x\n\na@b.in\nसारंग रानवटे a@b.in"), (2, None), (3, ""), (4, "x" * 200_000)], "doc_id bigint, text string")
    assert {tuple(r) for r in pii.pii_lines(df, names).collect()} == {(1, 2, "email"), (1, 3, "email"), (1, 3, "name")}


def test_names_are_learned_from_all_documents(spark):
    """A name shown three times among 12,600 documents is found; one shown once is found at its cue."""
    rows = [(i, "या भागात मातीची भांडी तयार करतात.") for i in range(12_600)]
    for i in (17, 6_000, 12_599):
        rows[i] = (i, "वार्ताहर: कैवल्या मोरवंडे")
    rows[9] = (9, "काल कैवल्या मोरवंडे आले.")
    rows[40] = (40, "पत्र श्री. इरावती माळणसे, नवनगर")
    rows[41] = (41, "काल ग्रामीण लोग कहते रहे. ग्रामीण लोग कहते हैं. By the river, it ended")
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    names = pii.fit_gazetteer(df)
    assert "मोरवंडे" in names.surnames and "माळणसे" not in names.surnames
    assert {tuple(r) for r in pii.pii_lines(df, names).collect()} == {(i, 0, "name") for i in (9, 17, 40, 6_000, 12_599)}
    d = pii.Detector(names)
    text = "पत्र श्री. इरावती माळणसे, नवनगर"
    assert [text[a:b] for a, b, _ in d.find(text)] == ["इरावती माळणसे"]


def test_names_beyond_what_memory_holds_lie_in_files(spark, monkeypatch):
    """No number of names is too many: with room for two, all are learned, found and replaced as with room for all."""
    given, surnames = ("कैवल्या", "सारंग", "Nayanika", "इरावती"), ("मोरवंडे", "रानवटे", "Moravande", "माळणसे")
    rows = [(10 * i + k, f"वार्ताहर: {a} {b}\n\nकाल {a} {surnames[(i + 1) % 4]} आले.") for i, (a, b) in enumerate(zip(given, surnames)) for k in range(3)]
    df = spark.createDataFrame([*rows, (99, None), (100, "कुणी नाही")], "doc_id bigint, text string")
    few = pii.fit_gazetteer(df)
    monkeypatch.setattr(pii, "MOST_NAMES", 2)
    many = pii.fit_gazetteer(df)
    assert many.in_files and not few.in_files and len(few.given) >= 4 and len(few.surnames) >= 4
    assert list(many.given) == sorted(few.given) and list(many.surnames) == sorted(few.surnames)
    assert all(w in many.given for w in few.given) and "कुणी" not in many.given and "" not in many.surnames and "zzz" not in many.given
    want = {tuple(r) for r in pii.pii_lines(df, few).collect()}
    assert {tuple(r) for r in pii.pii_lines(df, many).collect()} == want and len(want) == 24
    a, b = ({tuple(r) for r in pii.redact_documents(df, g, "k").select("doc_id", "redacted").collect()} for g in (few, many))
    assert a == b and len(a) == 14


def test_filters_let_every_value_pass(names):
    d = pii.Detector(names)
    for kind, v in [
        ("phone", "नऊ आठ सात पाच तीन एक दोन सात आठ सहा"), ("phone", "Nine, eight seven six five four three two one one"), ("phone", "seven-eight-nine-one-two-three-four"),
        ("email", "asmin ( at ) mail (dot) example"), ("email", "asmin [ At ] mail [dot] example"), ("email", "asmin (aT) mail.example"),
    ]:
        text = f"पहा: {v}.\nपुढे"
        assert [(text[a:b], k) for a, b, k in d.find(text)] == [(v, kind)], v
    assert d.find("एक दोन तीन चार पाच सहा लोक") == []
    long = "मजकूर " * 60
    assert letters_of(d, long + "9 ऑगस्ट 2020") == letters_of(d, long + "14 मार्च 2021")


def test_tags_keep_values_apart(spark, names, monkeypatch):
    """Tags of two digits collide among 600 numbers; longer ones are taken then, and equal values keep equal marks."""
    rows = [(i, f"फोन 90027{i % 600:05d}") for i in range(1200)] + [(2000, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(pii, "TAG_SIZES", (2, 24))
    assert pii.contested_tags(df, names, "k", 2).count() > 0 and pii.contested_tags(df, names, "k", 24).isEmpty()
    got = {r["doc_id"]: r["redacted"] for r in pii.redact_documents(df, names, "k").collect()}
    assert len({got[i] for i in range(600)}) == 600 and all(got[i] == got[i + 600] for i in range(600)) and got[2000] is None
    with pytest.raises(ValueError):
        pii.redact_documents(df, names, "")


def test_surrogates_keep_the_format(names):
    s = pii.Surrogates(names, "k")
    for kind, value in [("phone", "+91 98765 43210"), ("phone", "९००२७८१८३२"), ("phone", "(0292) 2476358"), ("phone", "(+91) 6002 732 525"), ("id_number", "1234 5678 9012"), ("id_number", "ABCDE1234F"), ("email", "asmin [at] mail [dot] example"), ("email", "a.b+c@x.co.in")]:
        new = s.surrogate(kind, value)
        found = pii.Detector(names).find(f"पहा: {new} असे")
        assert new != value and [(f"पहा: {new} असे"[a:b], k) for a, b, k in found] == [(new, kind)], new


def test_surrogates_replace_every_value(names):
    for s in (pii.Surrogates(names, "k"), pii.Surrogates(pii.Gazetteer(set(), set()), "k")):
        for value in ("सदनिका 117, वाकणेखेड अपार्टमेंट, शाळेजवळ, कुरणेकोट 417 826", "94/अ, जुनी पेठ, मु. पो. शेलणेसरे, पिन 570872", "ઘર નં. 12, રામપુર ગલી, વડનગર", "घर क्र. ५, मळगाव", "घर क्र. ५, \u200b\u200dमळ\u200dगाव"):
            new = s.surrogate("address", value)
            left = set(pii._INDIC.findall(value)) & set(pii._INDIC.findall(new))
            assert new != value and left <= pii.KEPT_IN_ADDRESS and new == s.surrogate("address", value), new
        for value in ("नऊ शून्य शून्य पाच तीन एक दोन सात आठ सहा", "Nine zero zero five three one two seven eight six", "નવ શૂન્ય એક બે ત્રણ ચાર પાંચ સાત"):
            new = s.surrogate("phone", value)
            assert new != value and len(new.split()) == len(value.split()) and pii.SPELLED.fullmatch(new), new
        for value in ("सारंग रानवटे", "ओवी रानवटे", "Nayanika Moravande", "NAYANIKA K. MORAVANDE", "क. म. रानवटे", "રમેશ પટેલ"):
            new = s.surrogate("name", value)
            assert all(a != b for a, b in zip(value.split(), new.split(), strict=True)) and value.isupper() == new.isupper(), new
        assert "ａ" not in s.surrogate("email", "ａａａａ@ｘ.in")


# ---------------------------------------------------------------- shared lines


def test_shared_lines_equal_brute_force(spark, names, monkeypatch):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    frames = ["Copyright {} Gramavedh. No copying.", "Updated {} by the desk of this paper today", "By Nayanika Moravande, {}", "rare line of three documents only"]
    rows = []
    for i in range(80):
        source = r.choice(["big", "big", "small", None])
        body = [" ".join(word() for _ in range(r.randint(1, 12))) for _ in range(r.randint(0, 5))]
        for k, f in enumerate(frames):
            if r.random() < (0.6, 0.4, 0.5, 0.05)[k]:
                f = f.format(r.choice(["9 August 2020", "03/09/2021"]))
                body.insert(r.randint(0, len(body)), r.choice([f, f.upper(), f"  {f} --", f.replace("o", "о")]))
        rows.append((i, source, "\n".join(body) if r.random() < 0.97 else None))
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = {tuple(x) for x in shared_lines.shared_lines(df, names).collect()}
    d = pii.Detector(names)
    total, held = {}, {}
    for i, s, t in rows:
        total[s] = total.get(s, 0) + 1
        for no, k in enumerate(letters_of(d, t)):
            if k:
                held.setdefault((s, k), []).append((i, no))
    want = {x for (s, _), at in held.items() if len({i for i, _ in at}) >= max(3, total[s] * 0.1) for x in at}
    assert got == want and want
    forms = shared_lines.shared_forms(df, names)[1]
    for bound in (shared_lines.BROADCAST_ROWS, 0):
        monkeypatch.setattr(shared_lines, "BROADCAST_ROWS", bound)
        assert {tuple(x) for x in shared_lines.shared_lines(df, names).collect()} == want
        clean = {r["doc_id"]: r for r in shared_lines.without_shared_lines(df, forms, names).collect()}
        assert len(clean) == 80
        for i, _, t in rows:
            kept = None if t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if (i, no) not in want)
            assert clean[i]["clean_text"] == kept and clean[i]["n_removed"] == sum(x == i for x, _ in want)
    assert shared_lines.shared_lines(df.limit(0), names).count() == 0


def letters_of(d, text):
    return [re.sub(r"(?:[^\wऀ-෿\n]|[\d_])+", "", x) for x in shared_lines.without_values(d, chars.fold(text or "")).split("\n")]


def test_chunks_of_a_line_do_not_depend_on_its_place(names):
    """But for the first and the last, which lie partly in other lines; line numbers and letters are right."""
    d = pii.Detector(names)
    line = "This is one line of letters without figures and it is long" * 2
    alone = shared_lines.Lines(d, [line])
    own = {h for _, h, _ in list(zip(*alone.chunks()))[1:-1]}
    there = shared_lines.Lines(d, ["x", "", f"qwerty 12\n\n{line}\ntail\n--\n", line])
    at, hashes, letters = there.chunks()
    place = [(int(a), int(b)) for a, b in zip(there.doc, there.no)]
    assert place == [(0, 0), (2, 0), (2, 2), (2, 3), (3, 0)] and own
    for k in (2, 4):
        assert own <= set(hashes[at == k].tolist()) and there.keys()[k] == alone.keys()[0]
    assert [int(letters[at == k].sum()) for k in range(5)] == there.size.tolist()


def test_the_cut_chunks_decide(spark, names, monkeypatch):
    df = spark.createDataFrame([(i, "s", f"own {'abcdefgh'[i % 8] * 3}\none shared line of text here") for i in range(12)], "doc_id bigint, source string, text string")
    assert {tuple(x) for x in shared_lines.shared_lines(df, names).collect()} == {(i, 1) for i in range(12)}
    monkeypatch.setattr(shared_lines, "CUT_SHARE", 1.1)
    assert shared_lines.shared_lines(df, names).count() == 0


def test_chunks_are_counted_once_a_batch(spark, names, monkeypatch):
    """A batch gives a row a document and one a source with each chunk's documents, however many slices it is worked on in."""
    texts = [f"one shared line of text here\n{'abcdefgh'[i % 8] * 9} {'own words'[i % 9 :]}\n" for i in range(40)] + ["", "12", "nothing shared"]
    rows = [(i, (None, "s", "t")[i % 3], t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").coalesce(1)
    monkeypatch.setattr(shared_lines, "slices", lambda batch, column, of=shared_lines.slices: of(batch, column, 60))
    assert shared_lines.lines_and_chunks(df, names).count() == 41 + 3
    want = {}
    for _, s, t in rows:
        for h in {int(h) for h in shared_lines.Lines(pii.Detector(names), [t]).chunks()[1]}:
            want[s or "", h] = want.get((s or "", h), 0) + 1
    got = shared_lines.chunk_counts(shared_lines.lines_and_chunks(df, names)).collect()
    assert {(s, h): n for s, h, n in got} == want and len(got) == len(want) and min(h for _, h in want) < 0 < max(want.values()) - 9
    monkeypatch.setattr(shared_lines, "HELD_COUNTS", 9)  # given away again and again
    got = shared_lines.chunk_counts(shared_lines.lines_and_chunks(df, names)).collect()
    assert len(got) > len(want) and {k: sum(n for s, h, n in got if (s, h) == k) for k in want} == want


def test_cues_and_months_are_found_as_by_patterns():
    r = random.Random(9)
    month = re.compile(r"(?<![\wऀ-૿])(?:" + "|".join(shared_lines.MONTHS) + r")(?![\wऀ-૿])")
    pool = [*shared_lines.MONTHS[::5], "may", "मे", "में", "1", "२", "\n", "\n", "x", "_", " ", " ", ",", "\x85", "\t", "|", "श्री", "श्रीमती", ".", "Mrs", "By", "Shri", "यांनी", "ने", "कहते", "म्हणाला", "Staff Writer", "प्रतिनिधी", "लेखन –", "Contact person:", "नाव="]
    shown = months = 0
    for _ in range(20_000):
        text = "".join(r.choice(pool) for _ in range(r.randint(0, 14)))
        want = [m.span() for m in pii.CUE_HINT.finditer(text)]
        assert [m.span() for m in pii.cue_hints(text)] == want, text
        lines = "\n".join(month.sub(" ", x) if re.search(r"\d", x) else x for x in text.split("\n"))
        assert shared_lines.without_months(text) == lines, text
        shown, months = shown + len(want), months + (lines != text)
    assert shown > 9_000 and months > 500


# ----------------------------------------------------------------------- pairs


def test_defects(spark, model):
    good = MR[0]
    rows = [
        (1, "काय काम आहे?", None), (2, "काय काम आहे?", " ​ "), (3, "काय काम आहे?", "N/A"), (4, "काय काम आहे?", good), (5, "हे काम काय आहे ते सांगा?", "“हे काम काय आहे ते सांगा”"),
        (6, "काय काम आहे?", "माफ करा, मी या प्रश्नाचे उत्तर देऊ शकत नाही."), (7, "लेखक काय म्हणतात?", HI[0]), (8, "या वाक्याचे हिंदी भाषांतर करा: " + MR[1], HI[0]),
        (9, "काय काम आहे?", good + " या भागात मातीची"), (10, "80 अधिक 90 किती?", "१७०"), (11, "एका शब्दात सांगा", "नवनगर"), (12, "पाच वस्तूंची यादी द्या", "1. भांडी\n2. काम\n3."), (13, None, good),
        (14, "काय काम आहे?", "क्षमस्व, आधीच्या उत्तरात एक चूक होती; योग्य माहिती अशी. " + good),
    ]
    df = spark.createDataFrame(rows, "pair_id bigint, instruction string, response string")
    known = {"ends": {"आहे", "नाही"}, "items": {"भांडी", "काम"}}
    got = {(r[0], r[1]) for r in pairs.pair_defects(df, model, known).collect()}
    assert got == {(1, "empty"), (2, "empty"), (3, "empty"), (5, "copy"), (6, "refusal"), (7, "other_lang"), (9, "truncated"), (12, "truncated")}


def test_ends_are_learned_from_all_responses(spark):
    """Ends and items shown after the first 20,000 responses count; a refusal may stand after other sentences."""
    rows = [("या भागात काम आहे.",)] * 20_010 + [("हे काम उरकले.",)] * 5 + [("1. नांगर\n2. कुदळ\n3. विळा",)] * 2
    known = pairs.last_words(spark.createDataFrame(rows, "response string").coalesce(1))
    assert known["ends"] == {"आहे", "उरकले"} and known["items"] == {"नांगर", "कुदळ"}
    list_of = lambda last: f"1. विळा\n2. {last}"
    assert pairs.is_truncated("यादी द्या", list_of("कुद"), known) and not pairs.is_truncated("यादी द्या", list_of("कुदळ"), known) and not pairs.is_truncated("यादी द्या", list_of("पहार"), known)
    answer = ["प्रश्न वाचला", "तो लांब आहे", "त्यात चार भाग आहेत", "धन्यवाद", "मी या प्रश्नाचे उत्तर देऊ शकत नाही"]
    assert pairs.Refusals()([pairs.words_of(x) for x in answer]) and not pairs.Refusals()([pairs.words_of(x) for x in answer[:4]])


def test_refusals_the_templates_were_not_made_from():
    """Written before the templates were tried on them; at least nine in ten are found, and no sound sentence."""
    refused = [
        "Sorry, I can't assist with that", "I can’t help you with this", "I'm unable to provide that information", "I won't be able to write this for you", "We cannot respond to such requests", "I must refuse this request",
        "I am afraid I cannot discuss that topic", "I'm not allowed to share this information", "माफ करा, मी यात मदत करू शकत नाही", "मला याचे उत्तर देता येत नाही", "या विषयावर मी चर्चा करू शकत नाही", "मी हे सांगू शकत नाही",
        "माफ़ कीजिए, मैं इसमें मदद नहीं कर सकता", "मैं इस विषय पर चर्चा नहीं कर सकती", "यह अनुरोध मैं पूरा नहीं कर सकता", "માફ કરજો, હું આમાં મદદ કરી શકતો નથી", "હું આ પ્રશ્નનો જવાબ આપી શકતી નથી", "म यसमा मद्दत गर्न सक्दिनँ", "मसँग यो जानकारी छैन, म भन्न सक्दिनँ",
        "I could not possibly comment on that", "That request is against my guidelines", "आम्हाला याविषयी माहिती देता येणार नाही",
    ]
    sound = [
        "I cannot swim across the wide river near the village", "The farmers do not work on Sundays because the market is closed", "माझ्या गावात पाणी नाही म्हणून मी विहिरीवर जातो", "मी रोज सकाळी शाळेत जात नाही", "वह किताब यहाँ नहीं मिल सकती क्योंकि पुस्तकालय बंद है",
        "It is not possible to grow rice here without rain", "He said that he could not come", "होय, मी हे करू शकतो", "No, that is not right; the answer is four", "“I cannot help you”, said the old man to the king of the valley", "લોકો અહીં રોજ કામ કરે છે",
    ]
    said = lambda t: pairs.Refusals()([pairs.spoken_words(s) for s in re.split(r"[.।?!\n]+", pairs.without_quotes(chars.fold(t))) if s.strip()])
    assert sum(map(said, refused)) >= 0.9 * len(refused) and not any(map(said, sound))


def test_lcs_equals_the_table():
    r = random.Random(5)
    for _ in range(100):
        a, b = [[r.choice("abcd") for _ in range(r.randint(0, 15))] for _ in range(2)]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert pairs.lcs(a, b) == t[-1][-1]


# -------------------------------------------------------------------- leakage


def test_leaks_are_found_and_like_texts_are_not(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    items = [(i, [word() for _ in range(r.randint(8, 60))]) for i in range(30)]
    docs, want = [], set()
    for d in range(60):
        body = [word() for _ in range(r.randint(0, 80))]
        if d % 3 == 0:
            i, w = r.choice(items)
            need = len(w) if len(w) < 15 else max(15, -(-len(w) * 4 // 10))
            a = r.randint(0, len(w) - need)
            part = w[a : a + need]
            if d % 2:
                part[len(part) // 2] = "other"
            body[len(body) // 2 : len(body) // 2] = part
            if not (d % 2 and need < 10):
                want.add((d, i))
        elif d % 3 == 1:
            i, w = r.choice(items)
            body += w[: min(6, len(w) - 2)]
        docs.append((d, (" ".join(body)).upper() if d % 5 == 0 else " ".join(body)))
    docs += [(100, None), (101, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(99, None)], "item_id bigint, text string")
    assert {tuple(x) for x in leakage.leaks(df, it).collect()} == want
    assert leakage.leaks(df, it.limit(0)).count() == 0


def test_paraphrases_need_the_answers(spark):
    """Half of the words in other words is a paraphrase if the figures and rare words are there, and none without them."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    frequent = [word() for _ in range(12)]
    item = [x for k in range(16) for x in (frequent[k % 12], f"{word()}")]
    told = [x if k % 2 else ("other" if k % 4 else x) for k, x in enumerate(item)]
    like = [f"{word()}" if k % 2 else x for k, x in enumerate(item)]
    docs = [(0, told), (1, like), (2, item)] + [(3 + i, r.sample(frequent, 9) + [word() for _ in range(30)]) for i in range(200)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id bigint, text string")
    got = {(r["doc_id"], r["how"]) for r in leakage.leak_report(df, spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")).collect()}
    assert got == {(0, "paraphrase"), (2, "passage")}


def test_leaks_of_an_item_in_a_third_of_the_documents(spark):
    """A hot item's words are in too many documents to weigh; an item that shares most of them is found too."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    hot, rare = [word() for _ in range(30)], [word() for _ in range(30)]
    items = [(0, hot), (1, rare), (2, hot[:26] + [word() for _ in range(4)])]
    docs, want = [], set()
    for d in range(150):
        body = [word() for _ in range(r.randint(5, 60))]
        if d % 3 == 0:
            part = hot[:20] if d % 2 else [*hot[:12], "other", *hot[13:]]
            body[len(body) // 2 : len(body) // 2] = part
            want |= {(d, 0), (d, 2)}
        elif d % 30 == 1:
            body += rare[5:25]
            want.add((d, 1))
        elif d % 3 == 1:
            body += r.sample(hot, 30)
        docs.append((d, " ".join(body)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    assert {tuple(x) for x in leakage.leaks(df, it).collect()} == want
    assert {tuple(x) for x in leakage.leaks(df, it.where("item_id = 0")).collect()} == {x for x in want if x[1] == 0}


def test_randomised_svd_finds_the_leading_space(spark):
    import numpy as np

    a = np.random.default_rng(1).standard_normal((60, 6)) @ np.random.default_rng(2).standard_normal((6, 40))
    rows = spark.createDataFrame([(list(range(40)), [float(v) for v in x]) for x in a], "words array<int>, weights array<float>")
    v = leakage.randomised_svd(rows, 40, rank=6, extra=6)
    assert np.linalg.norm(a - (a @ v) @ v.T) < 1e-3 * np.linalg.norm(a)


# ----------------------------------------------------------------------- prose


COMMON = ["the", "and", "of", "आणि", "आहे", "है", "की", "in", "that", "is"]


def test_rules_hold_on_documents_made_apart(spark):
    rules, stats = prose.learn_rules(spark, spark.createDataFrame([(t,) for t in MR + HI + EN], "text string"), COMMON, n=1500)
    made = prose.labelled_documents(MR + HI + EN, 400, seed=99)
    df = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(made)] + [(1000, "none", None), (1001, "none", " ")], "doc_id int, truth string, text string")
    got = prose.label_kinds(df, rules, stats, COMMON).select("truth", "kind").collect()
    right = sum(r.truth == r.kind for r in got if r.truth != "none")
    assert right >= 0.85 * len(made)
    assert all(r.kind is None for r in got if r.truth == "none")


def test_rules_hold_on_forms_they_were_not_learned_from(spark):
    """Programs, records, codes and wrong decodings of kinds left out of the training documents."""
    held = frozenset({"junk:indented", "junk:queries", "junk:log", "junk:ascii85", "junk:cp850", "list:number", "table:semicolon"})
    rules, stats = prose.learn_rules(spark, spark.createDataFrame([(t,) for t in MR + HI + EN], "text string"), COMMON, n=1500, without=held)
    made = prose.labelled_documents(MR + HI + EN, 400, seed=5, only=held)
    got = prose.label_kinds(spark.createDataFrame(made, "truth string, text string"), rules, stats, COMMON).select("truth", "kind").collect()
    assert sum(r.kind != "prose" for r in got) >= 0.9 * len(got)


# ------------------------------------------------------------ tokens, mixture


def test_pieces_equal_brute_force():
    pieces = [("▁", "piece", -3.0), ("a", "piece", -4.0), ("b", "piece", -4.0), ("ab", "piece", -5.0), ("▁a", "piece", -4.5), ("bab", "piece", -9.5), ("<0x00>", "byte", -20.0)]
    t = tokens.PieceTokenizer(pieces)
    score = {p: s for p, k, s in pieces if k == "piece"}

    def best(text):
        if not text:
            return (0.0, 0)
        options = [(best(text[len(p) :])[0] + s, best(text[len(p) :])[1] - 1) for p, s in score.items() if text.startswith(p)]
        if text[0] not in score:
            n = len(text[0].encode())
            options.append((best(text[1:])[0] - 20.0 * n, best(text[1:])[1] - n))
        return max(options)

    for w in ["a", "ab", "abab", "bbb", "aé", "क", "xabx"]:
        assert t.word(w) == -best("▁" + w)[1], w
    assert t.count(None) == t.count("  ") == 0 and t.count("a ab") == t.word("a") + t.word("ab")


def test_token_estimates_come_near(spark, model):
    pieces = [("▁", "piece", -3.0)] + [(c, "piece", -4.0) for c in sorted({c for t in MR + EN for c in t if c != " "})] + [("<0x00>", "byte", -20.0)]
    r = random.Random(7)
    rows = [(i, r.choice(["a", "b"]), "d", " ".join(r.choice(MR + EN) for _ in range(r.randint(1, 6)))) for i in range(400)] + [(1000, "a", None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, subject_domain string, text string")
    est = tokens.estimate_tokens(df, pieces, model, docs=150)
    exact = {r["doc_id"]: r["tokens"] for r in tokens.with_token_counts(df, pieces).collect()}
    got = {r["doc_id"]: r["est_tokens"] for r in est.collect()}
    assert set(got) == set(exact) and got[1000] == 0
    assert abs(sum(got.values()) / sum(exact.values()) - 1) < 0.02
    total = [r for r in tokens.token_totals(est).collect() if r["level"] == "all"][0]
    assert total["docs"] == 401 and total["est_tokens"] == sum(got.values())


def test_mixture_reaches_its_shares(spark):
    r = random.Random(8)
    rows = [(i, r.choice(["a"] * 8 + ["b", "c"]), r.randint(1, 60)) for i in range(2000)] + [(3000, None, 5), (3001, "a", 0), (3002, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 3), ("c", 0.2, 2), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    m = mixture.mix(docs, targets, slot_tokens=100)
    got = {r["source"]: r for r in mixture.shares(m, targets).collect()}
    for s, w in (("a", 1 / 3), ("b", 4 / 9), ("c", 2 / 9)):
        assert abs(got[s]["actual_share"] - w) < 0.01 and got[s]["most_uses"] <= got[s]["max_repeats"]
    assert got["none"]["tokens"] == 0
    # Slots are full, and a copy's parts follow each other without gaps.
    parts = m.collect()
    held, ends = {}, {}
    for x in parts:
        held[x["slot"]] = held.get(x["slot"], 0) + x["tokens"]
    assert set(held) == set(range(len(held))) and set(held.values()) == {100}
    for x in sorted(parts, key=lambda x: (x["doc_id"], x["copy"], x["first_token"])):
        assert x["first_token"] == ends.get((x["doc_id"], x["copy"]), 0)
        ends[x["doc_id"], x["copy"]] = x["first_token"] + x["tokens"]
    tokens_of = {i: n for i, _, n in rows}
    assert sum(n != tokens_of[i] for (i, _), n in ends.items()) <= 3
    assert {len({x["source"] for x in parts if x["slot"] == k}) for k in held} == {1}
    assert mixture.mix(docs.limit(0), targets).count() == 0
