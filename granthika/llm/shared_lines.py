"""Lines repeated across one source's documents (problem 1).

A document is a stream of letters in which a line end is a character like any other.  A rolling
hash over three characters sets the cuts of content-defined chunks, so shared text yields equal
chunks wherever it stands.  Distinct documents are counted per chunk and source; chunks repeated
excessively are cut, and a line more than half of whose letters are cut in enough documents is a
candidate.  An exact count of the candidates follows, since single chunks of a few letters are
frequent in sound text too.

Before hashing, what may be filled in differently is dropped (figures, dates, times, personal
data), as are case, spacing and punctuation, and characters that look the same are made one.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chars import fold_all
from .common import by_batch, cut, rows_bound, slices
from .pii import Detector, Gazetteer

#: A line is shared from this many documents and this share of its source's documents.
LEAST_DOCS, LEAST_SHARE = 3, 0.1
#: The rolling window and the mean length of a chunk, in characters.
WINDOW, MEAN_CHUNK = 3, 4
#: A line is a candidate if this share of its letters is cut, in this share of the documents it needs.
CUT_SHARE, CUT_DOCS = 0.5, 1 / 3
#: Rows of a per-source table that may go to every worker (about 16 bytes each), and its copies otherwise.
BROADCAST_ROWS, SALT = 400_000, 64

# Names of the months, which stand for figures in dates.
MONTHS = (
    "जानेवारी फेब्रुवारी मार्च एप्रिल मे जून जुलै ऑगस्ट सप्टेंबर ऑक्टोबर नोव्हेंबर डिसेंबर "
    "जनवरी फ़रवरी फरवरी अप्रैल मई जुलाई अगस्त सितंबर सितम्बर अक्टूबर अक्तूबर नवंबर नवम्बर दिसंबर दिसम्बर "
    "जनवरी फेब्रुअरी अप्रिल जुन जुलाई अगस्ट सेप्टेम्बर अक्टोबर नोभेम्बर डिसेम्बर "
    "january february march april may june july august september october november december "
    "jan feb mar apr jun jul aug sep sept oct nov dec am pm "
    "જાન્યુઆરી ફેબ્રુઆરી માર્ચ એપ્રિલ મે જૂન જુલાઈ ઑગસ્ટ ઓગસ્ટ સપ્ટેમ્બર ઑક્ટોબર ઓક્ટોબર નવેમ્બર ડિસેમ્બર"
).split()
_IN_WORD = re.compile(r"[\wऀ-૿]").match
_DATED = re.compile(r"\d")

#: What one batch of documents becomes: a row of packed arrays a document, and a row a source with the number of documents of each chunk.
PACKED = "doc_id bigint, source string, nos binary, keys binary, parts binary, hashes binary, letters binary, counts array<bigint>"
#: Counts of chunks that are held before they are summed up; if over half as many are left, they are given away.
HELD_COUNTS = 1_000_000


@lru_cache(maxsize=1)
def _letters():
    """Per code point whether it is a letter or mark of a word; line ends and the mark between documents stay too."""
    import numpy as np

    keep = np.array([(c := chr(cp)).isalnum() and not c.isdecimal() or 0x900 <= cp <= 0xDFF and not c.isdecimal() for cp in range(0x40000)] + [False] * (0x110000 - 0x40000))
    keep[[0, 10]] = True
    return keep


@lru_cache(maxsize=1)
def _months():
    import ahocorasick

    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for x in MONTHS:
        automaton.add_word(x)
    automaton.make_automaton()
    return automaton


def without_months(text: str) -> str:
    """A blank for each month, as a word of its own, in lines with a figure."""
    out, done = [], 0
    for end, n in _months().iter(text):
        a, b = end + 1 - n, end + 1
        if not (b < len(text) and _IN_WORD(text[b]) or a and _IN_WORD(text[a - 1])):
            stop = text.find("\n", b)
            if _DATED.search(text, text.rfind("\n", 0, a) + 1, len(text) if stop < 0 else stop):
                out += [text[done:a], " "]
                done = b
    return "".join(out) + text[done:] if out else text


def without_values(d: Detector, text: str) -> str:
    """A folded text in lower case without what may be filled in; its line ends stay."""
    spans = d.structured(text)
    spans += [(a, b, "name") for a, b in d.people(text) if all(b <= x or y <= a for x, y, _ in spans)]
    if spans:
        out, at = [], 0
        for a, b, _ in sorted(spans):
            out += [text[at:a], "\n" * text.count("\n", a, b) or " "]
            at = b
        text = "".join(out) + text[at:]
    return without_months(text.lower()).replace("\0", " ")


class Lines:
    """The lines of a batch of documents that hold a letter, as arrays: the letters, and per line its document, number, start and length."""

    def __init__(self, d: Detector, texts: list[str]):
        import numpy as np

        joined = "\0".join([without_values(d, t) for t in texts]) + "\0" if texts else ""
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = codes[_letters()[codes]]
        ends = np.flatnonzero((codes == 10) | (codes == 0))
        starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else np.zeros(0, dtype=np.int64)
        last = codes[ends] == 0
        doc = np.concatenate([[0], np.cumsum(last)[:-1]]).astype(np.int64) if len(ends) else starts
        first = np.zeros(len(texts) + 1, dtype=np.int64)
        np.add.at(first, doc + 1, 1)
        no = np.arange(len(ends)) - np.cumsum(first)[doc]
        used = ends > starts
        self.codes, self.n_docs = codes, len(texts)
        self.doc, self.no, self.start, self.size = doc[used], no[used], starts[used], (ends - starts)[used]

    def keys(self):
        """A 64-bit hash of each line's letters."""
        import numpy as np

        raw, size = self.codes.tobytes(), 4
        return np.array([xxhash.xxh3_64_intdigest(raw[a * size : (a + n) * size]) for a, n in zip(self.start.tolist(), self.size.tolist())], dtype=np.uint64).view(np.int64)

    def chunks(self, window: int = WINDOW, mean: int = MEAN_CHUNK):
        """(line, chunk's hash, letters of the line in it) of each part of a chunk that lies in a line, in order.

        Whether a cut stands before a character depends on it and its neighbours only, and every
        document begins and ends with a cut."""
        import numpy as np

        if not len(self.start):
            return (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64))
        # The stream: a line end before the first line, and each line with its end.
        size = self.size + 1
        begin = 1 + np.concatenate([[0], np.cumsum(size)[:-1]])
        n = int(size.sum()) + 1
        stream = np.full(n, 10, dtype=np.uint64)
        inside = np.arange(n - 1) - np.repeat(begin - 1, size)
        letter = inside < np.repeat(self.size, size)
        stream[1:][letter] = self.codes[(np.repeat(self.start, size) + inside)[letter]]
        base = np.uint64(0x9E3779B97F4A7C15)
        with np.errstate(over="ignore"):
            rolled, power = np.zeros(n - window + 1, dtype=np.uint64), np.uint64(1)
            for k in range(window):
                rolled += stream[k : n - window + 1 + k] * power
                power *= base
            mixed = (rolled ^ (rolled >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed >>= np.uint64(33)
            is_cut = np.zeros(n, dtype=bool)
            is_cut[window // 2 : window // 2 + len(mixed)] = (mixed & np.uint64(mean - 1) if mean & (mean - 1) == 0 else mixed % np.uint64(mean)) == 0
            opens = begin[np.flatnonzero(np.diff(self.doc, prepend=-1))]
            is_cut[opens] = is_cut[opens - 1] = is_cut[n - 1] = True
            cuts = np.flatnonzero(is_cut)
            bounds = np.append(cuts, n)
            # A chunk's hash from sums of characters weighed by powers of an odd base, shifted back to 0.
            weights = np.cumprod(np.full(n, base, dtype=np.uint64))
            back = np.cumprod(np.full(n, np.uint64(pow(int(base), -1, 1 << 64)), dtype=np.uint64))
            sums = np.concatenate([[np.uint64(0)], np.cumsum(stream * weights, dtype=np.uint64)])
            hashes = (sums[bounds[1:]] - sums[cuts]) * back[cuts]
            hashes = ((hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        is_line = np.zeros(n, dtype=bool)
        is_line[begin] = True
        edges = np.flatnonzero(is_cut | is_line)
        edges = edges[edges > 0]
        stop = np.append(edges[1:], n)
        line = np.cumsum(is_line)[edges] - 1
        letters = stop - edges - (stop == begin[line] + size[line])
        kept = letters > 0
        return line[kept], hashes[np.cumsum(is_cut)[edges] - 1][kept], letters[kept]


def _runs(x):
    """Where each run of equal numbers begins."""
    import numpy as np

    first = np.ones(len(x), dtype=bool)
    first[1:] = x[1:] != x[:-1]
    return np.flatnonzero(first)


class ChunkCounts:
    """The number of documents of each source and chunk, over the slices of a batch."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.parts: list[tuple] = []
        self.held = 0

    def add(self, sources: list[str], doc, hashes) -> None:
        """Parts of chunks: the document of each, by its place in ``sources``, and the chunk's hash."""
        import numpy as np

        of = np.array([self.place.setdefault(s, len(self.place)) for s in sources], dtype=np.uint64)
        once = np.sort((doc.astype(np.uint64) << np.uint64(32)) | hashes.view(np.uint32).astype(np.uint64))
        once = once[_runs(once)]
        keys = np.sort((of[(once >> np.uint64(32)).astype(np.int64)] << np.uint64(32)) | (once & np.uint64(0xFFFFFFFF)))
        first = _runs(keys)
        self.parts.append((keys[first], np.diff(first, append=len(keys))))
        self.held += len(first)

    def sum(self) -> None:
        import numpy as np

        if len(self.parts) > 1:
            keys, n = (np.concatenate(x) for x in zip(*self.parts))
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = _runs(keys)
            self.parts = [(keys[first], np.add.reduceat(n[order], first) if len(keys) else n)]
            self.held = len(first)

    def taken(self) -> tuple[list[str], pa.ListArray]:
        """The sources, and of each the counts: the chunk in the upper half of a number, its documents in the lower.  Nothing is held after."""
        import numpy as np

        self.sum()
        keys, n = self.parts[0] if self.parts else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
        bounds = np.searchsorted(keys, np.arange(len(self.place) + 1, dtype=np.uint64) << np.uint64(32)).astype(np.int32)
        packed = ((keys << np.uint64(32)) | n.astype(np.uint64)).view(np.int64)
        got = list(self.place), pa.ListArray.from_arrays(pa.array(bounds), pa.array(packed))
        self.__init__()
        return got


def _binaries(x, at) -> pa.Array:
    """The parts of an array between the places ``at``, as binary values."""
    import numpy as np

    x = np.ascontiguousarray(x)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * x.itemsize).astype(np.int32)), pa.py_buffer(x)])


def lines_and_chunks(df: DataFrame, names: Gazetteer, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The lines of every document and what chunks they lie in, packed, and in rows with ``counts`` the documents of each chunk of a source, counted within the batch; see ``chunk_counts``."""
    made = {}
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), *[(k, pa.binary()) for k in ("nos", "keys", "parts", "hashes", "letters")], ("counts", pa.list_(pa.int64()))])

    def counted(counts: ChunkCounts) -> pa.RecordBatch:
        sources, lists = counts.taken()
        return pa.RecordBatch.from_arrays([pa.array(sources, pa.string()) if f.name == "source" else lists if f.name == "counts" else pa.nulls(len(sources), f.type) for f in schema], schema=schema)

    def run(batch: pa.RecordBatch):
        counts = ChunkCounts()
        for part in slices(batch, 2):
            yield pack(part, counts)
            if counts.held > HELD_COUNTS:
                counts.sum()
                if counts.held > HELD_COUNTS // 2:
                    yield counted(counts)
        yield counted(counts)

    def pack(batch: pa.RecordBatch, counts: ChunkCounts) -> pa.RecordBatch:
        import numpy as np

        d = made.get("d") or made.setdefault("d", Detector(names))
        sources = batch.column(1).to_pylist()
        lines = Lines(d, fold_all([t or "" for t in batch.column(2).to_pylist()]))
        keys = lines.keys()
        line, hashes, letters = lines.chunks()
        parts = np.bincount(line, minlength=len(keys)).astype(np.uint32)
        at_line = np.searchsorted(lines.doc, np.arange(lines.n_docs + 1))
        at_part = np.concatenate([[0], np.cumsum(parts)]).astype(np.int64)[at_line]
        counts.add(sources, lines.doc[line], hashes)
        # A document without lines has no row, and no part of the arrays.
        kept = np.flatnonzero(np.diff(at_line))
        at_line, at_part = (np.append(x[kept], x[-1]) for x in (at_line, at_part))
        packed = ((lines.no.astype(np.int32), at_line), (keys, at_line), (parts, at_line), (hashes, at_part), (np.minimum(letters, 255).astype(np.uint8), at_part))
        return pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), *[_binaries(*x) for x in packed], pa.nulls(len(kept), schema.field("counts").type)], schema=schema)

    cols = df.where(F.col(text).rlike("\\S")).select(F.col(key).cast("bigint"), F.coalesce(F.col(source), F.lit("")), text)
    return by_batch(cols, run, PACKED)


def chunk_counts(packed: DataFrame) -> DataFrame:
    """``(source, chunk, n)``: the documents of each chunk and source, a row a batch that holds it."""
    both = packed.where("counts is not null").select("source", F.explode("counts").alias("both"))
    return both.select("source", F.shiftright("both", 32).cast("int").alias("chunk"), F.col("both").bitwiseAND(0xFFFFFFFF).alias("n"))


def _looked_up(docs: DataFrame, values: DataFrame, value: str, kind: str, fn: Callable, schema: str) -> DataFrame:
    """``fn(columns, rows, known, source)`` of the rows of each source in every batch of ``docs``, ``known`` being the sorted array of the source's values; it gives the columns of ``schema``.

    A source has at most ``values per document / LEAST_SHARE`` frequent values, since each takes
    a tenth of its documents.  A table of few rows goes to every worker; a bigger one is
    copied under ``SALT`` keys, so that no source's documents meet in one task."""
    types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    out = pa.schema([(x.split()[0], types[x.split()[1]]) for x in schema.split(", ")])

    def each(batch: pa.RecordBatch, known_of: Callable):
        import numpy as np

        columns = {k: batch.column(k).to_pylist() for k in batch.schema.names if k != "of_source"}
        rows: dict[str, list[int]] = {}
        for i, s in enumerate(columns["source"]):
            rows.setdefault(s, []).append(i)
        parts = [fn(columns, own, known, s) for s, own in rows.items() if len(known := known_of(s, own[0]))]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in parts]), type=f.type) for k, f in enumerate(out)], schema=out)

    got = rows_bound(values.select("source", value), BROADCAST_ROWS)
    if got is not None:
        lists: dict[str, list[int]] = {}
        for s, v in got:
            lists.setdefault(s, []).append(v)
        shared = docs.sparkSession.sparkContext.broadcast(lists)
        made: dict = {}

        def few(batch: pa.RecordBatch):
            import numpy as np

            if not made:
                made.update({s: np.sort(np.array(v, dtype=kind)) for s, v in shared.value.items()})
            return each(batch, lambda s, _: made.get(s, ()))

        return by_batch(docs, few, schema)
    arrays = values.groupBy("source").agg(F.array_sort(F.collect_list(value)).alias("of_source"))
    salted = arrays.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    joined = docs.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int")).join(salted, ["source", "_salt"], "left").drop("_salt")

    def many(batch: pa.RecordBatch):
        import numpy as np

        at = batch.column("of_source")
        return each(batch, lambda _, i: np.array(at[i].as_py() or [], dtype=kind))

    return by_batch(joined, many, schema)


def _among(x, known):
    """Which entries of ``x`` the sorted array ``known``, which is not empty, holds."""
    import numpy as np

    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _packed(columns: dict[str, list], name: str, rows: list[int], kind: str):
    """The packed arrays of some rows, one after the other."""
    import numpy as np

    return np.frombuffer(b"".join([columns[name][i] for i in rows]), dtype=kind)


def _documents(columns: dict[str, list], rows: list[int]):
    """The row of each line of ``_packed`` keys."""
    import numpy as np

    return np.repeat(np.array(rows), [len(columns["keys"][i]) // 8 for i in rows])


def _documents_per_key(source: str, keys, docs):
    """``(source, line, n)``: in how many documents each key stands."""
    import numpy as np

    order = np.lexsort((docs, keys))
    k, d = keys[order], docs[order]
    once = np.ones(len(k), dtype=bool)
    once[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    lines, n = np.unique(k[once], return_counts=True)
    return np.full(len(lines), source, dtype=object), lines, n


def shared_forms(df: DataFrame, names: Gazetteer, key: str = "doc_id", text: str = "text", source: str = "source", share: float = LEAST_SHARE, docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """(packed lines of every document, ``(source, line)``: the keys of each source's shared lines).

    A line is shared that ``docs`` documents and a ``share`` of all documents of its source hold.
    Null texts count as documents of their source; a null source is a source of its own."""
    import numpy as np

    least = cut(df.groupBy(F.coalesce(F.col(source), F.lit("")).alias("source")).agg(F.greatest(F.lit(docs), F.ceil(F.count("*") * F.lit(share) - F.lit(1e-9))).alias("least")))
    # Else the counts may be taken for the smaller side, as nothing tells how many lie in an array.
    least = F.broadcast(least) if least.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else least.hint("merge")
    packed = cut(lines_and_chunks(df, names, key, text, source))
    lines = packed.where("doc_id is not null").select("doc_id", "source", "nos", "keys", "parts", "hashes", "letters")

    def frequent(counts: DataFrame, value: str, part: float = 1.0) -> DataFrame:
        return cut(counts.groupBy("source", value).agg(F.sum("n").alias("n")).join(least, "source").where(F.col("n") >= F.col("least") * F.lit(part)).select("source", value))

    excessive = frequent(chunk_counts(packed), "chunk")

    def cut_lines(columns: dict[str, list], rows: list[int], known, source: str):
        keys = _packed(columns, "keys", rows, "int64")
        weight = _packed(columns, "letters", rows, "uint8").astype(np.int64)
        first = np.concatenate([[0], np.cumsum(_packed(columns, "parts", rows, "uint32"))[:-1]]).astype(np.int64)
        gone = np.add.reduceat(weight * _among(_packed(columns, "hashes", rows, "int32"), known), first)
        chosen = gone >= CUT_SHARE * np.add.reduceat(weight, first)
        return _documents_per_key(source, keys[chosen], _documents(columns, rows)[chosen])

    def count_forms(columns: dict[str, list], rows: list[int], known, source: str):
        keys = _packed(columns, "keys", rows, "int64")
        chosen = _among(keys, known)
        return _documents_per_key(source, keys[chosen], _documents(columns, rows)[chosen])

    counts = "source string, line bigint, n bigint"
    candidates = frequent(_looked_up(lines, excessive, "chunk", "int32", cut_lines, counts), "line", CUT_DOCS)
    return lines, frequent(_looked_up(lines.select("doc_id", "source", "keys"), candidates, "line", "int64", count_forms, counts), "line")


def shared_lines(df: DataFrame, names: Gazetteer, key: str = "doc_id", text: str = "text", source: str = "source", share: float = LEAST_SHARE, docs: int = LEAST_DOCS) -> DataFrame:
    """``(doc_id, line_no)``: each occurrence of a shared line; see ``shared_forms``.

    Lines of nothing but signs and filled-in values are none.  A document without ``doc_id``
    counts, but gives no row."""
    import numpy as np

    lines, forms = shared_forms(df, names, key, text, source, share, docs)

    def places(columns: dict[str, list], rows: list[int], known, source: str):
        chosen = _among(_packed(columns, "keys", rows, "int64"), known)
        ids = np.repeat(np.array([columns["doc_id"][i] for i in rows], dtype=np.int64), [len(columns["keys"][i]) // 8 for i in rows])
        return ids[chosen], _packed(columns, "nos", rows, "int32")[chosen]

    return _looked_up(lines.select("doc_id", "source", "nos", "keys"), forms, "line", "int64", places, "doc_id bigint, line_no int")


def without_shared_lines(df: DataFrame, forms: DataFrame, names: Gazetteer, text: str = "text", source: str = "source") -> DataFrame:
    """``df`` with ``clean_text``, the text without its source's shared lines, and ``n_removed``; other columns and rows stay.

    The shared lines go to the texts, not the texts to the lines: a table of few rows goes to
    every worker; a bigger one is joined by source, spread over ``SALT`` keys."""
    made: dict = {}
    got = rows_bound(forms.select("source", "line"), BROADCAST_ROWS)
    known: dict[str, set[int]] = {}
    for s, k in got or []:
        known.setdefault(s, set()).add(k)
    shared = df.sparkSession.sparkContext.broadcast(known)

    def clean(texts, of):
        import pandas as pd

        d = made.get("d") or made.setdefault("d", Detector(names))
        raw = [t if isinstance(t, str) else None for t in texts]
        lines = Lines(d, fold_all([t or "" for t in raw]))
        gone: dict[int, set[int]] = {}
        for i, no, k in zip(lines.doc.tolist(), lines.no.tolist(), lines.keys().tolist()):
            if k in of(i):
                gone.setdefault(i, set()).add(no)
        out = [t if i not in gone else "\n".join(x for no, x in enumerate(t.split("\n")) if no not in gone[i]) for i, t in enumerate(raw)]
        return pd.DataFrame({"clean_text": out, "n_removed": [len(gone.get(i, ())) for i in range(len(out))]})

    if got is not None:

        @F.pandas_udf("struct<clean_text string, n_removed int>")
        def run(texts, sources):
            own = [shared.value.get(s, ()) for s in sources]
            return clean(texts, own.__getitem__)

        marked = df.withColumn("_clean", run(F.col(text), F.coalesce(F.col(source), F.lit(""))))
    else:

        @F.pandas_udf("struct<clean_text string, n_removed int>")
        def run_joined(texts, arrays):
            own = [frozenset(() if a is None else map(int, a)) for a in arrays]
            return clean(texts, own.__getitem__)

        arrays = forms.groupBy(F.col("source").alias("_source")).agg(F.collect_list("line").alias("_lines")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        place = (F.coalesce(F.col(source), F.lit("")) == F.col("_source")) & (F.pmod(F.xxhash64(text), F.lit(SALT)) == F.col("_salt"))
        marked = df.join(arrays, place, "left").withColumn("_clean", run_joined(F.col(text), F.col("_lines"))).drop("_source", "_salt", "_lines")
    return marked.withColumns({"clean_text": F.col("_clean.clean_text"), "n_removed": F.col("_clean.n_removed")}).drop("_clean")
