"""SQL that gives the same results as the core's queries, for an engine with RE2 and lists."""

from __future__ import annotations

from .functions import redaction
from .functions import text as T

WS, NWS = T.SPACE, T.NOT_SPACE
DOCS = "docs AS (SELECT *, coalesce(text, '') AS t FROM documents)"
STRIP = lambda x: f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"
WORDS = lambda x: f"regexp_extract_all({x}, '{NWS}+')"
LINES = lambda x: f"(CASE WHEN {x} = '' THEN [] WHEN regexp_matches({x}, '({T.LINE_END})$') THEN string_split_regex({x}, '{T.LINE_END}')[:-2] ELSE string_split_regex({x}, '{T.LINE_END}') END)"
BUCKET = lambda key, m: f"(('0x' || substr(md5({key}), 1, 8))::BIGINT % {m})"
KEY = "coalesce(source, '') || ':' || coalesce(id, '')"
SPLIT = f"CASE WHEN {BUCKET(KEY, 1000000)} / 1e6 < 0.005 THEN 'val' WHEN source = 'wikipedia' AND {BUCKET(KEY, 1000000)} / 1e6 < 0.025 THEN 'wiki_val' ELSE 'train' END"
FRAME = "(" + " OR ".join(f"contains(@, '{p}')" for p in T.FRAME_PHRASES) + ")"

MEASURES = f"""
lined AS (SELECT *, {LINES('t')} AS ls FROM docs),
marked AS (SELECT *, list_filter(ls, lambda x: {FRAME.replace('@', f'lower({STRIP("x")})')}) AS fl, list_filter(ls, lambda x: NOT {FRAME.replace('@', f'lower({STRIP("x")})')}) AS kl FROM lined),
cleaned AS (SELECT *, CASE WHEN len(ls) = 0 THEN 0.0 ELSE len(fl) / len(ls) END AS frame_ratio, CASE WHEN t = '' THEN t ELSE array_to_string(kl, chr(10)) END AS clean_text FROM marked),
measured AS (SELECT *, {STRIP('clean_text')} AS c FROM cleaned),
counted AS (SELECT *, len({WORDS('c')}) AS n_words, len(regexp_extract_all(c, '{T.SYMBOL_CLASS}')) / greatest(1, len({WORDS('c')})) AS symbol_ratio,
  CASE WHEN len(regexp_extract_all(t, '{NWS}')) = 0 THEN 0.0 ELSE len(regexp_extract_all(t, '[\\x{{900}}-\\x{{97f}}]')) / len(regexp_extract_all(t, '{NWS}')) END AS script_ratio,
  list_filter(list_transform({LINES('c')}, lambda x: {STRIP('x')}), lambda x: x <> '') AS sl FROM measured),
rated AS (SELECT *, CASE WHEN len(sl) < 2 THEN 0.0 ELSE (len(sl) - len(list_filter(map_values(list_histogram(sl)), lambda n: n = 1))) / len(sl) END AS repeated_ratio FROM counted),
reasoned AS (SELECT *, CASE WHEN script_ratio < 0.70 THEN 'script' WHEN frame_ratio > 0.50 THEN 'frame' WHEN n_words < 20 OR n_words > 100000 THEN 'words' WHEN symbol_ratio > 0.10 THEN 'symbols' WHEN repeated_ratio > 0.30 THEN 'repeats' ELSE 'kept' END AS reason FROM rated)
"""
# Copies: the first in (source, doc_id) of each canonically composed text.
FIRSTS = "firsts AS (SELECT * FROM docs QUALIFY row_number() OVER (PARTITION BY nfc_normalize(t) ORDER BY source, doc_id) = 1)"
SHINGLES = f"""
worded AS (SELECT source, doc_id, {WORDS('t')} AS w FROM %s),
shingled AS (SELECT source, doc_id, list_distinct(list_transform(range(0, greatest(1, len(w) - 4)), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS s FROM worded)
"""
RE2 = lambda p: p.replace(r"(?<!\p{Nd})", "").replace(r"(?!\p{Nd})", "")
ONCE = lambda x, p, m: f"regexp_replace({x}, '(^|\\P{{Nd}})({RE2(p)})(\\P{{Nd}}|$)', '\\1{m}\\3', 'g')"
# Boundaries are consumed here, so neighbours that share one need a second pass.
TWICE = lambda x, p, m: ONCE(ONCE(x, p, m), p, m)
STREAM = f"""
copies AS (SELECT source, doc_id, {SPLIT} AS split, len({WORDS('t')}) + 1 AS n, {WORDS('t')} AS w, unnest(range(0, CASE WHEN source = 'wikipedia' AND ({SPLIT}) = 'train' THEN 2 ELSE 1 END)) AS copy FROM docs WHERE regexp_matches(t, '{NWS}')),
streams AS (SELECT *, sum(n) OVER (PARTITION BY split ORDER BY source, doc_id, copy) - n AS start FROM copies)
"""
TOKENS = """
placed AS (SELECT split, start, unnest(range(0, n)) AS i, unnest(list_append(list_transform(w, lambda x: ('0x' || substr(md5(x), 1, 4))::BIGINT % 60000 + 2), 1)) AS id FROM streams),
toks AS MATERIALIZED (SELECT split, start + i AS pos, id FROM placed)
"""
# A greedy pass over the documents near others, in order: node by node with the list of what is kept.
WALK = lambda firsts: f"""
{SHINGLES % firsts}, sized AS MATERIALIZED (SELECT doc_id, len(s) AS n, s FROM shingled), e AS MATERIALIZED (SELECT doc_id, n, unnest(s) AS g FROM sized),
place AS MATERIALIZED (SELECT doc_id, source, row_number() OVER (ORDER BY source, doc_id) AS r FROM {firsts}),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
near AS MATERIALIZED (SELECT pa.r AS a, pb.r AS b FROM common JOIN place pa ON pa.doc_id = a JOIN place pb ON pb.doc_id = b WHERE c / (na + nb - c) >= 0.8 - 1e-12 AND pa.r < pb.r),
nodes AS MATERIALIZED (SELECT r, list(a) AS before, row_number() OVER (ORDER BY r) AS i FROM (SELECT b AS r, a FROM near UNION ALL SELECT a, NULL FROM near) GROUP BY r),
walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept, []::BIGINT[] AS dropped UNION ALL
  SELECT n.i, CASE WHEN list_has_any(w.kept, n.before) THEN w.kept ELSE list_append(w.kept, n.r) END, CASE WHEN list_has_any(w.kept, n.before) THEN list_append(w.dropped, n.r) ELSE w.dropped END FROM walk w JOIN nodes n ON n.i = w.i + 1),
gone AS (SELECT unnest(dropped) AS r FROM (SELECT dropped FROM walk ORDER BY i DESC LIMIT 1)),
left_over AS (SELECT doc_id, source, r FROM place WHERE r NOT IN (SELECT r FROM gone))
"""  # noqa: E731
TURNS = f"""
turned AS (SELECT row_id, dataset, unnest(range(0, len(mar_deva))) AS turn, mar_deva FROM indic_turns),
pairs AS (SELECT row_id || '-' || turn AS example, dataset AS source, {STRIP("coalesce(mar_deva[turn + 1][1], '')")} AS instruction, {STRIP("coalesce(mar_deva[turn + 1][2], '')")} AS response FROM turned WHERE len(mar_deva[turn + 1]) = 2),
flat AS (SELECT * FROM pairs WHERE instruction <> '' AND response <> '')
"""
CHAT = "'<|user|>' || chr(10) || instruction || chr(10) || '<|assistant|>' || chr(10)"
EXAMPLES = f"""
ided AS (SELECT *, list_transform({WORDS(CHAT)}, lambda w: length(w) + 1) AS p, list_transform({WORDS('response')}, lambda w: length(w) + 1) AS r FROM flat),
examples AS (SELECT *, list_concat(list_concat(p, r), [1]) AS ids, list_concat(list_transform(p, lambda i: 0), list_concat(list_transform(r, lambda i: 1), [1])) AS mask FROM ided WHERE len(p) + len(r) + 1 <= 64)
"""
TWEETS = f"tw AS (SELECT tweet_id, {STRIP('tweet')} AS tweet, label, split_name FROM tweets WHERE label IS NOT NULL AND regexp_matches(coalesce(tweet, ''), '{NWS}'))"
SHOTS = "shots AS (SELECT * FROM tw WHERE split_name = 'train' QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('shots:' || tweet_id), tweet_id) <= 3)"
PREDICTED = f"""
scored AS (SELECT tweet_id, l.label_of, 0 - {BUCKET("tweet_id || ':' || l.label_of", 8)}::DOUBLE AS score FROM tw, (VALUES (1, 0), (-1, 1), (0, 2)) AS l(label_of, place)),
predicted AS (SELECT tweet_id, label_of AS predicted, score FROM scored QUALIFY row_number() OVER (PARTITION BY tweet_id ORDER BY score DESC, CASE label_of WHEN 1 THEN 0 WHEN -1 THEN 1 ELSE 2 END) = 1)
"""
LOGITS = "logits AS (SELECT vec_id AS ctx, unnest(range(0, len(embedding)))::INT AS token, unnest(embedding)::DOUBLE AS logit FROM embeddings)"
TOPK = "topk AS (SELECT * FROM logits QUALIFY rank() OVER (PARTITION BY ctx ORDER BY logit DESC) <= 10)"
SOFT = lambda of: f"peaks AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY ctx)) AS e FROM {of}), soft AS (SELECT *, e / sum(e) OVER (PARTITION BY ctx) AS p FROM peaks)"

# Redaction of {of}'s text t, in columns te, n_aadhaar, n_phone, n_email.
REDACTED = lambda of: f"""ra AS (SELECT *, {TWICE('t', redaction.AADHAAR, '[AADHAAR]')} AS ta FROM {of}), rp AS (SELECT *, {TWICE('ta', redaction.PHONE, '[PHONE]')} AS tp FROM ra), re AS (SELECT *, regexp_replace(tp, '{redaction.EMAIL}', '[EMAIL]', 'g') AS te FROM rp),
red AS (SELECT *, ((length(ta) - length(replace(ta, '[AADHAAR]', ''))) / 9 - (length(t) - length(replace(t, '[AADHAAR]', ''))) / 9)::INT AS n_aadhaar, ((length(tp) - length(replace(tp, '[PHONE]', ''))) / 7 - (length(ta) - length(replace(ta, '[PHONE]', ''))) / 7)::INT AS n_phone, len(regexp_extract_all(tp, '{redaction.EMAIL}'))::INT AS n_email FROM re)"""  # noqa: E731
KEPT = "kept AS MATERIALIZED (SELECT source, doc_id, c AS t FROM reasoned WHERE reason = 'kept'), clean AS MATERIALIZED (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY nfc_normalize(t) ORDER BY source, doc_id) = 1)"
# xxHash64 of a text with seed 0, in 128-bit integers modulo 2^64; fixed values: its primes.
_M, _P1, _P2, _P3, _P4, _P5 = (f"{n}::UHUGEINT" for n in (1 << 64, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_MUL = lambda a, b: f"((({a}) * ({b})) % {_M})"
_ADD = lambda a, b: f"((({a}) + ({b})) % {_M})"
_ROTL = lambda x, r: f"((({x}) * {1 << r}::UHUGEINT) % {_M} + ({x}) // {1 << (64 - r)}::UHUGEINT)"
# Terms are named by list elements, so that each is computed once.
_LET = lambda name, value, then: f"list_transform([{value}], lambda {name}: {then})[1]"
_ROUND = lambda acc, lane: _LET("rx", _ADD(acc, _MUL(lane, _P2)), _MUL(_ROTL("rx", 31), _P1))
_STEP = lambda h, r, by, plus: _LET("sx", h, f"(({_MUL(_ROTL('sx', r), by)} + {plus}) % {_M})")
_SHIFTED = lambda h, r: _LET("vx", h, f"xor(vx, vx // {1 << r}::UHUGEINT)")
_LANE = lambda off, n: f"list_reduce(list_transform(range(0, {n}), lambda j: b[{off} + j + 1] * powers[j + 1]), lambda lx, ly: lx + ly)"
_STRIPES = lambda k, start: f"list_reduce(list_transform(range(0, n // 32), lambda q: {_LANE(f'32 * q + {8 * k}', 8)}), lambda acc, lane: {_ROUND('acc', 'lane')}, {start})"
_MERGED = lambda h, v: _LET("mh", h, f"((({_MUL(f'xor(mh, {_ROUND("0::UHUGEINT", v)})', _P1)}) + {_P4}) % {_M})")
XXH64 = lambda of, key, keep: f"""
hx AS (SELECT {keep}, hex(encode({key})) AS hx FROM {of}), bytes AS (SELECT {keep}, len(hx) // 2 AS n, list_transform(range(0, len(hx) // 2), lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::UHUGEINT) AS b, list_transform(range(0, 8), lambda i: (1::UHUGEINT << (8 * i)::UHUGEINT)) AS powers FROM hx),
accs AS (SELECT *, {_STRIPES(0, _ADD(_P1, _P2))} AS v1, {_STRIPES(1, _P2)} AS v2, {_STRIPES(2, "0::UHUGEINT")} AS v3, {_STRIPES(3, f"({_M} - {_P1})")} AS v4 FROM bytes),
begun AS (SELECT *, CASE WHEN n < 32 THEN {_P5} ELSE {_MERGED(_MERGED(_MERGED(_MERGED(_ADD(_ADD(_ROTL("v1", 1), _ROTL("v2", 7)), _ADD(_ROTL("v3", 12), _ROTL("v4", 18))), "v1"), "v2"), "v3"), "v4")} END AS h0, n // 32 * 32 AS o0 FROM accs),
eights AS (SELECT *, list_reduce(list_transform(range(0, (n - o0) // 8), lambda q: {_LANE("o0 + 8 * q", 8)}), lambda acc, lane: {_STEP(f"xor(acc, {_ROUND('0::UHUGEINT', 'lane')})", 27, _P1, _P4)}, {_ADD("h0", "n::UHUGEINT")}) AS h1, o0 + (n - o0) // 8 * 8 AS o8 FROM begun),
fours AS (SELECT *, CASE WHEN n - o8 >= 4 THEN {_STEP(f"xor(h1, {_MUL(_LANE('o8', 4), _P1)})", 23, _P2, _P3)} ELSE h1 END AS h2, o8 + (n - o8) // 4 * 4 AS o4 FROM eights),
ones AS (SELECT *, list_reduce(list_transform(range(o4, n), lambda q: b[q + 1]), lambda acc, x: {_STEP(f"xor(acc, {_MUL('x', _P5)})", 11, _P1, "0::UHUGEINT")}, h2) AS h3 FROM fours),
hashed AS (SELECT {keep}, {_SHIFTED(_MUL(_SHIFTED(_MUL(_SHIFTED("h3", 33), _P2), 29), _P3), 32)} AS h FROM ones)
"""  # noqa: E731
# Naive Bayes on the trigrams of lower-case text.
GRAMS = lambda x: f"list_transform(range(1, greatest(1, len({x}) - 2) + 1), lambda i: array_to_string({x}[i:i + 2], ''))"
CHARS = lambda x: f"regexp_extract_all(' ' || regexp_replace({STRIP(f'lower({x})')}, '{WS}+', ' ', 'g') || ' ', '(?s).')"
IDENTIFIED = f"""
sampled AS (SELECT lang, unnest({GRAMS('c')}) AS gram FROM (SELECT lang, {CHARS("coalesce(text, '')")} AS c FROM lang_samples WHERE lang IS NOT NULL)),
counts AS (SELECT gram, lang, count(*) AS n FROM sampled GROUP BY ALL), known AS (SELECT gram, l.lang FROM (SELECT DISTINCT gram FROM counts), (SELECT DISTINCT lang FROM counts) l),
smooth AS (SELECT k.gram, k.lang, coalesce(n, 0) + 1 AS n FROM known k LEFT JOIN counts c ON c.gram = k.gram AND c.lang = k.lang),
model AS MATERIALIZED (SELECT gram, lang, ln(n / sum(n) OVER (PARTITION BY lang)) AS logp FROM smooth),
found AS (SELECT doc_id, gram, count(*) AS n FROM (SELECT doc_id, unnest({GRAMS('c')}) AS gram FROM (SELECT doc_id, {CHARS('t')} AS c FROM docs)) GROUP BY ALL),
scores AS (SELECT doc_id, m.lang, -sum(n * logp) / sum(n) AS cost FROM found f JOIN model m ON m.gram = f.gram GROUP BY ALL),
chances AS (SELECT doc_id, lang, 1 / sum(exp(min_cost - cost)) OVER (PARTITION BY doc_id) AS prob, cost FROM (SELECT *, min(cost) OVER (PARTITION BY doc_id) AS min_cost FROM scores)),
identified AS MATERIALIZED (SELECT doc_id, lang, prob FROM chances QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cost, lang) = 1)
"""
FUNNEL = f"SELECT source, count(*) AS docs_input, count(*) AS docs_after_language, count(*) FILTER (reason <> 'script') AS docs_after_script, count(*) FILTER (reason = 'kept') AS docs_after_quality, sum(len({WORDS('t')}))::BIGINT AS words_input, coalesce(sum(n_words) FILTER (reason = 'kept'), 0)::BIGINT AS words_after_quality FROM reasoned GROUP BY source"
TWEET_LINES = "numbered AS (SELECT row_number() OVER (ORDER BY tweet_id) - 1 AS n, regexp_replace(coalesce(tweet, ''), '[\\r\\n]', ' ', 'g') AS v FROM tweets)"

SQL = {
    "corpus_size": f"WITH {DOCS} SELECT source, count(*) AS docs, sum(strlen(t))::BIGINT AS bytes, sum(len({WORDS('t')}))::BIGINT AS words FROM docs GROUP BY ROLLUP (source)",
    "text_measures": f"WITH {DOCS} SELECT doc_id, len({WORDS('t')})::INT AS n_words, round(len(regexp_extract_all(t, '{T.SYMBOL_CLASS}')) / greatest(1, len({WORDS('t')})), 9) AS symbol_ratio, round(CASE WHEN len(regexp_extract_all(t, '{NWS}')) = 0 THEN 0.0 ELSE len(regexp_extract_all(t, '[\\x{{900}}-\\x{{97f}}]')) / len(regexp_extract_all(t, '{NWS}')) END, 9) AS script_ratio, len({LINES('t')})::INT AS n_lines FROM docs",
    "repeated_lines": f"WITH {DOCS}, l AS (SELECT doc_id, list_filter(list_transform({LINES('t')}, lambda x: {STRIP('x')}), lambda x: x <> '') AS sl FROM docs) SELECT doc_id, round(CASE WHEN len(sl) < 2 THEN 0.0 ELSE (len(sl) - len(list_filter(map_values(list_histogram(sl)), lambda n: n = 1))) / len(sl) END, 9) AS repeated_ratio FROM l",
    "frame_lines": f"WITH {DOCS}, {MEASURES} SELECT doc_id, round(frame_ratio, 9) AS frame_ratio, clean_text FROM cleaned",
    "quality_reasons": f"WITH {DOCS}, {MEASURES} SELECT doc_id, n_words::INT AS n_words, reason FROM reasoned",
    "clean_funnel": f"WITH {DOCS}, {MEASURES}, f AS (SELECT *, coalesce(lang = 'mr', false) AS l FROM reasoned) SELECT source, count(*) AS docs_input, count(*) FILTER (l) AS docs_after_language, count(*) FILTER (l AND reason <> 'script') AS docs_after_script, count(*) FILTER (l AND reason = 'kept') AS docs_after_quality, sum(len({WORDS('t')}))::BIGINT AS words_input, coalesce(sum(n_words) FILTER (l AND reason = 'kept'), 0)::BIGINT AS words_after_quality FROM f GROUP BY source",
    "exact_dedup": f"WITH {DOCS}, {FIRSTS} SELECT doc_id FROM firsts",
    "shingle_counts": f"WITH {DOCS}, {SHINGLES % 'docs'} SELECT doc_id, len(s)::INT AS n_shingles FROM shingled",
    "similar_pairs": f"""WITH {DOCS}, firsts AS (SELECT * FROM docs QUALIFY row_number() OVER (PARTITION BY nfc_normalize(t) ORDER BY doc_id) = 1), {SHINGLES % 'firsts'},
      sized AS MATERIALIZED (SELECT doc_id, len(s) AS n, s FROM shingled), e AS MATERIALIZED (SELECT doc_id, n, unnest(s) AS g FROM sized),
      common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2)
      SELECT a, b, round(c / (na + nb - c), 9) AS similarity FROM common WHERE c / (na + nb - c) >= 0.8 - 1e-12""",
    "redacted": f"""WITH {DOCS}, a AS (SELECT doc_id, t, {TWICE('t', redaction.AADHAAR, '[AADHAAR]')} AS ta FROM docs), p AS (SELECT *, {TWICE('ta', redaction.PHONE, '[PHONE]')} AS tp FROM a),
      e AS (SELECT *, regexp_replace(tp, '{redaction.EMAIL}', '[EMAIL]', 'g') AS te FROM p)
      SELECT doc_id, te AS redacted, ((length(ta) - length(replace(ta, '[AADHAAR]', ''))) / 9 - (length(t) - length(replace(t, '[AADHAAR]', ''))) / 9)::INT AS n_aadhaar, ((length(tp) - length(replace(tp, '[PHONE]', ''))) / 7 - (length(ta) - length(replace(ta, '[PHONE]', ''))) / 7)::INT AS n_phone, len(regexp_extract_all(tp, '{redaction.EMAIL}'))::INT AS n_email FROM e""",
    "nfc_text": f"WITH {DOCS} SELECT doc_id, nfc_normalize(t) AS nfc_text FROM docs",
    "recovered_documents": f"""WITH {DOCS}, p AS (SELECT doc_id::VARCHAR AS stem, list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda x: {STRIP('x')}), lambda x: x <> '') AS ps, list_filter(list_transform({LINES('t')}, lambda x: {STRIP('x')}), lambda x: x <> '') AS ls FROM docs),
      d AS (SELECT stem, CASE WHEN len(ps) >= 2 THEN ps WHEN len(ls) > 0 THEN list_transform(range(0, len(ls), 50), lambda i: array_to_string(ls[i + 1:i + 50], chr(10))) ELSE [] END AS ds FROM p), f AS (SELECT *, coalesce(sum(len(ds)) OVER (ORDER BY stem ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d), n AS (SELECT stem, start + unnest(range(0, len(ds))) AS i, unnest(ds) AS text FROM f)
      SELECT stem || '-' || i AS id, stem, text FROM n""",
    "first_per_source": "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10",
    "ingest_summary": "SELECT source, stage, count(*) AS records, count(DISTINCT doc_id) AS docs, sum(n_bytes)::BIGINT AS bytes, sum(proxy_tokens)::BIGINT AS proxy_tokens FROM shard_log GROUP BY ALL",
    "holdout": f"SELECT doc_id FROM documents WHERE {BUCKET(KEY, 1000)} < 10",
    "splits": f"SELECT doc_id, {SPLIT} AS split FROM documents",
    "upweighted": f"WITH {DOCS}, s AS (SELECT *, {SPLIT} AS split, unnest(range(0, CASE WHEN source = 'wikipedia' AND ({SPLIT}) = 'train' THEN 2 ELSE 1 END)) AS copy FROM docs) SELECT source, split, count(*) AS docs, sum(len({WORDS('t')}))::BIGINT AS words FROM s GROUP BY ALL",
    "hash_sample": f"""SELECT doc_id FROM documents WHERE {BUCKET("'sample:' || " + KEY, 1000000)} < 300000""",
    "document_offsets": f'WITH {DOCS}, {STREAM} SELECT split, doc_id, copy::INT AS copy, start::BIGINT AS start, (start + n)::BIGINT AS "end" FROM streams',
    "token_blocks": f"""WITH {DOCS}, {STREAM}, {TOKENS}, full_blocks AS (SELECT split, (max(pos) // 256) AS blocks FROM toks GROUP BY split),
      xs AS (SELECT split, pos // 256 AS block, md5(string_agg(id::VARCHAR, ',' ORDER BY pos)) AS x_md5 FROM toks GROUP BY ALL), ys AS (SELECT split, (pos - 1) // 256 AS block, md5(string_agg(id::VARCHAR, ',' ORDER BY pos)) AS y_md5 FROM toks WHERE pos > 0 GROUP BY ALL)
      SELECT x.split, x.block::BIGINT AS block, x_md5, y_md5 FROM xs x JOIN ys y ON x.split = y.split AND x.block = y.block JOIN full_blocks f ON f.split = x.split WHERE x.block < f.blocks""",
    "split_counts": f"WITH {DOCS}, {STREAM} SELECT split, count(*) AS docs, sum(n)::BIGINT AS tokens FROM copies GROUP BY split",
    "vocabulary_counts": f"WITH {DOCS}, w AS (SELECT unnest({WORDS('t')}) AS word FROM docs) SELECT word, count(*) AS n FROM w GROUP BY word",
    "flat_turns": f"WITH {TURNS} SELECT example, source, instruction, response FROM flat",
    "instruction_splits": f"""WITH {TURNS}, s AS (SELECT source, CASE WHEN {BUCKET("source || ':' || instruction", 1000)} < 5 AND source <> 'manual' THEN 'val' ELSE 'train' END AS split FROM flat) SELECT source, split, count(*) AS examples FROM s GROUP BY ALL""",
    "chat_texts": f"WITH {TURNS} SELECT example, {CHAT} || response || '<|endoftext|>' AS chat FROM flat",
    "masked_examples": f"WITH {TURNS}, {EXAMPLES} SELECT example, array_to_string(ids, ',') AS ids, array_to_string(mask, ',') AS mask FROM examples",
    "padded_batches": f"""WITH {TURNS}, {EXAMPLES}, b AS (SELECT *, ('0x' || substr(md5(example), 1, 4))::BIGINT % 25 AS batch_id FROM examples), m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS longest FROM b)
      SELECT example, batch_id, array_to_string(list_concat(ids[:-2], list_transform(range(0, longest - len(ids)), lambda i: 1)), ',') AS x,
      array_to_string(list_concat(list_transform(range(2, len(ids) + 1), lambda i: CASE WHEN mask[i] = 1 THEN ids[i] ELSE -1 END), list_transform(range(0, longest - len(ids)), lambda i: -1)), ',') AS y FROM m""",
    "fertility": f"WITH {DOCS}, c AS (SELECT sum(length(t)) AS ch, sum(strlen(t)) AS octets, sum(len({WORDS('t')})) AS w FROM docs), u AS (SELECT 'characters' AS tokenizer, ch AS tokens, w FROM c UNION ALL SELECT 'bytes', octets, w FROM c UNION ALL SELECT 'words', w, w FROM c) SELECT tokenizer, tokens::BIGINT AS tokens, w::BIGINT AS words, round(tokens / greatest(1, w), 3) AS fertility FROM u",
    "perplexity": "SELECT event_type AS split, round(sum(value / 100 * (user_id % 7 + 1)) / sum(user_id % 7 + 1), 6) AS loss, round(exp(sum(value / 100 * (user_id % 7 + 1)) / sum(user_id % 7 + 1)), 5) AS perplexity, sum(user_id % 7 + 1)::BIGINT AS tokens FROM events GROUP BY event_type",
    "mean_losses": "SELECT event_type, round(avg(value), 6) AS mean_loss FROM events GROUP BY event_type",
    "clean_tweets": f"WITH {TWEETS} SELECT tweet_id, tweet, label FROM tw",
    "exemplars": f"WITH {TWEETS}, {SHOTS} SELECT tweet_id, label FROM shots",
    "few_shot_prompt": f"WITH {TWEETS}, {SHOTS} SELECT string_agg(tweet || chr(10) || label, chr(10) || chr(10) ORDER BY md5('order:' || tweet_id), tweet) AS prompt FROM shots",
    "label_argmax": f"WITH {TWEETS}, {PREDICTED} SELECT tweet_id, predicted::INT AS predicted, score FROM predicted",
    "accuracy": f"WITH {TWEETS}, {PREDICTED} SELECT count(*) FILTER (predicted = label) AS correct, count(*) AS n, round(count(*) FILTER (predicted = label) / count(*), 9) AS accuracy, round(1.0 / count(DISTINCT label), 9) AS baseline FROM predicted JOIN tw USING (tweet_id)",
    "top_k": f"WITH {LOGITS}, {TOPK} SELECT ctx, token FROM topk",
    "softmax": f"WITH {LOGITS}, {SOFT('logits')} SELECT ctx, token, round(p, 9) AS p FROM soft",
    "top_p": f"WITH {LOGITS}, {TOPK}, {SOFT('topk')}, s AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY ctx ORDER BY logit DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM soft) SELECT ctx, token FROM s WHERE before <= 0.5",
    "learning_rates": "SELECT step, round(CASE WHEN step < 15 THEN 6e-4 * (step + 1) / 15 WHEN step >= 500 THEN 6e-5 ELSE 6e-5 + 0.5 * (6e-4 - 6e-5) * (1 + cos(pi() * (step - 15) / 485)) END, 12) AS lr FROM range(501) AS r(step)",
    "checkpoints": "SELECT user_id, event_id AS step FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3",
    "fuzzy_dedup": f"WITH RECURSIVE {DOCS}, {FIRSTS}, {WALK('firsts')} SELECT doc_id FROM left_over",
    "capped_fuzzy_dedup": f"WITH RECURSIVE {DOCS}, {FIRSTS}, {WALK('firsts')}, nth AS (SELECT r FROM left_over ORDER BY r LIMIT 1 OFFSET 99) SELECT doc_id FROM left_over UNION SELECT doc_id FROM place WHERE r > (SELECT r FROM nth)",
    "dedup_counters": f"""WITH RECURSIVE {DOCS}, {FIRSTS}, {WALK('firsts')}, i AS (SELECT source, count(*) AS n FROM docs GROUP BY source), f AS (SELECT source, count(*) AS n FROM firsts GROUP BY source), l AS (SELECT source, count(*) AS n FROM left_over GROUP BY source),
      per AS (SELECT i.source, i.n AS docs_input, coalesce(f.n, 0) AS after_exact, coalesce(l.n, 0) AS final FROM i LEFT JOIN f ON f.source IS NOT DISTINCT FROM i.source LEFT JOIN l ON l.source IS NOT DISTINCT FROM i.source),
      rows_of AS (SELECT *, false AS total FROM per UNION ALL SELECT NULL, sum(docs_input)::BIGINT, sum(after_exact)::BIGINT, sum(final)::BIGINT, true FROM per)
      SELECT source, total, docs_input, docs_input - after_exact AS dropped_exact, after_exact, after_exact - final AS dropped_fuzzy, final FROM rows_of""",
    "unfuzzy_pipeline": f"WITH {DOCS}, {MEASURES}, {KEPT}, {REDACTED('clean')} SELECT doc_id, md5(te) AS text_md5, n_aadhaar AS aadhaar, n_phone AS phone, n_email AS email FROM red",
    "clean_statistics": f"""WITH {DOCS}, {MEASURES}, {KEPT}, {REDACTED('clean')}, f AS ({FUNNEL}), l AS (SELECT source, count(*) AS final, sum(n_aadhaar)::BIGINT AS aadhaar, sum(n_phone)::BIGINT AS phone, sum(n_email)::BIGINT AS email FROM red GROUP BY source),
      per AS (SELECT f.*, coalesce(final, 0) AS final, coalesce(aadhaar, 0) AS aadhaar, coalesce(phone, 0) AS phone, coalesce(email, 0) AS email FROM f LEFT JOIN l ON l.source IS NOT DISTINCT FROM f.source)
      SELECT *, false AS total FROM per UNION ALL SELECT NULL, {", ".join(f"sum({c})::BIGINT" for c in ("docs_input", "docs_after_language", "docs_after_script", "docs_after_quality", "words_input", "words_after_quality", "final", "aadhaar", "phone", "email"))}, true FROM per""",
    "languages": f"WITH {DOCS}, {IDENTIFIED} SELECT doc_id, lang, round(prob, 6) AS prob FROM identified",
    "clean_pipeline": f"""WITH RECURSIVE {DOCS}, {IDENTIFIED}, {MEASURES}, kept AS MATERIALIZED (SELECT source, doc_id, c AS t FROM reasoned JOIN identified USING (doc_id) WHERE reason = 'kept' AND identified.lang = 'mr' AND prob >= 0.4),
      clean AS MATERIALIZED (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY nfc_normalize(t) ORDER BY source, doc_id) = 1), {WALK('clean')}, final AS (SELECT source, doc_id, t FROM clean WHERE doc_id IN (SELECT doc_id FROM left_over)), {REDACTED('final')}
      SELECT source, doc_id, te AS text FROM red""",
    "drawn_tokens": f"""WITH {LOGITS}, {SOFT('logits')}, s AS (SELECT *, sum(p) OVER (PARTITION BY ctx ORDER BY logit DESC, token) AS run, row_number() OVER (PARTITION BY ctx ORDER BY logit DESC, token) AS place, ('0x' || substr(md5('1:' || ctx), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM soft)
      SELECT ctx, coalesce(arg_min(token, place) FILTER (run > u), arg_max(token, place))::INT AS token FROM s GROUP BY ctx""",
    "shard_round_trip": "SELECT row_number() OVER (ORDER BY source, doc_id) - 1 AS place, doc_id, id, title, md5(coalesce(text, '')) AS text_md5 FROM documents WHERE source IS NOT NULL AND id IS NOT NULL",
    "ordered_shards": "SELECT row_number() OVER (ORDER BY source NULLS FIRST, doc_id) - 1 AS place, doc_id FROM documents",
    "by_source": "SELECT source, count(*) AS docs, min(doc_id) AS least_id FROM documents GROUP BY source",
    "sources_found": "SELECT (row_number() OVER (ORDER BY source) - 1)::INT AS place, source FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)",
    "parquet_documents": "SELECT doc_id::VARCHAR AS id, 'sangraha' AS source, coalesce(title, '') AS title, length(coalesce(text, ''))::INT AS n_chars FROM documents",
    "numbered_documents": "SELECT (row_number() OVER () - 1)::VARCHAR AS id, 'indiccorp' AS source, md5(coalesce(text, '')) AS text_md5 FROM documents",
    "text_documents": f"WITH {TWEET_LINES} SELECT n::VARCHAR AS id, 'tweets' AS source, v AS text FROM numbered WHERE regexp_matches(v, '{NWS}')",
    "text_lines": f"WITH {TWEET_LINES} SELECT {STRIP('v')} AS line FROM numbered WHERE n < 50 AND regexp_matches(v, '{NWS}')",
    "tweet_csv": f"WITH {TWEETS} SELECT tweet, label, count(*) AS n FROM tw GROUP BY ALL",
    "manual_pairs": f"""SELECT {STRIP("coalesce(instruction, '')")} AS instruction, {STRIP("coalesce(response, '')")} AS response FROM instruct_pairs""",
    "isolated_sources": """SELECT 'documents' AS "table", true AS "read", count(*) AS n FROM documents UNION ALL SELECT 'instruct_pairs', true, count(*) FROM instruct_pairs UNION ALL SELECT * FROM (VALUES ('tweets', false, NULL), ('missing', false, NULL))""",
    "pending_documents": "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM shard_log l WHERE l.stage = 'prepare' AND l.doc_id = d.doc_id)",
    "streamed_documents": f"WITH {DOCS} SELECT DISTINCT md5(nfc_normalize(t)) AS text_md5 FROM docs",
    "flat_files": f"WITH {DOCS}, {STREAM}, {TOKENS}, of_docs AS (SELECT split, count(*) AS docs, sum(start)::BIGINT AS sum_starts FROM streams GROUP BY split), of_ids AS (SELECT split, count(*) AS tokens, sum(id)::BIGINT AS sum_ids, count(*) FILTER (id = 1) AS ends FROM toks GROUP BY split) SELECT s.split, coalesce(docs, 0) AS docs, coalesce(tokens, 0) AS tokens, coalesce(sum_ids, 0) AS sum_ids, coalesce(ends, 0) AS ends, coalesce(sum_starts, 0) AS sum_starts FROM (VALUES ('train'), ('val'), ('wiki_val')) s(split) LEFT JOIN of_docs d ON d.split = s.split LEFT JOIN of_ids i ON i.split = s.split",
    "corpus_meta": f"WITH {DOCS}, {STREAM} SELECT split, count(*) AS docs, sum(n)::BIGINT AS tokens FROM copies GROUP BY split",
    "random_windows": f"""WITH {DOCS}, {STREAM}, {TOKENS}, room AS (SELECT max(pos) + 1 - 257 AS r FROM toks WHERE split = 'train'), w AS (SELECT k AS "window", ('0x' || substr(md5('1:' || k), 1, 15))::BIGINT % r AS start FROM range(200) AS g(k), room), each_pos AS (SELECT "window", start, start + unnest(range(0, 257)) AS pos FROM w)
      SELECT "window", e.start::BIGINT AS start, md5(string_agg(id::VARCHAR, ',' ORDER BY e.pos) FILTER (e.pos < e.start + 256)) AS x_md5, md5(string_agg(id::VARCHAR, ',' ORDER BY e.pos) FILTER (e.pos > e.start)) AS y_md5 FROM each_pos e JOIN toks t ON t.split = 'train' AND t.pos = e.pos GROUP BY "window", e.start""",
    "vocabulary_warning": "SELECT v::INT AS vocabulary, (SELECT sum(strlen(text)) FROM documents) // 10 < 100 * v AS too_little FROM (VALUES (100), (1000), (32000), (1000000)) AS x(v)",
    "covered_characters": f"WITH {DOCS}, c AS (SELECT unnest(regexp_extract_all(t, '(?s).')) AS c FROM docs), n AS (SELECT c, count(*) AS n FROM c GROUP BY c), r AS (SELECT c, sum(n) OVER (ORDER BY n DESC, c) - n AS before, sum(n) OVER () AS total FROM n) SELECT c AS character FROM r WHERE before < 0.9995::DOUBLE * total",
    "sized_sample": f"""SELECT doc_id FROM documents, (SELECT floor(least(1.0, 100000.0 / sum(strlen(text))) * 1000000)::BIGINT AS most FROM documents) WHERE {BUCKET("'sample:' || " + KEY, 1000000)} < most""",
    "turn_limit": "SELECT row_id FROM (SELECT row_id, sum(c) OVER (ORDER BY row_id) - c AS before FROM (SELECT row_id, len(list_filter(mar_deva, lambda t: len(t) = 2)) AS c FROM indic_turns) WHERE c > 0) WHERE before < 50",
    "united_sources": f"WITH {TURNS} SELECT 'turns' AS source, count(*) AS pairs, count(response) AS answered FROM flat UNION ALL SELECT 'manual', count(*), count(response) FROM instruct_pairs",
    "skipped_examples": f"WITH {TURNS}, {EXAMPLES} SELECT count(*) FILTER (len(p) + len(r) + 1 > 64) AS skipped, count(*) AS examples FROM ided",
    "epoch_batches": f"WITH {TURNS}, {EXAMPLES} SELECT example, (row_number() OVER (ORDER BY md5('1:0:' || example), example) - 1) // 32 AS batch_id FROM examples",
    "warm_softmax": f"WITH {LOGITS}, hot AS (SELECT ctx, token, exp(logit / 0.8 - max(logit / 0.8) OVER (PARTITION BY ctx)) AS e FROM logits), cold AS (SELECT ctx, token, exp(logit / 1e-6 - max(logit / 1e-6) OVER (PARTITION BY ctx)) AS e FROM logits) SELECT ctx, token, 0.8::DOUBLE AS t, round(e / sum(e) OVER (PARTITION BY ctx), 9) AS p FROM hot UNION ALL SELECT ctx, token, 0::DOUBLE, round(e / sum(e) OVER (PARTITION BY ctx), 9) FROM cold",
    "last_tokens": f"WITH {DOCS} SELECT doc_id, array_to_string(list_transform({WORDS('t')}, lambda w: length(w))[-16:], ',') AS ids FROM docs",
    "stopped_texts": f"WITH {TURNS} SELECT example, {STRIP(f'{CHAT} || response')} AS text FROM flat",
    "utilisation": "SELECT event_id, round((6 * 22900000 + 12 * 8 * 6 * 64 * 1024)::DOUBLE * (value * 1000) / 61.73e12, 9) AS mfu FROM events WHERE value IS NOT NULL",
    "best_checkpoints": "SELECT user_id, event_id AS step, round(value, 6) AS val_loss FROM events WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) = 1",
    "seeded_head": f"WITH {TWEETS} SELECT tweet_id, label FROM tw WHERE split_name = 'test' ORDER BY md5('test:' || tweet_id), tweet_id LIMIT 300",
    "splits_xxh64": f"WITH {XXH64('documents', KEY, 'doc_id, source')} SELECT doc_id, CASE WHEN h % 1000000 < 5000 THEN 'val' WHEN source = 'wikipedia' AND h % 1000000 < 25000 THEN 'wiki_val' ELSE 'train' END AS split FROM hashed",
    "holdout_xxh64": f"WITH {XXH64('documents', KEY, 'doc_id')} SELECT doc_id FROM hashed WHERE h % 1000 < 10",
    "instruction_splits_xxh64": f"""WITH {TURNS}, {XXH64('flat', "source || ':' || instruction", 'example, source')} SELECT example, CASE WHEN h % 1000 < 5 AND source <> 'manual' THEN 'val' ELSE 'train' END AS split FROM hashed""",
    "identified_funnel": f"WITH {DOCS}, {IDENTIFIED}, {MEASURES}, f AS (SELECT r.*, coalesce(i.lang = 'mr' AND prob >= 0.4, false) AS l FROM reasoned r LEFT JOIN identified i ON i.doc_id = r.doc_id) SELECT source, count(*) AS docs_input, count(*) FILTER (l) AS docs_after_language, count(*) FILTER (l AND reason <> 'script') AS docs_after_script, count(*) FILTER (l AND reason = 'kept') AS docs_after_quality, sum(len({WORDS('t')}))::BIGINT AS words_input, coalesce(sum(n_words) FILTER (l AND reason = 'kept'), 0)::BIGINT AS words_after_quality FROM f GROUP BY source",
}
