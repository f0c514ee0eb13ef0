"""DuckDB SQL equivalent of each registered query (tables are pre-registered views).

Shared pieces are CTE strings; regex rules come from the same fixed-value
lists the Spark side uses. Doubles from ``exp``/``avg`` are rounded the same
way as in ``catalog``.
"""

from __future__ import annotations

from tagframe.operators import phrase_grammar as G
from tagframe.operators import entities as E
from tagframe.operators import subwords as SW
from tagframe.operators import tagging as T
from tagframe.sources import tables as TB


def _split(col: str) -> str:
    d = f"substr(md5(CAST({col} AS VARCHAR)), 1, 1)"
    v = ", ".join(f"'{x}'" for x in TB.VALID_DIGITS)
    t = ", ".join(f"'{x}'" for x in TB.TEST_DIGITS)
    return f"CASE WHEN {d} IN ({v}) THEN 'valid' WHEN {d} IN ({t}) THEN 'test' ELSE 'train' END"


def _case(pairs, col: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, '{p}') THEN {v}" for p, v in pairs) + " END"


_TOKEN_ENTITY = _case([(p, f"'{n}'") for n, _, p in E.TOKEN_RULES], "word")
_TOKEN_SCORE = _case([(p, f"CAST({s} AS DOUBLE)") for _, s, p in E.TOKEN_RULES], "word")
_PHRASE_LABEL = _case([(f"^({p})\\z", f"'{n}'") for n, p in E.PHRASE_RULES], "word")
_PHRASE = E.phrase_pattern()

LAB = f"lab AS (SELECT doc_id, quality AS label_binary, {_split('doc_id')} AS split FROM labels)"

STMT = ("stmt AS (SELECT d.doc_id, d.text, l.quality AS label_binary, "
        f"{_split('d.doc_id')} AS split FROM documents d JOIN labels l ON l.doc_id = d.doc_id)")

ENTS_A = f"""
tok AS (
  SELECT doc_id, unnest(string_split(text, ' ')) AS word,
         unnest(range(len(string_split(text, ' ')))) AS pos
  FROM documents),
tokr AS (
  SELECT doc_id, pos, length(word) AS len, {_TOKEN_ENTITY} AS entity, {_TOKEN_SCORE} AS score, word FROM tok),
tokw AS (
  SELECT *, CAST(COALESCE(SUM(len + 1) OVER (PARTITION BY doc_id ORDER BY pos
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start
  FROM tokr),
ents_a AS (
  SELECT doc_id, 'A' AS tagger, CAST(pos AS INTEGER) AS pos, entity, score, word, start,
         CAST(start + len AS INTEGER) AS "end"
  FROM tokw WHERE entity IS NOT NULL)"""

ENTS_B = f"""
ph AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '{_PHRASE}', 0)) AS word,
         unnest(range(len(regexp_extract_all(text, '{_PHRASE}', 0)))) AS pos
  FROM documents),
ents_b AS (
  SELECT doc_id, 'B' AS tagger, CAST(pos AS INTEGER) AS pos, {_PHRASE_LABEL} AS entity,
         CAST(NULL AS DOUBLE) AS score, word, CAST(NULL AS INTEGER) AS start, CAST(NULL AS INTEGER) AS "end"
  FROM ph)"""

def _uniform(seed: int, col: str = "doc_id") -> str:
    return (f"(CAST(CAST(('0x' || substr(md5(CAST({col} AS VARCHAR) || ':{seed}'), 1, 8)) AS BIGINT) AS DOUBLE) "
            "/ 4294967296.0::DOUBLE)")


def _run(name: str, seed0: int, seed1: int, shift: float) -> str:
    return (f"SELECT '{name}' AS run, doc_id, label_binary, {_uniform(seed0)} * 4.0::DOUBLE - 2.0::DOUBLE AS logit0, "
            f"{_uniform(seed1)} * 4.0::DOUBLE - 2.0::DOUBLE + {shift}::DOUBLE * (label_binary - 0.5::DOUBLE) AS logit1 FROM pbase")


PRED = f"""
pbase AS (SELECT doc_id, quality AS label_binary FROM labels),
plog AS ({" UNION ALL ".join(_run(*r) for r in TB.RUN_LOGITS)}),
pred AS (
  SELECT run, doc_id, label_binary, logit0, logit1,
         CASE WHEN logit1 > logit0 THEN 1 ELSE 0 END AS prediction,
         exp(logit1 - greatest(logit0, logit1)) /
           (exp(logit0 - greatest(logit0, logit1)) + exp(logit1 - greatest(logit0, logit1))) AS confidence
  FROM plog)"""


def _insert(spans_cte: str) -> str:
    """Tag insertion over a CTE ``spans(doc_id, start, "end", entity)`` of disjoint spans."""
    return f"""
pieces AS (
  SELECT doc_id, start, "end", entity,
         COALESCE(lag("end") OVER (PARTITION BY doc_id ORDER BY start, "end", entity), 0) AS pe
  FROM {spans_cte}),
agg AS (
  SELECT p.doc_id,
         string_agg(substring(d.text, pe + 1, start - pe) || '<' || entity || '>' ||
                    substring(d.text, start + 1, "end" - start) || '</' || entity || '>', ''
                    ORDER BY start, "end", entity) AS body,
         max("end") AS last_end, count(*) AS n
  FROM pieces p JOIN documents d ON d.doc_id = p.doc_id GROUP BY p.doc_id)
SELECT d.doc_id, COALESCE(a.body, '') || substring(d.text, COALESCE(a.last_end, 0) + 1) AS tagged_text,
       CAST(COALESCE(a.n, 0) AS INTEGER) AS n_spans
FROM documents d LEFT JOIN agg a ON a.doc_id = d.doc_id"""


VALID_A = """
va AS (SELECT doc_id, pos, start, "end", entity FROM ents_a
       WHERE entity IS NOT NULL AND entity <> '' AND start IS NOT NULL AND "end" IS NOT NULL)"""


def _disjoint(src: str, name: str) -> str:
    """Spans that do not start before the end of any span before them."""
    return f"""
{name} AS (
  SELECT doc_id, pos, start, "end", entity FROM (
    SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start, pos
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end FROM {src})
  WHERE prev_end IS NULL OR start >= prev_end)"""


def _merge(src: str, name: str = "merged") -> str:
    return f"""
m1 AS (
  SELECT *, CASE WHEN lag("end") OVER w IS NULL OR lag(entity) OVER w <> entity
                   OR start > lag("end") OVER w + 1 THEN 1 ELSE 0 END AS brk
  FROM {src} WINDOW w AS (PARTITION BY doc_id ORDER BY start, pos)),
m2 AS (
  SELECT *, SUM(brk) OVER (PARTITION BY doc_id ORDER BY start, pos
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m1),
{name} AS (
  SELECT doc_id, CAST(island - 1 AS INTEGER) AS pos, CAST(min(start) AS INTEGER) AS start,
         CAST(arg_max("end", CAST(start AS BIGINT) * 4294967296 + pos) AS INTEGER) AS "end",
         min(entity) AS entity, count(*) AS n_merged
  FROM m2 GROUP BY doc_id, island)"""


SPANS_N5 = """
n1 AS (
  SELECT *, CASE WHEN lag(pos) OVER w IS NULL OR lag(pos) OVER w <> pos - 1
                   OR lag(entity) OVER w <> entity THEN 1 ELSE 0 END AS brk
  FROM ents_a WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
n2 AS (SELECT *, SUM(brk) OVER (PARTITION BY doc_id ORDER BY pos
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM n1),
spans5 AS (
  SELECT doc_id, min(pos) AS pos, min(entity) AS entity, round(avg(score), 6) AS score,
         string_agg(word, ' ' ORDER BY pos) AS word, min(start) AS start, max("end") AS "end",
         count(*) AS n_tokens
  FROM n2 GROUP BY doc_id, island)"""

PIECES = f"""
wp AS (
  SELECT doc_id, pos, entity, word AS w FROM ents_a),
pieces0 AS (
  SELECT doc_id, pos, 0 AS piece_no, CASE WHEN length(w) > {E.PIECE_LEN} THEN substring(w, 1, {E.PIECE_LEN}) ELSE w END AS word, entity FROM wp
  UNION ALL
  SELECT doc_id, pos, 1 AS piece_no, '{E.WORDPIECE_MARK}' || substring(w, {E.PIECE_LEN + 1}) AS word, entity
  FROM wp WHERE length(w) > {E.PIECE_LEN}),
pisl AS (
  SELECT *, SUM(CASE WHEN starts_with(word, '{E.WORDPIECE_MARK}') THEN 0 ELSE 1 END)
              OVER (PARTITION BY doc_id ORDER BY pos, piece_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
  FROM pieces0)"""


def _fold_lists(src: str) -> str:
    return f"""
el AS (SELECT doc_id, list({{'pos': pos, 'word': word, 'entity': entity}} ORDER BY pos) AS el FROM {src} GROUP BY doc_id)"""


SPAN_LIST_TYPE = 'STRUCT(start INTEGER, "end" INTEGER, entity VARCHAR)[]'

CURSOR = f"""
cj AS (SELECT d.doc_id, d.text, el.el FROM documents d JOIN el ON el.doc_id = d.doc_id),
cf AS (
  SELECT doc_id, list_reduce(el, lambda acc, x:
     CASE WHEN x.word IS NOT NULL AND x.word <> '' AND x.entity IS NOT NULL AND x.entity <> ''
               AND strpos(substring(text, acc.cursor + 1), x.word) > 0
          THEN {{'cursor': CAST(acc.cursor + strpos(substring(text, acc.cursor + 1), x.word) - 1 + length(x.word) AS INTEGER),
                 'spans': list_append(acc.spans, {{'start': CAST(acc.cursor + strpos(substring(text, acc.cursor + 1), x.word) - 1 AS INTEGER),
                                                   'end': CAST(acc.cursor + strpos(substring(text, acc.cursor + 1), x.word) - 1 + length(x.word) AS INTEGER),
                                                   'entity': x.entity}})}}
          ELSE acc END,
     {{'cursor': CAST(0 AS INTEGER), 'spans': CAST([] AS {SPAN_LIST_TYPE})}}) AS st
  FROM cj),
cspans AS (
  SELECT doc_id, CAST(generate_subscripts(st.spans, 1) - 1 AS INTEGER) AS pos, unnest(st.spans) AS s FROM cf),
cursor_spans AS (SELECT doc_id, pos, s.start AS start, s."end" AS "end", s.entity AS entity FROM cspans)"""

# U+0130 lower-cases to two characters; a case-insensitive match treats it as i.
OFFSETS = f"""
oj AS (SELECT d.doc_id, lower(replace(d.text, 'İ', 'i')) AS hay, el.el FROM documents d JOIN el ON el.doc_id = d.doc_id),
of AS (
  SELECT doc_id, list_reduce(el, lambda acc, x:
     CASE WHEN x.word IS NOT NULL AND x.word <> '' AND x.entity IS NOT NULL AND x.entity <> ''
               AND strpos(hay, lower(x.word)) > 0
               AND NOT list_bool_or(list_append(list_transform(acc, lambda y:
                     y.start < strpos(hay, lower(x.word)) - 1 + length(x.word)
                     AND strpos(hay, lower(x.word)) - 1 < y."end"), false))
          THEN list_append(acc, {{'start': CAST(strpos(hay, lower(x.word)) - 1 AS INTEGER),
                                 'end': CAST(strpos(hay, lower(x.word)) - 1 + length(x.word) AS INTEGER),
                                 'entity': lower(x.entity)}})
          ELSE acc END,
     CAST([] AS {SPAN_LIST_TYPE})) AS found
  FROM oj),
ospans AS (
  SELECT doc_id, CAST(generate_subscripts(found, 1) - 1 AS INTEGER) AS pos, unnest(found) AS s FROM of),
offsets AS (SELECT doc_id, pos, s.start AS start, s."end" AS "end", s.entity AS entity FROM ospans)"""


def _display(col: str) -> str:
    return (f"CASE WHEN strpos({col}, '''') > 0 AND strpos({col}, '\"') = 0 THEN '\"' || {col} || '\"' "
            f"WHEN strpos({col}, '''') > 0 THEN '''' || replace({col}, '''', '\\''') || '''' "
            f"ELSE '''' || {col} || '''' END")


METRICS_SQL = """
oc AS (
  SELECT run, CAST(sum(CASE WHEN label_binary = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
         CAST(sum(CASE WHEN label_binary = 0 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
         CAST(sum(CASE WHEN label_binary = 1 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
         CAST(sum(CASE WHEN label_binary = 0 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn
  FROM pred GROUP BY run),
bm AS (
  SELECT run, tp, fp, fn, tn,
    round(COALESCE((tp + tn)::DOUBLE / NULLIF(tp + fp + fn + tn, 0), 0.0), 9) AS accuracy,
    round(COALESCE(tp::DOUBLE / NULLIF(tp + fp, 0), 0.0), 9) AS precision,
    round(COALESCE(tp::DOUBLE / NULLIF(tp + fn, 0), 0.0), 9) AS recall,
    round(COALESCE(2.0 * tp::DOUBLE / NULLIF(2 * tp + fp + fn, 0), 0.0), 9) AS f1
  FROM oc)"""

WEIGHTED_SQL = """
SELECT run,
  round(COALESCE((COALESCE(tp / NULLIF(tp + fp, 0), 0) * (tp + fn) + COALESCE(tn / NULLIF(tn + fn, 0), 0) * (tn + fp)) / NULLIF(n, 0), 0), 9) AS w_precision,
  round(COALESCE((COALESCE(tp / NULLIF(tp + fn, 0), 0) * (tp + fn) + COALESCE(tn / NULLIF(tn + fp, 0), 0) * (tn + fp)) / NULLIF(n, 0), 0), 9) AS w_recall,
  round(COALESCE((COALESCE(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0) * (tp + fn) + COALESCE(2 * tn / NULLIF(2 * tn + fn + fp, 0), 0) * (tn + fp)) / NULLIF(n, 0), 0), 9) AS w_f1,
  round(COALESCE((tp + tn) / NULLIF(n, 0), 0), 9) AS accuracy
FROM (SELECT run, tp::DOUBLE tp, fp::DOUBLE fp, fn::DOUBLE fn, tn::DOUBLE tn, (tp + fp + fn + tn)::DOUBLE AS n FROM oc)"""


def _knn(src: str, cols, name: str, k: int = 10) -> str:
    """All pairs of distinct vectors: CTEs ending in ``knn_<name>(doc_id, label_binary, prediction)``; needs ``lab`` and ``src``."""
    fsel = ", ".join(f'CAST(COALESCE(c."{v}", 0) AS BIGINT) AS "{v}"' for v in cols)
    piv = ", ".join(f'sum(CASE WHEN entity = \'{v}\' THEN 1 ELSE 0 END) AS "{v}"' for v in cols)
    qv = ", ".join(f'q."{v}"' for v in cols)
    tvs = ", ".join(f't."{v}" AS "t_{v}"' for v in cols)
    d2 = " + ".join(f'(q."{v}" - t."{v}") * (q."{v}" - t."{v}")' for v in cols)
    part = ", ".join(f'"{v}"' for v in cols)
    tord = ", ".join(f'"t_{v}"' for v in cols)
    on = " AND ".join(f'f."{v}" = v."{v}"' for v in cols)
    n = name
    return (
        f"cnt{n} AS (SELECT doc_id, {piv} FROM {src} GROUP BY doc_id), "
        f"feats{n} AS (SELECT l.doc_id, l.label_binary, l.split, {fsel} FROM lab l LEFT JOIN cnt{n} c ON c.doc_id = l.doc_id), "
        f"tv{n} AS (SELECT {part}, sum(CASE WHEN label_binary = 0 THEN 1 ELSE 0 END) AS n0, "
        f"sum(CASE WHEN label_binary = 1 THEN 1 ELSE 0 END) AS n1 FROM feats{n} WHERE split IN ('train', 'valid') GROUP BY ALL), "
        f"qv{n} AS (SELECT DISTINCT {part} FROM feats{n} WHERE split = 'test'), "
        f"pairs{n} AS (SELECT {qv}, {tvs}, {d2} AS d2, t.n0, t.n1 FROM qv{n} q CROSS JOIN tv{n} t), "
        f"ranked{n} AS (SELECT *, COALESCE(sum(n0 + n1) OVER (PARTITION BY {part} ORDER BY d2, {tord} "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pairs{n}), "
        f"alloc{n} AS (SELECT *, greatest(0, least(n0 + n1, {k} - before)) AS take FROM ranked{n}), "
        f"votes{n} AS (SELECT {part}, sum(least(n0, take)) AS v0, sum(take - least(n0, take)) AS v1 FROM alloc{n} GROUP BY ALL), "
        f"knn_{n} AS (SELECT f.doc_id, f.label_binary, CASE WHEN v.v1 > v.v0 THEN 1 ELSE 0 END AS prediction "
        f"FROM feats{n} f JOIN votes{n} v ON {on} WHERE f.split = 'test')")


LOGS = f"""
ep AS (SELECT vec_id AS run, label, embedding, CAST(unnest(range(1, {TB.LOG_EPOCHS + 1})) AS INTEGER) AS epoch FROM embeddings),
logs AS (SELECT run, label, epoch, abs(CAST(embedding[epoch] AS DOUBLE)) AS loss,
         abs(CAST(embedding[10 + epoch] AS DOUBLE)) AS eval_loss, abs(CAST(embedding[20 + epoch] AS DOUBLE)) AS eval_f1 FROM ep)"""


def _roc(score: str) -> str:
    return f"""
rp AS (
  SELECT run, {score} AS score, CAST(sum(CASE WHEN label_binary = 1 THEN 1 ELSE 0 END) AS BIGINT) AS dtp,
         CAST(sum(CASE WHEN label_binary = 0 THEN 1 ELSE 0 END) AS BIGINT) AS dfp
  FROM pred GROUP BY run, {score}),
rt AS (
  SELECT *, sum(dtp) OVER (PARTITION BY run ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
            sum(dfp) OVER (PARTITION BY run ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
            sum(dtp) OVER (PARTITION BY run) AS P, sum(dfp) OVER (PARTITION BY run) AS N
  FROM rp)"""


ROC_SQL = _roc("confidence")
TAGS = "tags AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', {i})" for i, t in enumerate(E.TAGS_A)) + ") t(entity, tag_order))"

ERR_TAGS = f"""
errs AS (
  SELECT run, doc_id, CASE WHEN label_binary = 0 AND prediction = 1 THEN 'FP' ELSE 'FN' END AS outcome
  FROM pred WHERE (label_binary = 0 AND prediction = 1) OR (label_binary = 1 AND prediction = 0)),
ecnt AS (
  SELECT e.run, e.outcome, a.entity, count(*) AS n FROM errs e JOIN ents_a a ON a.doc_id = e.doc_id
  GROUP BY e.run, e.outcome, a.entity),
{TAGS},
etc AS (
  SELECT r.run, o.outcome, t.entity, CAST(t.tag_order AS INTEGER) AS tag_order, CAST(COALESCE(c.n, 0) AS BIGINT) AS n
  FROM (SELECT DISTINCT run FROM pred) r CROSS JOIN (VALUES ('FP'), ('FN')) o(outcome) CROSS JOIN tags t
  LEFT JOIN ecnt c ON c.run = r.run AND c.outcome = o.outcome AND c.entity = t.entity)"""

PIVOT_COLS = ", ".join(f'CAST(COALESCE(sum(CASE WHEN entity = \'{t}\' THEN 1 ELSE 0 END), 0) AS BIGINT) AS "{t}"'
                       for t in E.TAGS_A)


def _features(where: str, vocab, src: str = "ents_a") -> str:
    cols = ", ".join(f'CAST(COALESCE(c."{v}", 0) AS BIGINT) AS "{v}"' for v in vocab)
    piv = ", ".join(f'sum(CASE WHEN entity = \'{v}\' THEN 1 ELSE 0 END) AS "{v}"' for v in vocab)
    ents = ENTS_A if src == "ents_a" else ENTS_B
    return (f"WITH {LAB}, {ents}, cnt AS (SELECT doc_id, {piv} FROM {src} GROUP BY doc_id) "
            f"SELECT l.doc_id, l.label_binary, {cols} FROM lab l LEFT JOIN cnt c ON c.doc_id = l.doc_id {where}")


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _grammar_sql() -> str:
    """N6, wide: the same classes and grammar over the same units."""
    core = f"regexp_extract(x, {_sql_text(G.CORE)}, 1)"
    tail = f"regexp_extract(x, {_sql_text(G.TAIL)}, 0)"
    rules = " ".join(f"WHEN {f'regexp_matches(c, {_sql_text(r)})' if isinstance(r, str) else 'c IN (' + ', '.join(map(_sql_text, r)) + ')'} "
                     f"THEN '{letter}'" for letter, r in G.CLASSES)
    labels = " ".join(f"WHEN regexp_matches(m, {_sql_text(f'^(?:{p})' + chr(92) + 'z')}) THEN '{name}'" for name, p in G.GRAMMAR)
    return (f"WITH tok AS (SELECT doc_id, regexp_extract_all(text, {_sql_text(G.TOKEN)}) AS toks FROM documents), "
            f"one AS (SELECT doc_id, i, {core} AS c, {tail} AS tail FROM (SELECT doc_id, unnest(toks) AS x, unnest(range(len(toks))) AS i FROM tok)), "
            f"k AS (SELECT doc_id, i, c, tail, CASE {rules} ELSE '{G.OTHER}' END AS letter FROM one), "
            f"u AS (SELECT doc_id, list(c ORDER BY i) AS cores, string_agg(letter || CASE WHEN letter = '{G.OTHER}' THEN '' ELSE CAST(i AS VARCHAR) END "
            "|| CASE tail WHEN '' THEN '' WHEN ',' THEN ',' ELSE ';' END, ' ' ORDER BY i) AS units FROM k GROUP BY doc_id), "
            f"ml AS (SELECT doc_id, cores, regexp_extract_all(units, {_sql_text(G.phrase_pattern())}) AS ms FROM u), "
            "mm AS (SELECT doc_id, cores, unnest(ms) AS m, unnest(range(len(ms))) AS pos FROM ml), "
            "f AS (SELECT *, CAST(regexp_extract(m, '[0-9]+') AS INTEGER) AS a, CAST(regexp_extract(m, '([0-9]+)$', 1) AS INTEGER) AS z FROM mm) "
            f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE {labels} END AS entity, array_to_string(cores[a + 1:z + 1], ' ') AS word, "
            "a AS first_token, z - a + 1 AS n_tokens FROM f")


def _gazetteer_sql() -> str:
    """Names joined with the pieces between borders of letters and digits; leftmost, then longest, by a fold."""
    bench = ENTS_A.replace("FROM documents", "FROM (SELECT item_id AS doc_id, text FROM benchmark)")
    letter = r"[\p{L}\p{N}]"
    return f"""WITH {bench}, {SPANS_N5},
names AS (SELECT word AS name, min(entity) AS label, length(word) AS n FROM spans5 WHERE word <> '' GROUP BY word),
sizes AS (SELECT DISTINCT n FROM names),
letters AS (SELECT doc_id, regexp_extract_all(text, '(?s).') AS cs FROM documents),
marked AS (SELECT doc_id, cs, list_transform(cs, lambda c: regexp_matches(c, '{letter}')) AS alnum FROM letters),
starts AS (SELECT * FROM (SELECT doc_id, cs, alnum, unnest(range(len(cs))) AS s FROM marked)
           WHERE (s = 0 OR NOT alnum[s]) AND cs[s + 1] IN (SELECT substr(name, 1, 1) FROM names)),
cuts AS (SELECT doc_id, s, n, array_to_string(cs[s + 1:s + n], '') AS name FROM starts, sizes
         WHERE s + n <= len(cs) AND (s + n = len(cs) OR NOT alnum[s + n + 1])),
hits AS (SELECT doc_id, list({{'z': s + n, 'got': [{{'s': s, 'n': n, 'label': label, 'name': name}}]}} ORDER BY s, n DESC) AS hs
         FROM cuts JOIN names USING (name, n) GROUP BY doc_id),
kept AS (SELECT doc_id, list_reduce(hs, lambda acc, h: CASE WHEN h.got[1].s >= acc.z
           THEN {{'z': h.z, 'got': list_concat(acc.got, h.got)}} ELSE acc END).got AS got FROM hits),
flat AS (SELECT doc_id, unnest(got) AS g, unnest(range(len(got))) AS pos FROM kept)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, g.label AS entity, g.name AS word, CAST(g.s AS INTEGER) AS start,
       CAST(g.s + g.n AS INTEGER) AS "end" FROM flat"""


def _subword_ctes(xml: str) -> str:
    """``coded(doc_id, ids)``: longest match of every distinct token over the vocabulary file, by a fold over its places."""
    path, end = SW.default_vocabulary(), SW.WORD_END
    quoted = [c.replace("'", "''") for c in SW.byte_alphabet()]
    alphabet = ", ".join(f"('{b:02X}', '{c}')" for b, c in enumerate(quoted))
    vocabulary = SW.Vocabulary(path)
    markers = ", ".join(f"('{m}', {i})" for m, i in vocabulary.markers.items())
    longest = max(len(p.removesuffix(end)) for p in vocabulary.ids)
    return f"""{xml}, tx AS ({_insert('lm').replace('pieces AS', 'WITH pieces AS', 1)}),
toks AS (SELECT doc_id, regexp_extract_all(lower(tagged_text), '{T.TOKEN_PATTERN}', 0) AS ts FROM tx),
tokens AS (SELECT doc_id, unnest(ts) AS token, unnest(range(len(ts))) AS at FROM toks),
markers(token, id) AS (VALUES {markers}),
pieces_ AS (SELECT e.key AS piece, e.value AS id FROM (SELECT unnest(map_entries(from_json(
              json_extract(content, '$.model.vocab'), '"MAP(VARCHAR,INTEGER)"'))) AS e FROM read_text('{path}'))),
words AS (SELECT token, hex(encode(token)) AS hx FROM (SELECT DISTINCT token FROM tokens) ANTI JOIN markers USING (token)),
alphabet(b, c) AS (VALUES {alphabet}),
bytes AS (SELECT token, unnest(range(len(hx) // 2)) AS i, hx FROM words),
written AS (SELECT token, string_agg(c, '' ORDER BY i) AS w, count(*) AS size
            FROM bytes JOIN alphabet ON b = substr(hx, 2 * i + 1, 2) GROUP BY token),
places AS (SELECT token, w, size, unnest(range(size)) AS a FROM written),
cuts AS (SELECT token, w, size, a, unnest(range(1, least({longest}, size - a) + 1)) AS n FROM places),
edges AS (SELECT c.token, c.a, max(c.n) AS n, arg_max(p.id, c.n) AS id FROM cuts c JOIN pieces_ p
          ON p.piece = substr(c.w, c.a + 1, c.n) || CASE WHEN c.a + c.n = c.size THEN '{end}' ELSE '' END
          GROUP BY c.token, c.a),
lists AS (SELECT token, list({{'a': a, 'z': a + n, 'ids': [id]}} ORDER BY a) AS es FROM edges GROUP BY token),
codes AS (SELECT token, list_reduce(es, lambda acc, e: CASE WHEN e.a = acc.z
            THEN {{'a': acc.a, 'z': e.z, 'ids': list_concat(acc.ids, e.ids)}} ELSE acc END).ids AS ids FROM lists
          UNION ALL SELECT token, [id] FROM markers),
joined AS (SELECT t.doc_id, flatten(list(c.ids ORDER BY t.at)) AS ids FROM tokens t JOIN codes c USING (token) GROUP BY t.doc_id),
coded AS (SELECT d.doc_id, COALESCE(j.ids, []) AS ids FROM documents d LEFT JOIN joined j USING (doc_id))"""


def _batches_sql(xml: str) -> str:
    pad, size = SW.Vocabulary().pad, SW.BATCH
    return f"""WITH {_subword_ctes(xml)},
ranked AS (SELECT doc_id, ids, len(ids) AS n, row_number() OVER (
             ORDER BY len(ids), md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) - 1 AS r FROM coded),
batched AS (SELECT *, r // {size} AS batch_no, max(n) OVER (PARTITION BY r // {size}) AS longest FROM ranked)
SELECT doc_id, CAST(batch_no AS BIGINT) AS batch_no, CAST(longest AS INTEGER) AS batch_len, CAST(n AS INTEGER) AS n_tokens,
       array_to_string(list_concat(ids, list_transform(range(longest - n), lambda i: {pad})), ' ') AS input_ids,
       CAST(n AS INTEGER) AS n_real FROM batched"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["scan_text"] = "SELECT doc_id, text FROM documents"
    q["scan_splits"] = f"SELECT doc_id, {_split('doc_id')} AS split FROM documents"
    q["scan_predictions"] = (f"WITH {PRED} SELECT run, doc_id, label_binary, logit0, logit1, prediction, "
                             "round(confidence, 9) AS confidence FROM pred")
    q["parse_entities"] = (f"WITH {ENTS_A} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 "
                           "AS INTEGER) AS pos, entity, score, CAST(pos + 1 AS INTEGER) AS \"index\", "
                           "word, start, \"end\" FROM ents_a")
    q["project_text"] = f"WITH {STMT} SELECT doc_id, label_binary, text FROM stmt"
    q["drop_columns"] = f"WITH {STMT} SELECT doc_id, label_binary, split FROM stmt"
    q["label_isin"] = ("SELECT vec_id AS row_id, label, CASE WHEN label IN (3, 4, 5) THEN 1 ELSE 0 END AS label_binary "
                       "FROM embeddings")
    q["label_three_way"] = ("SELECT vec_id AS row_id, label, CASE WHEN label IN (3, 4, 5) THEN 1 WHEN label IN (0, 1, 2) "
                            "THEN 0 END AS label_binary, CASE WHEN label IN (3, 4, 5, 0, 1, 2) THEN 'ok' "
                            "ELSE 'Out-Of-Range' END AS label_status FROM embeddings")
    q["label_inverted"] = ("SELECT vec_id AS row_id, label, CASE WHEN label IN (0, 1, 2) THEN 1 ELSE 0 END AS label_binary "
                           "FROM embeddings")
    q["entity_display"] = (f"WITH {ENTS_A} SELECT doc_id, pos, '(' || {_display('word')} || ', ' || "
                           f"{_display('entity')} || ')' AS display FROM ents_a")
    q["label_map"] = (f"WITH {LAB} SELECT doc_id, CAST(label_binary AS BOOLEAN) AS cat_1, "
                      "NOT CAST(label_binary AS BOOLEAN) AS cat_0 FROM lab")
    q["preview"] = f"WITH {STMT} SELECT doc_id, label_binary, text FROM stmt ORDER BY doc_id LIMIT 5"
    q["filter_true"] = f"WITH {STMT} SELECT doc_id, text FROM stmt WHERE label_binary = 1"
    q["filter_false"] = f"WITH {STMT} SELECT doc_id, text FROM stmt WHERE label_binary = 0"
    q["error_outcome"] = (f"WITH {PRED} SELECT run, doc_id, CASE WHEN label_binary = 1 AND prediction = 1 THEN 'TP' "
                          "WHEN label_binary = 0 AND prediction = 1 THEN 'FP' WHEN label_binary = 1 AND prediction = 0 "
                          "THEN 'FN' WHEN label_binary = 0 AND prediction = 0 THEN 'TN' END AS outcome FROM pred")
    lit_item = ("'{''entity'': ' || " + _display("entity") + " || ', ''score'': ' || CAST(score AS VARCHAR) || "
                "', ''index'': ' || CAST(pos + 1 AS VARCHAR) || ', ''word'': ' || " + _display("word") +
                " || ', ''start'': ' || CAST(start AS VARCHAR) || ', ''end'': ' || CAST(\"end\" AS VARCHAR) || '}'")
    q["error_sample"] = (f"WITH {PRED}, {ENTS_A}, s AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id) AS rn "
                         "FROM pred WHERE prediction <> label_binary), "
                         f"lit AS (SELECT doc_id, '[' || string_agg({lit_item}, ', ' ORDER BY pos) || ']' AS A_raw_entities "
                         "FROM ents_a GROUP BY doc_id) "
                         "SELECT s.run, s.doc_id, d.text, COALESCE(lit.A_raw_entities, '[]') AS A_raw_entities, "
                         "s.prediction, s.label_binary FROM s "
                         "JOIN documents d ON d.doc_id = s.doc_id LEFT JOIN lit ON lit.doc_id = s.doc_id WHERE rn <= 5")
    q["valid_entities"] = (f"WITH {ENTS_A}, {ENTS_B}, allx AS (SELECT * FROM ents_a UNION ALL SELECT * FROM ents_b), "
                           "k AS (SELECT *, (doc_id + pos) % 7 AS lost FROM allx), "
                           "br AS (SELECT doc_id, tagger, pos, CASE lost WHEN 0 THEN '' WHEN 1 THEN NULL ELSE entity END AS entity, "
                           "CASE lost WHEN 2 THEN '' WHEN 3 THEN NULL ELSE word END AS word, "
                           "CASE WHEN lost <> 4 THEN COALESCE(start, pos) END AS start, "
                           "CASE WHEN lost <> 5 THEN COALESCE(\"end\", pos) END AS \"end\" FROM k) "
                           "SELECT doc_id, tagger, pos, entity, word, start, \"end\" FROM br WHERE word IS NOT NULL "
                           "AND word <> '' AND entity IS NOT NULL AND entity <> '' AND start IS NOT NULL "
                           "AND \"end\" IS NOT NULL")
    q["tag_tokens"] = f"WITH {ENTS_A} SELECT doc_id, pos, entity, score, word, start, \"end\" FROM ents_a"
    q["tag_multi"] = (f"WITH {ENTS_A}, {ENTS_B}, c AS (SELECT doc_id, count(*) FILTER (WHERE tagger = 'A') AS a, "
                      "count(*) FILTER (WHERE tagger = 'B') AS b FROM (SELECT doc_id, tagger FROM ents_a UNION ALL "
                      "SELECT doc_id, tagger FROM ents_b) GROUP BY doc_id) "
                      "SELECT d.doc_id, CAST(COALESCE(c.a, 0) AS BIGINT) AS n_a, CAST(COALESCE(c.b, 0) AS BIGINT) AS n_b "
                      "FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id")
    q["tag_spans"] = (f"WITH {ENTS_A}, {SPANS_N5} SELECT doc_id, CAST(pos AS INTEGER) AS pos, entity, score, word, "
                      "CAST(start AS INTEGER) AS start, CAST(\"end\" AS INTEGER) AS \"end\", n_tokens FROM spans5")
    q["tag_phrases"] = f"WITH {ENTS_B} SELECT doc_id, pos, entity, word FROM ents_b"
    q["tag_phrases_wide"] = _grammar_sql()
    q["tag_gazetteer"] = _gazetteer_sql()
    q["entity_labels"] = (f"WITH {ENTS_A} SELECT doc_id, string_agg(entity, ',' ORDER BY pos) AS labels "
                          "FROM ents_a GROUP BY doc_id")
    mark = E.BYTE_LEVEL_MARK
    q["clean_a_leading"] = (f"WITH {ENTS_A}, {SPANS_N5}, rw AS (SELECT doc_id, pos, '{mark}' || replace(word, ' ', '{mark}') "
                            f"AS raw_word FROM spans5) SELECT doc_id, CAST(pos AS INTEGER) AS pos, raw_word, "
                            f"regexp_replace(raw_word, '^{mark}+', '') AS word FROM rw")
    q["clean_a_all"] = (f"WITH {ENTS_A}, {SPANS_N5}, rw AS (SELECT doc_id, pos, '{mark}' || replace(word, ' ', '{mark}') "
                        f"AS raw_word FROM spans5) SELECT doc_id, CAST(pos AS INTEGER) AS pos, raw_word, "
                        f"replace(raw_word, '{mark}', '') AS word FROM rw")
    wm = E.WORDPIECE_MARK
    q["merge_wordpiece"] = (f"WITH {ENTS_A}, {PIECES} SELECT doc_id, CAST(island - 1 AS INTEGER) AS pos, "
                            f"string_agg(CASE WHEN starts_with(word, '{wm}') THEN replace(word, '{wm}', '') ELSE word END, '' "
                            "ORDER BY pos, piece_no) AS word, arg_min(entity, pos * 2 + piece_no) AS entity "
                            "FROM pisl WHERE island > 0 GROUP BY doc_id, island")
    q["merge_wordpiece_keep"] = (f"WITH {ENTS_A}, {PIECES}, g AS (SELECT doc_id, island, "
                                 f"string_agg(CASE WHEN starts_with(word, '{wm}') THEN substring(word, 3) ELSE word END, '' "
                                 "ORDER BY pos, piece_no) AS word, CASE WHEN island > 0 THEN arg_min(entity, pos * 2 + piece_no) "
                                 "END AS entity FROM pisl GROUP BY doc_id, island) "
                                 "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS INTEGER) "
                                 "AS pos, word, entity FROM g WHERE word <> ''")
    q["explode_entities"] = (f"WITH {ENTS_A}, {ENTS_B}, u AS (SELECT doc_id, tagger, pos, entity, word FROM ents_a "
                             "UNION ALL SELECT doc_id, tagger, pos, entity, word FROM ents_b) "
                             "SELECT doc_id, tagger, CAST(row_number() OVER (PARTITION BY doc_id, tagger ORDER BY pos) - 1 "
                             "AS INTEGER) AS pos, entity, word FROM u")
    q["tag_inline_tokens"] = f"WITH {ENTS_A}, {VALID_A}, {_disjoint('va', 'nov')}, {_insert('nov')}"
    q["merge_adjacent"] = (f"WITH {ENTS_A}, sp AS (SELECT doc_id, pos, start, \"end\", entity FROM ents_a), "
                           f"{_merge('sp')} SELECT * FROM merged")
    xml = (f"{ENTS_A}, {VALID_A}, {_merge('va')}, {_disjoint('merged', 'nov')}, "
           f"lm AS (SELECT doc_id, start, \"end\", lower(entity) AS entity FROM nov)")
    q["tag_xml"] = f"WITH {xml}, {_insert('lm')}"
    q["tag_inline_cursor"] = f"WITH {ENTS_B}, {_fold_lists('ents_b')}, {CURSOR}, {_insert('cursor_spans')}"
    q["find_offsets"] = f"WITH {ENTS_B}, {_fold_lists('ents_b')}, {OFFSETS} SELECT doc_id, pos, start, \"end\", entity FROM offsets"
    q["tag_xml_searched"] = (f"WITH {ENTS_B}, {_fold_lists('ents_b')}, {OFFSETS}, {_merge('offsets')}, "
                             f"{_disjoint('merged', 'ms')}, {_insert('ms')}")
    q["label_vocab"] = (f"WITH {ENTS_A}, l AS (SELECT DISTINCT entity FROM ents_a WHERE entity IS NOT NULL AND entity <> '') "
                        "SELECT '[' || entity || '_]' AS token FROM l UNION ALL SELECT '[/' || entity || '_]' FROM l")
    q["tokenize_pad"] = (f"WITH {xml}, tx AS ({_insert('lm').replace('pieces AS', 'WITH pieces AS', 1)}), "
                         f"tk AS (SELECT doc_id, regexp_extract_all(lower(tagged_text), '{T.TOKEN_PATTERN}', 0) AS toks FROM tx), "
                         f"wn AS (SELECT doc_id, toks, unnest(range(greatest(1, CAST(ceil(len(toks) / 128.0) AS BIGINT)))) AS w FROM tk), "
                         f"ws AS (SELECT doc_id, w, toks[w * 128 + 1:w * 128 + 128] AS t FROM wn) "
                         f"SELECT doc_id, CAST(w AS INTEGER) AS window_no, array_to_string(list_concat(t, list_transform("
                         f"range(128 - len(t)), lambda i: '{T.PAD}')), ' ') AS tokens, CAST(len(t) AS INTEGER) AS n_real FROM ws")
    q["subword_ids"] = (f"WITH {_subword_ctes(xml)} SELECT doc_id, CAST(len(ids) AS INTEGER) AS n_tokens, "
                        "array_to_string(ids, ' ') AS ids FROM coded")
    q["subword_batches"] = _batches_sql(xml)
    q["class_counts"] = f"WITH {LAB} SELECT label_binary, count(*) AS n FROM lab GROUP BY label_binary"
    q["class_balance"] = (f"WITH {LAB} SELECT split, count(*) AS total, "
                          "CAST(sum(CASE WHEN label_binary = 1 THEN 1 ELSE 0 END) AS BIGINT) AS ones, "
                          "CAST(sum(CASE WHEN label_binary = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zeros, "
                          "round(sum(CASE WHEN label_binary = 1 THEN 1 ELSE 0 END) * 100.0 / count(*), 2)::DOUBLE AS pct_ones, "
                          "round(sum(CASE WHEN label_binary = 0 THEN 1 ELSE 0 END) * 100.0 / count(*), 2)::DOUBLE AS pct_zeros "
                          "FROM lab GROUP BY split")
    q["class_priors"] = (f"WITH {LAB} SELECT round(avg(CASE WHEN label_binary = 0 THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS p0, "
                         "round(avg(CASE WHEN label_binary = 1 THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS p1 "
                         "FROM lab WHERE split = 'train'")
    wec = (f"{LAB}, {ENTS_A}, {ENTS_B}, wec AS (SELECT a.tagger, l.label_binary, a.word, a.entity, count(*) AS n "
           "FROM (SELECT doc_id, tagger, word, entity FROM ents_a UNION ALL SELECT doc_id, tagger, word, entity FROM ents_b) a "
           "JOIN lab l ON l.doc_id = a.doc_id GROUP BY a.tagger, l.label_binary, a.word, a.entity)")
    q["word_entity_counts"] = f"WITH {wec} SELECT * FROM wec"
    mark, wm = E.BYTE_LEVEL_MARK, E.WORDPIECE_MARK
    q["clean_entity_counts"] = (
        f"WITH {LAB}, {ENTS_A}, {SPANS_N5}, {PIECES}, "
        f"bl AS (SELECT doc_id, 'byte_level' AS tagger, regexp_replace('{mark}' || replace(word, ' ', '{mark}'), '^{mark}+', '') AS word, "
        f"entity FROM spans5), gl AS (SELECT doc_id, 'wordpiece' AS tagger, string_agg(CASE WHEN starts_with(word, '{wm}') "
        f"THEN replace(word, '{wm}', '') ELSE word END, '' ORDER BY pos, piece_no) AS word, arg_min(entity, pos * 2 + piece_no) AS entity "
        "FROM pisl WHERE island > 0 GROUP BY doc_id, island), u AS (SELECT * FROM bl UNION ALL SELECT * FROM gl) "
        "SELECT u.tagger, l.label_binary, u.word, u.entity, count(*) AS n FROM u JOIN lab l ON l.doc_id = u.doc_id "
        "GROUP BY u.tagger, l.label_binary, u.word, u.entity")
    q["top_entities"] = (f"WITH {wec}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY tagger, label_binary "
                         "ORDER BY n DESC, word, entity) AS INTEGER) AS rank FROM wec) SELECT * FROM r WHERE rank <= 10")
    q["tag_frequency"] = f"WITH {ENTS_A} SELECT entity, count(*) AS n FROM ents_a WHERE entity IS NOT NULL GROUP BY entity"
    q["tags_zero_filled"] = (f"WITH {ENTS_A}, {TAGS}, f AS (SELECT entity, count(*) AS n FROM ents_a GROUP BY entity) "
                             "SELECT t.entity, CAST(t.tag_order AS INTEGER) AS tag_order, CAST(COALESCE(f.n, 0) AS BIGINT) AS n "
                             "FROM tags t LEFT JOIN f ON f.entity = t.entity")
    q["error_tag_counts"] = f"WITH {PRED}, {ENTS_A}, {ERR_TAGS} SELECT * FROM etc"
    cmp_cols = ", ".join(f"CAST(COALESCE(sum(n) FILTER (WHERE run = '{r}' AND outcome = '{o}'), 0) AS BIGINT) AS {r}_{o}"
                         for r in ("tagged", "untagged") for o in ("FP", "FN"))
    q["run_comparison"] = f"WITH {PRED}, {ENTS_A}, {ERR_TAGS} SELECT entity, tag_order, {cmp_cols} FROM etc GROUP BY entity, tag_order"
    q["entity_pivot"] = f"WITH {ENTS_A} SELECT doc_id, {PIVOT_COLS} FROM ents_a GROUP BY doc_id"
    q["entity_features"] = _features("", E.TAGS_A)
    q["entity_features_b"] = _features("", E.TAGS_B, "ents_b")
    q["features_aligned"] = _features("WHERE l.split = 'test'", sorted(E.TAGS_A))
    worded = f"{LAB}, {ENTS_A}, we AS (SELECT a.doc_id, l.split, a.entity || '=' || a.word AS label FROM ents_a a JOIN lab l ON l.doc_id = a.doc_id)"
    vocab = ("v AS (SELECT label, row_number() OVER (ORDER BY md5(label || ':42'), label) - 1 AS feature_id "
             "FROM (SELECT DISTINCT label FROM we WHERE split = 'train'))")
    q["feature_vocabulary"] = f"WITH {worded}, {vocab} SELECT label, feature_id FROM v"
    q["features_sparse"] = (f"WITH {worded}, {vocab}, c AS (SELECT doc_id, feature_id, count(*) AS n FROM we JOIN v ON v.label = we.label "
                            "WHERE split = 'test' GROUP BY doc_id, feature_id), g AS (SELECT doc_id, count(*) AS k, "
                            "string_agg(feature_id || ':' || n, ',' ORDER BY feature_id) AS f FROM c GROUP BY doc_id) "
                            "SELECT l.doc_id, l.label_binary, CAST(COALESCE(k, 0) AS INTEGER) AS n_features, COALESCE(f, '') AS features "
                            "FROM lab l LEFT JOIN g ON g.doc_id = l.doc_id WHERE l.split = 'test'")
    sk = "md5(CAST(doc_id AS VARCHAR) || ':42')"
    q["seeded_shuffle"] = (f"WITH {LAB} SELECT doc_id, split, row_number() OVER (ORDER BY {sk}, doc_id) - 1 AS shuffle_rank FROM lab")
    q["mini_batches"] = (f"WITH {LAB} SELECT doc_id, split, CAST(floor((row_number() OVER (PARTITION BY split "
                         f"ORDER BY {sk}, doc_id) - 1) / 8) AS BIGINT) AS batch_no FROM lab")
    q["train_full"] = f"WITH {LAB} SELECT doc_id, label_binary, split FROM lab WHERE split IN ('train', 'valid')"
    q["score_predictions"] = (f"WITH {PRED} SELECT run, doc_id, prediction AS pred_argmax, round(confidence, 9) AS confidence, "
                              "CASE WHEN confidence >= 0.5 THEN 1 ELSE 0 END AS pred_threshold FROM pred")
    q["binary_metrics"] = f"WITH {PRED}, {METRICS_SQL} SELECT * FROM bm"
    q["weighted_metrics"] = f"WITH {PRED}, {METRICS_SQL} SELECT run, w_precision, w_recall, w_f1, accuracy FROM ({WEIGHTED_SQL})"
    q["confusion_matrix"] = (f"WITH {PRED}, cells AS (SELECT * FROM (VALUES (1, 1, 'TP'), (0, 1, 'FP'), (1, 0, 'FN'), (0, 0, 'TN')) "
                             "c(label_binary, prediction, outcome)), cnt AS (SELECT run, label_binary, prediction, count(*) AS n "
                             "FROM pred GROUP BY ALL) SELECT r.run, CAST(c.label_binary AS INTEGER) AS label_binary, "
                             "CAST(c.prediction AS INTEGER) AS prediction, c.outcome, CAST(COALESCE(cnt.n, 0) AS BIGINT) AS n "
                             "FROM (SELECT DISTINCT run FROM pred) r CROSS JOIN cells c LEFT JOIN cnt ON cnt.run = r.run "
                             "AND cnt.label_binary = c.label_binary AND cnt.prediction = c.prediction")
    for name, score in (("roc_curve", "confidence"), ("roc_curve_logit", "logit1")):
        q[name] = (f"WITH {PRED}, {_roc(score)} SELECT run, round(score, 9) AS score, CAST(tp AS BIGINT) AS tp, "
                   "CAST(fp AS BIGINT) AS fp, round(COALESCE(tp::DOUBLE / NULLIF(P, 0), 0), 9) AS tpr, "
                   "round(COALESCE(fp::DOUBLE / NULLIF(N, 0), 0), 9) AS fpr FROM rt UNION ALL "
                   "SELECT DISTINCT run, CAST(NULL AS DOUBLE), 0::BIGINT, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE FROM rt")
    q["auc"] = (f"WITH {PRED}, {ROC_SQL} SELECT run, round(COALESCE(sum((dfp::DOUBLE / N) * (2 * tp - dtp) / (2 * P)), 0), 6) "
                "AS auc, count(*) AS n_points FROM rt GROUP BY run")
    unp = " UNION ALL ".join(f"SELECT run, '{m}' AS metric, {m} AS value FROM bm" for m in ("accuracy", "precision", "recall", "f1"))
    q["metrics_long"] = f"WITH {PRED}, {METRICS_SQL} {unp}"
    q["metrics_wide"] = f"WITH {PRED}, {METRICS_SQL} SELECT run, accuracy, precision, recall, f1 FROM bm"
    q["random_baseline"] = (f"WITH {LAB}, pr AS (SELECT avg(CASE WHEN label_binary = 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS p1 "
                            "FROM lab WHERE split = 'train') SELECT doc_id, label_binary, CAST(CAST(('0x' || "
                            "substr(md5(CAST(doc_id AS VARCHAR) || ':42'), 1, 8)) AS BIGINT)::DOUBLE / 4294967296.0 < p1 AS INTEGER) "
                            "AS prediction FROM lab CROSS JOIN pr WHERE split = 'test'")
    q["knn_predict"] = f"WITH {LAB}, {ENTS_A}, {_knn('ents_a', E.TAGS_A, 'A')} SELECT doc_id, label_binary, prediction FROM knn_A"
    rand = (f"rnd AS ({q['random_baseline'].replace(f'WITH {LAB}, pr AS', 'WITH pr AS')})")
    q["scoreboard_exact"] = (
        f"WITH {LAB}, {ENTS_A}, {ENTS_B}, {_knn('ents_a', E.TAGS_A, 'A')}, {_knn('ents_b', E.TAGS_B, 'B')}, {rand}, "
        "allp AS (SELECT 'A' AS tagger, 'knn' AS model, label_binary, prediction FROM knn_A UNION ALL "
        "SELECT 'B', 'knn', label_binary, prediction FROM knn_B UNION ALL "
        "SELECT 'A', 'random', label_binary, prediction FROM rnd UNION ALL SELECT 'B', 'random', label_binary, prediction FROM rnd), "
        "pred AS (SELECT tagger || '|' || model AS run, label_binary, prediction FROM allp), "
        f"{METRICS_SQL}, wm AS (SELECT run AS wrun, w_precision, w_recall, w_f1 FROM ({WEIGHTED_SQL})) "
        "SELECT split_part(run, '|', 1) AS tagger, split_part(run, '|', 2) AS model, tp, fp, fn, tn, accuracy, precision, recall, f1, "
        "w_precision, w_recall, w_f1 FROM bm JOIN wm ON wrun = run")
    q["run_records"] = (f"WITH {PRED}, {METRICS_SQL} SELECT run, 42 AS seed, 0.5::DOUBLE AS threshold, accuracy, precision, recall, f1 FROM bm")
    q["epoch_stats"] = f"WITH {LOGS} SELECT run, epoch, loss, eval_loss, eval_f1 FROM logs"
    q["early_stop"] = (
        f"WITH {LOGS}, b AS (SELECT *, max(eval_f1) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING "
        "AND 1 PRECEDING) AS pb FROM logs), "
        "i AS (SELECT *, max(CASE WHEN pb IS NULL OR eval_f1 > pb THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS rb FROM b), "
        "s AS (SELECT run, min(CASE WHEN epoch - rb >= 5 THEN epoch END) AS stop, max(epoch) AS n FROM i GROUP BY run) "
        "SELECT s.run, i.rb AS best_epoch, CAST(s.n AS INTEGER) AS epochs, CAST(least(i.rb + 5, s.n) AS INTEGER) AS final_epoch "
        "FROM s JOIN i ON i.run = s.run AND i.epoch = COALESCE(s.stop, s.n)")
    q["best_run"] = (f"WITH {LOGS}, l AS (SELECT label, run, round(eval_f1, 9) AS f1 FROM logs WHERE epoch = {TB.LOG_EPOCHS}) "
                     "SELECT label, run, f1 FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY f1 DESC, run) AS r FROM l) "
                     "WHERE r = 1")
    q["tag_batched"] = q["tag_tokens"]
    q["stream_tag_xml"] = q["tag_xml"]
    return q
