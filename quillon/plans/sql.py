"""SQL counterparts of the core queries: analysis, stemming, index and ranking in plain SQL."""

from __future__ import annotations

# Values of its own, not those of the code they test.
# The 25 stopwords.
STOPWORDS = "a an and are as at be by for from has he in is it its of on that the to was were will with".split()
# First and last of Hiragana, Katakana, unified ideographs, Hangul syllables.
CJK = "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x3040, 0x309F), (0x30A0, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF)))
# The suffixes of Porter's steps 2, 3 and 4 in the order of the paper, with bli and logi.
_PAPER = {
    2: "ational ate, tional tion, enci ence, anci ance, izer ize, bli ble, alli al, entli ent, eli e, ousli ous, ization ize, ation ate, ator ate, "
    "alism al, iveness ive, fulness ful, ousness ous, aliti al, iviti ive, biliti ble, logi log",
    3: "icate ic, ative, alize al, iciti ic, ical ic, ful, ness",
    4: "al, ance, ence, er, ic, able, ible, ant, ement, ment, ent, ion, ou, ism, ate, iti, ous, ive, ize",
}


def _longest_first(step: int) -> list[tuple[str, str]]:
    rules = [(*r.split(), "")[:2] for r in _PAPER[step].split(", ")]
    return sorted(rules, key=lambda r: -len(r[0]))


STEP2, STEP3 = _longest_first(2), _longest_first(3)
STEP4 = [s for s, _ in _longest_first(4)]

# -- stemming as a chain of SELECTs over (token, w) ----------------------------------------------

_SHAPE = """list_reduce(list_concat([''], string_split(w, '')), lambda a, c: a ||
  CASE WHEN c = '' THEN '' WHEN c IN ('a', 'e', 'i', 'o', 'u') OR (c = 'y' AND right(a, 1) = 'c') THEN 'v' ELSE 'c' END)"""


def _left(what: str, n: int) -> str:
    return f"left({what}, length(w) - {n})"


def _ends(suffix: str) -> str:
    return f"w LIKE '%{suffix}'"


def _step(rules: list[tuple[str, str]], least: str) -> str:
    cases = [f"WHEN {_ends(s)} THEN CASE WHEN regexp_matches({_left('sk', len(s))}, '{least}') THEN {_left('w', len(s))} || '{new}' ELSE w END" for s, new in rules]
    return "CASE " + " ".join(cases) + " ELSE w END"


_O = "(regexp_matches({k}, 'cvc$') AND right({b}, 1) NOT IN ('w', 'x', 'y'))"
_M1, _M2 = "vc", "v+c+v+c"


def _removed(n: int) -> str:
    b, k = _left("w", n), _left("sk", n)
    short = f"(regexp_matches({k}, '{_M1}') AND NOT regexp_matches({k}, '{_M2}') AND {_O.format(k=k, b=b)})"
    return f"""CASE WHEN NOT contains({k}, 'v') THEN w
      WHEN {b} LIKE '%at' OR {b} LIKE '%bl' OR {b} LIKE '%iz' THEN {b} || 'e'
      WHEN length({b}) > 1 AND right({b}, 1) = left(right({b}, 2), 1) AND right({k}, 1) = 'c' AND right({b}, 1) NOT IN ('l', 's', 'z') THEN {_left('w', n + 1)}
      WHEN {short} THEN {b} || 'e' ELSE {b} END"""


def _fourth() -> str:
    cases = []
    for s in STEP4:
        b = _left("w", len(s))
        extra = f" AND right({b}, 1) IN ('s', 't')" if s == "ion" else ""
        cases.append(f"WHEN {_ends(s)} THEN CASE WHEN regexp_matches({_left('sk', len(s))}, '{_M2}'){extra} THEN {b} ELSE w END")
    return "CASE " + " ".join(cases) + " ELSE w END"


def _chain(source: str) -> str:
    """CTEs that end in stems(token, term) for source(token): distinct tokens."""
    b1, k1 = _left("w", 1), _left("sk", 1)
    steps = [
        f"CASE WHEN {_ends('sses')} OR {_ends('ies')} THEN {_left('w', 2)} WHEN {_ends('s')} AND NOT {_ends('ss')} THEN {b1} ELSE w END",
        f"CASE WHEN {_ends('eed')} THEN CASE WHEN regexp_matches({_left('sk', 3)}, '{_M1}') THEN {b1} ELSE w END WHEN {_ends('ed')} THEN {_removed(2)} WHEN {_ends('ing')} THEN {_removed(3)} ELSE w END",
        f"CASE WHEN {_ends('y')} AND contains({k1}, 'v') THEN {b1} || 'i' ELSE w END",
        _step(STEP2, _M1),
        _step(STEP3, _M1),
        _fourth(),
        f"CASE WHEN {_ends('e')} AND (regexp_matches({k1}, '{_M2}') OR (regexp_matches({k1}, '{_M1}') AND NOT {_O.format(k=k1, b=b1)})) THEN {b1} ELSE w END",
        f"CASE WHEN {_ends('ll')} AND regexp_matches(sk, '{_M2}') THEN {b1} ELSE w END",
    ]
    ctes = [f"st0 AS (SELECT DISTINCT token, token AS w FROM {source})"]
    for i, expr in enumerate(steps):
        ctes.append(f"sk{i} AS (SELECT token, w, {_SHAPE} AS sk FROM st{i} WHERE length(token) > 2 AND strlen(token) = length(token))")
        ctes.append(f"st{i + 1} AS (SELECT token, {expr} AS w FROM sk{i})")
    ctes.append(f"stems AS (SELECT s.token, coalesce(e.w, s.token) AS term FROM st0 s LEFT JOIN st{len(steps)} e USING (token))")
    return ",\n".join(ctes)


# -- tokens ---------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in sorted(STOPWORDS))


def tokens_of(content: str) -> str:
    """A list of the tokens of an expression."""
    pairs = f"CASE WHEN regexp_matches(p, '[{CJK}]') AND length(p) > 1 THEN list_transform(range(1, length(p)), lambda i: substr(p, i::INT, 2)) ELSE [p] END"
    cut = f"CASE WHEN regexp_matches(t, '[{CJK}]') THEN flatten(list_transform(regexp_extract_all(t, '[{CJK}]+|[^{CJK}]+'), lambda p: {pairs})) ELSE [t] END"
    return f"flatten(list_transform(regexp_extract_all(lower(nfc_normalize({content})), '[\\p{{L}}\\p{{N}}]+'), lambda t: {cut}))"


_DOCS = "docs AS (SELECT doc_id, coalesce(title, '') AS title, coalesce(text, '') AS text, lang, source FROM documents)"
_TEXTS = """texts AS (
  SELECT doc_id, '' AS field, title || ' ' || text AS content FROM docs
  UNION ALL SELECT doc_id, 'title', title FROM docs)"""
_LISTS = f"lists AS (SELECT doc_id, field, {tokens_of('content')} AS ts FROM texts)"
_TOKENS = "tokens AS (SELECT doc_id, field, unnest(range(len(ts)))::INT AS position, unnest(ts) AS token FROM lists)"

# queries: the distinct judged ones
_QUERIES = "queries AS (SELECT DISTINCT lower(trim(query)) AS query FROM qrels WHERE grade >= 0 AND query IS NOT NULL AND doc_id IS NOT NULL)"
_QLISTS = f"qlists AS (SELECT query, {tokens_of('query')} AS ts FROM queries)"
_QTOKENS = "qtokens AS (SELECT query, unnest(range(len(ts)))::INT AS off, unnest(ts) AS token FROM qlists)"

ANALYSED = ",\n".join([
    _DOCS, _TEXTS, _LISTS, _TOKENS, _QUERIES, _QLISTS, _QTOKENS,
    f"sides AS (SELECT DISTINCT w, list_filter(ts, lambda t: t NOT IN ({_STOP})) AS ts FROM (SELECT w, {tokens_of('w')} AS ts FROM (SELECT term AS w FROM synonyms UNION SELECT member FROM synonyms) WHERE w IS NOT NULL))",
    "every AS (SELECT token FROM tokens UNION SELECT token FROM qtokens UNION SELECT ts[1] FROM sides WHERE len(ts) = 1)",
    _chain("every"),
    f"occ AS (SELECT doc_id, field, position, term FROM tokens JOIN stems USING (token) WHERE token NOT IN ({_STOP}))",
    f"q AS (SELECT query, off, term FROM qtokens JOIN stems USING (token) WHERE token NOT IN ({_STOP}))",
    "post AS (SELECT term, field, doc_id, count(*) AS tf FROM occ GROUP BY ALL)",
    "n AS (SELECT count(*) AS n FROM docs)",
    "ts AS (SELECT term, field, count(*) AS df, sum(tf)::BIGINT AS cf, max(tf) AS max_tf FROM post GROUP BY ALL)",
    "len AS (SELECT d.doc_id, coalesce(sum(tf) FILTER (field = ''), 0)::BIGINT AS length, coalesce(sum(tf) FILTER (field = 'title'), 0)::BIGINT AS title_length FROM docs d LEFT JOIN post USING (doc_id) GROUP BY d.doc_id)",
    "avgs AS (SELECT avg(length) AS a, avg(title_length) AS t, min(length) AS m FROM len)",
    "idf AS (SELECT term, df, ln((SELECT n FROM n)::DOUBLE / df) AS classic, ln(1 + ((SELECT n FROM n) - df + 0.5) / (df + 0.5)) AS prob FROM ts WHERE field = '')",
    "norm AS (SELECT doc_id, sqrt(sum((tf * classic) ** 2)) AS norm FROM post JOIN idf USING (term) WHERE field = '' GROUP BY doc_id)",
])


def _with(*more: str) -> str:
    return "WITH " + ",\n".join([ANALYSED, *more]) + "\n"


_TFIDF = [
    "qc AS (SELECT query, term, count(*) AS c FROM q GROUP BY ALL)",
    "qw0 AS (SELECT query, term, classic, c * classic AS w FROM qc JOIN idf USING (term))",
    "qw AS (SELECT query, term, classic, w / sqrt(sum(w * w) OVER (PARTITION BY query)) AS w FROM qw0 QUALIFY sum(w * w) OVER (PARTITION BY query) > 0)",
    "tfidf AS (SELECT query, doc_id, sum(qw.w * tf * classic) / any_value(norm) AS score FROM post JOIN qw USING (term) JOIN norm USING (doc_id) WHERE field = '' AND norm > 0 GROUP BY ALL HAVING score > 0)",
]
_SAT = "tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / (SELECT a FROM avgs)))"
_BM25 = [
    "qd AS (SELECT DISTINCT query, term FROM q)",
    f"bm25 AS (SELECT query, doc_id, sum(prob * {_SAT}) AS score FROM post JOIN qd USING (term) JOIN idf USING (term) JOIN len USING (doc_id) WHERE field = '' GROUP BY ALL HAVING score > 0)",
]
_BM25F = [
    "qd AS (SELECT DISTINCT query, term FROM q)",
    """parts AS (SELECT query, doc_id, term, prob, sum(CASE field WHEN '' THEN tf / (0.25 + 0.75 * length / (SELECT a FROM avgs))
      ELSE 3.0 * tf / (0.25 + 0.75 * title_length / (SELECT t FROM avgs)) END) AS c
      FROM post JOIN qd USING (term) JOIN idf USING (term) JOIN len USING (doc_id) GROUP BY ALL)""",
    "bm25f AS (SELECT query, doc_id, sum(prob * c * 2.2 / (1.2 + c)) AS score FROM parts GROUP BY ALL HAVING score > 0)",
]
_SPAN = [
    "qd2 AS (SELECT DISTINCT query, term FROM q)",
    "kinds AS (SELECT query, count(*) AS n FROM qd2 GROUP BY query)",
    "places AS (SELECT query, doc_id, term, position FROM occ JOIN qd2 USING (term) WHERE field = '')",
    "whole AS (SELECT query, doc_id, n FROM places JOIN kinds USING (query) GROUP BY ALL HAVING count(DISTINCT term) = n)",
    # for each start, the farthest of the next places of all terms
    "starts AS (SELECT p.query, p.doc_id, n, p.position AS s FROM places p JOIN whole USING (query, doc_id))",
    "nexts AS (SELECT s.query, s.doc_id, s.n, s.s, p.term, min(p.position) AS nx FROM starts s JOIN places p ON p.query = s.query AND p.doc_id = s.doc_id AND p.position >= s.s GROUP BY ALL)",
    "spans AS (SELECT query, doc_id, n, min(w) AS span FROM (SELECT query, doc_id, n, max(nx) - s + 1 AS w FROM nexts GROUP BY query, doc_id, n, s HAVING count(*) = n) GROUP BY ALL)",
]
_PHRASE = [
    "size AS (SELECT query, count(DISTINCT off) AS n FROM q GROUP BY query)",
    "phrase AS (SELECT DISTINCT query, doc_id FROM (SELECT query, doc_id, position - off AS s, count(DISTINCT off) AS m FROM occ JOIN q USING (term) WHERE field = '' GROUP BY ALL) JOIN size USING (query) WHERE m = n)",
]


def _top(table: str, k: int = 10) -> str:
    return f"""SELECT query, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc_id)::INT AS rank, doc_id, round(score, 6) AS score
FROM {table} QUALIFY rank <= {k}"""


_RUN = [*_BM25, "run AS (" + _top("bm25") + ")"]
_QRELS = "rels AS (SELECT lower(trim(query)) AS query, doc_id, max(grade) AS grade FROM qrels WHERE grade >= 0 AND query IS NOT NULL AND doc_id IS NOT NULL GROUP BY ALL)"
_EVAL = [
    *_RUN,
    _QRELS,
    "hits AS (SELECT run.*, coalesce(grade, 0) AS grade, coalesce(grade > 0, false)::INT AS hit FROM run LEFT JOIN rels USING (query, doc_id))",
    "rel AS (SELECT query, sum((grade > 0)::INT) AS relevant FROM rels GROUP BY query)",
    "pr AS (SELECT rel.query, coalesce(sum(hit) / nullif(count(doc_id), 0), 0)::DOUBLE AS p, coalesce(sum(hit) / nullif(any_value(relevant), 0), 0)::DOUBLE AS r FROM rel LEFT JOIN hits USING (query) GROUP BY rel.query)",
    "ap AS (SELECT rel.query, coalesce(sum(CASE WHEN hit = 1 THEN so_far / rank END) / nullif(any_value(relevant), 0), 0)::DOUBLE AS v FROM rel LEFT JOIN (SELECT *, sum(hit) OVER (PARTITION BY query ORDER BY rank) AS so_far FROM hits) USING (query) GROUP BY rel.query)",
    "rr AS (SELECT rel.query, coalesce(1.0 / min(rank) FILTER (hit = 1), 0)::DOUBLE AS v FROM rel LEFT JOIN hits USING (query) GROUP BY rel.query)",
    "gain AS (SELECT rel.query, coalesce(sum(grade / log2(rank + 1)), 0)::DOUBLE AS v FROM rel LEFT JOIN hits USING (query) GROUP BY rel.query)",
    "ideal AS (SELECT query, sum(grade / log2(i + 1)) AS v FROM (SELECT query, grade, row_number() OVER (PARTITION BY query ORDER BY grade DESC, doc_id) AS i FROM rels) WHERE i <= 10 GROUP BY query)",
    "nd AS (SELECT gain.query, CASE WHEN ideal.v > 0 THEN gain.v / ideal.v ELSE 0 END AS v FROM gain JOIN ideal USING (query))",
]

_SYN = [
    "single AS (SELECT w, stems.term AS t FROM sides JOIN stems ON len(ts) = 1 AND token = ts[1])",
    "edges AS (SELECT a.t AS x, b.t AS y FROM synonyms s JOIN single a ON a.w = s.term JOIN single b ON b.w = s.member WHERE a.t <> b.t)",
    "reach AS (SELECT x AS term, y AS member FROM (SELECT x, y FROM edges UNION SELECT y, x FROM edges) UNION SELECT r.term, e.b FROM reach r JOIN (SELECT x AS a, y AS b FROM edges UNION SELECT y, x FROM edges) e ON e.a = r.member)",
    "grp AS (SELECT DISTINCT term, member FROM reach WHERE term <> member)",
]
# What is left of the constructed pages, written by hand.
_CLEANED = [
    "The mill of Orvane stands by the Tal.",
    "It has two floors.",
    "After the table.",
    "Corn was ground until 1901.",
    "The wheel It turned. Gear Of oak.",
    "The mill near the bridge in MaySeen from the east.",
    "See the survey and [https://mill.example/plain].",
    "Rye < wheat &amp; barley — all ground here .",
    "Open<!-- never closed",
    "An article that explains how #redirect lines work in a wiki.",
    "{{cut off|the mill and more",
    "a }} b ]] c |} d e",
    "shallow",
    "3 < 4 and 5 > 2, so x = y = z",
    "It is the miller's, not the bakers.",
    "and end",
    "a {{b c }} d",
    "plain text with gaps",
    "",
]
_PAGES = ", ".join("({}, '{}')".format(i, t.replace("'", "''")) for i, t in enumerate(_CLEANED, 1))
_WHITE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ARTICLE = f"coalesce(ns, 0) = 0 AND redirect IS NULL AND regexp_replace(coalesce(text, ''), '{_WHITE}', '', 'g') <> ''"
_TITLE = r"regexp_replace(coalesce(title, ''), '^\s+|\s+$', '', 'g')"

# the window of a passage: the terms of the text, stopwords gone, numbered; a window ends at b
_WINDOW = [
    *_RUN,
    f"ulists AS (SELECT doc_id, {tokens_of('text')} AS ts FROM docs WHERE doc_id IN (SELECT doc_id FROM run))",
    "utok AS (SELECT doc_id, unnest(range(len(ts)))::INT AS p, unnest(ts) AS token FROM ulists)",
    f"uterm AS (SELECT doc_id, term, (row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1)::INT AS i FROM utok JOIN stems USING (token) WHERE token NOT IN ({_STOP}))",
    "shown AS (SELECT r.query, r.rank, r.doc_id, u.i, u.term FROM run r JOIN uterm u USING (doc_id) JOIN (SELECT DISTINCT query, term FROM q) d ON d.query = r.query AND d.term = u.term)",
    "ends AS (SELECT a.query, a.doc_id, a.i AS b, count(DISTINCT c.term) AS kinds, count(*) AS hits FROM shown a JOIN shown c ON a.query = c.query AND a.doc_id = c.doc_id AND c.i BETWEEN a.i - 39 AND a.i GROUP BY ALL)",
    "bestw AS (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY query, doc_id ORDER BY kinds DESC, hits DESC, b) = 1)",
]
_GAP = [
    f"gl AS (SELECT {tokens_of('text')} AS ts FROM (SELECT DISTINCT coalesce(text, '') AS text FROM eval_items))",
    f"gr AS (SELECT list_filter(list_transform(range(1, len(ts) - 1), lambda i: [ts[i], ts[i + 1], ts[i + 2]]), lambda r: r[2] IN ({_STOP}) AND r[1] NOT IN ({_STOP}) AND r[3] NOT IN ({_STOP})) AS rs FROM gl WHERE len(ts) > 2)",
    "gq AS (SELECT DISTINCT rs[1][1] || ' ' || rs[1][2] || ' ' || rs[1][3] AS query, rs[1][1] AS x, rs[1][3] AS y FROM gr WHERE len(rs) > 0)",
    "gt AS (SELECT query, a.term AS x, b.term AS y FROM gq JOIN stems a ON a.token = gq.x JOIN stems b ON b.token = gq.y)",
]
_SIGN = [
    *_EVAL,
    *_TFIDF,
    "run2 AS (" + _top("tfidf") + ")",
    "hits2 AS (SELECT run2.*, coalesce(grade > 0, false)::INT AS hit FROM run2 LEFT JOIN rels USING (query, doc_id))",
    "ap2 AS (SELECT rel.query, coalesce(sum(CASE WHEN hit = 1 THEN so_far / rank END) / nullif(any_value(relevant), 0), 0)::DOUBLE AS v FROM rel LEFT JOIN (SELECT *, sum(hit) OVER (PARTITION BY query ORDER BY rank) AS so_far FROM hits2) USING (query) GROUP BY rel.query)",
    "wl AS (SELECT coalesce(sum((round(a.v, 9) > round(b.v, 9))::INT), 0)::BIGINT AS w, coalesce(sum((round(a.v, 9) < round(b.v, 9))::INT), 0)::BIGINT AS l, coalesce(sum((round(a.v, 9) = round(b.v, 9))::INT), 0)::BIGINT AS e FROM ap a JOIN ap2 b USING (query))",
]

_LOG = """
log AS (
  SELECT *, upper(trim(kind)) IN ('DELETE', '1') AS deleted
  FROM wal_records
  WHERE document_id IS NOT NULL AND upper(trim(kind)) IN ('ADD', '0', 'DELETE', '1')),
newest AS (
  SELECT * FROM log
  QUALIFY row_number() OVER (PARTITION BY document_id
    ORDER BY generation DESC NULLS LAST, seq DESC NULLS LAST, deleted DESC, title DESC NULLS LAST, text DESC NULLS LAST) = 1)
"""

ORACLES: dict[str, str] = {
    "p4_found": f"WITH {_LOG} SELECT document_id, generation, seq FROM newest WHERE NOT deleted",
    "p4_current": f"WITH {_LOG} SELECT document_id, coalesce(title, '') AS title, coalesce(text, '') AS text FROM newest WHERE NOT deleted",
    "tokenize": _with() + "SELECT doc_id, position, token FROM tokens WHERE field = ''",
    "token_counts_by_lang": _with() + "SELECT lang, count(*) AS tokens, count(DISTINCT token) AS distinct_tokens FROM tokens JOIN docs USING (doc_id) WHERE field = '' GROUP BY lang",
    "stopword_filter": _with() + f"SELECT doc_id, position, token FROM tokens WHERE field = '' AND token NOT IN ({_STOP})",
    "cjk_bigrams": _with() + f"SELECT token, count(*) AS n FROM tokens WHERE field = '' AND regexp_matches(token, '[{CJK}]') GROUP BY token",
    "stem_vocabulary": _with() + "SELECT DISTINCT token, term AS stem FROM stems WHERE token IN (SELECT token FROM tokens)",
    "analyze": _with() + "SELECT doc_id, position, term FROM occ WHERE field = ''",
    "postings": _with() + "SELECT term, field, doc_id, count(*)::INT AS tf, string_agg(position, ',' ORDER BY position) AS positions FROM occ GROUP BY ALL",
    "term_stats": _with() + "SELECT term, field, df, cf, max_tf::INT AS max_tf FROM ts",
    "doc_lengths": _with() + "SELECT doc_id, length, title_length FROM len",
    "corpus_stats": _with() + "SELECT n AS documents, round(a, 6) AS average_length, round(t, 6) AS average_title, m AS shortest FROM n, avgs",
    "derive_stopwords": _with() + "SELECT CASE field WHEN '' THEN term ELSE field || ':' || term END AS term, df FROM ts WHERE df >= 0.25 * (SELECT n FROM n)",
    "parse_queries": _with() + "SELECT query, length(query) > 1 AND query LIKE '\"%\"' AS is_phrase, off, term FROM q",
    "match_word": _with() + "SELECT DISTINCT query, doc_id FROM post JOIN q USING (term) WHERE field = '' AND query IN (SELECT query FROM q GROUP BY query HAVING count(*) = 1)",
    "match_any": _with(*_PHRASE) + "SELECT DISTINCT query, doc_id FROM post JOIN q USING (term) WHERE field = '' AND NOT (length(query) > 1 AND query LIKE '\"%\"') UNION SELECT query, doc_id FROM phrase WHERE length(query) > 1 AND query LIKE '\"%\"'",
    "match_phrase": _with(*_PHRASE) + "SELECT query, doc_id FROM phrase",
    "query_cost": _with() + "SELECT query, count(*) AS terms, (SELECT coalesce(sum(df), 0)::BIGINT FROM idf WHERE term IN (SELECT term FROM q b WHERE b.query = a.query)) AS cost FROM q a GROUP BY query",
    "rank_tfidf": _with(*_TFIDF) + _top("tfidf"),
    "rank_bm25": _with(*_BM25) + _top("bm25"),
    "rank_bm25f": _with(*_BM25F) + _top("bm25f"),
    "rank_bm25_permit": _with(*_BM25, "allowed AS (SELECT bm25.* FROM bm25 JOIN docs USING (doc_id) WHERE lang = 'en' AND source <> 'atlas-core')") + _top("allowed"),
    "rank_bm25_proximity": _with(*_BM25, *_SPAN, "near AS (SELECT query, doc_id, score * CASE WHEN span IS NULL OR k.n < 2 THEN 1 ELSE 1 + 0.3 * k.n / span END AS score FROM bm25 JOIN kinds k USING (query) LEFT JOIN spans USING (query, doc_id))") + _top("near"),
    "rank_pruned": _with(*_BM25) + _top("bm25"),
    "minimum_span": _with(*_SPAN) + "SELECT query, doc_id, span::INT AS span FROM spans",
    "bm25_upper_bounds": _with() + "SELECT term, round(prob * max_tf * 2.2 / (max_tf + 1.2 * (0.25 + 0.75 * (SELECT m / a FROM avgs))), 6) AS bound FROM idf JOIN ts USING (term) WHERE field = ''",
    "postings_blocks": _with() + "SELECT term, block_no, max(doc_id) AS last_document, count(*) AS document_count, max(tf)::INT AS max_tf FROM (SELECT term, doc_id, tf, (row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1) // 128 AS block_no FROM post WHERE field = '') GROUP BY ALL",
    "document_vector": _with() + "SELECT doc_id, term, round(CASE WHEN norm > 0 THEN tf * classic / norm ELSE 0 END, 6) AS weight FROM post JOIN idf USING (term) JOIN norm USING (doc_id) WHERE field = ''",
    "cosine_judged": _with(_QRELS, "best AS (SELECT query, doc_id FROM rels WHERE grade = 3)", "pairs AS (SELECT DISTINCT x.doc_id AS doc_id_a, y.doc_id AS doc_id_b FROM best x JOIN best y ON x.query = y.query AND x.doc_id < y.doc_id)",
        "vec AS (SELECT doc_id, term, CASE WHEN norm > 0 THEN tf * classic / norm ELSE 0 END AS w FROM post JOIN idf USING (term) JOIN norm USING (doc_id) WHERE field = '')",
        "dots AS (SELECT doc_id_a, doc_id_b, sum(x.w * y.w) AS d FROM pairs JOIN vec x ON x.doc_id = doc_id_a JOIN vec y ON y.doc_id = doc_id_b AND y.term = x.term GROUP BY ALL)")
        + "SELECT doc_id_a, doc_id_b, round(coalesce(d, 0), 6) AS cosine FROM pairs LEFT JOIN dots USING (doc_id_a, doc_id_b)",
    "precision_recall_at_k": _with(*_EVAL) + "SELECT query, round(p, 6) AS precision, round(r, 6) AS recall FROM pr",
    "average_precision": _with(*_EVAL) + "SELECT query, round(v, 6) AS value FROM ap",
    "mrr": _with(*_EVAL) + "SELECT query, round(v, 6) AS value FROM rr",
    "ndcg": _with(*_EVAL) + "SELECT query, round(v, 6) AS value FROM nd",
    "map_summary": _with(*_EVAL) + "SELECT count(*) AS queries, round(avg(ap.v), 6) AS map, round(avg(rr.v), 6) AS mrr, round(avg(nd.v), 6) AS ndcg, round(avg(p), 6) AS precision FROM ap JOIN rr USING (query) JOIN nd USING (query) JOIN pr USING (query)",
    "synonym_groups": _with(*_SYN).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT term, member FROM grp",
    "synonym_match": _with(*_SYN).replace("WITH ", "WITH RECURSIVE ", 1)
    + "SELECT DISTINCT query, doc_id FROM post JOIN (SELECT query, term FROM q UNION SELECT query, member FROM q JOIN grp USING (term)) USING (term) WHERE field = '' AND NOT (length(query) > 1 AND query LIKE '\"%\"')",
    "merge_segments": _with() + "SELECT term, field, df, cf, max_tf::INT AS max_tf FROM ts",
    "directory_df": _with() + "SELECT term, count(*) AS df FROM post JOIN docs USING (doc_id) WHERE field = '' AND lang IS DISTINCT FROM 'fr' GROUP BY term",
    "upsert_latest": f"""WITH {_LOG}, cur AS (SELECT document_id AS doc_id, coalesce(title, '') AS title, coalesce(text, '') AS text FROM newest WHERE NOT deleted)
      SELECT * FROM cur UNION ALL SELECT doc_id, coalesce(title, ''), coalesce(text, '') FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM cur)""",
    "dump_articles": f"SELECT DISTINCT revision_id, article_id, {_TITLE} AS title FROM articles WHERE {_ARTICLE}",
    "dump_pages": f"SELECT article_id AS doc_id, {_TITLE} AS title FROM articles WHERE revision_id IS NOT NULL AND {_ARTICLE}",
    "wiki_clean": f"SELECT page::INT AS page, text FROM (VALUES {_PAGES}) t(page, text)",
    "corpus_pages": f"SELECT doc_id, {_TITLE} AS title, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL",
    "judgement_file": f"WITH {_QRELS} SELECT query, doc_id, grade FROM rels WHERE query <> ''",
    "synonym_file": _with(*_SYN).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT term, member FROM grp",
    "ingest_stream": _with() + "SELECT term, field, df, cf, max_tf::INT AS max_tf FROM ts",
    "index_text": _with() + "SELECT o.term, o.doc_id, count(*)::INT AS tf, any_value(l.length)::INT AS length, string_agg(position, ',' ORDER BY position) AS positions FROM occ o JOIN len l USING (doc_id) WHERE field = '' GROUP BY o.term, o.doc_id",
    "snippet_window": _with(*_WINDOW) + "SELECT r.query, r.rank, r.doc_id, coalesce(greatest(b - 39, 0), 0)::INT AS first, coalesce(kinds, 0)::INT AS kinds, coalesce(hits, 0)::INT AS hits FROM run r LEFT JOIN bestw w ON w.query = r.query AND w.doc_id = r.doc_id",
    "match_phrase_with_stopword_gap": _with(*_GAP) + "SELECT DISTINCT gt.query, a.doc_id FROM gt JOIN occ a ON a.term = gt.x AND a.field = '' JOIN occ b ON b.term = gt.y AND b.field = '' AND b.doc_id = a.doc_id AND b.position = a.position + 2",
    "refused_queries": _with() + "SELECT *, CASE WHEN terms > 2 THEN 'terms' ELSE 'cost' END AS reason FROM (SELECT query, count(*) AS terms, (SELECT coalesce(sum(df), 0)::BIGINT FROM idf WHERE term IN (SELECT term FROM q b WHERE b.query = a.query)) AS cost FROM q a GROUP BY query) WHERE terms > 2 OR cost > 100",
    "sign_test": _with(*_SIGN) + "SELECT w AS wins, l AS losses, e AS ties, CASE WHEN w + l = 0 THEN 1.0 ELSE round(least(1, 2 * list_sum(list_transform(range(0, least(w, l) + 1), lambda i: exp(lgamma(w + l + 1) - lgamma(i + 1) - lgamma(w + l - i + 1) - (w + l) * ln(2))))), 6) END AS probability FROM wl",
    "p4_replayed": f"WITH {_LOG} SELECT document_id, generation, seq FROM newest WHERE NOT deleted",
    # each pair's other letters become signs that no term has, so that bytes are code points
    "suggest": _with("asked AS (SELECT DISTINCT term FROM q UNION SELECT DISTINCT 'x' || term || 'q' FROM q WHERE length(term) > 3)",
        "pairs AS (SELECT m.term, i.term AS candidate, df, array_to_string(list_distinct(regexp_extract_all(m.term || i.term, '[^\\x00-\\x7F]')), '') AS other FROM asked m JOIN idf i ON abs(length(m.term) - length(i.term)) <= 2 WHERE m.term NOT IN (SELECT term FROM idf))",
        "near AS (SELECT term, candidate, levenshtein(translate(term, other, left(signs, length(other))), translate(candidate, other, left(signs, length(other)))) AS distance, df FROM pairs, (SELECT string_agg(chr(n::INT), '' ORDER BY n) AS signs FROM range(1, 97) r(n) WHERE n NOT BETWEEN 48 AND 57))")
        + "SELECT term, candidate, distance::INT AS distance, df FROM near WHERE distance <= 2 QUALIFY row_number() OVER (PARTITION BY term ORDER BY distance, df DESC, candidate) <= 3",
}
