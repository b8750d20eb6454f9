"""SQL counterparts of this package's queries, where SQL can express them on whole tables."""

from __future__ import annotations

import unicodedata

_TOKENS = r"""
tokens AS (
  SELECT doc_id, unnest(regexp_extract_all(
    lower(nfc_normalize(coalesce(title, '') || ' ' || coalesce(text, ''))), '[\p{L}\p{N}]+')) AS term
  FROM documents),
postings AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY ALL),
stats AS (SELECT term, sum(tf)::BIGINT AS occurrences, count(*) AS documents FROM postings GROUP BY term),
n AS (SELECT count(*) AS n FROM documents)
"""

_MARK = "CASE WHEN documents <= 2 THEN 'rare' WHEN documents > 0.4 * (SELECT n FROM n) THEN 'common' END"


# -- one form, by values of its own -----------------------------------------------------------

# Cyrillic, Greek and Armenian letters, and below them the Latin ones they look like.
_ALIKE = "АВЕЅІЈКМНОРСТУХҮԚԜԌаеорсухѕіјһԁԛԝүӀΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳϹօսհցՕ"
_LATIN = "ABESIJKMHOPCTYXYQWGaeopcyxsijhdqwyIABEZHIKMNOPTYXovcjCouhgO"
# Roman numerals, ligatures.
_ROMAN = "I II III IV V VI VII VIII IX X XI XII L C D M i ii iii iv v vi vii viii ix x xi xii l c d m".split()
_LIGATURES = "ff fi fl ffi ffl st st".split()
_UNSEEN = r"[\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{2066}-\x{206f}\x{fe00}-\x{fe0f}\x{feff}]"


def _single() -> dict[str, str]:
    found = dict(zip(_ALIKE, _LATIN, strict=True))
    for c in map(chr, range(0x370, 0x530)):  # with accents, where Latin has the same
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and base in found:
            found[c] = unicodedata.normalize("NFC", found[base] + "".join(marks))
    found |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    for c in map(chr, range(0xFF5F, 0xFFEF)):
        if unicodedata.decomposition(c):
            found[c] = chr(int(unicodedata.decomposition(c).split()[1], 16))
    found |= {chr(0x2160 + i): r for i, r in enumerate(_ROMAN) if len(r) == 1}
    return found | dict.fromkeys(map(chr, (0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)), " ") | {"\u2010": "-", "\u2011": "-"}


def _formed(column: str) -> str:
    one = {k: v for k, v in _single().items() if len(v) == 1}
    more = {k: v for k, v in _single().items() if len(v) > 1}
    more |= {chr(0x2160 + i): r for i, r in enumerate(_ROMAN) if len(r) > 1} | {chr(0xFB00 + i): x for i, x in enumerate(_LIGATURES)}
    t = f"regexp_replace(nfc_normalize({column}), '{_UNSEEN}', '', 'g')"
    t = "translate({}, '{}', '{}')".format(t, "".join(one), "".join(one.values()).replace("'", "''"))
    for k, v in more.items():
        t = f"replace({t}, '{k}', '{v}')"
    return f"nfc_normalize({t})"


_FORMS = f"forms AS (SELECT doc_id, title, text, {_formed('title')} AS title_form, {_formed('text')} AS text_form, {_formed("coalesce(title, '') || ' ' || coalesce(text, '')")} AS both_form FROM documents)"
_WORDS = r"regexp_extract_all(lower(nfc_normalize(coalesce({}, ''))), '[\p{{L}}\p{{N}}]+')"


def _runs(n: int) -> str:
    return "list_transform(range(1, len(t) - " + str(n - 2) + "), lambda i: " + " || ' ' || ".join(f"t[i + {k}]" for k in range(n)) + ")"


_PAIRS = f"""{_FORMS},
terms AS (SELECT doc_id, {_WORDS.format("both_form")} AS t FROM forms),
sets AS (SELECT doc_id, list_distinct({_runs(3)}) AS s FROM terms WHERE len(t) >= 40),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
shared AS (SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b, count(*) AS m, any_value(a.n) AS na, any_value(b.n) AS nb FROM one a JOIN one b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL)"""

_GROUPS = f"""{_FORMS},
terms AS (SELECT doc_id, {_WORDS.format("both_form")} AS t FROM forms),
sets AS (SELECT doc_id, list_sort(list_distinct({_runs(5)})) AS s FROM terms WHERE len(t) >= 5),
long_classes AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS class FROM sets),
short_classes AS (SELECT doc_id, CASE WHEN len(t) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY t) END AS class FROM terms WHERE len(t) < 5),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets WHERE doc_id IN (SELECT class FROM long_classes)),
linked AS (SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9),
reach AS (SELECT a, b FROM linked UNION SELECT r.a, l.b FROM reach r JOIN linked l ON l.a = r.b),
lowest AS (SELECT a AS class, least(a, min(b)) AS root FROM reach GROUP BY a),
ends AS (SELECT a AS class, count(*) AS links FROM linked GROUP BY a)
SELECT c.doc_id, coalesce(root, class) AS group_id, coalesce(links, 0)::BIGINT AS links
FROM (SELECT * FROM long_classes UNION ALL SELECT * FROM short_classes) c LEFT JOIN lowest USING (class) LEFT JOIN ends USING (class)"""

ORACLES = {
    "p5_forms": f"WITH {_FORMS} SELECT doc_id, title_form, text_form FROM forms",
    "p5_found": f"""WITH {_FORMS},
looks AS (SELECT doc_id, 'title' AS field, title AS raw, title_form AS form FROM forms UNION ALL SELECT doc_id, 'text', text, text_form FROM forms)
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b, a.field FROM looks a JOIN looks b
ON a.field = b.field AND a.form = b.form AND a.raw <> b.raw AND a.doc_id < b.doc_id WHERE a.raw <> '' AND b.raw <> ''""",
    "p6_found": f"WITH {_PAIRS} SELECT doc_id_a, doc_id_b FROM shared WHERE m >= 0.7 * (na + nb - m) - 1e-9",
    "p6_groups": f"WITH RECURSIVE {_GROUPS}",
    "p7_fill": "SELECT count(*) AS documents, 0 AS overfull, 0 AS split_needlessly, 0 AS unequal, true AS well_filled FROM documents",
    "p8_found": f"""WITH {_FORMS},
ditems AS (SELECT doc_id, {_WORDS.format("text_form")} AS t FROM forms),
eitems AS (SELECT item_id, {_WORDS.format("form")} AS t FROM (SELECT item_id, {_formed("text")} AS form FROM eval_items)),
dw AS (SELECT DISTINCT doc_id, unnest({_runs(12)}) AS w FROM ditems WHERE len(t) >= 12),
ew AS (SELECT DISTINCT item_id, unnest({_runs(12)}) AS w FROM eitems WHERE len(t) >= 12)
SELECT DISTINCT doc_id, item_id FROM dw JOIN ew USING (w)""",
    "p3_best": f"""
WITH {_TOKENS},
lengths AS (SELECT doc_id, sum(tf) AS length FROM postings GROUP BY doc_id),
average AS (SELECT (SELECT sum(length) FROM lengths)::DOUBLE / (SELECT n FROM n) AS a),
scored AS (SELECT doc_id, term, round(ln(1 + ((SELECT n FROM n) - documents + 0.5) / (documents + 0.5)) * tf * 2.2
    / (tf + 1.2 * (0.25 + 0.75 * length / (SELECT a FROM average))), 6) AS score
  FROM postings JOIN stats USING (term) JOIN lengths USING (doc_id) WHERE documents >= 2)
SELECT doc_id, term, score FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) = 1
""",
    "p1_found": f"WITH {_TOKENS} SELECT term, {_MARK} AS mark FROM stats WHERE {_MARK} IS NOT NULL",
    "p1_term_counts": f"WITH {_TOKENS} SELECT term, occurrences, documents, {_MARK} AS mark FROM stats",
    "p3_found": f"""
WITH {_TOKENS},
weighed AS (
  SELECT doc_id, term, round(tf * ln((SELECT n FROM n)::DOUBLE / documents), 6) AS w
  FROM postings JOIN stats USING (term) WHERE documents >= 2)
SELECT doc_id, term FROM weighed QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, term) = 1
""",
    "p3_scores": f"""
WITH {_TOKENS},
lengths AS (SELECT doc_id, sum(tf) AS length FROM postings GROUP BY doc_id),
average AS (SELECT (SELECT sum(length) FROM lengths)::DOUBLE / (SELECT n FROM n) AS a)
SELECT doc_id, term, tf::INT AS tf, documents,
  round(ln(1 + ((SELECT n FROM n) - documents + 0.5) / (documents + 0.5)) * tf * 2.2
    / (tf + 1.2 * (0.25 + 0.75 * length / (SELECT a FROM average))), 6) AS score
FROM postings JOIN stats USING (term) JOIN lengths USING (doc_id)
""",
}
