"""The queries of this subpackage in DuckDB's SQL, where SQL can express them."""

from __future__ import annotations

from .glyphs import BLANKS, INVISIBLE, LOOKALIKE, STYLED

_LOOK, _LATIN = "".join(LOOKALIKE), "".join(LOOKALIKE.values())


def _escaped(s: str) -> str:
    """s for a DuckDB regular expression's character class."""
    return "".join(f"\\x{{{ord(c):X}}}" for c in s)


def _text(s: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in s)


P3 = rf"""
WITH v AS (
  SELECT 'word.logical' AS src_field, word_id AS row_id, logical AS value FROM word
  UNION ALL SELECT 'word.logical_norm', word_id, logical_norm FROM word
  UNION ALL SELECT 'term.logical', term_id, logical FROM term),
shown AS (
  SELECT *, nfc_normalize(translate(value, {_text(''.join(STYLED))} || {_text(BLANKS)} || {_text(INVISIBLE)}, '{''.join(STYLED.values())}' || repeat(' ', {len(BLANKS)}))) AS s
  FROM v WHERE value IS NOT NULL),
latin AS (
  SELECT src_field, row_id, value, trim(regexp_replace(list_aggregate(list_transform(
    regexp_extract_all(s, '[A-Za-z\x{{C0}}-\x{{24F}}{_escaped(_LOOK)}]+|[^A-Za-z\x{{C0}}-\x{{24F}}{_escaped(_LOOK)}]+'),
    lambda r: CASE WHEN regexp_full_match(r, '[A-Za-z\x{{C0}}-\x{{24F}}{_escaped(_LOOK)}]{{2,}}') THEN translate(r, '{_LOOK}', '{_LATIN}') ELSE r END), 'string_agg', ''), ' +', ' ', 'g')) AS clean_text
  FROM shown)
SELECT src_field, row_id, clean_text FROM latin WHERE clean_text <> '' AND value <> clean_text
"""

P5 = """
WITH t AS (
  SELECT 'morpheme_result.tokens' AS src_field, attr_id AS rec, unnest(tokens) AS term FROM morpheme_result
  UNION ALL SELECT 'token_match.frag', rec_id, frag FROM token_match),
k AS (SELECT src_field, rec, upper(trim(nfc_normalize(term))) AS term_key FROM t WHERE term IS NOT NULL),
g AS (SELECT * FROM k WHERE term_key <> ''),
n AS (SELECT src_field, count(DISTINCT rec) AS records FROM g GROUP BY src_field),
c AS (SELECT src_field, term_key, count(*) AS n_occ, count(DISTINCT rec) AS n_rec FROM g GROUP BY src_field, term_key)
SELECT c.src_field, term_key, n_occ, n_rec,
  CASE WHEN n_rec < 3 THEN 'rare' WHEN n_rec > 0.03 * records THEN 'common' ELSE 'usual' END AS freq_mark
FROM c JOIN n USING (src_field)
"""

SQL = {"p3_found": P3, "p5_found": P5}
