"""The queries of this subpackage, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from tessella.llm import bpe, decontam, htmlx, jaccard, langid, linedup, lmscore, quality, repeats, urlfilter

_WORDS = r"regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+')"

_REPEATS = f"""WITH w AS (SELECT DISTINCT doc_id, text, {_WORDS} AS ws FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {repeats.LEAST - 2})) AS i FROM w WHERE len(ws) >= {repeats.LEAST}),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + {repeats.LEAST - 1}], ' ')) AS h FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM g) WHERE c > 1),
s AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT doc_id, i, (i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {repeats.LEAST}, 0))::INT AS new FROM r)),
t AS (SELECT doc_id, (min(i) - 1)::INT AS first, (max(i) + {repeats.LEAST - 1})::INT AS last FROM s GROUP BY doc_id, k)
SELECT doc_id, list(first ORDER BY first) AS first_word, list(last ORDER BY first) AS end_word, sum(last - first)::INT AS words FROM t GROUP BY doc_id"""

_NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents WHERE doc_id IS NOT NULL),
g AS MATERIALIZED (SELECT DISTINCT doc_id, h FROM (
  SELECT doc_id, array_to_string(ws[i:i + {jaccard.N - 1}], ' ') AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {jaccard.N - 2})) AS i FROM w WHERE len(ws) >= {jaccard.N})
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND {jaccard.N - 1})),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE c >= {jaccard.THRESHOLD} * (x.n + y.n - c)),
u AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(id, k) AS (SELECT a, a FROM u UNION SELECT r.id, u.b FROM reach r JOIN u ON r.k = u.a),
m AS (SELECT id, min(k) AS group_id FROM reach GROUP BY id),
d AS (SELECT a AS id, count(*) AS links FROM u GROUP BY a)
SELECT id AS doc_id, group_id, links FROM m JOIN d USING (id)"""


def queries() -> dict:
    return {
        "op1_lm_scoring": lmscore.query,
        "op2_quality_rules": quality.query,
        "op3_line_dedup": linedup.query,
        "op4_bpe": bpe.query,
        "op5_decontamination": decontam.query,
        "op6_html_extraction": htmlx.query,
        "op7_suffix_array_dedup": repeats.query,
        "op8_ngram_jaccard": jaccard.query,
        "op9_url_filter": urlfilter.query,
        "op10_language_id": langid.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_suffix_array_dedup": _REPEATS, "op8_ngram_jaccard": _NEAR}
