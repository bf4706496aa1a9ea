from ..common import table
from ..decontaminate import search

THRESHOLD = 0.8


def query(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), threshold=THRESHOLD)


_WORDS = r"regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _grams(widths: str) -> str:
    return f"SELECT DISTINCT r, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM {widths})"


# An item of fewer than five words is one shingle of its own width.
SQL = rf"""
WITH bw AS (SELECT row_number() OVER () AS r, item_id, w, least(len(w), 5) AS k
  FROM (SELECT item_id, {_WORDS} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark) WHERE item_id IS NOT NULL) WHERE len(w) > 0),
dw AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM (SELECT DISTINCT doc_id, text FROM documents)),
b AS ({_grams('bw')}),
d AS ({_grams('(SELECT dw.r, k, w FROM dw, (SELECT DISTINCT k FROM bw))')}),
n AS (SELECT r, count(*) AS n FROM b GROUP BY r),
s AS (SELECT d.r AS dr, b.r, count(*) AS c FROM d JOIN b USING (k, g) GROUP BY ALL)
SELECT doc_id, item_id, n::BIGINT AS n_shingles, c::BIGINT AS n_shared, c::DOUBLE / n AS containment
FROM s JOIN n USING (r) JOIN bw USING (r) JOIN dw ON dw.r = s.dr WHERE c::DOUBLE / n >= {THRESHOLD}
"""
