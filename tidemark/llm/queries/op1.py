import math

from ..common import table
from ..license_scan import PHRASES, scan, template_words

THRESHOLD = 0.8


def query(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"), threshold=THRESHOLD)


def _places(phrase: str) -> str:
    test = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))
    return f"[i for i in range(1, len(w) + 1) if {test}]"


_TEMPLATES = ", ".join(
    f"({k}, '{label}', [{', '.join(f"'{x}'" for x in words)}], {math.ceil(THRESHOLD * len(words) - 1e-9)})"
    for k, (label, words) in enumerate(template_words()))

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
p AS (SELECT r, doc_id, len(w) AS n_words, {', '.join(f'{_places(p)} AS "{v}"' for p, v in PHRASES.items())} FROM w),
b AS (SELECT *, {' || '.join(f'"{v}"' for v in PHRASES.values())} AS places,
  [x for x in [{', '.join(f"""CASE WHEN len("{v}") > 0 THEN '{v}' END""" for v in PHRASES.values())}] if x IS NOT NULL] AS base FROM p),
paras AS (SELECT r, p, ps[p] AS para FROM (SELECT r, ps, unnest(range(1, len(ps) + 1)) AS p FROM
  (SELECT r, regexp_split_to_array(text, '\n{_GAP}*\n') AS ps FROM d))),
lines AS (SELECT r, p, n, list_distinct(regexp_extract_all(lower(ls[n]), '{_WORD}')) AS ws
  FROM (SELECT r, p, ls, unnest(range(1, len(ls) + 1)) AS n FROM (SELECT r, p, string_split(para, chr(10)) AS ls FROM paras))),
t(k, label, own, need) AS (VALUES {_TEMPLATES}),
ml AS (SELECT r, p, n, k, label, len(list_intersect(own, ws))::DOUBLE / len(own) AS c FROM lines, t WHERE len(list_intersect(own, ws)) >= need),
pw AS (SELECT r, p, list_distinct(regexp_extract_all(lower(para), '{_WORD}')) AS ws FROM paras),
mp AS (SELECT r, p, -1 AS n, k, label, len(list_intersect(own, ws))::DOUBLE / len(own) AS c FROM pw, t WHERE len(list_intersect(own, ws)) >= need),
m AS (SELECT * FROM ml UNION ALL SELECT * FROM mp ANTI JOIN ml USING (r, p, k)),
g AS (SELECT r, list(DISTINCT label) AS more, max(c) AS best, count(DISTINCT p || ':' || n) AS n_blocks FROM m GROUP BY r)
SELECT doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base, (list_min(places) - 1)::BIGINT AS first_word,
  (list_max(places) - 1)::BIGINT AS last_word, coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(base || coalesce(more, []))), ','), '') AS labels,
  CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score, coalesce(n_blocks, 0)::BIGINT AS n_blocks
FROM b LEFT JOIN g USING (r)
"""
