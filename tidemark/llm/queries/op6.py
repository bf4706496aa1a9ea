from ..common import table
from ..quality_rules import RULES, apply_rules

ALPHA = DELTA = 0.05
GOOD_COST = 20.0


def query(spark, sf_dir):
    found = apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), alpha=ALPHA, delta=DELTA, good_cost=GOOD_COST)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _grid() -> str:
    return ", ".join(f"('{r}', {i}, {c!r}::DOUBLE)" for r, grid in RULES.items() for i, c in enumerate(grid))


SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, chr(1)) AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, stratum, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
  [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM t),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM w)),
twice AS (SELECT r, g FROM win GROUP BY r, g HAVING count(*) > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM win JOIN twice USING (r, g)) GROUP BY r),
s AS (SELECT r, doc_id, stratum, len(w)::BIGINT AS n_words, length(list_aggregate(w, 'string_agg', ''))::BIGINT AS wc,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(ls) AS n_lines,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (r)),
v AS (SELECT *, coalesce(wc, 0) AS word_chars, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  n_symbols::DOUBLE / greatest(n_words, 1) AS symbols_per_word, n_repeat_words::DOUBLE / greatest(n_words, 1) AS repeat_share,
  n_dup_lines::DOUBLE / greatest(n_lines, 1) AS dup_lines_share, coalesce(wc, 0)::DOUBLE / greatest(n_words, 1) AS mean_word_chars FROM s),
long AS (SELECT r, doc_id, stratum, base_failed, unnest([
  {', '.join(f"{{'rule': '{r}', 'v': {r}}}" for r in RULES)}], recursive := true) FROM v),
known AS (SELECT doc_id, max(quality) >= 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
grid(rule, i, cutoff) AS (VALUES {_grid()}),
cells AS (SELECT stratum, rule, i, cutoff, sum(good::INT) AS n_good, sum((NOT good)::INT) AS n_bad,
  sum((v > cutoff AND good)::INT) AS k, sum((v > cutoff AND NOT good)::INT) AS bad
  FROM long JOIN known USING (doc_id) JOIN grid USING (rule) WHERE NOT base_failed GROUP BY ALL),
tail AS (SELECT stratum, rule, i, sum(exp(lgamma(n_good + 1) - lgamma(j + 1) - lgamma(n_good - j + 1)
    + j * ln({ALPHA / len(RULES)}) + (n_good - j) * ln(1 - {ALPHA / len(RULES)}))) AS p
  FROM (SELECT *, unnest(range(0, k::BIGINT + 1)) AS j FROM cells WHERE k < n_good * {ALPHA / len(RULES)}) GROUP BY ALL),
ok AS (SELECT *, bad / greatest(n_bad, 1) - {GOOD_COST} * k / greatest(n_good, 1) AS gain FROM cells JOIN tail USING (stratum, rule, i)
  WHERE p <= {DELTA} / ({len(RULES)} * (SELECT count(DISTINCT stratum) FROM cells)) AND bad / greatest(n_bad, 1) > {GOOD_COST} * k / greatest(n_good, 1)),
cut AS (SELECT stratum, rule, first(cutoff ORDER BY gain DESC, i) AS cutoff FROM ok GROUP BY ALL),
hit AS (SELECT DISTINCT r FROM long JOIN cut USING (stratum, rule) WHERE v > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (r IN (SELECT r FROM hit)) AS kept FROM v
"""
