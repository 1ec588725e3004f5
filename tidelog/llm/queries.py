"""The registered queries of the corpus operators and their DuckDB SQL.

Each applies an operator to its whole table. What nulls, empty and long texts, repeated rows, ties and empty tables
give is said at the function that it calls.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import byte_bpe, decontaminate, language_id, line_dedup, lm_score, quality, secrets, simhash_dedup, url_filter, warc
from tidelog.llm.url_filter import DAMPING, LEAST_DISTRUST, LINK, LOWER, MARGIN, RULES, TIE, UPPER, URL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and the groups within two bits, by Golay-code keys."""
    return simhash_dedup.op3_query(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures, and documents that line frequency by host leaves."""
    return quality.op4_query(_table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the byte and the word model."""
    return lm_score.op9_query(_table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of rules, and of trust and distrust over links."""
    return url_filter.op5_query(_table(spark, sf_dir, "pages"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of an archive that is written, read and rebuilt."""
    return warc.op10_query(_table(spark, sf_dir, "pages"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets by patterns and by Markov models."""
    return secrets.op6_query(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages by the recurrent network."""
    return language_id.op2_query(_table(spark, sf_dir, "documents"))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of whole texts, and what they decode to."""
    return byte_bpe.op1_query(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that repeat, equal or nearly so."""
    return line_dedup.op7_query(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that texts hold."""
    return decontaminate.op8_query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_language_id": op2_language_id,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_url_filters": op5_url_filters,
    "op6_secret_scans": op6_secret_scans,
    "op7_line_dedup": op7_line_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_warc": op10_warc,
}

WORDS = r"'[^\x20\x09-\x0D]+'"
A_Z = f"'{UPPER}', '{LOWER}'"

#: Lines by (document, host), words of each; windows of eight words found twice or more; lines that over 20 texts of a host have.
QUALITY = f"""WITH w AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {WORDS}) AS ws FROM documents),
ln AS (SELECT r, source, t, line, regexp_extract_all(line, {WORDS}) AS lw FROM (SELECT r, source, t, unnest(string_split(t, chr(10))) AS line FROM w)),
lk AS (SELECT r, source, t, line, len(lw) AS n, translate(array_to_string(lw, ' '), {A_Z}) AS k FROM ln WHERE len(lw) > 0),
often AS (SELECT source, k FROM lk GROUP BY source, k HAVING count(DISTINCT t) > {quality.LINE_DOCS}),
gone AS (SELECT r, sum(n) AS n, count(*) AS c FROM lk JOIN often o ON o.source IS NOT DISTINCT FROM lk.source AND o.k = lk.k GROUP BY r),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lk GROUP BY r),
win AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS x FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM (SELECT *, count(*) OVER (PARTITION BY r, x) AS c FROM win), range(8) t(j) WHERE c > 1 GROUP BY r),
m AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS lost, coalesce(gone.c, 0) AS n_removed_lines
  FROM w LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR n_words - lost < {quality.LEAST_LEFT} * n_words) AS kept, n_removed_lines FROM m"""


def _url_sql() -> str:
    longest = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r))
    case = lambda what: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{what(h, p, v)}'" for h, p, v in longest) + " END"
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    own, unit = repr(1 - DAMPING), "{0} * {1} / " + repr(1 - DAMPING)
    share = lambda v: f"avg(CASE WHEN ruled = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
    return f"""WITH RECURSIVE u AS (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), {quoted(URL)}, 1), {A_Z}) AS host, regexp_extract(coalesce(url, ''), {quoted(URL)}, 2) AS path FROM pages),
j AS (SELECT *, {case(lambda h, p, v: h + p)} AS rule, {case(lambda h, p, v: v)} AS ruled FROM u),
sd AS (SELECT host, {share('allow')} AS good, {share('block')} AS bad FROM j WHERE host <> '' GROUP BY host), tot AS (SELECT coalesce(sum(good), 0) AS g, coalesce(sum(bad), 0) AS b FROM sd),
ed AS (SELECT src, dst, count(*) AS w FROM (SELECT host AS src, translate(unnest(regexp_extract_all(coalesce(html, ''), {quoted(LINK)}, 1)), {A_Z}) AS dst FROM u) WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL),
sh AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p, w / sum(w) OVER (PARTITION BY dst) AS q FROM ed),
ns AS (SELECT host, coalesce(good, 0) / greatest(g, 1e-300) AS good, coalesce(bad, 0) / greatest(b, 1e-300) AS bad FROM (SELECT host FROM sd UNION SELECT src FROM sh UNION SELECT dst FROM sh) LEFT JOIN sd USING (host), tot),
rk AS (SELECT host, good, bad, good * {own} AS t, bad * {own} AS d, 0 AS n FROM ns UNION ALL
  SELECT r.host, good, bad, good * {own} + {DAMPING} * coalesce(a.t, 0), bad * {own} + {DAMPING} * coalesce(z.d, 0), n + 1
  FROM rk r LEFT JOIN (SELECT dst, sum(t * p) AS t FROM rk JOIN sh ON src = host GROUP BY dst) a ON a.dst = r.host LEFT JOIN (SELECT src, sum(d * q) AS d FROM rk JOIN sh ON dst = host GROUP BY src) z ON z.src = r.host WHERE n < 60)
SELECT page_id, j.host, path, rule, coalesce(ruled, CASE WHEN {unit.format('d', 'b')} > {LEAST_DISTRUST} AND {unit.format('d', 'b')} > {MARGIN} * ({unit.format('t', 'g')}) + {TIE} THEN 'block' END, 'allow') AS verdict
FROM j LEFT JOIN (SELECT * FROM rk WHERE n = 60) k ON k.host = j.host, tot"""


ARCHIVE = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages), q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS latest FROM p),
r AS (SELECT *, payload_bytes >= {warc.LEAST_REVISIT} AND latest IS NOT NULL AND page_id IS DISTINCT FROM latest AS again FROM q)
SELECT page_id, payload_bytes, sha1(h) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN latest END AS refers_to, true AS intact FROM r"""

#: SQL has no such tokenizer, network, hash of shingles, Markov model, edit similarity over blocks or trie; those queries are tested by brute force.
ORACLES: dict[str, str] = {"op4_quality_rules": QUALITY, "op5_url_filters": _url_sql(), "op10_warc": ARCHIVE}
