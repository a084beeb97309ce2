"""The queries of the text operators and, where SQL can express one, the same query in DuckDB's SQL.

DuckDB has no seeded XXH64 (op2), no CRC-32 (op7, op10), neither tokenizer (op9, op10), and no way to say op5's and op8's own
detections but their hundreds of patterns over again: these are held against brute force in tests/llm.
"""

from __future__ import annotations

from . import byte_bpe, decontaminate, license_scan, line_dedup, lm_score, pii, quality, simhash, token_files, warc

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "quality_ablation": quality.quality_ablation,
    "op2_simhash": simhash.op2_simhash,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_warc": warc.op4_warc,
    "op5_pii": pii.op5_pii,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_lm_score": lm_score.op7_lm_score,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_byte_bpe": byte_bpe.op9_byte_bpe,
    "op10_token_files": token_files.op10_token_files,
}

_DECONTAMINATE = r"""
WITH t AS (SELECT 'd' AS kind, doc_id::VARCHAR AS id, text FROM documents UNION ALL SELECT 'b', item_id::VARCHAR, text FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS x FROM t),
i AS (SELECT id, x, least(10, len(x)) AS k FROM w WHERE kind = 'b' AND len(x) > 0),
b AS (SELECT DISTINCT id AS item, k, array_to_string(x[s:s + k - 1], ' ') AS words FROM (SELECT *, unnest(range(1, len(x) - k + 2)) AS s FROM i)),
d AS (SELECT id, k, s, array_to_string(x[s:s + k - 1], ' ') AS words FROM (SELECT id, x, k, unnest(range(1, len(x) - k + 2)) AS s FROM w, (SELECT DISTINCT k FROM b) WHERE kind = 'd' AND len(x) >= k)),
h AS (SELECT d.id, d.s, d.k, b.item FROM d JOIN b ON d.words = b.words AND d.k = b.k),
p AS (SELECT id, count(DISTINCT place) AS n FROM (SELECT id, unnest(range(s, s + k)) AS place FROM h) GROUP BY id),
m AS (SELECT id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY id)
SELECT id::BIGINT AS doc_id, len(x)::BIGINT AS n_words, coalesce(p.n, 0)::BIGINT AS n_hit, coalesce(m.n, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, p.n IS NOT NULL AS contaminated
FROM w LEFT JOIN p USING (id) LEFT JOIN m USING (id) WHERE kind = 'd'
"""

ORACLE = {
    "op3_decontaminate": _DECONTAMINATE,
    "op1_quality_rules": quality.ORACLE,
    "op4_warc": warc.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
}
