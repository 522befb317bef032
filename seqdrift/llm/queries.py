"""Registered queries of the text operators and their SQL twins."""

from __future__ import annotations

from .chat import OP9_SQL, op9_chat_format
from .decontaminate import OP1_SQL, op1_decontamination
from .html_extract import op3_html_extraction
from .manifest import OP11_SQL, op11_merkle_manifest
from .periodic import op12_periodic_runs
from .pii import op5_pii
from .quality_classifier import op2_quality_classifier
from .quality_rules import op4_quality_rules
from .sentencepieces import op7_sentencepiece
from .sharding import op13_sharding
from .simhash import op10_simhash
from .substring import op6_substring_dedup
from .suffixes import op8_suffix_dedup

QUERIES = {f.__name__: f for f in (
    op1_decontamination, op2_quality_classifier, op3_html_extraction, op4_quality_rules, op5_pii,
    op6_substring_dedup, op7_sentencepiece, op8_suffix_dedup, op9_chat_format, op10_simhash,
    op11_merkle_manifest, op12_periodic_runs, op13_sharding)}

#: Windows of 50 words and of 100 bytes that also start earlier, straight from the contracts.
OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS p, unnest([md5(array_to_string(w[i:i + 49], ' ')) FOR i IN range(1, len(w) - 48)]) AS h
        FROM d WHERE len(w) >= 50),
least_id AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT win.doc_id, unnest(range(p, p + 50)) AS i FROM win JOIN least_id USING (h) WHERE win.doc_id > first),
per AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
word AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN per USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(CASE WHEN len(gone) = 0 THEN array_to_string(w, ' ')
       WHEN len(gone) = len(w) THEN '' ELSE array_to_string([w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(gone, i)], ' ') END) AS kept_sha256
FROM word
"""

ORACLE_SQL = {"op1_decontamination": OP1_SQL, "op6_substring_dedup": OP6_SQL, "op9_chat_format": OP9_SQL,
              "op11_merkle_manifest": OP11_SQL}
