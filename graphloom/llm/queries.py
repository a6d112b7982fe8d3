"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from graphloom.llm import alignment, decontamination, jaccard, licenses, packing, quality_classifier, quality_rules, sharding, simhash, substrings, suffix_array, token_counts, whitening

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_simhash_neardup": simhash.op3_simhash_neardup,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_suffix_array_dedup": suffix_array.op5_suffix_array_dedup,
    "op6_substring_dedup": substrings.op6_substring_dedup,
    "op7_sharding": sharding.op7_sharding,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_quality_classifier": quality_classifier.op9_quality_classifier,
    "op10_license_scan": licenses.op10_license_scan,
    "op11_ngram_jaccard_join": jaccard.op11_ngram_jaccard_join,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_cross_tokenizer_alignment": alignment.op13_cross_tokenizer_alignment,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {
    "op11_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        grams AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i : i + 3], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
        sizes AS (SELECT doc_id, COUNT(*) AS n FROM grams GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS x FROM grams AS a JOIN grams AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
        links AS (SELECT h.a, h.b FROM shared AS h JOIN sizes AS m ON m.doc_id = h.a JOIN sizes AS n ON n.doc_id = h.b WHERE 100 * h.x >= 85 * (m.n + n.n - h.x)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON r.b = l.a),
        least AS (SELECT a, MIN(b) AS c FROM reach GROUP BY a)
        SELECT w.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, coalesce(l.c, w.doc_id) AS component_id FROM w LEFT JOIN sizes AS s ON s.doc_id = w.doc_id LEFT JOIN least AS l ON l.a = w.doc_id
    """,
    "op6_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        windows AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
        again AS (SELECT doc_id, i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING COUNT(*) > 1)),
        gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 35)) AS i FROM again),
        words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
        kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.i) AS rest, COUNT(*) AS n FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i WHERE gone.i IS NULL GROUP BY words.doc_id)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.rest, '')) AS kept_sha256 FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
    """,
}
