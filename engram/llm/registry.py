"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from engram.llm.collocations import SQL as COLLOCATIONS
from engram.llm.collocations import op12_phrase_collocations
from engram.llm.decontamination import op3_benchmark_decontamination
from engram.llm.fingerprints import op9_fingerprints
from engram.llm.html_text import op10_html_extraction
from engram.llm.merkle import SQL as MERKLE
from engram.llm.merkle import op13_merkle_manifest
from engram.llm.near_duplicates import op6_minhash_near_dedup
from engram.llm.packing import op8_best_fit_packing
from engram.llm.quality import op7_quality_classifier
from engram.llm.sharding import op5_sharding
from engram.llm.suffix_dedup import op1_suffix_array_dedup
from engram.llm.token_counts import op4_token_counts
from engram.llm.toxicity import op2_toxicity
from engram.llm.warc import SQL as WARC
from engram.llm.warc import op11_warc

QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_token_counts": op4_token_counts,
    "op5_sharding": op5_sharding,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_fingerprints": op9_fingerprints,
    "op10_html_extraction": op10_html_extraction,
    "op11_warc": op11_warc,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: The exact groups by an inverted join of all shingles, and components by recursion.
NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
x AS (SELECT doc_id, unnest(s) AS g FROM s), n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c AS (SELECT doc_id AS node, doc_id AS label FROM n UNION SELECT e.b, c.label FROM c JOIN e ON e.a = c.node),
m AS (SELECT node, min(label) AS component_id FROM c GROUP BY node)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN m ON node = doc_id
"""

SQL: dict[str, str] = {"op6_minhash_near_dedup": NEAR_DUPLICATES, "op11_warc": WARC, "op12_phrase_collocations": COLLOCATIONS, "op13_merkle_manifest": MERKLE}
