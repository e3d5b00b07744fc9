"""The queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from .contamination import op5_decontamination
from .extraction import op8_html_extraction
from .jaccard import op3_jaccard_join
from .licences import op1_license_scan
from .lines import op7_line_dedup
from .merkle import op13_merkle_manifest
from .negatives import op11_hard_negatives
from .projections import op2_embedding_dedup
from .quality import op9_quality_classifier
from .scoring import op10_lm_scoring
from .token_files import op12_token_files
from .tokenise import op4_sentencepiece
from .toxicity import op6_toxicity

QUERIES = {
    f.__name__: f
    for f in (op1_license_scan, op2_embedding_dedup, op3_jaccard_join, op4_sentencepiece, op5_decontamination, op6_toxicity, op7_line_dedup, op8_html_extraction, op9_quality_classifier, op10_lm_scoring, op11_hard_negatives, op12_token_files, op13_merkle_manifest)
}

#: Vectors are compared by brute force here. The others' methods (bounded-error matching, learned models, tokenisers,
#: components) have no SQL; tests/llm holds them against brute force, round trips or held-out rows.
ORACLE: dict[str, str] = {
    "op2_embedding_dedup": """
        WITH RECURSIVE usable AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        ), unit AS (
            SELECT vec_id, label, v, sqrt(list_inner_product(v, v)) AS norm FROM usable
        ), link AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
            WHERE a.norm > 0 AND b.norm > 0 AND list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.98
        ), reach(a, b) AS (
            SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
        ), comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
        n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
        SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
        FROM embeddings e JOIN comp c ON e.vec_id = c.a LEFT JOIN n ON e.vec_id = n.a
    """,
    "op11_hard_negatives": """
        WITH given AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), usable AS (
            SELECT vec_id, m.label AS label, m.q AS q FROM (SELECT vec_id, min({'label': label, 'q': q}) AS m FROM given GROUP BY vec_id)
        ), anchors AS (SELECT * FROM usable WHERE vec_id % 100 = 0), met AS (
            SELECT a.vec_id AS a, r.vec_id AS b, a.label = r.label AS same, list_inner_product(a.q, r.q)::BIGINT AS score
            FROM anchors a JOIN usable r ON a.vec_id <> r.vec_id AND len(a.q) = len(r.q)
        ), near AS (
            SELECT a, b AS p, score AS s FROM met WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
        )
        SELECT a AS anchor_id, p AS positive_id, row_number() OVER v::INT AS rank, b AS negative_id, s AS positive_score, score AS negative_score
        FROM near JOIN (SELECT a, b, score FROM met WHERE NOT same) USING (a) WHERE 30 * s <= 100 * score AND 100 * score <= 90 * s
        WINDOW v AS (PARTITION BY a, p ORDER BY score DESC, b) QUALIFY row_number() OVER v <= 10
    """,
    "op13_merkle_manifest": """
        WITH RECURSIVE parts AS (
            SELECT doc_id, lang, n_chars, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
                coalesce(strlen(text) || ':' || text, '-') AS tail, n_chars IS NOT NULL AND xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT),
                    lambda c, x: list_reduce([xor(c, x)] || range(8), lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) % 7 = 0 AS hit
            FROM documents
        ), leaf AS (
            SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
                CASE WHEN hit THEN sha256(head || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || tail) END AS other FROM parts
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM leaf
        ), tree(g, h, i, digest, n) AS (
            SELECT g, 0, pos, leaf, n FROM placed
            UNION ALL SELECT g, h + 1, i // 2, sha256(string_agg(digest, '' ORDER BY i)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY g, h, i // 2, n
        ), subroots AS (SELECT g, digest, count(*) OVER () AS n FROM tree WHERE n = 1),
        top(h, i, digest, n) AS (
            SELECT 0, g, digest, n FROM subroots
            UNION ALL SELECT h + 1, i // 2, sha256(string_agg(digest, '' ORDER BY i)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY h, i // 2, n
        ), way(g, pos, h, i, n, proof, folded) AS (
            SELECT g, pos, 0, pos, n, '', coalesce(other, leaf) FROM placed
            UNION ALL SELECT w.g, w.pos, w.h + 1, w.i // 2, (w.n + 1) // 2, w.proof || coalesce(t.digest, ''), sha256(CASE WHEN w.i % 2 = 1 THEN t.digest || w.folded ELSE w.folded || coalesce(t.digest, '') END)
            FROM way w LEFT JOIN tree t ON t.g = w.g AND t.h = w.h AND t.i = xor(w.i, 1) WHERE w.n > 1
        ), up(g, pos, h, i, n, proof, folded) AS (
            SELECT w.g, w.pos, 0, w.g, s.n, proof, folded FROM way w JOIN subroots s USING (g) WHERE w.n = 1
            UNION ALL SELECT w.g, w.pos, w.h + 1, w.i // 2, (w.n + 1) // 2, w.proof || coalesce(t.digest, ''), sha256(CASE WHEN w.i % 2 = 1 THEN t.digest || w.folded ELSE w.folded || coalesce(t.digest, '') END)
            FROM up w LEFT JOIN top t ON t.h = w.h AND t.i = xor(w.i, 1) WHERE w.n > 1
        )
        SELECT p.doc_id, p.leaf, s.digest AS subroot, r.digest AS root, sha256(u.proof) AS proof_sha256, u.folded AS folded_root, u.folded = r.digest AS verified
        FROM placed p JOIN subroots s USING (g) JOIN (SELECT * FROM up WHERE n = 1) u USING (g, pos) CROSS JOIN (SELECT digest FROM top WHERE n = 1) r
    """,
}
