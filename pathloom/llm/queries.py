"""The queries of this subpackage and, where SQL can express one, its DuckDB twin."""

from .bpe import op5_bpe
from .centroids import op13_centroid_clustering
from .curriculum import op11_mixing
from .decontaminate import op4_decontaminate
from .near_dedup import op7_near_dedup
from .ngram_lm import op1_lm_scoring
from .pii import op6_pii
from .quality_classifier import op8_quality_classifier
from .quality_rules import op9_quality_rules
from .ranked_search import op12_ranked_search
from .secret_scan import op10_secret_scan
from .token_counts import op2_token_counts
from .warc import op3_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_lm_scoring, op2_token_counts, op3_warc, op4_decontaminate, op5_bpe, op6_pii, op7_near_dedup,
        op8_quality_classifier, op9_quality_rules, op10_secret_scan, op11_mixing, op12_ranked_search,
        op13_centroid_clustering,
    )
}

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lloyd(k: int = 8, rounds: int = 10) -> str:
    """Rounds of assignment and floored means, one after another, over (vec_id, i, x) rows."""
    out = f"""
        WITH kept AS (SELECT vec_id, row_number() OVER () AS r, embedding FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e::DOUBLE))) = 64),
        v AS MATERIALIZED (SELECT vec_id, r, i, floor(1024 * embedding[i]::DOUBLE)::BIGINT AS x FROM kept, range(1, 65) t(i)),
        f AS (SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR)) - 1 AS c FROM kept),
        c0 AS MATERIALIZED (SELECT c::INT AS c, i, x FROM f JOIN v USING (r) WHERE c < {k}),"""
    for n in range(rounds + 1):
        out += f"""
        d{n} AS (SELECT vec_id, r, c, sum((v.x - c{n}.x) * (v.x - c{n}.x))::BIGINT AS d FROM v JOIN c{n} USING (i) GROUP BY ALL),
        a{n} AS MATERIALIZED (SELECT vec_id, r, min_by(c, d * {k} + c) AS c, min(d) AS d FROM d{n} GROUP BY vec_id, r),"""
        if n < rounds:
            out += f"""
        m{n} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM a{n} JOIN v USING (r) GROUP BY c, i),
        c{n + 1} AS MATERIALIZED (SELECT o.c, o.i, coalesce((s - ((s % n) + n) % n) // n, o.x) AS x FROM c{n} o LEFT JOIN m{n} USING (c, i)),"""
    return out + f"""
        h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c)
        SELECT vec_id, c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
               (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
        FROM a{rounds} JOIN h USING (c)"""


ORACLE_SQL: dict[str, str] = {
    "op3_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first FROM p)
        SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('{_BASE32}', (((('0x' || substr(x, ((i // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM f""",
    "op7_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        near AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        r(node, component) AS (SELECT doc_id, doc_id FROM documents UNION SELECT near.b, r.component FROM r JOIN near ON near.a = r.node WHERE r.component < near.b)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(component) AS component_id, d.doc_id = min(component) AS kept
        FROM documents d JOIN r ON r.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n""",
    "op11_mixing": r"""
        WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM d GROUP BY source),
        w AS (SELECT *, [5, 2, 1][turn + 1] AS weight, 2 * source_size AS cap FROM s),
        l AS (SELECT *, (1.5::DOUBLE * (sum(cap) OVER ())::DOUBLE / 2 - coalesce(sum(cap) OVER o, 0)::DOUBLE)
                        / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level
              FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT *, least(cap::DOUBLE, weight * (SELECT min_by(level, cap::DOUBLE / weight) FROM l WHERE level * weight < cap)) AS target FROM l),
        g AS (SELECT *, floor(target + 0.5)::BIGINT AS goal FROM t),
        k AS (SELECT coalesce(sum(goal) FILTER (turn = 0), 0)::DOUBLE AS g0, coalesce(sum(goal) FILTER (turn = 1), 0)::DOUBLE AS g1,
                     coalesce(sum(goal) FILTER (turn = 2), 0)::DOUBLE AS g2 FROM g),
        p AS (SELECT doc_id, size, source_size, turn, target, goal,
                     coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(doc_id::VARCHAR), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
              FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
        x AS (SELECT *, greatest(0, least(size, goal - a)) AS n0, greatest(0, least(size, goal - a - source_size)) AS n1,
                     a::DOUBLE / goal::DOUBLE AS f0, (a + source_size)::DOUBLE / goal::DOUBLE AS f1 FROM p),
        y AS (SELECT *, CASE turn WHEN 0 THEN f0 * 2 / (1.5::DOUBLE + sqrt(greatest(2.25::DOUBLE - f0 * 2, 0))) WHEN 1 THEN f0 * 2 / (1 + sqrt(1::DOUBLE))
                        ELSE CASE WHEN f0 * 0.9375::DOUBLE < 0.3125::DOUBLE THEN f0 * 0.9375::DOUBLE * 2 / (0.5::DOUBLE + sqrt(0.25::DOUBLE + f0 * 0.9375::DOUBLE))
                             ELSE 0.5::DOUBLE + (f0 * 0.9375::DOUBLE - 0.3125::DOUBLE) * 2 / (0.75::DOUBLE + sqrt(0.5625::DOUBLE + (f0 * 0.9375::DOUBLE - 0.3125::DOUBLE) * 4)) END END AS t0,
                     CASE turn WHEN 0 THEN f1 * 2 / (1.5::DOUBLE + sqrt(greatest(2.25::DOUBLE - f1 * 2, 0))) WHEN 1 THEN f1 * 2 / (1 + sqrt(1::DOUBLE))
                        ELSE CASE WHEN f1 * 0.9375::DOUBLE < 0.3125::DOUBLE THEN f1 * 0.9375::DOUBLE * 2 / (0.5::DOUBLE + sqrt(0.25::DOUBLE + f1 * 0.9375::DOUBLE))
                             ELSE 0.5::DOUBLE + (f1 * 0.9375::DOUBLE - 0.3125::DOUBLE) * 2 / (0.75::DOUBLE + sqrt(0.5625::DOUBLE + (f1 * 0.9375::DOUBLE - 0.3125::DOUBLE) * 4)) END END AS t1
              FROM x),
        z AS (SELECT y.*,
                     floor(g0 * (t0 * (1.5::DOUBLE - t0 * 0.5::DOUBLE)) + g1 * t0
                           + g2 * (CASE WHEN t0 < 0.5 THEN t0 * (0.5::DOUBLE + t0 * 0.25::DOUBLE) ELSE 0.3125::DOUBLE + (t0 - 0.5::DOUBLE) * (0.75::DOUBLE + (t0 - 0.5::DOUBLE) * 1::DOUBLE) END / 0.9375::DOUBLE))::BIGINT AS p0,
                     floor(g0 * (t1 * (1.5::DOUBLE - t1 * 0.5::DOUBLE)) + g1 * t1
                           + g2 * (CASE WHEN t1 < 0.5 THEN t1 * (0.5::DOUBLE + t1 * 0.25::DOUBLE) ELSE 0.3125::DOUBLE + (t1 - 0.5::DOUBLE) * (0.75::DOUBLE + (t1 - 0.5::DOUBLE) * 1::DOUBLE) END / 0.9375::DOUBLE))::BIGINT AS p1
              FROM y, k)
        SELECT doc_id, size, source_size, target, (n0 + n1)::BIGINT AS taken, CASE WHEN n0 > 0 THEN p0 END AS position, CASE WHEN n1 > 0 THEN p1 END AS again_at
        FROM z""",
    "op12_ranked_search": rf"""
        WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
        d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
        s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM d),
        p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
        f AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, docs),
        q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // l)))))::BIGINT AS score
              FROM q JOIN f USING (term) JOIN p USING (term) JOIN d USING (doc_id), s GROUP BY item_id, doc_id),
        o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM r WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10""",
    "op13_centroid_clustering": _lloyd(),
}
