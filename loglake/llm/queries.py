"""The registered queries of this subpackage, and their SQL where SQL expresses them."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglake.llm.common import documents
from loglake.llm.bpe import bpe_digest
from loglake.llm.exact_dedup import exact_dedup
from loglake.llm.language_id import language_id
from loglake.llm.line_dedup import line_classes
from loglake.llm.lm_score import lm_score
from loglake.llm.merkle import document_manifest
from loglake.llm.minhash import CONTRACT, near_dedup
from loglake.llm.packing import pack
from loglake.llm.pii import pii_digest
from loglake.llm.quality_classifier import quality_classifier
from loglake.llm.quality_rules import quality_rules
from loglake.llm.token_counts import token_counts
from loglake.llm.whitening import whitening
from loglake.session import prepare


def op1_pii(spark, sf_dir):
    return pii_digest(documents(spark, sf_dir))


def op2_language_id(spark, sf_dir):
    return language_id(documents(spark, sf_dir))


def op3_line_dedup(spark, sf_dir):
    return line_classes(documents(spark, sf_dir))


def op4_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir))


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir))


def op6_minhash(spark, sf_dir):
    return near_dedup(documents(spark, sf_dir), CONTRACT)


def op7_bpe(spark, sf_dir):
    import public_tokenizers as P

    return bpe_digest(documents(spark, sf_dir), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


def op8_quality_rules(spark, sf_dir):
    return quality_rules(documents(spark, sf_dir))


def op9_quality_classifier(spark, sf_dir):
    return quality_classifier(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_lm_score(spark, sf_dir):
    return lm_score(documents(spark, sf_dir))


def op11_merkle_manifest(spark, sf_dir):
    return document_manifest(documents(spark, sf_dir))


def op12_token_counts(spark, sf_dir):
    import public_tokenizers as P

    return token_counts(documents(spark, sf_dir), P.path("byte_bpe_50k.json"))


def op13_whitening(spark, sf_dir):
    return whitening(prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_language_id, op3_line_dedup, op4_packing, op5_exact_dedup, op6_minhash, op7_bpe, op8_quality_rules, op9_quality_classifier, op10_lm_score,
    op11_merkle_manifest, op12_token_counts, op13_whitening)}

ORACLE = {
    "op3_line_dedup": """
        WITH RECURSIVE
        l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents),
        c AS (SELECT *, trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' AS counted FROM l),
        d AS (SELECT l, length(l) AS n, min((doc_id, line_no)) AS f, count(*) AS size FROM c WHERE counted GROUP BY 1, 2),
        -- within two edits a third of the shorter line stays as it is, at most two places away
        s AS MATERIALIZED (SELECT l, n, CASE WHEN n >= 128 THEN 2 ELSE 1 END AS t, left(l, (n // 3)::INT) AS a, right(l, (n // 3)::INT) AS z, substr(l, (n // 3 + 1)::INT, (n // 3)::INT) AS m FROM d WHERE n >= 16),
        p AS MATERIALIZED (SELECT x.l AS a, y.l AS b, x.t FROM s x JOIN d y ON y.n BETWEEN x.n AND x.n + 2 AND x.l <> y.l AND (starts_with(y.l, x.a) OR ends_with(y.l, x.z) OR contains(y.l, x.m))),
        e AS (SELECT a, b FROM p WHERE levenshtein(a, b) <= t),
        e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r AS (SELECT a AS s, a AS t FROM e2 UNION SELECT r.s, e2.b FROM r JOIN e2 ON r.t = e2.a),
        g AS (SELECT s AS l, min(d.f) AS f, sum(d.size) AS size FROM (SELECT DISTINCT s, t FROM r) x JOIN d ON d.l = x.t GROUP BY 1)
        SELECT c.doc_id, c.line_no::INT AS line_no,
            CASE WHEN counted THEN coalesce(g.f, d.f)[1] ELSE c.doc_id END AS class_id,
            CASE WHEN counted THEN coalesce(g.f, d.f)[2] ELSE c.line_no END::INT AS class_line_no,
            CASE WHEN counted THEN coalesce(g.size, d.size) ELSE 1 END::BIGINT AS class_size,
            NOT counted OR coalesce(g.f, d.f) = (c.doc_id, c.line_no) AS kept
        FROM c LEFT JOIN d ON c.counted AND c.l = d.l LEFT JOIN g ON c.counted AND c.l = g.l
    """,
    "op5_exact_dedup": """
        WITH g AS (SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
        FROM documents JOIN g ON coalesce(text, '') = g.t
    """,
    # the crc32 of an id runs over its digits, bit by bit
    "op11_merkle_manifest": """
        WITH RECURSIVE
        e AS (SELECT *, list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR], lambda v: coalesce(strlen(v) || ':' || v, '-')) AS f,
            xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda d, k: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END), 4294967295::BIGINT), 4294967295::BIGINT) AS crc FROM documents),
        l AS (SELECT doc_id, source, sha256(array_to_string(f, '') || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
            CASE WHEN crc % 5 = 0 THEN sha256(array_to_string(f, '') || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS bad FROM e),
        p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l),
        t AS (SELECT 0 AS level, source, pos, n, leaf AS h FROM p
            UNION ALL SELECT level + 1, source, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY level, source, pos // 16, n),
        s AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
        u AS (SELECT 0 AS level, pos, n, h FROM s UNION ALL SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, pos // 16, n),
        -- what stands before and behind each node in its run
        a AS (SELECT level, source, pos, n, coalesce(string_agg(h, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, coalesce(string_agg(h, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS z
            FROM t WINDOW r AS (PARTITION BY level, source, pos // 16 ORDER BY pos)),
        c AS (SELECT level, pos, n, coalesce(string_agg(h, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, coalesce(string_agg(h, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS z
            FROM u WINDOW r AS (PARTITION BY level, pos // 16 ORDER BY pos)),
        w AS (SELECT doc_id, source, leaf, 0 AS level, pos, n, coalesce(bad, leaf) AS h, '' AS proof FROM p
            UNION ALL SELECT w.doc_id, w.source, leaf, w.level + 1, w.pos // 16, (w.n + 15) // 16, sha256(b || h || z), proof || b || z FROM w JOIN a ON w.level = a.level AND w.pos = a.pos AND w.source IS NOT DISTINCT FROM a.source WHERE w.n > 1),
        x AS (SELECT w.doc_id, leaf, s.h AS subroot, 0 AS level, s.pos, s.n, w.h, proof FROM w JOIN s ON w.source IS NOT DISTINCT FROM s.source WHERE w.n = 1
            UNION ALL SELECT doc_id, leaf, subroot, x.level + 1, x.pos // 16, (x.n + 15) // 16, sha256(b || h || z), proof || b || z FROM x JOIN c ON x.level = c.level AND x.pos = c.pos WHERE x.n > 1)
        SELECT doc_id, leaf, subroot, u.h AS root, sha256(proof) AS proof_sha256, x.h AS folded_root, x.h = u.h AS verified FROM x, u WHERE x.n = 1 AND u.n = 1
    """,
}
