"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogscope.llm import byte_bpe, divergence_rules, exponion, gated_lm, html_blocks, kn_quality, line_dedup, multiprobe, packing, partenum, prefix_trie, syncmers, wordpiece
from dialogscope.llm.common import read


def op1_multiprobe_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return multiprobe.search(vectors, vectors.where("vec_id % 20 = 0"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated_lm.score(read(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_rules.judge(read(spark, sf_dir, "documents"))


def op5_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn_quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.components(read(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(read(spark, sf_dir, "pages"))


def op11_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_pairs(read(spark, sf_dir, "documents"))


def op12_exponion_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exponion.compressed(read(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.build(read(spark, sf_dir, "conversations"))


def _codes_sql() -> str:
    """Three assignments and two replacements of entries, each over all parts and entries."""
    distance = " + ".join(f"(x.c[{i}] - b.c[{i}]) * (x.c[{i}] - b.c[{i}])" for i in range(1, 5))
    mean = ", ".join(f"CAST(floor(sum(x.c[{i}]) / count(*)) AS BIGINT)" for i in range(1, 5))
    steps = []
    for k in range(3):
        # the least of distance * 64 + entry is the nearest entry, ties to the lower index
        steps.append(f"a{k} AS (SELECT x.vec_id, x.p, min(({distance}) * 64 + b.e) AS de FROM part x JOIN b{k} b ON b.p = x.p GROUP BY 1, 2)")
        steps.append(f"m{k} AS (SELECT x.p, a.de % 64 AS e, [{mean}] AS c FROM part x JOIN a{k} a ON a.vec_id = x.vec_id AND a.p = x.p GROUP BY 1, 2)")
        steps.append(f"b{k + 1} AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m ON m.p = b.p AND m.e = b.e)")
    return f"""
        WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        part AS (SELECT vec_id, p, c[4 * p + 1 : 4 * p + 4] AS c FROM v, range(16) AS t(p)),
        first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v ORDER BY vec_id LIMIT 64),
        b0 AS (SELECT part.p, first.e, part.c FROM part JOIN first ON first.vec_id = part.vec_id),
        {", ".join(steps)},
        coded AS (SELECT vec_id, string_agg(printf('%02x', de % 64), '' ORDER BY p) AS code, CAST(sum(de // 64) AS BIGINT) AS error FROM a2 GROUP BY vec_id),
        books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
        SELECT coded.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM coded JOIN v ON v.vec_id = coded.vec_id, books"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_multiprobe_search": op1_multiprobe_search,
    "op2_line_dedup": op2_line_dedup,
    "op3_gated_lm": op3_gated_lm,
    "op4_quality_rules": op4_quality_rules,
    "op5_kneser_ney_quality": op5_kneser_ney_quality,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_token_counts": op7_token_counts,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_html_extraction": op10_html_extraction,
    "op11_closed_syncmers": op11_closed_syncmers,
    "op12_exponion_codes": op12_exponion_codes,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": r"""
        WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        line AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs),
        keyed AS (SELECT doc_id, line, pos, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line),
        hot AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
        marked AS (SELECT keyed.*, hot.k IS NOT NULL AND doc_id <> last AS gone FROM keyed LEFT JOIN hot USING (k))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op9_jaccard_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
        e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
        r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON r.doc_id = e.x)
        SELECT r.doc_id, coalesce(max(n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op12_exponion_codes": _codes_sql(),
    "op13_prefix_trie": r"""
        WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i,
            {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS s FROM conversations WHERE conv_id IS NOT NULL),
        -- unsigned crc32 of the decimal conv_id, bit by bit
        c AS (SELECT conv_id, xor(4294967295, list_reduce(flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ord(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
            lambda s, x: xor(xor(s, x) >> 1, 3988292384 * (xor(s, x) & 1)), CAST(4294967295 AS BIGINT))) % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
        r AS (SELECT c.conv_id, t.i, t.s FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.i < c.h
            UNION ALL SELECT c.conv_id, t.i + 4, t.s FROM c JOIN t ON t.conv_id = c.conv_id AND t.i >= c.h),
        p AS (SELECT c.conv_id, coalesce(list(r.s ORDER BY r.i) FILTER (r.i IS NOT NULL), []) AS path FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
        m AS (SELECT conv_id, unnest(range(len(path) + 1)) AS depth, path FROM p),
        n AS (SELECT path[1:depth] AS k, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
            coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(path) = depth), '') AS ends FROM m GROUP BY 1, 2),
        w AS (SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(k[depth].text, '[^\x20\x09-\x0D]+')) END AS saved FROM n),
        kids AS (SELECT k[1:depth - 1] AS k, depth - 1 AS depth, count(*) AS n FROM n WHERE depth > 0 GROUP BY 1, 2),
        f AS (SELECT w.*, coalesce(kids.n, 0) AS n_children FROM w LEFT JOIN kids ON kids.k = w.k AND kids.depth = w.depth),
        up AS (SELECT k[1:d] AS k, d AS depth, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
            FROM (SELECT *, unnest(range(depth + 1)) AS d FROM f) GROUP BY 1, 2)
        SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(up.n_leaves AS BIGINT) AS n_leaves,
            CAST(up.saved_tokens AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
        FROM f JOIN up ON up.k = f.k AND up.depth = f.depth LEFT JOIN n q ON q.k = f.k[1:f.depth - 1] AND q.depth = f.depth - 1""",
}
