"""Registered queries of the operators, and their SQL where SQL can express them.

Each query applies its operator, with the parameters meant for production, to the whole
table, and returns its whole result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from rowtide.llm import (
    automaton_search,
    byte_bpe,
    centroids,
    embedding_dedup,
    fuzzy_lines,
    lsh_forest,
    mixing,
    quality,
    repeated_spans,
    threshold_topk,
    token_blocks,
    trie_lm,
    warc,
)

#: Tokenizer files; parameters of the operators.
RANKS = "byte_bpe_multi_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark, sf_dir):
    return embedding_dedup.link_vectors(_table(spark, sf_dir, "embeddings"))


def op2_quality_classifier(spark, sf_dir):
    return quality.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_warc(spark, sf_dir):
    return warc.archive_digests(_table(spark, sf_dir, "pages"))


def op4_token_blocks(spark, sf_dir):
    return token_blocks.token_index(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op5_source_mixing(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op6_trie_lm(spark, sf_dir):
    return trie_lm.score_documents(_table(spark, sf_dir, "documents"))


def op7_fuzzy_lines(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return fuzzy_lines.drop_repeated_lines(documents)


def op8_lsh_forest(spark, sf_dir):
    return lsh_forest.near_duplicates(_table(spark, sf_dir, "documents")).drop("component")


def op9_threshold_topk(spark, sf_dir):
    return threshold_topk.top_k(_table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


def op10_byte_bpe(spark, sf_dir):
    path = public_tokenizers.path(RANKS)
    return byte_bpe.token_digests(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op11_centroid_clustering(spark, sf_dir):
    return centroids.cluster_vectors(_table(spark, sf_dir, "embeddings"))


def op12_suffix_dedup(spark, sf_dir):
    return repeated_spans.remove_repeated_spans(_table(spark, sf_dir, "documents"), with_text=False)


def op13_lexical_search(spark, sf_dir):
    return automaton_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


# --- pipeline --------------------------------------------------------------------------


def good_documents(spark, docs, sf_dir):
    """Documents the quality classifier accepts; it learns from the labels of the same folder."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def unrepeated_lines(spark, docs, sf_dir):
    """Documents without lines that stay elsewhere; one that loses all its lines goes."""
    out = fuzzy_lines.drop_repeated_lines(docs)
    n_lines, n_kept = out.columns[-2:]
    lost_all = (F.col(n_lines) > 0) & (F.col(n_kept) == 0)
    return _as_documents(out.where(~lost_all), docs, F.col(n_kept) < F.col(n_lines))


def distinct_documents(spark, docs, sf_dir):
    """One document of each group of near duplicates (five words, a similarity of 0.8)."""
    return lsh_forest.one_of_each(docs, percent=80, shingle_words=5)


def mixed_sources(spark, docs, sf_dir):
    """As many copies of a document as the mix takes, the last one cut to its words."""
    return mixing.mixed_rows(docs)


def encoded_documents(spark, docs, sf_dir):
    """Documents with their token ids."""
    return byte_bpe.encode_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def _as_documents(out, docs, changed):
    """The columns of the documents, ``n_chars`` counted anew where the text has changed."""
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[f"`{c}`" for c in docs.columns])


STAGES = [
    ("quality", good_documents),
    ("lines", unrepeated_lines),
    ("near_duplicates", distinct_documents),
    ("mixing", mixed_sources),
    ("tokens", encoded_documents),
]


def queries():
    functions = [
        op1_embedding_near_dedup, op2_quality_classifier, op3_warc, op4_token_blocks, op5_source_mixing,
        op6_trie_lm, op7_fuzzy_lines, op8_lsh_forest, op9_threshold_topk, op10_byte_bpe,
        op11_centroid_clustering, op12_suffix_dedup, op13_lexical_search,
    ]
    return {f.__name__: f for f in functions}


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_COMPONENTS = """
    reach AS (
      SELECT a AS x, b AS y FROM both_ways
      UNION
      SELECT r.x, l.b FROM reach r JOIN both_ways l ON r.y = l.a),
    least AS (SELECT x, least(x, min(y)) AS component FROM reach GROUP BY x)"""


def _clustering_sql(rounds=10):
    """Each round's vectors with their cluster, and its centroids, one table after the other."""
    nearest = """SELECT vec_id, v, arg_min(cluster, (square, cluster)) AS cluster, min(square) AS distance FROM (
        SELECT vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS square
        FROM v CROSS JOIN {centroids}) GROUP BY vec_id, v"""
    steps = []
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({nearest.format(centroids=f'c{i}')})")
        steps.append(f"""c{i + 1} AS MATERIALIZED (
          SELECT cluster, coalesce(m, c) AS c FROM c{i} LEFT JOIN (
            SELECT cluster, list(mean ORDER BY place) AS m FROM (
              SELECT cluster, place, CAST(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END AS BIGINT) AS mean FROM (
                SELECT cluster, place, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
                  SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{i}) GROUP BY ALL))
            GROUP BY cluster) USING (cluster))""")
    steps = ",\n".join(steps)
    return f"""
        WITH v AS MATERIALIZED (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
          WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS MATERIALIZED (
          SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS cluster, v AS c FROM v
          ORDER BY sha256('3:' || vec_id) LIMIT 8),
        {steps},
        e AS MATERIALIZED ({nearest.format(centroids=f"c{rounds}")})
        SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
               CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(distance) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM e JOIN c{rounds} USING (cluster)"""


def oracle_sql():
    return {
        "op1_embedding_near_dedup": f"""
            WITH RECURSIVE v AS (
              SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
              WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
            both_ways AS (
              SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q
              ON p.label = q.label AND len(p.e) = len(q.e) AND p.vec_id <> q.vec_id
              WHERE list_cosine_similarity(p.e, q.e) >= 0.98), {_COMPONENTS},
            n AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
            SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(component, vec_id) AS component_id,
                   vec_id = coalesce(component, vec_id) AS kept
            FROM embeddings LEFT JOIN n ON vec_id = a LEFT JOIN least ON vec_id = x""",
        "op3_warc": """
            WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS bytes,
                              sha1(coalesce(html, '')) AS digest FROM pages),
            f AS (SELECT *, max(page_id) OVER (PARTITION BY digest, bytes) AS first FROM d)
            SELECT page_id, bytes AS payload_bytes, digest AS payload_digest,
                   CASE WHEN bytes >= 1000 AND page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN bytes >= 1000 AND page_id < first THEN first END AS refers_to FROM f""",
        "op8_lsh_forest": f"""
            WITH RECURSIVE w AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
            s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w]
                    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) END) AS s FROM w),
            f AS (SELECT s, list(doc_id) AS ids, min(doc_id) AS id, len(s) AS n FROM s GROUP BY s),
            e AS (SELECT id, n, unnest(s) AS t FROM f),
            o AS (SELECT id, n, t, row_number() OVER (PARTITION BY id ORDER BY c, t) AS k
                  FROM e JOIN (SELECT t AS u, count(*) AS c FROM e GROUP BY t) ON t = u),
            p AS (SELECT id, n, t FROM o WHERE 100 * (k - 1) <= 15 * n),
            c AS (SELECT DISTINCT a.id AS a, b.id AS b, a.n AS na, b.n AS nb FROM p a JOIN p b
                  ON a.t = b.t AND a.id < b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
            l AS (SELECT c.a, c.b FROM c JOIN f x ON x.id = c.a JOIN f y ON y.id = c.b
                  WHERE 100 * len(list_intersect(x.s, y.s)) >= 85 * (na + nb - len(list_intersect(x.s, y.s)))),
            both_ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l), {_COMPONENTS},
            r AS (SELECT unnest(ids) AS doc_id, CASE WHEN n > 0 THEN coalesce(component, id) END AS component, n
                  FROM f LEFT JOIN least ON id = x)
            SELECT doc_id, n AS n_shingles, coalesce(component, doc_id) AS component_id,
                   doc_id = coalesce(component, doc_id) AS kept FROM r""",
        "op9_threshold_topk": """
            WITH v AS (
              SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
              WHERE embedding IS NOT NULL AND len(embedding) > 0
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
                  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
            r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
                  FROM s)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
        "op11_centroid_clustering": _clustering_sql(),
        "op13_lexical_search": f"""
            WITH w AS (SELECT doc_id, {_TERMS} AS w FROM documents),
            d AS (SELECT doc_id, w, len(w) AS n FROM w WHERE len(w) > 0),
            s AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM d),
            f AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
            t AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
                  FROM f, s GROUP BY term, n_docs),
            q AS (SELECT item_id, term, count(*) AS times
                  FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
            m AS (SELECT doc_id, 100 - 25 + ((25 * n * n_docs) // n_terms) AS m FROM d, s),
            r AS (SELECT item_id, doc_id,
                    CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
                  FROM q JOIN t USING (term) JOIN f USING (term) JOIN m USING (doc_id) GROUP BY ALL),
            o AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
                  FROM r WHERE score > 0)
            SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 20""",
    }
