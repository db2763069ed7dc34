"""The registered queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.session import spread


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")


def op1_fingerprint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.substring_dedup import remove_repeats

    return remove_repeats(_docs(spark, sf_dir))


def op2_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.sharding import shard_documents

    return shard_documents(_docs(spark, sf_dir), leaves=8)


def op3_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.pii import find_personal_data

    return find_personal_data(_docs(spark, sf_dir))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from gleaner.llm.packing import pack_documents

    return pack_documents(_docs(spark, sf_dir), path("byte_bpe_50k.json"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.language_id import identify_languages

    return identify_languages(_docs(spark, sf_dir))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.url_filter import judge_urls

    return judge_urls(spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), "page_id"))


def op7_ivf_pq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.ann import search_every

    return search_every(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.near_dedup import near_duplicates

    return near_duplicates(_docs(spark, sf_dir), width=4, percent=80)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.exact_dedup import exact_duplicates

    return exact_duplicates(_docs(spark, sf_dir))


def op10_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from gleaner.llm.bpe import encode_documents

    return encode_documents(_docs(spark, sf_dir), path("word_bpe_49k.json"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.fill_in_middle import fill_in_middle_digests

    return fill_in_middle_digests(_docs(spark, sf_dir))


def op12_weighted_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.mixing import mix_plan

    return mix_plan(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op13_maxscore_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.lexical_search import search

    return search(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprint_index": op1_fingerprint_index,
        "op2_kd_sharding": op2_kd_sharding,
        "op3_pii_weak_supervision": op3_pii_weak_supervision,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_language_id": op5_language_id,
        "op6_url_filter": op6_url_filter,
        "op7_ivf_pq_search": op7_ivf_pq_search,
        "op8_circulant_minhash": op8_circulant_minhash,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_forced_boundary_bpe": op10_forced_boundary_bpe,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_weighted_mixing": op12_weighted_mixing,
        "op13_maxscore_search": op13_maxscore_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_fingerprint_index": """
            WITH w AS (
              SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
            ), v AS (
              SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13
            ), g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM v),
            f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
            r AS (SELECT g.doc_id, list(g.i) AS starts FROM g JOIN f ON g.g = f.g WHERE g.doc_id > f.first GROUP BY g.doc_id),
            x AS (SELECT doc_id, unnest(starts) AS i FROM r),
            c AS (SELECT DISTINCT doc_id, i + o AS pos FROM x, (SELECT unnest(range(0, 13)) AS o)),
            d AS (SELECT doc_id, list(pos) AS gone FROM c GROUP BY doc_id),
            k AS (
              SELECT w.doc_id, len(w.ws) AS n_words, coalesce(len(d.gone), 0) AS n_removed, w.ws, coalesce(d.gone, []) AS gone
              FROM w LEFT JOIN d ON w.doc_id = d.doc_id
            ), u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
            q AS (
              SELECT u.doc_id, string_agg(u.word, ' ' ORDER BY u.pos) AS kept
              FROM u LEFT JOIN c ON u.doc_id = c.doc_id AND u.pos = c.pos WHERE c.pos IS NULL GROUP BY u.doc_id
            )
            SELECT k.doc_id, k.n_words::BIGINT AS n_words, k.n_removed::BIGINT AS n_removed, sha256(coalesce(q.kept, '')) AS kept_sha256
            FROM k LEFT JOIN q ON k.doc_id = q.doc_id
        """,
        "op8_circulant_minhash": """
            WITH RECURSIVE w AS (
              SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
            ), s AS (
              SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w
            ), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
            c AS (
              SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS k
              FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
            ), l AS (SELECT x, y FROM c WHERE 100 * k >= 80 * (nx + ny - k)),
            d AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
            r AS (SELECT doc_id AS v, doc_id AS m FROM documents UNION SELECT d.y, r.m FROM r JOIN d ON d.x = r.v),
            f AS (SELECT v, min(m) AS component_id FROM r GROUP BY v)
            SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, f.component_id, f.component_id = s.doc_id AS kept
            FROM s JOIN f ON f.v = s.doc_id
        """,
        "op9_exact_dedup": """
            WITH t AS (
              SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents
            ), g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
            SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
            FROM t JOIN g ON t.norm = g.norm
        """,
        "op11_fill_in_middle": """
            WITH t AS (
              SELECT doc_id, coalesce(text, '') AS s, sha256('42:' || doc_id::VARCHAR) AS h,
                     regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents
            ), d AS (
              SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
                     ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS e FROM t
            ), f AS (
              SELECT *, CASE WHEN s = '' OR regexp_matches(s, '<[PSM]>') OR c >= 50 THEN 'plain' WHEN e < 80 THEN 'spm' ELSE 'psm' END AS form,
                     list_sum(list_transform(u[1:least(a, b)], lambda x: length(x))) AS p, list_sum(list_transform(u[1:greatest(a, b)], lambda x: length(x))) AS q FROM d
            ), g AS (SELECT *, coalesce(p, 0)::BIGINT AS p0, coalesce(q, 0)::BIGINT AS q0 FROM f)
            SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN p0 END AS prefix_chars, CASE WHEN form <> 'plain' THEN q0 - p0 END AS middle_chars,
                   sha256(CASE form WHEN 'plain' THEN s
                     WHEN 'psm' THEN '<P>' || substr(s, 1, p0) || '<S>' || substr(s, q0 + 1) || '<M>' || substr(s, p0 + 1, q0 - p0)
                     ELSE '<S>' || substr(s, q0 + 1) || '<P>' || substr(s, 1, p0) || '<M>' || substr(s, p0 + 1, q0 - p0) END) AS output_sha256,
                   sha256(s) AS restored_sha256
            FROM g
        """,
        "op12_weighted_mixing": r"""
            WITH d AS (
              SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, sha256('42:' || doc_id::VARCHAR)[1:15] AS key FROM documents
            ), s AS (SELECT source, sum(size)::BIGINT AS words FROM d GROUP BY source),
            w AS (SELECT source, words, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1.0::DOUBLE AS weight, sum(words) OVER ()::DOUBLE AS total FROM s),
            -- in order of the share of a unit of weight at which each is full: the first whose predecessors' being full leaves it below that
            o AS (
              SELECT *, 3 * words / weight AS full_at, coalesce(sum(3 * words) OVER (ORDER BY 3 * words / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS held,
                     sum(weight) OVER (ORDER BY 3 * words / weight DESC, source DESC)::DOUBLE AS open FROM w
            ), l AS (SELECT min_by(total - held, full_at) AS rest, min_by(open, full_at) AS open FROM o WHERE total - held <= full_at * open),
            t AS (SELECT source, words, CASE WHEN 3 * words * l.open < weight * l.rest THEN (3 * words)::DOUBLE ELSE weight * l.rest / l.open END AS target FROM o, l),
            b AS (SELECT source, words, target, round(target)::BIGINT AS budget FROM t),
            p AS (
              SELECT d.*, b.words, b.target, b.budget, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size AS before
              FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
            )
            SELECT doc_id, size, words AS source_size, target,
                   CASE WHEN words = 0 THEN 0 ELSE budget // words * size + greatest(0, least(size, budget % words - before)) END::BIGINT AS taken
            FROM p
        """,
        "op13_maxscore_search": r"""
            WITH e AS (
              SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
              FROM documents WHERE text IS NOT NULL
            ), q AS (
              SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
            ), n AS (SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id),
            c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
            p AS (SELECT doc_id, t, count(*) AS tf FROM e WHERE t IN (SELECT t FROM q) GROUP BY doc_id, t),
            f AS (SELECT t, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY t, docs),
            s AS (
              SELECT q.item_id, p.doc_id, sum(f.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (10 + (90 * n.n * c.docs) // c.terms))))::BIGINT AS score
              FROM q JOIN p ON q.t = p.t JOIN f ON f.t = p.t JOIN n ON n.doc_id = p.doc_id, c GROUP BY q.item_id, p.doc_id
            ), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
            SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10
        """,
    }
