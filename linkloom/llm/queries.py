"""The contract queries ``opN_*``: thin wraps that read the tables and derive the digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import decode, encode
from .conversations import conversation_reports, damage
from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_join
from .lexical_search import lexical_search
from .line_dedup import line_dedup
from .lm_scoring import lm_scores
from .mixing import mix_sources
from .piece_bpe import decode_pieces, encode_pieces
from .secret_scan import scan_secrets
from .suffix_dedup import suffix_dedup
from .toxicity import fit, toxicity_scores
from .topk import scaled, top_k


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(id_col: str, n: int) -> Column:
    """``crc32`` of an id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), words=4, percent=85)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decode(encode(table(spark, sf_dir, "documents"), path), path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(crc_mod("doc_id", 5) != 0))
    return toxicity_scores(docs, model).select(
        "doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "evidence"
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256")
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), length=100).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2("base_spans", 256).alias("base_sha256"),
        "spans",
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), crc_mod("doc_id", 10) == 0)


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = scaled(table(spark, sf_dir, "embeddings"))
    return top_k(vectors.filter("vec_id % 50 = 0"), vectors, k=5)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation_reports(rows, damage(rows))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decode_pieces(encode_pieces(table(spark, sf_dir, "documents"), path), path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_bpe": op3_bpe,
    "op4_toxicity": op4_toxicity,
    "op5_mixing": op5_mixing,
    "op6_line_dedup": op6_line_dedup,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_top_k": op10_top_k,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_lexical_search": op12_lexical_search,
    "op13_sentencepiece": op13_sentencepiece,
}

ORACLES = {
    "op1_exact_dedup": r"""
        WITH norm AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
            FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
        FROM norm WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)""",
    "op2_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
            FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                   ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2),
                                  lambda i: array_to_string(w[i:i + 3], ' ')))) END AS s
            FROM words),
        sizes AS (SELECT doc_id, len(s)::BIGINT AS n, md5(s::VARCHAR) AS class FROM sets),
        entries AS (SELECT doc_id, unnest(s) AS e FROM sets),
        common AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i
            FROM entries a JOIN entries b ON a.e = b.e AND a.doc_id < b.doc_id GROUP BY ALL),
        half AS (
            SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
            WHERE 100 * i >= 85 * (a.n + b.n - i)),
        links AS (SELECT x, y FROM half UNION ALL SELECT y, x FROM half),
        reach AS (
            SELECT doc_id, doc_id AS r FROM sizes
            UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.r),
        components AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id),
        others AS (
            SELECT x AS doc_id, count(DISTINCT b.class) AS n_links
            FROM links JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
            WHERE a.class <> b.class GROUP BY x)
        SELECT doc_id, n AS n_shingles, component_id, coalesce(n_links, 0) AS n_links
        FROM sizes JOIN components USING (doc_id) LEFT JOIN others USING (doc_id)""",
    "op10_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::DOUBLE) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   list_inner_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        ranked AS (
            SELECT query_id,
                   row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank,
                   vec_id, score
            FROM pairs)
        SELECT * FROM ranked WHERE rank <= 5""",
    "op11_conversation_repair": r"""
        WITH RECURSIVE crc AS (
            SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
                       lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
        kinds AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(
                       coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                       lambda c: ord(c)::BIGINT)),
                       lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) % 20 AS kind
            FROM conversations, crc),
        damaged AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g')
                        ELSE text END AS text,
                   unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
            FROM kinds WHERE kind <> 0),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i
            FROM damaged),
        faults AS (
            SELECT conv_id, turn, role, text, i, left(role, 1) AS r,
                   CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
                        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault,
                   lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
            FROM placed),
        counts AS (
            SELECT conv_id, count(*) AS n,
                   coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
                   count(*) FILTER (fault = 't') AS truncated,
                   count(*) FILTER (i > 1 AND before || r NOT IN ('su', 'ua', 'au')) AS illegal
            FROM faults GROUP BY conv_id),
        best AS (
            SELECT conv_id, n + 1 AS i,
                   [{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]},
                    {'c': 4::BIGINT, 'a': 'II', 't': ['user:', 'assistant:']},
                    {'c': 2::BIGINT, 'a': 'I', 't': ['assistant:']},
                    {'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}] AS s
            FROM counts
            UNION ALL
            SELECT conv_id, i, list_transform([1, 2, 3, 4], lambda k: list_sort([s[k],
                       {'c': s[[3, 3, 4, 3][k]].c + 2, 'a': 'I' || s[[3, 3, 4, 3][k]].a,
                        't': list_prepend(CASE WHEN k = 3 THEN 'assistant:' ELSE 'user:' END,
                                          s[[3, 3, 4, 3][k]].t)},
                       {'c': s[[4, 4, 3, 4][k]].c + 4, 'a': 'II' || s[[4, 4, 3, 4][k]].a,
                        't': list_concat(CASE WHEN k = 3 THEN ['assistant:', 'user:']
                                              ELSE ['user:', 'assistant:'] END, s[[4, 4, 3, 4][k]].t)}])[1])
            FROM (
                SELECT b.conv_id, f.i, list_transform([1, 2, 3, 4], lambda k: list_sort([
                           {'c': s[k].c + 3, 'a': 'D' || s[k].a, 't': s[k].t},
                           {'c': s[[3, 3, 4, 3][k]].c + 2 + extra, 'a': 'R' || s[[3, 3, 4, 3][k]].a,
                            't': list_prepend(CASE WHEN k = 3 THEN 'assistant:' ELSE 'user:' END || f.text,
                                              s[[3, 3, 4, 3][k]].t)},
                           {'c': coalesce(s[to_[k]].c, 1000000000000) + extra, 'a': 'K' || coalesce(s[to_[k]].a, ''),
                            't': list_prepend(f.role || ':' || f.text, coalesce(s[to_[k]].t, []::VARCHAR[]))}])[1]) AS s
                FROM best b JOIN (
                    SELECT *, CASE fault WHEN 't' THEN 1 WHEN '' THEN 0 ELSE 1000000000000 END AS extra,
                           CASE r WHEN 's' THEN [2, 0, 0, 0] WHEN 'u' THEN [3, 3, 0, 3]
                                  WHEN 'a' THEN [0, 0, 4, 0] ELSE [0, 0, 0, 0] END AS to_
                    FROM faults) f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i - 1)),
        ids AS (SELECT DISTINCT conv_id FROM conversations)
        SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
               coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, coalesce(s[1].c, 0) AS cost, coalesce(s[1].a, '') AS audit,
               sha256(coalesce(array_to_string(s[1].t, chr(10)), '')) AS repaired_sha256
        FROM ids LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id
        LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id AND best.i = 1""",
    "op12_lexical_search": r"""
        WITH terms AS (
            SELECT doc_id, unnest(regexp_extract_all(
                       translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM documents),
        tfs AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
        sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY doc_id),
        totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS occurrences FROM sizes),
        lengths AS (
            SELECT doc_id, 100 - 50 + (50 * n * docs) // occurrences AS m FROM sizes, totals),
        weights AS (
            SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
            FROM tfs, totals GROUP BY term, docs),
        asked AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(
                       translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark),
        scores AS (
            SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
            FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id)
            GROUP BY ALL),
        ranked AS (
            SELECT item_id,
                   row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank,
                   doc_id, score
            FROM scores WHERE score > 0)
        SELECT * FROM ranked WHERE rank <= 50""",
}
