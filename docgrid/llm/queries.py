"""The registered queries of this subpackage and their SQL."""

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.llm import decontam, exact_dedup, html_text, lexical_search, licenses, line_dedup, packing, quality, resampling, simhash, suffix_dedup, token_counts, toxicity
from docgrid.functions.lineage import scratch
from docgrid.llm.common import held_out, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(packing.VOCABULARY))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(documents, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("sentences").alias("n_offending"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.shared_passages(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a cache of its own for each call, so that every run counts; jobs that share one pass its folder
    cache = f"{scratch(spark)}/token-counts-{uuid.uuid4().hex}"
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), cache)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = quality.score_quality(documents, quality.fit_quality(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    kept = line_dedup.drop_lines(documents, line_dedup.line_bitmaps(documents))
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_packing, op3_exact_dedup, op4_toxicity, op5_simhash, op6_decontamination, op7_suffix_dedup, op8_html_extraction, op9_token_counts, op10_quality, op11_line_dedup, op12_importance_resampling, op13_lexical_search)}

ORACLE_SQL = {
    "op3_exact_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        n AS (SELECT doc_id, length(t) AS n, sha256(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM d)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER w AND n = first_value(n) OVER w AS kept, text_sha256
        FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
    """,
    "op7_suffix_dedup": r"""
        WITH t AS (SELECT DISTINCT doc_id, coalesce(text, '') AS t FROM documents),
        d AS (SELECT row_number() OVER () AS n, doc_id, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t),
        p AS (SELECT n, CAST(s - 1 AS BIGINT) AS start, md5(array_to_string(w[s:s + 49], ' ')) AS passage FROM (SELECT n, w, unnest(generate_series(1, len(w) - 49)) AS s FROM d)),
        r AS (SELECT n, start FROM p WHERE passage IN (SELECT passage FROM p GROUP BY passage HAVING min(n) <> max(n))),
        i AS (SELECT *, CASE WHEN start > coalesce(lag(start) OVER (PARTITION BY n ORDER BY start), -51) + 50 THEN 1 ELSE 0 END AS new FROM r),
        g AS (SELECT *, sum(new) OVER (PARTITION BY n ORDER BY start) AS island FROM i),
        f AS (SELECT n, min(start) AS start_word, max(start) + 50 AS end_word FROM g GROUP BY n, island)
        SELECT doc_id, start_word, end_word, end_word - start_word AS n_words FROM f JOIN d USING (n)
    """,
    "op11_line_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
        k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        s AS (SELECT key, min(doc_id) AS first_id, count(doc_id) = 0 AS unnamed FROM k WHERE length(key) >= 10 GROUP BY key),
        g AS (SELECT r, pos, line, s.key IS NOT NULL AND NOT s.unnamed AND k.doc_id IS DISTINCT FROM first_id AS lost FROM k LEFT JOIN s ON k.key = s.key),
        o AS (SELECT r, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '') AS kept FROM g GROUP BY r)
        SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN o USING (r)
    """,
    "op12_importance_resampling": r"""
        WITH crc AS (SELECT list(v ORDER BY b) AS tab FROM (SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS b))),
        a AS (SELECT 'd' AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 'b', 0, NULL, text FROM benchmark),
        w AS (SELECT side, r, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS word FROM a),
        h AS (SELECT word, hex(encode(word)) AS hex FROM (SELECT DISTINCT word FROM w)),
        y AS (SELECT word, list_transform(range(length(hex) // 2), lambda i: CAST('0x' || substr(hex, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS bytes FROM h),
        f AS (SELECT word, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, x: xor(c >> 8, tab[1 + (xor(c, x) & 255)]))) % 10000 AS bucket FROM y, crc),
        m AS (SELECT side, r, bucket, count(*) AS n FROM w JOIN f USING (word) GROUP BY side, r, bucket),
        c AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM m GROUP BY bucket),
        z AS (SELECT CAST(sum(s) AS DOUBLE) AS s_all, CAST(sum(t) AS DOUBLE) AS t_all FROM c),
        g AS (SELECT bucket, CAST(floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)) / ((s + 1)::DOUBLE * (t_all + 10000)))) AS BIGINT) AS gain FROM c, z),
        x AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM m JOIN g USING (bucket) WHERE side = 'd' GROUP BY r),
        d AS (SELECT r, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM a LEFT JOIN x USING (r) WHERE side = 'd'),
        e AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d),
        o AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS nth FROM e)
        SELECT doc_id, n_features, weight, score, CASE WHEN nth <= (SELECT count(nth) * 10 // 100 FROM o) THEN nth END AS rank FROM o
    """,
    "op13_lexical_search": r"""
        WITH a AS (SELECT 'd' AS side, row_number() OVER () AS r, doc_id AS id, text FROM documents UNION ALL SELECT 'b', 0, item_id, text FROM benchmark),
        w AS (SELECT side, r, id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM a),
        tf AS (SELECT r, id AS doc_id, term, count(*) AS tf FROM w WHERE side = 'd' GROUP BY r, id, term),
        n AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
        z AS (SELECT count(*) AS n_documents, sum(n)::BIGINT AS n_terms FROM n),
        df AS (SELECT term, CAST(floor(1000 * ln((2 * n_documents + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), z),
        q AS (SELECT DISTINCT id AS item_id, term FROM w WHERE side = 'b'),
        s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_documents) // n_terms))))::BIGINT AS score FROM q JOIN df USING (term) JOIN tf USING (term) JOIN n USING (r), z GROUP BY item_id, r, doc_id),
        o AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
    """,
}
