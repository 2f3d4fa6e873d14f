"""One query for each operator, with production parameters over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, exact_dedup, html_main, langid, packing, secret_scan, sharding, simhash, spelling, toxicity, unigram
from .common import fold_of, load


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs.filter(fold_of(F.col("doc_id")) != 1)))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")))


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(load(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encode(load(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(load(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(load(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.count_tokens(load(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    return html_main.extract(pages, html_main.fit(pages))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(load(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(load(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_language_id, op3_toxicity, op4_permutation_index, op5_sharding, op6_sentencepiece, op7_simhash, op8_secret_scan, op9_exact_dedup, op10_token_counts, op11_html_extraction, op12_cross_tokenizer_alignment, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {
        "op9_exact_dedup": r"""
            WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
            g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)""",
        # crc is the table of the checksum by its polynomial; the runs' letters have one or two bytes
        "op13_spelling_variants": r"""
            WITH RECURSIVE t AS (SELECT list(list_reduce(range(8), lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS crc FROM range(256) r(i)),
            found AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS i, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
            each AS (SELECT i, run, count(*) AS n FROM found WHERE length(run) >= 5 GROUP BY i, run),
            h AS (SELECT run, n, xor(4294967295, list_reduce(flatten(list_transform(regexp_extract_all(i || ':' || run, '.'), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [195, ord(c) - 64] END)), lambda v, b: xor(v >> 8, crc[(xor(v, b) & 255) + 1]), 4294967295)) AS h FROM each, t),
            w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
            v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
            d AS (SELECT word, p, substr(word, 1, p - 1) || substr(word, p + 1) AS cut FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM v)),
            one AS (SELECT d.word AS a, v.word AS b FROM d JOIN v ON v.word = d.cut UNION SELECT x.word, y.word FROM d x JOIN d y ON x.p = y.p AND x.cut = y.cut AND x.word <> y.word),
            near AS (SELECT a, b FROM one UNION SELECT b, a FROM one),
            best AS (SELECT a, count(*) AS n_near, min_by(b, (-v.n, b)) AS b, max(v.n) AS m FROM near JOIN v ON v.word = near.b GROUP BY a),
            f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * v.n THEN b END AS form, CASE WHEN m >= 2 * v.n THEN m END AS form_n FROM v LEFT JOIN best ON best.a = v.word),
            walk AS (SELECT word, word AS at FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NOT NULL),
            ends AS (SELECT walk.word, walk.at AS root FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NULL)
            SELECT word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)""",
    }
