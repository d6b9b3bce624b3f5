"""Queries over scalar text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import providers as P
from textloom.functions import text as T
from textloom.operators import language as N
from textloom.registry import derived, plain, query, table, values_sql

#: Scripts, ties and terminators that the driver's tables lack.
SCRIPTS = [
    (1, "안녕하세요 세계"),
    (2, "یہ ایک جملہ ہے"),
    (3, "hello 세계"),
    (4, "가나ab"),
    (5, "اب ab"),
    (6, "한글 عربي abc"),
    (7, "12345 !?"),
    (8, ""),
    (9, "끝났다。 다음 문장！ 마지막"),
    (10, "پہلا جملہ۔ دوسرا؟ تیسرا"),
    (11, "He said \"stop.\" Then left!"),
]
_HANGUL, _ARABIC = r"[\x{AC00}-\x{D7A3}]", r"[\x{0600}-\x{06FF}]"


def scripts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCRIPTS, "doc_id long, text string")


def _with_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text").union(scripts(spark).select(-F.col("doc_id"), "text"))


_UNION = f"(SELECT doc_id, text FROM documents UNION ALL SELECT -doc_id, text FROM {values_sql(SCRIPTS, ['doc_id', 'text'])}) d"


@query("SELECT doc_id, length(text)::BIGINT AS char_count, len(list_filter(regexp_split_to_array(text, '[\\s]+'), lambda x: x <> ''))::BIGINT AS word_count FROM documents")
def text_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("char_count"), T.word_count(F.col("text")).cast("long").alias("word_count"))


_DIRTY = "replace(replace(replace(text, '. ', '.' || chr(13) || chr(10) || chr(9) || '  '), ' the ', ' t-' || chr(10) || 'he' || chr(8205) || ' '), ', ', ',' || chr(10) || chr(10) || chr(10) || chr(10))"


@query(
    f"""WITH d AS (SELECT doc_id, {_DIRTY} AS t FROM documents),
    a AS (SELECT doc_id, regexp_replace(t, '[^\\P{{C}}\\n\\t]', '', 'g') AS t FROM d),
    b AS (SELECT doc_id, regexp_replace(t, '([\\p{{L}}\\p{{N}}_])-\\n([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g') AS t FROM a),
    c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g') AS t FROM b)
    SELECT doc_id, trim(regexp_replace(t, '[ ]+\\n', chr(10), 'g'), ' ' || chr(10) || chr(9)) AS cleaned FROM c"""
)
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.expr(_DIRTY.replace("chr(8205)", "'\\u200d'"))).alias("cleaned"))


@query(
    """WITH p AS (SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS raw, 'page_' || page_id || '-doc.html' AS filename FROM pages)
    SELECT page_id, CASE WHEN page_id % 5 = 0 OR lower(trim(raw)) IN ('word document', 'untitled', '') THEN replace(replace(regexp_replace(filename, '\\.[^.]*$', ''), '_', ' '), '-', ' ') ELSE raw END AS title FROM p"""
)
def title_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("page_"), F.col("page_id"), F.lit("-doc.html"))
    native = F.when(F.col("page_id") % 5 != 0, F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    return table(spark, sf_dir, "pages").select("page_id", T.resolve_title(native, name).alias("title"))


@query(f"SELECT doc_id, CASE WHEN regexp_matches(text, '{_HANGUL}') THEN 'ko' WHEN regexp_matches(text, '{_ARABIC}') THEN 'ur' ELSE 'en' END AS script FROM {_UNION}")
def script_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_scripts(spark, sf_dir).select("doc_id", T.script_presence(F.col("text")).alias("script"))


@query(
    f"""SELECT doc_id, CASE WHEN h > a AND h > n THEN 'ko' WHEN a > h AND a > n THEN 'ur' ELSE 'en' END AS script FROM
    (SELECT doc_id, len(regexp_extract_all(text, '{_HANGUL}')) AS h, len(regexp_extract_all(text, '{_ARABIC}')) AS a, len(regexp_extract_all(text, '[a-zA-Z]')) AS n FROM {_UNION})"""
)
def script_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_scripts(spark, sf_dir).select("doc_id", T.script_majority(F.col("text")).alias("script"))


@query(
    f"""SELECT doc_id, CASE WHEN greatest(a, h, n) = 0 THEN 'eng' WHEN a = greatest(a, h, n) THEN 'urd' WHEN h = greatest(a, h, n) THEN 'kor' ELSE 'eng' END AS engine FROM
    (SELECT doc_id, len(regexp_extract_all(text, '{_HANGUL}')) AS h, len(regexp_extract_all(text, '[\\x{{0600}}-\\x{{06FF}}\\x{{0750}}-\\x{{077F}}]')) AS a, len(regexp_extract_all(text, '[a-zA-Z]')) AS n FROM {_UNION})"""
)
def ocr_script_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_scripts(spark, sf_dir).select("doc_id", T.ocr_script(F.col("text")).alias("engine"))


@query(
    f"""SELECT doc_id, round(CASE WHEN s = 0 THEN 0 ELSE l / s END, 6) AS alpha_ratio FROM
    (SELECT doc_id, len(regexp_extract_all(text, '\\p{{L}}'))::DOUBLE AS l, len(regexp_extract_all(text, '[^\\s]'))::DOUBLE AS s FROM {_UNION})"""
)
def alpha_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_scripts(spark, sf_dir).select("doc_id", F.round(T.alpha_ratio(F.col("text")), 6).alias("alpha_ratio"))


@query(f"""SELECT doc_id, regexp_matches(trim(text, ' ' || chr(10) || chr(9)), '([.!?]["'']?|[۔؟！。])$') AS at_end FROM {_UNION}""")
def boundary_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_scripts(spark, sf_dir).select("doc_id", T.at_sentence_end(F.col("text")).alias("at_end"))


@query(
    f"""SELECT doc_id, len(list_filter(string_split(regexp_replace(trim(text, ' ' || chr(10) || chr(9)), '([.!?۔؟！。])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> ''))::BIGINT AS sentences FROM {_UNION}"""
)
def sentence_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_scripts(spark, sf_dir).select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("sentences"))


@query(
    f"""WITH t AS (SELECT doc_id, replace(text, ' ', '') AS t FROM {_UNION}),
    g AS (SELECT doc_id, CASE WHEN length(t) < 3 THEN t ELSE substr(t, i::INT, 3) END AS gram FROM t, LATERAL (SELECT unnest(range(1, greatest(length(t) - 1, 2))) AS i))
    SELECT gram, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS docs FROM g GROUP BY gram"""
)
def char_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and documents of every character trigram; per-document counts are taken before the distinct."""
    grams = _with_scripts(spark, sf_dir).select("doc_id", F.explode(T.char_ngrams(F.col("text"))).alias("gram"))
    per_doc = grams.groupBy("doc_id", "gram").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("gram").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


@query("SELECT token, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS token FROM documents) GROUP BY token")
def token_counts_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(T.tokens_en(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH s AS (SELECT doc_id, text, CASE WHEN regexp_matches(text, '{_HANGUL}') THEN 'ko' WHEN regexp_matches(text, '{_ARABIC}') THEN 'ur' ELSE 'en' END AS lang, replace(text, ' ', '') AS t FROM {_UNION}),
    k AS (SELECT doc_id, lang, CASE lang WHEN 'ko' THEN regexp_extract_all(text, '{_HANGUL}+') WHEN 'ur' THEN regexp_extract_all(text, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+') ELSE regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') END
      || CASE WHEN lang = 'en' THEN [] WHEN length(t) < 3 THEN [t] ELSE list_transform(range(1, length(t) - 1), lambda i: substr(t, i::INT, 3)) END AS tokens FROM s)
    SELECT doc_id, lang, array_to_string(tokens, '|') AS tokens FROM k"""
)
def tokens_by_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokenizer routing over documents and the multilingual fixture."""
    df = _with_scripts(spark, sf_dir)
    return df.select("doc_id", T.script_presence(F.col("text")).alias("lang"), F.array_join(T.tokens(F.col("text"), F.lit(None).cast("string")), "|").alias("tokens"))


#: A turn and what the next turn makes of it, some of them with the openings of a refusal.
GUARDED = """SELECT conv_id, turn, text AS raw, CASE length(text) % 5 WHEN 0 THEN 'I CANNOT ' || said WHEN 1 THEN 'the corpus doesn''t say' WHEN 2 THEN '  a ' WHEN 3 THEN 'i cannot assist ' || said ELSE said END AS rewritten
    FROM (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS said FROM {conversations}) t WHERE said IS NOT NULL"""


@query(
    f"""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(rewritten), 'cannot|corpus doesn''t|corpus does not|i don''t have|i''m unable|no information|not contain') OR length(rewritten) > 300 THEN raw ELSE rewritten END AS used,
    length(trim(rewritten)) >= 3 AND NOT (regexp_matches(lower(rewritten), 'user safety:|i cannot assist|i''m unable to help with that') AND length(rewritten) < 60) AS valid FROM ({plain(GUARDED)})"""
)
def rewrite_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = derived(spark, sf_dir, GUARDED)
    return df.select("conv_id", "turn", T.guarded_rewrite(F.col("raw"), F.col("rewritten")).alias("used"), T.valid_answer(F.col("rewritten")).alias("valid"))


#: A turn's sentences as a model's lines; the question is the first of them, another turn's role, or the lines are none.
PARSED = """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role ELSE substr(text, 1, 12) END AS query,
    CASE length(text) % 4 WHEN 0 THEN 'single' WHEN 1 THEN ' ' || chr(10) || ' ' WHEN 2 THEN role || chr(10) || ' ' || replace(text, '. ', chr(10)) ELSE replace(text, '. ', '. ' || chr(10) || chr(10) || '  ') END AS raw FROM {conversations}"""


@query(
    f"""WITH l AS (SELECT conv_id, turn, query, raw, list_filter(list_transform(string_split(raw, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM ({plain(PARSED)}))
    SELECT conv_id, turn, array_to_string(list_slice(CASE WHEN list_contains(lines, query) THEN lines ELSE [query] || lines END, 1, 4), '|') AS variants,
    array_to_string(CASE WHEN upper(trim(raw)) = 'SINGLE' OR len(lines) = 0 THEN [query] ELSE lines END, '|') AS parts FROM l"""
)
def query_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = derived(spark, sf_dir, PARSED)
    return df.select(
        "conv_id",
        "turn",
        F.array_join(T.query_variants(F.col("query"), F.col("raw")), "|").alias("variants"),
        F.array_join(T.sub_queries(F.col("query"), F.col("raw")), "|").alias("parts"),
    )


@query()
def language_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of every document by n-gram profiles of the labelled ones, as (language, probability) lists."""
    docs = table(spark, sf_dir, "documents")
    found = N.distribution(F.col("text"), N.learn(docs))
    return docs.select("doc_id", found.alias("languages")).select("doc_id", "languages", P.primary_language(F.col("languages")).alias("primary_language"))
