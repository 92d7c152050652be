"""Queries p7_ to p9_ and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoplane.llm import bpe, packing, quality
from chronoplane.session import materialise
from chronoplane.tables import table


def spread(df: DataFrame) -> DataFrame:
    """The rows as they lie, a scan's splits; only where these are fewer than the cores, as for one small file, they are shuffled once over all cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_corpus(spread(table(spark, folder, "documents").select("doc_id", "text")), "doc_id", "text")


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(table(spark, folder, "documents").select("doc_id", "text").where("text <> ''"))
    # texts are encoded once, their lengths are read twice
    lengths = materialise(bpe.encode_corpus(docs, "doc_id", "text", lengths_only=True), "token-lengths")
    return packing.pack_items(lengths, "doc_id", "tokens")


def p8_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the containers: how many documents lie in them, and no container overfull, no document of at most a container's length cut, none with tokens missing or twice."""
    docs = table(spark, folder, "documents").select("doc_id", "text").where("text <> ''")
    lengths = materialise(bpe.encode_corpus(spread(docs), "doc_id", "text", lengths_only=True), "token-lengths")
    packed = materialise(packing.pack_items(lengths, "doc_id", "tokens"), "containers")
    each = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("tokens").alias("packed")).join(lengths, "doc_id", "full")
    documents = each.agg(
        F.count("packed").alias("documents"), F.count_if((F.col("tokens") <= packing.CAPACITY) & (F.col("parts") > 1)).alias("cut"), F.count_if(~F.col("packed").eqNullSafe(F.col("tokens"))).alias("other_length")
    )
    fills = packed.groupBy("container").agg(F.sum("tokens").alias("fill")).agg(F.count_if(F.col("fill") > packing.CAPACITY).alias("overfull"))
    both = documents.unionByName(fills, allowMissingColumns=True)
    return both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("documents", "cut", "other_length", "overfull")])


def _quality(spark: SparkSession, folder: str) -> DataFrame:
    # a fixed table of frequent words, some 170 rows at every scale
    words = frozenset(r[0] for r in table(spark, folder, "common_words").select(F.lower("word")).where("word is not null").distinct().collect())
    return quality.text_quality(spread(table(spark, folder, "documents").select("doc_id", "text")), "doc_id", "text", words)


def p9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return _quality(spark, folder)


def p9_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """The counts and ratios, without the layout."""
    ratios = ("mean_word_length", "symbol_ratio", "digit_ratio", "punctuated_lines", "common_words", "distinct_words")
    return _quality(spark, folder).select("doc_id", "words", *[F.round(c, 9).alias(c) for c in ratios])


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _quality(spark, folder).where("not is_prose").select("doc_id")


QUERIES = {f.__name__: f for f in (p7_ids, p8_containers, p8_checks, p9_found, p9_quality, p9_statistics)}
#: Encoding, packing and judging the layout of texts can't be written in SQL: they are tested against brute force, bounds and fixtures.
SQL: dict[str, str] = {"p8_checks": "SELECT count(*) AS documents, 0 AS cut, 0 AS other_length, 0 AS overfull FROM documents WHERE text <> ''"}

SQL["p9_statistics"] = r"""
WITH t AS (SELECT doc_id, CASE WHEN regexp_matches(text, '[^ \t\n\x0B\f\r]') THEN text END AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '\pL+(?:[''’]\pL+)*') AS words, length(regexp_replace(text, '[ \t\n\x0B\f\r]', '', 'g')) AS seen,
        string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS lines FROM t),
l AS (SELECT doc_id, count(*) AS n, count(*) FILTER (regexp_matches(line, '[.!?…][''"”’»)\]]*[ \t\n\x0B\f\r]*$')) AS ended FROM (SELECT doc_id, unnest(lines) AS line FROM w) WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]') GROUP BY doc_id),
u AS (SELECT doc_id, count(DISTINCT lower(word)) AS different, count(*) FILTER (lower(word) IN (SELECT lower(word) FROM common_words WHERE word IS NOT NULL)) AS frequent, sum(length(word)) AS letters FROM (SELECT doc_id, unnest(words) AS word FROM w) GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN len(words) END AS words,
       CASE WHEN text IS NOT NULL THEN round(coalesce(letters / nullif(len(words), 0), 0), 9) END AS mean_word_length,
       CASE WHEN text IS NOT NULL THEN round((seen - length(regexp_replace(text, '[^\pL\pN]', '', 'g'))) / seen, 9) END AS symbol_ratio,
       CASE WHEN text IS NOT NULL THEN round(length(regexp_replace(text, '[^0-9]', '', 'g')) / seen, 9) END AS digit_ratio,
       CASE WHEN text IS NOT NULL THEN round(ended / n, 9) END AS punctuated_lines,
       CASE WHEN text IS NOT NULL THEN round(coalesce(frequent / nullif(len(words), 0), 0), 9) END AS common_words,
       CASE WHEN text IS NOT NULL THEN round(coalesce(different / nullif(len(words), 0), 0), 9) END AS distinct_words
FROM w LEFT JOIN l USING (doc_id) LEFT JOIN u USING (doc_id)
"""
