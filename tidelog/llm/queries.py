"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import table
from tidelog.llm.decontaminate import decontaminate
from tidelog.llm.exact_dedup import exact_dedup
from tidelog.llm.language_id import identify_language
from tidelog.llm.line_dedup import line_dedup
from tidelog.llm.mixing import mix_sources
from tidelog.llm.ngram_join import ngram_join
from tidelog.llm.quality import classify_quality
from tidelog.llm.secret_scan import secret_scan
from tidelog.llm.sharding import shard
from tidelog.llm.substring_dedup import substring_dedup


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base spans always, weak parts where they complete one another. A null text has none."""
    return secret_scan(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that stand earlier together with a neighbour: chunks first, then the pairs that chunks leave. A null text has no lines."""
    found = line_dedup(table(spark, sf_dir, "documents"), every_run=True)
    return found.select("doc_id", "n_lines", "n_removed", "removed", F.sha2("clean_text", 256).alias("clean_sha256"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision of every document. Null and blank texts score 0 and are rejected."""
    return classify_quality(table(spark, sf_dir, "documents")).select("doc_id", "keep", "quality_score", "weak_posterior")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component, class and number of links of every document. Null and blank texts link with nothing."""
    return ngram_join(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and survivor of every document, by its text without white space. A null text counts as empty."""
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, by the law of bytes. Null texts are one group."""
    return shard(table(spark, sf_dir, "documents"), shards=8)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document. A null text has none, a null source comes last."""
    return mix_sources(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document. A null text, and one without a letter, is und."""
    return identify_language(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that leak into every document. Null texts hold none."""
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", F.array_join(F.transform("item_ids", lambda x: x.cast("string")), ",").alias("item_ids"), F.size("leaks").cast("long").alias("n_leaks"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a window covers which starts earlier elsewhere. A null text has none."""
    return substring_dedup(table(spark, sf_dir, "documents"), with_text=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secret_scan, op2_line_dedup, op3_quality_classifier, op4_ngram_join, op5_exact_dedup, op6_sharding, op7_mixing, op8_language_id, op9_decontamination, op10_substring_dedup)}

#: The words of a text, in DuckDB's SQL.
_WORDS = r"""list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"""

SQL = {
    "op5_exact_dedup": r"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, sha256(bare) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY bare ORDER BY n_chars DESC, doc_id)""",
    "op4_ngram_join": rf"""
        WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
        s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(words[start + 1 : start + 5], ' ') AS sh FROM (SELECT doc_id, words, unnest(range(0, greatest(len(words) - 4, CASE WHEN len(words) > 0 THEN 1 ELSE 0 END))) AS start FROM w)),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        links AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL)
            JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 75 * (na.n + nb.n - shared)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, (SELECT count(*) FROM links l WHERE l.a = w.doc_id) AS n_links, CASE WHEN len(words) = 0 THEN w.doc_id ELSE min(w.doc_id) OVER (PARTITION BY array_to_string(words, ' ')) END AS class_id
        FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = w.doc_id""",
    "op10_substring_dedup": rf"""
        WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
        s AS MATERIALIZED (SELECT doc_id, start, md5(array_to_string(words[start + 1 : start + 20], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(0, len(words) - 19)) AS start FROM w)),
        later AS (SELECT doc_id, start FROM s QUALIFY (doc_id, start) > min((doc_id, start)) OVER (PARTITION BY h)),
        gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS i FROM later),
        kept AS (SELECT p.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p.i) AS text
            FROM (SELECT doc_id, unnest(words) AS word, unnest(range(0, len(words))) AS i FROM w) p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id)
        SELECT w.doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id""",
}
