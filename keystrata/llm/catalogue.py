"""The registered queries of this subpackage, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from keystrata.llm.decontaminate import contaminations
from keystrata.llm.exact_dedup import exact_groups
from keystrata.llm.jaccard_join import jaccard_links
from keystrata.llm.licences import MOST_LINES, TEMPLATES, THRESHOLD, scan_licences
from keystrata.llm.line_dedup import dedup_lines
from keystrata.llm.main_text import extract_main_text
from keystrata.llm.mixing import mix_sources
from keystrata.llm.text import read_table, vocabulary
from keystrata.llm.token_files import token_files
from keystrata.llm.toxicity import score_toxicity, train
from keystrata.llm.warc import archive_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def keep(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return keep


@query(
    "op3_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"), smallest=False)


@query("op7_token_files")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark, read_table(spark, sf_dir, "documents"), vocabulary(), end_id=2)


@query(
    "op10_warc",
    """
    WITH p AS (
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
    ), o AS (
        SELECT payload_digest, min(page_id) AS owner FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
    )
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN owner IS NOT NULL AND owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN owner <> page_id THEN owner END AS refers_to
    FROM p LEFT JOIN o USING (payload_digest)
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(spark, read_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op1_main_text")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read_table(spark, sf_dir, "pages"))


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, read_table(spark, sf_dir, "labels")))


@query(
    "op8_jaccard_join",
    r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
    ), g AS (
        SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [''] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
               ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS gram FROM w
    ), s AS (
        SELECT DISTINCT doc_id, gram FROM g
    ), n AS (
        SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
    ), pairs AS (
        SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (gram) JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
        WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING count(*) >= 0.8 * (x.n + y.n - count(*))
    ), reach AS (
        SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, p.b FROM reach r JOIN pairs p ON p.a = r.seen
    )
    SELECT node AS doc_id, min(seen) AS class_id, (SELECT count(*) FROM pairs p WHERE p.a = node) AS n_links FROM reach GROUP BY node
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_links(spark, read_table(spark, sf_dir, "documents"))


@query("op4_decontaminate")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query(
    "op5_mixing",
    r"""
    WITH d AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
               md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':mix') AS key FROM documents
    ), s AS (
        SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM d GROUP BY source
    ), w AS (
        SELECT *, number % 3 + 1 AS weight, CAST(sum(source_size) OVER () AS BIGINT) AS total, 3.0::DOUBLE * source_size / (number % 3 + 1) AS ratio FROM s
    ), l AS (
        SELECT *, (total - coalesce(sum(3 * source_size) OVER (ORDER BY ratio, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
               / (sum(weight) OVER (ORDER BY ratio, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w
    ), t AS (
        SELECT *, least(3.0::DOUBLE * source_size, (SELECT max(level) FROM l WHERE level <= ratio) * weight) AS target FROM l
    ), r AS (
        SELECT doc_id, size, source_size, target, CAST(round(target) AS BIGINT) AS wanted,
               CAST(sum(size) OVER (PARTITION BY number ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS start
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
    )
    SELECT doc_id, size, source_size, target,
           CASE WHEN size = 0 THEN 0 ELSE CAST(wanted // source_size * size + greatest(0, least(size, wanted % source_size - start)) AS BIGINT) END AS taken
    FROM r
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark, read_table(spark, sf_dir, "documents")).drop("source")


@query(
    "op6_line_dedup",
    r"""
    WITH d AS (
        SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
    ), l AS (
        SELECT doc_id, unnest(range(len(lines))) AS line_no, unnest(lines) AS raw FROM d
    ), t AS (
        SELECT doc_id, line_no, regexp_extract_all(raw, '[^\x20\x09-\x0D]+') AS words FROM l
    ), o AS (
        SELECT words, min((doc_id, line_no)) AS place, count(*) AS n FROM t WHERE len(words) > 0 GROUP BY words
    ), v AS (
        SELECT words, place, len(words) AS n, unnest(range(len(words))) AS p FROM o WHERE len(words) >= 4
    ), k AS (
        SELECT words, place, n, p, words[1:p] || words[p + 2:] AS rest FROM v
    ), near AS (
        SELECT a.words FROM k a JOIN k b ON a.rest = b.rest AND a.p = b.p WHERE b.place < a.place AND a.n >= 5
        UNION SELECT a.words FROM k a JOIN o b ON a.rest = b.words WHERE b.place < a.place AND a.n >= 5
        UNION SELECT b.words FROM k a JOIN o b ON a.rest = b.words WHERE a.place < b.place AND a.n >= 5
    ), gone AS (
        SELECT t.doc_id, t.line_no FROM t JOIN o USING (words) WHERE (t.doc_id, t.line_no) > o.place OR t.words IN (SELECT words FROM near)
    )
    SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE g.line_no IS NULL) AS n_kept,
           coalesce(string_agg(l.raw, chr(10) ORDER BY l.line_no) FILTER (WHERE g.line_no IS NULL), '') AS text
    FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line_no = g.line_no GROUP BY l.doc_id
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark, read_table(spark, sf_dir, "documents"))


def _licence_sql() -> str:
    values = ", ".join(f"('{name}', {k}, '{text}')" for name, texts in TEMPLATES.items() for k, text in enumerate(texts))
    split = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda t: t <> '')"
    return f"""
    WITH tpl(licence, template, body) AS (VALUES {values}
    ), tt AS (
        SELECT licence, template, unnest({split.format("body")}) AS term FROM tpl
    ), tc AS (
        SELECT licence, template, term, count(*) AS c FROM tt GROUP BY ALL
    ), d AS (
        SELECT doc_id, coalesce(source, '_') || '/' || coalesce(lang, '_') || '/' || coalesce(CAST(doc_id AS VARCHAR), '_') AS path, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
    ), l AS (
        SELECT path, unnest(range(len(lines))) AS line_no, unnest(lines) AS line FROM d
    ), df AS (
        SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct({split.format("line")})) AS term FROM l) GROUP BY term
    ), idf AS (
        SELECT term, ln(((SELECT count(*) FROM l) + 1) / (coalesce(n, 0) + 1)::DOUBLE) AS idf FROM (SELECT DISTINCT term FROM tt) FULL JOIN df USING (term)
    ), u AS (
        SELECT path, lines, n_lines, unnest(range(len(lines) - n_lines + 1)) AS line_no FROM d, range(1, {MOST_LINES} + 1) r(n_lines) WHERE n_lines <= len(lines)
    ), w AS (
        SELECT path, line_no, n_lines, unnest({split.format("array_to_string(lines[line_no + 1:line_no + n_lines], chr(10))")}) AS term FROM u
    ), tw AS (
        SELECT licence, template, term, (1 + ln(c)) * idf AS weight FROM tc JOIN idf USING (term)
    ), tn AS (
        SELECT licence, template, sqrt(sum(weight * weight)) AS norm FROM tw GROUP BY ALL
    ), kw AS (
        SELECT path, line_no, n_lines, term, (1 + ln(count(*))) * any_value(idf) AS weight FROM w JOIN idf USING (term) GROUP BY ALL
    ), kn AS (
        SELECT path, line_no, n_lines, sqrt(sum(weight * weight)) AS norm FROM kw GROUP BY ALL
    ), s AS (
        SELECT path, line_no, n_lines, licence, round(sum(kw.weight * tw.weight / tn.norm) / any_value(kn.norm), 6) AS score
        FROM kw JOIN tw USING (term) JOIN tn USING (licence, template) JOIN kn USING (path, line_no, n_lines)
        WHERE tn.norm > 0 AND kn.norm > 0 GROUP BY path, line_no, n_lines, licence, template
    ), own AS (
        SELECT path, score, line_no, n_lines, licence AS own_licence FROM s WHERE score >= {THRESHOLD}
        QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, n_lines, line_no, licence) = 1
    ), votes AS (
        SELECT regexp_replace(path, '/[^/]*$', '') AS dir, own_licence, count(*) AS n FROM own GROUP BY ALL
    ), dirs AS (
        SELECT dir, own_licence AS dir_licence FROM votes QUALIFY row_number() OVER (PARTITION BY dir ORDER BY n DESC, own_licence) = 1
    )
    SELECT doc_id, own_licence, score, line_no, n_lines, coalesce(own_licence, dir_licence) AS licence, CASE WHEN own_licence IS NULL THEN dir END AS inherited_from
    FROM d LEFT JOIN own USING (path) LEFT JOIN dirs ON dir = regexp_replace(d.path, '/[^/]*$', '')
    """


@query("op2_licences", _licence_sql())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree source/lang/doc_id; directories are spoken for by their files' notices."""
    files = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("_")) for c in ("source", "lang", "doc_id"))).alias("path"), "text")
    return scan_licences(spark, files, by_header=True).withColumnRenamed("id", "doc_id").drop("path")


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
