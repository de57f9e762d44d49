"""The registered queries of the operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, divergence, filter_audit, knn_graph, lattice_lm, minhash, mixing, positional_index, revisits, toxicity, url_templates
from .common import bucket, table
from .sentencepiece_codec import encode
from .token_counts import count_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The rules of the url query.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Wanted shares of the tokens, by the domains `quality-toxic` of the labels.
TARGETS = {"1-0": 0.85, "0-0": 0.08, "1-1": 0.05, "0-1": 0.02}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def domain_labels(labels: DataFrame) -> DataFrame:
    """`doc_id` and `domain`: quality and toxicity mark of each label."""
    return labels.select("doc_id", F.concat(F.col("quality").cast("string"), F.lit("-"), F.col("toxic").cast("string")).alias("domain"))


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """`page_id` and `good`: a page holds the document whose number is the last in its path."""
    number = F.regexp_extract(url_templates.path_of(F.col("url")), "/([0-9]{1,18})[^/]*/?$", 1)
    of = pages.select("page_id", number.try_cast("long").alias("doc_id"))
    return of.join(labels.select("doc_id", F.col("quality").alias("good")), "doc_id").select("page_id", "good")


@query
def op1_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_templates.judge(pages, page_labels(pages, table(spark, sf_dir, "labels")), URL_RULES)


ORACLE["op1_url_templates"] = url_templates.judge_sql(
    "SELECT page_id, quality AS good FROM split JOIN labels ON doc_id = TRY_CAST(regexp_extract(path, '/([0-9]{1,18})[^/]*/?$', 1) AS BIGINT)", URL_RULES)


def captures(pages: DataFrame) -> DataFrame:
    """Captures of every page, as an archive holds them: a response, a later revisit, for each third page a changed response, and one more
    revisit, for each seventh page before the first response. Pages of a number divisible by 5 have no entity tag, by 35 no validator."""
    p = F.col("page_id")
    tag = F.when(p % 5 != 0, F.concat(F.lit('"'), F.md5(F.encode(F.coalesce("html", F.lit("")), "UTF-8")), F.lit('"')))
    modified = F.when(p % 35 != 0, F.concat(F.lit("day "), F.floor(p / 7).cast("string")))
    other_url = F.concat(F.replace(F.col("url"), F.lit("http://"), F.lit("https://")), F.lit("#again"))

    def record(k: int, url, time, kind: str, etag, date, headers: list) -> object:
        listed = F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(v, F.lit("-")).alias("value")) for n, v in headers])
        return F.struct((4 * p + k).alias("record_id"), url.alias("url"), time.cast("long").alias("time"), F.lit(kind).alias("kind"), etag.alias("etag"), date.alias("last_modified"), listed.alias("headers"))

    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    first = record(0, F.col("url"), p, "response", tag, modified, [("Content-Type", F.lit("text/html")), ("Content-Length", size), ("ETag", tag), ("Cache-Control", F.lit("max-age=60"))])
    again = record(1, other_url, p + 1_000_000, "revisit", F.when(p % 4 == 1, F.concat(F.lit("W/"), tag)).otherwise(tag), modified,
                   [("cache-control", F.lit("max-age=600")), ("content-length", F.lit("0")), ("Age", p.cast("string"))])
    changed = record(2, F.col("url"), p + 2_000_000, "response", F.concat(F.lit('"new'), p.cast("string"), F.lit('"')), F.lit("changed"), [("Content-Type", F.lit("text/html")), ("ETag", tag)])
    last = record(3, F.col("url"), F.when(p % 7 == 0, p - 1).otherwise(p + 3_000_000), "revisit", tag, modified, [("Expires", F.lit("0")), ("Connection", F.lit("close"))])
    return pages.select(F.explode(F.filter(F.array(first, again, F.when(p % 3 == 0, changed), last), lambda r: r.isNotNull())).alias("r")).select("r.*")


@query
def op2_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(captures(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return found.withColumn("headers", F.array_join(F.array_sort(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"]))), "\n"))


ORACLE["op2_revisits"] = f"""WITH base AS (SELECT page_id AS p, url, coalesce(html, '') AS html,
  CASE WHEN page_id % 5 <> 0 THEN '"' || md5(coalesce(html, '')) || '"' END AS tag, CASE WHEN page_id % 35 <> 0 THEN 'day ' || CAST(page_id // 7 AS VARCHAR) END AS modified FROM pages),
records AS (
  SELECT 4 * p AS record_id, url, p AS time, 'response' AS kind, tag AS etag, modified AS last_modified,
    [{{'name': 'Content-Type', 'value': 'text/html'}}, {{'name': 'Content-Length', 'value': CAST(strlen(html) AS VARCHAR)}}, {{'name': 'ETag', 'value': coalesce(tag, '-')}}, {{'name': 'Cache-Control', 'value': 'max-age=60'}}] AS headers FROM base
  UNION ALL SELECT 4 * p + 1, replace(url, 'http://', 'https://') || '#again', p + 1000000, 'revisit', CASE WHEN p % 4 = 1 THEN 'W/' || tag ELSE tag END, modified,
    [{{'name': 'cache-control', 'value': 'max-age=600'}}, {{'name': 'content-length', 'value': '0'}}, {{'name': 'Age', 'value': CAST(p AS VARCHAR)}}] FROM base
  UNION ALL SELECT 4 * p + 2, url, p + 2000000, 'response', '"new' || CAST(p AS VARCHAR) || '"', 'changed',
    [{{'name': 'Content-Type', 'value': 'text/html'}}, {{'name': 'ETag', 'value': coalesce(tag, '-')}}] FROM base WHERE p % 3 = 0
  UNION ALL SELECT 4 * p + 3, url, CASE WHEN p % 7 = 0 THEN p - 1 ELSE p + 3000000 END, 'revisit', tag, modified,
    [{{'name': 'Expires', 'value': '0'}}, {{'name': 'Connection', 'value': 'close'}}] FROM base),
forms AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(url, '://[^?#]*[?]([^#]*)', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '{revisits.TRACKING}'))) AS kept FROM records),
named AS (SELECT record_id, time, kind, etag, last_modified, headers, CASE WHEN contains(url, '://') THEN
  regexp_replace(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ':(80|443)$', '') ||
  regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical FROM forms),
matched AS (SELECT v.record_id, max(row(r.time, r.record_id))[2] AS response_id FROM named v JOIN named r ON v.canonical = r.canonical AND r.time < v.time
  WHERE v.kind = 'revisit' AND r.kind = 'response' GROUP BY v.record_id),
joined AS (SELECT v.record_id, v.canonical, v.time, response_id, v.headers, r.headers AS old,
  CASE WHEN response_id IS NULL THEN 'no_response' WHEN v.etag IS NOT NULL AND r.etag IS NOT NULL THEN CASE WHEN regexp_replace(v.etag, '^W/', '') = regexp_replace(r.etag, '^W/', '') THEN 'validated' ELSE 'mismatch' END
   WHEN v.last_modified IS NOT NULL AND r.last_modified IS NOT NULL THEN CASE WHEN v.last_modified = r.last_modified THEN 'validated' ELSE 'mismatch' END ELSE 'unchecked' END AS status
  FROM named v LEFT JOIN matched m USING (record_id) LEFT JOIN named r ON r.record_id = response_id WHERE v.kind = 'revisit'),
fresh AS (SELECT *, list_filter(headers, lambda h: lower(h.name) NOT IN ({', '.join(f"'{h}'" for h in revisits.KEPT_HEADERS)})) AS new FROM joined)
SELECT record_id, canonical, time, response_id, status, array_to_string(list_sort(list_transform(
  CASE WHEN status = 'validated' THEN list_concat(list_filter(old, lambda o: NOT list_contains(list_transform(new, lambda h: lower(h.name)), lower(o.name))), new) ELSE headers END, lambda h: h.name || ': ' || h.value)), chr(10)) AS headers FROM fresh"""


@query
def op3_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link(table(spark, sf_dir, "documents"), minhash.Near(words=3, percent=85, side=12))


@query
def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_graph.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query
def op5_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return divergence.assess(docs, divergence.language_references(docs))


@query
def op6_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), domain_labels(table(spark, sf_dir, "labels")), TARGETS)


@query
def op7_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.fit_and_score(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), bucket(F.col("doc_id"), 5) == 1)


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.not_held_out())
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (~toxicity.not_held_out()).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE["op11_filter_audit"] = filter_audit.audit_sql()


@query
def op12_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional_index.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op12_positional_index"] = positional_index.decontaminate_sql()


@query
def op13_merge_path_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
