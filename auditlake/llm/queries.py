"""The thin contract queries over the operators of this subpackage, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, exact_dedup, fill_middle, line_dedup, ngram_join, packing, quality, sharding, suffix_dedup, toxicity, vector_codes, warc
from .common import new_path, small_batches

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer(), capacity=4096)


@query
def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), tokenizer())


@query
def op3_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), shards=24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and what is left once repeated passages of 51 words and more are removed too, whatever their bytes."""
    return suffix_dedup.suffix_dedup(documents(spark, sf_dir), least=400, words=51).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_text_removed", "n_text_spans", "n_kept_chars", "kept_text"
    )


@query
def op5_bloom_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = quality.score(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    )


@query
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(documents(spark, sf_dir), words=5, percent=80)


@query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in batches of falling id through one index, so that of equal texts the row with the largest id is met first."""
    docs = documents(spark, sf_dir)
    index = exact_dedup.DigestIndex(spark, new_path(spark, "digest-index"), max(16, -(-docs.count() // exact_dedup.DIGESTS_A_BUCKET)))
    found = exact_dedup.dedup_batches(exact_dedup.falling_batches(docs), index)
    index.close()
    return found


@query
def op9_collision_counting_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.nearest(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def crawl(pages: DataFrame) -> DataFrame:
    """pages as WARC files, one a page: its full response, and a not-modified revisit a day later.

    The rule: every 13th page is revisited an hour before its own response, every
    17th has another entity tag by then, every 19th has it as a weak one and every
    23rd has a date of change only.
    """
    import datetime
    import hashlib

    import pyarrow as pa

    from .common import slices

    begin = datetime.datetime(2024, 1, 1)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                out = []
                for page, url, html in zip(*(part.column(k).to_pylist() for k in range(3))):
                    body = (html or "").encode()
                    tag = '"' + hashlib.sha256(body).hexdigest()[:16] + '"'
                    seen = begin + datetime.timedelta(seconds=page)
                    again = seen + (datetime.timedelta(hours=-1) if page % 13 == 0 else datetime.timedelta(days=1))
                    since = f"{seen:%Y-%m-%dT%H:%M:%SZ}"
                    tag2 = '"changed"' if page % 17 == 0 else "W/" + tag if page % 19 == 0 else tag
                    first = warc.http_block("200 OK", [("Content-Type", "text/html"), ("ETag", tag), ("Last-Modified", since), ("Age", "0"), ("Content-Length", str(len(body)))], body)
                    validator = [("Last-Modified", since)] if page % 23 == 0 else [("ETag", tag2)]
                    second = warc.http_block("304 Not Modified", [*validator, ("Content-Type", "text/plain"), ("Age", "5"), ("Cache-Control", f"max-age={page % 100}"), ("Content-Length", "0")])
                    out.append(
                        warc.record("response", f"urn:page:{page}", url, since, first)
                        + warc.record("revisit", f"urn:again:{page}", url, f"{again:%Y-%m-%dT%H:%M:%SZ}", second, warc.NOT_MODIFIED)
                    )
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["warc"])

    return pages.filter("page_id IS NOT NULL").select("page_id", "url", "html").mapInArrow(run, "warc binary")


@query
def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = warc.resolve(warc.parse_column(crawl(pages), "warc", payloads=False))
    number = lambda c: F.regexp_extract(c, "[0-9]+$", 0).cast("long")
    header = lambda name: F.col("headers")[name]
    return found.select(
        number(F.col("record_id")).alias("page_id"), "canonical_url", "outcome", number(F.col("response_id")).alias("response_page_id"), "payload_sha256", "payload_bytes",
        header("content-type").alias("content_type"), header("content-length").alias("content_length"), header("etag").alias("etag"),
        header("age").alias("age"), header("cache-control").alias("cache_control"), F.size("headers").alias("n_headers"),
    )


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return fill_middle.fill_middle(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


@query
def op13_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity.score(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


ORACLE_SQL["op10_warc_revisits"] = r"""
WITH plain AS (
  SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM pages
), pieces AS (
  SELECT page_id, html,
         regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*', 0)), '^.*@', ''), '^www[0-9]*[.]', ''), ':(80|443)$', '') AS host,
         regexp_extract(u, '^[^/?]*([^?]*)', 1) AS path,
         list_sort(list_filter(string_split(regexp_extract(u, '[?](.*)$', 1), '&'),
                               lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|fbclid|gclid)(=.*)?$'))) AS kept
  FROM plain
), page AS (
  SELECT page_id, sha256(coalesce(html, '')) AS sha, octet_length(encode(coalesce(html, ''))) AS n,
         host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canon
  FROM pieces
), again AS (
  SELECT page_id, canon, page_id + CASE WHEN page_id % 13 = 0 THEN -3600 ELSE 86400 END AS at,
         CASE WHEN page_id % 23 = 0 THEN NULL WHEN page_id % 17 = 0 THEN 'changed' ELSE sha[1:16] END AS tag,
         page_id % 23 <> 0 AND page_id % 17 <> 0 AND page_id % 19 = 0 AS weak
  FROM page
), found AS (
  SELECT a.*, p.page_id AS full_id, p.sha, p.n,
         CASE WHEN p.page_id IS NULL THEN 'missing'
              WHEN a.tag IS NOT NULL THEN CASE WHEN a.tag = p.sha[1:16] THEN 'resolved' ELSE 'mismatch' END
              WHEN a.page_id = p.page_id THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM again a ASOF LEFT JOIN page p ON a.canon = p.canon AND a.at > p.page_id
)
SELECT page_id, canon AS canonical_url, outcome,
       CASE WHEN outcome = 'resolved' THEN full_id END AS response_page_id,
       CASE WHEN outcome = 'resolved' THEN sha END AS payload_sha256,
       CASE WHEN outcome = 'resolved' THEN n END AS payload_bytes,
       CASE WHEN outcome = 'resolved' THEN 'text/html' ELSE 'text/plain' END AS content_type,
       CASE WHEN outcome = 'resolved' THEN n::VARCHAR ELSE '0' END AS content_length,
       CASE WHEN tag IS NULL AND outcome = 'resolved' THEN '"' || sha[1:16] || '"'
            WHEN tag IS NOT NULL THEN CASE WHEN weak THEN 'W/' ELSE '' END || '"' || tag || '"' END AS etag,
       '5' AS age, 'max-age=' || (page_id % 100) AS cache_control,
       CASE WHEN outcome = 'resolved' THEN 6 ELSE 5 END AS n_headers
FROM found
"""


ORACLE_SQL["op8_exact_dedup"] = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


ORACLE_SQL["op5_bloom_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[ \t-\r]+|[ \t-\r]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), judged AS (
  SELECT doc_id, pos, line,
         length(k) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY k) AS gone
  FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def _codes_sql(parts: int = 4, entries: int = 256, scale: int = 1024, rounds: int = 4) -> str:
    """All rounds one after another; doubles hold these whole numbers exactly."""
    nearest = """
a{k} AS MATERIALIZED (
  SELECT vec_id, p, any_value(x) AS x,
         min({{'d': list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), 'e': e}}) AS best
  FROM part JOIN b{k} USING (p) GROUP BY vec_id, p
)"""
    update = """
s{k} AS (
  SELECT p, best.e AS e, i, floor(sum(x[i]) / count(*)) AS v FROM a{j}, unnest(range(1, len(x) + 1)) AS t(i) GROUP BY p, best.e, i
), b{k} AS MATERIALIZED (
  SELECT p, e, coalesce(m.c, o.c) AS c FROM b{j} o LEFT JOIN (SELECT p, e, list(v ORDER BY i) AS c FROM s{k} GROUP BY p, e) m USING (p, e)
)"""
    steps = [nearest.format(k=0)] + [x for k in range(1, rounds + 1) for x in (update.format(k=k, j=k - 1), nearest.format(k=k))]
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), part AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) AS t(p)
), b0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM part WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries})
), {", ".join(steps)}, whole AS (
  SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id
), books AS (
  SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS h FROM (SELECT p, e, i, c[i] AS v FROM b{rounds}, unnest(range(1, len(c) + 1)) AS t(i))
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
FROM whole JOIN kept USING (vec_id), books
"""


ORACLE_SQL["op11_vector_codes"] = _codes_sql()


ORACLE_SQL["op12_fill_in_middle"] = """
WITH seeded AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents
), numbers AS (
  SELECT doc_id, t, n, ('0x' || s[1:8])::UBIGINT AS h1, ('0x' || s[9:16])::UBIGINT AS h2, ('0x' || s[17:24])::UBIGINT AS h3, ('0x' || s[25:32])::UBIGINT AS h4 FROM seeded
), placed AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
                        WHEN 'psm' THEN '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
                        ELSE '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM placed
"""
