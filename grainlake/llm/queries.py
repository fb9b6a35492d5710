"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, context_mixing, quality, ranked_search, token_files, toxicity, url_filters, vector_codes, warc
from .bpe import token_digests
from .common import fresh_path, read_table
from .decontaminate import contaminated, contamination
from .html_extract import extract
from .simhash import near_duplicates


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    model = context_mixing.fit(docs.where(~held_out))
    return context_mixing.score(docs, model, learned=~held_out).select(
        F.col("id").alias("doc_id"),
        (F.crc32(F.col("id").cast("string")) % 7 == 2).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        "bits_per_byte",
    )


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.turns_of_rows(read_table(spark, sf_dir, "conversations"))
    hard = "\\### Assistant: </turn> ok"
    record = json.dumps({"messages": [{"role": role, "content": hard} for role in ("user", "assistant")]})
    more = chat.turns_of_json(spark.range(1).select(F.lit(-7).alias("record"), F.lit(record).alias("json")), "record", "json")
    made = chat.format_turns(rows.unionByName(more))
    read = made.select("*", chat.parse_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("record").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP3_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
coded AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\e') AS c FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, c)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, c) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(c) + 14) AS BIGINT) AS formatted_chars
FROM coded GROUP BY conv_id
""".replace("\\\\", "\\")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(read_table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.measure(docs, model).withColumnRenamed("id", "doc_id")


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels that toxicity may be learned from; the others are held out."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, training_labels(read_table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select(
        F.col("id").alias("doc_id"),
        (F.crc32(F.col("id").cast("string")) % 5 == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_warc(read_table(spark, sf_dir, "pages"), path)
    read = warc.read_warc(spark, path, with_payload=False)
    return read.select(
        warc.page_id(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.page_id(F.col("refers_to")).alias("refers_to"),
    )


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
  min(page_id) OVER (PARTITION BY sha256(h)) AS first_id FROM p),
r AS (SELECT *, payload_bytes >= 100 AND page_id <> first_id AS again FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first_id END AS refers_to
FROM r
"""


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = tokenizer_path("byte_bpe_50k.tiktoken"), token_pattern()
    return token_digests(read_table(spark, sf_dir, "documents"), *tokenizer).withColumnRenamed("id", "doc_id")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "token-files")
    docs = read_table(spark, sf_dir, "documents")
    manifest = token_files.write_token_files(docs, folder, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return token_files.crc_of_ids(token_files.read_token_files(manifest, folder)).withColumnRenamed("id", "doc_id")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked_search.build_index(read_table(spark, sf_dir, "documents"))
    found = ranked_search.search(index, read_table(spark, sf_dir, "benchmark"), 10)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


OP11_SQL = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
len AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
tot AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM len),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), tot),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN len USING (doc_id), tot GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= 10
"""

#: The rules of the query: those by host and path, and the library's patterns.
URL_RULES = [
    *(url_filters.place_rule(host, path, allow) for host, path, allow in (("org", "/", True), ("example.org", "/es/", False), ("example.org", "/en/1", False), ("com", "/fr/", True), ("com", "/de/", False))),
    *(url_filters.pattern_rule(p) for p in url_filters.PATTERNS),
]


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(read_table(spark, sf_dir, "pages"), URL_RULES).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "pattern")


def url_sql(rules: list[url_filters.Rule]) -> str:
    """All rules on all urls, without an index: the highest rank of those that match."""
    rows = ", ".join("({rank}, '{text}', {allow}, {place}, '{regex}')".format(**{k: str(v).replace("'", "''") for k, v in r.items()}) for r in url_filters.build_index(rules, {}))
    return rf"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{url_filters.UPPER}', '{url_filters.LOWER}'), '') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(rank, text, allow, place, regex) AS (VALUES {rows}),
distinct_urls AS (SELECT DISTINCT url, host, path FROM u),
hit AS (SELECT url, max_by(r, r.rank) AS best FROM distinct_urls, r WHERE regexp_matches(CASE WHEN place THEN host || path ELSE translate(url, '{url_filters.UPPER}', '{url_filters.LOWER}') END, regex) GROUP BY url)
SELECT page_id, host, path, CASE WHEN best.place THEN best.text END AS rule, CASE WHEN coalesce(best.allow, TRUE) THEN 'allow' ELSE 'block' END AS verdict,
  CASE WHEN NOT best.place THEN best.text END AS pattern FROM u LEFT JOIN hit USING (url)
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    books = vector_codes.fit(vectors)
    if books is None:
        return vectors.where("false").select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = vector_codes.with_label_error(vector_codes.encode(vectors, books))
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def codes_sql(rounds: int = 4, size: int = 256) -> str:
    """Every part against every entry, round by round."""
    assign = """a{k} AS MATERIALIZED (SELECT p, vec_id, arg_min(i, d * 256 + i) AS i, min(d) AS d FROM
  (SELECT x.p, x.vec_id, c.i, CAST(list_sum(list_transform(list_zip(x.a, c.a), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM parts x JOIN c{k} c USING (p)) GROUP BY p, vec_id)"""
    update = """c{n} AS MATERIALIZED (SELECT c.p, c.i, coalesce(u.a, c.a) AS a FROM c{k} c LEFT JOIN (SELECT p, i, list(CAST(floor(s / n) AS BIGINT) ORDER BY e) AS a FROM
  (SELECT p, i, e, CAST(sum(v) AS DOUBLE) AS s, count(*) AS n FROM (SELECT x.p, a.i, unnest(range(16)) AS e, unnest(x.a) AS v FROM parts x JOIN a{k} a USING (p, vec_id)) GROUP BY p, i, e) GROUP BY p, i) u USING (p, i))"""
    steps = ",\n".join(s for k in range(rounds) for s in (assign.format(k=k), update.format(k=k, n=k + 1)))
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p, v[16 * p + 1 : 16 * p + 16] AS a FROM kept, (SELECT unnest(range(4)) AS p)),
c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS i, a FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {size})),
{steps},
{assign.format(k=rounds)},
e AS (SELECT vec_id, string_agg(printf('%02x', CAST(i AS INT)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, i, e)) AS codebooks_sha256 FROM (SELECT p, i, unnest(range(16)) AS e, unnest(a) AS v FROM c{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN kept USING (vec_id), h
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_scoring, op2_simhash_near_dedup, op3_chat_formatting, op4_html_extraction, op5_quality_rules, op6_toxicity, op7_warc_revisits, op8_byte_bpe, op9_token_files, op10_benchmark_decontamination, op11_ranked_search, op12_url_filters, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_chat_formatting": OP3_SQL,
        "op7_warc_revisits": OP7_SQL,
        "op11_ranked_search": OP11_SQL,
        "op12_url_filters": url_sql(URL_RULES),
        "op13_vector_codes": codes_sql(),
    }
