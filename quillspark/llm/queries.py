"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import frames
from quillspark.llm.chat_format import expand, format_conversations, read_examples
from quillspark.llm.decontaminate import leaks
from quillspark.llm.filter_audit import audit, mask_counts
from quillspark.llm.fingerprints import edit_fingerprints
from quillspark.llm.license_scan import scan_licenses
from quillspark.llm.line_dedup import dedup_lines
from quillspark.llm.minhash_dedup import near_duplicates
from quillspark.llm.multi_index import neighbours
from quillspark.llm.packing import pack, tokenize_pieces
from quillspark.llm.quality import QualityModel, score_quality, train_quality
from quillspark.llm.secrets import scan_secrets
from quillspark.llm.timestamps import normalise
from quillspark.llm.url_filter import judge_urls

#: Least probability of quality 1 that a document is kept with.
QUALITY_THRESHOLD = 0.3

#: The URL rules that op4 applies: verdict, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> QualityModel:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return train_quality(docs, labels.filter(~held_out()))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(frames.documents(spark, sf_dir), words=3, per_cent=85, halves=10, rows=4)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(frames.documents(spark, sf_dir))


def packed(docs: DataFrame) -> DataFrame:
    pieces = tokenize_pieces(docs, tokenizer_path()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(frames.cut(pieces))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(frames.documents(spark, sf_dir))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return judge_urls(pages, rules, default="allow").select("page_id", "host", "path", "rule", "verdict")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(frames.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = edit_fingerprints(frames.documents(spark, sf_dir))
    return prints.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frames.documents(spark, sf_dir)
    scored = score_quality(docs, quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def _joined_spans(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of_kinds(*kinds: str):
    return lambda span: span["kind"].isin(*kinds)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(frames.documents(spark, sf_dir))
    counts = [F.size(F.filter("spans", _of_kinds(k))).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    base = _joined_spans(F.filter("spans", _of_kinds("assign", "access", "hex")))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), _joined_spans(F.col("spans")).alias("spans"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", planted), (-7, 1, "assistant", planted)], "conv_id long, turn long, role string, text string")
    return read_examples(expand(format_conversations(conversations.unionByName(extra)), rest=True))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = dedup_lines(frames.documents(spark, sf_dir))
    return lines.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=100, k=10).withColumnRenamed("id", "vec_id")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(mask_counts(frames.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op13_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise(spark.read.parquet(f"{sf_dir}/stamps.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_url_filter": op4_url_filter,
    "op5_decontamination": op5_decontamination,
    "op6_fingerprints": op6_fingerprints,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_secret_scan": op8_secret_scan,
    "op9_chat_format": op9_chat_format,
    "op10_line_dedup": op10_line_dedup,
    "op11_nearest_neighbours": op11_nearest_neighbours,
    "op12_filter_audit": op12_filter_audit,
    "op13_timestamps": op13_timestamps,
}

ORACLE_SQL: dict[str, str] = {
    "op4_url_filter": """
WITH parsed AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits AS (
  SELECT page_id, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS n
  FROM parsed JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parsed p LEFT JOIN (SELECT * FROM fits WHERE n = 1) f ON f.page_id = p.page_id
""",
    # A turn adds 14 characters and its role; escapes add one for each backslash, turn end and # before two others.
    "op9_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(14 + length(role) + 2 * length(text) - length(replace(text, '\', '')) + len(string_split(text, '</turn>')) - 1
                + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0)) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
""",
    "op10_line_dedup": """
WITH lines AS (
  SELECT doc_id, i, parts[i] AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
       LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i) r
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), frequent AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE keeper IS NOT NULL AND doc_id < keeper) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE keeper IS NULL OR doc_id >= keeper), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent USING (key) GROUP BY doc_id
""",
    # Bit 0 of a mask is filter A; an order's steps and the Shapley sums are counted from the masks as they are defined.
    "op12_filter_audit": r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS first FROM texts GROUP BY text
), said AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), masked AS (
  SELECT t.part, coalesce(s.good, false) AS good, coalesce(s.toxic, false) AS toxic,
         (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
         + 4 * (100 * length(regexp_replace(t.text, '[^A-Z]+', '', 'g')) > 2 * length(t.text))::INT + 8 * regexp_matches(t.text, '[#$%&*|]')::INT
         + 16 * coalesce(t.doc_id > f.first, false)::INT AS mask
  FROM texts t JOIN firsts f ON f.text = t.text LEFT JOIN said s ON s.doc_id = t.doc_id
), counts AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic FROM masked GROUP BY part, mask
), letters AS (
  SELECT substr('ABCDE', i + 1, 1) AS letter, 1 << i AS bit FROM (SELECT unnest(range(0, 5))::INT AS i)
), orders AS (
  SELECT [a, b, c, d, e] AS o FROM (SELECT letter AS a FROM letters), (SELECT letter AS b FROM letters), (SELECT letter AS c FROM letters), (SELECT letter AS d FROM letters), (SELECT letter AS e FROM letters)
  WHERE len(list_distinct([a, b, c, d, e])) = 5
), steps AS (
  SELECT array_to_string(o, '') AS filter_order, step, (SELECT bit FROM letters WHERE letter = o[step]) AS own,
         coalesce(list_sum(list_transform(o[1:step - 1], lambda x: (1 << (ascii(x) - 65)))), 0)::INT AS before
  FROM orders, (SELECT unnest(range(1, 6))::INT AS step)
), figures AS (
  SELECT c.part, s.filter_order, s.step, s.own,
         sum(n) FILTER (WHERE mask & (own | before) = 0) AS kept, sum(n) FILTER (WHERE mask & before = 0 AND mask & own <> 0) AS removed,
         sum(n) FILTER (WHERE mask & before <> 0 AND mask & own <> 0) AS redundant, sum(n) FILTER (WHERE mask = own) AS unique_fails,
         sum(n_good) FILTER (WHERE mask & before = 0 AND mask & own <> 0) AS good_lost, sum(n_toxic) FILTER (WHERE mask & before = 0 AND mask & own <> 0) AS toxic_lost
  FROM counts c, steps s GROUP BY ALL
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       (sum(coalesce(removed, 0)) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM figures
""",
    # Candidates are all offsets of whole quarters of an hour, rendered by ICU; after a gap's or an overlap's change holds what holds a day later.
    "op13_timestamps": r"""
WITH cores AS (
  SELECT row_number() OVER () AS row, stamp_id, source, zone, trim(raw, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core FROM stamps
), parsed AS (
  SELECT *, regexp_extract(core, '^(20[0-9][0-9]-[0-9][0-9]-[0-9][0-9]|20[0-9]{6}|[0-9][0-9][.][0-9][0-9][.]20[0-9][0-9]|[0-9][0-9] [A-Z][a-z][a-z] 20[0-9][0-9]|[0-9][0-9]/[0-9][0-9]/20[0-9][0-9])([T ]|$)', 1) AS date,
         regexp_full_match(core, '.*?([T ][0-9][0-9]:[0-9][0-9](:[0-9][0-9])?( ?[AP]M)?( ?(Z|[+-][0-9][0-9]:?[0-9][0-9]))?)?') AS framed
  FROM cores
), split AS (
  SELECT *, substr(core, length(date) + 1) AS rest FROM parsed
), timed AS (
  SELECT *, regexp_full_match(rest, '([T ][0-9][0-9]:[0-9][0-9](:[0-9][0-9])?( ?[AP]M)?( ?(Z|[+-][0-9][0-9]:?[0-9][0-9]))?)?') AND date <> '' AS fits,
         try_cast(nullif(regexp_extract(rest, '^[T ]([0-9][0-9])', 1), '') AS INT) AS h, try_cast(nullif(regexp_extract(rest, '^[T ][0-9][0-9]:([0-9][0-9])', 1), '') AS INT) AS m,
         coalesce(try_cast(nullif(regexp_extract(rest, '^[T ][0-9][0-9]:[0-9][0-9]:([0-9][0-9])', 1), '') AS INT), 0) AS s, regexp_extract(rest, '([AP])M', 1) AS half,
         regexp_extract(rest, '(Z|[+-][0-9][0-9]:?[0-9][0-9])$', 1) AS tail
  FROM split
), ranged AS (
  SELECT *, fits AND (rest = '' OR (m <= 59 AND s <= 59 AND CASE WHEN half = '' THEN h <= 23 ELSE h BETWEEN 1 AND 12 END
              AND (length(tail) < 2 OR (try_cast(substr(tail, 2, 2) AS INT) <= 14 AND try_cast(right(tail, 2) AS INT) <= 59)))) AS ok,
         CASE WHEN rest = '' THEN 0 ELSE ((CASE half WHEN '' THEN h WHEN 'A' THEN h % 12 ELSE h % 12 + 12 END) * 60 + m) * 60 + s END AS seconds,
         CASE WHEN tail = 'Z' THEN 0 WHEN tail <> '' THEN (try_cast(substr(tail, 2, 2) AS INT) * 60 + try_cast(right(tail, 2) AS INT)) * CASE WHEN tail[1] = '-' THEN -60 ELSE 60 END END AS offset_s
  FROM timed
), dated AS (
  SELECT *, date LIKE '%/%' AS slashed,
         CASE WHEN date LIKE '%/%' THEN try_strptime(date, '%d/%m/%Y') WHEN date LIKE '____-%' THEN try_strptime(date, '%Y-%m-%d') WHEN date LIKE '%.%' THEN try_strptime(date, '%d.%m.%Y')
              WHEN date LIKE '% %' THEN try_strptime(date, '%d %b %Y') ELSE try_strptime(date, '%Y%m%d') END AS one,
         CASE WHEN date LIKE '%/%' THEN try_strptime(date, '%m/%d/%Y') END AS other
  FROM ranged
), votes AS (
  SELECT source, count(*) FILTER (WHERE one IS NOT NULL) AS n_one, count(*) FILTER (WHERE other IS NOT NULL) AS n_other FROM dated
  WHERE ok AND slashed AND (one IS NULL) <> (other IS NULL) GROUP BY source
), chosen AS (
  SELECT a.row, a.stamp_id, a.zone, a.offset_s, a.seconds, a.core,
         CASE WHEN regexp_full_match(core, '[0-9]{10}|[0-9]{13}') THEN 'epoch' WHEN NOT coalesce(ok, false) OR (one IS NULL AND other IS NULL) THEN 'bad'
              WHEN one <> other AND slashed THEN CASE WHEN n_one > 10 * n_other OR n_other > 10 * n_one THEN 'votes' ELSE 'default' END ELSE 'plain' END AS rule,
         CASE WHEN slashed AND (one IS NULL OR (other IS NOT NULL AND coalesce(n_other > 10 * n_one, false))) THEN other ELSE one END AS day
  FROM dated a LEFT JOIN votes v ON v.source IS NOT DISTINCT FROM a.source
), walls AS (
  SELECT *, CASE WHEN rule NOT IN ('bad', 'epoch') THEN epoch_us(day) + seconds::BIGINT * 1000000 END AS wall FROM chosen
), candidates AS (
  SELECT row, any_value(wall) AS wall, any_value(zone) AS zone, count(*) FILTER (WHERE back = wall) AS n, max(utc) FILTER (WHERE back = wall) AS last
  FROM (SELECT row, wall, zone, wall - q * 900000000 AS utc, epoch_us(timezone(zone, make_timestamptz(wall - q * 900000000))) AS back
        FROM walls, (SELECT unnest(range(-48, 57)) AS q) WHERE wall IS NOT NULL AND offset_s IS NULL)
  GROUP BY row
), resolved AS (
  SELECT *, CASE WHEN n > 0 THEN last ELSE 2 * wall + 86400000000 - epoch_us(timezone(zone, make_timestamptz(wall + 86400000000))) END AS utc FROM candidates
)
SELECT w.stamp_id, CASE rule WHEN 'epoch' THEN CAST(core AS BIGINT) * CASE WHEN length(core) = 10 THEN 1000000 ELSE 1000 END
                            WHEN 'bad' THEN NULL ELSE coalesce(w.wall - w.offset_s::BIGINT * 1000000, r.utc) END::BIGINT AS utc_us,
       rule, (rule IN ('votes', 'default') OR (rule = 'plain' AND coalesce(r.n <> 1, false))) AS ambiguous
FROM walls w LEFT JOIN resolved r ON r.row = w.row
""",
}
