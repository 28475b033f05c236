"""The registered queries of the operators, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import (
    circulant_minhash,
    decontaminate,
    fertility,
    merkle,
    mixing,
    packing,
    quality_gam,
    repair_tokens,
    resampling,
    secrets,
    suffix_dedup,
    toxicity_mil,
    url_rules,
)


def vocabulary(name: str) -> str:
    """Where a public vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_context", "n_weak", "max_log10")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_mil.classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.measure(table(spark, sf_dir, "documents"), ["doc_id"], vocabulary("piece_bpe_32k.model"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_tokens.read_tokens(repair_tokens.write_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circulant_minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(url_rules.RULES), "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.checked_places(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_suffix_dedup, op3_decontamination, op4_quality, op5_toxicity, op6_fertility, op7_mixing, op8_token_output, op9_near_dedup, op10_url_rules, op11_merkle_manifest, op12_packing, op13_resampling)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
item AS (SELECT DISTINCT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM item WHERE len(w) > 0)),
size AS (SELECT DISTINCT k FROM win),
occ AS (
  SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM doc, size WHERE len(w) >= k)),
hit AS (SELECT r, i, o.k, item_id FROM occ o JOIN win USING (k, g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS p FROM hit) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN ids USING (r)
"""

OP7_SQL = r"""
WITH known AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
doc AS (
  SELECT d.doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    -ln((CAST(('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
      / (CASE quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) AS key
  FROM documents d LEFT JOIN known USING (doc_id)),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s,
    CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM doc GROUP BY source),
fill AS (
  SELECT *, sum(s) OVER () - coalesce(sum(3 * s) OVER before, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS by_w,
    row_number() OVER (ORDER BY s / CAST(w AS DOUBLE), encode(source) NULLS LAST) AS turn
  FROM src WINDOW before AS (ORDER BY s / CAST(w AS DOUBLE), encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
open AS (SELECT min(turn) AS turn FROM fill WHERE 3 * s * by_w > w * rest),
level AS (SELECT rest AS l_rest, by_w AS l_by FROM fill JOIN open USING (turn)),
goal AS (
  SELECT source, s, CASE WHEN 3 * s * by_w <= w * rest THEN CAST(3 * s AS DOUBLE) ELSE CAST(w * l_rest AS DOUBLE) / CAST(l_by AS DOUBLE) END AS target
  FROM fill LEFT JOIN level ON true),
plan AS (SELECT *, CASE WHEN s > 0 THEN least(CAST(floor(target / s) AS BIGINT), 3) ELSE 0 END AS epochs FROM goal),
run AS (
  SELECT doc_id, size, s, target, epochs, target - epochs * s AS rest, sum(size) OVER (PARTITION BY d.source ORDER BY key) AS upto,
    sum(size) OVER (PARTITION BY d.source, key) AS peers
  FROM doc d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, s AS source_size, target,
  CAST(size * (epochs + CASE WHEN rest > 0 AND 2 * upto - peers <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM run
"""

OP9_SQL = f"""
WITH RECURSIVE doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT r, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') AS g
  FROM (SELECT r, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM doc WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
pair AS (SELECT a.r AS a, b.r AS b, count(*) AS common FROM sh a JOIN sh b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS r, a AS t FROM way UNION SELECT reach.r, way.b FROM reach JOIN way ON way.a = reach.t),
comp AS (SELECT reach.r, min(doc_id) AS c FROM reach JOIN doc ON doc.r = reach.t GROUP BY reach.r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(c, doc_id) AS component_id, doc_id = coalesce(c, doc_id) AS kept
FROM doc LEFT JOIN n USING (r) LEFT JOIN comp USING (r)
"""

OP10_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
part AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
SELECT page_id, host, path,
  (SELECT rh || rp FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) ORDER BY length(rh || rp) DESC LIMIT 1) AS rule,
  coalesce((SELECT v FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) ORDER BY length(rh || rp) DESC LIMIT 1), 'allow') AS verdict
FROM part
"""


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a string's UTF-8 bytes, bit by bit."""
    data = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS INT), 2) AS BIGINT))"
    byte = "list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: {byte}), 4294967295)"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_SMALL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Trees over sources have number -1; a node knows its tree, the tree's size and its place.
OP11_SQL = f"""
WITH RECURSIVE row_ AS (
  SELECT row_number() OVER () AS r, doc_id, source, {_leaf_sql("text")} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {crc32_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_leaf_sql(_SMALL)} END AS changed
  FROM documents),
src AS (SELECT source, count(*) AS size, row_number() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS tree FROM row_ GROUP BY source),
leaf AS (
  SELECT r, doc_id, tree, size, leaf, changed, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM row_ JOIN src ON row_.source IS NOT DISTINCT FROM src.source),
grown AS (
  SELECT 0 AS k, tree, size, pos, leaf AS hash, NULL::VARCHAR AS pre FROM leaf
  UNION ALL
  SELECT max(k) + 1, tree, size, pos // 16, sha256(string_agg(hash, '' ORDER BY pos)), string_agg(hash, '' ORDER BY pos)
  FROM grown WHERE size > CAST(pow(16, k) AS BIGINT) GROUP BY tree, size, pos // 16),
sub AS (SELECT tree, arg_max(hash, k) AS subroot, max(k) AS height FROM grown GROUP BY tree),
upper AS (
  SELECT 0 AS k, (SELECT count(*) FROM sub) AS size, tree AS pos, subroot AS hash, NULL::VARCHAR AS pre FROM sub
  UNION ALL
  SELECT max(k) + 1, size, pos // 16, sha256(string_agg(hash, '' ORDER BY pos)), string_agg(hash, '' ORDER BY pos)
  FROM upper WHERE size > CAST(pow(16, k) AS BIGINT) GROUP BY size, pos // 16),
top AS (SELECT arg_max(hash, k) AS root FROM upper),
step AS (
  SELECT r, k, pre, (pos // CAST(pow(16, k - 1) AS BIGINT)) % 16 AS slot
  FROM leaf JOIN (SELECT k, tree AS t, pos AS p, pre FROM grown WHERE k > 0) ON t = tree AND p = pos // CAST(pow(16, k) AS BIGINT)
  UNION ALL
  SELECT r, height + k, pre, (tree // CAST(pow(16, k - 1) AS BIGINT)) % 16
  FROM leaf JOIN sub USING (tree) JOIN (SELECT k, pos AS p, pre FROM upper WHERE k > 0) ON p = tree // CAST(pow(16, k) AS BIGINT)),
proof AS (SELECT r, string_agg(substr(pre, 1, 64 * slot) || substr(pre, 64 * slot + 65), '' ORDER BY k) AS siblings FROM step GROUP BY r),
fold AS (
  SELECT r, 0 AS k, coalesce(changed, leaf) AS hash FROM leaf
  UNION ALL
  SELECT fold.r, step.k, sha256(substr(pre, 1, 64 * slot) || hash || substr(pre, 64 * slot + 65)) FROM fold JOIN step ON step.r = fold.r AND step.k = fold.k + 1),
folded AS (SELECT r, arg_max(hash, k) AS folded_root FROM fold GROUP BY r)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaf JOIN sub USING (tree) JOIN folded USING (r) LEFT JOIN proof USING (r), top
"""

_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP13_SQL = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
feat AS (
  SELECT r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM doc WHERE len(w) > 0
  UNION ALL
  SELECT NULL, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM (SELECT {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
per AS (SELECT r, f, count(*) AS n FROM feat GROUP BY r, f),
crc AS (SELECT f, {crc32_sql("f")} % 10000 AS b FROM (SELECT DISTINCT f FROM per)),
cnt AS (SELECT b, CAST(coalesce(sum(n) FILTER (r IS NOT NULL), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (r IS NULL), 0) AS DOUBLE) AS t FROM per JOIN crc USING (f) GROUP BY b),
tot AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM cnt),
gain AS (SELECT b, CAST(floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) AS BIGINT) AS g FROM cnt, tot),
weighed AS (
  SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(CAST(sum(n * g) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS weight
  FROM per JOIN crc USING (f) JOIN gain USING (b) WHERE r IS NOT NULL GROUP BY r),
noisy AS (
  SELECT r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM doc LEFT JOIN weighed USING (r)),
place AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS k, count(*) OVER () AS n FROM noisy WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= 25 * n // 100 THEN k END AS rank FROM noisy LEFT JOIN place USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": OP3_SQL, "op7_mixing": OP7_SQL, "op9_near_dedup": OP9_SQL, "op10_url_rules": OP10_SQL, "op11_merkle_manifest": OP11_SQL, "op13_resampling": OP13_SQL}
