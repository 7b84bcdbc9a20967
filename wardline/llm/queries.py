"""The queries that apply each operator to its whole table, with production parameters, and the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunk_bpe, embedding_tiles, kd_search, language_crf, line_blocks, line_edits, merkle, mixing, simhash, suffix_spans, token_files, url_rules, word_runs
from .common import WORD, table

#: Fixed values of the contract: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.packed_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1)


def op2_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_bpe.encoded_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, RULES)) + " AS t(host, path, verdict)")
    return url_rules.judged(table(spark, sf_dir, "pages"), rules)


def op4_embedding_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_tiles.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).drop("th")


def op6_line_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_edits.line_classes(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_crf.languages(table(spark, sf_dir, "documents"))


def op9_kd_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_search.top_k(table(spark, sf_dir, "embeddings"))


def op10_suffix_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_spans.without_repeats(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.leaf([
        F.translate("text", url_rules.UPPER, url_rules.LOWER) if f == "text" else F.col(f) for f in fields]))
    paths = merkle.manifest(
        table(spark, sf_dir, "documents"), [F.col(f) for f in fields], group=F.col("lang"), order=F.col("doc_id"), kept={"doc_id": F.col("doc_id"), "tampered": tampered}).paths
    found = paths.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        merkle.folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_blocks.extracted(table(spark, sf_dir, "pages"), F.col("html"), kept={"page_id": F.col("page_id"), "url": F.col("url")})
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def _looped(docs: DataFrame) -> DataFrame:
    """``text`` as the contract alters it: where 10 divides the crc32 of doc_id, the words from the a-th on repeat the p words there."""
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))).alias("words"))
    rows = rows.withColumn("n", F.size("words").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    tail = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - F.col("a") - 1), lambda i: F.col("words")[(F.col("a") + i % F.col("p")).cast("int")])
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), tail), " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_runs.periodic_runs(_looped(table(spark, sf_dir, "documents")), F.col("text"), kept={"doc_id": F.col("doc_id")})
    best = found.withColumn("best", word_runs.dominant(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.*", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(word_runs.listing(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


URL_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(r_host, r_path, r_verdict) AS (VALUES """ + ", ".join(map(str, RULES)) + """),
fit AS (
  SELECT s.*, r_host || r_path AS r_rule, r_verdict,
         CASE WHEN (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) THEN length(r_host || r_path) END AS size
  FROM split s, rules)
SELECT page_id, host, path, max_by(r_rule, size) AS rule, coalesce(max_by(r_verdict, size), 'allow') AS verdict
FROM (SELECT *, row_number() OVER () AS r FROM fit) GROUP BY page_id, host, path
"""

TOP_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(q.c, b.c), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v b ON q.vec_id <> b.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(doc_id::VARCHAR || 'mix') AS h, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM s0),
s2 AS (SELECT *, sum(source_size) OVER ()::BIGINT AS budget,
              coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS given,
              sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS open FROM s1),
s3 AS (SELECT *, (budget - given)::DOUBLE / open AS level FROM s2),
s4 AS (SELECT *, (SELECT level FROM s3 WHERE level <= cap / weight ORDER BY cap / weight, level LIMIT 1) AS l FROM s3),
goal AS (SELECT source, source_size, budget, CASE WHEN cap / weight >= l THEN weight * l ELSE cap::DOUBLE END AS target FROM s4),
o AS (
  SELECT d.doc_id, d.source, d.h, d.size, source_size, target, budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS cum,
         row_number() OVER (ORDER BY d.source NULLS FIRST, h, d.doc_id, d.size) AS place
  FROM d JOIN goal ON d.source IS NOT DISTINCT FROM goal.source),
c AS (SELECT *, coalesce((pass * source_size + cum)::DOUBLE / nullif(target, 0), 0) AS finish
      FROM o, (VALUES (0), (1), (2)) p(pass) WHERE pass = 0 OR pass < ceil(target / source_size)),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS FIRST, place, pass ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM c)
SELECT doc_id, source, size, source_size, target, sum(CASE WHEN run <= budget THEN size ELSE 0 END)::BIGINT AS taken
FROM r GROUP BY doc_id, source, place, size, source_size, target
"""


def _merkle_sql(levels: int) -> str:
    """Level by level; ``levels`` of 8 hold 8 ** levels documents of a language."""

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(
            f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def climb(name: str, keys: str) -> str:
        out = ""
        for k in range(levels):
            out += f"""
{name}_runs{k} AS (SELECT {keys} g, idx // 8 AS run, any_value(n) AS n, string_agg(h, '' ORDER BY idx) AS s FROM {name}{k} GROUP BY ALL),
{name}{k + 1} AS (SELECT g, run AS idx, CASE WHEN n = 1 THEN s ELSE sha256(s) END AS h, (n + 7) // 8 AS n FROM {name}_runs{k}),"""
        return out

    def beside(table: str, name: str) -> str:
        out, at = "", table
        for k in range(levels):
            place = f"(d.{name}_idx // {8 ** k})"
            out += f"""
{table}_{k} AS (
  SELECT d.*, CASE WHEN r.n > 1 THEN substr(s, 1, {place} % 8 * 64) ELSE '' END AS l, CASE WHEN r.n > 1 THEN substr(s, ({place} % 8 + 1) * 64 + 1) ELSE '' END AS r, r.n > 1 AS met
  FROM {at} d JOIN {name}_runs{k} r ON d.{name}_g IS NOT DISTINCT FROM r.g AND {place} // 8 = r.run),
{table}_{k}x AS (SELECT * REPLACE (proof || l || r AS proof, CASE WHEN met THEN sha256(l || x || r) ELSE x END AS x) FROM {table}_{k}),
{table}_{k}y AS (SELECT * EXCLUDE (l, r, met) FROM {table}_{k}x),"""
            at = f"{table}_{k}y"
        return out

    return f"""
WITH docs AS (
  SELECT doc_id, lang, {leaf("text")} AS leaf, {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS altered,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda c, b:
      list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc
  FROM documents),
t0 AS (SELECT lang AS g, leaf AS h, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM docs WINDOW w AS (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf)),{climb("t", "")}
u0 AS (SELECT 0 AS g, g AS lang, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM t{levels}),{climb("u", "")}
d AS (
  SELECT doc_id, lang AS t_g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS t_idx, leaf,
         CASE WHEN doc_id IS NOT NULL AND xor(crc, 4294967295) % 3 = 0 THEN altered ELSE leaf END AS x, '' AS proof FROM docs),{beside("d", "t")}
e AS (
  SELECT d.*, u0.g AS u_g, u0.idx AS u_idx, u0.h AS subroot, u{levels}.h AS root FROM d_{levels - 1}y d JOIN u0 ON d.t_g IS NOT DISTINCT FROM u0.lang, u{levels}),{beside("e", "u")}
done AS (SELECT * FROM e_{levels - 1}y)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, x AS folded_root, x = root AS verified FROM done
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_files, op2_chunk_bpe, op3_url_rules, op4_embedding_tiles, op5_mixing, op6_line_edits, op7_simhash, op8_language_crf, op9_kd_search, op10_suffix_spans, op11_merkle_manifest, op12_line_blocks, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_rules": URL_SQL, "op5_mixing": MIX_SQL, "op9_kd_search": TOP_SQL, "op11_merkle_manifest": _merkle_sql(levels=8)}
