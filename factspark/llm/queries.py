"""The registered query of each operator, with its checking SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factspark.session import scratch_folder

from . import alignment, language, mixing, neighbours, packing, partenum, quality, secrets, sharding, sitetext, tokenfiles, tokenindex, tokenscan, trie
from .common import documents, saved

END_ID = 1
#: The tokenizer's end-of-text id, which no ordinary text is encoded to.
SEPARATOR_ID = 49407
SHARDS = [1.0] * 8
MIX_WEIGHTS = [3, 1, 2]
POLICY = "web-2"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def word_tokenizer() -> str:
    return tokenizer_file("word_bpe_49k.json")


def op1_power_of_two_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(documents(spark, folder), word_tokenizer(), END_ID, longest=2048)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_token_store(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    written = tokenindex.write_store(docs, scratch_folder(spark, "tokens"), word_tokenizer(), END_ID)
    return tokenindex.lookup(written, docs).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_rendezvous_shards(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = documents(spark, folder).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = sharding.shard_rows(rows, "doc_id", SHARDS, joining=1.0)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_separator_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of each document (with the separator), counted from flat files of ids alone."""
    files = scratch_folder(spark, "flat")
    written = tokenfiles.write_flat(documents(spark, folder), files, word_tokenizer(), SEPARATOR_ID, 2, "doc_id", "text", headers=False, specials_as_text=True)
    names = saved(written, "names").select("file", "ordinal", "doc_id")
    counts = tokenscan.token_counts(spark, files, SEPARATOR_ID)
    return counts.join(names, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens", "closed")


def op5_language_profiles(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    out = F.coalesce(language.held_out(F.col("doc_id")), F.lit(False))
    profiles = language.fit(docs.where(~out))
    rows = docs.select("doc_id", out.alias("held_out"), "text")
    return language.predict(rows, profiles).select("doc_id", "held_out", "lang_pred", "score")


def op6_systematic_mix(spark: SparkSession, folder: str) -> DataFrame:
    rows = mixing.mix(documents(spark, folder), MIX_WEIGHTS)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies")


OP6_SQL = r"""
WITH base AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS turn FROM base GROUP BY source),
w AS (SELECT *, CASE (turn - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, cap / weight AS full_at, (SELECT sum(source_size) FROM w)::DOUBLE * 1.5::DOUBLE AS goal FROM w),
v AS (SELECT *, (goal - coalesce(sum(cap) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM l),
t AS (SELECT source, source_size, coalesce(least(cap, weight * (SELECT level FROM v WHERE level <= full_at ORDER BY full_at, source NULLS LAST LIMIT 1)), cap) AS target,
  (('0x' || substr(md5(coalesce('s' || source, 'n')), 1, 5))::BIGINT + 0.5::DOUBLE) / 1048576 AS u FROM v),
r AS (SELECT b.doc_id, b.source, b.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 2.0::DOUBLE) ELSE 0 END AS rate,
  row_number() OVER (PARTITION BY b.source ORDER BY b.size DESC, b.doc_id) - 1 AS i FROM base b JOIN t ON b.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, least(floor((i + 1) * rate + u) - floor(i * rate + u), 2)::INT AS copies FROM r)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, source, copies FROM c
"""


def op7_markov_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    model = secrets.fit(secrets.labelled_samples(docs))
    found = secrets.scan(docs, model)
    spans = F.col("spans")
    counts = [F.size(secrets.of_kinds(spans, [k])).cast("long").alias(f"n_{k}") for k in secrets.BASE_KINDS]
    base = F.sha2(secrets.joined(secrets.of_kinds(spans, secrets.BASE_KINDS)), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), secrets.joined(spans).alias("spans"))


def op8_rule_ledger(spark: SparkSession, folder: str) -> DataFrame:
    book = quality.ledger(documents(spark, folder))
    failed = F.col("failures").bitwiseAND(F.lit(quality.policy_mask("base-1")).cast("long")) != 0
    return book.select(
        F.col("document.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), quality.kept(POLICY).alias("kept"), "failures",
    )


OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
  [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM d),
g AS (SELECT doc_id, i, CASE WHEN i <= len(words) - 4 THEN array_to_string(words[i:i + 4], ' ') END AS gram FROM m, range(1, len(words) + 1) AS r(i)),
f AS (SELECT *, gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS twice FROM g),
c AS (SELECT doc_id, max(twice::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS covered FROM f),
n AS (SELECT doc_id, sum(covered) AS n_repeat_words FROM c GROUP BY doc_id),
x AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  len(lines) AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS n_capitals,
  length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS n_digits FROM m LEFT JOIN n USING (doc_id)),
b AS (SELECT *, greatest(n_words, 1) AS w, greatest(word_chars, 1) AS ch,
  (n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT AS base FROM x),
a AS (SELECT *, (base + 4 * (n_symbols / w > 0.1)::INT + 8 * (n_dup_lines / greatest(n_lines, 1) > 0.35)::INT + 16 * (word_chars / w > 12)::INT
  + 32 * (word_chars / w < 2.5)::INT + 64 * (n_capitals / ch > 0.4)::INT + 128 * (n_digits / ch > 0.5)::INT)::BIGINT AS failures FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base > 0 AS base_failed, failures = 0 AS kept, failures FROM a
"""


def op9_partenum_join(spark: SparkSession, folder: str) -> DataFrame:
    return partenum.near_groups(documents(spark, folder)).select("doc_id", "n_shingles", "component_id")


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS gram FROM w, range(1, greatest(len(words) - 3, 2)) AS r(i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.c)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(c) AS component_id FROM r GROUP BY a) m ON m.doc_id = d.doc_id
"""


def op10_kmeans_tree(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return neighbours.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.prefix_trie(trie.rebuilt(spark.read.parquet(f"{folder}/conversations.parquet")))


OP11_SQL = r"""
WITH RECURSIVE t AS (SELECT conv_id, list({'r': coalesce(role, ''), 'x': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, '')) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
s AS (SELECT conv_id, 0 AS i, 4294967295::BIGINT AS crc, conv_id::VARCHAR AS name FROM t UNION ALL
  SELECT conv_id, i + 1, list_reduce([xor(crc, ascii(name[i + 1])::BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384)), name FROM s WHERE i < length(name)),
h AS (SELECT conv_id, (xor(crc, 4294967295::BIGINT) % 9)::BIGINT AS h FROM s WHERE i = length(name)),
p AS (SELECT t.conv_id, list_concat(coalesce(b.own[1:h], []), t.own[h + 1:]) AS path FROM t JOIN h USING (conv_id) LEFT JOIN t b ON b.conv_id = t.conv_id - (t.conv_id % 5 + 5) % 5),
m AS (SELECT conv_id AS c, d, path, path[1:d] AS prefix FROM p, range(0, len(path) + 1) AS r(d)),
k AS (SELECT c, d, min(c) OVER w AS id, count(*) OVER w AS n, row_number() OVER (PARTITION BY prefix ORDER BY c) AS first, path, len(path) = d AS ends FROM m WINDOW w AS (PARTITION BY prefix)),
n AS (SELECT id, d, n, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * octet_length(encode(path[d].x)) END AS own FROM k WHERE first = 1),
e AS (SELECT id, d, string_agg(c::VARCHAR, ',' ORDER BY c) AS ends FROM k WHERE ends GROUP BY id, d),
u AS (SELECT n.id, n.d, k.id AS up FROM n JOIN k ON k.c = n.id AND k.d = n.d - 1),
c AS (SELECT up AS id, d - 1 AS d, count(*) AS children FROM u GROUP BY ALL),
a AS (SELECT k.id, k.d, sum(n.own) AS saved, count(*) FILTER (WHERE c.id IS NULL) AS leaves
  FROM n LEFT JOIN c ON c.id = n.id AND c.d = n.d JOIN k ON k.c = n.id AND k.d <= n.d GROUP BY ALL)
SELECT n.id AS conv_id, n.d::BIGINT AS depth, u.up AS parent_conv_id, n.n::BIGINT AS n_convs, coalesce(c.children, 0)::BIGINT AS n_children, a.leaves::BIGINT AS n_leaves,
  a.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ends, '')) AS ends_sha256
FROM n JOIN a ON a.id = n.id AND a.d = n.d LEFT JOIN u ON u.id = n.id AND u.d = n.d LEFT JOIN c ON c.id = n.id AND c.d = n.d LEFT JOIN e ON e.id = n.id AND e.d = n.d
"""


def op12_site_text(spark: SparkSession, folder: str) -> DataFrame:
    return sitetext.main_text(spark.read.parquet(f"{folder}/pages.parquet"))


def op13_galloping_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(documents(spark, folder), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op6_systematic_mix": OP6_SQL, "op8_rule_ledger": OP8_SQL, "op9_partenum_join": OP9_SQL, "op11_prefix_trie": OP11_SQL}
