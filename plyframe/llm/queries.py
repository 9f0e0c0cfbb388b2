"""The registered query of each operator, with its oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.llm import chunks, collocations, fertility, maxscore, mil, packing, rendezvous, repeats, simhash, snapshots, templates, tries, warc
from plyframe.plans.scratch import written

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_chunk_deduplication")
def chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunks.deduplicated(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.withColumn("kept", F.decode("kept", "utf-8")).withColumnRenamed("kept", "text")


SHARDS = 40


@query("op2_rendezvous_sharding")
def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = [(s, 1.0) for s in range(SHARDS + 1)]
    placed = rendezvous.place(table(spark, sf_dir, "documents"), "doc_id", "text", even[:SHARDS], even)
    return placed.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
                         "grown_shard")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def packed(docs: DataFrame) -> DataFrame:
    """Every piece of every document with its place; ids are reduced to their checksum before anything is shuffled."""
    pieces = packing.pieces(docs, "doc_id", "text", vocabulary())
    narrow = written(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                                   F.monotonically_increasing_id().alias("row")))
    return packing.pack(narrow, "length", "row").drop("row")


@query("op3_histogram_packing")
def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


@query("op4_chat_snapshots", """
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
whole AS (SELECT conv_id, count(*) AS n_turns, string_agg('<|im_start|>' || coalesce(role, 'user') || chr(10)
            || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered
          FROM turns GROUP BY conv_id),
unique_text AS (SELECT min(conv_id) AS conv_id, n_turns, count(*) AS copies, rendered FROM whole GROUP BY n_turns, rendered)
SELECT * FROM unique_text a WHERE NOT EXISTS (
  SELECT 1 FROM unique_text b WHERE b.n_turns > a.n_turns AND starts_with(b.rendered, a.rendered))""")
def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.chat_records(table(spark, sf_dir, "conversations"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def quality_model(docs: DataFrame, spark: SparkSession, sf_dir: str) -> mil.Model:
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    return mil.fit(docs, labels, "doc_id", "text", "quality")


@query("op5_mil_quality")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = mil.scored(docs, quality_model(docs, spark, sf_dir), "doc_id", "text")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op6_simhash_near_duplicates")
def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op7_warc_derivatives")
def derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(table(spark, sf_dir, "pages"))


@query("op8_maxscore_top_k", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
        CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5""")
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    def whole(x: Column) -> Column:  # floor of NaN is 0 and of what no long holds the limit, so the first become null
        value = x.cast("double")
        scaled = F.lit(256) * value
        floor = F.when(F.abs(scaled) < 2.0**53, F.floor(scaled).cast("double")).otherwise(scaled)
        return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(floor)

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", whole).alias("x"))
    return maxscore.top_k(vectors, "vec_id", "x", "id % 50 = 0")


@query("op9_suffix_array_deduplication")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_template_decontamination")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


@query("op11_prefix_trie", """
WITH turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 100 AS anchor,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
      lambda crc, d: list_reduce(list_prepend(xor(crc, d), range(8)),
        lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END))) % 6 AS h
  FROM turns GROUP BY conv_id),
convs AS (SELECT o.conv_id, o.anchor, o.h, least(o.h, coalesce(a.n, 0)) AS m FROM own o LEFT JOIN own a ON a.conv_id = o.anchor),
built AS (SELECT c.conv_id, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.anchor AND t.pos <= c.m
  UNION ALL SELECT c.conv_id, t.pos - c.h + c.m, t.role, t.text FROM convs c JOIN turns t USING (conv_id) WHERE t.pos > c.h),
lengths AS (SELECT conv_id, coalesce(max(pos), 0) AS n FROM own LEFT JOIN built USING (conv_id) GROUP BY conv_id),
pre AS (SELECT conv_id, pos AS depth, length(text) AS chars, string_agg(sha256(role || chr(0) || text), '') OVER (
    PARTITION BY conv_id ORDER BY pos) AS prefix FROM built
  UNION ALL SELECT conv_id, 0, 0, '' FROM own),
nodes AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(chars) AS saved FROM pre GROUP BY depth, prefix),
kids AS (SELECT k.depth, k.prefix, p.conv_id AS parent_conv_id FROM nodes k JOIN nodes p
  ON p.depth = k.depth - 1 AND p.prefix = left(k.prefix, length(k.prefix) - 64)),
n_kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n FROM kids GROUP BY ALL),
up AS (SELECT a.depth, a.prefix, sum(z.saved) AS saved, count(*) FILTER (WHERE NOT EXISTS (
    SELECT 1 FROM n_kids k WHERE k.conv_id = z.conv_id AND k.depth = z.depth)) AS n_leaves
  FROM nodes z JOIN pre a ON a.conv_id = z.conv_id AND a.depth <= z.depth GROUP BY a.depth, a.prefix),
ends AS (SELECT p.depth, p.prefix, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS e
  FROM pre p JOIN lengths l USING (conv_id) WHERE l.n = p.depth GROUP BY p.depth, p.prefix)
SELECT n.conv_id, n.depth, k.parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, u.n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens,
  coalesce(e.e, sha256('')) AS ends_sha256
FROM nodes n JOIN up u USING (depth, prefix) LEFT JOIN kids k USING (depth, prefix) LEFT JOIN n_kids c ON c.conv_id = n.conv_id AND c.depth = n.depth
LEFT JOIN ends e USING (depth, prefix)""")
def prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchor = F.col("conv_id") - F.col("conv_id") % 100
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    return tries.trie(*tries.reopened(written(tries.numbered(table(spark, sf_dir, "conversations"))), anchor, heads, 5))


@query("op12_tokeniser_fertility")
def fertility_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = fertility.ruled(table(spark, sf_dir, "documents"), "doc_id", "text", "lang",
                            public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                        "n_tokens", "chars_per_token", "byte_share", "entropy")


@query("op13_phrase_collocations", r"""
WITH pieces AS (SELECT lang, row_number() OVER () AS piece, p FROM (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
    FROM documents)),
said AS (SELECT lang, piece, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
words AS (SELECT lang, piece, generate_subscripts(w, 1) AS pos, unnest(w) AS w1 FROM said),
runs AS (SELECT lang, w1, lead(w1) OVER x AS w2, lead(w1, 2) OVER x AS w3 FROM words WINDOW x AS (PARTITION BY piece ORDER BY pos)),
one AS (SELECT lang, w1, count(*) AS f FROM runs GROUP BY ALL),
two AS (SELECT lang, w1, w2, count(*) AS f FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
three AS (SELECT lang, w1, w2, w3, count(*) AS f FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
cuts AS (SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.f AS a, 1 AS k, l.f AS l, r.f AS r
    FROM two t JOIN one l ON l.lang = t.lang AND l.w1 = t.w1 JOIN one r ON r.lang = t.lang AND r.w1 = t.w2
    WHERE NOT EXISTS (SELECT 1 FROM three h WHERE h.lang = t.lang AND h.w1 = t.w1 AND h.w2 = t.w2 AND 100 * h.f >= 50 * t.f)
      AND NOT EXISTS (SELECT 1 FROM three h WHERE h.lang = t.lang AND h.w2 = t.w1 AND h.w3 = t.w2 AND 100 * h.f >= 50 * t.f)
  UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 1, l.f, r.f
    FROM three t JOIN one l ON l.lang = t.lang AND l.w1 = t.w1 JOIN two r ON r.lang = t.lang AND r.w1 = t.w2 AND r.w2 = t.w3
  UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 2, l.f, r.f
    FROM three t JOIN two l ON l.lang = t.lang AND l.w1 = t.w1 AND l.w2 = t.w2 JOIN one r ON r.lang = t.lang AND r.w1 = t.w3),
scored AS (SELECT *, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
n AS (SELECT lang, sum(f) AS n FROM one GROUP BY lang),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
  FROM best JOIN n USING (lang))
SELECT * FROM ranked WHERE rank <= 2000""")
def collocation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), "text", "lang")
