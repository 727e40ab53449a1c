"""The queries op1 to op10 over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, jaccard, langid, licenses, packing, quality, repeats, sharding, tokencount


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts, of which 10,000 at once are large, are cut to ``rows``."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), with_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.classes(_read(spark, sf_dir, "documents"), k=3, percent=90)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    out = quality.score(docs.select("doc_id", "text", "source", "lang", "n_chars"), quality.train(docs, _read(spark, sf_dir, "labels")))
    return out.select("doc_id", F.col("__low").alias("p_low_quality"), F.col("__toxic").alias("p_toxic"), quality.accepted().alias("keep"))


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    shards = sharding.directory(docs)
    return sharding.assign(docs.select("doc_id"), shards).select("doc_id", "shard", F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_rows", "oversized")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "sentence_ids", F.array_join("licences", ",").alias("licences"), F.size("licences").cast("long").alias("n_licences"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(_read(spark, sf_dir, "documents"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_pack": op2_pack,
    "op3_jaccard": op3_jaccard,
    "op4_token_counts": op4_token_counts,
    "op5_language": op5_language,
    "op6_quality": op6_quality,
    "op7_shard": op7_shard,
    "op8_repeats": op8_repeats,
    "op9_nearest": op9_nearest,
    "op10_licenses": op10_licenses,
}

_LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER_SQL.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER_SQL.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
h AS (SELECT doc_id, i, g.n, item_id FROM (SELECT DISTINCT n FROM g) k JOIN p ON i + k.n - 1 <= len(w) JOIN g ON g.n = k.n AND g.gram = array_to_string(w[i:i + k.n - 1], ' ')),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP7_SQL = f"""
WITH r AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h, coalesce(octet_length(encode(text)), 0) AS b FROM documents),
l AS (SELECT d, h >> (60 - d)::INT AS p, sum(b) AS b, count(*) AS n, min(h) AS lo, max(h) AS hi FROM r, range(0, 41) AS k(d) GROUP BY 1, 2),
q AS (SELECT doc_id, h, min(d) AS d FROM r JOIN l ON l.p = r.h >> (60 - d)::INT WHERE l.b <= {sharding.MAX_BYTES} OR lo = hi GROUP BY 1, 2)
SELECT doc_id, CASE WHEN q.d = 0 THEN '' ELSE right(lpad(bin(p), 64, '0'), q.d::INT) END AS shard, q.d::INT AS depth, l.b::BIGINT AS shard_bytes, n::BIGINT AS shard_rows, l.b > {sharding.MAX_BYTES} AS oversized
FROM q JOIN l ON l.d = q.d AND l.p = q.h >> (60 - q.d)::INT
"""


def _op10_sql() -> str:
    known = ", ".join(f"('{s}', '{i}')" for i, s in licenses.SENTENCES.items())
    rest, tests = "rest0", []
    for i, (name, ids) in enumerate(licenses.RULES):
        pattern = "".join(f",{x}," for x in ids)
        tests.append((i, name, pattern))
    steps, last = [], "x0"
    for i, name, pattern in tests:
        steps.append(f"x{i + 1} AS (SELECT * REPLACE (replace(rest, '{pattern}', ',#,') AS rest, CASE WHEN contains(rest, '{pattern}') AND NOT list_contains(names, '{name}') THEN list_append(names, '{name}') ELSE names END AS names) FROM x{i})")
        last = f"x{i + 1}"
    return f"""
WITH k(sentence, sid) AS (VALUES {known}),
s AS (SELECT doc_id, unnest(parts) AS raw, unnest(range(0, len(parts))) AS pos
      FROM (SELECT doc_id, string_split_regex({_LOWER_SQL.format("text")}, '[.!?;:]*[\\n\\r]+|[.!?;:]+[ \\t]+') AS parts FROM documents)),
f AS (SELECT doc_id, pos, sid FROM s JOIN k ON k.sentence = trim(regexp_replace(raw, '[^a-z0-9]+', ' ', 'g'))),
o AS (SELECT *, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM f),
j AS (SELECT doc_id, string_agg(CASE WHEN before IS NOT NULL AND pos > before + 1 THEN '|,' ELSE '' END || sid || ',', '' ORDER BY pos) AS seq FROM o GROUP BY 1),
x0 AS (SELECT doc_id, seq, ',' || replace(seq, ',', ',,') || ',' AS rest, []::VARCHAR[] AS names FROM j),
{", ".join(steps)}
SELECT d.doc_id, coalesce(rtrim(seq, ','), '') AS sentence_ids, coalesce(array_to_string(names, ','), '') AS licences, coalesce(len(names), 0)::BIGINT AS n_licences
FROM documents d LEFT JOIN {last} USING (doc_id)
"""


_WORDS_SQL = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"

OP3_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS_SQL.format(_LOWER_SQL.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT d.doc_id, count(sh) AS n, md5(coalesce(string_agg(sh, '|' ORDER BY sh), '')) AS whole FROM d LEFT JOIN s USING (doc_id) GROUP BY 1),
f AS (SELECT whole, n, min(doc_id) AS first FROM n WHERE n > 0 GROUP BY 1, 2),
k AS (SELECT first, f.n, sh, row_number() OVER (PARTITION BY first ORDER BY df, sh) AS pos
      FROM f JOIN s ON doc_id = first JOIN (SELECT sh, count(*) AS df FROM s GROUP BY 1) USING (sh)),
c AS (SELECT DISTINCT a.first AS a, a.n AS an, b.first AS b, b.n AS bn FROM k a JOIN k b ON a.sh = b.sh AND a.first < b.first
      WHERE a.pos <= a.n - ceil(a.n * 0.9) + 1 AND b.pos <= b.n - ceil(b.n * 0.9) + 1 AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)),
l AS (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.sh = x.sh GROUP BY a, b, an, bn HAVING 100 * count(*) >= 90 * (an + bn - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT first AS a, first AS b FROM f UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
g AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, coalesce(component_id, n.doc_id) AS component_id
FROM n LEFT JOIN f ON f.whole = n.whole AND f.n = n.n LEFT JOIN g ON g.a = f.first
"""

OP8_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM p) WHERE k > 1),
c AS (SELECT DISTINCT doc_id, i, true AS gone FROM (SELECT doc_id, unnest(range(i, i + 20)) AS i FROM r)),
k AS (SELECT doc_id, count(gone) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (gone IS NULL) AS kept
      FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) LEFT JOIN c USING (doc_id, i) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

OP9_SQL = f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {ann.NEAREST}
"""


ORACLES: dict[str, str] = {"op1_decontaminate": OP1_SQL, "op3_jaccard": OP3_SQL, "op7_shard": OP7_SQL, "op8_repeats": OP8_SQL, "op9_nearest": OP9_SQL, "op10_licenses": _op10_sql()}
