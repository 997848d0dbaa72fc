"""The queries opN_<name> over the whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_licence_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import licence_scan

    return licence_scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_stream_vbyte(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import roundtrip
    from .tokens import vocabulary_path

    return roundtrip(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary_path("byte_bpe_50k.json"), end_id=0)


def op3_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lang_id import identify

    return identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op4_minimum_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .main_text import main_text

    return main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op5_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import exact_shards

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    light = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32")
    )
    return exact_shards(light, 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_configuration_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents
    from .tokens import vocabulary_path

    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary_path("word_bpe_49k.json"), end_id=1)


def op7_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import repeated_stretches

    return repeated_stretches(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import payload_digest

    return payload_digest(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_prefix_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op12_last_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_codec import roundtrip
    from .tokens import vocabulary_path

    return roundtrip(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary_path("piece_bpe_32k.model"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    return resample(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS win, least(len(w), 10) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, s.n, array_to_string(w[i:i + s.n - 1], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) x, sizes s WHERE i + s.n - 1 <= len(w)),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""

# crc32 of bytes: a table of 256 numbers by eight halvings each, then one look-up a byte
_CRC_TABLE = "crc AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i))"


def _crc(code_list: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, {code_list}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


_DECIMAL = "list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
OP11_SQL = f"""
WITH {_CRC_TABLE},
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role) AS pos, struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) AS turn FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list(turn ORDER BY pos) AS turns FROM o GROUP BY conv_id),
h AS (SELECT conv_id, turns, {_crc(_DECIMAL)} % 9 AS h FROM l, crc),
c AS (SELECT h.conv_id, list_concat(coalesce(b.turns, [])[1:h.h], h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN l b ON b.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, d AS depth, len(turns) AS n, turns[1:d] AS path, turns[1:greatest(d - 1, 0)] AS up FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM c)),
n AS (SELECT depth, path, min(conv_id) AS conv_id, min(up) AS up, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '') AS ends FROM p GROUP BY depth, path),
k AS (SELECT depth - 1 AS depth, up AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY depth, up),
a AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.depth = 0 THEN 0 ELSE (n_convs - 1) * octet_length(encode(n.path[n.depth].x)) END AS own FROM n LEFT JOIN k ON n.depth = k.depth AND n.path = k.path),
s AS (SELECT t.depth, t.path, sum(b.own) AS saved_tokens, count(*) FILTER (b.n_children = 0) AS n_leaves FROM a t JOIN a b ON b.depth >= t.depth AND b.path[1:t.depth] = t.path GROUP BY t.depth, t.path)
SELECT a.conv_id, a.depth, f.conv_id AS parent_conv_id, a.n_convs, a.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM a JOIN s ON a.depth = s.depth AND a.path = s.path LEFT JOIN a f ON a.depth > 0 AND f.depth = a.depth - 1 AND f.path = a.up
"""

_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_BYTES = "list_transform(range(1, 2 * octet_length(encode(f)), 2), lambda i: CAST('0x' || substr(hex(encode(f)), i, 2) AS BIGINT))"
OP13_SQL = f"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
df AS (SELECT doc_id, unnest(w) AS f FROM d),
bf AS (SELECT unnest(w) AS f FROM (SELECT {_WORDS} AS w FROM benchmark)),
b AS (SELECT f, {_crc(_BYTES)} % 10000 AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf), crc),
s AS (SELECT bucket, count(*) AS s FROM df JOIN b ON df.f = b.f GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN b ON bf.f = b.f GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bf) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM b) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
w AS (SELECT df.doc_id, sum(gain) AS gain, count(*) AS n FROM df JOIN b ON df.f = b.f JOIN g ON b.bucket = g.bucket GROUP BY df.doc_id),
x AS (SELECT d.doc_id, len(d.w) AS n_features, CAST(coalesce((gain - ((gain % n) + n) % n) // n, 0) AS BIGINT) AS weight,
  CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w ON d.doc_id = w.doc_id),
y AS (SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM x),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM y WHERE n_features >= 20)
SELECT y.*, CASE WHEN r <= 10 * (SELECT count(*) FROM r) // 100 THEN r END AS rank FROM y LEFT JOIN r ON y.doc_id = r.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_licence_classifier": op1_licence_classifier,
        "op2_stream_vbyte": op2_stream_vbyte,
        "op3_partial_matching": op3_partial_matching,
        "op4_minimum_cut": op4_minimum_cut,
        "op5_hypergeometric_shards": op5_hypergeometric_shards,
        "op6_configuration_packing": op6_configuration_packing,
        "op7_compact_windows": op7_compact_windows,
        "op8_progressive_jpeg": op8_progressive_jpeg,
        "op9_token_group_join": op9_token_group_join,
        "op10_prefix_set_join": op10_prefix_set_join,
        "op11_conversation_trie": op11_conversation_trie,
        "op12_last_token_table": op12_last_token_table,
        "op13_importance_resampling": op13_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_prefix_set_join": OP10_SQL, "op11_conversation_trie": OP11_SQL, "op13_importance_resampling": OP13_SQL}
