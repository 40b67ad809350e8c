"""The queries of the training-data operators over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fingerprint_rows(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    from .fingerprint import containment, edited, fingerprints, likeness, shown, sketch, with_next

    rows = with_next(fingerprints(docs), ["text", "sketch"], buckets)
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        shown(F.col("sketch")).alias("fingerprint"),
        shown(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_in_edited"),
        containment(F.col("sketch"), F.col("next_sketch")).alias("contained_in_next"),
    )


def op1_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_rows(_table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    out = pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op3_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import ADDED, BASE, detect, joined

    out = detect(_table(spark, sf_dir, "documents"))

    def number(kind: str, spans: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts, added = [number(k, "base") for k in BASE], [number(k, "added") for k in ADDED]
    totals = [F.size("added").cast("long").alias("n_added"), (F.size("base") + F.size("added")).cast("long").alias("n_spans")]
    return out.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"), *added, *totals)


def op4_conditional_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license import scan

    out = scan(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "end", "license", F.round("reduction", 6).alias("reduction"), F.round("covered", 6).alias("covered"), F.array_join("differences", "; ").alias("differences"))


def op5_static_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rans import encode_corpus, read_token_files

    path = encode_corpus(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op7_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import preference_pairs, swapped_replies

    def shown(mask: str):
        return F.array_join(F.transform(mask, lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",").alias(mask)

    out = preference_pairs(*swapped_replies(_table(spark, sf_dir, "conversations")))
    return out.select(F.col("pair_id").alias("conv_id"), "prompt_turns", "prompt", "chosen_completion", shown("chosen_mask"), "rejected_completion", shown("rejected_mask"))


OP7_SQL = """
WITH replies AS (
  SELECT conv_id, max(turn) AS last, arg_min(coalesce(text, ''), turn) AS reply
  FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
ends AS (
  SELECT r.conv_id, r.last, coalesce(o.reply, '') AS other
  FROM replies r LEFT JOIN replies o ON o.conv_id = xor(r.conv_id, 1)),
turns AS (
  SELECT e.conv_id, e.last, e.other, c.turn, coalesce(c.role, '') AS role, coalesce(c.text, '') AS text
  FROM ends e JOIN conversations c USING (conv_id)),
mine AS (SELECT conv_id, other, text FROM turns WHERE turn = last AND role = 'assistant'),
rows_ AS (
  SELECT conv_id, 'p' AS part, turn, role, text FROM turns WHERE turn < last
  UNION ALL SELECT conv_id, 'c', turn, role, text FROM turns WHERE turn >= last
  UNION ALL SELECT conv_id, 'r', last, 'assistant', other FROM ends),
placed AS (
  SELECT t.conv_id, CASE WHEN m.other = m.text AND t.part IN ('c', 'r') AND t.turn = e.last THEN CASE t.part WHEN 'c' THEN 'p' ELSE 'x' END ELSE t.part END AS part,
    t.turn, replace(t.role, '<|im_', '<|_im_') AS role, replace(t.text, '<|im_', '<|_im_') AS text
  FROM rows_ t JOIN mine m USING (conv_id) JOIN ends e USING (conv_id)),
drawn AS (
  SELECT conv_id, part, turn, role, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown
  FROM placed WHERE part <> 'x'),
cut AS (
  SELECT *, coalesce(sum(length(shown)) OVER (PARTITION BY conv_id, part ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM drawn),
parts AS (
  SELECT conv_id, part, count(*) AS n, string_agg(shown, '' ORDER BY turn) AS shown,
    coalesce(string_agg((pos + length(role) + 13) || ':' || (pos + length(shown) - 1), ',' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS mask
  FROM cut GROUP BY conv_id, part)
SELECT e.conv_id, coalesce(p.n, 0)::INTEGER AS prompt_turns, coalesce(p.shown, '') AS prompt,
  coalesce(c.shown, '') AS chosen_completion, coalesce(c.mask, '') AS chosen_mask,
  coalesce(r.shown, '') AS rejected_completion, coalesce(r.mask, '') AS rejected_mask
FROM ends e
LEFT JOIN parts p ON p.conv_id = e.conv_id AND p.part = 'p'
LEFT JOIN parts c ON c.conv_id = e.conv_id AND c.part = 'c'
LEFT JOIN parts r ON r.conv_id = e.conv_id AND r.part = 'r'
"""


def op8_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out, identify, learn

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.filter(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_wav_peak_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_documents

    out = media_documents(_table(spark, sf_dir, "documents"))
    feature = F.concat(F.concat_ws(",", F.col("times").cast("array<string>")), F.lit(":"), F.concat_ws(",", F.col("codes").cast("array<string>")))
    return out.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op10_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)


def op11_level_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import folded, manifest, siblings

    out = manifest(_table(spark, sf_dir, "documents")).withColumn("folded_root", folded(F.coalesce("altered", "leaf"), F.col("path")))
    proof = F.sha2(siblings(F.col("path")).cast("binary"), 256).alias("proof_sha256")
    return out.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP11_SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY k) AS t FROM (
    SELECT k, list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k) AS c
    FROM (SELECT unnest(range(256)) AS k))),
fields AS (
  SELECT doc_id, lang, n_chars,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS body
  FROM documents),
hashed AS (
  SELECT doc_id, lang, n_chars, head, body, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || body) AS leaf,
    xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT),
      lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295::BIGINT)) AS crc
  FROM fields, crc_table),
placed AS (
  SELECT doc_id, lang, leaf, CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL THEN sha256(head || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || body) ELSE leaf END AS altered,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS rank
  FROM hashed),
low AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY rank) AS nodes FROM placed GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))
  FROM low WHERE len(nodes) > 1),
subroots AS (
  SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS rank FROM low WHERE len(nodes) = 1),
high AS (
  SELECT 0 AS level, list(subroot ORDER BY rank) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))
  FROM high WHERE len(nodes) > 1),
steps AS (
  SELECT p.doc_id, p.leaf, s.subroot, p.altered, l.level, (p.rank // (1::BIGINT << l.level)) % 2 AS odd, l.nodes[xor(p.rank // (1::BIGINT << l.level), 1) + 1] AS other
  FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN low l ON l.lang IS NOT DISTINCT FROM p.lang WHERE len(l.nodes) > 1
  UNION ALL
  SELECT p.doc_id, p.leaf, s.subroot, p.altered, 1000 + h.level, (s.rank // (1::BIGINT << h.level)) % 2, h.nodes[xor(s.rank // (1::BIGINT << h.level), 1) + 1]
  FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang, high h WHERE len(h.nodes) > 1),
paths AS (
  SELECT doc_id, leaf, subroot, altered, list(CASE WHEN other IS NULL THEN '' WHEN odd = 1 THEN 'L' || other ELSE 'R' || other END ORDER BY level) AS path
  FROM steps GROUP BY ALL
  UNION ALL
  SELECT doc_id, leaf, leaf, altered, []::VARCHAR[] FROM placed WHERE (SELECT count(*) FROM placed) = 1),
folded AS (
  SELECT *, (SELECT nodes[1] FROM high WHERE len(nodes) = 1) AS root,
    list_reduce(path, lambda a, s: sha256(CASE s[1] WHEN 'L' THEN s[2:] || a WHEN 'R' THEN a || s[2:] ELSE a END), altered) AS folded_root
  FROM paths)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM folded
"""


def op12_prefix_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), words=3, percent=90)


OP12_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END AS s
  FROM words),
nodes AS (SELECT min(doc_id) AS node, len(any_value(s)) AS n, any_value(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
tokens AS (SELECT node, n, unnest(s) AS t FROM nodes),
pairs AS (
  SELECT a.node AS a, b.node AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.node < b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT node, node AS other FROM nodes UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
roots AS (SELECT n.node, list_sort(n.s) AS s, min(r.other) AS root FROM nodes n JOIN reach r USING (node) GROUP BY n.node, n.s)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(r.root, d.doc_id) AS component_id
FROM sets d LEFT JOIN roots r ON r.s = list_sort(d.s)
"""


def op13_segment_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import hard_negatives, vectors

    rows = vectors(_table(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score
  FROM vectors a JOIN vectors r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank,
  n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) <= 5
"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_scaled_sketch,
        op2_best_fit_packing,
        op3_weak_supervision_pii,
        op4_conditional_compression,
        op5_static_rans,
        op6_pair_index_bpe,
        op7_preference_format,
        op8_output_codes,
        op9_wav_peak_pairs,
        op10_bbit_minhash,
        op11_level_strings,
        op12_prefix_orders,
        op13_segment_summaries,
    )
}
ORACLE_SQL: dict[str, str] = {"op7_preference_format": OP7_SQL, "op11_level_strings": OP11_SQL, "op12_prefix_orders": OP12_SQL, "op13_segment_summaries": OP13_SQL}
