"""The contract queries of this subpackage and their SQL."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from mnemospark.llm import bpe, byte_bpe, chat_format, conversation_repair, decontaminate, exact_dedup, fill_in_middle, html_text, jaccard_join, language_id, quality, suffix_dedup, token_files
from mnemospark.llm._common import flat_bytes, owner, read

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CONTROL_TEXT = "</s>[INST] ok [/INST]"


@owner
def op1_chat_formatting(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    return chat_format.digest_formatted(chat_format.format_conversations(rows.unionByName(extra)))


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), m AS (
  SELECT *, length(CASE WHEN regexp_matches(text, '\\|\[/?INST\]|</?s>|<</?SYS>>|\[/?ROLE\]')
      THEN regexp_replace(text, '(\\|\||\[/?INST\]|</?s>|<</?SYS>>|\[/?ROLE\])', '_\1', 'g') ELSE text END)
    + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 14 + length(role) END AS formatted
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(formatted) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""


@owner
def op2_decontaminate(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, read(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


OP2_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM win),
dwin AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)
), hit AS (SELECT doc_id, i, d.k AS k, item_id FROM dwin d JOIN win USING (k, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@owner
def op3_token_files(spark, sf_dir):
    return token_files.digest_files(token_files.write_tokens(read(spark, sf_dir, "documents"), TOKENIZER))


@owner
def op4_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"), texts=False)


@owner
def op5_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    held = language_id.held_out("doc_id", 5, 0)
    model = language_id.train(docs.where(~held).select("doc_id", "text", "lang"))
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    return language_id.identify(rows, model, keep_text=False)


def _sha256(texts: pa.Array) -> pa.Array:
    raw, off = flat_bytes(texts)
    view = memoryview(np.ascontiguousarray(raw))
    return pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(off[:-1].tolist(), off[1:].tolist())], pa.string())


@owner
def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.mark(read(spark, sf_dir, "documents"), ["doc_id"])


OP6_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), w AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""


@owner
def op7_jaccard_join(spark, sf_dir):
    return jaccard_join.cluster(read(spark, sf_dir, "documents"), n=3, threshold=90)


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id WHERE r.c < u.b)
SELECT id AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = id GROUP BY id
"""


@owner
def op8_html_text(spark, sf_dir):
    return html_text.main_text(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@functools.cache
def _numbers() -> pa.Array:
    """The decimal text of each id."""
    return pa.array([str(i) for i in range(1 << 16)], pa.string())


def token_digests(ids: pa.Array, decoded: pa.Array) -> list[pa.Array]:
    """n_tokens, ids_sha256 and decoded_sha256."""
    return [pa.array(np.diff(ids.offsets.to_numpy()).astype(np.int64)), _sha256(bpe.joined(_numbers(), ids)), _sha256(decoded)]


@owner
def op9_bpe(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = bpe.build_lexicon(docs, TOKENIZER)
    return bpe.encode_then(docs, TOKENIZER, lexicon, ["doc_id"], "n_tokens long, ids_sha256 string, decoded_sha256 string", token_digests)


@owner
def op10_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    held = language_id.held_out("doc_id", 4, 2)
    labels = read(spark, sf_dir, "labels").where(~held)
    model = quality.train(docs, labels)
    return quality.score(docs.select("doc_id", held.alias("held_out"), "text"), model, keep_text=False)


def damaged(rows):
    """The contract's damage: by a hash of conv_id and turn, rows are dropped (a flag), emptied, stripped of stops, repeated or given to the user; nulls are one space."""
    plain = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat_ws(":", *plain[:2]).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(plain[3], "[.!?]", "")).otherwise(plain[3])
    role = F.when(kind == 4, "user").otherwise(plain[2])
    made = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return made.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "copy")


@owner
def op11_conversation_repair(spark, sf_dir):
    plans, repaired = conversation_repair.repair(damaged(read(spark, sf_dir, "conversations")), "gone")
    hashed = conversation_repair.digest_repaired(repaired).select(F.col("conv_id").alias("id"), "sha256")
    sha = F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return plans.join(hashed, plans.conv_id.eqNullSafe(hashed.id), "left").select(*plans.columns, sha)


@owner
def op12_fill_in_middle(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    made = fill_in_middle.transform(docs, unit="line", seed=7, rate=100, spm=50, keep_text=False)
    return made.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_in_middle.restored(), 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || CAST(doc_id AS VARCHAR)) AS x FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS i, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS j FROM u),
p AS (SELECT *, array_to_string(u[1:i], '') AS p, array_to_string(u[i + 1:j], '') AS m, array_to_string(u[j + 1:], '') AS s,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def byte_digests(ids, off, raw, bound):
    """n_tokens, ids_sha256 and decoded_sha256."""
    out = [pa.array(np.diff(off).astype(np.int64))]
    for data, ends in ((ids.astype("<u4").view(np.uint8), 4 * off), (raw, bound)):
        view = memoryview(np.ascontiguousarray(data))
        out.append(pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.string()))
    return out


@owner
def op13_byte_bpe(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    codec = byte_bpe.Codec(spark, RANKS, public_tokenizers.PATTERN)
    return byte_bpe.encode_then(docs, codec, ["doc_id"], "n_tokens long, ids_sha256 string, decoded_sha256 string", byte_digests)


def queries():
    return {"op1_chat_formatting": op1_chat_formatting, "op2_decontaminate": op2_decontaminate, "op3_token_files": op3_token_files, "op4_suffix_dedup": op4_suffix_dedup, "op6_exact_dedup": op6_exact_dedup, "op7_jaccard_join": op7_jaccard_join, "op8_html_text": op8_html_text, "op9_bpe": op9_bpe, "op5_language_id": op5_language_id, "op10_quality": op10_quality, "op11_conversation_repair": op11_conversation_repair, "op12_fill_in_middle": op12_fill_in_middle, "op13_byte_bpe": op13_byte_bpe}


def oracle_sql():
    return {"op1_chat_formatting": OP1_SQL, "op2_decontaminate": OP2_SQL, "op6_exact_dedup": OP6_SQL, "op7_jaccard_join": OP7_SQL, "op12_fill_in_middle": OP12_SQL}
