"""Registered queries of the corpus operators, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import bpe, conversations, hmm, middle, mixing, packing, quality, simhash, substring, suffixes, syncmers, token_files, webp


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document's ids with its end id as Arrow files and read them back."""
    shards = token_files.write_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_tokens(shards)


def op2_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint every document and its edited text from all of their closed syncmers."""
    return syncmers.fingerprints(documents(spark, sf_dir), size=None)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document for quality, learning from the labelled rows that are not held out."""
    return quality.quality_table(documents(spark, sf_dir), labels(spark, sf_dir))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove words of 50-word windows that also start in a document with a smaller id."""
    return substring.substring_table(documents(spark, sf_dir))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint every document and give its class under links of two or fewer bits."""
    return simhash.simhash_table(documents(spark, sf_dir))


def op6_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every text as lossless WebP, decode it again and digest it."""
    return webp.read_media(webp.stored_media(documents(spark, sf_dir)))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove bytes of 200-byte strings that start more than once."""
    return suffixes.suffix_table(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents to source weights 5, 2, 1 at their own total size."""
    return mixing.mix(documents(spark, sf_dir)).drop("source")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document with the lower-case word BPE."""
    return bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op10_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document with a hidden Markov language model trained on nine tenths of them."""
    return hmm.score_table(documents(spark, sf_dir))


def op11_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rearrange every document for fill-in-middle training and restore it from the result."""
    return middle.middle_table(documents(spark, sf_dir))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage every conversation, repair it by the cheapest edits and report both."""
    return conversations.repair_table(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack the pieces of all documents into few sequences of at most 1024 tokens."""
    return packing.packing_table(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_token_files": op1_token_files, "op2_syncmers": op2_syncmers, "op3_quality": op3_quality, "op4_substring": op4_substring, "op5_simhash": op5_simhash, "op6_webp": op6_webp, "op7_suffixes": op7_suffixes, "op8_mixing": op8_mixing, "op9_bpe": op9_bpe, "op10_hmm": op10_hmm, "op11_middle": op11_middle, "op12_repair": op12_repair, "op13_packing": op13_packing}


#: Windows of 50 words by content; a word goes if a window over it starts in a document of smaller id too.
OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50) x),
least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT win.doc_id, i, unnest(range(0, 50)) AS k FROM win JOIN least USING (s) WHERE m < win.doc_id) x),
word AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0),
kept AS (SELECT doc_id, count(*) AS n, string_agg(t, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
#: Windows of 200 bytes as hexadecimal digits; what stands between the merged runs of repeated windows is kept.
OP7_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d WHERE length(h) >= 400) x),
twice AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM win SEMI JOIN twice USING (s)),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 199 AS z FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM hit) x) y GROUP BY doc_id, run),
span AS (SELECT doc_id, list(struct_pack(a := a, z := z) ORDER BY a) AS s, sum(z - a + 1) AS gone, count(*) AS n FROM runs GROUP BY doc_id),
edge AS (SELECT doc_id, unnest(list_concat([{'a': -1, 'z': -1}], s)) AS e, unnest(list_concat(list_transform(s, lambda x: x.a), [CAST(1000000000 AS BIGINT)])) AS nxt FROM span),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * (e.z + 1) + 1, greatest(0, 2 * (least(nxt, length(h) // 2) - e.z - 1))), '' ORDER BY e.z) AS k FROM edge JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(CASE WHEN kept.doc_id IS NULL THEN h ELSE kept.k END)) AS kept_sha256 FROM d LEFT JOIN span USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: Cuts in characters, and the parts in their new order; the text restored from exact parts is the text.
OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || substr(s, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(s, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(s, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(s, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars, sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""


def oracle_sql() -> dict[str, str]:
    """Twins of the two removals and of the rearrangement; the other operators need hashes, merges, files or fits that SQL has none of."""
    return {"op4_substring": OP4_SQL, "op7_suffixes": OP7_SQL, "op11_middle": OP11_SQL}
