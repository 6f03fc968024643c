"""The registered queries of this package, and their SQL forms where SQL can express them."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventflow.llm import chat, decontaminate, exact_dedup, html_text, id_files, merkle, packing, pii, prefix_trie, quality, sharding, simhash, token_counts
from eventflow.llm.common import new_path, table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_BPE_IDS = 50_257
SEQUENCE = 2048


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), BYTE_BPE, limit=512)


@query
def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), BYTE_BPE, SEQUENCE, end_id=1)


@query
def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    index = exact_dedup.DigestIndex(spark, new_path(spark, "digest-index"))
    decided = exact_dedup.decide(documents, index, "first")
    return decided.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


SQL["op2_exact_dedup"] = """
    WITH hashed AS (
        SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
    )
    SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = min(doc_id) OVER same AS kept, text_sha256
    FROM hashed WINDOW same AS (PARTITION BY text_sha256)
"""


@query
def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"), words=4, most=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    dealt = sharding.shards(table(spark, folder, "documents"), 16)
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return dealt.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


@query
def op6_id_files(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "id-files")
    id_files.write_ids(table(spark, folder, "documents"), BYTE_BPE, BYTE_BPE_IDS, path, end_id=0)
    return id_files.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op5_chat(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    fixed = "SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    formatted = chat.format_chat(conversations.unionByName(spark.sql(fixed)))
    return chat.digests(written(formatted, "chats"))


# The formatted length follows from the template: 3 for <s>, then the marks of each turn and its text, in which
# backslashes and control strings take one character more.
SQL["op5_chat"] = """
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), sized AS (
        SELECT *, len(regexp_extract_all(text, '\\\\|</?s>|<</?SYS>>|\\[/?INST\\]|\\[/?ROLE\\]|\\[TEXT\\]')) + length(text)
               + CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 15 WHEN 'assistant' THEN 6
                 ELSE 19 + length(role) + len(regexp_extract_all(role, '\\\\|</?s>|<</?SYS>>|\\[/?INST\\]|\\[/?ROLE\\]|\\[TEXT\\]')) END AS chars
        FROM turns
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(3 + sum(chars) AS BIGINT) AS formatted_chars
    FROM sized GROUP BY conv_id
"""


@query
def op3_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


@query
def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def grades(labels: DataFrame) -> DataFrame:
    """Graded ratings from the labels: toxic 0, poor 1, good 2."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", grade.alias("grade"))


@query
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = quality.fit(documents, grades(table(spark, folder, "labels")), levels=3)
    return quality.rate(documents, model, least_grade=2)


def lowered(text: str) -> Column:
    """``text`` with A-Z in lower case."""
    return F.translate(F.col(text), string.ascii_uppercase, string.ascii_lowercase)


@query
def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    found = merkle.digest_of([lowered(c) if c == "text" else F.col(c) for c in fields])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, found)
    manifest = merkle.build(merkle.leaves(documents, fields, "doc_id", "lang", tampered))
    return merkle.audit(manifest).withColumnRenamed("id", "doc_id")


#: Unsigned CRC-32 of a decimal number, bit by bit: each digit's byte is followed by eight shifts.
CRC_OF = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST({} AS VARCHAR), ''),
    lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"""


def _field(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"coalesce(octet_length(encode({text})) || ':' || {text}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ["doc_id", "source", "lang", "n_chars", text])) + ")"


def _sides(nodes: str, by: str) -> str:
    run = f"string_agg(digest, '') OVER (PARTITION BY {by}level, idx // 8 ORDER BY idx ROWS BETWEEN"
    before, after = f"{run} UNBOUNDED PRECEDING AND 1 PRECEDING)", f"{run} 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    return f"SELECT *, coalesce({before}, '') AS l, coalesce({after}, '') AS r FROM {nodes}"


SQL["op11_merkle"] = f"""
    WITH RECURSIVE hashed AS (
        SELECT doc_id, lang, {_leaf("text")} AS leaf,
               CASE WHEN {CRC_OF.format("doc_id")} % 3 = 0
                    THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS claim
        FROM documents
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
               count(*) OVER (PARTITION BY lang) AS n, row_number() OVER () AS id
        FROM hashed
    ), node AS (
        SELECT lang, 0 AS level, idx, n, leaf AS digest FROM placed
        UNION ALL
        SELECT lang, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx))
        FROM node WHERE n > 1 GROUP BY lang, level, n, idx // 8
    ), subroot AS (
        SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM node WHERE n = 1
    ), over AS (
        SELECT 0 AS level, idx, n, digest FROM subroot
        UNION ALL
        SELECT level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx))
        FROM over WHERE n > 1 GROUP BY level, n, idx // 8
    ), side AS ({_sides("node", "lang, ")}), over_side AS ({_sides("over", "")}),
    walk AS (
        SELECT id, lang, 0 AS level, idx, n, coalesce(claim, leaf) AS digest, '' AS proof FROM placed
        UNION ALL
        SELECT w.id, w.lang, w.level + 1, w.idx // 8, (w.n + 7) // 8, sha256(s.l || w.digest || s.r), w.proof || s.l || s.r
        FROM walk w JOIN side s ON s.lang IS NOT DISTINCT FROM w.lang AND s.level = w.level AND s.idx = w.idx
        WHERE w.n > 1
    ), over_walk AS (
        SELECT w.id, 0 AS level, s.idx, s.n, w.digest, w.proof, s.digest AS subroot
        FROM walk w JOIN subroot s ON s.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
        UNION ALL
        SELECT w.id, w.level + 1, w.idx // 8, (w.n + 7) // 8, sha256(s.l || w.digest || s.r), w.proof || s.l || s.r, w.subroot
        FROM over_walk w JOIN over_side s ON s.level = w.level AND s.idx = w.idx WHERE w.n > 1
    )
    SELECT p.doc_id, p.leaf, w.subroot, o.digest AS root, sha256(w.proof) AS proof_sha256, w.digest AS folded_root,
           w.digest = o.digest AS verified
    FROM placed p JOIN over_walk w ON w.id = p.id AND w.n = 1 JOIN over o ON o.n = 1
"""


@query
def op12_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.personal_data(table(spark, folder, "documents"))
    counts = [pii.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select(
        F.col("id").alias("doc_id"), *counts, F.sha2(pii.as_text(F.col("base")), 256).alias("base_sha256"), pii.as_text(F.col("spans")).alias("spans")
    )


@query
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    rows = prefix_trie.turns(table(spark, folder, "conversations"))
    return prefix_trie.nodes(prefix_trie.prefixes(prefix_trie.with_shared_openings(rows, group=20, most=4)))


SQL["op13_prefix_trie"] = f"""
    WITH turn AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rank
        FROM conversations WHERE conv_id IS NOT NULL
    ), conv AS (
        SELECT conv_id, {CRC_OF.format("conv_id")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turn)
    ), rebuilt AS (
        SELECT c.conv_id, 1 AS part, b.rank, b.role, b.text
        FROM conv c JOIN turn b ON b.conv_id = c.conv_id - c.conv_id % 20 AND b.rank <= c.h
        UNION ALL
        SELECT t.conv_id, 2, t.rank, t.role, t.text FROM turn t JOIN conv c USING (conv_id) WHERE t.rank > c.h
    ), prefix AS (
        SELECT conv_id, 0 AS depth, '' AS key, 0 AS words FROM conv
        UNION ALL
        SELECT conv_id, row_number() OVER so_far, string_agg(sha256(strlen(role) || ':' || role || text), '') OVER so_far,
               len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))
        FROM rebuilt WINDOW so_far AS (PARTITION BY conv_id ORDER BY part, rank ROWS UNBOUNDED PRECEDING)
    ), size AS (SELECT conv_id, max(depth) AS turns FROM prefix GROUP BY conv_id
    ), node AS (
        SELECT depth, key, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
               sha256(coalesce(string_agg(p.conv_id, ',' ORDER BY p.conv_id) FILTER (turns = depth), '')) AS ends_sha256,
               max(turns) = depth AS leaf
        FROM prefix p JOIN size USING (conv_id) GROUP BY depth, key
    ), placed AS (
        SELECT n.*, p.key AS parent_key FROM node n LEFT JOIN prefix p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1
    ), above AS (
        SELECT p.depth, p.key, sum((n.n_convs - 1) * n.words) AS saved, count(*) FILTER (n.leaf) AS leaves,
               count(*) FILTER (n.depth = p.depth + 1) AS children
        FROM node n JOIN prefix p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.depth, p.key
    )
    SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs,
           a.children AS n_children, a.leaves AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, n.ends_sha256
    FROM placed n JOIN above a ON a.depth = n.depth AND a.key = n.key
    LEFT JOIN node u ON u.depth = n.depth - 1 AND u.key = n.parent_key
"""
