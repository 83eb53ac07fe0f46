"""The registered queries opN_<name> and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.storage import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyloom.llm.ngram_join import similar_components

    return similar_components(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyloom.llm.packing import grouped, pieces

    found = pieces(table(spark, sf_dir, "documents"), tokenizer())
    narrow = found.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "tier_index")
    return grouped(materialize(narrow, "pieces"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyloom.llm.exact_dedup import content_groups

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return content_groups(docs).select(F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyloom.llm.storage import scratch
    from keyloom.llm.token_files import read_documents, write_token_files

    path = scratch(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer())
    return read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("token_ids").alias("ids_crc32"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyloom.llm.substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyloom.llm.chat import chat_windows, read_windows

    own = r"\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    back = read_windows(materialize(chat_windows(turns), "chat"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyloom.llm.toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


#: The present layout that op8 starts from: shards by a hash of the text.
OLD_SHARDS, NEW_SHARDS = 32, 40


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyloom.llm.sharding import read_shards, reshard, slots
    from keyloom.llm.storage import scratch

    path = scratch(spark, "shards")
    old = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(OLD_SHARDS))
    kept = reshard(table(spark, sf_dir, "documents").select("doc_id", "text"), path, NEW_SHARDS, old, OLD_SHARDS)
    crc = F.crc32(F.coalesce("row.text", F.lit("")).cast("binary"))
    narrow = read_shards(spark, path, kept).select("row.doc_id", "size", crc.alias("text_crc32"), "h", "shard")
    return slots(narrow).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyloom.llm.decontamination import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    names = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyloom.llm.storage import scratch
    from keyloom.llm.warc import read_warc, write_warc

    path = scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path)


SQL = {
    "op1_ngram_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT DISTINCT doc_id, array_to_string(w[s : s + least(len(w), 4) - 1], ' ') AS g FROM d, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS u(s) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
        b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
        r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT b.y, r.root FROM r JOIN b ON b.x = r.doc_id WHERE r.root < b.y)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(root) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.doc_id = d.doc_id GROUP BY ALL
    """,
    "op5_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT doc_id, s, array_to_string(w[s : s + 12], ' ') AS g FROM d, unnest(range(1, len(w) - 11)) AS u(s)),
        m AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g),
        h AS (SELECT DISTINCT doc_id, k FROM g JOIN m USING (g), unnest(range(s, s + 13)) AS u(k) WHERE doc_id > least),
        a AS (SELECT doc_id, list(k) AS gone FROM h GROUP BY doc_id),
        f AS (SELECT doc_id, w, gone, CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END AS kept FROM d LEFT JOIN a USING (doc_id))
        SELECT doc_id, len(w) AS n_words, len(w) - len(kept) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM f
    """,
    "op9_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        q AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS g
            FROM i, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(s) WHERE len(w) > 0),
        p AS (SELECT doc_id, s, m, array_to_string(w[s : s + m - 1], ' ') AS g
            FROM d, (SELECT DISTINCT m FROM q), unnest(range(1, len(w) - m + 2)) AS u(s)),
        h AS (SELECT p.doc_id, p.s, p.m, q.item_id FROM p JOIN q ON p.g = q.g AND p.m = q.m),
        c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM h, unnest(range(s, s + m)) AS u(k) GROUP BY doc_id),
        t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM h GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
    """,
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
        g AS (SELECT t, max(page_id) AS keep, sha1(t) AS h FROM p GROUP BY t),
        v AS (SELECT t, keep, list_transform(range(0, 8), lambda i: ('0x' || substr(h, CAST(5 * i + 1 AS BIGINT), 5))::BIGINT) AS q FROM g),
        e AS (SELECT t, keep, array_to_string(list_transform(range(0, 32), lambda k:
            substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((q[CAST(k // 4 + 1 AS BIGINT)] >> (15 - 5 * (k % 4))::INTEGER) & 31) AS BIGINT), 1)), '') AS d FROM v)
        SELECT page_id, strlen(t) AS payload_bytes, d AS payload_digest,
            CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> keep THEN keep END AS refers_to
        FROM p JOIN e USING (t)
    """,
    "op3_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
        FROM d JOIN g USING (t)
    """,
}


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
