"""The registered queries of the operators of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timelens.llm import chat, collocations, config_pack, credentials, decontaminate, fingerprint, line_dedup, near_duplicates, ngrams, pack, token_counts, toxicity, turn_repair
from timelens.session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", toxicity.in_fold("doc_id", 10).alias("held_out"))
    return ngrams.score_documents(documents, ngrams.build_model(documents.where("NOT held_out")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.mark_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"),
                        F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.col("item_ids").cast("array<string>")), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(
        table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model")).drop("text")


def op5_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    of = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long")
    return found.select(
        F.col("repository").alias("doc_id"), of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(credentials.as_text(F.col("base")), 256).alias("base_sha256"), credentials.as_text(F.col("spans")).alias("spans"),
        "n_live", "n_copied")


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.digest_pieces(
        pack.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionAll(tricky)
    return chat.read_back(chat.format_conversations(rows))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train_on(documents, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(documents, model).select(
        "doc_id", toxicity.in_fold("doc_id", 5).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), "n_windows", "top_word")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.find_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprint.with_neighbours(documents, fingerprint.build_lexicon(documents))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_collocations(table(configure(spark), sf_dir, "documents"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turn_repair.damage(table(configure(spark), sf_dir, "conversations"))
    return turn_repair.with_digests(*turn_repair.repair_conversations(rows))


def op13_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(configure(spark), sf_dir, "documents")
    return config_pack.pack_documents(documents, tokenizer_path("byte_bpe_50k.json"), with_ids=False)


QUERIES = {
    "op1_language_model": op1_language_model,
    "op2_line_dedup": op2_line_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_token_counts": op4_token_counts,
    "op5_credentials": op5_credentials,
    "op6_pack": op6_pack,
    "op7_chat": op7_chat,
    "op8_toxicity": op8_toxicity,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_fingerprint": op10_fingerprint,
    "op11_collocations": op11_collocations,
    "op12_turn_repair": op12_turn_repair,
    "op13_best_fit_pack": op13_best_fit_pack,
}

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"



def _found(kind: str, rank: int, pattern: str, kept: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""SELECT r, doc_id, source, '{kind}' AS kind, {rank} AS rank, m AS value, start, start + length(m) AS "end" FROM (
        SELECT r, doc_id, source, ms[i] AS m, CAST(coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0)
            + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
        FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
            SELECT r, doc_id, source, regexp_extract_all(t, '{quoted}') AS ms, regexp_split_to_array(t, '{quoted}') AS ps FROM d)))
    WHERE {kept}"""


_ASSIGN = credentials.ASSIGN.replace("'", "''")

SQL = {
    "op3_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w
        FROM benchmark WHERE item_id IS NOT NULL),
    bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(list_slice(w, p, p + 9), ' ') AS win
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT size FROM bw),
    dw AS (SELECT r, size, p, array_to_string(list_slice(w, p, p + size - 1), ' ') AS win
        FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size)),
    hits AS (SELECT r, p, size, item_id FROM dw JOIN bw USING (size, win)),
    words AS (SELECT r, count(DISTINCT p + k) AS n_hit
        FROM (SELECT DISTINCT r, p, size, unnest(range(0, size)) AS k FROM hits) GROUP BY r),
    items AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
        FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op7_chat": f"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    t AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before,
        length(text) + length(text) - length(replace(text, chr(92), ''))
        + len(regexp_extract_all(text, '<s>|</s>|\\[INST\\]|\\[/INST\\]|<<SYS>>|<</SYS>>|<<ROLE>>|<</ROLE>>|<<END>>')) AS body
        FROM c)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(body + CASE role WHEN 'system' THEN 20 WHEN 'user' THEN 18 ELSE 5 END) AS BIGINT) AS formatted_chars,
    bool_and(CASE role WHEN 'system' THEN before IS NULL
        WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant') ELSE coalesce(before = 'user', false) END) AS valid
FROM t GROUP BY conv_id""",
    "op5_credentials": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
    base AS ({_found("assign", 0, credentials.ASSIGN, f"length(regexp_extract(m, '{_ASSIGN}', 2)) >= 6")}
        UNION ALL {_found("access", 1, credentials.ACCESS, "true")}
        UNION ALL {_found("hex", 2, credentials.HEX, "true")}),
    runs AS (SELECT * FROM ({_found("owned", 3, credentials.RUN, "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')")}) a
        WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = a.r AND b.start < a."end" AND a.start < b."end")),
    both_ AS (SELECT *, CASE rank WHEN 0 THEN regexp_extract(value, '{_ASSIGN}', 2) ELSE value END AS secret
        FROM (SELECT * FROM base UNION ALL SELECT * FROM runs)),
    owners AS (SELECT secret, count(DISTINCT coalesce(source, '')) AS n FROM both_ GROUP BY secret),
    judged AS (SELECT both_.*, n >= 2 AS copied FROM both_ JOIN owners USING (secret) WHERE rank < 3 OR n < 2),
    per AS (SELECT r, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access,
        count(*) FILTER (rank = 2) AS n_hex, count(*) FILTER (copied) AS n_copied, count(*) FILTER (NOT copied) AS n_live,
        string_agg(concat_ws(':', kind, start, "end"), ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
        string_agg(concat_ws(':', kind, start, "end"), ',' ORDER BY start, rank) AS spans FROM judged GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
    coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN per USING (r)""",
    "op11_collocations": f"""
WITH pieces AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\\n\\x0B\\f\\r]')), '[^ \\t]+') AS w
        FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), {_LETTERS}) AS t FROM documents)),
    totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
    grams AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, w[i:i + size - 1] AS words FROM (
        SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM pieces, (VALUES (1), (2), (3), (4)) sizes(size) WHERE len(w) >= size)),
    f AS (SELECT lang, phrase, any_value(size) AS size, any_value(words) AS words, count(*) AS f FROM grams GROUP BY lang, phrase HAVING count(*) >= 30),
    cuts AS (SELECT lang, phrase, f AS a, words, unnest(range(1, size)) AS k FROM f WHERE size >= 2),
    scored AS (SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, k, CAST(2000000::HUGEINT * c.a // (x.f::HUGEINT + y.f) AS BIGINT) AS score
        FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1:k], ' ')
        JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[k + 1:], ' ')),
    least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    longer AS (SELECT lang, array_to_string(words[i:i + n - 1], ' ') AS phrase, max(f) AS m FROM (
        SELECT *, unnest(range(1, size - n + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS n FROM f WHERE size >= 3)) GROUP BY ALL),
    left_over AS (SELECT least.* FROM least LEFT JOIN longer USING (lang, phrase) WHERE m IS NULL OR 100::HUGEINT * m < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "binary") AS rank, phrase, a, l, r, n, score
FROM left_over JOIN totals USING (lang) QUALIFY rank <= 2000""",
}
