"""The queries of this subpackage's operators over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, common, decontamination, filters, jaccard, langid, licenses, lines, packing, quality, substrings, tokenization, toxicity, trie


def _tokenizer(name: str) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = _tokenizer("byte_bpe_50k.tiktoken")
    coded = tokenization.encode(_table(spark, sf_dir, "documents"), path, pattern)
    back = tokenization.decode(coded, path, pattern)
    return back.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~common.held_out("doc_id")), _tokenizer("piece_bpe_32k.model")[0])
    return langid.predict(docs, model).select("doc_id", common.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", common.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.phrases(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x.end - x.start)
    ids = F.array_sort(F.col("items").cast("array<string>"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(_table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "class", "n_links", "component_id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_table(spark, sf_dir, "documents"), "source", out_cols=["doc_id", "source"])


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    chain = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.judge(docs, chain).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = _tokenizer("byte_bpe_50k.json")
    return packing.best_fit(_table(spark, sf_dir, "documents"), path, pattern)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_byte_bpe, op2_language, op3_toxicity, op4_decontamination, op5_substring_dedup, op6_chat_format, op7_license_scan, op8_jaccard_join, op9_line_dedup, op10_quality, op11_conversation_trie, op12_filter_audit, op13_best_fit_packing)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD4 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_OP4 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD4}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD4}') AS w FROM benchmark),
win AS (SELECT item_id, least({decontamination.WINDOW}, len(w)) AS n, array_to_string(w[i:i + least({decontamination.WINDOW}, len(w)) - 1], ' ') AS k
        FROM b, unnest(range(1, len(w) - least({decontamination.WINDOW}, len(w)) + 2)) t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM d, (SELECT DISTINCT n FROM win) s, unnest(range(1, greatest(len(w) - n + 2, 1))) t(i)),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN win USING (k, n)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN item USING (doc_id)
"""

_OP6 = f"""
WITH c AS (SELECT conv_id, count(*) AS n, list({{'r': role, 'x': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
u AS (SELECT l, any_value(n) AS n, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY l),
k AS (SELECT * FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.n > a.n AND b.l[1:a.n] = a.l))
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, CAST(n_copies AS BIGINT) AS n_copies,
       array_to_string(list_transform(l, lambda x: '{chat.START}' || coalesce(x.r, '') || chr(10) || coalesce(x.x, '') || '{chat.END}' || chr(10)), '') AS rendered
FROM k
"""


def _license_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in licenses.KNOWN)
    whole = ", ".join(f"({quote(i)}, {quote(d)})" for i, d in licenses.WHOLE)
    single = {a: b for a, b in licenses.EQUIVALENT if " " not in a}
    table = f"map([{', '.join(map(quote, single))}], [{', '.join(map(quote, single.values()))}])"
    words = (
        r"' ' || regexp_replace(regexp_replace(lower(text), '(^|\n)[ \t*#/;-]*(copyright|\(c\)|©|all rights reserved)[^\n]*', chr(10), 'g'), '[\x00-/:-`{-\x7f]+', ' ', 'g') || ' '"
    )
    spelt = f"trim(array_to_string(list_transform(string_split(replace({words}, ' sub license ', ' sublicense '), ' '), lambda w: coalesce({table}[w], w)), ' '))"
    digest = lambda t, key: f"SELECT {key}, CASE WHEN c <> '' THEN sha256(c) END AS digest FROM (SELECT {key}, {spelt} AS c FROM {t})"
    return f"""
WITH known(license_id, text) AS (VALUES {rows}), k AS (SELECT DISTINCT license_id, digest FROM ({digest('known', 'license_id')}) UNION SELECT * FROM (VALUES {whole}) w(license_id, digest)), d AS ({digest('documents', 'doc_id')})
SELECT doc_id, d.digest, license_id FROM d LEFT JOIN k ON d.digest = k.digest
"""


_OP9 = rf"""
WITH p AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS l FROM documents),
h AS (SELECT source, count(*) AS n_host FROM p GROUP BY source),
c AS (SELECT source, line, count(*) AS n_pages FROM (SELECT source, unnest(list_distinct(list_filter(l, lambda x: trim(x) <> ''))) AS line FROM p) GROUP BY source, line),
g AS (SELECT c.source, list(line) AS gone FROM c JOIN h ON c.source IS NOT DISTINCT FROM h.source WHERE n_pages >= {lines.MIN_PAGES} AND n_pages > CAST({lines.RATIO} AS DOUBLE) * n_host GROUP BY c.source),
r AS (SELECT doc_id, p.source, text, l, list_filter(l, lambda x: NOT list_contains(coalesce(gone, []), x)) AS kept FROM p LEFT JOIN g ON p.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, source, array_to_string(kept, chr(10)) AS text, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(l) - len(kept), 0) AS BIGINT) AS n_dropped FROM r
"""

_OP11 = f"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
c AS (SELECT conv_id, conv_id - conv_id % {trie.FAMILY} AS base,
        xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % {trie.LEADS} AS h
      FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), crc),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k, {{'r': coalesce(role, ''), 'x': coalesce(text, '')}} AS said FROM conversations),
s AS (SELECT c.conv_id, 0 AS own, k, said FROM c JOIN o ON o.conv_id = base AND k <= h UNION ALL SELECT c.conv_id, 1, k, said FROM c JOIN o ON o.conv_id = c.conv_id AND k > h),
w AS (SELECT c.conv_id, coalesce(l, []) AS l FROM c LEFT JOIN (SELECT conv_id, list(said ORDER BY own, k) AS l FROM s GROUP BY conv_id) USING (conv_id)),
n AS (SELECT d, l[1:d] AS key, count(*) AS n_convs, min(conv_id) AS conv_id, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(l) = d), '') AS ends FROM w, unnest(range(len(l) + 1)) r(d) GROUP BY ALL),
k AS (SELECT d - 1 AS d, key[1:d - 1] AS key, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (d, key)),
u AS (SELECT r.d, key[1:r.d] AS key, count(*) FILTER (n_children = 0) AS n_leaves, sum(CASE WHEN f.d = 0 THEN 0 ELSE (n_convs - 1) * length(key[f.d].x) END) AS saved FROM f, unnest(range(f.d + 1)) r(d) GROUP BY ALL)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN u USING (d, key) LEFT JOIN n p ON p.d = f.d - 1 AND p.key = f.key[1:f.d - 1]
"""

_OP12 = r"""
WITH l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
d AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        concat(CASE WHEN len(w) < 50 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END,
               CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 5 * length(x) THEN 'C' ELSE '' END, CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END,
               CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY x) THEN 'E' ELSE '' END) AS failed
      FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
f(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT concat(a.c, b.c, c.c, d.c, e.c) AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
g AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM d GROUP BY part, failed),
s AS (SELECT g.*, filter_order, step, filter_order[step] AS own, len(translate(filter_order[1:step - 1], failed, '')) < step - 1 AS gone, contains(failed, filter_order[step]) AS hit FROM g, o, range(1, 6) r(step)),
m AS (SELECT part, filter_order, step, own, sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = own THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN hit AND NOT gone THEN n_good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone THEN n_toxic ELSE 0 END) AS toxic_lost
      FROM s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM m
"""

SQL: dict[str, str] = {"op4_decontamination": _OP4, "op6_chat_format": _OP6, "op7_license_scan": _license_sql(), "op9_line_dedup": _OP9, "op11_conversation_trie": _OP11, "op12_filter_audit": _OP12}
