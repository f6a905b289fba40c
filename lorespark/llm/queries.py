"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, conversation_repair, decontaminate, exact_search, html_extract, license_scan, line_dedup, merkle_manifest, mix_sources, ngram_join, quality_rules, resample, secret_scan


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.ngram_jaccard_join(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)
    return out.select("doc_id", "n_shingles", "component_id", "n_links")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.html_extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.secret_scan(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base"), 256).alias("base_sha256"), "spans", "n_guess")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


#: The contract's extra conversation.
PROBE = "</s>[INST] ok [/INST]"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    out = chat_format.chat_format(rows.unionByName(probe))
    out = out.withColumns({"turns": chat_format.read_back(F.col("formatted")), "loss": chat_format.masked(F.col("formatted"), F.col("loss_spans"))})
    turn = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(F.array_join(turn, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_scores(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "log_perplexity")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources.mix_sources(_table(spark, sf_dir, "documents"))


def op10_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_grams", "log_weight", "noisy_weight", "selected")


def op11_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.exact_search(_table(spark, sf_dir, "embeddings"), k=20, every=20)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    claim = merkle_manifest.leaf([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), tampered])
    out = merkle_manifest.merkle_manifest(docs, carried={"claim": claim})
    out = out.withColumn("folded_root", merkle_manifest.folded(F.col("claim"), F.col("levels")))
    return out.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle_manifest.proof_digest(F.col("levels")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    rows = rows.select("conv_id", "turn", shown[2].alias("role"), shown[3].alias("text"), (F.crc32(F.concat(shown[0], F.lit(":"), shown[1])) % 20).alias("harm"))
    rows = rows.withColumns({
        "text": F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
        "role": F.when(F.col("harm") == 4, "user").otherwise(F.col("role")),
        "copy": F.explode(F.sequence(F.lit(1), F.when(F.col("harm") == 3, 2).otherwise(1))),
    })
    out = conversation_repair.conversation_repair(rows, present=F.col("harm") != 0)
    lines = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_join, op2_html_extract, op3_decontaminate, op4_license_scan, op5_secret_scan,
        op6_line_dedup, op7_chat_format, op8_quality_rules, op9_mix_sources, op10_resample, op11_exact_search, op12_merkle_manifest, op13_conversation_repair,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of an ASCII string, bit by bit."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"""


def _leaf(text: str) -> str:
    """SQL for the digest of a row whose text is ``text``."""
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"



def _plus(best: str, cost: int | str, label: str) -> str:
    """SQL for a cheapest path behind one more edit; a path is its cost in nine digits and its labels, so that paths compare as strings."""
    return f"printf('%09d', left({best}, 9)::BIGINT + {cost}) || '{label}' || substr({best}, 10)"


def _read(role: str, after: str, state: str) -> str:
    """SQL for the cheapest path from grammar state ``state`` that reads a row first; keeping it is grammatical for initial ``role``, to ``after``."""
    kept = f"CASE WHEN r = '{role}' THEN {_plus(after, 'stays', 'K')} END"
    if state == "b0":
        kept += f", CASE WHEN r = 's' THEN {_plus('bs', 'stays', 'K')} END"
    return f"least({_plus(state, 2, 'D')}, CASE WHEN f IN ('-', 't') THEN least({kept}, {_plus(after, 'stays + 1', 'R')}) END)"


SQL: dict[str, str] = {
    "op1_ngram_join": rf"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        links AS (
            SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
            JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.i >= 90 * (na.n + nb.n - p.i)
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        )
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, coalesce(k.n_links, 0)::BIGINT AS n_links
        FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
        LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a) k USING (doc_id)""",
    "op3_decontaminate": rf"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), win AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + 9), ' ') AS g
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)
        ), placed AS (
            SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
            FROM (SELECT doc_id, w, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS i FROM d, (SELECT DISTINCT k FROM win))
        ), hits AS (SELECT doc_id, item_id, i, p.k FROM placed p JOIN win ON p.k = win.k AND p.g = win.g),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id
        )
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op6_line_dedup": rf"""
        WITH l AS (
            SELECT doc_id, i, lines[i] AS line, translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key
            FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
        ), lost AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
        SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(keeper IS NOT NULL AND keeper <> doc_id)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
        FROM l LEFT JOIN lost USING (key) GROUP BY doc_id""",
    "op7_chat_format": rf"""
        WITH c AS (
            SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')
        ), e AS (
            SELECT *, length(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '[INST]', '[\INST]'), '[SEP]', '[\SEP]'), '[/INST]', '[\/INST]'), '</s>', '<\/s>')) AS n,
                   CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 5 ELSE length(role) + 20 END AS markup
            FROM c
        )
        SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               sum(n + markup)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op11_exact_search": """
        WITH v AS (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        )
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score,
                   row_number() OVER (PARTITION BY q.r ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id NULLS LAST) AS rank
            FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0
        ) WHERE rank <= 20""",
    "op12_merkle_manifest": rf"""
        WITH RECURSIVE d AS (
            SELECT row_number() OVER () AS r, doc_id, source, {_leaf("text")} AS leaf,
                   CASE WHEN {_crc32("doc_id::VARCHAR")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS claim
            FROM documents
        ), leaves AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d
        ), nodes AS (
            SELECT source, 0 AS level, i, n, leaf AS h FROM leaves
            UNION ALL SELECT source, level + 1, divide(i, 3), divide(n + 2, 3), sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY source, level, divide(i, 3), n
        ), groups AS (
            SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
        ), tops AS (
            SELECT 0 AS level, i, n, h FROM groups
            UNION ALL SELECT level + 1, divide(i, 3), divide(n + 2, 3), sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, divide(i, 3), n
        ), sibs AS (
            SELECT a.source, a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS pre, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS suf
            FROM nodes a JOIN nodes b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND divide(a.i, 3) = divide(b.i, 3) WHERE a.n > 1 GROUP BY ALL
        ), top_sibs AS (
            SELECT a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS pre, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS suf
            FROM tops a JOIN tops b ON a.level = b.level AND divide(a.i, 3) = divide(b.i, 3) WHERE a.n > 1 GROUP BY ALL
        ), fold AS (
            SELECT r, source, 0 AS level, i, n, claim AS h, '' AS proof FROM leaves
            UNION ALL SELECT f.r, f.source, f.level + 1, divide(f.i, 3), divide(f.n + 2, 3), sha256(pre || h || suf), proof || pre || suf
            FROM fold f JOIN sibs s ON f.source IS NOT DISTINCT FROM s.source AND f.level = s.level AND f.i = s.i
        ), top_fold AS (
            SELECT f.r, 0 AS level, g.i, g.n, f.h, f.proof FROM fold f JOIN groups g ON f.source IS NOT DISTINCT FROM g.source WHERE f.n = 1
            UNION ALL SELECT f.r, f.level + 1, divide(f.i, 3), divide(f.n + 2, 3), sha256(pre || h || suf), proof || pre || suf FROM top_fold f JOIN top_sibs s ON f.level = s.level AND f.i = s.i
        )
        SELECT d.doc_id, d.leaf, g.h AS subroot, t.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
        FROM d JOIN groups g ON d.source IS NOT DISTINCT FROM g.source JOIN top_fold f ON d.r = f.r AND f.n = 1 JOIN tops t ON t.n = 1""",
    "op13_conversation_repair": rf"""
        WITH RECURSIVE c AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   {_crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS harm FROM conversations
        ), d AS (
            SELECT conv_id, turn, CASE harm WHEN 4 THEN 'user' ELSE role END AS role,
                   CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE harm WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c
        ), o AS (
            SELECT conv_id, turn, role, text, left(role, 1) AS r, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS e,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM d
        ), rows AS (
            SELECT *, CASE WHEN f = 't' THEN 5 ELSE 0 END AS stays FROM (
                SELECT *, CASE WHEN e = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN e NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS f,
                       lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r NOT IN ('su', 'ua', 'au') AS bad FROM o)
        ), sums AS (
            SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(f = 'b') AS blank,
                   count_if(f = 'd') AS duplicate, count_if(f = 't') AS truncated, coalesce(count_if(bad), 0) AS illegal FROM rows GROUP BY conv_id
        ), back AS (
            SELECT conv_id, n + 1 AS i, '000000000' AS b0, '000000010II' AS bs, '000000005I' AS bu, '000000000' AS ba FROM sums
            UNION ALL
            SELECT conv_id, i, least(c0, {_plus("cu", 5, "I")}, {_plus("ca", 10, "II")}), least(cs, {_plus("cu", 5, "I")}, {_plus("ca", 10, "II")}),
                   least(cu, {_plus("ca", 5, "I")}), least(ca, {_plus("cu", 5, "I")})
            FROM (SELECT b.conv_id, x.i, {_read("u", "bu", "b0")} AS c0, {_read("u", "bu", "bs")} AS cs, {_read("a", "ba", "bu")} AS cu, {_read("u", "bu", "ba")} AS ca
                  FROM back b JOIN rows x ON b.conv_id IS NOT DISTINCT FROM x.conv_id AND x.i = b.i - 1)
        ), best AS (SELECT conv_id, left(b0, 9)::BIGINT AS cost, substr(b0, 10) AS audit FROM back WHERE i = 1),
        walk AS (
            SELECT conv_id, audit AS rest, 1::BIGINT AS i, '' AS g, []::VARCHAR[] AS lines FROM best
            UNION ALL
            SELECT w.conv_id, substr(rest, 2), w.i + CASE WHEN left(rest, 1) = 'I' THEN 0 ELSE 1 END,
                   CASE left(rest, 1) WHEN 'D' THEN g WHEN 'K' THEN x.r ELSE CASE g WHEN 'u' THEN 'a' ELSE 'u' END END,
                   CASE left(rest, 1) WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, x.role || ':' || x.text)
                        ELSE list_append(lines, CASE g WHEN 'u' THEN 'assistant' ELSE 'user' END || ':' || CASE left(rest, 1) WHEN 'R' THEN x.text ELSE '' END) END
            FROM walk w LEFT JOIN rows x ON w.conv_id IS NOT DISTINCT FROM x.conv_id AND w.i = x.i WHERE rest <> ''
        )
        SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
               coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
               sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN sums s ON a.conv_id IS NOT DISTINCT FROM s.conv_id
        LEFT JOIN best b ON a.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN walk w ON a.conv_id IS NOT DISTINCT FROM w.conv_id AND w.rest = ''""",
}
