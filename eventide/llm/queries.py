"""The corpus operators' queries over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    decontaminate,
    exact_dedup,
    filter_audit,
    line_dedup,
    mixing,
    quality_classifier,
    quality_rules,
    quotation,
    sharding,
    simhash,
    substring_dedup,
    turn_repair,
)
from .common import stored, table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a message, with its place in its conversation and the part of the conversation it is
    stored in: the part's size and the hash of its texts in reply order."""
    out = stored(quotation.parts(quotation.format_chats(table(spark, sf_dir, "conversations"))), "chats")
    texts = F.array_join(F.transform("messages", lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit(":"), m["text"])), "\n")
    whole = quotation.conversations(out).select("thread_conv", "thread_turn", "part", F.size("messages").cast("bigint").alias("part_size"), F.sha2(F.encode(texts, "UTF-8"), 256).alias("part_sha256"))
    out = out.join(whole, ["thread_conv", "thread_turn", "part"], "left")
    return out.select("conv_id", "turn", "role", "parent_conv", "parent_turn", "thread_conv", "thread_turn", "depth", "place", "quote_levels", "n_quoted", F.sha2(F.encode("own_text", "UTF-8"), 256).alias("own_sha256"), "part", "part_size", "part_sha256")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "source", "copies", "copy", "shuffle_key", F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_md5"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole records go through both passes; the columns are worked out from the written buckets."""
    out = sharding.assign(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", sharding.size_of(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), "contaminated")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_damaged(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_simhash": op2_simhash,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_quotation": op4_quotation,
    "op5_mixing": op5_mixing,
    "op6_sharding": op6_sharding,
    "op7_bpe_codec": op7_bpe_codec,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_line_dedup": op10_line_dedup,
    "op11_decontamination": op11_decontamination,
    "op12_filter_audit": op12_filter_audit,
    "op13_turn_repair": op13_turn_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
        win AS (
            SELECT doc_id, i, word, string_agg(word, ' ') OVER ahead AS s, count(*) OVER ahead = 13 AS whole
            FROM u WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
        hit AS (
            SELECT doc_id, i, word, whole AND min(doc_id) OVER (PARTITION BY whole, s) < doc_id AS dup FROM win),
        cov AS (
            SELECT doc_id, i, word, bool_or(dup) OVER (
                PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM hit),
        a AS (
            SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
                   string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM cov GROUP BY doc_id)
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM documents LEFT JOIN a USING (doc_id)""",
    "op8_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS len,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents),
        k AS (
            SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY norm) AS group_size
            FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k""",
    "op5_mixing": r"""
        WITH s AS (SELECT source, count(*) AS n, sqrt(count(*)) AS weight FROM documents GROUP BY source),
        m AS (
            SELECT source, (SELECT sum(n) FROM s) * (weight / (SELECT sum(weight) FROM s)) / n AS mean FROM s),
        p AS (
            SELECT source, mean, k, exp(-mean) * CASE WHEN k = 0 THEN 1 ELSE
                   (SELECT product(mean / j) FROM range(1, k + 1) t(j)) END AS p
            FROM m, range(0, 60) r(k)),
        c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
        k AS (
            SELECT doc_id, source, text, coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, '')) || ':'
                   || (row_number() OVER (PARTITION BY doc_id, source, text) - 1) AS name FROM documents),
        u AS (
            SELECT *, (('0x' || substr(md5('20240501:' || name || ':0'), 1, 13))::BIGINT + 0.5)
                      / 4503599627370496::DOUBLE AS u FROM k),
        n AS (
            SELECT doc_id, u.source, text, name,
                   (SELECT count(*) FROM c WHERE c.source = u.source AND c.cdf <= u.u AND c.cdf < 0.99999999999999) AS copies
            FROM u)
        SELECT doc_id, source, copies, copy, md5('20240502:' || name || ':' || copy) AS shuffle_key,
               md5(coalesce(text, '')) AS text_md5
        FROM (SELECT *, unnest(range(0, copies)) AS copy FROM n)""",
    "op10_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        x AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l),
        k AS (
            SELECT doc_id, i, line, translate(trim(line, E' \t\n\x0b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM x),
        f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (f.key IS NOT NULL) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL), '')) AS kept_sha256
        FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id""",
    "op9_quality_rules": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
            FROM documents),
        u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
        g AS (
            SELECT doc_id, i, string_agg(word, ' ') OVER ahead AS s, count(*) OVER ahead = 3 AS whole
            FROM u WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
        r AS (SELECT doc_id, i, whole AND count(*) OVER (PARTITION BY doc_id, whole, s) > 1 AS rep FROM g),
        c AS (
            SELECT doc_id, bool_or(rep) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS cov FROM r),
        n AS (SELECT doc_id, count(*) FILTER (cov) AS n_rep FROM c GROUP BY doc_id),
        k AS (
            SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
                   length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
                   coalesce(n_rep, 0) AS n_repeat_words, len(l) AS n_lines, len(list_distinct(w)) AS n_distinct,
                   length(regexp_replace(t, '[^A-Z]', '', 'g')) AS caps, length(regexp_replace(t, '[^!]', '', 'g')) AS excl,
                   length(regexp_replace(t, '[^0-9]', '', 'g')) AS digits
            FROM d LEFT JOIN n USING (doc_id)),
        f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM k)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR n_distinct * 50 < n_words OR n_symbols * 5 > n_words OR caps * 5 > word_chars * 2
                    OR excl * 5 > n_words OR n_dup_lines * 2 > n_lines OR word_chars < n_words * 2
                    OR word_chars > n_words * 20 OR digits * 2 > word_chars) AS kept
        FROM f""",
    "op4_quotation": r"""
        WITH RECURSIVE l AS (
            SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM conversations),
        p AS (
            SELECT *, length(regexp_replace(regexp_extract(line, '^[ \t]*(>[> \t]*)', 1), '[ \t]', '', 'g')) AS level,
                   regexp_replace(line, '^[ \t]*(>[> \t]*)', '') AS body FROM l),
        q AS (
            SELECT *, translate(trim(regexp_replace(body, '[\x20\x09-\x0D]+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm,
                   coalesce(lead(level) OVER (PARTITION BY conv_id, turn ORDER BY i), 0) AS below FROM p),
        kinds AS (
            SELECT *, CASE WHEN level > 0 THEN level WHEN below > 0 AND norm LIKE '%:' THEN -1 ELSE 0 END AS kind FROM q),
        runs AS (
            SELECT *, sum(CASE WHEN kind = pk AND norm <> '' AND pn <> '' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS run
            FROM (SELECT *, lag(kind) OVER w AS pk, lag(norm) OVER w AS pn FROM kinds WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i))),
        pas AS (
            SELECT conv_id, turn, run, kind, string_agg(norm, chr(10) ORDER BY i) AS h, count(*) AS weight
            FROM runs WHERE norm <> '' AND kind >= 0 GROUP BY ALL),
        units AS (
            SELECT conv_id, turn, run, kind, h, weight, true AS whole FROM pas
            UNION ALL SELECT r.conv_id, r.turn, r.run, r.kind, r.norm, 1, false
            FROM runs r JOIN pas p USING (conv_id, turn, run) WHERE p.weight > 1 AND r.norm <> '' AND r.kind >= 0),
        here AS (SELECT conv_id, h, min(turn) AS ft FROM units WHERE kind = 0 GROUP BY ALL),
        anywhere AS (
            SELECT h, conv_id AS ac, ft AS at_ FROM (
                SELECT *, row_number() OVER (PARTITION BY h ORDER BY conv_id, ft) AS n FROM here) WHERE n = 1),
        v0 AS (
            SELECT u.conv_id, u.turn, u.run, u.kind AS level, weight, whole,
                   CASE WHEN h.ft < u.turn THEN u.conv_id WHEN ac < u.conv_id OR (ac = u.conv_id AND at_ < u.turn) THEN ac END AS pc,
                   CASE WHEN h.ft < u.turn THEN h.ft WHEN ac < u.conv_id OR (ac = u.conv_id AND at_ < u.turn) THEN at_ END AS pt
            FROM units u LEFT JOIN here h ON h.conv_id = u.conv_id AND h.h = u.h LEFT JOIN anywhere a ON a.h = u.h
            WHERE u.kind > 0),
        v AS (SELECT *, bool_or(whole) OVER (PARTITION BY conv_id, turn, run) AS settled FROM v0 WHERE pc IS NOT NULL),
        b AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, (pc = conv_id) DESC, pc DESC, pt DESC) AS r
            FROM (SELECT conv_id, turn, level, pc, pt, sum(weight) AS n FROM v WHERE whole OR NOT settled GROUP BY ALL)),
        prev AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS pv FROM conversations),
        par AS (
            SELECT x.conv_id, x.turn, coalesce(b.pc, CASE WHEN pv IS NOT NULL THEN x.conv_id END) AS pc, coalesce(b.pt, pv) AS pt
            FROM prev x LEFT JOIN b ON b.conv_id = x.conv_id AND b.turn = x.turn AND b.r = 1),
        tree AS (
            SELECT conv_id, turn, pc, pt, conv_id AS tc, turn AS tt, 0::BIGINT AS depth FROM par WHERE pc IS NULL
            UNION ALL
            SELECT c.conv_id, c.turn, c.pc, c.pt, t.tc, t.tt, t.depth + 1 FROM par c JOIN tree t ON c.pc = t.conv_id AND c.pt = t.turn),
        o AS (
            SELECT q.conv_id, q.turn, CAST(max(q.level) AS BIGINT) AS quote_levels, count(*) FILTER (q.level > 0) AS n_quoted,
                   trim(coalesce(string_agg(q.body, chr(10) ORDER BY q.i) FILTER (NOT (q.level > 0 OR (q.below > 0 AND q.norm LIKE '%:'))), ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS own_text
            FROM q GROUP BY ALL),
        m AS (
            SELECT t.conv_id, t.turn, c.role, t.pc AS parent_conv, t.pt AS parent_turn, t.tc AS thread_conv, t.tt AS thread_turn, t.depth,
                   row_number() OVER (PARTITION BY t.tc, t.tt ORDER BY t.depth, t.conv_id, t.turn) - 1 AS place,
                   quote_levels, n_quoted, own_text
            FROM tree t JOIN o USING (conv_id, turn) JOIN conversations c USING (conv_id, turn)),
        s AS (SELECT *, place // 200 AS part FROM m),
        w AS (
            SELECT thread_conv, thread_turn, part, count(*) AS part_size,
                   sha256(string_agg(coalesce(role, '') || ':' || own_text, chr(10) ORDER BY place)) AS part_sha256
            FROM s GROUP BY ALL)
        SELECT conv_id, turn, role, parent_conv, parent_turn, thread_conv, thread_turn, depth, place, quote_levels, n_quoted,
               sha256(own_text) AS own_sha256, part, part_size, part_sha256
        FROM s JOIN w USING (thread_conv, thread_turn, part)""",
    "op11_decontamination": r"""
        WITH d AS (
            SELECT row_number() OVER () AS uid, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        g AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS s
            FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT size FROM g),
        p AS (
            SELECT uid, i, size, array_to_string(w[i:i + size - 1], ' ') AS s
            FROM d, sizes, LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS i)),
        m AS (SELECT uid, i, p.size, item_id FROM p JOIN g ON g.size = p.size AND g.s = p.s),
        h AS (
            SELECT uid, count(*) AS n_hit
            FROM (SELECT DISTINCT uid, unnest(range(i, i + size)) AS pos FROM m) GROUP BY uid),
        t AS (
            SELECT uid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT uid, item_id::VARCHAR AS item FROM m WHERE item_id IS NOT NULL) GROUP BY uid)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (uid) LEFT JOIN t USING (uid)""",
    "op12_filter_audit": r"""
        WITH d AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        l AS (
            SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
        f AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                   [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
                    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
                    regexp_matches(t, '[#$%&*|]'), coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)] AS fails
            FROM d LEFT JOIN l USING (doc_id)),
        c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
        x AS (SELECT unnest(range(1, 6)) AS k),
        o AS (
            SELECT [a.k, b.k, c.k, d.k, e.k] AS ks FROM x a, x b, x c, x d, x e
            WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
        s AS (
            SELECT part, ks, k AS step, ks[k] AS f, n, good, toxic, fails[ks[k]] AS failed,
                   len(list_filter(ks[1:k - 1], lambda j: fails[j])) > 0 AS earlier,
                   len(list_filter(fails, lambda z: z)) = 1 AS lone
            FROM c, o, x),
        r AS (
            SELECT part, ks, step, f,
                   coalesce(sum(n) FILTER (NOT failed AND NOT earlier), 0)::BIGINT AS kept,
                   coalesce(sum(n) FILTER (failed AND NOT earlier), 0)::BIGINT AS removed,
                   coalesce(sum(n) FILTER (failed AND earlier), 0)::BIGINT AS redundant,
                   coalesce(sum(n) FILTER (failed AND lone), 0)::BIGINT AS unique_fails,
                   coalesce(sum(good) FILTER (failed AND NOT earlier), 0)::BIGINT AS good_lost,
                   coalesce(sum(toxic) FILTER (failed AND NOT earlier), 0)::BIGINT AS toxic_lost
            FROM s GROUP BY part, ks, step, f)
        SELECT part, array_to_string(list_transform(ks, lambda j: substr('ABCDE', j, 1)), '') AS filter_order, step::INT AS step,
               kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
        FROM r""",
    "op13_turn_repair": r"""
        WITH RECURSIVE c AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS bytes
            FROM conversations),
        h AS (
            SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], bytes), lambda crc, b:
                       list_reduce(list_concat([xor(crc, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, i:
                           CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 20 AS k
            FROM c),
        m AS (
            SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
                   CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(CASE k WHEN 3 THEN [0, 1] ELSE [0] END) AS twin
            FROM h WHERE k <> 0),
        o AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), sha256(text)) AS i,
                   rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown,
                   CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS r FROM m),
        f AS (
            SELECT *, CASE WHEN shown = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                           WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '.' END AS fault,
                   lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair FROM o),
        a AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
                   count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
                   list(struct_pack(role := role, text := text, fine := fault NOT IN ('b', 'd'), e := CASE fault WHEN 't' THEN 1 ELSE 0 END,
                       keep := [CASE r WHEN 's' THEN 2 WHEN 'u' THEN 3 END, CASE r WHEN 'u' THEN 3 END, CASE r WHEN 'a' THEN 4 END, CASE r WHEN 'u' THEN 3 END]) ORDER BY i) AS rows
            FROM f GROUP BY conv_id),
        -- costs to go, from the last turn back; states: 1 nothing yet, 2 system, 3 user, 4 assistant last; [3, 3, 4, 3] after an insert
        v AS (
            SELECT conv_id, n AS i, [[0, 4, 2, 0]] AS costs FROM a
            UNION ALL
            SELECT v.conv_id, v.i - 1, list_concat([list_transform([1, 2, 3, 4], lambda q: least(z[q], 2 + z[[3, 3, 4, 3][q]]))], v.costs)
            FROM (SELECT v.conv_id, v.i, v.costs, list_transform([1, 2, 3, 4], lambda q: least(y[q], 2 + y[[3, 3, 4, 3][q]])) AS z
                  FROM (SELECT v.conv_id, v.i, v.costs, list_transform([1, 2, 3, 4], lambda q: least(x[q], 2 + x[[3, 3, 4, 3][q]])) AS y
                        FROM (SELECT v.conv_id, v.i, v.costs, list_transform([1, 2, 3, 4], lambda q: least(
                                  3 + v.costs[1][q], CASE WHEN t.fine THEN 2 + t.e + v.costs[1][[3, 3, 4, 3][q]] END,
                                  CASE WHEN t.fine AND t.keep[q] IS NOT NULL THEN t.e + v.costs[1][t.keep[q]] END)) AS x
                              FROM (SELECT v.*, a.rows[v.i] AS t FROM v JOIN a ON a.conv_id IS NOT DISTINCT FROM v.conv_id WHERE v.i > 0) v) v) v) v),
        w AS (
            SELECT a.conv_id, a.n, a.rows, v.costs, 0::BIGINT AS i, 1 AS q, '' AS audit, []::VARCHAR[] AS turns, 0 AS cost
            FROM a JOIN v ON v.conv_id IS NOT DISTINCT FROM a.conv_id AND v.i = 0
            UNION ALL
            SELECT conv_id, n, rows, costs, CASE l WHEN 'I' THEN i ELSE i + 1 END, CASE l WHEN 'D' THEN q WHEN 'K' THEN t.keep[q] ELSE ins END, audit || l,
                   CASE l WHEN 'D' THEN turns WHEN 'K' THEN list_append(turns, t.role || ':' || t.text)
                          ELSE list_append(turns, CASE ins WHEN 3 THEN 'user:' ELSE 'assistant:' END || CASE l WHEN 'R' THEN t.text ELSE '' END) END,
                   cost + CASE l WHEN 'D' THEN 3 WHEN 'I' THEN 2 WHEN 'R' THEN 2 + t.e ELSE t.e END
            FROM (SELECT *, [3, 3, 4, 3][q] AS ins, rows[i + 1] AS t,
                         CASE WHEN i = n THEN 'I' WHEN costs[i + 1][q] = 3 + costs[i + 2][q] THEN 'D' WHEN costs[i + 1][q] = 2 + costs[i + 1][[3, 3, 4, 3][q]] THEN 'I'
                              WHEN rows[i + 1].fine AND rows[i + 1].keep[q] IS NOT NULL AND costs[i + 1][q] = rows[i + 1].e + costs[i + 2][rows[i + 1].keep[q]] THEN 'K' ELSE 'R' END AS l
                  FROM w WHERE i < n OR q IN (2, 3)) s)
        SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(turns, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) d
        LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM d.conv_id
        LEFT JOIN (SELECT * FROM w WHERE i = n AND q IN (1, 4)) w ON w.conv_id IS NOT DISTINCT FROM d.conv_id""",
}
