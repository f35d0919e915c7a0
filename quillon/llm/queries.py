"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import byte_bpe, exact_dedup, html_text, langid, ngram_lm, packing, periods, pii, quality, simhash, toxicity, vector_codes, warc
from quillon.functions.codes import let
from quillon.llm.common import WORD, id_remainder, shared_folder, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padding")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).withColumn("p_good", F.round("p_good", 6))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, id_remainder("doc_id", 4) != 2)
    return langid.languages(docs, model).select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), id_remainder("doc_id", 5) != 0)
    return toxicity.toxicity(docs, model).select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.found_spans(docs, pii.train(docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.BASE_KINDS), F.sha2(pii.as_text(F.col("base")), 256).alias("base_sha256"), pii.as_text(F.col("spans")).alias("spans"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.coded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    n_tokens = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return coded.select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_lm.scores(table(spark, sf_dir, "documents"), id_remainder("doc_id", 10) != 0)
    return found.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid4().hex}"
    archives = warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.records(warc.read(archives, folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    books = vector_codes.trained(vectors)
    out = vector_codes.coded(vectors, books)
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def _planted(text: Column, doc_id: Column) -> Column:
    """Every tenth document by crc32 of its id gets periodic words from some place on; a null id stays as it is."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        by_number = lambda ap: F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < ap["a"], i).otherwise(ap["a"] + (i - ap["a"]) % ap["p"]))), " ")
        return F.when(n > 0, let(F.struct(a.alias("a"), p.alias("p")), by_number)).otherwise("")

    return F.when(h % 10 == 0, let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), 1), repeated)).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periods.periodic(docs.select("doc_id", _planted(F.col("text"), F.col("doc_id")).alias("text")))
    # Runs come by start, then period, so that of equal ratios the first stays; ratios are compared as products.
    higher = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.reduce("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), higher)
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.*", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_quality_rules, op3_simhash, op4_language_id, op5_toxicity, op6_html_text, op7_exact_dedup, op8_pii, op9_byte_bpe, op10_lm_score, op11_warc, op12_vector_codes, op13_periodic_runs)
}

_WORDS = r"list_filter(regexp_split_to_array({t}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
#: crc32 of an id written as text: eight shifts a character.
_CRC = "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"


#: The ratios of the quality rules in SQL.
_RATIOS = {
    "symbols": "n_symbols / n_words", "few_function_words": "1 - n_function_words / n_words", "repeats": "n_repeat_words / n_words",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)", "shouting": "n_capitals / greatest(word_chars, 1)", "word_length": "abs(word_chars / n_words - 6.0)",
}


def _quality_sql() -> str:
    names = list(quality.RULES)
    k = range(1, len(names) + 1)
    vote = lambda r, good, bad: f"CASE WHEN n_words = 0 THEN 0 WHEN {r} > {bad} THEN -1 " + (f"WHEN {r} <= {good} THEN 1 " if good is not None else "") + "ELSE 0 END"
    votes = ", ".join(f"{vote(_RATIOS[n], *quality.RULES[n][1:])} AS v{i}" for i, n in zip(k, names, strict=True))
    vs = ", ".join(f"v{i}" for i in k)
    logit = "ln(pi / (1 - pi)) + " + " + ".join(f"CASE v{i} WHEN 1 THEN ln(good[{i}] / (1 - bad[{i}])) WHEN -1 THEN ln((1 - good[{i}]) / bad[{i}]) ELSE 0 END" for i in k)
    share = lambda q, hit, i: f"least(0.99, greatest(0.5, (sum(CASE WHEN v{i} = {hit} THEN n * {q} ELSE 0 END) + 8) / (sum(CASE WHEN v{i} <> 0 THEN n * {q} ELSE 0 END) + 10)))"
    start = "[" + ", ".join("0.8::DOUBLE" for _ in k) + "]"
    stop = ", ".join(f"'{w}'" for w in quality.FUNCTION_WORDS)
    return rf"""
        WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, t, {_WORDS.format(t='t')} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
        g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS times FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
        r AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM g, range(3) o(d) WHERE times > 1 GROUP BY doc_id),
        f AS (SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
            length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_capitals, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
            len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_function_words, coalesce(r.n, 0) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
        v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {votes} FROM f),
        p AS (SELECT {vs}, count(*) AS n FROM v WHERE NOT base_failed GROUP BY ALL),
        em AS (SELECT 0 AS step, 0.8::DOUBLE AS pi, {start} AS good, {start} AS bad UNION ALL
            SELECT step + 1, least(0.98, greatest(0.02, (sum(n * q) + 8) / (sum(n) + 10))), [{', '.join(share('q', 1, i) for i in k)}], [{', '.join(share('(1 - q)', -1, i) for i in k)}]
            FROM (SELECT step, p.*, 1 / (1 + exp(-({logit}))) AS q FROM em, p WHERE step < 50) GROUP BY step),
        z AS (SELECT v.*, 1 / (1 + exp(-({logit}))) AS p_good FROM v, em WHERE step = (SELECT max(step) FROM em))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND p_good >= 0.5 AS kept, round(p_good, 6) AS p_good FROM z"""


def _codes_sql() -> str:
    """Codebooks by rounds over every part and entry in full; a quotient that goes down also for negative sums."""
    per = "len(e) // 16"
    near = "SELECT vec_id, label, part, v, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d FROM (SELECT p.*, c.entry, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts p JOIN {c} c USING (part)) GROUP BY ALL"
    move = "SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM {c} c LEFT JOIN (SELECT part, entry, list(q ORDER BY i) AS v FROM (SELECT part, entry, i, (sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS q FROM {n}, range(1, len(v) + 1) r(i) GROUP BY part, entry, i) GROUP BY part, entry) m USING (part, entry)"
    return f"""
        WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS (SELECT vec_id, label, p AS part, e[p * ({per}) + 1 : (p + 1) * ({per})] AS v FROM kept, range(16) r(p)),
        first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 64),
        c0 AS (SELECT part, entry, v FROM parts JOIN first USING (vec_id)),
        n0 AS ({near.format(c='c0')}), c1 AS ({move.format(c='c0', n='n0')}), n1 AS ({near.format(c='c1')}), c2 AS ({move.format(c='c1', n='n1')}), n2 AS ({near.format(c='c2')}),
        coded AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM n2 GROUP BY vec_id, label),
        books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded, books"""


def _periods_sql() -> str:
    """Matches of equal words at a lag, islands of them, the smallest period of each stretch."""
    return rf"""
        WITH d AS (SELECT doc_id, {_CRC} AS h, {_WORDS.format(t="coalesce(text, '')")} AS w FROM documents),
        a AS (SELECT doc_id, h, h // 10 AS g, w, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
        p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
        e AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM p),
        t AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS w FROM e),
        m AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND y.i - x.i <= x.n // 4),
        k AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m QUALIFY count(*) OVER (PARTITION BY doc_id, q) >= greatest(6, 4 * q) - q),
        s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM k GROUP BY doc_id, q, island HAVING count(*) >= greatest(6, 4 * q) - q),
        r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length),
        gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
        c AS (SELECT t.doc_id, string_agg(w, ' ' ORDER BY t.i) AS c FROM t ANTI JOIN gone USING (doc_id, i) GROUP BY t.doc_id),
        b AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs,
            list((start, length, period) ORDER BY (length::DECIMAL(38,0) * 1000000000000) // period DESC, start, period)[1] AS best FROM r GROUP BY doc_id)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best[1] AS start, best[2] AS length, best[3] AS period, 1000 * best[2] // best[3] AS exponent_milli,
            sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256 FROM d LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_K2, _K3 = ngram_lm.PRIORS

#: Base 32 of a SHA-1 in hexadecimal: bits of its digits, taken by fives.
_BASE32 = "array_to_string(list_transform(range(32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + (list_reduce(list_transform(range(5), lambda b: (instr('0123456789abcdef', h[(5 * k + b) // 4 + 1]) - 1) >> (3 - (5 * k + b) % 4)::INT & 1), lambda x, y: 2 * x + y))::INT]), '')"

ORACLE_SQL: dict[str, str] = {
    "op11_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keep FROM pages)
        SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM keep THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id IS DISTINCT FROM keep THEN keep END AS refers_to FROM p""",
    "op2_quality_rules": _quality_sql(),
    "op10_lm_score": rf"""
        WITH d AS (SELECT doc_id, {_CRC} % 10 = 0 AS held_out, {_WORDS.format(t=_LOWER)} || [chr(1)] AS w FROM documents),
        t AS (SELECT doc_id, held_out, unnest(([NULL, chr(2)] || w[:-3])[:len(w)]) AS h, unnest([chr(2)] || w[:-2]) AS u, unnest(w) AS w FROM d),
        c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
        b AS (SELECT u, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY u, w),
        g AS (SELECT h, u, w, count(*) AS c FROM t WHERE NOT held_out AND h IS NOT NULL GROUP BY h, u, w),
        hu AS (SELECT u, count(*) AS c FROM t WHERE NOT held_out GROUP BY u),
        n AS (SELECT sum(c) AS n, count(*) AS v FROM c),
        s AS (SELECT doc_id, held_out, t.h, coalesce(c.c, 0) AS c1, (coalesce(c.c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)) AS p, coalesce(b.c, 0) AS c2, coalesce(hu.c, 0) AS cu, coalesce(g.c, 0) AS c3, coalesce(hb.c, 0) AS ch, n
            FROM t CROSS JOIN n LEFT JOIN c USING (w) LEFT JOIN b ON b.u = t.u AND b.w = t.w LEFT JOIN hu ON hu.u = t.u LEFT JOIN g ON g.h = t.h AND g.u = t.u AND g.w = t.w LEFT JOIN b hb ON hb.u = t.h AND hb.w = t.u),
        q AS (SELECT *, (c2 + {_K2} * p) / (cu + {_K2}) AS p2 FROM s)
        SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (c1 > 0) AS n_known, max(n)::BIGINT AS train_tokens, round(fsum(log10(p)), 6) AS base_score,
            round(fsum(log10(CASE WHEN h IS NULL THEN p2 ELSE (c3 + {_K3} * p2) / (ch + {_K3}) END)), 6) AS score FROM q GROUP BY doc_id, held_out""",
    "op12_vector_codes": _codes_sql(),
    "op13_periodic_runs": _periods_sql(),
    "op7_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm, length(coalesce(text, '')) AS n FROM documents),
        r AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r""",
}
