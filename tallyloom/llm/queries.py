"""One query for each operator over its whole table, and SQL where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import exact_dedup, license_scan, media, mixing, near_dedup, pieces, preference, quality, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The tree of op1 as SQL expressions: domains are made up from the number in a source's name.
LEVELS = {"domain": "concat('d', coalesce(cast(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS int) % 3 AS string), 'x'))", "lang": "lang", "source": "source"}
WEIGHTS = [{"d0": 5, "d1": 3, "d2": 2}, {"en": 6, "fr": 2, "de": 1, "es": 1}, {}]
SHARE, EPOCHS, SEED = (3, 5), 2, 17

URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", *[F.expr(e).alias(n) for n, e in LEVELS.items()])
    return mixing.mix(docs, list(LEVELS), WEIGHTS, SHARE, EPOCHS, SEED)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.media_columns(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bit_depth", "colour_type")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(_table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def exact_dedup_two_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of even id first, then all documents against the same index."""
    docs = _table(spark, sf_dir, "documents")
    index = exact_dedup.DigestIndex(spark)
    exact_dedup.exact_duplicates(docs.filter("doc_id % 2 = 0"), index)
    found = exact_dedup.exact_duplicates(docs, index)
    index.drop()  # what is returned no longer reads it
    return found


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    def trained(mask: str):
        return F.aggregate(mask, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])

    found = preference.preferences(_table(spark, sf_dir, "conversations"))
    return found.select("chosen_id", "rejected_id", "status", F.col("n_prompt_turns").cast("bigint").alias("n_prompt_turns"),
                        *[F.sha2(c, 256).alias(c.removesuffix("_text") + "_sha256") for c in ("prompt", "chosen_text", "rejected_text")],
                        trained("chosen_mask").alias("chosen_trained"), trained("rejected_mask").alias("rejected_trained"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_near_dedup": op2_near_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_media": op4_media,
    "op5_pieces": op5_pieces,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_url_filter": op9_url_filter,
    "op10_preference": op10_preference,
    "exact_dedup_two_batches": exact_dedup_two_batches,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shared(level: str, parents: str, family: str) -> str:
    """SQL of one level of the mix: shares a family's budget; the water level is found by trying every prefix of the order."""
    on = f"PARTITION BY {parents}" if parents else ""
    return f"""(SELECT * REPLACE (CASE WHEN full_ THEN cap ELSE (weight * (budget - coalesce(sum(cap) FILTER (full_) OVER ({on}), 0))) //
                 (sum(weight) FILTER (NOT full_) OVER ({on})) END AS alloc) FROM (
             SELECT *, 0::HUGEINT AS alloc, cap * (sum(weight) OVER ({on}) - coalesce(sum(weight) OVER w, 0))
                    <= weight * (budget - coalesce(sum(cap) OVER w, 0)) AS full_
             FROM {family}
             WINDOW w AS ({on} ORDER BY cap::DOUBLE / weight::DOUBLE, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""


_MIX = f"""
    WITH d AS (
        SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               'd' || coalesce((try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 3)::VARCHAR, 'x') AS domain,
               len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens
        FROM documents),
    leaves AS (SELECT domain, lang, source, sum(tokens)::HUGEINT AS t, sum(tokens)::HUGEINT * {EPOCHS} AS c FROM d GROUP BY ALL),
    f1 AS (SELECT domain, sum(c)::HUGEINT AS cap, (CASE domain WHEN 'd0' THEN 5 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END)::HUGEINT AS weight,
                  (SELECT sum(t)::HUGEINT * {SHARE[0]} // {SHARE[1]} FROM leaves)::HUGEINT AS budget FROM leaves GROUP BY domain),
    a1 AS {_shared('domain', '', 'f1')},
    f2 AS (SELECT domain, lang, sum(c)::HUGEINT AS cap, (CASE lang WHEN 'en' THEN 6 WHEN 'fr' THEN 2 ELSE 1 END)::HUGEINT AS weight,
                  any_value(a1.alloc)::HUGEINT AS budget FROM leaves JOIN a1 USING (domain) GROUP BY domain, lang),
    a2 AS {_shared('lang', 'domain', 'f2')},
    f3 AS (SELECT domain, lang, source, c AS cap, 1::HUGEINT AS weight, a2.alloc::HUGEINT AS budget, t FROM leaves JOIN a2 USING (domain, lang)),
    a3 AS {_shared('source', 'domain, lang', 'f3')},
    plan AS (SELECT domain, lang, source, (alloc // t)::BIGINT AS whole, (alloc % t)::BIGINT AS rem FROM a3 WHERE t > 0),
    p AS (SELECT doc_id, domain, lang, source, tokens, whole, rem,
                 ('0x' || substr(md5('{SEED}:' || whole || ':' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM d JOIN plan USING (domain, lang, source))
    SELECT doc_id, domain, lang, source, tokens, unnest(range(whole)) AS epoch FROM p
    UNION ALL
    SELECT doc_id, domain, lang, source, tokens, whole FROM (
        SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id) AS upto FROM p WHERE rem > 0) WHERE upto <= rem"""


def _url_sql() -> str:
    keys = [f"s{k}" for k in range(url_filter.DEPTH)]
    parts = ", ".join(f"""CASE WHEN regexp_full_match(coalesce(seg[{k + 1}], ''), '[0-9a-f]{{8,}}') AND regexp_matches(seg[{k + 1}], '[a-f]') THEN '{{hex}}'
        ELSE regexp_replace(coalesce(seg[{k + 1}], ''), '^[0-9]+($|\\.)', '{{n}}\\1') END AS s{k}""" for k in range(url_filter.DEPTH))
    rules = sorted(URL_RULES, key=lambda r: -len(r[1]))
    fits = [(v, t, f"(host = '{t.split('/')[0]}' OR ends_with(host, '.{t.split('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}')") for v, t in rules]
    which = lambda i: "CASE " + " ".join(f"WHEN {c[2]} THEN '{c[i]}'" for c in fits) + " END"
    levels, made = "", "t"
    for k in range(url_filter.DEPTH):
        up = ", ".join(["host", *[f"g{i}" for i in range(k)]])
        levels += f"""
    b{k} AS (SELECT {up}, s{k}, sum(n) AS n, sum(l)::BIGINT AS l, sum(b)::BIGINT AS b FROM {made} WHERE s{k} <> '' GROUP BY ALL),
    o{k} AS (SELECT *, count(*) OVER w AS c, (sum(l) OVER w)::BIGINT AS tl, (sum(b) OVER w)::BIGINT AS tb FROM b{k} WINDOW w AS (PARTITION BY {up})),
    n{k} AS (SELECT {up}, s{k}, CASE WHEN NOT (n < 5 AND c > 8) AND l > 0 AND tl > l AND tb > 0 AND tl > tb
        AND tl::DOUBLE * (b * ((tl - l) - (tb - b)) - (tb - b) * (l - b))::DOUBLE * (b * ((tl - l) - (tb - b)) - (tb - b) * (l - b))::DOUBLE
            / (l::DOUBLE * (tl - l)::DOUBLE * tb::DOUBLE * (tl - tb)::DOUBLE) >= 3.84 THEN s{k} ELSE '*' END AS g{k} FROM o{k}),
    t{k} AS (SELECT x.*, coalesce(y.g{k}, '') AS g{k} FROM {made} x LEFT JOIN n{k} y USING ({up}, s{k})),"""
        made = f"t{k}"
    name = "host || " + " || ".join(f"CASE WHEN g{k} = '' THEN '' ELSE '/' || g{k} END" for k in range(url_filter.DEPTH))
    return f"""
    WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                      regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
    r AS (SELECT *, {which(1)} AS rule, {which(0)} AS said, list_filter(string_split(path, '/'), lambda s: s <> '') AS seg FROM u),
    v AS (SELECT page_id, host, path, rule, said, {parts} FROM r),
    t AS (SELECT host, {', '.join(keys)}, count(*) AS n, count(said) AS l, count(*) FILTER (said = 'block') AS b FROM v GROUP BY ALL),{levels}
    m AS (SELECT host, {', '.join(keys)}, l, b, {name} AS template FROM {made}),
    s AS (SELECT template, (sum(b) + 2.0::DOUBLE) / (sum(l) + 4.0::DOUBLE) > 0.7::DOUBLE AS bad FROM m GROUP BY template)
    SELECT page_id, host, path, rule, coalesce(said, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict, template
    FROM v JOIN m USING (host, {', '.join(keys)}) JOIN s USING (template)"""


def _turns(turns: str, low: str, high: str) -> str:
    part = f"list_slice({turns}, {low}, {high})"
    return f"array_to_string(list_transform({part}, lambda t: '<|' || t.role || '|>' || chr(10) || replace(t.text, '<|', '< |') || chr(10)), '')"


def _trained(turns: str, low: str) -> str:
    part = f"list_filter(list_slice({turns}, {low}, len({turns})), lambda t: t.role = 'assistant')"
    return f"coalesce(list_sum(list_transform({part}, lambda t: length(replace(t.text, '<|', '< |')))), 0)::BIGINT"


_PREFERENCE = f"""
    WITH t AS (SELECT DISTINCT conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
    c AS (SELECT conv_id, list({{'turn': turn, 'role': role, 'text': text}} ORDER BY turn, role, text) AS turns FROM t GROUP BY conv_id),
    k AS (SELECT *, turns[1].role || chr(31) || turns[1].text AS key, ('0x' || substr(md5(coalesce(conv_id::VARCHAR, '')), 1, 15))::BIGINT AS h,
                 coalesce(list_sum(list_transform(list_filter(turns, lambda t: t.role = 'assistant'), lambda t: length(t.text))), 0) AS pref FROM c),
    r AS (SELECT *, (row_number() OVER (PARTITION BY key ORDER BY h, conv_id) - 1) // 2 AS pair FROM k),
    s AS (SELECT *, row_number() OVER (PARTITION BY key, pair ORDER BY pref DESC, conv_id) AS side FROM r),
    p AS (SELECT a.conv_id AS chosen_id, a.turns AS a, b.conv_id AS rejected_id, b.turns AS b, b.turns IS NULL AS single FROM s a
          LEFT JOIN s b ON a.key = b.key AND a.pair = b.pair AND b.side = 2 WHERE a.side = 1),
    n AS (SELECT *, list_max(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN a[i].role = 'assistant' THEN i ELSE 0 END)) AS last,
                 list_position(list_transform(range(1, least(len(a), coalesce(len(b), 0)) + 1), lambda i: a[i].role = b[i].role AND a[i].text = b[i].text), false) AS miss FROM p),
    m AS (SELECT *, (CASE WHEN single THEN CASE WHEN last > 0 THEN last - 1 ELSE len(a) END WHEN miss > 0 THEN miss - 1 ELSE least(len(a), len(b)) END)::BIGINT AS k FROM n)
    SELECT chosen_id, rejected_id, CASE WHEN single THEN 'single' WHEN len(a) > k AND len(b) > k THEN 'pair' WHEN len(a) > k OR len(b) > k THEN 'cut' ELSE 'same' END AS status,
           k AS n_prompt_turns, sha256({_turns('a', '1', 'k')}) AS prompt_sha256, sha256({_turns('a', 'k + 1', 'len(a)')}) AS chosen_sha256,
           CASE WHEN NOT single THEN sha256({_turns('b', 'k + 1', 'len(b)')}) END AS rejected_sha256,
           {_trained('a', 'k + 1')} AS chosen_trained, CASE WHEN NOT single THEN {_trained('b', 'k + 1')} END AS rejected_trained FROM m"""


ORACLE_SQL = {
    "op1_mixing": _MIX,
    "op6_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "exact_dedup_two_batches": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) FILTER (doc_id % 2 = 0) AS early, max(doc_id) AS late, count(*) FILTER (doc_id % 2 = 0) AS m, count(*) AS n FROM d GROUP BY text_sha256)
        SELECT doc_id, coalesce(early, late) AS keep_id, CASE WHEN early IS NULL THEN n ELSE m END AS group_size, doc_id = coalesce(early, late) AS kept, text_sha256
        FROM d JOIN g USING (text_sha256)""",
    "op9_url_filter": _url_sql(),
    "op10_preference": _PREFERENCE,
}
