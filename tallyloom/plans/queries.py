"""Queries over the harness tables, one or more for each operator, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.markup import html_text
from tallyloom.functions.spill import written
from tallyloom.functions.tokens import Filters
from tallyloom.operators import distinct, frequency, fuzzy, lookup, ngram, setops
from tallyloom.operators.components import connected_components
from tallyloom.operators.tokens import tokens
from tallyloom.plans.sampling import workload
from tallyloom.sources.tables import document_corpus, spread, table_corpus

SHORT = Filters(drop_length_min=1, drop_length_max=3)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str, where: str | None = None) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return document_corpus(spread((docs.filter(where) if where else docs).select("doc_id", "text")), order_col="doc_id")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line: n-grams end there, and short arrays are built faster than those of whole texts."""
    return table_corpus(spread(_read(spark, sf_dir, "documents").select("doc_id", "text")), order_col="doc_id")


def _bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_corpus(_read(spark, sf_dir, "benchmark"), order_col="item_id", file_idx=1)


def _by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source plays a file; its number is that in its name."""
    idx = F.expr("cast(regexp_extract(source, '([0-9]+)$', 1) AS bigint)")
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", idx.alias("file"))
    return document_corpus(spread(docs), order_col="doc_id", file_idx=F.col("file"))


def _ranked(ordered: DataFrame, first: str = "first") -> DataFrame:
    """A first-seen table with the place of the first occurrence spelled out, so that order shows in unordered rows."""
    return ordered.select("token", distinct.part_of(F.col(first)).alias("part"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary of a fixed size: the words of part names and nation names."""
    part = document_corpus(_read(spark, sf_dir, "part"), "p_name", "p_partkey")
    nation = document_corpus(_read(spark, sf_dir, "nation"), "n_name", "n_nationkey", 1)
    return tokens(part.unionByName(nation)).distinct()


def token_frequency_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.token_frequency(_docs(spark, sf_dir), top_n=100)


def token_frequency_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.token_frequency(_docs(spark, sf_dir))


def token_frequency_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.token_frequency(_docs(spark, sf_dir), SHORT)


def frequency_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.frequency_totals(_docs(spark, sf_dir))


def dedupe_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(distinct.first_seen(_docs(spark, sf_dir)).orderBy("first"))


def dedupe_alphabetical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct.distinct_tokens(_docs(spark, sf_dir), ordering=distinct.ALPHABETICAL)


def dedupe_unordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct.distinct_tokens(_docs(spark, sf_dir), ordering=distinct.UNORDERED)


def dedupe_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct.distinct_tokens(_docs(spark, sf_dir), ordering=distinct.ALPHABETICAL, buckets=256)


def dedupe_length_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct.distinct_tokens(_docs(spark, sf_dir), SHORT, distinct.UNORDERED)


def dedupe_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct.dedupe_stats(_docs(spark, sf_dir), SHORT)


def per_file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct.file_stats(_by_source(spark, sf_dir), SHORT)


def set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setops.set_op(_docs(spark, sf_dir, "lang = 'en'"), _docs(spark, sf_dir, "lang <> 'en'"), setops.DIFF, ordering=distinct.UNORDERED)


def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setops.set_op(_docs(spark, sf_dir), _bench(spark, sf_dir), setops.INTERSECT)


def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setops.set_op(_docs(spark, sf_dir), _bench(spark, sf_dir), setops.UNION, ordering=distinct.ALPHABETICAL)


def set_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [setops.set_stats(_docs(spark, sf_dir), _bench(spark, sf_dir), op).withColumn("op", F.lit(op)) for op in (setops.DIFF, setops.INTERSECT, setops.UNION)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def ngram_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.distinct_ngrams(_lines(spark, sf_dir), 2, ordering=distinct.ALPHABETICAL)


def ngram_fivegrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.distinct_ngrams(_lines(spark, sf_dir), 5, ordering="unordered")


def ngram_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.distinct_ngrams(_lines(spark, sf_dir), 3, Filters(drop_length_min=2, drop_length_max=2), "unordered")


def ngram_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.ngram_stats(_lines(spark, sf_dir), 3)


def html_text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(_read(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", html_text(F.col("html")).alias("text"))
    return frequency.token_frequency(document_corpus(pages, order_col="page_id"))


def word_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = tokens(document_corpus(spread(_read(spark, sf_dir, "conversations").select("conv_id", "text")), order_col="conv_id")).distinct().withColumnRenamed("token", "word")
    return lookup.check_words(asked, _bench(spark, sf_dir))


def fuzzy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.fuzzy_pairs(_names(spark, sf_dir), 2)


def fuzzy_pairs_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.fuzzy_pairs(_names(spark, sf_dir), 4)


def fuzzy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.fuzzy_clusters(_names(spark, sf_dir), 3)


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct tokens of all documents; written, as the edit-distance plans read them more than once."""
    return written(tokens(_docs(spark, sf_dir)).distinct(), "vocabulary")


def fuzzy_pairs_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.fuzzy_pairs(_vocabulary(spark, sf_dir), 2)


def fuzzy_pairs_far_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.fuzzy_pairs(_vocabulary(spark, sf_dir), 4)


def fuzzy_clusters_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.fuzzy_clusters(_vocabulary(spark, sf_dir), 3)


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_custkey") + F.col("o_orderkey") % 3).alias("dst"))
    return connected_components(edges)


def sample_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload(_docs(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    token_frequency_top, token_frequency_all, token_frequency_filtered, frequency_totals, dedupe_first_seen, dedupe_alphabetical, dedupe_unordered,
    dedupe_bucketed, dedupe_length_filtered, dedupe_stats, per_file_stats, set_diff, set_intersect, set_union, set_stats, ngram_bigrams, ngram_fivegrams,
    ngram_filtered, ngram_stats, html_text_tokens, word_check, fuzzy_pairs, fuzzy_pairs_far, fuzzy_clusters, components, sample_workload)}

#: Over the tokens of whole corpora, where SQL would compare every token with every other: tests hold these against brute force.
WITHOUT_SQL = {f.__name__: f for f in (fuzzy_pairs_documents, fuzzy_pairs_far_documents, fuzzy_clusters_documents)}

_UNICODE = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _line_sql(table: str, key: str, text: str = "text", more: str = "") -> str:
    """(key, line_no, line, more...) of a table's texts."""
    return f"""SELECT {key} AS part, {more} unnest(range(len(l))) AS line_no, unnest(l) AS line
        FROM (SELECT *, string_split(regexp_replace({text}, '\\n$', ''), chr(10)) AS l FROM {table} WHERE {text} IS NOT NULL)"""


def _split_sql(line: str = "line") -> str:
    """The raw tokens of a line as a list."""
    return f"""list_filter(CASE WHEN regexp_full_match({line}, '[\\x00-\\x7F]*') THEN string_split_regex({line}, '[ \\t\\n\\f\\r,;]+')
        ELSE string_split_regex({line}, '[{_UNICODE},;]+') END, lambda t: t <> '')"""


def _clean_sql(line: str = "line") -> str:
    return f"list_filter(list_transform({_split_sql(line)}, lambda t: regexp_replace(t, '^[{_UNICODE}]+|[{_UNICODE}]+$', '', 'g')), lambda t: t <> '')"


def _token_sql(lines: str) -> str:
    """CTEs: l lines, t tokens (part, line_no, pos, token, any more columns of l)."""
    return f"l AS ({lines}), c AS (SELECT *, {_clean_sql()} AS toks FROM l), t AS (SELECT * EXCLUDE (line, toks), unnest(range(len(toks))) AS pos, unnest(toks) AS token FROM c)"


_DOCS = _token_sql(_line_sql("documents", "doc_id"))
_BENCH = f"bl AS ({_line_sql('benchmark', 'item_id')}), b AS (SELECT DISTINCT unnest({_clean_sql()}) AS token FROM bl)"
_NAMES = f"""w AS (SELECT DISTINCT unnest({_clean_sql('line')}) AS token FROM (SELECT p_name AS line FROM part UNION ALL SELECT n_name FROM nation))"""
_KEEP = "NOT length(token) BETWEEN 1 AND 3"


def _gram_sql(n: int, drop: str = "false") -> str:
    return f"""WITH l AS ({_line_sql('documents', 'doc_id')}), c AS (SELECT part, line_no, {_clean_sql()} AS toks FROM l),
        g AS (SELECT unnest(list_filter(list_transform(range(1, len(toks) - {n} + 2), lambda i: CASE WHEN len(list_filter(toks[i:i + {n - 1}], lambda t: {drop})) = 0
              THEN array_to_string(toks[i:i + {n - 1}], ' ') END), lambda x: x IS NOT NULL)) AS ngram FROM c)"""


def _pairs_sql(k: int) -> str:
    return f"SELECT a.token AS token, b.token AS other, levenshtein(a.token, b.token)::INT AS distance FROM w a JOIN w b ON a.token < b.token AND levenshtein(a.token, b.token) <= {k}"


def _reach_sql(edges: str) -> str:
    """CTE reach: (node, low) for each node and every node that it reaches. edges: SELECT of (u, v), both directions."""
    return f"e AS ({edges}), reach(node, low) AS (SELECT u, u FROM e UNION SELECT v, low FROM reach JOIN e ON e.u = reach.node)"


_STATS = f"""(SELECT sum(len({_split_sql()}))::BIGINT FROM l) AS tokens_seen"""

ORACLE_SQL = {
    "token_frequency_top": f"WITH {_DOCS} SELECT token, count(*) AS count FROM t GROUP BY token ORDER BY count DESC, token LIMIT 100",
    "token_frequency_all": f"WITH {_DOCS} SELECT token, count(*) AS count FROM t GROUP BY token",
    "token_frequency_filtered": f"WITH {_DOCS} SELECT token, count(*) AS count FROM t WHERE {_KEEP} GROUP BY token",
    "frequency_totals": f"WITH {_DOCS} SELECT count(DISTINCT token) AS unique_tokens, count(*) AS tokens_seen FROM t",
    "dedupe_first_seen": f"WITH {_DOCS} SELECT token, min(part) AS part FROM t GROUP BY token",
    "dedupe_alphabetical": f"WITH {_DOCS} SELECT DISTINCT token FROM t ORDER BY token",
    "dedupe_unordered": f"WITH {_DOCS} SELECT DISTINCT token FROM t",
    "dedupe_bucketed": f"WITH {_DOCS} SELECT DISTINCT token FROM t",
    "dedupe_length_filtered": f"WITH {_DOCS} SELECT DISTINCT token FROM t WHERE {_KEEP}",
    "dedupe_stats": f"""WITH {_DOCS} SELECT 1::BIGINT AS files, {_STATS}, count(DISTINCT token) FILTER ({_KEEP}) AS unique_tokens,
        count(*) FILTER ({_KEEP}) - count(DISTINCT token) FILTER ({_KEEP}) AS duplicates, count(*) FILTER (NOT {_KEEP}) AS filtered_by_length FROM t""",
    "per_file_stats": f"""WITH {_token_sql(_line_sql('documents', 'doc_id', more="regexp_extract(source, '([0-9]+)$', 1)::BIGINT AS file_idx,"))},
        n AS (SELECT file_idx, count(*) AS unique_new FROM (SELECT token, min(file_idx) AS file_idx FROM t WHERE {_KEEP} GROUP BY token) GROUP BY file_idx),
        s AS (SELECT file_idx, count(*) AS tokens_seen, count(*) FILTER ({_KEEP}) AS kept, count(*) FILTER (NOT {_KEEP}) AS filtered_by_length FROM t GROUP BY file_idx)
        SELECT file_idx, tokens_seen, kept - coalesce(unique_new, 0) AS duplicates, coalesce(unique_new, 0) AS unique_new, filtered_by_length FROM s LEFT JOIN n USING (file_idx)""",
    "set_diff": f"""WITH {_token_sql(_line_sql('documents', 'doc_id', more='lang,'))}
        SELECT token FROM t WHERE lang = 'en' EXCEPT SELECT token FROM t WHERE lang <> 'en'""",
    "set_intersect": f"WITH {_DOCS}, {_BENCH} SELECT token FROM t INTERSECT SELECT token FROM b",
    "set_union": f"WITH {_DOCS}, {_BENCH} SELECT token FROM t UNION SELECT token FROM b",
    "set_stats": f"""WITH {_DOCS}, {_BENCH}, bt AS (SELECT unnest({_clean_sql()}) AS token FROM bl),
        n AS (SELECT (SELECT count(*) FROM t) + (SELECT count(*) FROM bt) AS seen, (SELECT count(DISTINCT token) FROM t) AS dl, (SELECT count(*) FROM b) AS dr,
              (SELECT count(*) FROM (SELECT token FROM t INTERSECT SELECT token FROM b)) AS common)
        SELECT 2::BIGINT AS files, seen AS tokens_seen, dl - common AS unique_tokens, seen - dl - dr AS duplicates, 0::BIGINT AS filtered_by_length, 'diff' AS op FROM n
        UNION ALL SELECT 2, seen, common, seen - dl - dr, 0, 'intersect' FROM n UNION ALL SELECT 2, seen, dl + dr - common, seen - (dl + dr - common), 0, 'union' FROM n""",
    "ngram_bigrams": f"{_gram_sql(2)} SELECT DISTINCT ngram FROM g",
    "ngram_fivegrams": f"{_gram_sql(5)} SELECT DISTINCT ngram FROM g",
    "ngram_filtered": f"{_gram_sql(3, 'length(t) BETWEEN 2 AND 2')} SELECT DISTINCT ngram FROM g",
    "ngram_stats": f"{_gram_sql(3)} SELECT (SELECT sum(len(toks))::BIGINT FROM c) AS tokens_seen, count(*) AS ngrams_seen, count(DISTINCT ngram) AS unique_ngrams FROM g",
    "html_text_tokens": f"""WITH p AS (SELECT page_id, replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '<[^>]*$', ''), '>', ' ') AS h FROM pages),
        r AS (SELECT page_id, replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&') AS text FROM p),
        {_token_sql(_line_sql('r', 'page_id'))} SELECT token, count(*) AS count FROM t GROUP BY token""",
    "word_check": f"""WITH {_token_sql(_line_sql('conversations', 'conv_id'))}, {_BENCH}
        SELECT token AS word, token IN (SELECT token FROM b) AS found FROM (SELECT DISTINCT token FROM t)""",
    "fuzzy_pairs": f"WITH {_NAMES} {_pairs_sql(2)}",
    "fuzzy_pairs_far": f"WITH {_NAMES} {_pairs_sql(4)}",
    "fuzzy_clusters": f"""WITH RECURSIVE {_NAMES}, p AS ({_pairs_sql(3)}), {_reach_sql('SELECT token AS u, other AS v FROM p UNION ALL SELECT other, token FROM p UNION ALL SELECT token, token FROM w')}
        SELECT node AS token, min(low) AS representative FROM reach GROUP BY node""",
    "components": f"""WITH RECURSIVE {_reach_sql('SELECT o_custkey AS u, o_custkey + o_orderkey % 3 AS v FROM orders UNION SELECT o_custkey + o_orderkey % 3, o_custkey FROM orders')}
        SELECT node, min(low) AS component FROM reach GROUP BY node""",
    "sample_workload": f"""WITH {_DOCS} SELECT count(*) AS sample_tokens, count(DISTINCT token) AS sample_unique, count(*) - count(DISTINCT token) AS sample_duplicates,
        sum(strlen(token))::BIGINT::DOUBLE / count(*) AS avg_bytes, (count(*) - count(DISTINCT token))::DOUBLE / count(*) AS duplicate_ratio, count(DISTINCT token)::DOUBLE / count(*) AS unique_ratio FROM t""",
}
