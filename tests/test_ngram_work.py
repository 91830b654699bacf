"""n-gram counters come from one look at the text."""

from tallyloom.functions.tokens import Filters
from tallyloom.operators import ngram
from tallyloom.sources.tables import document_corpus, table_corpus


def test_stats_scan_once(spark, tmp_path):
    docs = [(1, "a b a b\n\nc\n\x0b é"), (2, None), (3, ""), (4, "a b xx a b")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "d"))
    for corpus in (table_corpus, document_corpus):
        df = ngram.ngram_stats(corpus(spark.read.parquet(str(tmp_path / "d")), order_col="doc_id"), 2, Filters(drop_length_min=2, drop_length_max=2))
        assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
        assert tuple(df.collect()[0]) == (10, 5, 2)
