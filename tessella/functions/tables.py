"""Table functions for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    """``postings(text)``: term and tf, a row for each distinct token; ``positions(text)``: term and nth (from 0), a row for each
    token. No rows of null. They are SQL functions, which Spark folds into the plan that calls them (``FROM t, LATERAL postings(text)``)."""
    tokens = "regexp_extract_all(lower(text), '[a-z0-9]+', 0)"
    # runs of equal tokens in their order, so that no rows have to meet: a GROUP BY would be pulled out of the row and joined
    starts = "filter(transform(s, (x, i) -> i), i -> NOT (get(s, i - 1) <=> s[i]))"
    runs = f"transform(array(array_sort({tokens})), s -> transform(array({starts}), b -> transform(b, (p, j) -> named_struct('term', s[p], 'tf', CAST(coalesce(get(b, j + 1), size(s)) - p AS BIGINT))))[0])[0]"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION positions(text STRING) RETURNS TABLE (term STRING, nth INT) RETURN SELECT t.col, t.pos FROM posexplode({tokens}) AS t(pos, col)")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION postings(text STRING) RETURNS TABLE (term STRING, tf BIGINT) RETURN SELECT t.term, t.tf FROM inline({runs}) AS t(term, tf)")
