"""Queries for scans, projections, dedup and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.functions import text as T
from revlens.operators import quality as Q
from revlens.plans.oracle_views import WS_CLASS as WS, duck_clean, duck_strip
from revlens.plans.registry import query, r6
from revlens.sources import tables

STRIP = f"regexp_replace(coalesce(review_text, ''), '^[{WS}]+|[{WS}]+$', '', 'g')"


@query("remove_duplicates", views=("reviews",), oracle=f"""
SELECT review_id, txt AS review_text, rating, verified_purchase, helpful_votes, total_votes,
       ts_epoch, reviewer_id, product_id, lang
FROM (SELECT *, {STRIP} AS txt,
             row_number() OVER (PARTITION BY {STRIP} ORDER BY review_id) AS rn FROM reviews) t
WHERE rn = 1
""")
def q_remove_duplicates(spark, sf):
    return Q.remove_duplicates(tables.reviews(spark, sf))


@query("profile_counts", views=("reviews",), oracle="""
SELECT count(*) AS n_rows,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT review_text FROM reviews) d) AS n_duplicates
FROM reviews
""")
def q_profile_counts(spark, sf):
    return Q.profile_counts(tables.reviews(spark, sf))


@query("missing_by_column", views=("reviews",), oracle="""
SELECT * FROM (
  SELECT count(*) FILTER (WHERE review_id IS NULL) AS review_id,
         count(*) FILTER (WHERE review_text IS NULL) AS review_text,
         count(*) FILTER (WHERE rating IS NULL) AS rating,
         count(*) FILTER (WHERE verified_purchase IS NULL) AS verified_purchase,
         count(*) FILTER (WHERE helpful_votes IS NULL OR isnan(helpful_votes)) AS helpful_votes,
         count(*) FILTER (WHERE total_votes IS NULL OR isnan(total_votes)) AS total_votes,
         count(*) FILTER (WHERE ts_epoch IS NULL) AS ts_epoch,
         count(*) FILTER (WHERE reviewer_id IS NULL) AS reviewer_id,
         count(*) FILTER (WHERE product_id IS NULL) AS product_id,
         count(*) FILTER (WHERE lang IS NULL) AS lang
  FROM reviews) t
UNPIVOT (n_missing FOR "column" IN (review_id, review_text, rating, verified_purchase, helpful_votes,
         total_votes, ts_epoch, reviewer_id, product_id, lang))
""")
def q_missing_by_column(spark, sf):
    return Q.missing_by_column(tables.reviews(spark, sf))


@query("rating_outliers", views=("reviews",), oracle="""
SELECT count(*) FILTER (WHERE TRY_CAST(trim(rating) AS DOUBLE) < 1 OR TRY_CAST(trim(rating) AS DOUBLE) > 5)
       AS rating_outliers FROM reviews
""")
def q_rating_outliers(spark, sf):
    return Q.rating_outliers(tables.reviews(spark, sf))


@query("text_length_outliers", views=("reviews",), oracle="""
WITH l AS (SELECT CAST(length(coalesce(review_text, '')) AS BIGINT) AS len FROM reviews),
c AS (SELECT coalesce(quantile_cont(len, 0.01) FILTER (WHERE len > 0), 0) AS lo,
             coalesce(quantile_cont(len, 0.99), 0) AS hi FROM l)
SELECT count(*) FILTER (WHERE len < lo OR len > hi) AS text_length_outliers FROM l, c
""")
def q_text_length_outliers(spark, sf):
    return Q.text_length_outliers(tables.reviews(spark, sf))


@query("rating_histogram", views=("reviews",), oracle="""
SELECT rating, count(*) AS n FROM reviews WHERE rating IS NOT NULL GROUP BY rating
""")
def q_rating_histogram(spark, sf):
    r = tables.reviews(spark, sf)
    return r.where(F.col("rating").isNotNull()).groupBy("rating").agg(F.count(F.lit(1)).alias("n")).orderBy("rating")


@query("basic_clean", views=("reviews",), oracle=f"""
SELECT 'review' AS src, review_id AS id, {duck_clean('review_text')} AS clean_text FROM reviews
UNION ALL
SELECT 'page' AS src, page_id AS id, {duck_clean('html')} AS clean_text FROM pages
""")
def q_basic_clean(spark, sf):
    r = tables.reviews(spark, sf).select(F.lit("review").alias("src"), F.col("review_id").alias("id"),
                                        T.basic_clean("review_text").alias("clean_text"))
    p = tables.pages(spark, sf).select(F.lit("page").alias("src"), F.col("page_id").alias("id"),
                                       T.basic_clean("html").alias("clean_text"))
    return r.unionByName(p)
