"""Queries of the training-data problems 2, 4, 5, 7, 8 and 9, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import cooccur, encode, leak, seen, setsim, stuffing, users
from lodestrata.sources.tables import table


def _together(spark: SparkSession, folder: str) -> DataFrame:
    docs = users.current_users(table(spark, folder, "user_doc"), ("following",))
    return cooccur.together(docs, "following", min_count=8, min_lift="3.0")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of ids followed together at least 8 times and 3 times as often as by chance."""
    return _together(spark, folder).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))


def p2_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The same pairs with their counts, lift and conviction."""
    got = _together(spark, folder)
    return got.select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), "n_ab", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"), F.round("conviction", 6).alias("conviction"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose key was there before."""
    return seen.seen_before(table(spark, folder, "entry_log"), key="key", order="arrival_no")


def p4_error_rate(spark: SparkSession, folder: str) -> DataFrame:
    """How often the filters answered wrongly."""
    return seen.error_rate(table(spark, folder, "entry_log"), key="key", order="arrival_no")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of users with nearly the same followers or the same followed users."""
    docs = users.current_users(table(spark, folder, "user_doc"), ("follower", "following"))
    return setsim.similar_pairs(docs, id="id", fields=("follower", "following"), threshold=0.7, least=4)


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every page."""
    return encode.encode(table(spark, folder, "documents"), id="doc_id", text="text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item."""
    docs, items = table(spark, folder, "documents"), table(spark, folder, "eval_item")
    return leak.leaks(docs, items, doc="doc_id", item="item_id", text="text")


def p8_reparameterised(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold an item's passage with other numbers, names or units."""
    docs, items = table(spark, folder, "documents"), table(spark, folder, "eval_item")
    return leak.reparameterised(docs, items, doc="doc_id", item="item_id", text="text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of keywords, links, products or tags in place of sentences."""
    return stuffing.stuffed_pages(table(spark, folder, "documents"), id="doc_id", text="text", lang="lang", host="source")


def p9_words(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each page, those in sentences and those in repetition."""
    return stuffing.page_words(table(spark, folder, "documents"), id="doc_id", text="text", lang="lang", host="source")


QUERIES = {
    "p2_found": p2_found, "p2_scores": p2_scores, "p4_found": p4_found, "p4_error_rate": p4_error_rate, "p5_found": p5_found,
    "p7_ids": p7_ids, "p8_found": p8_found, "p8_reparameterised": p8_reparameterised,
    "p9_found": p9_found, "p9_words": p9_words,
}

_USERS = """
    docs as (
      select trim(id) as id, follower, following from (
        select *, row_number() over (partition by trim(id) order by seq desc) as rn
        from user_doc where trim(id) <> '' and seq is not null) where rn = 1)"""

_PAIRS = f"""
    with {_USERS},
    f as (select distinct id, trim(u) as item from (select id, unnest(following) as u from docs) where trim(u) <> ''),
    n as (select count(distinct id) as n from f),
    c as (select item, count(*) as n_item from f group by 1),
    p as (select x.item as id_a, y.item as id_b, count(*) as n_ab
          from f x join f y on x.id = y.id and x.item < y.item group by 1, 2 having count(*) >= 8)
    select id_a, id_b, n_ab, a.n_item as n_a, b.n_item as n_b, n.n,
           round(n_ab::double * n.n / (a.n_item::double * b.n_item), 6) as lift,
           case when n_ab < a.n_item then round((1 - b.n_item::double / n.n) / (1 - n_ab::double / a.n_item), 6) end as conviction
    from p join c a on a.item = id_a join c b on b.item = id_b cross join n
    where n_ab * n.n >= 3.0 * a.n_item * b.n_item"""

SQL = {
    "p2_found": f"select id_a, id_b from ({_PAIRS})",
    "p2_scores": _PAIRS,
    "p4_found": """
        select e.arrival_no from entry_log e
        join (select key, min(arrival_no) as first from entry_log where octet_length(key) > 0 group by 1) k on k.key = e.key
        where e.arrival_no > k.first""",
    "p5_found": f"""
        with {_USERS},
        e as (select distinct 'follower' as field, id, trim(u) as x from (select id, unnest(follower) as u from docs) where trim(u) <> ''
              union all
              select distinct 'following', id, trim(u) from (select id, unnest(following) as u from docs) where trim(u) <> ''),
        n as (select field, id, count(*) as n from e group by 1, 2 having count(*) >= 4),
        c as (select a.field, a.id as id_a, b.id as id_b, count(*) as n_ab
              from e a join e b on a.field = b.field and a.x = b.x and a.id < b.id group by 1, 2, 3)
        select c.field, id_a, id_b from c
        join n na on na.field = c.field and na.id = id_a join n nb on nb.field = c.field and nb.id = id_b
        where n_ab >= 0.7 * (na.n + nb.n - n_ab)""",
}
