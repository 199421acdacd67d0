"""Query expansion by the fixed dictionaries: synonyms, related terms, questions of a kind, and all of them.

Every variant list begins with the query itself, has no variant twice and at most ``most`` beside the query.  A query that is
blank or shorter than ``SHORT`` stays alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.answers import RELATED, SYNONYMS, keywords

MOST, SHORT = 3, 3
#: Words by which the kind of a question is told, in this order, and what is put before it.
KINDS = {
    "what": ["چیست", "چیه", "چی", "تعریف", "معنی", "مفهوم"],
    "how": ["چطور", "چگونه", "نحوه", "روش", "راه‌حل"],
    "why": ["چرا", "دلیل", "علت"],
    "where": ["کجا", "کجاست", "مکان", "موقعیت"],
    "when": ["کی", "چه وقت", "زمان"],
}
BEFORE = {
    "what": ["تعریف", "معنی", "مفهوم"],
    "how": ["روش", "نحوه", "راه‌حل"],
    "why": ["دلیل", "علت", "چرا"],
    "where": ["مکان", "موقعیت", "کجا"],
    "when": ["زمان", "چه وقت", "کی"],
    "general": ["چیست", "چطور", "چرا"],
}


def _guarded(query: Column, variants: Column, most: int) -> Column:
    every = F.slice(F.array_distinct(F.concat(F.array(query), variants)), 1, most + 1)
    return F.when(F.length(F.trim(query)) < SHORT, F.array(query)).otherwise(every)


def synonyms(query: Column, most: int = MOST) -> Column:
    """For each head that stands in the query, in order of the dictionary, the query with all its places replaced."""
    made = [F.when(F.contains(query, F.lit(h)) & (F.lit(h) != F.lit(t)), F.replace(query, F.lit(h), F.lit(t))) for h, terms in SYNONYMS.items() for t in terms]
    return _guarded(query, F.slice(F.array_compact(F.array(*made)), 1, most), most)


def related(query: Column, most: int = MOST) -> Column:
    """The related terms of the query's keywords, in their order; each takes the first place of the first keyword."""
    own = keywords(query)
    terms = F.flatten(F.transform(own, lambda w: F.coalesce(reduce(lambda out, h: out.when(w == h, F.array(*map(F.lit, RELATED[h]))), list(RELATED)[1:], F.when(w == next(iter(RELATED)), F.array(*map(F.lit, next(iter(RELATED.values())))))), F.array().cast("array<string>"))))
    terms = F.slice(F.array_distinct(terms), 1, most)
    first = F.get(own, F.lit(0))
    # By call_function, as the place and the pieces follow from columns.
    at = F.call_function("locate", first, query)
    head, tail = F.call_function("substring", query, F.lit(1), at - 1), F.call_function("substring", query, at + F.length(first))
    made = F.transform(terms, lambda t: F.concat(head, t, tail))
    return _guarded(query, F.when(F.size(own) > 0, made).otherwise(F.array().cast("array<string>")), most)


def kind(query: Column) -> Column:
    """The first kind of which a word stands in the query, else general."""
    low, out = F.lower(query), F.lit("general")
    for name, heads in reversed(KINDS.items()):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(h)) for h in heads]), name).otherwise(out)
    return out


def in_context(query: Column, most: int = MOST) -> Column:
    """The query behind the words of its kind."""
    made = F.array(*[F.concat(F.lit(f"{p} "), query) for p in BEFORE["general"]])
    for name, words in BEFORE.items():
        made = F.when(kind(query) == name, F.array(*[F.concat(F.lit(f"{p} "), query) for p in words])).otherwise(made)
    return _guarded(query, F.slice(made, 1, most), most)


def hybrid(query: Column, most: int = MOST) -> Column:
    return _guarded(query, F.concat(synonyms(query, most), related(query, most), in_context(query, most)), most)


def expand(query: Column, how: Column) -> Column:
    """By the name of a way; an unknown one leaves the query alone."""
    return F.when(how == "synonyms", synonyms(query)).when(how == "related", related(query)).when(how == "context", in_context(query)).when(how == "hybrid", hybrid(query)).otherwise(F.array(query))


def evaluated(before: DataFrame, after: DataFrame, relevant: DataFrame, query: str, item: str) -> DataFrame:
    """What expansion did to each query's ranked results (query, item, rank): recall among five, reciprocal rank of the
    first hit and discounted gain among ten, before and after, their differences, and the recall's relative gain."""
    size = relevant.groupBy(query).agg(F.count(F.lit(1)).alias("_n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("_n"), F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))

    def told(results: DataFrame, name: str) -> DataFrame:
        hit = results.join(relevant.select(query, item, F.lit(1).alias("_hit")), [query, item])
        by = hit.groupBy(query).agg(F.sum((F.col("rank") <= 5).cast("int")).alias("_five"), F.min("rank").alias("_first"), F.sum(F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1.0))).alias("_gain"))
        held = size.join(by, query, "left").withColumn("_ideal", ideal)
        of = lambda c: F.coalesce(c, F.lit(0.0))
        return held.select(query, of(F.col("_five") / F.col("_n")).alias(f"{name}_recall_5"), of(1 / F.col("_first")).alias(f"{name}_mrr"), of(F.col("_gain") / F.col("_ideal")).alias(f"{name}_ndcg_10"))

    both = told(before, "original").join(told(after, "expanded"), query)
    delta = lambda m: F.col(f"expanded_{m}") - F.col(f"original_{m}")
    ratio = F.when(F.col("original_recall_5") > 0, delta("recall_5") / F.col("original_recall_5")).otherwise(0.0)
    return both.withColumns({"recall_delta": delta("recall_5"), "mrr_improvement": delta("mrr"), "ndcg_improvement": delta("ndcg_10"), "improvement_ratio": ratio})


def ranked_results(scored: DataFrame, query: str, item: str, score: str, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), item))
    return scored.withColumn("rank", place).filter(F.col("rank") <= k).select(query, item, "rank")
