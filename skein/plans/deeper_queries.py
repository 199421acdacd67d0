"""Expansion by the dictionaries and what it brings, topics, gaps, predictions, trends, health, search by text, text files."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators import answers as A
from skein.operators import chunkers as C
from skein.operators import expansion as EX
from skein.operators import folds
from skein.operators import retrieval as R
from skein.operators import scans as SC
from skein.operators import spans as SP
from skein.operators import vectors as V
from skein.operators.store import settled, shared_folder
from skein.plans.registry import query, table
from skein.sources import texts as TX

_Q = lambda s: "'" + s.replace("'", "''") + "'"

# --- expansion over what users of `conversations` say, each behind a word of the dictionaries -------------------------

WORDS = [*A.SYNONYMS, *[h for h in A.RELATED if h not in A.SYNONYMS], "xx"]
_ASKED = f"SELECT conv_id, turn, CASE WHEN (conv_id + turn) % {len(WORDS) + 1} = {len(WORDS)} THEN '  ?' ELSE [{', '.join(map(_Q, WORDS))}][(conv_id + turn) % {len(WORDS) + 1} + 1] || ' ' || text END AS q FROM conversations WHERE role = 'user'"


def asked(spark, d) -> DataFrame:
    k = ((F.col("conv_id") + F.col("turn")) % (len(WORDS) + 1)).cast("int")
    q = F.when(k == len(WORDS), "  ?").otherwise(F.concat(F.get(F.array(*map(F.lit, WORDS)), k), F.lit(" "), F.col("text")))
    return table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", q.alias("q"))


_ONCE = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_SYN = "list_filter([" + ", ".join(f"CASE WHEN contains(q, {_Q(h)}) THEN replace(q, {_Q(h)}, {_Q(t)}) END" for h, ts in A.SYNONYMS.items() for t in ts if t != h) + f"], lambda x: x IS NOT NULL)[1:{EX.MOST}]"
_KEYS = f"list_filter(list_filter(string_split_regex(q, '\\s+'), lambda x: x <> ''), lambda w: w NOT IN ({', '.join(map(_Q, A.STOP))}) AND length(w) > 1)"
_TERMS = "flatten(list_transform(ks, lambda w: CASE w " + " ".join(f"WHEN {_Q(h)} THEN [{', '.join(map(_Q, ts))}]" for h, ts in A.RELATED.items()) + " ELSE []::VARCHAR[] END))"
_KIND = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(q), {_Q(w)})" for w in ws) + f" THEN '{k}'" for k, ws in EX.KINDS.items()) + " ELSE 'general' END"
_CONTEXT = "CASE kind " + " ".join(f"WHEN '{k}' THEN [{', '.join(f'{_Q(w)} || chr(32) || q' for w in ws)}]" for k, ws in EX.BEFORE.items()) + " END"
_EXPANDED = f"""
a AS (SELECT *, {_KEYS} AS ks, {_KIND} AS kind, {_SYN} AS syn FROM ({_ASKED})),
b AS (SELECT *, {_TERMS} AS raw FROM a), c AS (SELECT *, {_ONCE.format('raw')}[1:{EX.MOST}] AS terms FROM b),
e AS (SELECT *, list_transform(terms, lambda t: substr(q, 1, instr(q, ks[1]) - 1) || t || substr(q, instr(q, ks[1]) + length(ks[1]))) AS rel, {_CONTEXT} AS con FROM c),
s AS (SELECT *, list_concat([q], syn) AS s1, list_concat([q], rel) AS r1, list_concat([q], con) AS c1 FROM e),
u AS (SELECT *, {_ONCE.format('s1')}[1:{EX.MOST + 1}] AS s2, {_ONCE.format('r1')}[1:{EX.MOST + 1}] AS r2, {_ONCE.format('c1')}[1:{EX.MOST + 1}] AS c2 FROM s), h AS (SELECT *, list_concat(s2, r2, c2) AS h1 FROM u),
x AS (SELECT conv_id, turn, q, length(trim(q)) < {EX.SHORT} AS short, s2, r2, c2, {_ONCE.format('h1')}[1:{EX.MOST + 1}] AS h2 FROM h)"""


def _ways(name: str, how: str, sql: str) -> None:
    @query(name, f"WITH {_EXPANDED} SELECT conv_id, turn, unnest(range(0, len(v))) AS position, md5(unnest(v)) AS variant FROM (SELECT conv_id, turn, CASE WHEN short THEN [q] ELSE {sql} END AS v FROM x)")
    def run(spark, d):
        return asked(spark, d).select("conv_id", "turn", F.posexplode(EX.expand(F.col("q"), F.lit(how))).alias("position", "variant")).withColumn("variant", F.md5("variant"))


_ways("exp01_05_dictionary_synonyms", "synonyms", "s2")
_ways("exp02_related_terms", "related", "r2")
_ways("exp03_dictionary_context", "context", "c2")
_ways("exp04_08_dictionary_hybrid", "hybrid", "h2")
_ways("exp08_unknown_way", "none such", "[q]")


@query("exp06_stop_list_keywords", f"SELECT conv_id, turn, md5(array_to_string({_KEYS}, '|')) AS keywords FROM ({_ASKED})")
def conversation_keywords(spark, d):
    return asked(spark, d).select("conv_id", "turn", F.md5(F.array_join(A.keywords(F.col("q")), "|")).alias("keywords"))


_DICTIONARIES = ", ".join(f"('{kind}', {_Q(h)}, {k}, {_Q(t)})" for kind, terms in (("synonym", A.SYNONYMS), ("related", A.RELATED)) for h, ts in terms.items() for k, t in enumerate(ts))


@query("exp05_dictionaries", f"WITH v AS (SELECT * FROM (VALUES {_DICTIONARIES}) v(kind, head, place, term)), f AS (SELECT DISTINCT head FROM v), c AS (SELECT head, count(*) AS n FROM f JOIN ({_ASKED}) ON contains(q, head) GROUP BY 1) SELECT v.*, coalesce(n, 0) AS asked FROM v LEFT JOIN c USING (head)")
def dictionaries(spark, d):
    """The dictionaries, with how many of the users' turns hold each head."""
    terms = spark.createDataFrame([(kind, h, k, t) for kind, terms in (("synonym", A.SYNONYMS), ("related", A.RELATED)) for h, ts in terms.items() for k, t in enumerate(ts)], "kind string, head string, place int, term string")
    heads = sorted({*A.SYNONYMS, *A.RELATED})
    held = F.array_compact(F.array(*[F.when(F.contains("q", F.lit(h)), F.lit(h)) for h in heads]))
    n = asked(spark, d).select(F.explode(held).alias("head")).groupBy("head").agg(F.count(F.lit(1)).alias("n"))
    return terms.join(n, "head", "left").select("kind", "head", "place", "term", F.coalesce("n", F.lit(0)).alias("asked"))


#: Words of a benchmark item that are asked first, and words of a run that tells that a document quotes it.
BRIEF, RUN = 5, 8
_LOW = "list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')"


@query("fun21_expansion_evaluation", f"""
WITH d AS (SELECT doc_id, {_LOW} AS w FROM documents), b AS (SELECT item_id, {_LOW} AS w FROM benchmark),
 dt AS (SELECT doc_id, unnest(list_distinct(w)) AS term FROM d), bo AS (SELECT item_id, unnest(list_distinct(w[1:{BRIEF}])) AS term FROM b), be AS (SELECT item_id, unnest(list_distinct(w)) AS term FROM b),
 ro AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, doc_id) AS rank FROM bo JOIN dt USING (term) GROUP BY 1, 2 QUALIFY rank <= 10),
 re AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, doc_id) AS rank FROM be JOIN dt USING (term) GROUP BY 1, 2 QUALIFY rank <= 10),
 dr AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w) - {RUN} + 2), lambda i: array_to_string(w[i:i + {RUN - 1}], ' ')))) AS run FROM d WHERE len(w) >= {RUN}),
 br AS (SELECT item_id, unnest(list_distinct(list_transform(range(1, len(w) - {RUN} + 2), lambda i: array_to_string(w[i:i + {RUN - 1}], ' ')))) AS run FROM b WHERE len(w) >= {RUN}),
 rel AS (SELECT DISTINCT item_id, doc_id FROM br JOIN dr USING (run)), n AS (SELECT item_id, count(*) AS n, list_sum(list_transform(range(1, CAST(least(count(*), 10) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) AS ideal FROM rel GROUP BY 1),
 mo AS (SELECT item_id, count(*) FILTER (rank <= 5) AS five, min(rank) AS first, sum(1 / log2(rank + 1)) AS gain FROM ro JOIN rel USING (item_id, doc_id) GROUP BY 1), me AS (SELECT item_id, count(*) FILTER (rank <= 5) AS five, min(rank) AS first, sum(1 / log2(rank + 1)) AS gain FROM re JOIN rel USING (item_id, doc_id) GROUP BY 1),
 v AS (SELECT item_id, coalesce(mo.five / n, 0) AS o5, coalesce(1 / mo.first, 0) AS om, coalesce(mo.gain / ideal, 0) AS og, coalesce(me.five / n, 0) AS e5, coalesce(1 / me.first, 0) AS em, coalesce(me.gain / ideal, 0) AS eg FROM n LEFT JOIN mo USING (item_id) LEFT JOIN me USING (item_id))
SELECT item_id, round(o5, 6) AS original_recall_5, round(e5, 6) AS expanded_recall_5, round(e5 - o5, 6) AS recall_delta, round(em - om, 6) AS mrr_improvement, round(eg - og, 6) AS ndcg_improvement, round(CASE WHEN o5 > 0 THEN (e5 - o5) / o5 ELSE 0 END, 6) AS improvement_ratio FROM v""")
def expansion_evaluation(spark, d):
    """Benchmark items asked by their first words and by all; relevant are the documents that quote them."""
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    brief = items.withColumn("text", F.array_join(F.slice(A.word_list(F.lower("text")), 1, BRIEF), " "))
    found = lambda q: R.keyword_search(docs, q, "doc_id", "item_id", "text", 10).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "rank")
    # Used three times and a fraction of the table, so it is written down.
    relevant = settled(R.quoting(docs, items, "doc_id", "item_id", "text", RUN).toDF("item_id", "doc_id"))
    told = EX.evaluated(found(brief), found(items), relevant, "item_id", "doc_id")
    return told.select("item_id", *[F.round(c, 6).alias(c) for c in ("original_recall_5", "expanded_recall_5", "recall_delta", "mrr_improvement", "ndcg_improvement", "improvement_ratio")])


# --- topics, gaps and predictions: users' sessions of `events`, their kinds as topics ---------------------------------

#: A value of so much is full satisfaction; favourite topics of a user.
FULL, FAVOURITES = 20.0, 3
_SESSIONS = """
ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) i FROM events),
fo AS (SELECT user_id, i, t, t AS start FROM ev WHERE i = 1 UNION ALL SELECT ev.user_id, ev.i, ev.t, CASE WHEN ev.t - fo.start > 3600000000 THEN ev.t ELSE fo.start END FROM fo JOIN ev ON ev.user_id = fo.user_id AND ev.i = fo.i + 1),
al AS (SELECT ev.*, start FROM ev JOIN fo USING (user_id, i))"""
_FAVOURITES = f"""
fa AS (SELECT user_id, event_type AS topic FROM events GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) <= {FAVOURITES}),
us AS (SELECT user_id, least(1.0, avg(value) / {FULL}) AS satisfaction FROM events GROUP BY 1)"""


def with_sessions(spark, d) -> DataFrame:
    t = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "ts")
    return SC.scan(t, "user_id", "ts", ["event_id"], SC.Sessions(3_600_000_000), "long").withColumnRenamed("value", "_v").toDF(*t.columns, "start")


def favourites(events: DataFrame) -> DataFrame:
    counted = events.groupBy("user_id", F.col("event_type").alias("topic")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "topic"))).filter(F.col("k") <= FAVOURITES).select("user_id", "topic")


def satisfaction(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.least(F.lit(1.0), F.avg("value") / FULL).alias("satisfaction"))


@query("evt21_popular_topics", f"""
WITH {_FAVOURITES}, tq AS (SELECT topic, e.event_type FROM fa JOIN events e USING (user_id) QUALIFY row_number() OVER (PARTITION BY topic ORDER BY e.user_id, e.ts, e.event_id) <= 10),
 r AS (SELECT topic, avg(CAST(contains(event_type, topic) AS INT)) AS relevance FROM tq GROUP BY 1)
SELECT topic, count(*) AS frequency, round(max(relevance), 6) AS relevance, round(avg(satisfaction), 6) AS engagement, round(count(*) * max(relevance) * avg(satisfaction), 6) AS score FROM fa JOIN us USING (user_id) JOIN r USING (topic) GROUP BY 1 ORDER BY frequency DESC, topic LIMIT 15""")
def popular_topics(spark, d):
    e = table(spark, d, "events")
    fa = favourites(e)
    asked_first = R.first_of_each(fa.join(e, "user_id").select("topic", "user_id", "ts", "event_id", "event_type"), ["topic"], ["user_id", "ts", "event_id"], 10)
    relevance = asked_first.groupBy("topic").agg(F.avg(F.contains("event_type", "topic").cast("int")).alias("relevance"))
    told = fa.join(satisfaction(e), "user_id").groupBy("topic").agg(F.count(F.lit(1)).alias("frequency"), F.avg("satisfaction").alias("engagement")).orderBy(F.desc("frequency"), "topic").limit(15).join(relevance, "topic")
    return told.select("topic", "frequency", F.round("relevance", 6).alias("relevance"), F.round("engagement", 6).alias("engagement"), F.round(F.col("frequency") * F.col("relevance") * F.col("engagement"), 6).alias("score"))


@query("evt22_content_gaps", f"""
WITH RECURSIVE {_SESSIONS}, {_FAVOURITES}, se AS (SELECT user_id, start, least(1.0, avg(value) / {FULL}) AS score FROM al GROUP BY 1, 2),
 un AS (SELECT event_type FROM al JOIN se USING (user_id, start) WHERE score < 0.3 GROUP BY 1), low AS (SELECT event_id, score FROM al JOIN se USING (user_id, start) WHERE score < 0.4 ORDER BY score, event_id LIMIT 20)
SELECT 'unanswered' AS gap, event_type AS what, CAST(NULL AS DOUBLE) AS score FROM un UNION ALL SELECT 'underused', topic, NULL FROM (SELECT topic FROM fa GROUP BY 1 HAVING count(*) < 2) UNION ALL SELECT 'low quality', CAST(event_id AS VARCHAR), round(score, 6) FROM low""")
def content_gaps(spark, d):
    """Kinds asked in sessions of little satisfaction, topics hardly anybody likes, and the worst answers."""
    s = with_sessions(spark, d)
    score = s.groupBy("user_id", "start").agg(F.least(F.lit(1.0), F.avg("value") / FULL).alias("score"))
    low = s.join(score.filter("score < 0.4"), ["user_id", "start"])
    nothing = F.lit(None).cast("double").alias("score")
    unanswered = low.filter("score < 0.3").select(F.lit("unanswered").alias("gap"), F.col("event_type").alias("what"), nothing).distinct()
    underused = favourites(s).groupBy("topic").count().filter("count < 2").select(F.lit("underused").alias("gap"), F.col("topic").alias("what"), nothing)
    worst = low.orderBy("score", "event_id").limit(20).select(F.lit("low quality").alias("gap"), F.col("event_id").cast("string").alias("what"), F.round("score", 6).alias("score"))
    return unanswered.unionByName(underused).unionByName(worst)


@query("evt25_predictions", f"""
WITH RECURSIVE {_SESSIONS}, {_FAVOURITES}, se AS (SELECT user_id, start, count(*) AS n, (max(t) - start) / 3.6e9 AS hours FROM al GROUP BY 1, 2),
 p AS (SELECT user_id, count(*) AS sessions, sum(n) AS queries, avg(hours) AS hours FROM se GROUP BY 1), f AS (SELECT user_id, count(*) AS topics FROM fa GROUP BY 1),
 x AS (SELECT *, list_filter([CASE WHEN queries > 10 THEN 'continue_active_usage' END, CASE WHEN hours > 1 THEN 'long_session_usage' END, CASE WHEN sessions > 5 THEN 'regular_user' END], lambda z: z IS NOT NULL) AS ps,
   list_filter([CASE WHEN sessions > 10 THEN 'experienced_user' END, CASE WHEN satisfaction > 0.7 THEN 'high_satisfaction' END, CASE WHEN topics > 3 THEN 'diverse_interests' END, CASE WHEN hours > 0.5 THEN 'engaged_user' END], lambda z: z IS NOT NULL) AS fs, least(sessions / 10, 1.0) AS full_ FROM p JOIN us USING (user_id) JOIN f USING (user_id))
SELECT user_id, CASE WHEN len(ps) = 0 THEN 'new_user' ELSE array_to_string(ps, ',') END AS predictions, CASE WHEN len(fs) = 0 THEN 'new_user' ELSE array_to_string(fs, ',') END AS factors, round(full_ * 0.8, 6) AS active, round(full_ * 0.7, 6) AS long_, round(full_ * 0.9, 6) AS regular, round((1 - full_) * 0.6, 6) AS new_ FROM x""")
def predictions(spark, d):
    """What a user will do by the past, how sure that is, and why."""
    s = with_sessions(spark, d)
    each = s.groupBy("user_id", "start").agg(F.count(F.lit(1)).alias("n"), ((F.max(F.unix_micros(F.col("ts").cast("timestamp"))) - F.col("start")) / 3.6e9).alias("hours"))
    p = each.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("queries"), F.avg("hours").alias("hours"))
    x = p.join(satisfaction(s), "user_id").join(favourites(s).groupBy("user_id").agg(F.count(F.lit(1)).alias("topics")), "user_id")
    named = lambda *cases: F.array_compact(F.array(*[F.when(test, name) for name, test in cases]))
    told = lambda c: F.when(F.size(c) == 0, "new_user").otherwise(F.array_join(c, ","))
    does = named(("continue_active_usage", F.col("queries") > 10), ("long_session_usage", F.col("hours") > 1), ("regular_user", F.col("sessions") > 5))
    why = named(("experienced_user", F.col("sessions") > 10), ("high_satisfaction", F.col("satisfaction") > 0.7), ("diverse_interests", F.col("topics") > 3), ("engaged_user", F.col("hours") > 0.5))
    full = F.least(F.col("sessions") / 10, F.lit(1.0))
    return x.select("user_id", told(does).alias("predictions"), told(why).alias("factors"), F.round(full * 0.8, 6).alias("active"), F.round(full * 0.7, 6).alias("long_"), F.round(full * 0.9, 6).alias("regular"), F.round((1 - full) * 0.6, 6).alias("new_"))


@query("evt31_health", f"""
WITH r AS (SELECT count(*) AS activities, count(DISTINCT user_id) AS users, avg(1 + least(4, floor(value / {FULL / 5}))) AS rating FROM events),
 h AS (SELECT *, CASE WHEN users > 0 THEN 25 ELSE 0 END + CASE WHEN rating >= 4 THEN 30 WHEN rating >= 3 THEN 20 ELSE 0 END + CASE WHEN activities > 100 THEN 25 WHEN activities > 10 THEN 15 ELSE 0 END + CASE WHEN users > 5 THEN 20 WHEN users > 1 THEN 10 ELSE 0 END AS score FROM r)
SELECT activities, users, round(rating, 6) AS rating, score, CASE WHEN score >= 80 THEN 'excellent' WHEN score >= 60 THEN 'good' WHEN score >= 40 THEN 'fair' ELSE 'poor' END AS status FROM h""")
def health(spark, d):
    r = table(spark, d, "events").agg(F.count(F.lit(1)).alias("activities"), F.countDistinct("user_id").alias("users"), F.avg(1 + F.least(F.lit(4), F.floor(F.col("value") / (FULL / 5)))).alias("rating"))
    band = lambda *steps: reduce(lambda out, s: out.when(s[0], s[1]), steps[1:], F.when(steps[0][0], steps[0][1])).otherwise(0)
    users, rating, n = F.col("users"), F.col("rating"), F.col("activities")
    score = band((users > 0, 25)) + band((rating >= 4, 30), (rating >= 3, 20)) + band((n > 100, 25), (n > 10, 15)) + band((users > 5, 20), (users > 1, 10))
    h = r.withColumn("score", score)
    return h.select("activities", "users", F.round("rating", 6).alias("rating"), "score", F.when(F.col("score") >= 80, "excellent").when(F.col("score") >= 60, "good").when(F.col("score") >= 40, "fair").otherwise("poor").alias("status"))


@query("fun14_trends_and_forecasts", """
WITH n AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\\d+(?:\\.\\d+)?'), lambda x: CAST(x AS DOUBLE)) AS v FROM documents),
 p AS (SELECT doc_id, v, len(v) AS n, list_avg(v[-3:]) AS recent, list_avg(v[1:len(v) - 3]) AS past, (v[-1] - v[-5]) / 4 AS step, list_filter(list_transform(range(1, len(v)), lambda i: CASE WHEN v[i + 1] <> 0 THEN v[i] / v[i + 1] END), lambda r: r IS NOT NULL) AS ratios FROM n WHERE len(v) >= 3)
SELECT doc_id, n, round(list_avg(v), 6) AS mean, round(list_median(v), 6) AS median, round(list_stddev_samp(v), 6) AS volatility, CASE WHEN n >= 5 AND recent > past * 1.05 THEN 'bullish' WHEN n >= 5 AND recent < past * 0.95 THEN 'bearish' ELSE 'neutral' END AS sentiment,
 len(list_filter(ratios, lambda r: r >= 0.01 AND r <= 2)) AS margins, len(list_filter(ratios, lambda r: NOT (r >= 0.01 AND r <= 2) AND r >= 0.1 AND r <= 10)) AS debts, CASE WHEN n >= 5 THEN round(v[-1] + step, 6) END AS next_period, CASE WHEN n >= 5 THEN round(v[-1] + 3 * step, 6) END AS next_3_periods, CASE WHEN n >= 5 THEN CASE WHEN step > 0 THEN 'positive' ELSE 'negative' END END AS direction FROM p""")
def trends(spark, d):
    """Numbers of a text in their order: spread, the last three against those before, ratios of neighbours, and what follows."""
    v = F.transform(F.regexp_extract_all("text", F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))
    t = table(spark, d, "documents").select("doc_id", v.alias("v")).filter(F.size("v") >= 3).withColumn("n", F.size("v"))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)
    at = lambda k: F.element_at("v", F.lit(k))
    t = t.withColumns({"mean": mean(F.col("v")), "recent": mean(F.slice("v", -3, 3)), "past": mean(F.slice("v", F.lit(1), F.greatest(F.col("n") - 3, F.lit(1)))), "step": F.when(F.col("n") >= 5, (at(-1) - F.get("v", F.col("n") - 5)) / 4)})
    ordered = F.array_sort("v")
    middle = (F.get(ordered, F.floor((F.col("n") - 1) / 2).cast("int")) + F.get(ordered, F.floor(F.col("n") / 2).cast("int"))) / 2
    # By Welford's sums, and rounded after scaling, as the SQL engine does: with numbers of sixteen digits and more every other way differs.
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))
    stepped = lambda s, x: F.struct((s["n"] + 1).alias("n"), (s["mean"] + (x - s["mean"]) / (s["n"] + 1)).alias("mean"), (s["squares"] + (x - s["mean"]) * (x - (s["mean"] + (x - s["mean"]) / (s["n"] + 1)))).alias("squares"))
    spread = F.aggregate("v", zero, stepped, lambda s: F.sqrt(s["squares"] / (s["n"] - 1)))
    rounded = lambda c: F.round(c * 1e6) / 1e6
    pairs = F.zip_with(F.slice("v", F.lit(1), F.col("n") - 1), F.slice("v", F.lit(2), F.col("n") - 1), lambda a, b: F.when(b != 0, a / b))
    margin = lambda r: (r >= 0.01) & (r <= 2)
    long_ = F.col("n") >= 5
    return t.select(
        "doc_id", "n", rounded(F.col("mean")).alias("mean"), rounded(middle).alias("median"), rounded(spread).alias("volatility"),
        F.when(long_ & (F.col("recent") > F.col("past") * 1.05), "bullish").when(long_ & (F.col("recent") < F.col("past") * 0.95), "bearish").otherwise("neutral").alias("sentiment"),
        F.size(F.filter(pairs, margin)).alias("margins"), F.size(F.filter(pairs, lambda r: ~margin(r) & (r >= 0.1) & (r <= 10))).alias("debts"),
        rounded(at(-1) + F.col("step")).alias("next_period"), rounded(at(-1) + 3 * F.col("step")).alias("next_3_periods"), F.when(long_, F.when(F.col("step") > 0, "positive").otherwise("negative")).alias("direction"),
    )


# --- search by text, chunks by each document's own strategy, text files ----------------------------------------------

_PART = "CAST('0x' || substr(md5(text || '_0'), {0}, 8) AS BIGINT) / 4294967295.0 * 2 - 1"
_EMBEDDED = "[" + ", ".join(_PART.format(8 * k + 1) for k in range(4)) + "]"


@query("vec11_search_by_text", f"""
WITH e AS (SELECT doc_id, {_EMBEDDED} AS v FROM documents), q AS (SELECT item_id, {_EMBEDDED} AS v FROM benchmark WHERE item_id % 50 = 0),
 s AS (SELECT item_id AS query_id, doc_id AS id, round(list_cosine_similarity(CAST(CAST(q.v AS FLOAT[]) AS DOUBLE[]), CAST(CAST(e.v AS FLOAT[]) AS DOUBLE[])), 9) AS score FROM q, e)
SELECT query_id, id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5""")
def search_by_text(spark, d):
    """Texts are embedded on both sides, then searched."""
    embedded = lambda name, key: table(spark, d, name).select(F.col(key).alias("id"), F.slice(V.hash_embedding(F.col("text"), F.lit(0), 4), 1, 4).alias("v"))
    return V.batch_topk(embedded("documents", "doc_id"), embedded("benchmark", "item_id").filter("id % 50 = 0"), "id", "v", 5).select("query_id", "id", F.round("score", 6).alias("score"))


def adaptive(docs: DataFrame) -> DataFrame:
    """(doc_id, strategy, chunk, content): every document by the strategy that its own analysis chooses."""
    a = C.analysis(F.col("text"))
    told = docs.select("doc_id", "text", C.strategy(a["length"], a["structure"], a["semantic"]).alias("strategy"))
    by = lambda name: told.filter(F.col("strategy") == name)
    token = SP.contents(SP.token_windows(by("token"), ["doc_id"], "text", C.SIZE, C.OVERLAP), by("token"), ["doc_id"], "text").select("doc_id", F.lit("token").alias("strategy"), "chunk", "content")
    layered = folds.hierarchical_chunks(by("hierarchical"), "doc_id", "text").select("doc_id", F.lit("hierarchical").alias("strategy"), "chunk", "content")
    grouped = folds.semantic_chunks(by("semantic"), "doc_id", "text").select("doc_id", F.lit("semantic").alias("strategy"), "chunk", "content")
    # Layers first; what is longer than a window there is cut again.
    parts = folds.hierarchical_chunks(by("hybrid"), "doc_id", "text").filter("level < 4").withColumn("_cut", C.token_chunks(F.col("content"), C.SIZE, C.OVERLAP))
    hybrid = parts.select("doc_id", F.lit("hybrid").alias("strategy"), "chunk", F.posexplode("_cut").alias("piece", "content"))
    numbered = hybrid.withColumn("chunk", (F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk", "piece")) - 1).cast("int")).drop("piece")
    return reduce(DataFrame.unionByName, [token, layered, grouped, numbered])


@query("chk23_adaptive_chunks")
def adaptive_chunks(spark, d):
    return adaptive(table(spark, d, "documents"))


#: Documents of a file.
FILE = 50
#: Stands for null in a folder's name; an encoded name never is a single mark of per cent.
NAMELESS = "%"


@query("src01_27_text_files", f"WITH f AS (SELECT source, doc_id // {FILE} AS part, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS text FROM documents GROUP BY 1, 2) SELECT source, part, length(text) AS chars, md5(text) AS digest, len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) AS lines FROM f")
def text_files(spark, d):
    """Documents written as text files in folders, and all files of the tree read whole."""
    folder = f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").groupBy("source", F.floor(F.col("doc_id") / FILE).alias("part")).agg(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("doc_id", "text")))).alias("held"))
    named = lambda c: F.coalesce(F.url_encode(F.col(c).cast("string")), F.lit(NAMELESS))
    # A file none of whose documents has a text is empty; the others end with a line end.
    text = F.when(F.size("held") > 0, F.concat(F.array_join(F.transform("held", lambda x: x["text"]), "\n"), F.lit("\n")))
    TX.write_tree(docs.select(F.concat(F.lit("source="), named("source"), F.lit("/part="), named("part"), F.lit("/texts.txt")).alias("path"), text.alias("text")), folder)
    files = TX.load_tree(spark, folder).withColumn("text", F.when(F.col("text") != "", F.col("text")))
    name = lambda x: F.regexp_extract("path", f"/{x}=([^/]*)/", 1)
    at = lambda x: F.when(name(x) != NAMELESS, F.url_decode(name(x)))
    return files.select(at("source").alias("source"), at("part").cast("long").alias("part"), F.length("text").alias("chars"), F.md5("text").alias("digest"), F.when(F.col("text").isNotNull(), F.size(F.filter(F.split("text", "\n"), lambda x: x != ""))).alias("lines"))
