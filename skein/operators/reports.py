"""Reports on users, tenants, logs and metrics: figures as Columns, hooks and policies over DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import held, words
from skein.operators.aggregation import ranked

#: Classes of log messages by pattern, and the group of each.
LOG_CLASSES = {
    "api_timeout": ("error", "timeout|timed out"),
    "connection_error": ("error", "connection.*(?:refused|failed|lost)"),
    "authentication_failure": ("error", "auth.*(?:failed|denied|invalid)"),
    "rate_limit_exceeded": ("error", "rate.?limit.*exceeded"),
    "memory_error": ("error", "memory.*(?:error|exhausted|out of)"),
    "slow_query": ("performance", r"query.*(?:slow|timeout|(?:\d+\.?\d*)\s*(?:seconds?|ms))"),
    "high_memory_usage": ("performance", r"memory.*(?:usage|percent).*\d+"),
    "cache_miss": ("performance", "cache.*miss"),
    "unauthorized_access": ("security", "unauthorized|forbidden|access.*denied"),
    "suspicious_activity": ("security", "suspicious|malicious|attack"),
}
#: Words that lead through an answer, and patterns of queries that are suspect.
INDICATORS = ["first", "second", "third", "finally", "however", "therefore", "moreover", "additionally", "in conclusion", "to summarize"]
SUSPECT = [r"password\s*[:=]", r"api\s*key\s*[:=]", r"token\s*[:=]", ".{200,}"]
#: Scores from which a query is blocked, by sensitivity.
BLOCKED = {"low": 0.3, "medium": 0.6, "high": 0.8}
#: Warning and critical value of each metric; of the last, less is worse.
THRESHOLDS = {"memory_usage": (80, 90), "cpu_usage": (70, 85), "disk_usage": (80, 90), "error_rate": (5, 10), "cache_hit_rate": (70, 50)}
#: Currencies, indicators and terms of financial texts.
CURRENCY = r"(?i)\d+(?:\.\d+)?\s*(?:USD|EUR|IRR|GBP|JPY|تومان|ریال)"
ECONOMIC = ["GDP", "CPI", "Unemployment", "Interest_Rate"]
TERMS = ["رشد", "تورم", "GDP", "CPI", "Unemployment", "Finance", "اقتصاد", "بازار", "سرمایه", "سرمایه‌گذاری", "قیمت"]


def log_classes(message: Column) -> Column:
    """Names of all classes that a message belongs to, in their order."""
    return F.array_compact(F.array(*[F.when(message.rlike(f"(?i){p}"), name) for name, (_, p) in LOG_CLASSES.items()]))


def usage_pattern(seconds: Column, queries: Column) -> Column:
    """By mean length and mean queries of a user's sessions."""
    return F.when((seconds > 1800) & (queries > 10), "power_user").when((seconds > 600) & (queries > 5), "regular_user").when(queries > 2, "casual_user").otherwise("light_user")


def risk(failed: Column, suspicious: Column) -> Column:
    logins = F.when(failed > 10, 30).when(failed > 5, 20).when(failed > 0, 10).otherwise(0)
    odd = F.when(suspicious > 5, 40).when(suspicious > 2, 25).when(suspicious > 0, 15).otherwise(0)
    return F.least(logins + odd, F.lit(100))


def metric_status(name: str, value: Column) -> Column:
    if name not in THRESHOLDS:
        return F.lit("healthy")
    warning, critical = THRESHOLDS[name]
    worse = (lambda limit: value < limit) if name == "cache_hit_rate" else (lambda limit: value > limit)
    return F.when(worse(critical), "critical").when(worse(warning), "warning").otherwise("healthy")


def threat(query: Column, banned: list[str], history: Column | float = 0.0, sensitivity: str = "medium") -> dict[str, Column]:
    """Score of a query by its length, banned words, suspect patterns and the user's history, and what follows."""
    some = lambda test, points: F.when(test, points).otherwise(0.0)
    parts = [some(F.length(query) > 1000, 0.3), *[some(F.contains(F.lower(query), F.lit(w.lower())), 0.5) for w in banned], *[some(query.rlike(f"(?i){p}"), 0.4) for p in SUSPECT]]
    score = reduce(lambda a, b: a + b, parts) + 0.2 * (history if isinstance(history, Column) else F.lit(history))
    return {"score": score, "suspicious": score > 0.3, "blocked": score > BLOCKED[sensitivity]}


def completeness(answer: Column, question: Column) -> Column:
    """Words of an answer against what its question lets expect; an empty one is 0."""
    asked = words(F.lower(question))
    has = lambda *ws: F.arrays_overlap(asked, F.array(*map(F.lit, ws)))
    expected = F.when(has("what", "how", "why", "when", "where", "who"), 50).when(has("explain", "describe", "tell"), 100).otherwise(30)
    return F.when((answer == "") | (question == ""), 0.0).otherwise(F.least(F.size(words(answer)) / expected, F.lit(1.0)))


def coherence(answer: Column) -> Column:
    sentences = F.split(answer, r"\.", -1)
    mean = F.aggregate(sentences, F.lit(0), lambda s, x: s + F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))) / F.size(sentences)
    return F.when(answer == "", 0.0).otherwise(0.6 * F.least(held(answer, INDICATORS) / 5, F.lit(1.0)) + 0.4 * F.least(mean / 20, F.lit(1.0)))


def prompt_context(rows: DataFrame, group: str, order: str, text: str, source: str, budget: int, header: str = "Source", buffer: int = 50, least: int = 100) -> DataFrame:
    """(group, context): texts with their number and source, in order, while they fit ``budget`` characters; the first
    that doesn't is cut to what is left less ``buffer``, if that is over ``least``, and ends the context."""
    numbered = ranked(rows.select(group, order, F.trim(F.col(text)).alias("_text"), F.col(source).alias("_source")), [group], [order])
    # A text adds its header at least, so no more of them can fit.
    few = numbered.filter(F.col("_i") <= budget // len(f"{header} 1 ():\n"))
    head = F.concat(F.lit(f"{header} "), (F.col("_i") + 1).cast("string"), F.lit(" ("), F.col("_source"), F.lit("):\n"))
    w = Window.partitionBy(group).orderBy("_i")
    used = few.withColumn("_part", F.concat(head, "_text")).withColumn("_used", F.sum(F.length("_part")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.col("_used") - F.length("_part")
    left = budget - before - buffer
    first = F.lag("_used").over(w)
    told = used.withColumn("_said", F.when(F.col("_used") <= budget, F.col("_part")).when((F.coalesce(first, F.lit(0)) <= budget) & (left > least), F.concat(head, F.call_function("substring", F.col("_text"), F.lit(1), left.cast("int")), F.lit("..."))))
    return told.filter("_said IS NOT NULL").groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_said"))), lambda x: x["_said"]), "\n\n").alias("context"))


@dataclass
class Policy:
    """``conditions`` are of time_based, query_length, tier_based; ``actions`` of query_modification, rate_limiting, logging."""

    name: str
    priority: int
    conditions: tuple = ()
    actions: tuple = ()
    rules: dict = field(default_factory=dict)
    active: bool = True


#: Tiers from the least on.
TIERS = ["free", "basic", "premium", "enterprise"]


def with_policies(rows: DataFrame, query: str, hour: str, tier: str, policies: list[Policy]) -> DataFrame:
    """Rows with ``query`` as the policies leave it and ``applied``, their names: by priority, each on what the one before
    left, where all its conditions hold."""
    rank = F.array_position(F.array(*map(F.lit, TIERS)), F.col(tier))
    out = rows.withColumn("applied", F.array().cast("array<string>"))
    for p in sorted(policies, key=lambda p: -p.priority):
        if not p.active:
            continue
        tests = {
            "time_based": F.col(hour).isin(*p.rules.get("allowed_hours", range(24))),
            "query_length": F.length(query) <= p.rules.get("max_query_length", 1000),
            "tier_based": rank >= TIERS.index(p.rules.get("required_tier", "free")) + 1,
        }
        holds = reduce(lambda a, b: a & b, [tests[c] for c in p.conditions if c in tests], F.lit(True))
        changed = F.trim(F.concat(F.lit(p.rules.get("query_prefix", "") + " "), F.col(query), F.lit(" " + p.rules.get("query_suffix", "")))) if "query_modification" in p.actions else F.col(query)
        out = out.withColumn("_holds", holds).withColumns({query: F.when(F.col("_holds"), changed).otherwise(F.col(query)), "applied": F.when(F.col("_holds"), F.array_append("applied", F.lit(p.name))).otherwise(F.col("applied"))}).drop("_holds")
    return out


def reserved(operations: DataFrame, keys: list[str], order: list[str], limit: str) -> DataFrame:
    """Operations with ``allowed`` (fewer than ``limit`` of their keys came before) and the usage they met; a hot tenant's
    are numbered by ranges."""
    placed = ranked(operations, keys, order)
    return placed.withColumns({"allowed": F.col("_i") < F.col(limit), "usage": F.least(F.col("_i"), F.col(limit))}).drop("_i", "_n")


#: What is recommended to each segment of users, to a kind of usage, and to others.
ADVICE = {
    "power_user": ["ارائه ویژگی‌های پیشرفته", "دسترسی اولویت‌دار به قابلیت‌های جدید", "پشتیبانی تخصصی"],
    "regular_user": ["ارائه آموزش‌های پیشرفته", "تشویق به استفاده بیشتر", "معرفی قابلیت‌های جدید"],
    "casual_user": ["بهبود تجربه کاربری", "ارائه محتوای جذاب", "کاهش پیچیدگی رابط کاربری"],
    "new_user": ["راهنمایی کامل", "آموزش‌های پایه", "تجربه کاربری ساده"],
    "inactive_user": ["بازگرداندن کاربر", "ارائه انگیزه‌های جدید", "بررسی علل عدم استفاده"],
}
OTHERWISE = "تحلیل بیشتر نیاز است"
MORE_OF, IN_DEPTH, IN_BRIEF = "محتوای بیشتر در زمینه", "محتوای عمیق و تفصیلی", "محتوای مختصر و کاربردی"


def advice(segment: Column, topics: Column, minutes: Column) -> Column:
    """What is recommended to a user: by segment, by their first topics, and by the length of their sessions."""
    own = F.array(F.lit(OTHERWISE))
    for name, said in ADVICE.items():
        own = F.when(segment == name, F.array(*map(F.lit, said))).otherwise(own)
    more = F.when(F.size(topics) > 0, F.concat(F.lit(f"{MORE_OF} "), F.array_join(F.slice(topics, 1, 3), ", ")))
    return F.array_compact(F.concat(own, F.array(more, F.when(minutes > 30, IN_DEPTH).otherwise(IN_BRIEF))))


#: Kinds of hooks.
HOOKS = ["pre_document_ingest", "post_document_ingest", "pre_query", "post_query", "pre_response", "post_response", "on_user_interaction", "on_error"]


class Hooks:
    """Functions on DataFrames by kind.  One that fails while its plan is built is passed over and told to ``on_error``;
    so is one whose result lacks columns that later steps need."""

    def __init__(self) -> None:
        self.held: dict[str, list[Callable[[DataFrame], DataFrame]]] = {k: [] for k in HOOKS}
        self.failed: list[tuple[str, str]] = []

    def register(self, kind: str, hook: Callable[[DataFrame], DataFrame]) -> None:
        if kind not in self.held:
            raise ValueError(f"unknown hook {kind}")
        self.held[kind].append(hook)

    def run(self, kind: str, df: DataFrame, needs: list[str] = ()) -> DataFrame:
        for hook in self.held[kind]:
            try:
                made = hook(df)
                # Analysed now, so that a fault is this hook's and not a later one's.
                missing = set(needs) - set(made.columns)
                if missing:
                    raise ValueError(f"lacks {sorted(missing)}")
                df = made
            except Exception as fault:  # a plug-in may raise anything
                self.failed.append((kind, type(fault).__name__))
                if kind != "on_error":
                    df = self.run("on_error", df, needs)
        return df
