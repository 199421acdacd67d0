"""Scalar text functions as Columns: statistics, classes, query features and answer quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java classes; the Arabic block stands for Persian script.
PERSIAN, LATIN = r"[\x{0600}-\x{06FF}]", "[a-zA-Z]"
PERSIAN_DIGITS, DIGITS = "۰۱۲۳۴۵۶۷۸۹", "0123456789"
#: Lexicons of the content filter, of our own choice; every function takes others.
TOXIC = ["idiot", "stupid", "moron", "scum", "trash", "loser", "worthless", "disgusting"]
#: The filter's Persian and English words.
TOXIC_FIXED = ["فحش", "زشت", "کثیف", "احمق", "خنگ", "بی‌عقل", "stupid", "idiot", "dumb", "hate", "kill", "die"]
SENSITIVE = ["password", "secret", "confidential", "private"]


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def word_set(c: Column) -> Column:
    return F.array_distinct(words(F.lower(c)))


def hits(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def statistics(c: Column, digits: int = 2) -> dict[str, Column]:
    letters, n = hits(c, r"\p{L}"), F.size(words(c))
    return {
        "char_count": F.length(c), "word_count": n, "line_count": hits(c, "\n") + 1, "alpha_count": letters, "digit_count": hits(c, "[0-9]"), "space_count": hits(c, r"\s"),
        "persian_ratio": F.round(F.when(F.length(c) > 0, hits(c, PERSIAN) / F.length(c)).otherwise(0.0), 3), "avg_word_length": F.round(F.when(n > 0, letters / n).otherwise(0.0), digits),
    }


def script_language(c: Column) -> Column:
    """fa, mixed or en by the shares of Persian and Latin letters among non-blank characters."""
    size = F.length(F.regexp_replace(c, r"\s+", ""))
    fa, en = hits(c, PERSIAN), hits(c, LATIN)
    return F.when(size == 0, "en").when((fa / size >= 0.2) & (en / size > 0.3), "mixed").when(fa / size >= 0.2, "fa").when(en / size > 0.3, "en").when(fa > 0, "fa").otherwise("en")


def held(c: Column, lexicon: list[str]) -> Column:
    """How many different words of the lexicon the text contains."""
    return reduce(lambda a, b: a + b, [F.contains(F.lower(c), F.lit(w)).cast("int") for w in lexicon])


#: Weights and patterns of the two scores below.
def spam_score(c: Column) -> Column:
    singles = hits(c, r"https?://\S+") + hits(c, "@") + hits(c, "#") + hits(c, r"\$") + hits(c, "[A-Z]{3,}")
    return F.least(F.lit(1.0), 0.2 * singles + 0.3 * hits(c, r"(.)\1{3,}") + F.when(F.length(c) > 500, 0.2).otherwise(0.0))


def personal_score(c: Column) -> Column:
    return F.least(F.lit(1.0), 0.3 * (hits(c, "[0-9]{4,}") + hits(c, r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}") + hits(c, r"\+[1-9][0-9]{6,14}")))


def content_class(c: Column) -> Column:
    """The first that applies: toxic, spam, sensitive, inappropriate, safe."""
    return F.when(held(c, TOXIC) > 0, "toxic").when(spam_score(c) > 0.5, "spam").when(held(c, SENSITIVE) > 0, "sensitive").when(personal_score(c) > 0.5, "inappropriate").otherwise("safe")


def redact(c: Column, lexicon: list[str]) -> Column:
    return F.regexp_replace(c, "(?i)" + "|".join(lexicon), "[FILTERED]")


#: Weights, scales and bands of a query's complexity and length.
def complexity(c: Column) -> Column:
    n, special = F.size(words(c)), hits(c, r"[^A-Za-z0-9_\s]")
    return 0.3 * F.least(n / 20, F.lit(1.0)) + 0.2 * F.least(F.length(c) / 200, F.lit(1.0)) + 0.2 * F.least(hits(c, r"\?") / 3, F.lit(1.0)) + 0.3 * F.least(special / 10, F.lit(1.0))


def length_band(c: Column) -> Column:
    n = F.size(words(c))
    return F.when(n <= 3, "short").when(n <= 8, "medium").otherwise("long")


#: Words of each type and category of query.
def query_type(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.rlike("count|sum|average|total"), "aggregation").when(low.rlike("search|find|look"), "search").when(low.rlike("get|retrieve|show"), "retrieval").otherwise("general")


def query_category(c: Column) -> Column:
    low = F.lower(F.trim(c))
    starts = lambda heads: reduce(lambda a, b: a | b, [F.startswith(low, F.lit(h)) for h in heads])
    return F.when(starts(["what", "how", "why", "when", "where", "who"]), "questions").when(starts(["show", "list", "find", "get"]), "commands").when(starts(["please", "can you", "could you"]), "requests").otherwise("other")


def numerals(c: Column) -> Column:
    return F.translate(c, PERSIAN_DIGITS, DIGITS)


def threat_score(c: Column, banned: list[str], patterns: list[str]) -> Column:
    low = F.lower(c)
    return reduce(lambda a, b: a + b, [F.when(F.length(c) > 1000, 0.3).otherwise(0.0), *[F.when(F.contains(low, F.lit(w)), 0.5).otherwise(0.0) for w in banned], *[F.when(c.rlike(p), 0.4).otherwise(0.0) for p in patterns]])


def overlap(a: Column, b: Column) -> Column:
    """Share of a's different words that b has."""
    x, y = word_set(a), word_set(b)
    return F.when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    x, y = word_set(a), word_set(b)
    return F.when(F.size(F.array_union(x, y)) > 0, F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)


def completeness(c: Column, expected: int) -> Column:
    return F.least(F.size(words(c)) / expected, F.lit(1.0))


def coherence(c: Column, indicators: list[str]) -> Column:
    found = held(c, indicators)
    sentences = F.filter(F.split(c, r"[.!?]+"), lambda s: F.trim(s) != "")
    mean = F.when(F.size(sentences) > 0, F.size(words(c)) / F.size(sentences)).otherwise(0.0)
    return 0.6 * F.least(found / 5, F.lit(1.0)) + 0.4 * F.least(mean / 20, F.lit(1.0))


def collapse(c: Column) -> Column:
    """What an embedder is given: trimmed, blanks collapsed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def keywords(c: Column, most: int = 16, least: int = 3) -> Column:
    """Different words of at least three characters in first-seen order."""
    return F.slice(F.array_distinct(F.filter(words(F.lower(c)), lambda w: F.length(w) >= least)), 1, most)


def truncated(c: Column, size: int) -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def word_prefix(c: Column, n: Column | int) -> Column:
    return F.array_join(F.slice(words(c), 1, n), " ")
