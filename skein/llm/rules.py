"""Quality rules (operator 10): plain counts, then divergence from language references.  DataFrame functions only.

The base counts fail a text with under 20 words, or with over 30 words in 100 inside repeated 8-word windows.  The
others are judged by the Jensen-Shannon distance of two histograms to the nearest language reference: character
classes (seven) and common words (a fixed list per language, and all other words).  A reference is the sum of the
histograms of all documents of that ``lang``.  Short texts have noisy histograms, so each distance only counts from
its own minimum length on, and a text is rejected where one exceeds its limit.

Defined cases: a null or empty text has no words, fails the base and is not kept; a null or unknown ``lang``
contributes to no reference, and the text is judged like any other, as no text's own ``lang`` is looked at; without
any reference (an empty table, or unknown languages alone) the base decides; repeated rows are judged alike and
counted each; other columns are ignored; a very long text is read whole; of references at equal distance any gives the
same distance, so ties don't matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import BLANK, cut_lineage, row_key

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
#: From so many word characters and words on the histograms count, and the distances that are too far.
GUARD_CHARS = 200
GUARD_WORDS = 150
CLASS_LIMIT = 0.31
WORD_LIMIT = 0.27

#: Frequent words of each language.
COMMON = {
    "de": "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er so",
    "en": "the of and to in a is that it for on was be with as this by at are an from or which not have",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más o pero",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il",
}
#: Character classes, taken out of a text one after another; what is left then, ASCII symbols, is ``symbol``.
CLASSES = {"lower": "a-z", "blank": r"\x20\x09-\x0D", "stop": r".,;:!?'\"()-", "upper": "A-Z", "digit": "0-9", "other": r"\x80-\x{10FFFF}"}


def words() -> Column:
    return F.array_remove(F.split("text", f"{BLANK}+"), "")


def _repeats(docs: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words within 8-word windows that the text holds twice or more."""
    windows = F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<long>"))
    found = docs.withColumn("windows", windows).withColumn("again", F.size("windows") > F.size(F.array_distinct("windows")))
    ordered = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    found = found.withColumn("ordered", F.when(F.col("again"), ordered))
    near = lambda i, step: F.coalesce(F.try_element_at("ordered", i + 1 + step)["h"], F.lit(None))
    same = lambda x, i: F.coalesce(x["h"] == near(i, 1), F.lit(False)) | (F.when(i > 0, F.coalesce(x["h"] == near(i, -1), F.lit(False))).otherwise(False))
    found = found.withColumn("starts", F.sort_array(F.transform(F.filter("ordered", same), lambda x: x["i"])))
    reach = F.zip_with("starts", F.slice("starts", F.lit(2), F.greatest(F.size("starts"), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    total = F.aggregate(reach, F.lit(0), lambda n, x: n + x)
    return found.withColumn("n_repeat_words", F.when(F.col("again"), total).otherwise(0).cast("long")).drop("windows", "again", "ordered", "starts")


def _half(p: Column, r: Column) -> Column:
    """What one bin adds to twice the Jensen-Shannon divergence."""
    m = (p + r) / 2
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(r > 0, r * F.log2(r / m)).otherwise(0.0)


def class_counts(docs: DataFrame) -> DataFrame:
    """Adds the number of characters of each class, and ``symbols``, what no class takes.  Every step searches only
    what the steps before have left."""
    before = "text"
    for name, chars in CLASSES.items():
        docs = docs.withColumn(f"_{name}", F.regexp_replace(before, f"[{chars}]+", ""))
        docs = docs.withColumn(f"c_{name}", F.length(before) - F.length(f"_{name}"))
        before = f"_{name}"
    return docs.withColumns({"c_symbol": F.length(before), "symbols": F.col(before)}).drop(*[f"_{name}" for name in CLASSES])


def base(docs: DataFrame) -> DataFrame:
    """The rows (doc_id, lang, text) with their words, class counts and base counts.  Of the base counts two follow
    from the classes: word characters are all that aren't blank, and symbols are among what no class takes."""
    rows = _repeats(class_counts(docs).withColumn("words", words()))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumns(
        {
            "size": F.length("text"),
            "n_words": F.size("words").cast("long"),
            "word_chars": (F.length("text") - F.col("c_blank")).cast("long"),
            "n_symbols": F.length(F.regexp_replace("symbols", "[^#*$%&|<>]+", "")).cast("long"),
            "lines": lines,
        }
    )
    rows = rows.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines", "symbols")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def measured(docs: DataFrame) -> DataFrame:
    """One narrow row for each document: key, doc_id, lang, base counts, size, class counts, and ``bins``, its common
    words with how often it has them.  The texts are read once; everything else is made from these rows."""
    common = sorted({w for ws in COMMON.values() for w in ws.split()})
    # Sorted, so the end of each run of equal words tells how many there are.
    rows = base(docs).withColumn("ordered", F.sort_array(F.filter("words", lambda w: w.isin(*common))))
    ends = F.filter(F.transform("ordered", lambda w, i: F.when(F.coalesce(F.get("ordered", i + 1) != w, F.lit(True)), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("ends", ends)
    bins = F.transform("ends", lambda e, k: F.struct(F.get("ordered", e).alias("word"), (e - F.coalesce(F.when(k > 0, F.get("ends", k - 1)), F.lit(-1))).alias("n")))
    counts = [f"c_{n}" for n in (*CLASSES, "symbol")]
    return rows.select(row_key().alias("key"), "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "size", *counts, bins.alias("bins"))


def class_references(rows: DataFrame) -> DataFrame:
    """One row: for each language the shares of the character classes over all its documents."""
    share = lambda lang, name: F.sum(F.when(F.col("lang") == lang, F.col(f"c_{name}"))) / F.sum(F.when(F.col("lang") == lang, F.col("size")))
    return rows.agg(*[share(lang, n).alias(f"r_{lang}_{n}") for lang in COMMON for n in (*CLASSES, "symbol")])


def word_references(rows: DataFrame) -> DataFrame:
    """One row: ``shares``, a map from each common word to its share among all words of each language's documents
    (null for a language without words), and ``others``, the shares of all other words."""
    sums = rows.filter(F.col("lang").isin(*COMMON)).select("lang", F.explode(F.concat("bins", F.array(F.struct(F.lit("").alias("word"), F.col("n_words").cast("int").alias("n"))))).alias("b")).groupBy("b.word")
    sums = sums.agg(*[F.sum(F.when(F.col("lang") == lang, F.col("b.n"))).alias(f"n_{lang}") for lang in COMMON])
    totals = sums.filter("word = ''").select(*[F.col(f"n_{lang}").alias(f"t_{lang}") for lang in COMMON])
    shares = sums.filter("word <> ''").join(F.broadcast(totals)).select("word", *[(F.coalesce(F.col(f"n_{lang}"), F.lit(0)) / F.nullif(f"t_{lang}", F.lit(0))).alias(lang) for lang in COMMON])
    known = shares.agg(F.map_from_entries(F.collect_list(F.struct("word", F.struct(*COMMON)))).alias("shares"), F.struct(*[(1 - F.sum(lang)).alias(lang) for lang in COMMON]).alias("rest"))
    # Languages whose documents hold no common word at all have their whole mass in the other words.
    whole = totals.select(F.struct(*[F.when(F.col(f"t_{lang}") > 0, F.lit(1.0)).alias(lang) for lang in COMMON]).alias("whole"))
    filled = F.struct(*[F.coalesce(F.col("rest")[lang], F.col("whole")[lang]).alias(lang) for lang in COMMON])
    return known.join(F.broadcast(whole), how="left").select("shares", filled.alias("others"))


def _word_distance() -> Column:
    """Distance of a text's common-word histogram (``shared``: share in the text, and in each reference) to the nearest
    reference.  A word that the text doesn't hold adds its whole share of the reference, so the sum starts from all of
    these and what the text holds is taken off again."""
    total = F.aggregate("shared", F.lit(0.0), lambda a, b: a + b["p"])

    def divergence(lang: str) -> Column:
        others = F.col("others")[lang]
        reference = lambda b: F.coalesce(b["r"][lang], F.lit(0.0))
        every = F.aggregate("shared", 1 - others, lambda a, b: a + _half(b["p"], reference(b)) - reference(b))
        return every + _half(F.greatest(1 - total, F.lit(0.0)), others)

    return F.sqrt(F.greatest(F.least(*[divergence(lang) for lang in COMMON]) / 2, F.lit(0.0)))


def judge(docs: DataFrame, class_limit: float = CLASS_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """Every row's key, doc_id, base counts, the two distances and ``kept``."""
    names = [*CLASSES, "symbol"]
    # Narrow rows, used for both references and for the verdicts: written down, so that no text is read twice.
    rows = cut_lineage(measured(docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))))
    # The references are one row each, whatever the number of documents.
    told = rows.join(F.broadcast(class_references(rows))).join(F.broadcast(word_references(rows)))
    parts = lambda lang: [_half(F.col(f"c_{n}") / F.col("size"), F.col(f"r_{lang}_{n}")) for n in names]
    distance = lambda lang: F.sqrt(F.greatest(F.lit(0.0), reduce(lambda a, b: a + b, parts(lang)) / 2))
    told = told.withColumn("class_distance", F.when(F.col("size") > 0, F.least(*[distance(lang) for lang in COMMON])))
    told = told.withColumn("shared", F.transform("bins", lambda b: F.struct((b["n"] / F.col("n_words")).alias("p"), F.col("shares")[b["word"]].alias("r"))))
    told = told.withColumn("word_distance", F.when(F.col("n_words") > 0, _word_distance()))
    far = (F.col("word_chars") >= GUARD_CHARS) & (F.col("class_distance") > class_limit) | (F.col("n_words") >= GUARD_WORDS) & (F.col("word_distance") > word_limit)
    kept = ~F.col("base_failed") & ~F.coalesce(far, F.lit(False))
    return told.select("key", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", kept.alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns."""
    columns = [f"d{k}" for k in range(len(docs.columns))]
    inner = docs.toDF(*columns)
    named = {c: columns[docs.columns.index(c)] for c in ("doc_id", "text", "lang")}
    plain = inner.select(*[F.col(own).alias(c) for c, own in named.items()])
    # Keys and verdicts are set aside first: a filter on the verdict would copy the rules' nested expressions into itself.
    kept = cut_lineage(judge(plain).select("key", "kept")).filter("kept").select("key").distinct()
    keyed = inner.withColumns({"doc_id": F.col(named["doc_id"]), "text": F.coalesce(F.col(named["text"]), F.lit(""))}).withColumn("key", row_key())
    return keyed.join(kept, "key", "left_semi").select(*columns).toDF(*docs.columns)
