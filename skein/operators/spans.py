"""Places inside texts as rows: matches, sentences and token windows with their offsets, unions of intervals, look-ups of
a position among intervals, and chunks whose ends stay out of protected places.

Rows carry numbers, not text: a text is read by regular expressions in the JVM, its pieces are numbered, and windows over
these numbers give offsets, in characters from 0.  An interval is [start, stop).  ``keys`` names the columns that tell texts
apart; a text is one row of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.chunkers import token_chunks

#: What may not be cut: a heading, a table mark, a fenced block, a line with tabs.
HEADING = r"(?m)^#{1,6} .*$"
PROTECTED = r"(?m)^[ \t]*\[Table\].*$|^[ \t]*```[\s\S]*?```|^.*\t.*$"
#: What separates sentences; the first that does so in a text is taken.
SENTENCE = [r"(?<=[.!?])\s+(?=[A-Z])", r"(?<=[。！？])\s*", r"(?<=[.!?])\s+(?=\S)", r"(?<=[\x{061F}\x{061B}\x{060C}])\s+"]
#: Characters that a chunk keeps at least when its end moves back.
LEAST = 10


def _until(keys: list[str], *order: str):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def _before(keys: list[str], *order: str):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def matches(docs: DataFrame, keys: list[str], text: str, pattern: str) -> DataFrame:
    """(keys, n, start, stop) of every match of a pattern that matches no empty string."""
    gaps = F.transform(F.split(F.col(text), pattern, -1), F.length)
    found = F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), F.length)
    rows = docs.select(*keys, F.posexplode(F.arrays_zip(gaps.alias("gap"), found.alias("size"))).alias("n", "x")).filter("x.size IS NOT NULL")
    stop = F.sum(F.col("x.gap") + F.col("x.size")).over(_until(keys, "n"))
    return rows.select(*keys, "n", stop.alias("stop"), F.col("x.size").alias("_size")).select(*keys, "n", (F.col("stop") - F.col("_size")).alias("start"), "stop")


def protected(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, start, stop, kind): headings and blocks that no chunk may cut."""
    return matches(docs, keys, text, HEADING).withColumn("kind", F.lit("heading")).unionByName(matches(docs, keys, text, PROTECTED).withColumn("kind", F.lit("block"))).drop("n")


def union(spans: DataFrame, keys: list[str], start: str = "start", stop: str = "stop") -> DataFrame:
    """The intervals of each key that cover the same, each as long as can be; those that touch become one."""
    far = F.max(stop).over(_before(keys, start, stop))
    islands = spans.withColumn("_new", (far.isNull() | (F.col(start) > far)).cast("int")).withColumn("_island", F.sum("_new").over(_until(keys, start, stop)))
    return islands.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(stop).alias(stop)).drop("_island")


def last_before(points: DataFrame, at: str, intervals: DataFrame, keys: list[str], start: str, values: list[str], inclusive: bool) -> DataFrame:
    """Points with ``values`` of the interval of their key that starts last before them (``inclusive``: or at them).

    Both are put in one order and read once, so a text with many points and many intervals meets no pair of them."""
    point = points.select(*keys, F.col(at).alias("_at"), F.lit(1 if inclusive else 0).alias("_turn"), F.struct(*points.columns).alias("_point"), F.lit(None).cast(intervals.select(F.struct(*values)).schema[0].dataType).alias("_value"))
    interval = intervals.select(*keys, F.col(start).alias("_at"), F.lit(0 if inclusive else 1).alias("_turn"), F.lit(None).cast(point.schema["_point"].dataType).alias("_point"), F.struct(*values).alias("_value"))
    seen = F.last("_value", ignorenulls=True).over(_until(keys, "_at", "_turn"))
    both = point.unionByName(interval).withColumn("_seen", seen).filter("_point IS NOT NULL")
    return both.select("_point.*", *[F.col(f"_seen.{v}").alias(v if v not in points.columns else f"{v}_of") for v in values])


def token_windows(docs: DataFrame, keys: list[str], text: str, size: int, overlap: int) -> DataFrame:
    """(keys, chunk, start, stop): windows of ``size`` words that begin ``size - overlap`` words after one another; white
    space belongs to the word behind it, that at the end to the last window.  A text without words has none."""
    step = size - min(overlap, size - 1)
    # A window is ``whole`` blocks of ``step`` words and the first ``rest`` words of the next block.
    whole, rest = divmod(size, step)
    word = r"[ \t\n\r\x0B\f]*+[^ \t\n\r\x0B\f]++"
    blocks = F.regexp_extract_all(F.col(text), F.lit(f"(?:{word}){{1,{step}}}+"), F.lit(0))
    head = lambda b: F.length(F.regexp_extract(b, f"^(?:{word}){{1,{rest}}}+", 0)) if rest else F.lit(0)
    sized = F.transform(blocks, lambda b: F.struct(F.length(b).alias("size"), head(b).alias("head")))
    rows = docs.select(*keys, F.length(text).alias("_length"), F.posexplode(sized).alias("chunk", "x")).select(*keys, "chunk", "_length", "x.*")
    upto, following = F.sum("size").over(_until(keys, "chunk")), Window.partitionBy(*keys).orderBy("chunk")
    rows = rows.withColumns({"_upto": upto, "_head": F.lead("head", whole).over(following), "_next": F.lead("size", whole).over(following), "_after": F.lead("size", whole + 1).over(following)})
    rows = rows.withColumn("_full", F.lead("_upto", whole - 1).over(following))
    # The last window's end is the text's; of windows that end there the first is enough.
    last = F.col("_next").isNull() | ((F.col("_head") == F.col("_next")) & F.col("_after").isNull())
    rows = rows.withColumn("_last", last).withColumn("stop", F.when(F.col("_last"), F.col("_length")).otherwise(F.col("_full") + F.col("_head")))
    rows = rows.withColumn("_over", F.lag("_last").over(following)).filter("NOT coalesce(_over, false)")
    return rows.select(*keys, "chunk", (F.col("_upto") - F.col("size")).alias("start"), F.col("stop").cast("long").alias("stop"))


def kept_whole(windows: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Windows whose ends lie inside no span: a start moves back to where the span begins, a stop as well if more than
    LEAST characters are left, else forward to its end.  Windows that lie in the one before them go; what windows cover
    stays covered.  Numbered anew."""
    ends = windows.select(*keys, "chunk", F.explode(F.array(F.struct(F.lit("a").alias("which"), F.col("start").alias("at")), F.struct(F.lit("b").alias("which"), F.col("stop").alias("at")))).alias("x")).select(*keys, "chunk", "x.*")
    held = last_before(ends, "at", union(spans, keys), keys, "start", ["start", "stop"], inclusive=False)
    inside = F.coalesce(F.col("at") < F.col("stop"), F.lit(False))
    of = lambda which, c: F.max(F.when(F.col("which") == which, c))
    sides = held.groupBy(*keys, "chunk").agg(of("a", F.when(inside, F.col("start")).otherwise(F.col("at"))).alias("_a"), of("b", F.col("at")).alias("_b"), of("b", F.when(inside, F.col("start"))).alias("_s"), of("b", F.when(inside, F.col("stop"))).alias("_e"))
    moved = sides.select(*keys, F.col("_a").alias("start"), F.when(F.col("_s").isNull(), F.col("_b")).when(F.col("_s") > F.col("_a") + LEAST, F.col("_s")).otherwise(F.col("_e")).alias("stop"))
    far = F.max("stop").over(_before(keys, "start", F.desc("stop")))
    new = moved.dropDuplicates().withColumn("_far", far).filter("_far IS NULL OR stop > _far").drop("_far")
    return new.withColumn("chunk", (F.row_number().over(Window.partitionBy(*keys).orderBy("start")) - 1).cast("int"))


def contents(chunks: DataFrame, docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Chunks with their text."""
    return chunks.join(docs.select(*keys, F.col(text).alias("_text")), keys).withColumn("content", F.substring(F.col("_text"), (F.col("start") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int"))).drop("_text")


def protected_chunks(docs: DataFrame, keys: list[str], text: str, size: int, overlap: int) -> DataFrame:
    """(keys, chunk, start, stop, content): token windows that cut no heading, table or fence."""
    return contents(kept_whole(token_windows(docs, keys, text, size, overlap), protected(docs, keys, text), keys), docs, keys, text)


def sentences(docs: DataFrame, keys: list[str], text: str, least: int = 8) -> DataFrame:
    """(keys, sentence, start, stop) of the sentences of at least ``least`` characters without the blanks around them.  Of
    the patterns the first that splits a text counts; a text that none splits is one sentence."""
    split = [F.split("_text", f"(?U){p}", -1) for p in SENTENCE]
    how = F.lit(None).cast("int")
    parts, between = F.array("_text"), F.array().cast("array<string>")
    for k in reversed(range(len(SENTENCE))):
        how = F.when(F.size(split[k]) > 1, k).otherwise(how)
    for k, pattern in enumerate(SENTENCE):
        parts = F.when(F.col("_how") == k, split[k]).otherwise(parts)
        between = F.when(F.col("_how") == k, F.regexp_extract_all("_text", F.lit(f"(?U){pattern}"), F.lit(0))).otherwise(between)
    bare = lambda c: F.length(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    sizes = F.zip_with(parts, between, lambda part, gap: F.struct(F.length(part).alias("size"), bare(part).alias("bare"), F.coalesce(F.length(gap), F.lit(0)).alias("gap")))
    rows = docs.select(*keys, F.col(text).alias("_text")).withColumn("_how", how).select(*keys, F.posexplode(sizes).alias("sentence", "x"))
    start = F.coalesce(F.sum(F.col("x.size") + F.col("x.gap")).over(_before(keys, "sentence")), F.lit(0))
    placed = rows.withColumn("start", start).withColumn("stop", F.col("start") + F.col("x.size")).filter(F.col("x.bare") >= max(1, least))
    return placed.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("sentence")) - 1).alias("sentence"), "start", "stop")


def split_at_spans(members: DataFrame, spans: DataFrame, keys: list[str], group: str, order: str) -> DataFrame:
    """Members (keys, group, order, start, stop) of groups, with their groups cut wherever a span begins or ends between
    two neighbours: ``part`` numbers a group's parts from 0."""
    edges = spans.select(*keys, F.explode(F.array("start", "stop")).alias("edge"))
    seen = last_before(members, "start", edges, keys, "edge", ["edge"], inclusive=True)
    own = [*keys, group]
    cut = F.coalesce((F.col("edge") >= F.lag("stop").over(Window.partitionBy(*own).orderBy(order))).cast("int"), F.lit(0))
    return seen.withColumn("_cut", cut).withColumn("part", F.sum("_cut").over(_until(own, order))).drop("_cut", "edge")


def sized(chunks: DataFrame, keys: list[str], order: list[str], least: int, most: int, overlap: int = 0) -> DataFrame:
    """(keys, chunk, start, stop, tokens, content): chunks of under half of ``least`` words join the one before, those of
    over ``most`` are cut into windows of words; numbered anew.  Cut ones keep the place of the whole."""
    n = F.size(F.filter(F.split("content", r"\s+"), lambda w: w != ""))
    at = Window.partitionBy(*keys).orderBy(*order)
    counted = chunks.withColumn("_n", n).withColumn("_k", F.row_number().over(at))
    new = ((F.col("_n") >= max(1, int(least * 0.5))) | (F.col("_k") == 1)).cast("int")
    homes = counted.withColumn("_home", F.sum(new).over(at.rowsBetween(Window.unboundedPreceding, 0)))
    held = homes.groupBy(*keys, "_home").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.array_sort(F.collect_list(F.struct("_k", "content"))).alias("_all"))
    first, tail = F.col("_all")[0]["content"], F.transform(F.slice("_all", 2, F.greatest(F.size("_all") - 1, F.lit(1))), lambda x: F.ltrim(x["content"]))
    cut = held.select(*keys, "_home", "start", "stop", tail.alias("_tail"), first.alias("_first")).withColumn("_cut", token_chunks(F.col("_first"), most, overlap)).select(*keys, "_home", "start", "stop", "_tail", F.posexplode("_cut").alias("_piece", "content"), F.size("_cut").alias("_pieces"))
    whole = cut.withColumn("content", F.when((F.col("_piece") == F.col("_pieces") - 1) & (F.size("_tail") > 0), F.concat_ws(" ", F.rtrim("content"), F.array_join("_tail", " "))).otherwise(F.col("content")))
    number = (F.row_number().over(Window.partitionBy(*keys).orderBy("_home", "_piece")) - 1).alias("chunk")
    return whole.select(*keys, number, "start", "stop", n.alias("tokens"), "content")


def paged(chunks: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks with the first and the last page that they touch; ``pages`` (keys, page, start, stop) lie after one another,
    with gaps or without.  A chunk in a gap has none."""
    at = Window.partitionBy(*keys).orderBy("start")
    # For what ends where a page does, the page after it counts; before any page ends, the first.
    marks = pages.select(*keys, "stop", F.lead("page").over(at).alias("after"), F.lead("start").over(at).alias("after_start"))
    opening = pages.groupBy(*keys).agg(F.lit(-1).cast("long").alias("stop"), F.min_by("page", "start").alias("after"), F.min("start").alias("after_start"))
    first = last_before(chunks.withColumn("_end", F.col("stop") - 1), "start", marks.unionByName(opening), keys, "stop", ["after", "after_start"], inclusive=True)
    both = last_before(first, "_end", pages, keys, "start", ["page"], inclusive=True)
    touched = F.col("after_start") < F.col("stop")
    return both.select(*chunks.columns, F.when(touched, F.col("after")).alias("first_page"), F.when(touched, F.col("page")).alias("last_page"))


def pages_of(docs: DataFrame, keys: list[str], text: str, lines: int) -> DataFrame:
    """(keys, page, start, stop): every ``lines`` lines of a text are a page."""
    rows = docs.select(*keys, F.posexplode(F.transform(F.split(F.col(text), "\n", -1), F.length)).alias("line", "size"))
    placed = rows.withColumn("stop", F.sum(F.col("size") + 1).over(_until(keys, "line")))
    return placed.groupBy(*keys, F.floor(F.col("line") / lines).alias("_page")).agg(F.min(F.col("stop") - F.col("size") - 1).alias("start"), F.max("stop").alias("stop")).select(*keys, (F.col("_page") + 1).alias("page"), "start", "stop")
