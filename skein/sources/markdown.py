"""Markdown to plain text: each run of text between marks on a line of its own, as a reader of the rendered page takes it.

A text is one row from end to end: its lines are an array, and are put together again, with carriage returns between them,
before the marks inside lines are read, so no line is a row and nothing is shuffled.  Fences are paired by an ordered fold over their marks alone (a closing mark is of the same
character, at least as long, and bare); tables are runs of lines with bars that hold a separator line.  Then every line is
told by itself: what a fence holds stays as it is but for the blanks around it, block marks go, cells and inline marks
part the text.  An image says nothing, a link says its text, an escaped character itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.sources.html import unescape

FENCE = r"^ {0,3}(`{3,}|~{3,})(.*)$"
RULE = r"^\s*(?:([-*_])(?:\s*\1){2,}|=+|-{2,})\s*$"
SEPARATOR = r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$"
DEFINITION = r"^ {0,3}\[[^\]]+\]:\s+\S+.*$"
#: Fixed value: the characters that a backslash makes plain.
ESCAPED = "\\`*_{}[]()#+-.!|>"
#: Stand-ins for them while marks are read, from the private area.
STAND_INS = "".join(chr(0xE000 + ord(c)) for c in ESCAPED)
#: White space at the ends of a text, and stand-ins (no characters) for that of fenced lines, which keep all but blanks.
WHITE = "\t\x0b\x0c\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
KEPT = "".join(chr(0xFDD0 + k) for k in range(len(WHITE)))
#: Lines of a run with bars that holds a separator: b is a line with a bar, s a separator.
TABLE = r"(?:\G(?!^)|(?<![bs])(?=b*+s))[bs]"


def fences(lines: Column) -> Column:
    """(a, b) of each fence: the numbers of its marks; one that isn't closed ends behind the last line."""
    kind = "struct<a:int,b:int>"
    some = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda m: F.contains(m["x"], F.lit("```")) | F.contains(m["x"], F.lit("~~~")))
    marks = F.filter(F.transform(some, lambda m: F.struct(m["i"].alias("i"), F.regexp_extract(m["x"], FENCE, 1).alias("mark"), F.trim(F.regexp_extract(m["x"], FENCE, 2)).alias("said"))), lambda m: m["mark"] != "")
    start = F.struct(F.lit("").alias("open"), F.lit(-1).alias("a"), F.array().cast(f"array<{kind}>").alias("held"))

    def step(s: Column, m: Column) -> Column:
        closes = (F.substring(s["open"], 1, 1) == F.substring(m["mark"], 1, 1)) & (F.length(m["mark"]) >= F.length(s["open"])) & (m["said"] == "")
        # What stands behind an opening mark of backticks holds none.
        opens = ~((F.substring(m["mark"], 1, 1) == "`") & F.contains(m["said"], F.lit("`")))
        closed = F.struct(F.lit("").alias("open"), F.lit(-1).alias("a"), F.array_append(s["held"], F.struct(s["a"].alias("a"), m["i"].alias("b"))).alias("held"))
        opened = F.struct(m["mark"].alias("open"), m["i"].alias("a"), s["held"].alias("held"))
        return F.when((s["open"] == "") & opens, opened).when((s["open"] != "") & closes, closed).otherwise(s)

    def finish(s: Column) -> Column:
        return F.when(s["open"] == "", s["held"]).otherwise(F.array_append(s["held"], F.struct(s["a"].alias("a"), F.lit(2**31 - 1).alias("b"))))

    return F.aggregate(marks, start, step, finish)


def _where(c: Column, mark: str, pattern: str) -> Column:
    """Text whose pattern is looked for only where its mark stands; by an array of one, so the text is made once."""
    return F.transform(F.array(c), lambda t: F.when(F.contains(t, F.lit(mark)), F.regexp_replace(t, pattern, "\n$2\n")).otherwise(t))[0]


def _prose(c: Column) -> Column:
    """Lines without code spans: marks become line ends; none reaches over a carriage return."""
    c = F.regexp_replace(c, r"<!--.*?-->|!\[[^\]\r]*\](?:\([^)\r]*\)|\[[^\]\r]*\])", "\n")
    c = F.regexp_replace(c, r"\[([^\]\r]*)\](?:\([^)\r]*\)|\[[^\]\r]*\])", "\n$1\n")
    c = F.regexp_replace(c, r"<((?:https?://|mailto:)[^>\s]+|[\w.+-]+@[\w.-]+)>", "\n$1\n")
    c = F.regexp_replace(c, r"</?[A-Za-z][^>\r]*>", "\n")
    for _ in range(3):
        c = _where(c, "*", r"(\*{1,3})(?=[^\s*])(.+?)(?<=[^\s*])\1")
        c = _where(c, "_", r"(?U)(?=_)(?<!\w)(_{1,3})(?=[^\s_])(.+?)(?<=[^\s_])\1(?!\w)")
    return unescape(c)


def inline(c: Column) -> Column:
    """Array of the texts of lines (with carriage returns between them): code spans as they are, the rest by its marks."""
    for char, other in zip(ESCAPED, STAND_INS, strict=True):
        c = F.replace(c, F.lit("\\" + char), F.lit(other))
    # Code spans, between marks of one length; a mark without another is text.  No line holds a line end so far.
    parts = F.split(F.regexp_replace(c, r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", "\n$2\n"), "\n", -1)
    told = F.transform(parts, lambda p, i: F.when((i % 2 == 1) | ~p.rlike(r"[*_\[<&]"), p).otherwise(_prose(p)))
    texts = F.transform(F.split(F.array_join(told, "\n"), "[\r\n]"), lambda t: F.btrim(t, F.lit(" \r\n" + WHITE)))
    back = lambda t: F.when(t.rlike(r"[\x{E000}-\x{E0FF}\x{FDD0}-\x{FDEF}]"), F.translate(t, STAND_INS + KEPT, ESCAPED + WHITE)).otherwise(t)
    return F.transform(F.filter(texts, lambda t: t != ""), back)


def _block(c: Column) -> Column:
    """A line without the marks of quotes, lists and headings before it."""
    bare = F.regexp_replace(c, r"^(?:\s*>\s?)+", "")
    bare = F.regexp_replace(bare, r"^(?:\s*(?:[-*+]|\d{1,9}[.)])\s+)+", "")
    headless = F.regexp_replace(bare, r"^\s*#{1,6}(?:\s+|$)", "")
    headless = F.when(headless == bare, bare).otherwise(F.regexp_replace(headless, r"(?:^|\s+)#+\s*$", ""))
    return F.when(c.rlike(r"^\s*[>\-*+\d#]"), headless).otherwise(c)


def _kinds(held: Column, n: Column) -> Column:
    """Array of a letter a line: m a fence's mark, c what a fence holds, p anything else."""
    many = lambda letter, k: F.array_repeat(F.lit(letter), k.cast("int"))
    start = F.concat(F.array(F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b"))), held)
    each = F.zip_with(F.slice(start, 1, F.size(held)), held, lambda last, f: F.concat(many("p", f["a"] - last["b"] - 1), many("m", F.lit(1)), many("c", F.least(f["b"], n) - f["a"] - 1), many("m", (f["b"] < n).cast("int"))))
    upto = F.get(F.slice(start, -1, 1), F.lit(0))["b"]
    return F.concat(F.flatten(each), many("p", F.greatest(n - upto - 1, F.lit(0))))


def to_text(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, text): the plain text of each row; a null or empty text is empty."""
    held = docs.select(*keys, F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|\r|\n", -1).alias("_lines"))
    held = held.withColumn("_fences", fences(F.col("_lines")))
    bar = lambda x: F.contains(x, F.lit("|"))
    told = F.zip_with("_lines", _kinds(F.col("_fences"), F.size("_lines")), lambda x, k: F.when((k != "p") | ~bar(x), k).when(x.rlike(SEPARATOR), "s").otherwise("b"))
    # Runs of lines with bars; those that hold a separator are tables.
    told = F.regexp_extract_all(F.regexp_replace(F.array_join(told, ""), TABLE, "t"), F.lit("."), F.lit(0))
    gone = lambda x, k: (k == "m") | ((k == "t") & x.rlike(SEPARATOR)) | (x.rlike(r"^\s*[-*_=\[]") & (x.rlike(RULE) | x.rlike(DEFINITION)))
    # A fenced line has no mark left, and stands where code does.
    code = lambda x: F.concat(F.lit("\n"), F.translate(F.trim(x), ESCAPED + WHITE, STAND_INS + KEPT), F.lit("\n"))
    cells = lambda x: F.replace(F.replace(x, F.lit("\\|"), F.lit(STAND_INS[ESCAPED.index("|")])), F.lit("|"), F.lit("\r"))
    lines = F.zip_with("_lines", told, lambda x, k: F.when(k == "c", code(x)).when(gone(x, k), "").when(k == "t", cells(x)).otherwise(_block(x)))
    return held.select(*keys, F.array_join(inline(F.array_join(lines, "\r")), "\n").alias("text"))
