"""HTML and Markdown as Columns: main content, metadata, headings, links and normalised text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are dropped with all they hold, and the entities that are told.
DROPPED = ["script", "style", "nav", "footer", "header", "noscript", "iframe", "object"]
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def unescape(c: Column) -> Column:
    for entity, char in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def without_blocks(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    for tag in DROPPED:
        c = F.regexp_replace(c, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "")
    return c


def main_html(c: Column) -> Column:
    """The first of main, article and section that a page has, else its body."""
    first = None
    for tag in ("main", "article", "section", "body"):
        found = F.regexp_extract(c, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
        first = F.when(found != "", found) if first is None else first.when(found != "", found)
    return first.otherwise(c)


def content(c: Column) -> Column:
    """Text of the main part, one line for each run between tags."""
    inner = main_html(without_blocks(c))
    return normalised(unescape(F.regexp_replace(inner, r"<[^>]+>", "\n")))


def normalised(c: Column) -> Column:
    """LF line ends, lines stripped, one blank line at most between lines."""
    lines = F.transform(F.split(F.regexp_replace(c, "\r\n?", "\n"), "\n"), lambda x: F.trim(x))
    return F.trim(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))


def title(c: Column) -> Column:
    return F.trim(unescape(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def meta(c: Column, name: str) -> Column:
    return unescape(F.regexp_extract(c, rf'(?is)<meta\s+(?:name|property)="{name}"\s+content="([^"]*)"', 1))


def language(c: Column) -> Column:
    return F.regexp_extract(c, r'(?is)<html[^>]*\blang="([^"]*)"', 1)


def headings(c: Column) -> Column:
    """(level, text) in order of level, then of place."""
    of = lambda n: F.transform(F.regexp_extract_all(c, F.lit(rf"(?is)<h{n}[^>]*>(.*?)</h{n}>"), 1), lambda t: F.struct(F.lit(n).alias("level"), F.regexp_replace(F.trim(t), r"<[^>]+>", "").alias("text")))
    return F.concat(*[of(n) for n in range(1, 7)])


def links(c: Column, most: int = 200) -> Column:
    """Different link targets in first-seen order."""
    return F.slice(F.array_distinct(F.regexp_extract_all(c, F.lit(r'(?i)<a\s[^>]*href="([^"]+)"'), 1)), 1, most)


def images(c: Column, most: int = 200) -> Column:
    found = F.regexp_extract_all(c, F.lit(r'(?i)<img\s[^>]*src="([^"]+)"'), 1)
    return F.slice(F.filter(found, lambda s: ~F.startswith(s, F.lit("data:"))), 1, most)


def absolute(base: Column, link: Column) -> Column:
    """A link against its page's address: absolute, from the root, or beside the page."""
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"/[^/]*$", "/")
    return F.when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), link).when(F.startswith(link, F.lit("/")), F.concat(root, link)).otherwise(F.concat(folder, link))


def marked_headings(c: Column) -> Column:
    for n in range(1, 7):
        c = F.regexp_replace(c, rf"(?is)<h{n}[^>]*>(.*?)</h{n}>", "\n" + "#" * n + " $1\n")
    return c


def markdown_metadata(c: Column) -> dict[str, Column]:
    count = lambda p: F.regexp_count(c, F.lit(p))
    return {"headings": count(r"(?m)^#{1,6}\s+\S"), "links": count(r"\[[^\]]*\]\([^)]+\)"), "images": count(r"!\[[^\]]*\]\([^)]+\)"), "bullets": count(r"(?m)^\s*[-*+]\s+"), "numbers": count(r"(?m)^\s*[0-9]+\.\s+"), "quotes": count(r"(?m)^>\s?"), "table_rows": count(r"(?m)^\|.*\|\s*$"), "code_blocks": F.floor(count("(?m)^```") / 2)}


def markdown_text(c: Column) -> Column:
    """Control characters out, blanks and line breaks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), r"[ \t]+", " "), r"\s*\n\s*", "\n"))


#: Loader of each extension.
FORMATS = {"txt": "text", "md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "pdf": "pdf", "docx": "docx", "pptx": "pptx", "xlsx": "xlsx"}


def loader_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,10})$", 1))
    out = F.when(path.rlike("^https?://"), "url")
    for e, kind in FORMATS.items():
        out = out.when(ext == e, kind)
    return out.otherwise("text")


def row_text(columns: list[str], number: Column) -> Column:
    """A table row as 'row n: name=value, ...' without missing and blank values."""
    parts = [F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in columns]
    return F.concat(F.lit("row "), number.cast("string"), F.lit(": "), F.array_join(F.array_compact(F.array(*parts)), ", "))


def page_metadata(c: Column) -> dict[str, Column]:
    """What the head of a page says of it; empty where it says nothing."""
    found = lambda pattern: F.regexp_extract(c, pattern, 1)
    named = lambda key, name: found(rf'<meta[^>]*{key}="{name}"[^>]*content="([^"]*)"')
    return {
        "lang": found(r'<html[^>]*\slang="([^"]*)"'),
        "title": found(r"(?is)<title[^>]*>(.*?)</title>"),
        "canonical": found(r'<link[^>]*rel="canonical"[^>]*href="([^"]*)"'),
        "description": named("name", "description"),
        "og_title": named("property", "og:title"),
        "robots": named("name", "robots"),
    }
