"""Ordered folds over the sentences of a text: semantic and hierarchical chunks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import word_set
from skein.operators.chunkers import rows_of_texts, sentences


def grouped(parts: list[str], least: float) -> list[list[int]]:
    """Greedy groups: a sentence joins the first open group with a member of that word overlap; groups may interleave.

    Only sentences that share a word can overlap, so members are found by an inverted index of the text's words; equal
    sets of words are one entry, which stands for the earliest of their groups.  Sets without words overlap with none.
    """
    if least <= 0:
        return [list(range(len(parts)))] if parts else []
    groups: list[list[int]] = []
    home_of: list[int] = []
    sizes: list[int] = []
    index: dict[str, list[int]] = {}
    # Entry of each set, and how many changes of the entries it has met.
    met: dict[frozenset, tuple[int, int]] = {}
    changes = 0
    for i, part in enumerate(parts):
        w = frozenset(part.lower().split())
        entry, seen = met.get(w, (None, -1))
        if entry is not None and seen == changes and least <= 1:
            groups[home_of[entry]].append(i)
            continue
        shared = Counter(chain.from_iterable(index[x] for x in w if x in index))
        home = min((home_of[k] for k, n in shared.items() if n / (len(w) + sizes[k] - n) >= least), default=len(groups))
        if home == len(groups):
            groups.append([])
        groups[home].append(i)
        if not w:
            continue
        if entry is None:
            entry = len(home_of)
            home_of.append(home)
            sizes.append(len(w))
            for x in w:
                index.setdefault(x, []).append(entry)
            changes += 1
        elif home < home_of[entry]:
            home_of[entry] = home
            changes += 1
        met[w] = entry, changes
    return groups


def semantic_chunks(docs: DataFrame, doc_id: str, text: str, least: float = 0.7, most_chars: int = 2000) -> DataFrame:
    """(doc_id, chunk, first, last, content): sentences grouped by similarity, in order of their first sentence."""

    def made(parts: list[str] | None) -> Iterator[tuple]:
        n = 0
        for g in grouped(parts or [], least):
            content = " ".join(parts[i] for i in g)
            for cut in range(0, max(1, len(content)), most_chars):
                yield n, g[0], g[-1], content[cut : cut + most_chars]
                n += 1

    return rows_of_texts(docs.select(doc_id, sentences(F.col(text)).alias("parts")), made, chunk="int", first="int", last="int", content="string")


def tree(text: str, small: int = 100, large: int = 2000) -> list[tuple[int, int, str]]:
    """(level, parent, content): title 1, sections 2, paragraphs 3, pieces of large paragraphs 4; small ones join."""
    out: list[tuple[int, int, str]] = []
    title = section = -1
    held = ""

    def flush() -> None:
        nonlocal held
        if held:
            parent = section if section >= 0 else title
            out.append((3, parent, held))
            own = len(out) - 1
            if len(held) > large:
                out.extend((4, own, held[k : k + large]) for k in range(0, len(held), large))
            held = ""

    for block in text.split("\n"):
        line = block.strip()
        if not line:
            continue
        if line.startswith("# "):
            flush()
            out.append((1, -1, line[2:].strip()))
            title, section = len(out) - 1, -1
        elif line.startswith("##"):
            flush()
            out.append((2, title, line.lstrip("# ").strip()))
            section = len(out) - 1
        else:
            held = f"{held}\n{line}" if held else line
            if len(held) >= small:
                flush()
    flush()
    return out


def hierarchical_chunks(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    made = lambda t: ((i, *node) for i, node in enumerate(tree(t or "")))
    return rows_of_texts(docs.select(doc_id, text), made, chunk="int", level="int", parent="int", content="string")


def folded_keywords(docs: DataFrame, doc_id: str, text: str, stop: list[str]) -> DataFrame:
    """(doc_id, keywords): accents folded, punctuation out, short and stop words out, then words and adjacent pairs."""
    import unicodedata

    @F.pandas_udf("string")
    def plain(s: pd.Series) -> pd.Series:
        strip = lambda t: unicodedata.normalize("NFKC", "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))
        return s.fillna("").map(strip)

    words = F.filter(F.split(F.regexp_replace(F.lower(plain(F.col(text))), r"[^\p{L}\p{N}]+", " "), " "), lambda w: (F.length(w) > 2) & ~w.isin(*stop))
    t = docs.select(doc_id, words.alias("w"))
    pairs = F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return t.select(doc_id, F.array_distinct(F.concat("w", pairs)).alias("keywords"))


def shared_words(a, b):
    return F.array_intersect(word_set(a), word_set(b))
