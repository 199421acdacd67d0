"""Texts to chunks, as Columns of arrays where the rule allows it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import hits, words

SIZE, OVERLAP = 358, 50
#: Rows of an Arrow batch that are Python objects at once.
AT_ONCE = 128


def token_chunks(c: Column, size: int = SIZE, overlap: int = OVERLAP, most: int | None = None) -> Column:
    """Windows of ``size`` words, each beginning ``size - overlap`` words after the last; a short text is one chunk.

    ``most``: the words behind so many chunks are left out; without it, none are."""
    step = size - min(overlap, size - 1)

    def cut(w: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(w) - size) / step).cast("int"))
        windows = F.transform(F.sequence(F.lit(0), last if most is None else F.least(last, F.lit(most - 1))), lambda i: F.array_join(F.slice(w, i * step + 1, size), " "))
        return F.when(F.size(w) <= size, F.array(c)).otherwise(windows)

    # By an array of one, so a text is split once and not once a window.
    return F.transform(F.array(words(c)), cut)[0]


def id_chunks(docs: DataFrame, doc_id: str, text: str, path: str, pattern: str, size: int = 512, overlap: int = 50) -> DataFrame:
    """(doc_id, chunk, first, n_tokens, content): windows of ``size`` ids of a byte-level vocabulary, each beginning
    ``size - overlap`` ids after the last; ``first`` is the place of its first id.  ``path`` names a file of ranks (a token in
    base 64 and its number a line), ``pattern`` how texts are split before merging.  A character that is cut in two becomes
    the replacement character on both sides.  A blank text has no chunk."""
    step = size - min(overlap, size - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            rows = []
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = coder.encode_ordinary(t) if t and t.strip() else []
                last = max(0, -(-(len(ids) - size) // step))
                rows += [(key, k, k * step, len(ids[k * step : k * step + size]), coder.decode(ids[k * step : k * step + size])) for k in range(last + 1 if ids else 0)]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 5, kinds, strict=True)], names=["id", "chunk", "first", "n_tokens", "content"])

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, "id long, chunk int, first long, n_tokens long, content string").withColumnRenamed("id", doc_id)


def chunk_id(doc: Column, index: Column, size: int, overlap: int) -> Column:
    return F.substring(F.md5(F.concat_ws("_", doc.cast("string"), index.cast("string"), F.lit(str(size)), F.lit(str(overlap)))), 1, 12)


def chunk_estimate(n: Column, size: int, overlap: int) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor((n - overlap) / (size - overlap)))


def paragraphs(c: Column) -> Column:
    return F.filter(F.split(c, r"\n\s*\n"), lambda p: F.trim(p) != "")


def sentences(c: Column, least: int = 8) -> Column:
    return F.filter(F.transform(F.split(c, r"(?<=[.!?。！？؟])\s+"), lambda s: F.trim(s)), lambda s: F.length(s) >= least)


def section_titles(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?m)^##+\s+(.+)$"), 1)


def document_title(c: Column) -> Column:
    return F.regexp_extract(c, r"(?m)^#\s+(.+)$", 1)


def clean(c: Column) -> Column:
    return F.rtrim(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), r"[ \t]+", " "))


def boundary_trim(c: Column, share: float = 0.7) -> Column:
    """Cut behind the last sentence end, if it lies beyond this share of the chunk."""
    head = F.regexp_extract(c, r"(?s)^(.*[.!?。！？؟؛،])(?:\s|$)", 1)
    return F.when(F.length(head) > share * F.length(c), head).otherwise(c)


#: Words that tell running prose.
PROSE = ["است", "بود", "می‌شود", "خواهد", "کرد", "شد"]


def analysis(c: Column) -> dict[str, Column]:
    """Length, words, sentences, paragraphs, and two scores from 0 to 1: headings, list marks and bars by 1000 characters,
    and prose words by ten words."""
    n, parts = F.size(words(c)), F.size(paragraphs(c))
    marks = hits(c, r"(?m)^#+\s+") + hits(c, r"(?m)^\s*[-*+]\s+") + hits(c, r"\|")
    prose = sum((hits(c, w) for w in PROSE[1:]), hits(c, PROSE[0]))
    structure = F.least(F.lit(1.0), marks / F.greatest(F.length(c) / 1000.0, F.lit(1.0)))
    return {"length": F.length(c), "n_words": n, "n_sentences": hits(c, r"[.!?]+"), "n_paragraphs": parts, "structure": structure, "semantic": F.least(F.lit(1.0), prose / (F.greatest(n, F.lit(1)) / 10.0))}


def strategy(length: Column, structure: Column, semantic: Column) -> Column:
    return F.when(structure > 0.3, "hierarchical").when(semantic > 0.7, "semantic").when(length > 5000, "hybrid").otherwise("token")


def quality(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Bands of chunk sizes around the target, and a score of them."""
    n = F.length(text)
    share = lambda test: F.avg(test.cast("double"))
    ends = share(F.col(text).rlike(r"[.!?]\s*$"))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("chunks"), F.sum((n < 400).cast("int")).alias("small"), F.sum(n.between(400, 600).cast("int")).alias("optimal"), F.sum((n > 600).cast("int")).alias("large"), F.round(0.7 * share(n.between(400, 600)) + 0.3 * ends, 3).alias("score"))


def merged(pieces: list[str], least: int = 400, most: int = 600) -> list[str]:
    """The optimiser's fold: short pieces join the one before, long ones are cut in the middle at a sentence."""
    out: list[str] = []
    for piece in pieces:
        if out and len(piece) < least and len(out[-1]) + len(piece) + 1 <= most:
            out[-1] = f"{out[-1]}\n{piece}"
            continue
        while len(piece) > most:
            cut = piece.rfind(". ", 0, most)
            cut = cut + 1 if cut > 0 else most
            out.append(piece[:cut])
            piece = piece[cut:].lstrip()
        if piece:
            out.append(piece)
    return out


def rows_of_texts(docs: DataFrame, made: Callable[[object], Iterable[tuple]], **kinds: str) -> DataFrame:
    """Rows of ``made`` for each value of the second column of ``docs``, behind its key in the first; ``kinds`` names their
    columns.  Only AT_ONCE values of a batch are Python objects at once, however long a batch is."""
    key = docs.columns[0]
    arrow = {"int": pa.int32(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                part = b.slice(at, AT_ONCE)
                rows = [(d, *row) for d, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for row in made(value)]
                columns = list(zip(*rows, strict=True)) or [[]] * (len(kinds) + 1)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, [pa.int64(), *(arrow[k] for k in kinds.values())], strict=True)], names=["key", *kinds])

    ddl = ", ".join(f"{n} {k}" for n, k in kinds.items())
    return docs.select(F.col(key).cast("long").alias("key"), docs.columns[1]).mapInArrow(run, f"key long, {ddl}").withColumnRenamed("key", key)


def optimised(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, chunk, content): paragraphs folded to chunks near the target size."""
    pieces = docs.select(doc_id, F.filter(F.split(text, "\n"), lambda p: F.trim(p) != "").alias("pieces"))
    return rows_of_texts(pieces, lambda ps: enumerate(merged(ps or [])), chunk="int", content="string")
