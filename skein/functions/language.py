"""Languages by rank-ordered character n-grams, and a vote of three parts of a text.

A profile is the TOP most frequent n-grams of a language's texts, of one to three characters with a blank at word ends.  A
text's distance to it is the sum, over the text's own most frequent n-grams, of how far they are from their place in the
profile (TOP for one that isn't there).  Profiles are fitted on at most SAMPLE labelled rows, told by a hash of their key.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP = 300
SAMPLE = 400
#: Characters of a part at least; the parts of a longer text are thirds.
PART = 2000


class _Letters(dict):
    """A character's number by itself if it is a letter, else a blank's."""

    def __missing__(self, c: int) -> int:
        self[c] = c if chr(c).isalpha() else 32
        return self[c]


_LETTERS = _Letters()


@lru_cache(1 << 15)
def _grams_of(word: str) -> tuple[str, ...]:
    padded = f" {word} "
    return tuple(g for size in (1, 2, 3) for i in range(len(padded) - size + 1) if (g := padded[i : i + size]) != " ")


def grams(text: str) -> Counter:
    """N-grams of the words of a text, folded to lower case; what isn't a letter parts words."""
    found: Counter = Counter()
    once: list[str] = []
    for word, n in Counter(text.lower().translate(_LETTERS).split()).items():
        # A long word's would fill the memory of words seen before.
        own = _grams_of(word) if len(word) <= 24 else _grams_of.__wrapped__(word)
        if n == 1:
            once += own
        else:
            for g in own:
                found[g] += n
    found.update(once)
    return found


def ranks(found: Counter) -> dict[str, int]:
    least = sorted(found.values(), reverse=True)[TOP - 1] if len(found) > TOP else 0
    kept = sorted(g for g, n in found.items() if n >= least)
    # By count, and by themselves where the counts are equal: the second sort leaves that order.
    return {g: i for i, g in enumerate(sorted(kept, key=found.__getitem__, reverse=True)[:TOP])}


def parts(text: str) -> list[str]:
    """Beginning, middle and end, which cover the text together."""
    n = len(text)
    size = max(PART, -(-n // 3))
    middle = max(0, n // 2 - size // 2)
    return [text[:size], text[middle : middle + size], text[max(0, n - size) :]]


def nearest(found: Counter, profiles: dict[str, dict[str, int]]) -> str | None:
    own = ranks(found)
    if not own or not profiles:
        return None
    distance = {}
    for lang, p in profiles.items():
        total = 0
        for g, i in own.items():
            j = p.get(g)
            total += TOP if j is None else i - j if i > j else j - i
        distance[lang] = total
    return min(sorted(distance), key=distance.get)


def vote(text: str, profiles: dict[str, dict[str, int]]) -> str | None:
    """The language of most parts; a tie goes to the earlier part.  None for a text without letters."""
    said = parts(text)
    if len(text) <= PART:
        said = said[:1]
    votes = [x for p in said if (x := nearest(grams(p), profiles))]
    return Counter(votes).most_common(1)[0][0] if votes else None


def sampled(key: str, of: int, rows: int) -> Column:
    """Whether a row is drawn: about ``of`` of ``rows``, by a hash of the key."""
    return F.pmod(F.xxhash64(F.lit("language"), F.col(key)), F.lit(1 << 20)) < F.lit(min(1.0, of / max(1, rows)) * (1 << 20))


def fitted(docs: DataFrame, key: str, text: str, label: str) -> dict[str, dict[str, int]]:
    """A profile for each label of the sample: TOP rows a label come to the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(grams(t or ""))
        rows = [(lang, g, n) for lang, c in held.items() for g, n in c.items()]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "gram", "n"])

    drawn = docs.filter(sampled(key, SAMPLE, docs.count()) & F.col(label).isNotNull()).limit(2 * SAMPLE).select(label, text)
    totals = drawn.mapInArrow(counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    placed = totals.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1).filter(F.col("rank") < TOP)
    profiles: dict[str, dict[str, int]] = {}
    for r in placed.collect():
        profiles.setdefault(r.lang, {})[r.gram] = r["rank"]
    return profiles


def voted(docs: DataFrame, text: str, profiles: dict[str, dict[str, int]]) -> DataFrame:
    """Rows with ``language``, null where no letter stands; whole texts are read."""
    columns = [f"c{k}" for k in range(len(docs.columns))]
    inner, place = docs.toDF(*columns), docs.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [vote(t or "", sent.value) for t in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.string())], names=[*columns, "language"])

    kinds = ", ".join(f"{c} {inner.schema[c].dataType.simpleString()}" for c in columns)
    return inner.mapInArrow(run, f"{kinds}, language string").toDF(*docs.columns, "language")
