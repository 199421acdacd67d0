"""Fill-in-the-middle transformation (operator 11): a rope is cut at two unit ranks and its parts change places.

Units are runs of ASCII letters and single other code points.  A text is a rope: leaves hold up to LEAF units and know
how many units and code points they have, inner nodes know the sums, so a cut at a unit rank goes down one path and makes
new nodes along it alone.  The parts are concatenated with the sentinels as leaves of their own; nothing is copied before
the leaves are written out.  :func:`restore` makes a rope of the output, cuts it around the sentinels by rank and
concatenates the parts in their first order.

Defined cases: a null or empty text is plain and empty, with no units; a text that holds a sentinel is plain; a null id
counts as the empty text in the hash; rows that share an id stay rows of their own, equal ids and texts are cut alike, and
cuts at one rank leave an empty middle; other columns are ignored; an empty table gives an empty result; a very long text
is many leaves, a very long run of letters one leaf, as no unit is cut.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import as_bytes, chunks, give_back, texts

#: Fixed values of the output format.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of a hundred texts, those that are transformed, and of these those with the suffix first.
RATE = 90
SUFFIX_FIRST = 20
#: Units of a leaf.
LEAF = 512


class Rope:
    """An immutable rope over UTF-8.  A leaf has ``data`` and the byte offsets at which its units start."""

    __slots__ = ("left", "right", "data", "starts", "units", "chars")

    def __init__(self, left=None, right=None, data: bytes = b"", starts=(), chars: int | None = None) -> None:
        self.left, self.right, self.data, self.starts = left, right, data, starts
        if left is None:
            self.units = len(starts)
            self.chars = sum(b & 0xC0 != 0x80 for b in data) if chars is None else chars
        else:
            self.units, self.chars = left.units + right.units, left.chars + right.chars

    def __add__(self, other: Rope) -> Rope:
        return other if not self.units else self if not other.units else Rope(self, other)

    def split(self, rank: int) -> tuple[Rope, Rope]:
        """The first ``rank`` units, and the others."""
        if rank <= 0:
            return EMPTY, self
        if rank >= self.units:
            return self, EMPTY
        if self.left is None:
            at = int(self.starts[rank])
            head = Rope(data=self.data[:at], starts=self.starts[:rank])
            return head, Rope(data=self.data[at:], starts=self.starts[rank:] - at, chars=self.chars - head.chars)
        if rank <= self.left.units:
            a, b = self.left.split(rank)
            return a, b + self.right
        a, b = self.right.split(rank - self.left.units)
        return self.left + a, b

    def leaves(self) -> Iterator[bytes]:
        held = [self]
        while held:
            node = held.pop()
            if node.left is None:
                yield node.data
            else:
                held += (node.right, node.left)

    def __bytes__(self) -> bytes:
        return b"".join(self.leaves())


EMPTY = Rope()
_SENTINEL = {s: Rope(data=s, starts=np.arange(3)) for s in (PREFIX, SUFFIX, MIDDLE)}


def _balanced(leaves: list[Rope]) -> Rope:
    if len(leaves) <= 1:
        return leaves[0] if leaves else EMPTY
    half = len(leaves) // 2
    return Rope(_balanced(leaves[:half]), _balanced(leaves[half:]))


def ropes(held: list[bytes]) -> Iterator[tuple[bytes, Rope, np.ndarray]]:
    """Each text with its rope and the byte offsets of its units; the units of all are told apart at once."""
    flat = np.frombuffer(b"".join(held), np.uint8)
    ends = np.cumsum([len(t) for t in held], dtype=np.int64)
    letter = ((flat | 32) - 97).astype(np.uint8) < 26
    first = flat & 0xC0 != 0x80
    begins = first.copy()
    begins[1:] &= ~(letter[1:] & letter[:-1])
    inner = ends[:-1][ends[:-1] < len(flat)]
    begins[inner] = True
    at = np.flatnonzero(begins)
    chars = np.concatenate(([0], np.cumsum(first)))
    bounds = np.searchsorted(at, np.concatenate(([0], ends)))
    base = 0
    for k, text in enumerate(held):
        starts = at[bounds[k] : bounds[k + 1]] - base
        cuts = [*starts[::LEAF].tolist(), len(text)]
        leaves = [Rope(data=text[i:j], starts=starts[n * LEAF : (n + 1) * LEAF] - i, chars=int(chars[base + j] - chars[base + i])) for n, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False))]
        yield text, _balanced(leaves), starts
        base += len(text)


def draws(doc_id: int | None) -> tuple[int, ...]:
    """Four unsigned 32-bit numbers of an id."""
    return struct.unpack(">4I", hashlib.sha256(b"1:" + (b"" if doc_id is None else str(doc_id).encode())).digest()[:16])


def rearranged(doc_id: int | None, text: bytes, rope: Rope, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[str, int | None, int | None, bytes]:
    """Form, code points of prefix and middle, and the output."""
    h1, h2, h3, h4 = draws(doc_id)
    if not text or h3 % 100 >= rate or any(s in text for s in _SENTINEL):
        return "plain", None, None, text
    low, high = sorted((h1 % (rope.units + 1), h2 % (rope.units + 1)))
    rest, suffix = rope.split(high)
    prefix, middle = rest.split(low)
    p, s, m = (_SENTINEL[x] for x in (PREFIX, SUFFIX, MIDDLE))
    if h4 % 100 < suffix_first:
        return "spm", prefix.chars, middle.chars, bytes(s + suffix + p + prefix + m + middle)
    return "psm", prefix.chars, middle.chars, bytes(p + prefix + s + suffix + m + middle)


def original(form: str, output: bytes, rope: Rope, starts: np.ndarray) -> bytes:
    """The text of an output; ValueError where the sentinels of its form are missing."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    places = [0 if output.startswith(first) else -1, output.find(second, 3), output.find(MIDDLE, 3)]
    if min(places) < 0 or places[1] > places[2]:
        raise ValueError(f"an output of form {form} lacks a sentinel")
    # From the back on, so that the ranks of what is left stay as they are.
    parts = []
    for rank in reversed(np.searchsorted(starts, places).tolist()):
        rope, behind = rope.split(rank)
        parts.append(behind.split(3)[1])
    middle, b, a = parts
    prefix, suffix = (b, a) if form == "spm" else (a, b)
    return bytes(prefix + middle + suffix)


def transform(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and the output of every whole text."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in chunks(zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True)):
                rows = [(i, rope.units, *rearranged(i, text, rope, rate, suffix_first)) for (i, _), (text, rope, _) in zip(part, ropes([t for _, t in part]), strict=True)]
                made = [pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)]
                yield pa.record_batch([*made[:-1], made[-1].cast(pa.string())], names=names)
        give_back()

    return texts(docs).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(made: DataFrame) -> DataFrame:
    """The rows of ``made`` (any columns, with form and output) with the text rebuilt from these two as ``restored``."""
    columns = [f"c{k}" for k in range(len(made.columns))]
    inner, form, output = made.toDF(*columns), made.columns.index("form"), made.columns.index("output")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for part in chunks(zip(b.column(form).to_pylist(), [t or b"" for t in as_bytes(b.column(output))], strict=True)):
                found = [original(f or "plain", *rope) for (f, _), rope in zip(part, ropes([t for _, t in part]), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.slice(at, len(part)).columns, pa.array(found, pa.binary()).cast(pa.string())], names=[*columns, "restored"])
                at += len(part)
        give_back()

    return inner.mapInArrow(run, ", ".join(f"{c} {inner.schema[c].dataType.simpleString()}" for c in columns) + ", restored string").toDF(*made.columns, "restored")


def digests(restored: DataFrame) -> DataFrame:
    return restored.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
