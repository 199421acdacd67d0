"""Byte-level BPE by forced-boundary splitting (operator 9).

A byte pair that occurs inside no token of the vocabulary can never be merged over, so a text may be cut between those
two bytes where the pre-tokenizer's matches on both sides stay the same.  :class:`ForcedBoundaryBpe` reads the pairs off
the vocabulary.  A text is cut before every space whose left neighbour stands before a space in no token (all but the
no-break space): a run of white space loses no match by it, as what is cut apart can't merge.  The fragments of a chunk of
texts are told apart by Arrow, each different one is encoded once, all of them in one call, and their ids are put
together again by position.  A fragment over LONG characters, as of a text without spaces, is cut further, at every such
pair of ASCII characters of different kinds (letter, digit, other; no apostrophe), where a match ends as well.

Defined cases: a null or empty text has no ids; repeated rows are encoded alike; other columns are ignored; an empty
table gives an empty result; a text with a no-break space before a space or with an added token is cut and encoded by itself; a very
long text is a chunk of its own; a text without any forced cut is one fragment; of pairs of equal rank the first merges, as
in the library.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import give_back, texts

#: Fixed value: how the byte-level vocabulary splits text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text whose fragments are told apart at once, and characters from which on a fragment is cut further.
CHUNK = 1 << 21
LONG = 64


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """The vocabulary file writes printable bytes as themselves and the others as the code points from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ForcedBoundaryBpe:
    """Encoder and decoder of one vocabulary file.  Made inside tasks; holds nothing of the input."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of_char = _byte_of_char()
        ranks = {bytes(of_char[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in of_char for c in token)}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        ranks = {token: i for token, i in ranks.items() if i not in self.added.values()}
        self.encoding = tiktoken.Encoding("forced", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=self.added)
        self.token_bytes = [b""] * (max([*ranks.values(), *self.added.values()]) + 1)
        for token, i in ranks.items():
            self.token_bytes[i] = token
        for token, i in self.added.items():
            self.token_bytes[i] = token.encode()
        self.sizes = np.array([len(t) for t in self.token_bytes], np.int64)
        inside = np.zeros((256, 256), bool)
        for token in ranks:
            if len(token) > 1:
                b = np.frombuffer(token, np.uint8)
                inside[b[:-1], b[1:]] = True
        self.never = ~inside
        # The characters that a token holds a space behind: no cut there.  Such a token must hold them whole.
        self.joined = {token[:i].decode()[-1] for token in ranks for i in range(1, len(token)) if token[i] == 0x20}
        if any(" " in t for t in self.added):
            raise ValueError("an added token holds a space: a forced cut could split it")
        self.before_space = re.compile(f"(?<![{re.escape(''.join(self.joined))}])(?= )" if self.joined else "(?= )")
        kind = np.zeros(256, np.uint8)
        for low, high, k in ((0x21, 0x7E, 3), (0x30, 0x39, 2), (0x41, 0x5A, 1), (0x61, 0x7A, 1)):
            kind[low : high + 1] = k
        kind[0x27] = 0
        self.certain = self.never & (kind[:, None] != kind[None, :]) & (kind[:, None] > 0) & (kind[None, :] > 0)

    def cuts(self, fragment: str) -> list[str]:
        """A long fragment, cut at every certain pair of ASCII characters."""
        b = np.frombuffer(fragment.encode(), np.uint8)
        at = [0, *(np.flatnonzero(self.certain[b[:-1], b[1:]]) + 1).tolist(), len(b)]
        return [bytes(b[i:j]).decode() for i, j in zip(at, at[1:], strict=False)]

    def encode_alone(self, text: str) -> np.ndarray:
        """Ids of one text, cut by itself."""
        if any(t in text for t in self.added):
            return np.array(self.encoding.encode(text, allowed_special="all"), np.uint32)
        parts = [p for f in self.before_space.split(text) for p in (self.cuts(f) if len(f) > LONG else [f])]
        return np.array([i for p in parts for i in self.encoding.encode_ordinary(p)], np.uint32)

    def _dictionary(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the fragments, a space before each piece, and how many ids each has."""
        sizes = pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        plain = (sizes > 1) & (sizes <= LONG)
        alone = {k: self.encode_alone(f" {pieces[k].as_py()}") for k in np.flatnonzero(~plain).tolist()}
        rest = pieces.filter(pa.array(plain))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(rest)], pa.int32()), rest), " ")[0].as_py()
        ids = self.encoding.encode_to_numpy(f" {joined}", disallowed_special=()).astype(np.uint32) if len(rest) else np.zeros(0, np.uint32)
        counts = np.zeros(len(pieces), np.int64)
        # Every fragment ends where a token ends: the cuts are forced.
        counts[plain] = np.diff(np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(sizes[plain]), side="right"), prepend=0)
        if not alone:
            return ids, counts
        for k, own in alone.items():
            counts[k] = len(own)
        pieces_of, at = [], 0
        ends = np.cumsum(np.where(plain, counts, 0))
        for k, own in alone.items():
            pieces_of += [ids[at : ends[k]], own]
            at = ends[k]
        return np.concatenate([*pieces_of, ids[at:]]), counts

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column after one another, and how many each text has."""
        texts = pc.fill_null(column.cast(pa.string()), "")
        odd = np.zeros(len(texts), bool)
        for part in [*self.added, *(f"{c} " for c in self.joined)]:
            odd |= pc.match_substring(texts, part).to_numpy(zero_copy_only=False)
        whole = {k: self.encode_alone(texts[k].as_py()) for k in np.flatnonzero(odd).tolist()}
        if whole:
            texts = pa.array(["" if k in whole else t for k, t in enumerate(texts.to_pylist())], pa.string())
        split = pc.split_pattern(texts, " ")
        starts = split.offsets.to_numpy()[:-1].astype(np.int64)
        pieces = split.flatten().dictionary_encode()
        ids, counts = self._dictionary(pieces.dictionary)
        fragment = pieces.indices.to_numpy().astype(np.int64)
        # What a text begins with has no space before it.
        firsts = [whole[k] if k in whole else np.array(self.encoding.encode_ordinary(t) if len(t) <= LONG else self.encode_alone(t), np.uint32) for k, t in enumerate(pieces.dictionary.take(pa.array(fragment[starts])).to_pylist())]
        fragment[starts] = len(counts) + np.arange(len(starts))
        counts = np.concatenate((counts, np.fromiter(map(len, firsts), np.int64, len(firsts))))
        ids = np.concatenate((ids, *firsts))
        begins = np.cumsum(counts) - counts
        sizes = counts[fragment]
        ends = np.cumsum(sizes)
        out = ids[np.repeat(begins[fragment] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return out, np.add.reduceat(sizes, starts) if len(starts) else np.zeros(0, np.int64)

    def encode_batches(self, batch: pa.RecordBatch, column: int, most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Slices of a batch of up to ``most`` rows and about CHUNK bytes, with their ids and the numbers of these."""
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + most], dtype=np.int64), CHUNK)))
            part = batch.slice(at, min(n, most))
            yield part, *self.encode_column(part.column(column))
            at += part.num_rows

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of one text."""
        return self.encode_column(pa.array([text]))[0].astype("<u4").tobytes()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, ForcedBoundaryBpe] = {}


def coder(path: str) -> ForcedBoundaryBpe:
    """The coder of this Python worker."""
    if path not in _loaded:
        _loaded[path] = ForcedBoundaryBpe(path)
    return _loaded[path]


#: Rows of one Arrow batch that an encoder returns.
OUT_ROWS = 1000


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every whole text."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for b in batches:
            for part, ids, counts in bpe.encode_batches(b, 1, OUT_ROWS):
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])
        give_back()

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of ``encoded`` (doc_id, ids) with their text."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for b in batches:
            for at in range(0, b.num_rows, OUT_ROWS):
                part = b.slice(at, OUT_ROWS)
                lists = part.column(1)
                flat, ends = lists.flatten().to_numpy().tolist(), np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).tolist()
                yield pa.record_batch([part.column(0), lists, pa.array([bpe.decode(flat[s:e]) for s, e in zip(ends, ends[1:])], pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, text string")


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("text"), 256).alias("decoded_sha256"),
    )
