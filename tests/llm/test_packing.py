import random
from collections import defaultdict

import numpy as np
import pytest

from skein.llm import bpe, packing


def test_fill_places_every_token_once():
    rng = random.Random(1)
    for n in (0, 1, 2, 60):
        lengths = [rng.choice([1, 3, 40, 900, 2048, 5000]) for _ in range(n)]
        pieces = list(packing.fill(lengths, lambda seed, unused: np.array([d for d in rng.sample(range(n), n) if unused[d]][:5], int)))
        sequences, documents = defaultdict(list), defaultdict(list)
        for doc, start, length, sequence, offset in pieces:
            sequences[sequence].append((offset, length))
            documents[doc].append((start, length))
        for of, total in ((sequences, None), (documents, lengths)):
            for k, parts in of.items():
                at = 0
                for start, length in sorted(parts):
                    assert start == at and length > 0
                    at += length
                if total:
                    assert at == total[k]
                else:
                    assert at == 2048 or at & (at - 1) == 0
        assert sorted(documents) == list(range(n))


def test_pack_matches_the_tokenizer(spark):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    texts = [None, "", "x", *(" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "été", "x1"], k=rng.randint(1, 3000))) for _ in range(40))]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, offset int").repartition(3)
    got = defaultdict(list)
    for r in packing.pack(docs).collect():
        got[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
    plain = Tokenizer.from_file(bpe.vocabulary_path())
    for i, t in enumerate(texts):
        want = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        assert [x for _, ids, _ in sorted(got[i]) for x in ids] == want
        assert {n for _, _, n in got[i]} == {len(want)}
    assert packing.pack(docs.limit(0)).count() == 0


def test_neighbours_are_the_best_by_score():
    docs = [np.array(x) for x in ([5, 6, 7], [5, 6, 9], [8, 9, 10], [5, 5, 11], [7])]
    held = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=12)
    index = packing.Bm25Shard(docs, held, 5, 2.6)
    ranked = index.neighbours(0, np.array([False, True, True, True, True])).tolist()
    scores = {}
    for d in range(1, 5):
        s = 0
        for t in (5, 6, 7):
            tf = (docs[d] == t).sum()
            s += np.log1p((5 - held[t] + 0.5) / (held[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[d]) / 2.6))
        scores[d] = s
    assert ranked == sorted((d for d in scores if scores[d] > 0), key=lambda d: -scores[d])


@pytest.mark.parametrize("text", ["", " ", "  ", "a  b", " a", "a ", "a \n b", "é  è ", "\n\n", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>  c", "日本 語　 x", "it's 's  'll", "a\x85 b", "\x00 \x01", "🙂 🙂🙂  .", "a\t b", "１ ２ ٣", "é f", "x" * 3000, "x1-y2,z" * 900, "中文字符" * 500, "a\u00a0 b", "à la", "a   b", " \u00a0 \u00a0 x"])
def test_forced_cuts_agree_with_the_tokenizer(text):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(bpe.vocabulary_path())
    coder = bpe.ForcedBoundaryBpe(bpe.vocabulary_path())
    want = plain.encode(text, add_special_tokens=False).ids
    ids = np.frombuffer(coder.encode(text), "<u4").tolist()
    assert ids == want
    assert coder.decode(ids) == plain.decode(want, skip_special_tokens=False)


def test_columns_of_texts_agree_with_the_tokenizer():
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = random.Random(4)
    parts = ["a", "b", "  ", " ", "\n", "é", "à", "中", "'s", "'", "1", "2", ".", "-", "\t", " ", "<|endoftext|>", "the", "\u00a0", " ", "   ", "\r\n", "x" * 70]
    texts = [None, *("".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(3000))]
    ids, counts = bpe.ForcedBoundaryBpe(bpe.vocabulary_path()).encode_column(pa.array(texts))
    want = [e.ids for e in Tokenizer.from_file(bpe.vocabulary_path()).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_a_long_fragment_is_cut():
    coder = bpe.ForcedBoundaryBpe(bpe.vocabulary_path())
    assert len(coder.cuts("ab12,cd;" * 50)) > 100


def test_ties_go_to_the_earlier_document():
    docs = [np.array([5, 6, 7])] * 60 + [np.array([5, 8])] * 40
    held = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=9)
    index = packing.Bm25Shard(docs, held, len(docs), 2.6)
    unused = np.ones(len(docs), bool)
    unused[[3, 4]] = False
    assert index.neighbours(1, unused).tolist() == [0, 2, *range(5, 5 + packing.NEIGHBOURS - 2)]


def test_the_index_is_asked_until_no_neighbour_is_left():
    # 40 neighbours of the first seed, three at a time, before the others.
    kin = [0, *range(20, 60)]
    asked = lambda seed, unused: np.array([d for d in kin if unused[d]][:3] if seed in kin else [], int)
    order = [doc for doc, start, *_ in packing.fill([10] * 70, asked) if start == 0]
    assert order[:41] == kin


def test_equal_texts_have_equal_keys_and_empty_ones_the_largest():
    ids = np.array([5000, 70, 6000, 5000, 70, 6000], np.uint32)
    first, second = packing.lexical_key(ids, np.array([3, 0, 3, 0]))
    assert first[0] == first[2] and second[0] == second[2] and first[1] == first[3] == 2**63 - 1
