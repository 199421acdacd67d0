import math
import random
import zlib
from collections import Counter

import pytest

from skein.llm import suffix_tree


def brute(rows):
    words = {i: ((t or "").encode().lower().split()) for i, t in rows}
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 != 0]
    c = Counter(w for i in train for w in words[i])
    ends = len(train)
    total, different = sum(c.values()) + ends, len(c) + (ends > 0)
    z = total + 0.1 * (different + 1)
    out = {}
    for i, ws in words.items():
        base = sum(math.log10((c[w] + 0.1) / z) for w in ws) + math.log10((ends + 0.1) / z)
        out[i] = (len(ws) + 1, sum(c[w] > 0 for w in ws) + (ends > 0), total, base)
    return out


def corpus():
    rng = random.Random(4)
    languages = [[f"{p}{k}é" for k in range(300)] for p in "xyz"]
    rows = [(0, None), (1, ""), (2, "Only"), (3, " only\tONLY é É ")]
    for i in range(4, 300):
        vocabulary = rng.choice(languages)
        rows.append((i, " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(300)], k=rng.randint(1, 400)))))
    return rows


@pytest.mark.parametrize("known", [100, 500_000])
def test_base_matches_brute_force_and_tree_helps(spark, monkeypatch, known):
    monkeypatch.setattr(suffix_tree, "KNOWN", known)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, h int, symbols string").repartition(3)
    got = {r.doc_id: r for r in suffix_tree.score(docs).collect()}
    want = brute(rows)
    for i, _ in rows:
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == want[i][:3]
        assert got[i].base_score == pytest.approx(want[i][3], rel=1e-9)
    held = [r for r in got.values() if r.held_out and r.n_tokens > 50]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held) * 0.97
    assert all(r.score < 0 and math.isfinite(r.score) for r in got.values())


def test_repeated_rows_and_no_training(spark):
    docs = spark.createDataFrame([(1, "a b a"), (1, "a b a"), (None, None)], "doc_id long, text string")
    rows = suffix_tree.score(docs).collect()
    assert len(rows) == 3 and len({r.base_score for r in rows if r.doc_id == 1}) == 1
    assert suffix_tree.score(docs.limit(0)).count() == 0


def test_distributions_sum_to_one(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    counts = suffix_tree.cut_lineage(suffix_tree.count_words(docs))
    model = suffix_tree.unigrams(counts, 270)
    tree = suffix_tree.grow(suffix_tree.cut_lineage(suffix_tree.symbolise(docs, model)), model)
    assert len(tree.probabilities) > 10
    assert tree.probabilities.sum(axis=1) == pytest.approx(1.0)


def brute_words(rows, classes_of, known):
    """What the states over whole words add, position by position with plain dictionaries."""
    texts = {i: ["<"] * 3 + (t or "").encode().lower().split() for i, t in rows}
    train = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 != 0}
    share = Counter()
    for w, c in known.items():
        if w in classes_of:
            share[classes_of[w]] += c + 0.1
    unigram = {w: (known[w] + 0.1) / share[classes_of[w]] for w in classes_of}
    spots = [(i, (tuple(ws[k - 2 : k]), classes_of[ws[k]]), ws[k - 3], ws[k]) for i, ws in texts.items() for k in range(3, len(ws)) if ws[k] in classes_of]
    parent = [unigram[s[3]] for s in spots]
    for deeper in (False, True):
        state = [(s[1], s[2]) if deeper else s[1] for s in spots]
        total = Counter(k for k, s in zip(state, spots, strict=True) if s[0] in train)
        seen = Counter((k, s[3]) for k, s in zip(state, spots, strict=True) if s[0] in train)
        test = Counter()
        for k, s, p in zip(state, spots, parent, strict=True):
            if s[0] in train:
                test[k] += math.log((seen[k, s[3]] - 1 + 2 * p) / (total[k] - 1 + 2) / p)
        parent = [(seen[k, s[3]] + 2 * p) / (total[k] + 2) if total[k] >= 2 and test[k] > 2 else p for k, s, p in zip(state, spots, parent, strict=True)]
    out = Counter()
    for s, p in zip(spots, parent, strict=True):
        out[s[0]] += math.log10(p / unigram[s[3]])
    return out


@pytest.mark.parametrize("flush", [1 << 20, 500])
def test_word_states_match_brute_force(spark, monkeypatch, flush):
    import xxhash

    from skein.llm import word_states

    monkeypatch.setattr(word_states, "FLUSH", flush)
    rows = corpus()
    rng = random.Random(9)
    passage = " ".join(f"rare{rng.randint(0, 60)}" for _ in range(80))
    rows += [(1000 + k, passage if k % 2 else f"x1é {passage} z5é") for k in range(12)] + [(2000, passage + " " + passage)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, row int").repartition(3)
    got = {r.doc_id: r.score - r.base_score for r in suffix_tree.score(docs, share=2.0).collect()}
    known = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in (t or "").encode().lower().split())
    signed = {w: (h := xxhash.xxh64_intdigest(w, 42)) - (h >> 63 << 64) for w in known}
    others = sorted(known, key=lambda w: (-known[w], signed[w]))[512:]
    want = brute_words(rows, {w: zlib.crc32(w[-3:]) % 64 for w in others}, known)
    assert len(others) > 100 and sum(v > 1 for v in want.values()) > 5
    for i, _ in rows:
        assert got[i] == pytest.approx(want[i], abs=1e-4)


def test_states_grow_with_the_corpus_and_tell_copies(spark):
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randint(0, 4999)}" for _ in range(120)) for _ in range(400)]
    rows = [*enumerate(texts), *((1000 + k, texts[k]) for k in range(40))]
    got = {r.doc_id: r for r in suffix_tree.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    trained = [i for i, _ in rows if not got[i].held_out]
    gain = {i: (got[i].score - got[i].base_score) / got[i].n_tokens for i in trained}
    twice = [gain[i] for i in trained if i >= 1000 and not got[i - 1000].held_out]
    once = [gain[i] for i in trained if 40 <= i < 1000]
    assert min(twice) > max(once)


def brute_tree(rows, share=1e-3, depth=3):
    """What the states over symbols add to each text, with dictionaries and one context at a time."""
    import xxhash

    words = {i: (t or "").encode().lower().split() for i, t in rows}
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10]
    count = Counter(w for i in train for w in words[i])
    signed = {w: (h := xxhash.xxh64_intdigest(w, 42)) - (h >> 63 << 64) for w in count}
    symbol = {w: k for k, w in enumerate(sorted(count, key=lambda w: (-count[w], signed[w]))[:512])}
    told = lambda w: symbol.get(w, 512 + zlib.crc32(w[-3:]) % 64)
    end, begin = 576, 577
    total = sum(count.values()) + len(train)
    mass = Counter({512 + k: 0.1 / 64 for k in range(64)})
    for w, c in count.items():
        mass[told(w)] += c + 0.1
    mass[end] += len(train) + 0.1
    root = {s: m / sum(mass.values()) for s, m in mass.items()}
    texts = {i: [begin] * 3 + [told(w) for w in ws] + [end] for i, ws in words.items()}

    def follows(size):
        found = {}
        for i in train:
            for k in range(3, len(texts[i])):
                found.setdefault(tuple(texts[i][k - size : k]), Counter())[texts[i][k]] += 1
        return found

    # Contexts, oldest symbol first, whose followers differ from their longest proper suffix's.
    states, counted = {(): root}, {}
    for size in range(1, depth + 1):
        here = follows(size)
        for context, n in here.items():
            if size > 1 and (context[1:] not in states or counted.get(context[:-1], {}).get(context[-1], 0) < share * total):
                continue
            counted[context] = n
        for context in [c for c in counted if len(c) == size]:
            n, parent = counted[context], states[context[1:]]
            seen = sum(n.values())
            kinds = sum(p > 0 for p in parent.values()) - 1
            test = 2 * sum(c * math.log(c / seen / max(parent.get(s, 0.0), 1e-300)) for s, c in n.items())
            if seen >= share * total and test > kinds + 4 * math.sqrt(2 * kinds):
                states[context] = {s: (n[s] + 200 * p) / (seen + 200) for s, p in parent.items()}
    out = {}
    for i, text in texts.items():
        out[i] = 0.0
        for k in range(3, len(text)):
            held = ()
            for size in range(1, depth + 1):
                if tuple(text[k - size : k]) not in states:
                    break
                held = tuple(text[k - size : k])
            if root.get(text[k], 0) > 0 and states[held].get(text[k], 0) > 0:
                out[i] += math.log10(states[held][text[k]] / root[text[k]])
    others = {w: told(w) - 512 for w in count if w not in symbol}
    return out, brute_words(rows, others, count), len(states)


def test_the_whole_score_is_the_plain_one(spark):
    rng = random.Random(12)
    rows = corpus()
    # Words that call for what follows them, two and three back, so that longer contexts become states.
    for i in range(300, 420):
        text = []
        for _ in range(60):
            text += rng.choice([["x1é", "x2é", "y3é"], ["z1é", "x2é", "z9é"], ["y1é", "z1é", "x2é", "x5é"], [f"x{rng.randint(0, 299)}é"]])
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, state int").repartition(3)
    got = {r.doc_id: r.score - r.base_score for r in suffix_tree.score(docs).collect()}
    tree, deep, states = brute_tree(rows)
    assert states > 40 and len({round(v) for v in tree.values()}) > 20
    for i, _ in rows:
        assert got[i] == pytest.approx(tree[i] + deep[i], abs=2e-3), i
