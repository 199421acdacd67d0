"""Null, empty and very long texts, ties, repeated rows, empty tables and clashing columns: every operator, every stage."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import bpe, idstore, infill, licenses, media, merkle, packing, quality, repeats, rules, simhash, suffix_tree, toxicity

CLASH = ("key", "kept", "root", "score", "ids", "first", "words", "runs", "place", "group", "path", "n", "form", "output", "frame", "h", "label", "value")


def rows():
    draw = random.Random(11)
    words = [f"{p}{k}" for k in range(60) for p in ("al", "be", "gé")]
    text = lambda n: " ".join(draw.choices(words, k=n))
    long_ = text(60_000) + "\n" + "letters" * 20_000
    made = [None, "", " \t\n", "one", text(30), text(30), long_, "tie tie", "tie tie", "mit license " + text(25)]
    made += [text(draw.randrange(20, 120)) for _ in range(30)]
    # The last of them stand twice, the very last with one id.
    out = [(i, t) for i, t in enumerate(made)] + [(90, made[-1]), (91, made[-2]), (92, made[-3]), (92, made[-3])]
    return [(i, t, "en", f"s{i % 3}", None if t is None else len(t), 1) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long, quality int").repartition(4)
    return df.withColumns({c: F.lit(3) for c in CLASH})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 2 == 0), int(i % 5 == 0)) for i in range(40)] + [(3, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")


def operators(labels):
    """What each operator makes of documents: rows with doc_id."""
    return {
        "media": lambda d: media.read_back(*media.store(d)),
        "repeats": repeats.remove,
        "quality": lambda d: quality.classify(d, labels),
        "simhash": simhash.near_duplicates,
        "suffix tree": suffix_tree.score,
        "licenses": licenses.scan,
        "toxicity": lambda d: toxicity.classify(d, labels),
        "bpe": lambda d: bpe.digests(bpe.decode(bpe.encode(d))),
        "rules": rules.judge,
        "infill": lambda d: infill.digests(infill.restore(infill.transform(d))),
        "merkle": merkle.verified,
        "token files": lambda d: idstore.digests(idstore.read(d.sparkSession, idstore.write(d))),
    }


@pytest.mark.parametrize("name", list(operators(None)))
def test_operators_take_all_rows(spark, docs, labels, name):
    run = operators(labels)[name]
    got = run(docs).collect()
    ids = sorted(r.doc_id for r in got)
    assert ids == sorted(r[0] for r in rows())
    # Rows of equal texts have equal values, but for what tells where they are.
    where = {"doc_id", "held_out", "component_id", "shard", "offset", "start", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "text", "output_sha256", "prefix_chars", "middle_chars", "form", *CLASH, "spans", "source", "seen"}
    if name not in ("merkle", "suffix tree"):
        by = {}
        for r in got:
            by.setdefault(r.doc_id, []).append({k: v for k, v in r.asDict().items() if k not in where})
        assert by[92][0] == by[92][1] and by[7][0] == by[8][0], name
    assert run(docs.limit(0)).count() == 0


def test_packing_takes_all_rows(docs):
    got = packing.pack(docs).collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows()}
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + len(r.ids) // 4
    # Twice the tokens for the id that two equal rows share.
    assert total[92] == 2 * next(r.doc_tokens for r in got if r.doc_id == 92) and total[0] == total[1] == 1
    assert packing.pack(docs.limit(0)).count() == 0


def test_long_texts_are_read_to_their_end(spark):
    """What stands behind two megabytes counts."""
    filler = "plain words of no meaning " * 80_000
    texts = [filler + "released under the mit license", filler, filler + "#" * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    assert [r.base_labels for r in licenses.scan(df).orderBy("doc_id").collect()] == ["mit", "", ""]
    assert [r.n_symbols for r in rules.judge(df).orderBy("doc_id").collect()] == [0, 0, 9]
    scores = {r.doc_id: r.n_tokens for r in suffix_tree.score(df).collect()}
    assert scores == {i: len(t.split()) + 1 for i, t in enumerate(texts)}
    (r,) = media.read_back(*media.store(df.filter("doc_id = 0"))).collect()
    raw = texts[0].encode()
    padded = raw + bytes(-len(raw) % 64)
    assert (r.n_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


def test_a_phrase_that_repeats_far_inside_long_texts(spark):
    """A passage over the seams of pieces, and one text that repeats itself throughout."""
    draw = random.Random(5)
    fresh = lambda n: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    passage = fresh(900)
    a, b = fresh(repeats.PIECE - 450) + passage + fresh(2000), fresh(700) + passage + fresh(300_000)
    unit = fresh(3000)
    df = spark.createDataFrame([(1, a), (2, b), (3, unit * 400), (4, fresh(5000))], "doc_id long, text string")
    got = {r.doc_id: r for r in repeats.remove(df).collect()}
    assert bytes(got[1].kept).decode() == a.replace(passage, "") and bytes(got[2].kept).decode() == b.replace(passage, "")
    assert bytes(got[3].kept) == b"" and bytes(got[4].kept).decode() == df.filter("doc_id = 4").first().text


@pytest.mark.parametrize("k", range(5))
def test_stages_take_all_rows(spark, docs, labels, tmp_path, k):
    """Each stage by itself: nothing breaks, columns stay, clean documents of a kind that it doesn't look for stay."""
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, str(tmp_path))
    kept = [r.doc_id for r in out.collect()]
    assert set(kept) <= {r[0] for r in rows()} and kept, name
    if name != "packing":
        assert out.columns == docs.columns, name
    if name == "SimHash near-dedup":
        assert 90 not in kept and 91 not in kept and kept.count(92) == 0 and {39, 38, 37} <= set(kept)
        assert sum(i in kept for i in (0, 1, 2)) == 1
    if name in ("suffix-array dedup", "packing"):
        assert set(kept) == {r[0] for r in rows()}
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
