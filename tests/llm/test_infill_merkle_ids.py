"""Operators 11 to 13 against plain versions, and the cases that their docstrings define."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import bpe, idstore, infill, merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, place long, path string, `group` string"
TEXTS = [None, "", "x", "<P> inside", "a<", "abc def\n\tghi", "é" * 40 + " naïve ßtraße ☃🙂 end", "same text", "same text", "Long Words and 123 more. " * 9000, "letters" * 30000, "<<S <M P> S>", "  "]


def docs(spark, rows):
    """Rows with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, s, "en", None if t is None else len(t), t, 7, "p", "g") for i, s, t in rows], SCHEMA).repartition(3)


def many():
    draw = random.Random(4)
    made = ["".join(draw.choice(["a", "Bc", " ", "<", "P", "S>", "é", "\n", "word"]) for _ in range(draw.randrange(60))) for _ in range(300)]
    return [(i, draw.choice([None, "", "hot", "hot", "hot", "b", "ß"]), t) for i, t in enumerate([*TEXTS, *made])]


def plain_infill(doc_id, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(b"1:" + (b"" if doc_id is None else str(doc_id).encode())).hexdigest()
    h = [int(h[k : k + 8], 16) for k in range(0, 32, 8)]
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_infill_is_the_plain_one(spark):
    rows = [*many(), (None, "a", "no id at all"), (5, "a", "another with id five")]
    got = sorted(tuple(r) for r in infill.transform(docs(spark, rows)).withColumn("doc_id", F.coalesce("doc_id", F.lit(-1))).collect())
    assert [(*x[:3], x[3], x[4], x[5]) for x in got] == sorted(((-1 if i is None else i), *plain_infill(i, t or "")) for i, _, t in rows)
    assert {x[2] for x in got} == {"plain", "psm", "spm"}


def test_infill_is_undone(spark):
    rows = many()
    made = infill.transform(docs(spark, rows), rate=100, suffix_first=50).withColumn("leaf", F.lit(1))
    back = {r.doc_id: r.restored for r in infill.restore(made).collect()}
    assert back == {i: t or "" for i, _, t in rows}
    with pytest.raises(ValueError):
        infill.original("psm", b"nothing here", *[x for x in infill.ropes([b"nothing here"])][0][1:])
    assert infill.digests(infill.restore(infill.transform(docs(spark, rows).limit(0)))).count() == 0


def test_ropes_split_anywhere():
    text = ("words and 1 more, é☃ " * 200).encode()
    ((_, rope, _),) = infill.ropes([text])
    units = [u.encode() for u in re.findall(r"[A-Za-z]+|[^A-Za-z]", text.decode())]
    assert rope.units == len(units) and rope.chars == len(text.decode()) and rope.left is not None
    for rank in (0, 1, infill.LEAF - 1, infill.LEAF, infill.LEAF + 1, len(units) - 1, len(units), len(units) + 5):
        a, b = rope.split(rank)
        assert bytes(a) == b"".join(units[:rank]) and bytes(a + b) == text
        assert a.units + b.units == rope.units and a.chars == len(bytes(a).decode()) and a.chars + b.chars == rope.chars


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_merkle(rows):
    """{doc_id: (leaf, subroot, root, proof, folded, verified)} of rows with ids of their own."""
    said = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda i, s, t: sha(said(i) + said(s) + said("en") + said(None if t is None else len(t)) + said(t))
    lower = lambda t: None if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)

    def tree(nodes):
        """Levels of a tree."""
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][k : k + 16])) for k in range(0, len(levels[-1]), 16)])
        return levels

    def walk(levels, at):
        for level in levels[:-1]:
            run = level[at // 16 * 16 : at // 16 * 16 + 16]
            yield "".join(run[: at % 16]), "".join(run[at % 16 + 1 :])
            at //= 16

    groups = {}
    for i, s, t in sorted(rows, key=lambda r: r[0]):
        groups.setdefault(s, []).append((i, t))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf(i, s, t) for i, t in groups[s]]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = {}
    for k, s in enumerate(order):
        for at, (i, t) in enumerate(groups[s]):
            path = [*walk(trees[s], at), *walk(top, k)]
            digest = leaf(i, s, lower(t)) if zlib.crc32(str(i).encode()) % 5 == 0 else leaf(i, s, t)
            for left, right in path:
                digest = sha(left + digest + right)
            out[i] = (leaf(i, s, t), trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), digest, digest == top[-1][0])
    return out


@pytest.mark.parametrize("n", [1, 2, 16, 17, 313])
def test_manifest_is_the_plain_one(spark, n):
    rows = many()[:n]
    got = {r.doc_id: tuple(r)[1:] for r in merkle.verified(docs(spark, rows)).collect()}
    assert got == plain_merkle(rows)
    assert n < 313 or {x[-1] for x in got.values()} == {True, False}


def test_manifest_of_many_groups_and_equal_rows(spark):
    rows = [(i, f"s{i % 40}", "T") for i in range(80)]
    assert {r.doc_id: tuple(r)[1:] for r in merkle.verified(docs(spark, rows)).collect()} == plain_merkle(rows)
    twice = merkle.verified(docs(spark, [(1, "a", "T"), (1, "a", "T"), (None, "a", "t")])).collect()
    assert len(twice) == 3 and len({r.leaf for r in twice}) == 2 and len({r.root for r in twice}) == 1
    assert merkle.verified(docs(spark, rows).limit(0)).count() == 0


def test_a_change_of_one_field_is_seen(spark):
    rows = [(i, "a", f"text {i}") for i in range(40)]
    found = merkle.proofs(merkle.build(merkle.leaves(docs(spark, rows), changed={"n_chars": F.col("n_chars") + 1}, where=F.col("doc_id") == 3)))
    roots = {r.id: r.root for r in found.select("id", merkle.folded(F.coalesce("tampered", "digest"), F.col("path")).alias("root")).collect()}
    assert len(set(roots.values())) == 2 and len({v for i, v in roots.items() if i != 3}) == 1


def plain_ids(texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(bpe.vocabulary_path())
    return [[*e.ids, 2] for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_token_files_round_trip(spark, tmp_path):
    rows = [(r[0] * 3 - 100, *r[1:]) for r in many()]
    folder = idstore.write(docs(spark, rows), f"file://{tmp_path}/ids")
    ids = dict(zip([i for i, _, _ in rows], plain_ids([t or "" for _, _, t in rows]), strict=True))
    want, at = {}, 0
    for i in sorted(ids):
        want[i] = (at, len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes()))
        at += len(ids[i])
    held = idstore.read(spark, folder)
    assert {r.doc_id: r.ids for r in held.collect()} == ids
    assert {r.doc_id: tuple(r)[1:] for r in idstore.digests(held).collect()} == want
    entries = idstore.index(spark, folder)
    assert {r.doc_id: (r.start, r.n_tokens) for r in entries.collect()} == {i: x[:2] for i, x in want.items()}
    few = idstore.fetch(entries.filter("doc_id in (-100, 200, 203)"), folder).collect()
    assert {r.doc_id: r.ids for r in few} == {i: ids[i] for i in (-100, 200, 203)}
    # One dictionary for all shards, by its hash, and frames smaller than the arrays.
    (said,) = {r.dictionary for r in idstore.shards(spark, folder).collect()}
    assert hashlib.sha256((tmp_path / "ids" / f"{said}.dictionary").read_bytes()).hexdigest() == said
    assert sum(r.length for r in entries.collect()) < sum(2 * len(x) for x in ids.values()) / 2


def test_token_files_of_odd_tables(spark, tmp_path):
    none = idstore.write(docs(spark, many()).limit(0), f"file://{tmp_path}/none")
    assert idstore.digests(idstore.read(spark, none)).count() == 0 and idstore.index(spark, none).count() == 0
    rows = [(None, "a", "no id"), (7, "a", "same"), (7, "a", "same"), (7, "b", "other"), (-1, "c", None)]
    held = sorted(((r.doc_id, r.start, r.ids) for r in idstore.read(spark, idstore.write(docs(spark, rows), f"file://{tmp_path}/odd")).collect()), key=lambda r: r[1])
    assert [r[0] for r in held] == [None, -1, 7, 7, 7] and held[1][2] == [2]
    assert [r[1] for r in held] == np.concatenate(([0], np.cumsum([len(r[2]) for r in held])[:-1])).tolist()
    assert sorted(r[2] for r in held) == sorted(plain_ids(["no id", "same", "same", "other", ""]))


def test_damaged_files_are_refused(spark, tmp_path):
    folder = idstore.write(docs(spark, many()[:9]), f"file://{tmp_path}/ids")
    shard = max((tmp_path / "ids/files").iterdir(), key=lambda f: f.stat().st_size)
    data = bytearray(shard.read_bytes())
    data[idstore.HEAD + 20] ^= 1
    shard.write_bytes(bytes(data))
    with pytest.raises(Exception, match="damaged|[Zz]std|corrupt|decompress"):
        idstore.read(spark, folder).collect()


def test_manifests_are_kept_and_compared(spark, tmp_path):
    draw = random.Random(9)
    rows = {(s, i): f"{s} {i}" for s, n in (("hot", 600), ("b", 20), ("c", 1)) for i in range(n)}
    of = lambda held: merkle.build(merkle.leaves(docs(spark, [(i, s, t) for (s, i), t in held.items()])))
    old = of(rows)
    merkle.save(old, f"{tmp_path}/old")
    old = merkle.load(spark, f"{tmp_path}/old")
    assert merkle.differences(old, of(dict(rows))).count() == 0
    for case in range(4):
        changed = dict(rows)
        if case == 0:
            changed["hot", 317] = "other"
        if case == 1:
            changed["hot", 900], changed["new", 1] = "more", "group"
            del changed["c", 0]
        if case == 2:
            for key in draw.sample(sorted(rows), 30):
                changed[key] += "!"
            for key in draw.sample(sorted(rows), 30):
                changed.pop(key)
            changed["hot", -5] = "first"
        if case == 3:
            # A tree that loses its upper levels.
            changed = {k: v for k, v in changed.items() if k[0] != "hot" or k[1] < 9}
        new = of(changed)
        want = {(f"g{s}", i): "added" if (s, i) not in rows else "removed" if (s, i) not in changed else "changed" for s, i in {*rows, *changed} if rows.get((s, i)) != changed.get((s, i))}
        assert {(r.group, r.id): r.change for r in merkle.differences(old, new).collect()} == want, case
        assert (old.root == new.root) == (not want)
