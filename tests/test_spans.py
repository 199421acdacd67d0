"""Offsets, protected places and pages on texts made by hand and by chance."""

import random
import re

import pytest

from skein.operators import spans as S

PIECES = ["# Title here\n", "## A somewhat longer heading of a section\n", "word ", "Two words. ", "a\tb\tc\n", "```\ncode in\n\nhere\n```\n", "[Table] of things\n", "\n\n", "ßtraße é ", "Long sentence goes on and on. Then Another! "]


def texts(spark, n=60, seed=3):
    draw = random.Random(seed)
    rows = [(i, "".join(draw.choice(PIECES) for _ in range(draw.randrange(1, 60)))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "  \n "), (n + 3, "```\n" + "x y " * 400 + "\n```\n"), (n + 4, "one"), (n + 5, "w " * 3000)]
    return rows, spark.createDataFrame(rows, "id long, text string").repartition(3)


def spans_by_hand(text):
    found = [m.span() for p in (S.HEADING, S.PROTECTED) for m in re.finditer(p, text)]
    out = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def test_unions_of_protected_places(spark):
    rows, docs = texts(spark)
    got = {}
    for r in S.union(S.protected(docs, ["id"], "text"), ["id"]).collect():
        got.setdefault(r.id, []).append((r.start, r.stop))
    assert {i: sorted(x) for i, x in got.items()} == {i: s for i, t in rows if (s := spans_by_hand(t or ""))}


@pytest.mark.parametrize("size,overlap", [(12, 3), (7, 0), (40, 39)])
def test_chunks_cut_no_protected_place_and_lose_nothing(spark, size, overlap):
    rows, docs = texts(spark)
    got = {}
    for r in S.protected_chunks(docs, ["id"], "text", size, overlap).collect():
        got.setdefault(r.id, []).append((r.chunk, r.start, r.stop, r.content))
    for i, text in rows:
        chunks = sorted(got.get(i, []))
        if not (text or "").strip():
            assert not chunks
            continue
        assert [c[0] for c in chunks] == list(range(len(chunks))) and chunks[0][1] == 0 and chunks[-1][2] == len(text)
        assert all(c[3] == text[c[1] : c[2]] for c in chunks)
        assert all(a[1] < b[1] <= a[2] < b[2] for a, b in zip(chunks, chunks[1:]))
        rebuilt = "".join(c[3][max(0, end - c[1]) :] for c, end in zip(chunks, [0, *(c[2] for c in chunks)]))
        assert rebuilt == text
        for a, b in spans_by_hand(text):
            assert not any(a < p < b for c in chunks for p in c[1:3])


def test_windows_are_words_by_number(spark):
    rows, docs = texts(spark)
    for size, overlap in ((5, 2), (9, 0), (3, 5)):
        step = size - min(overlap, size - 1)
        want = set()
        for i, text in rows:
            ends = [m.end() for m in re.finditer(r"\s*\S+", text or "")]
            for k, at in enumerate(range(0, len(ends), step)):
                if at == 0 or at - step + size < len(ends):
                    want.add((i, k, ends[at - 1] if at else 0, len(text) if at + size >= len(ends) else ends[at + size - 1]))
        assert {tuple(r) for r in S.token_windows(docs, ["id"], "text", size, overlap).collect()} == want


def test_sentences_as_the_patterns_split_them(spark):
    def plain(text):
        for p in S.SENTENCE:
            parts = re.split(p.replace(r"\x{061F}\x{061B}\x{060C}", "؟؛،"), text)
            if len(parts) > 1:
                break
        else:
            parts = [text]
        at, out = 0, []
        for part in parts:
            if part.strip():
                start = text.find(part, at)
                at = start + len(part)
                if len(part.strip()) >= 8:
                    out.append((start, at))
        return out

    rows = [(0, "Short. But this one is long enough. And this as well!  Yes indeed it is."), (1, "你好世界你好世界。再见世界再见世界！ 还有一句话在这里。"), (2, "lower case. follows here. and ends"), (3, "سلام دنیای بزرگ؟ بله همینطور است؛ پایان این متن"), (4, "no end at all"), (5, ""), (6, None), (7, "  Leading blanks here. And More of it.  ")]
    rows += [(10 + i, t) for i, t in enumerate(t for _, t in texts(spark)[0] if t)]
    got = {}
    for r in S.sentences(spark.createDataFrame(rows, "id long, text string"), ["id"], "text").collect():
        got.setdefault(r.id, []).append((r.sentence, r.start, r.stop))
    assert {i: [x[1:] for x in sorted(v)] for i, v in got.items()} == {i: s for i, t in rows if (s := plain(t or ""))}


def test_pages_with_gaps(spark):
    pages = spark.createDataFrame([(1, 7, 10, 20), (1, 8, 20, 30), (1, 9, 40, 50)], "id long, page long, start long, stop long")
    asked = [(0, 5), (0, 11), (10, 20), (15, 25), (12, 45), (30, 40), (35, 41), (49, 90), (50, 60)]
    chunks = spark.createDataFrame([(1, k, a, b) for k, (a, b) in enumerate(asked)] + [(2, 99, 0, 5)], "id long, chunk long, start long, stop long")
    got = {r.chunk: (r.first_page, r.last_page) for r in S.paged(chunks, pages, ["id"]).collect()}
    assert [got[k] for k in range(len(asked))] == [(None, None), (7, 7), (7, 7), (7, 8), (7, 9), (None, None), (9, 9), (9, 9), (None, None)]
    assert got[99] == (None, None)


def test_groups_are_cut_at_spans_and_sized(spark):
    members = spark.createDataFrame([(1, 0, k, 10 * k, 10 * k + 9) for k in range(6)], "id long, g long, s long, start long, stop long")
    edges = spark.createDataFrame([(1, 29, 40), (1, 55, 56)], "id long, start long, stop long")
    parts = {r.s: r.part for r in S.split_at_spans(members, edges, ["id"], "g", "s").collect()}
    # Edges lie between 2 and 3 and between 3 and 4; the last span lies inside a sentence.
    assert [parts[k] for k in range(6)] == [0, 0, 0, 1, 2, 2]
    rows = [(1, 0, 0, 9, "tiny"), (1, 1, 10, 19, "a b c d e f"), (1, 2, 20, 29, "x"), (1, 3, 30, 39, " ".join(map(str, range(25)))), (1, 4, 40, 49, "end")]
    got = S.sized(spark.createDataFrame(rows, "id long, k long, start long, stop long, content string"), ["id"], ["k"], 8, 10).orderBy("chunk").collect()
    assert [(r.chunk, r.start, r.stop, r.content) for r in got][:2] == [(0, 0, 9, "tiny"), (1, 10, 29, "a b c d e f x")]
    assert [r.content.split()[0] for r in got[2:]] == ["0", "10", "20"] and got[-1].content.endswith("24 end") and got[-1].stop == 49


def test_reports_are_dealt_out_by_their_number(spark, monkeypatch):
    from skein.plans import span_queries as Q

    d = "/root/testdata/sf0.001"
    want = {tuple(r) for r in Q.structural_groups(spark, d).collect()}
    monkeypatch.setattr(Q, "ORDERS", 100)
    n = -(-spark.read.parquet(f"{d}/orders.parquet").count() // 100)
    assert n > 4 and Q.reports(spark, d).rdd.getNumPartitions() == n
    assert {tuple(r) for r in Q.structural_groups(spark, d).collect()} == want
