import random
import re
from collections import Counter

from skein.llm import licenses, rules

REPEATED = "one two three four five six seven eight nine"


def texts():
    rng = random.Random(6)
    vocabulary = ["the", "of", "and", "alpha", "beta#", "x|y", "GAMMA", "der", "été", "$5"]
    made = [None, "", " \n\t ", "word", REPEATED, f"{REPEATED} {REPEATED}", "a " * 40, "line one\nline one\n\n \nline two\nline one"]
    for _ in range(40):
        words = rng.choices(vocabulary, k=rng.randint(1, 200))
        if rng.random() < 0.5:
            at = rng.randrange(len(words))
            words += words[at : at + 12] + ["break"] + words[at : at + 10]
        made.append("".join(w + rng.choice([" ", "  ", "\n", "\t"]) for w in words))
    return made


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed)


def test_base_counts(spark):
    made = texts()
    df = spark.createDataFrame([(i, t, [None, "en", "de", "xx"][i % 4], i) for i, t in enumerate(made)], "doc_id long, text string, lang string, n_words int")
    got = {r.doc_id: r for r in rules.judge(df).collect()}
    for i, t in enumerate(made):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t
        assert not (r.base_failed and r.kept)


def test_distances_by_hand(spark):
    import math

    made = [("the of x y " * 60, "en"), ("the the of z " * 60, "en"), ("der die q " * 60, "de"), ("### ### " * 200, "en")]
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(made)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in rules.judge(df).collect()}
    listed = {w for ws in rules.COMMON.values() for w in ws.split()}
    counts = [Counter(w if w in listed else "" for w in t.split()) for t, _ in made]
    references = {}
    for lang in ("en", "de"):
        total = sum((c for c, (_, own) in zip(counts, made) if own == lang), Counter())
        references[lang] = {w: n / sum(total.values()) for w, n in total.items()}

    def distance(p, r):
        s = 0
        for w in {*p, *r}:
            a, b = p.get(w, 0), r.get(w, 0)
            m = (a + b) / 2
            s += (a * math.log2(a / m) if a else 0) + (b * math.log2(b / m) if b else 0)
        return math.sqrt(s / 2)

    for i, c in enumerate(counts):
        p = {w: n / sum(c.values()) for w, n in c.items()}
        assert abs(got[i].word_distance - min(distance(p, r) for r in references.values())) < 1e-9


def test_no_rows_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "the of and " * 60, "en"), (1, "the of and " * 60, "en"), (None, None, None)], "doc_id long, text string, lang string")
    rows = rules.judge(df).collect()
    assert len(rows) == 3 and len({r.word_distance for r in rows if r.doc_id == 1}) == 1
    assert rules.judge(df.limit(0)).count() == 0 and rules.keep_good(df.limit(0)).count() == 0


def test_licences(spark):
    made = [None, "", "Released under the MIT License.", "mit  LICENSE, mit-license", "x permit license", "The GNU General\nPublic License, version 3", "This work is licensed under the GNU General Public License, version 3.",
            "Licensed under CC BY-NC 4.0.", "Apache License", "license mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "no words of that kind here"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(made)], "doc_id long, text string, word string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for i, t in enumerate(made):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        places, names = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            at = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            places += at
            names |= {label} if at else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(names))), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert got[10].labels == "mit" and got[7].labels == "cc-by-nc-4.0" and got[6].labels == "gpl,gpl-3.0" and got[11].labels == ""
    assert licenses.scan(df.limit(0)).count() == 0


def test_several_notices_in_one_file(spark):
    texts = {label: text for label, text, _ in licenses.TEMPLATES if label in ("bsd-3-clause", "mit", "isc", "mpl-2.0")}
    longest = {label: text for label, text, _ in sorted(licenses.TEMPLATES, key=lambda t: len(t[1]))}
    every = ". ".join(longest.values())
    made = [f"{texts['bsd-3-clause']}. {texts['mit']}", f"{longest['apache-2.0']}. Licensed under CC BY 4.0. {texts['bsd-3-clause']}", every, texts["isc"]]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan(df).collect()}
    assert {"bsd-3-clause", "mit"} <= got[0] and {"apache-2.0", "cc-by-4.0", "bsd-3-clause"} <= got[1]
    assert set(longest) <= got[2] and got[3] == {"isc"}
