import random
import zlib

import numpy as np

from skein.llm import quality, toxicity


def held_out(i, parts, part):
    return zlib.crc32(str(i).encode()) % parts == part


def corpus(spark):
    rng = random.Random(8)
    rows, labels = [(0, None), (1, "")], []
    for i in range(2, 600):
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        words = [("W" + "!" * 3 if bad else "w") + str(rng.randrange(50)) for _ in range(rng.randint(20, 90))]
        if toxic:
            words[rng.randrange(len(words))] = "insult"
            words[rng.randrange(len(words))] = "group"
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def accuracy(rows, labels, column, parts, part):
    got = {r.doc_id: r for r in rows}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == held_out(r.doc_id, parts, part) for r in rows)
    tested = [x for x in labels if held_out(x[0], parts, part)]
    return sum(got[x[0]].predicted == x[column] for x in tested) / len(tested)


def test_held_out_accuracy(spark):
    docs, labels, plain = corpus(spark)
    assert accuracy(quality.classify(docs, labels).collect(), plain, 1, 4, 2) > 0.95
    assert accuracy(toxicity.classify(docs, labels).collect(), plain, 2, 3, 1) > 0.95


def test_held_out_labels_are_never_used(spark):
    docs, labels, _ = corpus(spark)
    from pyspark.sql import functions as F

    from skein.llm.common import fold

    swapped = labels.withColumn("quality", F.when(fold(4) == 2, 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.when(fold(3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = lambda rows: {r.doc_id: round(r.score, 6) for r in rows.collect()}
    assert scores(quality.classify(docs, labels)) == scores(quality.classify(docs, swapped))
    assert scores(toxicity.classify(docs, labels)) == scores(toxicity.classify(docs, swapped))


def test_without_labels_and_rows(spark):
    docs, labels, _ = corpus(spark)
    few = docs.limit(5)
    for m in (quality, toxicity):
        assert m.classify(few, labels.limit(0)).count() == 5
        assert m.classify(docs.limit(0), labels).count() == 0


def test_pairs_say_more_than_terms():
    rng = random.Random(1)
    rows, labels = [], []
    for _ in range(800):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(toxicity.terms(" ".join([f"w{rng.randrange(30)}" for _ in range(10)] + ["insult"] * a + ["group"] * b).encode()))
        labels.append(int(a and b))
    machine = toxicity.FactorizationMachine().fit(rows, labels)
    wanted = [toxicity.terms(t) for t in (b"insult group w1", b"insult w1", b"group w1")]
    both, one, other = machine.score(wanted)
    assert both > 0.7 > 0.5 > max(one, other)


def test_a_mention_without_effect_alone():
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(2000):
        insult, slur, group = i % 10 < 3, i // 10 % 10 < 3, i // 100 % 2 == 1
        rows.append(toxicity.terms(" ".join([f"w{rng.randrange(30)}" for _ in range(10)] + ["insult"] * insult + ["slur"] * slur + ["group"] * group).encode()))
        labels.append(int(insult if group else slur))
    # Toxic are 0.3 of the texts with a mention of the group and 0.3 of those without.
    assert sum(labels[i] for i in range(2000) if i // 100 % 2) == sum(labels[i] for i in range(2000) if not i // 100 % 2) == 300
    machine = toxicity.FactorizationMachine().fit(rows, labels)
    both, one, other, neither = machine.score([toxicity.terms(t) for t in (b"insult group w1", b"insult w1", b"slur w1", b"slur group w1")])
    assert min(both, other) > 0.7 > 0.5 > max(one, neither)


def test_two_terms_that_say_nothing_alone():
    rng = random.Random(1)
    rows, labels = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(toxicity.terms(" ".join([f"w{rng.randrange(30)}" for _ in range(10)] + ["insult"] * a + ["group"] * b).encode()))
        labels.append(int(a != b))
    machine = toxicity.FactorizationMachine().fit(rows, labels)
    both, one, other, neither = machine.score([toxicity.terms(t) for t in (b"insult group w1", b"insult w1", b"group w2", b"w3")])
    assert min(one, other) > 0.7 > 0.5 > max(both, neither)


def test_score_is_the_double_sum_over_pairs():
    import math

    rng = random.Random(5)
    rows = [toxicity.terms(" ".join(rng.choices([f"t{k}" for k in range(9)], k=12)).encode()) for _ in range(20)] + [{}]
    machine = toxicity.FactorizationMachine()
    buckets = sorted({b for r in rows for b in r})[:7]  # two terms aren't in the machine
    machine.place, machine.bias, machine.trained = {b: k for k, b in enumerate(buckets)}, 0.3, True
    machine.linear = toxicity.np.array([rng.uniform(-1, 1) for _ in buckets])
    machine.pairs = toxicity.np.array([[rng.uniform(-1, 1) for _ in range(6)] for _ in buckets])
    for row, got in zip(rows, machine.score(rows), strict=True):
        x = {machine.place[b]: 1 + math.log(n) for b, n in row.items() if b in machine.place}
        margin = machine.bias + sum(machine.linear[k] * v for k, v in x.items())
        margin += sum(sum(machine.pairs[i] * machine.pairs[j]) * x[i] * x[j] for i in x for j in x if i < j)
        assert abs(got - 1 / (1 + math.exp(-margin))) < 1e-9


def test_vote_is_the_plain_one(spark):
    docs, labels, _ = corpus(spark)
    model = quality.fit(docs, labels)
    rows = [quality.terms((r.text or "").encode(), {}) for r in docs.collect()][:60]
    unit = model._unit((quality.matrix(rows) - model.centre) @ model.project)
    products = unit @ model.vectors.T
    for v, told, got in zip(unit, products, model.score(rows), strict=True):
        # The products are those of plain sums, and the vote is the plain one over them, to the last neighbour.
        assert all(abs(sum(a * b for a, b in zip(v.tolist(), w.tolist())) - float(p)) < 1e-5 for w, p in zip(model.vectors, told))
        near = sorted(((round(float(p), 5), float(y)) for p, y in zip(np.round(told, 5), model.labels)), reverse=True)
        last = near[quality.NEIGHBOURS - 1][0]
        votes = [(max(s, 1e-3) ** quality.SHARPNESS, y) for s, y in near if s >= last]
        assert len(votes) >= quality.NEIGHBOURS and abs(sum(w * y for w, y in votes) / sum(w for w, _ in votes) - got) < 1e-4


def test_long_repeated_and_clashing_rows(spark):
    docs, labels, _ = corpus(spark)
    from pyspark.sql import functions as F

    long = " ".join(["w1", "insult", "group"] * 60_000)
    some = spark.createDataFrame([(7000, long), (7001, long), (7001, long), (None, None)], "doc_id long, text string")
    both = docs.unionByName(some).withColumns({"label": F.lit("x"), "score": F.lit(1), "key": F.lit(2), "h": F.lit(3)})
    for m in (quality, toxicity):
        rows = [r for r in m.classify(both, labels).collect() if r.doc_id is None or r.doc_id >= 7000]
        assert len(rows) == 4 and len({round(r.score, 9) for r in rows if r.doc_id}) == 1
    kept = quality.keep_good(both, labels)
    assert kept.columns == both.columns and quality.keep_good(both.limit(0), labels).count() == 0


def test_an_id_in_many_rows_brings_one(spark):
    from skein.llm.labelled import training_sample

    docs = spark.createDataFrame([(3, f"text {k}") for k in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (3, 0)], "doc_id long, quality int")
    assert [tuple(r) for r in training_sample(docs, labels, "quality", 4, 9).collect()] == [(3, "text 0", 1)]
