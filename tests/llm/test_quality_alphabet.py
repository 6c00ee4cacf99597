import math
import random

import pytest
from pyspark.sql import functions as F

from fluxloom.llm import quality


class Plain:
    """An interpolated modified Kneser-Ney model of character trigrams, counted by hand."""

    def __init__(self, texts):
        padded = ["\0\0" + t for t in texts if t]
        tally = lambda grams: {g: grams.count(g) for g in set(grams)}
        three = tally([t[k : k + 3] for t in padded for k in range(len(t) - 2)])
        two = tally([g[1:] for g in three])
        one = tally([g[1:] for g in two])
        self.base, self.levels = 1 / max(quality.LEAST, len(one) + 2), []
        for counts in (one, two, three):
            n = [sum(c == k for c in counts.values()) for k in range(1, 5)]
            y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.5
            cuts = [max(0.05, k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 * k) for k in (1, 2, 3)]
            self.levels.append((counts, cuts))

    def p(self, gram):
        if not gram:
            return self.base
        counts, cuts = self.levels[len(gram) - 1]
        cut = lambda c: cuts[0] if c == 1 else cuts[1] if c == 2 else min(cuts[2], c)
        here = {g: c for g, c in counts.items() if g[:-1] == gram[:-1]}
        if not here:
            return self.p(gram[1:])
        total, left = sum(here.values()), sum(map(cut, here.values()))
        c = counts.get(gram, 0)
        return (c - cut(c) if c else 0) / total + left / total * self.p(gram[1:])

    def score(self, text):
        t = "\0\0" + text
        return -sum(math.log(self.p(t[k : k + 3])) for k in range(len(text))) / len(text)


@pytest.mark.parametrize("hot", [1_000_000, 5])
def test_scores_equal_a_plain_kneser_ney_model(spark, monkeypatch, hot):
    monkeypatch.setattr(quality, "HOT", hot)
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abcde 漢字é") for _ in range(rnd.randint(1, 60))) for _ in range(60)] + ["zzz q", "", None]
    docs = spark.createDataFrame([(k, t, 7.0, "x") for k, t in enumerate([*texts, texts[0]])], "doc_id long, text string, score double, far string")
    model = quality.log_probabilities(docs, docs.where("doc_id < 40").select("text"))
    out = quality.with_score(docs, model)
    assert sorted(out.columns) == sorted(docs.columns) and {r["far"] for r in out.collect()} == {"x"}
    got = {r["doc_id"]: r["score"] for r in out.collect()}
    plain = Plain(texts[:40])
    assert len(got) == len(texts) + 1
    for k, t in enumerate([*texts, texts[0]]):
        assert got[k] is None if not t else math.isclose(got[k], plain.score(t), rel_tol=1e-9)


def test_probabilities_sum_to_one_in_each_context():
    plain = Plain(["abracadabra", "banana", "cab"])
    for context in ("ab", "\0\0", "ra", "zz"):
        seen = {g for g in plain.levels[0][0]}
        unseen = plain.p(context + "?")
        assert math.isclose(sum(plain.p(context + c) for c in seen) + unseen * (1 / plain.base - len(seen)), 1)


def test_characters_beyond_the_most_frequent_are_told_apart(spark):
    """300 letters of a large script: only letters after the 126th change places in what must be rejected."""
    script = [chr(0x4E00 + k) for k in range(300)]
    good, rnd = "".join(script), random.Random(4)
    bad = [script[:126] + rnd.sample(script[126:], 174) for _ in range(3)]
    docs = spark.createDataFrame([(k, good) for k in range(12)] + [(20 + k, "".join(b)) for k, b in enumerate(bad)], "doc_id long, text string").withColumn("lang", F.lit("zh"))
    labels = spark.createDataFrame([(k, 1) for k in range(11)], "doc_id long, quality int")
    rows = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    assert rows[11]["_keep"] and not any(rows[20 + k]["_keep"] for k in range(3))
