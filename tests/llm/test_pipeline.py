"""The pipeline against a plain run of its five stages over lists."""

import hashlib
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fluxloom.llm import decontaminate, quality
from fluxloom.llm.common import table

from test_other import best_substring
from test_quality_alphabet import Plain

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def tables(rnd):
    words = ["".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 7))) for _ in range(90)]
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [line(9) for _ in range(3)]
    docs = [(k, line(rnd.randint(25, 60)), "en", rnd.choice("aab")) for k in range(90)]
    docs += [(100 + k, docs[k][1], "en", "a") for k in range(0, 12)]
    docs += [(200 + k, docs[k][1].rsplit(" ", 1)[0], "en", "b") for k in range(6, 20)]
    docs += [(300 + k, f"{line(15)} {items[k]} {line(15)}", "en", "a") for k in range(3)]
    docs += [(310, f"{line(20)} {items[0][:20]}zz{items[0][20:]} {line(9)}", "en", "b")]
    docs += [(400 + k, "#%$ XQJ!! " * rnd.randint(9, 20), "en", "a") for k in range(5)] + [(500, None, "en", "a"), (501, "", None, None), (502, line(30), None, None)]
    labels = [(k, 1) for k in range(70)] + [(400, 0), (5, 0)]
    return docs, labels, list(enumerate(items))


def plain(docs, labels, items, held):
    bad = {k for k, q in labels if q == 0}
    trusted = {k for k, q in labels if q == 1} - bad
    model = Plain([t for k, t, _, _ in docs if k in trusted and k not in held])
    scores = {(k, t): model.score(t) for k, t, _, _ in docs if t}
    limit = sorted(scores[k, t] for k, t, _, _ in docs if k in trusted and k in held)
    limit = limit[max(0, -(-99 * len(limit) // 100) - 1)] + quality.MARGIN
    docs = [d for d in docs if d[1] and scores[d[0], d[1]] <= limit]

    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (d[1].lower().split() for d in docs)]
    root = list(range(len(docs)))
    for _ in docs:
        for i in range(len(docs)):
            for j in range(i):
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    least = {}
    for d, r in zip(docs, root, strict=True):
        least[r] = min(least.get(r, d), d, key=lambda x: x[0])
    docs = list(least.values())

    norm = [decontaminate.normalise(t) for _, t in items]
    docs = [d for d in docs if not any(best_substring(t, decontaminate.normalise(d[1])) <= int(len(t) * decontaminate.RATE) for t in norm)]

    sized = [(d, len(WORDS.findall(d[1]))) for d in docs]
    totals = {}
    for d, n in sized:
        totals[d[3]] = totals.get(d[3], 0) + n
    names = sorted(totals, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full, budget = set(), 1.5 * sum(totals.values())
    while True:
        left = budget - sum(2 * totals[s] for s in full)
        share = {s: left * weight[s] / sum(weight[t] for t in names if t not in full) for s in names if s not in full}
        if not (above := {s for s in share if share[s] > 2 * totals[s]}):
            break
        full |= above
    taken = []
    for s in names:
        target = 2 * totals[s] if s in full else share[s]
        epochs, at = int(target // totals[s]), 0
        key = lambda x: int(hashlib.md5(f"{x[0][0]}|{x[0][1]}".encode()).hexdigest()[:12], 16)
        for d, n in sorted((x for x in sized if x[0][3] == s), key=key):
            taken += [d] * (epochs + (at + n / 2 <= target - epochs * totals[s]))
            at += n
    tokenizer, at, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for d in sorted(taken, key=lambda d: d[0]):
        ids = [*tokenizer.encode(d[1], add_special_tokens=False).ids, 1]
        out.append((d[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_pipeline_equals_a_plain_run(spark, tmp_path, seed):
    docs, labels, items = tables(random.Random(seed))
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, q, 0) for k, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held = {r[0] for r in spark.createDataFrame([(d[0],) for d in docs], "k long").where(F.pmod(F.xxhash64("k"), F.lit(quality.FOLDS)) == 0).collect()}
    want = plain(docs, labels, items, held)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == sorted(want)
    assert 20 < len({d for d, *_ in want}) < 95


def test_stages_on_an_empty_table(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars int"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = table(spark, str(tmp_path), "documents")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
