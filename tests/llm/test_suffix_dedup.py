import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fluxloom.llm import suffix_dedup as S


def brute(texts):
    windows = defaultdict(list)
    for d, t in enumerate(texts):
        for k in range(len(t) - S.SPAN + 1):
            windows[t[k : k + S.SPAN]].append((d, k))
    gone = [bytearray(len(t)) for t in texts]
    for places in windows.values():
        if len(places) > 1:
            for d, k in places:
                gone[d][k : k + S.SPAN] = b"\1" * S.SPAN
    return gone


def corpus(seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdéf") for _ in range(rnd.randint(1, 5))) for _ in range(60)]
    passages = [" ".join(rnd.choice(words) for _ in range(rnd.randint(60, 140))) for _ in range(5)]
    texts = []
    for _ in range(50):
        t = ""
        for _ in range(rnd.randint(0, 6)):
            c = rnd.random()
            if c < 0.4:
                t += " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 150)))
            elif c < 0.8:
                p = rnd.choice(passages)
                a = rnd.randint(0, 60)
                x = p[a : a + rnd.randint(150, 400)]
                j = rnd.randrange(len(x))
                t += x[:j] + "#" + x[j + 1 :] if rnd.random() < 0.4 else x
            else:
                t += rnd.choice(["a", "for ", "xyz\0"]) * rnd.randint(1, 200)
        texts.append(t)
    return texts + texts[:3]


def expected(texts):
    raw = [t.encode() for t in texts]
    out = []
    for t, g in zip(raw, brute(raw), strict=True):
        kept = bytes(b for b, x in zip(t, g, strict=True) if not x)
        spans = sum(1 for k in range(len(g)) if g[k] and (k == 0 or not g[k - 1]))
        out.append((len(t), sum(g), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in (("RUN_BYTES", 1 << 13), ("SORT_BYTES", 1 << 12), ("BLOCK", 1 << 10), ("DENSE", 3)):
            monkeypatch.setattr(S, name, value)
    texts = corpus(5 + small)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in S.digest(S.remove_repeats(docs)).collect()}
    assert [got[k] for k in range(len(texts))] == expected(texts)


def test_edges_of_the_input(spark):
    long = "".join(random.Random(1).choice("abc ") for _ in range(500))
    rows = [(1, None, 0), (2, "", 0), (3, "short", 0), (None, long, 0), (4, long, 0), (4, long, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, run int")
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"], r["n_spans"]) for r in S.digest(S.remove_repeats(docs)).collect())
    assert got == [(-1, 500, 500, 1), (1, 0, 0, 0), (2, 0, 0, 0), (3, 5, 0, 0), (4, 500, 500, 1), (4, 500, 500, 1)]
    assert S.remove_repeats(docs.where(F.lit(False))).count() == 0


def test_merge_keeps_order_and_known_prefixes():
    rnd = random.Random(2)
    for _ in range(200):
        runs = []
        for _ in range(rnd.randint(1, 9)):
            r = sorted(bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 6))) for _ in range(rnd.randint(0, 8)))
            runs.append([(S.common_prefix(r[k - 1], x) if k else 0, x, b"", False, k) for k, x in enumerate(r)])
        out = [(c, rec[1]) for c, _, rec in S.merge([iter(r) for r in runs])]
        assert [x for _, x in out] == sorted(rec[1] for r in runs for rec in r)
        assert all(out[k][0] == S.common_prefix(out[k - 1][1], out[k][1]) for k in range(1, len(out)))


def test_runs_fill_partitions_evenly(spark):
    from pyspark.sql import functions as F

    for runs, parts in ((1, 7), (64, 12), (102, 51), (5, 5), (32_000, 2000)):
        found = S.even_names(spark, runs, parts).collect()
        names = [r["name"] for r in found]
        assert len(set(names)) == runs and sorted(r["number"] for r in found) == list(range(runs))
        rows = spark.createDataFrame([(n,) for n in names], "run int").groupBy(F.pmod(F.hash("run"), F.lit(parts)).alias("p")).count().collect()
        assert max(r["count"] for r in rows) == -(-runs // parts)


def test_common_lines_are_no_anchors_beside_other_text(spark, monkeypatch):
    """A line of 150 bytes in every text between bytes of its own: results are those of brute force,
    and no anchor in the line has many different records; a long passage is one record a run."""
    rnd = random.Random(11)
    word = lambda n: bytes(rnd.choice(b"abcdefghijklmnop ") for _ in range(n))
    line, passage = word(150), word(600)
    texts = [word(rnd.randint(150, 400)) + line + word(rnd.randint(150, 400)) + (passage if k % 2 else b"") + word(60) for k in range(80)]
    most = []
    for table in (None, S.common_grams(iter(texts))):
        seen = defaultdict(set)
        for t in texts:
            place, first, last, h = S.anchors(S.np.frombuffer(t, S.np.uint8), [(0, len(t))], table)
            for a, b, g in zip(first.tolist(), last.tolist(), h.tolist(), strict=True):
                seen[g].add(t[a : b + S.SPAN])
        most.append(max(map(len, seen.values())))
    assert most[0] >= 30 and most[1] <= 8, most  # grams with a byte or two beside the line meet now and then
    docs = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts)], "doc_id long, text string")
    where = defaultdict(list)
    for k, t in enumerate(texts):
        for a in range(len(t) - S.SPAN + 1):
            where[t[a : a + S.SPAN]].append((k, a))
    gone = [set() for _ in texts]
    for places in where.values():
        if len(places) > 1:
            for k, a in places:
                gone[k].update(range(a, a + S.SPAN))
    got = {r["doc_id"]: bytes(r["kept"]) for r in S.remove_repeats(docs).collect()}
    assert all(got[k] == bytes(b for j, b in enumerate(t) if j not in gone[k]) for k, t in enumerate(texts))
    assert any(gone)
