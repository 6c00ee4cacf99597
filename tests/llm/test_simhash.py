import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fluxloom.llm import simhash


def brute_print(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    ones = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles)) if shingles else 0


def brute_classes(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", ["", None, "One", "One two", "A b\tc\x0bd", "É Ünï x y z ", "a a a a a a", "İx\u00a0y z w"])
def test_fingerprint_is_that_of_the_definition(text):
    assert simhash.fingerprint(text.encode() if text else None) == brute_print(text)


def test_long_texts_are_hashed_in_parts(monkeypatch):
    text = " ".join(f"w{k % 97}" for k in range(3000))
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text.encode()) == brute_print(text)


@pytest.mark.parametrize(("pair_limit", "block"), [(32, 2048), (2, 3)])
def test_classes_equal_all_pairs(spark, monkeypatch, pair_limit, block):
    monkeypatch.setattr(simhash, "PAIR_LIMIT", pair_limit)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 12).tolist()
    prints = {}
    for k in range(160):
        p = seeds[k % 12] if k % 5 else int(rng.integers(0, 1 << 63))
        for b in rng.integers(0, 64, rng.integers(0, 4)):
            p ^= 1 << int(b)
        prints[k] = p
    rows = [(int(np.uint64(p).astype(np.int64)),) for p in set(prints.values())]
    links = simhash.links(spark.createDataFrame(rows, "fp long"))
    from fluxloom.llm.common import components

    roots = {r["node"]: r["root"] for r in components(links).collect()}
    signed = {k: int(np.uint64(p).astype(np.int64)) for k, p in prints.items()}
    least = {}
    for k in sorted(signed):
        least.setdefault(roots.get(signed[k], signed[k]), k)
    assert {k: least[roots.get(p, p)] for k, p in signed.items()} == brute_classes(prints)


def test_edges_of_the_input(spark):
    rows = [(1, "a b c d", "x"), (2, "A b  c d", "x"), (3, "", "x"), (4, None, "x"), (None, "a b c d", "x"), (5, "other words stand in here", "x"), (5, "other words stand in here", "x"), (None, "some words that nobody else has", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r["doc_id"] or -1, r["component_id"] or -1) for r in simhash.classes(docs).collect()))
    assert got[1:] == [(-1, 1), (1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (5, 5)]
    assert got[0] == (-1, -1)
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 3, 5]
    assert simhash.classes(docs.where(F.lit(False))).count() == 0


def records_shuffled(spark):
    """Records that the session's shuffles have written so far."""
    context, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    context.listenerBus().waitUntilEmpty()
    none, no_quantiles = jvm.java.util.ArrayList(), spark.sparkContext._gateway.new_array(jvm.double, 0)
    stages = context.statusStore().stageList(none, False, False, no_quantiles, none)
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(k) for k in range(stages.size()))}


def test_keys_are_shuffled_once_where_shared_ones_are_too_many_to_send(spark):
    rng = np.random.default_rng(5)
    found = rng.integers(0, 1 << 63, 2000, np.uint64) * np.uint64(2) + rng.integers(0, 2, 2000, np.uint64)
    near = found[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300, np.uint64))
    found = np.unique(np.concatenate([found, near]))
    prints = spark.createDataFrame([(int(x),) for x in found.view(np.int64)], "fp long")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    before = records_shuffled(spark)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = {tuple(r) for r in simhash.links(prints).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    moved = sum(n for k, n in records_shuffled(spark).items() if k not in before)
    pairs = np.triu(np.bitwise_count(found[:, None] ^ found[None, :]) <= 2, 1)
    want = {tuple(sorted((int(found[a].astype(np.int64)), int(found[b].astype(np.int64))))) for a, b in zip(*pairs.nonzero(), strict=True)}
    assert got == want
    assert len(want) >= 300
    shared = 300 * 33  # a pair one bit apart shares the keys of its equal half and one of the other
    assert 64 * len(found) <= moved <= 64 * len(found) + 2 * len(found) + 10 * shared


def test_members_of_keys_are_those_of_the_exploded_keys(spark):
    rng = np.random.default_rng(6)
    bits = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    found = {0, -1, 1 << 31, 1 << 32, -1 << 63, (1 << 63) - 1, *bits, *(-1 - b for b in bits)}
    found |= {x ^ (1 << int(k)) for x in list(found) for k in rng.integers(0, 63, 2)}
    prints = spark.createDataFrame([(x,) for x in sorted(found)], "fp long")
    keys = simhash.variants(prints)
    want = {(r["key"], r["fp"]) for r in keys.collect()}
    got = simhash.members(prints, keys.select("key").distinct()).collect()
    assert len(got) == len(want) == 64 * len(found)
    assert {(r["key"], r["fp"]) for r in got} == want
