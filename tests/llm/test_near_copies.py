import random

import pytest

import corpus_pipeline
from fluxloom.llm import near_copies, simhash


def brute_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_kept(texts):
    sets, root = [brute_set(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted(i for i in range(len(texts)) if find(i) == i)


def edited(n_bases=12, copies=12):
    """Copies of some texts with one to nine words replaced, so similarities lie on both sides of 0.8."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    texts = []
    for _ in range(n_bases):
        base = [word() for _ in range(rnd.randint(60, 160))]
        texts.append(" ".join(base))
        for k in range(copies):
            copy = list(base)
            for at in rnd.sample(range(len(copy)), k % 9 + 1):
                copy[at] = word()
            texts.append(" ".join(copy))
    return [*texts, "", None, "Two words", "two  WORDS", texts[0]]


@pytest.mark.parametrize(("pair_limit", "block"), [(32, 2048), (2, 3)])
def test_stage_keeps_one_of_each_class_of_edited_copies(spark, monkeypatch, pair_limit, block):
    monkeypatch.setattr(near_copies, "PAIR_LIMIT", pair_limit)
    monkeypatch.setattr(near_copies, "BLOCK", block)
    texts = edited()
    want = brute_kept(texts)
    assert len(want) < len(texts) - 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == want


@pytest.mark.parametrize(("pair_limit", "block"), [(32, 2048), (2, 3)])
def test_simhash_keys_alone_link_fingerprints_two_bits_apart(spark, monkeypatch, pair_limit, block):
    """Without bands the stage links all similar texts whose fingerprints differ in at most two bits."""
    monkeypatch.setattr(near_copies, "PAIR_LIMIT", pair_limit)
    monkeypatch.setattr(near_copies, "BLOCK", block)
    bands = near_copies.keys_of
    monkeypatch.setattr(near_copies, "keys_of", lambda found: bands(found)[:1] * 0 + hash(found.tobytes()))
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    texts = []
    for _ in range(10):
        base = [word() for _ in range(900)]
        texts += [" ".join([*base[:-1], word()]) for _ in range(6)]
    prints = [simhash.fingerprint(t.encode(), words=5) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    assert len(set(root)) < len(texts) - 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = dict(near_copies.classes(docs).select("id", "component_id").collect())
    assert all(found[k] == found[r] for k, r in enumerate(root))
