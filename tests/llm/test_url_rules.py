"""Mined url rules against every combination of tokens, counted by hand."""

import itertools
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from fluxloom.llm import url_filter as U


def tokens(url):
    host, _, path = url.split("://")[1].partition("/")
    return {f"h:{x}" for x in host.split(".") if x} | {f"p:{x}" for x in path.split("/") if x}


def blocked(pages, labels, rows, confidence, most):
    """The urls that a rule of up to `most` tokens fits."""
    known = [(tokens(u), labels[k]) for k, u in pages if k in labels]
    least = max(rows, math.ceil(U.SUPPORT * len(known)))
    bad, every = {}, {}
    for items, block in known:
        for size in range(1, most + 1):
            for s in itertools.combinations(sorted(items), size):
                every[s] = every.get(s, 0) + 1
                bad[s] = bad.get(s, 0) + block
    rules = [set(s) for s in every if bad[s] >= least and bad[s] >= confidence * every[s]]
    return {u for _, u in pages if any(r <= tokens(u) for r in rules)}


@pytest.mark.parametrize(("seed", "wide", "depth"), [(1, 15, 4), (2, 3, 4), (3, 6, 9)])
def test_blocked_urls_equal_all_combinations(spark, monkeypatch, seed, wide, depth):
    monkeypatch.setattr(U, "WIDE", wide)
    rnd = random.Random(seed)
    pages = [(k, f"http://{rnd.choice('abc')}.{rnd.choice(['net', 'com'])}/" + "/".join(rnd.choice("rstuvwxy") for _ in range(rnd.randint(0, depth)))) for k in range(250)]
    labels = {k: bool({"p:r", "p:s"} <= tokens(u) or {"h:b", "p:v"} <= tokens(u) or {"h:a", "p:t", "p:u"} <= tokens(u) or rnd.random() < 0.1) for k, u in pages[:200]}
    want = blocked(pages, labels, 5, 0.7, 3)
    frame = spark.createDataFrame([(k, int(not b)) for k, b in labels.items()], "doc_id long, quality int")
    out = U.judge(spark.createDataFrame(pages, "page_id long, url string"), frame, [], confidence=0.7)
    assert {r["url"] for r in out.where("_verdict = 'block'").collect()} == want
    assert len(want) > 5


@pytest.mark.parametrize(("shared", "most"), [(60, 3), (200, 2), (1000, 2)])
def test_deep_urls_end_soon(spark, shared, most):
    """Urls that share many segments, a third of them blocked, some of them by a word beside the segments;
    others hold a part of the segments."""
    deep = [f"s{k}" for k in range(shared)]
    paths = [[*deep, str(k)] if k % 4 else [*deep, "bad", str(k)] for k in range(24)] + [["bad", str(k % 3)] for k in range(12)] + [[str(k % 7), "x"] for k in range(60)]
    paths += [[deep[7], "bad"], [deep[shared - 1], "bad"], deep[:9], ["bad"]]
    pages = [(k, "http://a.net/" + "/".join(p)) for k, p in enumerate(paths)]
    labels = {k: k % 4 == 0 or k == 1 for k in range(96)} | {k: False for k in range(24, 36)}
    began = time.time()
    out = U.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame([(k, int(not b)) for k, b in labels.items()], "doc_id long, quality int"), [], most=most)
    found = {r["url"] for r in out.where("_verdict = 'block'").collect()}
    assert time.time() - began < 30
    assert found == blocked(pages, labels, 5, 0.5, most)
    assert {pages[96][1], pages[97][1]} <= found and not {pages[98][1], pages[99][1]} & found


def test_no_pair_of_labels_is_lost_to_repeats(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (1, "http://a.net/x"), (None, "http://a.net/y"), (2, None)], "page_id long, url string")
    out = U.judge(pages, spark.createDataFrame([(1, 0), (1, 1), (None, 0), (2, 0)], "doc_id long, quality int"), [], rows=2)
    assert sorted((r["url"] or "", r["_verdict"]) for r in out.collect()) == [("", "allow"), ("http://a.net/x", "block"), ("http://a.net/x", "block"), ("http://a.net/y", "block")]
    assert U.judge(pages.where(F.lit(False)), spark.createDataFrame([], "doc_id long, quality int"), []).count() == 0
