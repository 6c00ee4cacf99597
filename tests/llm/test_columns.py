"""Extra columns of any name pass through, and none meets a name that an operator uses inside."""

import pytest
from pyspark.sql import functions as F

from fluxloom.llm import decontaminate, mixing, near_copies, quality, simhash, token_counts, toxicity, url_filter

NAMES = "_hit _id _key _bucket _before _l _n1 _length _features _kept _hash _toxic _source _nth block b s n id hash row at key kept kept_hash nth hit size place plan buckets once copies split mean far length threshold keep t0 t1 t2 q c0 c1 label toxic quality node root u v fp least cut lp gram token rule".split()
OUTPUTS = "_host _path _rule _verdict _score _threshold _keep _size _source_size _target _copies score n_tokens item_id".split()
TEXT = "some words of a text that is not very long, and more of them"


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.createDataFrame([(1, TEXT, "en", "web", "http://a.net/x/y"), (2, f"{TEXT} you nitwit and yet a few other words beside them", "en", "web", "http://b.net/x"), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, url string")
    return base.select("*", *[F.lit(f"={name}").alias(name) for name in NAMES + OUTPUTS])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, 5), (2, 0, 1, 5)], "doc_id long, quality int, toxic int, _id int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "nothing that any of these texts would hold", 0)], "item_id long, text string, t int")


OPERATORS = {
    "url": lambda d, l, b: url_filter.judge(d, l, [("allow", "a.net/")], id_col="doc_id"),
    "toxicity": lambda d, l, b: toxicity.score(d, toxicity.fit(d, l)),
    "quality": lambda d, l, b: quality.judge(d, l),
    "decontaminate": lambda d, l, b: decontaminate.clean(d, b),
    "mix": lambda d, l, b: mixing.mix(d),
    "mixed": lambda d, l, b: mixing.mixed(d, share=1.0, most=1.0),
    "tokens": lambda d, l, b: token_counts.token_counts(d, __import__("public_tokenizers").path("byte_bpe_50k.json")),
    "simhash": lambda d, l, b: simhash.representatives(d),
    "near_copies": lambda d, l, b: near_copies.representatives(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_names_do_not_clash(spark, docs, labels, bench, name):
    rows = OPERATORS[name](docs, labels, bench).collect()
    given = docs.where("text IS NOT NULL").collect() if name == "mixed" else docs.collect()
    assert len(rows) == len(given)
    assert set(docs.columns) <= set(rows[0].asDict())
    made = 0
    for r in rows:
        kept = [c for c in NAMES if r[c] != f"={c}"]
        assert not kept, kept
        made += sum(r[c] != f"={c}" for c in OUTPUTS)
    assert (made > 0) == (name in ("url", "toxicity", "quality", "mix", "tokens"))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in rows if r["text"]) == sorted((r["doc_id"] or 0, r["text"]) for r in given if r["text"])
