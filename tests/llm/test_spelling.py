import random
import zlib
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from fluxloom.llm import queries, spelling


def plainly(words):
    """By the definition, word against word."""

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = {}, {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
        out[w] = n, len(others)
    rows = []
    for w, (n, n_near) in out.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, n_near, words[form[w]] if form[w] else None))
    return sorted(rows)


def results(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in df.collect())


def test_dense_neighbourhoods_equal_the_definition(spark):
    random.seed(1)
    words = {"".join(random.choices("abÿ", k=random.randint(5, 8))): random.choice([3, 3, 6, 7, 12, 24, 50, 100]) for _ in range(700)}
    words |= {c * k: 3 * k for c in "aÿ" for k in range(5, 30)} | {"x" * 3000: 5, "x" * 3001: 10, "x" * 2999 + "y": 40}
    found = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long").repartition(7))
    assert results(found) == plainly(words)


def test_node_numbers_name_prefixes(spark):
    random.seed(2)
    words = sorted({"".join(random.choices("abc", k=random.randint(1, 9))) for _ in range(500)})
    rows = spelling.numbered(spark.createDataFrame([(w,) for w in words], "word string").repartition(5), F.col("word"), "nodes").collect()
    seen = {}
    for r in rows:
        for k, node in enumerate(r.nodes, 1):
            assert seen.setdefault(node, r.word[:k]) == r.word[:k]
    assert len(seen) == len({w[:k] for w in words for k in range(1, len(w) + 1)}) == max(seen)
    assert [r.word for r in sorted(rows, key=lambda r: r.nodes[-1])] == words


def test_texts_of_any_kind_equal_the_definition(spark):
    random.seed(3)
    pool = ["Haus", "Häuser", "HÄUSER", "hause", "hausen", "weiß", "weisse", "weißen", "ÿes", "Ω", "日本", "don't", "x1y", "street", "streets", "stret", "×÷×÷×"]
    rows = [(i if i % 9 else None, None if i % 11 == 0 else " ".join(random.choices(pool, k=random.randint(0, 60))), "x") for i in range(300)] + [(7, "words " * 200_000, "y")]
    rows += rows[:20]
    planted = Counter()
    for i, text, _ in rows:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                word = run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]
                planted[word] += len(word) >= 5
            run = ""
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    found = spelling.variants(spelling.vocabulary(spelling.misspelled(spelling.runs(docs), 97)))
    assert results(found) == plainly({w: n for w, n in planted.items() if n >= 3})
    none = spelling.runs(docs.limit(0))
    assert results(spelling.variants(spelling.vocabulary(spelling.misspelled(none, 97)))) == []


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(f"SELECT word, form, root, n, n_near, form_n FROM ({queries.ORACLE_SQL['op11_spelling']})").fetchall()
    found = results(queries.op11_spelling(spark, "/root/testdata/sf0.001"))
    assert found == sorted(want) and any(r[1] for r in found)
