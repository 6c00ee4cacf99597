import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fluxloom.llm import align, queries

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
POOL = [*"abcDE. ,'\"\n\t  <|>é́üß漢字0123٣😀 ‍_-!?\x01\x1c", "<|endoftext|>", "<s>", "<0x41>", "the", " of", "word ", "ing, ", "Tion.\n"]


def letters():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}


def plainly(texts):
    """By the definition: offsets of all tokens, their common ends, counts over all texts."""
    a_model, b_model, by = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), letters()
    a_model.encode_special_tokens = True
    rows, count = [], Counter()
    for text in texts:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        a_bytes = [bytes(by[c] for c in a_model.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            rows.append(([], [], [], []))
            continue
        ends = []
        for tokens in (a_bytes, b_bytes):
            at, found = 0, {}
            for k, t in enumerate(tokens):
                at += len(t)
                found[at] = k
            ends.append(found)
        links, groups, i, j = [], [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            k, m = ends[0][e], ends[1][e]
            links.append((a[k], b[m]))
            groups.append(",".join(map(str, a[i : k + 1])) + "|" + ",".join(map(str, b[j : m + 1])))
            i, j = k + 1, m + 1
        count.update(links)
        rows.append((a, b, groups, links))
    top = defaultdict(int)
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    sha = lambda groups: hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
    return [(len(a), len(b), len(g), len(x), sum(count[p] == top[p[1]] for p in x), sum(count[p] for p in x), sha(g)) for a, b, g, x in rows]


def results(df):
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(tuple(r[c] for c in ["doc_id", *names]) for r in df.collect())


def test_walk_finds_all_common_ends():
    random.seed(1)
    for _ in range(3000):
        n = random.randint(1, 60)
        a, b = (sorted({*random.sample(range(1, n + 1), random.randint(0, n)), n}) for _ in range(2))
        common = sorted(set(a) & set(b))
        assert align.cuts(a, b) == ([a.index(e) + 1 for e in common], [b.index(e) + 1 for e in common])


@pytest.mark.parametrize("hot", [0, 40, align.HOT])
def test_texts_of_any_characters_equal_the_definition(spark, hot):
    random.seed(2)
    texts = ["".join(random.choices(POOL, k=random.randint(0, 25))) for _ in range(1500)] + ["a▁b", "▁", " ", "  x", "x  ", "a \n b", "the the the"] * 2 + ["z" * 20_000, "漢" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert results(align.align(docs, A, B, hot=hot)) == [(i, *r) for i, r in enumerate(plainly(texts))]


def test_query_equals_the_definition(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert results(queries.op13_align(spark, "/root/testdata/sf0.001")) == [(r.doc_id, *x) for r, x in zip(rows, plainly([r.text for r in rows]), strict=True)]


def test_columns_nulls_and_empty_tables(spark):
    rows = [(1, None, "x", 1.0), (None, "", "y", 2.0), (2, "A bc.", "z", 3.0), (2, "A bc.", "z", 3.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, links string, N_A double")
    found = align.align(docs, A, B, groups=True)
    assert found.columns == ["doc_id", "links", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    got = sorted((r.doc_id or 0, r.links, r.n_a, r.count_sum, r.groups_sha256, r.groups) for r in found.collect())
    assert [g[:4] for g in got] == [(0, "y", 0, 0), (1, "x", 0, 0), (2, "z", 3, 6), (2, "z", 3, 6)]
    assert all((hashlib.sha256(g[5].encode()).hexdigest() if g[5] else "") == g[4] for g in got)
    assert align.align(docs.limit(0), A, B).count() == 0
