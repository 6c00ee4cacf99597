import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fluxloom.llm import bpe, queries

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
POOL = [*"abcDE. ,'\"\n\t  <|>é́üßΣσςİſﬁ漢字0123４٣😀 ‍_-!?▁", "<|startoftext|>", "<|endoftext|>", "'s", " 'll", "word ", " the", "The"]


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_last_tokens_of_prefixes_spell_what_merging_gives(path):
    random.seed(3)
    words, model = bpe.vocabulary(path), Tokenizer.from_file(path).model
    tokens = [s.removesuffix("</w>") for s in words.ids]
    pieces = ["".join(random.choices("etaoin", k=random.randint(1, 14))) for _ in range(3000)]
    pieces += [c * n for c in "azeĠ" for n in range(1, 70)] + ["".join(random.choices(tokens, k=random.randint(1, 4))) for _ in range(6000)]
    pieces = list(filter(None, pieces))
    for p, ids in zip(pieces, words.encode(pieces), strict=True):
        assert ids == [t.id for t in model.tokenize(p)] == words.encode([p])[0], p


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_texts_of_any_characters_equal_the_library(path):
    random.seed(4)
    tokenizer, decode = Tokenizer.from_file(path), bpe.decoder(path)
    texts = ["".join(random.choices(POOL, k=random.randint(0, 30))) for _ in range(6000)] + ["", " ", "x" * 50_000, "é" * 20_000]
    for t, ids in zip(texts, bpe.encoder(path)(texts), strict=True):
        want = ids_of(tokenizer, t)
        assert np.frombuffer(ids, "<u4").tolist() == want, t[:60]
        assert decode(ids) == tokenizer.decode(want, skip_special_tokens=False), t[:60]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_any_ids_decode_as_in_the_library(path):
    random.seed(5)
    tokenizer, decode = Tokenizer.from_file(path), bpe.decoder(path)
    for _ in range(3000):
        ids = [random.randrange(50_400) for _ in range(random.randint(0, 12))]
        assert decode(np.array(ids, "<u4").tobytes()) == tokenizer.decode(ids, skip_special_tokens=False)


def test_encoding_of_a_piece_takes_time_in_proportion(path=BYTES):
    piece = "".join(random.Random(6).choices("etaoinshr", k=300_000))
    assert sum(bpe.vocabulary(path).length[t] for t in bpe.vocabulary(path).encode([piece])[0]) == len(piece)


def test_files_that_are_no_plain_bpe_are_refused():
    with pytest.raises((ValueError, UnicodeDecodeError)):
        bpe.encoder(public_tokenizers.path("piece_bpe_32k.model"))(["a"])


def test_columns_nulls_and_empty_tables(spark):
    rows = [(1, None, "x", 1.0), (None, "", "y", 2.0), (2, "A b<|endoftext|>.", "z", 3.0), (2, "A b<|endoftext|>.", "z", 3.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, _text double")
    coded = bpe.decode(bpe.encode(docs, WORDS), WORDS)
    assert coded.columns == ["doc_id", "text", "_text", "ids", "decoded"]
    tokenizer = Tokenizer.from_file(WORDS)
    found = [(r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist(), r.decoded) for r in coded.collect()]
    assert found == [(i, ids_of(tokenizer, t), tokenizer.decode(ids_of(tokenizer, t), skip_special_tokens=False)) for i, t, *_ in rows]
    assert bpe.decode(bpe.encode(docs.limit(0), WORDS), WORDS).count() == 0


def test_query_equals_the_library(spark):
    tokenizer = Tokenizer.from_file(WORDS)
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    found = queries.op12_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(found) == len(texts)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in found:
        ids = ids_of(tokenizer, texts[r.doc_id])
        want = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tokenizer.decode(ids, skip_special_tokens=False).encode()))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want
