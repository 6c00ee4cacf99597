import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fluxloom.llm import token_counts as C
from fluxloom.llm import token_files as W

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = ["", "Ein Wort.", "a  b\n\n c, d.\n<|endoftext|> x,y 3,4. é, ½. it's, I'm\u00a0x", "\x1c a\x85 b  , .", "ſ. İ, ß,", "x" * 30 + " " * 50 + "y", "a\x01 b\x01. c", " lead and trail ", "one two, three.\nFour five. " * 40, "word" * 300, "\n", ".", ", ."]


@pytest.fixture(scope="module")
def texts():
    import pyarrow.parquet as pq

    return TEXTS + pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()[:80]


def test_word_memo_gives_the_tokenizers_counts(texts):
    count, tokenizer = C.counter(BYTES, 10**9, 0, 0), Tokenizer.from_file(BYTES)
    assert count(texts) == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize(("huge", "chunk", "overlap"), [(20, 60, 4), (100, 300, 16)])
def test_spliced_chunks_give_the_tokenizers_counts(texts, huge, chunk, overlap):
    count, tokenizer = C.counter(BYTES, huge, chunk, overlap), Tokenizer.from_file(BYTES)
    assert count(texts) == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_word_encoder_gives_the_tokenizers_ids(texts):
    for path in (WORDS, BYTES):
        encode, tokenizer = W.encoder(path), Tokenizer.from_file(path)
        for t, ids in zip(texts, encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, (path, t[:50])


PARTS = [*"aabcdeEstTmRlv'\u2019.,.,!?-_ \n\t  0123456789\u00bd\u00b2ÄäßẞİıſΣσςéèÑñ漢字かな。、ก่ำ한글\u1100\u1161e\u0301أ\x1c\x1d\x1e\x1f\x85\xa0\u2028\u200b\u200d\U0001f600\u3000ﬁǅⅧ٣\x00\x01\x7fŁłжЖ", "it's", "I'LL", "<|endoftext|>", "<|startoftext|>", "<|", " the ", "...", "don't", " . ", ",\n", "e\u0301"]


def random_texts(seed, n, parts=PARTS, most=25):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, most))) for _ in range(n)]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_ids_and_counts_of_random_texts(path):
    """Also of those with U+001C to U+001F, which Python takes for white space and the tokenizers don't."""
    encode, count, tokenizer = W.encoder(path), C.counter(path, 10**9, 0, 0), Tokenizer.from_file(path)
    for few in (random_texts(1, 12_000), random_texts(2, 13_000, list("abcdeE stTm'.,!-  0ÄäßÑñéź\n_("))):
        for k in range(0, len(few), 500):
            part = few[k : k + 500]
            want = [e.ids for e in tokenizer.encode_batch(part, add_special_tokens=False)]
            assert [np.frombuffer(x, "<u4").tolist() for x in encode(part)] == want
            assert count(part) == [len(x) for x in want]


@pytest.mark.parametrize(("chunk", "overlap"), [(7, 2), (20, 4), (60, 16)])
def test_splices_of_random_texts(chunk, overlap):
    texts, tokenizer = random_texts(3, 1500, most=120), Tokenizer.from_file(BYTES)
    want = [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert C.counter(BYTES, 5, chunk, overlap)(texts) == want


def test_texts_without_spaces_take_time_in_proportion():
    """Japanese sentences, one word without an end, and empty lines: what is encoded grows with the text."""
    tokenizer = Tokenizer.from_file(BYTES)
    for unit in ("これは長い文章です。", "あいう", "\n"):
        done = []
        for size in (100_000, 200_000, 400_000):
            seen = [0]

            def offsets(t, seen=seen):
                seen[0] += len(t)
                return tokenizer.encode(t, add_special_tokens=False).offsets

            text = unit * (size // len(unit))
            n = C.splice(text, offsets)
            done.append(seen[0])
            if size == 100_000:
                assert n == len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert done[2] <= 8 * 400_000 and done[2] <= 3 * done[1]


@pytest.mark.parametrize("path", ["piece_bpe_32k.model"])
def test_other_tokenizers_get_whole_texts(path):
    import sentencepiece

    path = public_tokenizers.path(path)
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    assert C.counter(path, 5, 7, 2)(TEXTS) == [len(own.encode(t)) for t in TEXTS]
    assert [np.frombuffer(x, "<u4").tolist() for x in W.encoder(path)(TEXTS)] == [own.encode(t) for t in TEXTS]


def test_kind_is_read_from_the_file(tmp_path):
    import json

    assert (C.kind(WORDS), C.kind(BYTES)) == ("words", "bytes")
    said = json.load(open(WORDS, encoding="utf-8"))
    said["normalizer"]["normalizers"][0] = {"type": "NFKC"}
    other = tmp_path / "other.json"
    other.write_text(json.dumps(said), encoding="utf-8")
    assert C.kind(str(other)) == "whole"
    encode, tokenizer = W.encoder(str(other)), Tokenizer.from_file(str(other))
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(["ﬁ x", "Ⅷ."])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in ("ﬁ x", "Ⅷ.")]


def test_memo_forgets_in_generations():
    calls = []
    memo = C.Memo(lambda words: calls.extend(words) or [len(w) for w in words], size=C.ENTRY + 10)
    for words in (["a", "bb"], ["ccc"], ["a"], ["dddd", "a"], ["bb"]):
        memo.learn(words)
        assert [memo[w] for w in words] == [len(w) for w in words]
        assert len(memo) <= 4
    assert calls.count("a") == 1


def test_counts_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (None, "a b", 9), (3, "a b", 9), (3, "a b", 9)], "doc_id long, text string, n_chars long")
    got = C.token_counts(docs, BYTES)
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in got.collect()) == [(-1, 2), (1, 0), (2, 0), (3, 2), (3, 2)]
    assert C.token_counts(docs.where(F.lit(False)), BYTES).count() == 0


def test_files_round_trip(spark, texts, tmp_path):
    rows = [(k * 3, t) for k, t in enumerate(texts)] + [(None, "no id"), (3, None), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = f"file://{tmp_path}/tokens"
    manifest = W.write(docs, path, WORDS, shards=3)
    got = [tuple(r) for r in W.read(manifest, path).orderBy("start").collect()]
    tokenizer = Tokenizer.from_file(WORDS)
    ids = lambda t: np.array([*(tokenizer.encode(t, add_special_tokens=False).ids if t else []), 1], "<u4").tobytes()
    assert sorted((-1 if d is None else d, bytes(x)) for d, _, x in got) == sorted((-1 if d is None else d, ids(t)) for d, t in rows)
    order = [-1 if d is None else d for d, _, _ in got]
    assert order == sorted(order)
    starts = np.concatenate([[0], np.cumsum([len(x) // 4 for _, _, x in got])])[:-1]
    assert [s for _, s, _ in got] == starts.tolist()
    some = {r["doc_id"]: r["start"] for r in W.read(manifest, path, only=[9, 30]).collect()}
    assert some == {d: s for d, s, _ in got if d in (9, 30)}
    crc = {r["start"]: r["ids_crc32"] for r in W.digest(W.read(manifest, path)).collect()}
    assert crc == {s: zlib.crc32(x) for _, s, x in got}
    assert W.write_and_read(docs.where(F.lit(False)), WORDS).count() == 0


def test_repeated_ids_are_dealt_out_and_files_agree(spark, tmp_path):
    """Null and repeated ids fill several shards, and a second run writes the same bytes."""
    rows = [(None if k % 2 else 7, f"text {k % 40} and more") for k in range(400)] + [(k, None) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    content = []
    for run, df in enumerate((docs, docs.repartition(5, "text"))):
        path = f"file://{tmp_path}/{run}"
        manifest = W.write(df, path, WORDS, shards=6).orderBy("shard").collect()
        assert len(manifest) >= 4 and max(r["n_docs"] for r in manifest) < 200
        content.append([open(f"{tmp_path}/{run}/{r['file']}", "rb").read() for r in manifest])
    assert content[0] == content[1]


def test_damage_is_found(tmp_path):
    import io

    import pyarrow as pa

    sink = io.BytesIO()
    writer = W.ShardWriter(sink)
    writer.add(5, b"\1\0\0\0" * 50)
    writer.close()
    raw = bytearray(sink.getvalue())
    assert [d for d, _ in W.ShardReader(pa.BufferReader(bytes(raw))).read()] == [5]
    raw[6] ^= 255
    with pytest.raises(Exception):  # noqa: B017
        list(W.ShardReader(pa.BufferReader(bytes(raw))).read())
