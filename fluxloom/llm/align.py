"""Which tokens of two tokenizers stand for the same bytes.

A text is read with a space before it. Its tokens have end offsets in bytes; where a token of
both tokenizers ends, both token lists are cut, and the tokens between two cuts are a group. The
end arrays are walked side by side at an index shift: as long as they agree, the step doubles, and
a stretch of one-to-one groups is jumped; where they differ, the smaller end moves on until the
ends meet, which closes a group of several tokens and gives the next shift. The last tokens of a
group end together and are linked. Tokens of no bytes don't exist in the files taken.

The links of all documents are counted by pair of ids. Each document keeps its distinct pairs;
counts of the most frequent pairs (HOT at most, so that they can be sent to every task) are
looked up where the document is, all other pairs meet their counts in a join; such a pair is rare,
so no key of the join is large.

Files: .json with a byte-level BPE, .model of sentencepiece that puts a space before a text. Where the
files prove that words don't depend on each other (no piece of the .model holds the two characters
at a cut), a batch's new words are encoded and their end arrays walked one behind the other; their
groups are kept in a memo bounded in bytes, and a text's are those of its words. Other files and
texts are walked whole.

Defined results: null and empty texts, and texts whose tokens don't spell the space and the text,
have no tokens: numbers 0 and an empty digest; special strings are plain text; repeated rows count
each; an empty table gives an empty result; the text is not carried along, other columns are, and
those named like an output are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import accumulate, chain, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import guarded, materialize, restored, small_batches, trim
from .token_counts import BLANK, GLUED, RUNS, SPACE, Memo, kind, load, mark

#: Pairs of ids whose counts are sent to the tasks, 20 bytes each.
HOT = 1 << 14
#: Bytes that the memo counts in each of its two generations.
MEMO = 64 << 20
#: A space that begins a token of both tokenizers.
CUT = re.compile(r"(?<=[^\s▁]) (?=\S)")
LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
LINK = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())])
ADDED = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("digest", pa.string()), ("links", pa.list_(LINK)), ("groups", pa.string())]
ADDED_DDL = "n_a long, n_b long, n_groups long, digest string, links array<struct<a:int,b:int,n:int>>, groups string"


class ByteLevel:
    """A byte-level BPE of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.by_words = Tokenizer.from_file(path), kind(path) == "bytes"
        if type(self.tokenizer.decoder).__name__ != "ByteLevel":
            raise ValueError(f"{path}: tokens are no bytes")
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        letters, names = byte_letters(), {i: s for s, i in self.tokenizer.get_vocab().items()}
        self.letter = {b: c for c, b in letters.items()}
        spell = lambda s: bytes(letters[c] for c in s) if all(c in letters for c in s) else s.encode()
        self.tokens = [spell(names.get(i, "")) for i in range(max(names) + 1)]

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(" " + text, add_special_tokens=False).ids

    def words(self, keys: Sequence[str]) -> list[list[int]]:
        one, piece = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids, self.tokenizer.model.tokenize
        byte = self.letter.__getitem__
        # A space and Latin letters are one piece, which the model alone can take.
        return [[t.id for t in piece(SPACE + k if k.isascii() else SPACE + "".join(map(byte, k.encode())))] if LATIN(k) else one(k[1:] if k[:1] == GLUED else " " + k) for k in keys]


class Pieces:
    """A sentencepiece model."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        self.model, said = load(path), sentencepiece_model_pb2.ModelProto()
        said.ParseFromString(self.model.serialized_model_proto())
        rule = said.normalizer_spec
        if not rule.add_dummy_prefix or said.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: it puts no space before a text")
        ids = range(len(self.model))
        names = [self.model.id_to_piece(i) for i in ids]
        self.tokens = [bytes([int(s[3:5], 16)]) if self.model.is_byte(i) else s.replace("▁", " ").encode() for i, s in enumerate(names)]
        inside = [s for i, s in enumerate(names) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        ordinary = said.trainer_spec.model_type == 2 and all(p.type != 4 for p in said.pieces) and rule.escape_whitespaces  # BPE, and no piece of a user's own
        plain = not rule.precompiled_charsmap and not rule.remove_extra_whitespaces
        crossed = re.compile(r"[^▁]▁|[A-Za-zÀ-ÖØ-öø-ÿ][.,]|\n")  # the cuts that `keys_of` makes
        self.by_words = ordinary and plain and not any(crossed.search(s) for s in inside)

    def whole(self, text: str) -> list[int]:
        return self.model.encode(text)

    def words(self, keys: Sequence[str]) -> list[list[int]]:
        # A piece that no space stands before is read after a line break, which is two tokens with the space.
        return [i[2:] if k[:1] == GLUED else i for k, i in zip(keys, self.model.encode(["\n" + k[1:] if k[:1] == GLUED else k for k in keys], num_threads=1), strict=True)]


@lru_cache(maxsize=4)
def side(path: str) -> ByteLevel | Pieces:
    return Pieces(path) if path.endswith(".model") else ByteLevel(path)


def keys_of(text: str) -> list[str]:
    """Words as memo keys: without the space before them, or GLUED and the piece."""
    if not (any(r in text for r in RUNS) or text[0].isspace() or text[-1].isspace() or "▁" in text or BLANK.search(text)):
        return mark(text, f" {GLUED}").replace("\n", f" {GLUED}\n {GLUED}").split(" ")
    ends = [m.start() for m in CUT.finditer(text)]
    return [text[i:j] for i, j in zip([0, *(e + 1 for e in ends)], [*ends, len(text)], strict=True)]


def cuts(a: Sequence[int], b: Sequence[int]) -> tuple[list[int], list[int]]:
    """The indices behind the groups' last tokens, for two lists of ascending ends that end alike."""
    i = j = 0
    behind_a: list[int] = []
    behind_b: list[int] = []
    while i < len(a):
        run, step, grows = 0, 2, True
        while step:
            ahead = a[i + run : i + run + step]
            if ahead and ahead == b[j + run : j + run + step]:
                run += len(ahead)
                step = step * 2 if grows else step // 2
            else:
                grows, step = False, step // 2
        if run:
            behind_a.extend(range(i + 1, i + run + 1))
            behind_b.extend(range(j + 1, j + run + 1))
            i, j = i + run, j + run
            if i == len(a):
                break
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        i, j = i + 1, j + 1
        behind_a.append(i)
        behind_b.append(j)
    return behind_a, behind_b


class Aligned(NamedTuple):
    """A text's or word's groups as they are written, its linked pairs (first id << 32 | second id) as
    bytes, and its numbers of tokens."""

    groups: bytes
    links: bytes
    n_a: int
    n_b: int


@lru_cache(maxsize=4)
def walker(first: str, second: str) -> Callable[[Sequence[Sequence[int]], Sequence[Sequence[int]]], list[Aligned]]:
    """Ids of texts by both files -> their alignments. The texts' end arrays are laid one behind the
    other and walked at once; each text's end is one of both arrays, so no group goes over it."""
    a_tokens, b_tokens = side(first).tokens, side(second).tokens
    a_sizes, b_sizes = (np.array([len(t) for t in tokens], np.int64) for tokens in (a_tokens, b_tokens))
    shown = [b"%d%c" % (i, c) for tokens, ends in ((a_tokens, b",|"), (b_tokens, b",;")) for i in range(len(tokens)) for c in ends].__getitem__

    def walk(a_ids: Sequence[Sequence[int]], b_ids: Sequence[Sequence[int]]) -> list[Aligned]:
        a, b = (np.array(list(chain.from_iterable(x)), np.int64) for x in (a_ids, b_ids))
        a_behind, b_behind = (np.array(x, np.int64) for x in cuts(np.cumsum(a_sizes[a]).tolist(), np.cumsum(b_sizes[b]).tolist()))
        a_in, b_in = np.diff(a_behind, prepend=0), np.diff(b_behind, prepend=0)
        written = np.empty(len(a) + len(b), np.int64)
        a_at = np.arange(len(a)) + np.repeat(b_behind - b_in, a_in)
        b_at = np.arange(len(b)) + np.repeat(a_behind, b_in)
        written[a_at], written[b_at] = 2 * a, 2 * (b + len(a_tokens))
        written[a_at[a_behind - 1]] += 1
        written[b_at[b_behind - 1]] += 1
        said = list(map(shown, written.tolist()))
        links = (a[a_behind - 1] << 32 | b[b_behind - 1]).tobytes()
        a_n, b_n = list(map(len, a_ids)), list(map(len, b_ids))
        a_ends = list(accumulate(a_n, initial=0))
        ends = [x + y for x, y in zip(a_ends, accumulate(b_n, initial=0), strict=True)]
        groups = [8 * g for g in np.searchsorted(a_behind, a_ends, "right").tolist()]
        return [Aligned(b"".join(said[i:j])[:-1], links[g:h], m, n) for (i, j), (g, h), m, n in zip(pairwise(ends), pairwise(groups), a_n, b_n, strict=True)]

    return walk


@lru_cache(maxsize=4)
def aligner(first: str, second: str) -> Callable[[Sequence[str]], list[Aligned | None]]:
    """Texts -> their alignments; None for texts that either file can't spell."""
    sides, walk = (side(first), side(second)), walker(first, second)

    def spells(text: bytes, ids: Sequence[Sequence[int]]) -> bool:
        return all(b"".join(map(s.tokens.__getitem__, i)) == text for s, i in zip(sides, ids, strict=True))

    def checked(texts: list[bytes], a: list[list[int]], b: list[list[int]]) -> list[Aligned | None]:
        right = [spells(*x) for x in zip(texts, zip(a, b, strict=True), strict=True)]
        found = iter(walk(*([i for i, r in zip(x, right, strict=True) if r] for x in (a, b))))
        return [next(found) if r else None for r in right]

    def new(keys: Sequence[str]) -> list[Aligned | None]:
        return checked([(k[1:] if k[:1] == GLUED else " " + k).encode() for k in keys], *(s.words(keys) for s in sides))

    memo, by_words = Memo(new, MEMO), all(s.by_words for s in sides)

    def align_texts(texts: Sequence[str]) -> list[Aligned | None]:
        cut = [bool(t) and by_words and GLUED not in t for t in texts]
        keys = [keys_of(t) if c else [] for t, c in zip(texts, cut, strict=True)]
        memo.learn(list(chain.from_iterable(keys)))
        out: list[Aligned | None] = []
        for t, c, k in zip(texts, cut, keys, strict=True):
            if not c:
                out += checked([(" " + t).encode()], *([s.whole(t)] for s in sides)) if t else [None]
                continue
            words = list(map(memo.__getitem__, k))
            if None in words:
                out.append(None)
                continue
            groups, links, n_a, n_b = zip(*words, strict=True)
            out.append(Aligned(b";".join(groups), b"".join(links), sum(n_a), sum(n_b)))
        return out

    return align_texts


def _added(found: list[Aligned | None], groups: bool) -> list[pa.Array]:
    """The columns that a batch's alignments add."""
    found = [x or Aligned(b"", b"", 0, 0) for x in found]
    distinct = [np.unique(np.frombuffer(x.links, np.int64), return_counts=True) for x in found]
    pairs, times = (np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*distinct, strict=True)) if found else (np.empty(0, np.int64),) * 2
    links = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (pairs >> 32, pairs & 0xFFFFFFFF, times)], fields=list(LINK))
    ends = np.cumsum([0, *(len(x) for x, _ in distinct)]).astype(np.int32)
    digests = [hashlib.sha256(x.groups).hexdigest() if x.n_a else "" for x in found]
    numbers = [pa.array(x, pa.int64()) for x in ([x.n_a for x in found], [x.n_b for x in found], [len(x.links) // 8 for x in found])]
    return [*numbers, pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(ends), links), pa.array([x.groups.decode() if groups else None for x in found], pa.string())]


def tokens(docs: DataFrame, first: str, second: str, text: str, groups: bool) -> DataFrame:
    """The other columns of docs with each text's numbers of tokens and groups, digest, distinct links
    with their number in the text, and the groups themselves if asked for."""
    kept = [c for c in docs.columns if c != text]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        align_texts = aligner(first, second)
        for batch in batches:
            found = align_texts([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *_added(found, groups)], [*kept, *(n for n, _ in ADDED)])

    schema = docs.select(*kept).schema
    return docs.select(*kept, text).mapInArrow(add, f"{schema.simpleString()[7:-1] + ', ' if kept else ''}{ADDED_DDL}")


def hot_count(counts: DataFrame, most: int) -> int:
    """The count from which on at most `most` pairs are counted so often: by a histogram of at most
    1024 steps."""
    step = F.floor(16 * F.log2("count"))
    level, taken = 1024, 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.step):
        taken += r.n
        if taken > most:
            break
        level = r.step
    return level


def align(docs: DataFrame, first: str, second: str, text: str = "text", groups: bool = False, hot: int = HOT) -> DataFrame:
    """The columns of docs but its text, with n_a, n_b, n_groups, n_links, n_best (links whose count is
    the highest of their second id), count_sum (counts of the links) and groups_sha256; with the
    column groups, if it is asked for."""
    small_batches(docs.sparkSession)
    own, names = guarded(docs)
    rows = materialize(tokens(own, first, second, names.pop(text), groups).withColumn("row", F.monotonically_increasing_id()))
    links = rows.select("row", F.inline("links"))
    counts = materialize(links.groupBy("a", "b").agg(F.sum("n").alias("count")))
    # One row for each id of the second vocabulary.
    best = counts.groupBy("b").agg(F.max("count").alias("top"))
    known = counts.join(F.broadcast(best), "b").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))
    is_hot = F.floor(16 * F.log2("count")) >= hot_count(counts, hot)
    near = links.join(F.broadcast(known.where(is_hot)), ["a", "b"], "left")
    far = near.where("count IS NULL").select("row", "a", "b", "n").join(known.where(~is_hot), ["a", "b"])
    summed = lambda df: df.groupBy("row").agg(F.sum(F.col("n") * F.col("count")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"))
    both = summed(near.where("count IS NOT NULL")).unionByName(summed(far)).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    out = rows.join(both, "row", "left").select("*", F.col("n_groups").alias("n_links")).na.fill(0, ["count_sum", "n_best"])
    added = {c: c for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")} | {"groups_sha256": "digest"} | ({"groups": "groups"} if groups else {})
    return restored(out, names, **added)
