"""Exact BPE encoding by dynamic programming over prefixes, and decoding.

Every prefix of a piece has one last token in its encoding. An automaton over the vocabulary
reads the piece; its state is the longest suffix read so far that begins a token, and names the
tokens that end there, longest first. The last token is the one that is compatible with the last
token of the prefix before it: a pair is compatible if no merge crosses its border before both of
its tokens are built. Back-pointers, from the end of the piece, give the ids. Nothing is merged, and
each character costs a look-up, however long the piece is.

This needs a file in which each token is built by one merge, of tokens that earlier merges built;
other files raise ValueError. What cuts a text into pieces is read from the file (`kind`); special
strings inside texts become their ids. Words are kept with their ids in a memo bounded in bytes.

Decoding puts the tokens of the file together as its decoder says: joined by a space where it has
none, as bytes where it is byte-level (wrong UTF-8 becomes U+FFFD). Ids that the file doesn't know
are left out.

Defined results: null and empty texts have no ids, null and empty ids decode to an empty text;
repeated rows each get a row; null ids of documents stay null; an empty table gives an empty result;
other columns pass through, and one named like the output is replaced.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import accumulate, chain, islice, pairwise
from os.path import commonprefix

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, trim
from .token_counts import Memo, keys_of, kind, load, piece_of, specials
from .token_files import Characters, words_of

#: Pairs whose compatibility is remembered.
PAIRS = 1 << 20
#: How far the last character of a word is moved, so that it is one character with the word's end.
END = 0x10000


class Vocabulary:
    """The tokens of a file, their merges and the automaton over them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path}: not a plain BPE")
        self.ids, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        size = max(self.ids.values()) + 1
        self.rank, self.left, self.right = [-1] * size, [0] * size, [0] * size
        self.merges: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            made, x, y = self.ids.get(a + b), self.ids.get(a), self.ids.get(b)
            if made is None or x is None or y is None or self.rank[made] >= 0:
                raise ValueError(f"{path}: merge {rank} builds no token of its own")
            self.rank[made], self.left[made], self.right[made] = rank, x, y
            self.merges[x, y] = rank
        if any(max(self.rank[x], self.rank[y]) >= rank for (x, y), rank in self.merges.items()):
            raise ValueError(f"{path}: a merge comes before those that build its parts")
        self.seen: dict[int, bool] = {}
        self._automaton()

    def spelled(self, token: str) -> str:
        return token[: -len(self.end) - 1] + chr(ord(token[-len(self.end) - 1]) + END) if self.end and token.endswith(self.end) and token != self.end else token

    def piece(self, piece: str) -> str:
        """A piece in the automaton's alphabet."""
        return piece[:-1] + chr(ord(piece[-1]) + END) if self.end and piece else piece

    def crosses(self, x: int, y: int, before: int) -> bool:
        """Whether a merge of a rank below `before` crosses the border of two adjacent tokens."""
        x_until = y_until = before
        while True:
            # Equal ranks: of three equal tokens in a row the two on the left merge.
            rank = self.merges.get((x, y))
            if rank is not None and rank < x_until and rank <= y_until:
                return True
            if self.rank[x] > self.rank[y]:
                x_until, x = self.rank[x], self.right[x]
            elif self.rank[y] >= 0:
                y_until, y = self.rank[y], self.left[y]
            else:
                return False

    def _automaton(self) -> None:
        # A token that other merges take apart before it is built is never in an encoding.
        made = [t for t in self.ids.values() if self.rank[t] < 0 or not self.crosses(self.left[t], self.right[t], self.rank[t])]
        spelling = {t: self.spelled(s) for s, t in self.ids.items()}
        self.go: list[dict[str, int]] = [{}]
        self.fail, own = [0], [-1]
        for t in made:
            state = 0
            for c in spelling[t]:
                step = self.go[state].get(c)
                if step is None:
                    step = self.go[state][c] = len(self.go)
                    self.go.append({})
                    self.fail.append(0)
                    own.append(-1)
                state = step
            own[state] = t
        self.length, self.shorter = [0] * len(self.rank), [-1] * len(self.rank)
        self.longest = own[:]
        waiting = deque(self.go[0].values())
        while waiting:  # nearer states first, so a state's suffix is done before it
            state = waiting.popleft()
            below = self.longest[self.fail[state]]
            if own[state] >= 0:
                self.shorter[own[state]] = below
            else:
                self.longest[state] = below
            for c, step in self.go[state].items():
                back = self.fail[state]
                while back and c not in self.go[back]:
                    back = self.fail[back]
                self.fail[step] = self.go[back].get(c, 0) if state else 0
                waiting.append(step)
        for t in made:
            self.length[t] = len(spelling[t])

    def encode(self, pieces: Sequence[str]) -> list[list[int]]:
        """The ids of pieces of text in the file's alphabet. They are taken in order, so that each goes on
        from the prefix that it shares with the one before."""
        out: list[list[int]] = [[]] * len(pieces)
        before, states, last = "", [0], []
        for k in sorted(range(len(pieces)), key=pieces.__getitem__):
            piece = self.piece(pieces[k])
            same = len(commonprefix((before, piece)))
            del states[same + 1 :], last[same:]
            self._read(piece, same, states, last)
            ids, end, before = [], len(piece), piece
            while end:
                token = last[end - 1]
                if token < 0:
                    raise ValueError(f"the vocabulary can't spell {pieces[k]!r}")
                ids.append(token)
                end -= self.length[token]
            ids.reverse()
            out[k] = ids
        return out

    def _read(self, piece: str, start: int, states: list[int], last: list[int]) -> None:
        """Add the states and last tokens of a piece's prefixes longer than `start`."""
        go, fail, longest, shorter, length, seen = self.go, self.fail, self.longest, self.shorter, self.length, self.seen
        state = states[-1]
        for end, c in enumerate(piece[start:], start + 1):
            step = go[state].get(c)
            while step is None and state:
                state = fail[state]
                step = go[state].get(c)
            state = step or 0
            token = longest[state]
            while token >= 0:
                at = end - length[token]
                if not at:
                    break
                pair = last[at - 1] << 32 | token
                fits = seen.get(pair)
                if fits is None:
                    if len(seen) >= PAIRS:
                        seen.clear()
                    fits = seen[pair] = last[at - 1] >= 0 and not self.crosses(last[at - 1], token, len(self.merges))
                if fits:
                    break
                token = shorter[token]
            states.append(state)
            last.append(token)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[Sequence[str]], list[bytes]]:
    """Texts -> bytes of their ids."""
    how = kind(path)
    if how == "whole":
        raise ValueError(f"{path}: it can't be read from the file what cuts a text")
    tokenizer, words, own = load(path), vocabulary(path), specials(path)
    cut = lambda text: [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)]
    packed = lambda pieces: np.array(list(chain.from_iterable(words.encode(pieces))), "<u4").tobytes()

    def each(parts: list[list[str]]) -> list[bytes]:
        """The bytes of the ids of lists of pieces."""
        found = words.encode(list(chain.from_iterable(parts)))
        flat, sizes = np.array(list(chain.from_iterable(found)), "<u4").tobytes(), iter(map(len, found))
        ends = [0, *accumulate(4 * sum(islice(sizes, len(p))) for p in parts)]
        return [flat[i:j] for i, j in pairwise(ends)]

    special = re.compile("|".join(re.escape(s) for s in sorted(own, key=len, reverse=True)) or "(?!)")

    if how == "bytes":
        memo = Memo(lambda keys: each([cut(piece_of(k)) for k in keys]))

        def plain(texts: Sequence[str]) -> list[bytes]:
            keys = [keys_of(t) if t else [] for t in texts]
            memo.learn(list(chain.from_iterable(keys)))
            return [b"".join(map(memo.__getitem__, k)) for k in keys]

    else:
        characters = Characters(tokenizer)
        memo = Memo(lambda keys: each([[k] if k.isascii() and k.isalpha() else [p.translate(characters.bytes) for p in characters.pieces(k)] for k in keys]))

        def plain(texts: Sequence[str]) -> list[bytes]:
            known = [characters.all_known(t) for t in texts]
            keys = [words_of(t.lower(), characters.pieces) if k else [] for t, k in zip(texts, known, strict=True)]
            memo.learn(list(chain.from_iterable(keys)))
            return [
                b"".join(map(memo.__getitem__, w)) if k else packed(cut(tokenizer.normalizer.normalize_str(t))) for t, k, w in zip(texts, known, keys, strict=True)
            ]

    def around(text: str) -> bytes:
        """A text with special strings: they are taken out before all else."""
        ids = [np.array([tokenizer.token_to_id(s)], "<u4").tobytes() for s in special.findall(text)] + [b""]
        return b"".join(chain.from_iterable(zip(plain(special.split(text)), ids, strict=True)))

    def encode(texts: Sequence[str]) -> list[bytes]:
        found = [bool(special.search(t)) for t in texts]
        rest = iter(plain([t for t, f in zip(texts, found, strict=True) if not f]))
        return [around(t) if f else next(rest) for t, f in zip(texts, found, strict=True)]

    return encode


@lru_cache(maxsize=4)
def decoder(path: str) -> Callable[[bytes], str]:
    """Bytes of ids -> text."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    names = {i: s for s, i in said["model"]["vocab"].items()} | {t["id"]: t["content"] for t in said.get("added_tokens") or []}
    how = (said.get("decoder") or {}).get("type")
    if how not in (None, "ByteLevel"):
        raise ValueError(f"{path}: unknown decoder {how}")
    if how is None:
        return lambda ids: " ".join([names[i] for i in np.frombuffer(ids, "<u4").tolist() if i in names])
    from_byte = byte_letters()
    table = {i: bytes(from_byte[c] for c in s) if all(c in from_byte for c in s) else s.encode() for i, s in names.items()}
    return lambda ids: b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist() if i in table]).decode("utf-8", "replace")


def byte_letters() -> dict[str, int]:
    """Letters by which byte-level vocabularies write bytes: visible Latin-1 characters stand for
    themselves, the others are numbered from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def encode(docs: DataFrame, tokenizer: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the ids of each text by the tokenizer file at `tokenizer`, as little-endian unsigned
    32-bit integers in one binary column."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("_text_to_encode"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        texts_to_ids = encoder(tokenizer)
        for batch in batches:
            ids = texts_to_ids([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.binary())], [*batch.schema.names[:-1], out])

    schema = docs.drop("_text_to_encode").schema.add(out, "binary")
    return docs.mapInArrow(add, schema)


def decode(rows: DataFrame, tokenizer: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text that the ids of a binary column stand for."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids_to_text = decoder(tokenizer)
        for batch in batches:
            yield pd.Series([ids_to_text(b or b"") for b in batch], dtype=object)

    small_batches(rows.sparkSession)
    return rows.withColumn(out, texts(F.col(f"`{ids}`")))
