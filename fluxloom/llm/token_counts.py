"""Token counts with overlap resynchronisation for huge documents.

A document beyond HUGE characters is encoded in overlapping chunks with offsets. Two
neighbouring encodings are spliced at a stable common boundary: a place inside the overlap
where both encodings begin a token and where the pre-tokenizer of a byte-level BPE always
cuts, whatever stands before: at a space that a character other than white space follows, or
after a letter that no letter follows. So tokens on both sides are those of the whole text.
Where an overlap holds no such place it is doubled; once it has reached the chunk's own
beginning, the chunk is doubled instead, so the work stays in proportion to the text.

Other documents are cut at the same kind of boundary, once for each word; a memo bounded in
bytes holds the counts of words seen before, and a batch's new words are encoded at once.

Defined results: null and empty texts have no bytes and no tokens; repeated rows each get a
row; null ids stay null; an empty table gives an empty result; other columns pass through,
and one named like the output is replaced.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Characters from which a document is encoded in overlapping chunks, and their sizes.
HUGE, CHUNK, OVERLAP = 32_768, 16_384, 256
#: Bytes that a worker's memo holds in each of its two generations, and what an entry takes
#: besides its word.
MEMO, ENTRY = 32 << 20, 240
#: New words that are encoded at once.
TOGETHER = 512
GLUED = "\x01"
#: Fixed value: how a byte-level BPE writes a space.
SPACE = "\u0120"
#: A space that a non-space follows never lies inside a token or changes the tokens before it.
CUT = re.compile(r" (?=\S)")
#: A lone mark between a Latin letter and white space is a token's beginning and end too.
MARK = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-ÿ])([.,])(?=[ \n]|$)")
#: Where a mark before white space has no such letter before it.
UNLIKE = re.compile(r"[.,](?=[ \n]|$)(?<![A-Za-zÀ-ÖØ-öø-ÿ][.,])")
#: What the quick way of cutting can't take: other white space than these two, and runs of them.
BLANK = re.compile(r"[\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
RUNS = ("  ", "\n\n", " \n", "\n ", GLUED)


class Memo(dict):
    """Word -> value, values of new words by `encode` in batches. When it is full it begins anew,
    but a word of the generation before is taken over without encoding it again."""

    def __init__(self, encode: Callable[[Sequence[str]], Sequence], size: int = MEMO):
        self.encode, self.size, self.held, self.old = encode, size, 0, {}

    def learn(self, words: Sequence[str]) -> None:
        """Make sure of all words."""
        new = [w for w in set(words) if w not in self]
        if new and self.held > self.size:
            self.old, self.held = dict(self), 0
            self.clear()
            new = list(set(words))
        if self.old and (again := [w for w in new if w in self.old]):
            self.update((w, self.old[w]) for w in again)
            self.held += ENTRY * len(again)
            new = [w for w in new if w not in self]
        if new:
            self.update(zip(new, self.encode(new), strict=True))
            self.held += ENTRY * len(new) + sum(map(len, new))


@lru_cache(maxsize=4)
def load(path: str):
    """A tokenizer file: .json by tokenizers, .model by sentencepiece."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


#: Fixed value: the pattern that a tokenizer of words cuts by.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@lru_cache(maxsize=4)
def kind(path: str) -> str:
    """What the file itself says of neighbouring words: "words" if white space is dropped and each
    piece of a known pattern is encoded by itself, "bytes" if the known pattern of byte-level
    BPE cuts, "whole" for anything else."""
    if path.endswith(".model"):
        return "whole"
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    added = said.get("added_tokens") or []
    plain = all(not (a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"]) and not re.search(r"[\s.,]", a["content"]) for a in added)
    if not plain or said["model"]["type"] != "BPE" or said["model"].get("dropout") or said.get("post_processor"):
        return "whole"
    first, cut = said.get("normalizer"), said.get("pre_tokenizer") or {}
    level = lambda p, own: p.get("type") == "ByteLevel" and not p["add_prefix_space"] and p.get("use_regex", True) is own
    if first is None and level(cut, True):
        return "bytes"
    steps, cuts = (first or {}).get("normalizers", []), cut.get("pretokenizers", [])
    folds = [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
    if folds and len(cuts) == 2 and cuts[0].get("pattern") == {"Regex": WORDS} and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and level(cuts[1], False):
        return "words"
    return "whole"


def specials(path: str) -> list[str]:
    """The strings that the tokenizer takes out of a text before all else."""
    return [t.content for t in load(path).get_added_tokens_decoder().values()]


def many(path: str) -> Callable[[Sequence[str]], list[np.ndarray]]:
    """The ids of many pieces of text, each as if it stood alone. They are joined by a special
    string, at which the tokenizer cuts before it does anything else."""
    tokenizer, own = load(path), specials(path)
    alone = lambda t: np.array(tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
    if not own:
        return lambda texts: [alone(t) for t in texts]
    mark, number = own[0], tokenizer.token_to_id(own[0])

    def encode(texts: Sequence[str]) -> list[np.ndarray]:
        if any(s in t for t in texts for s in own):
            return [alone(t) for t in texts]
        out = []
        for k in range(0, len(texts), TOGETHER):
            some = texts[k : k + TOGETHER]
            ids = np.array(tokenizer.encode_batch_fast([mark.join(some)], add_special_tokens=False)[0].ids, np.uint32)
            out += [x[1:] if j else x for j, x in enumerate(np.split(ids, np.flatnonzero(ids == number)))]
        return out

    return encode


def splice(text: str, encode: Callable[[str], list[tuple[int, int]]], chunk: int = CHUNK, overlap: int = OVERLAP, own: Sequence[str] = ()) -> int:
    """Tokens of a text by overlapping chunks. encode gives the tokens' offsets; strings of `own`
    are not cut."""
    done, start, stop = 0, 0, min(len(text), chunk)
    spans = encode(text[:stop])  # of text[start:stop]; tokens from `start` on count
    while stop < len(text):
        width, common = overlap, []
        while not common:
            base = max(start, stop - width)
            right_stop = min(len(text), stop + max(chunk, width))
            following = encode(text[base:right_stop])
            if base == start:
                break
            ours, theirs = ({o + a for a, _ in x} for o, x in ((start, spans), (base, following)))
            common = [c for c in ours & theirs if base < c < stop - 1 and boundary(text, c) and not any(text.find(s, max(0, c - len(s) + 1), c + len(s) - 1) >= 0 for s in own)]
            width *= 2
        if not common:  # no place to cut: this chunk, encoded from its own beginning, takes in the next
            spans, stop = following, right_stop
            continue
        cut = max(common)
        done += sum(start + a < cut for a, _ in spans)
        spans = [(a + base - cut, b + base - cut) for a, b in following if a + base >= cut]
        start, stop = cut, right_stop
    return done + len(spans)


def _letter(c: str) -> bool | None:
    """Whether a character is a letter; None if an old Unicode does not know it yet."""
    known = unicodedata.ucd_3_2_0.category(c)
    return None if known == "Cn" else known[0] == "L"


def boundary(text: str, c: int) -> bool:
    """Whether a byte-level BPE always begins a token at text[c]."""
    if text[c] == " ":
        return bool(text[c + 1 : c + 2].strip())
    return _letter(text[c]) is False and _letter(text[c - 1]) is True and not text[c].isspace()


def mark(text: str, by: str) -> str:
    """Put `by` before each lone mark that ends a word."""
    if UNLIKE.search(text):
        return MARK.sub(rf"{by}\1", text)
    for m in (". ", ", ", ".\n", ",\n"):
        text = text.replace(m, by + m)
    return text[:-1] + by + text[-1] if text.endswith((".", ",")) else text


def keys_of(text: str) -> list[str]:
    """Pieces that a byte-level BPE encodes independently of each other, as memo keys: a piece
    without the space before it, or GLUED and the piece where no space stands before it."""
    if not (any(r in text for r in RUNS) or text[0].isspace() or text[-1].isspace() or BLANK.search(text)):
        marked = mark(text, f" {GLUED}").replace("\n", f" {GLUED}\n {GLUED}")
        return (GLUED + marked).split(" ")
    parts, last = [], 0
    for m in CUT.finditer(text):
        if m.start():
            parts.append(text[last : m.start()])
            last = m.start()
    parts.append(text[last:])
    return [p[1:] if p[0] == " " and p[1:2] not in ("", GLUED) else GLUED + p for p in parts]


def piece_of(key: str) -> str:
    return key[1:] if key[0] == GLUED else " " + key


@lru_cache(maxsize=4)
def counter(path: str, huge: int, chunk: int, overlap: int) -> Callable[[Sequence[str]], list[int]]:
    """Texts -> their numbers of tokens."""
    tokenizer = load(path)
    if path.endswith(".model"):
        return lambda texts: [len(tokenizer.encode(t)) for t in texts]
    if kind(path) != "bytes":  # no boundary is proven: whole texts
        return lambda texts: [len(tokenizer.encode(t, add_special_tokens=False)) for t in texts]
    encode, model, own = many(path), tokenizer.model, specials(path)
    offsets = lambda t: tokenizer.encode(t, add_special_tokens=False).offsets

    def new(keys: Sequence[str]) -> list[int]:
        """A space and letters are one piece, which the model alone can take."""
        words = [k.isascii() and k.isalpha() for k in keys]
        rest = iter(encode([piece_of(k) for k, w in zip(keys, words, strict=True) if not w]))
        return [len(model.tokenize(SPACE + k) if w else next(rest)) for k, w in zip(keys, words, strict=True)]

    memo = Memo(new)

    def count(texts: Sequence[str]) -> list[int]:
        keys = [keys_of(t) if t and len(t) <= huge else [] for t in texts]
        memo.learn(list(chain.from_iterable(keys)))
        return [splice(t, offsets, chunk, overlap, own) if len(t) > huge else sum(map(memo.__getitem__, k)) for t, k in zip(texts, keys, strict=True)]

    return count


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", out: str = "n_tokens", huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Add the number of tokens that the tokenizer file at `tokenizer` gives."""

    @F.pandas_udf("long")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(tokenizer, huge, chunk, overlap)
        for texts in batches:
            yield pd.Series(count([t or "" for t in texts]), dtype="int64")

    small_batches(docs.sparkSession)
    return docs.withColumn(out, counts(F.col(text)))
