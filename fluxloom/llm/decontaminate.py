"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared in lower case with white space collapsed. An item of L
characters has an error budget of floor(L * rate) edits and is split into one piece more,
so every place within the budget holds a piece unchanged. An Aho-Corasick automaton over
all pieces finds their exact hits in one pass; a hit's neighbourhood must share enough
5-grams with the item (no place within the budget shares fewer), and is then measured with
Myers' bit-parallel distance, the item against any substring.

Items are handled in blocks of bounded size, all documents against each block; blocks follow
one another, so the benchmark may be of any size.

Defined results: null and empty texts and items match nothing; an item of fewer than MIN_CHARS
characters after normalising says nothing as a part of a text and matches the texts that
consist of it; of several places of an item in a text the nearest counts, the leftmost of
equals; repeated rows and items each give their pairs; rows with a null id are matched and give
a null id; `clean` looks at each row's own text, whatever its id; an empty table gives no pair;
other columns pass through `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import guarded, materialize, restored, small_batches, trim

RATE, MIN_CHARS = 0.08, 20
#: Characters of items that one block ships to the tasks.
BLOCK_CHARS = 4_000_000
GRAM = 5
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def normalise(text: str) -> str:
    low = text.lower()
    return " ".join((low if len(low) == len(text) else text.translate(ASCII_LOWER)).split())


def original_span(text: str, start: int, end: int) -> tuple[int, int]:
    """The place in the text of a span of normalise(text)."""
    at, words, place = 0, text.split(), 0
    first = last = None
    for w in words:
        place = text.index(w, place)
        if first is None and start < at + len(w):
            first = place + max(0, start - at)
        if end <= at + len(w):
            last = place + max(0, end - at)
            break
        at, place = at + len(w) + 1, place + len(w)
    return (first or 0), (last if last is not None else len(text))


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    cuts = [len(item) * k // (budget + 1) for k in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(item: str, masks: dict[str, int], window: str, best: int) -> tuple[int, int]:
    """The least distance, at most best, of the item to a substring of the window, and where
    the leftmost such substring ends; best + 1 and -1 if there is none."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, found, end = full, 0, m, best + 1, -1
    for k, c in enumerate(window):
        eq = masks.get(c, 0)
        x = eq | minus
        zero = ((((eq & plus) + plus) ^ plus) | x) & full
        ph, mh = minus | (full & ~(zero | plus)), plus & zero
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        plus, minus = mh | (full & ~(zero | ph)), ph & zero
        if score < found:
            found, end = score, k + 1
    return found, end


class Matcher:
    """All places of a block of items in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        given = [(i, t, int(len(t) * rate)) for i, t in ((i, normalise(t or "")) for i, t in items) if t]
        self.items = [x for x in given if len(x[1]) >= MIN_CHARS] + [x for x in given if len(x[1]) < MIN_CHARS]
        self.short: dict[str, list[int]] = {}
        self.made: dict[int, tuple] = {}
        found: dict[str, list] = {}
        for k, (_, t, budget) in enumerate(self.items):
            if len(t) < MIN_CHARS:
                self.short.setdefault(t, []).append(k)
                continue
            for at, piece in pieces(t, budget):
                found.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()

    def _tools(self, k: int) -> tuple:
        if k not in self.made:
            t = self.items[k][1]
            masks, back = {}, {}
            for p, c in enumerate(t):
                masks[c] = masks.get(c, 0) | 1 << p
                back[c] = back.get(c, 0) | 1 << (len(t) - 1 - p)
            self.made[k] = masks, back, {t[p : p + GRAM] for p in range(len(t) - GRAM + 1)}
        return self.made[k]

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item's index, distance, start, end) in the normalised text, the nearest place of
        each item, the leftmost of equals."""
        whole = [(k, 0, 0, len(text)) for k in self.short.get(text, ())]
        if not len(self.automaton):
            return whole
        tried: set[tuple[int, int]] = set()
        best: dict[int, tuple[int, int, int]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for k, at in places:
                _, item, budget = self.items[k]
                begin = end + 1 - size - at
                step = max(1, budget)
                if (k, begin // step) in tried or (k in best and best[k][0] == 0 and begin >= best[k][1]):
                    continue
                tried.add((k, begin // step))
                low = max(0, begin // step * step - budget)  # the whole step of begins is looked at
                window = text[low : begin // step * step + step + len(item) + budget]
                masks, back, grams = self._tools(k)
                need = len(item) - GRAM + 1 - GRAM * budget
                if sum(window[p : p + GRAM] in grams for p in range(len(window) - GRAM + 1)) < need:
                    continue
                distance, stop = myers(item, masks, window, min(budget, best[k][0] if k in best else budget))
                if stop >= 0:
                    _, width = myers(item[::-1], back, window[:stop][::-1], distance)
                    place = distance, low + stop - width, low + stop
                    best[k] = min(place, best.get(k, place))
        return whole + [(k, *v) for k, v in best.items()]


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item: str = "text", rate: float = RATE) -> DataFrame:
    """Pairs of a document and a benchmark item found in it: doc_id, item_id, distance, and the
    span start, end of the nearest place in the document's text."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item_id).alias("i"), F.col(item).alias("t"))
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks, found = -(-chars // BLOCK_CHARS) or 1, None
    for b in range(blocks):
        rows = [tuple(r) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()]  # about BLOCK_CHARS characters
        shipped = spark.sparkContext.broadcast(rows)
        part = _block(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), shipped, rate)
        if blocks > 1:  # one block at a time is held anywhere
            part = materialize(part)
            shipped.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def _block(docs: DataFrame, rows, rate: float) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        matcher = Matcher(rows.value, rate)
        for batch in batches:
            out = []
            for doc_id, t in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                for k, distance, start, end in matcher.find(normalise(t)) if t else ():
                    out.append((doc_id, matcher.items[k][0], distance, *original_span(t, start, end)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return docs.mapInArrow(find, "doc_id long, item_id long, distance int, start int, end int")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without a benchmark item in them, all columns kept."""
    docs, names = guarded(docs)
    docs = docs.withColumn("key", F.xxhash64(names[id_col], names[text]))
    hit = matches(docs, benchmark, "key", names[text], **options).select(F.col("doc_id").alias("hit")).distinct()
    return restored(docs.join(hit, F.col("key") == F.col("hit"), "left_anti"), names)
