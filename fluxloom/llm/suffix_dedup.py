"""Exact removal of repeated byte strings by a common-prefix-aware merge sort of suffix runs.

A byte goes if a string of SPAN bytes that covers it also starts anywhere else. Sorting every
suffix would move each text SPAN times, so suffixes are sorted at anchors only: the anchor of
a window of SPAN bytes is the place of its least K-gram hash, the leftmost of equals. Equal
windows have equal anchors at equal offsets. Neighbouring windows share an anchor; a record
holds for it the bytes from the anchor on (its suffix, at most SPAN bytes) and those before.
Grams that a sample of the texts shows to be common (a licence line, a footer) are anchors only
of windows without any other, so that no anchor meets different bytes beside it in many texts.

1. Documents are dealt to runs of bounded size. A run sorts its records, joins equal ones and
   sends them front-coded (length of the prefix common with the one before, then the rest),
   to the bucket of the anchor's K-gram.
2. A bucket merges its runs with a loser tree that keeps with each candidate the length of
   its prefix common with the last output, so known prefixes are never compared again.
   Neighbours with a common prefix of K bytes or more form a group; in it, windows with a
   bytes before the anchor are equal if those a bytes and the SPAN - a bytes after are.
3. The repeated windows go back to their run, which marks them in its documents.

Runs join equal records before they send them, and a merge passes a repeated record on at
once: a passage that fills a third of all rows costs one record for each run.

Defined results: null and empty texts have no bytes and lose none; texts shorter than SPAN
lose none; repeated rows lose the bytes they share; null ids stay null; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches

SPAN, K = 200, 32
#: Text bytes of a run, of what it sorts at once, and of one pass over the hashes.
RUN_BYTES, SORT_BYTES, BLOCK = 8 << 20, 4 << 20, 1 << 18
#: Uncompressed bytes that a bucket should receive, and about what a text byte sends.
BUCKET_BYTES, SENT = 12 << 20, 3.5
#: Bytes of the texts that show which grams are common, and how often they must be there.
SAMPLE_BYTES, COMMON = 8 << 20, 24
#: Runs of a partition up to which they are dealt out evenly; more even out by themselves.
EVEN = 16
#: Records of one block from which equal ones are joined before the run's sort.
DENSE = 4 * BLOCK // (SPAN - K)

_MIX = np.random.default_rng(7).integers(1, 1 << 63, 300, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
POS, FRONT = np.uint64(BLOCK * 2 - 1), np.uint64(44)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all K-grams of data."""
    h, width, level = _MIX[data], 1, 256
    while width < K:
        h = h[:-width] * _MIX[level] + h[width:]
        width, level = width * 2, level + 1
    h ^= h >> np.uint64(31)
    h *= _MIX[290]
    h ^= h >> np.uint64(29)
    return h


def common_grams(sample: Iterator[bytes]) -> np.ndarray:
    """A table of hash beginnings that marks the K-grams found COMMON times in a sample of texts."""
    texts, held = [], 0
    for t in sample:
        texts.append(t)
        held += len(t)
        if held >= SAMPLE_BYTES:
            break
    table = np.zeros(1 << 20, bool)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) >= K:
        h = np.sort(np.concatenate([gram_hashes(data[a : a + BLOCK + K - 1]) for a in range(0, len(data) - K + 1, BLOCK)]))
        table[h[COMMON - 1 :][h[COMMON - 1 :] == h[: len(h) - COMMON + 1]] >> FRONT] = True
    return table


def anchors(data: np.ndarray, pieces: list[tuple[int, int]], common: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Anchors of the windows that lie inside the pieces (start, end) of data, of at most
    2 * BLOCK bytes: their places, the first and the last window of each, and their hashes."""
    none = tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    if len(data) < SPAN:
        return none
    h = gram_hashes(data)
    low = ((h >> np.uint64(1)) & ~POS) | np.arange(len(h), dtype=np.uint64)
    if common is not None:  # grams that stand in many texts come last
        low |= common[h >> FRONT].astype(np.uint64) << np.uint64(63)
    size, windows = 1, SPAN - K + 1
    while size * 2 <= windows:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if rest := windows - size:
        low = np.minimum(low[:-rest], low[rest:])
    edges = np.zeros(len(data) + 1, np.int8)
    for a, b in pieces:
        if b - a >= SPAN:
            edges[a] += 1
            edges[b - SPAN + 1] -= 1
    starts = np.flatnonzero(np.cumsum(edges[:-1], dtype=np.int8)[: len(low)])
    if not len(starts):
        return none
    place = (low[starts] & POS).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)])
    last = np.r_[new[1:], len(starts)] - 1
    return place[new], starts[new], starts[last], h[place[new]]


BUCKET, RIGHT, LEFT = slice(0, 4), slice(4, 4 + SPAN), slice(5 + SPAN, 5 + 2 * SPAN - K)
WIDTH = 6 + 2 * SPAN - K


def _rows(data: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray, hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Records as rows of bytes: bucket, suffix and its length, bytes before (reversed) and theirs."""
    rows = np.zeros((len(place), WIDTH), np.uint8)
    bucket = ((hashes * _MIX[291]) >> np.uint64(32)) % np.uint64(buckets)
    rows[:, BUCKET] = bucket.astype(">u4").view(np.uint8).reshape(-1, 4)
    right, left = last + SPAN - place, place - first
    for part, n, step in ((RIGHT, right, 1), (LEFT, left, -1)):
        col = np.arange(part.stop - part.start)
        at = place[:, None] + (col if step > 0 else -1 - col)
        rows[:, part] = np.where(col < n[:, None], data[np.clip(at, 0, len(data) - 1)], 0)
        rows[:, part.stop] = n
    return rows


def _joined(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different rows in order, the index of each row's equal among them, and their numbers."""
    order = np.argsort(rows.view(f"S{WIDTH}").ravel(), kind="stable")
    ordered = rows[order]
    new = np.r_[True, (ordered[1:] != ordered[:-1]).any(axis=1)] if len(rows) else np.zeros(0, bool)
    index = np.empty(len(rows), np.int64)
    index[order] = np.cumsum(new) - 1
    return ordered[new], index, np.bincount(index, minlength=int(new.sum()))


class Run:
    """The documents of a run, in an order of its own, and their sorted parts."""

    def __init__(self, docs: pa.Table, common: np.ndarray | None = None):
        self.common = common
        texts = [t or b"" for t in docs["text"].to_pylist()]
        ids = docs["id"].to_pylist()
        self.order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, texts[k]))
        self.ids, self.texts = [ids[k] for k in self.order], [texts[k] for k in self.order]
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        self.ends = np.cumsum([len(t) for t in self.texts], dtype=np.int64)

    def parts(self, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Different records, their numbers, and for all anchors place and index of the record."""
        blocks, held = [], 0
        for lo, hi, pieces in self._blocks():
            data = self.data[lo:hi]
            found = anchors(data, pieces, self.common)
            rows, index, n = _rows(data, *found, buckets), np.arange(len(found[0])), np.ones(len(found[0]), np.int64)
            if len(rows) > DENSE:
                rows, index, n = _joined(rows)
            blocks.append((rows, index, n, found[0] + lo))
            held += hi - lo
            if held >= SORT_BYTES:
                yield self._part(blocks)
                blocks, held = [], 0
        if blocks:
            yield self._part(blocks)

    def _blocks(self) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
        """Stretches of data of at most BLOCK window starts with the pieces of documents in them."""
        pieces, lo, a = [], 0, 0
        for b in self.ends.tolist():
            while b - a >= SPAN:
                stop = min(b, lo + BLOCK + SPAN)
                if stop - a >= SPAN:
                    pieces.append((a - lo, stop - lo))
                    a = stop - SPAN + 1
                if stop < b or stop - lo >= BLOCK:
                    if pieces:
                        yield lo, stop, pieces
                    pieces, lo = [], a
            a = b
            if not pieces:
                lo = b
            elif b - lo >= BLOCK:
                yield lo, lo + pieces[-1][1], pieces
                pieces, lo = [], b
        if pieces:
            yield lo, lo + pieces[-1][1], pieces

    @staticmethod
    def _part(blocks: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        rows, index, _ = _joined(np.concatenate([b[0] for b in blocks]))
        base = np.cumsum([0] + [len(b[0]) for b in blocks])
        each = np.concatenate([index[base[k] + b[1]] for k, b in enumerate(blocks)])
        return rows, np.bincount(each, minlength=len(rows)), np.concatenate([b[3] for b in blocks]), each


def pack(rows: np.ndarray, numbers: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Front-coded records of each bucket."""
    right, left, r, n = rows[:, RIGHT], rows[:, LEFT], rows[:, RIGHT.stop].astype(np.int64), rows[:, LEFT.stop]
    bucket = np.ascontiguousarray(rows[:, BUCKET]).view(">u4").ravel()
    differ = right[1:] != right[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), SPAN)
    common = np.r_[0, np.minimum(common, np.minimum(r[1:], r[:-1]))]
    firsts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    common[firsts] = 0
    col = np.arange(SPAN)
    tails = (col >= common[:, None]) & (col < r[:, None])
    lefts = np.arange(SPAN - K) < n[:, None]
    coder = zstandard.ZstdCompressor(level=3)
    for a, b in zip(firsts.tolist(), [*firsts[1:].tolist(), len(rows)], strict=True):
        body = b"".join(x.tobytes() for x in (common[a:b].astype(np.uint8), r[a:b].astype(np.uint8), n[a:b], numbers[a:b] > 1, right[a:b][tails[a:b]], left[a:b][lefts[a:b]]))
        yield int(bucket[a]), struct.pack("<II", b - a, a) + coder.compress(body)


def unpack(blob: bytes) -> Iterator[tuple[int, bytes, bytes, bool, int]]:
    """(prefix common with the one before, suffix, bytes before, more than one, index)."""
    n, first = struct.unpack("<II", blob[:8])
    body = zstandard.ZstdDecompressor().decompress(blob[8:])
    common, r, left, many = body[:n], body[n : 2 * n], body[2 * n : 3 * n], body[3 * n : 4 * n]
    at, to, suffix = 4 * n, 4 * n + sum(r) - sum(common), b""
    for k in range(n):
        c, size = common[k], r[k] - common[k]
        suffix = suffix[:c] + body[at : at + size]
        yield c, suffix, body[to : to + left[k]], many[k] > 0, first + k
        at, to = at + size, to + left[k]


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    n = min(len(a), len(b))
    while known + 16 <= n and a[known : known + 16] == b[known : known + 16]:
        known += 16
    while known < n and a[known] == b[known]:
        known += 1
    return known


def merge(runs: list[Iterator]) -> Iterator[tuple[int, int, tuple]]:
    """Merge sorted runs of (common, suffix, ...) with a loser tree: yields the prefix common
    with the output before, the run, and the record."""
    size = 1 << max(0, len(runs) - 1).bit_length()
    heads: list = [next(r, None) for r in runs] + [None] * (size - len(runs))
    known = [0] * size  # prefix common with the last output, or with the winner it lost to
    losers = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        s, t = x[1], y[1]
        c = common_prefix(s, t, known[a])
        if c == len(s) or (c < len(t) and s[c] < t[c]):
            known[b] = c
            return a, b
        known[a] = c
        return b, a

    first: dict[int, int] = {}
    for node in range(size - 1, 0, -1):  # leaves stand at size .. 2 * size - 1
        x, y = (c - size if c >= size else first[c] for c in (2 * node, 2 * node + 1))
        first[node], losers[node] = play(x, y)
    best = first[1] if size > 1 else 0
    while (record := heads[best]) is not None:
        yield known[best], best, record
        heads[best] = record = next(runs[best], None)
        known[best] = record[0] if record else 0
        node = (best + size) >> 1
        while node:
            other = losers[node]
            x, y = heads[best], heads[other]
            if x is None:
                best, losers[node] = other, best
            elif y is not None:
                k, o = known[best], known[other]
                if k < o:
                    best, losers[node] = other, best
                elif k == o:
                    best, losers[node] = play(best, other)
            node >>= 1


def repeated(group: list[tuple[int, bytes, bytes, bool, tuple]]) -> Iterator[tuple[tuple, int, int]]:
    """Of records (common, suffix, bytes before, more than one, key) of a group, the ranges
    (key, lo, hi) of bytes before the anchor at which a repeated window begins."""
    if len(group) == 1:
        _, s, left, many, key = group[0]
        if many:
            yield key, SPAN - len(s), len(left)
        return
    if len(group) == 2:
        (_, s, a, many, key), (c, t, b, more, other) = group
        lo, hi = SPAN - c, common_prefix(a, b)
        for x, y, own, full in ((s, a, key, many), (t, b, other, more)):
            if full:
                yield own, SPAN - len(x), len(y)
            elif lo <= hi:
                yield own, max(lo, SPAN - len(x)), min(hi, len(y))
        return
    seen: dict[tuple[bytes, bytes], list] = {}
    rights: list[int] = []  # prefixes common with the different record before
    low = SPAN
    for c, s, left, many, key in group:
        low = min(low, c)
        if (s, left) in seen:
            seen[s, left][0] = True
            seen[s, left][1].append(key)
        else:
            seen[s, left] = [many, [key]]
            rights.append(low)
            low = SPAN
    records = list(seen.items())
    m = len(records)
    right = np.array(rights[1:], np.int64)
    by_left = sorted(range(m), key=lambda k: records[k][0][1])
    left = np.array([common_prefix(records[a][0][1], records[b][0][1]) for a, b in zip(by_left, by_left[1:], strict=False)], np.int64)
    starts = np.unique(np.r_[0, SPAN - right, left + 1])
    starts = starts[(starts >= 0) & (starts <= SPAN - K)]
    twice = np.zeros((m, len(starts)), bool)
    place = np.empty(m, np.int64)
    for k, a in enumerate(starts.tolist()):
        place[by_left] = np.r_[0, np.cumsum(left < a)]
        code = np.r_[0, np.cumsum(right < SPAN - a)] * m + place
        _, where, n = np.unique(code, return_inverse=True, return_counts=True)
        twice[:, k] = n[where] > 1
    stops = np.r_[starts[1:] - 1, SPAN - K]
    for k, ((s, before), (many, keys)) in enumerate(records):
        least, most = SPAN - len(s), len(before)
        spans = [(least, most)] if many else []
        if not many:
            for j in np.flatnonzero(twice[k]).tolist():
                lo, hi = max(least, int(starts[j])), min(most, int(stops[j]))
                if lo <= hi:
                    if spans and spans[-1][1] + 1 >= lo:
                        spans[-1] = spans[-1][0], hi
                    else:
                        spans.append((lo, hi))
        for key in keys:
            yield from ((key, lo, hi) for lo, hi in spans)


def _merged(runs: list[Iterator], names: list[tuple[int, int]]) -> Iterator[tuple[tuple, int, int]]:
    group, again = [], None  # again: the last record, if it has been seen twice
    for common, run, (_, s, left, many, index) in merge(runs):
        key = (*names[run], index)
        if common < K:
            yield from repeated(group) if group else ()
            group, again = [], None
        elif again and again[0] == left and again[1] == s and common == len(s):
            yield key, SPAN - len(s), len(left)
            continue
        elif group and common == len(s) == len(group[-1][1]) and left == group[-1][2]:
            group[-1] = (*group[-1][:3], True, group[-1][4])
            again = left, s
            yield key, SPAN - len(s), len(left)
            continue
        group.append((common, s, left, many, key))
        again = (left, s) if many else None
    yield from repeated(group) if group else ()


def _common(docs: DataFrame, total: int) -> np.ndarray:
    """The table of common grams of a bounded sample; results don't depend on it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = common_grams(t for b in batches for t in b["text"].to_pylist())
        yield pa.RecordBatch.from_pydict({"bits": [np.packbits(table).tobytes()]})

    share = int(min(1.0, SAMPLE_BYTES / max(1, total)) * (1 << 30))
    sample = docs.where((F.pmod(F.xxhash64("id", "text", F.lit("sample")), F.lit(1 << 30)) <= share) & F.col("text").isNotNull())
    rows = sample.select("text").repartition(1).mapInArrow(count, "bits binary").collect()  # SAMPLE_BYTES in, one row out
    return np.unpackbits(np.frombuffer(rows[0]["bits"], np.uint8)).astype(bool) if rows else np.zeros(1 << 20, bool)


def even_names(spark: SparkSession, runs: int, parts: int) -> DataFrame:
    """Rows (number, name): names of runs that Spark's hash deals out to its partitions in equal shares.
    Run r is to be in partition r % parts, under the next name that the hash sends there."""
    tried = spark.range(8 * (runs + parts) + 64).select(F.col("id").cast("int").alias("name"))
    tried = tried.withColumn("part", F.pmod(F.hash("name"), F.lit(parts)))
    place = F.row_number().over(Window.partitionBy("part").orderBy("name")) - 1
    return tried.select((place * parts + F.col("part")).alias("number"), "name").where(F.col("number") < runs)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (array of start, end in bytes) and kept,
    the remaining bytes."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    runs = int(max(1, -(-total // RUN_BYTES), min(64, total >> 18)))
    buckets = int(max(1, total * SENT // BUCKET_BYTES, min(256, total >> 16)))
    # Id and text name the run: copies of a text spread, and both passes see the same runs.
    parts, common = int(spark.conf.get("spark.sql.shuffle.partitions")), _common(docs, total)
    docs = docs.withColumn("run", F.pmod(F.xxhash64("id", "text"), F.lit(runs)).cast("int"))
    if runs <= EVEN * parts:
        # As many rows as runs, so at most EVEN for each partition. A run that got no name keeps one of its own.
        docs = docs.join(F.broadcast(even_names(spark, runs, parts)), F.col("run") == F.col("number"), "left").withColumn("run", F.coalesce("name", -1 - F.col("run"))).drop("number", "name")
    docs = docs.repartition(parts, "run")

    def sort(run: pa.Table) -> pa.Table:
        number, out = run["run"][0].as_py(), []
        for part, (rows, numbers, _, _) in enumerate(Run(run, common).parts(buckets)):
            if len(rows):
                out += [(bucket, number, part, blob) for bucket, blob in pack(rows, numbers)]
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "run", "part", "blob"])

    def combine(blobs: pa.Table) -> pa.Table:
        names = list(zip(blobs["run"].to_pylist(), blobs["part"].to_pylist(), strict=True))
        found = [(*key, lo, hi) for key, lo, hi in _merged([unpack(b) for b in blobs["blob"].to_pylist()], names)]
        columns = np.array(found, np.int32).reshape(-1, 5).T
        return pa.table(list(columns), names=["run", "part", "record", "lo", "hi"])

    kept_schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept", pa.binary())])

    def cut(docs: pa.Table, windows: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return kept_schema.empty_table()
        run, w = Run(docs, common), {c: windows[c].to_numpy() for c in ("part", "record", "lo", "hi")}
        edges = np.zeros(len(run.data) + 1, np.int32)
        if windows.num_rows:
            for part, (_, _, place, record) in enumerate(run.parts(buckets)):
                own = w["part"] == part
                order = np.argsort(w["record"][own], kind="stable")
                number, lo, hi = (w[c][own][order] for c in ("record", "lo", "hi"))
                a, b = np.searchsorted(number, record, "left"), np.searchsorted(number, record, "right")
                n = b - a
                which = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                at = np.repeat(place, n)
                np.add.at(edges, at - hi[which], 1)
                np.add.at(edges, at - lo[which] + SPAN, -1)
        gone = np.cumsum(edges[:-1]) > 0
        spans, kept, start = [], [], 0
        for end in run.ends.tolist():
            own = gone[start:end]
            if own.any():
                turns = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8)))
                spans.append([{"start": a, "end": b} for a, b in turns.reshape(-1, 2).tolist()])
                kept.append(run.data[start:end][~own].tobytes())
            else:
                spans.append([])
                kept.append(run.data[start:end].tobytes())
            start = end
        return pa.table({"doc_id": run.ids, "n_bytes": [len(t) for t in run.texts], "spans": spans, "kept": kept}, schema=kept_schema)

    blobs = docs.groupBy("run").applyInArrow(sort, "bucket int, run int, part int, blob binary")
    windows = blobs.groupBy("bucket").applyInArrow(combine, "run int, part int, record int, lo int, hi int")
    schema = "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary"
    return docs.groupBy("run").cogroup(windows.groupBy("run")).applyInArrow(cut, schema)


def digest(removed: DataFrame) -> DataFrame:
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))
    return removed.select("doc_id", "n_bytes", n.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
