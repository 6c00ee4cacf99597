"""Token-ID files of independent zstandard frames with a trailing seek table.

A shard holds documents in ascending id order. Its body is a run of zstandard frames; each
frame holds the token ids of whole documents as little-endian unsigned 32-bit integers and
can be decompressed by itself. The seek table follows in a zstandard skippable frame, so
ordinary tools read the file too: for each frame its place, sizes and the crc32 of its
content, for each document its id, frame, place and length. The last 16 bytes are the
table's length and crc32 and a magic word. Readers fetch the table, then only the frames of
the documents asked for, and check each frame.

Documents are dealt to shards by ranges of ids, repeated ids in the order of their texts; the
number of shards follows the size of the texts. A task writes its shard under a name of its
own, and the manifest names the files of those tasks that Spark took as done: a repeated task
leaves an equal file that no reader opens, and nothing is ever renamed.

Defined results: null and empty texts hold only the end id; rows with a null id come first
and are returned with a null id; repeated rows are written each; an empty table gives no
shard; columns other than id and text are ignored.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from .common import materialize, shared_dir, small_batches, trim
from .token_counts import Memo, keys_of, kind, load, many, piece_of, specials

MAGIC, SKIPPABLE = b"FLUXTOK1", 0x184D2A5E
#: Bytes of ids from which a frame is closed, and bytes of text that a shard should take.
FRAME_BYTES, SHARD_BYTES = 1 << 18, 16 << 20
FRAMES = np.dtype([("offset", "<u8"), ("size", "<u4"), ("raw", "<u4"), ("crc", "<u4")])
DOCS = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("frame", "<u4"), ("at", "<u4"), ("n", "<u4")])
#: Characters of a text that a tokenizer of whole texts is given at once, up to the next space.
PART = 1 << 16
#: Two marks that stand together, of which the second is one that ends sentences.
PAIR = re.compile(r"[.,](?<![\w\s][.,])|_[.,]")


class Characters:
    """Which characters a tokenizer of words folds and cuts one by one, asked of its own parts a
    block of 128 at a time when a text first holds one of them: letters, digits, marks and blanks
    that no mark beside them changes. Texts of other characters go to the tokenizer as they are."""

    def __init__(self, tokenizer):
        self.tokenizer, self.blocks, self.classes = tokenizer, set(), {k: set() for k in ("letter", "digit", "mark", "blank", "capital")}
        self.level, self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False), {}
        self._ask({0, 1, 2})

    def _kind(self, c: str) -> str | None:
        if c in " \t\n\v\f\r":
            return "blank"
        if c < " " or unicodedata.category(c)[0] not in "LNPS" or unicodedata.normalize("NFC", c) != c or unicodedata.normalize("NFC", "e" + c) != "e" + c or "\u1100" <= c <= "\u11ff":
            return None
        low = self.tokenizer.normalizer.normalize_str(c)
        if low != c:
            return "capital" if low == c.lower() and len(low) == 1 and c != "Σ" else None
        pieces = lambda t: [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(t)]
        if len(pieces("a" + c)) == 1:
            return "letter"
        return "digit" if len(pieces(c + c)) == 2 else "mark"

    def _ask(self, blocks: set[int]) -> None:
        for c in (chr(p) for b in blocks for p in range(b << 7, (b + 1) << 7) if not 0xD800 <= p < 0xE000):
            if found := self._kind(c):
                self.classes[found].add(c)
                self.bytes[ord(c)] = self.level.pre_tokenize_str(c)[0][0]
        self.blocks |= blocks
        # A capital is known only with its small letter.
        small = self.classes["letter"] | self.classes["mark"]
        text = {k: "".join(map(re.escape, sorted(v))) for k, v in self.classes.items()}
        text["capital"] = "".join(map(re.escape, sorted(c for c in self.classes["capital"] if c.lower() in small)))
        self.other = re.compile(f"[^{''.join(text.values())}]")
        self.pieces = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{text['letter']}]+|[{text['digit']}]|[{text['mark']}]+").findall

    def all_known(self, text: str) -> bool:
        if not self.other.search(text):
            return True
        if new := {ord(c) >> 7 for c in set(text)} - self.blocks:
            self._ask(new)
        return not self.other.search(text)


def words_of(text: str, pieces: Callable[[str], list[str]]) -> list[str]:
    """Words of a folded text that are encoded independently of each other."""
    if PAIR.search(text):
        return pieces(text)
    return text.replace(".", " .").replace(",", " ,").split()


@lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[Sequence[str]], list[bytes]]:
    """Texts -> bytes of their ids. Where the tokenizer's file says that its pieces don't depend
    on each other (`kind`), each word is encoded once and kept in a bounded memo."""
    tokenizer = load(path)
    if path.endswith(".model"):
        return lambda texts: [np.array(tokenizer.encode(t), "<u4").tobytes() for t in texts]
    alone = lambda t: np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    if kind(path) == "bytes":
        each = many(path)
        memo = Memo(lambda keys: [x.astype("<u4").tobytes() for x in each([piece_of(k) for k in keys])])

        def encode_bytes(texts: Sequence[str]) -> list[bytes]:
            keys = [keys_of(t) if t else [] for t in texts]
            memo.learn(list(chain.from_iterable(keys)))
            return [b"".join(map(memo.__getitem__, k)) for k in keys]

        return encode_bytes
    if kind(path) == "whole":
        return lambda texts: [alone(t) for t in texts]

    own, characters, model = specials(path), Characters(tokenizer), tokenizer.model

    def new(words: Sequence[str]) -> list[bytes]:
        """Pieces that are folded and cut already go to the model itself."""
        out = []
        for w in words:
            found = (w,) if w.isascii() and w.isalpha() else characters.pieces(w)
            ids = [t.id for p in found for t in model.tokenize(p if p.isascii() else p.translate(characters.bytes))]
            out.append(np.array(ids, "<u4").tobytes())
        return out

    def by_parts(text: str) -> bytes:
        """A text with characters of any kind; nothing crosses a space."""
        out, at = [], 0
        while at < len(text):
            stop = text.find(" ", at + PART)
            stop = len(text) if stop < 0 else stop
            out.append(alone(text[at:stop]))
            at = stop
        return b"".join(out)

    memo = Memo(new)

    def encode(texts: Sequence[str]) -> list[bytes]:
        plain = [characters.all_known(t) and not any(s in t for s in own) for t in texts]
        words = [words_of(t.lower(), characters.pieces) if p else [] for t, p in zip(texts, plain, strict=True)]
        memo.learn(list(chain.from_iterable(words)))
        return [b"".join(map(memo.__getitem__, w)) if p else by_parts(t) for t, p, w in zip(texts, plain, words, strict=True)]

    return encode


def _file(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


class ShardWriter:
    def __init__(self, sink, level: int = 3):
        self.sink, self.level, self.at = sink, level, 0
        self.frames, self.docs, self.ids, self.held = [], [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(self.frames), self.held, len(ids) // 4))
        self.ids.append(ids)
        self.held += len(ids)
        if self.held >= FRAME_BYTES:
            self._close_frame()

    def _close_frame(self) -> None:
        raw = b"".join(self.ids)
        frame = zstandard.ZstdCompressor(level=self.level, write_checksum=True).compress(raw)
        self.sink.write(frame)
        self.frames.append((self.at, len(frame), len(raw), zlib.crc32(raw)))
        self.at, self.ids, self.held = self.at + len(frame), [], 0

    def close(self) -> int:
        if self.held:
            self._close_frame()
        body = struct.pack("<II", len(self.frames), len(self.docs)) + np.array(self.frames, FRAMES).tobytes() + np.array(self.docs, DOCS).tobytes()
        body = zlib.compress(body)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(body) + 16) + body + struct.pack("<II", len(body), zlib.crc32(body)) + MAGIC)
        return sum(d[4] for d in self.docs)


class ShardReader:
    def __init__(self, source):
        self.source, size = source, source.size()
        source.seek(size - 16)
        length, crc = struct.unpack("<II", (tail := source.read(16))[:8])
        if tail[8:] != MAGIC:
            raise ValueError("no seek table")
        source.seek(size - 16 - length)
        body = source.read(length)
        if zlib.crc32(body) != crc:
            raise ValueError("the seek table is damaged")
        body = zlib.decompress(body)
        n, m = struct.unpack("<II", body[:8])
        self.frames = np.frombuffer(body, FRAMES, n, 8)
        self.docs = np.frombuffer(body, DOCS, m, 8 + FRAMES.itemsize * n)

    def frame(self, k: int) -> bytes:
        f = self.frames[k]
        self.source.seek(int(f["offset"]))
        raw = zstandard.ZstdDecompressor().decompress(self.source.read(int(f["size"])), int(f["raw"]))
        if zlib.crc32(raw) != f["crc"]:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def read(self, only: set[int] | None = None) -> Iterator[tuple[int | None, bytes]]:
        """Documents in file order, those of the ids `only` or all; other frames stay unread."""
        held, raw = -1, b""
        for d in self.docs:
            if only is None or (int(d["doc_id"]) in only and not d["null"]):
                if d["frame"] != held:
                    held, raw = int(d["frame"]), self.frame(int(d["frame"]))
                at = int(d["at"])
                yield None if d["null"] else int(d["doc_id"]), raw[at : at + 4 * int(d["n"])]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text: str = "text", shards: int | None = None) -> DataFrame:
    """Write shards below path and return their manifest: shard, file, n_docs, n_tokens, start."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    shards = shards or max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES))
    small_batches(spark)
    end = struct.pack("<I", end_id)
    schema = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        encode, writer = encoder(tokenizer), None
        fs, root = _file(path)
        for batch in batches:
            if writer is None and batch.num_rows:
                shard = batch["shard"][0].as_py()
                name = f"shard-{shard:06d}-{uuid.uuid4().hex}.tok"
                fs.create_dir(root, recursive=True)
                sink = fs.open_output_stream(f"{root}/{name}")
                writer = ShardWriter(sink)
            for doc_id, ids in zip(batch["id"].to_pylist(), encode([t or "" for t in batch["text"].to_pylist()]), strict=True):
                writer.add(doc_id, ids + end)
        if writer is not None:
            n = writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [name], "n_docs": [len(writer.docs)], "n_tokens": [n]}, schema=schema)

    # Ranges go by a hash of the text after the id, so repeated and null ids are dealt out, too.
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text").alias("h").asc()]
    ranged = docs.repartitionByRange(shards, *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    manifest = materialize(ranged.select(F.spark_partition_id().alias("shard"), "id", "text").mapInArrow(put, "shard int, file string, n_docs long, n_tokens long"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(manifest: DataFrame, path: str, only: list[int] | None = None) -> DataFrame:
    """Documents of the shards: doc_id, start (ids of all documents before it), ids as bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])
    wanted = set(only) if only is not None else None

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file(path)
        for batch in batches:
            for name, start in zip(batch["file"].to_pylist(), batch["start"].to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as source:
                    reader = ShardReader(source)
                    starts = start + np.concatenate([[0], np.cumsum(reader.docs["n"].astype(np.int64))])
                    if wanted is not None:
                        starts = starts[:-1][np.isin(reader.docs["doc_id"], list(wanted)) & (reader.docs["null"] == 0)]
                    rows, held = [], 0
                    for at, (doc_id, ids) in zip(starts.tolist(), reader.read(wanted), strict=False):
                        rows.append((doc_id, at, ids))
                        held += len(ids)
                        if held >= 4 * FRAME_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return manifest.select("file", "start").repartition("file").mapInArrow(get, "doc_id long, start long, ids binary")


def digest(documents: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of documents read from the files."""
    n = (F.octet_length("ids") / 4).cast("long")
    return documents.select("doc_id", "start", n.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def write_and_read(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    path = shared_dir(docs.sparkSession)
    path = path if "://" in path else f"file://{path}"
    return digest(read(write(docs, path, tokenizer, **options), path))
