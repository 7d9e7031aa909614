"""Token ids as binary files: documents in ascending doc_id order, blocks of a context-mixing range coder.

A file holds whole documents' ids as one stream, cut into blocks that
``mixcoder`` codes independently of each other, then an index (doc_id and
number of ids of each document) and a footer, all with checksums. Files close
after ``FILE_IDS`` ids, at a document's end.

Writing: documents are encoded, stored, dealt into ranges of (doc_id, hash of
the ids) and sorted; every task writes the files of its range under the shared
folder, with a name of its own for each attempt. A manifest that Spark commits
names the files of the attempts that count, so a lost executor or a second
attempt leaves at most a file that no reader looks at. Reading: the manifest's
files are decoded and checked, and a damaged one raises ``DamagedBlock``.

Encoding repeats segments: a text is cut before single spaces, around single
line ends and before punctuation behind a word, where no token of a byte-level
tokenizer with this splitting pattern reaches over; the library encodes each
distinct segment once and a bounded memory in the worker keeps it.

Defined results: null and empty texts are the end id alone; long texts take
memory in proportion to their length; rows that repeat a doc_id follow each
other in the order of their ids' hash, each with its own row; rows without
doc_id come first; an empty table gives no file and no row; other columns are
not read. doc_id is an integer; ids fit 16 bits.
"""

from __future__ import annotations

import codecs
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from . import mixcoder
from .common import stored

MAGIC = b"IDMIX001"
FOOT = struct.Struct("<QQQI8s")  # place of the index, its bytes, blocks, crc32 of the index
FILE_IDS = mixcoder.BLOCK * mixcoder.LANES
END = 0
TOGETHER = 1 << 17  # characters of texts encoded at once, few enough for the caches; a longer text is encoded alone
MANIFEST = "part int, seq int, path string, n_docs long, n_ids long, n_bytes long"
SPACES = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
UNEVEN = re.compile(f"^[{SPACES}]|[{SPACES}]$|[ \\n][{SPACES}]|[{SPACES}][ \\n]")
EVEN = re.compile(f"(?<=[^{SPACES}]) (?=[^{SPACES}])")
OTHER = re.compile("[\\t\\x0b-\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
WHITE = re.compile(f"[{SPACES}]")
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
# A segment and a space: its word, where punctuation or nothing follows, and what is left of it.
PARTS = re.compile(f"(\\n?[{LETTERS}]+(?=[!-/:-@\\[-`{{-~ ])|)([^ ]*) ")
LETTER = re.compile(f"[{LETTERS}]")
# Byte-level tokenizers write a byte as the character of its number, these excepted; here a space parts words and _ is one.
_UNSEEN = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
_NAMES = "".join(" " if b == 0x20 else "Ġ" if b == ord("_") else chr(0x100 + _UNSEEN.index(b) if b in _UNSEEN else b)
                 for b in range(256))


class Encoder:
    """The library's ids of texts, segment by segment, as 16-bit little-endian bytes.

    A segment's key has a line end in front if it starts a line; all others
    stand for the segment with a space in front.
    """

    SEGMENTS = 500_000
    LONGEST = 48  # characters of a segment that is remembered

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.endings: dict[str, bytes] = {}
        self.line = self.whole(["\n"])[0]
        self._plain()

    def _plain(self) -> None:
        """The library's model behind a splitter at spaces, for words that its own splitting leaves whole."""
        from tokenizers import Tokenizer, models, pre_tokenizers
        own = self.library
        split = own.pre_tokenizer
        self.model = None
        if (isinstance(split, pre_tokenizers.ByteLevel) and split.use_regex and not split.add_prefix_space
                and isinstance(own.model, models.BPE) and own.normalizer is None and len(self.line) == 2
                and not any(LETTER.match(t.content) for t in own.get_added_tokens_decoder().values())):
            self.model = Tokenizer(own.model)
            self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            names = own.get_vocab()
            self.n_bytes = np.zeros(max(names.values()) + 1, np.int64)  # by id; a character of its name is a byte
            self.n_bytes[list(names.values())] = [len(t) for t in names]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes()
                for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, keys: list[str]) -> list[bytes]:
        """Ids of the words of ``LETTERS`` that these keys stand for."""
        if self.model is None or not keys:
            return self._segments(keys)
        text = " ".join(["_" + s if s[0] != "\n" else s[1:] for s in keys])
        text = codecs.charmap_decode(text.encode(), "strict", _NAMES)[0]
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        sums = self.n_bytes.take(ids).cumsum()
        ends = np.cumsum(np.fromiter(map(len, text.split(" ")), np.int64, len(keys)))
        at = sums.searchsorted(ends)
        if len(ids) != at[-1] + 1 or (sums[at] != ends).any():  # a model that leaves bytes out
            return self._segments(keys)
        flat, at = ids.astype("<u2").tobytes(), (2 * at + 2).tolist()
        return [flat[a:b] if s[0] != "\n" else self.line + flat[a:b] for s, a, b in zip(keys, [0, *at], at)]

    def _segments(self, keys: list[str]) -> list[bytes]:
        """Ids of segments by their keys, encoded as the lines of one text: a line end is a token of its own here."""
        if not keys:
            return []
        lines = [s if s[0] == "\n" else "\n " + s for s in keys]
        ids = np.frombuffer(self.whole(["".join(lines)])[0], "<u2")
        at = np.flatnonzero(ids == np.frombuffer(self.line, "<u2")[0]) if len(self.line) == 2 else ids[:0]
        if len(at) != len(keys):  # a tokenizer that splits otherwise
            return self.whole([s if s[0] == "\n" else " " + s for s in keys])
        flat, at = ids.tobytes(), [*(2 * at).tolist(), 2 * len(ids)]
        return [flat[a if s[0] == "\n" else a + 2:b] for s, a, b in zip(keys, at, at[1:])]

    def _learn(self, new: list[str]) -> None:
        """Ids of new segments without white space; a word is looked up without the punctuation behind it."""
        parts = PARTS.findall(" ".join([*new, ""]))
        known, endings = self.known, self.endings
        words = list({a for a, _ in parts if a}.difference(known))
        known.update(zip(words, self._words(words)))
        others = [s for s, (a, _) in zip(new, parts) if not a]
        known.update(zip(others, self._segments(others)))
        ends = list({b for a, b in parts if a and b}.difference(endings))
        endings.update(zip(ends, self.whole(ends)))
        known.update([(s, known[a] + endings[b]) for s, (a, b) in zip(new, parts) if a and b])

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.SEGMENTS:
            self.known, self.endings = {}, {}
        fronts: dict[int, str] = {}
        cuts = [("\n" + t).replace("\n", " \n").split(" ")[1:] if t else [] for t in texts]
        new = list(set().union(*cuts).difference(self.known))
        # What is known holds no white space but a line end in front, so an uneven text has a segment that shows here.
        spaced: list[str] = []
        if "" in new or "\n" in new or OTHER.search(" ".join(new)):
            for i, t in enumerate(texts):
                if UNEVEN.search(t):
                    fronts[i], *cuts[i] = EVEN.split(t)
            new = list(set().union(*cuts).difference(self.known))
            spaced = [s for s in new if WHITE.search(s, 1)]
            self.known.update(zip(spaced, self.whole([s if s[0] == "\n" else " " + s for s in spaced])))
            new = list(set(new).difference(spaced))
        self._learn(new)
        starts = dict(zip(fronts, self.whole(list(fronts.values()))))
        skip, find = len(self.line), self.known.__getitem__
        out = [starts[i] + b"".join(map(find, c)) if i in starts else b"".join(map(find, c))[skip:]
               for i, c in enumerate(cuts)]
        for s in [*spaced, *[s for s in new if len(s) > self.LONGEST]]:
            del self.known[s]
        return out


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Slices of about ``TOGETHER`` characters: the segments of one slice are held at a time."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > TOGETHER:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One for all tasks of a worker, so that its memory stays warm."""
    return Encoder(path)


def encode_texts(documents: DataFrame, tokenizer: str) -> DataFrame:
    """``(doc_id, h, ids)``: 16-bit ids with the end id, and a hash that orders equal doc_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        end = struct.pack("<H", END)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [x + end for i, j in _slices(texts) for x in encode(texts[i:j])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "h", "ids"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, h long, ids binary")


def _file_bytes(doc_ids: list[int | None], ids: list[bytes]) -> tuple[bytes, int]:
    stream = np.frombuffer(b"".join(ids), "<u2")
    blocks = mixcoder.encode([stream[i:i + mixcoder.BLOCK] for i in range(0, len(stream), mixcoder.BLOCK)])
    body = MAGIC + b"".join(blocks)
    lengths = np.array([len(x) // 2 for x in ids], "<i8")
    known = np.array([d is not None for d in doc_ids], "u1")
    index = zlib.compress(struct.pack("<Q", len(ids)) + known.tobytes()
                          + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + lengths.tobytes(), 1)
    return body + index + FOOT.pack(len(body), len(index), len(blocks), zlib.crc32(index), MAGIC), len(stream)


def _filesystem(path: str):
    from pyarrow import fs
    found, inner = fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", re.sub("^file:/(?!/)", "file:///", path)))
    return found, inner


def write_files(encoded: DataFrame, base: str) -> DataFrame:
    """Writes ``(doc_id, h, ids)`` in ascending order as files under ``base`` -> their manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        ids: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            data, n_ids = _file_bytes(doc_ids, ids)
            path = f"{base}/ids-{part:06d}-{seq:06d}-{uuid.uuid4().hex}.idmix"
            place, inner = _filesystem(path)
            place.create_dir(inner.rsplit("/", 1)[0], recursive=True)
            with place.open_output_stream(inner) as f:
                f.write(data)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
                                               "path": [path], "n_docs": [len(doc_ids)], "n_ids": [n_ids],
                                               "n_bytes": [len(data)]})

        for batch in batches:
            for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc_ids.append(doc_id)
                ids.append(x)
                held += len(x) // 2
                if held >= FILE_IDS:
                    yield close()
                    doc_ids, ids, held, seq = [], [], 0, seq + 1
        if ids:
            yield close()

    placed = encoded.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    return stored(placed.select("doc_id", "ids").mapInArrow(run, MANIFEST), "id-manifest")


def _documents_of(data: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """The documents of a file, decoding a group of blocks at a time."""
    at, n_index, n_blocks, crc, magic = FOOT.unpack(data[-FOOT.size:])
    packed = data[at:at + n_index]
    if magic != MAGIC or data[:8] != MAGIC or len(data) != at + n_index + FOOT.size or zlib.crc32(packed) != crc:
        raise mixcoder.DamagedBlock("the index of a file of ids is damaged")
    index = zlib.decompress(packed)
    n = struct.unpack_from("<Q", index)[0]
    known = np.frombuffer(index, "u1", n, 8)
    doc_ids, lengths = np.frombuffer(index, "<i8", n, 8 + n), np.frombuffer(index, "<i8", n, 8 + 9 * n)
    view, place, left, held = memoryview(data), len(MAGIC), n_blocks, np.empty(0, "<u4")
    for ok, doc_id, length in zip(known, doc_ids.tolist(), lengths.tolist()):
        while len(held) < length:
            blocks, place = mixcoder.read_blocks(view, place, min(left, mixcoder.LANES))
            left -= len(blocks)
            held = np.concatenate([held, *blocks]).astype("<u4")
        yield doc_id if ok else None, held[:length]
        held = held[length:]


def read_files(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the manifest's files."""
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task that wrote
    parts = (manifest.groupBy("part").agg(F.sum("n_ids").alias("ids"))
             .select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("offset")))
    files = manifest.withColumn("within", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).join(parts, "part")
    files = files.select("path", "n_bytes", (F.col("offset") + F.col("within")).alias("start"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, n_bytes, start in zip(pdf["path"], pdf["n_bytes"], pdf["start"]):
                place, inner = _filesystem(path)
                with place.open_input_file(inner) as f:
                    data = f.read()
                if len(data) != n_bytes:
                    raise mixcoder.DamagedBlock(f"{path} has {len(data)} bytes, its manifest {n_bytes}")
                rows = []
                for doc_id, ids in _documents_of(data):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                got = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                got["doc_id"] = got["doc_id"].astype("Int64")
                yield got

    n_files = manifest.count()
    return (files.repartition(max(1, min(n_files, 10_000)))
            .mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def op11(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Contract query over every document: ids written to files, and the files read back."""
    if tokenizer is None:
        import public_tokenizers
        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    encoded = stored(encode_texts(documents, tokenizer), "ids")
    base = scratch_path(documents.sparkSession, f"llm/id-files-{uuid.uuid4().hex}")
    return read_files(write_files(encoded, base))
