"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

A text is normalised as the model asks (spaces become U+2581, one is put in
front) and cut where no piece can reach over: before a space and at
characters outside the vocabulary. For each prefix of such a segment the table
stores the one piece that ends the prefix's encoding: an Aho-Corasick
automaton gives the pieces that end there, and the one whose pair with the
last piece of the remaining prefix stays apart under the merges is it. Ids are
recovered from the end of the table. Runs of spaces, whose pieces share one
score, are grouped from the left as the merge order does. Segments repeat, so
their ids are kept in a bounded memory per Python worker.

Defined results: null counts as the empty text (``<s> </s>`` only); very long
texts and words take time and memory in proportion to their length; repeated
rows give equal rows; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SPACE = "▁"
START = (1 << 20) - 1  # stands for the piece before the first


class Tokenizer:
    """Pieces of a model with the identity normaliser, and the prefix-table encoder."""

    SEGMENTS = 120_000
    PAIRS = 400_000

    def __init__(self, pieces: list[tuple[str, float, int]]):
        # piece types: 1 normal, 2 unknown, 3 control, 4 user defined, 6 byte
        self.text = [p for p, _, _ in pieces]
        self.kind = [k for _, _, k in pieces]
        self.id = {p: i for i, (p, _, k) in enumerate(pieces) if k in (1, 4)}
        self.score = [s for _, s, _ in pieces]
        self.byte = {int(p[3:-1], 16): i for i, (p, _, k) in enumerate(pieces) if k == 6}
        self.bos, self.eos = self.text.index("<s>"), self.text.index("</s>")
        self.raw = [p.replace(SPACE, " ").encode() if k in (1, 4) else bytes([int(p[3:-1], 16)]) if k == 6 else b""
                    for p, _, k in pieces]
        self.longest_gap = max((len(p) for p in self.id if set(p) == {SPACE}), default=1)
        self.chars = frozenset(p for p in self.id if len(p) == 1)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            if set(p) != {SPACE} or len(p) == 1:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.length = [len(p) for p in self.text]
        self.apart: dict[int, bool] = {}
        self.known = _Segments(self)

    def merges(self, s: str) -> list[int]:
        """Ids of a short string by merging the best pair, leftmost first, until none is left."""
        at = list(s)
        while True:
            best, where = None, -1
            for i in range(len(at) - 1):
                j = self.id.get(at[i] + at[i + 1])
                if j is not None and (best is None or self.score[j] > best):
                    best, where = self.score[j], i
            if where < 0:
                return [self.id[x] for x in at]
            at[where:where + 2] = [at[where] + at[where + 1]]

    def stays_apart(self, a: int, b: int) -> bool:
        """Whether the text of pieces a, b encodes to exactly a, b (a = START: b alone)."""
        if len(self.apart) >= self.PAIRS:
            self.apart.clear()
        left = [] if a == START else [a]
        got = self.apart[a << 20 | b] = self.merges("".join(self.text[x] for x in (*left, b))) == [*left, b]
        return got

    def prefix_table(self, s: str) -> list[int]:
        """Ids of a string of known characters without runs of spaces."""
        last, known = [START] + [-1] * len(s), self.apart.get
        for end, (piece, n) in self.automaton.iter(s):
            end += 1
            if last[end] < 0:
                before = last[end - n]
                if before >= 0:
                    fits = known(before << 20 | piece)
                    if fits or fits is None and self.stays_apart(before, piece):
                        last[end] = piece
        ids, at, length = [], len(s), self.length
        while at:
            ids.append(last[at])
            at -= length[last[at]]
        ids.reverse()
        return ids

    def gaps(self, n: int) -> list[int]:
        """Ids of n spaces in a row: the leftmost piece grows first."""
        ids = []
        while n:
            k = min(n, self.longest_gap)
            while SPACE * k not in self.id:
                k -= 1
            ids.append(self.id[SPACE * k])
            n -= k
        return ids

    def segment(self, s: str) -> list[int]:
        """Ids of one segment: spaces, then anything without spaces."""
        word = s.lstrip(SPACE)
        n, ids = len(s) - len(word), []
        part = SPACE if n else ""
        for c in word:
            if c in self.id:
                part += c
                continue
            ids += self._known_part(part, n) if n else self.prefix_table(part)
            part, n = "", 0
            ids += [self.byte[b] for b in c.encode("utf-8", "surrogatepass")]
        return ids + (self._known_part(part, n) if n else self.prefix_table(part))

    def _known_part(self, part: str, n: int) -> list[int]:
        ids = self.prefix_table(part)
        if n == 1:
            return ids
        if self.text[ids[0]] == SPACE:  # the last space stayed alone, so it joins the others
            return self.gaps(n) + ids[1:]
        return self.gaps(n - 1) + ids

    def words(self, text: str) -> list[str]:
        """Keys of the text's segments: the part after the last space, or all with more spaces."""
        ws = text.replace(" ", SPACE).split(SPACE)
        if "" not in ws:
            return ws
        out, n = [], 0
        for w in ws:
            n += 1
            if w:
                out.append(w if n == 1 else SPACE * n + w)
                n = 0
        if n:
            out.append(SPACE * n)
        return out

    def encode_bytes(self, text: str) -> tuple[bytes, bytes]:
        """Ids as little-endian 32-bit integers with both ends, and their decoded text."""
        if not text:
            return struct.pack("<2I", self.bos, self.eos), b""
        ws = self.words(text)
        body = b"".join([self.known[w] for w in ws])
        if self.known.odd:
            back = b"".join([self.known.odd.get(w) or (w if w[:1] == SPACE else SPACE + w).replace(SPACE, " ")
                             .encode("utf-8", "surrogatepass") for w in ws])
        else:  # each segment's ids were decoded to the segment itself
            back = (SPACE + text).replace(SPACE, " ").encode("utf-8", "surrogatepass")
        return struct.pack("<I", self.bos) + body + struct.pack("<I", self.eos), back[1:] if back[:1] == b" " else back

    def encode(self, text: str) -> list[int]:
        raw, _ = self.encode_bytes(text)
        return list(struct.unpack(f"<{len(raw) // 4}I", raw))

    def decode_bytes(self, ids: list[int]) -> bytes:
        """Text of any ids: control ids vanish, bytes join, one leading space goes."""
        out = b"".join([self.raw[i] for i in ids])
        first = next((i for i in ids if self.kind[i] != 3), None)
        if first is not None and self.kind[first] != 6 and out[:1] == b" ":
            out = out[1:]
        return out

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


class _Segments(dict):
    """Segment -> packed ids. Keys without a leading space have one.

    The ids of a new segment are decoded and compared with the segment; a
    segment that would come back otherwise is noted in ``odd``. A full memory
    becomes the older generation, from which segments still in use come back,
    so it holds at most twice ``SEGMENTS`` short segments.
    """

    def __init__(self, tok: Tokenizer):
        super().__init__()
        self.tok, self.old, self.odd = tok, {}, {}

    def __missing__(self, w: str) -> bytes:
        got = self.old.get(w)
        if got is None:
            tok, s = self.tok, w if w[:1] == SPACE else SPACE + w
            if "\n" in w:
                ids = [i for part in re.findall(r"[^\n]+|\n", s) for i in tok.segment(part)]
            elif s is not w and tok.chars.issuperset(w):
                ids = tok.prefix_table(s)
            else:
                ids = tok.segment(s)
            back = b"".join([tok.raw[i] for i in ids])
            if back != s.replace(SPACE, " ").encode("utf-8", "surrogatepass"):
                self.odd[w] = back
            got = struct.pack(f"<{len(ids)}I", *ids)
        if len(w) <= 64:
            if len(self) >= Tokenizer.SEGMENTS:
                self.old = dict(self)
                self.clear()
            self[w] = got
        return got


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def read_pieces(path: str) -> tuple[tuple[str, float, int], ...]:
    """(piece, score, type) of a model file, in id order; checks what the encoder relies on."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    norm = m.normalizer_spec
    if m.trainer_spec.model_type != 2 or not m.trainer_spec.byte_fallback:
        raise ValueError(f"{path}: a BPE model with byte fallback is needed")
    if not norm.add_dummy_prefix or norm.remove_extra_whitespaces or norm.precompiled_charsmap:
        raise ValueError(f"{path}: the identity normaliser with a leading space is needed")
    pieces = tuple((p.piece, p.score, p.type) for p in m.pieces)
    if any(SPACE in p.lstrip(SPACE) for p, _, k in pieces if k in (1, 4)):
        raise ValueError(f"{path}: a piece reaches over a space")
    return pieces


@lru_cache(maxsize=2)
def _tokenizer(pieces) -> Tokenizer:
    return Tokenizer(list(pieces))


def encode_documents(docs: DataFrame, keep: list[str], path: str | None = None,
                     with_ids: bool = False) -> DataFrame:
    """Columns ``keep`` with ``n_tokens, ids_sha256, decoded_sha256`` (and ``ids``).

    The driver reads the model file; its pieces (one vocabulary) are broadcast.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(read_pieces(path or model_path()))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    extra = ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches):
        tok = _tokenizer(pieces.value)
        for whole in batches:
            for i in range(0, len(whole), 256):  # results leave the worker in small pieces
                b, rows = whole.iloc[i:i + 256], []
                for t in b["text"]:
                    ids, back = tok.encode_bytes("" if pd.isna(t) else t)
                    row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest())
                    rows.append((*row, np.frombuffer(ids, "<i4")) if with_ids else row)
                out = b[keep].copy()
                names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
                for k, c in enumerate(names):
                    out[c] = [r[k] for r in rows]
                yield out

    text = [] if "text" in keep else ["text"]
    return docs.select(*keep, *text).mapInPandas(run, schema + extra)


def op4(documents: DataFrame) -> DataFrame:
    """Contract query: every whole text, with begin and end ids, then decoded again."""
    return encode_documents(documents, ["doc_id"])
