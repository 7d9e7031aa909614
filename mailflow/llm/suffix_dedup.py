"""Substring removal by a depth-limited radix sort of suffixes.

Texts are UTF-8 bytes; a window is ``DEPTH`` = 200 bytes. Suffixes are ordered
only through the window's bytes, by most-significant-digit passes that group
suffixes by one digit after the other and go on with groups of two or more;
groups that are equal through all digits are exactly the repeated windows. To
keep the passes small the sort is sparse: a window is represented by the
suffix at its *anchor*, the smallest (by hash, leftmost) of the ``DIGIT`` = 50
byte strings in the window. Equal windows have it at the same place, and about
75 windows in a row share it. The first digit is these 50 bytes, the second
all the bytes that the anchor's windows cover (``repeats`` has these passes);
for the few anchors still in doubt, blocks of 8 windows are told apart by
their 193 common bytes, then by the whole block, then by the single window. A
radix pass groups by the 64-bit hash of a long digit, which stands for its
bytes.

Defined results: null counts as the empty text; texts under 200 bytes lose
nothing; repeated rows lose everything from 200 bytes on, both alike; an empty
table gives no rows; a text is read whole, in about 100 bytes of memory a
byte; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, stored
from .repeats import (Anchored, Ranges, asked_rows, covered, flagged, mark_lists, marks, raw_text, repeated_starts,
                      signed, together)

DEPTH, DIGIT = 200, 50
BLOCK = 8  # windows that are settled together; their extra bytes fit a long
CORE = DEPTH - BLOCK + 1
_SIGN = np.random.default_rng(5).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_NONE = np.zeros(0, np.int64)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row, by running minima of blocks."""
    n = len(v) - width + 1
    pad = -len(v) % width
    blocks = np.concatenate([v, np.full(pad, np.iinfo(v.dtype).max, v.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1:width - 1 + n])


def anchored(raws: list[bytes]) -> Anchored:
    base = np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64)
    raw = np.frombuffer(b"".join(raws), np.uint8)
    starts = np.concatenate([_NONE, *(np.arange(s, e - DEPTH + 1) for s, e in zip(base[:-1], base[1:]))])
    if not len(starts):
        none = _NONE.view(np.uint64)
        return Anchored(_NONE, _NONE, _NONE, none, none, _NONE, base, lambda s: s.view(np.uint64))
    ranges = Ranges(_SIGN[raw])
    places = np.arange(len(raw) - DIGIT + 1)
    digit = ranges.of(places, places + DIGIT)
    low = np.uint64(0xFFFFFFFF)
    best = sliding_min((digit & ~low) | places.astype(np.uint64), DEPTH - DIGIT + 1)[starts]
    at = (best & low).astype(np.int64)  # the anchor of each window; never moves back
    begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.concatenate([begin, [len(at)]]))
    anchor, first = at[begin], starts[begin]
    last = first + count - 1
    shape = (anchor - first).astype(np.uint64) * np.uint64(512) + count.astype(np.uint64)
    context = mix(ranges.of(first, last + DEPTH) + mix(shape))
    return Anchored(starts, np.repeat(np.arange(len(begin)), count), at - starts, digit[anchor], context,
                    np.searchsorted(base, first, "right") - 1, base, lambda s: ranges.of(s, s + DEPTH))


def _blocks(a: Anchored, raws: list[bytes], chosen: np.ndarray, did: np.ndarray) -> pd.DataFrame:
    """The chosen anchors' windows in blocks of ``BLOCK`` offsets.

    All windows of a block share its core, ``DEPTH - BLOCK + 1`` bytes; a
    window adds x bytes on its left and BLOCK - 1 - x on its right. ``left``
    and ``right`` hold the bytes that the block's windows add, nearest first.
    """
    raw = np.concatenate([np.frombuffer(b"".join(raws), np.uint8), np.zeros(DEPTH, np.uint8)])
    ranges = Ranges(_SIGN[raw])
    pick = np.zeros(len(a.classes), bool)
    pick[chosen] = True
    at = np.flatnonzero(pick[a.owner])
    owner, off = a.owner[at], a.offset[at]
    block = off // BLOCK
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])])) if len(at) else _NONE
    end = np.concatenate([new[1:], [len(at)]]) - 1 if len(at) else _NONE
    xb, xa, k = off[new] % BLOCK, off[end] % BLOCK, block[new]  # offsets fall as windows move on
    core = a.starts[at[new]] + off[new] - k * BLOCK  # where the core starts
    left, right = np.zeros(len(new), np.uint64), np.zeros(len(new), np.uint64)
    for i in range(BLOCK - 1):
        byte = raw[np.maximum(core - 1 - i, 0)].astype(np.uint64) << np.uint64(8 * i)
        left |= np.where(i < xb, byte, np.uint64(0))
        byte = raw[core + CORE + i].astype(np.uint64) << np.uint64(8 * i)
        right |= np.where(i < BLOCK - 1 - xa, byte, np.uint64(0))
    who = owner[new]
    return pd.DataFrame({
        "did": did[a.doc[who]], "context": signed(a.contexts[who]),
        "shape": (k * BLOCK * BLOCK + xa * BLOCK + xb).astype(np.int32),
        "core": signed(mix(ranges.of(core, core + CORE) + k.astype(np.uint64))), "left": signed(left), "right": signed(right)})


def _last_digits(asked: DataFrame) -> DataFrame:
    """Repeated windows of the contexts in doubt, by core, whole block, then single window."""
    blocks = stored(asked_rows(asked, anchored, _blocks,
                               "did long, context long, shape int, core long, left long, right long"), "blocks")
    shared = blocks.groupBy("core").agg(F.count("*").alias("k")).where("k > 1")
    near = stored(blocks.join(shared.select("core"), "core", "left_semi"), "near")
    unit = ["core", "shape", "left", "right"]
    units = stored(near.groupBy(*unit).agg(F.count("*").alias("m"), F.min("did").alias("did"),
                                           F.min("context").alias("context")), "units")
    first, xa, xb = f"(shape div {BLOCK * BLOCK}) * {BLOCK}", f"(shape div {BLOCK}) % {BLOCK}", f"shape % {BLOCK}"
    word = F.expr(f"cast(({first}) div 64 as int)").alias("word")
    whole = (near.join(units.where("m > 1").select(*unit), unit, "left_semi")
             .select("did", "context", word,
                     F.expr(f"shiftleft(shiftleft(1L, {xb} + 1) - shiftleft(1L, {xa}), cast(({first}) % 64 as int))").alias("bits")))
    mixed = units.groupBy("core").agg(F.count("*").alias("k"), F.min("m").alias("least")).where("k > 1 and least = 1")
    single = (units.join(mixed.select("core"), "core", "left_semi")
              .withColumn("x", F.explode(F.expr(f"sequence({xa}, {xb})")))
              .select("did", "context", "shape", "m", "core", "x",
                      F.expr("left & (shiftleft(1L, 8 * x) - 1)").alias("l"),
                      F.expr(f"right & (shiftleft(1L, 8 * ({BLOCK - 1} - x)) - 1)").alias("r")))
    window = ["core", "x", "l", "r"]
    often = single.groupBy(*window).agg(F.count("*").alias("k")).where("k > 1").select(*window)
    alone = (single.where("m = 1").join(often, window, "left_semi")
             .select("did", "context", word, F.expr(f"shiftleft(1L, cast(({first}) % 64 as int) + x)").alias("bits")))
    return whole.unionByName(alone)


def remove_repeats(docs: DataFrame, keep: list[str], with_text: bool = False) -> DataFrame:
    """Columns ``keep`` with the counts and digest of what stays (and ``kept_bytes``)."""
    names = list(dict.fromkeys([*keep, "text"]))
    rows = docs.select(*names, F.xxhash64(F.coalesce("text", F.lit(""))).alias("did"))
    found = marks(rows.select("did", "text"), anchored, False, _last_digits)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema += ", n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * with_text
    cols = [*keep, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_bytes"] * with_text

    def run(batches):
        for b in batches:
            raws = [raw_text(t) for t in b["text"]]
            for i, j in together(raws):
                a, out = anchored(raws[i:j]), []
                cut = covered(a.base[-1], repeated_starts(a, *mark_lists(b, i, j)), DEPTH)
                for raw, s, e in zip(raws[i:j], a.base[:-1], a.base[1:]):
                    mine = cut[s:e]
                    kept = np.frombuffer(raw, np.uint8)[~mine].tobytes()
                    spans = int(mine[:1].sum()) + int((mine[1:] & ~mine[:-1]).sum())
                    out.append((len(raw), int(mine.sum()), spans, hashlib.sha256(kept).hexdigest(),
                                *([kept] if with_text else [])))
                got = b[keep].iloc[i:j].copy()
                for k, c in enumerate(cols[len(keep):]):
                    got[c] = [r[k] for r in out]
                yield got

    both = flagged(rows, found)
    raw = F.coalesce("text", F.lit("")).cast("binary")
    clean = both.where("hit is null").select(
        *keep, F.octet_length(raw).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256"), *([raw.alias("kept_bytes")] if with_text else []))
    return clean.select(*cols).unionByName(
        both.where("hit").join(found, "did").drop("did", "hit").mapInPandas(run, schema))


def op5(documents: DataFrame) -> DataFrame:
    """Contract query over every whole text."""
    return remove_repeats(documents.select("doc_id", "text"), ["doc_id"])


SQL = r"""
WITH raw AS (
 SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
strings AS (
 SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS content
 FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM raw)),
often AS (SELECT content FROM strings GROUP BY content HAVING count(*) > 1),
starts AS (
 SELECT s.doc_id, s.i, coalesce(s.i > 200 + lag(s.i) OVER (PARTITION BY s.doc_id ORDER BY s.i), TRUE) AS opens
 FROM strings s SEMI JOIN often o ON o.content = s.content),
runs AS (
 SELECT doc_id, min(i) AS lo, max(i) + 200 AS hi
 FROM (SELECT doc_id, i, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM starts) GROUP BY doc_id, run),
pieces AS (
 SELECT r.doc_id, r.lo, r.hi,
  substr(raw.h, 2 * coalesce(lag(r.hi) OVER (PARTITION BY r.doc_id ORDER BY r.lo), 0) + 1,
         2 * (r.lo - coalesce(lag(r.hi) OVER (PARTITION BY r.doc_id ORDER BY r.lo), 0))) AS piece
 FROM runs r JOIN raw ON raw.doc_id = r.doc_id),
cut AS (
 SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS tail, string_agg(piece, '' ORDER BY lo) AS kept
 FROM pieces GROUP BY doc_id)
SELECT raw.doc_id, CAST(raw.n AS BIGINT) AS n_bytes, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed,
 CAST(coalesce(c.n_spans, 0) AS BIGINT) AS n_spans,
 sha256(unhex(coalesce(c.kept, '') || substr(raw.h, 2 * coalesce(c.tail, 0) + 1))) AS kept_sha256
FROM raw LEFT JOIN cut c ON c.doc_id = raw.doc_id"""
