"""Substring removal by recompression.

A text is a sequence of words. A round of recompression names first the runs
of equal symbols, then the pairs of a left and a right symbol (each symbol is
left or right by a bit of its name); a name is a hash of what it stands for,
so equal content has equal names in all texts without any shared dictionary.
A symbol's *reach* is the stretch of words that decided it, its neighbours'
included; wherever the same words recur, the same symbol recurs inside.

A window is ``WINDOW`` = 13 words. Its anchor is the highest-level symbol
(then the smallest by name, then the leftmost) whose reach lies inside the
window; a window without one stands for itself. Equal windows therefore share
their anchor symbol. Symbols shared by several documents reveal the repeats
and their contexts and windows verify them (``repeats`` has these passes).

Defined results: null counts as no words; texts under 13 words lose nothing;
a window repeated only inside one document stays; rows that repeat a doc_id
are one document; a null doc_id neither loses nor causes anything; an empty
table gives no rows; a text is read whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, stored
from .repeats import (Anchored, Ranges, asked_rows, covered, flagged, marks, raw_text, repeated_starts, signed,
                      together, word_hashes)

WINDOW, ROUNDS = 13, 2
_P = np.random.default_rng(9).integers(1, 1 << 63, 4, np.uint64) * np.uint64(2) + np.uint64(1)
_FAR = 1 << 40  # a reach beyond the text: decided by the text's end, so not by words alone
_NONE = np.zeros(0, np.int64)


class Symbols(NamedTuple):
    name: np.ndarray
    start: np.ndarray
    lo: np.ndarray  # the reach: words lo to hi, exclusive
    hi: np.ndarray
    made: np.ndarray  # whether this round made it


def name_runs(s: Symbols) -> Symbols:
    new = np.concatenate([[True], s.name[1:] != s.name[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(s.name)]]) - 1
    n = (last - first + 1).astype(np.uint64)
    name = np.where(n > 1, mix(s.name[first] * _P[0] + n * _P[1]), s.name[first])
    # A run's borders are decided by the symbols beside it.
    lo = np.where(first > 0, s.lo[first - 1], -_FAR)
    hi = np.where(last + 1 < len(s.name), s.hi[np.minimum(last + 1, len(s.name) - 1)], _FAR)
    return Symbols(name, s.start[first], np.minimum(lo, s.lo[first]), np.maximum(hi, s.hi[last]), n > 1)


def name_pairs(s: Symbols, turn: int) -> Symbols:
    left = (mix(s.name + np.uint64(turn)) & np.uint64(1)) == 0
    joins = np.concatenate([left[:-1] & ~left[1:], [False]])
    second = np.concatenate([[False], joins[:-1]])
    at = np.flatnonzero(~second)
    nxt = np.minimum(at + 1, len(left) - 1)
    name = np.where(joins[at], mix(s.name[at] * _P[2] + s.name[nxt] * _P[3]), s.name[at])
    # A left symbol is decided by the next one's side, a right one by the one before.
    hi = np.where(left[at], np.where(at + 1 < len(left), s.hi[nxt], _FAR), s.hi[at])
    lo = np.where(left[at], s.lo[at], np.where(at > 0, s.lo[np.maximum(at - 1, 0)], -_FAR))
    return Symbols(name, s.start[at], lo, np.maximum(hi, s.hi[at]), joins[at] | s.made[at])


def symbols(h: np.ndarray, base: np.ndarray, rounds: int = ROUNDS) -> list[Symbols]:
    """The symbols of each round, the words themselves first.

    Texts lie end to end; a symbol between two texts, unlike any other, keeps
    them apart, and what it decides has no reach.
    """
    gaps = base[1:-1]
    place = np.insert(np.arange(len(h)), gaps, -1)
    edge = place < 0
    name = np.where(edge, mix(np.arange(len(place)).astype(np.uint64) + _P[3]), h[place])
    out = [Symbols(name, place, np.where(edge, -_FAR, place), np.where(edge, _FAR, place + 1), np.zeros(len(place), bool))]
    for r in range(rounds):
        out.append(name_pairs(name_runs(out[-1]), r + 1))
    return out


def anchored(raws: list[bytes]) -> Anchored:
    h, base = word_hashes(raws)
    starts = np.concatenate([_NONE, *(np.arange(s, e - WINDOW + 1) for s, e in zip(base[:-1], base[1:]))])
    if not len(starts):
        none = _NONE.view(np.uint64)
        return Anchored(_NONE, _NONE, _NONE, none, none, _NONE, base, lambda s: s.view(np.uint64))
    ranges, n = Ranges(h), len(h)
    levels = symbols(h, base)[1:]
    rank = np.concatenate([np.where(s.made, len(levels) - i, len(levels) + 1) for i, s in enumerate(levels, 1)])
    name, start, lo, hi = (np.concatenate([getattr(s, f) for s in levels]) for f in ("name", "start", "lo", "hi"))
    fits = np.flatnonzero((lo >= 0) & (hi <= n) & (hi - lo <= WINDOW))
    rank, name, start, lo, hi = (x[fits] for x in (rank, name, start, lo, hi))
    # Smallest first: rank, then name, then place; a window takes the first symbol that it holds whole.
    order = np.lexsort((start, mix(name), rank))[::-1]
    best = np.full(n, -1, np.int64)
    room, lo_o = (WINDOW - (hi - lo))[order], lo[order]
    at = np.repeat(lo_o, room + 1) - (np.arange((room + 1).sum()) - np.repeat(np.cumsum(room + 1) - room - 1, room + 1))
    who = np.repeat(order, room + 1)
    ok = at >= 0
    best[at[ok]] = who[ok]  # of several values for one window the last one, the smallest, stays
    best = best[starts]
    key = np.where(best < 0, starts + len(lo), best)
    keys, owner = np.unique(key, return_inverse=True)
    single = keys >= len(lo)
    sym = np.where(single, 0, keys)
    by = np.argsort(owner, kind="stable")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(owner[by])) + 1])
    first, last = starts[by][cuts], starts[by][np.concatenate([cuts[1:], [len(by)]]) - 1]
    taken = np.bitwise_or.reduceat((np.int64(1) << (starts - first[owner]))[by], cuts).astype(np.uint64)
    if len(lo):
        place = np.where(single, first, start[sym])
        cls = mix(ranges.of(np.where(single, first, lo[sym]), np.where(single, first + WINDOW, hi[sym]))
                  + np.where(single, 0, rank[sym] + 1).astype(np.uint64) * _P[0]
                  + np.where(single, 0, start[sym] - lo[sym]).astype(np.uint64) * _P[1])
    else:
        place, cls = first, mix(ranges.of(first, first + WINDOW))
    context = mix(ranges.of(first, last + WINDOW) + mix(taken * _P[2] + (place - first + 1).astype(np.uint64) * _P[3] + cls))
    return Anchored(starts, owner, place[owner] - starts, cls, context, np.searchsorted(base, first, "right") - 1, base,
                    lambda s: ranges.of(s, s + WINDOW))


def _windows(a: Anchored, raws: list[bytes], chosen: np.ndarray, did: np.ndarray) -> pd.DataFrame:
    pick = np.zeros(len(a.classes), bool)
    pick[chosen] = True
    at = np.flatnonzero(pick[a.owner])
    who = a.owner[at]
    return pd.DataFrame({"did": did[a.doc[who]], "context": signed(a.contexts[who]),
                         "offset": a.offset[at].astype(np.int32), "window": signed(a.hashes(a.starts[at]))})


def _last_digits(asked: DataFrame) -> DataFrame:
    """Windows of the contexts in doubt that an earlier document has."""
    windows = stored(asked_rows(asked, anchored, _windows, "did long, context long, offset int, window long"), "windows")
    often = windows.groupBy("window").agg(F.min("did").alias("lead"), F.max("did").alias("last")).where("lead < last")
    return (windows.join(often.select("window", "lead"), "window").where("did > lead")
            .select("did", "context", F.lit(0).alias("word"), F.expr("shiftleft(1L, offset)").alias("bits")))


def remove_repeats(docs: DataFrame, keep: list[str], with_text: bool = False) -> DataFrame:
    """Columns ``keep`` (doc_id among them) with the counts and digest of what stays (and ``kept_text``)."""
    names = list(dict.fromkeys([*keep, "text"]))
    rows = docs.select(*names, F.col("doc_id").cast("long").alias("did"))
    found = marks(rows.select("did", "text").where("did is not null"), anchored, True, _last_digits)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema += ", n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    cols = [*keep, "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text

    def run(batches):
        for b in batches:
            raws, out = [raw_text(t) for t in b["text"]], []
            marked = np.flatnonzero(b["hit"].notna().to_numpy())
            gone = {}
            for i, j in together([raws[k] for k in marked]):
                part = marked[i:j]
                a = anchored([raws[k] for k in part])
                lists = list(b["context"].iloc[part]), [list(b[m].iloc[part]) for m in ("m0", "m1", "m2")]
                cut = covered(a.base[-1], repeated_starts(a, *lists), WINDOW)
                gone.update((k, cut[s:e]) for k, s, e in zip(part, a.base[:-1], a.base[1:]))
            for k, raw in enumerate(raws):
                ws = kept = raw.split()
                if k in gone:
                    kept = [w for w, c in zip(ws, gone[k].tolist()) if not c]
                rest = b" ".join(kept)
                out.append((len(ws), len(ws) - len(kept), hashlib.sha256(rest).hexdigest(),
                            rest.decode("utf-8", "replace") if with_text else None))
            got = b[keep].copy()
            for i, c in enumerate(cols[len(keep):]):
                got[c] = [r[i] for r in out]
            yield got

    both = flagged(rows, found)
    none = [F.lit(None).cast(t).alias(c) for c, t in found.dtypes if c != "did"]
    clean = both.where("hit is null").select(*names, "hit", *none)
    dirty = both.where("hit").join(found, "did").select(clean.columns)
    return clean.mapInPandas(run, schema).unionByName(dirty.mapInPandas(run, schema))


def op9(documents: DataFrame) -> DataFrame:
    """Contract query over every whole text."""
    return remove_repeats(documents.select("doc_id", "text"), ["doc_id"])


SQL = r"""
WITH words AS (
 SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (
 SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS content
 FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM words)),
leads AS (SELECT content, min(doc_id) AS lead FROM windows GROUP BY content HAVING min(doc_id) < max(doc_id)),
gone AS (
 SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i
 FROM (SELECT w.doc_id, w.i FROM windows w JOIN leads l ON l.content = w.content AND w.doc_id > l.lead)),
stays AS (
 SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS kept, count(*) AS n
 FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM words) p
 WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = p.doc_id AND g.i = p.i) GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(len(w.ws) - coalesce(s.n, 0) AS BIGINT) AS n_removed,
 sha256(coalesce(s.kept, '')) AS kept_sha256
FROM words w LEFT JOIN stays s ON s.doc_id = w.doc_id"""
