"""Repeated windows by anchors: the Spark part shared by two operators.

A kernel gives each window of a text (a fixed number of bytes or words) one
*anchor*, a place inside the window chosen from the window's content alone, so
equal windows have equal anchors at equal offsets. Several windows share an
anchor, so a text has far fewer anchors than windows. An anchor has a *class*
(the content close to it, which all its windows contain) and a *context* (the
content that all its windows cover together, with the set of windows).

1. Classes that occur once are dropped: their windows are unique.
2. Anchors with the same context have the same windows: all are repeated.
3. Only in classes with several contexts windows may be repeated one by one:
   one copy of each such context goes on, to be settled by ``last_digits``.

Every step is a grouped aggregation with partial sums or a join of two
shuffled sides, so a class or context that a third of all texts share is
pre-aggregated or split; no group is gathered in one task. The marks of a
``did`` are a set, so they are bounded by its text, however often it is copied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, sized_broadcast, stored

BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


class Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown as texts ask."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            one = np.ones(1, np.uint64)
            self.up = np.cumprod(np.concatenate([one, np.full(size - 1, BASE)]))
            self.down = np.cumprod(np.concatenate([one, np.full(size - 1, _INVERSE)]))
        return self.up[:n], self.down[:n]


POWERS = Powers()


class Ranges:
    """Hashes of ranges of a sequence of 64-bit values from prefix sums."""

    def __init__(self, values: np.ndarray):
        up, _ = POWERS.to(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:len(values)], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        _, down = POWERS.to(len(self.sums))
        return mix((self.sums[end] - self.sums[start]) * down[start])


_BYTE = np.random.default_rng(3).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's words start (and the last end).

    Each byte is hashed with its place in the word before they are summed, so
    no arrangement of letters cancels out as in a polynomial modulo 2**64.
    """
    raw = np.frombuffer(b"\n".join([b"", *raws, b""]), np.uint8)
    word = ~_SPACE[raw]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1  # the first and last byte are no word
    start, end = edge[::2], edge[1::2]
    texts = np.cumsum([0, *(len(r) + 1 for r in raws)])
    place = np.arange(len(raw), dtype=np.uint64)
    place[1:] -= np.maximum.accumulate(np.where(word[1:] & ~word[:-1], place[1:], np.uint64(0)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(_BYTE[raw] + place * BASE), dtype=np.uint64)])
    return mix(sums[end] - sums[start] + (end - start).astype(np.uint64) * BASE), np.searchsorted(start, texts)


class Anchored(NamedTuple):
    """Windows of some texts laid end to end, by start, and their anchors."""

    starts: np.ndarray    # of each window, among all positions
    owner: np.ndarray     # its anchor's number
    offset: np.ndarray    # of the anchor in the window, below 192
    classes: np.ndarray
    contexts: np.ndarray
    doc: np.ndarray       # the text of each anchor
    base: np.ndarray      # where each text starts, and where the last ends
    hashes: Callable[[np.ndarray], np.ndarray]  # of windows by start

    def keys(self) -> np.ndarray:
        """A context together with its text, as one hash."""
        return text_key(self.contexts, self.doc)


Kernel = Callable[[list[bytes]], Anchored]
TOGETHER = 1 << 18  # bytes of texts handled at once; a longer text is handled alone


def text_key(contexts: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(contexts.view(np.uint64) ^ mix(doc.astype(np.uint64) + np.uint64(1)))


def raw_text(t) -> bytes:
    return b"" if t is None or pd.isna(t) else t.encode("utf-8", "surrogatepass")


def together(raws: list[bytes]) -> Iterator[tuple[int, int]]:
    """Slices of a batch of about TOGETHER bytes."""
    start = size = 0
    for i, r in enumerate(raws):
        if i > start and size + len(r) > TOGETHER:
            yield start, i
            start, size = i, 0
        size += len(r)
    if start < len(raws):
        yield start, len(raws)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def anchor_rows(docs: DataFrame, kernel: Kernel) -> DataFrame:
    """``did, class, context, n`` for each distinct context of each row of ``docs(did, text)``."""
    def run(batches):
        for b in batches:
            raws, did = [raw_text(t) for t in b["text"]], b["did"].to_numpy()
            for i, j in together(raws):
                a = kernel(raws[i:j])
                _, first, n = np.unique(a.keys(), return_index=True, return_counts=True)
                first, n = first[(order := np.argsort(first))], n[order]
                yield pd.DataFrame({"did": did[i:j][a.doc[first]], "class": signed(a.classes[first]),
                                    "context": signed(a.contexts[first]), "n": n.astype(np.int32)})

    return docs.select("did", "text").mapInPandas(run, "did long, class long, context long, n int")


def wanted_anchors(a: Anchored, wanted: list) -> np.ndarray:
    """One anchor for each wanted context of each text."""
    sizes = [len(w) for w in wanted]
    want = text_key(np.concatenate([np.asarray(w, np.int64) for w in wanted]), np.repeat(np.arange(len(sizes)), sizes))
    keys, first = np.unique(a.keys(), return_index=True)
    return first[np.isin(keys, want)]


def asked_rows(docs: DataFrame, kernel: Kernel, answer, schema: str) -> DataFrame:
    """``answer(anchored, raws, chosen anchors, did)`` over ``docs(did, text, contexts)``."""
    def run(batches):
        for b in batches:
            raws, did, want = [raw_text(t) for t in b["text"]], b["did"].to_numpy(), list(b["contexts"])
            for i, j in together(raws):
                a = kernel(raws[i:j])
                yield answer(a, raws[i:j], wanted_anchors(a, want[i:j]), did[i:j])

    return docs.select("did", "text", "contexts").mapInPandas(run, schema)


def repeated_starts(a: Anchored, contexts: list, masks: list[list]) -> np.ndarray:
    """Starts of the windows that each text's marks ``context, m0, m1, m2`` name (bit = offset)."""
    sizes = [len(c) for c in contexts]
    if not len(a.starts) or not sum(sizes):
        return a.starts[:0]
    keys = text_key(np.concatenate([np.asarray(c, np.int64) for c in contexts]), np.repeat(np.arange(len(sizes)), sizes))
    order = np.argsort(keys)
    bits = np.stack([np.concatenate([np.asarray(x, np.int64) for x in m])[order] for m in masks], 1).view(np.uint64)
    keys, mine = keys[order], a.keys()
    at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
    bits = np.where((keys[at] == mine)[:, None], bits[at], np.uint64(0))
    word = bits[a.owner, a.offset >> 6]
    return a.starts[((word >> (a.offset & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)]


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of n positions lie in a window of ``width`` from one of the starts."""
    step = np.zeros(n + 1, np.int64)
    step[starts] += 1  # starts are distinct
    np.subtract.at(step, starts + width, 1)
    return np.cumsum(step[:-1]) > 0


def flagged(docs: DataFrame, ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``docs`` with ``hit`` (true or null) where ``did`` is in ``ids``.

    Up to ``most`` ids (a long each) are broadcast, so that other texts need
    not be shuffled; beyond it the texts are shuffled by ``did`` for the join.
    """
    return docs.join(sized_broadcast(ids.select("did").withColumn("hit", F.lit(True)), most), "did", "left")


def marks(docs: DataFrame, kernel: Kernel, earlier_only: bool, last_digits) -> DataFrame:
    """Marks per ``did``: which windows of which contexts are repeated.

    ``docs(did, text)``. With ``earlier_only`` a window is repeated if it also
    occurs under a smaller ``did``; else if it occurs anywhere else, rows with
    one ``did`` being copies of one text. ``last_digits(asked)`` settles
    the windows of contexts in doubt: rows ``did, context, word, bits``.
    """
    rows = stored(anchor_rows(docs, kernel), "anchors")
    if earlier_only:
        shared = rows.groupBy("class").agg(F.min("did").alias("lo"), F.max("did").alias("hi")).where("lo < hi")
    else:
        shared = rows.groupBy("class").agg(F.sum("n").alias("total")).where("total > 1")
    live = stored(rows.join(shared.select("class"), "class", "left_semi"), "live")
    each = stored(live.groupBy("class", "context").agg(
        F.sum("n").alias("total"), F.min("did").alias("did"), F.max("did").alias("last")), "contexts")
    if earlier_only:
        full = (live.join(each.where("did < last").select("class", "context", F.col("did").alias("lead")),
                          ["class", "context"]).where("did > lead"))
        open_ = each.groupBy("class").agg(F.min("did").alias("lo"), F.max("did").alias("hi")).where("lo < hi")
    else:
        full = live.join(each.where("total > 1").select("class", "context"), ["class", "context"], "left_semi")
        open_ = (each.groupBy("class").agg(F.count("*").alias("k"), F.min("total").alias("least"))
                 .where("k > 1 and least = 1"))
    doubtful = each.join(open_.select("class"), "class", "left_semi")
    wanted = stored(doubtful.groupBy("did").agg(F.collect_list("context").alias("contexts")), "doubt")  # of one text
    asked = flagged(docs, wanted).where("hit").join(wanted, "did")
    if not earlier_only:  # rows with one did are copies; one of them is enough
        asked = asked.groupBy("did").agg(F.first("text").alias("text"), F.first("contexts").alias("contexts"))
    some = last_digits(asked)
    if not earlier_only:  # contexts that occur twice are marked whole below
        some = some.join(each.where("total = 1").select("did", "context"), ["did", "context"], "left_semi")
    some = some.groupBy("did", "context").agg(
        *[F.bit_or(F.when(F.col("word") == w, F.col("bits")).otherwise(F.lit(0).cast("long"))).alias(f"m{w}") for w in range(3)])
    every = full.select("did", "context", *[F.lit(-1).cast("long").alias(f"m{w}") for w in range(3)])
    # A set: each of the rows with one did brings the same marks, and partial sets drop them before the shuffle.
    got = every.unionByName(some).groupBy("did").agg(F.collect_set(F.struct("context", "m0", "m1", "m2")).alias("x"))
    return stored(got.select("did", *[F.col(f"x.{c}").alias(c) for c in ("context", "m0", "m1", "m2")]), "marks")


def mark_lists(b: pd.DataFrame, i: int, j: int) -> tuple[list, list[list]]:
    """Contexts and masks of rows i to j of a batch joined with marks."""
    return list(b["context"].iloc[i:j]), [list(b[m].iloc[i:j]) for m in ("m0", "m1", "m2")]
