"""Ranked lexical search: Block-Max MaxScore over compressed shards of an inverted index.

Index: documents are dealt into shards as they are read (bounded by rows and by
bytes of text). A shard's posting lists are cut into blocks of ``BLOCK``
documents, gaps and frequencies as variable-length bytes; beside each block lie
its last document and its largest impact (the score without the term's
weight), which needs the table's N and L and so is exact. Every term of every
document is indexed.

Search: a query term's weight comes from the document frequencies summed over
shards; the lists that the queries need go to their shard's task. There each
query takes its lists in falling order of weight times largest impact. As long
as the lists that remain could lift an unseen document to the least score held
so far, a list is essential: all of it is read and opens candidates. Once their
bounds sum below it, the remaining lists are non-essential: block maxima reject
candidates, and only blocks that hold a candidate left are decompressed. The
heap of a query goes on over the shards of a task, so later shards start with a
threshold; the tasks' heaps are merged by rank. Queries are taken in blocks of
``QUERY_ROWS``, all of them against all documents.

Defined results: a null or empty text, or one without a term, is no document
(and no item: it has no rows); rows that repeat a doc_id are documents of their
own; equal scores go by doc_id, null last; rows of ``items`` that agree in item_id and text
are ranked once, others that repeat an item_id each with ranks of their own; an
empty table on either side gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERMS = re.compile(TERM)
LOWER = {c: c + 32 for c in range(65, 91)}
BLOCK = 64  # documents in a block of a posting list
SHARD_ROWS, SHARD_CHARS = 8192, 12_000_000
QUERY_ROWS = 512
INDEX = "shard string, term string, df int, best long, lasts binary, maxima binary, ends binary, postings binary"
DOCS = ""  # the "term" of the row that lists a shard's documents


def terms(text: str) -> list[str]:
    return TERMS.findall(text.translate(LOWER))


def impact(tf: np.ndarray, n: np.ndarray, total_docs: int, total_terms: int) -> np.ndarray:
    """Score of ``tf`` occurrences in documents of ``n`` terms, without the term's weight."""
    m = 75 + 25 * n * total_docs // total_terms
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length bytes of non-negative integers, and the place after each."""
    size = np.ones(len(values), np.int64)
    for shift in range(7, 35, 7):
        size += values >> shift > 0
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for i in range(int(size.max(initial=0))):
        has = size > i
        out[ends[has] - size[has] + i] = values[has] >> 7 * i & 127 | np.where(size[has] > i + 1, 128, 0)
    return out, ends


def _unpacked(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    out = np.zeros(len(last), np.int64)
    for i in range(int((last - first).max(initial=0)) + 1):
        has = last - first >= i
        out[has] |= (data[first[has] + i].astype(np.int64) & 127) << 7 * i
    return out


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """An Arrow column of the stretches of ``data`` (bytes) that end at ``ends``."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])


def _shard_rows(name: str, doc_ids: list, texts: list[str], n_docs: int, n_terms: int) -> pa.RecordBatch:
    """The index rows of one shard, sorted by term; its first row lists the documents."""
    words: dict[str, int] = {}
    ids, tfs, sizes, lengths = [], [], [], []
    for text in texts:
        found = Counter(terms(text))
        ids.extend(words.setdefault(w, len(words)) for w in found)
        tfs.extend(found.values())
        sizes.append(len(found))
        lengths.append(sum(found.values()))
    n = np.array(lengths, np.int64)
    listed = sorted(words)
    place = np.empty(len(words), np.int64)
    place[[words[w] for w in listed]] = np.arange(len(listed))
    term = place[np.array(ids, np.int64)] if ids else np.empty(0, np.int64)
    doc, tf = np.repeat(np.arange(len(texts)), sizes), np.array(tfs, np.int64)
    order = np.argsort(term, kind="stable")
    term, doc, tf = term[order], doc[order], tf[order]
    score = impact(tf, n[doc], n_docs, n_terms) if len(doc) else np.empty(0, np.int64)
    df = np.bincount(term, minlength=len(listed))
    starts = np.cumsum(df) - df
    rank = np.arange(len(doc)) - starts[term]
    opens = np.flatnonzero(rank % BLOCK == 0)  # first posting of each block
    closes = np.append(opens[1:], len(doc)) - 1 if len(opens) else opens
    gap = doc - np.where(rank > 0, np.concatenate([[0], doc[:-1]]), -1) - 1 if len(doc) else doc
    gap[opens] = doc[opens]  # a block is read without the one before it
    mixed = np.empty(2 * len(doc), np.int64)
    mixed[::2], mixed[1::2] = gap, tf - 1
    data, ends = _packed(mixed)
    ends = ends[1::2]
    blocks = (df + BLOCK - 1) // BLOCK
    last_block = np.cumsum(blocks)
    base = np.concatenate([[0], ends])[starts[term[opens]]] if len(opens) else opens
    maxima = np.maximum.reduceat(score, opens) if len(opens) else score
    best = np.maximum.reduceat(score, starts) if len(listed) else score
    four = lambda x: x.astype("<i4").view(np.uint8) if len(x) else np.empty(0, np.uint8)
    post_ends = ends[starts + df - 1] if len(listed) else ends
    known = np.array([d is not None for d in doc_ids], np.uint8)
    about = np.concatenate([known, np.array([d or 0 for d in doc_ids], "<i8").view(np.uint8), n.astype("<i8").view(np.uint8)])
    columns = [
        pa.array([name] * (len(listed) + 1)), pa.array([DOCS, *listed]),
        pa.array(np.concatenate([[len(texts)], df]), pa.int32()), pa.array(np.concatenate([[0], best]), pa.int64()),
        _binary(four(doc[closes]), np.concatenate([[0], 4 * last_block])),
        _binary(four(maxima), np.concatenate([[0], 4 * last_block])),
        _binary(four(ends[closes] - base), np.concatenate([[0], 4 * last_block])),
        _binary(np.concatenate([about, data]), np.concatenate([[len(about)], len(about) + post_ends])),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in INDEX.split(", ")])


def build_index(documents: DataFrame) -> tuple[DataFrame, int, int]:
    """The stored index of ``(doc_id, text)``, the number of documents with a term and of all terms."""
    rows = documents.select(F.col("doc_id").cast("long"), "text")
    n = F.regexp_count(F.col("text"), F.lit(TERM))
    n_docs, n_terms = rows.agg(F.count(F.when(n > 0, 1)), F.coalesce(F.sum(n.cast("long")), F.lit(0))).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, seq, doc_ids, texts, chars = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc_ids.append(doc_id)
                texts.append(text)
                chars += len(text)
                if len(texts) >= SHARD_ROWS or chars >= SHARD_CHARS:
                    yield _shard_rows(f"{part}-{seq}", doc_ids, texts, n_docs, n_terms)
                    seq, doc_ids, texts, chars = seq + 1, [], [], 0
        if texts:
            yield _shard_rows(f"{part}-{seq}", doc_ids, texts, n_docs, n_terms)

    return stored(rows.where(n > 0).mapInArrow(run, INDEX), "search-index"), n_docs, n_terms


class _List:
    """A term's postings in one shard."""

    def __init__(self, df, best, lasts, maxima, ends, postings):
        self.best = int(best)
        self.lasts, self.maxima, self.ends = (np.frombuffer(x, "<i4") for x in (lasts, maxima, ends))
        self.postings = np.frombuffer(postings, np.uint8)
        self.opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and frequencies of a block; kept for the other queries of the shard."""
        got = self.opened.get(i)
        if got is None:
            mixed = _unpacked(self.postings[self.ends[i - 1] if i else 0:self.ends[i]])
            gaps = mixed[::2]
            gaps[1:] += 1
            got = self.opened[i] = np.cumsum(gaps), mixed[1::2] + 1
        return got

    def read(self, blocks) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.block(i) for i in blocks]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


class _Shard:
    def __init__(self, about: bytes, n: int, n_docs: int, n_terms: int):
        self.known = np.frombuffer(about, np.uint8, n)
        self.doc_ids, self.n = np.frombuffer(about, "<i8", n, n), np.frombuffer(about, "<i8", n, 9 * n)
        self.of = n_docs, n_terms
        self.lists: dict[str, _List] = {}

    def search(self, query: list[tuple[str, int]], k: int, floor: int) -> list[tuple[int, int, int]]:
        """The best k of ``query`` (term, weight x repeats) at or above ``floor``: ``(-score, unknown, doc_id)``."""
        lists = sorted(((w * self.lists[t].best, w, t) for t, w in query if t in self.lists and w > 0), reverse=True)
        rest = np.cumsum([0, *(b for b, _, _ in lists[::-1])])[::-1]  # bound of the lists from here on
        score = np.zeros(len(self.n), np.int64)
        at = 0
        while at < len(lists) and rest[at] >= floor:  # essential
            _, w, t = lists[at]
            held = self.lists[t]
            docs, tf = held.read(range(len(held.lasts)))
            score[docs] += w * impact(tf, self.n[docs], *self.of)
            at += 1
            if at < len(lists) and len(score) > k:
                floor = max(floor, int(np.partition(score, -k)[-k]))
        left = np.flatnonzero(score)
        for i in range(at, len(lists)):  # non-essential
            _, w, t = lists[i]
            held = self.lists[t]
            left = left[score[left] + rest[i] >= floor]
            if not len(left):
                return []
            block = np.searchsorted(held.lasts, left)
            inside = block < len(held.lasts)
            peak = np.where(inside, held.maxima[np.minimum(block, len(held.lasts) - 1)], 0)
            fits = score[left] + w * peak + rest[i + 1] >= floor
            left, needed = left[fits], np.unique(block[fits & inside])
            if len(needed):
                docs, tf = held.read(needed.tolist())
                where = np.minimum(np.searchsorted(docs, left), len(docs) - 1)
                hit = docs[where] == left
                score[left[hit]] += w * impact(tf[where[hit]], self.n[left[hit]], *self.of)
            if len(left) > k:
                floor = max(floor, int(np.partition(score[left], -k)[-k]))
        left = left[(score[left] >= floor) & (score[left] > 0)]
        best = np.lexsort((self.doc_ids[left], self.known[left] == 0, -score[left]))[:k]
        return [(-int(score[d]), int(self.known[d] == 0), int(self.doc_ids[d])) for d in left[best]]


def search(index: DataFrame, n_docs: int, n_terms: int, items: list[tuple], k: int = 20) -> DataFrame:
    """The best k documents of each item ``(number, text)``: ``number, rank, doc_id, score``."""
    queries = {number: Counter(terms(text)) for number, text in items}
    spark = index.sparkSession
    wanted = spark.createDataFrame([(t,) for t in {t for q in queries.values() for t in q} | {DOCS}], "term string")
    lists = index.join(F.broadcast(wanted), "term", "left_semi")
    found = lists.where(F.col("term") != DOCS).groupBy("term").agg(F.sum("df").alias("df"))
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t, df in found.collect()}
    weighted = {number: [(t, c * weight[t]) for t, c in q.items() if t in weight] for number, q in queries.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        heaps: dict[int, list] = {number: [] for number in weighted}
        shard, name = None, None

        def finish():
            for number, query in weighted.items():
                heap = heaps[number]
                floor = -heap[-1][0] if len(heap) >= k else 1
                heaps[number] = sorted(heap + shard.search(query, k, floor))[:k]

        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != name:
                    if shard is not None:
                        finish()
                    name, shard = row["shard"], _Shard(row["postings"], row["df"], n_docs, n_terms)
                else:
                    shard.lists[row["term"]] = _List(*(row[c] for c in ("df", "best", "lasts", "maxima", "ends", "postings")))
        if shard is not None:
            finish()
        rows = [(number, None if unknown else d, -s) for number, heap in heaps.items() for s, unknown, d in heap]
        yield pa.RecordBatch.from_pydict({"number": pa.array([r[0] for r in rows], pa.int64()),
                                          "doc_id": pa.array([r[1] for r in rows], pa.int64()),
                                          "score": pa.array([r[2] for r in rows], pa.int64())})

    heaps = (lists.repartition("shard").sortWithinPartitions("shard", "term")
             .mapInArrow(run, "number long, doc_id long, score long"))
    best = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return heaps.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def ranked(documents: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """``item_id, rank, doc_id, score`` of every item's best k documents, items in blocks."""
    index, n_docs, n_terms = build_index(documents)
    rows = stored(items.select("item_id", "text").where(F.regexp_count(F.col("text"), F.lit(TERM)) > 0).distinct()
                  .repartitionByRange("item_id", "text").sortWithinPartitions("item_id", "text")
                  .withColumn("number", F.monotonically_increasing_id()), "search-items")
    done, block, last = [], True, -1
    while block:
        block = rows.where(F.col("number") > last).orderBy("number").limit(QUERY_ROWS).select("number", "text").collect()
        if block:
            last = block[-1].number
            done.append(stored(search(index, n_docs, n_terms, [tuple(r) for r in block], k), "search-found"))
    spark = documents.sparkSession
    found = spark.createDataFrame([], "number long, doc_id long, score long, rank int")
    for part in done:
        found = found.unionByName(part)
    return found.join(rows.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")


def op12(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Contract query: the 20 best documents of every benchmark item."""
    return ranked(documents, items)


SQL = r"""
WITH found AS (
 SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
 FROM documents WHERE text IS NOT NULL),
docs AS (SELECT r, doc_id, t, CAST(len(t) AS BIGINT) AS n FROM found WHERE len(t) > 0),
total AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs),
post AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(t) AS term FROM docs) x GROUP BY r, term),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
 FROM post, total GROUP BY term, n_docs),
need AS (SELECT item_id, term, CAST(count(*) AS BIGINT) AS c FROM (SELECT item_id, unnest(regexp_extract_all(
   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark) y GROUP BY item_id, term),
scored AS (SELECT item_id, doc_id, r, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
 FROM need JOIN weight USING (term) JOIN post USING (term) JOIN docs USING (r), total GROUP BY item_id, doc_id, r)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
 SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) z
WHERE rank <= 20
"""
