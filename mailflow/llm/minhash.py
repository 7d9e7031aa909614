"""MinHash near-duplicates by a multi-index Hamming join.

A document's set holds its distinct five-word shingles. Documents with equal
sets form a class; one of each class gets a signature of ``K`` = 64 MinHash
values cut to b = 16 bits. Two sets of similarity 0.75 differ in 16 of the 64
symbols on average; the search guarantees all pairs that differ in at most
``RADIUS`` = 31 (beyond that lie about 2 in 100,000 of the pairs that are
exactly at the threshold): the signature is split into 16 chunks of 4 symbols,
by pigeonhole one chunk has at most one error, and the keys of a chunk leave
out each of its symbols in turn, so such pairs share one of 64 keys.

Candidates are not all pairs of a key. First every member of a key is compared
with the key's smallest member only: a pair goes on if its sizes allow the
similarity and its signatures, seen at 4 bits, differ in at most RADIUS
symbols (fewer bits can only hide differences), and is confirmed on full sets
of word tuples. Then, with the components of the links found so far, the keys
that still hold several components are gathered by their largest one, and
blocks of their members are searched for links between components, through an
index of their shingles; nothing is compared within a component, and only
links leave a block.

Defined results: null text, empty text or no word -> empty set, linked with
nothing; repeated rows are one class; rows that repeat a doc_id are linked with
each other, so their groups are one, and a null doc_id is none (component null, kept false); an empty table gives
no rows; very long texts are read whole; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, components, mix, stored

WIDTH, K, CHUNKS, RADIUS = 5, 64, 16, 31
BLOCK = 2048
_RNG = np.random.default_rng(20240601)
_A = _RNG.integers(1, 1 << 63, K, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, K, np.uint64)
_P = _RNG.integers(1, 1 << 63, WIDTH, np.uint64) * np.uint64(2) + np.uint64(1)
_WORDS = WordHashes()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(ws: list[bytes]) -> set:
    """Distinct shingles as word tuples; a shorter text is one shingle."""
    if len(ws) < WIDTH:
        return {tuple(ws)} if ws else set()
    return set(zip(*(ws[i:] for i in range(WIDTH))))


def shingle_hashes(ws: list[bytes]) -> np.ndarray:
    h = _WORDS.of(ws)
    if len(ws) < WIDTH:
        n, acc = min(1, len(ws)), np.full(min(1, len(ws)), len(ws), np.uint64)
        for x, p in zip(h, _P):
            acc = mix(acc * p + x)
        return acc[:n]
    n = len(h) - WIDTH + 1
    acc = np.full(n, WIDTH, np.uint64)
    for i in range(WIDTH):
        acc += mix(h[i:i + n] * _P[i])
    return np.unique(mix(acc))


def signature(s: np.ndarray) -> np.ndarray:
    """K MinHash symbols of 16 bits."""
    low = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        block = s[i:i + 4096]
        np.minimum(low, ((block[None, :] * _A[:, None] + _B[:, None]) >> np.uint64(16)).min(axis=1), out=low)
    return (mix(low) & np.uint64(0xFFFF)).astype(np.uint16)


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """Keys of each signature row: each chunk with each of its symbols left out."""
    n, per = sig.shape[0], K // CHUNKS
    c = sig.reshape(n, CHUNKS, per).astype(np.uint64)
    out = np.empty((n, CHUNKS, per), np.uint64)
    for k in range(per):
        acc = np.zeros((n, CHUNKS), np.uint64)
        for j in range(per):
            if j != k:
                acc = (acc << np.uint64(16)) | c[:, :, j]
        out[:, :, k] = mix(acc + ((np.arange(CHUNKS, dtype=np.uint64) * np.uint64(per) + np.uint64(k)) << np.uint64(48)))
    return out.reshape(n, K)


def planes(sig: np.ndarray) -> np.ndarray:
    """Four 64-bit planes: bit i of plane p is bit p of symbol i."""
    bits = (sig[:, None, :] >> np.arange(4, dtype=np.uint16)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view(np.uint64).reshape(len(sig), 4)


def sign(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, n_shingles, digest`` of the set, text key, planes and keys."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            sets = [shingle_hashes(words_of(None if pd.isna(t) else t)) for t in b["text"]]
            sig = np.array([signature(s) for s in sets], np.uint16).reshape(len(sets), K)
            p = planes(sig).view(np.int64)
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "tk": b["tk"], "n": [len(s) for s in sets],
                "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                "p0": p[:, 0], "p1": p[:, 1], "p2": p[:, 2], "p3": p[:, 3],
                "sig": [s.tobytes() for s in sig]})

    return (docs.select("doc_id", "text", F.xxhash64("text").alias("tk"))
            .mapInPandas(run, f"doc_id {id_type}, tk long, n long, digest binary, p0 long, p1 long, p2 long, p3 long, sig binary"))


def _keys(nodes: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            if len(b):
                keys = chunk_keys(np.frombuffer(b"".join(b["sig"]), np.uint16).reshape(len(b), K)).view(np.int64)
                yield pd.DataFrame({"node": b["node"], "keys": list(keys)})

    return (nodes.select("node", "sig").mapInPandas(run, "node long, keys array<long>")
            .select(F.explode("keys").alias("key"), "node"))


def _near(a: str, b: str) -> Column:
    """Sizes allow the similarity, and at most RADIUS symbols differ in their low bits."""
    diff = F.lit(0).cast("long")
    for p in ("p0", "p1", "p2", "p3"):
        diff = diff.bitwiseOR(F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}")))
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (small * 100 >= large * 75) & (F.bit_count(diff) <= RADIUS)


def similar(a: set, b: set) -> bool:
    both = len(a & b)
    return 100 * both >= 75 * (len(a) + len(b) - both)


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of nodes whose full sets reach the similarity."""
    full = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b"))

    def run(batches):
        last, kept = None, set()
        for p in batches:
            ok = []
            for a, ta, tb in zip(p["a"], p["ta"], p["tb"]):
                if a != last:
                    last, kept = a, shingles(words_of(ta))
                ok.append(similar(kept, shingles(words_of(tb))))
            yield p.loc[ok, ["a", "b"]]

    return full.mapInPandas(run, "a long, b long")


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and one row per set of shingles: ``node`` (its number), ``lead`` (its smallest doc_id)."""
    rows = stored(sign(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "signatures")
    classes = rows.where("digest is not null and doc_id is not null").groupBy("digest").agg(
        F.min("doc_id").alias("lead"), F.min_by("tk", F.struct("doc_id", "tk")).alias("tk"), F.first("n").alias("n"),
        *[F.first(p).alias(p) for p in ("p0", "p1", "p2", "p3", "sig")])
    # Numbered as it is written: a doc_id with several texts is the lead of several classes.
    return rows, stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")


def _links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Enough links ``a, b`` between classes to connect all that similarity connects."""
    keys = _keys(classes)
    shared = keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top")
    live = stored(keys.join(shared.select("key", "hub"), "key"), "live")
    texts = _texts(docs, classes.join(live.select("node").distinct(), "node", "left_semi"))
    sides = classes.select("node", F.struct("n", "p0", "p1", "p2", "p3").alias("s"))

    def checked(pairs: DataFrame) -> DataFrame:
        both = (pairs.join(sides.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
                .join(sides.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b"))
        return confirm(both.where(_near("sa", "sb")).select("a", "b"), texts)

    stars = live.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = stored(checked(stars), "links")
    label = components(links)
    # What may still link different components: members of keys that hold several.
    tagged = live.join(label.select(F.col("id").alias("node"), "component"), "node", "left").select(
        "key", "node", F.coalesce("component", "node").alias("comp"))
    counts = tagged.groupBy("key", "comp").agg(F.count("*").alias("m"))
    mixed = (counts.groupBy("key").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.count("*").alias("k"))
             .where("k > 1").select("key", "main"))
    rest = tagged.join(mixed, "key").groupBy("main", "node").agg(F.min("comp").alias("comp"))
    return links.unionByName(stored(across(rest, texts), "links"))


def _labelled(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``digest, lead, tk, component`` of the classes, components named by any of their nodes."""
    label = components(links).withColumnRenamed("id", "node")
    return classes.select("digest", "node", "lead", "tk").join(label, "node", "left").select(
        "digest", "lead", "tk", F.coalesce("component", "node").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row of ``docs(doc_id, text)``."""
    rows, classes = _classes(docs)
    own = rows.where("digest is not null and doc_id is not null").select("doc_id", "digest")
    several = own.groupBy("doc_id").agg(F.min("digest").alias("d"), F.max("digest").alias("e")).where("d <> e")
    own = (own.join(several.select("doc_id"), "doc_id", "left_semi").distinct()
           .join(classes.select("digest", F.col("node").alias("b")), "digest").select("doc_id", "b"))
    hub = own.groupBy("doc_id").agg(F.min("b").alias("a"))
    same = own.join(hub, "doc_id").where("a <> b").select("a", "b")  # the texts of one doc_id
    named = _labelled(classes, _links(docs, classes).unionByName(same))
    least = named.groupBy("component").agg(F.min("lead").alias("component_id"))
    named = named.join(least, "component").select("digest", "component_id")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(named, "digest", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def representatives(docs: DataFrame) -> DataFrame:
    """``doc_id, tk`` (hash of the text) of the texts that stay if one of each group of similar texts does.

    Of a group the one with the smallest doc_id (then hash) stays; unlike texts
    under one doc_id are not similar, so both stay. Texts without words all stay.
    """
    rows, classes = _classes(docs)
    named = _labelled(classes, _links(docs, classes))
    best = named.groupBy("component").agg(F.min(F.struct("lead", "tk")).alias("x")).select("x.*")
    empty = rows.where("digest is null and doc_id is not null").select("doc_id", "tk").distinct()
    return best.select(F.col("lead").alias("doc_id"), "tk").unionByName(empty)


def across(rest: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between different components among the nodes of each group ``main``.

    ``rest(main, node, comp)``: a group holds all nodes that share a key with
    the group's largest component, ``main``. Its nodes outside ``main`` ask,
    all its nodes answer, in blocks of about ``BLOCK`` by ``BLOCK``, so no group
    has to fit one task; a block returns at most one link for each asking node
    and answering component.
    """
    sizes = stored(rest.groupBy("main").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"),
        F.ceil(F.sum((F.col("comp") != F.col("main")).cast("long")) / BLOCK).cast("int").alias("parts")), "groups")
    rows = rest.join(sizes, "main")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    answer = (rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
              .withColumn("part", upto("parts")).withColumn("asks", F.lit(False)))
    ask = (rows.where("comp <> main").withColumn("block", upto("blocks"))
           .withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")).withColumn("asks", F.lit(True)))
    cols = ["main", "block", "part", "asks", "node", "comp"]
    dealt = answer.select(*cols).unionByName(ask.select(*cols)).join(texts, "node")

    def search(g):
        asking, there = g[g["asks"]], g[~g["asks"]]
        pairs = links_between(asking["text"].tolist(), asking["comp"].to_numpy(), there["text"].tolist(), there["comp"].to_numpy())
        a, b = asking["node"].to_numpy(), there["node"].to_numpy()
        return pd.DataFrame([(min(a[i], b[j]), max(a[i], b[j])) for i, j in pairs], columns=["a", "b"]).astype("int64")

    return dealt.groupBy("main", "block", "part").applyInPandas(search, "a long, b long")


def links_between(texts: list, comps: np.ndarray, others: list, other_comps: np.ndarray) -> list[tuple[int, int]]:
    """Linked (text, other) of different components, one per text and component.

    Common shingles are counted over an index of the others' shingle hashes;
    a link is confirmed on full sets.
    """
    if not texts or not others:
        return []
    sets = [shingle_hashes(words_of(t)) for t in others]
    size = np.array([len(x) for x in sets])
    shingle, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(shingle, kind="stable")
    shingle, owner = shingle[order], owner[order]
    out = []
    for i, t in enumerate(texts):
        mine = shingle_hashes(words_of(t))
        low, high = np.searchsorted(shingle, mine), np.searchsorted(shingle, mine, "right")
        n = high - low
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        both = np.bincount(owner[at], minlength=len(sets))
        found = np.flatnonzero((100 * both >= 75 * (len(mine) + size - both)) & (other_comps != comps[i]))
        done: set[int] = set()
        for j in found.tolist():
            if other_comps[j] not in done and similar(shingles(words_of(t)), shingles(words_of(others[j]))):
                done.add(other_comps[j])
                out.append((i, j))
    return out


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """One text per node, for the nodes that have a candidate."""
    wanted = nodes.select("node", "tk")
    got = (docs.select(F.xxhash64("text").alias("tk"), "text")
           .join(wanted, "tk").groupBy("node").agg(F.first("text").alias("text")))
    return stored(got, "texts")


def op3(documents: DataFrame) -> DataFrame:
    """Contract query over every whole text."""
    return near_duplicates(documents.select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE words AS (
 SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (
 SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
   ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS grams FROM words),
members AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM sets),
links AS (
 SELECT a.doc_id AS x, b.doc_id AS y FROM members a JOIN members b ON a.gram = b.gram AND a.doc_id <> b.doc_id
 GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(s.grams) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(l.y, s.doc_id)) AS component_id,
 s.doc_id <= coalesce(l.y, s.doc_id) AS kept
FROM sets s LEFT JOIN low l ON l.x = s.doc_id"""
