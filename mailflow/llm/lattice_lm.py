"""Language-model scores from a subword lattice.

The model is a unigram model over the pieces of an existing vocabulary: a text
is a sequence of pieces and an end, each drawn by its probability. The
vocabulary's own scores give the first probabilities (they rank the pieces, so
rank r starts at 1 / (r + 10)); they are then fitted to the training texts by
expectation maximisation, in which they stay as a prior. A word's probability sums over all its
segmentations: a forward recursion in log space over the word's bytes. Pieces
never reach over white space, so a text's marginal probability is the product
over its words and one end, and each distinct word is scored once.

The corpus's words are counted by Spark; what reaches the driver is one row
per piece of the vocabulary. A text's words meet their counts and scores
through row chunks: a chunk asks for each of its distinct words once, so a
frequent word has one row per chunk, not one per text.

Words are lower-cased (A-Z) runs of ``[^\\x20\\x09-\\x0D]``; the end of a text
counts as a token. Defined results: null counts as the empty text, whose only
token is the end; no training row -> counts 0 and the vocabulary's own
scores; repeated rows are scored alike and trained on each; an empty table
gives no rows; words and texts of any length are read whole; other columns
are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import exp, inf, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, mix, stored
from .repeats import POWERS
from .sentencepiece_bpe import SPACE, model_path, read_pieces

CHUNK_ROWS = 4096
LONG, LONG_BLOCK = 512, 1 << 14  # bytes of a word scored by itself, and of it looked up together
LOG10E = np.log10(np.e)
FRONT = SPACE.encode()
_ODD = np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Lattice:
    """Pieces found by content hash; the last probability of a model is that of a text's end."""

    SLOTS = 17

    def __init__(self, pieces: list[bytes]):
        self.size = len(pieces) + 1
        self.lengths = sorted(set(map(len, pieces)))
        hashes = np.zeros(len(pieces), np.uint64)
        for n in self.lengths:
            at = [i for i, p in enumerate(pieces) if len(p) == n]
            hashes[at] = _range_hash(_prefix(np.frombuffer(b"".join(pieces[i] for i in at), np.uint8).reshape(len(at), n)), 0, n)
        # Hash tables; what finds its slot taken goes to the next table.
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        left = np.arange(len(pieces))
        while len(left):
            slot = self._slot(hashes[left], len(self.tables))
            _, first = np.unique(slot, return_index=True)
            keys, ids = np.zeros(1 << self.SLOTS, np.uint64), np.full(1 << self.SLOTS, -1, np.int32)
            keys[slot[first]], ids[slot[first]] = hashes[left[first]], left[first]
            self.tables.append((keys, ids))
            left = np.delete(left, first)

    def _slot(self, h: np.ndarray, table: int) -> np.ndarray:
        return ((h * (_ODD + np.uint64(2 * table))) >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        flat = h.ravel()
        out, left = np.full(len(flat), -1, np.int32), None  # left: places whose slot another piece has taken
        for t, (keys, ids) in enumerate(self.tables):
            asked = flat if left is None else flat[left]
            slot = self._slot(asked, t)
            got, other = ids[slot], keys[slot] != asked
            taken = np.flatnonzero(other & (got >= 0))
            got[other] = -1
            if left is None:
                out, left = got, taken
            else:
                out[left] = got
                left = left[taken]
            if not len(left):
                break
        return out.reshape(h.shape)

    def _ways(self, sums: np.ndarray, known: np.ndarray, lo: int, hi: int) -> list[list[tuple[int, int]]]:
        """Of each end in (lo, hi] of one long word the ``(start, piece)`` pairs with a probability."""
        _, down = POWERS.to(len(sums))
        found: list[list[tuple[int, int]]] = [[] for _ in range(hi - lo)]
        for size in self.lengths:
            s, e = max(lo + 1 - size, 0), hi - size + 1
            if s < e:
                piece = self.find((sums[s + size:e + size] - sums[s:e]) * down[s:e])
                for i in np.flatnonzero(known[piece] > -np.inf).tolist():
                    found[s + i + size - lo - 1].append((s + i, int(piece[i])))
        return found

    def forward_long(self, word: np.ndarray, logp: np.ndarray, uses: np.ndarray | None = None, weight: float = 1.0) -> float:
        """``forward`` of one word, and its expected uses: scalar steps over the pieces that are there.

        A long word has few others of its length, so steps over arrays of words
        would cost it hundreds of microseconds a byte. The pieces are looked up
        block by block, once for each direction; beside a block's pieces a few
        numbers a byte are held.
        """
        known, n = np.append(logp, -np.inf), len(word)
        sums, lp = _prefix(word[None, :])[:, 0], known.tolist()
        alpha, blocks = np.full(n + 1, -inf), [(s, min(s + LONG_BLOCK, n)) for s in range(0, n, LONG_BLOCK)]
        reach = self.lengths[-1]
        alpha[0] = 0.0
        for lo, hi in blocks:
            first = max(lo - reach, 0)  # no piece starts before it
            a = alpha[first:hi + 1].tolist()
            for end, at in enumerate(self._ways(sums, known, lo, hi), lo + 1):
                ways = [a[s - first] + lp[p] for s, p in at]
                most = max(ways, default=-inf)
                if most > -inf:
                    a[end - first] = most + log(sum([exp(w - most) for w in ways]))
            alpha[lo + 1:hi + 1] = a[lo + 1 - first:]
        if uses is not None and alpha[n] > -inf:
            passes = np.zeros(n + 1)
            passes[n] = weight
            for lo, hi in reversed(blocks):
                first = max(lo - reach, 0)
                a, u = alpha[first:hi + 1].tolist(), passes[first:hi + 1].tolist()
                found = self._ways(sums, known, lo, hi)
                for end in range(hi, lo, -1):
                    through = u[end - first]
                    if through:
                        for s, p in found[end - lo - 1]:
                            one = through * exp(a[s - first] + lp[p] - a[end - first])
                            u[s - first] += one
                            uses[p] += one
                passes[first:hi + 1] = u
        return float(alpha[n])

    def forward(self, x: np.ndarray, logp: np.ndarray, edges: list | None = None) -> np.ndarray:
        """Log marginal probability of words of one length (rows of bytes), over all segmentations.

        Goes through the prefixes in log space. ``edges`` collects for each
        end: the starts, the pieces and each edge's share of the prefix.
        """
        if edges is None and x.shape[1] > LONG:
            return np.array([self.forward_long(w, logp) for w in x])
        sums, known = _prefix(x), np.append(logp, -np.inf)  # piece -1 has no probability
        alpha = np.full((x.shape[1] + 1, len(x)), -np.inf)
        alpha[0] = 0
        for end in range(1, x.shape[1] + 1):
            starts = [end - n for n in self.lengths if n <= end]
            piece = self.find(np.stack([_range_hash(sums, s, end) for s in starts]))
            ways = alpha[starts] + known[piece]
            most = ways.max(axis=0)
            share = np.exp(ways - np.where(np.isfinite(most), most, 0))
            total = share.sum(axis=0)
            with np.errstate(divide="ignore"):
                alpha[end] = most + np.log(total)
            if edges is not None:
                edges.append((starts, piece, share / np.where(total > 0, total, 1)))
        return alpha[-1]

    def expected(self, x: np.ndarray, weight: np.ndarray, logp: np.ndarray, total: np.ndarray) -> None:
        """Adds the expected uses of each piece in words x, each seen ``weight`` times."""
        if x.shape[1] > LONG:
            for w, times in zip(x, weight.tolist()):
                self.forward_long(w, logp, total, times)
            return
        edges: list = []
        self.forward(x, logp, edges)
        passes = np.zeros((x.shape[1] + 1, len(x)))  # expected passes through each prefix
        passes[-1] = weight
        for end in range(x.shape[1], 0, -1):
            starts, piece, share = edges[end - 1]
            use = share * passes[end]
            for s, u in zip(starts, use):
                passes[s] += u
            ok = piece >= 0
            total += np.bincount(piece[ok], use[ok], self.size)


def _prefix(x: np.ndarray) -> np.ndarray:
    up, _ = POWERS.to(x.shape[1] + 1)
    sums = np.zeros((x.shape[1] + 1, len(x)), np.uint64)
    np.cumsum(mix(x.astype(np.uint64) + np.uint64(1)).T * up[:x.shape[1], None], axis=0, out=sums[1:])
    return sums


def _range_hash(sums: np.ndarray, start: int, end: int) -> np.ndarray:
    _, down = POWERS.to(len(sums))
    return (sums[end] - sums[start]) * down[start]


def by_length(words: list[bytes], most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of words of one length with the space in front: their places and bytes."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        step = max(1, most // (int(n) + 3))
        for i in range(0, len(at), step):
            part = at[i:i + step]
            x = np.frombuffer(b"".join(FRONT + words[j] for j in part), np.uint8)
            yield part, x.reshape(len(part), -1)


def vocabulary(path: str | None = None) -> tuple[list[bytes], np.ndarray]:
    """Distinct pieces (no pure space runs; single bytes included) and their first log probabilities.

    The last probability is that of the end of a text.
    """
    ranks: dict[bytes, int] = {}
    pieces = read_pieces(path or model_path())
    normal = [p for p, _, k in pieces if k in (1, 4) and p.encode().lower() == p.encode()]  # texts are lower-cased
    for r, p in enumerate(p for p in normal if p == SPACE or p.strip(SPACE)):
        ranks.setdefault(p.encode(), r)
    for i in range(256):
        ranks.setdefault(bytes([i]), len(normal) + i)
    weight = 1.0 / (np.array(list(ranks.values()), float) + 10)
    weight = np.append(weight, weight.sum() / 1000)
    return list(ranks), np.log(weight / weight.sum())


def fit(words: DataFrame, ends: int, lattice, logp: np.ndarray, rounds: int = 3, prior: float = 1.0) -> np.ndarray:
    """Expectation maximisation over ``words(word, c)``; one row per piece comes back each round.

    The vocabulary's probabilities stay as a prior: each piece has been seen
    ``prior`` times the number of pieces times its first probability before.
    """
    spark, before = words.sparkSession, prior * len(logp) * np.exp(logp)
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(logp)

        def expect(batches):
            total = np.zeros(lattice.value.size)
            for b in batches:
                ws, c = list(b["word"]), b["c"].to_numpy(float)
                for at, x in by_length(ws):
                    lattice.value.expected(x, c[at], now.value, total)
            used = np.flatnonzero(total)
            yield pd.DataFrame({"piece": used, "uses": total[used]})

        got = (words.where("c > 0").mapInPandas(expect, "piece int, uses double")
               .groupBy("piece").agg(F.sum("uses").alias("uses")).toPandas())
        uses = before.copy()
        uses[got["piece"].to_numpy(int)] += got["uses"].to_numpy(float)
        uses[-1] += ends
        logp = np.log(uses / uses.sum())
    return logp


def score(docs: DataFrame, keep: list[str], path: str | None = None, rounds: int = 3) -> DataFrame:
    """Columns ``keep`` of ``docs(text, train, ...)`` with token counts, base and lattice scores."""
    spark = docs.sparkSession
    # Rows in chunks: the words of a chunk are asked for together.
    rows = stored(docs.select(*keep, "text", "train").withColumn(
        "chunk", F.expr(f"monotonically_increasing_id() div {CHUNK_ROWS}")), "lm-docs")

    def count(batches):
        seen: dict[int, tuple[Counter, Counter]] = {}
        for b in batches:
            for chunk, t, train in zip(b["chunk"], b["text"], b["train"]):
                if chunk not in seen:
                    for c, both in seen.items():
                        yield table(c, *both)
                    seen = {chunk: (Counter(), Counter())}
                seen[chunk][0 if train else 1].update(words_of(None if pd.isna(t) else t))
        for c, both in seen.items():
            yield table(c, *both)

    def table(chunk, train, rest):
        ws = list(train) + [w for w in rest if w not in train]
        return pd.DataFrame({"word": ws, "chunk": chunk, "n": [train[w] for w in ws]})

    asked = stored(rows.select("chunk", "text", "train").mapInPandas(count, "word binary, chunk long, n long"), "lm-asked")
    words = stored(asked.groupBy("word").agg(F.sum("n").alias("c")), "lm-words")
    total = words.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    ends = rows.where("train").count()
    n, v = (total["n"] or 0) + ends, (total["v"] or 0) + (ends > 0)
    pieces, logp = vocabulary(path)
    lattice = spark.sparkContext.broadcast(Lattice(pieces))
    if n:
        logp = fit(words, ends, lattice, logp, rounds)
    model = spark.sparkContext.broadcast(logp)

    def marginal(batches):
        for b in batches:
            ws, out = list(b["word"]), np.zeros(len(b))
            for at, x in by_length(ws):
                out[at] = lattice.value.forward(x, model.value)
            yield pd.DataFrame({"word": b["word"], "c": b["c"], "lp": (out * LOG10E).astype(np.float32)})

    scored = stored(words.mapInPandas(marginal, "word binary, c long, lp float"), "lm-scored")
    answers = asked.select("word", "chunk").join(scored, "word").select("chunk", "word", "c", "lp")
    base_of = lambda c: np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    end = float(base_of(ends)), float(logp[-1] * LOG10E)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def add(key, texts, answer):
        base = dict(zip(answer["word"], base_of(answer["c"].to_numpy(float)).tolist()))
        lp = dict(zip(answer["word"], answer["lp"].tolist()))
        known = set(answer["word"][answer["c"] > 0])
        out = []
        for t in texts["text"]:
            ws = words_of(None if pd.isna(t) else t)
            out.append((len(ws) + 1, sum(map(known.__contains__, ws)) + (ends > 0),
                        sum(map(base.__getitem__, ws)) + end[0], sum(map(lp.__getitem__, ws)) + end[1]))
        got = texts[keep].copy()
        got["n_tokens"], got["n_known"] = [r[0] for r in out], [r[1] for r in out]
        got["train_tokens"] = n
        got["base_score"], got["score"] = [r[2] for r in out], [r[3] for r in out]
        return got

    return (rows.drop("train").groupBy("chunk").cogroup(answers.groupBy("chunk"))
            .applyInPandas(add, schema + ", n_tokens long, n_known long, train_tokens long, base_score double, score double"))


def op2(documents: DataFrame) -> DataFrame:
    """Contract query: learn where crc32(doc_id) mod 5 is not 1, score every whole text."""
    held = crc_mod("doc_id", 5) == 1
    return score(documents.select("doc_id", "text", held.alias("held_out"), (~held).alias("train")), ["doc_id", "held_out"])
