"""Product quantisation in integers, nearest entries by a Walsh-Hadamard transform.

Components become floor(scale * x); a vector's parts are coded by the nearest
of their position's codebook entries, and the codebooks are refined by rounds of
assignment and componentwise floor means, all in integers, so that every
machine and every order of rows gives the same codes.

Nearest entry: parts and entries are padded with zeros to a power of two, d,
and transformed by the Walsh-Hadamard matrix, whose rows are taken in sequency
order (number of sign changes), where neighbouring components concentrate
energy in the first coefficients. The sum of squared differences of the
coefficients is d times the squared distance, so the sum over the first
coefficients bounds it from below: entries whose sum exceeds the whole distance
of the most promising entry are out, and only the others go on, a few
coefficients at a time. Entries in a tie stay to the end; the lower index wins.

Each round is one pass: tasks add up their parts by entry (a fixed number of
rows each), Spark adds the tasks, the driver divides ``parts * entries`` rows.

Defined results: vectors that are null or hold null or non-finite components
are dropped; vectors shorter than the longest count as padded with zeros, and
all are padded to a multiple of the number of parts (an empty one to zeros);
the start is the smallest vec_ids (null last, equal ones by their components),
fewer entries if fewer vectors; components too large for 64-bit sums are
computed with unbounded integers, and errors beyond 64 bits are reported as the
largest one; null labels form one group; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, sized_broadcast, stored

LARGEST = (1 << 63) - 1
SMALL = 1 << 22  # components below it keep every sum of a block inside 64 bits
STEP = 2  # coefficients between two eliminations
ROWS = 8192  # vectors at a time


def hadamard(d: int) -> np.ndarray:
    """The d x d Walsh-Hadamard matrix (d a power of two), rows by their number of sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < d:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((np.diff(h, axis=1) != 0).sum(axis=1), kind="stable")]


def scaled(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, exactly; unbounded integers where 64 bits might not do."""
    if not vectors.size or np.abs(vectors).max() * scale < SMALL:
        return np.floor(vectors * scale).astype(np.int64)
    flat = [math.floor(x) * scale if abs(x) >= 2.0 ** 53 else math.floor(x * scale) for x in vectors.ravel().tolist()]
    return np.array(flat, object).reshape(vectors.shape)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row (lower index on ties) and its squared distance."""
    width = parts.shape[1]
    d = 1 << max(0, width - 1).bit_length()
    h = hadamard(d)[:, :width]  # the padding is zero, so its columns add nothing
    if parts.dtype == object or entries.dtype == object:
        h = h.astype(object)
    x, c = parts @ h.T, entries @ h.T
    sums = (x[:, :1] - c[:, 0]) ** 2  # rows x entries, over the first coefficient
    hope = np.asarray(np.argmin(sums, axis=1))
    best = ((x - c[hope]) ** 2).sum(axis=1)  # d times a whole distance
    row, entry = np.nonzero(sums <= best[:, None])
    total = sums[row, entry]
    for at in range(1, d, STEP):
        total = total + ((x[row, at:at + STEP] - c[entry, at:at + STEP]) ** 2).sum(axis=1)
        stays = total <= best[row]
        row, entry, total = row[stays], entry[stays], total[stays]
    # What is left lies at the least distance or at the hoped one; both are whole.
    order = np.lexsort((entry, total.astype(float) if total.dtype == object else total, row)) \
        if total.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], total[i], entry[i])), int)
    row, entry, total = row[order], entry[order], total[order]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else row
    return entry[first], total[first] // d


def _blocks(batches: Iterator[pa.RecordBatch], column: int, width: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of at most ``ROWS`` vectors with their scaled components, padded to ``width``."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            rows = batch.slice(at, ROWS)
            lists = rows.column(column)
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if (n == width).all():
                vectors = flat.reshape(-1, width)
            else:
                vectors = np.zeros((len(n), width))
                vectors[np.arange(width) < n[:, None]] = flat
            yield rows, scaled(vectors, scale)


def _sums(vectors: DataFrame, books: list[np.ndarray], width: int, scale: int) -> DataFrame:
    """``(part, entry, n, sums)``: how many parts chose an entry, and their componentwise sum."""
    each = width // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, object) for b in books]
        for _, x in _blocks(batches, 0, width, scale):
            for p, book in enumerate(books):
                part = x[:, p * each:(p + 1) * each]
                chosen, _ = nearest(part, book)
                for e in np.unique(chosen):
                    own = part[chosen == e]
                    counts[p][e] += len(own)
                    sums[p][e] += own.sum(axis=0).astype(object)
        rows = [(p, e, int(counts[p][e]), [str(v) for v in sums[p][e]]) for p in range(len(books))
                for e in range(len(books[p])) if counts[p][e]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
             pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.string()))],
            names=["part", "entry", "n", "sums"])

    tasks = vectors.select("embedding").mapInArrow(run, "part int, entry int, n long, sums array<string>")
    return (tasks.select("part", "entry", "n", F.posexplode("sums").alias("at", "sum"))
            .groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum")))


def train(vectors: DataFrame, width: int, parts: int = 8, entries: int = 16, rounds: int = 6,
          scale: int = 4096) -> list[np.ndarray]:
    """Codebooks, one ``entries x (width / parts)`` integer array a part, from all of ``(vec_id, embedding)``."""
    each = width // parts
    start = (vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect())
    first = np.zeros((len(start), width))
    for i, r in enumerate(start):
        first[i, :len(r.embedding)] = r.embedding
    whole = scaled(first, scale)
    books = [whole[:, p * each:(p + 1) * each].copy() for p in range(parts)]
    for _ in range(rounds):
        for r in _sums(vectors, books, width, scale).collect():  # parts * entries * (width / parts) rows
            value = int(r["sum"]) // r.n
            if books[r.part].dtype != object and abs(value) >= SMALL:
                books[r.part] = books[r.part].astype(object)
            books[r.part][r.entry, r.at] = value
    return books


def encode(vectors: DataFrame, books: list[np.ndarray], width: int, scale: int = 4096) -> DataFrame:
    """``(vec_id, label, code, error)``: two hex digits a part, and the squared distances' sum."""
    each = width // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, x in _blocks(batches, 2, width, scale):
            codes, error = np.empty((len(x), len(books)), np.uint8), np.zeros(len(x), object)
            for p, book in enumerate(books):
                codes[:, p], far = nearest(x[:, p * each:(p + 1) * each], book)
                error = error + far.astype(object)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()),
                 pa.array([min(e, LARGEST) for e in error], pa.int64())], names=["vec_id", "label", "code", "error"])

    types = dict(vectors.dtypes)
    return vectors.select("vec_id", "label", "embedding").mapInArrow(
        run, f"vec_id {types['vec_id']}, label {types['label']}, code string, error long")


def quantise(embeddings: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """Codes and errors of ``(vec_id, embedding, label)``, with the label's error and the codebooks' digest."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = stored(embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
                  .where(F.col("embedding").isNotNull() & finite), "vectors")
    longest = kept.agg(F.max(F.size("embedding"))).first()[0]
    width = parts * max(1, -(-(longest or 0) // parts))
    books = train(kept, width, parts, entries, rounds, scale) if longest is not None else \
        [np.zeros((0, width // parts), np.int64)] * parts
    listed = ",".join(str(v) for b in books for e in b for v in e)
    digest = hashlib.sha256(listed.encode()).hexdigest()
    coded = stored(encode(kept, books, width, scale), "vector-codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    by_label = cut(coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of"))
    return (coded.join(sized_broadcast(by_label, 100_000), F.col("label").eqNullSafe(F.col("of")))
            .select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")))


def op13(embeddings: DataFrame) -> DataFrame:
    """Contract query over every vector: 8 parts, 16 entries, 6 rounds, components times 4096."""
    return quantise(embeddings)


def _sql() -> str:
    """The same by unrolled rounds of joins with the entries."""
    steps = ["""WITH kept AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
 FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS MATERIALIZED (SELECT r, p, list_slice(v, p * (len(v) // 8) + 1, (p + 1) * (len(v) // 8)) AS v FROM kept, range(8) t(p)),
b0 AS MATERIALIZED (SELECT p, e, v FROM cells JOIN (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 16) s USING (r))"""]
    near = """a{i} AS MATERIALIZED (SELECT r, p, min(d * 16 + e) % 16 AS e, min(d * 16 + e) // 16 AS d FROM (SELECT c.r, c.p, b.e,
 CAST(list_sum(list_transform(range(1, len(c.v) + 1), lambda i: (c.v[i] - b.v[i]) * (c.v[i] - b.v[i]))) AS BIGINT) AS d
 FROM cells c JOIN b{i} b ON b.p = c.p) x GROUP BY r, p)"""
    for i in range(7):
        steps.append(near.format(i=i))
        if i < 6:
            steps.append(f"""m{i} AS (SELECT p, e, list(m ORDER BY j) AS v FROM (SELECT p, e, j, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS m
 FROM (SELECT p, e, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS j FROM cells JOIN a{i} USING (r, p)) y GROUP BY p, e, j) z GROUP BY p, e),
b{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{i}.v, b{i}.v) AS v FROM b{i} LEFT JOIN m{i} USING (p, e))""")
    steps.append("""coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a6 GROUP BY r),
book AS (SELECT sha256(string_agg(x, ',' ORDER BY p, e)) AS s FROM (SELECT p, e, array_to_string(v, ',') AS x FROM b6) y)""")
    return ",\n".join(steps) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256
FROM coded JOIN kept USING (r), book"""


SQL = _sql()
