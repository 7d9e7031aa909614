"""Range coder for token ids whose probabilities mix order-0, order-1 and order-2 predictions.

A block of ids is coded on its own: it carries the sorted ids that occur in it,
starts from a fresh model and has checksums of its bytes and of its ids. The
model of a block predicts the next id three times:

* order 0: adaptive counts of the block's ids, accumulated anew every
  ``REFRESH`` ids to a distribution of total 2**16;
* order 1 and order 2: the id last seen after the previous id, and after (a
  hash of) the previous two, each with a confidence of 1 to 3.

The three are mixed by 8-bit weights that are learned while coding, for each
joint state of the two confidences: a step's interval is dealt to the orders by
weight, and one arithmetic coding step codes an id in the part of the highest
order that predicts it (order 0 predicts every id of the block). All arithmetic
is in integers, so every machine decodes alike.

Blocks are independent, so many are coded side by side, one lane of the arrays
each; memory is bounded by ``LANES`` blocks.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 8192  # ids in a block
LANES = 1024  # blocks coded side by side
REFRESH = 256  # ids between two accumulations of the order-0 counts
GAIN = 2  # what one occurrence adds to an order-0 count
SLOTS = 1 << 11  # order-2 contexts of a block
UNIT = 16  # bits of the order-0 total; with 8 bits of weight a step has 24 bits
STEP = UNIT + 8
CREDIT = 4000  # with a decay of 1/16 the weights of a state stay below 2**16 - 256 in sum
GROWN = np.array([1, 1, 1, 1, 1, 2, 3, 3], np.int32)  # confidence after a miss, then a hit, by confidence
WORD = 24  # bits of a coded word; a range stays between 2**32 and 2**56
LEAST = 1 << 32
TILE = 64  # steps that are laid side by side at once
KEEP = np.array([-1, LEAST - 1])
HEAD = struct.Struct("<IIIII")  # ids, symbols, alphabet bytes, words, crc32 of the ids


class DamagedBlock(ValueError):
    """A block whose bytes or ids do not match their checksums."""


class _Model:
    """The models of blocks side by side, flat arrays with one stretch per lane; symbols start at 1.

    Arrays of two rows hold order 2 in the first and order 1 in the second.
    """

    N2, N1 = np.arange(32, dtype=np.int32) >> 3, np.arange(32, dtype=np.int32) >> 1 & 3
    START = np.stack([np.where(N2 > 0, 8000 + 7000 * N2, 256), np.where(N1 > 0, 6000 + 4000 * N1, 256)]).astype(np.int32)

    def __init__(self, sizes: np.ndarray):
        k, a = len(sizes), int(sizes.max())
        lane = np.arange(k, dtype=np.int64)
        self.sizes = sizes.astype(np.int64)
        self.counts = ((np.arange(a + 1) <= sizes[:, None]) & (np.arange(a + 1) > 0)).astype(np.int64)
        self.cum = np.zeros((k, a + 2), np.int32)
        self.seen = np.zeros(k * (a + 1 + SLOTS), np.int32)  # id << 2 | confidence, by context
        self.weights = np.tile(self.START, (1, k)).reshape(-1)  # learned, by state
        self.places = (np.stack([lane * SLOTS, k * SLOTS + lane * (a + 1)]), np.stack([lane * 32, k * 32 + lane * 32]),
                       lane * (a + 2), lane * (a + 1), (lane * ((1 << UNIT) + 1)).astype(np.int32))
        self.context = np.zeros((2, k), np.int64)
        self.flat = self.cum.reshape(-1)
        self.resize(k)
        self.refresh(0, None)

    def resize(self, k: int) -> None:
        """Only the first k lanes go on."""
        self.active = k
        self.at_seen, self.at_weight, self.at_cum, self.at_count, self.off = (x[..., :k] for x in self.places)
        self.context = self.context[:, :k]

    def refresh(self, t: int, new: np.ndarray | None) -> None:
        """Accumulates the order-0 counts with the symbols ``new`` of the steps since the last time."""
        k = self.active
        if new is not None:
            found = np.bincount((new + self.at_count).reshape(-1), minlength=self.counts.size)
            found *= GAIN
            self.counts += found.reshape(self.counts.shape)
        sums = np.cumsum(self.counts[:k], axis=1, dtype=np.int64)
        sums *= ((1 << 40) // (self.sizes[:k] + GAIN * t))[:, None]
        sums >>= 40 - UNIT
        sums += self.off[:, None]
        self.cum[:k, 0] = self.off
        self.cum[:k, 1:] = sums

    def predict(self) -> None:
        """Contexts, predicted symbols and the orders' shares of the next step."""
        self.i = self.at_seen + self.context
        e = self.seen.take(self.i)
        self.c = e >> 2
        e &= 3
        self.n = e
        state = (e[0] << 2) + e[1]
        state <<= 1
        state += self.c[0] == self.c[1]
        self.state = self.at_weight + state
        self.v = self.weights.take(self.state)
        w = self.v >> 8
        self.l0 = 256 - w[0]
        self.l0 -= w[1]
        w <<= UNIT
        self.w = w
        self.top = w[0] + w[1]

    def span(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of the step's part that codes symbols ``s``."""
        at = self.at_cum + s
        low = self.flat.take(at)
        at += 1
        width = self.flat.take(at)
        width -= low
        low -= self.off
        low *= self.l0
        low += self.top
        width *= self.l0
        hit = self.hit = self.c == s
        hit[1] &= ~hit[0]
        for row, first in ((0, 0), (1, self.w[0])):
            np.copyto(low, first, where=hit[row])
            np.copyto(width, self.w[row], where=hit[row])
        return low, width

    def find(self, v: np.ndarray) -> np.ndarray:
        """The symbols whose parts hold ``v``."""
        x = v - self.top
        two = x < 0
        x //= self.l0
        x += self.off
        s = self.flat.searchsorted(x.astype(np.int32), "right")
        s -= self.at_cum
        s -= 1
        np.copyto(s, self.c[1], where=two)
        np.copyto(s, self.c[0], where=v < self.w[0])
        return s

    def learn(self, s: np.ndarray) -> None:
        """Takes up the symbols that ``span`` was asked for last."""
        hit, v = self.hit, self.v
        v -= v - 256 >> 4  # a weight never falls to nothing
        v += hit * CREDIT
        self.weights[self.state] = v
        n = self.n
        n += (self.c == s) << 2
        s4 = s << 2
        self.seen[self.i] = GROWN.take(n) + s4
        two = self.context[1] << 6
        two ^= s
        two *= 40503
        two >>= 3
        two &= SLOTS - 1
        self.context[0] = two
        self.context[1] = s


def _steps(lengths: np.ndarray):
    """``(t, active lanes, refresh?)`` for lanes in order of falling length."""
    k = len(lengths)
    for t in range(int(lengths[0]) if k else 0):
        while lengths[k - 1] <= t:
            k -= 1
        yield t, k, t % REFRESH == 0 and t > 0 or t in (16, 32, 64, 128)


def _symbols(ids: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted ids of a block and its ids as places in that list, from 1."""
    ids = ids.astype(np.int64)
    found = np.zeros(len(table), bool)
    found[ids] = True
    alphabet = np.flatnonzero(found)
    table[alphabet] = np.arange(1, len(alphabet) + 1)
    return alphabet, table.take(ids)


def _packed(words: np.ndarray) -> bytes:
    return words.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _unpacked(data: np.ndarray) -> np.ndarray:
    parts = data.reshape(-1, 3).astype(np.int64)
    return parts[:, 0] | parts[:, 1] << 8 | parts[:, 2] << 16


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Non-empty arrays of at most ``BLOCK`` ids -> the bytes of each block."""
    out: list[bytes] = []
    for i in range(0, len(blocks), LANES):
        out += _encode(blocks[i:i + LANES])
    return out


def _repeats(context: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``_Model`` predicts for each place of a block by one context, and its confidence.

    Places sorted by context follow each other as the model visits its entry.
    """
    by = context.astype(np.uint16).argsort(kind="stable")
    at, sym = context.take(by), s.take(by)
    met = np.zeros(len(s), bool)
    np.equal(at[1:], at[:-1], out=met[1:])
    before = np.zeros_like(sym)
    np.multiply(sym[:-1], met[1:], out=before[1:])
    place = np.arange(len(s), dtype=np.int32)
    run = place - np.maximum.accumulate(np.where(before == sym, 0, place))  # hits in a row up to here
    sure = np.zeros(len(s), np.int32)
    np.minimum(run[:-1] + 1, 3, out=sure[1:])
    sure *= met
    predicted, n = np.empty_like(before), np.empty_like(sure)
    predicted[by], n[by] = before, sure
    return predicted, n


def _epochs(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The steps at which the order-0 counts of ``n`` ids are accumulated, and the number of the last one by step."""
    starts = np.array(sorted({0, 16, 32, 64, 128, *range(REFRESH, max(n, REFRESH), REFRESH)}))
    return starts, (starts.searchsorted(np.arange(n), "right") - 1).astype(np.int32)


def _block_steps(s: np.ndarray, a: int, starts: np.ndarray, epoch: np.ndarray) -> tuple[np.ndarray, ...]:
    """Order-0 start and width of each step, which order hits (2, 1 or 0), and the state of the weights."""
    n = len(s)
    p = np.zeros(n + 1, np.int32)
    p[1:] = s
    two = np.zeros(n, np.int64)
    two[1:] = ((p[:-2].astype(np.int64) << 6 ^ p[1:-1]) * 40503 >> 3) & SLOTS - 1
    c2, n2 = _repeats(two, s)
    c1, n1 = _repeats(p[:-1], s)
    hit = np.where(c2 == s, 2, c1 == s).astype(np.uint8)
    state = ((n2 << 2) + n1 << 1) + (c2 == c1)
    epoch = epoch[:n]
    used = int(epoch[-1]) + 1
    cell = epoch * (a + 1) + s.astype(np.int64)
    found = np.bincount(cell, minlength=used * (a + 1)).astype(np.int32).reshape(used, a + 1)
    counts = np.zeros_like(found)
    np.cumsum(found[:-1], axis=0, out=counts[1:])
    counts *= GAIN
    counts[:, 1:] += 1
    sums = np.cumsum(counts, axis=1, dtype=np.int32).reshape(-1)
    scale = ((1 << 40) // (a + GAIN * starts[:used])).take(epoch)
    low = (sums.take(cell - 1) * scale >> 40 - UNIT).astype(np.int32)
    width = (sums.take(cell) * scale >> 40 - UNIT).astype(np.int32)
    width -= low
    return low, width, hit, state.astype(np.uint8)


def _weights(hits: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weights of order 2 and order 1 at each place of ``hits``, which holds the places by block and state.

    Every state of every block learns on its own, so all of them go side by side.
    """
    first = _Model.START[:, np.arange(len(lengths)) % 32]
    order = np.argsort(-lengths, kind="stable")
    place, lengths = (np.cumsum(lengths) - lengths)[order], lengths[order]
    v = first[:, order].astype(np.int32)
    credit = np.array([[0, 0, CREDIT], [0, CREDIT, 0]], np.int32)
    w2, w1 = np.empty(len(hits), np.uint8), np.empty(len(hits), np.uint8)
    active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), "right")
    k = len(lengths)
    for k_now in active.tolist():
        if k_now < k:
            k = k_now
            v, place = v[:, :k].copy(), place[:k].copy()
        w = v >> 8
        w2[place], w1[place] = w
        v -= v - 256 >> 4  # a weight never falls to nothing
        v += credit.take(hits.take(place), axis=1)
        place += 1
    return w2, w1


def _all_steps(symbols: list[np.ndarray], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Start and width of every step of all blocks, a row each: what ``_Model`` gives step by step.

    All symbols are known here, so each block's predictions are found at once.
    """
    n = len(symbols[0])
    start, freq = np.zeros((len(symbols), n), np.int32), np.zeros((len(symbols), n), np.int32)
    starts, epoch = _epochs(n)
    orders, sorted_hits, lengths = [], [], []
    for j, (s, a) in enumerate(zip(symbols, sizes)):
        low, width, hit, state = _block_steps(s, a, starts, epoch)
        by = state.argsort(kind="stable")
        low.take(by, out=start[j, :len(s)], mode="clip")
        width.take(by, out=freq[j, :len(s)], mode="clip")
        sorted_hits.append(hit.take(by))
        lengths.append(np.bincount(state, minlength=32))
        orders.append(by.astype(np.uint16))
    hits = np.concatenate(sorted_hits)
    w2, w1 = _weights(hits, np.concatenate(lengths))
    at = 0
    for j, by in enumerate(orders):
        part = slice(at, at + len(by))
        at += len(by)
        by = by.astype(np.int64)
        a2, a1, hit = w2[part].astype(np.int32), w1[part].astype(np.int32), hits[part]
        low, width = start[j, :len(by)], freq[j, :len(by)]  # still by state
        both = a2 + a1
        low = low * (256 - both) + (both << UNIT)
        width = width * (256 - both)
        a2 <<= UNIT
        a1 <<= UNIT
        for row, order, first, share in ((0, 1, a2, a1), (1, 2, 0, a2)):
            np.copyto(low, first, where=hit == order)
            np.copyto(width, share, where=hit == order)
        start[j][by], freq[j][by] = low, width
    return start, freq


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    lengths = np.array([len(blocks[i]) for i in order])
    k, n = len(order), int(lengths[0])
    table = np.zeros(max(int(b.max()) for b in blocks) + 1, np.int32)
    alphabets, symbols = [], []
    for i in order:
        alphabet, s = _symbols(blocks[i], table)
        alphabets.append(alphabet)
        symbols.append(s)
    starts, freqs = _all_steps(symbols, [len(a) for a in alphabets])
    del symbols
    width = n + 4
    words, used = np.zeros(k * width, np.int32), np.arange(k, dtype=np.int64) * width
    low, rng = np.zeros(k, np.int64), np.full(k, 1 << 56, np.int64)
    for t, k, _ in _steps(lengths):
        if t % TILE == 0:
            start, freq = starts[:, t:t + TILE].T.astype(np.int64), freqs[:, t:t + TILE].T.astype(np.int64)
        lo, rg, at = low[:k], rng[:k], used[:k]
        rg >>= STEP
        lo += start[t % TILE, :k] * rg
        rg *= freq[t % TILE, :k]
        need = rg < LEAST  # one word is enough: a range never falls below 2**8
        words[at] = lo >> 32  # with its carry; overwritten where no word is due
        at += need
        shift = need * WORD
        lo &= KEEP.take(need.view(np.int8))
        lo <<= shift
        rg <<= shift
    for _ in range(3):
        words[used] = low >> 32
        used += 1
        low = (low & LEAST - 1) << WORD
    out: list[bytes] = [b""] * len(order)
    for j, i in enumerate(order):
        w = words[j * width:used[j]]
        while (over := w >> WORD).any():  # carries go to the word before
            w &= (1 << WORD) - 1
            w[:-1] += over[1:]
        listed = zlib.compress(np.diff(alphabets[j], prepend=-1).astype("<u4").tobytes(), 1)
        body = HEAD.pack(len(blocks[i]), len(alphabets[j]), len(listed), len(w),
                         zlib.crc32(blocks[i].astype("<u4").tobytes())) + listed + _packed(w)
        out[i] = body + struct.pack("<I", zlib.crc32(body))
    return out


def read_blocks(data: memoryview, at: int, n: int) -> tuple[list[np.ndarray], int]:
    """Decodes ``n`` blocks from ``data`` at ``at`` -> their ids and the place after them."""
    parts = []
    for _ in range(n):
        n_ids, n_symbols, n_listed, n_words, crc = HEAD.unpack_from(data, at)
        end = at + HEAD.size + n_listed + 3 * n_words
        if end + 4 > len(data) or struct.unpack_from("<I", data, end)[0] != zlib.crc32(data[at:end]):
            raise DamagedBlock("the bytes of a block do not match their checksum")
        listed = at + HEAD.size
        gaps = np.frombuffer(zlib.decompress(data[listed:listed + n_listed]), "<u4", n_symbols)
        parts.append((n_ids, np.cumsum(gaps.astype(np.int64)) - 1,
                      _unpacked(np.frombuffer(data, np.uint8, 3 * n_words, listed + n_listed)), crc))
        at = end + 4
    out: list[np.ndarray] = []
    for i in range(0, n, LANES):
        out += _decode(parts[i:i + LANES])
    return out, at


def _decode(parts: list[tuple[int, np.ndarray, np.ndarray, int]]) -> list[np.ndarray]:
    order = sorted(range(len(parts)), key=lambda i: -parts[i][0])
    lengths = np.array([parts[i][0] for i in order])
    k, n = len(order), int(lengths[0])
    longest = max(len(parts[i][2]) for i in order) + 4
    words = np.zeros((k, longest), np.int64)
    for j, i in enumerate(order):
        words[j, :len(parts[i][2])] = parts[i][2]
    rest = words[:, 0] << 32 | words[:, 1] << 8 | words[:, 2] >> 16
    words = words.reshape(-1)
    used, rng = np.arange(k, dtype=np.int64) * longest + 2, np.full(k, 1 << 56, np.int64)
    done = 0
    symbols = np.zeros((n, k), np.int64)
    model = _Model(np.array([len(parts[i][1]) for i in order]))
    for t, k, again in _steps(lengths):
        if k < model.active:
            model.resize(k)
        if again:
            model.refresh(t, symbols[done:t, :k])
            done = t
        model.predict()
        left, rg, at = rest[:k], rng[:k], used[:k]
        rg >>= STEP
        s = model.find(np.minimum(left // rg, (1 << STEP) - 1))
        start, freq = model.span(s)
        left -= start * rg
        rg *= freq
        need = rg < LEAST
        # The next 24 bits begin 16 bits into the word at hand and end in the one after it.
        more = (words.take(at) & 0xFFFF) << 8 | words.take(at + 1) >> 16
        shift = need * WORD
        left <<= shift
        left |= more * need
        rg <<= shift
        at += need
        symbols[t, :k] = s
        model.learn(s)
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(order)
    for j, i in enumerate(order):
        n_ids, alphabet, _, crc = parts[i]
        ids = alphabet[np.minimum(symbols[:n_ids, j], len(alphabet)) - 1]
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise DamagedBlock("the ids of a block do not match their checksum")
        out[i] = ids
    return out
