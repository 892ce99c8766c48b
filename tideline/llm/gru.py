"""LM scoring: a gated recurrent language model with a class-factored softmax, trained by truncated backpropagation in numpy.

P(word) = P(class | state) P(cell | class, state) P(word | cell): frequent words have a class and, in it, one of a few cells, both
by a softmax from the state; the most frequent words are cells of their own, others share one by their counts. Words that aren't frequent are
spelled: a class for each group of documents, then counts mixed with a letter model of the group.

Every training document takes part: its words are counted, and each partition trains the recurrent part on its own documents; the
partitions' parameters are averaged by their tokens after each of ROUNDS. Only counts of the most frequent words, at most HEAD of
them, and tables of a fixed size reach the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import durable, gathered, map_batches, table

#: The most frequent words, which have a class, a cell and a share of it, and how often each must occur; all others are spelled.
HEAD, LEAST = 200_000, 4
#: Classes of frequent words and cells of a class, hidden units, lanes and steps of a training window, rate.
CLASSES, CELLS, HIDDEN, LANES, STEPS, RATE = 28, 16, 12, 256, 16, 0.02
#: Windows that a stream makes at least: a short one is cut into fewer lanes.
WINDOWS = 400
#: Parts of the documents, by hash of the text, after each of which the partitions' parameters are averaged.
ROUNDS = 2
#: Groups of documents (such as languages) whose words are classed and spelled apart; the rest count as one.
GROUPS = 6
#: Bytes of the texts whose words are in memory at once, if one text has no more; symbols that a partition trains on at a time.
CHUNK, CHUNK_SYMBOLS = 12 << 20, 4 << 20
SEED = 11
#: Symbols of the spelling model: 0 between words, letters, digits, other ASCII, first bytes beyond, and six for the bytes after.
SYMBOLS = 36
SYMBOL = bytes(0 if b == 0 else b - 96 if 97 <= b <= 122 else 27 if 48 <= b <= 57 else 28 if b < 128 else 29 if b >= 0xC0 else 30 + b % 6 for b in range(256))
GRAMS = SYMBOLS**4
#: Scoring holds weights and states in steps of 1 / GRID, so that products and sums are exact whatever their order; the curves are tables.
GRID, REACH, FINE = 1 << 14, 8, 1 << 10


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of binary texts, one after another, and how many each text has; null texts have none."""
    as_string = pc.cast(texts, options=pc.CastOptions(target_type=pa.string(), allow_invalid_utf8=True))
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(as_string, "")))
    words, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy()).astype(np.int64)
    some = pc.greater(pc.binary_length(words), 0)  # beside white space at an end there is an empty one
    kept = some.to_numpy(zero_copy_only=False)
    if kept.all():
        return words, sizes
    return words.filter(some), np.bincount(np.repeat(np.arange(len(sizes)), sizes)[kept], minlength=len(sizes))


# --- the recurrent part ---------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


#: The largest logit of a softmax; its exponential is still a number of 32 bits.
MOST_LOGIT = 80.0


def _softmax(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of columns: exponentials and their sums."""
    e = np.exp(np.minimum(x, MOST_LOGIT, out=x))
    return e, e.sum(0)


class Gru:
    """P(symbol | symbols before), a symbol being a cell of a class. The last symbol ends a document; after it the state is empty.

    class_of, slot_of: of each symbol; the first `split` classes have several cells. By default each symbol is a class.
    """

    def __init__(self, symbols: int, hidden: int = HIDDEN, class_of: np.ndarray | None = None, slot_of: np.ndarray | None = None, split: int = 0, bias: np.ndarray | None = None, inner: np.ndarray | None = None, seed: int = SEED) -> None:
        """bias: of the classes; inner: of the cells of the first classes."""
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) * 0.15).astype(np.float32)
        self.class_of = np.arange(symbols, dtype=np.int16) if class_of is None else class_of.astype(np.int16)
        self.slot_of = np.zeros(symbols, np.int64) if slot_of is None else slot_of
        self.split, self.symbols, self.hidden = split, symbols, hidden
        classes = int(self.class_of.max()) + 1
        bias = np.zeros(classes) if bias is None else bias
        inner = np.zeros((split, CELLS)) if inner is None else inner
        self.p = [draw(symbols, 3 * hidden), draw(hidden, 3 * hidden), np.zeros(3 * hidden, np.float32), draw(hidden, classes), bias.astype(np.float32), draw(split, hidden, inner.shape[1]) * 0.3, inner.astype(np.float32)]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p])

    def set_flat(self, v: np.ndarray) -> Gru:
        at = 0
        for k, x in enumerate(self.p):
            self.p[k] = v[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size
        return self

    def step(self, a: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """a: what the symbols before put in."""
        n = self.hidden
        g = h @ self.p[1]
        rz = _sigmoid(a[:, : 2 * n] + g[:, : 2 * n])
        r, z = rz[:, :n], rz[:, n:]
        new = np.tanh(a[:, 2 * n :] + r * g[:, 2 * n :])
        return new + z * (h - new), r, z, new, g[:, 2 * n :]

    def cells(self, h: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the rows whose class has cells: their places, sorted by class; where each class starts; a column of logits of its cells for each."""
        order = np.argsort(cls, kind="stable")
        starts = np.searchsorted(cls[order], np.arange(self.split + 1, dtype=cls.dtype))
        order = order[: starts[-1]]
        x, w, inner = np.ascontiguousarray(h[order].T), self.p[5], self.p[6]
        logits = np.empty((w.shape[2], len(order)), h.dtype)
        for k, (s, e) in enumerate(zip(starts, starts[1:], strict=False)):
            if s < e:
                logits[:, s:e] = w[k].T @ x[:, s:e]
                logits[:, s:e] += inner[k][:, None]
        return order, starts, logits

    def log_probs(self, h: np.ndarray, aim: np.ndarray) -> np.ndarray:
        """Of each row's symbol."""
        cls = self.class_of[aim]
        logits = self.p[3].T @ h.T
        logits += self.p[4][:, None]
        total = _softmax(logits)[1]
        out = logits[cls, np.arange(len(aim))] - np.log(total)
        if self.split:
            order, _, logits = self.cells(h, cls)
            total = _softmax(logits)[1]
            out[order] += logits[self.slot_of[aim[order]], np.arange(len(order))] - np.log(total)
        return out

    def window(self, prev: np.ndarray, target: np.ndarray, h: np.ndarray) -> tuple[float, list[np.ndarray], np.ndarray]:
        """Over (steps, lanes): loss summed in nats, gradients of its mean, and the state to go on with; nothing is propagated beyond the window."""
        steps, lanes = prev.shape
        n, size = self.hidden, prev.size
        made = lambda: np.empty((steps, lanes, n), self.p[0].dtype)
        hs, befores, rs, zs, news, gns = (made() for _ in range(6))
        keep = (prev != self.symbols - 1)[:, :, None].astype(hs.dtype)
        a = self.p[0][prev] + self.p[2]
        for t in range(steps):
            h = h * keep[t]
            befores[t] = h
            h, rs[t], zs[t], news[t], gns[t] = self.step(a[t], h)
            hs[t] = h
        flat, aim = hs.reshape(-1, n), target.ravel()
        cls, at = self.class_of[aim], np.arange(size)
        logits = self.p[3].T @ flat.T + self.p[4][:, None]
        e, total = _softmax(logits)
        own = logits[cls, at]
        loss = float(np.log(total).sum() - own.sum())
        d = e / (total * size)
        d[cls, at] -= 1 / size
        dflat = (self.p[3] @ d).T
        d_v, d_bias = flat.T @ d.T, d.sum(1)
        d_in, d_out = np.zeros_like(self.p[5]), np.zeros_like(self.p[6])
        if self.split:
            order, starts, logits = self.cells(flat, cls)
            slots, at = self.slot_of[aim[order]], np.arange(len(order))
            e, total = _softmax(logits)
            own = logits[slots, at]
            loss += float(np.log(total).sum() - own.sum())
            d = e / (total * size)
            d[slots, at] -= 1 / size
            x, back = flat[order], np.empty((len(order), n), d.dtype)
            for k, (s, t) in enumerate(zip(starts, starts[1:], strict=False)):
                if s < t:
                    d_in[k], d_out[k] = (d[:, s:t] @ x[s:t]).T, d[:, s:t].sum(1)
                    back[s:t] = (self.p[5][k] @ d[:, s:t]).T
            dflat = np.ascontiguousarray(dflat)
            dflat[order] += back
        dhs = dflat.reshape(steps, lanes, n)
        # what a step's error is multiplied by on its way to the candidate, the reset and the update
        by_new, by_reset, by_update = (1 - zs) * (1 - news * news), gns * rs * (1 - rs), (befores - news) * zs * (1 - zs)
        dg, dns = np.empty((steps, lanes, 3 * n), hs.dtype), made()
        dh, ut = np.zeros((lanes, n), hs.dtype), self.p[1].T.copy()
        for t in range(steps - 1, -1, -1):
            dh = dh + dhs[t]
            dn = np.multiply(dh, by_new[t], out=dns[t])
            np.multiply(dn, by_reset[t], out=dg[t, :, :n])
            np.multiply(dh, by_update[t], out=dg[t, :, n : 2 * n])
            np.multiply(dn, rs[t], out=dg[t, :, 2 * n :])
            dh = (dh * zs[t] + dg[t] @ ut) * keep[t]
        da = dg.reshape(-1, 3 * n)
        d_u = befores.reshape(-1, n).T @ da
        da[:, 2 * n :] = dns.reshape(-1, n)
        order = np.argsort(prev.ravel(), kind="stable")
        sorted_ = prev.ravel()[order]
        first = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
        d_wx = np.zeros_like(self.p[0])
        d_wx[sorted_[first]] = np.add.reduceat(da[order], first)
        return loss, [d_wx, d_u, da.sum(0), d_v, d_bias, d_in, d_out], h


class Trainer:
    """Adam over the windows of a stream of symbols, cut into lanes that go on from window to window."""

    def __init__(self, gru: Gru, lanes: int = LANES, steps: int = STEPS, rate: float = RATE, before: int = 0) -> None:
        """before: windows of earlier rounds, for the falling rate."""
        self.gru, self.lanes, self.steps, self.rate, self.before = gru, lanes, steps, rate, before
        self.m, self.v, self.k, self.seen = [np.zeros_like(p) for p in gru.p], [np.zeros_like(p) for p in gru.p], 0, 0

    def feed(self, stream: np.ndarray) -> float:
        """stream: symbols of whole documents, each with its end. Returns nats a token."""
        gru, total, stream = self.gru, 0.0, stream.astype(np.int16)  # of at most CLASSES * CELLS cells and a few more
        lanes = max(1, min(self.lanes, len(stream) // (WINDOWS * self.steps)))
        width = -(-len(stream) // lanes)
        # the last lane is filled up from the front, so that every token is learned from
        aim = np.resize(stream, lanes * width).reshape(lanes, width).T
        before = np.concatenate((np.array([gru.symbols - 1], np.int16), np.resize(stream, lanes * width)[:-1])).reshape(lanes, width).T
        h = np.zeros((lanes, gru.hidden), np.float32)
        for t in range(0, width, self.steps):
            loss, grads, h = gru.window(before[t : t + self.steps], aim[t : t + self.steps], h)
            total += loss
            self.k += 1
            rate = self.rate / (1 + (self.before + self.k) / 500)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            for p, g, m, v in zip(gru.p, grads, self.m, self.v, strict=True):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**self.k)) / (np.sqrt(v / (1 - 0.99**self.k)) + 1e-8)
        self.seen += len(stream)
        return total / max(1, lanes * width)


class Exact:
    """A trained model for scoring, whose states depend on a text alone and not on the texts beside it.

    Weights and states are multiples of 1 / GRID, so that products and their sums are exact in 64 bits in any order; the curves are
    read from tables. Only the last logarithms round, in their last digits.
    """

    def __init__(self, gru: Gru) -> None:
        self.gru = Gru(gru.symbols, gru.hidden, gru.class_of, gru.slot_of, gru.split, inner=np.zeros(gru.p[6].shape))
        self.gru.p = [self.grid(p.astype(np.float64)) for p in gru.p]
        at = np.arange(-REACH * FINE, REACH * FINE + 1) / FINE
        self.sigmoid, self.tanh = self.grid(_sigmoid(at)), self.grid(np.tanh(at))
        self.wx, self.u = self.gru.p[0] + self.gru.p[2], self.gru.p[1]

    @staticmethod
    def grid(x: np.ndarray) -> np.ndarray:
        return np.rint(x * GRID) / GRID

    @staticmethod
    def _curve(values: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The curve at x, which is overwritten; beyond the table its ends."""
        x *= FINE
        np.rint(x, out=x)
        x += REACH * FINE
        return values.take(x.astype(np.int32), mode="clip")

    def step(self, a: np.ndarray, h: np.ndarray) -> np.ndarray:
        n = self.gru.hidden
        g = h @ self.u
        rz = self._curve(self.sigmoid, a[:, : 2 * n] + g[:, : 2 * n])
        new = rz[:, :n] * g[:, 2 * n :]
        new += a[:, 2 * n :]
        new = self._curve(self.tanh, new)
        h = h - new
        h *= rz[:, n:]
        h += new
        h *= GRID
        np.rint(h, out=h)
        h *= 1 / GRID
        return h


def score_sequences(gru: Gru | Exact, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural log probability of each symbol of each document (symbols one after another, each document with its end).

    Documents are dealt to lanes, the longest first; a lane's state is carried from window to window through a whole document.
    """
    out = np.empty(len(flat))
    if not len(sizes):
        return out
    exact = gru if isinstance(gru, Exact) else Exact(gru)
    starts = np.cumsum(sizes) - sizes
    lanes = int(max(1, min(512, len(flat) // max(int(sizes.max()), 1), len(sizes))))
    heap, rows = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
    for i in np.argsort(-sizes, kind="stable"):
        load, k = heapq.heappop(heap)
        rows[k].append(i)
        heapq.heappush(heap, (load + int(sizes[i]), k))
    rows = sorted(rows, key=lambda r: -int(sizes[r].sum()))
    loads = np.array([int(sizes[r].sum()) for r in rows])
    at = np.full((loads[0], lanes), -1, np.int32)  # where a lane's token stands in flat
    for k, r in enumerate(rows):
        at[: loads[k], k] = np.concatenate([np.arange(starts[i], starts[i] + sizes[i]) for i in r])
    end = exact.gru.symbols - 1
    h, last, window = np.zeros((lanes, exact.gru.hidden)), np.full(lanes, end), 64
    for t0 in range(0, len(at), window):
        part = at[t0 : t0 + window]
        n = int((part[0] >= 0).sum())  # lanes that go on are the first
        h, part = h[:n], part[:, :n]
        hs = np.empty((len(part), n, exact.gru.hidden))
        aim = flat[np.maximum(part, 0)]
        before = np.concatenate((last[None, :n], aim[:-1]))
        a, keep, last = exact.wx[before], (before != end)[:, :, None], aim[-1]
        for t in range(len(part)):
            h = exact.step(a[t], h * keep[t])
            hs[t] = h
        ok = part >= 0
        out[part[ok]] = exact.gru.log_probs(hs[ok], aim[ok])
    return out


# --- words, classes and cells ------------------------------------------------------


def _parts(count: np.ndarray, k: int) -> np.ndarray:
    """Numbers 0, 1, ... of at most k parts of about the same sum, of counts in falling order."""
    upto = (np.cumsum(count) - count / 2) / count.sum()
    return np.unique(np.minimum((upto * k).astype(int), k - 1), return_inverse=True)[1]


class Vocabulary:
    """Frequent words with their classes and cells; spelled words by group; the end of a document. Probabilities sum to one over all texts at most."""

    def __init__(self, head: list[tuple[bytes, int, str]], groups: list[str], n_tokens: int, n_distinct: int, n_docs: int, tail_tokens: int, spelling: np.ndarray, classes: int = CLASSES) -> None:
        """head: (word, count, group) in order of falling counts; groups: the largest, the rest count as one; spelling: what count_letters() counts."""
        self.words = pa.array([w for w, _, _ in head], pa.binary()).cast(pa.string())
        self.n_tokens, self.n_distinct, self.groups = n_tokens, n_distinct, {g: k for k, g in enumerate(groups)}
        count = np.array([c for _, c, _ in head], float)
        group = np.array([self.groups.get(g, len(groups)) for _, _, g in head], int)
        n_groups, cell, class_of, slot_of, totals = len(groups) + 1, np.zeros(len(head), np.int32), [], [], []
        for g in range(n_groups):
            if len(own := np.flatnonzero(group == g)):
                for part in _members(_parts(count[own], max(1, round(classes * count[own].sum() / count.sum()))), own):
                    slots = _members(_parts(count[part], CELLS), part)
                    for s, words in enumerate(slots):
                        cell[words] = len(class_of)
                        class_of.append(len(totals))
                        slot_of.append(s)
                    totals.append(count[part].sum())
        self.cell, self.split, self.tail = cell, len(totals), len(class_of)
        held = np.bincount(cell, count, minlength=self.tail)
        self.in_cell = np.log(count / held[cell]) if len(head) else np.zeros(0)
        self.end = self.tail + n_groups
        self.class_of = np.array([*class_of, *range(self.split, self.split + n_groups + 1)])
        self.slot_of = np.array(slot_of + [0] * (n_groups + 1))
        self.inner = np.full((self.split, CELLS), -1e4)
        self.inner[self.class_of[: self.tail], self.slot_of[: self.tail]] = np.log(held / np.array(totals)[self.class_of[: self.tail]]) if self.split else 0
        grams, letters, types = spelling[: n_groups * GRAMS].reshape(n_groups, GRAMS), spelling[n_groups * GRAMS : -n_groups], spelling[-n_groups:]
        share = (types + 0.5) / (types + 0.5).sum()
        total = np.array([*totals, *share * tail_tokens, n_docs])
        self.bias = np.log((total + 0.5) / (total + 0.5).sum())
        self.spelling = np.stack([_floored(_smoothed(g)) for g in grams])
        symbol = np.frombuffer(SYMBOL, np.uint8)
        self.letter = _floored((letters + 0.5) / np.bincount(symbol, letters + 0.5, minlength=SYMBOLS)[symbol])
        self.prior = (1000 * np.log(share)).astype(np.int32)
        self.base = np.log10(count + 0.5)
        self.base_end, self.base_all = float(np.log10(n_docs + 0.5)), float(np.log10(n_tokens + 0.5 * (n_distinct + 1)))
        self.new, self.tail_tokens = [1.0] * n_groups, [1.0] * n_groups  # of each group's spelled words, set once these are known

    def gru(self) -> Gru:
        return Gru(self.end + 1, class_of=self.class_of, slot_of=self.slot_of, split=self.split, bias=self.bias, inner=self.inner)

    def ids(self, words: pa.Array) -> np.ndarray:
        """Place in the head, or -1."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False)

    def symbols(self, ids: np.ndarray, rare: np.ndarray) -> np.ndarray:
        """rare: groups of the spelled words among ids, in their order."""
        out = np.empty(len(ids), np.int32)
        out[ids >= 0] = self.cell[ids[ids >= 0]]
        out[ids < 0] = self.tail + rare
        return out

    def spelled(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The group whose letter model likes each word best, and the natural log probability of the word's letters and end in it, in thousandths."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        at, flat, sizes = _letters(words)
        starts = np.cumsum(sizes) - sizes
        own = np.add.reduceat(self.letter[flat].astype(np.int32), starts)
        sums = np.stack([np.add.reduceat(table_[at].astype(np.int32), starts) for table_ in self.spelling])
        group = (sums + self.prior[:, None]).argmax(0)
        return group.astype(np.int32), sums[group, np.arange(len(words))] + own


def _members(part: np.ndarray, of: np.ndarray) -> list[np.ndarray]:
    return [of[part == k] for k in range(int(part.max()) + 1)]


def _smoothed(grams: np.ndarray) -> np.ndarray:
    """P(symbol | three before), each order backed off to the one below."""
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(4):
        n = grams.reshape(-1, *[SYMBOLS] * (order + 1)).sum(0)
        p = (n + 4 * p) / (n.sum(-1, keepdims=True) + 4)
    return p.ravel()


def _floored(p: np.ndarray) -> np.ndarray:
    """Natural logarithms in thousandths, rounded down, so that sums of probabilities don't grow."""
    return np.maximum(np.floor(1000 * np.log(p)), -32000).astype(np.int16)


def _letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each letter of each word and the 0 after it: where the four symbols up to it are counted, and the letter; letters of each word."""
    flat = np.frombuffer(b"\0\0\0" + b"\0\0\0".join(words) + b"\0", np.uint8)
    sizes = np.array([len(w) + 1 for w in words])
    ends = np.cumsum(sizes + 2)
    at = np.arange(sizes.sum()) + np.repeat(ends - (np.cumsum(sizes)) - 2 + 3, sizes)
    s = np.frombuffer(SYMBOL, np.uint8)[flat].astype(np.int32)
    return ((s[at - 3] * SYMBOLS + s[at - 2]) * SYMBOLS + s[at - 1]) * SYMBOLS + s[at], flat[at], sizes


def _pieces(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """From and to: rows with so many bytes together, or one row with more."""
    upto = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + limit, side="right")))
        yield at, to
        at = to


def _chunks(texts: pa.Array, v: Vocabulary) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[bytes]]]:
    """Of some texts at a time: from, to, ids, how many each has, and the words that are spelled; no other words are held."""
    for at, to in _pieces(texts, CHUNK):
        words, sizes = words_of(texts.slice(at, to - at))
        ids = v.ids(words)
        yield at, to, ids, sizes, words.filter(pa.array(ids < 0)).cast(pa.binary()).to_pylist()


def _stream(v: Vocabulary, ids: np.ndarray, sizes: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """Symbols of some texts one after another, each with its end; rare: groups of the spelled words."""
    out = np.full(len(ids) + len(sizes), v.end, np.int32)
    word = np.ones(len(out), bool)
    word[np.cumsum(sizes) + np.arange(len(sizes))] = False
    out[word] = v.symbols(ids, rare)
    return out


def count_words(docs: DataFrame, group: str) -> DataFrame:
    """(word, n, top): counts over all rows of (_text, _group), and the group in which a word is most frequent."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(it, 0, CHUNK):
            for g in pc.unique(b.column(1)).to_pylist():
                texts = b.column(0).filter(pc.equal(b.column(1), g))
                for at, to in _pieces(texts, CHUNK):
                    found = pc.value_counts(words_of(texts.slice(at, to - at))[0])
                    n = found.field("counts")
                    yield pa.RecordBatch.from_arrays([found.field("values"), pa.array([g], pa.string()).take(pa.array(np.zeros(len(n), np.int32))), n], names=["word", "g", "n"])

    parts = map_batches(docs.select("_text", group), batches, "word string, g string, n long").groupBy("word", "g").agg(F.sum("n").alias("n"))
    return parts.groupBy("word").agg(F.sum("n").alias("n"), F.max_by("g", F.struct("n", "g")).alias("top"))


def count_letters(tail: DataFrame, groups: list[str]) -> DataFrame:
    """(at, n) over (word, top), each word once: four symbols that follow each other by group, then bytes, then words by group."""
    place, n_groups = {g: k for k, g in enumerate(groups)}, len(groups) + 1

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_groups * GRAMS + 256 + n_groups, np.int32)
        for b in it:
            words = [w.encode() for w in b.column(0).to_pylist()]
            if not words:
                continue
            at, flat, sizes = _letters(words)
            group = np.array([place.get(g, n_groups - 1) for g in b.column(1).to_pylist()])
            seen, n = np.unique(at + np.repeat(group, sizes).astype(np.int64) * GRAMS, return_counts=True)
            total[seen] += n.astype(np.int32)
            total[n_groups * GRAMS : -n_groups] += np.bincount(flat, minlength=256).astype(np.int32)
            total[-n_groups:] += np.bincount(group, minlength=n_groups).astype(np.int32)
        seen = np.flatnonzero(total)
        for k in range(0, len(seen), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(seen[k : k + (1 << 18)]), pa.array(total[seen[k : k + (1 << 18)]].astype(np.int64))], names=["at", "n"])

    return map_batches(tail.select("word", "top"), batches, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))


def spelled_shares(tail: DataFrame, v: Vocabulary) -> list[tuple[int, int, int]]:
    """(group, tokens, words seen once) of the words that are spelled, by the group of their spelling; at most GROUPS rows."""
    sent = tail.sparkSession.sparkContext.broadcast(v)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            group, _ = sent.value.spelled([w.encode() for w in b.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(group), b.column(1)], names=["g", "n"])

    found = map_batches(tail.select("word", "n"), batches, "g int, n long").groupBy("g").agg(F.sum("n"), F.count_if(F.col("n") == 1))
    return [tuple(r) for r in found.collect()]


def train(docs: DataFrame, head: int = HEAD, least: int = LEAST) -> tuple[Vocabulary, Gru, DataFrame]:
    """From all rows of (_text binary, _group): vocabulary, model, and the durable table of counts (word, n).

    An empty table gives a model that spells every word with even letters.
    """
    spark = docs.sparkSession
    counts = durable(count_words(docs, "_group"))
    n_docs = docs.count()
    n_words, n_distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    groups = [r[0] for r in counts.groupBy("top").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "top").limit(GROUPS - 1).select("top").collect()]
    found = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(head).select("word", "n", "top").toArrow()
    best = [(w.encode(), n, g) for w, n, g in zip(*(c.to_pylist() for c in found.columns), strict=True)]
    tail = counts
    if best:
        low = (best[-1][1], best[-1][0].decode())
        tail = counts.filter((F.col("n") < low[0]) | ((F.col("n") == low[0]) & (F.col("word") > low[1])))
    spelling = np.zeros((len(groups) + 1) * GRAMS + 256 + len(groups) + 1)
    letters = count_letters(tail, groups).toArrow()
    spelling[letters.column("at").to_numpy()] = letters.column("n").to_numpy()
    v = Vocabulary(best, groups, n_words + n_docs, n_distinct + (n_docs > 0), n_docs, n_words - sum(n for _, n, _ in best), spelling)
    del best, found, letters, spelling
    for g, n, once in spelled_shares(tail, v):
        v.new[g], v.tail_tokens[g] = max(0.02, min(0.98, once / n)), float(n)
    sent, gru, windows = spark.sparkContext.broadcast(v), v.gru(), 0
    for k in range(ROUNDS):
        part = docs.filter(F.pmod(F.xxhash64("_text", F.lit(5)), F.lit(ROUNDS)) == k)
        flat, most = train_round(part, sent, gru.flat(), windows)
        gru, windows = gru.set_flat(flat), windows + most
    return v, gru, counts.select("word", "n")


def train_round(docs: DataFrame, sent, start: np.ndarray, before: int) -> tuple[np.ndarray, int]:
    """The average, by tokens, of the parameters that each partition reaches from `start`, and the most windows that one had.

    Parameters are summed as whole numbers, so that the order of the sums doesn't matter.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        trainer = Trainer(v.gru().set_flat(start), before=before)
        held: list[np.ndarray] = []
        for b in gathered(it, 0, CHUNK):
            for _, _, ids, sizes, rare in _chunks(b.column(0), v):
                held.append(_stream(v, ids, sizes, v.spelled(rare)[0]))
                if sum(map(len, held)) >= CHUNK_SYMBOLS:
                    trainer.feed(np.concatenate(held))
                    held = []
        if held:
            trainer.feed(np.concatenate(held))
        if trainer.seen:
            weight = -(-trainer.seen // 1024)
            sums = np.append(np.rint(np.clip(trainer.gru.flat().astype(float), -64, 64) * (1 << 20)) * weight, [weight]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums), pa.array(np.full(len(sums), trainer.k))], names=["i", "v", "k"])

    found = map_batches(docs.select("_text"), batches, "i long, v long, k long").groupBy("i").agg(F.sum("v").alias("v"), F.max("k").alias("k")).toArrow()
    if not found.num_rows:
        return start, 0
    sums = np.zeros(len(start) + 1)
    sums[found.column("i").to_numpy()] = found.column("v").to_numpy()
    flat = sums[:-1] / sums[-1] / (1 << 20)
    return np.where(start < -64, start, flat), int(found.column("k").to_numpy().max())


def _distinct(words: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words of texts one after another: a place of each different word of each text, how often the text has it, and where texts start among these."""
    first, times, cuts, at = [], [], [0], 0
    for n in sizes.tolist():
        seen: dict[bytes, int] = {}
        for k in range(at, at + n):
            if (j := seen.setdefault(words[k], len(first))) == len(first):
                first.append(k)
                times.append(1)
            else:
                times[j] += 1
        cuts.append(len(first))
        at += n
    return np.array(first, np.int64), np.array(times, np.int64), np.array(cuts)


def score(docs: DataFrame, model: tuple[Vocabulary, Gru, DataFrame], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_tokens, n_known, train_tokens, base_score, score (log10).

    Null texts are empty; an empty text has its end only. Counts of words beyond the head come by a join on the word, of the words of
    each text counted first. Repeated rows each get a row; equal texts have equal scores, which are rounded to six places.
    """
    vocabulary, gru, counts = model
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, gru))
    source = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    schema = T.StructType(
        [
            T.StructField("_row", T.LongType()),
            T.StructField("_id", docs.schema[id_col].dataType),
            *(T.StructField(c, t) for c, t in (("n_tokens", T.LongType()), ("known", T.LongType()), ("base", T.DoubleType()), ("score", T.DoubleType()), ("tail", T.ArrayType(T.StringType())), ("times", T.ArrayType(T.IntegerType())), ("group", T.ArrayType(T.IntegerType())), ("spelled", T.ArrayType(T.IntegerType())))),
        ]
    )

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, g = sent.value
        g = Exact(g)
        for b in gathered(it, 2, CHUNK):
            for at, to, flat, sizes, words in _chunks(b.column(2), v):
                known, of = flat >= 0, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
                group, letters = v.spelled(words)
                lp = score_sequences(g, _stream(v, flat, sizes, group), sizes + 1)
                total = np.add.reduceat(lp, np.cumsum(sizes + 1) - sizes - 1) + np.bincount(of[known], v.in_cell[flat[known]], minlength=len(sizes))
                base = np.bincount(of[known], v.base[flat[known]], minlength=len(sizes))
                n_known = np.bincount(of[known], minlength=len(sizes))
                first, times, cuts = _distinct(words, np.bincount(of[~known], minlength=len(sizes)))
                spelled = pa.array([words[k] for k in first.tolist()], pa.binary()).cast(pa.string())
                cuts = pa.array(cuts.astype(np.int32))
                columns = [
                    pa.array(sizes + 1),
                    pa.array(n_known + (v.n_tokens > 0)),
                    pa.array(base + v.base_end),
                    pa.array(total / np.log(10)),
                    pa.ListArray.from_arrays(cuts, spelled),
                    pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int32))),
                    pa.ListArray.from_arrays(cuts, pa.array(group[first])),
                    pa.ListArray.from_arrays(cuts, pa.array(letters[first].astype(np.int32))),
                ]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), b.column(1).slice(at, to - at), *columns], names=schema.names)

    rows = durable(map_batches(source, batches, schema))
    names = ["tail", "times", "group", "spelled"]
    tail = rows.select("_row", F.inline(F.arrays_zip(*(F.col(c).alias(c) for c in names)))).withColumnRenamed("tail", "word")
    found = tail.join(counts, "word", "left").select("_row", "times", "group", "spelled", F.coalesce("n", F.lit(0)).alias("n"))
    of = lambda values: F.element_at(F.lit([float(x) for x in values]), F.col("group") + 1)
    chance = of([(1 - a) / b for a, b in zip(vocabulary.new, vocabulary.tail_tokens, strict=True)]) * F.col("n") + of(vocabulary.new) * F.exp(F.col("spelled") / 1000.0)
    found = found.groupBy("_row").agg(
        F.sum(F.col("times") * F.log10(F.greatest(chance, F.lit(1e-300)))).alias("rare"),
        F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("also"),
    )
    out = rows.select("_row", "_id", "n_tokens", "known", "base", "score").join(found, "_row", "left")
    return out.select(
        F.col("_id").alias(id_col),
        "n_tokens",
        (F.col("known") + F.coalesce("also", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocabulary.n_tokens).cast("long").alias("train_tokens"),
        F.round(F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(vocabulary.base_all), 9).alias("base_score"),
        F.round(F.col("score") + F.coalesce("rare", F.lit(0.0)), 6).alias("score"),
    )


def held_out(id_: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(id_).cast("string"), F.lit(""))), F.lit(5)) == 1


def op8_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = docs.filter(~held_out()).select(F.col("text").cast("binary").alias("_text"), F.coalesce("lang", F.lit("")).alias("_group"))
    found = score(docs, train(learned))
    return found.select("doc_id", held_out().alias("held_out"), *found.columns[1:])


QUERIES = {"op8_gru_scores": op8_gru_scores}
ORACLE_SQL: dict[str, str] = {}
