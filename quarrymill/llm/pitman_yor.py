"""Language-model scoring with a hierarchical Pitman-Yor model.

A token is drawn in the restaurant of the word before it (of the text's end, for a text's first token). All these
restaurants share one parent, the restaurant of words without context, and that falls back on the uniform distribution
over the training words and one unknown word. Customers are tokens; each table of a context's restaurant is a customer
of the parent.

1. Documents are read in blocks of BLOCK_TOKENS. A block sends its distinct (word, context) pairs with their training
   counts to cells: a cell holds the pairs whose word's hash falls in one range and whose context's in another. So the
   pairs of a frequent word, or context, are dealt over a whole row, or column, of cells, whose number grows with the
   input.
2. A cell adds the counts up. For each of its words it tells the word's shard how many customers and tables it has, as a
   dish and as a context; the shard adds up what all cells told, seats the parent's customers, and replies with
   what the cells need: a context's customers and tables, a dish's part in the parent. What passes is one entry for each
   word of a cell, whatever the word's number of tokens.
3. Gibbs sampling: with that reply a cell draws the number of tables of each of its dishes from the conditional
   distribution given all others: t tables of n customers have a weight of S(n, t) a1 ... at, where S counts the seatings
   of all n customers (generalized Stirling numbers) and ai is the weight of an i-th new table, in its own restaurant, where all tables before
   it make a new one likelier, and in the parent's, where it is one more customer of the dish. That seats every customer anew
   once a sweep, however many a dish has: exactly up to SMALL customers, and by the saddle point of the same weights
   above, with the ai of the middle table of the last sweep. All cells sweep at a time, between exchanges with the shards.
   Discount and strength of the contexts, and of the parent, are drawn after every sweep, given all seats: cells and shards tell the logarithm of
   their likelihood at the NODES of a window that is laid at random around the present values, and the driver draws by slices
   from the polynomial through them and the prior (a flat one for discounts, exp(-x) for strengths). After BURN sweeps, the
   predictive probabilities of SAMPLES sweeps, each with its own seats, discounts and strengths, are averaged; they sum to one over the words.
4. Documents are read again, and their tokens' pairs meet the cells, which send back sums for each document.

Before the first sweep strengths are STRENGTH, and discounts come from the counts of counts, n1 / (n1 + 2 n2), of pairs and of the words' contexts.

Cases: null and empty texts are the end token alone; a null doc_id stays null; A-Z count as a-z; texts are scored whole, each in one
block; repeated rows are trained on and scored one by one; with no training token every token has the uniform probability; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from numpy.polynomial import chebyshev
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import Scratch, WordHash, chunks, kept, texts, trim, trimmed

BLOCK_TOKENS = 1_000_000
#: Bytes of text for each cell; small inputs have FEW_CELLS of FEWER_BYTES, so that more tasks share the work.
CELL_BYTES, FEW_CELLS, FEWER_BYTES = 32 << 20, 16, 1 << 20
STRENGTH, BURN, SAMPLES, SMALL = 0.5, 1, 4, 64
#: A window of the logit of a discount and the logarithm of a strength: points on each side, and how wide.
NODES, WINDOW, FARTHEST = 12, (1.0, 2.0), (6.0, 12.0)
_EXACT = 2.0**12  # logarithms of likelihoods are whole numbers of this part, so that sums don't depend on their order
END = b"\n"  # no word holds white space
_NO_ID = -(1 << 63)
_FINE = 2.0**32  # sums of logarithms of counts travel as whole numbers of this part
ROW = "key long, kind int, ref long, a binary, b binary, s array<double>"
_SCHEMA = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("ref", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("s", pa.list_(pa.float64()))])
#: Kinds of rows, in the order in which a cell needs them.
CELL, TOLD_DISHES, TOLD_CONTEXTS, DISHES, CONTEXTS, ASKED, HEAD, TOTALS, LIKELY = range(9)


# --- arrays as bytes ------------------------------------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """The arrays in one frame; of each, first all first bytes, then all second ones: small where high bytes are alike."""
    parts = [np.array([len(x) for x in arrays], np.int64).tobytes()]
    parts += [np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes() for x in arrays if len(x)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(b: bytes, *kinds: type) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    sizes, at, out = raw[: 8 * len(kinds)].view(np.int64), 8 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        wide = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * wide].reshape(wide, n).T).view(kind).ravel() if n else np.zeros(0, kind))
        at += n * wide
    return out


def steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def sums(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=x.dtype)


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))] if len(x) else x


def _top(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The range that a hash falls in, of 2 ** bits."""
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _rows(found: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(found), 64):
        some = zip(*found[i : i + 64], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(some, _SCHEMA, strict=True)], schema=_SCHEMA)


# --- documents ------------------------------------------------------------------------------------------------------


def block_rows(block: int, own: np.ndarray, sizes: np.ndarray, ids: np.ndarray, train: np.ndarray, bits: tuple[int, int], asks: bool) -> Iterator[pa.RecordBatch]:
    """own: the tokens' hashes, text after text, each with its end. A row for each cell: the pairs' words, how many
    pairs each has, the contexts, which one each pair has, training counts; if it asks, also the documents of each pair's tokens."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    words, place = np.unique(own, return_inverse=True)
    before = np.empty_like(place)
    before[1:] = place[:-1]
    before[np.cumsum(sizes) - sizes] = place[-1]  # the last token is an end
    code = place * len(words) + before
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    word, context = np.divmod(code[first], len(words))
    many = np.diff(first, append=len(code))
    trained = np.add.reduceat(train[of][order].astype(np.int64), first)
    cell = _top(words[word], bits[0]) << bits[1] | _top(words[context], bits[1])
    by_cell = np.argsort(cell, kind="stable")
    word, context, many, trained, cell, first = (x[by_cell] for x in (word, context, many, trained, cell, first))
    starts = np.flatnonzero(np.diff(cell, prepend=-1)).tolist()
    tokens = np.concatenate([[0], np.cumsum(many)])
    found = []
    if asks:
        found.append((-1 - block, HEAD, block, pack(ids, train.astype(np.uint8), sizes.astype(np.int64)), b"", None))
        at = np.repeat(first - tokens[:-1], many) + np.arange(tokens[-1])
        of = of[order[at]].astype(np.uint32)
    for i, j in zip(starts, [*starts[1:], len(cell)], strict=True):
        begins = np.flatnonzero(np.diff(word[i:j], prepend=-1))
        contexts, which = np.unique(context[i:j], return_inverse=True)
        pairs = pack(steps(words[word[i:j][begins]]), np.diff(begins, append=j - i).astype(np.uint32), steps(words[contexts]), which.astype(np.uint32), trained[i:j].astype(np.uint32))
        docs = pack(many[i:j].astype(np.uint32), of[tokens[i] : tokens[j]]) if asks else b""
        found.append((int(cell[i]), ASKED, block, pairs, docs, None))
    yield from _rows(found)


def blocks(docs: DataFrame, bits: tuple[int, int], asks: bool) -> DataFrame:
    """(doc_id, text, train) -> rows for the cells; if they ask, also a row for each block itself, with a key of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, block = kept("tokens", lambda: WordHash(limit=300_000)), TaskContext.get().partitionId() << 24
        held: list[tuple] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block, total
            own, sizes, ids, train = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            yield from block_rows(block, own, sizes, ids, train, bits, asks)
            block, total = block + 1, 0
            trim()

        for batch in batches:
            for part in chunks(batch):
                split = [known.of([*x.lower().split(), END]) for x in texts(part)]
                sizes = np.array([len(x) for x in split], np.int64)
                ids, train = np.asarray(part.column("doc_id").fill_null(_NO_ID), np.int64), np.asarray(part.column("train")).astype(bool)
                held.append((np.concatenate(split), sizes, ids, train))
                total += int(sizes.sum())
                if total >= BLOCK_TOKENS:
                    yield from flush()
        if held:
            yield from flush()

    return docs.mapInArrow(trimmed(run), ROW)


# --- seats ----------------------------------------------------------------------------------------------------------


def log_stirling(n: int, discount: float) -> np.ndarray:
    """log S(i, t) for i and t up to n: S(i + 1, t) = S(i, t - 1) + (i - t discount) S(i, t)."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[0, 0] = 0.0
    for i in range(n):
        t = np.arange(1, i + 2)
        with np.errstate(divide="ignore"):
            stay = np.log(np.maximum(i - t * discount, 0.0)) + out[i, 1 : i + 2]
        out[i + 1, 1 : i + 2] = np.logaddexp(out[i, : i + 1], stay)
    return out


def draw_tables(n: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator, small: int = SMALL, grows: tuple[np.ndarray, ...] = (), before: np.ndarray | None = None) -> np.ndarray:
    """The number of tables of n customers of a dish, t, with probability in proportion to S(n, t) times the weights of
    tables 1 to t. That of table i + 1 is weight times 1 + i g for each g in grows.

    Above small customers: seatings are sets of tables, whose sizes have the generating function weight * phi(x), phi(x) =
    (1 - (1 - x)^discount) / discount; the x at which n customers are expected gives the number of tables' mean and
    variance, a Poisson number where there are few and a normal one where there are many. There all tables have the weight of the middle one
    of the tables before."""
    t = np.minimum(n, 1).astype(np.int64)
    weight = np.maximum(weight, 1e-300)
    logs, low = log_stirling(small, discount), 1
    plain = np.exp(logs[:17, :17])
    for high in (2, 4, 8, 16, 32, small):  # dishes of like sizes together: short rows
        some = np.flatnonzero((n > low) & (n <= high))
        for i in range(0, len(some), 1 << 16):
            part = some[i : i + (1 << 16)]
            w = np.repeat(weight[part][:, None], high, axis=1)
            for g in grows:
                w *= 1 + g[part][:, None] * np.arange(high)
            w[:, 0] = 1  # there is one table at least
            if high <= 16:
                p = plain[n[part], 1 : high + 1] * np.cumprod(w, axis=1)
            else:
                p = logs[n[part], 1 : high + 1] + np.cumsum(np.log(w), axis=1)
                p = np.exp(p - p.max(1, keepdims=True))
            p = np.cumsum(p, axis=1)
            t[part] = 1 + (p < (rng.random(len(part)) * p[:, -1])[:, None]).sum(1)
        low = high
    big = np.flatnonzero(n > small)
    if len(big):
        count, a = n[big].astype(float), weight[big]
        for g in grows:
            a = a * (1 + g[big] * np.maximum(before[big] - 1, 0) / 2)
        lower, upper = np.full(len(big), -700.0), np.zeros(len(big))  # log(1 - x)
        for _ in range(60):
            y = (lower + upper) / 2
            more = np.log(a) + np.log(-np.expm1(y)) + (discount - 1) * y > np.log(count)
            lower, upper = np.where(more, y, lower), np.where(more, upper, y)
        y = np.exp((lower + upper) / 2)
        x, slope = 1 - y, y ** (discount - 1)
        mean = a * -np.expm1(discount * np.log(y)) / discount
        spread = np.maximum(mean - a * (x * slope) ** 2 / (x * slope + x * x * (1 - discount) * slope / y), 0.0)
        few = 1 + rng.poisson(np.minimum(mean, 30.0))
        t[big] = np.clip(np.where(mean < 20, few, np.rint(rng.normal(np.maximum(mean, 1.0), np.sqrt(spread)))), 1, count)
    return t


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers."""
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7))


def log_big_stirling(n: np.ndarray, t: np.ndarray, discount: float, points: int = 32) -> np.ndarray:
    """log S(n, t) of many customers: n! / t! times the coefficient of x^n in phi(x)^t, by Cauchy's integral over a parabola
    around the cut from 1 on, through the saddle point or, where that is nearer to 1, through 1 - 2 / n. Within 0.02
    where nearly all customers have tables of their own, elsewhere far nearer."""
    n, t, d = n.astype(float), t.astype(float), discount
    lower, upper = np.full(len(n), -600.0), np.full(len(n), -1e-12)  # log(1 - x) at the saddle point
    for _ in range(30):
        y = (lower + upper) / 2
        more = d * -np.expm1(y) * np.exp((d - 1) * y) > n / t * -np.expm1(d * y)
        lower, upper = np.where(more, y, lower), np.where(more, upper, y)
    z = np.maximum(np.exp((lower + upper) / 2), 2 / n)
    x, phi = 1 - z, -np.expm1(d * np.log(z)) / d
    mean = x * z ** (d - 1) / phi
    spread = np.maximum(mean + x * x * (1 - d) * z ** (d - 2) / phi - mean * mean, 0.0)
    step = 8 / np.sqrt(np.maximum(4.0, 4 * (z / x) ** 2 * t * spread)) / points
    start, total = t * np.log(phi) - (n + 1) * np.log(x), np.zeros(len(n))
    for i in range(points):
        u = 1 + 1j * i * step
        w = z * u * u
        part = np.exp(t * np.log((1 - w**d) / d) - (n + 1) * np.log(1 - w) - start) * u
        total += part.real * (0.5 if i == 0 else 1.0)
    many = log_gamma(n + 1) - log_gamma(t + 1) + start + np.log(np.maximum(total * step * 2 * z / np.pi, 1e-300))
    return np.where(t >= n, 0.0, many)


def log_dishes(n: np.ndarray, t: np.ndarray, discounts: np.ndarray, small: int = SMALL) -> np.ndarray:
    """The sum of log S(n, t) over dishes, for each discount."""
    little = (n <= small) & (n > 1)
    held = np.bincount(n[little] * (small + 1) + t[little], minlength=(small + 1) ** 2).reshape(small + 1, -1)
    at = np.nonzero(held)
    big = n > small
    pairs, many = np.unique(np.stack([n[big], t[big]]), axis=1, return_counts=True)
    return np.array([(held[at] * log_stirling(small, d)[at]).sum() + (many * log_big_stirling(*pairs, d)).sum() for d in discounts])


def log_restaurants(tables: np.ndarray, customers: np.ndarray, discounts: np.ndarray, strengths: np.ndarray) -> np.ndarray:
    """The sum over restaurants of the logarithm of what opening their tables and seating their customers weighs, for each
    discount and strength: (strength + discount) (strength + 2 discount) ... by (strength + 1) (strength + 2) ..."""
    (t, at), (c, ac) = (np.unique(x[x > 0], return_counts=True) for x in (tables, customers))
    out = np.zeros((len(discounts), len(strengths)))
    for j, s in enumerate(strengths):
        out[:, j] -= (ac * (log_gamma(s + c) - log_gamma(np.array([s + 1])))).sum()
        for i, d in enumerate(discounts):
            out[i, j] += (at * ((t - 1) * np.log(d) + log_gamma(s / d + t) - log_gamma(np.array([s / d + 1])))).sum()
    return out


def _exact(x: np.ndarray) -> list[float]:
    return (np.rint(x.ravel() * _EXACT) / _EXACT).tolist()


class Window:
    """Discounts and strengths at which a level's likelihood is told, around the present ones. It lies at random, so that a draw
    within it leaves the distribution as it is."""

    def __init__(self, discount: float, strength: float, rng: np.random.Generator):
        self.at = np.array([np.log(discount / (1 - discount)), np.log(strength)])
        self.low = self.at - rng.random(2) * WINDOW
        places = [low + width * (1 + self.points()) / 2 for low, width in zip(self.low, WINDOW, strict=True)]
        self.discounts, self.strengths = 1 / (1 + np.exp(-places[0])), np.exp(places[1])

    @staticmethod
    def points() -> np.ndarray:
        return np.cos(np.pi * (np.arange(NODES) + 0.5) / NODES)

    def draw(self, likely: np.ndarray, rng: np.random.Generator, steps: int = 100) -> tuple[float, float]:
        """likely: its logarithm, by discounts and strengths. A discount and a strength given all seats."""
        fit = np.linalg.inv(chebyshev.chebvander(self.points(), NODES - 1))
        terms = fit @ (likely - likely.max()) @ fit.T

        def log(x: np.ndarray) -> float:
            if (np.abs(x) > FARTHEST).any():
                return -np.inf
            u, v = 2 * (x - self.low) / WINDOW - 1
            return float(chebyshev.chebval2d(u, v, terms)) - np.logaddexp(0, x[0]) - np.logaddexp(0, -x[0]) + x[1] - np.exp(x[1])

        x = self.at.copy()
        for _ in range(steps):
            for i in (0, 1):
                level, low, high = log(x) + np.log(1 - rng.random()), self.low[i], self.low[i] + WINDOW[i]
                new = x.copy()
                while True:
                    new[i] = rng.uniform(low, high)
                    if log(new) >= level or high - low < 1e-12:
                        break
                    low, high = (new[i], high) if new[i] < x[i] else (low, new[i])
                x = new
        return float(1 / (1 + np.exp(-x[0]))), float(np.exp(x[1]))


class World:
    """What all cells and shards share."""

    def __init__(self, ones: float, twos: float):
        self.discount, self.parent_discount = self.ratio(ones, twos), 0.5
        self.strength = self.parent_strength = STRENGTH
        self.customers = self.tables = self.words = self.tokens = 0.0
        self.window = self.parent_window = None
        self.past: list[World] = []  # of the sweeps that count so far

    def keep(self) -> None:
        """Lets what holds now count in the predictions."""
        now = copy.copy(self)
        now.past = []
        self.past = [*self.past, now]

    @staticmethod
    def ratio(a: float, b: float) -> float:
        return min(0.95, max(0.05, a / (a + 2 * b))) if a else 0.5

    @property
    def uniform(self) -> float:
        return 1 / (self.words + 1)

    @property
    def rest(self) -> float:
        """What the parent leaves to new tables of a word."""
        return (self.parent_strength + self.parent_discount * self.tables) * self.uniform

    def parent(self, own: np.ndarray) -> np.ndarray:
        """The probability of words without context, from customers less discounts of each."""
        return (own + self.rest) / (self.parent_strength + self.customers)

    def look(self, rng: np.random.Generator) -> None:
        """Lays the windows for the next draw."""
        self.window, self.parent_window = Window(self.discount, self.strength, rng), Window(self.parent_discount, self.parent_strength, rng)

    def draw(self, dishes: np.ndarray, told: np.ndarray, rng: np.random.Generator) -> None:
        """Discounts and strengths, given what cells and shards told of the windows."""
        restaurants, words = told[: NODES * NODES].reshape(NODES, NODES), told[NODES * NODES :]
        self.discount, self.strength = self.window.draw(dishes[:, None] + restaurants, rng)
        w = self.parent_window
        above = log_restaurants(np.array([self.tables]), np.array([self.customers]), w.discounts, w.strengths)
        self.parent_discount, self.parent_strength = w.draw(words[:, None] + above, rng)


class Cell:
    """The pairs of words and contexts that training holds, of one range of each."""

    def __init__(self, words: np.ndarray, contexts: np.ndarray, code: np.ndarray, n: np.ndarray, tables: np.ndarray):
        """code: number of the word times the number of contexts, plus that of the context; ascending."""
        self.words, self.contexts, self.code, self.n, self.tables = words, contexts, code, n, tables
        self.word, self.context = np.divmod(code, max(1, len(contexts)))
        self.busy = np.flatnonzero(n >= 2)  # one customer has one table
        #: Of each sweep that counts so far: tables of the busy pairs, customers and tables of the words in the parent, tables of the contexts.
        self.sheets: list[list[np.ndarray]] = []
        self.raw, self.means = b"", None

    @staticmethod
    def of(messages: list[bytes]) -> Cell:
        read = [unpack(x, np.uint64, np.uint32, np.uint64, np.uint32, np.uint32) for x in messages]
        words, contexts = (distinct(np.concatenate([sums(x[i]) for x in read])) for i in (0, 2))
        codes, counts = [], []
        for w, pairs, c, which, n in read:
            code = np.repeat(np.searchsorted(words, sums(w)), pairs) * len(contexts) + np.searchsorted(contexts, sums(c))[which]
            codes.append(code[n > 0])
            counts.append(n[n > 0])
        code, count = np.concatenate(codes), np.concatenate(counts).astype(np.int64)
        order = np.argsort(code)
        code, count = code[order], count[order]
        first = np.flatnonzero(np.diff(code, prepend=-1))
        n = np.add.reduceat(count, first) if len(first) else count
        return Cell(words, contexts, code[first], n, np.ones(len(first), np.float32))

    @staticmethod
    def load(row: dict) -> Cell:
        words, contexts, pairs, which, n = unpack(row["a"], np.uint64, np.uint64, np.uint32, np.uint32, np.int64)
        code = np.repeat(np.arange(len(words)), pairs) * len(contexts) + which
        cell = Cell(sums(words), sums(contexts), code, n, np.ones(len(code), np.float32))
        sizes = (len(cell.busy), len(words), len(words), len(contexts))
        read = unpack(row["b"], np.float32)[0]
        cell.tables[cell.busy], at = read[: sizes[0]], sizes[0]
        while at < len(read):
            cuts = at + np.cumsum(sizes)
            cell.sheets.append(np.split(read[at : cuts[-1]], cuts[:-1] - at))
            at = cuts[-1]
        cell.raw = row["a"]  # it stays as it is
        return cell

    def rows(self, key: int, bits: tuple[int, int], window: Window | None = None) -> list[tuple]:
        """The cell itself, and what it tells the shards of its words."""
        a = self.raw
        if not a:
            pairs = np.bincount(self.word, minlength=len(self.words)).astype(np.uint32)
            a = pack(steps(self.words), steps(self.contexts), pairs, self.context.astype(np.uint32), self.n)
        b = pack(np.concatenate([self.tables[self.busy], *[x for sheet in self.sheets for x in sheet]]).astype(np.float32))
        likely = _exact(log_dishes(self.n, np.rint(self.tables).astype(np.int64), window.discounts)) if window else []
        out = [(key, CELL, key, a, b, [float((self.n == 1).sum()), float((self.n == 2).sum()), *likely])]
        counts = np.bincount(self.word, self.n, len(self.words)).astype(np.int64)
        for kind, hashes, of, more in ((TOLD_DISHES, self.words, self.word, [counts]), (TOLD_CONTEXTS, self.contexts, self.context, [])):
            tables = np.bincount(of, self.tables, len(hashes)).astype(np.float32)
            shard = _top(hashes, max(bits))
            starts = np.flatnonzero(np.diff(shard, prepend=-1)).tolist()
            for i, j in zip(starts, [*starts[1:], len(shard)], strict=True):
                out.append((int(shard[i]), kind, key, pack(steps(hashes[i:j]), tables[i:j], *[x[i:j] for x in more]), b"", None))
        return out

    def hear(self, replies: list[dict], world: World) -> None:
        """Takes in what the shards say, which come in the order of the hashes."""
        kinds = {DISHES: (np.float32, np.float32, np.int64), CONTEXTS: (np.float32, np.int64)}
        said = {k: [unpack(r["a"], *kinds[k]) for r in replies if r["kind"] == k] for k in kinds}
        join = lambda k, i: np.concatenate([x[i] for x in said[k]]).astype(float) if said[k] else np.zeros(0)
        self.word_customers, self.word_tables, self.word_counts = (join(DISHES, i) for i in range(3))
        self.parent = world.parent(np.maximum(self.word_customers - world.parent_discount * self.word_tables, 0.0))
        self.context_tables, self.customers = join(CONTEXTS, 0), join(CONTEXTS, 1)

    def sweep(self, world: World, draws: int, rng: np.random.Generator) -> None:
        """Seats the customers of every dish anew; the mean of so many draws."""
        busy = self.busy
        before = self.tables[busy].astype(float)
        # without the dish's own tables
        own = world.strength + world.discount * np.maximum(self.context_tables[self.context[busy]] - before, 0)
        word = self.word[busy]
        others = np.maximum(self.word_customers[word] - before, 0)
        above = others - world.parent_discount * np.minimum(self.word_tables[word], others) + world.rest
        weight, grows = own * above / (world.parent_strength + world.customers), (world.discount / own, 1 / above)
        total = np.zeros(len(busy))
        for _ in range(draws):
            total += draw_tables(self.n[busy], weight, world.discount, rng, grows=grows, before=before)
        self.tables[busy] = total / draws

    def keep(self) -> None:
        """Lets the present seats count in the predictions."""
        self.sheets.append([self.tables[self.busy], self.word_customers, self.word_tables, self.context_tables])

    def average(self, word: np.ndarray, context: np.ndarray, world: World) -> np.ndarray:
        """The mean probability by the seats that were kept, under what held then, and the present ones."""
        if self.means is None:
            own, parts = np.zeros(len(self.n)), []
            now = [self.tables[self.busy], self.word_customers, self.word_tables, self.context_tables]
            for then, (tables, customers, seated, of_contexts) in zip([*world.past, world], [*self.sheets, now], strict=True):
                t = np.ones(len(self.n))
                t[self.busy] = tables
                own += (self.n - then.discount * t) / (then.strength + self.customers[self.context])
                back = (then.strength + then.discount * of_contexts) / (then.strength + self.customers)
                parts.append((back, then.parent(np.maximum(customers - then.parent_discount * seated, 0.0))))
            self.means = own, *(np.stack(x, axis=1) for x in zip(*parts, strict=True))
        own, back, parent = self.means
        total = self._of_pairs(own, word, context) + np.einsum("ij,ij->i", back.take(context, axis=0), parent.take(word, axis=0))
        return total / back.shape[1]

    def _of_pairs(self, x: np.ndarray, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        """What x holds for these pairs; 0 for pairs that training doesn't have."""
        code = word * len(self.contexts) + context
        if not len(self.code):
            return np.zeros(len(code))
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[at] == code, x[at], 0.0)

    def probability(self, word: np.ndarray, context: np.ndarray, world: World) -> np.ndarray:
        """Of words in contexts, both by their numbers here, by the present seats."""
        own = self._of_pairs(self.n - world.discount * self.tables, word, context)
        return own / (world.strength + self.customers[context]) + ((world.strength + world.discount * self.context_tables) / (world.strength + self.customers))[context] * self.parent[word]

    def answer(self, ask: dict, world: World) -> bytes:
        """Sums for each document of a block: its number there, logs of probabilities, logs of counts, known tokens."""
        w, pairs, c, which, _ = unpack(ask["a"], np.uint64, np.uint32, np.uint64, np.uint32, np.uint32)
        many, of = unpack(ask["b"], np.uint32, np.uint32)
        word = np.repeat(np.searchsorted(self.words, sums(w)), pairs)
        logs = np.repeat(np.log10(self.average(word, np.searchsorted(self.contexts, sums(c))[which], world)), many)
        counts = np.repeat(self.word_counts[word], many)
        docs, of = np.unique(of, return_inverse=True)
        add = lambda x: np.bincount(of, x, len(docs))
        return pack(steps(docs), add(logs).astype(np.float32), np.rint(add(np.log10(counts + 1)) * _FINE).astype(np.int64), add(counts > 0).astype(np.uint32))


def shard_rows(rows: list[dict], world: World, first: bool, rng: np.random.Generator) -> list[tuple]:
    """Adds up what cells told of a shard's words, seats the parent's customers, and replies to each."""
    told = [(r, unpack(r["a"], np.uint64, np.float32, *[np.int64] * (r["kind"] == TOLD_DISHES))) for r in rows]
    words = distinct(np.concatenate([sums(x[0]) for _, x in told]))
    counts, customers, tables = np.zeros(len(words)), np.zeros(len(words)), np.zeros(len(words))
    places = [np.searchsorted(words, sums(x[0])) for _, x in told]
    for (r, x), at in zip(told, places, strict=True):  # a cell names a word once
        if r["kind"] == TOLD_DISHES:
            customers[at] += x[1]
            counts[at] += x[2]
        else:
            tables[at] += x[1]
    whole = np.rint(customers).astype(np.int64)
    seated = np.minimum(whole, 1)
    if not first:
        left = world.parent_strength + world.parent_discount * max(0.0, world.tables - 1)
        grows = np.full(len(whole), world.parent_discount / left)
        seated = draw_tables(whole, np.full(len(whole), left * world.uniform), world.parent_discount, rng, grows=(grows,), before=np.ones(len(whole)))
    out = [(-1, TOTALS, 0, b"", b"", [float(x) for x in (customers.sum(), seated.sum(), (counts > 0).sum(), counts.sum(), (whole == 1).sum(), (whole == 2).sum())])]
    if world.window:
        contexts = counts > 0
        likely = log_restaurants(np.rint(tables[contexts]), counts[contexts], world.window.discounts, world.window.strengths)
        out.append((-1, LIKELY, 0, b"", b"", [*_exact(likely), *_exact(log_dishes(whole, seated, world.parent_window.discounts))]))
    for (r, _), at in zip(told, places, strict=True):
        kind, said = (DISHES, (customers, seated)) if r["kind"] == TOLD_DISHES else (CONTEXTS, (tables,))
        out.append((r["ref"], kind, r["key"], pack(*[x[at].astype(np.float32) for x in said], counts[at].astype(np.int64)), b"", None))
    return out


# --- the whole ------------------------------------------------------------------------------------------------------


def _dicts(t: pa.Table) -> list[dict]:
    return sorted(t.to_pylist(), key=lambda r: (r["kind"], r["ref"]))


def _table(found: list[tuple]) -> pa.Table:
    return pa.Table.from_batches(_rows(found), _SCHEMA)


def score(docs: DataFrame, train: Column, burn: int = BURN, samples: int = SAMPLES, seed: int = 23) -> DataFrame:
    """(doc_id, text) and which rows are learnt from -> doc_id, train, n_tokens, n_known, train_tokens, base_score,
    score (log10)."""
    scratch = Scratch(docs.sparkSession, "pitman_yor")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    all_bits = int(np.ceil(np.log2(max(1, size / CELL_BYTES, min(FEW_CELLS, size / FEWER_BYTES)))))
    bits = (all_bits - all_bits // 2, all_bits // 2)  # of words, of contexts

    def by_key(df: DataFrame, work, keys: int) -> DataFrame:  # noqa: ANN001
        """Keys over all executors: their rows are few and large, which would come back in few tasks."""

        def trimmed_work(t: pa.Table) -> pa.Table:
            try:
                return work(t)
            finally:
                trim()

        return df.repartition(2 * keys, "key").groupBy("key").applyInArrow(trimmed_work, ROW)

    def gather(t: pa.Table) -> pa.Table:
        return _table(Cell.of(t.column("a").to_pylist()).rows(t.column("key")[0].as_py(), bits))

    def shard(world: World, first: bool, k: int):  # noqa: ANN202
        def work(t: pa.Table) -> pa.Table:
            rows = _dicts(t)
            return _table(shard_rows(rows, world, first, np.random.default_rng([seed, k, 1, rows[0]["key"]])))

        return work

    def sweeper(world: World, counts: bool, k: int):  # noqa: ANN202
        def work(t: pa.Table) -> pa.Table:
            rows = _dicts(t)
            cell = Cell.load(rows[0])
            cell.hear(rows[1:], world)
            if counts:
                cell.keep()
            cell.sweep(world, 1, np.random.default_rng([seed, k, 2, rows[0]["key"]]))
            return _table(cell.rows(rows[0]["key"], bits, world.window))

        return work

    def total(df: DataFrame, kind: int) -> list[float]:
        """A few sums over all cells or shards."""
        rows = df.where(F.col("kind") == kind).select(F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
        return [r["x"] for r in rows]

    def exchange(cells: DataFrame, k: int) -> DataFrame:
        replies = scratch.table(by_key(cells.where(F.col("kind").isin(TOLD_DISHES, TOLD_CONTEXTS)), shard(world, k == 0, k), 1 << max(bits)), "none")
        customers, tables, words, tokens, ones, twos = total(replies, TOTALS) or [0.0] * 6
        world.customers, world.tables, world.words, world.tokens = customers, tables, words, tokens
        if k == 0:
            world.parent_discount = world.ratio(ones, twos)
        elif tokens:
            world.draw(np.array(total(cells, CELL)[2:]), np.array(total(replies, LIKELY)), np.random.default_rng([seed, k, 3]))
        return replies.where(~F.col("kind").isin(TOTALS, LIKELY)), replies

    cells = scratch.table(by_key(blocks(docs, bits, False), gather, 1 << all_bits), "none")
    world = World(*(total(cells, CELL) or [0.0, 0.0]))
    replies, written = exchange(cells, 0)
    for k in range(1, burn + samples + 1):
        # the seats of the sweep before count if burn sweeps went before them
        if k > burn + 1:
            world.keep()
        world.look(np.random.default_rng([seed, k, 4]))
        after = scratch.table(by_key(cells.where(F.col("kind") == CELL).union(replies), sweeper(world, k > burn + 1, k), 1 << all_bits), "none")
        scratch.drop(cells, written)
        cells = after
        replies, written = exchange(cells, k)

    def answer(t: pa.Table) -> pa.Table:
        rows = _dicts(t)
        if rows[0]["kind"] == HEAD:
            return _table([(r["ref"], HEAD, 0, r["a"], b"", None) for r in rows])
        cell = Cell.load(rows[0])
        cell.hear([r for r in rows if r["kind"] in (DISHES, CONTEXTS)], world)
        return _table([(r["ref"], ASKED, r["key"], cell.answer(r, world), b"", None) for r in rows if r["kind"] == ASKED])

    n_tokens, floor = int(world.tokens), np.log10(max(1.0, world.tokens + world.words + 1))

    def add_up(t: pa.Table) -> pa.Table:
        rows = _dicts(t)
        ids, train, sizes = next(unpack(r["a"], np.int64, np.uint8, np.int64) for r in rows if r["kind"] == HEAD)
        logs, base, known = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        for r in rows:
            if r["kind"] == ASKED:
                docs, some, fine, n = unpack(r["a"], np.uint32, np.float32, np.int64, np.uint32)
                docs = sums(docs)
                logs[docs] += some
                base[docs] += fine / _FINE
                known[docs] += n
        return pa.table({"doc_id": pa.array(ids, mask=ids == _NO_ID), "train": train.astype(bool), "n_tokens": sizes, "n_known": known, "train_tokens": np.full(len(ids), n_tokens), "base_score": base - sizes * floor, "score": logs})

    asked = cells.where(F.col("kind") == CELL).union(replies).union(blocks(docs, bits, True))
    answered = by_key(asked, answer, 1 << all_bits)
    return answered.groupBy("key").applyInArrow(add_up, "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
