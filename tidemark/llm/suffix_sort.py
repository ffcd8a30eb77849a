"""External induced sorting of suffixes, with common prefixes carried along.

Suffix tuples (position, common prefix with the tuple before it) wait in a priority queue: a first-in first-out region
per first symbol, laid out in one store that goes to disk beyond a bound of memory. Scanning the queue in order of
symbols induces the tuple of each predecessor, and its common prefix is one more than the least that was met since the
last tuple that went to the same symbol. Sorted substrings between local minima (LMS) get names; the text of names is
sorted by the same induction, recursively, and common prefixes of names are turned into common prefixes of symbols on
the way back. Regions that are complete are scanned many at a time, however many symbols there are.

Whatever grows with the text lives in the store and is worked on block by block.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np

from .kernels import keep_freed_memory

keep_freed_memory()
#: Bytes of tuples, text and tables of one sort that stay in memory; what is beyond goes to unlinked files, which end with
#: the task.
STORE_BYTES = 32 << 20
#: Tuples scanned at once, and entries of other passes.
SCAN, STRETCH = 1 << 15, 1 << 17
#: Common prefix of substrings that are equal as a whole.
EQUAL = np.uint16(65535)

Emit = Callable[[np.ndarray, np.ndarray], None]


class Store:
    """Arrays in memory up to a bound, then in unlinked temporary files."""

    def __init__(self, limit: int = STORE_BYTES) -> None:
        self.limit, self.held, self.spilled = limit, 0, 0

    def array(self, size: int, kind) -> np.ndarray:
        wanted = size * np.dtype(kind).itemsize
        if self.held + wanted <= self.limit or not size:
            self.held += wanted
            return np.zeros(size, kind)
        self.spilled += wanted
        with tempfile.TemporaryFile() as file:
            return np.asarray(np.memmap(file, kind, "w+", shape=(size,)))  # as a plain array, of which slices cost less

    def free(self, *arrays: np.ndarray) -> None:
        self.held -= sum(a.nbytes for a in arrays if not in_file(a))


def in_file(array: np.ndarray | None) -> bool:
    while isinstance(array, np.ndarray) and not isinstance(array, np.memmap):
        array = array.base
    return isinstance(array, np.memmap)


def stretches(size: int, step: int = STRETCH) -> Iterator[tuple[int, int]]:
    return ((a, min(size, a + step)) for a in range(0, size, step))


class BucketQueue:
    """A first-in first-out region per symbol for as many tuples as counts says."""

    def __init__(self, store: Store, counts: np.ndarray) -> None:
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        self.tail = self.starts.copy()
        self.tuples = store.array(int(self.ends[-1]) if len(counts) else 0, np.int64)

    def push(self, symbols: np.ndarray, positions: np.ndarray, prefix: np.ndarray, fresh: np.ndarray | None = None) -> None:
        """Tuples in order of symbols, and under each in order of arrival. fresh: which are the first under theirs."""
        n = len(symbols)
        if fresh is None:
            fresh = np.ones(n, bool)
            np.not_equal(symbols[1:], symbols[:-1], out=fresh[1:])
        first = fresh.nonzero()[0]
        own = symbols[first]
        count = np.empty(len(first), np.int64)
        count[:-1] = first[1:] - first[:-1]
        count[-1] = n - first[-1]
        tail = self.tail[own]
        self.tuples[(tail - first).repeat(count) + np.arange(n)] = (positions << 16) | prefix
        self.tail[own] = tail + count

    def close(self, symbol: int, text: np.ndarray, cap: int) -> bool:
        """Pushes what the tuples under a symbol induce under that symbol itself, and what that induces, in rounds: in the
        order and with the common prefixes that scanning would give, without a scan a round. Whether it did so: not
        where the first round is too large to be worked on at once.

        Suffixes of round k begin with the symbol k + 1 times, so the first of a round shares k with the one before it."""
        low, high = int(self.starts[symbol]), int(self.tail[symbol])
        if not low < high < self.ends[symbol] or high - low > SCAN:
            return False
        part = np.array(self.tuples[low:high])
        position, prefix, shared = part >> 16, part & 0xFFFF, 0
        held, size = [], 0
        while True:
            take = ((text[position - 1] == symbol) & (position > 0)).nonzero()[0]
            if not len(take):
                break
            if len(take) < len(position):
                prefix = np.minimum.reduceat(prefix[: take[-1] + 1], np.concatenate(([0], take[:-1] + 1)))
                position = position[take]
            position, prefix, shared = position - 1, prefix + (prefix < cap), min(shared + 1, cap)
            prefix[0] = shared
            held.append((position << 16) | prefix)
            size += len(position)
            if size > SCAN:
                self.tuples[high : high + size] = np.concatenate(held)
                held, size, high = [], 0, high + size
        if held:
            self.tuples[high : high + size] = np.concatenate(held)
        self.tail[symbol] = high + size
        return True

    def pop(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions and common prefixes under one symbol, those that arrive meanwhile too."""
        at = self.starts[symbol]
        while at < self.tail[symbol]:
            part = np.array(self.tuples[at : min(self.tail[symbol], at + SCAN)])
            prefix = (part & 0xFFFF).astype(np.uint16)
            if at == self.starts[symbol]:
                prefix[0] = 0
            at += len(part)
            yield part >> 16, prefix

    def downward(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What pop gave, last first; each with its common prefix with the one that was after it (first: 0)."""
        low, high, ahead = int(self.starts[symbol]), int(self.tail[symbol]), 0
        while high > low:
            part = np.array(self.tuples[max(low, high - SCAN) : high])[::-1]
            own = (part & 0xFFFF).astype(np.uint16)
            prefix = np.concatenate((np.array([ahead], np.uint16), own[:-1]))
            ahead, high = own[-1], high - len(part)
            yield part >> 16, prefix

    def region(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions, common prefixes (first of each symbol: 0) and symbols of all complete regions of [low, high)."""
        part = np.array(self.tuples[self.starts[low] : self.ends[high - 1]])
        prefix, count = (part & 0xFFFF).astype(np.uint16), self.ends[low:high] - self.starts[low:high]
        prefix[(self.starts[low:high] - self.starts[low])[count > 0]] = 0
        return part >> 16, prefix, np.repeat(np.arange(low, high), count)


class Minima:
    """Least value of any stretch of an array, from minima of stretches of 1, 2, 4, ... values, a row of a table each."""

    def __init__(self, values: np.ndarray, array: Callable | None = None) -> None:
        n = len(values)
        rows = max(1, n.bit_length())
        self.table = (array(rows * n, values.dtype) if array else np.empty(rows * n, values.dtype)).reshape(rows, n)
        self.table[0] = values
        for k in range(1, rows):
            step = 1 << (k - 1)
            for a, b in stretches(n - 2 * step + 1, 1 << 20):
                np.minimum(self.table[k - 1, a:b], self.table[k - 1, a + step : b + step], out=self.table[k, a:b])

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        return np.minimum(self.table[level, first], self.table[level, last + 1 - (np.int64(1) << level)])


class Inducer:
    """Pushes the predecessors of scanned tuples. since: by symbol, the least common prefix met since its last push."""

    def __init__(self, text: np.ndarray, symbols: int, queue: BucketQueue, cap: int) -> None:
        self.text, self.queue, self.cap = text, queue, np.uint16(cap)
        self.since, self.open = np.zeros(symbols, np.uint16), []

    def _lower(self, low: np.uint16) -> None:
        """open: the symbols whose value may not be 0; at the edge of a symbol, where low is 0, all are closed."""
        if self.open:
            raised = np.concatenate(self.open)
            if len(raised) > len(self.since):
                raised = self.since.nonzero()[0]
            self.since[raised] = np.minimum(self.since[raised], low)
            self.open = [raised] if low else []

    def scan(self, position: np.ndarray, prefix: np.ndarray, wanted: Callable[[np.ndarray], np.ndarray]) -> None:
        symbol = self.text[position - 1]  # of position 0: any
        take = (wanted(symbol) & (position > 0)).nonzero()[0]
        low = np.minimum.accumulate(prefix)
        if not len(take):
            self._lower(low[-1])
            return
        symbol = symbol[take]
        order = symbol.argsort(kind="stable")
        take, symbol = take[order], symbol[order]
        fresh = np.ones(len(take) + 1, bool)
        np.not_equal(symbol[1:], symbol[:-1], out=fresh[1:-1])
        value = np.minimum(self.since[symbol], low[take])
        again = (~fresh[:-1]).nonzero()[0]
        if len(again):
            value[again] = Minima(prefix).least(take[again - 1] + 1, take[again])
        later = np.empty(len(prefix) + 1, np.uint16)
        np.minimum.accumulate(prefix[::-1], out=later[-2::-1])
        later[-1] = EQUAL
        ending = fresh[1:].nonzero()[0]
        later, raised = later[take[ending] + 1], symbol[ending]
        self._lower(low[-1])
        self.since[raised] = later
        self.open.append(raised[later > 0])
        self.queue.push(symbol, position[take] - 1, value + (value < self.cap), fresh[:-1])


def run_lengths(text: np.ndarray, at: np.ndarray, cap: int) -> np.ndarray:
    """How often the symbol at each position comes in a row from there, at most cap."""
    run, open_, symbol = np.ones(len(at), np.int64), np.arange(len(at)), text[at]
    for step in range(1, cap):
        open_ = open_[at[open_] + step < len(text)]
        open_ = open_[text[at[open_] + step] == symbol[open_]]
        if not len(open_):
            break
        run[open_] += 1
    return run


def seams(text: np.ndarray, position: np.ndarray, prefix: np.ndarray, at: np.ndarray, cap: int) -> None:
    """Sets the common prefixes of positions[at] with the ones before them, of the other type under the same symbol."""
    if len(at):
        prefix[at] = np.minimum(run_lengths(text, position[at - 1], cap), run_lengths(text, position[at], cap))


def complete(queue: BucketQueue, extra: np.ndarray, low: int, step: int) -> int:
    """End of a run of symbols from low on (down, if step is -1) whose regions are complete and, with what else belongs to
    them, not too many; low itself if its region is not complete. extra: how much else, summed up to each symbol."""
    n, width = len(queue.tail), 64
    while True:
        first, end = (low, min(n, low + width)) if step > 0 else (max(0, low + 1 - width), low + 1)
        whole = queue.tail[first:end] == queue.ends[first:end]
        if step > 0:
            size = queue.ends[first:end] - queue.starts[low] + extra[first + 1 : end + 1] - extra[low]
        else:
            size = queue.ends[low] - queue.starts[first:end] + extra[low + 1] - extra[first:end]
            whole, size = whole[::-1], size[::-1]
        bad = np.flatnonzero(~whole | (size > SCAN))
        if len(bad):
            return low + step * int(bad[0])
        if end - first < width:
            return low + step * (end - first)
        width *= 8


def induce(text: np.ndarray, rising: np.ndarray, symbols: int, seeds: np.ndarray, seed_prefix: np.ndarray, cap: int, store: Store, emit: Emit) -> None:
    """All suffixes, last in order first, with the common prefix of each and the one before it in this order.

    seeds: LMS positions in order; seed_prefix: of each and the one before it."""
    counts = np.zeros((2, symbols), np.int64)
    for a, b in stretches(len(text)):
        for kind in (0, 1):
            counts[kind] += np.bincount(text[a:b][rising[a:b] == kind], minlength=symbols)
    bounds = _bounds(text, seeds, symbols)

    falling = BucketQueue(store, counts[0])
    falling.push(text[-1:].astype(np.int64), np.array([len(text) - 1]), np.zeros(1, np.uint16))
    inducer, c = Inducer(text, symbols, falling, cap), 0
    while c < symbols:
        stop = complete(falling, bounds, c, 1)
        if stop == c and falling.close(c, text, cap):
            stop = complete(falling, bounds, c, 1)
        if stop > c:
            position, prefix, symbol = falling.region(c, stop)
            a, b = bounds[c], bounds[stop]
            if b > a:
                own = np.repeat(np.arange(c, stop), np.diff(bounds[c : stop + 1]))
                kind = np.concatenate((2 * symbol, 2 * own + 1))
                order = np.argsort(kind, kind="stable")
                position, prefix, kind = np.concatenate((position, seeds[a:b]))[order], np.concatenate((prefix, seed_prefix[a:b]))[order], kind[order]
                symbol = kind >> 1
                first = np.flatnonzero((kind & 1 == 1) & np.concatenate(([True], kind[1:] != kind[:-1])))
                prefix[first] = 0
                seams(text, position, prefix, first[(first > 0) & (symbol[first - 1] == symbol[first])], cap)
            if len(position):
                inducer.scan(position, prefix, lambda s: s > symbol)  # noqa: B023
            c = stop
            continue
        last, least = None, c + int(falling.tail[c] == falling.ends[c])  # a complete region takes no more
        for position, prefix in falling.pop(c):
            inducer.scan(position, prefix, lambda s: s >= least)  # noqa: B023
            last = position[-1:]
        for a, b in stretches(int(bounds[c + 1] - bounds[c]), SCAN):
            position, prefix = np.array(seeds[bounds[c] + a : bounds[c] + b]), np.array(seed_prefix[bounds[c] + a : bounds[c] + b])
            if not a:
                prefix[0] = 0 if last is None else min(run_lengths(text, last, cap)[0], run_lengths(text, position[:1], cap)[0])
            inducer.scan(position, prefix, lambda s: s > c)  # noqa: B023
        c += 1

    queue = BucketQueue(store, counts[1])
    inducer, c = Inducer(text, symbols, queue, cap), symbols - 1
    above = np.concatenate(([0], falling.ends))
    while c >= 0:
        stop = complete(queue, above, c, -1)
        if stop == c and queue.close(c, text, cap):
            stop = complete(queue, above, c, -1)
        if stop < c:
            position, prefix, symbol = queue.region(stop + 1, c + 1)
            more, shared, own = (x[::-1] for x in falling.region(stop + 1, c + 1))
            kind = np.concatenate((2 * (c - symbol), 2 * (c - own) + 1))
            order = np.argsort(kind, kind="stable")
            shared = np.concatenate((np.zeros(1, np.uint16), shared[:-1])) if len(more) else shared
            position, prefix, kind = np.concatenate((position, more))[order], np.concatenate((prefix, shared))[order], kind[order]
            symbol = c - (kind >> 1)
            first = np.flatnonzero((kind & 1 == 1) & np.concatenate(([True], kind[1:] != kind[:-1])))
            prefix[first] = 0
            seams(text, position, prefix, first[(first > 0) & (symbol[first - 1] == symbol[first])], cap)
            if len(position):
                inducer.scan(position, prefix, lambda s: s < symbol)  # noqa: B023
                emit(position, prefix)
            c = stop
            continue
        last, most = None, c - int(queue.tail[c] == queue.ends[c])
        for position, prefix in queue.pop(c):
            inducer.scan(position, prefix, lambda s: s <= most)  # noqa: B023
            emit(position, prefix)
            last = position[-1:]
        for position, prefix in falling.downward(c):
            if last is not None:
                prefix[0] = min(run_lengths(text, last, cap)[0], run_lengths(text, position[:1], cap)[0])
                last = None
            inducer.scan(position, prefix, lambda s: s < c)  # noqa: B023
            emit(position, prefix)
        c -= 1
    store.free(queue.tuples, falling.tuples)


def _bounds(text: np.ndarray, seeds: np.ndarray, symbols: int) -> np.ndarray:
    """Where the seeds of each symbol begin."""
    counts = np.zeros(symbols, np.int64)
    for a, b in stretches(len(seeds)):
        counts += np.bincount(text[seeds[a:b]], minlength=symbols)
    return np.concatenate(([0], np.cumsum(counts)))


def s_types(text: np.ndarray, store: Store) -> np.ndarray:
    """Whether each suffix is smaller than the one after it (the end is smaller than all)."""
    n = len(text)
    out, ahead = store.array(n, bool), False
    for a, b in reversed(list(stretches(n))):
        own = np.array(text[a : min(n, b + 1)]).astype(np.int64)
        if b == n:
            own = np.append(own, -1)
        rises, differs = own[:-1] < own[1:], own[:-1] != own[1:]
        place = np.where(differs, np.arange(b - a), b - a)
        nearest = np.minimum.accumulate(place[::-1])[::-1]
        out[a:b] = np.append(rises, ahead)[nearest]
        ahead = bool(out[a])
    return out


class Kept:
    """Collects some of the tuples of a downward stream, with the least common prefix since the last one kept."""

    def __init__(self, store: Store, size: int) -> None:
        self.position, self.prefix = store.array(size, np.int64), store.array(size, np.uint16)
        self.n, self.low = size, EQUAL

    def add(self, position: np.ndarray, prefix: np.ndarray, keep: np.ndarray) -> None:
        at = np.flatnonzero(keep)
        if not len(at):
            self.low = min(self.low, prefix.min())
            return
        least = np.minimum.reduceat(prefix[: at[-1] + 1], np.concatenate(([0], at[:-1] + 1)))
        least[0] = min(least[0], self.low)
        rest = prefix[at[-1] + 1 :]
        self.low = rest.min() if len(rest) else EQUAL
        low = self.n - len(at)
        self.position[low : self.n], self.prefix[low : self.n] = position[at][::-1], least[::-1]
        self.n = low

    def ascending(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions in order, and of each the common prefix with the one before it."""
        if len(self.prefix):
            for a, b in reversed(list(stretches(len(self.prefix)))):
                self.prefix[max(a, 1) : b] = np.array(self.prefix[max(a, 1) - 1 : b - 1])
            self.prefix[0] = 0
        return self.position, self.prefix


def first_order(text: np.ndarray, lms: np.ndarray, symbols: int, cap: int, store: Store) -> tuple[np.ndarray, np.ndarray]:
    """LMS positions by symbol and length of its run (longer ones first), with common prefixes as far as that tells."""

    def dealt(source: np.ndarray, keys: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        counts = np.zeros(size, np.int64)
        for a, b in stretches(len(source)):
            counts += np.bincount(keys(np.array(source[a:b])), minlength=size)
        queue = BucketQueue(store, counts)
        for a, b in stretches(len(source)):
            at = np.array(source[a:b])
            key = keys(at)
            order = np.argsort(key, kind="stable")
            queue.push(key[order], at[order], np.zeros(b - a, np.int64))
        for a, b in stretches(len(source)):
            queue.tuples[a:b] >>= 16
        return queue.tuples

    by_run = dealt(lms, lambda at: cap - run_lengths(text, at, cap), cap + 1)
    seeds = dealt(by_run, lambda at: text[at].astype(np.int64), symbols)
    store.free(by_run)
    prefix, last = store.array(len(lms), np.uint16), (-1, 0)
    for a, b in stretches(len(lms)):
        at = np.array(seeds[a:b])
        symbol, run = text[at].astype(np.int64), run_lengths(text, at, cap)
        same, equal = symbol == np.append(last[0], symbol[:-1]), run == np.append(last[1], run[:-1])
        prefix[a:b] = np.where(same, np.where(equal, EQUAL, run), 0)  # runs shorten within a symbol
        last = (symbol[-1], run[-1])
    return seeds, prefix


def suffixes(text: np.ndarray, symbols: int, cap: int, store: Store, emit: Emit) -> None:
    """All suffixes of a text, last in order of their first cap symbols first, with common prefixes (at most cap)."""
    n = len(text)
    if cap < 2:
        by_symbol(text, symbols, store, emit)
        return
    rising = s_types(text, store)

    def is_lms(at: np.ndarray) -> np.ndarray:
        return rising[at] & ~rising[at - 1] & (at > 0)

    size = sum(int(is_lms(np.arange(a, b)).sum()) for a, b in stretches(n))
    lms, filled = store.array(size, np.int64), 0
    for a, b in stretches(n):
        own = a + np.flatnonzero(is_lms(np.arange(a, b)))
        lms[filled : filled + len(own)] = own
        filled += len(own)
    seeds, prefix = lms, np.zeros(size, np.uint16)
    if size > 1:
        named = Kept(store, size)
        first, first_prefix = first_order(text, lms, symbols, cap, store)
        induce(text, rising, symbols, first, first_prefix, cap, store, lambda at, common: named.add(at, common, is_lms(at)))
        store.free(first, first_prefix)
        seeds, prefix = named.ascending()
        distinct = 1 + sum(int((prefix[max(a, 1) : b] != EQUAL).sum()) for a, b in stretches(size))
        if distinct < size:
            seeds, prefix = by_names(lms, seeds, prefix, distinct, cap, store)
    induce(text, rising, symbols, seeds, prefix, cap, store, emit)
    store.free(rising, lms, *(() if seeds is lms else (seeds, prefix)))


def by_symbol(text: np.ndarray, symbols: int, store: Store, emit: Emit) -> None:
    """As suffixes, where only the first symbol counts."""
    queue = BucketQueue(store, sum(np.bincount(text[a:b], minlength=symbols) for a, b in stretches(len(text))))
    for a, b in stretches(len(text)):
        order = np.argsort(text[a:b], kind="stable")
        queue.push(text[a:b][order].astype(np.int64), order + a, np.ones(b - a, np.int64))
    before = -1
    for a, b in reversed(list(stretches(len(text)))):
        position = np.array(queue.tuples[a:b])[::-1] >> 16
        symbol = text[position].astype(np.int64)
        emit(position, (symbol == np.append(before, symbol[:-1])).astype(np.uint16))
        before = symbol[-1]
    store.free(queue.tuples)


def by_names(lms: np.ndarray, by_name: np.ndarray, prefix: np.ndarray, distinct: int, cap: int, store: Store) -> tuple[np.ndarray, np.ndarray]:
    """LMS positions in order of their suffixes, with common prefixes, by sorting the text of the names of substrings.

    by_name: LMS positions in order of substrings; prefix: of each and the one before, EQUAL where they have one name."""
    size, last = len(lms), 0
    number = store.array(int(lms[-1] >> 1) + 1, np.uint32 if size <= 1 << 32 else np.int64)  # no two are neighbours
    for a, b in stretches(size):
        number[lms[a:b] >> 1] = np.arange(a, b)
    name, between = store.array(size, np.uint16 if distinct < 1 << 16 else np.uint32), store.array(distinct, np.uint16)
    for a, b in stretches(size):
        fresh = np.array(prefix[a:b]) != EQUAL
        if not a:
            fresh[0] = False
        own = last + np.cumsum(fresh)
        between[own[fresh]] = prefix[a:b][fresh]
        name[number[by_name[a:b] >> 1]] = own
        last = int(own[-1])
    store.free(number)
    del number
    found = Kept(store, size)
    suffixes(name, distinct, cap // 2 + 1, store, lambda at, common: found.add(at, common, np.ones(len(at), bool)))
    order, common = found.ascending()
    lows = Minima(between, store.array)
    out, out_prefix, before = by_name, prefix, 0
    for a, b in stretches(size):
        own, shared = np.array(order[a:b]), np.array(common[a:b]).astype(np.int64)
        other = np.concatenate(([before], own[:-1]))
        if not a:
            shared[0], other[0] = 0, own[0]
        before = own[-1]
        high, low = name[own + shared].astype(np.int64), name[other + shared].astype(np.int64)
        told = np.zeros(b - a, np.int64)
        apart = np.flatnonzero(high > low)  # all but the first of all, and those alike as far as was asked
        told[apart] = lows.least(low[apart] + 1, high[apart])
        told += lms[own + shared] - lms[own]
        out[a:b], out_prefix[a:b] = lms[own], np.minimum(told, cap)
    out_prefix[0] = 0
    store.free(name, between, order, common, lows.table)
    return out, out_prefix


def repeated_starts(blocks: list[bytes], window: int, store: Store | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Block and offset of every `window` bytes that also start elsewhere in the blocks: suffixes whose common prefix with
    a neighbour is the window at least. A symbol of its own, less than all bytes, ends each block, so that nothing is compared
    beyond it; their order is that of the blocks' numbers with bits reversed, as one that rises with the text (or its names)
    would be induced one by one."""
    store = store or Store()
    lengths = np.array([len(b) for b in blocks], np.int64)
    ends = np.cumsum(lengths + 1) - 1
    symbols = len(blocks) + 256
    reversed_bits = sum(((np.arange(len(blocks)) >> k) & 1) << (30 - k) for k in range(31))
    end_symbols = np.argsort(np.argsort(reversed_bits)).tolist()
    text = store.array(int(ends[-1]) + 1 if len(ends) else 0, np.uint16 if symbols <= 1 << 16 else np.uint32)
    for block, end, end_symbol in zip(blocks, ends.tolist(), end_symbols, strict=True):
        text[end - len(block) : end] = np.frombuffer(block, np.uint8)
        text[end - len(block) : end] += text.dtype.type(len(blocks))
        text[end] = end_symbol
    hit = store.array(len(text), bool)
    last = [0]

    def note(position: np.ndarray, prefix: np.ndarray) -> None:
        same = np.flatnonzero(prefix >= window)
        hit[position[same]] = True
        hit[np.where(same > 0, position[same - 1], last[0])] = True
        last[0] = position[-1]

    if len(text):
        suffixes(text, symbols, window, store, note)
    at = np.concatenate([a + np.flatnonzero(hit[a:b]) for a, b in stretches(len(text))] or [np.zeros(0, np.int64)])
    block = np.searchsorted(ends, at)
    inside = ends[block] - at >= window
    at, block = at[inside], block[inside]
    return block, at - (ends - lengths)[block]
