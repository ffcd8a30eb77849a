"""Line deduplication by an exact set-similarity join.

A line is the set of its words. Words are ordered by rarity in the corpus (counts in a sketch of fixed size, so the
order is total and the same everywhere); only the rarest words of a line, its prefix, are indexed. Lines that share a
prefix word are held against the length filter, the positional filter and a bound from 128-bit parity maps of their
words (the maps of two sets differ in no more bits than the sets in words); what is left is verified on full sets. A line
that matches an earlier one is removed.

Index entries travel as packed arrays, one row per some megabytes of them and bucket of words; equal sets collapse in the
stretch and again in the bucket. A later line needs one earlier match, so its two likeliest candidates of all its lists
are verified and not all its pairs. Where both fail though there were more, a second round gives such lines all their
candidates, from what the first one has written: its further pairs, and whole lists where a line left one early.

A set is known by two 64-bit hashes of its words. Its lines meet once, sorted, which tells the first one; a line with an
equal one before it in its stretch of text is known to be a copy and does not travel.

Sets so small that they can be similar only to an equal set are not indexed: the grouping by set hash settles them.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchored import numbered, spans_by_document
from .common import Bloom, Scratch, strings
from .kernels import chunks, mix, word_codes, words

#: Slots of the word-count sketch: 4 MB of counts, whatever the corpus.
LOG_SLOTS, SLICES = 20, 16
#: A line leaves an index list in the first round with this many candidates; one whose word map is at most half as far
#: off as it may be counts as STRONG of them. BEST: candidates of a line that are verified in the first round.
TRIES, STRONG, BEST = 64, 32, 2
#: Bytes of index entries that are joined at once, and that a task gathers before it packs them.
BUCKET_BYTES = PACK_BYTES = 16 << 20
#: What an index entry is: word, set, place of the line, size of the set, rank of the word in it, word map.
ENTRY = (("word", np.uint64), ("c", np.int64), ("doc", np.int64), ("line", np.int32), ("n", np.int32), ("pos", np.int32), ("m0", np.uint64), ("m1", np.uint64))
ENTRY_BYTES = sum(np.dtype(t).itemsize for _, t in ENTRY)


def sorted_within(line: np.ndarray, rank: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Order by line, then by rank (under 2**44), then by word: one sort of packed keys if that leaves no tie."""
    if not len(line) or line[-1] < 1 << 20:
        key = (line.astype(np.uint64) << np.uint64(44)) | rank
        order = np.argsort(key)
        key = key[order]
        tied = np.flatnonzero(key[1:] == key[:-1])
        if (word[order[tied]] == word[order[tied + 1]]).all():
            return order
    return np.lexsort((word, rank, line))


class Lines:
    """Lines of a stretch of documents as sets of words: for each its document, number, and distinct word hashes, in order of
    the hashes, or rarest first if the counts of the sketch's slots are given. where: a mask of the lines to take, by
    document and number."""

    def __init__(self, data: np.ndarray, at: np.ndarray, counts: np.ndarray | None = None, where=None) -> None:
        begin, end, doc = words(data, at)
        breaks = np.flatnonzero(data == 0x0A)
        start = np.unique(np.searchsorted(begin, np.concatenate((breaks, at[:-1]))))
        start = start[start < len(begin)]
        self.doc = doc[start]
        self.number = np.searchsorted(breaks, begin[start]) - np.searchsorted(breaks, at[self.doc])
        held = np.diff(np.append(start, len(begin)))
        if where:
            mine = where(self.doc, self.number)
            inside = np.repeat(mine, held)
            begin, end, held, self.doc, self.number = begin[inside], end[inside], held[mine], self.doc[mine], self.number[mine]
            start = np.cumsum(held) - held
        line = np.repeat(np.arange(len(start)), held)
        word = word_codes(data, begin, end)
        word = word[sorted_within(line, word >> np.uint64(20) if counts is None else rareness(word, counts), word)]
        keep = np.ones(len(word), bool)
        keep[1:] = word[1:] != word[:-1]
        keep[start] = True
        self.word, self.line = word[keep], line[keep]
        self.size = np.bincount(self.line, minlength=len(start))
        self.bounds = np.concatenate(([0], np.cumsum(self.size)))

    @cached_property
    def code(self) -> np.ndarray:
        return self.hashed(0x2545F4914F6CDD1D)

    @cached_property
    def other(self) -> np.ndarray:
        return self.hashed(0x9FB21C651E98DF25)

    def hashed(self, salt: int) -> np.ndarray:
        """A 64-bit hash of each set."""
        sums = np.add.reduceat(mix(self.word ^ np.uint64(salt)), self.bounds[:-1]) if len(self.size) else self.word
        return mix(sums + self.size.astype(np.uint64))

    def firsts(self, least: int) -> np.ndarray:
        """The first line of each set of at least `least` words."""
        fit = np.flatnonzero(self.size >= least)
        return np.sort(fit[np.unique(self.code[fit], return_index=True)[1]])


def _slot(word: np.ndarray) -> np.ndarray:
    return (word >> np.uint64(64 - LOG_SLOTS)).astype(np.int64)


def rareness(word: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rank of words under 2**44, the rarest first. Words of one slot differ in the bits that follow the count, for these are
    not the slot's."""
    rarity = np.minimum(counts[_slot(word)], (1 << 24) - 1).astype(np.uint64)
    return (rarity << np.uint64(20)) | (word & np.uint64((1 << 20) - 1))


def word_counts(parts: DataFrame) -> np.ndarray:
    """Lines in which the words of each slot occur, over all rows. parts: slice, counts, as _survey gives them."""

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, counts in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                held[s] = held.get(s, 0) + np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["slice", "counts"])

    out = np.zeros((SLICES, (1 << LOG_SLOTS) // SLICES), np.int64)
    for row in parts.repartition(SLICES, "slice").mapInArrow(add, "slice int, counts binary").collect():  # 8 MB
        out[row.slice] += np.frombuffer(row.counts, np.int64)
    return np.minimum(out.ravel(), 2**32 - 1).astype(np.uint32)


def overlap_needed(n, m, percent: int):
    """Least intersection of sets of n and m with 100 * intersection >= percent * union."""
    return -(-(percent * (n + m)) // (100 + percent))


def least_indexed(percent: int, least: int) -> int:
    """Least size of a set that can be similar to a different one: n of n + 1 words must be enough."""
    return max(least, -(-percent // (100 - percent)) if percent < 100 else 2**31 - 1)


def prefix_entries(lines: Lines, first: np.ndarray, docs: np.ndarray, percent: int) -> dict[str, np.ndarray]:
    """Index entries of the chosen lines, as arrays by name of ENTRY. lines: rarest words first. docs: doc_id of each row of
    the stretch."""
    size, begin = lines.size, lines.bounds[:-1]
    bit = (lines.word >> np.uint64(24)) & np.uint64(127)
    one, upper = np.uint64(1) << (bit & np.uint64(63)), bit >> np.uint64(6)
    maps = [np.bitwise_xor.reduceat(one * mine, begin) if len(begin) else one for mine in (upper ^ np.uint64(1), upper)]
    heads = (size - -(-percent * size // 100) + 1)[first]
    line = np.repeat(first, heads)
    rank = np.arange(len(line)) - np.repeat(np.cumsum(heads) - heads, heads)
    values = (lines.word[begin[line] + rank], lines.code[line].view(np.int64), docs[lines.doc[line]], lines.number[line], size[line], rank, maps[0][line], maps[1][line])
    return {name: v.astype(t) for (name, t), v in zip(ENTRY, values, strict=True)}


def place_keys(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mix(doc.astype(np.int64).view(np.uint64) ^ mix(line.astype(np.uint64) + np.uint64(1)))


def standing_at(places, ids: np.ndarray):
    """For Lines: the lines whose places a Bloom filter holds. ids: doc_id of each row of the stretch."""
    return lambda doc, number: places.might_hold(place_keys(ids[doc], number))


def _places(batches):
    for batch in batches:
        doc, line = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "line"))
        yield pa.RecordBatch.from_arrays([pa.array(place_keys(doc, line).view(np.int64))], ["key"])


def packed(held: list[dict[str, np.ndarray]], buckets: int) -> pa.RecordBatch:
    """Index entries as a row per bucket that has any: its arrays, one after the other."""
    entry = {name: np.concatenate([x[name] for x in held]) for name, _ in ENTRY}
    bucket = (mix(entry["word"]) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    full, held_in = np.unique(bucket[order], return_counts=True)
    stops = np.cumsum(held_in)
    arrays = [(v.itemsize, v[order].tobytes()) for v in entry.values()]
    rows = [b"".join([raw[width * i : width * j] for width, raw in arrays]) for i, j in zip((stops - held_in).tolist(), stops.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(rows, pa.binary())], ["bucket", "entries"])


def _index(counts, percent: int, least: int, buckets: int, places):
    """Packed index entries: a row per PACK_BYTES of entries and bucket. places: a broadcast Bloom filter of the lines in which
    sets come first; copies of a set further on are left out (if the filter is full, they meet in the bucket)."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for start, stop, data, at in chunks(batch.column("text")):
                lines = Lines(data, at, counts.value, standing_at(places.value, ids[start:stop]))
                fit = np.flatnonzero(lines.size >= least)
                fit = fit[np.lexsort((lines.number[fit], ids[start:stop][lines.doc[fit]]))]  # rows of a stretch are in any order
                first = np.sort(fit[np.unique(lines.code[fit], return_index=True)[1]])
                held.append(prefix_entries(lines, first, ids[start:stop], percent))
                size += len(held[-1]["word"]) * ENTRY_BYTES
                if size >= PACK_BYTES:
                    yield packed(held, buckets)
                    held, size = [], 0
        if size:
            yield packed(held, buckets)

    return run


def unpacked(rows: list[bytes]) -> dict[str, np.ndarray]:
    out, at, held = {}, 0, [len(raw) // ENTRY_BYTES for raw in rows]
    for name, t in ENTRY:
        width = np.dtype(t).itemsize
        out[name] = np.frombuffer(b"".join([raw[n * at : n * (at + width)] for raw, n in zip(rows, held, strict=True)]), t)
        at += width
    return out


def listed(e: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Index entries by word, in order of their lines, the first line of each set in each list; lists of several lines only,
    the longest first."""
    order = listed_order(e["word"], e["doc"], e["line"])
    same = mix(e["word"] ^ mix(e["c"].view(np.uint64)))[order]
    told = np.sort(same)
    if (told[1:] == told[:-1]).any():
        order = order[np.sort(np.unique(same, return_index=True)[1])]
    start, size = lists_of(e["word"][order])
    turn = np.argsort(-size, kind="stable")[: np.count_nonzero(size > 1)]
    start, size = start[turn], size[turn]
    order = order[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    return {k: v[order] for k, v in e.items()}


def lists_of(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of each run of one word."""
    start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(word)))


def listed_order(word: np.ndarray, doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Order by word, doc, line: by the word's upper bits and the place among the entries, packed, if these tell words apart."""
    if len(word) and int(doc.max()) - int(doc.min()) < 1 << 32:
        by_place = np.argsort(((doc - doc.min()).view(np.uint64) << np.uint64(32)) | line.astype(np.uint64), kind="stable")
        low = np.uint64((1 << len(word).bit_length()) - 1)
        key = np.sort((word[by_place] & ~low) | np.arange(len(word), dtype=np.uint64))
        order = by_place[(key & low).view(np.int64)]
        if (((key[1:] ^ key[:-1]) > low) | (word[order[1:]] == word[order[:-1]])).all():
            return order
    return np.lexsort((line, doc, word))


def candidates(e: dict[str, np.ndarray], percent: int, probe=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """a (later), b (earlier), score: places of pairs in one index list that the filters let through. cut: a mask of the
    places that left their list early, with others before.

    The nearest b of each a and list, two likely ones or up to TRIES; with probe (a mask of sets by c), all b of the sets
    that it holds. e: as `listed` gives it. The lower the score, the likelier."""
    start, size = lists_of(e["word"])
    n, pos, m0, m1 = e["n"], e["pos"], e["m0"], e["m1"]
    place = (np.arange(len(n)) - np.repeat(start, size)).astype(np.int32)
    wide, top = n.astype(np.int64), np.iinfo(np.int32).max
    high = 100 * wide // percent
    room = np.minimum((100 - percent) * (wide + high) // (100 + percent), 64).astype(np.uint8)  # of any b; a map has 64 bits
    low, high = (-(-percent * wide // 100)).astype(np.int32), np.minimum(high, top).astype(np.int32)
    if probe:
        low[~probe(e["c"])] = top  # such places and those that have left their list take no b
    tries, cut = np.zeros(len(n), np.int16), np.zeros(len(n), bool)
    stops = np.append(start, len(n))[np.searchsorted(-size, -np.arange(size[0] + 1 if len(size) else 1))]  # of lists longer than so much
    found, left = [(place[:0].astype(np.int64),) * 3], None
    for back in range(1, len(stops) - 1):
        if back % 16 == 1 and left is None:
            own = np.flatnonzero((place[: stops[back]] >= back) & (low[: stops[back]] < top))
            left = own if 8 * len(own) < stops[back] else None
        if left is None:  # every place of the lists that are long enough, against the one so far before it
            ours, theirs = slice(back, stops[back]), slice(0, stops[back] - back)
            fit = n[theirs] >= low[ours]
            fit &= n[theirs] <= high[ours]
            fit &= place[ours] >= back
            fit &= np.bitwise_count(m0[ours] ^ m0[theirs]) <= room[ours]
            a = np.flatnonzero(fit) + back
        else:
            left = left[(place[left] >= back) & (low[left] < top)]
            if not len(left):
                break
            a = left[(n[left - back] >= low[left]) & (n[left - back] <= high[left])]
        need = overlap_needed(wide[a], wide[a - back], percent)
        fit = np.minimum(pos[a], pos[a - back]) + np.minimum(n[a] - pos[a], n[a - back] - pos[a - back]) >= need
        a, need = a[fit], need[fit]
        apart = np.bitwise_count(m0[a] ^ m0[a - back]).astype(np.int64) + np.bitwise_count(m1[a] ^ m1[a - back])
        most = wide[a] + wide[a - back] - 2 * need
        fit = apart <= most
        a, apart, most = a[fit], apart[fit], most[fit]
        found.append((a, a - back, 1000 * apart // np.maximum(most, 1)))
        if not probe:
            tries[a] += np.where(2 * apart <= most, STRONG, 1).astype(np.int16)
            done = a[tries[a] >= TRIES]
            low[done], cut[done] = top, place[done] > back
    return *(np.concatenate(p) for p in zip(*found, strict=True)), cut


JOINED = "x long, y long, score int, more boolean, entries binary, pairs binary"


def _joined(x=None, y=None, score=None, more=None, entries=None, pairs=None) -> pa.RecordBatch:
    n = len(x) if x is not None else 1
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.nulls(n, t) if v is None else pa.array(v, t) for v, t in zip((x, y, score, more, entries, pairs), kinds, strict=True)], [c.split()[0] for c in JOINED.split(", ")])


def _join(percent: int):
    """Rows of packed entries, those of one bucket in a row; gives the BEST candidates of each set in each bucket and whether it
    had more; packed entries of the lists that a set left early or whose further pairs take more bytes than the list; and
    x, y of the further pairs of all others, packed."""

    def bucket(rows: list[bytes]):
        e = listed(unpacked(rows))
        a, b, score, cut = candidates(e, percent)
        order = np.lexsort((score, e["c"][a]))
        a, b, score = a[order], b[order], score[order]
        x, y = e["c"][a], e["c"][b]
        start, held = lists_of(x)
        further = np.arange(len(x)) - np.repeat(start, held) >= BEST
        more = np.repeat(np.maximum.reduceat(cut[a] | further, start), held) if len(x) else further
        yield _joined(x[~further], y[~further], score[~further].astype(np.int32), more[~further])
        size = lists_of(e["word"])[1]
        of = np.repeat(np.arange(len(size)), size)
        whole = 2 * x.itemsize * np.bincount(of[a[further]], minlength=len(size)) > ENTRY_BYTES * size
        whole[of[cut]] = True
        if whole.any():
            yield _joined(entries=[b"".join(v[whole[of]].tobytes() for v in e.values())])
        further &= ~whole[of[a]]
        if further.any():
            yield _joined(pairs=[x[further].tobytes() + y[further].tobytes()])

    def run(batches):
        now, rows = None, []
        for batch in batches:
            for k, raw in zip(batch.column("bucket").to_pylist(), batch.column("entries").to_pylist(), strict=True):
                if k != now and rows:
                    yield from bucket(rows)
                    rows = []
                now = k
                rows.append(raw)
        if rows:
            yield from bucket(rows)

    return run


def _all(percent: int, open_):
    """x, y: the candidates of the open sets (a broadcast Bloom filter) in lists and further pairs that _join has given."""

    def held(c):
        return open_.value.might_hold(c.view(np.uint64))

    def run(batches):
        for batch in batches:
            for entries, pairs in zip(batch.column("entries").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
                if entries is not None:
                    e = unpacked([entries])
                    a, b, _, _ = candidates(e, percent, held)
                    x, y = e["c"][a], e["c"][b]
                else:
                    x, y = np.frombuffer(pairs, np.int64).reshape(2, -1)
                    mine = held(x)
                    x, y = x[mine], y[mine]
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["x", "y"])

    return run


SURVEY = "doc_id long, th long, line int, c long, d long, slice int, counts binary"


LINES = "doc_id long, th long, line int, c long, d long, first boolean"


def copies(c: np.ndarray, d: np.ndarray, *place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lines in order of sets, then of places: masks of those at another place than the first of their run of one set, and
    of those at its very place (of a repeated row)."""
    fresh = np.concatenate(([True], (c[1:] != c[:-1]) | (d[1:] != d[:-1]))) if len(c) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(c)), 0)) if len(c) else np.zeros(0, np.int64)
    there = np.logical_and.reduce([x == x[head] for x in place])
    return ~there, there & ~fresh


def _survey(least: int):
    """One pass over the texts: doc_id, th, line, c and d of every line that is long enough (no c and d: its set comes earlier
    in the stretch of text), and slice, counts of words."""
    names = [x.split()[0] for x in SURVEY.split(", ")]

    def run(batches):
        held = np.zeros(1 << LOG_SLOTS, np.int64)
        for batch in batches:
            ids, hashes = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("doc_id", "th"))
            for start, stop, data, at in chunks(batch.column("text")):
                lines = Lines(data, at)
                np.add.at(held, _slot(lines.word), 1)
                fit = np.flatnonzero(lines.size >= least)
                if (np.diff(ids[start:stop]) <= 0).any():  # rows of a stretch are in any order
                    row = lines.doc[fit] + start
                    fit = fit[np.lexsort((hashes[row], lines.number[fit], ids[row]))]
                fit = fit[np.argsort(lines.code[fit], kind="stable")]
                row, line, c, d = lines.doc[fit] + start, lines.number[fit].astype(np.int32), lines.code[fit].view(np.int64), lines.other[fit].view(np.int64)
                known = copies(c, d, ids[row], line, hashes[row])[0]
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(hashes[row]), pa.array(line), pa.array(c, mask=known), pa.array(d, mask=known), pa.nulls(len(fit), pa.int32()), pa.nulls(len(fit), pa.binary())], names)
        parts = held.reshape(SLICES, -1)
        for k in range(SLICES):
            if parts[k].any():
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())), pa.array([k], pa.int32()), pa.array([parts[k].tobytes()], pa.binary())], names)

    return run


def _mark(batches):
    """Lines in order of c, d, doc_id, line, th; tells which ones are the first of their sets, and leaves out repeated rows."""
    names = [x.split()[0] for x in LINES.split(", ")]
    last = [np.zeros(0, np.int64)] * 5
    for batch in batches:
        own = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("c", "d", "doc_id", "line", "th")]
        if not len(batch):
            continue
        c, d, *place = (np.concatenate(x) for x in zip(last, own, strict=True))
        copy, twin = copies(c, d, *place)
        skip = len(c) - len(batch)
        head = len(c) - 1 - int(np.argmax(~(copy | twin)[::-1]))  # a row that starts a set: the first of all, at least
        last = [x[head : head + 1] for x in (c, d, *place)]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names[:-1]), pa.array(~copy[skip:])], names).filter(pa.array(~twin[skip:]))


def _sets(places, standing, least: int):
    """c, d, members of the sets at these places (a broadcast Bloom filter of the lines in which wanted sets come first, and one
    of their documents)."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(standing.value.might_hold(batch.column("of").to_numpy(zero_copy_only=False).view(np.uint64))))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for start, stop, data, at in chunks(batch.column("text")):
                lines = Lines(data, at, where=standing_at(places.value, ids[start:stop]))
                first = lines.firsts(least)
                yield pa.RecordBatch.from_arrays([pa.array(lines.code[first].view(np.int64)), pa.array(lines.other[first].view(np.int64)), pa.array([lines.word[lines.bounds[k] : lines.bounds[k + 1]].tobytes() for k in first.tolist()], pa.binary())], ["c", "d", "members"])

    return run


def shared(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the sets of each row (packed word hashes), and how many words they share."""
    n, m = (pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) // 8 for x in (a, b))
    row = np.arange(len(n))
    row = np.concatenate((np.repeat(row, n), np.repeat(row, m)))
    word = np.frombuffer(b"".join(a.to_pylist() + b.to_pylist()), np.uint64)
    order = sorted_within(row, word >> np.uint64(20), word)
    row, word = row[order], word[order]
    both = (row[1:] == row[:-1]) & (word[1:] == word[:-1])
    return n, m, np.bincount(row[1:][both], minlength=len(n))


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            n, m, both = shared(batch.column("a"), batch.column("b"))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("d")], ["x", "d"]).filter(pa.array(100 * both >= percent * (n + m - both)))

    return run


def matched_sets(scratch: Scratch, rows: DataFrame, told: np.ndarray, firsts: DataFrame, percent: int, least: int) -> DataFrame:
    """x, d: the hashes of every set that is similar to one that comes first earlier. told: word counts by slot. firsts: c,
    first (doc_id, line, th)."""
    spark, least = rows.sparkSession, least_indexed(percent, least)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(told.sum(dtype=np.int64)) * 3 * ENTRY_BYTES // (10 * BUCKET_BYTES)))
    counts = spark.sparkContext.broadcast(told)
    places = spark.sparkContext.broadcast(Bloom.build(firsts.select("first.doc_id", "first.line").mapInArrow(_places, "key long"), firsts.count()))
    # About three entries to ten words, so a bucket is about BUCKET_BYTES; a task holds one at a time.
    entries = rows.select("doc_id", "text").mapInArrow(_index(counts, percent, least, buckets, places), "bucket int, entries binary")
    joined = scratch.put("joined", entries.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_join(percent), JOINED))
    scratch.sweep()

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        ends = pairs.select(F.col("x").alias("c")).union(pairs.select("y")).distinct().join(firsts, "c")
        ends = scratch.put(f"ends_{name}", ends.select("c", "first.doc_id", "first.line", "first.th"))
        n = ends.count()
        keys = ends.select("doc_id", "line").mapInArrow(_places, "key long"), ends.select(F.xxhash64("doc_id", "th").alias("key"))
        blooms = [spark.sparkContext.broadcast(Bloom.build(k, n)) for k in keys]
        sets = rows.select("doc_id", "text", F.xxhash64("doc_id", "th").alias("of")).mapInArrow(_sets(*blooms, least), "c long, d long, members binary")
        sets = scratch.put(f"sets_{name}", sets.join(ends.select("c").distinct(), "c", "left_semi").dropDuplicates(["c", "d"]))
        x = sets.select(F.col("c").alias("x"), "d", F.col("members").alias("a"))
        y = sets.select(F.col("c").alias("y"), F.col("members").alias("b"))
        hits = scratch.put(f"hits_{name}", pairs.join(x, "x").join(y, "y").mapInArrow(_verify(percent), "x long, d long").distinct())
        scratch.drop(f"ends_{name}", f"sets_{name}")
        scratch.sweep()
        return hits

    best = F.sort_array(F.collect_set(F.struct("score", "y")))
    tried = joined.filter("x IS NOT NULL").groupBy("x").agg(best.alias("best"), F.max("more").alias("more"))
    tried = tried.select("x", F.slice("best", 1, BEST).alias("best"), (F.col("more") | (F.size("best") > BEST)).alias("more"))
    tried = scratch.put("tried", tried)
    hits = verified(tried.select("x", F.explode("best").alias("of")).select("x", "of.y"), "one")
    open_ = scratch.put("open", tried.filter("more").select("x").join(hits, "x", "left_anti"))
    if not open_.isEmpty():
        bloom = spark.sparkContext.broadcast(Bloom.build(open_.select(F.col("x").alias("key")), open_.count()))
        rest = joined.filter("x IS NULL").select("entries", "pairs").mapInArrow(_all(percent, bloom), "x long, y long")
        rest = rest.union(joined.filter("x IS NOT NULL").select("x", "y")).join(open_, "x", "left_semi").distinct()
        hits = hits.union(verified(scratch.put("rest", rest), "two")).distinct()
    scratch.drop("joined")
    return hits


def line_dedup(docs: DataFrame, percent: int = 80, least: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_removed, kept_text (kept lines joined by \\n).

    Lines are split at \\n. A line of at least `least` distinct words is removed if an earlier line (by doc_id, then
    place in the text) has a word set with 100 * intersection >= percent * union; equal sets are similar. Earlier
    lines count whether or not they are kept themselves; sets are ordered by their first line. Shorter and blank lines
    stay. Null text counts as empty; rows with a null doc_id stay whole and remove nothing; of rows that share a
    doc_id, those of equal text are one. An empty table gives no rows; extra columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "line_dedup")
    every = numbered(docs)
    rows = every.filter("doc_id IS NOT NULL AND text <> ''")
    survey = scratch.put("lines", rows.mapInArrow(_survey(least), SURVEY))
    counts = word_counts(survey.filter("slice IS NOT NULL").select("slice", "counts"))
    lines = survey.filter("c IS NOT NULL").select("doc_id", "th", "line", "c", "d").repartition("c")
    lines = scratch.put("marked", lines.sortWithinPartitions("c", "d", "doc_id", "line", "th").mapInArrow(_mark, LINES))
    firsts = lines.filter("first").select("c", F.struct("doc_id", "line", "th").alias("first"))
    hits = scratch.put("hits", matched_sets(scratch, rows, counts, firsts, percent, least))
    gone = survey.filter("slice IS NULL AND c IS NULL").select("doc_id", "th", "line").union(lines.filter("NOT first").select("doc_id", "th", "line"))
    gone = gone.union(lines.filter("first").join(hits.withColumnRenamed("x", "c"), ["c", "d"], "left_semi").select("doc_id", "th", "line"))
    spans = scratch.put("spans", spans_by_document(gone.select("doc_id", "th", F.col("line").alias("start"), F.lit(1).alias("length"))))
    scratch.drop("lines", "marked", "hits")
    scratch.sweep()

    def keep(batches):
        for batch in batches:
            total, removed, kept, spans = [], [], [], batch.column("spans")
            held = np.cumsum(spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)).tolist()
            number = (spans.flatten().to_numpy(zero_copy_only=False) >> 32).tolist()
            for text, start, stop in zip(strings(batch.column("text")), [0, *held[:-1]], held, strict=True):
                if start == stop:
                    total.append(text.count("\n") + 1)
                    removed.append(0)
                    kept.append(text)
                    continue
                own, gone = text.split("\n"), set(number[start:stop])
                total.append(len(own))
                removed.append(len(gone))
                kept.append("\n".join(x for j, x in enumerate(own) if j not in gone))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_removed", "kept_text"])

    met = every.join(spans, ["doc_id", "th"], "left").select("doc_id", "text", "spans")
    return met.mapInArrow(keep, "doc_id long, n_lines long, n_removed long, kept_text string")
