"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct pretokens of a stretch of a partition are laid end to end as one array of symbol ids. An index maps
every mergeable pair to all its positions in that array; active ranks leave a heap in ascending order, each is
applied to its whole position list at once, and the lists of the pairs that this makes or breaks are updated.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import strings, text_or_empty
from .kernels import chunks

#: The pretoken pattern of the byte-level pretokenizer. Fixed value.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text encoded at once.
TEXT_BYTES = 2 << 20
#: Pretokens remembered between batches, and bytes of pretokens merged at once.
REMEMBER, MERGE_BYTES = 500_000, 1 << 20


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b not in (0x7F, 0xAD)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Ids, merges by pair of ids, and the bytes of each id, from a tokenizer file."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        ids, letters = spec["model"]["vocab"], byte_letters()
        value = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.base = np.array([ids[c] for c in letters], np.int64)
        size = 1 + max(max(ids.values()), *self.special.values(), 0)
        pieces = [b""] * size
        for token, i in ids.items():
            pieces[i] = bytes(value[c] for c in token)
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.size = size
        left, right, made = [], [], []
        for pair in spec["model"]["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left.append(ids[a])
            right.append(ids[b])
            made.append(ids[a + b])
        key = np.array(left, np.int64) * size + np.array(right, np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order, np.array(made, np.int64)
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, -1 if there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


def merge_all(vocabulary: Vocabulary, pieces: list[bytes]) -> list[bytes]:
    """Token ids (int32) of every piece, merged by ascending rank through a pair occurrence index."""
    lengths = np.array([len(p) for p in pieces], np.int64)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    n = len(data)
    symbol = np.empty(n + 1, np.int64)
    symbol[:n], symbol[n] = vocabulary.base[data], -1
    after = np.arange(1, n + 2)
    before = np.arange(-1, n)
    ends = np.cumsum(lengths)
    after[ends[lengths > 0] - 1] = n
    before[(ends - lengths)[lengths > 0]] = n
    after[n] = before[n] = n

    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def note(positions: np.ndarray) -> None:
        """Enters the pairs that start at these positions."""
        positions = positions[after[positions] != n]
        rank = vocabulary.rank(symbol[positions], symbol[after[positions]])
        positions, rank = positions[rank >= 0], rank[rank >= 0]
        order = np.argsort(rank, kind="stable")
        positions, rank = positions[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for r, at in zip(rank[np.concatenate(([0], cuts))] if len(rank) else (), np.split(positions, cuts), strict=False):
            if int(r) in index:
                index[int(r)].append(at)
            else:
                index[int(r)] = [at]
                heapq.heappush(heap, int(r))

    note(np.arange(n))
    while heap:
        r = heapq.heappop(heap)
        lists = index.pop(r)
        at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
        left, right = vocabulary.left[r], vocabulary.right[r]
        at = at[(symbol[at] == left) & (symbol[after[at]] == right)]
        if left == right and len(at) > 1:
            at = _alternate(at, after)
        if not len(at):
            continue
        gone = after[at]
        symbol[at], symbol[gone] = vocabulary.made[r], -1
        after[at] = after[gone]
        inner = at[after[at] != n]
        before[after[inner]] = inner
        earlier = before[at]
        note(np.unique(np.concatenate((earlier[earlier != n], at))))
    live = np.flatnonzero(symbol[:n] >= 0)
    ids, cuts = symbol[live].astype(np.int32).tobytes(), (4 * np.searchsorted(live, ends)).tolist()
    return [ids[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]


def _alternate(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of runs of overlapping occurrences of a pair of equal symbols, every second one from the left."""
    at = np.sort(at)
    joined = np.concatenate(([False], after[at[:-1]] == at[1:]))
    run = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
    return at[(np.arange(len(at)) - run) % 2 == 0]


class Codec:
    """Encodes and decodes texts as the tokenizer file says; remembers a bounded number of pretokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            self.vocabulary = Vocabulary(f.read())
        special = "|".join(regex.escape(t) for t in sorted(self.vocabulary.special, key=len, reverse=True))
        self.special = regex.compile(f"({special})") if special else None
        self.pretokens = regex.compile(PRETOKEN).findall
        self.memory: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """Pretokens and special tokens of a text, in order."""
        if self.special is None or not self.special.search(text):
            return self.pretokens(text)
        out = []
        for k, part in enumerate(self.special.split(text)):
            out += [part] if k % 2 else self.pretokens(part)
        return out

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        pieces = [self.split(t) for t in texts]
        if len(self.memory) > REMEMBER:
            self.memory = {}
        fresh = list(dict.fromkeys(p for ps in pieces for p in ps if p not in self.memory))
        special = self.vocabulary.special
        known = self.memory
        for p in fresh:
            if p in special:
                known[p] = np.array([special[p]], np.int32).tobytes()
        fresh = [p for p in fresh if p not in known]
        raw = [p.encode("utf-8", "surrogatepass") for p in fresh]
        start = 0
        while start < len(raw):
            stop, size = start, 0
            while stop < len(raw) and (stop == start or size + len(raw[stop]) <= MERGE_BYTES):
                size += len(raw[stop])
                stop += 1
            known.update(zip(fresh[start:stop], merge_all(self.vocabulary, raw[start:stop]), strict=True))
            start = stop
        for ps in pieces:
            yield np.frombuffer(b"".join([known[p] for p in ps]), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        v = self.vocabulary
        lengths = v.lengths[ids]
        first = np.cumsum(lengths) - lengths
        at = np.repeat(v.offsets[ids] - first, lengths) + np.arange(int(lengths.sum()))
        return v.data[at].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(docs: DataFrame, tokenizer: str, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """doc_id, ids ARRAY<INT>, decoded: every whole text encoded and decoded again (null: empty text, no ids).

    tokenizer: path of a byte-level BPE file in the tokenizers format, readable on every worker. One narrow pass:
    nothing is shuffled, repeated rows are encoded as often as they occur, null doc_ids stay null, an empty table gives no
    rows, extra columns are not read. A text is encoded whole, however long: the index then covers it alone. The index
    runs over the pretokens of a stretch that have not been merged before, each once, up to MERGE_BYTES of them.
    """

    def run(batches):
        own = codec(tokenizer)
        for batch in batches:
            for start, stop, _, _ in chunks(batch.column("text"), text_bytes):
                part = batch.slice(start, stop - start)
                ids = list(own.encode(strings(part.column("text"))))
                decoded = [own.decode(x) for x in ids]
                cuts = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
                flat = pa.array(np.concatenate(ids), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), flat), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    rows = text_or_empty(docs, "doc_id")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def digests(encoded: DataFrame, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, if asked for) of what encode_documents returns."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    found = [F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")]
    return encoded.select("doc_id", *found, *(["ids"] if keep_ids else []))
