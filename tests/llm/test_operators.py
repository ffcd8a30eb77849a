import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe, exact_dedup, line_dedup, minhash, mixing, quality_classifier, quality_rules, queries, substring_dedup, suffix_dedup, suffix_sort
from tidemark.llm.kernels import CHUNK, Prefix, mix, segments, stretch_codes
from tidemark.llm.textstats import Stretch

from . import brute

ROWS = brute.corpus()
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, brute.SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], brute.SCHEMA)


def rows(df, *columns):
    return sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.select(*columns).collect()), key=repr)


def test_exact_dedup(docs, nothing):
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert rows(exact_dedup.exact_dedup(docs), *columns) == sorted(brute.exact(ROWS), key=repr)
    assert exact_dedup.exact_dedup(nothing).count() == 0
    kept = exact_dedup.keep_unique(docs)
    want = {(d, k) for d, k, _, stays, _ in brute.exact(ROWS) if stays}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in want) and kept.columns == docs.columns


def test_bpe(docs, nothing):
    t = Tokenizer.from_file(TOKENIZER)
    out = bpe.encode_documents(docs, TOKENIZER)
    want = [(r[0], t.encode(r[1] or "", add_special_tokens=False).ids) for r in ROWS]
    assert sorted(((r.doc_id, list(r.ids)) for r in out.collect()), key=repr) == sorted(want, key=repr)
    told = [(d, len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(t.decode(i, skip_special_tokens=False).encode()).hexdigest()) for d, i in want]
    assert rows(bpe.digests(out), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(told, key=repr)
    assert bpe.encode_documents(nothing, TOKENIZER).count() == 0


@pytest.mark.parametrize("text", ["aaaaaaaaa", "<|endoftext|><|endoftext|>x", "  \n\t  y'll we've 12³ é́ ​", "\u0085  　z", "'S's 't'T", "a" * 5000])
def test_bpe_on_odd_texts(text):
    c, t = bpe.codec(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    ids = next(iter(c.encode([text])))
    assert ids.tolist() == t.encode(text, add_special_tokens=False).ids and c.decode(ids) == text


def test_quality_rules(docs, nothing):
    want = sorted(((r[0], *brute.rules(r[1])) for r in ROWS), key=repr)
    out = quality_rules.quality_rules(docs)
    assert rows(out, "doc_id", *quality_rules.MEASURES, "base_failed", "kept") == want
    assert sorted((r.doc_id for r in quality_rules.keep_good(docs).collect()), key=repr) == sorted((w[0] for w in want if w[-1]), key=repr)
    assert quality_rules.quality_rules(nothing).count() == 0 and quality_rules.keep_good(nothing).count() == 0


def test_rule_order_does_not_change_the_verdict(docs):
    one = rows(quality_rules.quality_rules(docs, quality_rules.RULES[::-1], sample_rows=1), "doc_id", "kept")
    assert one == rows(quality_rules.quality_rules(docs), "doc_id", "kept")


def test_substring_dedup(docs, nothing):
    out = substring_dedup.substring_dedup(docs)
    assert rows(out, "doc_id", "n_words", "n_removed", "kept_text") == sorted(brute.windows13(ROWS), key=repr)
    assert substring_dedup.substring_dedup(nothing).count() == 0


def test_suffix_dedup(docs, nothing):
    out = suffix_dedup.suffix_dedup(docs, shard_bytes=3000, store_bytes=1000)
    assert rows(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept") == sorted(brute.strings200(ROWS), key=repr)
    assert suffix_dedup.suffix_dedup(nothing).count() == 0


def hot_rows(glue):
    """One phrase in many different contexts, some of them copied in part."""
    rng = np.random.default_rng(8)
    some = lambda k: glue.join(f"{x:05x}" for x in rng.integers(0, 1 << 20, k))
    phrase, tail = "the very long common phrase of them all", some(40)
    texts = [glue.join((some(30), phrase, tail if k % 3 == 0 else some(40))) for k in range(60)]
    texts += [texts[5], texts[7][40:], texts[5][:330]]
    return [(k * 37 % 64, t) for k, t in enumerate(texts)]


def test_substring_dedup_of_an_anchor_too_large_for_a_task(spark, docs, monkeypatch):
    """Windows of an anchor beyond the bound never reach the index of one task."""
    sizes, whole = [], substring_dedup.dealt_windows
    monkeypatch.setattr(substring_dedup, "dealt_windows", lambda blocks: sizes.append(blocks.count()) or whole(blocks))
    for rows_, df in ((hot_rows(" "), None), (ROWS, docs)):
        df = df or spark.createDataFrame(rows_, "doc_id long, text string")
        for most in (20, 10**6):
            out = substring_dedup.substring_dedup(df, anchor_windows=most)
            assert rows(out, "doc_id", "n_words", "n_removed", "kept_text") == sorted(brute.windows13(rows_), key=repr)
    assert len(sizes) == 2 and min(sizes) > 1


def test_suffix_dedup_of_an_anchor_too_large_for_a_shard(spark, docs, monkeypatch):
    """Segments of an anchor beyond the bound of a shard never reach the sorting of one task."""
    sizes, whole = [], suffix_dedup.dealt_windows
    monkeypatch.setattr(suffix_dedup, "dealt_windows", lambda blocks, width: sizes.append(blocks.count()) or whole(blocks, width))
    for rows_, df in ((hot_rows("-"), None), (ROWS, docs)):
        df = df or spark.createDataFrame(rows_, "doc_id long, text string")
        for most in (500, 10**8):
            out = suffix_dedup.suffix_dedup(df, anchor_bytes=most)
            assert rows(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept") == sorted(brute.strings200(rows_), key=repr)
    assert len(sizes) == 2 and min(sizes) > 1


def common(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("scan", [suffix_sort.SCAN, 3])
def test_suffix_order_and_common_prefixes(monkeypatch, scan):
    monkeypatch.setattr(suffix_sort, "SCAN", scan)
    rng = np.random.default_rng(1)
    for k in range(40):
        text = rng.integers(0, rng.integers(1, 5), rng.integers(1, 60)).astype(np.uint16)
        text = np.tile(text[:20], 4) if k % 3 == 0 else text
        cap, got, shared, t = (5, 200)[k % 2], [], [], text.tolist()
        suffix_sort.suffixes(text, 6, cap, suffix_sort.Store(0 if k % 5 else 1 << 20), lambda p, c: (got.extend(p.tolist()), shared.extend(c.tolist())))  # noqa: B023
        heads = [t[i : i + cap] for i in got]
        assert sorted(got) == list(range(len(t))) and heads == sorted(heads, reverse=True)
        assert shared[1:] == [common(a, b) for a, b in zip(heads, heads[1:], strict=False)]


def test_suffix_sort_scans_runs_and_block_ends_together(monkeypatch):
    """op6_suffix_dedup: neither a round of a long run of one symbol nor the end of a block takes a scan of its own."""
    rng = np.random.default_rng(6)
    phrase = rng.integers(97, 123, 230).astype(np.uint8).tobytes()
    runs = [bytes([97 + k]) * (300 + 40 * k) + phrase[: 20 * k] for k in range(6)]
    blocks = runs + [rng.integers(97, 123, 5).astype(np.uint8).tobytes() + phrase for _ in range(300)] + [phrase[:1]] * 900
    scans, scan = [], suffix_sort.Inducer.scan
    monkeypatch.setattr(suffix_sort.Inducer, "scan", lambda self, at, *more: scans.append(len(at)) or scan(self, at, *more))
    block, off = suffix_sort.repeated_starts(blocks, 200)
    seen = {}
    for k, b in enumerate(blocks):
        for i in range(len(b) - 199):
            seen.setdefault(b[i : i + 200], []).append((k, i))
    assert list(zip(block.tolist(), off.tolist(), strict=True)) == sorted(x for xs in seen.values() if len(xs) > 1 for x in xs)
    assert len(scans) < 600


@pytest.mark.parametrize(("width", "gram"), [(200, 32), (50, 8), (60, 60), (41, 40)])
def test_suffix_dedup_sorts_what_segments_can_share(monkeypatch, width, gram):
    """op6_suffix_dedup: strings that end with the anchor, begin with it, and lie anywhere between; all else is cut off."""
    rng = np.random.default_rng(width)
    some = lambda k: rng.integers(0, 256, k).astype(np.uint8).tobytes()
    whole, sorted_bytes, sort = width - gram, [], suffix_dedup.repeated_starts
    monkeypatch.setattr(suffix_dedup, "repeated_starts", lambda blocks, *more: sorted_bytes.append(sum(map(len, blocks))) or sort(blocks, *more))
    for left in range(whole + 1):
        shared = some(width)
        raw = [some(whole - left) + shared + (b"\0" + some(left))[:left], shared + (b"\1" + some(left))[:left], some(whole + width)]
        payload = [at.to_bytes(2, "little") + x for at, x in zip((whole, left, whole), raw, strict=True)]
        batch = pa.RecordBatch.from_pydict({"a": [7] * 3, "s": [1, 2, 3], "payload": payload})
        (out,) = suffix_dedup.sort_shards(width, gram, 1 << 20, 1 << 20)([batch])
        assert [tuple(r.values()) for r in out.to_pylist()] == [(7, 1, whole - left, 1), (7, 2, 0, 1)]
        assert sorted_bytes[-1] <= 2 * (width + whole // 5 + 2)


def test_suffix_sort_of_a_shard_far_larger_than_its_memory():
    """The store has a twentieth of the shard; nearly all of the tuples, text and tables go through files."""
    rng = np.random.default_rng(4)
    letters = rng.integers(97, 101, 20_000).astype(np.uint8).tobytes()
    blocks = [letters[a : a + 300] for a in range(0, 19_000, 290)] + [letters[a : a + 260] for a in range(37, 19_000, 1900)]
    size = sum(map(len, blocks))
    store = suffix_sort.Store(size // 20)
    block, off = suffix_sort.repeated_starts(blocks, 200, store)
    assert store.spilled > 20 * size and store.held <= size // 20
    seen = {}
    for k, b in enumerate(blocks):
        for i in range(len(b) - 199):
            seen.setdefault(b[i : i + 200], []).append((k, i))
    assert list(zip(block.tolist(), off.tolist(), strict=True)) == sorted(x for xs in seen.values() if len(xs) > 1 for x in xs)


def test_equal_windows_lie_in_segments_of_equal_anchor():
    rng = np.random.default_rng(2)
    code = rng.integers(0, 3, 4000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    doc = np.repeat(np.arange(40), 100)
    first, last, anchor, _ = segments(Prefix(code), doc, 9, 3)
    of = {i: anchor[k] for k in range(len(first)) for i in range(first[k], last[k] + 1)}
    seen = {}
    for i in range(len(code) - 8):
        if doc[i] == doc[i + 8]:
            assert seen.setdefault(code[i : i + 9].tobytes(), of[i]) == of[i]
    assert len(of) == 40 * 92


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") & 1] for k in range(n))


def test_texts_that_collide_under_polynomial_hashes(spark):
    """Words and lines of Thue-Morse sequences and of their complements: equal under any polynomial modulo 2**64."""
    one = thue_morse(4096)
    other = one.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"w{k}" for k in range(30))
    rows_ = [(1, f"{one} {tail[:60]}"), (2, f"{other} {tail[:60]}"), (3, f"{one}\n{other}\n{tail}"), (4, " ".join([one, other] * 9)), (5, " ".join([other, one] * 9))]
    df = spark.createDataFrame(rows_, "doc_id long, text string")
    assert rows(quality_rules.quality_rules(df), "doc_id", *quality_rules.MEASURES, "base_failed", "kept") == sorted((d, *brute.rules(t)) for d, t in rows_)
    assert rows(substring_dedup.substring_dedup(df), "doc_id", "n_words", "n_removed", "kept_text") == sorted(brute.windows13(rows_))
    assert rows(minhash.near_duplicates(df), "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.near(rows_))
    assert rows(line_dedup.line_dedup(df, least=1), "doc_id", "n_lines", "n_removed", "kept_text") == sorted(brute.lines(rows_, least=1))
    assert rows(suffix_dedup.suffix_dedup(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept") == sorted(brute.strings200(rows_))


def test_stretches_have_codes_of_their_own():
    rng = np.random.default_rng(6)
    data = np.frombuffer(rng.integers(0, 3, 5000).astype(np.uint8).tobytes(), np.uint8)
    start = np.sort(rng.choice(5000, 900, replace=False))
    end = np.append(start[1:], 5000)
    code = stretch_codes(data, start, end).tolist()
    told = {}
    for c, a, b in zip(code, start.tolist(), end.tolist(), strict=True):
        assert told.setdefault(data[a:b].tobytes(), c) == c
    assert len(set(told.values())) == len(told)


def test_line_dedup(docs, nothing):
    out = line_dedup.line_dedup(docs)
    assert rows(out, "doc_id", "n_lines", "n_removed", "kept_text") == sorted(brute.lines(ROWS), key=repr)
    assert line_dedup.line_dedup(nothing).count() == 0


def test_line_dedup_of_rows_in_any_order(spark):
    """A set that comes first further down its stretch of rows."""
    near = [" ".join(f"a{k}" if k != j else "z" for k in range(12)) for j in range(3)]
    rows_ = [(9, near[0]), (5, near[1]), (3, near[0]), (7, near[2]), (4, near[2])]
    out = line_dedup.line_dedup(spark.createDataFrame(rows_, "doc_id long, text string").coalesce(1))
    assert rows(out, "doc_id", "n_lines", "n_removed", "kept_text") == sorted(brute.lines(rows_))


def test_line_dedup_second_round(spark):
    """Lines whose best candidate fails while another one holds."""
    import random

    rng = random.Random(3)
    base = [f"k{i}" for i in range(30)]
    texts = []
    for _ in range(150):
        w = rng.sample(base, rng.randint(8, 13))
        texts.append(" ".join(w))
    rows_ = [(k, t) for k, t in enumerate(texts)]
    out = line_dedup.line_dedup(spark.createDataFrame(rows_, "doc_id long, text string"), percent=60)
    assert rows(out, "doc_id", "n_lines", "n_removed", "kept_text") == sorted(brute.lines(rows_, 60), key=repr)


def test_line_dedup_query_takes_lines_of_any_length(spark, tmp_path):
    """Copies of short lines and of lines without spaces, and four words of five."""
    texts = ["All rights reserved.\nintro", "x\nAll rights reserved.", "日本語の長い一行です。\nintro", "日本語の長い一行です。\n\n \nx x", "p q r s\np q r", "p q r s t\nr q p\np q z", "p q r s"]
    rows_ = [(k, t) for k, t in enumerate(texts)] + [(100 + r[0], r[1]) for r in ROWS if r[0] is not None]
    spark.createDataFrame(rows_, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = [(d, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, kept in brute.lines(rows_, least=1)]
    assert sum(w[2] for w in want if w[0] < 100) == 7
    assert rows(queries.op7_line_dedup(spark, str(tmp_path)), "doc_id", "n_lines", "n_removed", "kept_sha256") == sorted(want, key=repr)


class Places:
    """Stands for a broadcast Bloom filter that holds just these keys."""

    def __init__(self, keys):
        self.value, self.keys = self, keys

    def might_hold(self, keys):
        return np.isin(keys, self.keys)


def test_only_lines_asked_for_are_hashed(monkeypatch):
    """The index and the fetched sets take one line of a hundred; the words of the others are not hashed or sorted."""
    texts = ["\n".join(" ".join(f"w{d}x{j}x{k}" for k in range(10)) for j in range(50)) for d in (4, 7)]
    texts = [texts[0], None, "", " \n", texts[1]]
    ids = [4, 5, 6, 8, 7]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts), pa.array([1, 1, 1, 1, 1])], ["doc_id", "text", "of"])
    places, hashed = Places(line_dedup.place_keys(np.array([7]), np.array([31]))), []
    monkeypatch.setattr(line_dedup, "word_codes", lambda data, begin, end: hashed.append(len(begin)) or stretch_codes(data, begin, end))
    counts = Places(None)
    counts.value = np.ones(1 << line_dedup.LOG_SLOTS, np.uint32)
    entries = line_dedup.unpacked([raw for out in line_dedup._index(counts, 80, 4, 1, places)([batch]) for raw in out.column("entries").to_pylist()])
    assert hashed == [10] and set(zip(entries["doc"].tolist(), entries["line"].tolist())) == {(7, 31)} and len(entries["pos"]) == 3
    sets = [row for out in line_dedup._sets(places, Places(np.array([1], np.uint64)), 4)([batch]) for row in out.to_pylist()]
    assert hashed == [10, 10] and len(sets) == 1 and sets[0]["c"] == entries["c"][0] and len(sets[0]["members"]) == 80


def test_words_of_one_slot_need_no_second_sort(monkeypatch):
    """Words whose counts differ by slot only: rarest first by one packed sort, though some share a slot."""
    data = np.frombuffer(" ".join(f"word{k}" for k in range(6000)).encode(), np.uint8)
    counts = np.random.default_rng(8).permutation(1 << line_dedup.LOG_SLOTS).astype(np.uint32)
    calls, sort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: calls.append(len(keys)) or sort(keys))
    lines = line_dedup.Lines(data, np.array([0, len(data)]), counts)
    slot = line_dedup._slot(lines.word)
    assert not calls and len(lines.word) == 6000 > len(np.unique(slot))
    assert (np.diff(counts[slot].astype(np.int64)) >= 0).all()


def test_order_of_index_lists():
    rng = np.random.default_rng(9)
    word = rng.integers(0, 1 << 63, 40, dtype=np.uint64)[rng.integers(0, 40, 500)]
    for doc in (rng.integers(-9, 9, 500), rng.integers(-(1 << 62), 1 << 62, 500)):
        line = rng.integers(0, 1 << 31, 500).astype(np.int32)
        for w in (word, word >> np.uint64(58)):  # the latter differ in lower bits only
            assert (line_dedup.listed_order(w, doc, line) == np.lexsort((line, doc, w))).all()
    empty = np.zeros(0, np.int64)
    assert len(line_dedup.listed_order(empty.view(np.uint64), empty, empty.astype(np.int32))) == 0


def index_of(texts, percent):
    """Packed index entries of one bucket."""
    counts, every = Places(None), Places(None)
    counts.value, every.might_hold = np.ones(1 << line_dedup.LOG_SLOTS, np.uint32), lambda keys: np.ones(len(keys), bool)
    index = line_dedup._index(counts, percent, 2, 1, every)
    batches = (pa.RecordBatch.from_arrays([pa.array([k]), pa.array([t])], ["doc_id", "text"]) for k, t in enumerate(texts))
    return [raw for out in index(batches) for raw in out.column("entries").to_pylist()]


def join_of(rows_, percent):
    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(rows_)), pa.array(rows_)], ["bucket", "entries"])
    out = [row for part in line_dedup._join(percent)([batch]) for row in part.to_pylist()]
    return [r for r in out if r["x"] is not None], [r for r in out if r["x"] is None]


def test_lists_seen_to_the_end_are_not_written():
    """A line that has held all earlier ones of its lists has no more candidates, whatever stands before the one it found."""
    data = np.frombuffer(" ".join(f"w{k:02}" for k in range(40)).encode(), np.uint8)
    code = stretch_codes(data, np.arange(0, 160, 4), np.arange(3, 163, 4))
    rare, *other = [f"w{k:02}" for k in np.argsort(code & np.uint64((1 << 20) - 1))]  # rarest first where all counts are the same
    texts = [" ".join([rare, *other[k : k + 4]]) for k in range(0, 32, 4)] + [" ".join([rare, *other[32:35]]), " ".join([rare, *other[32:36]])]
    pairs, rest = join_of(index_of(texts, 80), 80)
    assert len(pairs) == 1 and not pairs[0]["more"] and not rest


def test_index_entries_are_gathered_before_they_are_packed():
    """Many small stretches of text make one row for each bucket, not one each."""
    texts = [" ".join(f"w{k}x{j}" for j in range(9)) for k in range(50)]
    (raw,) = index_of(texts, 80)
    e = line_dedup.unpacked([raw])
    assert len(e["word"]) == 100 and set(e["doc"].tolist()) == set(range(50)) and set(e["n"].tolist()) == {9}
    half = {k: v[:50] for k, v in e.items()}, {k: v[50:] for k, v in e.items()}
    out = line_dedup.packed(list(half), 7)
    assert len(out) == 7 and out.column("bucket").to_pylist() == list(range(7))
    for bucket, raw in zip(*(c.to_pylist() for c in out.columns), strict=True):
        own = mix(e["word"]) % np.uint64(7) == bucket
        assert all((line_dedup.unpacked([raw])[k] == v[own]).all() for k, v in e.items())


def test_first_lines_of_sets(spark):
    """Copies in one stretch do not travel; of what does, the first place of a set is told over borders of batches, and rows
    that are repeated as a whole are no copies."""
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in ([3, 1, 3, 2], ["a b c d\ne f g h", "e f g h\nb a c d\nd c b a", "a b c d\ne f g h", "i j k l"], [30, 10, 30, 20])], ["doc_id", "text", "th"])
    told = [r for out in line_dedup._survey(1)([batch]) for r in out.to_pylist() if r["slice"] is None]
    travel = [(r["doc_id"], r["line"]) for r in told if r["c"] is not None]
    assert sorted(travel) == [(1, 0), (1, 1), (2, 0)] and len(told) == 8
    rows_ = [(5, 6, 1, 0, 1), (5, 6, 1, 0, 1), (5, 6, 2, 0, 1), (5, 7, 1, 0, 1), (5, 7, 1, 0, 2), (5, 7, 1, 3, 1), (8, 7, 1, 0, 1), (8, 7, 1, 0, 1)]
    names = ["c", "d", "doc_id", "line", "th"]
    for step in (1, 2, 3, 8):
        batches = (pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows_[k : k + step], strict=True)], names) for k in range(0, 8, step))
        out = [tuple(r[k] for k in [*names, "first"]) for b in line_dedup._mark(batches) for r in b.to_pylist()]
        assert out == [(5, 6, 1, 0, 1, True), (5, 6, 2, 0, 1, False), (5, 7, 1, 0, 1, True), (5, 7, 1, 0, 2, False), (5, 7, 1, 3, 1, False), (8, 7, 1, 0, 1, True)]
    texts = [(2, "a b c d\nx y z w"), (1, "x y z w"), (2, "a b c d\nx y z w"), (3, "a b c d")]
    for parts in (1, 4):
        out = line_dedup.line_dedup(spark.createDataFrame(texts, "doc_id long, text string").repartition(parts), least=1)
        assert rows(out, "doc_id", "n_lines", "n_removed", "kept_text") == sorted(brute.lines(texts, least=1))


def plain_candidates(e, percent):
    """All pairs of a list, one at a time; those of a later line end with the two likely ones or TRIES."""
    out, cut = [], set()
    maps = [a | b << 64 for a, b in zip(e["m0"].tolist(), e["m1"].tolist(), strict=True)]
    word, n, pos = (e[k].tolist() for k in ("word", "n", "pos"))
    for a in range(len(word)):
        tries, b = 0, a - 1
        while b >= 0 and word[b] == word[a] and tries < line_dedup.TRIES:
            need = -(-percent * (n[a] + n[b]) // (100 + percent))
            apart, room = (maps[a] ^ maps[b]).bit_count(), n[a] + n[b] - 2 * need
            if 100 * min(n[a], n[b]) >= percent * max(n[a], n[b]) and min(pos[a], pos[b]) + min(n[a] - pos[a], n[b] - pos[b]) >= need and apart <= room:
                out.append((a, b, 1000 * apart // max(room, 1)))
                tries += line_dedup.STRONG if 2 * apart <= room else 1
            b -= 1
        if tries >= line_dedup.TRIES and b >= 0 and word[b] == word[a]:
            cut.add(a)
    return sorted(out), cut


@pytest.mark.parametrize("percent", [60, 80, 100])
def test_candidates_of_long_and_short_lists(percent):
    """Whole lists at a time and, once most lines have left, single places give what one pair at a time gives."""
    rng = np.random.default_rng(11)
    base = [f"k{k}" for k in range(30)]
    texts = [" ".join(rng.choice(base, rng.integers(2, 14), replace=False)) for _ in range(300)]
    texts += [" ".join([*base[:20], *(f"c{x}" for x in rng.integers(0, 9, 2))]) for _ in range(200)]
    rows_ = index_of(texts, percent)
    e = line_dedup.listed(line_dedup.unpacked(rows_))
    a, b, score, cut = line_dedup.candidates(e, percent)
    want, early = plain_candidates(e, percent)
    assert sorted(zip(a.tolist(), b.tolist(), score.tolist(), strict=True)) == want and set(np.flatnonzero(cut).tolist()) == early
    assert bool(early) == (percent < 100)
    every = Places(None)
    every.value, every.might_hold = every, lambda keys: np.ones(len(keys), bool)
    pairs, rest = join_of(rows_, percent)
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rest], pa.binary()) for k in ("entries", "pairs")], ["entries", "pairs"])
    given = {(r["x"], r["y"]) for r in pairs} | {(r["x"], r["y"]) for out in line_dedup._all(percent, every)([batch]) for r in out.to_pylist()}
    a, b, _, _ = line_dedup.candidates(e, percent, every.might_hold)
    assert given == set(zip(e["c"][a].tolist(), e["c"][b].tolist(), strict=True))
    one = e["c"][len(e["c"]) // 2]
    a1, b1, _, _ = line_dedup.candidates(e, percent, lambda c: c == one)
    assert sorted(zip(a1.tolist(), b1.tolist(), strict=True)) == sorted((x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if e["c"][x] == one)


def test_shared_words():
    rng = np.random.default_rng(10)
    sets = [[set(rng.integers(0, 30, rng.integers(1, 25)).tolist()) for _ in range(200)] for _ in "ab"]
    a, b = (pa.array([np.array(sorted(x), np.uint64).tobytes() for x in side]) for side in sets)
    want = [(len(x), len(y), len(x & y)) for x, y in zip(*sets, strict=True)]
    assert list(zip(*(v.tolist() for v in line_dedup.shared(a, b)), strict=True)) == want
    assert [len(v) for v in line_dedup.shared(a[:0], b[:0])] == [0, 0, 0]


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(docs, nothing, percent):
    out = minhash.near_duplicates(docs, percent)
    want = [(d, n, c, k) for d, n, c, k in brute.near(ROWS, percent)]
    assert rows(out, "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=repr)
    if percent == 80:
        assert minhash.near_duplicates(nothing).count() == 0
        kept = minhash.keep_representatives(docs)
        assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted({d for d, _, _, k in want if k}, key=repr)


def test_chains_of_near_copies_are_one_component(spark):
    """A chain whose ends are unlike, and a large group of copies with one word changed each."""
    base = [f"v{i}" for i in range(120)]
    chain = []
    for k in range(14):
        chain.append(" ".join(base))
        base[k * 7] = f"new{k}"
    hub = [f"h{i}" for i in range(90)]
    star = []
    for k in range(150):
        w = list(hub)
        w[k % 90] = f"z{k}"
        star.append(" ".join(w))
    rows_ = [(k, t) for k, t in enumerate([*chain, *star, " ".join(hub)])]
    out = minhash.near_duplicates(spark.createDataFrame(rows_, "doc_id long, text string"), 85)
    assert rows(out, "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.near(rows_, 85), key=repr)


def test_bits_estimate_similarity():
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 2**63, 1200, dtype=np.uint64))[:1000]
    for shared in (1000, 900, 700, 100):
        b = np.sort(np.concatenate((a[:shared], rng.integers(0, 2**63, 1000 - shared, dtype=np.uint64))))
        packed, _ = minhash.sketches(np.concatenate((a, b)), np.array([0, 1000, 2000]))
        assert abs(minhash.estimate(packed[0], packed[1:])[0] - shared / (2000 - shared)) < minhash.MARGIN


def test_mixing(docs, nothing):
    out = mixing.mix_report(docs, block=8)
    got = [r.asDict() for r in out.collect()]
    assert sorted((r["doc_id"], r["size"]) for r in got if r["doc_id"] is not None) == sorted((r[0], len(brute.words(r[1]))) for r in ROWS if r[0] is not None)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert rows(out, *out.columns) == rows(mixing.mix_report(docs.repartition(3), block=8), *out.columns)
    by = {}
    for r in got:
        by.setdefault((r["source_size"], r["target"]), [0, 0])[0] += r["taken"]
    assert all(abs(t - target) <= max(16, 0.02 * target) for (_, target), (t, _) in by.items())
    assert mixing.mix_report(nothing).count() == 0


def test_words_taken_by_a_mix_one_by_one(spark, docs):
    """taken, target and sizes recomputed plainly: every slot of every shard, word by word."""
    block, by = 8, {}
    for r in {(r[0], r[1], r[3]) for r in ROWS if r[0] is not None}:
        by.setdefault(r[2], []).append((r[0], len(brute.words(r[1]))))
    names = sorted(by, key=lambda x: (x is None, x or ""))
    words_of = [[d for d, n in sorted(by[name]) for _ in range(n)] for name in names]
    size, weight = [len(w) for w in words_of], [k % 3 + 1 for k in range(len(names))]
    goal, full = [0.0] * len(names), set()
    while len(full) < len(names):
        rest = sum(size) - sum(3 * size[k] for k in full)
        share = {k: rest * weight[k] / sum(weight[j] for j in range(len(names)) if j not in full) for k in range(len(names)) if k not in full}
        over = {k for k, x in share.items() if x > 3 * size[k]}
        if not over:
            break
        full |= over
    for k in range(len(names)):
        goal[k] = 3.0 * size[k] if k in full else share[k]
    blocks = [-(-n // block) for n in size]
    quota = np.array([min(round(g * b / n), 3 * b) if n else 0 for g, b, n in zip(goal, blocks, size, strict=True)])
    plan, taken = mixing.Plan(quota, np.maximum(1, blocks), 1), {}
    for _, first, count in plan.draws(np.arange(plan.shards)):
        for s in range(len(names)):
            for slot in range(int(first[s]), int(first[s] + count[s])):
                epoch, i = divmod(slot, blocks[s])
                key = mix(np.array([epoch * len(names) + s + 1], np.uint64))
                at = int(mixing.permuted(np.array([i]), np.array([blocks[s]]), key)[0])
                for d in words_of[s][at * block : (at + 1) * block]:
                    taken[d] = taken.get(d, 0) + 1
    told = {d: (n, size[k], round(goal[k], 6), taken.get(d, 0)) for k, name in enumerate(names) for d, n in by[name]}
    rows_ = sorted({(r[0], r[1], r[3]) for r in ROWS if r[0] is not None}, key=repr)
    got = mixing.mix_report(spark.createDataFrame(rows_, "doc_id long, text string, source string"), block=block).collect()
    assert {r.doc_id: (r["size"], r.source_size, round(r.target, 6), r.taken) for r in got} == told


def test_repeated_rows_of_a_mix_count_once(spark):
    rows_ = [(k % 4, " ".join(f"w{k % 4}{i}" for i in range(30)), "a", k) for k in range(12)] + [(None, "x y z", None, 1), (None, "x y z", None, 2), (7, None, "a", 3)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, source string, th int")
    one = df.dropDuplicates(["doc_id", "text", "source"])
    assert rows(mixing.mix_documents(df, block=4), "doc_id", "text", "source") == rows(mixing.mix_documents(one, block=4), "doc_id", "text", "source")


def test_multinomial_draws_stay_in_the_quota():
    rng = np.random.default_rng(0)
    quota = np.array([500, 3, 0, 90_000_000_000])
    got = np.array([mixing.multinomial(rng, quota, 10_000) for _ in range(200)])
    assert (got.sum(axis=1) == 10_000).all() and (got <= quota).all() and got[:, 3].min() > 9_990
    even = np.array([mixing.multinomial(rng, np.array([10_000, 30_000]), 1000)[0] for _ in range(500)])
    assert abs(even.mean() - 250) < 3 and 10 < even.std() < 18  # a multinomial's is 13.7
    assert mixing.multinomial(rng, quota[:3], 503).tolist() == [500, 3, 0]


def test_mixed_documents(docs, nothing):
    taken = {}
    for r in mixing.mix_report(docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), block=8).collect():
        taken[r.doc_id] = r.taken
    out = mixing.mix_documents(docs.filter("doc_id IS NOT NULL"), block=8).collect()
    have, text = dict.fromkeys(taken, 0), {r[0]: r[1] for r in ROWS}
    for r in out:
        have[r.doc_id] += len(brute.words(r.text))
        assert r.n_chars == len(r.text) and not set(brute.words(r.text)) - set(brute.words(text[r.doc_id]))
    assert have == taken
    assert mixing.mix_documents(nothing).count() == 0


def test_targets():
    t = mixing.targets(np.array([100, 100, 10, 0]), np.array([1.0, 1.0, 2.0, 3.0]))
    assert np.allclose(t, [90, 90, 30, 0]) and np.allclose(mixing.targets(np.array([5]), np.array([1.0])), [5])
    assert mixing.targets(np.zeros(2, int), np.array([1.0, 2.0])).tolist() == [0, 0]


def test_permutations():
    for n in (1, 2, 3, 17, 1000):
        i = np.arange(n)
        p = mixing.permuted(i, np.full(n, n), np.full(n, 99, np.uint64))
        assert sorted(p.tolist()) == i.tolist()


def test_draws_meet_the_quota():
    plan = mixing.Plan(np.array([5000, 1, 0, 1700]), np.array([2000, 1, 1, 1700]), 3)
    draws = list(plan.draws(np.arange(plan.shards)))
    assert sum(q for _, _, q in draws).tolist() == plan.quota.tolist()
    assert [int(q.sum()) for _, _, q in sorted(draws, key=lambda d: d[0])] == [mixing.SHARD] * (plan.shards - 1) + [plan.slots - mixing.SHARD * (plan.shards - 1)]
    alone = [d for k in range(plan.shards) for d in plan.draws(np.array([k]))]
    assert [(a, b.tolist(), c.tolist()) for a, b, c in sorted(draws, key=lambda d: d[0])] == [(a, b.tolist(), c.tolist()) for a, b, c in alone]


def test_quality_classifier(spark, docs, nothing):
    data = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    out = quality_classifier.quality_scores(documents, labels)
    told = out.join(labels, "doc_id").filter("held_out").select("quality", "predicted").collect()
    assert out.count() == documents.count() and sum(r.quality == r.predicted for r in told) >= 0.95 * len(told)
    few = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    got = quality_classifier.quality_scores(docs, few).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert quality_classifier.quality_scores(nothing, few).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_classifier.quality_scores(docs, none).collect()} == {0.5}


def test_scores_are_those_of_a_walk_down_every_tree(spark):
    """The query's scores, tree by tree and node by node, and labels with columns of clashing names."""
    data = "/root/testdata/sf0.001"
    documents, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    made = []
    fit = quality_classifier.fit
    quality_classifier.fit = lambda *a: made.append(fit(*a)) or made[-1]
    try:
        out = {r.doc_id: r for r in quality_classifier.quality_scores(documents, labels.selectExpr("*", "1 as x", "'t' as text", "2.0 as score", "3 as held_out")).collect()}
    finally:
        quality_classifier.fit = fit
    forest = made[0]
    assert len(out) == documents.count() and len(forest.leaf) > 10
    for r in documents.collect():
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        x = quality_classifier.statistics(Stretch(raw, np.array([0, len(raw)])))[0]
        margin = forest.start
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if x[feature[node]] > threshold[node] else 1)
            margin += leaf[node - len(feature)]
        assert abs(out[r.doc_id].score - 1 / (1 + np.exp(-margin))) < 1e-8 and out[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_documents_longer_than_a_stretch(spark):
    """Texts of over a megabyte with repeats inside and across, held against the plain versions by parts that can be told."""
    rng = np.random.default_rng(12)
    unit = [" ".join(f"{x:05x}" for x in rng.integers(0, 1 << 20, 12)) for _ in range(15_000)]
    long = "\n".join(unit)
    rows_ = [(1, long), (2, "\n".join(unit[4000:4003]) + " tail of it"), (3, long + "\nlast one line of five"), (4, None), (5, "")]
    assert len(long) > 2 * CHUNK
    df = spark.createDataFrame(rows_, "doc_id long, text string")
    assert rows(quality_rules.quality_rules(df), "doc_id", *quality_rules.MEASURES, "base_failed", "kept") == sorted((d, *brute.rules(t)) for d, t in rows_)
    assert rows(substring_dedup.substring_dedup(df), "doc_id", "n_words", "n_removed", "kept_text") == sorted(brute.windows13(rows_))
    assert rows(line_dedup.line_dedup(df, least=1), "doc_id", "n_removed") == [(1, 0), (2, 3), (3, 15_000), (4, 0), (5, 0)]
    assert rows(minhash.near_duplicates(df), "doc_id", "component_id") == [(1, 1), (2, 2), (3, 1), (4, 4), (5, 5)]
    size = len(long)
    assert rows(suffix_dedup.suffix_dedup(df), "doc_id", "n_bytes", "n_removed") == [(1, size, size), (2, 226, 215), (3, size + 22, size), (4, 0, 0), (5, 0, 0)]


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    f = quality_classifier.fit(x[:2000], y[:2000])
    assert ((f.score(x[2000:]) >= 0.5) == (y[2000:] > 0)).mean() > 0.97
