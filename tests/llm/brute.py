"""Plain versions of the corpus operators, and a small corpus with every awkward kind of row."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th long, a long, s long, n int, size long, payload string, c long, first long, word long, score double"


def words(text):
    return WORD.findall(text or "")


def corpus(seed=7, n=60):
    """Rows of SCHEMA: copies, near copies, shared passages and lines, nulls, empties, long texts, odd characters."""
    rng = random.Random(seed)
    vocabulary = [f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{x}" for x in ("ra", "to", "lin", "gem", "sode", "ñu", "über", "的", "x", "ming", "o", "tal")] * 2
    vocabulary += [f"w{k}{rng.choice('abcdef')}" for k in range(150)]
    sentence = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k)).capitalize() + "."
    passage, line = sentence(70), sentence(14)
    texts = []
    for k in range(n):
        body = [sentence(rng.randint(4, 30)) for _ in range(rng.randint(1, 9))]
        if k % 6 == 0:
            body.insert(rng.randrange(len(body) + 1), passage)
        if k % 4 == 0:
            body.insert(rng.randrange(len(body) + 1), line)
        texts.append("\n".join(body))
    texts += [texts[3], texts[3] + " \n", texts[3].replace(" ", "\t"), texts[5]]
    for k in (8, 9, 10, 8, 8):
        w = texts[k].split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [None, "", " \t\n", "one", "one two three", "ONE two three", "a b c <|endoftext|> d\r\n\x0b\x0c e", "x " * 40, "日本語 😀 ñandú " * 9, "\n\n\n", (sentence(25) + "\n") * 3, sentence(9000), "\x00 \x1f \x7f"]
    rows = [(k, t, "en", f"s{k % 5}" if k % 11 else None, len(t or ""), 1, 2, 3, 4, 5, "p", 6, 7, 8, 0.5) for k, t in enumerate(texts)]
    rows.append(rows[12])  # a repeated row
    rows.append((None, texts[3], None, "s1", 0, *rows[0][5:]))
    return rows


def exact(rows):
    groups = defaultdict(list)
    for r in rows:
        key = hashlib.sha256((r[1] or "").translate({ord(c): None for c in SPACES}).encode()).hexdigest()
        groups[key].append((-len(r[1] or ""), r[0] is None, r[0] or 0, r[0]))
    out = []
    for key, members in groups.items():
        keep = min(members)[3]
        out += [(m[3], keep, len(members), m[3] == keep, key) for m in members]
    return out


def windows13(rows, width=13):
    rows = [(d, [w.encode() for w in words(t)]) for d, t, *_ in rows]
    first = {}
    for d, w in rows:
        for i in range(len(w) - width + 1 if d is not None else 0):
            key = tuple(w[i : i + width])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, w in rows:
        gone = set()
        for i in range(len(w) - width + 1 if d is not None else 0):
            if first[tuple(w[i : i + width])] < d:
                gone |= set(range(i, i + width))
        out.append((d, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def strings200(rows, width=200):
    raw = [(r[0], (r[1] or "").encode()) for r in rows]
    count = Counter(b[i : i + width] for _, b in raw for i in range(len(b) - width + 1))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if count[b[i : i + width]] > 1:
                gone[i : i + width] = b"\x01" * width
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def lines(rows, percent=80, least=5):
    held = []
    for d, t, *_ in sorted({(r[0], r[1]) for r in rows if r[0] is not None and r[1]}):
        for j, x in enumerate(t.split("\n")):
            s = frozenset(words(x))
            if len(s) >= least:
                held.append((d, j, s))
    first = {}
    for d, j, s in held:
        first.setdefault(s, (d, j))
    order, hit = list(first), set()
    for k, s in enumerate(order):
        if any(100 * len(s & o) >= percent * len(s | o) for o in order[:k]):
            hit.add(s)
    gone = defaultdict(set)
    for d, j, s in held:
        if s in hit or first[s] != (d, j):
            gone[d].add(j)
    out = []
    for d, t, *_ in rows:
        own = (t or "").split("\n")
        drop = gone[d] if d is not None else set()
        out.append((d, len(own), len(drop), "\n".join(x for j, x in enumerate(own) if j not in drop)))
    return out


def near(rows, percent=80, width=5):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for r in rows:
        w = words((r[1] or "").translate(lower))
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                if rows[a][0] < rows[b][0]:
                    a, b = b, a
                root[a] = b
    return [(r[0], len(s), rows[find(k)][0], r[0] == rows[find(k)][0]) for k, (r, s) in enumerate(zip(rows, sets, strict=True))]


def rules(text):
    text = text or ""
    w = words(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeated = {i + k for i in range(len(w) - 4) for k in range(5) if grams[tuple(w[i : i + 5])] > 1}
    full = [x for x in text.split("\n") if words(x)]
    chars, symbols, dup = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full))
    failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
    stutters = sum(a == b for a, b in zip(w, w[1:], strict=False))
    upper, letters = len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z]", text))
    bad = 10 * symbols > len(w) or 5 * text.count("!") > len(w) or 2 * upper > letters or 5 * stutters > len(w) or 2 * dup > len(full) or 2 * chars < 5 * len(w) or chars > 12 * len(w)
    return len(w), chars, symbols, dup, len(repeated), failed, not failed and not bad
