"""Plain versions of the operators, for small tables."""

import hashlib
import re

import xxhash

LAST = 2**63 - 1
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return ALNUM.findall(lower(t))


class Groups:
    def __init__(self, n):
        self.root = list(range(n))

    def find(self, x):
        while self.root[x] != x:
            x = self.root[x]
        return x

    def join(self, a, b):
        self.root[self.find(a)] = self.find(b)


def cut_repeats(rows, size=50):
    """Per row: the mask of removed bytes."""
    ent = [(LAST if i is None else i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in ent:
        for k in range(len(b) - size + 1):
            s = b[k : k + size]
            least[s] = min(least.get(s, LAST), i)
    out = []
    for i, b in ent:
        m = [False] * len(b)
        for k in range(len(b) - size + 1):
            if least[b[k : k + size]] < i:
                m[k : k + size] = [True] * size
        out.append(m)
    return out


def repeats(rows):
    out = []
    for (i, t), m in zip(rows, cut_repeats(rows), strict=True):
        b = (t or "").encode()
        kept = bytes(x for x, gone in zip(b, m, strict=True) if not gone)
        runs = sum(1 for k, gone in enumerate(m) if gone and (k == 0 or not m[k - 1]))
        out.append((i, len(b), sum(m), runs, hashlib.sha256(kept).hexdigest()))
    return out


def fingerprint(t):
    w = SOLID.findall(lower(t))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_copies(rows):
    """(doc_id, fingerprint, component_id) of each row."""
    fps = [fingerprint(t) for _, t in rows]
    g = Groups(len(rows))
    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and (fps[a] ^ fps[b]).bit_count() <= 3:
                g.join(a, b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[g.find(k)] = min(least.get(g.find(k), LAST), i)
    return [(i, f"{fps[k]:016x}", None if i is None else least[g.find(k)]) for k, (i, _) in enumerate(rows)]


def leaks(docs, items, window=10):
    """Per row: words, hit flags and items."""
    wins = {}
    for i, t in items:
        w = words(t)
        if w:
            n = min(window, len(w))
            for k in range(len(w) - n + 1):
                wins.setdefault(tuple(w[k : k + n]), set()).add(None if i is None else str(i))
    out = []
    for _, t in docs:
        w = words(t)
        hit, found = [False] * len(w), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                got = wins.get(tuple(w[k : k + n]))
                if got:
                    hit[k : k + n] = [True] * n
                    found |= got
        out.append((w, hit, found - {None}))
    return out


WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def paragraphs_of(b):
    """Lists of (start, end) of the words of each paragraph, and all words' spans."""
    low = lower(b.decode()).encode()
    spans = [(m.start(), m.end()) for m in WORD.finditer(low)]
    lines, at = [], 0
    for line in low.split(b"\n"):
        lines.append([k for k, (x, y) in enumerate(spans) if at <= x < at + len(line)])
        at += len(line) + 1
    out, stretch = [], [[]]

    def flush():
        runs = []
        for run in [r for r in stretch if r]:
            if len(run) < 5 and runs:
                runs[-1] = runs[-1] + run
            else:
                runs.append(run)
        if len(runs) > 1 and len(runs[0]) < 5:
            runs[:2] = [runs[0] + runs[1]]
        out.extend(runs)
        stretch[:] = [[]]

    for line in lines:
        if len(line) >= 20:
            flush()
            out.append(line)
        elif line:
            stretch[-1] += line
        else:
            stretch.append([])
    flush()
    return [p for p in out if len(p) >= 5 or len(p) == len(spans)], spans


def cuts_of(ws):
    """Words that are smallest among four neighbours to both sides, by the operator's hash."""
    import numpy as np

    from graphloom.llm.arrays import mix, rolling
    from graphloom.llm.paragraphs import SEED

    r = rolling(SEED)
    h = np.array([r.of(r.prefix(np.frombuffer(w, np.uint8)), np.array([0]), np.array([len(w)]))[0] for w in ws], np.uint64)
    pair = [int(v) for v in mix(h[:-1] * np.uint64(31) + h[1:])] + [2**64 - 1] if len(h) else []
    return [k for k in range(5, len(pair) - 5) if pair[k] == min(pair[k - 4 : k + 5])]


def paragraph_cuts(rows, inner=True):
    """(doc_id, n_paragraphs, n_bytes, n_removed, n_spans, kept_sha256, component_id) of each row."""
    ps, pieces, texts = [], {}, []
    for r, (i, t) in enumerate(rows):
        b = (t or "").encode()
        who = LAST if i is None else i
        low = lower(t).encode()
        if inner:
            found, spans = paragraphs_of(b)
        else:
            _, spans = paragraphs_of(b)
            starts = [0, *(k + 1 for k, c in enumerate(b) if c == 10), len(b) + 1]
            found = [p for x, y in zip(starts, starts[1:]) if len(p := [k for k, s in enumerate(spans) if x <= s[0] < y]) >= 20]
        ws = [low[x:y] for x, y in spans]
        texts.append((b, spans, ws, len(found)))
        ps += [(who, r, p[0], len(p), frozenset(tuple(ws[k : k + 5]) for k in range(p[0], p[0] + max(1, len(p) - 4)) if k + 5 <= p[0] + len(p) or len(p) < 5)) for p in found]
        if inner:
            c = cuts_of(ws)
            for x, y in zip(c, c[2:]):
                if y - x >= 10:
                    pieces.setdefault(tuple(ws[x:y]), []).append((who, xxhash.xxh64_intdigest(b, 42) - (1 << 64) * (xxhash.xxh64_intdigest(b, 42) >> 63), x, r))
    g = Groups(len(ps))
    for a in range(len(ps)):
        for b in range(a):
            if len(ps[a][4] & ps[b][4]) >= 0.8 * len(ps[a][4] | ps[b][4]):
                g.join(a, b)
    least = {}
    for k, p in enumerate(ps):
        least[g.find(k)] = min(least.get(g.find(k), LAST + 1), p[0])
    gone = [(p[1], p[2], p[3], least[g.find(k)]) for k, p in enumerate(ps) if p[0] > least[g.find(k)]]
    for key, at in pieces.items():
        who, _, x, r = min(at)
        for w, _, y, q in at:
            if w > who:
                mine, other = texts[q][2], texts[r][2]
                left = right = 0
                while left < 14 and min(x, y) > left and mine[y - left - 1] == other[x - left - 1]:
                    left += 1
                n = len(key)
                while right < 14 and y + n + right < len(mine) and x + n + right < len(other) and mine[y + n + right] == other[x + n + right]:
                    right += 1
                gone.append((q, y - left, n + left + right, who))
    docs = Groups(0)
    docs.root = {LAST if i is None else i: LAST if i is None else i for i, _ in rows}
    masks = [[False] * len(t[0]) for t in texts]
    for r, first, n, who in gone:
        spans = texts[r][1]
        x, y = spans[first][0], spans[first + n - 1][1]
        masks[r][x:y] = [True] * (y - x)
        if rows[r][0] is not None:
            a, b = sorted((docs.find(rows[r][0]), docs.find(who)))
            docs.root[b] = a
    out = []
    for (i, _), (b, _, _, n), m in zip(rows, texts, masks, strict=True):
        kept = bytes(x for x, off in zip(b, m, strict=True) if not off)
        runs = sum(1 for k, off in enumerate(m) if off and (k == 0 or not m[k - 1]))
        out.append((i, n, len(b), sum(m), runs, hashlib.sha256(kept).hexdigest(), None if i is None else docs.find(i)))
    return out
