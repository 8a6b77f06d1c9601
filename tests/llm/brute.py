"""The contracts of the queries, in the plainest form."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def byte_repeats(rows, width=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - width + 1):
            w = b[k : k + width]
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if first[b[k : k + width]] < i:
                gone[k : k + width] = b"\1" * width
        out[i] = (i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def word_repeats(rows, width=50):
    split = {i: WORD.findall(t or "") for i, t in rows}
    first = {}
    for i, w in split.items():
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out[i] = (i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def components(rows, size=4, threshold=80):
    sets = {i: shingles(t, size) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    up[y] = x
    return {i: (i, len(sets[i]), root(i), root(i) == i) for i in sets}


def quality(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    often = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(often)


def periodic_runs(words, least_length=6, least_exponent=4):
    """(start, length, period) of all runs, by trying every period."""
    found = {}
    n = len(words)
    for q in range(1, n // least_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least_length, least_exponent * q):
                found.setdefault((i, j + q - i), q)  # smaller periods come first
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contaminated(docs, items, window=10):
    """(words, places of hit words, items with occurring windows) of each text."""
    wins = {}
    for item, text in items:
        w = ITEM_WORD.findall((text or "").translate(LOWER))
        m = min(len(w), window)
        for k in range(len(w) - m + 1 if w else 0):
            wins.setdefault(tuple(w[k : k + m]), set()).add("" if item is None else str(item))
    sizes = {len(x) for x in wins}
    out = []
    for _, text in docs:
        w = ITEM_WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if (got := wins.get(tuple(w[k : k + m]))) is not None:
                    hit |= set(range(k, k + m))
                    found |= got
        out.append((len(w), sorted(hit), len(found), sha(",".join(sorted(found, key=str.encode)))))
    return out


def trie(sequences):
    """Rows of the prefix trie of {id: [(role, text), ...]}."""
    members = {}
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    out = []
    for node, own in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        parent = min(members[node[:-1]]) if node else None
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below) for x in below)
        ends = sha(",".join(str(c) for c in sorted(own) if len(sequences[c]) == len(node)))
        out.append((min(own), len(node), parent, len(own), len(children), leaves, saved, ends))
    return sorted(out, key=lambda r: r[:2])


def rebuilt(rows):
    """{id: turns} of (conv_id, turn, role, text) rows as the query of the trie rebuilds them."""
    import zlib

    own = {}
    for c, n, role, text in rows:
        if c is not None:
            r, x = role or "", text or ""
            own.setdefault(c, []).append(((n is not None, n or 0), hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest(), (r, x)))
    own = {c: [t for _, _, t in sorted(x)] for c, x in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[: h[c]] + own[c][h[c] :] for c in own}
