"""Plain versions of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(doc_id):
    return -(2**63) if doc_id is None else doc_id


def covered(docs, units, width):
    """docs: (doc_id, sequence); yields doc_id, sequence, flags of removed units."""
    first = {}
    for doc_id, seq in docs:
        for i in range(len(seq) - width + 1):
            w = units(seq[i : i + width])
            first[w] = min(first.get(w, low(doc_id)), low(doc_id))
    for doc_id, seq in docs:
        gone = [False] * len(seq)
        for i in range(len(seq) - width + 1):
            if first[units(seq[i : i + width])] < low(doc_id):
                gone[i : i + width] = [True] * width
        yield doc_id, seq, gone


def substrings(rows, width=13):
    docs = [(d, WORD.findall(t or "")) for d, t in rows]
    out = []
    for doc_id, words, gone in covered(docs, tuple, width):
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def suffixes(rows, width=50):
    docs = [(d, (t or "").encode()) for d, t in rows]
    out = []
    for doc_id, data, gone in covered(docs, bytes, width):
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def near(rows, width=4, percent=80):
    """doc_id, n_shingles, component_id, kept: sets of lower-cased word shingles, linked at a Jaccard likeness."""
    table = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for d, t in rows:
        w = WORD.findall((t or "").translate(table))
        sets.append((d, {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()))
    by = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            by[x].append(i)
    up = list(range(len(sets)))

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    tried = set()
    for i, (_, s) in enumerate(sets):
        for j in {j for x in s for j in by[x] if j < i}:
            t = sets[j][1]
            if (i, j) not in tried and 100 * len(s & t) >= percent * len(s | t):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[top(i)] = min(least.get(top(i), low(d)), low(d))
    return [(d, len(s), None if least[top(i)] == low(None) else least[top(i)], low(d) == least[top(i)]) for i, (d, s) in enumerate(sets)]


def fault(row, earlier):
    """0 sound, 1 blank, 2 duplicate, 3 truncated."""
    words = WORD.findall(row[1])
    if not words:
        return 1
    if row in earlier:
        return 2
    return 0 if words[-1][-1] in ".!?" else 3


def cheapest(rows, faults):
    """Cost, audit and remaining role:text lines of the cheapest repair, ties by audit: all ways, keeping the best of each state.

    Whole audits are compared, and ways that agree in state and number of rows read are compared by cost and audit.
    """
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}

    def better(into, state, way):
        if state not in into or way[:2] < into[state][:2]:
            into[state] = way
            return True
        return False

    def insertions(ways):
        todo = list(ways)
        while todo:
            state = todo.pop()
            cost, audit, out = ways[state]
            for role in ("user", "assistant"):
                if role[0] in follows[state] and better(ways, role[0], (cost + 2, audit + "I", (*out, f"{role}:"))):
                    todo.append(role[0])
        return ways

    for (role, text), bad in zip(rows, faults):
        plain, new = dict(best), {}
        for state, (cost, audit, out) in plain.items():
            better(new, state, (cost + 3, audit + "D", out))
        if bad in (0, 3):
            more = bad == 3
            # Insertions come from every state, as the best way to a state may differ by what follows.
            for source in plain:
                for state, (cost, audit, out) in insertions({source: plain[source]}).items():
                    if role[:1] and role[:1] in follows[state]:
                        better(new, role[:1], (cost + more, audit + "K", (*out, f"{role}:{text}")))
                    for to in ("user", "assistant"):
                        if to[0] in follows[state]:
                            better(new, to[0], (cost + 2 + more, audit + "R", (*out, f"{to}:{text}")))
        best = new
    ends = [w for source in best for state, w in insertions({source: best[source]}).items() if state in ("", "a")]
    cost, audit, out = min(ends, key=lambda w: w[:2])
    return cost, audit, list(out)


def dialogues(rows):
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 after the planted damage."""
    import zlib

    by = defaultdict(list)
    for conv, turn, role, text in rows:
        own = by[conv]
        show = lambda x: " " if x is None else str(x)
        k = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    out = []
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        pairs = [r[1:] for r in own]
        faults = [fault(r, pairs[:k]) for k, r in enumerate(pairs)]
        turns = {r[0] for r in own if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        cost, audit, left = cheapest(pairs, faults)
        out.append((conv, gaps, *(faults.count(f) for f in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return out


def mixed(data, seed=42):
    import xxhash

    return xxhash.xxh64_intdigest(data, seed)


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def fingerprints(rows, densities, subsets, rarest, commonest):
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; distinct doc_ids, texts that have lexicon terms."""
    import struct

    whole = lambda x: struct.pack("<q", x)
    low_ascii = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    terms = lambda t: {signed(mixed(w.encode())) for w in WORD.findall(t.translate(low_ascii))}
    rows = sorted((d, t or "") for d, t in rows)
    n = defaultdict(int)
    for _, t in rows:
        for x in terms(t):
            n[x] += 1
    known = {x for x, k in n.items() if max(2, rarest * len(rows)) <= k <= max(2, commonest * len(rows))}

    def values(t):
        found = []
        for density in densities:
            for _ in range(subsets):
                k, value = len(found), 42
                own = sorted(x for x in terms(t) & known if mixed(struct.pack("<i", k), mixed(whole(x))) >> 32 < int(density * 2**32))
                for x in own:
                    value = mixed(whole(x), value)
                found.append(value if own else None)
        return found

    def likeness(a, b):
        if a == b:
            return 1.0
        dense, hits, total = [], 0, 0
        for k in range(0, len(a), subsets):
            either = [(x, y) for x, y in zip(a[k : k + subsets], b[k : k + subsets]) if x is not None or y is not None]
            equal = sum(x == y for x, y in either)
            hits, total = hits + equal, total + len(either)
            if 2 * len(either) >= subsets:
                dense.append(equal / len(either))
        return max(dense) if dense else hits / max(total, 1)

    show = lambda v: ".".join("-" if x is None else f"{x:016x}" for x in v)
    out = []
    for k, (d, t) in enumerate(rows):
        then = rows[(k + 1) % len(rows)][1]
        need = len(t) // 4
        edit = t[: len(t) - need] + then[:need]
        a, b, c = values(t), values(edit), values(then)
        out.append((d, len(t), hashlib.sha256(edit.encode()).hexdigest(), show(a), show(b), likeness(a, b), likeness(a, c)))
    return out
