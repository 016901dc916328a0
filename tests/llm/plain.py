"""Plain versions of the operators' results, for small inputs."""

import hashlib
import re
from collections import Counter

SPACED, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def near_groups(docs, n=5, percent=80):
    sets = {}
    for key, text in docs.items():
        w = SPACED.findall(lower(text))
        sets[key] = {tuple(w[i: i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    group = {k: k for k in sets}
    moved = True
    while moved:
        moved = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * len(sets[a] | sets[b]) and group[b] < group[a]:
                    group[a], moved = group[b], True
    return {k: (len(sets[k]), group[k]) for k in sets}


def cut_repeats(docs, length=100):
    seen, out = set(), {}
    for key in sorted(docs):
        data = (docs[key] or "").encode()
        gone = [False] * len(data)
        for at in range(len(data) - length + 1):
            part = data[at: at + length]
            if part in seen:
                gone[at: at + length] = [True] * length
            seen.add(part)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[key] = (len(data), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


def hits(docs, items, window=13):
    known = {}
    for item, text in items:
        w = ALNUM.findall(lower(text))
        for s in range(max(1, len(w) - window + 1) if w else 0):
            known.setdefault(tuple(w[s: s + window]), set()).add("" if item is None else str(item))
    out = []
    for key, text in docs:
        w, found = ALNUM.findall(lower(text)), set()
        hit = [False] * len(w)
        for n in {len(k) for k in known}:
            for s in range(len(w) - n + 1):
                if tuple(w[s: s + n]) in known:
                    hit[s: s + n] = [True] * n
                    found |= known[tuple(w[s: s + n])]
        out.append((key, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return out


def word_counts(texts):
    return Counter(w for t in texts for w in [*SPACED.findall(lower(t)), None])
