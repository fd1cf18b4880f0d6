"""Plain versions of the operators, for small fixtures."""

import hashlib
import re
from collections import defaultdict

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def decontaminate(docs, items, window=10):
    wins = defaultdict(set)
    for i, text in items:
        w = item_words(text)
        for s in range(max(len(w) - window, 0) + 1 if w else 0):
            wins[tuple(w[s : s + window])].add(str(i))
    lens = {len(w) for w in wins}
    out = {}
    for d, text in docs:
        w = item_words(text)
        hit, found = set(), set()
        for n in lens:
            for s in range(len(w) - n + 1):
                got = wins.get(tuple(w[s : s + n]))
                if got:
                    hit |= set(range(s, s + n))
                    found |= got
        names = sorted(found)
        out[d] = (len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit))
    return out


def suffix(texts, length=200):
    seen = defaultdict(int)
    raws = [(t or "").encode() for t in texts]
    for b in raws:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] += 1
    out = []
    for b in raws:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k, 0) + 1)} if w else set()


def components(ids, pairs):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {i: top(i) for i in ids}


def near(docs, percent=85):
    sets = {d: shingles(t) for d, t in docs}
    ids = sorted(sets)
    linked = [
        (a, b) for n, a in enumerate(ids) for b in ids[n + 1 :]
        if sets[a] and sets[b] and 100 * (i := len(sets[a] & sets[b])) >= percent * (len(sets[a]) + len(sets[b]) - i)
    ]
    comp = components(ids, linked)
    return {d: (len(sets[d]), comp[d], comp[d] == d) for d in ids}


#: Fixed values of the contract.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def licenses(text):
    w = item_words(text)
    at, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def line_sets(text, k=5):
    return {text[i : i + k] for i in range(max(len(text) - k, 0) + 1)}


def lines(docs, percent=80, least=1):
    where = defaultdict(list)
    for d, text in docs:
        for n, raw in enumerate((text or "").split("\n")):
            line = raw.strip(" \t\r\f\v")
            if len(line) >= least:
                where[line].append((d, n))
    names = sorted(where)
    sets = {x: line_sets(x) for x in names}
    linked = [(a, b) for n, a in enumerate(names) for b in names[n + 1 :] if 100 * (i := len(sets[a] & sets[b])) >= percent * (len(sets[a]) + len(sets[b]) - i)]
    comp = components(names, linked)
    groups = defaultdict(list)
    for x in names:
        groups[comp[x]] += where[x]
    removed = defaultdict(set)
    for places in groups.values():
        for d, n in set(places) - {min(places)}:
            removed[d].add(n)
    return {d: sorted(removed[d]) for d, _ in docs}
