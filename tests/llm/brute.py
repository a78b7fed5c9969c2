"""Plain versions of the contracts, over lists of (doc_id, text)."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def repeats(rows, window=13):
    """op3: (doc_id, n_words, n_removed, kept_sha256) of every row."""
    first: dict = {}
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        w = words(text)
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def parse(rows, window=13):
    """op3's factors: {doc_id: [(start, end, source)]} of rows with distinct ids."""
    first: dict = {}
    texts = {i: words(text) for i, text in rows if i is not None}
    for i in sorted(texts):
        for k in range(len(texts[i]) - window + 1):
            first.setdefault(tuple(texts[i][k : k + window]), (i, k))
    out = {}
    for i, w in texts.items():
        source = {k: place for k in range(len(w) - window + 1) if (place := first[tuple(w[k : k + window])])[0] < i}
        found, end = [], 0
        for k in range(len(w) - window + 1):
            if k in source and k + window > end:
                doc, at = source[k]
                last = k
                while (more := [j for j in range(last + 1, last + window + 1) if source.get(j) == (doc, at + j - k)]):
                    last = more[-1]
                end = last + window
                found.append((k, end, doc))
        out[i] = found
    return out


def tokens(rows, path):
    """op4: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    out = []
    for i, text in rows:
        ids = made.encode(text or "", add_special_tokens=False).ids
        out.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(made.decode(ids, skip_special_tokens=False))))
    return out


def fingerprint(text, shingle=3):
    w = words(lower(text))
    if not w:
        return 0
    k = min(shingle, len(w))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[a : a + k]).encode(), 42) for a in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, distance=3):
    """Root of each fingerprint of a set, over links."""
    root = {x: x for x in prints}
    order = sorted(prints)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            if (a ^ b).bit_count() <= distance and find(a) != find(b):
                root[find(b)] = find(a)
    return {x: find(x) for x in prints}


def simhash_classes(rows, shingle=3):
    """op7: (doc_id, fingerprint, component_id)."""
    prints = [(i, fingerprint(text, shingle)) for i, text in rows]
    root = classes({x for _, x in prints})
    least: dict = {}
    for i, x in prints:
        if i is not None:
            least[root[x]] = min(least.get(root[x], i), i)
    return [(i, f"{x:016x}", least.get(root[x])) for i, x in prints]


def near_classes(rows, shingle=5, least=0.8):
    """Near copies, every text against every other: {(doc_id, text): smallest doc_id of what hangs together}."""

    def sets(text):
        w = words(lower(text))
        k = min(shingle, len(w))
        return {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if w else {()}

    texts = sorted({t or "" for i, t in rows if i is not None})
    made = [sets(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for b, mine in enumerate(made):
        for a in range(b):
            low, high = sorted((len(mine), len(made[a])))
            if low >= least * high - 1e-9 and len(made[a] & mine) >= least * len(made[a] | mine) - 1e-12:
                root[find(b)] = find(a)
    of = {t: find(k) for k, t in enumerate(texts)}
    first: dict = {}
    for i, t in rows:
        if i is not None:
            first[of[t or ""]] = min(first.get(of[t or ""], i), i)
    return {(i, t or ""): first[of[t or ""]] for i, t in rows if i is not None}


PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


def licences(rows):
    """op9: (doc_id, n_words, n_base, first_word, last_word, base_labels)."""
    out = []
    for i, text in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        hits = [(k, label) for p, label in PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        out.append((i, len(w), len(hits), min((k for k, _ in hits), default=None), max((k for k, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))))
    return out


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def personal(text):
    """op10: base spans (start, kind, end)."""
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    spans += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m)) <= 15]
    return sorted(spans)


def personal_rows(rows):
    out = []
    for i, text in rows:
        spans = personal(text)
        written = ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{z}" for a, k, z in spans)
        out.append((i, *[sum(k == j for _, k, _ in spans) for j in range(4)], sha(written)))
    return out
