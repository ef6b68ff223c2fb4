"""Plain versions of the operators, for small inputs."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict


def repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        left = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(d), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def shingle_set(text, k=5):
    w = re.findall(r"\w+", (text or "").lower())
    if not w:
        return frozenset()
    k = min(k, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def classes(rows, threshold):
    """(doc_id, class_id, n_copies, n_links) of (doc_id, text)."""
    texts = defaultdict(list)
    for d, t in rows:
        texts[t or ""].append(d)
    names = list(texts)
    sets = [shingle_set(t) for t in names]
    root = list(range(len(names)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(names)
    for i in range(len(names)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and shared >= threshold * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, t in enumerate(names):
        least[find(i)] += [d for d in texts[t] if d is not None]
    place = {t: i for i, t in enumerate(names)}
    return sorted(((d, min(least[find(place[t or ""])], default=None), len(texts[t or ""]), links[place[t or ""]]) for d, t in rows), key=str)


def quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    rep = set()
    for i in range(len(w) - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            rep.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    longest, covered = 0, set()
    for i in range(len(w)):
        for j in range(i):
            n = 0
            while i + n < len(w) and w[i + n] == w[j + n]:
                n += 1
            longest = max(longest, n)
            if n >= 10:
                covered.update(range(i, i + n))
                covered.update(range(j, j + n))
    failed = len(w) < 10 or 100 * len(rep) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep), failed, len(covered), longest


def sha1_base32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
