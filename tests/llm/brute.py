"""Plain single-machine versions, written apart from the operators."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P


def token_lists(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def bpe(texts):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for x in texts:
        ids = e.encode_ordinary(x or "")
        out.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()))
    return out


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def near(docs):
    """{doc_id: (n_shingles, component_id)} for {doc_id: text}."""
    sets = {i: shingle_set(t) for i, t in docs.items()}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    parent = {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, s in sets.items():
        shared = Counter(j for x in s for j in where[x] if j < i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in docs}


def repeats(docs, width):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256)}: bytes under a width-byte string that starts twice or more."""
    raw = {i: (t or "").encode() for i, t in docs.items()}
    seen = Counter(r[k : k + width] for r in raw.values() for k in range(len(r) - width + 1))
    out = {}
    for i, r in raw.items():
        gone = np.zeros(len(r) + 1, int)
        for k in range(len(r) - width + 1):
            if seen[r[k : k + width]] > 1:
                gone[k] += 1
                gone[k + width] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(r) else 0
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out[i] = (len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def neighbours(vectors, k=10):
    """{query: [(id, score)]} for {id: vector or None}, queries are ids divisible by 100."""
    good = {}
    for i, v in vectors.items():
        if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, float)
    out = {}
    for q in good:
        if q % 100 == 0:
            d = sorted((float(np.sqrt(((good[q] - x) ** 2).sum())), i) for i, x in good.items() if i != q)
            out[q] = [(i, s) for s, i in d[:k]]
    return out


class KneserNey:
    """Interpolated modified Kneser-Ney over bytes; each text follows order - 1 bytes with the value 2."""

    def __init__(self, texts, order):
        self.order = order
        self.counts = {order: Counter(g for t in texts for g in self.grams(t))}
        for n in range(order - 1, 0, -1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])  # how many n-grams one longer end in it
        self.discount, self.total, self.left = {}, defaultdict(int), defaultdict(float)
        for n, found in self.counts.items():
            of = Counter(found.values())
            y = of[1] / (of[1] + 2 * of[2]) if of[1] + of[2] else 0
            self.discount[n] = [max(0.05, min(k - 0.05, k - (k + 1) * y * of[k + 1] / of[k] if of[k] else 0.5 * k)) for k in (1, 2, 3)]
            for g, c in found.items():
                self.total[g[:-1]] += c
                self.left[g[:-1]] += self.discount[n][min(c, 3) - 1]

    def grams(self, text):
        raw = bytes([2]) * (self.order - 1) + text.encode()
        return [raw[i : i + self.order] for i in range(len(raw) - self.order + 1)]

    def p(self, gram):
        if not gram:
            return 1 / 256
        context, c = gram[:-1], self.counts[len(gram)][gram]
        if not self.total[context]:
            return self.p(gram[1:])
        own = c - self.discount[len(gram)][min(c, 3) - 1] if c else 0
        return (own + self.left[context] * self.p(gram[1:])) / self.total[context]

    def perplexity(self, text):
        found = [np.log(self.p(g)) for g in self.grams(text)]
        return float(np.exp(-np.mean(found)))
