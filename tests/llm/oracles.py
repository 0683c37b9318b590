"""Plain, single-machine versions of the operators: what the Spark jobs must return."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import xxhash


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def bpe(docs):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for i, t in docs:
        ids = enc.encode_ordinary(t or "")
        out.append((i, len(ids), sha(" ".join(map(str, ids))), sha(t or "")))
    return out


def wavelet(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, out = 0, []
    for i, text in sorted(docs):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    return out


KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for n, c in enumerate(reversed(digits)):
        x = int(c) * (1 + n % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def valid(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 if kind == "phone" else True


def private(docs):
    out = []
    for i, t in docs:
        spans = sorted((m.start(), n, m.end(), k) for n, k in enumerate(KINDS) for m in re.finditer(PATTERNS[k], t or "") if valid(k, m[0]))
        count = Counter(s[3] for s in spans)
        out.append((i, *[count[k] for k in KINDS], sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans))))
    return out


def ascii_words(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def groups(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    return [find(x) for x in range(n)]


def simhash(docs, words=3, distance=2):
    prints = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", ascii_words(t))
        s = [" ".join(w[j : j + words]) for j in range(max(1, len(w) - words + 1))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    n = len(docs)
    g = groups(n, [(a, b) for a in range(n) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= distance])
    low = {}
    for k, r in enumerate(g):
        low[r] = min(low.get(r, docs[k][0]), docs[k][0])
    return [(docs[k][0], f"{prints[k]:016x}", low[g[k]]) for k in range(n)]


def repeats(docs, length=200):
    raw = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(b[s : s + length] for _, b in raw for s in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def lines(docs, threshold=0.8, least=5):
    """Documents in order of id; each line against all earlier ones that share a word."""
    known, by_word, out = [], defaultdict(set), []
    for i, t in sorted(docs, key=lambda d: d[0]):
        all_ = [] if t is None else t.split("\n")
        kept = []
        for line in all_:
            w = frozenset(x for x in re.split(r"[\x20\x09-\x0D]+", ascii_words(line)) if x)
            if len(w) < least:
                kept.append(line)
                continue
            meets = set().union(*[by_word[x] for x in w])
            if any(len(w & known[k]) >= threshold * len(w | known[k]) - 1e-9 for k in meets):
                same = True
            else:
                same = False
                kept.append(line)
            known.append(w)
            for x in w:
                by_word[x].add(len(known) - 1)
            del same
        out.append((i, len(all_), len(all_) - len(kept), sha("\n".join(kept))))
    return out


def top(vectors, k=10):
    import math

    kept = {i: [math.floor(1024 * float(x)) for x in v] for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in kept:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(kept[q], v, strict=True)), i) for i, v in kept.items() if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out
