"""Plain statements of what the operators compute, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substring_dedup(docs, window=20):
    """docs: (doc_id, text) with distinct ids. {doc_id: (n_words, n_removed, kept_sha256)}"""
    seen, out = set(), {}
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is None, d[0])):
        ws, cut = words(text), set()
        for i in range(len(ws) - window + 1):
            w = tuple(ws[i : i + window])
            if w in seen:
                cut.update(range(i, i + window))
            seen.add(w)
        out[doc_id] = (len(ws), len(cut), sha(" ".join(w for i, w in enumerate(ws) if i not in cut)))
    return out


def shingle_set(text, n=5):
    ws = words(text)
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} or {tuple(ws)}


def similar_pairs(sets, threshold=0.8):
    """sets: key -> set. Pairs of keys with a Jaccard similarity of threshold or more, by an inverted index."""
    index = {}
    for k, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(k)
    keys, pairs = list(sets), set()
    for k in keys:
        common = {}
        for x in sets[k]:
            for o in index[x]:
                if o > k:
                    common[o] = common.get(o, 0) + 1
        pairs |= {(k, o) for o, c in common.items() if c >= threshold * (len(sets[k]) + len(sets[o]) - c)}
    return pairs


def groups(keys, pairs):
    """Each key's least key among those that chains of pairs lead to."""
    up = {k: k for k in keys}

    def root(k):
        while up[k] != k:
            up[k] = k = up[up[k]]
        return k

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {k: root(k) for k in keys}


def line_dedup(docs, shingle=9, threshold=0.8):
    """docs: (doc_id, text). {doc_id: removed line numbers}"""
    first, all_lines = {}, []
    for doc_id, text in sorted(docs):
        for i, x in enumerate((text or "").split("\n")):
            if words(x):
                all_lines.append((doc_id, i, x))
                first.setdefault(x, (doc_id, i))
    sets = {first[x]: ({x[i : i + shingle] for i in range(len(x) - shingle + 1)} or {x}) for x in first}
    comp = groups(sets, similar_pairs(sets, threshold))
    out = {doc_id: [] for doc_id, _ in docs}
    for doc_id, i, x in all_lines:
        if comp[first[x]] != (doc_id, i):
            out[doc_id].append(i)
    return out


def quality_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"""
    text, ws = text or "", words(text)
    windows, seen = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)], {}
    for i, w in enumerate(windows):
        seen.setdefault(w, []).append(i)
    covered = {p + k for places in seen.values() if len(places) > 1 for p in places for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    failed = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def targets(sizes, weights=(5, 2, 1), cap=3):
    """sizes: source -> size. Source -> target, capped shares reshared by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, held, out = sum(sizes.values()), {}, {}
    while True:
        free = [s for s in order if s not in held]
        rest = total - sum(held.values())
        whole = sum(weight[s] for s in free)
        out = held | {s: rest * weight[s] / whole for s in free}
        above = [s for s in free if out[s] > cap * sizes[s]]
        if not above:
            return out
        held |= {s: float(cap * sizes[s]) for s in above}


def fits(rule, host, path):
    h, _, p = rule.partition("/")
    return (host == h or host.endswith("." + h)) and path.startswith("/" + p)


def url_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def matched(template, words):
    """Longest common subsequence of two lists of words: words matched, over the whole length of both."""
    row = [0] * (len(words) + 1)
    for t in template:
        new = [0]
        for j, w in enumerate(words):
            new.append(row[j] + 1 if w == t else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def vote_rate(vote, x, z):
    """How often a vote cast is this one, of objections x of which z are strong; z None: strength doesn't tell."""
    if vote >= 0:
        return 1 - x if vote else 1
    return x if z is None else x * (z if vote < -1 else 1 - z)


def label_model(rows, start, strong, weight, rounds):
    """Plain expectation-maximisation over single rows of votes. start: (share, objects), by kind."""
    share, objects = start
    n, kinds = len(rows[0]), range(len(start[0]))
    known = [weight["junk" if k else "good"] for k in kinds]
    for _ in range(rounds):
        of, (cast, bad) = [0.0 for _ in kinds], ([[0.0] * n for _ in kinds] for _ in range(2))
        for votes in rows:
            p = posterior(votes, share, objects, strong)
            for k in kinds:
                of[k] += p[k]
                for i, v in enumerate(votes):
                    cast[k][i] += p[k] * (v != 0)
                    bad[k][i] += p[k] * (v < 0)
        share = [(of[k] + weight["share"] * start[0][k]) / (len(rows) + weight["share"]) for k in kinds]
        objects = [[(bad[k][i] + known[k] * start[1][k][i]) / (cast[k][i] + known[k]) for i in range(n)] for k in kinds]
    return share, objects


def posterior(votes, share, objects, strong):
    """Of each kind."""
    p = list(share)
    for k, row in enumerate(objects):
        for v, x, z in zip(votes, row, strong[k], strict=True):
            p[k] *= vote_rate(v, x, z)
    return [x / sum(p) for x in p]


def resampled(rows, target, n=1, buckets=10_000, least=20, percent=10):
    """(doc_id, n_features, weight, score, rank) of each row, from plain counts. Ties of repeated rows go by their place."""

    def words_in(text):
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)

    def buckets_of(text):
        own = words_in(text)
        return [zlib.crc32(" ".join(own[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(own) - k + 1)]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(buckets_of(text))
    for text in target:
        t.update(buckets_of(text))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for doc_id, text in rows:
        own = buckets_of(text)
        weight = sum(map(gain, own)) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_in(text))])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = place
    return [tuple(r[:5]) for r in out]


def vector_codes(rows, parts=4, entries=256, rounds=4):
    """((vec_id, code, error) of each row, digest of the codebooks): plain loops over all distances."""
    whole = sorted(((n, [math.floor(1024 * x) for x in v]) for n, v, _ in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-len(whole[0][1]) // parts)
    cut = [(n, [(v + [0] * (width * parts - len(v)))[p * width : (p + 1) * width] for p in range(parts)]) for n, v in whole]
    books = [[v[p] for _, v in cut[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            of = [near(v[p], books[p])[1] for _, v in cut]
            for i in range(len(books[p])):
                own = [v[p] for (_, v), e in zip(cut, of, strict=True) if e == i]
                if own:
                    books[p][i] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    codes = [(n, [near(v[p], books[p]) for p in range(parts)]) for n, v in cut]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return [(n, "".join(f"{i:02x}" for _, i in own), sum(d for d, _ in own)) for n, own in codes], digest
