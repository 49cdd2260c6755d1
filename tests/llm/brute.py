"""Plain versions of the operators for small tables."""

import collections
import hashlib
import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WHITE = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def exact(rows):
    """(doc_id, keep_id, group_size, sha) per row; ids may be missing."""
    groups = collections.defaultdict(list)
    for i, text in rows:
        groups[lower(text)].append(i)
    return sorted(
        [(i, max((x for x in groups[lower(t)] if x is not None), default=None), len(groups[lower(t)]), sha(lower(t))) for i, t in rows], key=repr
    )


def lines(rows, min_chars=20, min_documents=3):
    held = collections.defaultdict(set)
    key = lambda line: lower(line.strip(WHITE))
    rank = lambda i: (i is not None, i or 0)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(i)
    out = []
    for i, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if not (len(held[key(x)]) >= min_documents and max(held[key(x)], key=rank) != i)]
        out.append((i, len(own), len(own) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=repr)


def repetition(text, min_words):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered words, longest repeat)."""
    words = WORD.findall(text or "")
    n = len(words)
    repeat = [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and words[i + k] == words[j + k]:
                k += 1
            repeat[i], repeat[j] = max(repeat[i], k), max(repeat[j], k)
    covered = lambda least: len({p for i, k in enumerate(repeat) if k >= least for p in range(i, i + k)})
    own = [line for line in (text or "").split("\n") if WORD.search(line)]
    return (
        n,
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(own) - len(set(own)),
        covered(8),
        covered(min_words),
        max(repeat, default=0),
    )


def fingerprint(text):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), seed=42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(rows, distance=4):
    """(doc_id, fingerprint, component_id) per row."""
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance:
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        known = least.get(find(k))
        least[find(k)] = i if known is None else known if i is None else min(known, i)
    return sorted([(i, format(p, "016x"), least[find(k)]) for k, ((i, _), p) in enumerate(zip(rows, prints, strict=True))], key=repr)


def boundaries(counts, buckets):
    """Least total padding over all choices of at most so many boundaries."""
    import itertools

    lengths = sorted(counts)
    best = None
    for k in range(min(buckets, len(lengths))):
        for chosen in itertools.combinations(lengths[:-1], k):
            edges = [*chosen, lengths[-1]]
            cost = sum((next(e for e in edges if e >= n) - n) * c for n, c in counts.items())
            best = cost if best is None else min(best, cost)
    return best


def perplexity(training, text, codes, order=5, n_codes=4096):
    """Interpolated modified Kneser-Ney over padded sequences, straight from its definition."""
    pad = lambda t: [0] * (order - 1) + list(codes(t))
    counts = {order: collections.Counter()}
    for t in training:
        s = pad(t)
        counts[order].update(tuple(s[i - order + 1 : i + 1]) for i in range(order - 1, len(s)))
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    discount = {}
    for k, c in counts.items():
        n = [sum(1 for v in c.values() if v == i) for i in (1, 2, 3, 4)]
        discount[k] = []
        for i in (1, 2, 3):
            if n[i - 1] and n[0]:
                d = i - (i + 1) * n[0] / (n[0] + 2 * n[1]) * n[i] / n[i - 1]
                discount[k].append(min(max(d, 0.05), i - 0.05))
            else:
                discount[k].append(0.5 * i)
    totals = {k: collections.Counter() for k in counts}
    taken = {k: collections.Counter() for k in counts}
    for k, c in counts.items():
        for g, v in c.items():
            totals[k][g[:-1]] += v
            taken[k][g[:-1]] += discount[k][min(v, 3) - 1]

    def p(g):
        k = len(g)
        below = p(g[1:]) if k > 1 else 1 / n_codes
        total = totals[k][g[:-1]]
        if not total:
            return below
        v = counts[k][g]
        share = max(v - discount[k][min(v, 3) - 1], 0) / total if v else 0
        return share + taken[k][g[:-1]] / total * below

    s = pad(text)
    logs = [np.log(p(tuple(s[i - order + 1 : i + 1]))) for i in range(order - 1, len(s))]
    return float(np.exp(-np.mean(logs))) if logs else None


def chunk_ends(text):
    """(end in bytes, words) of the chunks of a text, byte by byte."""
    from trackweave.llm import substring_dedup as sd

    data, blank = text.encode(), b" \t\n\x0b\x0c\r"

    def value(at):
        near = data[max(0, at - sd.WINDOW + 1) : at + 1]
        total = sum(int(sd.GEAR[byte]) << (len(near) - 1 - i) for i, byte in enumerate(near))
        return total * 2654435761 % 2**32

    ends, start = [], None
    for at, byte in enumerate([*data, 32]):
        if byte not in blank:
            start = at if start is None else start
        elif start is not None:
            if at - start > sd.LONG_TOKEN:
                of_character = [i for i in range(start, at - 1) if data[i + 1] >> 6 != 2]
                ends += [i for i in of_character if (value(i) >> 16) % sd.PIECE == 0]
            ends.append(at - 1)
            start = None
    values, chunks, words = [value(end) for end in ends], [], 0
    for i, end in enumerate(ends):
        words += 1
        before, after = values[max(0, i - sd.REACH) : i], values[i + 1 : i + 1 + sd.REACH]
        if i == len(ends) - 1 or (all(values[i] > v for v in before) and all(values[i] >= v for v in after)):
            chunks.append((end + 1, words))
            words = 0
    return chunks
