"""Plain restatements of the contracts, to hold the operators against."""

import collections
import hashlib
import math
import re
import zlib

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = re.compile("[A-Z]")


def low(text):
    return UPPER.sub(lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def op1(texts, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = ITEM_WORD.findall(low(text))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].update([] if item is None else [str(item)])
    out = []
    for text in texts:
        w, hit, ids = ITEM_WORD.findall(low(text)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    ids |= windows[tuple(w[k : k + n])]
        out.append((len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)))
    return out


def luhn(digits):
    return sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def op4(text):
    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, hit):
        digits = re.sub("[^0-9]", "", hit)
        return kind == "email" or kind == "ip" and all(int(p) <= 255 for p in hit.split(".")) or kind == "card" and 16 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, r in rules.items() for m in re.finditer(r, text or "") if good(k, m[0])]


def op6(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    inside = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w))


def op7(rows):
    """rows: (doc_id, text); per row (n_tokens, n_known, train_tokens, base_score)."""
    spelt = [(i, [*WORD.findall(low(t)), ""]) for i, t in rows]
    counts = collections.Counter()
    for i, w in spelt:
        if fold(i, 7) != 2:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    return [(len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) for _, w in spelt]


def fingerprint(text):
    w = WORD.findall(low(text))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, radius=2):
    """Smallest index reachable, for a list of fingerprints."""
    root = list(range(len(values)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(values))]


def op10(text):
    assign = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    spans = [(m.start(), 0, m.end(), "assign") for m in re.finditer(assign, text or "") if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 32]
    return [(k, a, b) for a, _, b, k in sorted(spans)]


def class_contexts(words, k, node):
    """Keys of a token's bit: no word, the word before, the two words before."""
    before = [words[k - j] if k >= j else None for j in (1, 2)]
    return [(node,), (node, before[0]), (node, *before)]


def class_counts(texts, bits):
    """[zeros, ones] by key over the class bits of all texts, the empty end included."""
    counts = collections.defaultdict(lambda: [0, 0])
    for t in texts:
        words = [*t.split(), b""]
        for k, w in enumerate(words):
            label = zlib.crc32(w) >> (32 - bits)
            for b in range(bits):
                for key in class_contexts(words, k, (label | 1 << bits) >> (bits - b)):
                    counts[key][label >> (bits - 1 - b) & 1] += 1
    return counts


def op2(rows, ends_of, least):
    """rows: (doc_id, digest, text); the repeated runs of chunks, by plain counting."""
    order = lambda i: (i is not None, i or 0)
    cut = {}
    for i, d, t in rows:
        if t:
            data = t.encode()
            ends = ends_of(data)
            cut[i, d] = [(data[a:b], len(data[:a].decode()), len(data[:b].decode())) for a, b in zip([0, *ends], ends, strict=False)]
    places = collections.defaultdict(list)
    for (i, d), own in cut.items():
        for c, a, _ in own:
            places[c].append((order(i), d, a, i))
    out = []
    for (i, d), own in cut.items():
        runs = []  # [start, end, n_docs, first, stays]
        for c, a, b in own:
            docs = {(x[0], x[1]) for x in places[c]}
            if len(docs) < 2:
                continue
            first = min(places[c])
            stays = (first[0], first[1], first[2]) == (order(i), d, a)
            if runs and runs[-1][1] == a and runs[-1][4] == stays:
                runs[-1][1], runs[-1][2] = b, max(runs[-1][2], len(docs))
                runs[-1][3] = min((x for x in (runs[-1][3], first[3]) if x is not None), default=None)
            else:
                runs.append([a, b, len(docs), first[3], stays])
        for r in runs:
            a, b = r[0], r[1]
            for x in reversed([x for x in runs if x[1] <= r[0]]):
                a = x[0] if x[1] == a else a
            for x in [x for x in runs if x[0] >= r[1]]:
                b = x[1] if x[0] == b else b
            if b - a >= least:
                out.append((i, d, *r))
    return out


def path_score(scores, path, switch):
    return sum(s[p] for s, p in zip(scores, path, strict=True)) - switch * sum(a != b for a, b in zip(path, path[1:], strict=False))


def viterbi(scores, switch):
    """The score of the best path."""
    v = None
    for s in scores:
        v = list(s) if v is None else [max(max(v) - switch, u) + x for u, x in zip(v, s, strict=True)]
    return max(v) if v else 0.0


class PrefixTree:
    """Unmerged counts: how often each prefix is passed, and each word ends."""

    def __init__(self, words):
        self.visits = collections.Counter(w[:k] for w in words for k in range(len(w) + 1))
        self.ends = collections.Counter(words)

    def score(self, word):
        steps = [math.log((self.visits[word[: k + 1]] + 0.5) / (self.visits[word[:k]] + 1)) for k in range(len(word))]
        return (sum(steps) + math.log((self.ends[word] + 0.5) / (self.visits[word] + 1))) / (len(word) + 1)


def op5(text, templates, least):
    """(units, names, best coefficient): every line, paragraph and anchored window against every template."""
    plain = lambda t: re.sub("[^a-z0-9]+", " ", t.lower()).split()
    grams = lambda w: collections.Counter(zip(w, w[1:], strict=False))
    sized = [(n, v, plain(t)) for n, v, t in templates]

    def dice(w, t):
        a, b = grams(w), grams(t)
        return 2 * sum((a & b).values()) / (len(w) + len(t) - 2)

    def matches(w, own):
        found = {}
        for n, v, t in own:
            d = dice(w, t)
            have = {" ".join(w[k : k + 2]) for k in range(len(w) - 1)}
            if d >= least and all(x in have for x in v.split(",") if x):
                found[n.split("-")[0]] = min(found.get(n.split("-")[0], (0, "")), (-d, n))
        return [(n, -d) for d, n in found.values()]

    text = text or ""
    units = [plain(x) for x in text.split("\n")] + [plain(p) for p in re.split(r"\n[\x20\t\r]*\n", text) if "\n" in p]
    units = [w for w in units if len(w) > 1]
    hits = [m for w in units for m in matches(w, sized)]
    every = plain(text)
    for n, v, t in sized:
        for k in range(len(every) - 1):
            if every[k : k + 2] == t[:2] and len(every) - k >= len(t) * least / (2 - least):
                hits += [m for m in matches(every[k : k + len(t)], [(n, v, t)]) if m[0] == n]
    return len(units), ",".join(sorted({n for n, _ in hits})), round(max([d for _, d in hits], default=0.0), 9)


def op4_ids(texts, rounds, support, confident, shortest):
    """By text the (start, end) of tokens that plain bootstrapping adds to the base spans."""
    low_words = lambda t: [(m.start(), m.end(), m[0].lower()) for m in WORD.finditer(t or "")]
    rows = []  # (text, start, end, instance, seed, patterns)
    for n, t in enumerate(texts):
        w = low_words(t)

        def around(first, after, w=w):
            left, two, right = (w[first - 1][2] if first else None), (w[first - 2][2] + " " + w[first - 1][2] if first > 1 else None), (w[after][2] if after < len(w) else None)
            return [(k, c) for k, c in (("l", left), ("b", two), ("r", right)) if c is not None]

        for k, (a, b, x) in enumerate(w):
            if re.search("[0-9]", x):
                rows.append((n, a, b, x, bool(op4(t[a:b])), around(k, k + 1)))
        for _, a, b in op4(t):
            if re.search(r"[\x20\x09-\x0D]", t[a:b]) or not re.search("[0-9]", t[a:b]):
                rows.append((n, a, b, t[a:b].lower(), True, around(sum(x[1] <= a for x in w), sum(x[0] < b for x in w))))
    seen, seeds = collections.Counter(), {}
    for *_, x, seed, patterns in rows:
        for p in patterns:
            seen[p, x] += 1
            seeds[p, x] = seeds.get((p, x), False) or seed
    score = {e: float(s) for e, s in seeds.items()}
    for _ in range(rounds):
        total, right, kinds = collections.Counter(), collections.Counter(), collections.Counter()
        for (p, x), n in seen.items():
            total[p] += n
            right[p] += n * score[p, x]
            kinds[p] += 1
        sure = {p: right[p] / (total[p] + 1) for p in total if kinds[p] >= support}
        best = collections.defaultdict(float)
        for p, x in seen:
            if not seeds[p, x] and p in sure:
                best[x] = max(best[x], sure[p])
        score = {e: 1.0 if s else best[e[1]] for e, s in seeds.items()}
    good = {p for p, c in sure.items() if c >= confident}
    out = [set() for _ in texts]
    for n, a, b, _, seed, patterns in rows:
        if not seed and b - a >= shortest and good & set(patterns) and not any(s < b and a < e for _, s, e in op4(texts[n])):
            out[n].add((a, b))
    return out
