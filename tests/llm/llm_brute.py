"""Plain restatements of the operators, a row at a time, for small tables."""

import hashlib
import re
from collections import Counter

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def quality_base(text):
    if not text:
        return 0, 0, 0, 0, 0
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    times = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if times[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text):
    words = WORD.findall(lower(text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def groups(rows):
    """{row number: smallest id of its group} of (doc_id, text) rows."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in members.items()}
    return [least[find(i)] for i in range(len(rows))]


def plain_secrets(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_pii(text):
    text = text or ""
    digits = lambda x: re.sub("[^0-9]", "", x)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def spans(found, kinds):
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in found)


def water(sizes, cycle=(1, 2, 3), cap=3.0):
    """Targets by source: weights share all words, what lies above the cap is shared again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > cap * sizes[s]}
        if not full:
            target.update({s: weight[s] * level for s in open_})
            break
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def without_repeats(texts, length=200):
    """(bytes, removed, spans, kept) of every text: bytes under a string of ``length`` that starts twice or more go."""
    raw = [(t or "").encode("utf-8") for t in texts]
    times = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if times[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((len(r), sum(gone), len(re.findall(b"\1+", gone)), bytes(c for c, g in zip(r, gone) if not g)))
    return out


def codes(rows, parts=16, entries=64, rounds=2, scale=256):
    """{(id, vector): (code, error)} and the codebooks of (id, vector) rows, by trying every entry."""
    import math

    rows = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))
    width = -(-max((len(v) for _, v in rows), default=1) // parts) or 1
    whole = [[math.floor(scale * x) for x in v] + [0] * (width * parts - len(v)) for _, v in rows]
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for v in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for c in cut:
                held.setdefault(near(c[p], books[p])[1], []).append(c[p])
            books[p] = [tuple(sum(x) // len(held[i]) for x in zip(*held[i])) if i in held else e for i, e in enumerate(books[p])]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    return [(r[0], "".join(f"{i:02x}" for _, i in f), sum(d for d, _ in f)) for r, f in zip(rows, found)], books


def phrases(rows, least, top, longest=5):
    """(lang, rank, phrase, a, l, r, n, score) by counting every phrase of (text, lang) rows."""
    count, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                count.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        whole = {p[i:j] for p in found for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and found[p] >= found[p[i:j]]}
        stay = []
        for p, a in found.items():
            score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if p not in whole:
                stay.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (score, a, p, left, right) in enumerate(sorted(stay)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -score))
    return out


def site_scores(rows, sway, keep):
    """(p_host, p_path, score, kept) of (host, path, p) rows: Beta priors by moments on two levels, a row at a time."""
    import math

    def odds(p):
        p = min(max(p, 1e-4), 1 - 1e-4)
        return math.log(p / (1 - p))

    def strength(groups):
        """groups: (n, good, centre)"""
        n = sum(g[0] for g in groups)
        noise = sum(c * (1 - c) for _, _, c in groups)
        spread = sum(m * (x / m - c) ** 2 for m, x, c in groups)
        within = sum(m * c * (1 - c) for m, _, c in groups)
        excess = (spread - noise) / max(n - sum(m * m for m, _, _ in groups) / n, 1)
        return min(max(within / n / excess - 1, 1), 1e4) if excess > 0 else 1e4

    hosts, paths = {}, {}
    for host, path, p in rows:
        for at, key in ((hosts, host), (paths, (host, path))):
            n, good = at.get(key, (0, 0.0))
            at[key] = n + 1, good + p
    whole = sum(p for _, _, p in rows) / len(rows)
    tau = strength([(n, good, whole) for n, good in hosts.values()])
    p_host = {h: (good + tau * whole) / (n + tau) for h, (n, good) in hosts.items()}
    tau = strength([(n, good, p_host[h]) for (h, _), (n, good) in paths.items()])
    p_path = {k: (good + tau * p_host[k[0]]) / (n + tau) for k, (n, good) in paths.items()}
    out = []
    for host, path, p in rows:
        shift = min(max(odds(p_path[host, path]) - odds(whole), -sway), sway)
        score = 1 / (1 + math.exp(-(odds(p) + shift)))
        out.append((p_host[host], p_path[host, path], score, score >= keep))
    return out
