"""Plain versions of the operators on lists, for tests. They share no code with the operators."""

import hashlib
import math
import re
import unicodedata
import zlib

SPACE = " \t\n\x0b\x0c\r"


def words(text):
    return [w for w in re.split("[ \t\n\x0b\x0c\r]+", text or "") if w]


def lower(text):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")


def patience_pairs(a, b):
    """Equal head and tail, then the longest chain of elements that both have once, then what lies between."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0)] + [(i + 1, j + 1) for i, j in patience_pairs(a[1:], b[1:])]
    if a[-1] == b[-1]:
        return patience_pairs(a[:-1], b[:-1]) + [(len(a) - 1, len(b) - 1)]
    once = [(i, b.index(x)) for i, x in enumerate(a) if a.count(x) == 1 == b.count(x)]
    best = []  # the longest chain that ends with each
    for k, (_, j) in enumerate(once):
        chain = max((best[m] for m in range(k) if once[m][1] < j), key=len, default=[])
        best.append([*chain, once[k]])
    out, i0, j0 = [], 0, 0
    for i, j in [*max(best, key=len, default=[]), (None, None)]:
        if i is None and not best:
            break
        out += [(x + i0, y + j0) for x, y in patience_pairs(a[i0:i], b[j0:j])]
        if i is not None:
            out.append((i, j))
            i0, j0 = i + 1, j + 1
    return out


def lines_left(docs, min_words=8):
    """{key: (lines deleted, text)} of (key, text): each shortest run of a document is aligned with those of the first earlier document
    that has it."""
    split = {k: [(i, x.strip(SPACE)) for i, x in enumerate((t or "").split("\n")) if x.strip(SPACE)] for k, t in docs}
    runs = {}
    for k, lines in split.items():
        n = [len(words(x)) for _, x in lines]
        found = set()
        for i in range(len(lines)):
            found |= {(i, j) for j in [next((j for j in range(i + 1, len(lines) + 1) if sum(n[i:j]) >= min_words), None)] if j}
            found |= {(j, i + 1) for j in [next((j for j in range(i, -1, -1) if sum(n[j : i + 1]) >= min_words), None)] if j is not None}
        runs[k] = [(i, tuple(x for _, x in lines[i:j])) for i, j in sorted(found)]
    first = {}
    for k in sorted(runs):
        for _, run in runs[k]:
            first.setdefault(run, k)
    out = {}
    for k, t in docs:
        gone = set()
        for owner in {first[run] for _, run in runs[k]} - {k}:
            own = [(i, run) for i, run in runs[k] if first[run] == owner]
            other = [run for _, run in runs[owner] if any(run == x for _, x in own)]
            pairs = dict(patience_pairs([run for _, run in own], other))
            free = [j for j in range(len(other)) if j not in pairs.values()]
            for i, (_, run) in enumerate(own):
                j = next((j for j in free if other[j] == run), None)
                if i not in pairs and j is not None:
                    free.remove(j)
                    pairs[i] = j
            gone |= {split[k][own[i][0] + m][0] for i in pairs for m in range(len(own[i][1]))}
        out[k] = (len(gone), t if not gone else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone))
    return out


def shingle_sets(docs, size=5):
    out = {}
    for k, t in docs:
        w = words(lower(t))
        out[k] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}
    return out


def components(keys, linked):
    """{key: smallest key reachable} over pairs that ``linked`` tells."""
    root = {k: k for k in keys}
    for a in sorted(keys):
        for b in sorted(keys):
            if a < b and root[a] != root[b] and linked(a, b):
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


def near_copies(docs):
    sets = shingle_sets(docs)
    return components(list(sets), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))


def passes_rules(text):
    t = text or ""
    w = words(t)
    chars = sum(map(len, w))
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    repeated = len({i + k for v in seen.values() if len(v) > 1 for i in v for k in range(3)})
    some = [x for x in t.split("\n") if words(x)]
    capitals = sum(unicodedata.category(c) == "Lu" for c in t)
    return not (
        len(w) < 50 or 100 * repeated > 50 * len(w) or 100 * len(re.findall("[#*$%&|<>]", t)) > 8 * chars or 100 * (len(some) - len(set(some))) > 70 * len(some)
        or 100 * capitals > 50 * chars or chars < 2 * len(w) or chars > 15 * len(w)
    )


def poisson_copies(rows, weights, seed=42):
    """{place in rows: copies} of (key, source, text)."""
    size = {}
    for _, s, t in rows:
        if s in weights:
            size[s] = size.get(s, 0) + len((t or "").encode())
    size = {s: b for s, b in size.items() if b}
    total, share = sum(size.values()), sum(weights[s] for s in size)
    out = {}
    for i, (key, s, _) in enumerate(rows):
        rate = total * weights[s] / share / size[s] if s in size else 1.0
        u = (int(hashlib.md5(f"{seed}|{'null' if key is None else key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        n, term = 0, math.exp(-rate)
        reached = term
        while reached < u:
            n += 1
            term *= rate / n
            reached += term
        out[i] = n
    return out


def piece_rows(key, ids, length=2048):
    """(key, piece, start, length, crc) of a document's ids, the end id included."""
    first = len(ids) % length or length
    cuts = [(0, first)] + [(i, i + length) for i in range(first, len(ids), length)]
    return [(key, k, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))) for k, (a, b) in enumerate(cuts)]


def best(vectors, k):
    """[(query, rank, id, score)] of (id, vector), each distinct row with an id divisible by 20 a query of its own."""
    out = []
    for q, v in sorted({(i, tuple(v)) for i, v in vectors if i % 20 == 0}):
        found = sorted((-sum(x * y for x, y in zip(v, w)), i) for i, w in vectors if i != q and len(w) == len(v))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return out


def reputation(outcomes, hosts, z=1.645, low=2.0, high=1000.0):
    """{host: (mean, upper bound)} of (host, good), for ``hosts``; domains are two labels, suffixes one."""
    domain, suffix = (lambda h: ".".join(h.split(".")[-2:])), (lambda h: h.split(".")[-1])
    count = {}
    for h, good in outcomes:
        for level, name in enumerate((h, domain(h), suffix(h), "")):
            n, k = count.get((level, name), (0, 0))
            count[level, name] = n + 1, k + good
    n, k = count[3, ""]
    mean = {(3, ""): (k + 1) / (n + 2)}
    strength = {}
    for level, up in ((2, lambda x: ""), (1, suffix), (0, domain)):
        units = {x: c for (lv, x), c in count.items() if lv == level}
        v = sum(n * ((k / n - (m := mean[level + 1, up(x)])) ** 2 - m * (1 - m) / n) for x, (n, k) in units.items()) / sum(n for n, _ in units.values())
        c = sum(n * (m := mean[level + 1, up(x)]) * (1 - m) for x, (n, _) in units.items()) / sum(n for n, _ in units.values())
        strength[level] = s = min(high, max(low, (c - v) / v)) if v > 0 else high
        mean |= {(level, x): (k + s * mean[level + 1, up(x)]) / (n + s) for x, (n, k) in units.items()}
    out = {}
    for h in hosts:
        level, name = next((lv, x) for lv, x in enumerate((h, domain(h), suffix(h), "")) if (lv, x) in mean)
        spread = 1 / (count[0, h][0] + strength[0] + 1) if level == 0 else 1 / (strength[0] + 1)
        for lv in range(1, level):
            spread = 1 / (strength[lv] + 1) + strength[lv] / (strength[lv] + 1) * spread
        m = mean[level, name]
        out[h] = m, min(1.0, m + z * math.sqrt(m * (1 - m) * spread))
    return out


def repaired(rows):
    """(blank, duplicate, truncated, illegal, cost, audit, repaired lines) of a conversation's (role, text) in order, by trying all
    edits at every place."""
    faults, seen = [], set()
    for role, text in rows:
        t = text.strip(SPACE)
        faults.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {"": "su", "s": "u", "u": "a", "a": "u"}  # the initial before, and those that may follow
    known = {}

    def best(i, last, inserted):
        """(cost, audit, lines) of the rest; no more than three rows in a row are inserted."""
        if (i, last, inserted) not in known:
            ways = [(0, "", ())] if i == len(rows) and last in ("", "a") else []

            def add(letter, cost, line, rest):
                ways.append((cost + rest[0], letter + rest[1], (*line, *rest[2])))

            if inserted < 3:
                for role in ("user", "assistant"):
                    if role[0] in after[last]:
                        add("I", 2, [f"{role}:"], best(i, role[0], inserted + 1))
            if i < len(rows):
                (role, text), fault = rows[i], faults[i]
                add("D", 3, [], best(i + 1, last, 0))
                if fault not in ("blank", "duplicate"):
                    more = fault == "truncated"
                    if role[:1] and role[:1] in after[last]:
                        add("K", more, [f"{role}:{text}"], best(i + 1, role[0], 0))
                    for other in ("user", "assistant"):
                        if other[0] in after[last]:
                            add("R", 2 + more, [f"{other}:{text}"], best(i + 1, other[0], 0))
            known[i, last, inserted] = min(ways) if ways else (1 << 30, "", ())
        return known[i, last, inserted]

    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(rows, rows[1:]))
    return (*(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, *best(0, "", 0))


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def merkle(leaves, fan):
    """(root, [proof of each leaf]) of digests in order; a proof is [(before, after), ...] from the leaf up."""
    level, proofs, above = leaves, [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for leaf, at in enumerate(above):
            run = at // fan * fan
            proofs[leaf].append((level[run:at], level[at + 1 : run + fan]))
            above[leaf] = at // fan
        level = [sha(*level[i : i + fan]) for i in range(0, len(level), fan)]
    return level[0], proofs
