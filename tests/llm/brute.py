"""Plain Python versions of the operators' contracts."""

import hashlib
import re
from collections import Counter, defaultdict

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def dedup(rows, n=20):
    """{doc_id: (n_words, n_removed, kept_sha256)}"""
    words = {d: SPACE_WORD.findall(t or "") for d, t in rows}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - n + 1):
            first.setdefault(tuple(words[d][i : i + n]), (d, i))
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < (d, i):
                gone.update(range(i, i + n))
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def contamination(rows, items, size=13):
    """{doc_id: (n_words, n_hit, items)}"""
    wins = defaultdict(set)
    for i, t in items:
        w = TERM.findall(lower(t or ""))
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[k : k + n])].add(str(i))
    out = {}
    for d, t in rows:
        w, hit, names = TERM.findall(lower(t or "")), set(), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                if found := wins.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    names |= found
        out[d] = (len(w), len(hit), sorted(names))
    return out


def components(rows):
    """{doc_id: (n_shingles, component_id)}"""
    sets = {}
    for d, t in rows:
        w = SPACE_WORD.findall(lower(t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    holders, parent = defaultdict(list), {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for d in sorted(sets):
        shared = Counter(e for s in sets[d] for e in holders[s])
        for e, k in shared.items():
            if 100 * k >= 75 * (len(sets[d]) + len(sets[e]) - k):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
        for s in sets[d]:
            holders[s].append(d)
    return {d: (len(sets[d]), root(d)) for d in sets}


def fill(amount: float, weights: list, room: list) -> list[float]:
    """Divides an amount by weight; what exceeds a child's room goes to the others. Weight 0 takes nothing."""
    out, open_, left = [0.0] * len(weights), [i for i, w in enumerate(weights) if w > 0], float(amount)
    while open_ and left > 0:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total >= room[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = room[i]
        left -= sum(room[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def allocate(supply: dict, budget: float, weights: dict, epochs: int, levels=("domain", "lang", "source")) -> dict:
    """Whole tokens for each leaf (a path of labels). A label without a weight weighs 1."""
    out: dict = {}

    def descend(leaves: dict, amount: float, depth: int) -> None:
        if depth == len(levels):
            out.update({path: int(amount + 1e-6) for path in leaves})
            return
        children: dict[str, dict] = {}
        for path, n in sorted(leaves.items()):
            children.setdefault(path[depth], {})[path] = n
        shares = fill(amount, [weights.get(levels[depth], {}).get(c, 1.0) for c in children], [epochs * sum(x.values()) for x in children.values()])
        for child, share in zip(children.values(), shares, strict=True):
            descend(child, share, depth + 1)

    descend(dict(supply), min(budget, epochs * sum(supply.values())), 0)
    return out
