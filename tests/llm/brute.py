"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def _first_documents(windows_of: dict) -> dict:
    first: dict = {}
    for doc, windows in windows_of.items():
        for w in windows:
            first[w] = min(first.get(w, doc), doc)
    return first


def substring(docs: dict[int, str | None], window: int = 13) -> set:
    words = {d: (t or "").encode().split() for d, t in docs.items()}
    at = {d: [tuple(w[i : i + window]) for i in range(len(w) - window + 1)] for d, w in words.items()}
    first, out = _first_documents(at), set()
    for d, w in words.items():
        gone = [False] * len(w)
        for i, x in enumerate(at[d]):
            if first[x] < d:
                gone[i : i + window] = [True] * window
        out.add((d, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def byte_repeats(docs: dict[int, str | None], length: int = 50) -> set:
    raw = {d: (t or "").encode() for d, t in docs.items()}
    at = {d: [r[i : i + length] for i in range(len(r) - length + 1)] for d, r in raw.items()}
    first, out = _first_documents(at), set()
    for d, r in raw.items():
        gone = bytearray(len(r))
        for i, x in enumerate(at[d]):
            if first[x] < d:
                gone[i : i + length] = b"\x01" * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.add((d, len(r), sum(gone), spans, sha(bytes(b for b, g in zip(r, gone, strict=True) if not g))))
    return out


_UPPER = {i: i + 32 for i in range(65, 91)}


def shingle_sets(docs: dict[int, str | None], width: int = 5) -> dict[int, frozenset]:
    out = {}
    for d, t in docs.items():
        w = (t or "").translate(_UPPER).encode().split()
        out[d] = frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    return out


def near(docs: dict[int, str | None], percent: int = 75, width: int = 5) -> set:
    sets = shingle_sets(docs, width)
    parent = {d: d for d in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders: dict = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    shared: dict = {}
    for ds in holders.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {(d, len(sets[d]), root(d), root(d) == d) for d in docs}


def lm_scores(docs: dict[int, str | None], good: set, mu: float = 5.0) -> dict:
    from collections import Counter
    from math import log

    tokens = {d: (t or "").translate(_UPPER).encode().split() for d, t in docs.items()}
    models = []
    for own in (good, set(docs)):
        c, c2 = Counter(), Counter()
        for d in own & set(docs):
            w = tokens[d]
            c.update(w)
            if w:
                c[None] += 1
            c2.update(zip([None, *w], w))
        models.append((c, c2, sum(c.values()), own))
    v = len(models[1][0])
    out = {}
    for d, w in tokens.items():
        losses = []
        for c, c2, n, own in models:
            less = d in own
            total = 0.0
            for x, y in zip([None, *w], w):
                u = (c[y] - less + 1) / (n - less + v)
                total -= log((c2[x, y] - less + mu * u) / (c[x] - less + mu))
            losses.append(total / len(w) if w else None)
        out[d] = (len(w), losses[0], losses[1], losses[0] - losses[1] if w else None)
    return out


_PAD = " \t\n\v\f\r"


def lines(docs: dict[int, str | None], at_least: int) -> set:
    split = {d: (t or "").split("\n") for d, t in docs.items()}
    key = lambda line: line.strip(_PAD).translate(_UPPER)
    holders: dict = {}
    for d, ls in split.items():
        for k in {key(x) for x in ls} - {""}:
            holders[k] = holders.get(k, 0) + 1
    out = set()
    for d, ls in split.items():
        kept = [x for x in ls if holders.get(key(x), 0) < at_least]
        out.add((d, len(ls), len(ls) - len(kept), sha("\n".join(kept).encode())))
    return out


def first_lines(docs: dict[int, str | None]) -> set:
    seen, out = set(), set()
    for d in sorted(docs):
        ls, kept = (docs[d] or "").split("\n"), []
        for x in ls:
            k = x.strip(_PAD).translate(_UPPER)
            if not k or k not in seen:
                kept.append(x)
            seen.add(k)
        out.add((d, len(ls), len(ls) - len(kept), sha("\n".join(kept).encode())))
    return out


def base_secrets(text: str | None) -> list[tuple[int, int, int]]:
    import re

    text = text or ""
    assign = re.compile(r"(?:(?i:(password|passwd|secret|token|api_?key)))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12 and m[1].isascii()]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def linked(text: str, base: list, scope: int):
    """As secrets.linked_spans(), by looking at every pair."""
    import re

    from titlemart.llm import secrets

    breaks = [m.start() for m in re.finditer(r"\n[ \t]*\n", text)]

    def near(part, others):
        found = []
        for x in others:
            gap, lo, hi = max(x[0] - part[2], part[0] - x[2], 0), min(part[2], x[2]), max(part[0], x[0])
            if gap <= scope and not any(lo <= b < hi for b in breaks):
                found.append((gap, x))
        return min(found)[1] if found else None

    spans = lambda k, pattern: [(m.start(), k, m.end()) for m in pattern.finditer(text)]
    access, assigned = ([s for s in base if s[1] == k] for k in (1, 0))
    if not access:
        return [], []
    weak = [s for s in spans(3, secrets.SECRET) if near(s, access)]
    sure = assigned + [s for s in weak if not any(a[0] <= s[0] and s[2] <= a[2] for a in assigned)]
    ends = [s for s in spans(4, secrets.ENDPOINT) if near(s, access) and near(s, sure)]
    links = [(a, near(a, sure), near(a, ends)) for a in access]
    return sorted(weak + ends), [x for x in links if x[1]]


def mixture(bag: list[int], logs: list[list[float]], penalty: float, rounds: int) -> list[float]:
    """Proportions of a bag of buckets; row b of ``logs`` holds log p(b | language)."""
    from math import exp, log

    n = len(logs[0])
    if not bag:
        return [0.0] * n
    alone = [sum(logs[b][k] for b in bag) for k in range(n)]
    share = [float(k == alone.index(max(alone))) for k in range(n)]
    likelihood = lambda s: sum(log(sum(s[k] * exp(logs[b][k]) for k in range(n))) for b in bag)
    level = max(alone)
    while sum(s > 0 for s in share) < n:
        mixed = [sum(share[k] * exp(logs[b][k]) for k in range(n)) for b in bag]
        gain = [-1.0 if share[k] else sum(exp(logs[b][k]) / m for b, m in zip(bag, mixed)) for k in range(n)]
        new = gain.index(max(gain))
        if gain[new] <= len(bag):
            break
        trial = [0.1 if k == new else s for k, s in enumerate(share)]
        trial = [s / sum(trial) for s in trial]
        for _ in range(rounds):
            mixed = [sum(trial[k] * exp(logs[b][k]) for k in range(n)) for b in bag]
            trial = [t * sum(exp(logs[b][k]) / m for b, m in zip(bag, mixed)) / len(bag) for k, t in enumerate(trial)]
        reached = likelihood(trial)
        if reached - level <= penalty * log(len(bag) + 1):
            break
        share, level = trial, reached
    return share


def edit_matches(text: str, item: str) -> int:
    """Least edit distance of ``item`` to any substring, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, x in enumerate(text, 1):
            last, row[j] = row[j], min(last + (c != x), row[j] + 1, row[j - 1] + 1)
    return min(row)


def exact(docs: list[tuple[int | None, str | None]]) -> list[tuple]:
    """(doc_id, keep_id, group_size, kept, sha256) of each row, in their order."""
    form = [re.sub(rb"[ \t-\r]+", b" ", (t or "").encode()) for _, t in docs]
    first: dict = {}
    for k, (d, _) in enumerate(docs):
        place = (d is None, d or 0, k)
        first[form[k]] = min(first.get(form[k], place), place)
    return [(d, docs[first[f][2]][0], form.count(f), first[f][2] == k, sha(f)) for k, ((d, _), f) in enumerate(zip(docs, form, strict=True))]


def clusters(rows: list[tuple], k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64) -> list[tuple]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, sha256) in whole numbers."""
    sound = lambda v: v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if sound(v)]
    first = sorted(kept, key=lambda r: (sha(f"1:{r[0]}".encode()) if r[0] is not None else "z", r[1]))
    centroids = [v for _, v in first[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        near = [min((apart(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
        for j in range(len(centroids) if r < rounds else 0):
            own = [v for (_, v), (_, n) in zip(kept, near, strict=True) if n == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    total: dict = {}
    for d, j in near if kept else []:
        total[j] = total.get(j, 0) + d
    shas = [sha(",".join(map(str, c)).encode()) for c in centroids]
    return [(i, j, d, total[j], sum(total.values()), shas[j]) for (i, _), (d, j) in zip(kept, near if kept else [], strict=True)]


def rebuilt(rows: list[tuple], group: int = 100, most: int = 6) -> dict[int, list[tuple[str, str]]]:
    """Conversations of (conv_id, turn, role, text) that begin as others do."""
    digest = lambda r: sha(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode())
    own: dict = {}
    for c, _, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, digest(r))):
        own.setdefault(c, []).append((role or "", text or ""))
    h = {c: zlib.crc32(str(c).encode()) % most for c in own}
    return {c: own.get(c - int(math.fmod(c, group)), [])[: h[c]] + t[h[c] :] for c, t in own.items()}


def trie(turns: dict[int, list[tuple[str, str]]]) -> set:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node."""
    members: dict = {}
    for c, t in turns.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    below: dict = {}
    for k in members:
        for d in range(len(k) + 1):
            below.setdefault(k[:d], []).append(k)
    children = {k: sum(len(x) == len(k) + 1 for x in below[k]) for k in members}
    saved = {k: (len(m) - 1) * len(k[-1][1]) if k else 0 for k, m in members.items()}
    return {
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], sum(not children[x] for x in below[k]), sum(saved[x] for x in below[k]),
         sha(",".join(str(c) for c in sorted(m) if len(turns[c]) == len(k)).encode()))
        for k, m in members.items()
    }
