"""Plain versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def pack_ids(text, path):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, 2]


def decontaminate(docs, items, window=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    grams = {}
    for name, text in items:
        w = pattern.findall(lower(text or ""))
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if n else ():
            grams.setdefault(tuple(w[i : i + n]), set()).add(str(name))
    out = []
    for doc, text in docs:
        w, hit, found = pattern.findall(lower(text or "")), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if names := grams.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= names
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha, bool(hit)))
    return out


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def jaccard_components(docs, k=5, percent=75):
    sets = [(doc, shingles(text, k)) for doc, text in docs]
    top = {i: i for i in range(len(sets))}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    postings = {}
    for i, (_, s) in enumerate(sets):
        for g in s:
            postings.setdefault(g, []).append(i)
    pairs = {}
    for members in postings.values():
        for a in range(len(members)):
            for b in range(a + 1, len(members)):
                pairs[members[a], members[b]] = pairs.get((members[a], members[b]), 0) + 1
    for (a, b), both in pairs.items():
        if 100 * both >= percent * (len(sets[a][1]) + len(sets[b][1]) - both):
            top[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return [(doc, len(s), least[find(i)]) for i, (doc, s) in enumerate(sets)]


def _covered(docs, units, n):
    first = {}
    for doc, text in docs:
        u = units(text)
        for i in range(len(u) - n + 1):
            g = u[i : i + n] if isinstance(u, bytes) else tuple(u[i : i + n])
            first[g] = min(first.get(g, doc), doc)
    for doc, text in docs:
        u = units(text)
        mask = [False] * len(u)
        for i in range(len(u) - n + 1):
            g = u[i : i + n] if isinstance(u, bytes) else tuple(u[i : i + n])
            if first[g] < doc:
                mask[i : i + n] = [True] * n
        yield doc, u, mask


def repeated_words(docs, n=13):
    out = []
    for doc, u, mask in _covered(docs, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or ""), n):
        kept = " ".join(w for w, m in zip(u, mask) if not m)
        out.append((doc, len(u), sum(mask), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def repeated_bytes(docs, n=50):
    out = []
    for doc, u, mask in _covered(docs, lambda t: (t or "").encode(), n):
        runs = sum(m and not p for p, m in zip([False, *mask], mask))
        kept = bytes(c for c, m in zip(u, mask) if not m)
        out.append((doc, len(u), sum(mask), runs, hashlib.sha256(kept).hexdigest()))
    return out


def crc(text):
    return zlib.crc32((text or "").encode())


def merkle(docs, arity=16):
    """docs: (doc_id, source, lang, n_chars, text).  Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaf = lambda row: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + arity])) for i in range(0, len(levels[-1]), arity)])
        return levels

    def path(levels, i):
        for nodes in levels[:-1]:
            low = i // arity * arity
            yield nodes[low:i], nodes[i + 1 : low + arity]
            i //= arity

    groups = {}
    for row in docs:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: tree([leaf(r) for r in groups[g]]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, row in enumerate(groups[g]):
            steps = [*path(trees[g], i), *path(top, k)]
            held = row
            if crc("" if row[0] is None else str(row[0])) % 5 == 0 and row[4] is not None:
                held = (*row[:4], lower(row[4]))
            now = leaf(held)
            for left, right in steps:
                now = sha("".join([*left, now, *right]))
            proof = sha("".join(h for left, right in steps for h in (*left, *right)))
            out.append((row[0], leaf(row), trees[g][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return out


def prefix_trie(turns, span=20, most=4):
    """turns: (conv_id, turn, role, text).  Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    own = {}
    for conv, turn, role, text in turns:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0, digest), (role, text)))
    for v in own.values():
        v.sort(key=lambda x: x[0])
    members, ends = {}, {}
    for c in own:
        h = crc(str(c)) % most
        donor = [x for _, x in own.get(c - int(math.fmod(c, span)), [])]
        seq = tuple(donor[:h] + [x for _, x in own[c]][h:])
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
        ends.setdefault(seq, []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children.get(p, ())) or 1
        saved[p] = (len(members[p]) - 1) * words(p) + sum(saved[k] for k in children.get(p, ()))
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, ())), leaves[p], saved[p], sha(ends.get(p, ()))) for p, m in members.items()]


def base_rules(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and the words."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, repeated = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            repeated |= {i + k for i in places for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), failed, w


def likelihood_scores(docs, good, buckets, shrink=1.0):
    """docs: (id, text); good: ids of trusted documents.  Per document the mean log ratio of its n-grams, None where base rules fail."""
    import numpy as np
    import xxhash

    grams = []
    for _, text in docs:
        w = [x.encode() for x in base_rules(text)[-1]]
        one = [xxhash.xxh64_intdigest(x, seed=42) for x in w]
        grams.append([h % buckets for h in one] + [xxhash.xxh64_intdigest(b, seed=h) % buckets for h, b in zip(one, w[1:])])
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for (doc, _), g in zip(docs, grams):
        np.add.at(raw, g, 1)
        if doc in good:
            np.add.at(target, g, 1)
    p = raw / raw.sum()
    with np.errstate(all="ignore"):
        w = np.log((target + shrink * buckets * p) / ((target.sum() + shrink * buckets) * p)).astype(np.float32).astype(float)
    return [None if base_rules(t)[5] else float(np.mean(w[g])) for (_, t), g in zip(docs, grams)]
