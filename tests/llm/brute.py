"""Plain versions of the corpus operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def groups(nodes, links):
    """Smallest node that links reach, per node."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def shingles(text: str | None, width: int = 5) -> set:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def near_groups(rows, percent: int):
    """doc_id -> (set size, component) for rows with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    links = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    found = groups(sets, links)
    return {i: (len(sets[i]), found[i]) for i in sets}


def without_passages(rows, window: int):
    """doc_id -> (words, removed, kept text)."""
    words = {i: WORD.findall(t or "") for i, t in rows}
    first: dict = {}
    for i in sorted(words):
        for s in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][s : s + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone |= set(range(s, s + window))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def without_substrings(texts, window: int):
    """Per text, in order: (bytes, removed, runs, kept)."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[s : s + window] for b in raw for s in range(len(b) - window + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            if seen[b[s : s + window]] > 1:
                gone[s : s + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept))
    return out


def exact_groups(rows):
    """One (doc_id, keep_id, group size, sha256) per row."""
    bare = [(i, t or "", re.sub(r"[\x20\x09-\x0D]", "", t or "")) for i, t in rows]
    by = defaultdict(list)
    for i, t, b in bare:
        by[b].append((-len(t), i is None, i if i is not None else 0, i))
    return [(i, min(by[b])[3], len(by[b]), hashlib.sha256(b.encode()).hexdigest()) for i, t, b in bare]


def source_targets(sizes: dict, weights=(5, 2, 1), most=3):
    """Target per source by sharing what is over again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    left, open_ = float(sum(sizes.values())), list(order)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s in open_:
            target[s] += share[s]
            if target[s] > most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
        open_ = [s for s in open_ if target[s] < most * sizes[s]]
    return target


def linked_vectors(rows, cosine: float):
    """vec_id -> (links, component)."""
    known = {}
    for i, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            size = math.sqrt(sum(x * x for x in v))
            known[i] = [x / size for x in v]
    links = [(a, b) for a in known for b in known if a < b and sum(x * y for x, y in zip(known[a], known[b])) >= cosine]
    count = Counter(x for link in links for x in link)
    found = groups([i for i, _ in rows], links)
    return {i: (count[i], found[i]) for i, _ in rows}


def frequent_phrases(rows, least: int, longest: int) -> dict:
    """(lang, words) -> occurrences of every phrase inside pieces, and lang -> words."""
    seen, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                seen.update((lang, tuple(words[s : s + k])) for s in range(len(words) - k + 1))
    return seen, total


def best_phrases(rows, least: int, longest: int, reported: int):
    """(lang, rank, phrase, a, l, r, n, score), in order."""
    seen, total = frequent_phrases(rows, least, longest)
    often = {k: a for k, a in seen.items() if a >= least and len(k[1]) > 1}
    out = []
    for (lang, words), a in often.items():
        cuts = []
        for c in range(1, len(words)):
            left, right = seen[lang, words[:c]], seen[lang, words[c:]]
            cuts.append((2000000 * a // (left + right), c, left, right))
        score, _, left, right = min(cuts)
        longer = [b for (other, w), b in often.items() if other == lang and len(w) > len(words) and any(w[s : s + len(words)] == words for s in range(len(w)))]
        if not any(100 * b >= 80 * a for b in longer):
            out.append((lang, -score, -a, " ".join(words).encode(), left, right))
    ranked, place = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        place[lang] += 1
        if place[lang] <= reported:
            ranked.append((lang, place[lang], phrase.decode(), -a, left, right, total[lang], -score))
    return ranked


def word_runs(words, least: int):
    """(start, length, period) of all maximal repetitions, by start and period."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        start = 0
        while start + q < n:
            end = start
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end - start >= q and end - start + q >= least:
                found.setdefault((start, end - start + q), q)
            start = max(end, start + 1)
    return sorted(((s, size, q) for (s, size), q in found.items()), key=lambda x: (x[0], x[2]))


def item_windows(text, items, window: int):
    """(words, hit places, item ids) of one document."""
    plain_words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, names = plain_words(text), set(), set()
    for item, line in items:
        line = plain_words(line)
        m = min(window, len(line))
        some = {tuple(line[s : s + m]) for s in range(len(line) - m + 1)} if m else set()
        for s in range(len(words) - m + 1):
            if tuple(words[s : s + m]) in some:
                hit |= set(range(s, s + m))
                names.add(item)
    return words, hit, names - {None}


def without_templates(rows, least: int, leading: int = 3, similarity: float = 0.7):
    """One (removed positions) per row of (doc_id, text) with ids that do not repeat."""
    lines = []
    for i, text in rows:
        for pos, line in enumerate((text or "").split("\n") if text is not None else []):
            tidy = WORD.findall(line)
            wild = ["<*>" if re.search("[0-9]", t) else t for t in tidy]
            constants = lambda tokens: len(tokens) - "".join(tokens).count("<*>")
            if tidy:
                lines.append((i, text, pos, tuple(wild if constants(wild[:leading]) > 0 or constants(wild) > 1 else tidy)))
    leaves = defaultdict(Counter)
    for _, _, _, tokens in lines:
        if len(tokens) > leading:
            leaves[len(tokens), tokens[:leading]][tokens] += 1
    patterns = defaultdict(set)
    for leaf, texts in leaves.items():
        if len(texts) < 2 or sum(texts.values()) < least:
            continue
        often = Counter()
        for tokens, n in texts.items():
            for spot in enumerate(tokens):
                often[spot] += n
        for tokens in texts:
            degree = {spot: int(math.log2(often[spot] / least)) for spot in enumerate(tokens) if often[spot] >= least}
            for bound in set(degree.values()):
                kept = tuple(s for s, d in degree.items() if d >= bound)
                further = [s for s, t in kept if s >= leading and t != "<*>"]
                if further and similarity * len(tokens) <= len(kept) < len(tokens):
                    patterns[tokens].add((leaf, kept))
    holders = defaultdict(set)
    for i, text, _, tokens in lines:
        for key in (tokens, *patterns[tokens]):
            holders[key].add((i is None, i or 0, i, text))
    gone = defaultdict(set)
    for i, text, pos, tokens in lines:
        for key in (tokens, *patterns[tokens]):
            named = sorted(h for h in holders[key] if not h[0])
            common, whole = len(named) >= least, key is tokens
            if not named or i == named[0][2]:
                continue
            if common or (whole and len({h[3] for h in named}) > 1 and len(named) > 1 and text != named[0][3]):
                gone[i, text].add(pos)
    return [gone[i, text] for i, text in rows]
