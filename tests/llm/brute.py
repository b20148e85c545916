"""Plain single-machine versions of the operators, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import accumulate

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NGRAM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def contamination(docs, items, n=13):
    """{doc_id: (n_words, n_hit, n_items, items_sha256, contaminated)}"""
    windows = defaultdict(set)
    for item, text in items:
        words = NGRAM_WORD.findall((text or "").translate(LOWER))
        for i in range(max(1, len(words) - n + 1)):
            if words:
                windows[tuple(words[i : i + n])].add(item)
    lengths = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        words = NGRAM_WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for length in lengths:
            for i in range(len(words) - length + 1):
                if (own := windows.get(tuple(words[i : i + length]))) is not None:
                    hit |= set(range(i, i + length))
                    found |= own
        found = sorted(map(str, found - {None}))
        out[doc] = (len(words), len(hit), len(found), sha(",".join(found)), len(hit) > 0 and 20 * len(hit) >= len(words))
    return out


def lines(docs, min_chars=40, min_docs=5):
    """{doc_id: (n_lines, n_dropped, kept text)}"""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(doc)
    drop = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = {}
    for doc, text in docs:
        own = (text or "").split("\n")
        kept = [x for x in own if drop.get(key(x), doc) == doc]
        out[doc] = (len(own), len(own) - len(kept), "\n".join(kept))
    return out


def passages(docs, window=50):
    """{doc_id: (n_words, n_removed, kept text)}"""
    first = {}
    for doc, text in sorted(docs):
        words = WORD.findall(text or "")
        for i in range(len(words) - window + 1):
            first.setdefault(tuple(words[i : i + window]), doc)
    out = {}
    for doc, text in docs:
        words, gone = WORD.findall(text or ""), set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < doc:
                gone |= set(range(i, i + window))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out[doc] = (len(words), len(gone), " ".join(kept))
    return out


def simhash(text):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """{doc_id: smallest reachable doc_id} of (doc_id, fingerprint), two bits at most a link."""
    by = defaultdict(list)
    for doc, fp in prints:
        by[fp].append(doc)
    values, root = list(by), {f: f for f in by}

    def find(f):
        while root[f] != f:
            root[f] = root[root[f]]
            f = root[f]
        return f

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    low = {}
    for f, ids in by.items():
        low[find(f)] = min([*ids, low.get(find(f), ids[0])])
    return {doc: low[find(f)] for doc, f in prints}


def rules_base(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    text = text or ""
    words = WORD.findall(text)
    own = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= set(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(own) - len(set(own)), len(covered)


def rule_votes(text):
    """Votes of the quality rules, in their order: 1 good, 0 bad, None abstains."""
    n, chars, symbols, same, repeated = rules_base(text)
    text = text or ""
    rows = sum(bool(WORD.search(x)) for x in text.split("\n"))
    capitals, letters, shouts = sum("A" <= c <= "Z" for c in text), sum(c.isalpha() for c in text), text.count("!")
    vote = lambda good, bad: 0 if bad else 1 if good else None
    return (
        vote(n >= 50, n < 20),
        vote(3 * n <= chars <= 10 * n, chars < 2 * n or chars > 14 * n),
        vote(50 * symbols <= n, 5 * symbols > n),
        vote(10 * letters >= 9 * chars, 5 * letters < 4 * chars),
        vote(20 * repeated <= n, 5 * repeated > n),
        vote(rows >= 4 and 10 * same <= rows, rows >= 4 and 3 * same > rows),
        vote(4 * capitals <= chars, 2 * capitals > chars),
        vote(20 * shouts <= n, 4 * shouts > n),
    )


def kept_by_rules(docs, keep=0.5, edge=0.001, rounds=300):
    """[(base_failed, kept)] of texts: votes, EM text by text with NumPy, posterior of good."""
    import numpy as np

    votes = np.array([[np.nan if v is None else v for v in rule_votes(t)] for _, t in docs])
    start = np.array([[0.95] * 8, [0.6, 0.6, 0.2, 0.2, 0.6, 0.6, 0.6, 0.6], [0.6, 0.6, 0.6, 0.6, 0.2, 0.2, 0.2, 0.2]])
    shares, rates, said = np.array([0.8, 0.1, 0.1]), start, ~np.isnan(votes)
    good, bad = np.where(said, votes, 0), np.where(said, 1 - votes, 0)

    def posterior():
        p = np.exp(good @ np.log(rates).T + bad @ np.log(1 - rates).T) * shares
        return p / p.sum(axis=1, keepdims=True)

    for _ in range(rounds):
        p, before = posterior(), shares
        shares = np.clip((p.sum(axis=0) + 1) / (len(docs) + 3), edge, 1 - edge)
        rates = np.clip((p.T @ good + 10 * start) / (p.T @ said + 10), edge, 1 - edge)
        if abs(before - shares).max() < 1e-9:
            break
    out = []
    for (_, text), good_share in zip(docs, posterior()[:, 0], strict=True):
        n, *_, repeated = rules_base(text)
        failed = n < 20 or 100 * repeated > 30 * n
        out.append((failed, not failed and bool(good_share >= keep)))
    return out


def language(docs, learnt):
    """{doc_id: lang} by plain word-first backoff; ``learnt``: (text, lang) of every document to learn from."""
    import math

    letters = re.compile(r"[^\W\d_]+")
    split = lambda text: [w for w in letters.findall((text or "").lower()) if any(map(str.isalpha, w))]
    cut = lambda w, n: [w] if n == 1 == len(w) else [(w if n == 1 else f"<{w}>")[i : i + n] for i in range(len(w if n == 1 else f"<{w}>") - n + 1)]
    langs = sorted({lang for text, lang in learnt if split(text)})
    words, grams = defaultdict(Counter), defaultdict(Counter)
    for text, lang in learnt:
        for w in split(text):
            words[w][lang] += 1
            for n in range(1, 6):
                for g in cut(w, n):
                    grams[g][lang] += 1
    total = {x: sum(c[x] for c in words.values()) for x in langs}
    by_size = {(n, x): 1 + sum(c[x] for g, c in grams.items() if len(g) == n) for n in range(1, 6) for x in langs}

    def scores(w):
        if w in words:
            return [math.log((words[w][x] + 0.5) / (total[x] + 0.5 * len(words))) for x in langs]
        for n in range(5, 0, -1):
            if known := [g for g in cut(w, n) if g in grams]:
                return [sum(math.log((grams[g][x] + 0.5) / by_size[n, x]) for g in known) / len(known) for x in langs]
        return [0.0] * len(langs)

    out = {}
    for doc, text in docs:
        own = [scores(w) for w in split(text)]
        sums = [sum(c) for c in zip(*own, strict=True)]
        out[doc] = langs[max(range(len(langs)), key=lambda k: sums[k])] if own and langs else "und"
    return out


def alignment(docs, a_tokens, b_tokens):
    """[(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)] of texts; ``a_tokens`` and ``b_tokens`` give (id, bytes) of each token of a text."""
    found = []
    for text in docs:
        a, b = (a_tokens(text), b_tokens(text)) if text else ([], [])
        if not text or any(b"".join(x for _, x in own) != f" {text}".encode() for own in (a, b)):
            found.append([])
            continue
        ends = [list(accumulate(len(x) for _, x in own)) for own in (a, b)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in cuts]
        for side, (own, at) in enumerate(zip((a, b), ends, strict=True)):
            for (i, _), end in zip(own, at, strict=True):
                groups[bisect_left(cuts, end)][side].append(i)
        found.append(groups)
    links = [[(x, y) for left, right in groups for x in left for y in right] for groups in found]
    counts = Counter(pair for own in links for pair in set(own))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for groups, own in zip(found, links, strict=True):
        text = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)
        best = sum(counts[p] == most[p[0]] for p in own)
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(own), best, sum(counts[p] for p in own), sha(text) if groups else ""))
    return out


def damaged(rows):
    """(conv_id, turn, role, text) rows damaged by the crc32 of conv_id:turn."""
    import zlib

    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        at = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        row = (conv, turn, "user" if at == 4 else role, "" if at == 1 else re.sub("[.!?]", "", text) if at == 2 else text)
        out += [row] * (0 if at == 0 else 2 if at == 3 else 1)
    return out


def repaired(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired text) of one conversation's (turn, role, text) rows, in any order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    turns = {t for t, _, _ in rows if t is not None}
    seen, faults = set(), []
    for _, role, text in rows:
        own = WORD.findall(text)
        faults.append("blank" if not own else "duplicate" if (role, text) in seen else "truncated" if own[-1][-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    # Best (cost, letters, lines) by the last initial that was written.
    states = {"": (0, "", ())}

    def better(to, key, value):
        if key not in to or value[:2] < to[key][:2]:
            to[key] = value

    def inserts(states):
        for _ in range(3):
            for q, (cost, letters, lines) in list(states.items()):
                for name in ("user", "assistant"):
                    if (q, name[0]) in after:
                        better(states, after[q, name[0]], (cost + 3, letters + "I", (*lines, f"{name}:")))
        return states

    for (_, role, text), fault in zip(rows, faults, strict=True):
        then = {}
        for q, (cost, letters, lines) in inserts(states).items():
            better(then, q, (cost + 4, letters + "D", lines))
            if fault in ("", "truncated"):
                more = 3 if fault else 0
                if (q, role[:1]) in after:
                    better(then, after[q, role[:1]], (cost + more, letters + "K", (*lines, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    if (q, name[0]) in after:
                        better(then, after[q, name[0]], (cost + more + 3, letters + "R", (*lines, f"{name}:{text}")))
        states = then
    cost, letters, lines = min(v for q, v in inserts(states).items() if q in ("", "a"))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, letters, "\n".join(lines)
