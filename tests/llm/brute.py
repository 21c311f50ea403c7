"""Plain Python versions of the operators, and small tables to hold them against."""

import hashlib
import html.parser
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
fold = lambda i, n: zlib.crc32(str(i).encode()) % n


class Groups:
    """Union of what is linked."""

    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def root(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lowered)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(docs, radius=2):
    """{doc_id: (fingerprint, component)}"""
    fp = {i: fingerprint(t) for i, t in docs}
    g, ids = Groups(fp), sorted(fp)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (fp[a] ^ fp[b]).bit_count() <= radius:
                g.join(a, b)
    return {i: (f"{fp[i]:016x}", g.root(i)) for i in ids}


class Articles(html.parser.HTMLParser):
    """The text of the article elements of a page, by the standard library's parser; for pages without names."""

    BREAKS = set("article h1 h2 h3 p ul ol li div section table tr td blockquote pre figure".split())
    SILENT = set("script style nav aside footer form svg noscript header".split())

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside = self.silent = 0
        self.blocks = [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.silent += tag in self.SILENT
        self.inside += tag == "article"
        if tag in self.BREAKS:
            self.blocks.append("")
        if tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag in self.BREAKS:
            self.blocks.append("")
        self.silent -= tag in self.SILENT and self.silent > 0
        self.inside -= tag == "article" and self.inside > 0

    def handle_data(self, data):
        if self.inside and not self.silent:
            self.blocks[-1] += data

    def text(self):
        return "\n".join(t for t in (" ".join(b.split()) for b in self.blocks) if t)


def shingles(text, width=5):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lowered)
    return {" ".join(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {" ".join(w)} if w else set()


def near_copies(docs, least=0.8):
    """{doc_id: component} of (doc_id, text) rows by the Jaccard similarity of sets of five-word shingles"""
    sets = {i: shingles(t) for i, t in docs}
    g, holders, seen = Groups(sets), defaultdict(list), {}
    for i in sorted(sets):
        first = seen.setdefault(frozenset(sets[i]), i)
        g.join(i, first)
        if first != i:
            continue
        shared = Counter(j for x in sets[i] for j in holders[x])
        for j, n in shared.items():
            if n / (len(sets[i]) + len(sets[j]) - n) >= least:
                g.join(i, j)
        for x in sets[i]:
            holders[x].append(i)
    return {i: g.root(i) for i in sets}


def measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"""
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    n = len(w)
    return n, sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def conversations(rows):
    """{conv_id: (n_turns, turns_sha256, loss_chars, loss_sha256)} of (conv_id, turn, role, text) rows"""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[c] = len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(loss), sha(loss)
    return out


def cosine_groups(rows, least):
    """{vec_id: (n_links, component, kept)} of (vec_id, vector, label) rows, in exact fractions but for the root"""
    from fractions import Fraction
    from math import isfinite

    good = {}
    for i, v, label in rows:
        if label is not None and v and all(x is not None and isfinite(x) for x in v) and any(v):
            x = [Fraction(c) for c in v]
            good[i] = x, sum(c * c for c in x), label
    g, n = Groups([r[0] for r in rows]), Counter()
    ids, bar = sorted(good), Fraction(least) ** 2
    for k, a in enumerate(ids):
        for b in ids[:k]:
            (x, xx, lx), (y, yy, ly) = good[a], good[b]
            if lx == ly and len(x) == len(y):
                dot = sum(p * q for p, q in zip(x, y, strict=True))
                if dot > 0 and dot * dot >= bar * xx * yy:
                    g.join(a, b)
                    n.update((a, b))
    return {r[0]: (n[r[0]], g.root(r[0]), g.root(r[0]) == r[0]) for r in rows}
