"""Plain, slow versions of the operators, written from their contracts."""

from __future__ import annotations

import hashlib
import html as entities
import math
import re
import unicodedata
from collections import Counter, defaultdict
from zlib import crc32

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def held_out(doc_id):
    return doc_id is None or crc32(str(doc_id).encode()) % 5 == 0


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text):
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def pii(text):
    spans = base_spans(text)
    counts = Counter(k for k, _, _ in spans)
    written = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return *(counts[k] for k in ("email", "ip", "card", "phone")), hashlib.sha256(written.encode()).hexdigest(), written


def repetition(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), n < 10 or 100 * len(hit) > 20 * n


def top_ngram(text, n, times=4):
    """Share of word characters in all occurrences of the n-gram that has most of them."""
    words = WORD.findall(text or "")
    found = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    return max((k * sum(map(len, g)) for g, k in found.items() if k >= times), default=0) / max(sum(map(len, words)), 1)


def shingles(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(lower)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)])


def components(rows, percent=80):
    """rows: (doc_id, text). doc_id -> (set size, component)."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    common = Counter()
    where = defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            for j in where[s]:
                common[j, i] += 1
            where[s].append(i)
    links = 0
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            links += 1
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}, links


def url(u, rules):
    host = path = ""
    if u and "://" in u:
        rest = u.split("://", 1)[1]
        m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
        host, path = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]
    best = None
    for rule, verdict in rules:
        own, rest = rule.split("/", 1)
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, best


def targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        out = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if out[s] > cap * sizes[s]]
        if not over:
            return out | fixed
        fixed |= {s: cap * sizes[s] for s in over}


def conversation(turns):
    """turns: (role, text) in order."""
    turns = [(r or "", t or "") for r, t in turns]
    said = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()


def main_text(page):
    """For pages with an article element: its blocks, without what stands in noisy elements, by regular expressions."""
    body = re.sub(r"(?is)<!--.*?-->|<(script|style|nav|footer|aside|form)\b.*?</\1>|<div class=\"ad\">.*?</div>", "", page or "")
    m = re.search(r"(?is)<article>(.*?)(</article>|\Z)", body)
    if not m:
        return None
    blocks = re.split(r"(?i)</?(?:p|h[1-6]|ul|ol|li|div|section|table|tr|td|th|blockquote|pre|figure|figcaption|article)\b[^<>]*>", m[1])
    out = [" ".join(entities.unescape(re.sub(r"<[^<>]*>", "", re.sub(r"(?i)<br\b[^<>]*>", " ", b))).split()) for b in blocks]
    return "\n\n".join(x for x in out if x)


def tokens(text):
    """Runs of letters and digits, case-folded, in compatibility form."""
    text = unicodedata.normalize("NFKC", text or "").casefold()
    return re.findall(r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]|(?:(?![\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff_])\w)+", text)


def tiled(text, passage, k):
    """Tokens of the passage that greedy tiles of k tokens or more cover."""
    used_t, used_p = [False] * len(text), [False] * len(passage)
    places = defaultdict(list)
    for t, x in enumerate(text):
        places[x].append(t)
    while True:
        best = (k - 1, 0, 0)
        for p in range(len(passage)):
            for t in places[passage[p]]:
                n = 0
                while p + n < len(passage) and t + n < len(text) and passage[p + n] == text[t + n] and not used_p[p + n] and not used_t[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, t)
        if best[0] < k:
            return sum(used_p)
        n, p, t = best
        used_p[p : p + n] = used_t[t : t + n] = [True] * n


def contaminated(texts, items, k=5, least=0.5):
    """texts: id -> text; items: (id, text). id -> (item, coverage) of the most covered passage, of equal ones the smallest."""
    passages = [(i, tokens(t)) for i, t in items]
    out = {}
    for d, text in texts.items():
        own = tokens(text)
        grams = {n: {tuple(own[j : j + n]) for j in range(len(own) - n + 1)} for n in range(1, k + 1)}
        for i, p in passages:
            n = min(k, len(p))
            if n and any(tuple(p[j : j + n]) in grams[n] for j in range(len(p) - n + 1)):
                c = tiled(own, p, n) / len(p)
                if c >= least and (d not in out or (-c, i) < (-out[d][1], out[d][0])):
                    out[d] = i, c
    return out


def context_bits(samples, text, order):
    """Bits of each symbol of ``text`` after what one language's ``samples`` (lists of symbols) held, by the definition; every symbol of ``alphabet`` counts."""
    samples, alphabet = samples
    counts = defaultdict(Counter)
    for s in samples:
        for i, x in enumerate(s):
            for k in range(min(i, order) + 1):
                counts[tuple(s[i - k : i])][x] += 1

    def chance(context, k):
        below = {x: 1 / len(alphabet) for x in alphabet} if k == 0 else chance(context[1:], k - 1)
        seen = counts.get(context)
        if not seen:
            return below
        n, distinct = sum(seen.values()), len(seen)
        if distinct == len(alphabet):
            return {x: seen[x] / n for x in alphabet}
        left = sum(below[x] for x in alphabet if x not in seen)
        return {x: seen[x] / (n + distinct) if x in seen else distinct / (n + distinct) * below[x] / left for x in alphabet}

    return [-math.log2(chance(tuple(text[max(0, i - order) : i]), min(i, order))[x]) for i, x in enumerate(text)]


def statistics(text):
    """What the quality classifier looks at, one by one."""
    text = text or ""
    words, chars = WORD.findall(text), max(len(text), 1)
    n = max(len(words), 1)
    lines = [tuple(WORD.findall(x)) for x in text.split("\n") if WORD.search(x)]
    share = lambda own: sum(c in own for c in text) / chars
    return [
        len(words), sum(map(len, words)) / n, len({*words}) / n, sum(a == b for a, b in zip(words, words[1:])) / n, share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("0123456789"), share("#*$%&<>"), share("|"), share("!"), share(".,;:?"),
        len(words) / (text.count("\n") + 1), len({*lines}) / max(len(lines), 1),
    ]


def _entropy(value):
    return -sum(k / len(value) * math.log2(k / len(value)) for k in Counter(value).values())


def protected(text):
    """(kind, value, before, after) of the known forms and secrets of a text; before and after reach to the next match of the kind, valid or not."""
    digits = lambda v: re.sub("[^0-9]", "", v)
    forms = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda v: True),
        "ip": (r"[0-9]+(?:\.[0-9]+){3}", lambda v: all(int(x) <= 255 for x in v.split("."))),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", lambda v: 16 <= len(digits(v)) <= 19 and luhn(digits(v))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(digits(v)) <= 15),
        "secret": (r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}", lambda v: bool(re.search("[0-9]", v) and re.search("[A-Za-z]", v)) and _entropy(v) >= 3),
    }
    for kind, (pattern, valid) in forms.items():
        found = [*re.finditer(pattern, text)]
        cuts = [0, *(x for m in found for x in m.span()), len(text)]
        for i, m in enumerate(found):
            if valid(m[0]):
                yield kind, m[0], text[cuts[2 * i] : m.start()], text[m.end() : cuts[2 * i + 3]]


def terms(text):
    """Words with a letter outside of emails, lower-case."""
    plain = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", " ", text).lower()
    return [w for w in re.findall(r"[^\W_]+", plain) if re.search(r"[^\W\d_]", w)]


def revealing(texts, threshold=0.9, least=3, window=10, prior=0.5):
    """term -> disclosure of the terms that reveal protected entities, counted from the definition."""
    texts = sorted({t or "" for t in texts})
    words = [terms(t) for t in texts]
    values, beside, holders = defaultdict(set), defaultdict(set), set()
    for d, text in enumerate(texts):
        for kind, value, before, after in protected(text):
            holders.add(d)
            values[kind, value].add(d)
            for w in terms(before)[-window:] + terms(after)[:window]:
                beside[(kind, value), w].add(d)
    entities = defaultdict(set)
    for (kind, value), own in values.items():
        entities[(kind, value) if len(own) >= least else kind] |= own
    seen = defaultdict(set)
    for d, own in enumerate(words):
        for w in own:
            seen[w].add(d)

    def disclosed(both, entity, word):
        p = entity / len(texts)
        return 1 - math.log((min(both, len(seen[word])) + prior * p) / (len(seen[word]) + prior)) / math.log(p) if entity < len(texts) else -1.0

    out = defaultdict(lambda: -1.0)
    for (value, w), own in beside.items():
        if w in seen:
            out[w] = max(out[w], disclosed(len(own), len(values[value]), w))
    for entity, own in entities.items():
        contexts, both = defaultdict(set), defaultdict(set)
        for d in own:
            for i, w in enumerate(words[d]):
                contexts[w].add(tuple(words[d][j] if 0 <= j < len(words[d]) else "" for j in (i - 2, i - 1, i + 1, i + 2)))
                both[w].add(d)
        for w, c in contexts.items():
            if len(c) >= least:
                out[w] = max(out[w], disclosed(len(both[w]), len(own), w))
    return {w: x for w, x in out.items() if x >= threshold}
