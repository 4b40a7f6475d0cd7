"""Plain versions of the operators, for small tables."""

import hashlib
from collections import Counter, defaultdict

BLANKS = " \t\n\x0b\x0c\r"
UPPER = {c: c + 32 for c in range(65, 91)}


def words_by_blanks(text):
    for c in BLANKS[1:]:
        text = (text or "").replace(c, " ")
    return [w for w in (text or "").split(" ") if w]


def words_of_letters(text):
    out, word = [], ""
    for c in (text or "").translate(UPPER) + " ":
        if "0" <= c <= "9" or "a" <= c <= "z" or c > "\x7f":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def shingle_set(text, width=5):
    words = words_by_blanks((text or "").translate(UPPER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def near_classes(docs, percent=85):
    """docs: id -> text. id -> smallest id reachable."""
    sets = {d: shingle_set(t) for d, t in docs.items()}
    root = {d: d for d in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in docs}


def repeats(docs, width=100):
    """docs: id -> text. id -> (bytes, removed mask)."""
    seen, out = set(), {}
    for d in sorted(docs):
        raw = (docs[d] or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - width + 1):
            s = raw[i : i + width]
            if s in seen:
                gone[i : i + width] = [True] * width
            seen.add(s)
        out[d] = raw, gone
    return out


def removal_row(raw, gone):
    kept = bytes(b for b, g in zip(raw, gone) if not g)
    spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
    return len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()


def contaminated_words(text, items):
    """(words, hit words, item ids as strings) of one text; items: list of (id, text)."""
    words, hit, found = words_of_letters(text), set(), set()
    for item, body in items:
        w = words_of_letters(body)
        n = min(10, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def quality_counts(text):
    words = words_by_blanks(text)
    chars = sum(map(len, words))
    lines = [x for x in (text or "").split("\n") if words_by_blanks(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {i + d for i, g in enumerate(grams) if often[g] > 1 for d in range(3)}
    return len(words), chars, sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def groups_of(pairs):
    out = defaultdict(list)
    for k, v in pairs:
        out[k].append(v)
    return out
