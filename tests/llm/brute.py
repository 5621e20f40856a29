"""The contracts in plain Python, for small tables."""

import base64
import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTE_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
NORMAL = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def covered(hits, n):
    marks = [False] * n
    for at, length in hits:
        marks[at : at + length] = [True] * length
    return marks


def facts(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(grams)
    marks = covered([(i, 5) for i, g in enumerate(grams) if count[g] > 1], len(words))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), sum(marks), len(lines)


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    n, chars, symbols, dup, repeat, lines = facts(text)
    failed = n < 10 or 100 * repeat > 20 * n
    bad = symbols > 2 * n or 10 * dup > 3 * lines or (text or "").count("!") > n or chars > 50 * n
    return n, chars, symbols, dup, repeat, failed, not failed and not bad


def rule(url, rules):
    at = (url or "").find("://")
    if url is None or at < 0:
        return "", "", None, None
    rest = url[at + 3 :]
    host = re.match(r"(?s)[^/?#]*", rest)[0]
    path = re.match(r"(?s)[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOWER)
    fits = []
    for name, says in rules:
        domain, _, tail = name.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + tail):
            fits.append((len(name), name, says))
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def private(text):
    """Base spans (start, kind index, end)."""
    out = []
    for k, (kind, pattern) in enumerate(PII.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def repeats(rows, length=50):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 from (doc_id, text)."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, t in texts:
        for i in range(len(t) - length + 1 if d is not None else 0):
            s = t[i : i + length]
            first[s] = min(first.get(s, d), d)
    for d, t in texts:
        hits = [(i, length) for i in range(len(t) - length + 1) if d is not None and first[t[i : i + length]] < d]
        marks = covered(hits, len(t))
        spans = sum(m and (i == 0 or not marks[i - 1]) for i, m in enumerate(marks))
        yield d, len(t), sum(marks), spans, sha(bytes(c for c, m in zip(t, marks, strict=True) if not m))


def shingles(text):
    words = BYTE_WORD.findall((text or "").translate(LOWER).encode())
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def classes(rows):
    """doc_id -> (n_shingles, component_id), for distinct ids."""
    sets = {d: shingles(t) for d, t in rows}
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    owners = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            owners[x].append(d)
    common = Counter()
    for ids in owners.values():
        common.update((a, b) for i, a in enumerate(ids) for b in ids[i + 1 :])
    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def contamination(rows, items):
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    windows = defaultdict(set)
    for item, text in items:
        words = NORMAL.findall((text or "").translate(LOWER))
        n = min(13, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[i : i + n])].add(str(item))
    lengths = {len(w) for w in windows}
    for d, text in rows:
        words = NORMAL.findall((text or "").translate(LOWER))
        hits, found = [], set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hits.append((i, n))
                    found |= windows[tuple(words[i : i + n])]
        n_hit = sum(covered(hits, len(words)))
        yield d, len(words), n_hit, len(found), sha(",".join(sorted(found))), n_hit > 0 and 20 * n_hit >= len(words)


def archives(rows):
    """page_id, payload_bytes, payload_digest, record_type, refers_to."""
    best = {}
    for p, html in rows:
        best[html or ""] = max(best.get(html or "", p), p)
    for p, html in rows:
        raw = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        own = best[html or ""] == p
        yield p, len(raw), digest, "response" if own else "revisit", None if own else best[html or ""]


def chats(rows):
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 from (conv_id, turn, role, text)."""
    of = defaultdict(list)
    for c, turn, role, text in rows:
        of[c].append((turn, role or "", text or ""))
    for c, turns in of.items():
        turns.sort()
        learned = "".join(t for _, r, t in turns if r == "assistant")
        yield c, len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(learned), sha(learned)
