"""Brute-force versions of the operators, in plain Python, row by row."""

import hashlib
import re

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def pii(text):
    """(counts of email, ip, card, phone; base_sha256)."""
    spans, text = [], text or ""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    ok = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m.group().split(".")),
        "card": lambda m: 12 <= len(digits(m)) <= 19 and _luhn(digits(m)),
        "phone": lambda m: 9 <= len(digits(m)) <= 15,
    }
    for order, (kind, rx) in enumerate((("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))):
        spans += [(m.start(), order, m.end(), kind) for m in rx.finditer(text) if ok[kind](m)]
    spans.sort()
    listed = ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
    return [sum(x[3] == k for x in spans) for k in ("email", "ip", "card", "phone")], hashlib.sha256(listed.encode()).hexdigest(), listed


IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+(?![A-Za-z0-9_+/-])")


def further_spans(text):
    """kind:start:end of the kinds beyond the base ones, decided by validators and the words around, match by match."""
    text, out = text or "", []

    def near(matches, i):
        """The 40 characters before a match, and the first 40 after it, which end with the second next match."""
        m = matches[i]
        stop = matches[i + 2].start() if i + 2 < len(matches) else len(text)
        return text[max(m.start() - 40, 0) : m.start()], text[m.end() : min(m.end() + 40, stop)]

    for m in IBAN.finditer(text):
        c = m.group().replace(" ", "")
        if 15 <= len(c) <= 34 and int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1:
            out.append((m.start(), 4, m.end(), "iban"))
    found = list(SSN.finditer(text))
    for i, m in enumerate(found):
        g = m.group()
        if g[:3] not in ("000", "666") and g[0] != "9" and g[4:6] != "00" and g[7:] != "0000" and any(re.search(r"(?i)\bssn\b|social security", x) for x in near(found, i)):
            out.append((m.start(), 5, m.end(), "ssn"))
    if re.search("(?i)token|secret|passw|api.?key", text):
        found = list(SECRET.finditer(text))
        for i, m in enumerate(found):
            if re.search("[0-9]", m.group()) and re.search("[A-Za-z]", m.group()) and re.search(r"(?i)(?:token|secret|passw(?:or)?d|api[ _-]?key)[^A-Za-z0-9]{0,8}$", near(found, i)[0]):
                out.append((m.start(), 6, m.end(), "secret"))
    return out


def all_spans(text):
    """Base and further spans, listed by start, then kind."""
    order = {"email": 0, "ip": 1, "card": 2, "phone": 3}
    base = [(int(s), order[k], int(e), k) for k, s, e in (x.split(":") for x in pii(text)[2].split(",") if x)]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(base + further_spans(text)))


def repeats(docs, n=50):
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256) of exact substring dedup by n-byte strings."""
    first = {}
    data = {i: (t or "").encode() for i, t in docs}
    for i in sorted(data, reverse=True):
        for p in range(len(data[i]) - n + 1):
            first[data[i][p : p + n]] = i
    out = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if first[b[p : p + n]] < i:
                gone[p : p + n] = b"\1" * n
        runs = len(re.findall(b"\1+", gone))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def jaccard(a, b, k=5):
    """Jaccard similarity of word shingles; texts of fewer words are one shingle."""
    sets = []
    for t in (a, b):
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(len(w) - k, 0) + 1)} if w else set())
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


def classes(docs, threshold=0.8):
    """doc_id -> smallest doc_id of its group of linked documents."""
    ids = [i for i, _ in docs]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(docs):
        for j, b in docs[:x]:
            if (a or "").split() and jaccard(a, b) >= threshold:
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: find(i) for i in ids}
