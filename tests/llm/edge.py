"""Small documents with every awkward case, and brute-force versions of the operators."""
import hashlib
import re
from collections import Counter

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, h1 bigint, content string, words string, start string, kind string, node string"
LINE = "This line is held by very many documents."
BODY = " ".join(f"word{k} thing{k * 7 % 13}" for k in range(60))
ASCII_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def awkward_rows():
    """(doc_id, text) with nulls, empty and long texts, ties, repeated rows and odd characters."""
    texts = [None, "", " ", "\n", "a", BODY, BODY, f"{LINE}\nfirst\n{LINE}", f"  {LINE.upper()}\t\nsecond", f"third\n{LINE.lower()}", BODY + " changed", "ab " * 3000, "é" * 500 + "日本語 " * 50,
             "Écrire à x.y@example.org ou +33 (0)1 23 45 67 89, carte 4111 1111 1111 1111, 10.0.0.255 et 300.1.1.1", "x" * 4000, "\x1c\x85 odd spaces\r\n\ttabs", "!!! ??? 123", "a\0b\0 c"]
    rows = [(k, t) for k, t in enumerate(texts)]
    return rows + [(5, BODY), (None, BODY), (None, None)]   # a repeated row and rows without id


def frame(spark, rows):
    """The rows with further columns whose names clash with those that the operators use."""
    full = [(d, t, None if d is None or d % 4 == 3 else ("en", "fr")[d % 2], None, None, "k", 1, "c", "w", "s", "x", "n") for d, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def empty(spark):
    return frame(spark, awkward_rows()).limit(0)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


class Groups:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def lower(text):
    return text.translate({k: k + 32 for k in range(65, 91)})


def line_dedup(docs):
    """docs: {(id, text)} distinct. Returns kept text per document, number of lines and of dropped ones."""
    key = lambda line: lower(line.strip(" \t\n\x0b\f\r"))
    held = {}
    for d, t in docs:
        for k in {key(x) for x in t.split("\n")}:
            held.setdefault(k, []).append(d)
    out = {}
    for d, t in docs:
        lines = t.split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(held[key(x)]) < 3 or d == max(held[key(x)], key=lambda v: -1 if v is None else v)]
        out[d, t] = "\n".join(kept), len(lines), len(lines) - len(kept)
    return out


def repeats(docs, threshold):
    """docs: [(id, bytes)] in order. Returns (removed, spans, kept) per document."""
    seen, out = set(), []
    for _, data in docs:
        gone = [False] * len(data)
        for p in range(len(data) - threshold + 1):
            window = data[p:p + threshold]
            if window in seen:
                gone[p:p + threshold] = [True] * threshold
            seen.add(window)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((sum(gone), spans, bytes(b for b, g in zip(data, gone) if not g)))
    return out


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def quality_counts(text):
    words = ASCII_WORD.findall(text)
    shingles = Counter(zip(words, words[1:], words[2:]))
    hit = {k + j for k in range(len(words) - 2) if shingles[tuple(words[k:k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if ASCII_WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)
