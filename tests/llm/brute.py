"""Brute-force versions of what SQL can't express."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None, width: int = 5) -> frozenset:
    w = WORD.findall((text or "").translate(UPPER))
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def groups(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id -> (number of shingles, smallest id reachable by links of 0.75 or more)."""
    sets, up = [(i, shingles(t)) for i, t in docs], {i: i for i, _ in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns."""
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def digest(spans: list[tuple[int, int, int]]) -> str:
    names = ("assign", "access", "hex")
    return hashlib.sha256(",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def check_packing(rows: list[tuple], lengths: dict[int, int], capacity: int) -> int:
    """rows: (doc_id, piece, start, length, sequence_id, offset), each document of lengths once. The number of sequences."""
    of, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for doc, piece, start, length, seq, offset in rows:
        of[doc].append((piece, start, length))
        seqs[seq].append((offset, length))
    assert set(of) == set(lengths)
    for doc, parts in of.items():
        expected = [(k, a, min(capacity, lengths[doc] - a)) for k, a in enumerate(range(0, lengths[doc], capacity))]
        assert sorted(parts) == expected
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(seqs) >= math.ceil(sum(lengths.values()) / capacity)
    return len(seqs)


def first_fit_decreasing(lengths: list[int], capacity: int) -> int:
    """The number of sequences that first-fit decreasing needs."""
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        for k, room in enumerate(rooms):
            if n <= room:
                rooms[k] -= n
                break
        else:
            rooms.append(capacity - n)
    return len(rooms)


PROSE = " it was a long and quiet morning and the people of the town walked slowly along the river before they went to work in the fields and shops beyond the old bridge "
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")
L, U, D = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = [D + L[:6], D + U[:6], L, U, U + "234567", D + L, D + U, U + L, U + L + D, U + L + D + "+/", U + L + D + "-_", U + L + D + "+/-_"]


def randomness(token: str) -> float:
    """-ln of the combined p-value of the battery."""
    alphabet = next(a for a in ALPHABETS if set(token) <= set(a))
    n, k, x = len(token), len(alphabet), [alphabet.index(c) for c in token]
    chi = sum(token.count(c) ** 2 for c in alphabet) * k / n - n
    tail = lambda z: max(math.erfc(z / 2**0.5) / 2, 1e-300)
    turns = sum((2 * a >= k) != (2 * b >= k) for a, b in zip(x, x[1:], strict=False))
    serial = sum((a - (k - 1) / 2) * (b - (k - 1) / 2) for a, b in zip(x, x[1:], strict=False)) / ((k * k - 1) / 12)
    h = -math.log(tail((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)))
    h -= math.log(min(1, 2 * tail(abs(turns - (n - 1) / 2) / math.sqrt((n - 1) / 4)))) + math.log(min(1, 2 * tail(abs(serial) / math.sqrt(n - 1))))
    return h - math.log(1 + h + h * h / 2)


def decoys(token: str, text: str, n: int) -> list[str]:
    prose = re.sub(TOKEN.pattern + "|[^A-Za-z]+", " ", text).lower() + PROSE
    digits, out = re.sub("[^0-9]", "", token), []
    m = len(token) - len(digits)
    for r in range(1, n + 1):
        at = zlib.crc32(f"{token}:{r}".encode()) % len(prose)
        words = (prose[at:] + prose * (2 * m // len(prose) + 2))[: 2 * m]
        low, up = re.search("[a-z]", token), re.search("[A-Z]", token)
        words = " ".join(w[:1].upper() + w[1:] for w in words.split(" ")) if low and up else words.upper() if up else words
        words = words.replace(" ", "_" if r % 2 else "-") if re.search("[^0-9A-Za-z]", token) else words.replace(" ", "")
        w = words[:m].ljust(m, "e")
        out.append(w + digits if r % 3 == 0 else w[: m // 2] + digits + w[m // 2 :])
    return out


def random_spans(texts: dict[int, str], q: float, n: int) -> dict[int, list[tuple[int, int]]]:
    """The tokens beside base spans that Benjamini and Hochberg's rule picks in their class, by p-values from decoys."""
    tests, pool = collections.defaultdict(list), collections.defaultdict(list)
    bin_ = lambda t: min(400, math.floor(max(0, randomness(t)) * 8))
    for i, text in texts.items():
        base = base_spans(text)
        for m in TOKEN.finditer(text):
            if re.search("[A-Za-z]", m[0]) and not any(a < m.end() and m.start() < b for a, _, b in base):
                kind = (len(m[0]).bit_length(), *(bool(re.search(x, m[0])) for x in ("[0-9]", "[a-z]", "[A-Z]", "[^0-9A-Za-z]")))
                tests[kind].append((bin_(m[0]), i, m.start(), m.end()))
                pool[kind] += [bin_(d) for d in decoys(m[0], text, n)]
    out = collections.defaultdict(list)
    for kind, found in tests.items():
        p = sorted(((1 + sum(d <= t[0] for d in pool[kind])) / (1 + len(pool[kind])), t) for t in found)
        last = max((k for k in range(len(p)) if p[k][0] <= q * (k + 1) / len(p)), default=-1)
        for _, (_, i, a, b) in p[: last + 1]:
            out[i].append((a, b))
    return {i: sorted(x) for i, x in out.items()}
