"""Plain versions of the operators, to test them against."""

import hashlib
import re
import zlib

import xxhash

ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_secrets(text):
    s = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(s + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def contaminated(docs, items, n=13):
    """Rows of op2 for (doc_id, text) and (item_id, text)."""
    windows = {}
    for i, t in items:
        w = WORD.findall(lowered(t or ""))
        for k in range(max(1, len(w) - n + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for i, t in docs:
        w = WORD.findall(lowered(t or ""))
        hit, found = [False] * len(w), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if ids := windows.get(tuple(w[k : k + size])):
                    found |= ids
                    hit[k : k + size] = [True] * size
        h = sum(hit)
        out.append((i, len(w), h, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), h > 0 and 20 * h >= len(w)))
    return sorted(out)


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_duplicates(docs, distance=4):
    fp = {i: fingerprint(t) for i, t in docs}
    comp = {i: i for i in fp}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(fp)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fp[a] ^ fp[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return sorted((i, f"{fp[i]:016x}", find(i)) for i in ids)


def repeats(docs, n=50):
    seen, out = set(), []
    for _, group in sorted({i: [t for j, t in docs if j == i] for i, _ in docs}.items()):
        mine = set()
        for t in group:
            b = (t or "").encode()
            cover = bytearray(len(b))
            for k in range(len(b) - n + 1):
                mine.add(b[k : k + n])
                if b[k : k + n] in seen:
                    cover[k : k + n] = b"\1" * n
            kept = bytes(c for c, m in zip(b, cover, strict=True) if not m)
            runs = len(re.findall(b"\1+", bytes(cover)))
            out.append((_, len(b), sum(cover), runs, hashlib.sha256(kept).hexdigest()))
        seen |= mine
    return sorted(out)


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1
