"""Text rules: HTML to text, sentences, chunk strategies, names, similarity, hashed embeddings.

Plain functions on strings; ``udfs`` wraps them for Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache, reduce
from operator import or_

import numpy as np

from .wordlists import ABBREVIATIONS, HONORIFICS, ORG_ENDINGS, PLACE_ENDINGS, STOPWORDS

BLOCK_TAGS = {"p", "/p", "br", "div", "/div", "li", "/li", "tr", "/tr", *(f"{x}h{n}" for n in range(1, 7) for x in ("", "/"))}
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"))
JOINERS = {"of", "and", "for", "the", "de", "van", "von"}
_STOP, _BLACK, _ROUND, _EDGE = re.compile(r"[.!?](?=\s)"), re.compile(r"\S"), re.compile(r"^[\W_]+|[\W_]+$"), re.compile(r"^[^\w.&'-]+|[^\w.&'-]+$|^_+|_+$")
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ")


def html_to_text(html: str) -> str:
    """Drops tags and the bodies of script and style; bare block tags break lines; blank lines go."""
    out, at, skip = [], 0, None
    for m in re.finditer(r"<([^>]*)(>|\Z)", html):
        if skip is None:
            out.append(html[at : m.start()])
        at = m.end()
        if not m[2]:
            break
        tag = m[1].strip().lower()
        if skip is None and tag.startswith(("script", "style")):
            skip = "script" if tag.startswith("script") else "style"
            continue
        if skip is not None and tag.startswith(f"/{skip}"):
            skip = None
            continue
        if tag in BLOCK_TAGS:
            out.append("\n")
    if skip is None:
        out.append(html[at:])
    text = "".join(out)
    for name, char in ENTITIES:
        text = text.replace(name, char)
    return "\n".join(x for x in (line.strip() for line in text.split("\n")) if x)


def title_of(text: str, name: str) -> str:
    """The first level-one heading of the first twenty lines, else the name."""
    for line in text.split("\n")[:20]:
        if line.strip().startswith("# ") and (head := line.strip()[2:].strip()):
            return head
    return name


def _ends_sentence(word: str, following: str | None) -> bool:
    if following is not None and (following.islower() or following in "0123456789"):
        return False
    bare = _ROUND.sub("", word).lower()
    return bare not in ABBREVIATIONS and not (len(bare) == 1 and bare.isalpha())


def sentences(text: str) -> list[str]:
    """Cuts after ., ! or ? before white space; a dot after an abbreviation or initial, or before a small letter or digit, is no end."""
    out, start = [], 0
    for m in _STOP.finditer(text):
        current = text[start : m.end()]
        if not current.strip():
            continue
        rest = _BLACK.search(text, m.end())
        words = current.rstrip(".").rsplit(None, 1)
        if m[0] != "." or _ends_sentence(words[-1] if words else "", rest[0] if rest else None):
            out.append(current.strip())
            start = m.end()
    if text[start:].strip():
        out.append(text[start:].strip())
    return out


@dataclass(frozen=True)
class Chunker:
    """``kind[:size[:overlap]]``: whole, fixed, recursive (1000:150) or sentence (1000:1)."""

    kind: str = "recursive"
    size: int = 1000
    overlap: int = 150

    @classmethod
    def parse(cls, spec: str) -> Chunker:
        kind, *numbers = spec.strip().lower().split(":")
        if kind not in ("whole", "fixed", "recursive", "sentence") or len(numbers) > 2 or not all(n.isdigit() for n in numbers):
            raise ValueError(f"unknown chunker: {spec!r}")
        size = int(numbers[0]) if numbers else 1000
        overlap = int(numbers[1]) if len(numbers) > 1 else 1 if kind == "sentence" else min(150, max(size - 1, 0)) if numbers else 150
        out = cls(kind, size, overlap)
        if kind != "whole" and (size < 1 or kind != "sentence" and overlap >= size):
            raise ValueError(f"chunk size must be at least 1 and larger than the overlap: {spec!r}")
        return out

    @property
    def name(self) -> str:
        return "whole" if self.kind == "whole" else f"{self.kind}:{self.size}:{self.overlap}"

    def split(self, text: str | None) -> list[str]:
        text = (text or "").strip()
        if not text:
            return []
        make = {"whole": lambda: [text], "fixed": lambda: fixed(text, self.size, self.overlap), "recursive": lambda: merged(split_by(text, self.size, SEPARATORS), self.size, self.overlap), "sentence": lambda: packed(text, self.size, self.overlap)}
        return [p for p in (piece.strip() for piece in make[self.kind]()) if p]


def fixed(text: str, size: int, overlap: int) -> list[str]:
    step = max(size - overlap, 1)
    n = 1 if len(text) <= size else -(-(len(text) - size) // step) + 1
    return [text[i * step : i * step + size] for i in range(n)]


def split_by(text: str, size: int, seps: tuple[str, ...]) -> list[str]:
    """Pieces of ``size`` characters at most, cut at the coarsest separator that divides."""
    while len(text) > size and seps and seps[0] not in text:
        seps = seps[1:]
    if len(text) <= size:
        return [text]
    if not seps:
        return fixed(text, size, 0)
    parts = text.split(seps[0])
    pieces = [p + seps[0] for p in parts[:-1]] + parts[-1:]
    return [x for p in pieces if p.strip() for x in ([p] if len(p) <= size else split_by(p, size, seps[1:]))]


def merged(pieces: list[str], size: int, overlap: int) -> list[str]:
    out, current = [], ""
    for piece in pieces:
        if current and len(current) + len(piece) > size:
            out.append(current)
            current = _tail(current, overlap)
        current += piece
    return out + [current] if current.strip() else out


def _tail(text: str, n: int) -> str:
    tail = text[-n:] if n else ""
    m = re.search(r"\s", tail)
    return tail[m.start() :].lstrip() if m and len(tail[: m.start()].encode()) < n // 2 else tail


def packed(text: str, size: int, overlap: int) -> list[str]:
    out, current = [], []
    for s in sentences(text):
        if current and sum(map(len, current)) + len(s) > size:
            out.append(" ".join(current))
            keep = min(overlap, len(current) - 1)
            current = current[len(current) - keep :]
        current.append(s)
    return out + [" ".join(current)] if current else out


def candidates(text: str) -> list[str]:
    """Runs of capitalised words, joined by small words such as "of", sentence by sentence."""
    out: list[str] = []

    def close(run: list[str]) -> None:
        while run and run[-1].lower() in JOINERS:
            run.pop()
        if run:
            out.append(" ".join(run))
        run.clear()

    for line in text.splitlines():
        for sentence in sentences(line.lstrip("#-*> \t")):
            run: list[str] = []
            for k, raw in enumerate(sentence.split()):
                if not run and raw.islower():  # no capital: it can't begin a run
                    continue
                word = raw if raw.isalpha() else _EDGE.sub("", raw)
                bare = word.rstrip(".")
                named = bare[:1].isupper() and not (k == 0 and bare.lower() in STOPWORDS)
                if bare and (named or run and bare.lower() in JOINERS):
                    run.append(word)
                    if raw[-1] in ",;:)]\"":
                        close(run)
                else:
                    close(run)
            close(run)
    return out


def normal_name(name: str) -> str:
    low = name.lower()
    words = (low if low.isalnum() else "".join(c if c.isalnum() or c == "&" else " " for c in low)).split()
    return " ".join(words[1:] if len(words) > 1 and words[0] == "the" else words)


def classify(name: str) -> tuple[str, float]:
    """Type and confidence. Fixed rules: their order and figures decide the results."""
    words = name.lower().split()
    if not words:
        return "concept", 0.3
    if words[-1] in ORG_ENDINGS:
        return "org", 0.9
    if words[-1] in PLACE_ENDINGS:
        return "place", 0.8
    if words[0].rstrip(".") in HONORIFICS:
        return "person", 0.9
    if re.fullmatch(r"[A-Z&]{2,6}", name):
        return "org", 0.7
    if len(words) in (2, 3) and not {"of", "and", "for", "the"} & set(words):
        return "person", 0.45
    return "concept", 0.4


def entities(text: str | None, least: int = 1) -> list[tuple[str, str, str, float, int]]:
    """(name, normal form, type, confidence, mentions), by first mention; of surface forms the longest in bytes names it."""
    seen: dict[str, list[str]] = {}
    for name in candidates(text or ""):
        if (key := normal_name(name)) and key not in STOPWORDS:
            seen.setdefault(key, []).append(name)
    best = {k: max(v, key=lambda s: len(s.encode())) for k, v in seen.items() if len(v) >= least}
    return [(n, k, *classify(n), len(seen[k])) for k, n in best.items()]


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(left, (c for c, u in zip(b, used, strict=True) if u), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    if jaro < 0.7:
        return jaro
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + same * 0.1 * (1 - jaro)


def name_similarity(a: str, b: str) -> float:
    a, b = normal_name(a), normal_name(b)
    return _similarity(a, a.split(), b, b.split())


def _similarity(a: str, a_words: list[str], b: str, b_words: list[str]) -> float:
    """Of two normal forms and their words."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    short, long = sorted((a_words, b_words), key=len)
    if all(t in long for t in short):
        return 0.95
    initial = lambda x, y: len(x.encode()) == 1 and y.startswith(x)
    if len(short) == len(long) and all(x == y or initial(x, y) or initial(y, x) for x, y in zip(short, long, strict=True)):
        return 0.93
    return jaro_winkler(a, b)


def _may_resemble(names: list[str], words: list[list[str]], threshold: float, cells: int = 1 << 16) -> Iterator[Sequence[int]]:
    """For each name the places of those before it, in order, that can be similar by ``threshold``: exact bounds, for ``cells`` pairs at a time.

    Words of one name can all be in the other, first letters can be the same, or the characters in common, wherever they stand, leave Jaro-Winkler high enough."""
    n = len(names)
    if n <= 4:
        yield from map(range, range(n))
        return
    sizes = np.array([len(x) for x in names])
    codes = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32) & 31
    counts = np.bincount(np.repeat(np.arange(n), sizes) * 32 + codes, minlength=n * 32).reshape(n, 32)
    counts = counts.astype(np.uint8 if counts.max() < 256 else np.int32)
    heads = np.array([[ord(c) for c in x[:4]] + [-1] * (4 - len(x[:4])) for x in names], np.int64)
    held = np.array([reduce(or_, (1 << (hash(t) & 63) for t in w), 0) for w in words], np.uint64)
    first = np.array([hash(tuple(t[0] for t in w)) for w in words], np.int64)
    share = 1 / np.maximum(sizes, 1)
    step = max(1, cells // n)
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        m = np.minimum(counts[lo:hi, None], counts[None, :hi]).sum(axis=2, dtype=np.int64)
        jaro = (m * share[lo:hi, None] + m * share[None, :hi] + 1) / 3
        same = np.logical_and.accumulate(heads[lo:hi, None] == heads[None, :hi], axis=2).sum(axis=2)
        a, b = held[lo:hi, None], held[None, :hi]
        near = (jaro + 0.1 * same * (1 - jaro) >= threshold - 1e-9) | (a & ~b == 0) | (b & ~a == 0) | (first[lo:hi, None] == first[None, :hi])
        near &= np.arange(hi)[None] < np.arange(lo, hi)[:, None]
        for row in near:
            yield np.flatnonzero(row).tolist()


def find_aliases(rows: list[tuple[str, str, str, int]], threshold: float = 0.92, across_types: bool = False) -> list[tuple[str, str, float]]:
    """(alias id, head id, similarity) for (id, name, type, mentions): names join the first head they resemble; heads never chain."""
    rows = sorted(rows, key=lambda r: (-r[3], -len(r[1].encode()), r[0]))
    kinds: dict[str | None, list[int]] = {}
    for place, row in enumerate(rows):
        kinds.setdefault(None if across_types else row[2], []).append(place)
    out = []
    for places in kinds.values():
        names = [normal_name(rows[p][1]) for p in places]
        words = [x.split() for x in names]
        head = [True] * len(places)
        for i, near in enumerate(_may_resemble(names, words, threshold)):
            for j in near:
                if head[j] and (s := _similarity(names[j], words[j], names[i], words[i])) >= threshold:
                    out.append((places[i], rows[places[i]][0], rows[places[j]][0], s))
                    head[i] = False
                    break
    return [x[1:] for x in sorted(out, key=lambda x: x[0])]


@lru_cache(1 << 16)
def _slots(term: str) -> tuple[int, int]:
    h = fnv1a(term.encode())
    return h, fnv1a(h.to_bytes(8, "little"))


def fnv1a(data: bytes, h: int = 0xCBF29CE484222325) -> int:
    for byte in data:
        h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def hash_embedding(text: str | None, dim: int = 256) -> list[float]:
    """Signed hashing of words (weight 1) and adjacent pairs (1/2) into two slots each, scaled to unit length."""
    v = np.zeros(dim)
    words = re.findall(r"[^\W_]+", text or "")
    words = [w.lower() for w in words]
    for term, weight in [*((w, 1.0) for w in words), *((f"{x} {y}", 0.5) for x, y in zip(words, words[1:], strict=False))]:
        for code, share in zip(_slots(term), (1.0, 0.5), strict=True):
            v[code % dim] += weight * share * (-1 if code >> 32 & 1 else 1)
    norm = float(np.sqrt((v * v).sum()))
    return (v / norm if norm > 1.1920929e-7 else v).tolist()


def _fnv1a_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray, most: int = 256) -> np.ndarray:
    """``fnv1a`` of each span of bytes, going on from ``h``: a byte of all spans at a time, what is beyond ``most`` bytes one by one."""
    order = np.argsort(start - end, kind="stable")  # longest first
    start, size, h = start[order], (end - start)[order], h[order]
    left = np.searchsorted(-size, -np.arange(1, min(int(size[0]) if len(size) else 0, most) + 1), side="right")
    for k, n in enumerate(left.tolist()):
        h[:n] = (h[:n] ^ data[start[:n] + k]) * np.uint64(0x100000001B3)
    for i in range(int(np.searchsorted(-size, -most, side="left"))):
        h[i] = fnv1a(data[start[i] + most : start[i] + size[i]].tobytes(), int(h[i]))
    out = np.empty_like(h)
    out[order] = h
    return out


def hash_embeddings(texts: list[str | None], dim: int = 256) -> np.ndarray:
    """``hash_embedding`` of each text, all at once. Words stand in one array of bytes, so that a pair is a span of it too."""
    data = np.frombuffer("\n".join(" ".join(re.findall(r"[^\W_]+", t or "")).lower() for t in texts).encode() + b"\n", np.uint8)
    cut = np.flatnonzero((data == 32) | (data == 10))
    start, text = np.concatenate(([0], cut[:-1] + 1)), np.concatenate(([0], np.cumsum(data[cut[:-1]] == 10)))
    paired = data[cut] == 32  # the next word is of the same text
    real = cut > start
    start, end, text, paired = start[real], cut[real], text[real], paired[real]
    words = _fnv1a_spans(data, start, end, np.full(len(start), 0xCBF29CE484222325, np.uint64))
    pairs = _fnv1a_spans(data, end[paired], end[np.flatnonzero(paired) + 1], words[paired])
    v = np.zeros(len(texts) * dim)
    for h, of, weight in ((words, text, 1.0), (pairs, text[paired], 0.5)):
        again = np.full(len(h), 0xCBF29CE484222325, np.uint64)
        for k in range(8):
            again = (again ^ (h >> np.uint64(8 * k) & np.uint64(255))) * np.uint64(0x100000001B3)
        for code, share in ((h, 1.0), (again, 0.5)):
            sign = 1.0 - 2.0 * (code >> np.uint64(32) & np.uint64(1)).astype(np.float64)
            v += np.bincount(of * dim + (code % np.uint64(dim)).astype(np.int64), weight * share * sign, len(v))
    v = v.reshape(len(texts), dim)
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(norm > 1.1920929e-7, norm, 1.0)


def lcs_diff(old: list[str], new: list[str], most: int = 2000) -> list[tuple[str, str]]:
    """(op, text) with op same, removed or added; at a tie what is removed comes first. Beyond ``most`` all is replaced."""
    if len(old) > most or len(new) > most:
        return [("removed", x) for x in old] + [("added", x) for x in new]
    n, m = len(old), len(new)
    code: dict[str, int] = {}
    a, b = (np.array([code.setdefault(x, len(code)) for x in side], np.int64) for side in (old, new))
    t = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n - 1, -1, -1):  # a row at a time: the best so far, from its end
        t[i, :m] = np.maximum.accumulate(np.where(b == a[i], t[i + 1, 1:] + 1, t[i + 1, :-1])[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < n and j < m:
        if old[i] == new[j]:
            out.append(("same", old[i]))
            i, j = i + 1, j + 1
        elif t[i + 1, j] >= t[i, j + 1]:
            out.append(("removed", old[i]))
            i += 1
        else:
            out.append(("added", new[j]))
            j += 1
    return out + [("removed", x) for x in old[i:]] + [("added", x) for x in new[j:]]
