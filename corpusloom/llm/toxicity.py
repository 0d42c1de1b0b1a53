"""Toxicity by a subsequence string kernel and a support vector machine with Nystroem landmarks.

A text is lower-cased, cut into sentences (and those into stretches of at most STRETCH words); punctuation and marks within words
go, so that "id-iot" is one word, and runs of single letters ("i d i o t") are joined to one more word. Runs of Han characters and kana, which have
no blanks, count as their overlapping pairs. Characters are Unicode code points, so every script has its own letters.

The kernel of two words is the gap-weighted subsequence kernel (Lodhi et al., 2002) of orders 1 to 4 side by side: every so many
characters in order count, weighted by LAMBDA to the power of their span, divided per order by the norms of both words, so insults with
inserted or missing characters stay close. A landmark of four characters or more takes part with order 4, a shorter one with its own
length, so that words of two and three letters are told apart as well. A word over LONG characters is scored whole (in parts of PART characters
that overlap by half, with spans of at most SPAN) and by its overlapping windows, and has the greatest of these scores.
The kernel of a sentence and a landmark is the sum over the sentence's distinct words (a convolution kernel).

Training (driver, on a bounded sample of labelled documents): words that go with toxic documents and clean words like them
are landmarks; a sentence's kernel values with them, whitened (Nystroem), are its features; a linear SVM
with squared hinge loss separates sentences. Labels are of documents, so toxic sentences are those of toxic
documents with a landmark or, in later rounds, those that the machine rejects (MI-SVM); landmarks with an inserted
character are further examples. The decision function is a sum over subsequences of characters, so the model
is one weight for each that a landmark has; scoring is exact, in numpy on Arrow buffers, and keeps known words' scores.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import CHUNK, buffers, mix, process_cache
from corpusloom.runtime import small_batches

LAMBDA = 0.8
STRETCH = 8
ORDER = 4
#: Words up to this length have all their subsequences counted; in parts of longer ones those of at most SPAN characters.
LONG, SPAN, PART = 16, 12, 64
WINDOW, STEP = 12, 3
#: Scores of words that a worker remembers; beyond, it starts anew.
KNOWN = 500_000
#: Subsequences in memory at once.
CELLS = 400_000
#: Documents for training, half of them toxic; the bound of the labelled sample.
MAX_TRAIN = 1600
LANDMARKS = (64, 64)
#: Weights of a model: per order the names of subsequences in rising order, their weights, and which slots of a table the names fall in.
Weights = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
SLOTS = 20
P, Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def code_points(b: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Code points of UTF-8 bytes, and where each begins (None: every byte is one)."""
    if not len(b) or b.max() < 128:
        return b, None
    at = np.flatnonzero((b & 0xC0) != 0x80)
    wide = np.concatenate([b, np.zeros(3, np.uint8)])
    lead = wide[at]
    x = lead.astype(np.uint32)
    for size, low, high in ((2, 0xC0, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0x100)):
        k = np.flatnonzero((lead >= low) & (lead < high))
        y = x[k] & (0x7F >> size)
        for j in range(1, size):
            y = y << 6 | (wide[at[k] + j] & 0x3F)
        x[k] = y
    return x, at


class _Codes:
    """Character codes of a word given as UTF-8 bytes: digits are one character, all others themselves."""

    def __getitem__(self, b: np.ndarray) -> np.ndarray:
        return coded(np.frombuffer(np.asarray(b, np.uint8).tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32))


def coded(c: np.ndarray) -> np.ndarray:
    return np.where((c >= 48) & (c <= 57), 48, c).astype(np.uint64)


def _tables() -> tuple[np.ndarray, _Codes]:
    """Class of each character of the basic plane (0 dropped, 1 character, 2 blank, 3 of a script without blanks), and the coder."""
    cache = process_cache("toxicity")
    if "made" not in cache:
        cache["made"] = _made_tables()
    return cache["made"]


def _made_tables() -> tuple[np.ndarray, _Codes]:
    kind = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        k = unicodedata.category(chr(c))[0]
        if c < 128:
            kind[c] = 1 if chr(c).isalnum() else 2 if chr(c) in " \t\n\r\v\f\0" else 0
        else:
            kind[c] = {"L": 1, "N": 1, "S": 1, "Z": 2}.get(k, 0)
    for a, z in ((0x2E80, 0x3000), (0x3040, 0x3100), (0x31F0, 0x3200), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00)):
        kind[a:z][kind[a:z] == 1] = 3
    return kind, _Codes()


def split_units(offsets: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in a byte buffer (offsets from 0): kept characters, begin and end of each word in them, its stretch (rising
    numbers) and its text."""
    kind, _ = process_cache("toxicity").setdefault("tables", _tables())
    b, at = code_points(b)
    if at is not None:
        offsets = np.searchsorted(at, offsets)
        k = kind[np.minimum(b, 0xFFFF)]
        k[b > 0xFFFF] = 1
        k[b >= 0x20000] = 3
    else:
        k = kind[b]
    last = np.zeros(len(b) + 1, bool)
    last[offsets[1:]] = True
    blank_next = np.concatenate([k[1:] == 2, [True]]) | last[1:]
    stop = (b == 10) | (((b == 46) | (b == 33) | (b == 63)) & blank_next)
    if at is not None:
        stop |= (b == 0x3002) | (b == 0xFF01) | (b == 0xFF1F) | (b == 0x0964)
    kept = k != 0
    pos = np.concatenate([[0], np.cumsum(kept)])
    off = pos[offsets]
    b2, k2 = b[kept], k[kept]
    char = k2 != 2
    edge = np.zeros(len(b2) + 1, bool)
    edge[off] = True
    other = k2[1:] != k2[:-1]  # a word is of one kind
    before = np.concatenate([[True], other]) | edge[:-1] if len(char) else np.zeros(0, bool)
    after = np.concatenate([other, [True]]) | edge[1:] if len(char) else np.zeros(0, bool)
    s, e = np.flatnonzero(char & before), np.flatnonzero(char & after) + 1
    if at is not None and (han := k2[s] == 3).any():
        first, size = s[han], (e - s)[han]
        n = np.maximum(size - 1, 1)
        pair = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ends = np.minimum(pair + 2, np.repeat(e[han], n))
        s, e = np.concatenate([s[~han], pair]), np.concatenate([e[~han], ends])
        order = np.argsort(s, kind="stable")
        s, e = s[order], e[order]
    cuts = np.unique(np.concatenate([pos[np.flatnonzero(stop)], off]))
    sentence = np.searchsorted(cuts, s, "right")
    doc = np.searchsorted(off, s, "right") - 1
    if len(s):
        first = np.concatenate([[True], sentence[1:] != sentence[:-1]])
        nth = np.arange(len(s)) - np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
        stretch = np.cumsum(first | (nth % STRETCH == 0)) - 1
    else:
        stretch = np.zeros(0, np.int64)
    return b2, s, e, stretch, doc


def _grams(n: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the subsequences of a word of n characters, and their weights."""
    cache = process_cache("toxicity")
    if (n, order) not in cache:
        if n <= LONG:
            idx = np.array(list(combinations(range(n), order)), np.int64).reshape(-1, order)
        else:
            rest = np.array(list(combinations(range(1, SPAN), order - 1)), np.int64).reshape(-1, order - 1)
            idx = np.concatenate([np.hstack([np.full((len(r), 1), i), i + r]) for i in range(n) if len(r := rest[(rest < n - i).all(1)])])
        cache[n, order] = idx, LAMBDA ** (idx[:, -1] - idx[:, 0] + 1.0)
    return cache[n, order]


def gram_names(codes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For words of one length as rows of character codes: 64-bit names of their subsequences, and these' weights."""
    idx, lam = _grams(codes.shape[1], order)
    with np.errstate(over="ignore"):
        t = codes[:, idx[:, 0]] + np.uint64(order << 32)
        for k in range(1, order):
            t = t * P + codes[:, idx[:, k]]
        return t * Q, lam


def _norms(t: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """Norm of each row in feature space: equal subsequences of a word are one feature."""
    if t.shape[1] == 1:
        return np.full(len(t), lam[0])
    order = np.argsort(t, axis=1, kind="stable")
    ts, ls = np.take_along_axis(t, order, 1), lam[order]
    new = np.ones(ts.shape, bool)
    new[:, 1:] = ts[:, 1:] != ts[:, :-1]
    heads = np.flatnonzero(new.ravel())
    sums = np.add.reduceat(ls.ravel(), heads)
    return np.sqrt(np.bincount(heads // ts.shape[1], sums * sums, minlength=len(t)))


def _found(t: np.ndarray, names: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and column of the subsequences that are among the names, and which."""
    r, g = np.nonzero(slots[t >> np.uint64(64 - SLOTS)])
    which = np.searchsorted(names, t[r, g])
    which[which == len(names)] = 0
    on = names[which] == t[r, g]
    return r[on], g[on], which[on]


def _slots(names: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << SLOTS, bool)
    out[names >> np.uint64(64 - SLOTS)] = True
    return out


def _score_rows(codes: np.ndarray, weight: Weights) -> np.ndarray:
    """Decision values of words of one length, as rows of codes."""
    out, n = np.zeros(len(codes)), codes.shape[1]
    for order, (names, value, slots) in weight.items():
        if n < order:
            continue
        step = max(1, CELLS // len(_grams(n, order)[0]))
        for k in range(0, len(codes), step):
            t, lam = gram_names(codes[k : k + step], order)
            r, g, which = _found(t, names, slots)
            if len(r):
                raw = np.bincount(r, value[which] * lam[g], minlength=len(t))
                hit = np.unique(r)
                out[k + hit] += raw[hit] / _norms(t[hit], lam)
    return out


def _pieces(n: int) -> list[tuple[int, int]]:
    """Begin and length of what a long word is scored by: parts that overlap by half, and windows at every few characters."""
    parts = [(a, min(PART, n - a)) for a in range(0, max(1, n - PART // 2), PART // 2)]
    return parts + [(a, WINDOW) for a in [*range(0, n - WINDOW, STEP), n - WINDOW]]


def score_words(codes: list[np.ndarray], weight: Weights) -> np.ndarray:
    """Decision value of single words given as arrays of character codes."""
    out = np.zeros(len(codes))
    by: dict[int, list[int]] = {}
    for i, c in enumerate(codes):
        by.setdefault(len(c), []).append(i)
    for n, ids in by.items():
        if n <= LONG:
            out[ids] = _score_rows(np.stack([codes[i] for i in ids]).astype(np.uint64), weight) if n else 0.0
            continue
        for i in ids:
            same: dict[int, list[int]] = {}
            for a, size in _pieces(n):
                same.setdefault(size, []).append(a)
            c = codes[i].astype(np.uint64)
            out[i] = max(_score_rows(c[np.array(at)[:, None] + np.arange(size)], weight).max() for size, at in same.items())
    return out


def _unit_scores(b2: np.ndarray, s: np.ndarray, e: np.ndarray, weight: Weights, model: str) -> tuple[np.ndarray, np.ndarray]:
    cache = process_cache("toxicity-scores")
    if cache.get("model") != model or len(cache.get("h", ())) > KNOWN:
        cache.clear()
        cache["model"] = model
    known_h, known_v = cache.get("h", np.zeros(0, np.uint64)), cache.get("v", np.zeros(0))
    h = word_names(b2, s, e)
    uniq, first, inv = np.unique(h, return_index=True, return_inverse=True)
    at = np.searchsorted(known_h, uniq)
    at[at == len(known_h)] = 0
    seen = known_h[at] == uniq if len(known_h) else np.zeros(len(uniq), bool)
    vals = np.zeros(len(uniq))
    if seen.any():
        vals[seen] = known_v[at[seen]]
    new = np.flatnonzero(~seen)
    if len(new):
        ns, ne = s[first[new]], e[first[new]]
        size = ne - ns
        for n in np.unique(size):
            own = np.flatnonzero(size == n)
            if n > LONG:
                vals[new[own]] = score_words([coded(b2[ns[i] : ne[i]]) for i in own], weight)
            else:
                vals[new[own]] = _score_rows(coded(b2[ns[own][:, None] + np.arange(n)]), weight)
        hs, vs = np.concatenate([known_h, uniq[new]]), np.concatenate([known_v, vals[new]])
        order = np.argsort(hs)
        cache["h"], cache["v"] = hs[order], vs[order]
    return vals[inv], h


def word_names(b2: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's characters."""
    cache = process_cache("toxicity-powers")
    if cache.get("n", 0) < len(b2) + 1:
        n = max(len(b2) + 1, CHUNK + (CHUNK >> 2))
        with np.errstate(over="ignore"):
            up, down = np.full(n, P), np.full(n, np.uint64(pow(int(P), -1, 1 << 64)))
            up[0] = down[0] = 1
            cache.update(n=n, up=np.cumprod(up, dtype=np.uint64), down=np.cumprod(down, dtype=np.uint64), value=mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64) * Q))
    up, down, value = cache["up"], cache["down"], cache["value"]
    total = np.zeros(len(b2) + 1, np.uint64)
    with np.errstate(over="ignore"):
        v = value[b2] if b2.dtype == np.uint8 else value[b2 & 0xFFFF]
        if b2.dtype != np.uint8 and len(far := np.flatnonzero(b2 > 0xFFFF)):
            v[far] = mix((b2[far].astype(np.uint64) + np.uint64(1)) * Q)
        np.cumsum(v * up[: len(b2)], out=total[1:])
        return mix((total[e] - total[s]) * down[s])


def spelled(b2: np.ndarray, s: np.ndarray, e: np.ndarray, doc: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Runs of at least three single-letter words of one text: index of the first word, and the characters of the joined word."""
    one = (e - s == 1).astype(np.int8)
    if not len(one):
        return []
    d = np.diff(np.concatenate([[0], one, [0]]))
    out = []
    for a, z in zip(np.flatnonzero(d == 1), np.flatnonzero(d == -1), strict=True):
        if z - a >= 3:
            for x in np.split(np.arange(a, z), np.flatnonzero(np.diff(doc[a:z])) + 1):
                if len(x) >= 3:
                    out.append((int(x[0]), b2[s[x]]))
    return out


def score_chunk(offsets: np.ndarray, b: np.ndarray, weight: Weights, model: str) -> tuple[np.ndarray, np.ndarray]:
    """Score of each stretch in which something speaks for or against, and the text it is of."""
    b2, s, e, stretch, doc = split_units(offsets, b)
    if not len(s):
        return np.zeros(0), np.zeros(0, np.int64)
    v, h = _unit_scores(b2, s, e, weight, model)
    if extra := spelled(b2, s, e, doc):
        np.add.at(v, [i for i, _ in extra], score_words([coded(x) for _, x in extra], weight))
    hit = np.flatnonzero(v)  # most words share no subsequence with a landmark
    if not len(hit):
        return np.zeros(0), np.zeros(0, np.int64)
    key = mix(stretch[hit].astype(np.uint64)) ^ h[hit]
    hit = hit[np.sort(np.unique(key, return_index=True)[1])]
    heads = np.concatenate([[0], np.flatnonzero(np.diff(stretch[hit])) + 1])
    return np.add.reduceat(v[hit], heads), doc[hit[heads]]


class Model:
    """Weights of subsequences and the threshold of a stretch's score."""

    def __init__(self, weight: Weights, threshold: float, name: str) -> None:
        self.weight, self.threshold, self.name = weight, threshold, name


def _utf8(c: np.ndarray) -> bytes:
    return "".join(map(chr, c.tolist())).encode("utf-8", "surrogatepass")


def _train_units(text: str, vocab: dict[bytes, int]) -> list[np.ndarray]:
    """Numbers of the distinct words of each stretch, as split_units has them; new words are numbered."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    b2, s, e, stretch, doc = split_units(np.array([0, len(raw)]), raw)
    plain = b2.tobytes() if b2.dtype == np.uint8 else None
    out: dict[int, set[int]] = {}
    for a, z, k in zip(s.tolist(), e.tolist(), stretch.tolist(), strict=True):
        out.setdefault(k, set()).add(vocab.setdefault(plain[a:z] if plain is not None else _utf8(b2[a:z]), len(vocab)))
    for i, x in spelled(b2, s, e, doc):
        out[int(stretch[i])].add(vocab.setdefault(_utf8(x), len(vocab)))
    return [np.array(sorted(x), np.int32) for x in out.values()]


def _landmarks(marks: list[bytes], code: _Codes) -> tuple[np.ndarray, Weights]:
    """Features of landmarks as a dense matrix, each with the order of its length (ORDER at most), and per order the names of the
    subsequences that they have, their columns and the table of slots. Landmarks are read up to PART characters."""
    feats: list[tuple[int, Counter]] = []
    for w in marks:
        c = code[np.frombuffer(w, np.uint8)][:PART]
        t, lam = gram_names(c[None, :], order := min(ORDER, len(c)))
        f: Counter = Counter()
        for k, x in zip(t[0].tolist(), lam.tolist(), strict=True):
            f[k] += x
        norm = sum(x * x for x in f.values()) ** 0.5
        feats.append((order, Counter({k: x / norm for k, x in f.items()})))
    where: Weights = {}
    column: dict[tuple[int, int], int] = {}
    for order in sorted({o for o, _ in feats}):
        names = np.array(sorted({t for o, f in feats if o == order for t in f}), np.uint64)
        where[order] = names, np.arange(len(names)) + len(column), _slots(names)
        column |= {(order, t): i + len(column) for i, t in enumerate(names.tolist())}
    phi = np.zeros((len(marks), len(column)))
    for i, (o, f) in enumerate(feats):
        phi[i, [column[o, t] for t in f]] = list(f.values())
    return phi, where


def _kernels(words: list[bytes], phi: np.ndarray, where: Weights, code: _Codes) -> np.ndarray:
    """Kernel values of words (rows) with landmarks; of a long word, for each landmark the greatest of its pieces'."""
    known, by_gram = np.zeros((len(words), len(phi)), np.float32), np.ascontiguousarray(phi.T, np.float32)
    pieces: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, w in enumerate(words):
        c = code[np.frombuffer(w, np.uint8)]
        for p in [c] if len(c) <= LONG else [c[a : a + n] for a, n in _pieces(len(c))]:
            pieces.setdefault(len(p), []).append((i, p))
    for n, group in pieces.items():
        for order, (names, cols, slots) in where.items():
            step = max(1, 60_000 // len(_grams(n, order)[0])) if n >= order else 0
            for k in range(0, len(group) if step else 0, step or 1):
                t, lam = gram_names(np.stack([p for _, p in group[k : k + step]]), order)
                r, g, which = _found(t, names, slots)
                if len(r):
                    v = by_gram[cols[which]] * (lam[g] / _norms(t, lam)[r]).astype(np.float32)[:, None]
                    heads = np.concatenate([[0], np.flatnonzero(np.diff(r)) + 1])
                    own = np.zeros((len(t), len(phi)), np.float32)
                    own[r[heads]] = np.add.reduceat(v, heads, axis=0)
                    # a landmark has one order, so maxima of pieces and of orders are the same
                    np.maximum.at(known, np.array([i for i, _ in group[k : k + step]]), own)
    return known


def svm(pos: np.ndarray, neg: np.ndarray, c: float = 1000.0, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by Newton steps; both classes weigh the same."""
    m = pos.shape[1] + 1
    w, ridge = np.zeros(m), np.eye(m)
    ridge[-1, -1] = 1e-3
    for _ in range(rounds):
        left, right = ridge.copy(), np.zeros(m)
        for x, y in ((pos, 1.0), (neg, -1.0)):
            for k in range(0, len(x), 16384):
                z = np.hstack([x[k : k + 16384], np.ones((len(x[k : k + 16384]), 1))]).astype(np.float64)
                z = z[y * (z @ w) < 1]
                left += z.T @ z * (c / len(x))
                right += z.sum(0) * (y * c / len(x))
        w = np.linalg.solve(left, right)
    return w[:-1], float(w[-1])


def train(toxic: list[str], clean: list[str], seed: int = 7) -> Model:
    """A model from texts of toxic and clean documents. Without a text in either list nothing is toxic."""
    _, code = process_cache("toxicity").setdefault("tables", _tables())
    vocab: dict[bytes, int] = {}
    pos, neg = [_train_units(t, vocab) for t in toxic], [_train_units(t, vocab) for t in clean]
    words = list(vocab)
    length = np.array([len(w.decode("utf-8", "replace")) for w in words])
    fits = (length <= PART) & ((length > 1) | np.array([not w.isalnum() for w in words], bool))  # a single letter or digit says nothing
    dp, dn = (np.bincount(np.concatenate([np.zeros(0, np.int64), *(np.unique(np.concatenate(d)) for d in x if d)]), minlength=len(words)) * fits for x in (pos, neg))
    none = Model({}, 1.0, f"none-{seed}")
    if not dp.any() or not dn.any():
        return none
    n1, n0 = len(pos), len(neg)
    bar = np.log(((dp > 0).sum() + (dn > 0).sum()) / 0.01)  # a log-likelihood ratio that no word of this vocabulary reaches by chance
    with np.errstate(divide="ignore", invalid="ignore"):
        evidence = np.nan_to_num(dp * np.log(dp / ((dp + dn) * n1 / (n1 + n0)))) + np.nan_to_num(dn * np.log(dn / ((dp + dn) * n0 / (n1 + n0))))
    telling = np.flatnonzero((dp / n1 > 9 * dn / n0) & (evidence > bar))
    if not len(telling):
        return none
    marks = sorted(telling.tolist(), key=lambda i: (-evidence[i], words[i]))[: LANDMARKS[0]]
    # of the clean words those most like a toxic landmark are the other landmarks
    other = np.setdiff1d(np.flatnonzero(dn >= 3), telling).tolist()
    plain = sorted(other, key=lambda i: (-dn[i], words[i]))
    toxic_marks = _landmarks([words[i] for i in marks], code)
    like = np.concatenate([np.zeros(0), *(_kernels([words[i] for i in plain[k : k + 20_000]], *toxic_marks, code).max(1, initial=0.0) for k in range(0, len(plain), 20_000))])
    chosen = marks + [plain[k] for k in sorted(range(len(plain)), key=lambda k: (-like[k], words[plain[k]]))[: LANDMARKS[1]]]
    phi, where = _landmarks([words[i] for i in chosen], code)
    val, vec = np.linalg.eigh(phi @ phi.T + 1e-6 * np.eye(len(chosen)))
    white = vec @ np.diag(1 / np.sqrt(np.maximum(val, 1e-3))) @ vec.T
    known = _kernels(words, phi, where, code)

    def rows(docs: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        flat = [(i, s) for i, d in enumerate(docs) for s in d]
        out = np.empty((len(flat), len(chosen)), np.float32)
        for k in range(0, len(flat), 4096):
            part = [s for _, s in flat[k : k + 4096]]
            heads = np.concatenate([[0], np.cumsum([len(s) for s in part])[:-1]])
            out[k : k + len(part)] = np.add.reduceat(known[np.concatenate(part)], heads, axis=0) @ white
        return out, np.array([i for i, _ in flat], np.int64)

    (xp, ip), (xn, _) = rows(pos), rows(neg)
    weighty = np.zeros(len(words))
    weighty[marks] = evidence[marks]
    guess = np.array([weighty[s].sum() for d in pos for s in d])
    told = np.isin(ip, ip[guess > 0])  # toxic documents without any landmark are taken for label noise
    xp, guess, named = xp[told], guess[told], guess[told] > 0
    # landmarks with one more character within them are toxic too
    twisted = [(w[:k] + c + w[k:]).encode() for i in marks for w in [words[i].decode("utf-8", "replace")] for k in range(2, len(w) - 1) for c in ("x", "e") if len(w) < LONG]
    xm = (_kernels(twisted, phi, where, code) @ white).astype(np.float32)
    for _ in range(3):
        bad = named | (guess > 0)
        w, bias = svm(np.vstack([xp[bad], xm]), xn)
        guess = xp @ w + bias
    # between nearly all clean stretches (a few labels are wrong) and the weaker toxic ones
    high, low = float(np.quantile(xn @ w, 0.9999)), float(np.quantile(np.concatenate([xp[named] @ w, xm @ w]), 0.05))
    threshold = high + 0.5 * max(0.0, low - high)
    value = phi.T @ (white @ w)
    weight = {o: (names, value[cols], slots) for o, (names, cols, slots) in where.items()}
    return Model(weight, threshold, f"{seed}-{mix(np.array([abs(hash(value.tobytes()))], np.uint64))[0]}")


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> tuple[list[str], list[str]]:
    """Texts of at most limit/2 toxic and limit/2 clean labelled documents, chosen by a hash of their ids; of rows that repeat an id, the least text."""
    order = F.xxhash64("doc_id", F.lit(11))
    ids = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = ids.filter("toxic = 1").orderBy(order, "doc_id").limit(limit // 2).unionByName(ids.filter("toxic = 0").orderBy(order, "doc_id").limit(limit // 2))
    picked = {r["doc_id"]: r["toxic"] for r in chosen.collect()}
    if not picked:
        return [], []
    spark = docs.sparkSession
    small = spark.createDataFrame(list(picked.items()), "doc_id bigint, toxic int")
    got = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(small), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).collect()  # a row per id
    got.sort(key=lambda r: r["doc_id"])
    return [r["text"] for r in got if r["toxic"] == 1], [r["text"] for r in got if r["toxic"] == 0]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, score, worst_sentences): the highest score of a stretch and how many are over the threshold, for
    every row of docs. Whole texts are read. A null or empty text scores 0."""
    weight, threshold, name = docs.sparkSession.sparkContext.broadcast(model.weight), model.threshold, model.name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weight.value
        for batch in batches:
            texts = batch.column(1)
            off, data = buffers(texts)
            best, count, row, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64), 0, len(texts)
            while row < n:
                stop = min(n, max(row + 1, int(np.searchsorted(off, off[row] + CHUNK, "right")) - 1))
                v, d = score_chunk(off[row : stop + 1] - off[row], data[off[row] : off[stop]], w, name)
                np.maximum.at(best, d + row, v)
                np.add.at(count, d[v > threshold] + row, 1)
                row = stop
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best), pa.array(count)], ["doc_id", "score", "worst_sentences"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("t")).mapInArrow(run, "doc_id bigint, score double, worst_sentences bigint")


def model_for(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> Model:
    return train(*labelled_sample(docs, labels, limit))


def toxic_documents(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """Rejected documents only: doc_id, score, worst_sentences. Repeated rows are rejected each; a document without
    text is never rejected; a null doc_id is scored like any other; further columns are ignored. Empty tables of documents or labels give
    an empty result; long texts are read whole; a score that equals the threshold isn't over it."""
    return score(docs, model or model_for(docs, labels)).filter("worst_sentences > 0").withColumn("score", F.round("score", 6))


def without_toxic(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents that aren't rejected, all columns kept, without a shuffle: the text is scored in the same pass as
    a filter."""
    m = model or model_for(docs, labels)
    weight, threshold, name = docs.sparkSession.sparkContext.broadcast(m.weight), m.threshold, m.name
    cols = [F.col(f"`{c}`") for c in docs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weight.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            off, data = buffers(texts)
            bad, row, n = np.zeros(len(texts), bool), 0, len(texts)
            while row < n:
                stop = min(n, max(row + 1, int(np.searchsorted(off, off[row] + CHUNK, "right")) - 1))
                v, d = score_chunk(off[row : stop + 1] - off[row], data[off[row] : off[stop]], w, name)
                bad[d[v > threshold] + row] = True
                row = stop
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(~bad)).columns[:-1], schema=pa.schema(list(batch.schema)[:-1]))

    small_batches(docs.sparkSession)
    return docs.select(*cols, F.lower(F.coalesce("text", F.lit(""))).alias("__loom_t")).mapInArrow(run, docs.schema)
