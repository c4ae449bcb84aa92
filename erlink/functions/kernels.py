"""String-similarity kernels.

Each similarity has a plain definition for two strings, and a form for a whole Arrow batch: strings become matrices of
character codes, and the longest common subsequence of all pairs advances one character at a time in 64-bit words. Strings of
over 64 characters take the plain form; both give the same numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 64


def _places(s: str) -> dict[str, int]:
    """Character -> bits of its places."""
    where: dict[str, int] = {}
    for i, c in enumerate(s):
        where[c] = where.get(c, 0) | 1 << i
    return where


def _matched(where: dict[str, int], n: int, other: str) -> int:
    """Length of the longest common subsequence of ``other`` and the n characters in ``where``, bit-parallel."""
    full = free = (1 << n) - 1
    for c in other:
        hit = free & where.get(c, 0)
        free = ((free + hit) | (free - hit)) & full
    return n - free.bit_count()


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    return _matched(_places(a), len(a), b)


def ratio(a: str, b: str) -> float:
    """200 x common subsequence / total length; 100 for two empty strings."""
    n = len(a) + len(b)
    return 200.0 * common_subsequence(a, b) / n if n else 100.0


def sorted_words(s: str) -> str:
    return " ".join(sorted(s.split()))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(sorted_words(a), sorted_words(b))


def _word_sets(a: str, b: str) -> tuple[float, str, str, str] | float:
    """The ratio where word sets settle it; else the best ratio so far, the shared words and the two full sets as text."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = (sorted(s) for s in (x & y, x - y, y - x))
    if both and not (only_x and only_y):
        return 100.0
    shared, left, right = " ".join(both), " ".join(both + only_x), " ".join(both + only_y)
    part = max(200.0 * len(shared) / (len(shared) + len(t)) for t in (left, right)) if both else 0.0  # it begins both texts
    return part, shared, left, right


def token_set_ratio(a: str, b: str) -> float:
    """100 if one word set holds the other; else the best of the shared words and the two full sets; 0 without words."""
    found = _word_sets(a, b)
    return found if isinstance(found, float) else max(found[0], ratio(found[2], found[3]))


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with a window of the longer, windows cut at its ends included."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    best = _best_window(a, b)
    return max(best, _best_window(b, a)) if len(a) == len(b) else best


def _best_window(a: str, b: str) -> float:
    """A window that ends (or, cut at the right, begins) with a character that ``a`` lacks is no better than one without it."""
    where, n, best = _places(a), len(a), 0.0
    for end in range(1, len(b) + n):
        start = max(0, end - n)
        if b[end - 1 if end <= len(b) else start] in where:
            window = b[start:end]
            best = max(best, 200.0 * _matched(where, n, window) / (n + len(window)))
    return best


def jaro_winkler(a: str, b: str) -> float:
    """Jaro with the prefix bonus above 0.7, on 0 to 1; two empty strings are equal."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, t in zip(b, taken, strict=True) if t]
    turned = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - turned) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def is_subsequence(a: str, b: str) -> bool:
    """Whether all characters of ``a`` occur in ``b`` in order."""
    return common_subsequence(a, b) == len(a)


# The same for batches.

_ONE = np.uint64(1)


class _Texts:
    """Strings as columns of codes 1, 2, ... of the batch's characters, 0 below where a string has ended."""

    def __init__(self, strings: Sequence[str], alphabet: dict[int, int]):
        self.size = np.fromiter(map(len, strings), np.int64, len(strings))
        rows = np.zeros((len(strings), int(self.size.max(initial=0))), np.int64)
        flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(flat):
            own = np.zeros(int(flat.max()) + 1, np.int64)
            own[flat] = 1
            points = np.flatnonzero(own)
            own[points] = [alphabet.setdefault(p, len(alphabet) + 1) for p in points.tolist()]
            rows[np.arange(rows.shape[1]) < self.size[:, None]] = own.take(flat)
        self.codes = np.ascontiguousarray(rows.T)


def _masks(t: _Texts, signs: int) -> np.ndarray:
    """For each string and sign, one after the other, the bits of the sign's places; the sign 0 has none."""
    out = np.zeros(len(t.size) * signs, np.uint64)
    begin = np.arange(len(t.size)) * signs
    for i, codes in enumerate(t.codes):
        at = begin + codes
        out[at] = out.take(at) | _ONE << np.uint64(i)
    out[begin] = 0
    return out


def _common(masks: np.ndarray, begin: np.ndarray, n: np.ndarray, steps: Iterable[np.ndarray]) -> np.ndarray:
    """Length of the longest common subsequence of each string (its masks from ``begin`` on, n characters) with the other's codes."""
    full = np.where(n >= WORD, np.uint64(2**64 - 1), (_ONE << (n % WORD).astype(np.uint64)) - _ONE)
    free = full.copy()
    for codes in steps:
        hit = masks.take(begin + codes)
        hit &= free
        rest = free - hit
        free += hit
        free |= rest
        free &= full
    return n - np.bitwise_count(free).astype(np.int64)


def _by_pair(plain: Callable[[str, str], float], batch: Callable[[list[str], list[str]], np.ndarray]) -> Callable[[Sequence[str], Sequence[str]], np.ndarray]:
    """The batch form over distinct pairs whose strings fit a word, the plain form over the rest."""

    def run(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
        place: dict[tuple[str, str], int] = {}
        at = np.fromiter((place.setdefault(p, len(place)) for p in zip(a, b, strict=True)), np.int64, len(a))
        pairs = list(place)
        fits = np.fromiter((len(x) <= WORD and len(y) <= WORD for x, y in pairs), bool, len(pairs))
        out = np.zeros(len(pairs))
        short = np.flatnonzero(fits)
        if len(short):
            out[short] = batch([pairs[i][0] for i in short], [pairs[i][1] for i in short])
        for i in np.flatnonzero(~fits).tolist():
            out[i] = plain(*pairs[i])
        return out[at]

    return run


def _ratios(a: list[str], b: list[str]) -> np.ndarray:
    out = np.zeros(len(a))
    for k in range(0, len(a), 2048):  # small enough for the masks to stay in cache
        signs: dict[int, int] = {}
        x, y = _Texts(a[k : k + 2048], signs), _Texts(b[k : k + 2048], signs)
        common = _common(_masks(x, len(signs) + 1), np.arange(len(x.size)) * (len(signs) + 1), x.size, y.codes)
        total = x.size + y.size
        out[k : k + 2048] = np.where(total > 0, 200.0 * common / np.maximum(total, 1), 100.0)
    return out


def _partials(a: list[str], b: list[str]) -> np.ndarray:
    """Windows of all pairs side by side, some 10,000 at a time."""
    swap = [len(x) > len(y) for x, y in zip(a, b, strict=True)]
    short = [y if s else x for x, y, s in zip(a, b, swap, strict=True)]
    long = [x if s else y for x, y, s in zip(a, b, swap, strict=True)]
    out = np.array([100.0 if x in y and (x or not y) else 0.0 for x, y in zip(short, long, strict=True)])
    open_ = [i for i in range(len(a)) if short[i] and not out[i]]
    for k in range(0, len(open_), 256):
        at = open_[k : k + 256]
        x, y = [short[i] for i in at], [long[i] for i in at]
        best = _windows(x, y)
        even = [i for i in range(len(at)) if len(x[i]) == len(y[i])]
        if even:
            best[even] = np.maximum(best[even], _windows([y[i] for i in even], [x[i] for i in even]))
        out[at] = best
    return out


def _windows(short: list[str], long: list[str]) -> np.ndarray:
    """Best ratio of each short string with a window of its long one."""
    signs: dict[int, int] = {}
    x, y = _Texts(short, signs), _Texts(long, signs)
    signs_ = len(signs) + 1
    masks = _masks(x, signs_)
    count = y.size + x.size - 1
    row = np.repeat(np.arange(len(short)), count)
    end = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + 1
    first, last = np.maximum(end - x.size[row], 0), np.minimum(end, y.size[row])
    pairs, flat = len(short), y.codes.ravel()
    edge = flat.take(np.where(end <= y.size[row], last - 1, first) * pairs + row)
    useful = masks.take(row * signs_ + edge) > 0
    row, first, last = row[useful], first[useful], last[useful]
    best = np.zeros(pairs)
    if len(row):
        width, at = last - first, first * pairs + row
        steps = (np.where(j < width, flat.take(np.minimum(at + j * pairs, len(flat) - 1)), 0) for j in range(int(width.max())))
        np.maximum.at(best, row, 200.0 * _common(masks, row * signs_, x.size[row], steps) / (x.size[row] + width))
    return best


def _jaro_winklers(a: list[str], b: list[str]) -> np.ndarray:
    signs: dict[int, int] = {}
    x, y = _Texts(a, signs), _Texts(b, signs)
    begin, wide = np.arange(len(a)) * (len(signs) + 1), max(len(x.codes), len(y.codes))
    masks = _masks(y, len(signs) + 1)
    reach = np.maximum(np.maximum(x.size, y.size) // 2 - 1, 0)
    below = lambda n: np.where(n >= WORD, np.uint64(2**64 - 1), (_ONE << (np.clip(n, 0, WORD - 1)).astype(np.uint64)) - _ONE)
    taken, order = np.zeros(len(a), np.uint64), np.zeros((len(a), wide + 1), np.int64)
    m = np.zeros(len(a), np.int64)
    for i, codes in enumerate(x.codes):
        free = masks.take(begin + codes) & below(i + reach + 1) & ~below(i - reach) & ~taken
        low = free & (~free + _ONE)
        taken |= low
        hit = np.flatnonzero(low)
        order[hit, m[hit]] = codes[hit]
        m[hit] += 1
    turned, seen = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    for j, codes in enumerate(y.codes):
        hit = np.flatnonzero((taken >> np.uint64(j)) & _ONE)
        turned[hit] += order[hit, seen[hit]] != codes[hit]
        seen[hit] += 1
    some = np.maximum(m, 1)
    jaro = np.where(m > 0, (m / np.maximum(x.size, 1) + m / np.maximum(y.size, 1) + (m - turned // 2) / some) / 3, 0.0)
    prefix, same = np.zeros(len(a), np.int64), np.ones(len(a), bool)
    for cx, cy in zip(x.codes[:4], y.codes[:4], strict=False):
        same &= (cx == cy) & (cx > 0)
        prefix += same
    jaro = np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro)
    return np.where((x.size == 0) | (y.size == 0), (x.size == y.size).astype(float), jaro)


ratios = _by_pair(ratio, _ratios)
partial_ratios = _by_pair(partial_ratio, _partials)
jaro_winklers = _by_pair(jaro_winkler, _jaro_winklers)


def token_sort_ratios(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    known = {s: sorted_words(s) for s in {*a, *b}}
    return ratios([known[s] for s in a], [known[s] for s in b])


def token_set_ratios(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    place: dict[tuple[str, str], int] = {}
    at = np.fromiter((place.setdefault(p, len(place)) for p in zip(a, b, strict=True)), np.int64, len(a))
    found = [_word_sets(x, y) for x, y in place]
    out = np.array([f if isinstance(f, float) else f[0] for f in found])
    open_ = [i for i, f in enumerate(found) if not isinstance(f, float)]
    if open_:
        out[open_] = np.maximum(out[open_], ratios([found[i][2] for i in open_], [found[i][3] for i in open_]))
    return out[at]


#: Similarities of two columns of strings, by name.
BATCH = {"ratio": ratios, "token_sort": token_sort_ratios, "token_set": token_set_ratios, "partial": partial_ratios, "jaro_winkler": jaro_winklers}


#: Pairs of strings that a task remembers for each two columns, about; beyond these it begins anew.
MEMO = 1 << 16


def remembered(memo: dict[tuple[str, str], list[float]], a: Sequence[str], b: Sequence[str], kernels: Sequence[Callable[[Sequence[str], Sequence[str]], np.ndarray]]) -> np.ndarray:
    """A row of similarities for each pair; pairs that are in ``memo`` are not compared again, others come into it."""
    if len(memo) > MEMO:
        memo.clear()
    place: dict[tuple[str, str], int] = {}
    at = np.fromiter((place.setdefault(p, len(place)) for p in zip(a, b, strict=True)), np.int64, len(a))
    new = [p for p in place if p not in memo]
    if new:
        left, right = [x for x, _ in new], [y for _, y in new]
        memo.update(zip(new, np.column_stack([k(left, right) for k in kernels]).tolist(), strict=True))
    return np.array([memo[p] for p in place]).reshape(len(place), len(kernels))[at]


def similarities(wanted: dict[str, tuple[str, str]], columns: dict[str, tuple[Column, Column]]) -> Column:
    """One struct of several similarities, so that strings reach Python once: result -> (kernel, pair of columns).

    Null where one of the two strings is.
    """
    names = list(columns)
    of = {pair: [(out, BATCH[kernel]) for out, (kernel, p) in wanted.items() if p == pair] for pair in names}
    memos: dict[str, dict[tuple[str, str], list[float]]] = {pair: {} for pair in names}

    @F.pandas_udf(", ".join(f"{out} double" for out in wanted))
    def run(*sides: pd.Series) -> pd.DataFrame:
        found = {}
        for i, pair in enumerate(names):
            a, b = sides[2 * i], sides[2 * i + 1]
            known = (a.notna() & b.notna()).to_numpy()
            values = np.full((len(a), len(of[pair])), np.nan)
            if known.any():
                values[known] = remembered(memos[pair], a[known].tolist(), b[known].tolist(), [kernel for _, kernel in of[pair]])
            for j, (out, _) in enumerate(of[pair]):
                found[out] = pd.Series(values[:, j]).astype(object).where(known, None) if not known.all() else values[:, j]
        return pd.DataFrame({out: found[out] for out in wanted})

    return run(*[c for pair in columns.values() for c in pair])


def _udf(kernel: str) -> Callable[[Column, Column], Column]:
    return lambda a, b: similarities({"x": (kernel, "p")}, {"p": (F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)})["x"]


ratio_udf, token_sort_udf, token_set_udf, partial_udf, jaro_winkler_udf = map(_udf, ("ratio", "token_sort", "token_set", "partial", "jaro_winkler"))


def lev_sim(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, by the built-in function; 1 for two empty strings."""
    n = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(n == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / n)
