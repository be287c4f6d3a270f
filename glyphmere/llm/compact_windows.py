"""Near-duplicate passages by compact windows, and their removal.

The tokens of a text are its 5-word shingles. For each of ``HASHES`` hash
functions the text's Cartesian tree (least hash at the root, the first of
equals) gives its compact windows (l, c, r): every run of tokens inside l..r
that holds c has the min-hash at c. Windows that can hold a passage of
``least_words`` words are dealt by that min-hash, so passages of different
documents that share a signature meet, and each window is joined with earlier
ones (by id and place) whose intervals leave room for a passage on both sides:

* with the first of those whose words around the anchor are all the same, so far
  as a passage that holds it reaches; only the first of these goes on;
* with all earlier ones of its group, of those that have the same words to the
  right of the anchor, and to the left, where a group has up to ``FEW`` members;
* in larger groups, by the shingles within ``reach`` of the anchors, with earlier
  ones that share as many as a passage needs in a part long enough, until what is
  left of them lies in passages of joined ones; shifted parts get their diagonals.

Documents that share two hash functions' anchors, or one whose words on one side
agree too, are candidates. Joined windows of two documents are put together by
diagonal; then word runs that truly agree are chained over short gaps, and a
chain of ``least_words`` words or more whose shingle sets have a Jaccard
similarity of ``threshold`` or more is a repeat; of a chain that has less, the
maximal parts that have it are. What a document repeats of itself alone is left,
unless asked for. In the larger groups, runs of ``least_words``
equal words are looked for apart, so that none is lost to the choice of
partners: all such runs about their anchors are hashed (96 bits), and of equal
ones all but the first are repeats. The later one (by id, then place) is
reported and can be cut; the first copy stays.

So a passage of ``least_words`` words that stands in an earlier document word for word is always
found (but where a shingle returns within a passage's length, only windows that
far apart are kept). A changed one of similarity s shares fewer than two of the
functions with a probability of (1-s)**H + H s (1-s)**(H-1), 0.027 at 0.8.

Ids may be of any type that Spark can sort; a null id comes first (an integer id
of -2**63 is taken for null). Null text and texts too short have no repeats. Rows
that share an id are one document here. An empty table gives no rows. Columns named
repeats, n_words, n_cut and rest are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmere.llm import _common
from glyphmere.llm._common import WS, as_bytes, forget, parts_of, placed, release, slices, spread_join, stored
from glyphmere.llm._shingles import SHINGLE, hashed_words, mixed, shingles

HASHES = 4
#: Windows of a group that are all joined with each other.
FEW = 8
#: Members of a larger group that one task compares with all earlier ones.
ALONE = 2_000
#: Earlier members that are compared at once, the first time and at most.
FIRST_BLOCK, BLOCK = 64, 8_192
#: Bits of a member's set, pairs whose bits are compared at once, and pairs that are looked at place by place at once.
BITS, AT_ONCE, PAIRS = 1024, 1 << 18, 1 << 14
#: Links of one document that are handed its text together.
TOGETHER = 1_000
#: Unequal words that a chain may bridge.
GAP = 12
#: Evidence of a link that agrees in words on one side of the anchor, as two functions' bits.
STRONG = 3 << HASHES
#: In place of a link's bits: a part in which equal runs are to be looked for, a member of a larger group.
ASKED, MEMBER = 0, -1
NULL_ID = -(1 << 63)
_WORD = re.compile(rb"[^ \t-\r]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A window: key, text, hash function, anchor, tokens on its left and right (255: or more), hashes of the words right of, left of and all around the anchor.
WINDOW = np.dtype([("key", "<u8"), ("doc", "<i8"), ("f", "u1"), ("c", "<u4"), ("l", "u1"), ("r", "u1"), ("right", "<u4"), ("left", "<u4"), ("around", "<u4")])
LINK = np.dtype([("doc", "<i8"), ("of", "<i8"), ("diagonal", "<i8"), ("c", "<i8"), ("bits", "<i2")])
PART = np.dtype([("doc", "<i8"), ("lo", "<i8"), ("hi", "<i8")])


def window_bounds(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """c, l, r of all compact windows of at least ``width`` places; zeros in ``h`` part the texts."""
    n = len(h)
    half, levels, span = (width - 1) // 2, [h], 1
    while span < n:
        m = levels[-1].copy()
        m[:-span] = np.minimum(m[:-span], levels[-1][span:])
        m[-span:] = 0
        levels.append(m)
        span *= 2
    k = max(0, half.bit_length() - 1)
    near = np.zeros(n, h.dtype)
    if half and n > half:
        near[: n - half + 1] = np.minimum(levels[k][: n - half + 1], levels[k][half - (1 << k) : n - (1 << k) + 1])
        before, after = np.zeros(n, h.dtype), np.zeros(n, h.dtype)
        before[half:], after[:-1] = near[: n - half], near[1:]
        c = np.flatnonzero((h > 0) & ((before > h) | (after >= h)))
    else:
        c = np.flatnonzero(h > 0)
    own, left, right = h[c], c.copy(), c + 1
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        at = left - step
        go = at >= 0
        go[go] = levels[k][at[go]] > own[go]
        left[go] -= step
        go = right + step <= n
        go[go] = levels[k][right[go]] >= own[go]
        right[go] += step
    wide = right - left >= width
    return c[wide], left[wide], right[wide] - 1


class Ranges:
    """Hashes of any ranges of words, from sums of the words' hashes times powers."""

    def __init__(self, words: np.ndarray) -> None:
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words), _BASE, np.uint64)]))
        self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words), _INVERSE, np.uint64)]))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(words * power[:-1])])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((self.sums[b] - self.sums[a]) * self.back[a] + mixed((b - a).astype(np.uint64)))


def text_windows(texts: list[bytes], least_words: int) -> np.ndarray:
    """``WINDOW`` records of all texts (doc: the text's number); equal keys of a text lie ``least_words`` - 4 places apart or more."""
    words, lengths = hashed_words(texts)
    width = least_words - SHINGLE + 1
    parted = np.zeros(len(words) + len(texts), np.uint64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    at = np.arange(len(words)) + owner
    every = shingles(words)
    first = np.cumsum(lengths) - lengths
    real = np.arange(len(words)) - first[owner] <= lengths[owner] - SHINGLE
    parted[at[real]] = every[real] | np.uint64(1)
    base = np.cumsum(lengths + 1) - lengths - 1
    ranges, side, far = Ranges(words), width // 2 - 1, width - 1
    out = []
    for f in range(HASHES):
        value = mixed(parted ^ np.uint64(f + 1))
        h = (value >> np.uint64(33)).astype(np.uint32) + np.uint32(1)
        h[parted == 0] = 0
        c, l, r = window_bounds(h, width)
        text = np.searchsorted(base, c, side="right") - 1
        key = value[c]
        order = np.lexsort((c, key, text))
        c, l, r, text, key = c[order], l[order], r[order], text[order], key[order]
        again = np.flatnonzero((key[1:] == key[:-1]) & (text[1:] == text[:-1])) + 1
        if len(again):  # periodic text
            keep = np.ones(len(c), bool)
            last, previous = 0, -2
            for i in again:
                if previous != i - 1:
                    last = c[i - 1]
                keep[i] = c[i] - last >= width
                last = c[i] if keep[i] else last
                previous = i
            c, l, r, text, key = c[keep], l[keep], r[keep], text[keep], key[keep]
        rows = np.zeros(len(c), WINDOW)
        rows["key"], rows["doc"], rows["f"], rows["c"] = key, text, f, c - base[text]
        rows["l"], rows["r"] = np.minimum(c - l, 255), np.minimum(r - c, 255)
        lo, hi, at = first[text], first[text] + lengths[text], c - text  # the text's words, the anchor's place among all words
        rows["right"] = ranges(at, np.minimum(at + SHINGLE + side, hi)) >> np.uint64(32)
        rows["left"] = ranges(np.maximum(at - side, lo), at + SHINGLE) >> np.uint64(32)
        rows["around"] = ranges(np.maximum(at - far, lo), np.minimum(at + least_words, hi)) >> np.uint64(32)
        out.append(rows)
    return np.concatenate(out)


def pairs_in(rows: np.ndarray, *by: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of each window and all earlier ones of its group, of groups of up to ``FEW``; and each window's size of group."""
    order = np.lexsort((rows["c"], rows["doc"], *(rows[b] for b in by[::-1])))
    ranked = rows[order]
    head = np.ones(len(rows), bool)
    head[1:] = np.any([ranked[b][1:] != ranked[b][:-1] for b in by], axis=0)
    starts = np.flatnonzero(head)
    n = np.diff(np.append(starts, len(rows)))
    nth, of = np.arange(len(rows)) - np.repeat(starts, n), np.repeat(n, n)
    later = [np.flatnonzero((nth >= d) & (of <= FEW)) for d in range(1, FEW)]
    earlier = [at - d for d, at in enumerate(later, 1)]
    size = np.empty(len(rows), np.int64)
    size[order] = of
    return order[np.concatenate(later)], order[np.concatenate(earlier)], size


def joined(rows: np.ndarray, least_words: int, within: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``LINK`` records of joined windows (of one document only if ``within``), ``PART`` records of words in which equal runs are still to be looked for, and the windows of larger groups. All windows of a key are among ``rows``."""
    width = least_words - SHINGLE + 1
    rows = rows[np.argsort(rows["key"], kind="stable")]
    same = rows["key"][1:] == rows["key"][:-1]
    shared = np.zeros(len(rows), bool)
    shared[1:] |= same
    shared[:-1] |= same
    rows = rows[shared]
    rows = rows[np.lexsort((rows["c"], rows["doc"], rows["around"], rows["key"]))]
    head = np.ones(len(rows), bool)
    head[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["around"][1:] != rows["around"][:-1])
    lead = np.maximum.accumulate(np.where(head, np.arange(len(rows)), 0))
    if not within:  # the first one's own repeats have no other that stands for them
        head |= rows["doc"] == rows["doc"][lead]
    firsts = np.flatnonzero(head)
    found = [(np.flatnonzero(~head), lead[~head], np.uint8(STRONG))]
    size = {}
    for by in (("key",), ("key", "right"), ("key", "left")):
        a, b, size[by[-1]] = pairs_in(rows[firsts], *by)
        found.append((firsts[a], firsts[b], np.left_shift(1, rows["f"][firsts[a]]) if len(by) == 1 else np.uint8(STRONG)))
    a, b = (np.concatenate([x[k] for x in found]) for k in (0, 1))
    bits = np.concatenate([np.broadcast_to(x[2], len(x[0])) for x in found])
    x, y = rows[a], rows[b]
    # a passage of enough tokens must fit both windows around their anchors, but for gaps
    fits = np.minimum(x["l"], y["l"]).astype(np.int64) + np.minimum(x["r"], y["r"]) + 1 >= width * 4 // 5
    fits &= within | (x["doc"] != y["doc"])
    x, y = x[fits], y[fits]
    links = np.zeros(len(x), LINK)
    links["doc"], links["of"], links["c"], links["bits"] = x["doc"], y["doc"], x["c"], bits[fits]
    links["diagonal"] = x["c"].astype(np.int64) - y["c"]
    w, right, left = rows[firsts], size["right"] > FEW, size["left"] > FEW
    ask = (w["f"] == 0) & (right | left)
    parts = np.zeros(int(ask.sum()), PART)
    c = w["c"][ask].astype(np.int64)
    # windows of the same key that were dropped may follow within a passage's length
    parts["doc"], parts["lo"] = w["doc"][ask], np.maximum(0, c - np.where(left[ask], width - 1, width // 2))
    parts["hi"] = c + np.where(right[ask], least_words, SHINGLE + width // 2) + width
    return links, parts, w[size["key"] > FEW]


def alike(near: np.ndarray, docs: np.ndarray, least_words: int, threshold: float, within: bool = False, turn: int = 0, turns: int = 1) -> list[tuple[int, int]]:
    """Numbers of each ``turns``-th member of a group and those earlier ones that can hold a passage like its own (one by one: what ``like_members`` is tested against).

    near: each member's shingles about its anchor, zeros outside its text; members are in the order of ``docs``.
    A passage has ``threshold`` times its distinct shingles or more in common. Earlier
    members are left out if a joined one has their common shingles at the same
    places, or if these lie in repeats of joined ones.
    """
    names, of = np.unique(near, return_inverse=True)
    of = of.reshape(near.shape).astype(np.int32)
    ranked = np.sort(of, axis=1)
    fresh = names[ranked] != 0
    fresh[:, 1:] &= ranked[:, 1:] != ranked[:, :-1]
    own, member = ranked[fresh].astype(np.int64), np.nonzero(fresh)[0]
    n_own = fresh.sum(axis=1)
    begin = np.cumsum(n_own) - n_own
    again = (near != 0).sum(axis=1) - n_own  # places whose shingle stands at an earlier place
    need = np.maximum(1, np.ceil(threshold * (least_words - SHINGLE + 1 - again) - 1e-9)).astype(np.int64)
    often = np.bincount(own, minlength=len(names))
    holders = member[np.argsort(own, kind="stable")]
    listed = np.cumsum(often) - often
    ends = np.arange(len(docs)) if within else np.searchsorted(docs, docs)
    flag, first, last = np.zeros(len(names), bool), np.zeros(len(names), np.int16), np.zeros(len(names), np.int16)
    places = np.arange(near.shape[1], dtype=np.int16)

    def holding(some: np.ndarray, end: int) -> np.ndarray:
        met = np.zeros(len(docs), bool)
        for v in some.tolist():
            met[holders[listed[v] : listed[v] + often[v]]] = True
        return np.flatnonzero(met[:end])

    found, kept = [], np.zeros(0, np.int64)
    for i in range(turn, len(docs), turns):
        mine, end = own[begin[i] : begin[i] + n_own[i]], int(ends[i])
        # who shares enough has one of the rarest too
        rare = np.sort(often[mine] << 32 | mine)[: max(0, n_own[i] - need[i] + 1)] & 0xFFFFFFFF
        rare = rare[often[rare] > 1]
        if not len(rare) or not end:
            continue
        flag[mine], first[of[i, ::-1]], last[of[i]] = True, places[::-1], places
        met, kept = kept[kept < end], kept[:0]  # those of the member before, then all others
        asked, block = False, FIRST_BLOCK
        while len(met) or not asked:
            some, met = np.concatenate([kept, met[:block]]), met[block:]
            gone = np.zeros(near.shape[1], bool)
            if len(some):
                others = of[some]
                common = flag[others]
                enough = common.sum(axis=1) >= need[i]
                some, others, common = some[enough], others[enough], common[enough]
                lo, hi = (np.where(common, x[others], y) for x, y in ((first, places[-1]), (last, 0)))
                chosen, gone = _foremost(others, of[i], common, lo.min(axis=1, initial=places[-1]), hi.max(axis=1, initial=0), least_words, threshold)
                kept = some[chosen]
            if not asked and not len(met):
                asked, met = True, None
            elif len(met):
                block = min(BLOCK, 4 * block)
            if met is None or len(met) > block:
                if gone.any():  # only who shares something outside the repeats matters
                    rest = np.unique(of[i][~gone])
                    rest = rest[flag[rest] & (often[rest] > 1)]
                    fewer = rest if met is not None or often[rest].sum() < often[rare].sum() else rare
                    others = holding(fewer, end)
                    met = np.setdiff1d(others, kept, assume_unique=True) if met is None else np.intersect1d(met, others, assume_unique=True)
                elif met is None:
                    met = np.setdiff1d(holding(rare, end), kept, assume_unique=True)
        flag[mine] = False
        found += [(i, j) for j in kept.tolist()]
    return found


def _foremost(others: np.ndarray, mine: np.ndarray, common: np.ndarray, lo: np.ndarray, hi: np.ndarray, least_words: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of rows that no other makes needless, and the places of ``mine`` that are repeats of theirs. lo, hi: places of ``mine`` that each row's common shingles span."""
    level = common & (others == mine)
    shifted = (common & ~level).any(axis=1)
    left = np.argsort(-level.sum(axis=1), kind="stable")
    packed = np.packbits(level, axis=1)
    bits = np.zeros((len(level), -(-packed.shape[1] // 8) * 8), np.uint8)
    bits[:, : packed.shape[1]] = packed
    bits = bits.view(np.uint64)
    kept, gone = [], np.zeros(len(mine), bool)
    while len(left):
        b = int(left[0])
        kept.append(b)
        for x, y in _level_repeats(level[b], mine, others[b], least_words, threshold):
            gone[x:y] = True
        open_before = np.concatenate([[0], np.cumsum(~gone)])
        left = left[1:]
        same = ~shifted[left] & ((bits[left] & ~bits[b]) == 0).all(axis=1)
        same |= ((others[left] == others[b]) | ~common[left]).all(axis=1) if shifted[b] else False
        left = left[~same & (open_before[hi[left].astype(np.int64) + 1] > open_before[lo[left]])]
    return np.sort(np.array(kept, np.int64)), gone


def _level_repeats(level: np.ndarray, a: np.ndarray, b: np.ndarray, least_words: int, threshold: float) -> list[tuple[int, int]]:
    """Places (first, end) of shingles of chains of ``level`` runs that are repeats as a whole."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], level.view(np.int8), [0]])))
    starts, ends = edges[::2], edges[1::2]
    cut = np.flatnonzero(starts[1:] - ends[:-1] >= SHINGLE + GAP) + 1
    out = []
    for s, e in zip(np.split(starts, cut), np.split(ends, cut)):
        if len(s) and e[-1] - s[0] + SHINGLE - 1 >= least_words:
            x, y = np.unique(a[s[0] : e[-1]]), np.unique(b[s[0] : e[-1]])
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both >= threshold * (len(x) + len(y) - both):
                out.append((int(s[0]), int(e[-1])))
    return out


def like_members(near: np.ndarray, docs: np.ndarray, least_words: int, threshold: float, within: bool = False, turn: int = 0, turns: int = 1) -> np.ndarray:
    """Pairs of numbers (i, j) as of ``alike``, less those that can hold no passage, each with the shifts that its passage has; members of a block are compared with all earlier ones at once.

    Members are sets of bits, one or more shingles each, so pairs that share too few
    are known from the bits alone. Each member is joined with the one that shares
    most; of the others only those go on that share something outside the passages
    found, and have a part of a passage's length in which enough places are shared.
    """
    n, m = near.shape
    names, of, often = np.unique(near, return_inverse=True, return_counts=True)
    met = (often > 1) & (names != 0)
    kinds = int(met.sum())
    none = np.zeros((0, 3), np.int64)
    if not kinds:
        return none
    number = np.where(met, np.cumsum(met) - 1, kinds).astype(np.int32)[of.reshape(n, m)]  # kinds: no other has it
    width = -(-min(kinds, BITS) // 64) * 64
    bit = np.where(number < kinds, number % width, width)

    def packed(rows: np.ndarray, bits: np.ndarray, count: int) -> np.ndarray:
        table = np.zeros((count, width + 1), bool)
        table[rows, bits] = True
        return np.packbits(table[:, :width], axis=1).view(np.uint64).T.copy()

    again, times, fewest = _repeated(near, least_words - SHINGLE + 1)
    need = np.maximum(1, np.ceil(threshold * fewest - 1e-9)).astype(np.int64)
    ranked = np.sort(number, axis=1)
    own = (ranked[:, :1] < kinds).sum(axis=1) + ((ranked[:, 1:] < kinds) & (ranked[:, 1:] != ranked[:, :-1])).sum(axis=1)
    sets = packed(np.arange(n)[:, None], bit, n)
    least = np.maximum(1, need - own + np.bitwise_count(sets).sum(axis=0, dtype=np.int64))
    # of members that have the same shared shingles at the same places the first stands for all
    _, partners = np.unique(mixed((number.astype(np.uint64) * mixed(np.arange(1, m + 1, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)), return_index=True)
    partners = np.sort(partners)
    every = sets[:, partners]
    ends = np.searchsorted(partners, np.arange(n) if within else np.searchsorted(docs, docs))
    members = np.arange(turn, n, turns)
    members = members[(ends[members] > 0) & (own[members] >= need[members])]
    step = max(1, AT_ONCE // len(partners))
    look = _Places(number, kinds, again, times, least_words, threshold)
    out = []
    for start in range(0, len(members), step):
        mine = members[start : start + step]
        end = int(ends[mine].max())
        common = np.zeros((len(mine), end), np.uint16)
        for x, w in zip(sets[:, mine], every):
            common += np.bitwise_count(x[:, None] & w[None, :end])
        ok = (common >= least[mine, None]) & (np.arange(end) < ends[mine, None])
        at = np.flatnonzero(ok.any(axis=1))
        if not len(at):
            continue
        best = np.where(ok[at], common[at], 0).argmax(axis=1)
        gone, good, _, _ = look(mine[at], partners[best])
        at, best, gone = at[good], best[good], gone[good]
        out.append(np.stack([mine[at], partners[best]], axis=1))
        ok[at, best] = False
        covered = np.zeros((len(mine), m), bool)
        covered[at] = gone
        # a passage not inside the one found shares a place close by it, or as many as a passage needs elsewhere
        edges = (np.diff(gone.astype(np.int8), axis=1, prepend=0) == 1).sum(axis=1)
        once = at[edges == 1]
        if len(once):
            inside, held = covered[once], bit[mine[once]]
            x, y = inside.argmax(axis=1)[:, None], m - inside[:, ::-1].argmax(axis=1)[:, None]
            close = (np.arange(m) >= x - SHINGLE - GAP) & (np.arange(m) < y + SHINGLE + GAP) & ~inside
            beside, opened = (packed(np.arange(len(once))[:, None], np.where(v, held, width), len(once)) for v in (close, ~inside))
            shares, others = np.zeros((len(once), end), bool), np.zeros((len(once), end), np.uint16)
            for x, y, w in zip(beside, opened, every):
                shares |= (x[:, None] & w[None, :end]) != 0
                others += np.bitwise_count(y[:, None] & w[None, :end])
            ok[once] &= shares | (others >= least[mine[once], None])
        a, b = np.nonzero(ok)
        cuts = np.flatnonzero(np.diff(a, prepend=-1))
        cuts = [0, *cuts[np.flatnonzero(np.diff(cuts // PAIRS)) + 1].tolist(), len(a)]
        out += [_rounds(look, mine, a[x:y], partners[b[x:y]], covered) for x, y in zip(cuts, cuts[1:]) if x < y]
    return look.shifts(np.concatenate(out)) if out else none


def _repeated(near: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: whether a shingle is there twice, for each place how often its shingle is, and the fewest different ones in ``size`` places of the text (one more than there are places: no such)."""
    n, m = near.shape
    order = np.argsort(near, axis=1, kind="stable")
    ranked = np.take_along_axis(near, order, axis=1)
    same = np.zeros((n, m), bool)
    same[:, 1:] = ranked[:, 1:] == ranked[:, :-1]
    again = (same & (ranked != 0)).any(axis=1)
    kind = np.cumsum(~same.ravel()) - 1
    times, before = np.empty((n, m), np.float32), np.full((n, m), -1, np.int64)
    np.put_along_axis(times, order, np.bincount(kind)[kind].reshape(n, m).astype(np.float32), axis=1)
    np.put_along_axis(before, order, np.where(same, np.roll(order, 1, axis=1), -1), axis=1)
    first = np.maximum(before, np.arange(m) - size) + 1  # the first of the windows in which a place is the first of its kind
    change = np.bincount((np.arange(n)[:, None] * (m + 1) + first).ravel(), minlength=n * (m + 1)).reshape(n, m + 1)
    change[:, 1:] -= 1
    blank = np.concatenate([np.zeros((n, 1), np.int64), np.cumsum(near == 0, axis=1)], axis=1)
    held = np.where(blank[:, size:] == blank[:, :-size], np.cumsum(change, axis=1)[:, : m - size + 1], 2 * m)
    return again, times, held.min(axis=1)


class _Places:
    """Where the shingles of members stand in others of their group, in batches of pairs."""

    def __init__(self, number: np.ndarray, kinds: int, again: np.ndarray, times: np.ndarray, least_words: int, threshold: float) -> None:
        self.number, self.kinds, self.again, self.least, self.threshold = number, kinds, again, least_words - SHINGLE + 1, threshold
        self.batch = max(1, min(4096, (4 << 20) // (kinds + 1)))
        self.scratch = np.full((self.batch, kinds + 1), -1, np.int16)
        self.places = np.arange(number.shape[1], dtype=np.int16)
        self.worth = -np.float32(threshold) / times  # of a place that isn't common: no more than its share of a shingle

    def __call__(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per pair: places of ``i`` in passages, whether there are any, places that could be in one (none: no passage), and whether that is not certain."""
        parts = [self._some(i[k : k + self.batch], j[k : k + self.batch]) for k in range(0, len(i), self.batch)]
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _some(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
        a, b, rows = self.number[i], self.number[j], np.arange(len(i))[:, None]
        self.scratch[rows, b[:, ::-1]] = self.places[::-1]  # the first place of each
        self.scratch[:, self.kinds] = -1
        at = self.scratch[rows, a]
        self.scratch[rows, b] = -1
        at = np.where((a == b) & (a < self.kinds), self.places, at)
        unsure = self.again[i] | self.again[j]
        # without repeats the places of a passage lie about one diagonal
        common = (at >= 0) & ((np.abs(at - self.places) <= self.least) | unsure[:, None])
        wide, size = common.shape[1], self.least
        gone = np.zeros(common.shape, bool)
        r, p = np.nonzero(common)
        q = at[r, p].astype(np.int64)
        same, close = r[1:] == r[:-1], p[1:] - p[:-1] < SHINGLE + GAP + 1
        go = same & close & (q[1:] > q[:-1]) & (q[1:] - q[:-1] < SHINGLE + GAP + 1)
        odd = unsure.copy()
        odd[r[1:][same & close & ~go]] = True
        # a part of a chain from s to e: value(e) - value(s) + rest >= 0, if its similarity is high enough
        value = np.full(common.shape, np.inf)
        value[r, p] = (1 + self.threshold) * np.arange(len(r)) - self.threshold * (p + q) - 1e4 * np.cumsum(np.concatenate([[0], ~go])[: len(r)])
        rest, top = 1 - self.threshold + 1e-6, np.where(np.isinf(value), -np.inf, value)
        low, high = np.minimum.accumulate(value, axis=1), np.maximum.accumulate(top[:, ::-1], axis=1)[:, ::-1]
        k, e = np.nonzero(top[:, size - 1 :] - low[:, : wide - size + 1] + rest >= 0)
        if len(k):
            start = np.maximum.accumulate(np.where(value == low, self.places, 0), axis=1)
            end = np.minimum.accumulate(np.where(top == high, self.places, wide - 1)[:, ::-1], axis=1)[:, ::-1]
            g, s = np.nonzero(high[:, size - 1 :] - value[:, : wide - size + 1] + rest >= 0)
            edge = np.zeros((len(i), wide + 1), np.int16)
            np.add.at(edge, (np.concatenate([k, g]), np.concatenate([start[k, e], s])), 1)  # of each end with its best start, each start with its best end
            np.add.at(edge, (np.concatenate([k, g]), np.concatenate([e + size, end[g, s + size - 1] + 1])), -1)
            gone = np.cumsum(edge, axis=1, dtype=np.int16)[:, :-1] > 0
            for k in np.flatnonzero(gone.any(axis=1) & unsure).tolist():  # sets of shingles, some of them at several places
                f, e = int(gone[k].argmax()), wide - 1 - int(gone[k, ::-1].argmax())
                g, h = int(at[k, f]), int(at[k, e])
                gone[k, :f], gone[k, e:] = False, False
                gone[k, f : e + 1] = g <= h and self._alike(a[k, f : e + 1], b[k, g : h + 1])
        good = gone.any(axis=1)
        self.moved = np.where(gone & common, at - self.places, 0)
        # of a passage's places as many are common as its similarity asks for
        sums = np.zeros((len(i), wide + 1), np.float32)
        np.cumsum(np.where(common, np.float32(1 - self.threshold), self.worth[i]), axis=1, out=sums[:, 1:])
        low = np.minimum.accumulate(sums, axis=1)
        odd &= (sums[:, size:] - low[:, :-size]).max(axis=1) >= -1e-3
        first, last = common.argmax(axis=1), wide - 1 - common[:, ::-1].argmax(axis=1)
        return gone, good, np.where(odd[:, None], (self.places >= first[:, None]) & (self.places <= last[:, None]), gone), odd

    def shifts(self, pairs: np.ndarray) -> np.ndarray:
        """(i, j, places by which parts of passages of ``i`` stand further on in ``j``), 0 for every pair."""
        out = [np.concatenate([pairs, np.zeros((len(pairs), 1), np.int64)], axis=1)]
        for k in range(0, len(pairs), self.batch):
            some = pairs[k : k + self.batch]
            self._some(*some.T)
            r, p = np.nonzero(self.moved)
            if len(r):
                r, by = np.unique(np.stack([r, self.moved[r, p]], axis=1), axis=0).T
                out.append(np.concatenate([some[r], by[:, None]], axis=1))
        return np.concatenate(out)

    def shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Places of ``j`` whose shingle ``i`` has too."""
        out = np.zeros((len(i), len(self.places)), bool)
        for k in range(0, len(i), self.batch):
            a, b = self.number[i[k : k + self.batch]], self.number[j[k : k + self.batch]]
            rows = np.arange(len(a))[:, None]
            self.scratch[rows, a] = 0
            self.scratch[:, self.kinds] = -1
            out[k : k + self.batch] = self.scratch[rows, b] >= 0
            self.scratch[rows, a] = -1
        return out

    def _alike(self, a: np.ndarray, b: np.ndarray) -> bool:
        x, y = np.unique(a[a < self.kinds]), np.unique(b[b < self.kinds])
        both, lone = len(np.intersect1d(x, y, assume_unique=True)), int((a == self.kinds).sum() + (b == self.kinds).sum())
        return both >= self.threshold * (len(x) + len(y) + lone - both)


def _rounds(look: _Places, mine: np.ndarray, a: np.ndarray, b: np.ndarray, covered: np.ndarray) -> np.ndarray:
    """Pairs (member, b) of candidates (a: number in ``mine``) that can hold passages outside those found before."""
    out = []
    gone, _, wanted, odd = look(mine[a], b)
    left = np.flatnonzero((wanted & ~covered[a]).any(axis=1))
    a, b, gone, wanted, odd = a[left], b[left], gone[left], wanted[left], odd[left]
    shared = np.zeros(gone.shape, bool)
    shared[odd] = look.shared(mine[a[odd]], b[odd])
    left = np.lexsort((-shared.sum(axis=1), -gone.sum(axis=1), a))
    latest = np.zeros(len(mine), np.int64)
    while len(left):
        head = np.ones(len(left), bool)
        head[1:] = a[left[1:]] != a[left[:-1]]
        taken, left = left[head], left[~head]
        out.append(np.stack([mine[a[taken]], b[taken]], axis=1))
        covered[a[taken]] |= gone[taken]
        latest[a[taken]] = b[taken]
        left = left[(wanted[left] & ~covered[a[left]]).any(axis=1)]
        same = odd[left]  # what is not certain adds nothing to one that has the same at these places
        if same.any():
            some = left[same]
            same[same] = ((look.number[b[some]] == look.number[latest[a[some]]]) | ~shared[some]).all(axis=1)
            left = left[~same]
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def met_windows(rows: DataFrame, least_words: int, within: bool) -> DataFrame:
    """doc, of, diagonal, c, bits of joined windows; rows of bits ``ASKED`` give a part diagonal..c of ``doc`` in which equal runs are to be looked for, of bits ``MEMBER`` a window of the larger group ``of`` at c. rows: k, t."""
    spark = rows.sparkSession
    n = parts_of(spark)
    spots = np.array(placed(spark, n))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", 2 << 20):
            found = text_windows([t or b"" for t in as_bytes(batch.column("t"))], least_words)
            found["doc"] = batch.column("k").to_numpy()[found["doc"]]
            part = (found["key"] >> np.uint64(20)).astype(np.int64) % n
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(n + 1))
            sent = [(int(spots[p]), b"".join(found[name][o].tobytes() for name in WINDOW.names)) for p in range(n) if len(o := order[cuts[p] : cuts[p + 1]])]
            if sent:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*sent), (pa.int64(), pa.binary()))], ["spot", "rows"])

    def read(raw: bytes) -> np.ndarray:
        out = np.zeros(len(raw) // WINDOW.itemsize, WINDOW)
        at = 0
        for name in WINDOW.names:
            kind = WINDOW[name]
            out[name] = np.frombuffer(raw, kind, len(out), at)
            at += kind.itemsize * len(out)
        return out

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [read(x) for b in batches for x in as_bytes(b.column("rows"))]
        if not got:
            return
        every = np.concatenate(got)
        del got
        links, parts, many = joined(every, least_words, within)
        del every
        rest = [parts["doc"], parts["doc"], parts["lo"], parts["hi"], np.full(len(parts), ASKED)]
        members = [many["doc"], many["key"].view("<i8"), np.zeros(len(many)), many["c"], np.full(len(many), MEMBER)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x.astype(LINK[f]) for x in (links[f], *more)])) for f, *more in zip(LINK.names, rest, members)], list(LINK.names))
        del links, parts, many, rest, members
        release()

    dealt = rows.mapInArrow(split, "spot long, rows binary").repartition(n, "spot")
    met = dealt.mapInArrow(meet, "doc long, of long, diagonal long, c long, bits short")
    return met


def alike_windows(met: DataFrame, rows: DataFrame, least_words: int, threshold: float, within: bool) -> DataFrame:
    """doc, of, diagonal, c, bits of windows of larger groups that can hold like passages. Groups of over ``ALONE`` are shared out."""
    left, right = reach(least_words), reach(least_words) - SHINGLE
    members = met.where(F.col("bits") == MEMBER).select("doc", F.col("of").alias("key"), "c")
    large = F.broadcast(members.groupBy("key").agg(F.ceil(F.count("*") / ALONE).cast("int").alias("turns")).where("turns > 1"))
    members = members.join(large, "key", "left").groupBy("doc").agg(F.collect_set(F.struct("key", "c", F.coalesce("turns", F.lit(1)).alias("turns"))).alias("at"))
    asked = rows.join(members, F.col("k") == F.col("doc")).select("k", "t", "at")

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", 1 << 20):
            words, lengths = hashed_words([t or b"" for t in as_bytes(batch.column("t"))])
            every = (shingles(words) >> np.uint64(32)).astype("<u4") | np.uint32(1)
            listed = batch.column("at")
            at, j = listed.flatten(), np.repeat(np.arange(batch.num_rows), listed.value_lengths().to_numpy())
            begin, n = (np.cumsum(lengths) - lengths)[j, None], (lengths - SHINGLE + 1)[j, None]
            place = at.field("c").to_numpy()[:, None] + np.arange(-left, right + 1)
            inside = (place >= 0) & (place < n)
            near = np.zeros(place.shape, "<u4")
            near[inside] = every[(begin + place)[inside]]
            yield pa.RecordBatch.from_arrays([at.field("key"), pa.array(batch.column("k").to_numpy()[j]), at.field("c"), at.field("turns"), pa.array([x.tobytes() for x in near], pa.binary())], ["key", "doc", "c", "turns", "near"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []

        def links() -> pa.RecordBatch:
            every = np.concatenate(out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(every[f]) for f in LINK.names], list(LINK.names))

        def finish(held: list[pa.RecordBatch]) -> None:
            group = pa.Table.from_batches(held).combine_chunks()
            docs, c = (group.column(x).to_numpy() for x in ("doc", "c"))
            near = np.frombuffer(b"".join(x for b in held for x in as_bytes(b.column("near"))), "<u4").reshape(len(docs), left + right + 1)
            i, j, by = like_members(near, docs, least_words, threshold, within, group.column("turn")[0].as_py(), group.column("turns")[0].as_py()).T
            if len(i):
                made = np.zeros(len(i), LINK)
                made["doc"], made["of"], made["diagonal"], made["c"], made["bits"] = docs[i], docs[j], c[i] - c[j] - by, c[i], STRONG
                out.append(made)

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            key, turn = (batch.column(x).to_numpy() for x in ("key", "turn"))
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (turn[1:] != turn[:-1])) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if held and last != (key[lo], turn[lo]):
                    finish(held)
                    held = []
                last = (key[lo], turn[lo])
                held.append(batch.slice(lo, hi - lo))
            if sum(map(len, out)) >= 10_000:
                yield links()
        if held:
            finish(held)
        if out:
            yield links()
        release()

    near = asked.mapInArrow(surroundings, "key long, doc long, c long, turns int, near binary")
    near = near.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    near = near.repartition(parts_of(rows.sparkSession), "key", "turn").sortWithinPartitions("key", "turn", "doc", "c")
    return near.mapInArrow(compare, "doc long, of long, diagonal long, c long, bits short")


def equal_runs(met: DataFrame, rows: DataFrame, least_words: int, within: bool) -> DataFrame:
    """doc, check (of its text), of, diagonal, first, last: runs of ``least_words`` words or more, in the parts asked for, that stand at an earlier place too."""
    parts = met.where(F.col("bits") == ASKED).groupBy("doc").agg(F.collect_list(F.struct(F.col("diagonal").alias("lo"), F.col("c").alias("hi"))).alias("parts"))
    asked = rows.join(parts, F.col("k") == F.col("doc")).select("k", "t", "parts")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", 1 << 20):
            texts = [t or b"" for t in as_bytes(batch.column("t"))]
            words, lengths = hashed_words(texts)
            ranges, again = Ranges(words), Ranges(mixed(words))
            begin = np.cumsum(lengths) - lengths
            doc, at = [], []
            for j, listed in enumerate(batch.column("parts").to_pylist()):
                starts = np.zeros(int(lengths[j]) + 1, bool)
                for p in listed:
                    starts[p["lo"] : max(0, min(p["hi"], int(lengths[j])) - least_words + 1)] = True
                at.append(np.flatnonzero(starts))
                doc.append(np.full(len(at[-1]), j))
            if not doc:
                continue
            j, p = np.concatenate(doc), np.concatenate(at)
            a = begin[j] + p
            check = np.array([xxhash.xxh3_64_intdigest(t) >> 33 for t in texts], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("k").to_numpy()[j]), pa.array(check[j]), pa.array(p.astype(np.int32)), pa.array(ranges(a, a + least_words).view(np.int64)), pa.array((again(a, a + least_words) >> np.uint64(32)).astype(np.uint32).view(np.int32))], ["doc", "check", "at", "h", "g"])

    runs = stored(asked.mapInArrow(hashes, "doc long, check int, at int, h long, g int"), "runs")
    groups = runs.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(F.struct("doc", "at")).alias("lead")).where("n > 1")
    groups = stored(groups, "equal")
    met_again = spread_join(runs, groups, ["h", "g"])
    later = (runs.join(groups, ["h", "g"]) if met_again is None else met_again).where(F.struct("doc", "at") != F.col("lead") if within else F.col("doc") != F.col("lead.doc")).select("doc", "check", "at", F.col("lead.doc").alias("of"), (F.col("at") - F.col("lead.at")).cast("long").alias("diagonal"))
    along = Window.partitionBy("doc", "check", "of", "diagonal").orderBy("at")
    islands = later.distinct().withColumn("island", F.col("at") - F.row_number().over(along))
    out = stored(islands.groupBy("doc", "check", "of", "diagonal", "island").agg(F.min("at").cast("long").alias("first"), (F.max("at") + least_words).cast("long").alias("last")).drop("island"), "runs")
    forget(runs, groups)
    return out


def reach(least_words: int) -> int:
    """Words around the outer anchors of a diagonal that its passages can lie in: each holds an anchor within its first and last ``least_words``."""
    return least_words + 2 * GAP


def agreeing_runs(a: np.ndarray, b: np.ndarray, b_at: int, diagonal: int, first: int, last: int, around: int) -> list[tuple[int, int, int]]:
    """Maximal runs (start in a, start in b, length) of at least 5 equal words on a diagonal, about anchors first..last; b begins at word b_at."""
    lo = max(0, first - around, b_at + diagonal)
    hi = min(len(a), last + around, b_at + len(b) + diagonal)
    if hi - lo < SHINGLE:
        return []
    equal = a[lo:hi] == b[lo - diagonal - b_at : hi - diagonal - b_at]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], equal.view(np.int8), [0]])))
    return [(lo + s, lo + s - diagonal, e - s) for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()) if e - s >= SHINGLE]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    x, y = (np.unique(shingles(w.astype(np.uint64))[: max(0, len(w) - SHINGLE + 1)]) for w in (a, b))
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / max(1, len(x) + len(y) - common)


def entries(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of the words, sorted, and for each the number of the first of the sorted ``ends`` that it lies before."""
    every, at = np.unique(shingles(words.astype(np.uint64))[: max(0, len(words) - SHINGLE + 1)], return_index=True)
    return every, np.searchsorted(ends, at + SHINGLE)


def similarities(a: np.ndarray, b: np.ndarray, x: np.ndarray, ends: np.ndarray, y: np.ndarray, other: np.ndarray) -> np.ndarray | None:
    """(i, j): similarity of the parts from run i to run j, where no shingle repeats within ``a`` or ``b``; else, or with very many runs, None."""
    k, m, n = len(x), len(a) - SHINGLE + 1, len(b) - SHINGLE + 1
    if k > 1000:
        return None
    (h, p), (g, q) = (np.unique(shingles(w.astype(np.uint64))[:c], return_index=True) for w, c in ((a, m), (b, n)))
    if len(h) < m or len(g) < n:
        return None
    _, here, there = np.intersect1d(h, g, assume_unique=True, return_indices=True)
    p, q = p[here], q[there]
    start = np.minimum(np.searchsorted(x, p, side="right"), np.searchsorted(y, q, side="right")) - 1
    end = np.maximum(np.searchsorted(ends, p + SHINGLE), np.searchsorted(other, q + SHINGLE))
    common = np.bincount(start * k + end, minlength=k * k).reshape(k, k)[::-1].cumsum(axis=0)[::-1].cumsum(axis=1)
    every = (ends - x[:, None] - SHINGLE + 1) + (other - y[:, None] - SHINGLE + 1)
    return common / np.maximum(1, every - common)


def passages(a: np.ndarray, b: np.ndarray, at: int, chain: list[tuple[int, int, int]], least_words: int, threshold: float) -> list[tuple[int, int, float]]:
    """Spans of ``a``: the chain, or its maximal parts (from run to run) of ``least_words`` words whose similarity is ``threshold`` or more; b begins at word ``at``."""
    x, y, n = (np.array(c, np.int64) for c in zip(*chain))
    ends, other = x + n, y + n
    if ends[-1] - x[0] < least_words:
        return []
    s = 1.0 if len(chain) == 1 else jaccard(a[x[0] : ends[-1]], b[y[0] - at : other[-1] - at])
    if s >= threshold:
        return [(int(x[0]), int(ends[-1]), s)]
    table = similarities(a[x[0] : ends[-1]], b[y[0] - at : other[-1] - at], x - x[0], ends - x[0], y - y[0], other - y[0])
    found: list[tuple[int, int, float]] = []
    reached = 0
    for i in range(len(chain)):
        long = ends - x[i] >= least_words
        long[:reached] = False
        if not long.any():
            continue
        if table is not None:
            similar = table[i, i:]
        else:  # a shingle is common to the parts from i on that reach it on both sides
            k = len(chain) - i
            (h, p), (g, q) = entries(a[x[i] : ends[-1]], ends[i:] - x[i]), entries(b[y[i] - at : other[-1] - at], other[i:] - y[i])
            _, here, there = np.intersect1d(h, g, assume_unique=True, return_indices=True)
            common, here, there = (np.cumsum(np.bincount(e, minlength=k)) for e in (np.maximum(p[here], q[there]), p, q))
            similar = common / np.maximum(1, here + there - common)
        good = np.flatnonzero((similar >= threshold) & long[i:])
        if len(good):
            j = int(good[-1])
            found.append((int(x[i]), int(ends[i + j]), float(similar[j])))
            reached = i + j + 1  # parts that start later and end no later lie in this one
    return found


def repeats(a: np.ndarray, pieces: list[tuple[int, np.ndarray, list[tuple[int, int, int]]]], least_words: int, threshold: float, own: bool) -> list[tuple[int, int, float]]:
    """Spans (first word, end, similarity) of ``a`` that repeat words of one other document.

    pieces: (place of the piece, its words, its diagonals with their anchors).
    """
    found: list[tuple[int, int, float]] = []
    for at, b, diagonals in pieces:
        runs = sorted({run for d, first, last in diagonals if d > 0 or not own for run in agreeing_runs(a, b, at, d, first, last, reach(least_words))})
        chains: list[list[tuple[int, int, int]]] = []
        near: list[list[tuple[int, int, int]]] = []  # chains that later runs can still reach
        for run in runs:
            near = [c for c in near if run[0] - (c[-1][0] + c[-1][2]) <= GAP]
            best = None
            for chain in near[::-1]:
                x, y, n = chain[-1]
                da, db = run[0] - (x + n), run[1] - (y + n)
                if -SHINGLE < da <= GAP and -SHINGLE < db <= GAP and (best is None or abs(da - db) < best[0]):
                    best = (abs(da - db), chain)
            if best:
                best[1].append(run)
            else:
                chains.append([run])
                near.append(chains[-1])
        for chain in chains:
            found += passages(a, b, at, chain, least_words, threshold)
    return found


def merged(spans: list[tuple[int, int, float, int]]) -> list[tuple[int, int, float, int]]:
    """Overlapping spans (first, end, similarity, document) joined; the longest gives similarity and document."""
    out: list[tuple[int, int, float, int]] = []
    longest = 0
    for x, y, s, d in sorted(spans):
        if out and x <= out[-1][1]:
            a, b, t, e = out[-1]
            t, e = (s, d) if y - x > longest else (t, e)
            out[-1] = (a, max(b, y), t, e)
        else:
            out.append((x, y, s, d))
            longest = 0
        longest = max(longest, y - x)
    return out


def without(raw: bytes, spans: list[tuple[int, int, float, int]]) -> bytes:
    """The text without the words of the spans and the white space after them."""
    at = [m.span() for m in _WORD.finditer(raw)]
    out, last = [], 0
    for x, y, _, _ in spans:
        out.append(raw[last : at[x][0]])
        last = at[y][0] if y < len(at) else len(raw)
    out.append(raw[last:])
    return b"".join(out).rstrip(WS) if spans and spans[-1][1] >= len(at) else b"".join(out)


def numbered(df: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """``df`` with k__, a long in the order of its ids, and for ids that aren't integers the table (k, id) of it."""
    if isinstance(df.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return df.withColumn("k__", F.coalesce(df[id_col].cast("long"), F.lit(NULL_ID))), None
    ids = df.select(df[id_col].alias("id")).distinct().repartitionByRange(parts_of(df.sparkSession), "id").sortWithinPartitions("id")
    ids = stored(ids.select(F.monotonically_increasing_id().alias("k__"), "id"), "ids")
    return df.join(ids, df[id_col].eqNullSafe(ids["id"])).drop(ids["id"]), ids.withColumnRenamed("k__", "k")


def handed(links: DataFrame) -> DataFrame:
    """of, wanted: the links (doc, of, lo, hi, diagonals) listed by ``of``; those of a document with very many in lists of about ``TOGETHER``."""
    per = links.groupBy("of").agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n")).first()[0] or 0
    often = max(total // (4 * parts_of(links.sparkSession)), _common.OFTEN)
    hot = F.broadcast(per.where(F.col("n") > often))  # at most 4 * partitions rows
    part = F.coalesce(F.pmod(F.xxhash64("doc"), F.ceil(F.col("n") / TOGETHER)), F.lit(0))
    return links.join(hot, "of", "left").groupBy("of", part.alias("part")).agg(F.collect_list(F.struct("doc", "lo", "hi", "diagonals")).alias("wanted")).drop("part")


def find_repeats(df: DataFrame, least_words: int = 50, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", within: bool = False) -> DataFrame:
    """``df`` with repeats (array of first, end: words; similarity; of: id), n_words, n_cut and rest (the text without them).

    Repeats are of other documents, and ``within`` also of the document's own earlier words.
    """
    around = reach(least_words)
    base = [c for c in df.columns if c not in ("repeats", "n_words", "n_cut", "rest")]
    if text_col not in base or id_col not in base:
        raise ValueError("the id or text column is named like a result")
    plain = df.select(*[df[c] for c in base])
    keyed, ids = numbered(plain, id_col)
    rows = keyed.select(F.col("k__").alias("k"), F.col(text_col).alias("t"))
    met = stored(met_windows(rows, least_words, within), "windows")
    lines = met.where("bits > 0").unionByName(alike_windows(met, rows, least_words, threshold, within)).groupBy("doc", "of", "diagonal").agg(F.min("c").alias("first"), F.max("c").alias("last"), F.bit_or("bits").alias("bits"))
    links = lines.groupBy("doc", "of").agg(F.min(F.col("first") - F.col("diagonal")).alias("lo"), F.max(F.col("last") - F.col("diagonal")).alias("hi"), F.collect_list(F.struct("diagonal", "first", "last")).alias("diagonals"), F.bit_or("bits").alias("bits"))
    links = stored(links.where(F.bit_count("bits") >= 2).drop("bits"), "links")

    def clip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", 4 << 20):
            words, lengths = hashed_words([t or b"" for t in as_bytes(batch.column("t"))])
            begin = np.cumsum(lengths) - lengths
            short = (words >> np.uint64(32)).astype("<u4")
            for j, (k, wanted) in enumerate(zip(batch.column("k").to_pylist(), batch.column("wanted").to_pylist())):
                at = [max(0, w["lo"] - around) for w in wanted]
                cut = [short[begin[j] + a : begin[j] + max(a, min(int(lengths[j]), w["hi"] + around))].tobytes() for a, w in zip(at, wanted)]
                docs, lines = [w["doc"] for w in wanted], [w["diagonals"] for w in wanted]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([k] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array(cut, pa.binary()), pa.array(lines, listed)], ["doc", "of", "at", "words", "diagonals"])

    listed = pa.list_(pa.struct([("diagonal", pa.int64()), ("first", pa.int64()), ("last", pa.int64())]))
    kind = "doc long, of long, at long, words binary, diagonals array<struct<diagonal: long, first: long, last: long>>"
    pieces = stored(handed(links).join(rows, F.col("of") == F.col("k")).select("k", "t", "wanted").mapInArrow(clip, kind), "pieces")
    equal = equal_runs(met, rows, least_words, within)
    exact = equal.groupBy("doc", "of", F.col("check").cast("long").alias("at")).agg(F.lit(None).cast("binary").alias("words"), F.collect_list(F.struct("diagonal", "first", "last")).alias("diagonals"))
    forget(met, links)
    pieces = pieces.unionByName(exact)
    if ids is None:
        name = F.when(F.col("of") != NULL_ID, F.col("of")).cast(df.schema[id_col].dataType)
    else:
        pieces, name = pieces.join(ids, F.col("of") == F.col("k")).drop("k"), F.col("id")
    pieces = pieces.groupBy(F.col("doc").alias("doc__")).agg(F.collect_list(F.struct("of", name.alias("name"), "at", "words", "diagonals")).alias("pieces__"))
    joined_rows = keyed.join(pieces, F.col("k__") == F.col("doc__"), "left").drop("doc__")
    schema = plain.schema
    for field, ddl in (("repeats", f"array<struct<first: long, end: long, similarity: double, of: {df.schema[id_col].dataType.simpleString()}>>"), ("n_words", "long"), ("n_cut", "long"), ("rest", "string")):
        schema = schema.add(field, T.DataType.fromDDL(ddl))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 4 << 20):
            spans_of, total, gone, rest = [], [], [], []
            for k, t, listed in zip(batch.column("k__").to_pylist(), as_bytes(batch.column(text_col)), batch.column("pieces__").to_pylist()):
                count, spans, names = len(t.split()) if t else 0, [], {}
                if listed and t:
                    a, check = (hashed_words([t])[0] >> np.uint64(32)).astype("<u4"), xxhash.xxh3_64_intdigest(t) >> 33
                    by: dict[int, list] = {}
                    for p in listed:
                        names[p["of"]] = p["name"]
                        if p["words"] is not None:
                            by.setdefault(p["of"], []).append((p["at"], np.frombuffer(p["words"], "<u4"), [(d["diagonal"], d["first"], d["last"]) for d in p["diagonals"]]))
                        elif p["at"] == check:
                            spans += [(d["first"], d["last"], 1.0, p["of"]) for d in p["diagonals"]]
                    for of, found in by.items():
                        spans += [(x, y, s, of) for x, y, s in repeats(a, found, least_words, threshold, of == k)]
                    spans = merged(spans)
                spans_of.append([{"first": x, "end": y, "similarity": s, "of": names[of]} for x, y, s, of in spans])
                total.append(count)
                gone.append(sum(y - x for x, y, _, _ in spans))
                rest.append((without(t, spans) if spans else t).decode("utf-8") if t is not None else None)
            span_type = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("similarity", pa.float64()), ("of", batch.column(id_col).type)]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in base), pa.array(spans_of, span_type), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(rest, pa.string())], [*base, "repeats", "n_words", "n_cut", "rest"])

    return joined_rows.mapInArrow(cut, schema)
