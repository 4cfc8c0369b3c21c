"""Ziv-Merhav cross-parsing against reference text of the corpus.

The reference of a language is the text of all its documents that labels call good.
Every document is parsed against the whole of it, less the document's own text: from
left to right, each phrase is the longest run of tokens that occurs in another document
of the reference, a token that occurs nowhere is a phrase of its own.  With c phrases
over n tokens against a reference of N tokens the cross entropy is c log2(N) / n bits a
token; with the c' phrases of the document's own incremental (LZ78) parse, its entropy
is c' log2(c') / n; the score is their difference.

Scale: the reference is cut by hash of doc_id into suffix arrays of about `shard_tokens`
tokens, written once to the folder that executors share and mapped into memory one after
the other.  A batch of documents takes the longest match at each position over all of
them, then the greedy parse; results don't depend on the cut.  Documents aren't
shuffled.  The work is the documents' tokens times the number of suffix arrays, where an
array costs a position a look into a filter, and a search only if a longer run may be there
and the runs from its neighbours leave its own open.
"""

from __future__ import annotations

import io
import math
import re
import sys
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, shared_folder, small_side, table

#: Of one suffix array; about 90 bytes each while it is built, 34 mapped.
SHARD_TOKENS = 4_000_000
#: Tokens of documents that are matched at once.
BATCH_TOKENS = 400_000
TOKEN = re.compile(r"\w+|[^\w\s]")
SPACE = re.compile(r"\s")
SCHEMA = "doc_id long, lang string, n_tokens long, reference_tokens long, cross_phrases long, self_phrases long, cross_entropy double, relative_entropy double"


class SuffixAutomaton:
    """Of a sequence of hashable tokens; extended one by one in amortised constant time."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.last, self.size = [-1], [0], 0, 0

    def extend(self, tokens) -> None:
        nxt, link, length, last = self.next, self.link, self.length, self.last
        for ch in tokens:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and ch not in nxt[p]:
                nxt[p][ch] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][ch]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(nxt[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(ch) == q:
                        nxt[p][ch] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
            self.size += 1
        self.last = last

    def phrases(self, tokens) -> int:
        """The number of phrases of the greedy parse."""
        nxt = self.next
        start = state = nxt[0]
        count, open_ = 0, False
        for ch in tokens:
            to = state.get(ch)
            if to is None:
                count += open_
                to = start.get(ch)
                if to is None:
                    count, open_, state = count + 1, False, start
                    continue
            state, open_ = nxt[to], True
        return count + open_


def own_phrases(tokens) -> int:
    """Phrases of the LZ78 parse; an unfinished last one counts."""
    root: dict = {}
    node, count = root, 0
    for ch in tokens:
        to = node.get(ch)
        if to is None:
            node[ch] = {}
            count += 1
            node = root
        else:
            node = to
    return count + (node is not root)


BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Lengths of runs for which a shard has a filter of eight to sixteen bits a token; a run of one is a phrase, known or not.
LEVELS = np.array([2, 3, 4, 6])
#: Turns a run's hash into that of its second place in a filter.
SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def powers(n: int, base: int = BASE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def runs(sums: np.ndarray, a: np.ndarray, n: np.ndarray | int, inverse: np.ndarray) -> np.ndarray:
    """Hashes of the runs of n tokens from a on; their highest bits, and those times SECOND, are their places in a filter."""
    return mix64((sums[a + n] - sums[a]) * inverse[a])


def prefix_hashes(hashes: np.ndarray, power: np.ndarray) -> np.ndarray:
    """h with h[b] - h[a] the polynomial hash of tokens a to b, times the power of a; modulo 2^64."""
    return np.append(np.uint64(0), np.add.accumulate(hashes * power[: len(hashes)]))


@cache
def characters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point 1 if it is of a word, 2 if it is a mark, 0 if neither, as TOKEN has it; and its hash."""
    every = "".join(" " if 0xD800 <= c < 0xE000 else chr(c) for c in range(sys.maxunicode + 1))
    kind = np.zeros(len(every), np.uint8)
    for k, pattern in ((1, r"\w+"), (2, r"[^\w\s]+")):
        for m in re.finditer(pattern, every):
            kind[m.start() : m.end()] = k
    return kind, mix64(np.arange(len(every), dtype=np.uint64))


class Hasher:
    """Texts, or lists of tokens, -> 64-bit hashes of their tokens."""

    #: Characters that are hashed at once; about 60 bytes each.
    CHARS = 1 << 18

    def __init__(self) -> None:
        self.power, self.inverse = powers(self.CHARS), powers(self.CHARS, INVERSE)

    def __call__(self, tokens: list[str]) -> np.ndarray:
        return self.texts([" ".join(tokens)])[0]

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """The hashes of the tokens that TOKEN finds in each text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held, size = [], 0
        for i, text in enumerate(texts):
            for part in self.parts(text):
                if held and size + len(part) >= self.CHARS:
                    self.hash(held, out)
                    held, size = [], 0
                held.append((i, part))
                size += len(part) + 1
        if held:
            self.hash(held, out)
        return [h[0] if len(h) == 1 else np.concatenate([np.zeros(0, np.uint64), *h]) for h in out]

    def parts(self, text: str) -> Iterator[str]:
        """The text, if it is long cut where there is space."""
        at = 0
        while len(text) - at > self.CHARS and (space := SPACE.search(text, at + self.CHARS // 2)):
            yield text[at : space.start()]
            at = space.end()
        yield text[at:]

    def hash(self, held: list[tuple[int, str]], out: list[list[np.ndarray]]) -> None:
        kinds, codes = characters()
        ends = np.cumsum([len(t) + 1 for _, t in held])
        points = np.frombuffer("\n".join([*(t for _, t in held), ""]).encode("utf-32-le"), np.uint32)
        if len(points) > len(self.power):
            self.power, self.inverse = powers(len(points)), powers(len(points), INVERSE)
        kind = kinds[points]
        # A word goes on as long as its characters do, a mark stands alone; the last character is a space.
        word = kind == 1
        start = np.flatnonzero((kind == 2) | (word & np.append(True, ~word[:-1])))
        stop = np.flatnonzero((kind == 2) | (word & np.append(~word[1:], True))) + 1
        sums = prefix_hashes(codes[points], self.power)
        token = runs(sums, start, stop - start, self.inverse)
        for (i, _), some in zip(held, np.split(token, np.searchsorted(start, ends[:-1]))):
            out[i].append(some)


def suffix_array(key: np.ndarray, k: int) -> np.ndarray:
    """By prefix doubling, from keys that order the first k tokens of each suffix."""
    n = len(key)
    sa = np.argsort(key)
    ordered = key[sa]
    first = np.append(True, ordered[1:] != ordered[:-1])
    del ordered
    rank = np.empty(n, np.int32)
    at = np.arange(n, dtype=np.int32)
    rank[sa] = np.maximum.accumulate(np.where(first, at, np.int32(0)))
    left = at[~(first & np.append(first[1:], True))]
    del at, first
    while len(left):
        own = sa[left]
        later = np.where(own + k < n, rank[np.minimum(own + k, n - 1)], n + own)  # behind the end all is mark
        both = rank[own].astype(np.int64) << 32 | later
        order = np.argsort(both, kind="stable")
        own, both = own[order], both[order]
        sa[left] = own
        first = np.append(True, both[1:] != both[:-1])
        rank[own] = np.maximum.accumulate(np.where(first, left, 0))
        left = left[~(first & np.append(first[1:], True))]
        k *= 2
    return sa


class Shard:
    """A suffix array over the tokens of some documents, each followed by a mark that no text holds."""

    #: Its arrays: distinct token hashes, tokens, the suffixes' places, their first tokens
    #: packed, the steps (of 255 at most) to the nearest suffixes before and after with
    #: another document, prefix hashes, where each text begins and its document, doc_ids,
    #: the documents' lengths, and for each of LEVELS a bit map of its runs.
    NAMES = ("vocabulary", "tokens", "sa", "key", "before", "after", "hashes", "begins", "owners", "ids", "lengths", "filters")

    #: Runs that are put into a filter at once.
    PART = 1 << 19

    def __init__(self, arrays: list[np.ndarray]) -> None:
        self.vocabulary, self.tokens, self.sa, self.key, self.before, self.after, self.hashes, self.begins, self.owners, self.ids, self.lengths, self.filters = arrays
        self.bits = int(len(self.vocabulary) + 2).bit_length()
        self.width = 62 // self.bits

    @classmethod
    def build(cls, ids: list[int], texts: list[np.ndarray]) -> Shard:
        """`texts` are token hashes; those of one doc_id stand together."""
        names, doc_of = np.unique(np.array(ids, np.int64), return_inverse=True)
        lengths = np.array([len(t) for t in texts], np.int64)
        flat = np.concatenate([np.append(t, np.uint64(0)) for t in texts])
        mark = np.cumsum(lengths + 1) - 1
        vocabulary, token = np.unique(flat, return_inverse=True)
        # Codes from 1 on; 0 stands for tokens that the shard doesn't know, the mark sorts behind all.
        token = token.astype(np.int64) + 1
        if vocabulary[0] == 0:
            vocabulary, token = vocabulary[1:], token - 1
        token[mark] = len(vocabulary) + 1
        flat[mark] = mix64(np.full(1, 77, np.uint64))[0]
        bits = int(len(vocabulary) + 2).bit_length()
        width = 62 // bits
        token = token.astype(np.int32)
        key = np.zeros(len(token), np.int64)
        padded = np.append(token, np.full(width, len(vocabulary) + 1, np.int32))
        for k in range(width):
            key = key << bits | padded[k : k + len(token)]
        del padded
        sa = suffix_array(key, width).astype(np.int32)
        key = key[sa]
        doc = np.repeat(doc_of, lengths + 1)[sa].astype(np.int32)
        at = np.arange(len(sa))
        change = np.append(True, doc[1:] != doc[:-1])
        start = np.maximum.accumulate(np.where(change, at, 0))
        end = np.append(at[change][1:], len(sa))[np.cumsum(change) - 1]
        sums = np.bincount(doc_of, weights=lengths, minlength=len(names)).astype(np.int64)
        near = [np.minimum(x, 255).astype(np.uint8) for x in (at - start + 1, end - at)]
        del start, end, change, doc, at
        hashes = prefix_hashes(flat, powers(len(flat)))
        del flat
        inverse = powers(len(token), INVERSE)
        size = max(10, int(8 * len(token)).bit_length())
        filters = np.zeros((len(LEVELS), 1 << (size - 3)), np.uint8)
        for level, n in enumerate(LEVELS.tolist()):
            seen = np.zeros(1 << size, bool)
            for first in range(0, len(token) - n + 1, cls.PART):
                run = runs(hashes, np.arange(first, min(first + cls.PART, len(token) - n + 1)), n, inverse)
                seen[run >> np.uint64(64 - size)] = True
                seen[run * SECOND >> np.uint64(64 - size)] = True
            filters[level] = np.packbits(seen, bitorder="little")
        begins = np.append(0, mark[:-1] + 1)
        return cls([vocabulary, token, sa, key, *near, hashes, begins, doc_of.astype(np.int64), names, sums, filters])

    def save(self, folder: str) -> None:
        files, path = fs.FileSystem.from_uri(folder)
        files.create_dir(path)
        for name in self.NAMES:
            held = io.BytesIO()
            np.save(held, getattr(self, name))
            with files.open_output_stream(f"{path}/{name}.npy") as out:
                out.write(held.getbuffer())

    @classmethod
    def load(cls, folder: str) -> Shard:
        """Mapped into memory from a local or mounted folder, else read."""
        files, path = fs.FileSystem.from_uri(folder)
        if isinstance(files, fs.LocalFileSystem):
            return cls([np.load(f"{path}/{name}.npy", mmap_mode="r").view(np.ndarray) for name in cls.NAMES])
        return cls([np.load(io.BytesIO(files.open_input_file(f"{path}/{name}.npy").read())) for name in cls.NAMES])

    def index(self, ids: list[int | None]) -> np.ndarray:
        """The place of each doc_id in this shard, or -1."""
        asked = np.array([-1 if d is None else d for d in ids], np.int64)
        at = np.minimum(np.searchsorted(self.ids, asked), len(self.ids) - 1)
        return np.where((self.ids[at] == asked) & np.array([d is not None for d in ids]), at, -1)

    def equal(self, text: np.ndarray, power: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return (text[a + n] - text[a]) * power[b] == (self.hashes[b + n] - self.hashes[b]) * power[a]

    def common(self, text: np.ndarray, power: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The number of equal tokens from a of the text and b of the shard on, `most` at most."""
        most = np.minimum(most, len(self.hashes) - 1 - b)
        out, fail, at, step = np.zeros(len(a), np.int64), np.ones(len(a), np.int64), np.arange(len(a)), 1
        while len(at):
            at = at[most[at] >= step]
            at = at[self.equal(text, power, a[at], b[at], step)]
            out[at], fail[at] = step, 2 * step
            step *= 2
        # The first `out` agree, the first `fail` don't.
        at = np.flatnonzero((fail - out > 1) & (most > out))
        while len(at):
            mid = (out[at] + np.minimum(fail[at], most[at] + 1)) // 2
            same = self.equal(text, power, a[at], b[at], mid)
            out[at] = np.where(same, mid, out[at])
            fail[at] = np.where(same, np.minimum(fail[at], most[at] + 1), mid)
            at = at[fail[at] - out[at] > 1]
        return out

    def pack(self, token: np.ndarray, a: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`width` tokens from a on, as far as they are known, zeros behind, where only order counts; and whether all are known."""
        key, whole = np.zeros(len(a), np.int64), np.ones(len(a), bool)
        for k in range(self.width):
            t = np.where(a + k < end, token[np.minimum(a + k, len(token) - 1)], 0)
            whole &= t > 0
            key = key << self.bits | np.where(whole, t, 0)
        return key, whole

    def second(self, at: np.ndarray) -> np.ndarray:
        """The tokens behind the packed ones of the suffixes at `at`, packed."""
        first, key = self.sa[at].astype(np.int64) + self.width, np.zeros(len(at), np.int64)
        for k in range(self.width):
            key = key << self.bits | np.where(first + k < len(self.tokens), self.tokens[np.minimum(first + k, len(self.tokens) - 1)], len(self.vocabulary) + 1)
        return key

    def agree(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The number of first tokens in which packed tokens agree."""
        x = x ^ y
        return sum(((x >> self.bits * (self.width - k)) == 0).astype(np.int64) for k in range(1, self.width + 1))

    def bound(self, lo: np.ndarray, hi: np.ndarray, key: np.ndarray, right: bool) -> np.ndarray:
        """Where each key goes among the second keys from lo to hi."""
        lo, hi = lo.copy(), hi.copy()
        at = np.flatnonzero(lo < hi)
        while len(at):
            mid = (lo[at] + hi[at]) // 2
            its = self.second(mid)
            less = its <= key[at] if right else its < key[at]
            lo[at] = np.where(less, mid + 1, lo[at])
            hi[at] = np.where(less, hi[at], mid)
            at = at[lo[at] < hi[at]]
        return lo

    def known(self, distinct: np.ndarray) -> np.ndarray:
        """The codes of distinct token hashes, 0 for those that aren't here."""
        place = np.minimum(np.searchsorted(self.vocabulary, distinct), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[place] == distinct, place + 1, 0)

    def may_hold(self, level: np.ndarray, run: np.ndarray) -> np.ndarray:
        """Which runs, of LEVELS[level] tokens, may be here."""
        bits, flat = int(self.filters.shape[1]).bit_length() + 2, self.filters.reshape(-1)
        at = None
        for factor in (np.uint64(1), SECOND):
            place = (run if at is None else run[at] * factor) >> np.uint64(64 - bits)
            row = level if at is None else level[at]
            hit = np.flatnonzero((flat[(row << (bits - 3)) + (place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1)
            at = hit if at is None else at[hit]
        return at

    def document(self, at: np.ndarray) -> np.ndarray:
        """The documents of the suffixes at `at`."""
        return self.owners[np.searchsorted(self.begins, self.sa[at], "right") - 1]

    def skip(self, near: np.ndarray, step: np.ndarray, sign: int, own: np.ndarray) -> np.ndarray:
        """The first suffixes from `near` on, or places beyond all, that are of another document than `own`."""
        near, size = near.copy(), len(self.sa)
        at = np.flatnonzero((near >= 0) & (near < size) & (own >= 0))
        while len(at := at[self.document(near[at]) == own[at]]):
            near[at] += sign * step[near[at]].astype(np.int64)
            at = at[(near[at] >= 0) & (near[at] < size)]
        return near

    def longest(self, token: np.ndarray, text: np.ndarray, power: np.ndarray, end: np.ndarray, own: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions a, in some order, of documents that end at `end`, and the longest run from each in another document than `own` (index, or -1)."""
        n, size = len(token), len(self.sa)
        key, whole = self.pack(token, a, end[a])
        # In the order of the shard, so that neighbours look at the same places.
        order = np.argsort(key)
        a, key, whole = a[order], key[order], whole[order]
        new = np.append(True, key[1:] != key[:-1])
        some, back = key[new], np.cumsum(new) - 1
        lo = np.searchsorted(self.key, some, "left")
        hi = lo.copy()
        # No suffix's key holds the zero of a token that isn't known.
        there = np.flatnonzero(self.key[np.minimum(lo, size - 1)] == some)
        hi[there] = np.searchsorted(self.key, some[there], "right")
        lo, hi = lo[back], hi[back]
        most, own = end[a] - a, own[a]
        # The same among equals by their next tokens.
        at = np.flatnonzero(hi > lo)
        key2 = np.zeros(len(a), np.int64)
        key2[at], both = self.pack(token, a[at] + self.width, end[a[at]])
        left = self.bound(lo[at], hi[at], key2[at], False)
        right = left.copy()
        right[both] = self.bound(left[both], hi[at[both]], key2[at[both]], True)
        lo[at], hi[at] = left, right
        known = np.full(len(a), self.width)
        known[at] = 2 * self.width
        # Where all of these are the document's own, the nearest others lie around them.
        at = np.flatnonzero((lo < hi) & (own >= 0))
        others = self.skip(lo[at], self.after, 1, own[at])
        search = lo < hi
        search[at] = others < hi[at]
        at = np.flatnonzero(search)
        while len(at):
            mid = (lo[at] + hi[at]) // 2
            b = self.sa[mid].astype(np.int64)
            same = self.common(text, power, a[at] + known[at], b + known[at], most[at] - known[at]) + known[at]
            # The text's suffix is less where it ends; else the next tokens decide.
            ended = same == most[at]
            mine = token[np.minimum(a[at] + same, n - 1)]
            its = self.tokens[b + same]
            less = ended | (mine < its)
            hi[at] = np.where(less, mid, hi[at])
            lo[at] = np.where(less, lo[at], mid + 1)
            at = at[lo[at] < hi[at]]
        out = np.zeros(len(a), np.int64)
        for near, step, sign in ((lo - 1, self.before, -1), (hi, self.after, 1)):
            near = self.skip(near, step, sign, own)
            at = np.flatnonzero((near >= 0) & (near < size))
            same = self.agree(key[at], self.key[near[at]])
            more = np.flatnonzero(same == self.width)
            same[more] += self.agree(key2[at[more]], self.second(near[at[more]]))
            more = np.flatnonzero(same == 2 * self.width)
            far = at[more]
            same[more] += self.common(text, power, a[far] + 2 * self.width, self.sa[near[far]].astype(np.int64) + 2 * self.width, most[far] - 2 * self.width)
            out[at] = np.maximum(out[at], same)
        return a, out


class Batch:
    """Documents that are matched at once, against one array after the other.

    What doesn't depend on the array is done once: tokens are numbered, and a position
    keeps the hash of the end of the shortest run that would be a gain there (as long as
    LEVELS has it) until it gains.  An array is asked for that by its filters, and searched
    only where they let it pass.  A run may lose its first tokens, so no run from a later
    position ends before one from an earlier; between two positions with runs that end at
    the same place no search is needed.
    """

    #: Of the positions that filters let pass, those divisible by the first are searched first.
    STEPS = (16, 1)

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray, power: np.ndarray, inverse: np.ndarray) -> None:
        self.lengths, self.end, self.power, self.inverse = lengths, np.repeat(np.cumsum(lengths), lengths), power, inverse
        self.distinct, self.number = np.unique(tokens, return_inverse=True)
        self.text = prefix_hashes(tokens, power)
        # Where the longest run from each position ends; a token that occurs nowhere is a phrase as well.
        self.reach = np.arange(1, len(tokens) + 1)
        #: Positions where a longer run has room, its level and its hash.
        self.at = np.flatnonzero(self.end > self.reach)
        self.level, self.run = self.needed(self.at)

    @property
    def best(self) -> np.ndarray:
        """The length of the longest run from each position."""
        return self.reach - np.arange(len(self.reach))

    def needed(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        after = self.reach[at] + 1
        level = np.searchsorted(LEVELS, after - at, "right") - 1
        return level, runs(self.text, after - LEVELS[level], LEVELS[level], self.inverse)

    def meet(self, shard: Shard, own: np.ndarray) -> None:
        """Take the longer runs of a shard; `own` is the place of each document in it, or -1."""
        if not len(self.at) or not len(shard.vocabulary):
            return
        left = self.at[shard.may_hold(self.level, self.run)]
        if not len(left):
            return
        token, own, before = shard.known(self.distinct)[self.number], np.repeat(own, self.lengths), self.reach[self.at]
        # The shard has no longer run from a settled position; the last of a document always is one.
        settled = np.ones(len(token), bool)
        settled[left] = False
        for step in self.STEPS:
            left = left[~settled[left]]
            done = np.flatnonzero(settled)
            a = left[(left % step == 0) & (self.reach[left] < self.reach[done[np.searchsorted(done, left)]])]
            if len(a):
                settled[a] = True
                a, found = shard.longest(token, self.text, self.power, self.end, own, a)
                self.reach[a] = np.maximum(self.reach[a], a + found)
                # No run reaches into the next document.
                np.maximum.accumulate(self.reach, out=self.reach)
        moved = np.flatnonzero(self.reach[self.at] > before)
        room = self.end[self.at[moved]] > self.reach[self.at[moved]]
        self.level[moved[room]], self.run[moved[room]] = self.needed(self.at[moved[room]])
        self.at, self.level, self.run = (np.delete(x, moved[~room]) for x in (self.at, self.level, self.run))


def score(n: int, c: int, own: int, reference: int) -> tuple[int, int, float | None, float | None]:
    if not n or not reference:
        return 0, own, None, None
    cross = c * math.log2(reference + 1) / n
    return c, own, cross, cross - own * math.log2(max(own, 1)) / n


def relative_entropy(docs: DataFrame, labels: DataFrame, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row for each document; see SCHEMA.

    reference_tokens counts the tokens of its language's reference less its own.  A
    phrase lies within one reference text.  A null language is a language of its own.
    Null and empty texts, and documents without another good document in their language,
    get null entropies.  Repeated rows are scored each; as references they count once
    for each doc_id and text.  Other columns are ignored.
    """
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("key"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    good = small_side(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct())
    reference = text.where("length(text) > 0").join(good, "doc_id", "left_semi")
    # A token is a word or a mark; words are about six characters long with their space.
    # Sizes need no text beyond the scan.
    shards = reference.select("key", F.length("text").alias("chars")).groupBy("key").agg(F.ceil(F.sum("chars") / 6 / shard_tokens).cast("int").alias("n"))
    rows = reference.join(F.broadcast(shards), "key").select("key", F.pmod(F.xxhash64("doc_id"), F.col("n")).cast("int").alias("shard"), "doc_id", "text")
    rows = rows.repartition("key", "shard").sortWithinPartitions("key", "shard", "doc_id", F.xxhash64("text"))
    folder = f"{shared_folder(spark)}/cross-parsing-{uuid.uuid4()}"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, at, last = Hasher(), None, None
        ids: list[int] = []
        texts: list[np.ndarray] = []

        def done() -> Iterator[pa.RecordBatch]:
            if ids:
                shard, path = Shard.build(ids, texts), f"{folder}/{uuid.uuid4()}"
                shard.save(path)
                yield pa.RecordBatch.from_pydict({"key": [at[0]], "path": [path], "n": [int(shard.lengths.sum())]})
            ids.clear()
            texts.clear()

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "shard", "doc_id", "text")]
            for key, shard, doc, t, tokens in zip(*columns, hasher.texts(columns[-1])):
                if (key, shard) != at:
                    yield from done()
                    at, last = (key, shard), None
                if (doc, t) != last:
                    ids.append(doc)
                    texts.append(tokens)
                last = (doc, t)
        yield from done()

    paths: dict[str, list[str]] = {}
    totals: dict[str, int] = {}
    for r in rows.mapInArrow(build, "key string, path string, n long").collect():
        paths.setdefault(r.key, []).append(r.path)
        totals[r.key] = totals.get(r.key, 0) + r.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        loaded: dict[str, list[Shard]] = {}
        held: dict[str, list[tuple]] = {}
        sizes: dict[str, int] = {}
        power = inverse = powers(0)

        def done(key: str) -> pa.RecordBatch:
            nonlocal power, inverse
            docs, sizes[key] = held.pop(key), 0
            if key not in loaded:
                loaded[key] = [Shard.load(p) for p in paths.get(key, ())]
            lengths = np.array([len(d[2]) for d in docs])
            ends = np.cumsum(lengths)
            tokens = np.concatenate([d[2] for d in docs])
            if (most := max([len(tokens), *(len(s.sa) for s in loaded[key])]) + 1) > len(power):
                power, inverse = powers(most), powers(most, INVERSE)
            batch, rest = Batch(tokens, lengths, power, inverse), np.full(len(docs), totals.get(key, 0))
            for shard in loaded[key]:
                own = shard.index([d[0] for d in docs])
                rest -= np.where(own >= 0, shard.lengths[own], 0)
                batch.meet(shard, own)
            reach = batch.reach.tolist()
            out: dict[str, list] = {k: [] for k in ("doc_id", "lang", "n_tokens", "reference_tokens", "cross_phrases", "self_phrases", "cross_entropy", "relative_entropy")}
            for (doc, lang, own_tokens, phrases), e, n in zip(docs, ends.tolist(), rest.tolist()):
                at, c = e - len(own_tokens), 0
                while at < e:
                    at = reach[at]
                    c += 1
                for k, v in zip(out, (doc, lang, len(own_tokens), n, *score(len(own_tokens), c, phrases, n))):
                    out[k].append(v)
            return pa.RecordBatch.from_arrays(
                [pa.array(out[k], t) for k, t in (("doc_id", pa.int64()), ("lang", pa.string()), ("n_tokens", pa.int64()), ("reference_tokens", pa.int64()), ("cross_phrases", pa.int64()), ("self_phrases", pa.int64()), ("cross_entropy", pa.float64()), ("relative_entropy", pa.float64()))],
                list(out),
            )

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "doc_id", "lang", "text")]
            for key, doc, lang, tokens in zip(*columns[:-1], hasher.texts([t or "" for t in columns[-1]])):
                held.setdefault(key, []).append((doc, lang, tokens, own_phrases(tokens.tolist())))
                sizes[key] = sizes.get(key, 0) + len(tokens) + 1
                if sizes[key] >= BATCH_TOKENS:
                    yield done(key)
        for key in list(held):
            yield done(key)

    return text.mapInArrow(run, SCHEMA)


def op4_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relative_entropy(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
