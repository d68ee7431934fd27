"""BPE encoding and decoding by speculation and verification.

A word (a piece that the pre-tokenizer leaves) is first cut greedily into the longest tokens.
A sequence of tokens is what merging gives exactly if every adjacent pair is, so the proposal is
checked pair by pair, for all words of a batch at once; only words with a failing pair are merged
rule by rule. Distinct words of a batch are encoded once and remembered in a bounded cache.

Texts that are null count as empty. Rows are independent of each other: repeated rows, ties in
doc_id and null doc_ids pass through, an empty table gives an empty table, and other columns of
the input are ignored.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import text
from ._common import documents

#: The patterns of the two published pre-tokenizers.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Words longer than this are merged with a heap, in n log n steps.
LONG_WORD = 192
#: Entries of a cache, and of the one before it.
CACHE_ENTRIES = 200_000
#: Pieces of lower-case texts that are remembered, their ids, and the longest of them in bytes.
CACHE_PIECES = 400_000
CACHE_IDS = 8_000_000
LONG_PIECE = 256
#: Text bytes taken through a worker at a time.
BATCH_BYTES = 2 << 20

_NO_RANK = np.int32(2**31 - 1)
#: Words that are merged side by side.
_COLUMNS = 8192
_SYMBOLS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LAST_PLAIN = "\u024f"  # up to here letters are lower-cased one by one and nothing composes


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class MergeTable:
    """One vocabulary as arrays: how each token splits, which pairs merge, and a trie."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        n = max([*vocab.values(), *self.specials.values()]) + 1
        letters = byte_alphabet()
        code = {c: b for b, c in enumerate(letters)}
        self.end = 256
        self.prio = np.zeros(n, np.int32)
        self.left = np.arange(n, dtype=np.int32)
        self.right = np.arange(n, dtype=np.int32)
        self.plain = np.array([vocab[c] for c in letters], np.int32)
        self.closing = np.array([vocab[c + self.suffix] for c in letters], np.int32) if self.suffix else self.plain
        pairs: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            first, second = merge.split(" ") if isinstance(merge, str) else merge
            a, b, made = vocab[first], vocab[second], vocab[first + second]
            pairs[a, b] = made
            self.left[made], self.right[made], self.prio[made] = a, b, rank + 1
        self._pairs = pairs
        self.by_rank = np.zeros(len(pairs) + 2, np.int32)
        made = np.flatnonzero(self.prio)
        self.by_rank[self.prio[made]] = made
        self._hash(pairs)
        self.bytes_of = [b""] * n
        spelled: list[tuple[list[int], int]] = []
        for token, i in vocab.items():
            body = token[: -len(self.suffix)] if self.suffix and token.endswith(self.suffix) else token
            raw = bytes(code[c] for c in body)
            closed = len(body) < len(token)
            self.bytes_of[i] = raw + (b" " if closed else b"")
            spelled.append(([*raw, self.end] if closed else list(raw), i))
        for content, i in self.specials.items():
            self.bytes_of[i] = content.encode()
        self._trie(spelled)

    def _hash(self, pairs: dict[tuple[int, int], int]) -> None:
        """Open addressing; a slot holds the pair as one integer."""
        bits = 19
        self._mask, self._mul = (1 << bits) - 1, np.uint64(0x9E3779B97F4A7C15)
        self._keys, self._made = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        self._shift = np.uint64(64 - bits)
        keys = np.array([(a << 32) | b for a, b in pairs], np.int64)
        for key, slot, made in zip(keys.tolist(), self._slot(keys).tolist(), pairs.values(), strict=True):
            while self._keys[slot] >= 0:
                slot = (slot + 1) & self._mask
            self._keys[slot], self._made[slot] = key, made

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self._mul) >> self._shift).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Token that each pair merges into, -1 where there is no such rule."""
        keys = (a.astype(np.int64) << 32) | b.astype(np.int64)
        slot = self._slot(keys)
        found = self._keys[slot]
        out = np.where(found == keys, self._made[slot], np.int32(-1))
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while open_.size:
            slot[open_] = (slot[open_] + 1) & self._mask
            found = self._keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self._made[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def _trie(self, spelled: list[tuple[list[int], int]]) -> None:
        step: dict[tuple[int, int], int] = {}
        token = [-1]
        inner: dict[int, int] = {0: 0}
        for symbols, i in spelled:
            at = 0
            for s in symbols:
                inner.setdefault(at, len(inner))
                nxt = step.get((at, s))
                if nxt is None:
                    nxt = step[at, s] = len(token)
                    token.append(-1)
                at = nxt
            token[at] = i
        rows = np.full(len(token), len(inner), np.int32)  # leaves share a row without steps
        rows[list(inner)] = list(inner.values())
        table = np.zeros((len(inner) + 1, 258), np.int32)
        for (at, s), nxt in step.items():
            table[inner[at], s] = nxt
        self._rows, self._next, self._token = rows, table.ravel(), np.array(token, np.int32)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each adjacent pair: does merging leave exactly these two tokens?

        The merges on both sides of the border are undone, latest first. The pair fails as soon
        as a rule across the border would have come before the merge undone last.
        """
        ok = np.ones(len(a), bool)
        at, limit = np.arange(len(a)), np.full(len(a), _NO_RANK, np.int32)
        while at.size:
            made = self.merged(a, b)
            bad = (made >= 0) & (self.prio[made] < limit)
            ok[at[bad]] = False
            pa_, pb_ = self.prio[a], self.prio[b]
            go = ~bad & ((pa_ > 0) | (pb_ > 0))
            at, a, b, pa_, pb_ = at[go], a[go], b[go], pa_[go], pb_[go]
            undo_left = pa_ > pb_
            limit = np.where(undo_left, pa_, pb_ + 1).astype(np.int32)
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
        return ok

    def propose(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest match for words back to back in ``raw``: (word, token) in order, and which words can't be cut so."""
        symbols = np.full(len(raw) + len(sizes) + 2, 257, np.int64)
        symbols[np.arange(len(raw)) + np.repeat(np.arange(len(sizes)), sizes)] = raw
        ends = np.cumsum(sizes + 1) - 1
        symbols[ends] = self.end if self.suffix else 257
        last = ends + 1 if self.suffix else ends
        pos, who = ends - sizes, np.arange(len(sizes))
        failed = np.zeros(len(sizes), bool)
        out_who, out_token = [], []
        live = pos < last
        pos, who, goal = pos[live], who[live], last[live]
        while who.size:
            state = np.zeros(len(who), np.int32)
            token, length = np.full(len(who), -1, np.int32), np.zeros(len(who), np.int64)
            walk, depth = np.arange(len(who)), 0
            while walk.size:
                state = self._next[self._rows[state] * 258 + symbols[pos[walk] + depth]]
                depth += 1
                going = state > 0
                walk, state = walk[going], state[going]
                found = self._token[state]
                hit = found >= 0
                token[walk[hit]], length[walk[hit]] = found[hit], depth
            none = token < 0
            failed[who[none]] = True
            out_who.append(who[~none])
            out_token.append(token[~none])
            pos = pos + length
            live = ~none & (pos < goal)
            pos, who, goal = pos[live], who[live], goal[live]
        if not out_who:
            return np.zeros(0, np.int64), np.zeros(0, np.int32), failed
        who, token = np.concatenate(out_who), np.concatenate(out_token)
        order = np.argsort(who, kind="stable")
        return who[order], token[order], failed

    def merge_exactly(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rule by rule, lowest rank and then leftmost first: (word, token) in the order of each word's tokens.

        Words of similar length are columns of one matrix; every step makes one merge in each column.
        """
        who, token = [], []
        for i in np.flatnonzero(sizes > LONG_WORD).tolist():
            token.append(self._merge_long(raw[starts[i] : starts[i] + sizes[i]].tobytes()))
            who.append(np.full(len(token[-1]), i))
        short = np.flatnonzero((sizes > 0) & (sizes <= LONG_WORD))
        short = short[np.argsort(sizes[short], kind="stable")]
        lo = 0
        while lo < len(short):
            width = (int(sizes[short[lo]]) + 3) // 4 * 4
            hi = min(lo + _COLUMNS, int(np.searchsorted(sizes[short], width, "right")))
            for w, t in self._merge_columns(raw, starts[short[lo:hi]], sizes[short[lo:hi]], width):
                who.append(short[lo:hi][w])
                token.append(t)
            lo = hi
        if not who:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        return np.concatenate(who), np.concatenate(token)

    def _merge_columns(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int):
        """The tokens of words of at most ``width`` bytes, as (column, token) arrays.

        ``key`` is the rank of the pair that begins at a place, with the place in the low byte; dead places and
        the last row, which stands for what lies outside a word, have none.
        """
        n = len(starts)
        place = np.arange(width)[:, None]
        inside = place < sizes
        symbols = raw[np.minimum(starts + place, len(raw) - 1)]
        ids = np.full((width + 1, n), -1, np.int32)
        ids[:-1] = np.where(inside, self.plain[symbols], -1)
        last = sizes - 1
        ids[last, np.arange(n)] = self.closing[symbols[last, np.arange(n)]]
        key = np.full((width + 1, n), _NO_RANK, np.int32)
        pair = place[:-1] < sizes - 1
        made = self.merged(ids[: width - 1][pair], ids[1:width][pair])
        key[: width - 1][pair] = np.where(made >= 0, self.prio[made] << 8, _NO_RANK - 255) | np.broadcast_to(place[:-1], pair.shape)[pair].astype(np.int32)
        key[key >= _NO_RANK - 255] = _NO_RANK
        after = np.broadcast_to(np.arange(1, width + 2, dtype=np.int32)[:, None], ids.shape).copy()
        after[last, np.arange(n)] = width
        after[width] = width
        before = np.broadcast_to(np.arange(-1, width, dtype=np.int32)[:, None], ids.shape).copy()
        before[0] = width
        owner = np.arange(n)
        while True:
            least = key[:width].min(axis=0)
            live = np.flatnonzero(least != _NO_RANK)
            n = len(owner)
            if live.size * 2 < n or not live.size:
                done = np.ones(n, bool)
                done[live] = False
                left = ids[:width, done].T
                held = left >= 0
                yield np.repeat(owner[done], held.sum(axis=1)), left[held]
                if not live.size:
                    return
                owner, least, n = owner[live], least[live], len(live)
                ids, key, after, before = (np.ascontiguousarray(x[:, live]) for x in (ids, key, after, before))
                live = np.arange(n)
            flat_ids, flat_key, flat_after, flat_before = (x.reshape(-1) for x in (ids, key, after, before))
            found = least[live]
            at = found & 255
            token = self.by_rank[found >> 8]
            here = at * n + live
            gone = flat_after[here] * n + live
            next_ = flat_after[gone]
            right = next_ * n + live
            prior = flat_before[here]
            left = prior * n + live
            flat_ids[here] = token
            flat_ids[gone] = -1
            flat_key[gone] = _NO_RANK
            flat_after[here] = next_
            flat_before[right] = at
            made = self.merged(np.concatenate([token, flat_ids[left]]), np.concatenate([flat_ids[right], token]))
            new = np.where(made >= 0, self.prio[made] << 8 | np.concatenate([at, prior]), _NO_RANK)
            flat_key[here] = new[: len(live)]
            flat_key[left] = new[len(live) :]

    def _merge_long(self, word: bytes) -> np.ndarray:
        ids = [int(self.plain[b]) for b in word]
        ids[-1] = int(self.closing[word[-1]])
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        pairs, prio = self._pairs, self.prio
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(ids) and (made := pairs.get((ids[i], ids[after[i]]))) is not None:
                heapq.heappush(heap, (int(prio[made]), i, ids[i], ids[after[i]]))

        for i in range(len(ids) - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = pairs[a, b], -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
        """Tokens of all words in one array, where each word's begin, and how many needed merging."""
        return self.encode_spans(np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words)))

    def encode_spans(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The same for words that stand back to back in ``raw``."""
        begins = np.cumsum(sizes) - sizes
        odd = sizes > LONG_WORD
        if (raw == 0).any():
            odd[np.searchsorted(begins + sizes, np.flatnonzero(raw == 0), "right")] = True
        short, exact = np.flatnonzero((sizes > 0) & ~odd), np.flatnonzero((sizes > 0) & odd)
        who, token = np.zeros(0, np.int64), np.zeros(0, np.int32)
        if short.size:
            packed = raw if short.size == len(sizes) else raw[np.repeat((sizes > 0) & ~odd, sizes)]
            who, token, failed = self.propose(packed, sizes[short])
            same = np.flatnonzero(who[1:] == who[:-1])
            wrong = same[~self.compatible(token[same], token[same + 1])]
            failed[who[wrong]] = True
            good = ~failed[who]
            who, token = short[who[good]], token[good]
            exact = np.concatenate([exact, short[failed]])
        if exact.size:
            owner, merged = self.merge_exactly(raw, begins[exact], sizes[exact])
            who, token = np.concatenate([who, exact[owner]]), np.concatenate([token, merged])
            order = np.argsort(who, kind="stable")
            who, token = who[order], token[order]
        starts = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(sizes)))]).astype(np.int64)
        return token, starts, len(exact)


class _Codec:
    """Cuts texts into units that can be encoded apart, and remembers units."""

    def __init__(self, path: str):
        self.path, self._library = path, None
        self.table = MergeTable(path)
        self.special_marks = tuple(self.table.specials)
        self.cache: dict = {}
        self.older: dict = {}
        self.letters = byte_alphabet()
        self.code = {c: b for b, c in enumerate(self.letters)}
        self.words = self.failures = 0

    def plan(self, units: list, index: dict) -> list:
        """For each unit a place in ``index``, or several; ~i stands for the token i itself."""
        return [self._place(self.pieces(u), index) for u in units]

    @staticmethod
    def _place(pieces: list, index: dict):
        if len(pieces) == 1 and type(pieces[0]) is bytes:
            return index.setdefault(pieces[0], len(index))
        return [index.setdefault(p, len(index)) if type(p) is bytes else ~p for p in pieces]

    @property
    def library(self):
        """The published tokenizer, for texts with characters beyond the plain ones; loaded when needed."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def fill(self, units: set) -> None:
        """Have all these units in the cache.

        A full cache becomes the older one, from which units in use come back.
        """
        if len(self.cache) > CACHE_ENTRIES:
            self.cache, self.older = {}, self.cache
        cache, older, fresh = self.cache, self.older, []
        for unit in units:
            if unit not in cache:
                if unit in older:
                    cache[unit] = older[unit]
                else:
                    fresh.append(unit)
        for lo in range(0, len(fresh), 50_000):
            index: dict[bytes, int] = {}
            plan = self.plan(fresh[lo : lo + 50_000], index)
            flat, starts, failed = self.table.encode_words(list(index))
            self.words += len(index)
            self.failures += failed
            self.cache.update(zip(fresh[lo : lo + 50_000], self.values(plan, flat, starts), strict=True))


class ByteCodec(_Codec):
    """The byte-level vocabulary: pieces keep the space before them.

    A text is cut at each single space between two characters that aren't white space: there a
    new piece starts, whatever stands around it.
    """

    _odd = re.compile(r" \s|\s |[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
    _cut = re.compile(r"(?<=[^\s\x1c-\x1f]) (?=[^\s\x1c-\x1f])")
    _split = regex.compile(BYTE_PATTERN)

    def units(self, text: str) -> list[str]:
        """Units with the space that starts each, but for the first."""
        parts = self._cut.split(text) if self._odd.search(text) else text.strip(" ").split(" ") if text[:1] != " " != text[-1:] else self._cut.split(text)
        return [parts[0], *[" " + p for p in parts[1:]]] if text else []

    def pieces(self, unit: str) -> list:
        for mark in self.special_marks:
            if mark in unit:
                before, _, rest = unit.partition(mark)
                return [*(self.pieces(before) if before else []), self.table.specials[mark], *(self.pieces(rest) if rest else [])]
        body = unit[1:] if unit[:1] == " " else unit
        if body.isalpha() and max(body) <= _LAST_PLAIN:
            return [unit.encode()]
        core = body.rstrip(_SYMBOLS)
        if core and core.isalpha() and max(core) <= _LAST_PLAIN:
            cut = len(unit) - len(body) + len(core)
            return [unit[:cut].encode(), unit[cut:].encode()]
        if max(unit) <= _LAST_PLAIN:
            return [p.encode() for p in self._split.findall(unit)]
        return [bytes(self.code[c] for c in p) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(unit)]

    def values(self, plan: list, flat: np.ndarray, starts: np.ndarray) -> list[tuple[bytes, bytes]]:
        """Decimal ids joined by commas, and the bytes that the ids decode to."""
        ids, at, known = flat.tolist(), starts.tolist(), self.table.bytes_of
        out = []
        for p in plan:
            mine = ids[at[p] : at[p + 1]] if type(p) is int else [i for q in p for i in (ids[at[q] : at[q + 1]] if q >= 0 else [~q])]
            out.append((",".join(map(str, mine)).encode(), b"".join([known[i] for i in mine])))
        return out

    def encode(self, text: str) -> list[int]:
        units = self.units(text)
        self.fill(set(units))
        return [int(x) for u in units if (d := self.cache[u][0]) for x in d.split(b",")]

    def decode(self, ids) -> str:
        known = self.table.bytes_of
        return b"".join(known[i] for i in ids if 0 <= i < len(known)).decode("utf-8", "replace")


class SeenPieces:
    """Pieces met so far as arrays with open addressing: what each consists of, and where its ids stand.

    A piece is compared by its length, its first 16 bytes and, beyond these, a 64-bit hash. The table starts
    anew when it holds ``most`` pieces or ``CACHE_IDS`` ids, so its size in bytes is bounded.
    """

    def __init__(self, most: int = CACHE_PIECES):
        self.most, self.bits = most, (4 * most).bit_length() - 1
        self.shift, self.mask = np.uint64(64 - self.bits), (1 << self.bits) - 1
        self.slots = np.empty(1 << self.bits, np.int32)
        self.first, self.second, self.hash = (np.zeros(2 * most + 2, np.uint64) for _ in range(3))
        self.size, self.at, self.count = (np.zeros(2 * most + 2, np.int32) for _ in range(3))
        self.ids = np.zeros(1 << 16, np.int32)
        self.clear()

    def clear(self) -> None:
        """Only piece 0 stays: the closing id."""
        self.slots.fill(-1)
        self.n, self.used = 1, 1
        self.at[0], self.count[0] = 0, 1

    def find(self, first: np.ndarray, second: np.ndarray, size: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        """Number of each piece, -1 for those not met yet."""
        slot = (hashed >> self.shift).astype(np.int64)
        out = self.slots[slot]
        left = np.arange(len(out))
        while left.size:
            number = out[left]
            other = number >= 0
            other &= (self.hash[number] != hashed[left]) | (self.first[number] != first[left]) | (self.second[number] != second[left]) | (self.size[number] != size[left])
            left = left[other]
            slot[left] = (slot[left] + 1) & self.mask
            out[left] = self.slots[slot[left]]
        return out

    def add(self, first: np.ndarray, second: np.ndarray, size: np.ndarray, hashed: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Take up different new pieces; their numbers."""
        n = len(first)
        number = np.arange(self.n, self.n + n, dtype=np.int32)
        self.first[number], self.second[number], self.size[number], self.hash[number] = first, second, size, hashed
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.int32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.count[number], self.at[number] = counts, self.used + np.cumsum(counts) - counts
        self.n, self.used = self.n + n, self.used + len(ids)
        slot, left = (hashed >> self.shift).astype(np.int64), np.arange(n)
        while left.size:
            free = self.slots[slot[left]] < 0
            self.slots[slot[left[free]]] = number[left[free]]
            left = left[self.slots[slot[left]] != number[left]]
            slot[left] = (slot[left] + 1) & self.mask
        return number


#: Kinds of bytes: white space, letter, digit, symbol; a word with any other byte is looked at alone.
_SPACE, _LETTER, _DIGIT, _SYMBOL, _OTHER = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[33:127] = _SYMBOL
_KIND[[32, *range(9, 14)]] = _SPACE
_KIND[ord("0") : ord("9") + 1] = _DIGIT
for _first in b"aA":
    _KIND[_first : _first + 26] = _LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class WordCodec(_Codec):
    """The lower-case vocabulary with word ends: white space separates and is dropped.

    Texts of a batch are cut into pieces together, by the kind of each byte. Words with bytes beyond ASCII and
    the letters of Latin-1 are taken one by one, but for repeated ones.
    """

    _split = regex.compile(WORD_PATTERN)

    def __init__(self, path: str):
        super().__init__(path)
        self.seen = SeenPieces()

    def pieces(self, text: str) -> list:
        if any(mark in text for mark in self.special_marks) or max(text) > _LAST_PLAIN:
            return self.library.encode(text, add_special_tokens=False).ids
        return [p.encode() for p in self._split.findall(text.lower())]

    @staticmethod
    def cut(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each piece, whether it is a word to be looked at alone, and the bytes in lower case."""
        n = len(raw)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), raw
        kind, lower = _KIND[raw], _LOWER[raw]
        head = np.flatnonzero(raw == 0xC3)  # two bytes: a letter of Latin-1, or one of its two signs
        tail = raw[head + 1]
        sign = (tail == 0x97) | (tail == 0xB7)
        lower[head[(tail < 0x9F) & ~sign] + 1] += 0x20
        kind[head] = kind[head + 1] = np.where(sign, _SYMBOL, _LETTER)
        bar = np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|")))  # a special token may begin here
        kind[bar] = _OTHER
        opens = np.zeros(n + 1, bool)
        opens[at] = True
        odd = np.flatnonzero(kind == _OTHER)
        if odd.size:
            start, end, _ = text.words(raw, at)
            whole = np.unique(np.searchsorted(start, odd, "right") - 1)
            size = end[whole] - start[whole]
            inside = np.arange(size.sum()) + np.repeat(start[whole] - (np.cumsum(size) - size), size)
            kind[inside], lower[inside] = _OTHER, raw[inside]
        begins = opens[:n] | (kind == _DIGIT)
        begins[1:] |= kind[1:] != kind[:-1]
        mark = np.flatnonzero((raw == ord("'")) & begins & (kind == _SYMBOL))  # 's 't 'm 'd 're 've 'll
        if mark.size:
            wide, kinds = np.append(lower, [0, 0, 0]), np.append(kind, [_SPACE] * 3)
            ends = np.append(opens, [True, True, True])
            ok = (kinds[mark + 1] == _LETTER) & ~ends[mark + 1]
            a, b = wide[mark + 1], wide[mark + 2]
            one = ok & np.isin(a, np.frombuffer(b"stmd", np.uint8))
            two = ok & ~ends[mark + 2] & (((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l"))))
            begins[mark[one | two] + 1] = False
            rest = np.concatenate([mark[one] + 2, mark[two] + 3])
            rest = rest[rest < n]
            begins[rest[kind[rest] == _LETTER]] = True
        start = np.flatnonzero(begins)
        end, what = np.append(start[1:], n), kind[start]
        ink = what != _SPACE
        return start[ink], end[ink], what[ink] == _OTHER, lower

    def encode_texts(self, texts: pa.Array, closing: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts back to back, each with the closing id if there is one, and where each text's begin (and the end)."""
        raw, at = text.flat(texts)
        start, end, alone, lower = self.cut(raw, at)
        owner_cuts = np.searchsorted(start, at)
        lanes = text.lanes(lower)
        ids, counts = [], []
        for lo in range(0, len(start), CACHE_PIECES):
            found, n = self._ids(lower, lanes, start[lo : lo + CACHE_PIECES], end[lo : lo + CACHE_PIECES], alone[lo : lo + CACHE_PIECES])
            ids.append(found)
            counts.append(n)
        sums = np.concatenate([[0], np.cumsum(np.concatenate([*counts, np.zeros(0, np.int64)]))]).astype(np.int64)
        token = np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.uint32)
        starts = sums[owner_cuts]
        if closing is None:
            return token, starts
        return np.insert(token, starts[1:], np.uint32(closing)), starts + np.arange(len(starts))

    def _ids(self, raw: np.ndarray, words: np.ndarray, start: np.ndarray, end: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these pieces back to back, and how many each has."""
        seen = self.seen
        if seen.n > seen.most or seen.used > CACHE_IDS:
            seen.clear()
        length = end - start
        size = (length | (alone.astype(np.int64) << 30)).astype(np.int32)
        first = words[start] & text.KEEP[np.minimum(length, 8)]
        second = np.zeros(len(start), np.uint64)
        more = np.flatnonzero(length > 8)
        second[more] = words[start[more] + 8] & text.KEEP[np.minimum(length[more] - 8, 8)]
        hashed = text._spread(text._spread(first ^ (size.astype(np.uint64) * text.MIX_2)) ^ (second * text.MIX))
        huge = length > LONG_PIECE
        live, step = np.flatnonzero((length > 16) & ~huge), 16
        while live.size:
            tail = words[start[live] + step] & text.KEEP[np.minimum(length[live] - step, 8)]
            hashed[live] = text._spread((hashed[live] ^ tail) * text.MIX + np.uint64(step))
            step += 8
            live = live[length[live] > step]
        if huge.any():  # taken each time, and never met again
            hashed[huge], size[huge] = np.flatnonzero(huge).astype(np.uint64) << np.uint64(40), -1 - np.arange(huge.sum(), dtype=np.int32)
        number = seen.find(first, second, size, hashed)
        new = np.flatnonzero((number < 0) | huge)
        while new.size:
            _, one, which = np.unique(hashed[new], return_index=True, return_inverse=True)
            one = new[one]
            same = (first[new] == first[one][which]) & (second[new] == second[one][which]) & (size[new] == size[one][which])
            found, counts = self._encode(raw, start[one], length[one], alone[one])
            numbers = seen.add(first[one], second[one], size[one], hashed[one], found, counts)
            number[new[same]] = numbers[which[same]]
            new = new[~same]
        counts = seen.count[number].astype(np.int64)
        place = np.repeat(seen.at[number] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return seen.ids[place], counts

    def _encode(self, raw: np.ndarray, start: np.ndarray, length: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different pieces back to back, and how many each has."""
        plain = np.flatnonzero(~alone)
        size = length[plain]
        inside = np.arange(size.sum()) + np.repeat(start[plain] - (np.cumsum(size) - size), size)
        flat, at, failed = self.table.encode_spans(raw[inside], size)
        self.words += len(plain)
        self.failures += failed
        odd = np.flatnonzero(alone)
        if not odd.size:
            return flat, np.diff(at)
        index: dict[bytes, int] = {}
        plan = self.plan([raw[start[i] : start[i] + length[i]].tobytes().decode("utf-8", "replace") for i in odd.tolist()], index)
        more, places, failed = self.table.encode_words(list(index))
        self.words += len(index)
        self.failures += failed
        found = []
        for p in plan:
            found.append(np.concatenate([more[places[q] : places[q + 1]] if q >= 0 else np.array([~q], np.int32) for q in ([p] if type(p) is int else p)] or [np.zeros(0, np.int32)]))
        counts = np.zeros(len(start), np.int64)
        counts[plain], counts[odd] = np.diff(at), [len(f) for f in found]
        owner = np.concatenate([np.repeat(plain, counts[plain]), np.repeat(odd, counts[odd])])
        return np.concatenate([flat, *found])[np.argsort(owner, kind="stable")], counts


@lru_cache(maxsize=4)
def byte_codec(path: str) -> ByteCodec:
    return ByteCodec(path)


def word_codec(path: str) -> WordCodec:
    """A codec for one task. It isn't kept: workers live on, and those of later stages would hold it beside their own arrays."""
    return WordCodec(path)


def give_back() -> None:
    """Return freed memory to the system: workers live on, and stages with large arrays follow each other."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def byte_ranges(texts: pa.Array, most: int = BATCH_BYTES):
    """Index ranges of an Arrow text column that hold about ``most`` bytes each, a row at least."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi
    give_back()


class _Encode:
    """mapInArrow function: one row of digests or ids for each text."""

    def __init__(self, path: str, full: bool):
        self.path, self.full = path, full

    def __call__(self, batches):
        codec = byte_codec(self.path)
        for batch in batches:
            for lo, hi in byte_ranges(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                cut = [codec.units(t or "") for t in part.column(1).to_pylist()]
                codec.fill(set().union(*cut))
                known = codec.cache.__getitem__
                if self.full:
                    ids = [[int(x) for d, _ in map(known, u) if d for x in d.split(b",")] for u in cut]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
                    continue
                counts, listed, back = [], [], []
                for units in cut:
                    parts = list(map(known, units))
                    decimal = b",".join([d for d, _ in parts])
                    counts.append(decimal.count(b",") + 1 if decimal else 0)
                    listed.append(hashlib.sha256(decimal).hexdigest())
                    text = b"".join([b for _, b in parts]).decode("utf-8", "replace")
                    back.append(hashlib.sha256(text.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(listed, pa.string()), pa.array(back, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )


class _Decode:
    def __init__(self, path: str):
        self.path = path

    def __call__(self, batches):
        codec = byte_codec(self.path)
        for batch in batches:
            texts = [codec.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the tokens of each whole text; an empty list for a null or empty text."""
    return documents(docs, "doc_id", "text").mapInArrow(_Encode(path, True), "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); special tokens keep their text, a null list gives ''."""
    return documents(tokens, "doc_id", "ids").mapInArrow(_Decode(path), "doc_id long, text string")


def encode_digest(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text: token count, SHA-256 of the ids and of the decoded text."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return documents(docs, "doc_id", "text").mapInArrow(_Encode(path, False), schema)
