"""Byte-level BPE over batches of texts with numpy arrays only.

Pre-tokens are found with array comparisons of character classes, each distinct pre-token is merged once, and the
merges run rank-synchronously: in every round each sequence applies its own lowest-ranked pair, all sequences at once.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import regex

from . import rows

_LETTER, _NUMBER, _OTHER, _SPACE, _BLANK = range(5)  # _BLANK is U+0020, _SPACE any other white space
_NONE = np.iinfo(np.int32).max
_QUOTE = ord("'")


def byte_alphabet() -> dict[int, str]:
    """Byte to printable character: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def character_classes(path: str) -> np.ndarray:
    """Class of every code point, as the library sees it.

    Two Unicode versions (of `regex` and of Python) settle the points on which they agree; the library itself is asked
    for the rest, which are the characters that one of the versions does not know yet.
    """
    from tokenizers import Tokenizer

    table = np.full(0x110000, _OTHER, np.uint8)
    points = np.array([*range(0xD800), *range(0xE000, 0x110000)], np.uint32)
    every = points.astype("<u4").tobytes().decode("utf-32-le")
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            table[points[m.start() : m.end()]] = kind
    table[0x20] = _BLANK
    older = {"L": _LETTER, "N": _NUMBER}
    second = np.array([older.get(unicodedata.category(c)[0], _OTHER) for c in every], np.uint8)
    first = table[points]
    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    for p in points[(first != second) & (first < _SPACE)]:
        c = chr(p)
        table[p] = _LETTER if len(split(f"a{c}a")) == 1 else _NUMBER if len(split(f"1{c}1")) == 1 else _OTHER
    return table


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.base = np.zeros(256, np.int32)
        for b, c in byte_alphabet().items():
            self.base[b] = vocab[c]
        self.size = max(vocab.values()) + 1
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        key = left * self.size + right
        order = np.argsort(key)
        self.keys, self.ranks = key[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
        # A table with one probe for almost every key: the slot of a multiplicative hash holds the key's place.
        self._bits = 22
        slot = self._slot(self.keys)
        self._place = np.full(1 << self._bits, -1, np.int32)
        self._place[slot] = np.arange(len(slot))
        self._lost = np.flatnonzero(self._place[slot] != np.arange(len(slot)))  # keys whose slot went to another
        self._lost_keys = self.keys[self._lost]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = self._place[self._slot(key)]
        hit = self.keys[at] == key
        rank = np.where((at >= 0) & hit, self.ranks[at], _NONE)
        miss = np.flatnonzero((at >= 0) & ~hit)
        if len(miss) and len(self._lost):
            i = np.minimum(np.searchsorted(self._lost_keys, key[miss]), len(self._lost) - 1)
            ok = self._lost_keys[i] == key[miss]
            rank[miss[ok]] = self.ranks[self._lost[i[ok]]]
        return rank

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge ragged sequences (all of length 1 or more). Returns the surviving ids, flat, and their counts."""
        n = len(lengths)
        counts = np.ones(n, np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # sequence numbers, counts, flat ids
        live = np.arange(n)
        sym, length = symbols.astype(np.int32), lengths.astype(np.int64)
        rank = None
        while len(live):
            first = np.cumsum(length) - length
            last = first + length - 1
            if rank is None:
                rank = np.full(len(sym), _NONE, np.int32)
                rank[:-1] = self.pair_ranks(sym[:-1], sym[1:])
                rank[last] = _NONE
            low = np.minimum.reduceat(rank, first)
            stay = low != _NONE
            if not stay.all():
                keep = np.repeat(stay, length)
                done.append((live[~stay], length[~stay], sym[~keep]))
                live, length, low, sym, rank = live[stay], length[stay], low[stay], sym[keep], rank[keep]
                if not len(live):
                    break
            chosen = rank == np.repeat(low, length)
            at = np.flatnonzero(chosen)
            # Overlaps (a a a) can only be the same pair again: of a run of neighbours every other one is applied.
            run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            if len(run) != len(at):
                inside = np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))
                at = at[inside % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            seq = np.repeat(np.arange(len(live)), length)
            length = length - np.bincount(seq[at], minlength=len(live))
            moved = np.cumsum(keep) - 1
            at = moved[at]
            sym, rank = sym[keep], rank[keep]
            ends = np.cumsum(length) - 1
            # Only pairs that touch a new symbol have another rank now.
            new = np.unique(np.concatenate((at, at[at > 0] - 1)))
            inner = new[new < len(sym) - 1]
            rank[inner] = self.pair_ranks(sym[inner], sym[inner + 1])
            rank[ends] = _NONE
        if not done:
            return np.zeros(0, np.int32), counts[:0]
        ids = np.concatenate([d[0] for d in done])
        cnt = np.concatenate([d[1] for d in done])
        flat = np.concatenate([d[2] for d in done])
        order = np.argsort(ids, kind="stable")
        begin = (np.cumsum(cnt) - cnt)[order]
        counts[ids] = cnt
        return flat[_ragged(begin, cnt[order])], counts


def _ragged(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices begin[i] .. begin[i] + count[i] - 1, one segment after another."""
    total = int(count.sum())
    out = np.ones(total, np.int64)
    if not total:
        return out
    full = count > 0
    begin, count = begin[full], count[full]
    heads = np.cumsum(count) - count
    out[heads] = begin
    out[heads[1:]] -= begin[:-1] + count[:-1] - 1
    return np.cumsum(out)


class Encoder:
    """Encodes batches of UTF-8 texts; keeps the merged form of pre-tokens it has seen (at most `cache` of them)."""

    def __init__(self, path: str, cache: int = 400_000):
        self.vocabulary = Vocabulary(path)
        self.classes = character_classes(path)
        self.limit = cache
        self._rng = np.random.Generator(np.random.PCG64(20240607))
        self._weights = self._rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._forget()

    def _forget(self) -> None:
        self.seen = np.zeros(0, np.uint64)  # sorted
        self.seen_begin = np.zeros(0, np.int64)
        self.seen_count = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def _hash(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        most = int(length.max())
        while most > len(self._weights):
            more = self._rng.integers(0, 1 << 63, len(self._weights), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            self._weights = np.concatenate((self._weights, more))
        inside = np.arange(len(data), dtype=np.int32) - np.repeat(begin.astype(np.int32), length)
        part = (data.astype(np.uint64) + np.uint64(1)) * self._weights[inside]
        h = np.add.reduceat(part, begin)
        h ^= h >> np.uint64(29)
        return h * np.uint64(0xBF58476D1CE4E5B9)

    def pretokens(self, data: np.ndarray, text_begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte offsets at which pre-tokens begin, and which of them are special tokens (index, id pairs)."""
        raw = data.tobytes()
        points = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.flatnonzero((data & 0xC0) != 0x80)
        cls = self.classes[points]
        n = len(points)
        edge = np.zeros(n + 1, bool)
        edge[np.searchsorted(at, text_begin[text_begin < len(data)])] = True
        edge[n] = True
        specials = []
        for content, number in self.vocabulary.special.items():
            i = raw.find(content)
            while i >= 0:
                j = i + len(content)
                a, b = np.searchsorted(at, i), np.searchsorted(at, j)
                if not edge[a + 1 : b].any():
                    specials.append((i, int(a), int(b), number))
                    edge[[a, b]] = True
                    i = raw.find(content, j)
                else:
                    i = raw.find(content, i + 1)
        white = cls >= _SPACE
        kind = np.where(white, _SPACE, cls)
        before = np.empty(n, np.uint8)
        before[0], before[1:] = 255, cls[:-1]
        before[edge[:n]] = 255
        kind_before = np.where((before == _BLANK), _SPACE, before)
        after_white = np.zeros(n, bool)
        after_white[:-1] = white[1:]
        after_end = edge[1:]
        start = kind != kind_before
        start &= ~(~white & (before == _BLANK))
        start |= white & (kind_before == _SPACE) & ~after_white & ~after_end
        quote = np.flatnonzero((points == _QUOTE) & start)
        if len(quote):
            padded = np.concatenate((points, np.zeros(3, np.uint32)))
            closed = np.concatenate((edge, np.ones(3, bool)))
            one = np.isin(padded[quote + 1], np.frombuffer("stmd".encode("utf-32-le"), np.uint32)) & ~closed[quote + 1]
            two = np.zeros(len(quote), bool)
            for pair in ("re", "ve", "ll"):
                two |= (padded[quote + 1] == ord(pair[0])) & (padded[quote + 2] == ord(pair[1]))
            two &= ~closed[quote + 1] & ~closed[quote + 2]
            start[quote[one | two] + 1] = False
            for hit, step in ((one, 2), (two, 3)):
                nxt = quote[hit] + step
                start[nxt[nxt < n]] = True
        start[edge[:n]] = True
        for _, a, b, _ in specials:
            start[a + 1 : b] = False
        begin = at[start]
        number = np.full(len(begin), -1, np.int32)
        for i, _, _, value in specials:
            number[np.searchsorted(begin, i)] = value
        return begin, number

    def _lookup(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Place of each pre-token in the cache, after adding the missing ones."""
        h = self._hash(data, begin, length)
        distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.seen) + len(distinct) > self.limit:
            self._forget()
        i = np.searchsorted(self.seen, distinct)
        known = np.zeros(len(distinct), bool)
        inside = i < len(self.seen)
        known[inside] = self.seen[i[inside]] == distinct[inside]
        fresh = first[~known]
        if len(fresh):
            n = length[fresh]
            symbols = self.vocabulary.base[data[_ragged(begin[fresh], n)]]
            flat, counts = self.vocabulary.merge(symbols, n)
            at = i[~known]
            self.seen = np.insert(self.seen, at, distinct[~known])
            self.seen_begin = np.insert(self.seen_begin, at, len(self.pool) + np.cumsum(counts) - counts)
            self.seen_count = np.insert(self.seen_count, at, counts)
            self.pool = np.concatenate((self.pool, flat))
        return np.searchsorted(self.seen, distinct)[inverse]

    def encode(self, data: np.ndarray, offsets: np.ndarray, ids: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
        """data: the texts' bytes, one after another; offsets: len(texts) + 1 of them. Returns ids (or None), counts."""
        texts = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int32) if ids else None, np.zeros(texts, np.int64)
        begin, special = self.pretokens(data, offsets[:-1])
        length = np.diff(begin, append=len(data))
        place = self._lookup(data, begin, length)
        count = np.where(special >= 0, 1, self.seen_count[place])
        total = np.concatenate(([0], np.cumsum(count)))
        bound = np.searchsorted(begin, offsets)
        per_text = total[bound[1:]] - total[bound[:-1]]
        if not ids:
            return None, per_text
        flat = self.pool[_ragged(np.where(special >= 0, 0, self.seen_begin[place]), count)]
        for i in np.flatnonzero(special >= 0):
            flat[total[i]] = special[i]
        return flat, per_text


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
        rows.release()  # the vocabulary's file as read here and by the library
    return _ENCODERS[path]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
