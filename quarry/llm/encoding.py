"""Whole texts to token ids by the tokenizers library, with a table of encoded words.

Texts are cut, in arrays over their bytes, into parts whose ids in a row are the text's ids. A part is
known by two 64-bit hashes; the table maps them to a run of ids in a pool. Parts that the table lacks
are encoded by the library, many at a call.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A part is a run of ASCII white space with what follows it, letters apart from a common mark after
#: them. For pre-tokenizers that never join letters with such marks, or a character that isn't white
#: space with white space after it, the ids of these parts in a row are the text's ids.
MARKS = b'.,!?;:#$%&*()"-'
PLAIN = re.compile(r" [A-Za-zÀ-ÖØ-öø-ÿ]+")
#: New words encoded in a row.
WORDS_A_ROW = 400
#: Bytes of a group of texts; a text is cut into more groups, between words, if it is longer.
GROUP_BYTES = 1 << 18
#: Longer parts are encoded each time. Parts and ids that the table holds at most, after which it starts anew.
PART_BYTES, PARTS, POOL_IDS = 64, 1 << 20, 1 << 23


def _flags(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_SPACE, _MARK = _flags(b" \t\n\v\f\r"), _flags(MARKS)
_LETTER = _flags(bytes(range(65, 91)) + bytes(range(97, 123)))
#: First bytes of white space or separators of other kinds; texts that hold them are encoded in one piece.
_ODD_FIRST = _flags(b"\x1c\x1d\x1e\x1f\xc2\xe1\xe2\xe3\xef")
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‏    ⁠　﻿]")
#: Odd multipliers of the two hashes.
_FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Parts:
    """Hashes of parts -> where in ``pool`` their ids are: an open-addressing table of bounded size."""

    def __init__(self, limit: int = PARTS, pool_ids: int = POOL_IDS) -> None:
        self.limit, self.pool_ids = limit, pool_ids
        self.bits = (2 * limit - 1).bit_length()
        self.clear()

    def clear(self) -> None:
        size = 1 << self.bits
        self.keys = np.zeros((size, 2), np.uint64)
        self.begin, self.size = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self.pool, self.used, self.count = np.zeros(1 << 16, np.uint32), 0, 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each row of ``h`` (two hashes); -1 if it isn't held."""
        at = (h[:, 0] >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(at), -1, np.int64)
        left = np.arange(len(at))
        while len(left):
            found = (self.keys[at] == h[left]).all(1) & (self.size[at] >= 0)
            out[left[found]] = at[found]
            go_on = ~found & (self.size[at] >= 0)
            left, at = left[go_on], (at[go_on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, h: np.ndarray, ids: list[bytes]) -> None:
        """Rows of ``h`` are distinct and not held."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin = self.append(b"".join(ids)) + np.cumsum(sizes) - sizes
        at, left = (h[:, 0] >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(h))
        while len(left):
            _, first = np.unique(at, return_index=True)
            first = first[self.size[at[first]] < 0]
            slot, row = at[first], left[first]
            self.keys[slot], self.begin[slot], self.size[slot] = h[row], begin[row], sizes[row]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)
        self.count += len(h)

    def append(self, raw: bytes) -> int:
        """Puts ids at the end of the pool; where they begin."""
        n, begin = len(raw) // 4, self.used
        if begin + n > len(self.pool):
            self.pool = np.concatenate([self.pool[:begin], np.zeros(max(n, begin), np.uint32)])
        self.pool[begin : begin + n] = np.frombuffer(raw, "<u4")
        self.used += n
        return begin

    def room(self) -> int:
        return max(0, 3 * len(self.size) // 4 - self.count)

    def full(self) -> bool:
        return self.count > self.limit or self.used > self.pool_ids


class Encoder:
    """ids of a tokenizer file, without added special tokens; a special token's string in a text is that token."""

    def __init__(self, path: str, group: int = GROUP_BYTES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.group, self.parts = group, Parts()
        self.powers = np.stack([_powers(f, group) for f in _FACTORS])
        self.inverse = np.stack([_powers(pow(f, -1, 1 << 64), group) for f in _FACTORS])
        special = [(t.content, k) for k, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word)]
        vocabulary = self.tokenizer.get_vocab()
        self.edge, self.edge_after = None, 0
        for after, is_edge in ((1, lambda t: t.endswith("</w>")), (0, lambda t: t.startswith("Ġ"))):
            edges = [k for t, k in vocabulary.items() if is_edge(t)]
            if len(edges) > len(vocabulary) // 10:
                self.edge, self.edge_after = np.zeros(max(vocabulary.values()) + 1, bool), after
                self.edge[edges] = True
                break
        self.fence, self.fence_id = max(special, key=lambda x: x[1], default=("", -1))

    def _encoded(self, parts: list[str]) -> list[bytes]:
        """The ids of each part. Plain words go in rows: their first or last tokens show where each is."""
        if self.edge is None:
            return self._fenced(parts)
        plain = [p for p in parts if PLAIN.fullmatch(p)]
        found: dict[str, bytes] = {}
        for k in range(0, len(plain), WORDS_A_ROW):
            row = plain[k : k + WORDS_A_ROW]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(row)], add_special_tokens=False)[0].ids, np.uint32)
            at = (np.flatnonzero(self.edge[ids]) + self.edge_after).tolist()
            if len(at) != len(row):
                found.update(zip(row, self._fenced(row), strict=True))
                continue
            cuts, raw = [0, *at] if self.edge_after else [*at, len(ids)], ids.astype("<u4").tobytes()
            found.update((p, raw[4 * a : 4 * b]) for p, a, b in zip(row, cuts, cuts[1:], strict=False))
        rest = [p for p in parts if p not in found]
        if rest:
            found.update(zip(rest, self._fenced(rest), strict=True))
        return [found[p] for p in parts]

    def _fenced(self, parts: list[str]) -> list[bytes]:
        """The ids of each part, by one call: a special token between parts keeps them apart."""
        whole = self.fence.join(parts)
        if not self.fence or whole.count(self.fence) != len(parts) - 1:
            return [_packed(e.ids) for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        ids = np.array(self.tokenizer.encode_batch_fast([whole], add_special_tokens=False)[0].ids, np.uint32)
        cuts, raw = [-1, *np.flatnonzero(ids == self.fence_id).tolist(), len(ids)], ids.astype("<u4").tobytes()
        return [raw[4 * a + 4 : 4 * b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _hashes(self, buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Two polynomial hashes of each part, from sums over all bytes before."""
        b = buf.astype(np.uint64) + np.uint64(1)
        out = np.empty((len(begin), 2), np.uint64)
        for k in (0, 1):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(b * self.powers[k, : len(b)])])
            h = (sums[end] - sums[begin]) * self.inverse[k][begin]
            out[:, k] = (h ^ (h >> np.uint64(32))) * np.uint64(_FACTORS[1 - k])
        return out

    def _group(self, buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts that begin at ``starts`` (ascending, the first 0) in ``buf``, and where each text's ids end."""
        begin = cuts(buf, starts)
        end = np.append(begin[1:], len(buf))
        h = self._hashes(buf, begin, end)
        if self.parts.full():
            self.parts.clear()
        table, used = self.parts, None
        slot = table.find(h)
        missing = np.flatnonzero(slot < 0)
        first, size = table.begin[slot], table.size[slot]
        if len(missing):
            long = end[missing] - begin[missing] > PART_BYTES
            _, one, back = np.unique(h[missing, 0] ^ (h[missing, 1] >> np.uint64(1)), return_index=True, return_inverse=True)
            raw = buf.tobytes()
            new = [raw[a:b].decode("utf-8") for a, b in zip(begin[missing[one]].tolist(), end[missing[one]].tolist(), strict=True)]
            ids = self._encoded(new)
            keep = np.flatnonzero(~long[one])[: table.room()]
            table.add(h[missing[one[keep]]], [ids[k] for k in keep.tolist()])
            used = table.used  # ids of parts that aren't kept lie behind it, for this group only
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            place = np.zeros(len(one), np.int64)
            place[keep] = table.begin[table.find(h[missing[one[keep]]])]
            for k in np.setdiff1d(np.arange(len(one)), keep).tolist():
                place[k] = table.append(ids[k])
            first[missing], size[missing] = place[back], sizes[back]
        upto = np.cumsum(size, dtype=np.int64)
        total = int(upto[-1]) if len(upto) else 0
        at = np.repeat(first - (upto - size), size)
        at += np.arange(total)
        ids = table.pool[at]
        if used is not None:
            table.used = used
        of_text = np.append(np.searchsorted(begin, starts[1:]), len(begin))
        return ids, np.append(0, upto)[of_text]

    def packed_arrow(self, texts: pa.Array) -> Iterator[bytes]:
        """All ids of each text (none null) as little-endian unsigned 32-bit integers."""
        texts = texts.cast(pa.large_string())
        _, offsets, data = texts.buffers()
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        n = 0
        while n < len(texts):
            if ends[n + 1] - ends[n] > self.group:
                yield self._long(data[ends[n] : ends[n + 1]])
                n += 1
                continue
            m = max(n + 1, int(np.searchsorted(ends, ends[n] + self.group, side="right")) - 1)
            yield from self._texts(data[ends[n] : ends[m]], ends[n : m + 1] - ends[n])
            n = m

    def _texts(self, buf: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
        """Texts of one group: those with odd white space whole, the others by parts."""
        odd = np.zeros(len(ends) - 1, bool)
        hit = np.flatnonzero(_ODD_FIRST[buf])
        if len(hit):
            raw = buf.tobytes()
            for k in np.unique(np.searchsorted(ends, hit, side="right") - 1).tolist():
                odd[k] = ODD_SPACE.search(raw[ends[k] : ends[k + 1]].decode("utf-8")) is not None
        sizes = np.diff(ends)
        plain = ~odd & (sizes > 0)
        if plain.any():
            kept = buf if not odd.any() else buf[np.repeat(plain, sizes)]
            starts = np.cumsum(sizes[plain]) - sizes[plain]
            ids, upto = self._group(kept, starts)
            found = ids.astype("<u4").tobytes()
            upto = [0, *(4 * upto).tolist()]
        j = 0
        for k, is_plain in enumerate(plain.tolist()):
            if is_plain:
                yield found[upto[j] : upto[j + 1]]
                j += 1
            else:
                yield self._whole(buf[ends[k] : ends[k + 1]]) if odd[k] else b""

    def _long(self, buf: np.ndarray) -> bytes:
        """A text longer than a group: in pieces that end between words, or whole where that can't be."""
        if _ODD_FIRST[buf].any() and ODD_SPACE.search(buf.tobytes().decode("utf-8")):
            return self._whole(buf)
        out, a = [], 0
        while a < len(buf):
            b = min(a + self.group, len(buf))
            if b < len(buf):
                space = _SPACE[buf[a:b]]
                ends = np.flatnonzero(space[1:] & ~space[:-1])
                if not len(ends):
                    return self._whole(buf)
                b = a + int(ends[-1]) + 1
            out.append(self._group(buf[a:b], np.zeros(1, np.int64))[0].astype("<u4").tobytes())
            a = b
        return b"".join(out)

    def _whole(self, buf: np.ndarray) -> bytes:
        return _packed(self.tokenizer.encode(buf.tobytes().decode("utf-8"), add_special_tokens=False).ids)

    def packed(self, text: str) -> bytes:
        return next(self.packed_arrow(pa.array([text])))


def cuts(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where parts begin in texts that begin at ``starts`` in ``buf`` and aren't empty."""
    n = len(buf)
    space, letter = _SPACE[buf], _LETTER[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC3)  # À to ÿ, but for two signs
    if len(lead):
        lead = lead[(buf[lead + 1] != 0x97) & (buf[lead + 1] != 0xB7)]
        letter[lead] = letter[lead + 1] = True
    flags = np.zeros(n + 1, bool)
    flags[1:n] = space[1:] & ~space[:-1]  # a word ends; what follows starts with its white space
    flags[starts] = True
    first = np.zeros(n + 1, bool)
    first[starts] = True
    # Runs of letters within a text: begin and end pair one to one.
    before = np.concatenate([[False], letter])
    after = np.append(letter, False)
    begin = np.flatnonzero(after & (~before | first))
    end = np.flatnonzero(before & (~after | first))
    leading = first[begin] | np.concatenate([[True], space])[begin]
    cut = end[leading & (end < n)]
    flags[cut[_MARK[buf[cut]]]] = True
    return np.flatnonzero(flags[:n])


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder of a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
