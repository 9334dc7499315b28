"""Token ids of whole texts with a tokenizers file, in bounded memory."""

from __future__ import annotations

import json
import re
from pathlib import Path

import numpy as np

from .common import mixed, powers, text_buffer, words_of

CACHE = 1_500_000
_LOADED: dict[tuple[str, int], "Encoder"] = {}
_RNG = np.random.default_rng(20250101)
_TABLES = _RNG.integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLES[:, 0x20] = 0
_TABLES[:, 0x0A] = 0
_BASE = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
#: First bytes of white space beyond ASCII.
_WIDE = np.zeros(256, bool)
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
#: ASCII letters and digits, and the signs that never join them (an apostrophe may).
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[x for x in range(0x21, 0x7F) if not _ALNUM[x] and x != 0x27]] = True
START, SPACE, LINE = 0, 1, 2
WINDOW = 1 << 21
#: Letters of Latin script, which every version of Unicode agrees on.
LETTERS = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
#: A space that no pattern moves: between ASCII letters or digits.
PLAIN_SPACE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
#: How byte-level vocabularies write the bytes that have no sign of their own.
BYTE_SIGNS = np.arange(256, dtype="<u4")
BYTE_SIGNS[0x7F:0xA1] = np.arange(289, 323)
BYTE_SIGNS[0xAD] = 323


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str, cache: int = CACHE) -> "Encoder":
    """One encoder for each worker process and file."""
    found = _LOADED.get((path, cache))
    if found is None:
        found = _LOADED[path, cache] = Encoder(path, cache)
    return found


class Encoder:
    """Ids of a text as the library gives them for the whole text, without special tokens added.

    A byte-level tokenizer of the usual pattern never joins a space or line feed that stands
    between two other characters to what precedes it, nor a line feed to what follows, nor a
    letter or digit to a sign behind it. So a text is cut there; pieces are looked up in a table by
    their bytes (those beyond 16 bytes by 128 bits of hash), and new ones go to the library: to its
    model where they are plain letters, else to all of it. A table of more than ``cache`` pieces
    starts anew. Texts with any other white space beside such a cut, or with an added token, go to
    the library whole; so does every text when the file holds another kind of tokenizer.

    Work goes on in windows of about ``WINDOW`` bytes, cut at spaces, so memory does not depend on
    the batch or the longest text.
    """

    #: White space beside a cut, or what libraries disagree on.
    UNEVEN = re.compile(r"[ \n]\s|\s[ \n]|[\x1c-\x1f\u180e]|^[ \n]|[ \n]$")

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        kind = json.loads(Path(path).read_text())
        before = kind.get("pre_tokenizer") or {}
        self.added = [x["content"] for x in kind.get("added_tokens", []) if x["content"]]
        self.by_piece = kind.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and kind["model"]["type"] == "BPE"
        line = self._whole("\n")
        self.by_piece = self.by_piece and len(line) == 1
        self.line = line[:1]
        self.cache = cache
        self._forget()

    def _forget(self) -> None:
        self.n, room = 0, 1 << 12
        self.low, self.high, self.tag = np.zeros(room, np.uint64), np.zeros(room, np.uint64), np.zeros(room, np.uint8)
        self.at, self.size = np.zeros(room, np.int32), np.zeros(room, np.int32)
        self.flat, self.n_flat = np.zeros(room, np.uint32), 0
        self.slots = np.full(4 * room, -1, np.int32)

    def _add(self, low: np.ndarray, high: np.ndarray, tag: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        """New pieces, distinct and not in the table."""
        first, self.n = self.n, self.n + len(low)
        while self.n > len(self.low):
            for name in ("low", "high", "tag", "at", "size"):
                own = getattr(self, name)
                setattr(self, name, np.concatenate((own, np.zeros(len(own), own.dtype))))
        for name, new in (("low", low), ("high", high), ("tag", tag), ("at", at), ("size", size)):
            getattr(self, name)[first : self.n] = new
        if 2 * self.n > len(self.slots):
            self.slots = np.full(4 * len(self.low), -1, np.int32)
            first = 0
        left = np.arange(first, self.n, dtype=np.int32)
        slot = self._slot(self.low[first : self.n], self.high[first : self.n], self.tag[first : self.n])
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            out = self.slots[slot] != left
            left, slot = left[out], (slot[out] + 1) % len(self.slots)

    def _slot(self, low: np.ndarray, high: np.ndarray, tag: np.ndarray) -> np.ndarray:
        h = mixed(low * np.uint64(_BASE) + (high ^ tag) * np.uint64(0xC2B2AE3D27D4EB4F) + tag)
        return (h & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray, tag: np.ndarray) -> np.ndarray:
        """The row of each piece in the table, or -1."""
        slot = self._slot(low, high, tag)
        found = self.slots[slot]
        ask = np.flatnonzero((found >= 0) & ((self.low[found] != low) | (self.high[found] != high) | (self.tag[found] != tag)))
        while len(ask):
            slot[ask] = (slot[ask] + 1) % len(self.slots)
            own = self.slots[slot[ask]]
            found[ask] = own
            ask = ask[(own >= 0) & ((self.low[own] != low[ask]) | (self.high[own] != high[ask]) | (self.tag[own] != tag[ask]))]
        return found

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _text(self, text: str) -> np.ndarray:
        """Ids of a text by the library alone; a long one goes in parts, cut at plain spaces."""
        if not self.by_piece or len(text) <= WINDOW // 4:
            return self._whole(text)
        parts, begin = [], 0
        while len(text) - begin > WINDOW // 4 and (found := PLAIN_SPACE.search(text, begin + WINDOW // 4)):
            parts.append(self._whole(text[begin : found.start()]))
            begin = found.start()
        return np.concatenate([*parts, self._whole(text[begin:])])

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        import pyarrow as pa

        ids, ends = self.encode_column(pa.array(texts, pa.large_string()))
        raw, ends = ids.astype("<u4").tobytes(), (4 * ends).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def encode_column(self, column) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow text column, and where those of each row end."""
        parts, ends, done = [], [np.zeros(1, np.int64)], 0
        data, offsets = text_buffer(column)
        lo = 0
        while lo < len(offsets) - 1:  # rows of one window, or one longer row
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + WINDOW, "right")) - 1)
            ids, own = self._rows(column.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            parts.append(ids)
            ends.append(own + done)
            done += len(ids)
            lo = hi
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.concatenate(ends)[1:]

    def _rows(self, column, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow as pa

        if len(offsets) == 2 and len(data) > WINDOW:
            return self._long(column, data)
        odd = self._odd(column, data, offsets)
        if not odd.any():
            return self._even(data, offsets)
        ids, ends = self._even(*text_buffer(column.filter(pa.array(~odd))))
        parts, begin, k = [], 0, 0
        for i, whole in enumerate(odd.tolist()):
            if whole:
                parts.append(self._text(column[i].as_py()))
            else:
                parts.append(ids[begin : ends[k]])
                begin, k = ends[k], k + 1
        return np.concatenate(parts), np.cumsum([len(p) for p in parts])

    def _long(self, column, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A text beyond a window, cut before spaces that stand between ASCII letters or digits."""
        if not self.by_piece:
            ids = self._whole(column[0].as_py())
            return ids, np.array([len(ids)])
        import pyarrow as pa

        parts, begin = [], 0
        while begin < len(data):
            end = len(data)
            for at in range(begin + WINDOW // 2, len(data), WINDOW // 2):
                near = data[at - 1 : at + WINDOW // 2 + 1]
                cuts = np.flatnonzero((near[1:-1] == 0x20) & _ALNUM[near[:-2]] & _ALNUM[near[2:]]) if len(near) > 2 else []
                if len(cuts):
                    end = at + int(cuts[0])
                    break
            part = data[begin:end]
            if begin:  # with the letter before the space, whose ids are known and dropped
                lead = data[begin - 1 : begin]
                text = pa.array([np.concatenate((lead, part)).tobytes().decode()], pa.large_string())
                skip = len(self._whole(lead.tobytes().decode()))
            else:
                text, skip = pa.array([part.tobytes().decode()], pa.large_string()), 0
            own, bounds = text_buffer(text)
            ids = self._text(text[0].as_py()) if self._odd(text, own, bounds)[0] else self._even(own, bounds)[0]
            parts.append(ids[skip:])
            begin = end
        ids = np.concatenate(parts)
        return ids, np.array([len(ids)])

    def _odd(self, column, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows that can't be cut."""
        n = len(offsets) - 1
        odd = np.zeros(n, bool)
        full = np.flatnonzero(np.diff(offsets))
        if not self.by_piece:
            odd[full] = True
            return odd
        if not len(data):
            return odd
        cut = (data == 0x20) | (data == 0x0A)
        blank = _BLANK[data]
        bad = np.zeros(len(data), bool)
        bad[1:] = (cut[1:] & blank[:-1]) | (blank[1:] & cut[:-1])
        bad |= (data >= 0x1C) & (data <= 0x1F)
        bad[offsets[:-1][full]] |= cut[offsets[:-1][full]]
        bad[offsets[1:][full] - 1] |= cut[offsets[1:][full] - 1]
        row = lambda at: np.searchsorted(offsets, at, "right") - 1
        odd[row(np.flatnonzero(bad))] = True
        ask = np.zeros(n, bool)  # wide white space and added tokens: look closer
        ask[row(np.flatnonzero(_WIDE[data]))] = True
        for token in self.added:
            first = token.encode()[:2]
            hits = np.flatnonzero(data[:-1] == first[0]) if len(data) > 1 else np.zeros(0, np.int64)
            ask[row(hits[data[hits + 1] == first[-1]] if len(first) > 1 else hits)] = True
        for i in np.flatnonzero(ask & ~odd):
            text = column[int(i)].as_py()
            odd[i] = self.UNEVEN.search(text) is not None or any(x in text for x in self.added)
        return odd

    def _even(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        kind = np.full(len(data), -1, np.int8)
        gaps = np.flatnonzero((data == 0x20) | (data == 0x0A))
        kind[gaps + 1] = np.where(data[gaps] == 0x20, SPACE, LINE)
        kind[np.flatnonzero(_SIGN[data[1:]] & _ALNUM[data[:-1]]) + 1] = START
        kind[offsets[:-1][np.diff(offsets) > 0]] = START
        starts = np.flatnonzero(kind >= 0)
        kind = kind[starts]
        ends = np.append(starts[1:] - (kind[1:] != START), len(data))
        low, high, tag = _names(data, starts, ends, kind)
        found = self._find(low, high, tag)
        new = np.flatnonzero(found < 0)
        if len(new):
            one = new[_distinct(low[new], high[new], tag[new])]
            at, size = self._learn(kind[one], data, starts[one], ends[one])
            self._add(low[one], high[one], tag[one], at, size)
            found[new] = self._find(low[new], high[new], tag[new])
        size, begin = self.size[found].astype(np.int64), self.at[found]
        done = np.cumsum(size)
        ids = self.flat[np.repeat(begin - (done - size), size) + np.arange(int(done[-1]))]
        if self.n > self.cache:
            self._forget()
        pieces = np.searchsorted(starts, offsets[1:], "left")
        return ids, np.append(0, done)[pieces]

    def _learn(self, kind: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of new pieces begin in flat, and how many they are. What is not plain letters goes to the library a piece a line, for a line feed is a token of its own there."""
        parts, sizes, order = [], [], []
        size = ends - starts
        bounds = np.cumsum(size + 1)
        flat = np.full(int(bounds[-1]), 0x0A, np.uint8)  # a piece a line
        inside = np.ones(len(flat), bool)
        inside[bounds - 1] = False
        flat[inside] = data[np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        texts = flat[:-1].tobytes().decode().split("\n")
        lines = np.append(0, bounds[:-1])
        letter = _ALNUM[flat] & (flat >= 0x41)
        letter[bounds - 1] = True
        plain = np.logical_and.reduceat(letter, lines) & (size > 0)
        for i in np.flatnonzero(~plain & np.logical_and.reduceat(letter | (flat >= 0x80), lines) & (size > 0)).tolist():
            plain[i] = LETTERS.fullmatch(texts[i]) is not None
        own = np.flatnonzero(plain)
        if len(own):
            flat = BYTE_SIGNS[flat[:-1]].tobytes().decode("utf-32-le").split("\n")
            ask = self.library.model.tokenize
            found = [ask("\u0120" + flat[i] if s else flat[i]) for i, s in zip(own.tolist(), (kind[own] == SPACE).tolist(), strict=True)]
            parts.append(np.array([x.id for one in found for x in one], np.uint32))
            sizes.append(np.array([len(one) for one in found]))
            order.append(own)
        for one, before in ((SPACE, " "), (START, ""), (LINE, "")):
            own = np.flatnonzero((kind == one) & ~plain)
            for lo in range(0, len(own), 20_000):
                part = own[lo : lo + 20_000]
                ids = self._whole(before + ("\n" + before).join([texts[i] for i in part]))
                cuts = np.flatnonzero(ids == self.line[0])
                if len(cuts) == len(part) - 1:
                    size = np.diff(np.concatenate(([-1], cuts, [len(ids)]))) - 1
                    ids = np.delete(ids, cuts)
                else:
                    each = [self._whole(before + texts[i]) for i in part]
                    size, ids = np.array([len(x) for x in each]), np.concatenate(each)
                parts.append(ids)
                sizes.append(size)
                order.append(part)
        feeds = np.flatnonzero(kind[np.concatenate(order)] == LINE)
        if len(feeds):  # a line feed in front
            size, ids = np.concatenate(sizes), np.concatenate(parts)
            ids = np.insert(ids, (np.cumsum(size) - size)[feeds], self.line[0])
            size[feeds] += 1
            parts, sizes = [ids], [size]
        size, order, ids = np.concatenate(sizes), np.concatenate(order), np.concatenate(parts)
        while self.n_flat + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(len(self.flat), np.uint32)))
        self.flat[self.n_flat : self.n_flat + len(ids)] = ids
        at, sizes = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        at[order], sizes[order] = self.n_flat + np.cumsum(size) - size, size
        self.n_flat += len(ids)
        return at, sizes


class WordEncoder(Encoder):
    """Ids of a text by a tokenizer that drops white space: nothing joins across a space or line feed.

    Texts are cut there, and each different piece goes to the library once. Texts that hold an
    added token go to the library whole, and so does every text when the file is of another kind.
    """

    def __init__(self, path: str, cache: int = CACHE):
        super().__init__(path, cache)
        kind = json.loads(Path(path).read_text())
        steps = (kind.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        forms = [x["type"] for x in (kind.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = steps[0].get("behavior") == "Removed" and bool(steps[0].get("invert")) and set(forms) <= {"NFC", "Replace", "Lowercase"} and not len(self._whole(" \n"))

    def _odd(self, column, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if not self.by_word:
            return np.diff(offsets) > 0
        odd = np.zeros(n, bool)
        for token in self.added:
            odd |= np.array([token in (x or "") for x in column.to_pylist()]) if self._holds(data, token.encode()) else False
        return odd

    @staticmethod
    def _holds(data: np.ndarray, token: bytes) -> bool:
        return token in memoryview(data).tobytes()

    def _long(self, column, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_word or self._odd(column, data, np.array([0, len(data)]))[0]:
            ids = self._whole(column[0].as_py())
            return ids, np.array([len(ids)])
        cuts, parts, begin = np.flatnonzero(CUTS[data]), [], 0
        while begin < len(data):
            k = int(np.searchsorted(cuts, begin + WINDOW))
            end = int(cuts[k]) if k < len(cuts) else len(data)
            parts.append(self._even(data[begin:end], np.array([0, end - begin]))[0])
            begin = end + (k < len(cuts))
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        return ids, np.array([len(ids)])

    def _even(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, first = words_of(data, offsets, CUTS)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        low, high, tag = _names(data, starts, ends, np.zeros(len(starts), np.int64))
        found = self._find(low, high, tag)
        new = np.flatnonzero(found < 0)
        if len(new):
            one = new[_distinct(low[new], high[new], tag[new])]
            at, size = self._ask(data, starts[one], ends[one])
            self._add(low[one], high[one], tag[one], at, size)
            found[new] = self._find(low[new], high[new], tag[new])
        size, begin = self.size[found].astype(np.int64), self.at[found]
        done = np.cumsum(size)
        ids = self.flat[np.repeat(begin - (done - size), size) + np.arange(int(done[-1]))]
        if self.n > self.cache:
            self._forget()
        return ids, np.append(0, done)[first[1:]]

    def _ask(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of new pieces begin in flat, and how many they are."""
        texts = [data[a:b].tobytes().decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        ids = [x.ids for lo in range(0, len(texts), 20_000) for x in self.library.encode_batch_fast(texts[lo : lo + 20_000], add_special_tokens=False)]
        size = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))
        while self.n_flat + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(len(self.flat), np.uint32)))
        self.flat[self.n_flat : self.n_flat + len(flat)] = flat
        at = self.n_flat + np.cumsum(size) - size
        self.n_flat += len(flat)
        return at, size


def word_encoder(path: str, cache: int = CACHE) -> "WordEncoder":
    """One encoder for each worker process and file."""
    found = _BY_WORD.get((path, cache))
    if found is None:
        found = _BY_WORD[path, cache] = WordEncoder(path, cache)
    return found


_BY_WORD: dict[tuple[str, int], WordEncoder] = {}
#: Where a WordEncoder cuts: at spaces and line feeds.
CUTS = np.zeros(256, bool)
CUTS[[0x20, 0x0A]] = True
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What tells a piece: its first and next eight bytes, or two hashes of a longer one, and kind and length."""
    padded = np.concatenate((data, np.zeros(24, np.uint8)))
    eight = np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))  # at every byte
    size = ends - starts
    low = eight[starts] & _MASK[np.minimum(size, 8)]
    high = eight[np.minimum(starts + 8, len(data))] & _MASK[np.clip(size - 8, 0, 8)]
    for i in np.array_split(np.flatnonzero(size > 16), max(1, int((size > 16).sum()) // 100_000)):
        if len(i):
            done = np.cumsum(size[i])
            at = np.arange(int(done[-1])) - np.repeat(done - size[i], size[i])
            own = data[np.repeat(starts[i], size[i]) + at]
            weight = powers(_BASE, int(size[i].max()))[at]
            low[i], high[i] = (mixed(np.add.reduceat(table[own] * weight, done - size[i])) for table in _TABLES)
    return low, high, (kind * 32 + np.minimum(size, 17)).astype(np.uint8)


def _distinct(low: np.ndarray, high: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """Rows with each combination once."""
    order = np.lexsort((tag, high, low))
    a, b, c = low[order], high[order], tag[order]
    return order[np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1]))]
