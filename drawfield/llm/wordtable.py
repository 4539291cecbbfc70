"""Token ids of whole batches of texts by numpy: known words come from a table, only new ones go to the library.

Both tokenizer families used here never let a token cross the place where white space begins, so a text's
ids are those of its pieces: a run of white space with the word after it, or, where the tokenizer drops
white space, the word alone. A piece of up to 23 bytes is three 64-bit numbers (its bytes and its
length), its key in an open-addressing table kept in arrays; equality is decided on all of them, so the
ids are exactly the library's. Longer pieces are kept by their bytes. Texts with other white space than
ASCII's, or with the mark of a special token, are encoded whole by the library. At ``most`` pieces the
table starts empty again, which changes speed only.
"""

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from drawfield.llm.common import travels
from drawfield.llm.shingles import SPACE, mix

travels(__name__)

SHORT = 23
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_LOWER = np.array([b | 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Latin letters after at most one blank (or a new line), then signs of ASCII but the apostrophe: pre-tokens of their own.
_LETTERS = rb"((?:[A-Za-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF])+)"
_SIGNS = rb"([!-&(-/:-@\[-`{-~]*)"
WITH_BLANK = re.compile(rb"(\n?)( ?" + _LETTERS[1:-1] + rb")" + _SIGNS)
WITHOUT_BLANK = re.compile(rb"()" + _LETTERS + _SIGNS)
OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Byte-level models: printable Latin-1 signs stand for themselves, other bytes for the letters from U+0100 on, in order.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SHOWN = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_BLANK = chr(_SHOWN[32])
_FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class WordTable:
    """Ids by the tokenizer at ``path``. ``keep_blank``: a word's ids depend on the white space before it."""

    def __init__(self, path, keep_blank, most=1_000_000):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.keep_blank, self.most = keep_blank, most
        self.pattern = WITH_BLANK if keep_blank else WITHOUT_BLANK
        self._clear()

    def _clear(self, batch=0):
        self.slots = 1 << (2 * max(self.most, batch)).bit_length()
        self.parts = {}
        self.keys = np.zeros((self.slots, 3), np.uint64)
        self.place = np.zeros(self.slots, np.int32)  # a slot's piece
        self.long = {}
        self.first, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.flagged = np.zeros(1 << 16, bool)
        self.ids, self.held, self.pieces = np.zeros(1 << 18, np.uint16), 0, 0

    # --- pieces ---------------------------------------------------------------------------

    def _split(self, data, offsets):
        """``(starts, ends)`` of all pieces of texts that lie one after the other."""
        space = SPACE[data]
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets] = True
        before = np.empty(len(data), bool)
        before[:1], before[1:] = False, space[:-1]
        if self.keep_blank:
            start = np.flatnonzero((space & ~before) | begins[:-1])
            return start, np.append(start[1:], len(data))
        start = np.flatnonzero(~space & (before | begins[:-1]))
        after = np.append(space[1:], True)
        return start, np.flatnonzero(~space & (after | begins[1:])) + 1

    def _keys(self, data, start, size):
        """The three numbers of each piece of at most ``SHORT`` bytes; ``data`` goes on for 24 bytes after the last."""
        words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        keys = np.empty((len(start), 3), np.uint64)
        for k in range(3):
            keys[:, k] = words[start + 8 * k] & _MASK[np.clip(size - 8 * k, 0, 8)]
        keys[:, 2] |= size.astype(np.uint64) << np.uint64(56)
        return keys

    def _find(self, keys, slot):
        """For each key its slot with the piece, or the first free one, and whether it was found."""
        at, todo = slot.copy(), None
        found = np.zeros(len(keys), bool)
        while todo is None or len(todo):
            there = self.keys[at if todo is None else at[todo]]
            mine = keys if todo is None else keys[todo]
            same = (there[:, 0] == mine[:, 0]) & (there[:, 2] == mine[:, 2]) & (there[:, 1] == mine[:, 1])
            if todo is None:
                found, todo = same, np.flatnonzero(~same & (there[:, 2] != 0))
            else:
                found[todo[same]] = True
                todo = todo[~same & (there[:, 2] != 0)]
            at[todo] = (at[todo] + 1) & (self.slots - 1)
        return at, found

    def _insert(self, keys, slot, pieces):
        """New different keys, each into the first free slot."""
        todo = np.arange(len(keys))
        while len(todo):
            at, _ = self._find(keys[todo], slot[todo])
            at, winner = np.unique(at, return_index=True)
            self.keys[at], self.place[at] = keys[todo[winner]], pieces[todo[winner]]
            todo = np.delete(todo, winner)

    # --- what the library says ------------------------------------------------------------

    def _ids_of(self, raw):
        """The ids of new pieces, given as bytes, and which of them need the whole text.

        A run of letters with its blank, or of signs, is one pre-token, which the library's model takes as it is (shown as
        printable signs); most pieces are put together from such parts."""
        tokenize, parts, match = self.tokenizer.model.tokenize, self.parts, self.pattern.fullmatch

        def part(bytes_):
            shown = bytes_.decode().replace(" ", _BLANK) if bytes_.isascii() and bytes_ != b"\n" else bytes_.decode("latin-1").translate(_SHOWN)
            found = parts[bytes_] = array("H", [t.id for t in tokenize(shown)]).tobytes()
            return found

        blobs, odd, know = [], [], parts.get
        for r in raw:
            found = match(r)
            if found is None:
                odd.append(len(blobs))
                blobs.append(b"")
                continue
            line, letters, signs = found.groups()
            if not self.keep_blank and not letters.isascii():  # the tokenizer itself makes lower case
                letters = letters.decode().lower().encode()
            blob = know(letters) or part(letters)
            if signs:
                blob += know(signs) or part(signs)
            if line:
                blob = (know(line) or part(line)) + blob
            blobs.append(blob)
        texts = [raw[i].decode() for i in odd]
        flagged = np.zeros(len(raw), bool)
        for i, text, blob in zip(odd, texts, self._library(texts)):
            blobs[i] = blob
            # White space beyond ASCII beside ASCII's, and special tokens, need the whole text.
            flagged[i] = "<|" in text or OTHER_SPACE.search(text) is not None
        return blobs, flagged

    def _library(self, texts):
        return [np.array(e.ids, "<u2").tobytes() for at in range(0, len(texts), 1024)
                for e in self.tokenizer.encode_batch_fast(texts[at:at + 1024], add_special_tokens=False)]

    def _learn(self, raw):
        """Numbers of new pieces, given as bytes."""
        blobs, flagged = self._ids_of(raw)
        size = np.array([len(b) // 2 for b in blobs], np.int64)
        new = np.frombuffer(b"".join(blobs), "<u2")
        number = self.pieces + np.arange(len(blobs))
        while self.held + len(new) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        while self.pieces + len(blobs) > len(self.first):
            self.first, self.count, self.flagged = (np.append(a, np.zeros_like(a)) for a in (self.first, self.count, self.flagged))
        self.ids[self.held:self.held + len(new)] = new
        self.first[number] = self.held + np.cumsum(size) - size
        self.count[number] = size
        self.flagged[number] = flagged
        self.pieces += len(blobs)
        self.held += len(new)
        return number

    # --- batches --------------------------------------------------------------------------

    def encode(self, column):
        """``(ids, counts)`` of an Arrow column of texts: all ids one after the other (16 bits), ids per text."""
        column = pc.fill_null(column, "").cast(pa.string())
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
        size = int(offsets[-1] - offsets[0])
        data = np.zeros(size + 32, np.uint8)
        if size:
            data[:size] = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        start, end = self._split(data[:size], offsets[:-1][offsets[:-1] < size])
        if not self.keep_blank and len(start):
            # The tokenizer makes lower case itself; before it does, letters beyond Latin-1 may join with A-Z.
            edges = np.stack([start, end], axis=1).ravel()
            plain = np.maximum.reduceat(np.append(data[:size], np.uint8(255)), edges)[::2] < 0xC4
            low = np.repeat(plain, end - start)
            at = np.repeat(start - np.cumsum(end - start) + (end - start), end - start) + np.arange(len(low))
            data[at[low]] = _LOWER[data[at[low]]]
        if self.pieces > self.most or 3 * (self.pieces + len(start)) > 2 * self.slots:
            self._clear(len(start))
        number = self._numbers(data, start, end - start)
        count = self.count[number]
        before = np.append(0, np.cumsum(count, dtype=np.int64))
        at = np.repeat(self.first[number] - before[:-1], count) + np.arange(before[-1])
        ids = self.ids[at]
        piece = np.searchsorted(start, offsets)
        counts = np.diff(before[piece])
        if self.flagged[number].any():
            odd = np.unique(np.searchsorted(offsets, start[self.flagged[number]], side="right") - 1)
            parts = np.split(ids, before[piece][1:-1])
            whole = self._library(column.take(pa.array(odd)).to_pylist())
            for i, blob in zip(odd.tolist(), whole):
                parts[i] = np.frombuffer(blob, "<u2")
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, counts

    def _numbers(self, data, start, size):
        long = np.flatnonzero(size > SHORT)
        if len(long):
            number = np.empty(len(start), np.int64)
            raw = [data[s:s + n].tobytes() for s, n in zip(start[long].tolist(), size[long].tolist())]
            new = [r for r in dict.fromkeys(raw) if r not in self.long]
            if new:
                self.long.update(zip(new, self._learn(new).tolist()))
            number[long] = [self.long[r] for r in raw]
            short = np.flatnonzero(size <= SHORT)
            number[short] = self._short_numbers(data, start[short], size[short])
            return number
        return self._short_numbers(data, start, size)

    def _short_numbers(self, data, start, size):
        keys = self._keys(data, start, size)
        hashed = mix(keys[:, 0] * _FACTORS[0] + (keys[:, 1] ^ keys[:, 0] >> np.uint64(29)) * _FACTORS[1] + keys[:, 2] * _FACTORS[2])
        slot = (hashed & np.uint64(self.slots - 1)).astype(np.int64)
        at, found = self._find(keys, slot)
        number = self.place[at].astype(np.int64)
        todo = np.flatnonzero(~found)
        while len(todo):
            # One of each hash is learnt; another piece with that hash is new in the next round.
            new = todo[np.unique(hashed[todo], return_index=True)[1]]
            raw = [data[s:s + n].tobytes() for s, n in zip(start[new].tolist(), size[new].tolist())]
            self._insert(keys[new], slot[new], self._learn(raw))
            at, found = self._find(keys[todo], slot[todo])
            number[todo[found]] = self.place[at[found]]
            todo = todo[~found]
        return number


def word_table(path, keep_blank, most=1_000_000):
    """One per Python worker, kept with the library's module: workers live on from task to task."""
    import tokenizers
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    kept = vars(tokenizers).setdefault("_kept_vocabularies", {})
    if (path, keep_blank, "table") not in kept:
        kept[path, keep_blank, "table"] = WordTable(path, keep_blank, most)
    return kept[path, keep_blank, "table"]
