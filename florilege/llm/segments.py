"""Ids of whole Arrow columns of text from the ids of their distinct stretches, each of which is encoded once.

An encoder says where stretches start, so that a text's ids are those of its stretches one after another, and how to encode
distinct ones (`Memory.starts_of`, `Memory.learn`). Stretches of up to `KEY_BYTES` bytes are looked up by their bytes, all of
a lot at once, in an open-addressed table of arrays: a row is three words of bytes and length, compared in full, and the
place of its ids. Unknown ones are encoded together, a lot at a time. The table holds a bounded number of stretches (`REMEMBERED`) and is
then emptied; longer stretches are encoded as they come, each distinct one of a lot once.

`Encoder` is for byte-level BPE by the tokenizers library. A stretch starts where a text does and at every white space that
follows a sign which surely is none. The pre-tokeniser never lets a token run into such a white space, nor looks past it;
where the sign before is in doubt, the stretch just goes on, which is always right. The string of an added token has no white
space, so it stands within one stretch and is the token there as anywhere.
"""

from __future__ import annotations

import os
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PROBES, KEY_BYTES = 12, 23
#: Stretches that fill a table to two thirds or so.
REMEMBERED = 1_300_000
#: Stretches to a text, and texts to a call of the library.
JOINED, CALL = 64, 128
#: Bytes of text looked up side by side, which bounds a worker's memory for texts of any length.
LOT = 1 << 19

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII signs, and first bytes of U+00C0 to U+023F, none of which is white space.
SIGN, LEAD = np.zeros(256, bool), np.zeros(256, bool)
SIGN[0x21:0x7F] = True
LEAD[0xC3:0xC9] = True
KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
ODD_1, ODD_2, ODD_3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def within(values: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of `values`, one after another."""
    ends = np.cumsum(size)
    take = np.repeat(starts - (ends - size), size)
    take += np.arange(len(take))
    return values[take]


def follows(raw: np.ndarray) -> np.ndarray:
    """Second bytes of U+00C0 to U+023F."""
    return (raw >= 0x80) & (raw < 0xC0) & LEAD[np.append(np.uint8(0), raw[:-1])]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column and where each text starts, and the last ends; a null text is empty."""
    column = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), offsets


class Memory:
    #: Where texts longer than LOT can be cut: before the second byte of what this finds.
    BREAK = re.compile(rb"[!-~][\t-\r ]")

    def __init__(self, wide: str, remembered: int | None = None) -> None:
        self.wide, self.remembered = wide, remembered or REMEMBERED
        self.slot_bits = (self.remembered * 3 // 2).bit_length()
        #: by slot: the bytes and length of a stretch, then where its ids are times 256 plus how many (0: a free slot)
        self.rows = np.zeros(((1 << self.slot_bits) + PROBES, 4), np.uint64)
        self.forget()

    def starts_of(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where stretches start in `raw`, whose texts begin at `starts` (none of them empty)."""
        raise NotImplementedError

    def learn(self, raw: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct stretches, which follow one another in `raw`: all of them, and where each one's start and how many."""
        raise NotImplementedError

    def forget(self) -> None:
        self.ids, self.held, self.kept, self.known = np.zeros(1 << 20, self.wide), 0, 0, 0
        self.rows[:, 3] = 0

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column, and where each text's end."""
        raw, offsets = buffers(texts)
        if not len(texts) or offsets[-1] == offsets[0]:
            return np.zeros(0, self.wide), np.zeros(len(texts), np.int64)
        bounds = np.unique(np.concatenate([offsets, self._breaks(raw, offsets)]))
        parts, sizes, at = [], [], 0
        while at < len(bounds) - 1:
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + LOT, "right")) - 1)
            ids, counts = self._lot(raw[bounds[at] : bounds[end]], bounds[at:end] - bounds[at])
            parts.append(ids)
            sizes.append(counts)
            at = end
        total = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        return np.concatenate(parts), total[np.searchsorted(bounds, offsets[1:])]

    def _breaks(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Places to cut texts longer than LOT, about LOT bytes apart."""
        out: list[int] = []
        for i in np.flatnonzero(np.diff(offsets) > LOT).tolist():
            text = raw[offsets[i] : offsets[i + 1]].data
            at = LOT
            while at < len(text) and (m := self.BREAK.search(text, at)):
                out.append(int(offsets[i]) + m.start() + 1)
                at = m.start() + LOT
        return np.array(out, np.int64)

    def _lot(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that begin at `starts` and are not empty, and how many each has."""
        if self.known > self.remembered:
            self.forget()
        at = self.starts_of(raw, starts)
        place, n = self._found(raw, at, np.diff(at, append=len(raw)))
        upto = np.cumsum(n)[np.append(np.searchsorted(at, starts[1:]), len(at)) - 1]
        ids = within(self.ids, place, n)
        self.held = self.kept  # what was encoded for this lot alone goes
        return ids, np.diff(upto, prepend=0)

    def _found(self, raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in `ids` those of each stretch are, and how many."""
        eight = np.ndarray((len(raw) + 24,), "<u8", np.concatenate([raw, np.zeros(32, np.uint8)]), 0, (1,))  # the 8 bytes from each place on
        keys = np.zeros((3, len(at)), np.uint64)
        keys[0] = eight[at] & KEPT[np.minimum(size, 8)]
        more = np.flatnonzero(size > 8)
        keys[1, more] = eight[at[more] + 8] & KEPT[np.minimum(size[more] - 8, 8)]
        more = more[size[more] > 16]
        keys[2, more] = eight[at[more] + 16] & KEPT[np.minimum(size[more] - 16, 7)]
        keys[2] |= np.minimum(size, 255).astype(np.uint64) << np.uint64(56)
        mixed = keys[0] * ODD_1 ^ (keys[1] + keys[2]) * ODD_2
        mixed ^= mixed >> np.uint64(31)
        mixed *= ODD_3
        slot = (mixed >> np.uint64(64 - self.slot_bits)).astype(np.int64)
        value = np.zeros(len(at), np.uint64)
        todo = np.flatnonzero(size <= KEY_BYTES)
        for probe in range(PROBES):
            row = self.rows[slot[todo] + probe]
            same = (row[:, 0] == keys[0, todo]) & (row[:, 1] == keys[1, todo]) & (row[:, 2] == keys[2, todo])
            value[todo[same]] = row[same, 3]
            todo = todo[~same & (row[:, 3] != 0)]  # a free slot ends a search
            if not len(todo):
                break
        place, n = (value >> np.uint64(8)).astype(np.int64), (value & np.uint64(255)).astype(np.int64)
        new = np.flatnonzero(value == 0)
        short, long_ = new[size[new] <= KEY_BYTES], new[size[new] > KEY_BYTES]
        if len(short):
            firsts, which = np.unique(mixed[short], return_index=True, return_inverse=True)[1:]
            if (keys[:, short[firsts[which]]] != keys[:, short]).any():  # the hash does not tell all apart
                firsts, which = np.unique(keys[:, short], axis=1, return_index=True, return_inverse=True)[1:]
            once = short[firsts]
            place_of, n_of = self._learned(within(raw, at[once], size[once]), size[once])
            self.kept = self.held
            few = np.flatnonzero(n_of < 256)
            self._remember(keys[:, once[few]], slot[once[few]], place_of[few] << 8 | n_of[few])
            place[short], n[short] = place_of[which], n_of[which]
        if len(long_):
            number: dict[bytes, int] = {}
            which = np.array([number.setdefault(raw[a : a + s].tobytes(), len(number)) for a, s in zip(at[long_].tolist(), size[long_].tolist())])
            place_of, n_of = self._learned(np.frombuffer(b"".join(number), np.uint8), np.array(list(map(len, number)), np.int64))
            place[long_], n[long_] = place_of[which], n_of[which]
        return place, n

    def _learned(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, start, n = self.learn(raw, np.cumsum(size) - size, size)
        if (need := self.held + len(ids)) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(need - len(self.ids), len(self.ids) // 2), self.wide)])
        self.ids[self.held : need] = ids
        self.held = need
        return need - len(ids) + start, n

    def _remember(self, keys: np.ndarray, slot: np.ndarray, value: np.ndarray) -> None:
        """Give each stretch the first free slot from its own on; one that finds none in PROBES is not remembered."""
        todo = np.arange(len(slot))
        for probe in range(PROBES):
            at = slot[todo] + probe
            free = np.flatnonzero(self.rows[at, 3] == 0)
            free = free[np.unique(at[free], return_index=True)[1]]
            taken = todo[free]
            self.rows[at[free]] = np.column_stack([*keys[:, taken], value[taken].astype(np.uint64)])
            self.known += len(taken)
            todo = np.delete(todo, free)
            if not len(todo):
                break


class Encoder(Memory):
    def __init__(self, file: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        size = self.tokenizer.get_vocab_size()
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        super().__init__("<u2" if size <= 1 << 16 else "<u4")

    def starts_of(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        white = np.flatnonzero(WHITE[raw])
        white = white[white > 0]
        before = raw[white - 1]
        sure = SIGN[before] | ((before >= 0x80) & (before < 0xC0) & LEAD[raw[np.maximum(white - 2, 0)]])
        found = np.zeros(len(raw), bool)
        found[white[sure]] = True
        found[starts] = True
        return np.flatnonzero(found)

    def learn(self, raw: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        odd = ~(SIGN[raw] | LEAD[raw] | follows(raw))
        odd[starts] = (raw[starts] != 32) | (size < 2)
        plain = np.add.reduceat(odd, starts, dtype=np.int64) == 0
        start, n, ids = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), np.zeros(0, self.wide)
        if plain.any():
            # a blank, then signs that are none: encoded joined, and told apart by the blank's token
            joined = within(raw, starts[plain], size[plain]).tobytes()
            cuts = [*(np.cumsum(size[plain]) - size[plain])[::JOINED].tolist(), len(joined)]
            ids = np.concatenate([np.array(x, self.wide) for x in self._ids([joined[a:b].decode() for a, b in zip(cuts, cuts[1:])])])
            first = np.flatnonzero(self.opens[ids])
            if len(first) != plain.sum():
                raise AssertionError("a stretch does not start with a blank's token")
            start[plain], n[plain] = first, np.diff(first, append=len(ids))
        single = np.flatnonzero(~plain)
        each = self._ids([raw[a : a + s].tobytes().decode("utf-8", "replace") for a, s in zip(starts[single].tolist(), size[single].tolist())])
        n[single] = list(map(len, each))
        start[single] = len(ids) + np.cumsum(n[single]) - n[single]
        return np.concatenate([ids, *(np.array(x, self.wide) for x in each)]), start, n

    def _ids(self, texts: list[str]) -> list[list[int]]:
        calls = (self.tokenizer.encode_batch_fast(texts[at : at + CALL], add_special_tokens=False) for at in range(0, len(texts), CALL))
        return [e.ids for call in calls for e in call]


@cache
def encoder(file: str) -> Encoder:
    """One a Python worker."""
    return Encoder(file)
