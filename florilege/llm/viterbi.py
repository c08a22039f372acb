"""SentencePiece encoding and decoding by a streaming Viterbi search.

The lattice has a node at every character boundary and an arc for every piece that ends there, reaching back at most the
longest piece. For a unigram model the best arc has the largest sum of scores. For a BPE model a path is the model's
own encoding exactly if every two neighbours are what merging their joint text yields, and every boundary has exactly
one arc that keeps this; such arcs score 0 and all others minus infinity. A character that no piece has is an arc of its
own and becomes its UTF-8 bytes' pieces.

The search is a stream: it takes text in parts, keeps the boundaries of the last `longest` characters and what hangs on
them, and commits ids up to the boundary on which all surviving backpointer paths converge. In natural text that happens
every few characters, so a text of any length is encoded in bounded memory. What the search has committed for a unit of
text that no piece can leave (a blank-led word) holds wherever the unit stands, and is remembered (`segments.Memory`). A lot's
new units go through one search, one after another; a unit of any length goes through it as it comes.

Normalisation is the identity with a blank put in front; blanks are U+2581. Decoding gives the text back exactly, but
that a U+2581 in a text returns as a blank. Defined results: a null or empty text has no ids; null and repeated doc_ids
give a row each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import LEAD, Memory, buffers, follows, within
from .shared import lean_batches, tidy

#: U+2581 in the model; a plain blank here, so that units stay short in memory.
MARK, BLANK = "▁", " "
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Units and pairs of pieces that a worker remembers.
REMEMBERED, PAIRS_REMEMBERED = 650_000, 350_000
#: Lengths to try where no longer piece may end.
SHORT = (2, 1)
#: Score of a character without a piece in a unigram model.
LOST = -1e6
#: Units handed to the search at a time.
PART = 1024
#: Letters of one byte.
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


class Model:
    def __init__(self, file: str, kind: str = "bpe") -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=file)
        n = sp.vocab_size()
        special = lambda i: sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)
        self.kind, self.bytes = kind, {}
        self.text = [sp.id_to_piece(i).replace(MARK, BLANK) for i in range(n)]
        self.score = [sp.get_score(i) for i in range(n)]
        self.id = {self.text[i]: i for i in range(n) if not special(i)}
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = sp.unk_id()
        hidden = {i for i in range(n) if sp.is_control(i)}
        self.wide = np.uint16 if n <= 1 << 16 else np.int32
        #: what each id puts into a text
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in hidden else " ⁇ ".encode() if i == self.unknown else t.encode() for i, t in enumerate(self.text)]
        self.longest = max(map(len, self.id))
        tails: dict[str, set[int]] = {}
        for p in self.id:
            if len(p) > 2:
                tails.setdefault(p[-3:], {n for n in (1, 2) if p[-n:] in self.id}).add(len(p))
        #: by last three characters: the lengths of the pieces that may end there, longest first
        self.lengths = {t: tuple(sorted(k, reverse=True)) for t, k in tails.items()}
        self.pairs: dict[int, bool] = {}
        #: whether no piece goes on over a blank after another sign, nor over the end of letters
        self.apart = not any(BLANK in p.lstrip(BLANK) for p in self.id)
        self.split = not any(re.search(f"[{LETTERS}][^{LETTERS}{BLANK}]", p) for p in self.id)

    def merged(self, text: str) -> list[str]:
        """BPE by definition: the best-scored neighbours first, leftmost of equals."""
        parts, ids, score = list(text), self.id, self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or score[k] > best):
                    best, at = score[k], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, a: int, b: int) -> bool:
        """Whether a, b is the encoding of their joint text; -1 is a character without a piece."""
        if a < 0 or b < 0:
            return True
        ok = self.pairs.get(a << 32 | b)
        if ok is None:
            if len(self.pairs) >= PAIRS_REMEMBERED:
                self.pairs.clear()
            ok = self.pairs[a << 32 | b] = self.merged(self.text[a] + self.text[b]) == [self.text[a], self.text[b]]
        return ok


class StreamingViterbi:
    """`push` text, get ids that are certain; `finish` gives the rest."""

    def __init__(self, model: Model) -> None:
        self.m = model
        self.window = ""  # text since the last committed boundary, and `longest` characters before it at most
        self.base = 0  # boundaries before window
        self.node: list[tuple[float, int, int]] = [(0.0, -1, -2)]  # by boundary in the window: score, boundary before, piece
        self.done = 0  # committed boundary, in the window
        self.ends: list[int] = []  # by id: the boundary after its character or piece, in the whole stream
        self.peak = 0

    def push(self, text: str) -> list[int]:
        out: list[int] = []
        m, step = self.m, 4 * self.m.longest
        grow = self._grow_bpe if m.kind == "bpe" else self._grow_scored
        for at in range(0, len(text), step):
            grow(text[at : at + step])
            self.peak = max(self.peak, len(self.window))
            if len(self.window) <= step:
                continue
            out += self._commit(self._converged())
            if self.done > m.longest:  # forget what no arc can reach
                cut = self.done - m.longest
                self.base += cut
                self.window = self.window[cut:]
                self.node = [(n[0], n[1] - cut, n[2]) for n in self.node[cut:]]
                self.done -= cut
        return out

    def finish(self) -> list[int]:
        return self._commit(len(self.window))

    def _grow_bpe(self, text: str) -> None:
        """Give each new boundary the one arc that keeps the path the model's own encoding."""
        m, node, done = self.m, self.node, self.done
        lengths, ids, pairs, fits = m.lengths, m.id, m.pairs, m.fits
        end = len(self.window)
        window = self.window = self.window + text
        while end < len(window):
            end += 1
            for n in lengths.get(window[end - 3 : end], SHORT) if end > 2 else SHORT:
                start = end - n
                if start < done:
                    continue
                piece = ids.get(window[start:end])
                if piece is None:
                    continue
                last = node[start][2]
                if last < 0 or (pairs.get(last << 32 | piece) or (last << 32 | piece not in pairs and fits(last, piece))):
                    node.append((0.0, start, piece))
                    break
            else:
                node.append((0.0, end - 1, -1))  # a character without a piece

    def _grow_scored(self, text: str) -> None:
        """Give each new boundary the arc of the largest sum of scores."""
        m, node = self.m, self.node
        end = len(self.window)
        window = self.window = self.window + text
        while end < len(window):
            end += 1
            best = (node[end - 1][0] + LOST, end - 1, -1)
            for n in m.lengths.get(window[end - 3 : end], SHORT) if end > 2 else SHORT:
                start = end - n
                if start >= self.done and (piece := m.id.get(window[start:end])) is not None and (total := node[start][0] + m.score[piece]) > best[0]:
                    best = (total, start, piece)
            node.append(best)

    def _converged(self) -> int:
        """The last boundary that every path through the reachable window shares."""
        end = len(self.window)
        alive = set(range(max(self.done, end - self.m.longest + 1), end + 1))
        while len(alive) > 1:
            i = max(alive)
            alive.discard(i)
            alive.add(self.node[i][1])
        return max(alive.pop(), self.done)

    def _commit(self, upto: int) -> list[int]:
        path, i = [], upto
        while i > self.done:
            _, before, piece = self.node[i]
            path.append((piece, i))
            i = before
        out, before_all = [], len(self.ends)
        for piece, i in reversed(path):
            if piece >= 0:
                out.append(piece)
            else:
                raw = self.window[i - 1 : i].encode("utf-8", "replace")
                out += [self.m.bytes.get(b, self.m.unknown) for b in raw] if self.m.bytes else [self.m.unknown]
            self.ends += [self.base + i] * (len(out) - (len(self.ends) - before_all))
        self.done = max(upto, self.done)
        return out


class Codec(Memory):
    """Encoding of columns by the search, with its results for units remembered, and decoding."""

    #: Where texts can be cut: no piece goes on over a blank that stands after another sign.
    BREAK = re.compile(rb"[^ ] ")

    def __init__(self, file: str, kind: str = "bpe") -> None:
        self.m = Model(file, kind)
        self.code = "H" if self.m.wide is np.uint16 else "i"
        lengths = np.array([len(r) for r in self.m.raw], np.int64)
        self.raw, self.raw_size, self.raw_start = np.frombuffer(b"".join(self.m.raw), np.uint8), lengths, np.cumsum(lengths) - lengths
        super().__init__("<u2" if self.code == "H" else "<i4", REMEMBERED)

    def starts_of(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Units: blanks, other signs, letters. A new one starts with the blank after another sign and, where no piece has
        a letter before another sign, with any sign after a letter."""
        found = np.zeros(len(raw), bool)
        if self.m.apart:
            blank = raw == 32
            found[1:] = blank[1:] & ~blank[:-1]
        if self.m.apart and self.m.split:
            letter = LETTER[raw]
            second = follows(raw)
            second[1:] &= ~((raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7)))  # signs among the letters
            found[1:] |= (letter | second)[:-1] & ~letter[1:] & ~LEAD[raw[1:]] & ((raw[1:] < 0x80) | (raw[1:] >= 0xC0)) & (raw[1:] != 0xC9)
        found[starts] = True
        return np.flatnonzero(found)

    def learn(self, raw: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Units that a blank leads go through one search, one after another; each other one through its own."""
        led = (raw[starts] == 32) & (raw[starts + size - 1] != 32) & self.m.apart
        out, n = array(self.code), np.zeros(len(starts), np.int64)
        order = np.concatenate([np.flatnonzero(led), np.flatnonzero(~led)])
        units = [raw[a : a + k].tobytes().decode("utf-8", "replace") for a, k in zip(starts[order].tolist(), size[order].tolist())]
        n_led = int(led.sum())
        if n_led:
            search = StreamingViterbi(self.m)
            for at in range(0, n_led, PART):
                out.extend(search.push("".join(units[at : min(at + PART, n_led)])))
            out.extend(search.finish())
            borders = np.cumsum(list(map(len, units[:n_led])))
            n[order[:n_led]] = np.diff(np.searchsorted(search.ends, borders, "right"), prepend=0)
        for i, unit in zip(order[n_led:].tolist(), units[n_led:]):
            search = StreamingViterbi(self.m)
            ids = search.push(unit) + search.finish()
            out.extend(ids)
            n[i] = len(ids)
        start = np.zeros(len(starts), np.int64)
        start[order] = np.cumsum(n[order]) - n[order]
        return np.frombuffer(out, self.wide) if len(out) else np.zeros(0, self.wide), start, n

    def marked(self, texts: pa.Array) -> pa.Array:
        """Texts as the model has them: a blank in front of each that is not empty, blanks for U+2581."""
        plain = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), MARK, BLANK)
        led = pc.binary_join_element_wise(pa.scalar(BLANK, pa.large_string()), plain, pa.scalar("", pa.large_string()))
        return pc.if_else(pc.equal(pc.binary_length(plain), 0), plain, led)

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of a column, where each text's end, and whether decoding them gives the text back."""
        column = self.marked(texts)
        ids, ends = self.encode(column)
        size = np.diff(np.concatenate([[0], np.cumsum(self.raw_size[ids])])[ends], prepend=0)
        raw, offsets = buffers(column)
        exact = size == np.diff(offsets)
        back, begins = within(self.raw, self.raw_start[ids], self.raw_size[ids]), np.cumsum(size) - size
        raw = raw[offsets[0] : offsets[-1]]
        if not exact.all() or not np.array_equal(back, raw):
            for i in np.flatnonzero(exact).tolist():
                exact[i] = np.array_equal(back[begins[i] : begins[i] + size[i]], raw[offsets[i] - offsets[0] : offsets[i + 1] - offsets[0]])
        return ids, ends, exact

    def encode_texts(self, texts: list[str | None]) -> list[list[int]]:
        ids, ends, _ = self.encode_column(pa.array(texts, pa.string()))
        return [x.tolist() for x in np.split(ids, ends[:-1])] if len(ends) else []

    def decode(self, ids) -> str:
        text = b"".join(map(self.m.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@cache
def codec(file: str, kind: str = "bpe") -> Codec:
    return Codec(file, kind)


def encode(docs: DataFrame, file: str | None = None, kind: str = "bpe") -> DataFrame:
    """doc_id, n_ids, ids, exact: the ids of every text, and whether decoding them gave the text back."""
    file = file or public_tokenizers.path("piece_bpe_32k.model")
    lean_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(file, kind)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                ids, ends, exact = c.encode_column(part.column(1))
                ends = np.append(0, ends)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ends)), lists, pa.array(exact)], ["doc_id", "n_ids", "ids", "exact"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), f"doc_id {dict(rows.dtypes)['doc_id']}, n_ids long, ids array<int>, exact boolean")


def decode(rows: DataFrame, file: str | None = None, kind: str = "bpe") -> DataFrame:
    """doc_id, text from doc_id, ids."""
    file = file or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(file, kind)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x or ()) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    rows = rows.select("doc_id", "ids")
    return rows.mapInArrow(tidy(run), f"doc_id {dict(rows.dtypes)['doc_id']}, text string")
