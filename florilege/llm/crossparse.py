"""Language identification by cross-parsing: the language whose labelled text explains a text in fewest phrases.

For every language a suffix automaton is built over a bounded sample of its labelled text. A text is parsed greedily
into the longest matches that occur in the sample; a phrase ends at the first letter that does not continue one. The
number of phrases over the number of letters read is the cross-parsing entropy; the smallest wins, ties by code point.

The automata are tables of next states (one row a state, one column a letter; where a sample has more than `COLUMNS`
letters, the steps by its rarer ones are a sorted list instead), so the texts of an Arrow batch are parsed
side by side: each is cut into lanes of `LANE` letters and all lanes advance together, one array step a letter. A lane
first supposes that a phrase starts with it. Then the phrase of the lane before is carried on into it, until a phrase of
both starts at one letter, from where on they agree. What is counted is thus the parse of the whole text, whatever the
lanes' length. All letters of a text are read; none decides alone.

Training is bounded: per language the `sample_docs` labelled documents of smallest hash, cut at `sample_letters` letters
over all languages. The window that picks them keeps that many rows per language and task before its shuffle. Only
text and label are learned from; a prediction sees only the text.

Defined results: null texts and texts without a letter are `und` with score 0, as is every text if nothing was learned;
an empty label is a label like any other; null doc_ids are held out of training; repeated rows give a row each; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import lean_batches, tidy

LANE = 512
SAMPLE_DOCS, SAMPLE_LETTERS = 200, 240_000
#: Columns of a language's table: its most frequent letters, and a last one for all that its sample does not have.
COLUMNS = 64
#: Letters by their Unicode category: number signs such as `½` or `②` are word characters, but no letters.
LETTER = regex.compile(r"\p{L}+")


def spoken(text: str) -> str:
    """The words of a text in lower case, each after one blank; nothing but letters."""
    words = LETTER.findall(text.lower())
    return " " + " ".join(words) + " " if words else ""


def alphabet(samples: dict[str, str]) -> dict[str, int]:
    """Every letter of any sample, numbered."""
    return {c: i for i, c in enumerate(sorted(set().union(*samples.values())))}


def suffix_automaton(code: list[int]) -> list[dict[int, int]]:
    """Next states by letter, a dictionary a state."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in code:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Steps:
    """An automaton as arrays. A step gives the next state; where no match goes on, that after a new phrase's letter, less 2 ** 31."""

    def __init__(self, code: np.ndarray, n_letters: int) -> None:
        counts = np.bincount(code, minlength=n_letters + 1)
        common = np.argsort(-counts, kind="stable")[: COLUMNS - 1]
        common = common[counts[common] > 0]
        self.width = len(common) + 1
        self.column = np.full(n_letters + 1, len(common), np.int32)
        self.column[common] = np.arange(len(common))
        #: Numbers of the letters that the sample has and that own no column, from 0; -1 for all others.
        self.rare = np.full(n_letters + 1, -1, np.int32)
        rest = np.flatnonzero((counts > 0) & (self.column == len(common)))
        self.rare[rest] = np.arange(len(rest))
        self.n_rare = len(rest)
        nxt = suffix_automaton(code.tolist())
        state = np.repeat(np.arange(len(nxt)), [len(row) for row in nxt])
        letter = np.fromiter((c for row in nxt for c in row), np.int64, len(state))
        to = np.fromiter((t for row in nxt for t in row.values()), np.int32, len(state))
        own = self.column[letter] < len(common)
        table = np.full((len(nxt), self.width), -1, np.int32)
        table[state[own], self.column[letter[own]]] = to[own]
        again = np.where(table[0] >= 0, table[0], 0).astype(np.int64) - (1 << 31)
        self.table = np.where(table >= 0, table, again[None, :]).astype(np.int32).ravel()
        keys = state[~own] * self.n_rare + self.rare[letter[~own]]
        order = np.argsort(keys)
        self.keys, self.to = keys[order], to[~own][order]

    def next(self, state: np.ndarray, column: np.ndarray, rare: np.ndarray | None) -> np.ndarray:
        to = self.table[state * self.width + column]
        if rare is not None and len(at := np.flatnonzero(rare >= 0)):
            keys = state[at].astype(np.int64) * self.n_rare + rare[at]
            found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            # the first state has a step by every letter of the sample: they are the first keys, in order
            to[at] = np.where(self.keys[found] == keys, self.to[found], self.to[rare[at]].astype(np.int64) - (1 << 31))
        return to


def labelled(doc_id: Column, lang: Column) -> Column:
    return ~held_out(doc_id) & lang.isNotNull() & doc_id.isNotNull()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_letters: int = SAMPLE_LETTERS) -> dict[str, str]:
    """lang -> text, of bounded size; the same for the same rows."""
    rows = docs.filter(labelled(F.col("doc_id"), F.col("lang")) & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    by_hash = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    few = rows.withColumn("nth", F.row_number().over(by_hash)).filter(F.col("nth") <= sample_docs)
    # so many characters of a document as any one language may give letters
    few = few.select("lang", "nth", F.substring("text", 1, sample_letters).alias("text"))
    langs = max(few.select("lang").distinct().count(), 1)
    room = sample_letters // langs
    few = few.withColumn("before", F.coalesce(F.sum(F.length("text")).over(W.partitionBy("lang").orderBy("nth").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    out: dict[str, str] = {}
    for r in few.filter(F.col("before") < 4 * room).orderBy("lang", "nth").select("lang", "text").toLocalIterator():
        if len(out.setdefault(r["lang"], "")) < room:
            out[r["lang"]] = (out[r["lang"]] + spoken(r["text"]))[:room]
    return {k: v for k, v in sorted(out.items()) if v}


class CrossParser:
    def __init__(self, samples: dict[str, str]) -> None:
        self.langs = sorted(samples)
        self.columns = alphabet(samples)
        self.other = len(self.columns)  # letters that no sample has
        self.points = np.full(0x110000, self.other, np.int32)
        self.points[[ord(c) for c in self.columns]] = list(self.columns.values())
        self.tables = [Steps(self.coded(samples[k]), self.other) for k in self.langs]

    def coded(self, text: str) -> np.ndarray:
        return self.points[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases by text and language, and letters read by text."""
        codes = [self.coded(t) for t in texts]
        letters = np.array([len(c) for c in codes], np.int64)
        lanes = -(-letters // LANE)
        total = int(lanes.sum())
        counts = np.zeros((len(texts), len(self.langs)), np.int64)
        if not total:
            return counts, letters
        owner = np.repeat(np.arange(len(texts)), lanes)
        nth = np.arange(total) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        length = np.minimum(LANE, letters[owner] - nth * LANE)
        order = np.argsort(-length, kind="stable")
        start = (np.repeat(np.cumsum(letters) - letters, lanes) + nth * LANE)[order]
        owner, length = owner[order], length[order]
        stream = np.concatenate(codes)
        alive = total - np.searchsorted(length[::-1], np.arange(1, int(length[0]) + 1))
        place = np.argsort(order)
        before = np.where(nth > 0, place[np.arange(total) - 1], -1)[order]  # the lane that each goes on from
        for k, steps in enumerate(self.tables):
            columns, rare = steps.column[stream], steps.rare[stream] if steps.n_rare else None
            fresh = np.zeros(len(stream), bool)  # letters with which a phrase starts, were each lane a text
            state, found = np.zeros(total, np.int32), np.zeros(total, np.int64)
            for step, n in enumerate(alive):
                at = start[:n] + step
                to = steps.next(state[:n], columns[at], None if rare is None else rare[at])
                fresh[at] = to < 0
                found[:n] += to < 0
                state[:n] = to & 0x7FFFFFFF
            found += self._carried(steps, columns, rare, fresh, start, length, before, state)
            counts[:, k] = np.bincount(owner, found, len(texts)).astype(np.int64) + (lanes > 0)
        return counts, letters

    def _carried(self, steps: Steps, columns: np.ndarray, rare: np.ndarray | None, fresh: np.ndarray, start: np.ndarray, length: np.ndarray, before: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many more phrases each lane starts if it goes on with the phrase of the lane before."""
        more, entered = np.zeros(len(start), np.int64), np.zeros(len(start), np.int32)
        alone, end = end, end.copy()
        while True:
            enters = np.where(before >= 0, end[before], 0)
            todo = np.flatnonzero(enters != entered)  # in the first state a lane is as if alone
            if not len(todo):
                return more
            entered = enters
            state, n = enters[todo], np.zeros(len(todo), np.int64)
            more[todo], end[todo] = 0, alone[todo]
            at, left = start[todo], length[todo]
            shortest = int(left.min())
            for step in range(LANE):
                if step >= shortest:
                    over = left <= step
                    more[todo[over]], end[todo[over]] = n[over], state[over]
                    todo, state, n, at, left = (x[~over] for x in (todo, state, n, at, left))
                    if not len(todo):
                        break
                    shortest = int(left.min())
                to = steps.next(state, columns[at], None if rare is None else rare[at])
                here, there = to < 0, fresh[at]
                n += here
                n -= there
                met = here & there if step else here
                if np.count_nonzero(met):
                    more[todo[met]] = n[met]
                    todo, n, to, at, left = (x[~met] for x in (todo, n, to, at, left))
                    if not len(todo):
                        break
                state = to & 0x7FFFFFFF
                at = at + 1
            else:
                more[todo], end[todo] = n, state

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score: the share of the winner among the inverse entropies."""
        said = [spoken(t or "") for t in texts]
        counts, letters = self.phrases(said)
        langs, scores = [], []
        for row, n in zip(counts.tolist(), letters.tolist()):
            if not n or not row:
                langs.append("und")
                scores.append(0.0)
                continue
            best = min(range(len(row)), key=lambda i: (row[i], self.langs[i]))
            langs.append(self.langs[best])
            scores.append((1 / row[best]) / sum(1 / x for x in row))
        return langs, scores


_parsers: dict[int, CrossParser] = {}


def parser_of(samples: dict[str, str]) -> CrossParser:
    """One parser a Python worker: automata are built once and serve all its tasks."""
    key = hash(tuple(sorted(samples.items())))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = CrossParser(samples)
    return _parsers[key]


#: Characters parsed side by side, which bounds a worker's memory.
BATCH_CHARS = 2_000_000


def lots(batch: pa.RecordBatch, text_column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about BATCH_CHARS characters each."""
    at = size = 0
    for i, n in enumerate(pc.fill_null(pc.utf8_length(batch.column(text_column)), 0).to_pylist(), 1):
        size += n
        if size >= BATCH_CHARS or i == batch.num_rows:
            yield batch.slice(at, i - at)
            at, size = i, 0


def identify(docs: DataFrame, samples: dict[str, str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    lean_batches(docs.sparkSession)
    samples = training_samples(docs) if samples is None else samples
    shared = docs.sparkSession.sparkContext.broadcast(samples)  # at most SAMPLE_LETTERS letters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = parser_of(shared.value)
        for b in batches:
            for part in lots(b, 2):
                langs, scores = parser.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, samples: dict[str, str] | None = None) -> DataFrame:
    """The documents, with all their columns, whose language is told; `und` goes. Nothing is shuffled."""
    lean_batches(docs.sparkSession)
    samples = training_samples(docs) if samples is None else samples
    shared = docs.sparkSession.sparkContext.broadcast(samples)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = parser_of(shared.value)
        for b in batches:
            for part in lots(b, at):
                langs, _ = parser.predict(part.column(at).to_pylist())
                yield part.filter(pa.array([x != "und" for x in langs]))

    # columns by place, whatever their names
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(tidy(run), plain.schema).toDF(*docs.columns)
