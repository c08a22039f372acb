"""License scan by template-markup matching.

A template is license wording with regions in markup: `[[ ... ]]` may be left out, `{{n}}` stands for any 0 to n words.
`license_texts` has those in use; `scan` takes others, as (label, template). A template is compiled into an automaton over tokens; a text holds the license where a run of its words is accepted, that is,
where all wording outside the regions stands there word for word. Three fixed phrases are counted beside the templates.

A text is lower-cased (A-Z), cut into words, and joined by single blanks, once. A template is only run on a text that
holds its anchor, the longest piece of mandatory wording, which every accepted text must hold; then from every word that
can begin it. The states alive at once are bounded by the template's length.

Defined results: a null text counts as empty (no words, no places, null first and last, empty labels, score 0); null and
repeated doc_ids give a row each; texts of any length are read whole; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import PHRASES, TEMPLATES
from .shared import lean_batches, tidy

MARKUP = re.compile(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+")
NOT_WORD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(NOT_WORD).split()


class TokenAutomaton:
    """States are places between tokens: `steps[s]` lists (word or None for any word, next), `free[s]` moves without one."""

    def __init__(self, template: str) -> None:
        self.steps: list[list[tuple[bytes | None, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        runs, run, opened = [], [], []
        for token in MARKUP.findall(template):
            here = len(self.steps) - 1
            if token == "[[":
                opened.append(here)
            elif token == "]]":
                self.free[opened.pop()].append(here)
            elif token.startswith("{{"):
                first = here
                for _ in range(int(token[2:-2])):
                    self._add(None)
                end = len(self.steps) - 1
                for s in range(first, end):
                    self.free[s].append(end)
            else:
                self._add(token.encode())
            if not opened and not token.startswith(("[[", "]]", "{{")):
                run.append(token.encode())
            else:
                runs.append(run)
                run = []
        self.final = len(self.steps) - 1
        self.anchor = b" " + b" ".join(max([*runs, run], key=len)) + b" "
        self.first = {w for s in self.closure({0}) for w, _ in self.steps[s]}

    def _add(self, word: bytes | None) -> None:
        self.steps[-1].append((word, len(self.steps)))
        self.steps.append([])
        self.free.append([])

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def accepts_at(self, words: list[bytes], at: int) -> bool:
        states = self.closure({0})
        while self.final not in states:
            if not states or at == len(words):
                return False
            states = self.closure({to for s in states for w, to in self.steps[s] if w is None or w == words[at]})
            at += 1
        return True


@cache
def automata_of(templates: tuple[tuple[str, str], ...]) -> tuple[tuple[str, TokenAutomaton], ...]:
    """Compiled once a worker."""
    return tuple((label, TokenAutomaton(t)) for label, t in templates)


NEEDLES = tuple((b" " + p.encode() + b" ", label) for p, label in PHRASES)


def scan_text(text: str | None, templates=TEMPLATES) -> tuple[int, int, int | None, int | None, str, str, float]:
    words = words_of(text)
    line = b" " + b" ".join(words) + b" "
    n_base, first, last, base, own = 0, None, None, set(), set()
    for needle, label in NEEDLES:
        at, seen, upto = line.find(needle), 0, 0
        while at >= 0:
            seen += line.count(b" ", upto, at)  # each word before has one blank before it
            upto = at
            n_base += 1
            base.add(label)
            first = seen if first is None else min(first, seen)
            last = seen if last is None else max(last, seen)
            at = line.find(needle, at + 1)
    for label, automaton in automata_of(templates):
        if label not in own and automaton.anchor in line:
            if any(w in automaton.first and automaton.accepts_at(words, i) for i, w in enumerate(words)):
                own.add(label)
    score = 1.0 if own else 0.5 if base else 0.0
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(base | own)), score


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (1 template, 0.5 phrase only, 0 neither)."""
    lean_batches(docs.sparkSession)
    templates = tuple(map(tuple, templates))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kinds = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(zip(*(scan_text(t.as_py(), templates) for t in b.column(1)), strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, kind) for x, (_, kind) in zip(found, kinds))], ["doc_id", *(k for k, _ in kinds)])

    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return rows.mapInArrow(tidy(run), schema)


def pattern(template: str) -> str:
    """A template as a regular expression over words that end in a blank each."""
    out = ""
    for token in MARKUP.findall(template):
        out += {"[[": "(?:", "]]": ")?"}.get(token) or ("(?:[^ ]+ ){0," + token[2:-2] + "}" if token[0] == "{" else token + " ")
    return out


def oracle(templates=TEMPLATES) -> str:
    """SQL for the rows of `scan`: the templates as regular expressions."""
    words = [p.split() for p, _ in PHRASES]
    places = [f"list_filter(range(len(w)), lambda i: {' AND '.join(f'w[i + {k}] = ' + repr(x) for k, x in enumerate(ws, 1))})" for ws in words]
    base = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(PHRASES))
    own = ", ".join(f"CASE WHEN regexp_matches(line, ' {pattern(t)}') THEN '{label}' END" for label, t in templates)
    distinct = "array_to_string(list_sort(list_distinct({0})), ',')"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return (
        f"WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents), "
        f"p AS (SELECT doc_id, len(w) AS n_words, ' ' || array_to_string(w, ' ') || ' ' AS line, {', '.join(f'{x} AS p{k}' for k, x in enumerate(places))} FROM t), "
        f"f AS (SELECT doc_id, n_words, list_concat({', '.join(f'p{k}' for k in range(len(PHRASES)))}) AS found, list_filter([{base}], lambda x: x IS NOT NULL) AS base, list_filter([{own}], lambda x: x IS NOT NULL) AS own FROM p) "
        f"SELECT doc_id, n_words, len(found) AS n_base, list_min(found) AS first_word, list_max(found) AS last_word, {distinct.format('base')} AS base_labels, {distinct.format('list_concat(base, own)')} AS labels, "
        "CASE WHEN len(own) > 0 THEN 1.0 WHEN len(base) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM f"
    )
