"""Text kernel: folding, comparison forms, dates and small formatters.

Column functions stay in the JVM. Their Python twins (`*_py`) serve Arrow UDFs that need offsets and full Unicode rules.
"""

from __future__ import annotations

from collections.abc import Callable

import datetime as dt
import html
import re
import unicodedata
from functools import cache, lru_cache, partial

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Low bytes that the portal writes as character references, and what they stand for.
LOW_REFERENCES = {19: "–", 20: "—", 24: "‘", 25: "’", 28: "“", 29: "”"}
#: Entities decoded in the JVM, `&amp;` last.
ENTITIES = (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
#: Months, ordinals and the nouns ordinals stand before.
MONTHS = ("janeiro", "fevereiro", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")
ORDINALS = {
    "primeira": "1a", "segunda": "2a", "terceira": "3a", "quarta": "4a", "quinta": "5a", "sexta": "6a", "setima": "7a",
    "oitava": "8a", "nona": "9a", "decima": "10a", "primeiro": "1a", "segundo": "2a", "terceiro": "3a",
}
ORDINAL_NOUNS = "camara|turma|secao|grupo"
PARTICLES = ("da", "das", "de", "do", "dos", "e")
DASHES, QUOTES = "–—-", "“”‘’\"'`´"
TOKEN = r"[^\p{L}\p{N}\p{Co}]+"


@cache
def fold_table() -> tuple[str, str]:
    """Letters of U+00C0 to U+024F and the one letter each folds to."""
    pairs = []
    for point in range(0xC0, 0x250):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(point)) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != chr(point):
            pairs.append((chr(point), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold_accents(text: Column, source: str = "", target: str = "") -> Column:
    """Letters without their accents, and `source` as `target`."""
    letters, bases = fold_table()
    return F.translate(text, letters + source, bases + target)


#: What normal forms change. Nothing in them reaches over an ASCII character, so a run is made alone.
BEYOND_ASCII = re.compile(r"([^\x00-\x7f]+)")


def _bare(form: str, run: str) -> str:
    return "".join(c for c in unicodedata.normalize(form, run) if unicodedata.category(c) != "Mn")


_bare_short = lru_cache(1 << 14)(_bare)


def runs_made(text: str, short: Callable[[str], str], long: Callable[[str], str]) -> list[str]:
    """A text in parts, every second one made of a run beyond ASCII; what is made of short runs may be kept."""
    parts = BEYOND_ASCII.split(text)
    parts[1::2] = [short(run) if len(run) <= 4 else long(run) for run in parts[1::2]]
    return parts


def without_marks(text: str, form: str) -> str:
    """The normal form of a text, without its marks."""
    return text if text.isascii() else "".join(runs_made(text, partial(_bare_short, form), partial(_bare, form)))


def fold_accents_py(text: str) -> str:
    return without_marks(text, "NFD")


def html_to_text(markup: Column) -> Column:
    """Scripts go, block ends become line ends, other tags go; then references, then white space."""
    t = F.regexp_replace(markup, r"(?is)<(script|style)\b.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</p>|</div>|</tr>|</td>|</h[0-9]>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    for number, char in LOW_REFERENCES.items():
        t = F.replace(t, F.lit(f"&#{number};"), F.lit(char))
    for entity, char in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(F.replace(t, F.lit("\xa0"), F.lit(" ")), r"[ \t\r]+", " ")
    return F.regexp_replace(F.regexp_replace(t, r"\n\s*\n+", "\n"), r"^\s+|\s+$", "")


def html_to_text_py(markup: str) -> str:
    t = re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", markup)
    t = re.sub(r"(?i)<br\s*/?>|</(?:p|div|tr|td|h\d)>", "\n", t)
    t = re.sub(r"<[^>]+>", "", t)
    t = re.sub(r"&#(1[9]|2[04589]);", lambda m: LOW_REFERENCES[int(m[1])], t)
    t = WIDE_GAP.sub(" ", html.unescape(t).replace("\xa0", " ").replace("\t", " ").replace("\r", " "))
    return re.sub(r"\n\s*\n+", "\n", t).strip()


#: Rules of the comparison form, in their order, as (pattern, replacement); they follow folding and lower case.
NORM_RULES = (
    (r"\bn[o.°]\s*([0-9])", "n $1"),
    (r"§\s+", "§"),
    (f"[{QUOTES}]", "'"),
    (f"[{DASHES}]", "-"),
    (r"\s+([.,;:)\]])", "$1"),
    (r"([(\[])\s+", "$1"),
    (r"\s+", " "),
)


def norm(text: Column) -> Column:
    """Comparison form: no accents, lower case, one kind of quote and dash, no blanks before stops, single blanks."""
    t = F.lower(fold_accents(text, "ºª", "oa"))
    for pattern, to in NORM_RULES:
        t = F.regexp_replace(t, pattern, to)
    return F.trim(t)


#: `n` leads its pattern, so that the search goes from one to the next.
NUMBER = re.compile(r"n[o.°](?<=\bn.) ?([0-9])")
WIDE_GAP = re.compile("  +")


def plain_signs(text: str) -> str:
    for char in QUOTES + DASHES:
        if char.isascii() or not text.isascii():
            text = text.replace(char, "'" if char in QUOTES else "-")
    return text


def norm_py(text: str) -> str:
    """`norm` by full Unicode rules: NORM_RULES over text whose blanks are single before the others rather than after."""
    t = without_marks(text, "NFKD")
    plain = plain_signs(t)
    # signs beside a letter may decide on its lower case, though not in ASCII
    t = plain.lower() if plain.isascii() else plain_signs(t.lower())
    t = NUMBER.sub(r"n \1", " ".join(t.split())).replace("§ ", "§")
    for char in ".,;:)]":
        t = t.replace(" " + char, char)
    return t.replace("( ", "(").replace("[ ", "[")


def norm_with_places(text: str) -> tuple[str, list[int]]:
    """The comparison form, and for each of its characters the place in `text` that it came from."""
    chars, places = [], []
    for i, c in enumerate(text):
        for x in fold_accents_py(unicodedata.normalize("NFKC", c)).lower():
            chars.append(x)
            places.append(i)
    t = "".join(chars)
    for pattern, to in NORM_RULES:
        out, kept, at = [], [], 0
        for m in re.finditer(pattern, t):
            made = m.expand(to.replace("$1", r"\1"))
            out += [t[at : m.start()], made]
            # what a rule keeps stands at the start or the end of what it matched
            same = next((k for k, (x, y) in enumerate(zip(made, m[0])) if x != y), min(len(made), len(m[0])))
            kept += [*places[at : m.start() + same], *(places[max(m.end() - len(made) + k, m.start())] for k in range(same, len(made)))]
            at = m.end()
        t, places = "".join([*out, t[at:]]), kept + places[at:]
    start = len(t) - len(t.lstrip())
    t = t.strip()
    return t, places[start : start + len(t)]


def norm_body(text: Column) -> Column:
    """`norm` with feminine and masculine ordinals in words written as figures before the name of a court's body."""
    t = norm(text)
    for word, figure in ORDINALS.items():
        t = F.regexp_replace(t, rf"\b{word}\s+(?=(?:{ORDINAL_NOUNS}))", figure + " ")
    return t


def norm_body_py(text: str) -> str:
    return re.sub(rf"\b({'|'.join(ORDINALS)})\s+(?={ORDINAL_NOUNS})", lambda m: ORDINALS[m[1]] + " ", norm_py(text))


@cache
def _fold_one(char: str) -> str:
    """One character for one character."""
    if char.isspace() or char == "﻿":
        return " "
    if char in "“”‘’\"`´«»":
        return "'"
    if char in "–—":
        return "-"
    plain = "".join(c for c in unicodedata.normalize("NFKD", char) if unicodedata.category(c) != "Mn").lower()
    return plain[:1] or " "


ASCII_FOLDS = {point: _fold_one(chr(point)) for point in range(128)}


def _fold_run(run: str) -> str:
    return "".join(map(_fold_one, run))


_fold_short = lru_cache(1 << 14)(_fold_run)


def fold_in_place(text: str) -> str:
    """Folded text in which every character keeps its place."""
    if text.isascii():
        return text.translate(ASCII_FOLDS)
    parts = runs_made(text, _fold_short, _fold_run)
    made = "".join(parts[1::2])
    if made.isascii() and made.translate(ASCII_FOLDS) == made:  # the runs stay as they are made
        return "".join(parts).translate(ASCII_FOLDS)
    parts[::2] = [part.translate(ASCII_FOLDS) for part in parts[::2]]
    return "".join(parts)


def matching_form(text: str) -> str:
    return " ".join(re.findall("[a-z0-9]+", fold_in_place(text)))


def long_date(text: Column) -> Column:
    """`31 de Agosto de 2026` as a date; null if there is none or it is not on the calendar."""
    pattern = r"(\d{1,2})\s*º?\s+de\s+([A-Za-zçÇ]+)\s+de\s+(\d{4})"
    part = lambda k: F.regexp_extract(text, pattern, k)
    month = F.element_at(F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, f"{i:02}"))), F.lower(fold_accents(part(2))))
    return F.try_to_date(F.concat_ws("-", part(3), month, F.lpad(part(1), 2, "0")))


def long_date_py(text: str) -> dt.date | None:
    m = re.search(r"(\d{1,2})\s*º?\s+de\s+([A-Za-zçÇ]+)\s+de\s+(\d{4})", text)
    month = fold_accents_py(m[2]).lower() if m else ""
    try:
        return dt.date(int(m[3]), MONTHS.index(month) + 1, int(m[1])) if month in MONTHS else None
    except ValueError:
        return None


def short_date(date: Column) -> Column:
    return F.coalesce(F.date_format(date, "dd/MM/yyyy"), F.lit("?"))


def given_date(value: str, label: str) -> dt.date:
    """A date of a query, in one of two forms."""
    for form in ("%Y-%m-%d", "%d/%m/%Y"):
        try:
            return dt.datetime.strptime(value.strip(), form).date()
        except ValueError:
            pass
    raise ValueError(f"{label}: {value!r} is not a date as yyyy-mm-dd or dd/mm/yyyy")


def proper_name(text: Column) -> Column:
    """Words with a capital each, particles in lower case unless first."""
    words = F.split(F.lower(F.trim(text)), r"\s+")
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & w.isin(*PARTICLES), w).otherwise(F.initcap(w))), " ")


def citation(appeal: Column, process: Column, decision: Column, rapporteur: Column, body: Column, judged: Column, link: Column, level: str) -> Column:
    """How a decision is cited, with its link and how far it was verified; an appeal or rapporteur that is not known has a stand-in."""
    known = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    date = F.when(judged.isNotNull(), F.concat(F.lit(", julgado em "), short_date(judged))).otherwise("")
    parts = ("([TJSE, ", known(appeal, "Acórdão"), ", processo nº ", process, ", acórdão nº ", decision, ", Rel. ", proper_name(known(rapporteur, "?")), ", ", body, date, "](", link, f")) — verificação: {level}")
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def base_ref(ref: Column) -> Column:
    return F.trim(F.substring_index(ref, "/", 1))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def ascii_like(column: Column, needle: str) -> Column:
    """LIKE '%needle%' with case folded for A-Z alone, the needle's own wildcards taken as they are."""
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.contains(lower(column), lower(F.lit(needle)))


def newer_version(a: Column, b: Column) -> Column:
    """Whether three-part version `a` is newer than `b`; malformed ones never are."""
    form = r"^v?(\d+)\.(\d+)\.(\d+)$"
    parts = lambda c: F.transform(F.array(*(F.regexp_extract(c, form, k) for k in (1, 2, 3))), lambda x: x.cast("int"))
    return a.rlike(form) & b.rlike(form) & (parts(a) > parts(b))


def latin1_quoted(text: str) -> str:
    """Percent-encoding of the Latin-1 bytes."""
    from urllib.parse import quote_from_bytes

    return quote_from_bytes(text.encode("latin-1", "replace"))


def given(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once a row, however often it is named, in functions of elements too."""
    return F.element_at(F.transform(F.array(value), then), 1)
