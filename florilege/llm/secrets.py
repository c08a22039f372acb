"""Secret scan, in DataFrame functions only: three fixed patterns, and character Markov models for the rest.

Two first-order Markov models over characters, one of random strings and one of ordinary identifiers, are trained from
labelled samples (token, is_random): any such table, or `labelled_samples`, which makes one by rule. A quarter of the
samples, by hash, is held out. A token of 20 or more characters that no pattern has taken is reported as kind `random` if its
log-likelihood ratio is above a threshold: the odds that a token is ordinary before it is read (`PRIOR`), or, if that is more,
the ratio that only `FALSE_SHARE` of the ordinary held-out samples exceed. The models are a table of SYMBOLS ** 2 numbers,
which is all that reaches the driver; texts stay in the JVM. Places are code points: a text is split at a pattern's matches,
and the lengths of gaps and matches add up to the places.

Defined results: a null text counts as empty and has no spans; texts of any length are read whole; null or repeated
doc_ids give one row each; without samples nothing is `random`; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
SYMBOLS = len(ALPHABET)
#: Log of the odds that a token is ordinary, before it is read: about a million to one.
PRIOR = 14.0
#: Share of ordinary held-out samples that may be above the threshold, and one in how many samples is held out.
FALSE_SHARE, HELD_OUT = 0.001, 4
SMOOTHING = 0.5
#: Elements of a list that are scanned together; a text of n matches costs n * (CHUNK + n / CHUNK ** 2) copied numbers.
CHUNK = 256

#: Words of which ordinary identifiers are made.
IDENTIFIER_WORDS = (
    "account active address amount array backup batch buffer build cache category channel check client cluster code column commit "
    "config connection container content context control counter country create currency customer data database date default delete "
    "delivery description device directory document domain element email enable encoding error event execution export factory feature "
    "field file filter folder format function generate group handler header height history image import index information input instance "
    "interface internal invoice item language layer length level library limit list local location logger manager mapping memory message "
    "method model module monitor network number object offset option order output package parameter parent password path pattern payment "
    "permission policy position price process product profile project property protocol provider query queue reader record reference "
    "region register release remote report request resource response result return role root sample schedule schema score script search "
    "section security select sequence server service session setting source stack start status storage stream string style subject "
    "summary system table target task template test thread time token total transaction transfer type update upload user validate value "
    "vector version view visible volume widget window worker writer"
).split()


def labelled_samples(spark: SparkSession, n: int = 8000) -> DataFrame:
    """(token, is_random): hashes in several alphabets and lengths; and identifiers joined from `IDENTIFIER_WORDS` by rule."""
    h = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 512)
    rows = spark.range(n).select("id", h.alias("h"), F.base64(F.unhex(h)).alias("b"))
    length = (20 + F.col("id") % 29).cast("int")
    alphabets = (
        F.translate("b", "=", ""),
        F.translate("b", "+/=", ""),
        F.translate("b", "+/=", "-_"),
        F.upper(F.translate("b", "+/=", "")),
        F.lower(F.translate("b", "+/=", "")),
        F.col("h"),
        F.upper("h"),
    )
    random = F.substring(F.element_at(F.array(*alphabets), (F.col("id") % len(alphabets) + 1).cast("int")), F.lit(1), length)
    words = F.array(*map(F.lit, IDENTIFIER_WORDS))
    pick = lambda salt: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(IDENTIFIER_WORDS))) + 1).cast("int"))
    four, number = [pick(k) for k in range(4)], (F.pmod(F.xxhash64("id"), F.lit(10_000))).cast("string")
    styles = (
        F.concat_ws("_", *four),
        F.concat(four[0], *map(F.initcap, four[1:])),
        F.concat_ws("/", *four),
        F.upper(F.concat_ws("_", *four)),
        F.concat(F.concat_ws("-", *four), F.lit("-"), number),
        F.concat(*four),
        F.concat(F.initcap(four[0]), F.initcap(four[1]), number, F.initcap(four[2]), F.initcap(four[3])),
    )
    ordinary = F.element_at(F.array(*styles), (F.col("id") % len(styles) + 1).cast("int"))
    return rows.select(random.alias("token"), F.lit(True).alias("is_random")).union(rows.select(ordinary, F.lit(False)))


def held_out(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(HELD_OUT)) == 0


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios by pair of symbols: SYMBOLS ** 2 numbers, the pair (a, b) at a * SYMBOLS + b."""
    pairs = samples.select("is_random", F.explode(F.expr("transform(sequence(1, greatest(length(token) - 1, 1)), i -> substring(token, i, 2))")).alias("pair"))
    # a row a class and a pair of symbols
    known = pairs.filter((F.length("pair") == 2) & F.col("pair").rlike("^[" + ALPHABET.replace("-", r"\-") + "]+$"))
    seen = {(r["is_random"], r["pair"]): r["count"] for r in known.groupBy("is_random", "pair").count().collect()}
    out = []
    for a in ALPHABET:
        totals = {k: sum(seen.get((k, a + b), 0) + SMOOTHING for b in ALPHABET) for k in (True, False)}
        for b in ALPHABET:
            p, q = ((seen.get((k, a + b), 0) + SMOOTHING) / totals[k] for k in (True, False))
            out.append(round(math.log(p / q), 3))
    return out


def calibrated(samples: DataFrame, model: list[float]) -> float:
    """The threshold, from samples that the model was not trained on."""
    told = samples.filter(~F.col("is_random") & F.col("token").rlike("^[" + ALPHABET.replace("-", r"\-") + "]+$"))
    high = told.agg(F.percentile(ratio(F.col("token"), as_column(model)), F.lit(1 - FALSE_SHARE))).first()[0]
    return max(PRIOR, high if high is not None else PRIOR)


def fitted(samples: DataFrame) -> tuple[list[float], float]:
    """Model and threshold from labelled samples: null tokens and labels take no part."""
    samples = samples.select(F.col("token").cast("string").alias("token"), F.col("is_random").cast("boolean").alias("is_random")).filter("token IS NOT NULL AND is_random IS NOT NULL")
    model = train(samples.filter(~held_out(F.col("token"))))
    return model, calibrated(samples.filter(held_out(F.col("token"))), model)


def as_column(model: list[float]) -> Column:
    return F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")


def ratio(token: Column, model: Column) -> Column:
    chars = F.split(token, "")
    at = lambda c: F.instr(F.lit(ALPHABET), c)
    pairs = F.zip_with(F.slice(chars, 1, F.size(chars) - 1), F.slice(chars, 2, F.size(chars) - 1), lambda a, b: F.element_at(model, (at(a) - 1) * SYMBOLS + at(b)))
    return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x)


def given(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), then), 1)


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """By element, what `merge` makes of 0 and all before it: within chunks and over chunks, as a list grows by copying."""
    state = lambda at: F.struct(at.alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    add = lambda acc, x: F.struct(merge(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
    scan = lambda array, at: F.aggregate(array, state(at), add, lambda acc: acc["out"])
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(CHUNK)), lambda i: F.slice(v, i + 1, CHUNK))
    whole = lambda chunks: scan(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), merge)), F.lit(0))
    return given(values, lambda v: given(cut(v), lambda chunks: F.flatten(F.zip_with(chunks, whole(chunks), scan))))


def placed(text: Column, pattern: str, kind: int, may: Column, value_group: int = 0) -> Column:
    """Array of (start, kind, end, value) for the leftmost non-overlapping matches; empty unless `may`."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else matches
    measured = lambda m: F.zip_with(F.slice(gaps, 1, F.size(m)), F.arrays_zip(m.alias("m"), values.alias("v")), lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m["m"]).alias("n"), m["v"].alias("v")))
    span = lambda m, at: F.struct((at + m["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + m["gap"] + m["n"]).alias("end"), m["v"].alias("value"))
    found = given(given(matches, measured), lambda lengths: F.zip_with(lengths, running(F.transform(lengths, lambda m: m["gap"] + m["n"]), lambda a, b: a + b), span))
    return F.when(may, found).otherwise(F.expr("cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)"))


def untouched(tokens: Column, base: Column) -> Column:
    """The tokens that meet no base span: of the base spans that start before a token ends, none ends after its start.

    Base spans stand at their start and tokens at their end, sorted; the largest end of the spans before a token says it."""
    of = lambda spans, at, last: F.transform(spans, lambda s: F.struct(s[at].alias("at"), F.lit(last).alias("is_span"), s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    reach = lambda events: running(F.transform(events, lambda e: F.when(e["is_span"], e["end"]).otherwise(0)), lambda a, b: F.greatest(a, b))
    events = F.array_sort(F.concat(of(tokens, "end", False), of(base, "start", True)))
    free = given(events, lambda es: F.filter(F.arrays_zip(es.alias("e"), reach(es).alias("r")), lambda x: ~x["e"]["is_span"] & (x["r"] <= x["e"]["start"])))
    return F.transform(free, lambda x: F.struct(x["e"]["start"].alias("start"), x["e"]["kind"].alias("kind"), x["e"]["end"].alias("end"), x["e"]["value"].alias("value")))


def listed(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def scan(docs: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans (kind:start:end, code points, end exclusive)."""
    model, threshold = fitted(labelled_samples(docs.sparkSession) if samples is None else samples)
    table = as_column(model)
    text = F.col("text")
    found = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select(
        "doc_id",
        F.filter(placed(text, ASSIGN, 0, text.contains("=") | text.contains(":"), 2), lambda s: F.length(s["value"]) >= 8).alias("assign"),
        placed(text, ACCESS, 1, text.contains("AKIA")).alias("access"),
        placed(text, HEX, 2, text.rlike(HEX)).alias("hex"),
        placed(text, TOKEN, 3, text.rlike(TOKEN)).alias("tokens"),
    )
    found = found.withColumn("base", F.concat("assign", "access", "hex"))
    free = untouched(F.col("tokens"), F.col("base"))
    found = found.withColumn("free", F.when((F.size("tokens") > 0) & (F.size("base") > 0), free).otherwise(F.col("tokens"))).withColumn(
        "random", F.when(F.size("free") > 0, F.filter("free", lambda t: ratio(t["value"], table) > threshold)).otherwise(F.col("free"))
    )
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", "random")).alias("spans"),
    )
