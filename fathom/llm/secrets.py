"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Everything is DataFrame expressions.  A match's place follows from the pieces between the matches: ``split`` gives those,
``regexp_extract_all`` the matches, and their lengths add up to offsets in code points.

The two models are first-order Markov chains over 69 symbols (letters, digits, ``+/_=-.`` and all else).  A transition's probability is
drawn towards the frequency of the symbol it leads to, with the weight of PRIOR transitions.  Random strings are learnt from the values that the fixed patterns found and from SAMPLES generated digests, ordinary ones
from words of the texts; the sample of texts is bounded by TRAIN_DOCS.  A candidate of MIN_LEN or more characters is a secret when its
log-likelihood ratio reaches MIN_LLR nats in all.

Defined results: null or empty texts have no spans; the same span is reported once per kind; candidates that overlap a fixed match are
left out; without training rows the generated digests and no words are learnt from; repeated rows get the same spans, an empty table
none; texts of any length are searched whole.  Columns of any name pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm.common import free_name

# The patterns of the three kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
WIDTH = len(SYMBOLS) + 1

MIN_LEN = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{MIN_LEN},}}"
MIN_LLR = 12.0
PRIOR = 8.0
TRAIN_DOCS = 4000
SAMPLES = 2000
#: Matches whose places are summed up at a time.
CHUNK = 512


def _symbols(c: Column) -> Column:
    """Symbol numbers of a string, 0 for characters outside the list."""
    return F.transform(F.split(c, ""), lambda x: F.when(x == "", F.lit(0)).otherwise(F.instr(F.lit(SYMBOLS), x)))


def spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Array of struct(start, kind, stop, value) of the matches that ``keep`` accepts; the regular expression runs once for texts without any."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(F.regexp_like(text, F.lit(pattern)), _placed(text, found, pattern, kind, keep)).otherwise(F.array().cast(SPAN))


SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"


def _placed(text: Column, found: Column, pattern: str, kind: int, keep) -> Column:
    gaps = F.split(text, pattern, -1)
    sizes = "array<struct<gap:int,hit:int,value:string>>"
    pairs = F.zip_with(gaps, found, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("hit"), h.alias("value")))
    pairs = F.filter(pairs, lambda p: p["value"].isNotNull()).cast(sizes)
    out = F.get(F.transform(F.array(pairs), lambda p: _summed(p, sizes, kind)), F.lit(0))  # evaluates ``pairs`` once
    return out if keep is None else F.filter(out, lambda s: keep(s["value"]))


def _summed(pairs: Column, sizes: str, kind: int) -> Column:
    """Spans from gaps and matches.  Running sums append to a list, which copies it, so they are made inside chunks and over the chunks."""
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(pairs) - 1) / CHUNK), F.lit(0)).cast("int")), lambda c: F.slice(pairs, c * CHUNK + 1, CHUNK))
    chunks = F.transform(cut, lambda c: F.struct(c.alias("pairs"), F.aggregate(c, F.lit(0), lambda n, p: n + p["gap"] + p["hit"]).alias("n")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<pairs:{sizes},at:int>>").alias("out"))
    placed = F.aggregate(chunks, start, lambda acc, c: F.struct((acc["at"] + c["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct(c["pairs"].alias("pairs"), acc["at"].alias("at")))).alias("out")), lambda acc: acc["out"])

    def step(acc: Column, p: Column) -> Column:
        at = acc["at"] + p["gap"]
        one = F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + p["hit"]).alias("stop"), p["value"].alias("value"))
        return F.struct((at + p["hit"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.flatten(F.transform(placed, lambda c: F.aggregate(c["pairs"], F.struct(c["at"].alias("at"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"])))


def base_spans(text: Column) -> Column:
    """Spans of the three fixed kinds, by start and then kind."""
    long_enough = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 1)) >= 6
    return F.array_sort(F.concat(spans(text, ASSIGN, 0, long_enough), spans(text, ACCESS, 1), spans(text, HEX, 2)))


def train(docs: DataFrame, text: str = "text") -> list[float]:
    """Log-likelihood ratio of every transition, random over ordinary: WIDTH * WIDTH numbers.

    The sample is the different texts whose hash falls below TRAIN_DOCS over the number of different texts: bounded in expectation, the
    same on every run, and a text counts once however many copies it has.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    n = rows.select("h").distinct().count()
    key = F.pmod("h", F.lit(1 << 40)) / float(1 << 40)
    few = rows.where(key < min(1.0, TRAIN_DOCS / max(n, 1))).dropDuplicates(["h"])
    values = F.transform(base_spans(F.col("t")), lambda s: F.when(s["kind"] == 0, F.regexp_extract(s["value"], ASSIGN, 1)).otherwise(s["value"]))
    found = few.select(F.explode(values).alias("s"), F.lit(1).alias("random"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    made = spark.range(SAMPLES).select(F.explode(F.array(F.base64(F.unhex(digest)), F.substring(digest, 1, 40))).alias("s"), F.lit(1).alias("random"))
    words = few.select(F.explode(F.regexp_extract_all("t", F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z][A-Za-z_]{7,}(?![A-Za-z0-9+/_=-])"), F.lit(0))).alias("s"), F.lit(0).alias("random"))
    both = found.unionByName(made).unionByName(words).select("random", _symbols(F.col("s")).alias("x")).where(F.size("x") > 1)
    steps = both.select("random", F.explode(F.zip_with(F.slice("x", 1, F.size("x") - 1), F.slice("x", 2, F.size("x") - 1), lambda a, b: a * WIDTH + b)).alias("step"))
    counts = {(r[0], r[1]): r[2] for r in steps.groupBy("random", "step").agg(F.count("*")).collect()}

    def log_rows(kind: int) -> list[float]:
        table = [[counts.get((kind, a * WIDTH + b), 0) for b in range(WIDTH)] for a in range(WIDTH)]
        every = [sum(row[b] for row in table) + 0.5 for b in range(WIDTH)]
        total = sum(every)
        return [math.log((n + PRIOR * every[b] / total) / (sum(row) + PRIOR)) for row in table for b, n in enumerate(row)]

    return [round(p - q, 4) for p, q in zip(log_rows(1), log_rows(0), strict=True)]


def ratio(value: Column, table: Column) -> Column:
    """Log-likelihood ratio of a string's transitions."""
    x = _symbols(value)
    steps = F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: F.element_at(table, (a * WIDTH + b + 1).cast("int")))
    return F.aggregate(steps, F.lit(0.0), lambda acc, s: acc + s)


def scan(docs: DataFrame, text: str = "text", model: list[float] | None = None) -> tuple[DataFrame, str, str]:
    """``docs`` with the fixed spans and all spans, arrays of struct(start, kind, stop, value); also the names of both columns."""
    model = train(docs, text) if model is None else model
    table = F.split(F.lit(",".join(map(str, model))), ",").cast(T.ArrayType(T.DoubleType()))  # folded to one constant
    base = free_name(docs.columns, "base_spans")
    every = free_name([*docs.columns, base], "spans")
    out = docs.withColumn(base, F.coalesce(base_spans(F.col(text)), F.array().cast(SPAN)))
    more = F.coalesce(spans(F.col(text), CANDIDATE, 3), F.array().cast(SPAN))
    clear = F.filter(more, lambda s: ~F.exists(F.col(base), lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])) & (ratio(s["value"], table) >= MIN_LLR))
    return out.withColumn(every, F.array_sort(F.concat(F.col(base), clear))), base, every


def listing(found: Column) -> Column:
    """``kind:start:stop`` of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def counted(found: Column, kind: int) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
