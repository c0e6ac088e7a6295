"""Language identification by prediction by partial matching.

Each language has a byte context tree of depth ``DEPTH``: counts of what followed every context of up to that many bytes.  A byte is
coded in the longest context that the language has seen it in, after an escape from each longer context that it has seen without that
byte: with t bytes and q different ones seen, a byte seen c times has probability c / (t + q), the escape q / (t + q).  Below the empty
context every byte has 1/256.  Counts are frozen after training, so the code length of a byte is a function of the DEPTH + 1 bytes up
to it, and whole texts are scored by table look-up.

Defined results: ``und`` with score 0 for null text or text without a letter, and for all rows when there is nothing to learn from; on
equal code lengths the name that sorts first.  Columns of any name pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import append

DEPTH = 4
#: Training text: this many bytes a language at most in expectation, this many for all languages, and no text longer than this.
BYTES_PER_LANG = 384 << 10
BYTES_IN_ALL = 24 << 20
LONGEST = 64 << 10
UND = "und"
_MUL = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93))


class Table:
    """Vectorised look-up of 64-bit keys: a few hash tables, each for the keys that collided in the one before."""

    def __init__(self, keys: np.ndarray):
        self.levels, left = [], np.arange(len(keys), dtype=np.int32)
        for mul in _MUL:
            bits = max(4, math.ceil(math.log2(8 * len(left) + 1)))
            slot = self.slot(keys[left], mul, bits)
            stored, at = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
            at[slot] = left
            stored[slot] = keys[left]
            self.levels.append((mul, bits, stored, at))
            left = left[at[slot] != left]
        self.order = np.argsort(keys[left], kind="stable")
        self.rest, self.rest_at = keys[left][self.order], left[self.order]

    @staticmethod
    def slot(keys: np.ndarray, mul: np.uint64, bits: int) -> np.ndarray:
        return ((keys * mul) >> np.uint64(64 - bits)).astype(np.intp)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 where it is not there."""
        out = np.full(len(keys), -1, np.int32)
        todo: np.ndarray | None = None
        for mul, bits, stored, at in self.levels:
            k = keys if todo is None else keys[todo]
            slot = self.slot(k, mul, bits)
            got = at[slot]
            got[stored[slot] != k] = -1
            if todo is None:
                out, todo = got, np.flatnonzero(got < 0)
            else:
                out[todo] = got
                todo = todo[got < 0]
            if not len(todo):
                return out
        if len(self.rest):
            j = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            out[todo] = np.where(self.rest[j] == keys[todo], self.rest_at[j], -1)
        return out


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """Code of the n bytes that end at each position from n - 1 on."""
    out = np.zeros(max(len(data) - n + 1, 0), np.uint64)
    for j in range(n):
        out = (out << np.uint64(8)) | data[j : len(data) - n + 1 + j]
    return out


@dataclass
class Model:
    """Frozen statistics of all languages: per gram length a sorted key list and code lengths in bits by language."""

    langs: list[str]
    keys: list[np.ndarray]  # [n - 1]: grams of length n
    cost: list[np.ndarray]
    contexts: list[np.ndarray]  # [n - 1]: contexts of length n - 1
    escape: list[np.ndarray]  # bits, 0 where a language has not seen the context


def train(samples: dict[str, list[bytes]], depth: int = DEPTH) -> Model:
    langs = sorted(samples)
    pad = bytes(depth)
    model = Model(langs, [], [], [], [])
    data = {lang: np.frombuffer(b"".join(pad + t for t in samples[lang]), np.uint8) for lang in langs}
    real = {lang: np.concatenate([np.r_[np.zeros(depth, bool), np.ones(len(t), bool)] for t in samples[lang]] or [np.zeros(0, bool)]) for lang in langs}
    for n in range(1, depth + 2):
        counts, totals = {}, {}
        for lang in langs:
            g = grams(data[lang], n)[real[lang][n - 1 :]]
            counts[lang] = np.unique(g, return_counts=True)
            ctx, where = np.unique(counts[lang][0] >> np.uint64(8), return_inverse=True)
            t = np.bincount(where, counts[lang][1], len(ctx)) if len(ctx) else np.zeros(0)
            totals[lang] = (ctx, t, np.bincount(where, minlength=len(ctx)) if len(ctx) else np.zeros(0))
        keys = np.unique(np.concatenate([counts[x][0] for x in langs]))
        ctxs = np.unique(np.concatenate([totals[x][0] for x in langs]))
        escape = np.zeros((len(ctxs), len(langs)))
        cost = np.zeros((len(keys), len(langs)))
        if n == 1:
            lower = np.full((len(keys), len(langs)), 8.0)
        else:
            mask = np.uint64((1 << 8 * (n - 1)) - 1)
            lower = model.cost[-1][np.searchsorted(model.keys[-1], keys & mask)]
        key_ctx = np.searchsorted(ctxs, keys >> np.uint64(8))
        for k, lang in enumerate(langs):
            ctx, t, q = totals[lang]
            escape[np.searchsorted(ctxs, ctx), k] = np.log2((t + q) / q)
            cost[:, k] = lower[:, k] + escape[key_ctx, k]
            seen, c = counts[lang]
            j = np.searchsorted(ctx, seen >> np.uint64(8))
            cost[np.searchsorted(keys, seen), k] = np.log2((t[j] + q[j]) / c)
        model.keys.append(keys)
        model.cost.append(cost)
        model.contexts.append(ctxs)
        model.escape.append(escape)
    return model


class Scorer:
    def __init__(self, model: Model):
        self.model, self.depth = model, len(model.keys) - 1
        self.top = Table(model.keys[-1])
        self.cost = model.cost[-1].astype(np.float32)

    def backed_off(self, code: np.ndarray) -> np.ndarray:
        """Code lengths of grams that no language has seen in full."""
        m, out = self.model, np.zeros((len(code), len(self.model.langs)))
        todo = np.arange(len(code))
        for n in range(self.depth + 1, 0, -1):
            c = code[todo] & np.uint64((1 << 8 * n) - 1)
            j = np.minimum(np.searchsorted(m.keys[n - 1], c), len(m.keys[n - 1]) - 1)
            found = m.keys[n - 1][j] == c
            out[todo[found]] += m.cost[n - 1][j[found]]
            todo, c = todo[~found], c[~found] >> np.uint64(8)
            if not len(todo):
                return out
            j = np.minimum(np.searchsorted(m.contexts[n - 1], c), len(m.contexts[n - 1]) - 1)
            out[todo] += np.where((m.contexts[n - 1][j] == c)[:, None], m.escape[n - 1][j], 0.0)
        out[todo] += 8.0
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Exact code length of each text in each language."""
        pad, out = bytes(self.depth), np.zeros((len(texts), len(self.model.langs)))
        sizes = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(pad + t for t in texts), np.uint8)
        starts = np.cumsum(sizes + self.depth) - sizes  # of the texts themselves
        piece = 1 << 20
        code = np.zeros(0, np.uint64)
        for i in range(0, len(data) - self.depth, piece):
            code = grams(data[i : i + piece + self.depth], self.depth + 1)
            at = self.top.find(code)
            miss = np.flatnonzero(at < 0)
            each = self.cost[at]
            if len(miss):
                each[miss] = self.backed_off(code[miss])
            # position p of ``code`` is the byte i + p + depth of ``data``
            lo, hi = i + self.depth, i + self.depth + len(code)
            first, last = np.searchsorted(starts + sizes, lo, "right"), np.searchsorted(starts, hi, "left")
            rows = np.arange(first, last)
            a, b = np.maximum(starts[rows], lo) - lo, np.minimum(starts[rows] + sizes[rows], hi) - lo
            keep = b > a
            rows, a, b = rows[keep], a[keep], b[keep]
            if len(rows):
                cuts = np.column_stack([a, b]).ravel()
                ends = len(each)
                sums = np.add.reduceat(np.vstack([each, np.zeros((1, each.shape[1]), each.dtype)]), np.minimum(cuts, ends), axis=0, dtype=np.float64)[::2]
                np.add.at(out, rows, sums)
        return out


def sample(docs: DataFrame, text: str, lang: str, usable: Column | None = None) -> dict[str, list[bytes]]:
    """A bounded training sample: the texts with the smallest hashes, some BYTES_PER_LANG of each language.

    Which rows are taken depends on the texts alone, so every run trains the same model.  Copies of a text count once, both for the
    share to take and in the sample, so a text with any number of copies stays within the bound.
    """
    rows = docs.where(F.col(lang).isNotNull() & (F.octet_length(F.col(text)) > 0))
    rows = (rows if usable is None else rows.where(usable)).select(F.col(lang).cast("string").alias("l"), F.left(F.col(text), F.lit(LONGEST)).alias("t"), F.xxhash64(text).alias("h"))
    totals = {r[0]: r[1] for r in rows.groupBy("l", "h").agg(F.max(F.octet_length("t").cast("long")).alias("n")).groupBy("l").agg(F.sum("n")).collect()}
    if not totals:
        return {}
    most = min(BYTES_PER_LANG, BYTES_IN_ALL // len(totals))
    share = F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, min(1.0, most / n))])
    key = F.pmod("h", F.lit(1 << 40)) / float(1 << 40)
    out: dict[str, list[bytes]] = {}
    for name, t in rows.where(key < F.element_at(share, F.col("l"))).select("l", "t").distinct().collect():
        out.setdefault(name, []).append(t.encode("utf-8", "surrogatepass"))
    return {k: sorted(v) for k, v in out.items()}


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> tuple[DataFrame, str, str]:
    """``docs`` with the predicted language and its score; also the names of both columns.

    The score is the probability of the language given the code lengths, all languages being equally likely before.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(held.value) if held.value else None

        def step(texts: pa.Array) -> list:
            plain = texts.to_pylist()
            lang, score = [UND] * len(plain), np.zeros(len(plain))
            rows = [i for i, t in enumerate(plain) if has_letter(t)] if scorer else []
            if rows:
                bits = scorer.bits([plain[i].encode("utf-8", "surrogatepass") for i in rows])
                best = bits.argmin(axis=1)
                over = bits - bits[np.arange(len(rows)), best][:, None]
                score[rows] = 1.0 / np.exp2(-np.minimum(over, 1000.0)).sum(axis=1)
                for i, b in zip(rows, best, strict=True):
                    lang[i] = held.value.langs[b]
            return [pa.array(lang, pa.string()), pa.array(score, pa.float64())]

        return step

    out, (a, b) = append(docs, [text], make, [("lang_pred", "string"), ("score", "double")])
    return out, a, b


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that is never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> tuple[DataFrame, str, str]:
    """Train on the rows outside the held-out fold and predict all rows."""
    samples = sample(docs, text, lang, ~held_out(doc_id))
    return predict(docs, train(samples) if samples else None, text)


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """The documents whose language could be told, with their own columns only.

    The model names the likeliest language of any text and never rejects one: what goes is null text and text without a letter.  With
    nothing to learn from the same rows go, though ``identify`` has no name for the others.
    """
    samples = sample(docs, "text", "lang", ~held_out())
    if samples:
        out, lang, _ = predict(docs, train(samples))
        return out.where(F.col(lang) != UND).select(*docs.columns)
    out, (letters,) = append(docs, ["text"], lambda: lambda texts: [pa.array([has_letter(t) for t in texts.to_pylist()], pa.bool_())], [("has_letter", "boolean")])
    return out.where(letters).select(*docs.columns)
