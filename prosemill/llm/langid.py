"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read a text's bytes from the left and from the right;
a softmax over both states labels every position with a language (letters, white
space and marks alike), and a document's probabilities are the mean over all its
positions. A text is read in windows of ``window`` bytes with ``context`` further
bytes on either side, which carry the states but are not counted, so every byte
is labelled once, with its surroundings. The network is trained here, in numpy,
by backpropagation through time on a bounded sample of labelled rows
(``docs_per_lang`` documents of each language and ``windows_per_doc`` windows of
``span`` bytes of each of those).

Scale: one pass without a shuffle of text; the sample and the weights (a few
thousand numbers) are all that leaves or reaches an executor. Work and memory
are linear in the bytes of a text, in batches of a fixed number of windows.

Defined results: a null text or one without a letter is `und` with score 0; so
is every text when no labelled row exists; repeated rows repeat; a null id is
never held out and never learned from; a null language is never learned; ties go
to the first language by name; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textops as T


@dataclass(frozen=True)
class LangRules:
    window: int = 256
    context: int = 16
    hidden: int = 8
    #: Bounds of the labelled sample.
    docs_per_lang: int = 400
    windows_per_doc: int = 8
    span: int = 64
    steps: int = 400
    batch: int = 128
    rate: float = 0.02
    seed: int = 5
    #: Documents with a lower pooled probability are rejected by the filter.
    min_score: float = 0.4


#: A byte that UTF-8 never uses, in place of what a window has not.
PAD = 0xFF
#: Windows read at once.
_TOGETHER = 2048


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class ByteGru:
    """Weights by name: per direction d, input table ``w{d}`` [256, 3H] and recurrent ``u{d}`` [H, 3H]; ``v`` [2H, C], ``c`` [C]."""

    def __init__(self, langs: list[str], rules: LangRules):
        self.langs, self.rules = langs, rules
        h, rng = rules.hidden, np.random.RandomState(rules.seed)  # noqa: NPY002
        make = lambda *shape, by: (rng.randn(*shape) * by).astype(np.float32)
        self.p = {"w0": make(256, 3 * h, by=0.3), "u0": make(h, 3 * h, by=0.3), "w1": make(256, 3 * h, by=0.3), "u1": make(h, 3 * h, by=0.3), "v": make(2 * h, len(langs), by=0.3), "c": np.zeros(len(langs), np.float32)}

    def _run(self, x: np.ndarray, d: int, kept: list | None = None) -> np.ndarray:
        """States [T, H, N] of direction ``d`` over bytes [T, N], in the order of positions; padding leaves the state at zero.

        Windows are the last axis, so that every step works on whole rows.
        """
        w, u, hs = np.ascontiguousarray(self.p[f"w{d}"].T), np.ascontiguousarray(self.p[f"u{d}"].T), self.rules.hidden
        steps, n = x.shape
        out = np.empty((steps, hs, n), np.float32)
        h = np.zeros((hs, n), np.float32)
        real = (x != PAD).astype(np.float32)
        whole = real.all(1)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            g = np.take(w, x[t], axis=1)
            a = u @ h
            gates = g[: 2 * hs]
            gates += a[: 2 * hs]
            z, r = np.split(_sigmoid(gates), 2)
            new = r * a[2 * hs :]
            new += g[2 * hs :]
            np.tanh(new, out=new)
            if kept is not None:
                kept.append((t, h, z, r, new, a[2 * hs :]))
            h = np.subtract(h, new, out=out[t])
            h *= z
            h += new
            if not whole[t]:
                h *= real[t]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """[T, C, N]: the label probabilities of every position of windows [T, N]."""
        return self._softmax(self._run(x, 0), self._run(x, 1))

    def _softmax(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        hs = self.rules.hidden
        s = self.p["v"][:hs].T @ forward
        s += self.p["v"][hs:].T @ backward
        s += self.p["c"][:, None]
        s -= s.max(1, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(1, keepdims=True)
        return s

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean loss of all positions that are no padding, for windows [T, N] with a label each."""
        steps, n = x.shape
        hs = self.rules.hidden
        kept: tuple[list, list] = ([], [])
        states = [self._run(x, d, kept[d]) for d in (0, 1)]
        ds = self._softmax(*states)
        ds[:, y, np.arange(n)] -= 1
        seen = (x != PAD).astype(np.float32)
        ds *= (seen / max(float(seen.sum()), 1.0))[:, None, :]
        grad = {"v": np.concatenate([(s @ ds.transpose(0, 2, 1)).sum(0) for s in states]), "c": ds.sum((0, 2))}
        order = np.argsort(x, axis=None, kind="stable")
        sorted_bytes = x.ravel()[order]
        first = np.flatnonzero(np.concatenate(([True], sorted_bytes[1:] != sorted_bytes[:-1])))
        for d in (0, 1):
            u = self.p[f"u{d}"]
            back = self.p["v"][d * hs : (d + 1) * hs] @ ds
            gu, gw = np.zeros_like(u), np.zeros_like(self.p[f"w{d}"])
            into = np.empty((steps, 3 * hs, n), np.float32)
            carry = np.zeros((hs, n), np.float32)
            for t, h, z, r, new, a in reversed(kept[d]):
                dh = (back[t] + carry) * seen[t]
                dz = dh * (h - new) * z * (1 - z)
                dn = dh * (1 - z) * (1 - new * new)
                dr = dn * a * r * (1 - r)
                da = np.concatenate((dz, dr, dn * r))
                gu += h @ da.T
                carry = dh * z + u @ da
                into[t] = np.concatenate((dz, dr, dn))
            gw[sorted_bytes[first]] = np.add.reduceat(into.transpose(0, 2, 1).reshape(-1, 3 * hs)[order], first)
            grad[f"u{d}"], grad[f"w{d}"] = gu, gw
        return grad

    def train(self, windows: np.ndarray, y: np.ndarray) -> ByteGru:
        """Adam on batches of windows [N, span], languages drawn evenly."""
        rules, rng = self.rules, np.random.RandomState(self.rules.seed)  # noqa: NPY002
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        own = [o for c in range(len(self.langs)) if len(o := np.flatnonzero(y == c))]
        for step in range(1, rules.steps + 1):
            pick = np.concatenate([rng.choice(o, max(1, rules.batch // len(own))) for o in own])
            for k, g in self.gradients(windows[pick].T, y[pick]).items():
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.01 * (g * g - s[k])
                rate = rules.rate * min(1.0, 2 * (1 - step / (rules.steps + 1)))
                self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def pooled(self, t: T.Texts) -> np.ndarray:
        """[rows, C]: mean label probabilities over all positions of each row; zeros for a row without any."""
        window, context = self.rules.window, self.rules.context
        size = np.diff(t.bounds)
        count = -(-size // window)
        row = np.repeat(np.arange(len(t)), count)
        start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * window + t.bounds[:-1][row]
        out = np.zeros((len(t), len(self.langs)))
        for a in range(0, len(row), _TOGETHER):
            r, at = row[a : a + _TOGETHER], start[a : a + _TOGETHER]
            length = int(np.minimum(window, t.bounds[r + 1] - at).max())  # windows of short texts only: no longer than those
            x, counted = read_windows(t, r, at - context, length + 2 * context), slice(context, context + length)
            p = (self.probabilities(x)[counted] * (x[counted] != PAD)[:, None, :]).sum(0, dtype=np.float64)
            for j in range(out.shape[1]):
                out[:, j] += np.bincount(r, p[j], len(t))
        return out / np.maximum(size, 1)[:, None]


def read_windows(t: T.Texts, row: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """[length, N]: the bytes of each window from ``start`` on, with padding outside its row."""
    at = start + np.arange(length)[:, None]
    inside = (at >= t.bounds[row]) & (at < t.bounds[row + 1])
    return np.where(inside, t.data[np.where(inside, at, 0)], np.uint8(PAD)) if len(t.data) else np.full(at.shape, PAD, np.uint8)


def held_out(id_col: str) -> Column:
    """True for ids whose crc32 as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def has_letter(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rules: LangRules | None = None) -> ByteGru:
    """Train on the rows that are not held out; reads a bounded sample of them."""
    rules = rules or LangRules()
    T.prepare(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out("id"))
    # a share of each language first, by hash, so that the ranking below sees a few times the sample whatever the input
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col("lang") == r.lang, min(1.0, 4 * rules.docs_per_lang / r.n)).otherwise(share)
    part = rows.select("id", "lang").filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id", F.lit(1)), "id")
    picked = part.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= rules.docs_per_lang).select("id").distinct()
    sample = rows.join(F.broadcast(picked), "id").filter(has_letter("text"))  # docs_per_lang ids of each language

    def cut(batches):
        for b in T.chunks(batches, "text"):
            t = T.texts(b.column("text"))
            ids, n = b.column("order").to_numpy(), np.diff(t.bounds)
            offset = [np.random.RandomState(i & 0x7FFFFFFF).randint(0, max(size - rules.span, 0) + 1, rules.windows_per_doc) for i, size in zip(ids.tolist(), n.tolist(), strict=True)]  # noqa: NPY002
            row = np.repeat(np.arange(len(t)), rules.windows_per_doc)
            x = read_windows(t, row, t.bounds[row] + np.concatenate(offset), rules.span)
            # every other window is cut short, as short texts are
            cut_at = np.where(np.arange(len(row)) % 2, rules.span, 4 + (ids[row] ^ np.arange(len(row))) % max(rules.span - 4, 1))
            x[np.arange(rules.span)[:, None] >= cut_at] = PAD
            langs = b.column("lang").take(pa.array(row))
            yield pa.RecordBatch.from_arrays([langs, pa.array(ids[row]), pa.array([w.tobytes() for w in np.ascontiguousarray(x.T)], pa.binary())], names=["lang", "order", "window"])

    found = sorted({(r[0], r[1], bytes(r[2])) for r in sample.select("lang", F.xxhash64("id").alias("order"), "text").mapInArrow(cut, "lang string, order bigint, window binary").collect()})
    langs = sorted({r[0] for r in found})
    model = ByteGru(langs, rules)
    if len(langs) < 2:
        return model
    windows = np.frombuffer(b"".join(r[2] for r in found), np.uint8).reshape(len(found), rules.span)
    return model.train(windows, np.array([langs.index(r[0]) for r in found]))


def _predictor(model: ByteGru):
    def predict(t: T.Texts, letters: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not model.langs:
            return ["und"] * len(t), np.zeros(len(t))
        p = model.pooled(t)
        best = p.argmax(1)
        score = np.where(letters, np.clip(p[np.arange(len(t)), best], 0, 1), 0.0)
        return [model.langs[k] if ok else "und" for k, ok in zip(best.tolist(), letters.tolist(), strict=True)], score

    return predict


def identify(df: DataFrame, model: ByteGru, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``held_out``, ``lang_pred`` and ``score``."""
    T.prepare(df.sparkSession)
    wanted = df.select(F.col(id_col).alias("__id"), held_out(id_col).alias("held_out"), has_letter(text_col).alias("__letter"), F.col(text_col).cast("string").alias("__text"))

    def run(batches):
        predict = _predictor(model)
        for b in T.chunks(batches, "__text"):
            lang, score = predict(T.texts(b.column("__text")), b.column("__letter").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column("__id"), b.column("held_out"), pa.array(lang), pa.array(score)], names=["__id", "held_out", "lang_pred", "score"])

    return wanted.mapInArrow(run, f"__id {wanted.schema['__id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double").withColumnRenamed("__id", id_col)


def filter_languages(docs: DataFrame, model: ByteGru, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that have a language with at least ``min_score``, with the same columns."""
    T.prepare(docs.sparkSession)
    schema = docs.schema
    marked = docs.withColumn("__letter_found", has_letter(text_col))

    def run(batches):
        predict = _predictor(model)
        for b in T.chunks(batches, text_col):
            lang, score = predict(T.texts(b.column(text_col)), b.column(b.num_columns - 1).to_numpy(zero_copy_only=False))
            keep = np.array([x != "und" for x in lang], bool) & (score >= model.rules.min_score)
            kept = b.filter(pa.array(keep)).select(range(b.num_columns - 1))
            if kept.num_rows:
                yield kept

    return marked.mapInArrow(run, schema)
