"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in both directions, gives every byte position a
distribution over the learned languages and pools a text's distribution as
the mean over all its positions.  It is trained in numpy by backpropagation through
time (Adam), with the language of the text as the target of every position.

Training reads a bounded sample: per language ``PER_LANGUAGE`` texts at most
(``BUCKETS`` hash buckets of equal share, so no language is one group), one snippet
of ``SNIPPET`` characters each, at a hashed place.  Prediction reads whole texts: segments
of ``SEGMENT`` bytes run side by side, both directions in one sweep, each warmed up on ``CONTEXT``
bytes before it.  Against one pass over each whole text that changed 95 of 596,748 position labels and
no text's language (250 held-out texts of sf0.01).

Defined results: ``und`` with score 0 if the text is null, holds no letter, or
nothing could be learned; of equally likely languages the first in alphabetical order; equal texts get
equal results up to rounding; an empty table gives an empty
table; further columns pass through the pipeline stage whatever their names are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import table
from . import textflat
from .groups import bounded_batches, free_name
from .registry import register

PER_LANGUAGE, BUCKETS, SNIPPET = 480, 16, 400
HIDDEN, WINDOW, BATCH, STEPS, RATE = 8, 96, 192, 200, 0.02
SEGMENT, CONTEXT, ROWS = 512, 64, 512
#: pipeline stage: a text whose pooled probability is lower is of no one language
MIN_SCORE = 0.5


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)
    return x


class ByteGru:
    """Weights and both passes.  Gates lie side by side: update, reset, candidate."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        k, self.languages, self.hidden = len(languages), languages, hidden
        self.w = {}
        for d in "fb":
            self.w[f"E{d}"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            self.w[f"U{d}"] = rng.normal(0, 0.3, (hidden, 3 * hidden)).astype(np.float32)
            self.w[f"V{d}"] = rng.normal(0, 0.3, (hidden, k)).astype(np.float32)
        self.w["o"] = np.zeros(k, np.float32)

    def states(self, x: np.ndarray, d: str, keep=None, inside: np.ndarray | None = None) -> np.ndarray:
        """Hidden states (time, rows, hidden) over bytes x (time, rows) in the order
        given.  ``keep`` collects what the backward pass needs; outside a text
        (``inside`` false) the state is zero."""
        E, U, n = self.w[f"E{d}"], self.w[f"U{d}"], self.hidden
        steps, rows = x.shape
        out = np.empty((steps, rows, n), np.float32)
        h = np.zeros((rows, n), np.float32)
        partial = None if inside is None else ~inside.all(axis=1)
        for t in range(steps):
            g, u = E[x[t]], h @ U
            zr = g[:, :2 * n]
            zr += u[:, :2 * n]
            zr = _sigmoid(zr)
            z, r = zr[:, :n], zr[:, n:]
            c = u[:, 2 * n:] * r
            c += g[:, 2 * n:]
            c *= 2
            c = _sigmoid(c)
            c *= 2
            c -= 1
            if keep is not None:
                keep.append((h, z.copy(), r.copy(), c.copy(), u[:, 2 * n:].copy()))
            h = h - c
            h *= z
            h += c
            if partial is not None and partial[t]:
                h *= inside[t][:, None]
            out[t] = h
        return out

    def logits(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        return forward @ self.w["Vf"] + backward @ self.w["Vb"] + self.w["o"]

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients over windows x (time, rows) of languages y."""
        kf, kb, n = [], [], self.hidden
        f = self.states(x, "f", kf)
        b = self.states(x[::-1], "b", kb)[::-1]
        p = self.logits(f, b)
        p = np.exp(p - p.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        scale = (weight / (weight.sum() * len(x))).astype(np.float32)
        loss = -float((np.log(p[:, np.arange(len(y)), y] + 1e-9) * scale).sum())
        p[:, np.arange(len(y)), y] -= 1
        p *= scale[None, :, None]
        grad = {"o": p.sum(axis=(0, 1)), "Vf": np.einsum("trh,trk->hk", f, p), "Vb": np.einsum("trh,trk->hk", b, p)}
        for d, kept, seen, dout in (("f", kf, x, p @ self.w["Vf"].T), ("b", kb, x[::-1], (p @ self.w["Vb"].T)[::-1])):
            U = self.w[f"U{d}"]
            dU, dG = np.zeros_like(U), np.empty((*x.shape, 3 * n), np.float32)
            dh = np.zeros((x.shape[1], n), np.float32)
            for t in range(len(x) - 1, -1, -1):
                h, z, r, c, u = kept[t]
                dh = dh + dout[t]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * u * r * (1 - r)
                dG[t] = np.concatenate([dz, dr, dc], axis=1)
                du = np.concatenate([dz, dr, dc * r], axis=1)
                dU += h.T @ du
                dh = dh * z + du @ U.T
            flat, at = dG.reshape(-1, 3 * n), seen.ravel()
            grad[f"U{d}"] = dU
            grad[f"E{d}"] = np.stack([np.bincount(at, flat[:, j], 256) for j in range(3 * n)], axis=1).astype(np.float32)
        return loss, grad

    def fit(self, snippets: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 3) -> list[float]:
        """Adam over random windows; languages weigh the same."""
        rng = np.random.default_rng(seed)
        share = np.bincount(labels, minlength=len(self.languages))
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        losses = []
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(snippets), BATCH)
            x = np.zeros((WINDOW, BATCH), np.uint8)
            for j, i in enumerate(pick):
                s = snippets[i]
                at = int(rng.integers(0, max(1, len(s) - WINDOW + 1)))
                w = np.frombuffer((s[at:at + WINDOW] * (1 + WINDOW // max(1, len(s[at:at + WINDOW]))))[:WINDOW], np.uint8)
                x[:, j] = w
            y = labels[pick]
            loss, grad = self.gradients(x, y, 1.0 / share[y])
            losses.append(loss)
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grad.items():
                m[k] += 0.1 * (g - m[k])
                v2[k] += 0.01 * (g * g - v2[k])
                self.w[k] -= (rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v2[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
        return losses

    def _tables(self):
        """Both directions' weights side by side for the scan: bytes to gates (gate, direction, byte, hidden) as one
        list of rows, and states to gates.  The signs and factors of the sigmoids are multiplied in."""
        n = self.hidden
        factor = np.array([-1, -1, -2], np.float32)[:, None, None]
        E = np.stack([self.w[f"E{d}"].reshape(256, 3, n).transpose(1, 0, 2) * factor for d in "fb"], axis=1)
        U = np.stack([self.w[f"U{d}"].reshape(n, 3, n).transpose(1, 0, 2) * factor for d in "fb"], axis=1)
        return np.ascontiguousarray(E.reshape(-1, n)), np.ascontiguousarray(U)

    def scan(self, x: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Logits (language, position, row) of bytes x (CONTEXT + positions + CONTEXT, rows), both directions in one
        sweep; outside a text (``inside`` false) the state is zero."""
        E, U = self._tables()
        n, rows, steps = self.hidden, x.shape[1], len(x) - CONTEXT
        base = (np.arange(6) * 256).reshape(3, 2, 1)
        seen = np.stack([x[:steps], x[:CONTEXT - 1:-1]], axis=1).astype(np.intp)
        whole = np.stack([inside[:steps], inside[:CONTEXT - 1:-1]], axis=1)
        partial = ~whole.all(axis=(1, 2))
        g, u = np.empty((3, 2, rows, n), np.float32), np.empty((3, 2, rows, n), np.float32)
        at = np.empty((3, 2, rows), np.intp)
        h = np.zeros((2, rows, n), np.float32)
        out = np.empty((2, steps - CONTEXT, rows, n), np.float32)
        (z, r), zr, c = g[:2], g[:2], u[2]
        with np.errstate(over="ignore"):
            for t in range(steps):
                np.add(base, seen[t], out=at)
                np.take(E, at, axis=0, out=g, mode="clip")
                np.matmul(h, U, out=u)
                zr += u[:2]
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                c *= r
                c += g[2]
                np.exp(c, out=c)
                c += 1
                np.reciprocal(c, out=c)
                c *= 2
                c -= 1
                h -= c
                h *= z
                h += c
                if partial[t]:
                    h *= whole[t][:, :, None]
                if t >= CONTEXT:
                    out[:, t - CONTEXT] = h
        both = out[0].reshape(-1, n) @ self.w["Vf"]
        both += out[1, ::-1].reshape(-1, n) @ self.w["Vb"]
        both += self.w["o"]
        return np.ascontiguousarray(both.T).reshape(-1, steps - CONTEXT, rows)

    def positions(self, data: np.ndarray, off: np.ndarray):
        """Yields (segments, text of each, inside, probabilities) for all segments of all
        texts: the distribution of every position (languages, position, segment).  Segments of
        like length run side by side."""
        size = np.diff(off)
        count = -(-size // SEGMENT)
        doc = np.repeat(np.arange(len(size)), count)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        start = off[doc] + nth * SEGMENT
        lo, hi = off[doc], off[doc + 1]
        length = np.minimum(hi - start, SEGMENT)
        order = np.argsort(-length, kind="stable")
        for a in range(0, len(doc), ROWS):
            s = order[a:a + ROWS]
            at = start[s][None, :] + np.arange(-CONTEXT, int(length[s[0]]) + CONTEXT)[:, None]
            inside = (at >= lo[s]) & (at < hi[s])
            p = self.scan(data[np.clip(at, 0, len(data) - 1)], inside)
            inside = inside[CONTEXT:-CONTEXT]
            p -= p.max(axis=0)
            np.exp(p, out=p)
            p /= p.sum(axis=0)
            yield s, doc[s], inside, p

    def pooled(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(mean distribution, share of positions labelled with each language) per text."""
        k, rows = len(self.languages), len(off) - 1
        total, votes = np.zeros((rows, k)), np.zeros((rows, k))
        for _, doc, inside, p in self.positions(data, off):
            top = p.max(axis=0)
            for i in range(k):
                total[:, i] += np.bincount(doc, (p[i] * inside).sum(axis=0), rows)
                votes[:, i] += np.bincount(doc, ((p[i] == top) & inside).sum(axis=0), rows)
        size = np.maximum(np.diff(off), 1)[:, None]
        return total / size, votes / size

    def label_positions(self, text: str) -> list[str]:
        """The language of every byte position of one text."""
        data = np.frombuffer(text.encode(), np.uint8)
        if not len(data) or not self.languages:
            return ["und"] * len(data)
        out: dict[int, list[str]] = {}
        for segment, _, inside, p in self.positions(data, np.array([0, len(data)])):
            best = p.argmax(axis=0)
            for j, k in enumerate(segment.tolist()):
                out[k] = [self.languages[i] for i in best[inside[:, j], j]]
        return [language for k in sorted(out) for language in out[k]]


def sample(docs: DataFrame) -> DataFrame:
    """(lang, snippet): the bounded training sample of (doc_id, text, lang)."""
    length = F.length("text")
    at = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(length - SNIPPET, F.lit(1))).cast("int") + 1
    bucket = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(BUCKETS))
    rows = docs.where("lang IS NOT NULL AND length(text) > 0").select(
        "lang", F.xxhash64("doc_id", "text").alias("h"), bucket.alias("bucket"), F.substring("text", at, F.lit(SNIPPET)).alias("snippet"))
    order = Window.partitionBy("lang", "bucket").orderBy("h", "snippet")
    return (rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= PER_LANGUAGE // BUCKETS)
            .select("lang", "snippet", "h"))


def train(docs: DataFrame) -> ByteGru:
    """The network fitted on the sample of (doc_id, text, lang)."""
    rows = sorted((r.lang, r.h, r.snippet) for r in sample(docs).collect())
    languages = sorted({r[0] for r in rows})
    net = ByteGru(languages)
    if len(languages) > 1:
        net.fit([r[2].encode() for r in rows], np.array([languages.index(r[0]) for r in rows]))
    return net


def predict(docs: DataFrame, net: ByteGru, name: str, carry: list[str] | None = None) -> DataFrame:
    """Rows with the struct ``name``: lang_pred, score and the share of positions
    that carry that language."""
    bounded_batches(docs.sparkSession)
    carry = carry or docs.columns
    result = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("position_share", T.DoubleType())])
    schema = T.StructType([*[docs.schema[c] for c in carry], T.StructField(name, result)])
    letter, languages = free_name(docs, "has_letter"), np.array([*net.languages, "und"], dtype=object)

    def run(batches):
        for batch in batches:
            for piece in textflat.pieces(batch, "text"):
                data, off = textflat.flat(piece.column(piece.schema.get_field_index("text")))
                has = piece.column(piece.schema.get_field_index(letter)).to_numpy(zero_copy_only=False)
                rows = np.arange(len(has))
                if len(net.languages) and len(data):
                    p, votes = net.pooled(data, off)
                    best = p.argmax(axis=1)
                    score, share = np.where(has, p[rows, best], 0.0), np.where(has, votes[rows, best], 0.0)
                    best = np.where(has, best, len(net.languages))
                else:
                    best, score, share = np.full(len(has), len(net.languages)), np.zeros(len(has)), np.zeros(len(has))
                found = pa.StructArray.from_arrays(
                    [pa.array(languages[best], pa.string()), pa.array(np.minimum(score, 1.0)), pa.array(np.minimum(share, 1.0))],
                    names=["lang_pred", "score", "position_share"])
                yield pa.RecordBatch.from_arrays(
                    [*[piece.column(piece.schema.get_field_index(c)) for c in carry], found], names=[*carry, name])

    return (docs.withColumn(letter, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
            .mapInArrow(run, schema))


def in_one_language(docs: DataFrame) -> DataFrame:
    """Pipeline stage: rows with a letter whose pooled score reaches MIN_SCORE."""
    name = free_name(docs, "language")
    net = train(docs.select("doc_id", "text", "lang"))
    found = predict(docs, net, name)
    return found.where((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.score") >= MIN_SCORE)).select(*docs.columns)


@register("op6_byte_gru")
def op6_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    net = train(docs.where(~held_out))
    found = predict(docs, net, "found", carry=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "found.*")
