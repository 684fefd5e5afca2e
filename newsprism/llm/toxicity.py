"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: marks are taken off letters, look-alike letters of other
scripts and digit substitutions become plain Latin letters (``l`` and ``i`` are
one letter, since ``1`` stands for either), and everything between words becomes one blank.  The
automaton finds lexicon entries that start at a word; of several at one
place the longest counts, and an exception phrase found there cancels it.  A text's
score is a logistic function of the matched weight, as a sum and normalised by
the text's length.

The lexicon is learned: entries are word beginnings of 4 to 8 letters and whole words
that stand in significantly more toxic than other texts, with their log odds
as weight; exceptions are entry words, alone or with the next word, that
stand in clean texts.  Learning reads at most ``TRAIN_ROWS`` labelled texts (by
hash of doc_id) and leaves out near copies among them, so it may use fewer: a text goes
only if the smallest doc_id of its label and least 3-word hash agrees with it in
``COPY`` of ``SKETCH`` minwise values; scoring reads whole texts.

Defined results: null and empty texts have no match and get the score of a text
without one; without labels of both kinds every score is 0; a doc_id labelled
twice counts as toxic if one label says so; an empty table gives an empty
table; further columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import write_and_reload
from ..sources.tables import table
from . import textflat
from .groups import bounded_batches
from .registry import register

TRAIN_ROWS, LEXICON, EXCEPTIONS = 16_000, 4_000, 4_000
PREFIXES = range(4, 9)
MIN_Z, MIN_PRECISION, MAX_WEIGHT = 6.0, 0.5, 6.0
THRESHOLD = 0.7
SKETCH, COPY = 32, 20
_SALTS = textflat.mix64(np.arange(1, SKETCH + 1, dtype=np.uint64))

# --- fixed values: look-alike letters (Cyrillic, Greek, others) and substitutions ---
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k",
    "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѡ": "w", "ь": "b",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t",
    "υ": "u", "χ": "x", "ω": "w", "γ": "y", "ı": "i", "ɩ": "i", "ɡ": "g", "ɑ": "a", "ł": "l", "ø": "o", "đ": "d", "ß": "b",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
}
_FOLD = {ord(a): "i" if b == "l" else b for a, b in LOOK_ALIKES.items()} | {ord("l"): "i"} | {
    c: None for c in [*range(0x300, 0x370), 0x200B, 0x200C, 0x200D, 0xFEFF, 0xAD]}
_RUNS = re.compile(r"([@$#*%&!?])\1+")
_GAPS = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """The folded text: words between single blanks, a blank at both ends."""
    if not text:
        return " "
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    return " " + _GAPS.sub(" ", _RUNS.sub(" ", text).lower().translate(_FOLD)).strip() + " "


class Lexicon:
    """Entries with weights, exceptions (weight 0), and the calibration."""

    def __init__(self, entries: dict[str, float], exceptions: list[str] = (), curve: tuple = (0.0, 0.0, -40.0)):
        self.entries, self.exceptions, self.curve, self._automaton = dict(entries), list(exceptions), tuple(curve), None

    def __getstate__(self):
        return self.entries, self.exceptions, self.curve

    def __setstate__(self, state):
        self.__init__(*state)

    @property
    def automaton(self):
        if self._automaton is None:
            import ahocorasick
            self._automaton = ahocorasick.Automaton()
            for word, weight in [*self.entries.items(), *((e, 0.0) for e in self.exceptions)]:
                self._automaton.add_word(word, (len(word), weight))
            if self.entries:
                self._automaton.make_automaton()
        return self._automaton

    def matches(self, folded: str) -> dict[int, tuple[int, float]]:
        """start -> (length, weight) of the longest match there; exceptions cancel."""
        found: dict[int, tuple[int, float]] = {}
        if self.entries:
            for end, (length, weight) in self.automaton.iter(folded):
                start = end - length + 1
                if start not in found or length > found[start][0]:
                    found[start] = (length, weight)
        return {s: m for s, m in found.items() if m[1] > 0}

    def features(self, text: str | None) -> tuple[float, float, int]:
        """(log weight, log weight per hundred words, matches)."""
        folded = fold(text)
        found = self.matches(folded)
        weight = sum(w for _, w in found.values())
        return math.log1p(weight), math.log1p(100 * weight / (folded.count(" ") + 50)), len(found)

    def score(self, total: float, density: float) -> float:
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, a * total + b * density + c))))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, toxic): the bounded sample without near copies.  A text is
    left out for a kept one of the same label only."""
    chosen = (labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))

    def sketches(batches):
        for batch in batches:
            for piece in textflat.pieces(batch, "text"):
                data, off = textflat.flat(piece.column(1))
                starts, ends, doc_words = textflat.words(data, off)
                h = textflat.hash_spans(textflat.padded(textflat.lower_ascii(data)), starts, ends)
                win, at = textflat.window_hashes(h, doc_words, 3)
                cut = np.searchsorted(at, doc_words)
                some = cut[1:] > cut[:-1]
                # a text without a window is its own only value
                least = np.tile(textflat.hash_spans(textflat.padded(data), off[:-1], off[1:])[:, None], (1, SKETCH))
                for k, salt in enumerate(_SALTS if some.any() else ()):
                    least[some, k] = np.minimum.reduceat(textflat.mix64(win ^ salt), cut[:-1][some])
                values = pa.array(least.reshape(-1).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, pa.array(least[:, 0].copy().view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, SKETCH, dtype=np.int32)), values)],
                    names=["doc_id", "text", "toxic", "family", "sketch"])

    # at most ``rows`` ids are broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("toxic").cast("int"))
    marked = write_and_reload(texts.mapInArrow(sketches, "doc_id bigint, text string, toxic int, family bigint, sketch array<bigint>"),
                              "toxic_marked")
    first = marked.groupBy("family", "toxic").agg(F.min(F.struct("doc_id", "sketch")).alias("f"))
    same = F.size(F.filter(F.zip_with("sketch", "f.sketch", lambda a, b: a == b), lambda x: x))
    # at most ``rows`` sketches, then ids, are broadcast
    copies = (marked.select("doc_id", "family", "toxic", "sketch").join(F.broadcast(first), ["family", "toxic"])
              .where((F.col("doc_id") > F.col("f.doc_id")) & (same >= COPY)).select("doc_id"))
    copies = write_and_reload(copies, "toxic_copies")
    return marked.join(F.broadcast(copies), "doc_id", "left_anti").select("doc_id", "text", "toxic")


def _counts(sample: DataFrame, patterns) -> DataFrame:
    """(pattern, toxic, clean): texts that hold each of ``patterns(folded)``."""
    def run(batches):
        for batch in batches:
            toxic, clean = Counter(), Counter()
            for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                (toxic if label else clean).update(patterns(fold(text)))
            keys = list(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()),
                 pa.array([clean[k] for k in keys], pa.int64())], names=["pattern", "toxic", "clean"])

    rows = sample.select("doc_id", "text", "toxic").mapInArrow(run, "pattern string, toxic bigint, clean bigint")
    return rows.groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _beginnings(folded: str) -> set[str]:
    out = set()
    for w in set(folded.split()):
        out.update(" " + w[:n] for n in PREFIXES if n <= len(w))
        if 3 <= len(w) <= 24:
            out.add(f" {w} ")
    return out


def learn(sample: DataFrame) -> Lexicon:
    """The lexicon, its exceptions and its calibration from (doc_id, text, toxic)."""
    held = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(10)) < 3
    fit, calibrate = sample.where(~held), sample.where(held)
    n = {r.toxic: r["count"] for r in fit.groupBy("toxic").count().collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        return Lexicon({})
    p = bad / (bad + good)
    total = F.col("toxic") + F.col("clean")
    z = (F.col("toxic") - total * p) / F.sqrt(total * p * (1 - p))
    found = (_counts(fit, _beginnings).withColumn("z", z).where((F.col("z") >= MIN_Z) & (F.col("toxic") >= MIN_PRECISION * total))
             .orderBy(F.desc("z"), "pattern").limit(LEXICON).collect())

    def weight(r):
        return min(MAX_WEIGHT, math.log((r.toxic + 0.5) / (bad + 1)) - math.log((r.clean + 0.5) / (good + 1)))

    entries: dict[str, float] = {}
    for r in sorted(found, key=lambda r: (len(r.pattern), r.pattern)):
        shorter = [entries[r.pattern[:k]] for k in range(2, len(r.pattern)) if r.pattern[:k] in entries]
        if weight(r) > 0 and (not shorter or weight(r) > shorter[-1] + 1):
            entries[r.pattern] = weight(r)
    lexicon = Lexicon(entries)
    if not entries:
        return lexicon

    def phrases(folded):
        out = set()
        for start in lexicon.matches(folded):
            word = folded.index(" ", start + 1)
            out.add(folded[start:word + 1])
            after = folded.find(" ", word + 1)
            if after > 0:
                out.add(folded[start:after + 1])
        return out

    cleared = (_counts(fit, phrases).where((F.col("clean") >= 3) & (F.col("toxic") <= p * total))
               .orderBy(F.desc("clean"), "pattern").limit(EXCEPTIONS).collect())
    lexicon = Lexicon(entries, [r.pattern for r in cleared if r.pattern not in entries])
    rows = calibrate.select("doc_id", "text", "toxic").mapInArrow(_features(lexicon), _FEATURES).collect()
    lexicon.curve = _calibration(np.array([[r.total, r.density] for r in rows]).reshape(-1, 2),
                                 np.array([float(r.toxic) for r in rows]), p)
    return lexicon


_FEATURES = "doc_id bigint, toxic int, total double, density double, n_matches bigint"


def _features(lexicon: Lexicon):
    def run(batches):
        for batch in batches:
            rows = [lexicon.features(t) for t in batch.column(1).to_pylist()]
            columns = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(columns[0], pa.float64()), pa.array(columns[1], pa.float64()),
                 pa.array(columns[2], pa.int64())], names=["doc_id", "toxic", "total", "density", "n_matches"])
    return run


def _calibration(x: np.ndarray, y: np.ndarray, base: float, ridge: float = 0.05, rounds: int = 50) -> tuple:
    """Logistic fit (Newton, ridge on the slopes) of label on both features; a
    slope that turns negative is left out."""
    use = [0, 1]
    while use:
        a = np.column_stack([x[:, use], np.ones(len(x))])
        w = np.append(np.zeros(len(use)), math.log(base / (1 - base)))
        penalty = np.diag([ridge] * len(use) + [1e-3])
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (q * (1 - q))[:, None]).T @ a + penalty, a.T @ (y - q) - penalty @ w)
            w += np.clip(step, -2, 2)
        if (w[:-1] >= 0).all():
            slopes = [0.0, 0.0]
            for k, v in zip(use, w):
                slopes[k] = float(v)
            return (*slopes, float(w[-1]))
        use.pop(int(np.argmin(w[:-1])))
    return 0.0, 0.0, math.log(base / (1 - base))


def scores(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score, n_matches, matched_weight) of every whole text."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = [lexicon.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([lexicon.score(a, b) for a, b, _ in rows], pa.float64()),
                 pa.array([n for _, _, n in rows], pa.int64()), pa.array([math.expm1(a) for a, _, _ in rows], pa.float64())],
                names=["doc_id", "score", "n_matches", "matched_weight"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(run, "doc_id bigint, score double, n_matches bigint, matched_weight double"))


def held_out(c: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(c).cast("string")) % 3 == 1, F.lit(False))


@register("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out())
    lexicon = learn(labelled_sample(docs, labels))
    return scores(docs, lexicon).select("doc_id", held_out().alias("held_out"), "score",
                                        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_matches", "matched_weight")
