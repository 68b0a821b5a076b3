"""Language identification by hierarchical discrimination.

Texts become counts of byte trigrams (lower-cased ASCII, everything that is no letter a
space) in DIM hashed places, square-rooted and scaled to length one.  Languages whose mean
vectors are close form families; a linear classifier a family picks the family, and within
it one-versus-one linear support vector machines vote.

The classifiers are fitted on the driver, on a sample of at most SAMPLE labelled rows: of each
language the same number, those with the smallest hashes of doc_id, so that none is left without a row (of
more languages than SAMPLE the most frequent are learned).  Everything else runs where the rows are.

Text that is null or has no letter is `und` with score 0.  Without any labelled row every
text is; with one language every other text is that language.  Rows with a null doc_id
are left out; repeated rows give repeated, equal results.  Of languages with equal votes the surer one wins, and of
equally sure ones the first in alphabetical order.  Texts count whole; a very long one is walked in pieces.  Columns
other than doc_id, text and (for `fit`) lang are not read; `labelled` hands them on.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .shared import binary_text

DIM = 4096
#: Labelled rows the classifiers are fitted on at most.
SAMPLE = 3000
UNKNOWN = "und"

_letter = np.full(256, 0x20, np.uint8)
_letter[0x80:] = np.arange(0x80, 0x100)
for _c in range(ord("a"), ord("z") + 1):
    _letter[_c] = _letter[_c - 32] = _c
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[ord("a") : ord("z") + 1] = _ASCII_LETTER[ord("A") : ord("Z") + 1] = True


#: Bytes of text whose trigrams are counted at once.
PIECE = 4 << 20


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of DIM values for each text."""
    if len(off) == 2 and len(data) > PIECE:  # one very long text: pieces that share two bytes have its trigrams
        cuts = range(0, len(data) - 2, PIECE)
        x = sum(trigrams(data[a : a + PIECE + 2], np.array([0, min(PIECE + 2, len(data) - a)])) for a in cuts)
    else:
        x = trigrams(data, off)
    np.sqrt(x, out=x)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def trigrams(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    n = len(off) - 1
    x = np.zeros((n, DIM), np.float32)
    if len(data) > 2:
        b = _letter[data].astype(np.uint32)
        h = ((b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(20)).astype(np.int64)
        size = np.diff(off)
        row = np.repeat(np.arange(n), size)[: len(h)]
        ok = np.ones(len(h), bool)
        for k in (1, 2):  # trigrams that reach over a text's end
            at = off[1:][size >= k] - k
            ok[at[at < len(h)]] = False
        ok &= h != _SPACES
        x = np.bincount(row[ok] * DIM + h[ok], minlength=n * DIM).reshape(n, DIM).astype(np.float32)
    return x


_SPACES = int((0x20 * (0x9E3779B1 + 0x85EBCA77 + 0xC2B2AE3D)) % 2**32) >> 20


def has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    count = np.append(0, np.cumsum(_ASCII_LETTER[data]))[off]
    out = np.diff(count) > 0
    for i in np.flatnonzero(~out & (np.diff(off) > 0)):
        out[i] = any(c.isalpha() for c in data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, steps: int = 120, reg: float = 1e-4) -> np.ndarray:
    """Weights (with bias last) of squared-hinge machines: a column for each column of y (+1, -1, or 0: left out)."""
    weight = np.zeros_like(y, np.float32)
    for s in (1, -1):  # both sides of a machine weigh the same
        weight += (y == s) / np.maximum((y == s).sum(0), 1)
    w = v = np.zeros((x.shape[1] + 1, y.shape[1]), np.float32)
    rate, t = 0.2, 1.0  # a number of Python's own leaves arrays in 32 bits
    for _ in range(steps):
        pull = weight * y * np.maximum(1 - y * (x @ v[:-1] + v[-1]), 0)
        new = v - rate * (reg * v - np.concatenate([x.T @ pull, pull.sum(0, keepdims=True)]))
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w


def families_of(mean: np.ndarray) -> np.ndarray:
    """Family of each language: the closest two groups are joined until about the square root of the count is left."""
    group = list(range(len(mean)))
    unit = mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)
    while len(set(group)) > max(1, round(len(mean) ** 0.5)):
        ids = sorted(set(group))
        best = max(((min(unit[i] @ unit[j] for i in range(len(group)) if group[i] == a for j in range(len(group)) if group[j] == b), -a, -b) for k, a in enumerate(ids) for b in ids[k + 1 :]))
        group = [-best[1] if g == -best[2] else g for g in group]
    ids = sorted(set(group))
    return np.array([ids.index(g) for g in group])


class Model:
    def __init__(self, langs: list[str], x: np.ndarray, y: np.ndarray):
        self.langs = langs
        if not langs:
            return
        self.family = families_of(np.stack([x[y == k].mean(0) for k in range(len(langs))]))
        self.n_families = int(self.family.max()) + 1
        self.pairs = [(a, b) for a in range(len(langs)) for b in range(a + 1, len(langs)) if self.family[a] == self.family[b]]
        target = [np.where(self.family[y] == f, 1, -1) for f in range(self.n_families)] if self.n_families > 1 else []
        target += [np.where(y == a, 1, np.where(y == b, -1, 0)) for a, b in self.pairs]
        self.w = linear_svm(x, np.stack(target, 1).astype(np.float32)) if target else np.zeros((DIM + 1, 0), np.float32)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language index and a score from 0 to 1 for each row."""
        m = x @ self.w[:-1] + self.w[-1]
        sure = 1 / (1 + np.exp(-3 * np.clip(m, -10, 10)))
        n = len(x)
        family, score = np.zeros(n, np.int64), np.ones(n)
        if self.n_families > 1:
            family = m[:, : self.n_families].argmax(1)
            score = sure[np.arange(n), family].astype(float)
            m, sure = m[:, self.n_families :], sure[:, self.n_families :]
        votes, margin = np.zeros((n, len(self.langs))), np.zeros((n, len(self.langs)))
        for k, (a, b) in enumerate(self.pairs):
            votes[:, a] += m[:, k] > 0
            votes[:, b] += m[:, k] <= 0
            margin[:, a] += sure[:, k]
            margin[:, b] += 1 - sure[:, k]
        inside = self.family[None, :] == family[:, None]
        pick = np.where(inside, votes + margin / (len(self.langs) + 1), -1).argmax(1)
        rivals = np.bincount(self.family, minlength=self.n_families)[family] - 1
        within = np.where(rivals > 0, margin[np.arange(n), pick] / np.maximum(rivals, 1), 1.0)
        return pick, np.clip(score * within, 0.0, 1.0)


def sample_rows(batches):
    for batch in batches:
        data, off = A.column_bytes(batch.column("text"))
        out = []
        for a, b in A.slices(off):
            out += [x.tobytes() for x in (features(data[off[a] : off[b]], off[a : b + 1] - off[a]) * 65535).astype(np.uint16)]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("level"), pa.array(out, pa.binary())], ["lang", "level", "x"])


def fold(folds: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")), F.lit(folds))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the labelled rows (lang not null, text not empty) of docs."""
    rows = docs.where("doc_id is not null and lang is not null and length(text) > 0")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model([], None, None)
    langs = sorted(counts, key=lambda k: (-counts[k], k))[:sample]
    share = max(1, sample // len(langs))
    level = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30))
    kept: dict[str, list[tuple[int, bytes]]] = {k: [] for k in langs}
    for more in (1.2, 8):  # the rows below a level that leaves a little more than `share`; again where chance left fewer
        short = [k for k in langs if len(kept[k]) < min(share, counts[k])]
        if not short:
            break
        bound = F.create_map(*(F.lit(v) for k in short for v in (k, min(1 << 30, math.ceil((more * share + 10) / counts[k] * (1 << 30))))))
        below = rows.withColumn("level", level).where(F.col("level") < bound[F.col("lang")])
        picked = binary_text(below, F.col("lang").cast("string").alias("lang"), "level")
        for k in short:
            kept[k] = []
        for r in picked.mapInArrow(sample_rows, "lang string, level long, x binary").collect():  # some 1.2 * sample rows
            kept[r.lang].append((r.level, bytes(r.x)))
    names = [k for k in sorted(langs) for _ in sorted(kept[k])[:share]]
    x = np.frombuffer(b"".join(v for k in sorted(langs) for _, v in sorted(kept[k])[:share]), np.uint16).reshape(-1, DIM).astype(np.float32)
    x /= 65535
    langs = sorted(set(names))
    return Model(langs, x, np.array([langs.index(n) for n in names]))


def predict_rows(shared):
    def run(batches):
        model: Model = shared.value
        for batch in batches:
            data, off = A.column_bytes(batch.column("text"))
            lang, score = [], []
            for a, b in A.slices(off, 1 << 20):
                d, o = data[off[a] : off[b]], off[a : b + 1] - off[a]
                known = has_letter(d, o) if model.langs else np.zeros(b - a, bool)
                if model.langs:
                    pick, sure = model.predict(features(d, o))
                    lang += [model.langs[p] if k else UNKNOWN for p, k in zip(pick, known)]
                    score.append(np.where(known, sure, 0.0))
                else:
                    lang += [UNKNOWN] * (b - a)
                    score.append(np.zeros(b - a))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(np.concatenate(score) if score else np.zeros(0))], ["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of each document, from its text alone."""
    return binary_text(docs).mapInArrow(predict_rows(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, lang_pred string, score double")


def label_rows(shared, names: list[str]):
    def run(batches):
        predicted = predict_rows(shared)
        for batch in batches:
            (found,) = predicted(iter([pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text")], ["doc_id", "text"])]))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), found.column("lang_pred"), found.column("score")], [*names, "lang_pred", "score"])

    return run


def labelled(docs: DataFrame, model: Model) -> DataFrame:
    """docs with all their columns, and lang_pred and score (which replace columns of these names)."""
    docs = docs.drop("lang_pred", "score").where("doc_id is not null")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(label_rows(shared, docs.columns), f"{schema}, lang_pred string, score double")
