"""Language identification with hyperdimensional profiles.

Every letter has a random +1/-1 vector that follows from the seed and its code point.  An n-gram is the
product of its letters' vectors, each permuted by its place; a text is the sum of its n-grams; a language is the
sum of its texts, each weighted alike.  A document gets the language of the most similar prototype by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hierspark.llm.util import pieces, texts_of

UNKNOWN = "und"
SCALE = 1 << 24
BLOCK = 4096


@dataclass
class Profiles:
    """Prototypes by language: unit vectors of ``dim`` numbers."""

    langs: list[str]
    vectors: np.ndarray
    dim: int
    seed: int


def letter_vector(code: int, dim: int, seed: int) -> np.ndarray:
    """Any code point has a vector of its own; 0 stands for everything that is no letter."""
    return np.random.default_rng((seed, code)).integers(0, 2, dim, dtype=np.int8) * np.int8(2) - np.int8(1)


_LETTER = np.array([chr(i).isalpha() for i in range(0x110000)], dtype=bool)


@dataclass
class Grams:
    """Trigrams of a few texts: for each text the codes, and the letters that the codes number."""

    letters: np.ndarray
    codes: np.ndarray
    begins: np.ndarray
    memo: dict[int, np.ndarray] = field(default_factory=dict)

    def counts(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.codes[self.begins[i] : self.begins[i + 1]], return_counts=True)


def grams(texts: list[str]) -> Grams:
    """Lower-cased letters; each run of other characters, and both ends, is one boundary; a trigram's middle is a letter."""
    low = [t.lower() for t in texts]
    points = np.frombuffer(("\0" + "\0".join(low) + "\0").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int32)
    doc = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
    doc = np.append(doc, len(low) - 1 if low else 0)[: len(points)]
    points = np.where(_LETTER[points], points, 0)
    keep = np.ones(len(points), dtype=bool)
    keep[1:] = (points[1:] != 0) | (points[:-1] != 0)
    points, doc = points[keep], doc[keep]
    seen = np.zeros(0x110000, dtype=bool)
    seen[points] = True
    seen[0] = True
    letters = np.flatnonzero(seen)
    place = np.zeros(0x110000, dtype=np.int32)
    place[letters] = np.arange(len(letters))
    ids = place[points].astype(np.int64)
    middle = np.flatnonzero(points[1:-1] != 0) + 1
    codes = (ids[middle - 1] * len(letters) + ids[middle]) * len(letters) + ids[middle + 1]
    return Grams(letters, codes, np.searchsorted(doc[middle], np.arange(len(low) + 1)))


class Space:
    """Letter vectors on demand, and the sum of weighted n-gram vectors."""

    def __init__(self, dim: int, seed: int):
        self.dim, self.seed, self.known = dim, seed, {}

    def letter_rows(self, letters: np.ndarray) -> np.ndarray:
        for code in letters.tolist():
            if code not in self.known:
                self.known[code] = letter_vector(code, self.dim, self.seed)
        return np.stack([self.known[c] for c in letters.tolist()])

    def vectors(self, codes: np.ndarray, rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        n = len(rows[0])
        return (rows[0][codes // (n * n)] * rows[1][codes // n % n] * rows[2][codes % n]).astype(np.float32)

    def rows(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = self.letter_rows(letters)
        return np.roll(own, 2, axis=1), np.roll(own, 1, axis=1), own

    def bundle(self, codes: np.ndarray, weights: np.ndarray, rows: tuple, kind: type = np.float32) -> np.ndarray:
        total = np.zeros(self.dim, dtype=kind)
        for at in range(0, len(codes), BLOCK):
            total += weights[at : at + BLOCK].astype(kind) @ self.vectors(codes[at : at + BLOCK], rows).astype(kind, copy=False)
        return total


def _learn(batches: Iterator[pa.RecordBatch], dim: int, seed: int) -> Iterator[pa.RecordBatch]:
    space = Space(dim, seed)
    sums: dict[str, np.ndarray] = {}
    for batch in pieces(batches, 0):
        langs = batch.column(1).to_pylist()
        found = grams(texts_of(batch, 0))
        rows = space.rows(found.letters)
        for lang in dict.fromkeys(langs):
            codes, weights = [], []
            for i in (i for i, x in enumerate(langs) if x == lang):
                own = found.codes[found.begins[i] : found.begins[i + 1]]
                if len(own):
                    codes.append(own)
                    weights.append(np.full(len(own), max(1, SCALE // len(own)), dtype=np.float64))
            if codes:
                unique, back = np.unique(np.concatenate(codes), return_inverse=True)
                total = np.bincount(back, np.concatenate(weights))
                # whole numbers far below 2^53: exact whatever texts come together
                sums[lang] = sums.get(lang, 0) + space.bundle(unique, total, rows, np.float64).astype(np.int64)
    for lang, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * dim), pa.array(np.arange(dim, dtype=np.int32)), pa.array(total)], names=["lang", "place", "value"])


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = 1024, seed: int = 7) -> Profiles:
    """Prototypes from all rows with a language; texts without letters count for nothing.

    Every text weighs 2^24, shared out among its n-grams as whole numbers; tasks sum their own documents and Spark adds the
    sums, so prototypes do not depend on how rows are dealt out.  The driver gets ``dim`` numbers a language.  Without labelled text there are no languages.
    """
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sums = rows.mapInArrow(lambda batches: _learn(batches, dim, seed), "lang string, place int, value bigint").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    got = sums.collect()
    langs = sorted({r["lang"] for r in got})
    vectors = np.zeros((len(langs), dim))
    for r in got:
        vectors[langs.index(r["lang"]), r["place"]] = r["value"]
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return Profiles(langs, vectors / np.where(norms > 0, norms, 1), dim, seed)


def _predict(batches: Iterator[pa.RecordBatch], profiles: Profiles, prefix: str) -> Iterator[pa.RecordBatch]:
    space = Space(profiles.dim, profiles.seed)
    prototypes = profiles.vectors.astype(np.float32)
    for batch in pieces(batches, 1):
        found = grams(texts_of(batch, 1))
        rows = space.rows(found.letters)
        table, place = None, None
        if len(found.letters) ** 3 <= 1 << 22:
            used = np.unique(found.codes) if len(found.codes) < 1 << 14 else np.flatnonzero(np.bincount(found.codes, minlength=1))
            if len(used) <= 1 << 14:
                table = space.vectors(used, rows)
                place = np.zeros(len(found.letters) ** 3, dtype=np.int32)
                place[used] = np.arange(len(used))
        langs, scores = [], []
        for i in range(batch.num_rows):
            codes, counts = found.counts(i)
            if not len(codes) or not profiles.langs:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            own = counts.astype(np.float32) @ table[place[codes]] if table is not None else space.bundle(codes, counts, rows)
            cosines = prototypes @ own / (np.linalg.norm(own) or 1.0)
            best = int(np.argmax(cosines))
            langs.append(profiles.langs[best])
            scores.append(float(min(1.0, max(0.0, cosines[best]))))
        columns = [batch.column(0), *batch.columns[2:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[0], *batch.schema.names[2:], f"{prefix}lang_pred", f"{prefix}score"])


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """Return (id, kept columns, lang_pred, score), one row per input row; the score is the cosine, cut at 0.

    NULL and empty texts, texts without letters (of any script), and all texts if nothing was learned, are ``und`` with score 0.
    Equal cosines go to the first language by name.  Other columns are ignored.  ``prefix`` goes before the new names.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"), *(F.col(c) for c in keep))
    schema = T.StructType([rows.schema[0], *rows.schema.fields[2:], T.StructField(f"{prefix}lang_pred", T.StringType()), T.StructField(f"{prefix}score", T.DoubleType())])
    return rows.mapInArrow(lambda batches: _predict(batches, profiles, prefix), schema)
