"""Toxicity by a weighted lexicon that an Aho-Corasick automaton matches.

Texts are folded first: lower case, look-alike letters of other scripts and digits inside words become the letters
that they stand for, everything else becomes one blank.  Lexicon entries are word beginnings.  A hit inside an
exception phrase counts nothing.  The weights of the hits are summed, divided by the logarithm of the text's
length in words, and turned into a score by a logistic curve.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hierspark.llm.util import pieces, stored, texts_of

# Letters of other scripts that look like Latin ones, and characters used in their place.
LOOK_ALIKES = dict(
    zip(
        "аеорсухіјѕԁһԛԝкмтвнαεορυικντχµ",
        "aeopcyxijsdhqwkmtbhaeopuikvtxu",
        strict=True,
    )
)
IN_WORDS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
MIN_PREFIX, MAX_PREFIX = 4, 12


def _folded(point: int) -> int:
    char = chr(point)
    return ord(LOOK_ALIKES.get(char) or (char if char.isalpha() or char in IN_WORDS else " "))


_FOLD = np.array([_folded(i) for i in range(0x30000)] + [ord(" ")], dtype="<u4")
_MIXED = re.compile(r"(?<=[^\W\d_])[0134578@$9]+(?=[^\W\d_])|(?<=[^\W\d_])[01345789$]+|[@$0134578](?=[^\W\d_]{2})")
_SIGNS = re.compile(r"[0134578@$9]")
_UNDO = {ord(k): v for k, v in IN_WORDS.items()}
_DROP = {ord(k): " " for k in IN_WORDS}


def fold_all(texts: list[str]) -> list[str]:
    """Each text as words of letters between blanks, with a blank at both ends.  All texts pass one table look-up."""
    low = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    whole = _FOLD[np.minimum(points, 0x30000)].tobytes().decode("utf-32-le", "replace")
    folded, at = [], 0
    for t in low:
        part = whole[at : at + len(t)]
        at += len(t)
        if _SIGNS.search(part):
            part = _MIXED.sub(lambda m: m[0].translate(_UNDO), part).translate(_DROP)
        folded.append(part)
    return folded


def fold(text: str) -> str:
    return fold_all([text])[0]


@dataclass
class Lexicon:
    """Weights of word beginnings, exception phrases (folded), and the logistic curve."""

    weights: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    slope: float = 1.0
    offset: float = -4.0
    automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"automaton": None}

    def machine(self) -> ahocorasick.Automaton | None:
        if self.automaton is None and self.weights:
            built = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                built.add_word(" " + entry, (entry, weight))
            for phrase in self.exceptions:
                built.add_word(f" {phrase} ", (phrase, None))
            built.make_automaton()
            self.automaton = built
        return self.automaton

    def hits(self, folded: str) -> list[tuple[int, str, float]]:
        """(place of the blank before it, entry, weight) of the hits that no exception phrase holds; at one place the heaviest counts."""
        machine = self.machine()
        if machine is None:
            return []
        found: dict[int, tuple[str, float]] = {}
        spared: list[tuple[int, int]] = []
        for end, (entry, weight) in machine.iter(folded):
            if weight is None:
                spared.append((end - len(entry) - 1, end))
            else:
                begin = end - len(entry)
                if begin not in found or found[begin][1] < weight:
                    found[begin] = (entry, weight)
        return [(b, *hit) for b, hit in found.items() if not any(x <= b and b + len(hit[0]) <= y for x, y in spared)]

    def strength(self, folded: str) -> float:
        """Summed weights over the logarithm of the length in words."""
        hits = self.hits(folded)
        return sum(w for _, _, w in hits) / math.log(math.e + folded.count(" ")) if hits else 0.0

    def score(self, folded: str) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.offset + self.slope * self.strength(folded)))))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word beginnings with the number of toxic and other texts that hold them."""
    toxic, clean = Counter(), Counter()
    for batch in pieces(batches, 0):
        for folded, label in zip(fold_all(texts_of(batch, 0)), batch.column(1).to_pylist()):
            words = set(folded.split())
            (toxic if label else clean).update({w[:n] for w in words for n in range(min(MIN_PREFIX, len(w)), min(MAX_PREFIX, len(w)) + 1)})
    keys = list(toxic.keys() | clean.keys())
    for at in range(0, len(keys), 50_000):
        part = keys[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([toxic[k] for k in part], pa.int64()), pa.array([clean[k] for k in part], pa.int64())], names=["entry", "toxic", "clean"])


def _phrases(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    """Pairs of words around hits with the number of toxic and other texts that hold them."""
    toxic, clean = Counter(), Counter()
    for batch in pieces(batches, 0):
        for folded, label in zip(fold_all(texts_of(batch, 0)), batch.column(1).to_pylist()):
            seen = set()
            for begin, _, _ in lexicon.hits(folded):
                before, after = folded[max(0, begin - 40) : begin].split()[-1:], folded[begin : begin + 80].split()[:2]
                seen.update({" ".join(before + after[:1]), " ".join(after)})
            (toxic if label else clean).update(p for p in seen if " " in p)
    keys = [k for k in clean if not toxic[k]]
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([clean[k] for k in keys], pa.int64()), pa.array([0] * len(keys), pa.int64())], names=["phrase", "clean", "toxic"])
    keys = list(toxic)
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([clean[k] for k in keys], pa.int64()), pa.array([toxic[k] for k in keys], pa.int64())], names=["phrase", "clean", "toxic"])


def _strengths(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 0):
        yield pa.RecordBatch.from_arrays([pa.array([lexicon.strength(t) for t in fold_all(texts_of(batch, 0))], pa.float64()), batch.column(1).cast(pa.int32())], names=["strength", "label"])


def choose(rows: list[tuple[str, int, int]], n_toxic: int, n_clean: int, least_share: float, least_weight: float) -> dict[str, float]:
    """Entries that mark toxic texts, each once: neither a part of a chosen one nor a longer form of it."""
    least = max(3 if n_toxic >= 20 else 2, least_share * n_toxic)
    weighed = []
    for entry, toxic, clean in rows:
        weight = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))
        if toxic >= least and weight >= least_weight:
            weighed.append((toxic, len(entry), entry, weight))
    chosen: dict[str, tuple[int, float]] = {}
    for toxic, _, entry, weight in sorted(weighed, key=lambda x: (-x[0], -x[1], x[2])):
        longer = any(q.startswith(entry) and toxic <= 1.1 * t for q, (t, _) in chosen.items())
        if not longer and not any(entry.startswith(q) for q in chosen):
            chosen[entry] = (toxic, weight)
    return {entry: weight for entry, (_, weight) in chosen.items()}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by damped Newton steps."""
    a = np.column_stack([x, np.ones_like(x)])
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) / len(y) + ridge * w * (1, 0)
        hess = (a * (p * (1 - p))[:, None]).T @ a / len(y) + np.diag([ridge, 1e-9])
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 4 / max(1e-12, np.abs(step).max()))
    return float(w[0]), float(w[1])


def learn(rows: DataFrame, text_col: str = "text", label_col: str = "toxic", least_share: float = 0.015, least_weight: float = 2.5) -> Lexicon:
    """Weights, exceptions and curve from labelled texts (label 1 or 0; NULL labels are left out).

    Equal texts count once.  An entry must be in ``least_share`` of the toxic texts and have a log odds ratio of
    ``least_weight``.  Without texts of both labels nothing is learned and every score is the same low value.
    Bound the rows with ``labelled``: the curve is fitted on the driver, on two numbers a row.
    """
    sample = stored(rows.where(F.col(label_col).isNotNull()).select(F.col(text_col).alias("text"), (F.col(label_col) == 1).cast("int").alias("label")), "toxic-sample").distinct()
    n_toxic, n_all = sample.select(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    if not n_toxic or n_toxic == n_all:
        return Lexicon({})
    counts = sample.mapInArrow(_entries, "entry string, toxic bigint, clean bigint").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    least = max(2, int(least_share * n_toxic))
    good = F.col("toxic") * (n_all - n_toxic + 1) > math.exp(least_weight - 1) * F.col("clean") * (n_toxic + 1)
    found = counts.where((F.col("toxic") >= least) & good).collect()
    lexicon = Lexicon(choose([(r["entry"], r["toxic"], r["clean"]) for r in found], n_toxic, n_all - n_toxic, least_share, least_weight))
    phrases = sample.mapInArrow(lambda b: _phrases(b, lexicon), "phrase string, clean bigint, toxic bigint").groupBy("phrase").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    lexicon = Lexicon(lexicon.weights, frozenset(r["phrase"] for r in phrases.where("toxic = 0 and clean >= 2").collect()))
    points = sample.mapInArrow(lambda b: _strengths(b, lexicon), "strength double, label int").collect()
    slope, offset = logistic(np.array([p["strength"] for p in points]), np.array([float(p["label"]) for p in points]))
    return Lexicon(lexicon.weights, lexicon.exceptions, slope, offset)


def _score(batches: Iterator[pa.RecordBatch], lexicon: Lexicon, prefix: str) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 1):
        scores = [lexicon.score(t) for t in fold_all(texts_of(batch, 1))]
        columns = [batch.column(0), *batch.columns[2:], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[0], *batch.schema.names[2:], f"{prefix}score", f"{prefix}predicted"])


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """Return (id, kept columns, score, predicted), one row per input row; NULL and empty texts have the score of a text without hits.

    Repeated rows are scored each; other columns are ignored.  ``prefix`` goes before the new names.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"), *(F.col(c) for c in keep))
    schema = T.StructType([rows.schema[0], *rows.schema.fields[2:], T.StructField(f"{prefix}score", T.DoubleType()), T.StructField(f"{prefix}predicted", T.IntegerType())])
    return rows.mapInArrow(lambda batches: _score(batches, lexicon, prefix), schema)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 20_000) -> DataFrame:
    """Texts with their labels, cut to about ``max_rows`` labels before the join, so that only their texts move."""
    kept = labels.where(F.col(label_col).isNotNull()).select(id_col, label_col)
    share = min(1.0, max_rows / max(1, kept.count()))
    chosen = kept.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) < math.ceil((1 << 30) * share))
    return docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)
