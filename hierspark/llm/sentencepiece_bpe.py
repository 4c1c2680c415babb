"""SentencePiece (merge type) encoding with seeded merge-dropout, and decoding.

Symbols start as characters; the agenda merges the adjacent pair whose joined piece scores best, the leftmost of
equals.  A candidate merge is skipped if a hash of (seed, document, word, place in the word, joined piece) falls below the
dropout rate, so equal seeds give equal segmentations on any partitioning.  Every document draws anew: the more documents
hold a word, the more ways it is split.  Inside a document a word is split alike.  With rate 0 the result is the plain
segmentation.

A segmentation differs from the plain one only if a merge that the plain agenda carries out is skipped: as long as none is, the
best of the remaining candidates is the plain agenda's choice.  So tasks remember the plain segmentation of a word with
its merges, and the agenda runs anew only where the hash of a document skips one of them.

No piece holds a space mark after another character, so words (a run of spaces and what follows) are encoded
one by one.  All distinct words of a slice run through the agenda together, as numpy arrays.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hierspark.llm.util import pieces, texts_of

SPACE = "▁"
NEVER = np.int64(1) << 62
LONG_WORD = 48
M1, M2, M3, M4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


class Pieces:
    """Vocabulary of a model file: characters, bytes, and pairs that join to a piece."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.path, self.size = path, model.get_piece_size()
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(self.size)]
        names = [model.id_to_piece(i) for i in range(self.size)]
        ids = {name: i for i, name in enumerate(names) if not special[i]}
        if any(SPACE in name.lstrip(SPACE) for name in ids):
            raise ValueError("a piece holds a space mark after another character")
        self.byte_ids = np.zeros(256, dtype=np.int64)
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.byte_ids[int(name[1:-1], 16)] = i
        self.char_ids = np.full(0x110000, -1, dtype=np.int64)
        for name, i in ids.items():
            if len(name) == 1:
                self.char_ids[ord(name)] = i
        self.char_ids[ord(SPACE)], self.space = -1, ids[SPACE]
        self.char_ids[ord(" ")] = self.space
        order = {i: r for r, i in enumerate(sorted(ids.values(), key=lambda i: (-model.get_score(i), i)))}
        joined = sorted({(ids[n[:k]] * self.size + ids[n[k:]], order[i] * self.size + i) for n, i in ids.items() for k in range(1, len(n)) if n[:k] in ids and n[k:] in ids})
        self._lay_out(np.array([p for p, _ in joined], dtype=np.int64), np.array([w for _, w in joined], dtype=np.int64))
        self.pair_worth = dict(joined)
        self.bytes = [bytes([int(n[1:-1], 16)]) if model.is_byte(i) else n.replace(SPACE, " ").encode() if i in order else b"" for i, n in enumerate(names)]
        self.byte_flat = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self.byte_counts = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.byte_begins = np.cumsum(self.byte_counts) - self.byte_counts

    def candidates(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """order * size + id of the joined piece; NEVER where there is none."""
        keys = np.where((left < self.size) & (right < self.size), left * self.size + right, -2)
        at = self._slot(keys)
        seen = self.pairs[at]
        out = np.where(seen == keys, self.worth[at], NEVER)
        rest = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & (len(self.pairs) - 1)
            seen = self.pairs[at[rest]]
            hit = seen == keys[rest]
            out[rest[hit]] = self.worth[at[rest[hit]]]
            rest = rest[~hit & (seen >= 0)]
        return out

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * M1) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _lay_out(self, keys: np.ndarray, worth: np.ndarray) -> None:
        """Pairs in a table at most a quarter full, each at its slot or the next free one."""
        self.bits = max(8, int(4 * len(keys)).bit_length())
        self.pairs, self.worth = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, NEVER, dtype=np.int64)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.pairs[at[left]] < 0]
            taken, one = np.unique(at[free], return_index=True)
            self.pairs[taken], self.worth[taken] = keys[free[one]], worth[free[one]]
            left = left[self.pairs[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & (len(self.pairs) - 1)


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def skipped(seeds: np.ndarray, place: np.ndarray, piece: np.ndarray, rate: float) -> np.ndarray:
    """Keyed decision for each candidate."""
    drawn = mix(seeds + place.astype(np.uint64) * M1 + piece.astype(np.uint64) * M4)
    return drawn >> np.uint64(11) < np.uint64(int(rate * (1 << 53)))


def long_word(symbols: list[int], seed: int, vocabulary: Pieces, rate: float) -> list[int]:
    """The same agenda as a heap, for words of many characters."""
    n = len(symbols)
    symbols, before, after = list(symbols), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(at: int) -> None:
        right = after[at]
        if right < n and symbols[at] < vocabulary.size and symbols[right] < vocabulary.size:
            worth = vocabulary.pair_worth.get(symbols[at] * vocabulary.size + symbols[right])
            if worth is not None and not (rate and skipped(np.array([seed], np.uint64), np.array([at]), np.array([worth % vocabulary.size]), rate)[0]):
                heapq.heappush(heap, (worth, at, symbols[at], symbols[right]))

    for at in range(n - 1):
        offer(at)
    while heap:
        worth, at, left, right = heapq.heappop(heap)
        if symbols[at] != left or after[at] >= n or symbols[after[at]] != right:
            continue
        gone = after[at]
        symbols[at], symbols[gone], after[at] = worth % vocabulary.size, -1, after[gone]
        if after[gone] < n:
            before[after[gone]] = at
        offer(at)
        if before[at] >= 0:
            offer(before[at])
    return [s for s in symbols if s >= 0]


def merge(symbols: np.ndarray, begins: np.ndarray, seeds: np.ndarray, vocabulary: Pieces, rate: float, trace: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Segment words given as flat symbols; return flat symbols and their counts by word.

    ``trace`` receives the words, places and pieces of the merges carried out, one tuple a round.
    """
    n_words = len(begins) - 1
    word = np.repeat(np.arange(n_words), np.diff(begins))
    place = np.arange(len(symbols)) - begins[:-1][word]
    done_word, done_place, done_symbol = [], [], []

    def worth_of(at: np.ndarray) -> np.ndarray:
        worth = vocabulary.candidates(symbols[at], symbols[at + 1])
        worth[word[at] != word[at + 1]] = NEVER
        if rate:
            real = np.flatnonzero(worth != NEVER)
            drop = skipped(seeds[word[at[real]]], place[at[real]], worth[real] % vocabulary.size, rate)
            worth[real[drop]] = NEVER
        return worth

    worth = np.append(worth_of(np.arange(len(symbols) - 1)), NEVER) if len(symbols) else np.zeros(0, dtype=np.int64)
    while len(symbols):
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        best = np.minimum.reduceat(worth, first)
        open_ = best != NEVER
        lengths = np.diff(np.append(first, len(symbols)))
        keep = np.repeat(open_, lengths)
        if not keep.all():
            done_word.append(word[~keep])
            done_place.append(place[~keep])
            done_symbol.append(symbols[~keep])
            symbols, word, place, worth = symbols[keep], word[keep], place[keep], worth[keep]
            best, lengths = best[open_], lengths[open_]
            if not len(symbols):
                break
            first = np.cumsum(lengths) - lengths
        equal = np.flatnonzero(worth == np.repeat(best, lengths))
        owner = word[equal]
        at = equal[np.append(True, owner[1:] != owner[:-1])]
        symbols[at] = best % vocabulary.size
        if trace is not None:
            trace.append((word[at], place[at], symbols[at]))
        alive = np.ones(len(symbols), dtype=bool)
        alive[at + 1] = False
        moved = np.cumsum(alive) - 1
        at = moved[at]
        symbols, word, place, worth = symbols[alive], word[alive], place[alive], worth[alive]
        again = np.concatenate([at[at + 1 < len(symbols)], at[at > 0] - 1])
        worth[at] = NEVER
        worth[again] = worth_of(again)
        worth[-1] = NEVER
    if not done_word:
        return symbols, np.zeros(n_words, dtype=np.int64)
    words, places, found = (np.concatenate(x) for x in (done_word, done_place, done_symbol))
    order = np.lexsort((places, words))
    return found[order], np.bincount(words, minlength=n_words)


def spans_take(flat: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenate flat[b : b + c] for all b, c."""
    total = int(counts.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(counts)
    return flat[np.arange(total) - np.repeat(ends - counts, counts) + np.repeat(begins, counts)]


def symbols_of(points: np.ndarray, begins: np.ndarray, counts: np.ndarray, vocabulary: Pieces) -> np.ndarray:
    """Flat symbols of the words at these places: piece ids of the characters, code points beyond the vocabulary for others."""
    chars = spans_take(points, begins, counts)
    symbols = vocabulary.char_ids[chars]
    return np.where(symbols < 0, chars + vocabulary.size, symbols)


def segment(points: np.ndarray, begins: np.ndarray, counts: np.ndarray, seeds: np.ndarray, vocabulary: Pieces, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Flat symbols of the words at these places, and their counts by word."""
    symbols = symbols_of(points, begins, counts, vocabulary)
    short = counts <= LONG_WORD
    mask = np.repeat(short, counts)
    found, n_found = merge(symbols[mask], np.append(0, np.cumsum(counts[short])), seeds[short], vocabulary, rate)
    at = np.cumsum(counts) - counts
    extra = [np.array(long_word(symbols[at[i] : at[i] + counts[i]].tolist(), int(seeds[i]), vocabulary, rate), dtype=np.int64) for i in np.flatnonzero(~short)]
    flat = np.concatenate([found, *extra])
    n_symbols = np.zeros(len(seeds), dtype=np.int64)
    n_symbols[short], n_symbols[~short] = n_found, [len(x) for x in extra]
    place = np.zeros(len(seeds), dtype=np.int64)
    place[short] = np.cumsum(n_found) - n_found
    place[~short] = len(found) + np.cumsum([0, *(len(x) for x in extra)])[:-1]
    return spans_take(flat, place, n_symbols), n_symbols


class Known:
    """Segmentations of this task's earlier words, by seed; forgotten when there are too many."""

    def __init__(self) -> None:
        self.seeds, self.place, self.counts, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def missing(self, unique: np.ndarray) -> np.ndarray:
        if len(self.seeds) + len(unique) > KEPT_WORDS:
            self.__init__()
        at = np.searchsorted(self.seeds, unique)
        return np.flatnonzero((at == len(self.seeds)) | (self.seeds[np.minimum(at, len(self.seeds) - 1)] != unique)) if len(self.seeds) else np.arange(len(unique))

    def add(self, seeds: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> None:
        at = np.searchsorted(self.seeds, seeds)
        self.place = np.insert(self.place, at, len(self.flat) + np.cumsum(counts) - counts)
        self.counts = np.insert(self.counts, at, counts)
        self.seeds = np.insert(self.seeds, at, seeds)
        self.flat = np.append(self.flat, flat.astype(np.int32))

    def find(self, unique: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.seeds, unique)
        return self.place[at], self.counts[at]


class Plain:
    """Plain segmentations of this task's earlier words with their merges, by word hash; forgotten when there are too many."""

    def __init__(self) -> None:
        self.words = np.zeros(0, np.uint64)
        self.begins, self.counts, self.merge_begins, self.merge_counts = (np.zeros(0, np.int64) for _ in range(4))
        self.flat, self.merges = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def find(self, words: np.ndarray, points: np.ndarray, begins: np.ndarray, counts: np.ndarray, vocabulary: Pieces) -> np.ndarray:
        """Rows of these distinct words, in ascending order of hash; new ones are segmented first."""
        if len(self.words) + len(words) > KEPT_PLAIN:
            self.__init__()
        at = np.searchsorted(self.words, words)
        new = np.flatnonzero(np.append(self.words, words[-1:])[at] != words) if len(self.words) else np.arange(len(words))
        new = np.union1d(new, np.flatnonzero(at == len(self.words)))
        if len(new):
            self._add(words[new], at[new], points, begins[new], counts[new], vocabulary)
            at = np.searchsorted(self.words, words)
        return at

    def _add(self, words: np.ndarray, at: np.ndarray, points: np.ndarray, begins: np.ndarray, counts: np.ndarray, vocabulary: Pieces) -> None:
        trace: list[tuple] = [(np.zeros(0, np.int64),) * 3]
        flat, n_symbols = merge(symbols_of(points, begins, counts, vocabulary), np.append(0, np.cumsum(counts)), words, vocabulary, 0.0, trace)
        owner, place, piece = (np.concatenate(x) for x in zip(*trace))
        n_merges = np.bincount(owner, minlength=len(words))
        self.begins = np.insert(self.begins, at, len(self.flat) + np.cumsum(n_symbols) - n_symbols)
        self.merge_begins = np.insert(self.merge_begins, at, len(self.merges) + np.cumsum(n_merges) - n_merges)
        self.counts, self.merge_counts = np.insert(self.counts, at, n_symbols), np.insert(self.merge_counts, at, n_merges)
        self.words = np.insert(self.words, at, words)
        self.flat = np.append(self.flat, flat.astype(np.int32))
        self.merges = np.append(self.merges, ((piece << 6) + place)[np.argsort(owner, kind="stable")].astype(np.int32))

    def kept(self, rows: np.ndarray, seeds: np.ndarray, rate: float) -> np.ndarray:
        """Whether no merge of the word in this row is skipped under this seed."""
        n = self.merge_counts[rows]
        merges = spans_take(self.merges, self.merge_begins[rows], n)
        drop = np.flatnonzero(skipped(np.repeat(seeds, n), merges & 63, merges >> 6, rate))
        out = np.ones(len(rows), dtype=bool)
        out[np.searchsorted(np.cumsum(n), drop, "right")] = False
        return out


WORDS: dict[tuple, Known] = {}
PLAIN: dict[str, Plain] = {}
KEPT_WORDS = 1_500_000
KEPT_PLAIN = 600_000


def drawn(points: np.ndarray, begins: np.ndarray, counts: np.ndarray, words: np.ndarray, seeds: np.ndarray, vocabulary: Pieces, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat symbols, and where in them each word's are: the plain ones unless a merge of the word is skipped, else anew."""
    plain = PLAIN.setdefault(vocabulary.path, Plain())
    short = np.flatnonzero(counts <= LONG_WORD)
    distinct, first, back = np.unique(words[short], return_index=True, return_inverse=True)
    rows = plain.find(distinct, points, begins[short[first]], counts[short[first]], vocabulary)[back]
    same = plain.kept(rows, seeds[short], rate) if rate else np.ones(len(rows), dtype=bool)
    anew = np.ones(len(words), dtype=bool)
    anew[short[same]] = False
    place, n_symbols = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
    place[short[same]], n_symbols[short[same]] = plain.begins[rows[same]], plain.counts[rows[same]]
    found, n_found = segment(points, begins[anew], counts[anew], seeds[anew], vocabulary, rate)
    place[anew], n_symbols[anew] = len(plain.flat) + np.cumsum(n_found) - n_found, n_found
    return np.append(plain.flat, found), place, n_symbols


def encode_texts(texts: list[str], variants: np.ndarray, vocabulary: Pieces, rate: float, seed: int, remember: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of all texts and their counts by text; ``remember`` keeps segmentations, where variants or words recur."""
    sizes = np.array([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
    points = np.frombuffer("".join(" " + t for t in texts if t).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    if not len(points):
        return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
    text_begins = np.cumsum(sizes) - sizes
    blank = points == ord(" ")
    starts = blank.copy()
    starts[1:] &= ~blank[:-1]
    starts[text_begins[sizes > 0]] = True
    begins = np.flatnonzero(starts)
    ends = np.append(begins[1:], len(points))
    owner = np.repeat(np.arange(len(texts)), sizes)[begins]
    with np.errstate(over="ignore"):
        powers = np.full(int((ends - begins).max()), M1 | np.uint64(1), dtype=np.uint64).cumprod()
        local = np.arange(len(points)) - np.repeat(begins, ends - begins)
        hashes = mix(np.add.reduceat(mix(points.astype(np.uint64) + M4) * powers[local], begins) + (ends - begins).astype(np.uint64) * M3)
        seeds = mix(hashes ^ mix(np.uint64(seed) + variants[owner] * M1)) if rate else hashes
    unique, first, back = np.unique(seeds, return_index=True, return_inverse=True)
    if remember:
        known = WORDS.setdefault((vocabulary.path, rate, seed), Known())
        new = known.missing(unique)
        known.add(unique[new], *segment(points, begins[first[new]], (ends - begins)[first[new]], unique[new], vocabulary, rate))
        flat, (place, n_symbols) = known.flat, known.find(unique)
    else:
        flat, place, n_symbols = drawn(points, begins[first], (ends - begins)[first], hashes[first], unique, vocabulary, rate)
    ids = spans_take(flat, place[back], n_symbols[back]).astype(np.int64)
    by_text = np.bincount(owner, n_symbols[back], minlength=len(texts)).astype(np.int64)
    odd = np.flatnonzero(ids >= vocabulary.size)
    if len(odd):
        fallback = [vocabulary.byte_ids[list(chr(c - vocabulary.size).encode("utf-8", "surrogatepass"))] for c in ids[odd].tolist()]
        widths = np.ones(len(ids), dtype=np.int64)
        widths[odd] = [len(b) for b in fallback]
        text_of = np.repeat(np.arange(len(texts)), by_text)
        wide = np.repeat(ids, widths)
        wide[np.repeat(ids >= vocabulary.size, widths)] = np.concatenate(fallback)
        ids, by_text = wide, np.bincount(text_of, widths, minlength=len(texts)).astype(np.int64)
    return ids.astype(np.int32), by_text


def decode_ids(ids: list[int], vocabulary: Pieces) -> str:
    """The text of ids; the mark before the first word goes, ids of no text (control, unknown) are empty."""
    whole = b"".join([vocabulary.bytes[i] for i in ids]).decode("utf-8", "replace")
    return whole[1:] if whole.startswith(" ") else whole


def _encode(batches: Iterator[pa.RecordBatch], path: str, rate: float, seed: int, remember: bool) -> Iterator[pa.RecordBatch]:
    vocabulary = load(path)
    for batch in pieces(batches, 1, 1 << 18):
        variants = batch.column(2).to_numpy().view(np.uint64)
        ids, counts = encode_texts(texts_of(batch, 1), variants, vocabulary, rate, seed, remember)
        listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(ids))
        yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[3:], listed], names=[batch.schema.names[0], *batch.schema.names[3:], "ids"])
    WORDS.clear()
    PLAIN.clear()  # an idle worker keeps its memory, and the next task learns as cheaply


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.1, seed: int = 13, variants: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Return (id, kept columns, ids array<int>), one row per input row.

    ``model`` is a SentencePiece model file of merge type with byte fallback, present on every machine.  NULL and empty
    texts have no ids.  Characters outside the vocabulary, and the space mark itself, become bytes.  A document
    draws its merges by a hash of its id, or by that hash modulo ``variants``, where a bounded number of segmentations of a
    word is wanted; repeated rows have equal ids, as have equal texts without an id.
    """
    drawn = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(seed))
    variant = (drawn if variants is None else F.pmod(drawn, F.lit(variants)).cast("bigint")).alias("__variant")
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"), variant, *(F.col(c) for c in keep))
    schema = T.StructType([rows.schema[0], *rows.schema.fields[3:], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(lambda batches: _encode(batches, model, rate, seed, variants is not None or not rate), schema)


def decode_lists(ids: np.ndarray, counts: np.ndarray, vocabulary: Pieces) -> pa.Array:
    """The texts of flat ids with so many for each text, as ``decode_ids`` gives them."""
    sizes = vocabulary.byte_counts[ids]
    data = spans_take(vocabulary.byte_flat, vocabulary.byte_begins[ids], sizes)
    ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))]
    starts = ends[:-1][np.diff(ends) > 0]
    marks = starts[data[starts] == ord(" ")]
    ends -= np.searchsorted(marks, ends)
    found = pa.Array.from_buffers(pa.string(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.delete(data, marks))])
    try:
        found.validate(full=True)
    except pa.ArrowInvalid:  # byte pieces that are no characters
        places = np.append(0, np.cumsum(counts)).tolist()
        return pa.array([decode_ids(ids[b:e].tolist(), vocabulary) for b, e in zip(places, places[1:])], pa.string())
    return found


def _decode(batches: Iterator[pa.RecordBatch], path: str, kept: list[int]) -> Iterator[pa.RecordBatch]:
    vocabulary = load(path)
    for batch in batches:
        counts = pa.compute.fill_null(pa.compute.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff((np.cumsum(counts) - counts) // (1 << 19))) + 1
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            part = batch.slice(begin, end - begin)
            texts = decode_lists(part.column(1).flatten().to_numpy(), counts[begin:end], vocabulary)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), texts], names=[*(part.schema.names[i] for i in kept), "decoded"])


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Return (id, kept columns, decoded) of rows with ids; NULL ids decode to an empty text.  Kept ``ids`` are sent to Python once."""
    rows = encoded.select(F.col(id_col), F.col("ids"), *(F.col(c) for c in keep if c != "ids"))
    kept = [0, *(1 if c == "ids" else rows.columns.index(c, 2) for c in keep)]
    schema = T.StructType([*(rows.schema[i] for i in kept), T.StructField("decoded", T.StringType())])
    return rows.mapInArrow(lambda batches: _decode(batches, model, kept), schema)
