"""Jaccard self-join of word n-gram sets with token-combination prefixes, and the groups that its links make.

Tokens are shingle hashes.  Two sets of similarity t miss at most e = (1 - t) * size of each other's tokens.  All sets
order their tokens alike, tokens that one set alone holds first, then rare before frequent.  A prefix of one set
is long enough once its tokens could not all be missing: a token of a rare class counts 1, and the tokens of one part of
a class of k-combinations count what they are more than k - 1.  When the counts reach e + 1, similar sets share a token
of a rare class, or k tokens of one part of a frequent class, inside both prefixes.  These are the signatures.

The parts of a class follow from the token's hash and from the band of the set's size, so a part of a prefix
holds a few tokens however long the document, and the number of signatures is proportional to its length.

Only a fixed part of the tokens, drawn by hash, is counted; it comes first in the order, the other tokens follow as
singles where a prefix needs them.  A set with more than e counted tokens of its own has no partner at all and goes
no further; that is nearly every document.

Sets of equal tokens are one class.  Members of a bucket are first verified against a few pivots, which are plain
aggregates; their links make groups.  Then pairs of a bucket that are still in different groups, and that sizes and parity
bits allow, are verified too.  A pair leaves a bucket only if none of the first few signatures of both is common and
smaller, so it rarely leaves more than once.  At last the links of every class are counted inside its component, by products
of incidence matrices.  Buckets and components of any size are cut into square tiles of a bounded number of
members, so no task gets a whole group and the pairs of a group never become rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hierspark.llm.graph import components
from hierspark.llm.shingles import mix, parity_bits, set_keys, shingle_sets
from hierspark.llm.util import broadcast_up_to, pieces, stored, texts_of

#: (most sets of a token, tokens of a signature, parts of the class for each missing token)
CLASSES = ((32, 1, 0.0), (1024, 2, 0.5), (None, 3, 0.35))
EIGHTHS = 8
BITS = 8
PIVOTS = 4
#: Members of a tile's side, and columns of an incidence matrix.
TILE, COLUMNS = 512, 4096
FIRST = 8
LAST = 1 << 62
#: Tokens that a task handles at a time.
SLICE = 1 << 18
BROADCAST_SETS = 2_000_000


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 1):
        sets = shingle_sets(texts_of(batch, 1), width)
        keys = [set_keys(s) for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())], names=["id", "n", "key", "key2"])


def counted(found: np.ndarray, eighths: int) -> np.ndarray:
    """Which tokens are counted: a fixed part of all hashes."""
    return (mix(found) >> np.uint64(61)) < np.uint64(eighths)


def _tokens(batches: Iterator[pa.RecordBatch], width: int, eighths: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 0):
        parts, keys, sizes = [], [], []
        for found in shingle_sets(texts_of(batch, 0), width):
            own = found[counted(found, eighths)]
            if len(own):
                parts.append(own)
                keys.append(set_keys(found)[0])
                sizes.append(len(own))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), pa.array(np.repeat(np.array(keys, np.int64), sizes))], names=["token", "key"])


def _kept(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 1):
        sets = shingle_sets(texts_of(batch, 1), width)
        keys = [set_keys(s) for s in sets]
        good = [i for i, k in enumerate(keys) if k == (batch.column(2)[i].as_py(), batch.column(3)[i].as_py())]
        lists = [sets[i].view(np.int64) for i in good]
        bits = [parity_bits(sets[i], BITS) for i in good]
        take = batch.take(pa.array(good, pa.int64()))
        offsets = lambda x: pa.array(np.cumsum([0, *map(len, x)]).astype(np.int32))
        flat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([take.column(2), pa.array([len(x) for x in lists], pa.int64()), take.column(4), pa.ListArray.from_arrays(offsets(lists), flat(lists)), pa.ListArray.from_arrays(offsets(bits), flat(bits))], names=["id", "n", "own", "tokens", "bits"])


def missing(n: int, percent: int) -> int:
    """Tokens of a set of this size that a partner may lack."""
    return n * (100 - percent) // 100


def bands(n: int, percent: int) -> list[int]:
    """Size bands of a set: its own and that of its largest partner."""
    return sorted({n.bit_length(), (n * 100 // percent).bit_length()})


def by_tokens(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices whose lists hold about ``SLICE`` elements; a longer list is a slice of its own."""
    for batch in batches:
        counts = pa.compute.fill_null(pa.compute.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = (np.flatnonzero(np.diff((np.cumsum(counts) - counts) // SLICE)) + 1).tolist()
        for begin, end in zip([0, *cuts], [*cuts, batch.num_rows]):
            if end > begin:
                yield batch.slice(begin, end - begin)


def _rows(batches: Iterator[pa.RecordBatch], percent: int, eighths: int) -> Iterator[pa.RecordBatch]:
    """Counted tokens of each set, and the other tokens that its prefix may come to need."""
    for batch in by_tokens(batches, 2):
        ids, sizes, tokens, spare = [], [], [], []
        for id_, n, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            found = listed.values.to_numpy().view(np.uint64)
            first = counted(found, eighths)
            need = missing(n, percent) + 1
            parts = max(1, *(int(p * missing(1 << b, percent)) for b in bands(n, percent) for _, _, p in CLASSES))
            short = first.sum() - 2 * parts < need
            # the spares in the order of signatures(), which reads tokens as signed numbers
            for own, is_spare in ((found[first].view(np.int64), False), (np.sort(found[~first].view(np.int64))[: need if short else 0], True)):
                tokens.append(own)
                sizes.append((id_, n, len(own), is_spare))
        repeat = [s[2] for s in sizes]
        ids = pa.array([s[0] for s in sizes]).take(pa.array(np.repeat(np.arange(len(sizes)), repeat)))
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(np.repeat([s[1] for s in sizes], repeat).astype(np.int64)), pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64)), pa.array(np.repeat([s[3] for s in sizes], repeat).astype(bool))], names=["id", "n", "token", "spare"])


def signatures(n: int, own: int, rated: list[tuple[int, int]], percent: int) -> set[int]:
    """Signatures of a set: ``own`` tokens that it alone holds, ``rated`` the others as (sets that hold it, token)."""
    need = missing(n, percent) + 1 - own
    made: set[int] = set()
    if need <= 0:
        return made
    ordered = sorted(rated)
    for band in bands(n, percent):
        left, k = need, 0
        for limit, size, share in CLASSES:
            parts = max(1, int(share * missing(1 << band, percent)))
            held: dict[int, list[int]] = {}
            while left > 0 and k < len(ordered) and (limit is None or ordered[k][0] <= limit) and ordered[k][0] < LAST:
                token = ordered[k][1] & (1 << 64) - 1
                k += 1
                if size == 1:
                    made.add(fold((1, token)))
                    left -= 1
                    continue
                part = held.setdefault((token >> 20) % parts, [])
                made.update(fold((size, band, *sorted((*some, token)))) for some in combinations(part, size - 1))
                part.append(token)
                left -= len(part) >= size
        for _, token in ordered[k:] if left > 0 else ():
            if left <= 0:
                break
            made.add(fold((1, token & (1 << 64) - 1)))
            left -= 1
    return made


def fold(parts: tuple[int, ...]) -> int:
    """One signed 64-bit hash of a few numbers."""
    h = 0
    for p in parts:
        h = (h * 0x9E3779B97F4A7C15 + p + 1) & (1 << 64) - 1
        h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & (1 << 64) - 1
        h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & (1 << 64) - 1
        h ^= h >> 31
    return h - (1 << 64) if h >> 63 else h


def _signatures(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in by_tokens(batches, 3):
        ends = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(batch.column(3)), 0).to_numpy(zero_copy_only=False)).tolist()
        rates, tokens = (x.to_numpy() for x in batch.column(3).flatten().flatten())
        own = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), [0, *ends], ends)
        made = [list(signatures(n, k, list(zip(rates[b:e].tolist(), tokens[b:e].tolist())), percent)) for n, k, b, e in own]
        back = pa.array(np.repeat(np.arange(batch.num_rows), [len(m) for m in made]))
        flat = pa.array([s for m in made for s in m], pa.int64())
        yield pa.RecordBatch.from_arrays([flat, batch.column(0).take(back), batch.column(2).take(back)], names=["signature", "id", "own"])


def may_link(a: str, b: str, percent: int) -> Column:
    """Sizes and parity bits allow the similarity: what two sets differ by is at least the bits that differ."""
    union_least = F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n"))
    sizes = F.lit(100) * F.least(F.col(f"{a}.n"), F.col(f"{b}.n")) >= F.lit(percent) * union_least
    differ = sum((F.bit_count(F.get(F.col(f"{a}.bits"), k).bitwiseXOR(F.get(F.col(f"{b}.bits"), k))) for k in range(BITS)), F.lit(0))
    return sizes & (F.lit(100 + percent) * differ <= F.lit(100 - percent) * (F.col(f"{a}.n") + F.col(f"{b}.n")))


def verified(pairs: DataFrame, kept: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose sets are similar."""
    sets = kept.select("id", "n", "tokens")
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb")), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    return both.where(F.lit(100) * common >= F.lit(percent) * (F.col("na") + F.col("nb") - common)).select("a", "b")


def tiled(rows: DataFrame, group: str, size: str) -> DataFrame:
    """Rows of the tiles of each group: ``_low``, ``_high`` and the row's own ``_block``; sorted by tile.

    A group of up to ``TILE`` members is one tile.  A larger one is cut into blocks, and every two blocks make a tile.
    """
    n_blocks = F.ceil(F.col(size) / TILE).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(3)), n_blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda x: F.struct(F.least("_block", x).alias("_low"), F.greatest("_block", x).alias("_high")))
    placed = rows.withColumn("_blocks", n_blocks).withColumn("_block", own).withColumn("_tile", F.explode(pairs))
    rest = [c for c in rows.columns if c not in (group, size)]
    tiles = placed.select(group, "_tile._low", "_tile._high", "_block", *rest)
    return tiles.repartition(group, "_low", "_high").sortWithinPartitions(group, "_low", "_high")


def runs(batches: Iterator[pa.RecordBatch], keys: int = 3) -> Iterator[pa.Table]:
    """Consecutive rows that agree in the first columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)])
        cuts = [0, *(np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:]):
            now = tuple(columns[:, begin].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def sides(tile: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of the members on both sides of a tile; a tile on the diagonal has the same on both."""
    block = tile["_block"].to_numpy()
    return np.flatnonzero(block == tile["_low"][0].as_py()), np.flatnonzero(block == tile["_high"][0].as_py())


def close_enough(na: np.ndarray, nb: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (na[:, None] + nb[None, :] - common)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Common tokens of all pairs of two lists of sets, by products of their incidence matrices."""
    if len(left) == len(right) == 1:
        return np.array([[len(np.intersect1d(left[0], right[0], assume_unique=True))]])
    _, column, count = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    keep = count > 1
    number = np.where(keep, np.cumsum(keep) - 1, -1)[column]
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    row, number = row[number >= 0], number[number >= 0]
    order = np.argsort(number, kind="stable")
    row, number = row[order], number[order]
    total = np.zeros((len(left), len(right)), np.float32)
    for begin in range(0, int(keep.sum()), COLUMNS):
        part = slice(*np.searchsorted(number, [begin, begin + COLUMNS]))
        cells = np.zeros((len(left) + len(right), min(COLUMNS, int(keep.sum()) - begin)), np.float32)
        cells[row[part], number[part] - begin] = 1
        total += cells[: len(left)] @ cells[len(left) :].T
    return total.astype(np.int64)


def whole_runs(batches: Iterator[pa.RecordBatch], columns: Callable[[pa.RecordBatch], list[np.ndarray]], keys: int = 3) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(end of each row's run, columns) of chunks of whole runs; the first columns say what a run is."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = columns(batch)
        held = now if held is None else [np.concatenate(pair) for pair in zip(held, now)]
        starts = run_starts(held[:keys])
        if len(starts) > 1:
            yield ends_of(starts, starts[-1]), [c[: starts[-1]] for c in held]
            held = [c[starts[-1] :] for c in held]
    if held is not None:
        yield ends_of(run_starts(held[:keys]), len(held[0])), held


def run_starts(keys: list[np.ndarray]) -> np.ndarray:
    changed = np.zeros(len(keys[0]), bool)
    changed[0] = True
    for c in keys:
        changed[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(changed)


def ends_of(starts: np.ndarray, total: int) -> np.ndarray:
    starts = starts[starts < total]
    ends = np.append(starts[1:], total)
    return np.repeat(ends, ends - starts)


def _open(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of a tile's members in different groups that sizes and parity bits allow to be similar."""

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        flat = [batch.column(name).to_numpy(zero_copy_only=False) for name in ("signature", "_low", "_high", "_block", "id", "root", "n")]
        bits = batch.column("bits").flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, BITS)
        first = pa.compute.list_flatten(batch.column("first")).to_numpy().reshape(batch.num_rows, FIRST)
        return [*flat, bits, first]

    for end, (signature, low, high, block, ids, root, n, bits, first) in whole_runs(batches, columns):
        at, step, found = np.arange(len(end)), 0, []
        while True:
            # pairs of rows that lie ``step`` apart in a run
            step += 1
            at = at[at + step < end[at]]
            if not len(at):
                break
            to = at + step
            may = (root[at] != root[to]) & ((low[at] == high[at]) | (block[at] != block[to]))
            may &= 100 * np.minimum(n[at], n[to]) >= percent * np.maximum(n[at], n[to])
            i, j = at[may], to[may]
            for begin in range(0, len(i), 1 << 14):
                x, y = i[begin : begin + (1 << 14)], j[begin : begin + (1 << 14)]
                differ = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
                near = (100 + percent) * differ <= (100 - percent) * (n[x] + n[y])
                x, y = x[near], y[near]
                met = ((first[x][:, :, None] == first[y][:, None, :]) & (first[x] < signature[x][:, None])[:, :, None]).any(axis=(1, 2))
                found.append((x[~met], y[~met]))
        if found:
            x, y = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[x], ids[y])), pa.array(np.maximum(ids[x], ids[y]))], names=["a", "b"])


def token_sets(tile: pa.Table) -> list[np.ndarray]:
    return [x.values.to_numpy() for x in tile["tokens"].combine_chunks()]


def _counted(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """For each member of a tile, the documents in the classes that it links with on the other side."""
    for tile in runs(batches):
        a, b = sides(tile)
        n, ids, sizes, sets = tile["n"].to_numpy(), tile["id"].to_numpy(), tile["size"].to_numpy(), token_sets(tile)
        linked = close_enough(n[a], n[b], overlaps([sets[i] for i in a], [sets[i] for i in b]), percent) & (ids[a][:, None] != ids[b][None, :])
        rows = [(ids[a], linked @ sizes[b])]
        if tile["_low"][0].as_py() != tile["_high"][0].as_py():
            rows.append((ids[b], linked.T @ sizes[a]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[k] for r in rows])) for k in (0, 1)], names=["id", "links"])


def links(kept: DataFrame, counts: DataFrame, percent: int, eighths: int) -> DataFrame:
    """Links between classes: enough of them to connect all that all links connect."""
    rows = kept.select("id", "n", "tokens").mapInArrow(lambda b: _rows(b, percent, eighths), "id bigint, n bigint, token bigint, spare boolean")
    rated = rows.where("not spare").join(counts, "token").select("id", "token", "rate").unionByName(rows.where("spare").select("id", "token", F.lit(LAST).alias("rate")))
    listed = rated.groupBy("id").agg(F.collect_list(F.struct("rate", "token")).alias("rated"))
    made = stored(kept.select("id", "n", "own").join(listed, "id").mapInArrow(lambda b: _signatures(b, percent), "signature bigint, id bigint, own bigint"), "signatures")
    order = [F.struct(F.xxhash64("id", F.lit(r)), "id") for r in range(PIVOTS)] + [F.struct("own", F.xxhash64("id", F.lit(r)), "id") for r in range(PIVOTS)]
    buckets = made.groupBy("signature").agg(F.count("*").alias("m"), F.array_distinct(F.array(*(F.min(o)["id"] for o in order))).alias("pivots")).where("m > 1")
    members = stored(made.select("signature", "id").join(buckets, "signature"), "members")
    pivots = members.select("id", F.explode("pivots").alias("b")).where("id != b").select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()
    facts = kept.select("id", F.struct("n", "bits").alias("x"))
    likely = pivots.join(facts.select(F.col("id").alias("a"), F.col("x").alias("xa")), "a").join(facts.select(F.col("id").alias("b"), F.col("x").alias("xb")), "b")
    first = stored(verified(likely.where(may_link("xa", "xb", percent)).select("a", "b"), kept, percent), "links")
    groups = components(first)
    named = members.select("signature", "m", "id").join(groups.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = stored(named, "named")
    mixed = named.groupBy("signature").agg(F.min("root").alias("_least"), F.max("root").alias("_most")).where("_least != _most").select("signature")
    # the smallest signatures of an id, the largest number where it has fewer
    few = F.concat(F.slice(F.array_sort(F.collect_list("signature")), 1, FIRST), F.array_repeat(F.lit((1 << 63) - 1), FIRST))
    firsts = members.groupBy("id").agg(F.slice(few, 1, FIRST).alias("first"))
    apart = named.join(mixed, "signature").join(kept.select("id", "n", "bits").join(firsts, "id"), "id")
    rest = tiled(apart, "signature", "m").mapInArrow(lambda b: _open(b, percent), "a bigint, b bigint").distinct()
    return first.unionByName(verified(stored(rest, "open"), kept, percent))


def link_counts(found: DataFrame, kept: DataFrame, percent: int) -> DataFrame:
    """(key, links): how many documents of other classes each class links with; ``found`` has key, root and size."""
    components_ = found.groupBy("root").agg(F.count("*").alias("m"))
    rows = found.join(components_, "root").select("root", "m", F.col("key").alias("id"), "size").join(kept.select("id", "n", "tokens"), "id")
    counted_ = tiled(rows.select("root", "m", "id", "size", "n", "tokens"), "root", "m").mapInArrow(lambda b: _counted(b, percent), "id bigint, links bigint")
    return counted_.groupBy(F.col("id").alias("key")).agg(F.sum("links").alias("links"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90, eighths: int = 2, count_links: bool = True) -> DataFrame:
    """Return (id, n_shingles, class_id, component_id, n_links), one row per input row.

    Two documents link if 100 * common >= percent * union of their shingle sets.  ``class_id`` is the smallest id
    with the same set, ``component_id`` the smallest id that links reach, ``n_links`` the number of other rows that a row
    links with, those of the same set included (left out without ``count_links``).  A text of fewer words than ``width`` is one
    shingle; NULL and empty texts have none and link with nothing: their class and component are themselves.  Rows with
    a NULL id link with nothing, count for nothing and have a NULL class and component.  Repeated rows of an id give a row each; if their
    texts differ, each row has the class and the component of its own text.  Ids are whole numbers; other columns are ignored.
    ``eighths`` of all tokens are counted; it changes the work, not the result.
    """
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    sets = stored(own.mapInArrow(lambda b: _sets(b, width), "id bigint, n bigint, key bigint, key2 bigint"), "sets")
    classes = sets.where("n > 0 and id is not null").groupBy("key", "key2", "n").agg(F.min("id").alias("class_id"), F.count("*").alias("size"))
    seen = own.where("id is not null").select("text").mapInArrow(lambda b: _tokens(b, width, eighths), "token bigint, key bigint").groupBy("token").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("rate"))
    # One row for a token: the set that alone holds it, or the token itself and how often it is held.
    alone = F.col("low") == F.col("high")
    seen = stored(seen.select(F.when(alone, F.col("low")).alias("key"), F.when(~alone, F.col("token")).alias("token"), F.when(~alone, F.col("rate")).alias("rate")), "tokens")
    singles = seen.where("key is not null").groupBy("key").agg(F.count("*").alias("own"))
    spread = F.expr(f"n * {100 - percent} div 100")
    alive = stored(classes.join(singles, "key", "left").withColumn("own", F.coalesce("own", F.lit(0))).where(F.col("own") <= spread), "alive")
    chosen = own.join(broadcast_up_to(alive.withColumnRenamed("class_id", "id").select("id", "key", "key2", "own"), BROADCAST_SETS), "id")
    # from here on a class goes by its key: two classes may have the same smallest id
    kept = stored(chosen.select("id", "text", "key", "key2", "own").mapInArrow(lambda b: _kept(b, width), "id bigint, n bigint, own bigint, tokens array<bigint>, bits array<bigint>").dropDuplicates(["id"]), "kept")
    found = components(links(kept, seen.where("token is not null").select("token", "rate"), percent, eighths)).withColumnRenamed("node", "key").join(alive.select("key", "class_id", "size"), "key")
    found = stored(found, "found")
    reached = found.select("key", "root").join(found.groupBy("root").agg(F.min("class_id").alias("component_id")), "root").select(F.col("key").alias("linked"), "component_id")
    if count_links:
        reached = reached.join(link_counts(found, kept, percent).withColumnRenamed("key", "linked"), "linked")
    known = F.col("class_id").isNotNull() & F.col("id").isNotNull()
    named = sets.join(classes, ["key", "key2", "n"], "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id")).alias("class_id"), F.when(known, F.col("key")).alias("linked"), F.when(known, F.col("size") - 1).otherwise(F.lit(0)).alias("copies"))
    whole = named.join(reached, "linked", "left")
    n_links = [(F.col("copies") + F.coalesce("links", F.lit(0))).alias("n_links")] if count_links else []
    return whole.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "class_id", F.coalesce("component_id", "class_id").alias("component_id"), *n_links)
