"""Operators on sets of documents, the queries with SQL, and the pipeline."""

import hashlib
import importlib.util
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from compare import database, differences
from pyspark.sql import functions as F

from hierspark.llm import decontaminate, graph, imatch, ngram_join, oracles, queries
from hierspark.llm.shingles import parity_bits, shingle_sets
from hierspark.llm.util import next_ids

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_against_sql(spark, name):
    assert differences(name, queries.QUERIES[name](spark, SF), database(SF), oracles.ORACLES[name]) == []


# N-gram join


def plain_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)] if words else [])


def plain_groups(texts, width, percent):
    sets = [plain_set(t, width) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    n_links = Counter()
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                n_links.update([i, j])
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), n_links[i]) for i in range(len(texts))}


def mutated(rng, words, vocabulary, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = rng.choice(vocabulary)
    return words


@pytest.mark.parametrize("width, percent, eighths", [(3, 90, 2), (5, 80, 3), (2, 60, 8), (3, 90, 1)])
@pytest.mark.parametrize("small_vocabulary", [False, True])
def test_groups_against_all_pairs(spark, monkeypatch, width, percent, eighths, small_vocabulary):
    monkeypatch.setattr(ngram_join, "TILE", 3 if small_vocabulary else 512)
    rng = random.Random(width * percent + small_vocabulary)
    vocabulary = [f"w{i}" for i in range(12 if small_vocabulary else 400)]
    shared = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(14):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 20, 60, 150]))] + (shared if rng.random() < 0.5 else [])
        texts += [" ".join(mutated(rng, base, vocabulary, rng.randrange(0, 1 + len(base) // 20))) for _ in range(rng.randrange(1, 9))]
    texts += [None, "", "One two", "one TWO", " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.near_groups(docs, width=width, percent=percent, eighths=eighths).collect()}
    assert got == plain_groups(texts, width, percent)


def test_similar_sets_share_a_signature(monkeypatch):
    """The promise of the prefixes, for rare and frequent classes, checked on random pairs."""
    monkeypatch.setattr(ngram_join, "CLASSES", ((4, 1, 0.0), (30, 2, 0.5), (None, 3, 0.35)))
    rng = random.Random(5)
    rate = {t: rng.choice([2, 3, 10, 20, 100, 1000]) for t in range(4000)}
    value = {t: int(v) for t, v in zip(range(4000), np.random.default_rng(1).integers(-(2**63), 2**63, 4000))}
    shared = 0
    for _ in range(600):
        percent, n = rng.choice([80, 90]), rng.randrange(10, 300)
        a = set(rng.sample(range(4000), n))
        b = set(rng.sample(sorted(a), n - rng.randrange(0, 1 + n * (100 - percent) // 150))) | set(rng.sample(range(4000), rng.randrange(0, 1 + n // 25)))
        if 100 * len(a & b) < percent * len(a | b):
            continue
        rows = lambda s: [(ngram_join.LAST if t % 4 else rate[t], value[t]) for t in s]
        assert ngram_join.signatures(len(a), 0, rows(a), percent) & ngram_join.signatures(len(b), 0, rows(b), percent)
        shared += 1
    assert shared > 200


@pytest.mark.parametrize("percent, eighths", [(80, 3), (90, 2)])
def test_similar_small_sets_share_a_signature(percent, eighths):
    """Through _rows, where few or no tokens are counted and the others stand in."""
    rng = np.random.default_rng(percent)
    sets = {}
    for k in range(6000):
        a = np.unique(rng.integers(0, 2**64, rng.integers(2, 13), dtype=np.uint64))
        b = np.unique(np.append(a[rng.permutation(len(a))[: len(a) - rng.integers(0, 2)]], rng.integers(0, 2**64, rng.integers(0, 2), dtype=np.uint64)))
        sets[2 * k], sets[2 * k + 1] = a, b
    listed = pa.array([x.view(np.int64) for x in sets.values()], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array([len(x) for x in sets.values()], pa.int64()), listed], names=["id", "n", "tokens"])
    held = Counter(t for x in sets.values() for t in x.view(np.int64).tolist())
    rated, own = {i: [] for i in sets}, Counter()
    for i, t, spare in ((r["id"], r["token"], r["spare"]) for r in pa.Table.from_batches(list(ngram_join._rows(iter([batch]), percent, eighths))).to_pylist()):
        if spare or held[t] > 1:
            rated[i].append((ngram_join.LAST if spare else held[t], t))
    for i, x in sets.items():
        own[i] = sum(held[t] == 1 for t in x[ngram_join.counted(x, eighths)].view(np.int64).tolist())
    made = {i: ngram_join.signatures(len(x), own[i], rated[i], percent) for i, x in sets.items()}
    linked = [i for i in range(0, len(sets), 2) if 100 * len(np.intersect1d(sets[i], sets[i + 1])) >= percent * len(np.union1d(sets[i], sets[i + 1]))]
    assert len(linked) > 1000 and [i for i in linked if not made[i] & made[i + 1]] == []


@pytest.mark.parametrize("size", [1, 40, 1 << 18])
def test_slices_change_no_signature(monkeypatch, size):
    """Lists cut at any length, empty and long ones among them, against each set for itself."""
    rng = np.random.default_rng(3)
    rated = [[(int(r), int(t)) for r, t in zip(rng.integers(2, 3000, n), rng.integers(-(2**62), 2**62, n))] for n in (0, 1, 7, 900, 0, 30, 0)]
    cells = [[{"rate": r, "token": t} for r, t in x] for x in rated]
    columns = {"id": list(range(7)), "n": [max(1, len(x)) for x in rated], "own": [0, 0, 1, 20, 0, 3, 0], "rated": pa.array(cells, pa.list_(pa.struct([("rate", pa.int64()), ("token", pa.int64())])))}
    batch = pa.RecordBatch.from_pydict(columns)
    monkeypatch.setattr(ngram_join, "SLICE", size)
    got = {(r["signature"], r["id"], r["own"]) for b in ngram_join._signatures(iter([batch, batch.slice(3), batch.slice(0, 0)]), 80) for r in b.to_pylist()}
    want = {(s, i, k) for i, n, k, x in zip(columns["id"], columns["n"], columns["own"], rated) for s in ngram_join.signatures(n, k, x, 80)}
    assert got == want and {i for _, i, _ in got} == {2, 3, 5}


def test_two_texts_of_one_id_keep_their_links(spark):
    first, second = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    docs = spark.createDataFrame([(1, first), (1, second), (2, first + " x"), (3, second + " x"), (4, second), (None, first)], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or 0, r["class_id"] or 0, r["component_id"] or 0, r["n_links"]) for r in ngram_join.near_groups(docs).collect())
    assert got == [(0, 0, 0, 0), (1, 1, 1, 1), (1, 1, 1, 2), (2, 2, 1, 1), (3, 3, 1, 2), (4, 1, 1, 2)]


def test_a_group_of_many_different_copies(spark):
    """Copies of one text, each with words of its own: a group larger than a tile, most pairs of it no links."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    texts = [" ".join(mutated(rng, base, [f"x{k}_{i}" for i in range(9)], rng.choice([1, 1, 2, 3]))) for k in range(700)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.near_groups(docs).collect()}
    assert got == plain_groups(texts, 3, 90) and len({n for _, _, n in got.values()}) > 20


def test_overlaps_are_set_sizes(monkeypatch):
    monkeypatch.setattr(ngram_join, "COLUMNS", 7)
    rng = np.random.default_rng(3)
    a, b = ([np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(n)] for n in (5, 8))
    assert ngram_join.overlaps(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert ngram_join.overlaps(a[:1], b[:1]).tolist() == [[len(np.intersect1d(a[0], b[0]))]]


def test_groups_of_awkward_texts(spark, awkward, nothing):
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in ngram_join.near_groups(awkward).collect())
    assert len(got) == awkward.count()
    by_id = {i: (n, c) for i, n, c in got}
    assert by_id[1] == (0, 1) and by_id[2] == (0, 2) and by_id[3] == (0, 3) and by_id[4] == (1, 4) and by_id[5] == (1, 4) and by_id[-1] == (3, None)
    assert by_id[6][1] == 6 and by_id[8] == (1, 8) and by_id[9] == (1, 9)
    assert ngram_join.near_groups(nothing).count() == 0


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(100):
        a, b = (rng.integers(0, 300, rng.integers(1, 300)).astype(np.uint64) for _ in range(2))
        a, b = np.unique(a), np.unique(b)
        bits = np.bitwise_count((parity_bits(a, 8) ^ parity_bits(b, 8)).view(np.uint64)).sum()
        assert bits <= len(np.setxor1d(a, b))


def test_shingles_follow_the_words():
    texts = ["A b\tc  d", "a B c d", "a b c", "a b", "", "x a b c"]
    sets = [set(s.tolist()) for s in shingle_sets(texts, 3)]
    assert sets[0] == sets[1] and sets[2] < sets[0] and len(sets[3]) == 1 and not sets[4] and sets[2] < sets[5] and not sets[3] & sets[2]


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(200, i) for i in range(201, 230)] + [(7, 7)]
    found = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    root = {n: n for p in pairs for n in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert all(found.get(n, n) == r for n, r in root.items())
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# Decontamination


def test_substituted_passages_are_found(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = [[word() for _ in range(n)] for n in (9, 20, 60)]
    docs, want = [], set()
    for i in range(60):
        k, words = i % 3, [word() for _ in range(80)]
        if i < 30:
            item = list(items[k])
            for at in range(rng.randrange(4, 7), len(item), 7):
                item[at] = word()
            words[i : i + len(item)] = item
            want.add((i, k))
        elif i < 40:
            words[3:7] = items[k][:4]
        docs.append((i, (" . " if i % 2 else "\n").join(words).upper()))
    tests = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(8, None), (9, "too short")], "item_id bigint, text string")
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), tests).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)


def test_random_substitutions_against_all_alignments(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [[word() for _ in range(n)] for n in (7, 8, 9, 10, 11, 13, 15, 15, 17, 20, 24, 30, 45)]
    docs = []
    for i in range(1200):
        item, rate = rng.choice(items), rng.choice([0.1, 0.2, 0.3, 0.4])
        part = [word() if rng.random() < rate else w for w in item]
        docs.append([word() for _ in range(rng.randrange(12))] + part[rng.choice([0, 0, 0, 1, 2]) : len(part) - rng.choice([0, 0, 0, 1, 2])] + [word() for _ in range(rng.randrange(12))])
    want = {}
    for i, d in enumerate(docs):
        for k, item in enumerate(items):
            best = None
            for start in range(1 - len(item), len(d)):
                same = [0 <= start + j < len(d) and d[start + j] == w for j, w in enumerate(item)]
                if sum(same) >= 0.6 * len(item) or any(sum(same[j : j + 16]) >= 13 for j in range(len(item) - 15)):
                    best = max(best or (0, 0), (sum(same), -start))
            if best:
                want[i, k] = (len(item), best[0], -best[1])
    tables = [spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(xs)], f"{name} bigint, text string") for xs, name in ((docs, "doc_id"), (items, "item_id"))]
    got = {(r["doc_id"], r["item_id"]): (r["item_words"], r["matches"], r["start"]) for r in decontaminate.contaminated(*tables).collect()}
    assert got == want and len(want) > 700


def test_a_long_item_held_in_part_and_awkward_texts(spark, awkward, nothing):
    item = " ".join(f"v{i}" for i in range(100))
    tests = spark.createDataFrame([(1, item), (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, " ".join(f"v{i}" for i in range(30, 60))), (2, item[50:100])], "doc_id bigint, text string")
    assert {(r["doc_id"], r["start"]) for r in decontaminate.contaminated(docs, tests).collect()} >= {(1, -30)}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(awkward, tests).collect()} == {(6, 2), (7, 2)}
    assert decontaminate.contaminated(nothing, tests).count() == 0 and decontaminate.contaminated(awkward, tests.limit(0)).count() == 0


def test_a_hit_does_not_carry_the_whole_text(spark):
    tests = spark.createDataFrame([(1, " ".join(f"v{i}" for i in range(20)))], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, " ".join(f"v{i}" for i in range(5, 300)))], "doc_id bigint, text string")
    found = decontaminate.contaminated(docs, tests)
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join " in x]
    assert len(joins) == 2 and not any(re.search(r"(?<!item)_words#", x) for x in joins)
    assert [tuple(r) for r in found.collect()] == [(1, 1, 20, 15, -5)]


# Fingerprints


def spark_hash(values, seed=42):
    """xxhash64 of Spark over strings or longs."""
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else np.int64(v).tobytes(), seed=seed)
    return int(np.uint64(seed).astype(np.int64))


def plain_fingerprint(text, lexicon):
    terms = {t for t in re.split(r"[^\w]|_", text.lower()) if t}
    scale = max(0, int(np.floor(np.log2(max(1, len(terms)) / imatch.PER_SCALE))))
    hashes = sorted(h for h in (spark_hash([t]) for t in terms) if h in lexicon)
    slots = []
    for s in (scale, scale + 1):
        for k in range(imatch.SLOTS):
            own = [h for h in hashes if h % (1 << s) == 0 and ((h % 2**64) >> 40) % imatch.SLOTS == k]
            slots.append((spark_hash(own) % 2**64) >> 32 if own else None)
    return scale, slots, f"{scale}:" + ",".join("-" if h is None else f"{h:x}" for h in slots)


def plain_likeness(a, b):
    if a[:2] == b[:2]:
        return 1.0
    x, y = {s: a[1][i * imatch.SLOTS :][: imatch.SLOTS] for i, s in enumerate((a[0], a[0] + 1))}, {s: b[1][i * imatch.SLOTS :][: imatch.SLOTS] for i, s in enumerate((b[0], b[0] + 1))}
    pairs = [p for s in sorted(x.keys() & y.keys()) for p in zip(x[s], y[s])]
    either = [p for p in pairs if p != (None, None)]
    return sum(p == q for p, q in either) / len(either) if either else 0.0


def test_fingerprints_against_plain_python(spark):
    texts = dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{SF}/documents.parquet'").fetchall())
    df = Counter(t for text in texts.values() for t in {x for x in re.split(r"[^\w]|_", text.lower()) if x})
    lexicon = {spark_hash([t]) for t, n in df.items() if 2 <= n <= max(20, int(0.1 * len(texts)))}
    ids = sorted(texts)
    got = {r["doc_id"]: r for r in queries.op7_fingerprint(spark, SF).collect()}
    assert sorted(got) == ids
    for k, i in enumerate(ids):
        quarter, after = len(texts[i]) // 4, texts[ids[(k + 1) % len(ids)]]
        edited = texts[i][: len(texts[i]) - quarter] + after[:quarter]
        a, e, n = (plain_fingerprint(t, lexicon) for t in (texts[i], edited, after))
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(texts[i]), hashlib.sha256(edited.encode()).hexdigest())
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (a[2], e[2])
        assert got[i]["near_edited"] == pytest.approx(plain_likeness(a, e)) and got[i]["near_next"] == pytest.approx(plain_likeness(a, n))
    assert np.mean([r["near_edited"] > r["near_next"] for r in got.values()]) > 0.9


def test_fingerprints_of_awkward_texts(spark, awkward, nothing):
    got = {r["doc_id"]: r for r in imatch.fingerprints(awkward, band=imatch.Band(1, 1.0, 20)).collect()}
    assert sorted(got) == list(range(1, 13)) and got[1]["n_chars"] == got[2]["n_chars"] == 0 and got[1]["near_next"] == 1.0
    assert got[4]["fingerprint"] == got[5]["fingerprint"] and got[4]["near_next"] == 1.0
    assert imatch.fingerprints(nothing).count() == 0
    assert imatch.fingerprints(awkward.where("doc_id = 4")).first()["near_next"] == 1.0


def test_next_ids(spark):
    rng = random.Random(4)
    ids = sorted({rng.randrange(-5000, 9_000_000) for _ in range(300)} | set(range(40)))
    got = {r["_id"]: r["_next"] for r in next_ids(spark.createDataFrame([(i,) for i in ids * 2], "_id bigint")).collect()}
    assert got == {i: ids[(k + 1) % len(ids)] for k, i in enumerate(ids)}


# Pipeline

pipeline = importlib.util.find_spec("corpus_pipeline")


@pytest.mark.skipif(pipeline is None, reason="no pipeline here")
def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    stages = dict(p.STAGES)
    clean = p.stored(stages["toxicity"](spark, docs, SF), "t")
    kept = {r["doc_id"] for r in clean.collect()}
    assert clean.columns == docs.columns and len(set(texts) - kept - toxic) <= 4 and len(toxic & kept) <= len(toxic) // 2
    spoken = p.stored(stages["language_id"](spark, clean, SF), "t")
    lettered = {i for i in kept if re.search(r"[^\W\d_]", texts[i])}
    assert {r["doc_id"] for r in spoken.collect()} <= lettered and len(lettered) - spoken.count() <= 1
    single = p.stored(stages["near_copies"](spark, spoken, SF), "t")
    ids = sorted(r["doc_id"] for r in spoken.collect())
    groups = plain_groups([texts[i] for i in ids], 5, 80)
    assert single.columns == docs.columns and sorted(r["doc_id"] for r in single.collect()) == [ids[k] for k in sorted(groups) if groups[k][1] == k]
    safe = p.stored(stages["decontamination"](spark, single, SF), "t")
    items = [" ".join(re.findall(r"\w+", t.lower())) for (t,) in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    holds = {i for i in ids if any(x in " ".join(re.findall(r"\w+", texts[i].lower())) for x in items)}
    assert {r["doc_id"] for r in safe.collect()} == {r["doc_id"] for r in single.collect()} - holds
    last = stages["sentencepiece"](spark, safe, SF).collect()
    assert all(r["lossless"] and r["n_tokens"] == len(r["token_ids"]) for r in last) and len(last) == safe.count()


@pytest.mark.skipif(pipeline is None, reason="no pipeline here")
def test_the_search_for_benchmark_items_runs_once(spark, tmp_path):
    import corpus_pipeline as p

    item = " ".join(f"v{i}" for i in range(9))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, item), (2, "v1 v2 v3"), (None, "x " + item), (3, None)], "doc_id bigint, text string")
    kept = p.decontamination(spark, docs, str(tmp_path))
    assert "Generate" not in kept._jdf.queryExecution().optimizedPlan().toString()  # what follows reads the ids that were found
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3]


@pytest.mark.skipif(pipeline is None, reason="no pipeline here")
def test_language_stage_rejects_what_it_has_not_learned(spark):
    import corpus_pipeline as p

    rng = random.Random(2)
    foreign = ["".join(rng.choice("абвгдежзийклмнопрстуфхцчшщ    ") for _ in range(300)), "日本語の文章は漢字と仮名で書かれています。" * 9, " ".join("".join(rng.choice("qzxvjkw") for _ in range(5)) for _ in range(60))]
    known = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null and n_chars > 100").select("doc_id", "text", "lang")
    docs = known.unionByName(spark.createDataFrame([(10**9 + k, t, None) for k, t in enumerate([*foreign, "Ja", "\U000E0067 \U000F0000"])], known.schema))
    got = {r["doc_id"] for r in p.language_id(spark, docs, SF).collect()}
    assert {i for i in got if i >= 10**9} <= {10**9 + 3} and len([i for i in got if i < 10**9]) >= known.count() - 1


@pytest.mark.skipif(pipeline is None, reason="no pipeline here")
def test_near_copies_go_by_row(spark):
    import corpus_pipeline as p

    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a, "s"), (1, b, "s"), (2, c, "s"), (5, a + " end", "s"), (5, "q " + c[:20], "t"), (None, b, "s"), (7, None, "s"), (7, None, "s"), (8, "z z", "u"), (8, "z z", "t")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = sorted(map(tuple, p.near_copies(spark, docs, SF).collect()), key=str)
    assert got == sorted([(1, a, "s"), (1, b, "s"), (2, c, "s"), (5, "q " + c[:20], "t"), (7, None, "s"), (8, "z z", "t")], key=str)


@pytest.mark.skipif(pipeline is None, reason="no pipeline here")
def test_stages_on_awkward_documents(spark, awkward, nothing):
    import corpus_pipeline as p

    for name, stage in p.STAGES[:-1]:
        got = stage(spark, awkward, SF)
        assert got.columns == awkward.columns and stage(spark, nothing, SF).count() == 0, name
        ids = [r["doc_id"] for r in got.collect()]
        assert 9 in ids and (ids.count(6) == 1 if name == "near_copies" else ids.count(6) == 2), name
    assert p.sentencepiece(spark, awkward, SF).where("lossless").count() == awkward.count()
