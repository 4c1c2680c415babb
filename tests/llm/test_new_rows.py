"""Byte-level encoding, packing and the radix-trie audit against plain Python."""

import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hierspark.llm import byte_bpe, filter_audit, packing, queries

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")


def documents():
    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()


# Byte-level ids


@given(st.lists(st.one_of(st.text(), st.text("ab'st .,!1²Ⅷé\n\t  日"), st.text("ab. \n"))))
@settings(max_examples=150, deadline=None)
def test_ids_are_those_of_the_library(texts):
    ours = byte_bpe.encoder(BPE, 7)
    assert [np.frombuffer(b, "<u4").tolist() for b in ours.encode(texts)] == [[*ours.tokenizer.encode(t, add_special_tokens=False).ids, 7] for t in texts]


def test_forgetting_changes_nothing():
    small, large = byte_bpe.Encoder(BPE, 0, kept_words=20), byte_bpe.Encoder(BPE, 0)
    texts = [t or "" for _, t in documents()]
    assert [b for t in texts for b in small.encode([t])] == large.encode(texts)
    assert len(small.young.older) < len(large.young)


def test_special_strings_are_the_library_s():
    text = "a<|endoftext|> b"
    assert np.frombuffer(byte_bpe.Encoder(BPE, 1).encode([text])[0], "<u4").tolist() == [*Tokenizer.from_file(BPE).encode(text, add_special_tokens=False).ids, 1]


# Packing


@given(st.integers(0, 5000), st.integers(0, 11))
def test_cuts_are_the_binary_form(n, power):
    found = packing.cuts(n, 1 << power)
    assert sum(length for _, length in found) == n and [s for s, _ in found] == np.cumsum([0, *(x for _, x in found)])[:-1].tolist()
    small = [x for _, x in found if x < 1 << power]
    assert len(found) - len(small) == n >> power and sum(small) == n % (1 << power) and sorted(set(small), reverse=True) == small and all(x & (x - 1) == 0 for x in small)


def test_packed_documents_against_the_tokenizer(spark):
    library = Tokenizer.from_file(BPE)
    want = set()
    for i, text in documents():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want |= {(i, s, n, zlib.crc32(ids[s : s + n].tobytes()), len(ids)) for s, n in packing.cuts(len(ids), 1024)}
    got = queries.op13_packing(spark, SF).collect()
    assert {(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got} == want and len(got) == len(want)
    assert {r["offset"] for r in got} == {0}
    by_id = sorted((r["sequence_id"], r["length"]) for r in got)
    assert [i for i, _ in by_id] == list(range(len(got))) and [n for _, n in by_id] == sorted((n for _, n in by_id), reverse=True)


def test_packing_of_awkward_texts(spark, awkward, nothing, tmp_path):
    library = Tokenizer.from_file(BPE)
    packing.write(awkward, f"file://{tmp_path}/a", BPE, 0, longest=16)
    got = packing.read(spark, f"file://{tmp_path}/a").collect()
    whole = {}
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["length"] * 4 == len(r["ids"]) and r["length"] <= 16
        whole.setdefault(r["doc_id"], []).append(bytes(r["ids"]))
    want = {}
    for r in awkward.collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want.setdefault(r["doc_id"], []).extend((s, ids[s : s + n].tobytes()) for s, n in packing.cuts(len(ids), 16))
    assert whole == {k: [b for _, b in sorted(v)] for k, v in want.items()} and len({r["sequence_id"] for r in got}) == len(got)
    packing.write(nothing, f"file://{tmp_path}/b", BPE, 0)
    assert packing.read(spark, f"file://{tmp_path}/b").count() == 0
    with pytest.raises(ValueError):
        packing.write(awkward, f"file://{tmp_path}/c", BPE, 0, longest=1000)


# Filter audit


@given(st.lists(st.binary(max_size=6) | st.sampled_from([b"abc" * 30, b"abc" * 30 + b"x", b"abc" * 29, b""])))
@settings(deadline=None)
def test_trie_tells_texts_apart(texts):
    trie, seen = filter_audit.Trie(), {}
    for t in texts:
        assert trie.insert(t) == seen.setdefault(t, len(seen))


@given(st.lists(st.tuples(st.binary(max_size=4), st.integers(1, 9)), unique_by=lambda x: x[0]))
def test_separators_keep_order(prefixes):
    found = filter_audit.separators(prefixes, 10)
    assert found == sorted(set(found)) and all(0 < len(s) <= 4 for s in found)
    buckets = {}
    for p, n in prefixes:
        at = sum(s <= p for s in found)
        buckets.setdefault(at, []).append(n)
    assert all(sum(b) <= 10 or len(b) == 1 for b in buckets.values())


def plain_masks(rows):
    out = []
    for i, text, _ in rows:
        t = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        mask = (len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1 | (100 * len(re.findall("[A-Z]", t)) > 5 * len(t)) << 2 | bool(re.search(r"[#$%&*|]", t)) << 3
        out.append(mask | (i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)) << 4)
    return out


def plain_audit(rows, labels):
    want, found = {}, plain_masks(rows)
    good, bad = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    for part in {p or "" for *_, p in rows}:
        own = [(i, m) for (i, _, p), m in zip(rows, found) if (p or "") == part]
        shares = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone = [(i, m) for i, m in left if m & bit]
                left = [(i, m) for i, m in left if not m & bit]
                shares[letter] += len(gone)
                redundant = sum(bool(m & bit) for _, m in own) - len(gone)
                want[part, "".join(order), step] = [len(left), len(gone), redundant, sum(m == bit for _, m in own), sum(i in good for i, _ in gone), sum(i in bad for i, _ in gone)]
        for (p, order, step), counts in want.items():
            if p == part:
                counts.append(shares[order[step - 1]])
    return want


def test_audit_against_plain_python(spark, awkward, nothing):
    rng = random.Random(3)
    shared = "The same long beginning of many texts. " * 40
    texts = ["", None, " \n", "A B", "x # y", "Über " * 60, *(shared + str(k) for k in range(40)), *(" ".join(rng.choices([f"w{n}" for n in range(90)], k=70)) for _ in range(6))]
    rows = [(i if i % 17 else None, rng.choice(texts), rng.choice(["a", "b", "", None])) for i in range(400)] + [(5, "A B", "a"), (5, "A B", "a")] + [(i, "hot text #1", "hot") for i in range(900, 1100)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in rng.choices(range(1100), k=500)] + [(None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("mask", F.lit(7)).repartition(5)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    want = plain_audit(rows, labels)
    for bucket_bytes in (1 << 23, 2000):
        got = {(r["part"], r["filter_order"], r["step"]): [*r][3:] for r in filter_audit.audit(docs, marks, bucket_bytes=bucket_bytes).collect()}
        assert got == want
    assert len(filter_audit.boundaries(docs.select(F.coalesce("text", F.lit("")).alias("_text")), 2000)) > 5
    odd = awkward.withColumn("source", F.lit("s"))
    plain = [(r["doc_id"], r["text"], "s") for r in odd.collect()]
    assert sorted((r["id"] or 0, r["mask"]) for r in filter_audit.masks(odd).collect()) == sorted((i or 0, m) for (i, *_), m in zip(plain, plain_masks(plain)))
    assert filter_audit.audit(nothing.withColumn("source", F.lit("s")), marks).count() == 0
