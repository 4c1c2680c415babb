"""URL rules looked up in a memory-mapped array of sorted 64-bit digests.

The file holds the sorted xxhash64 digests of all rule strings (host + path), the strings themselves and
their verdicts.  Tasks map it into memory, probe all candidate keys of a batch with one binary search and
accept a hit only where the stored string equals the key, so a digest collision never decides.

Rules are operator configuration, not data: they reach the executors as one file that Spark distributes.
``judge_by_join`` has the same result for rule tables too large for that.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hierspark.llm.util import LOWER, UPPER, local_copy

ALLOW, BLOCK = "allow", "block"
MAGIC = b"SDA1"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for NULL or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"\A[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; empty for NULL or without ://."""
    return F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def digest_file(rules: list[tuple[str, str, str]]) -> bytes:
    """Rules (host, path, verdict) as one sorted array.  Of repeated rules a block wins."""
    verdicts: dict[str, str] = {}
    lengths = set()
    for host, path, verdict in rules:
        key = host + path
        lengths.add((len(path)))
        verdicts[key] = BLOCK if BLOCK in (verdict, verdicts.get(key)) else ALLOW
    by_digest = sorted((xxhash.xxh64_intdigest(k), k) for k in verdicts)
    strings = [k.encode() for _, k in by_digest]
    offsets = np.cumsum([0, *map(len, strings)]).astype("<u8")
    depths = np.array(sorted(lengths), dtype="<u8")
    head = np.array([len(by_digest), len(depths)], dtype="<u8")
    keys = np.array([d for d, _ in by_digest], dtype="<u8")
    blocked = np.array([verdicts[k] == BLOCK for _, k in by_digest], dtype="u1")
    return MAGIC + b"\0\0\0\0" + head.tobytes() + depths.tobytes() + keys.tobytes() + offsets.tobytes() + blocked.tobytes() + b"".join(strings)


class DigestArray:
    """A mapped digest file."""

    def __init__(self, path: str):
        data = np.memmap(path, dtype="u1", mode="r")
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a digest file")
        n, n_lengths = (int(x) for x in data[8:24].view("<u8"))
        at = 24
        self.lengths = [int(x) for x in data[at : at + 8 * n_lengths].view("<u8")]
        at += 8 * n_lengths
        self.keys = data[at : at + 8 * n].view("<u8")
        at += 8 * n
        self.offsets = data[at : at + 8 * (n + 1)].view("<u8")
        at += 8 * (n + 1)
        self.blocked = data[at : at + n]
        self.heap = data[at + n :]

    def find(self, keys: list[str]) -> np.ndarray:
        """Index of each key in the array, -1 where its string is not stored."""
        found = np.full(len(keys), -1, dtype=np.int64)
        if not keys or not len(self.keys):
            return found
        digests = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), dtype="<u8", count=len(keys))
        first, last = np.searchsorted(self.keys, digests, "left"), np.searchsorted(self.keys, digests, "right")
        for i in np.flatnonzero(last > first):
            want = keys[i].encode()
            for at in range(int(first[i]), int(last[i])):
                if self.heap[int(self.offsets[at]) : int(self.offsets[at + 1])].tobytes() == want:
                    found[i] = at
        return found


def candidates(host: str, path: str, lengths: list[int]) -> list[str]:
    """Every host suffix that starts at a label, with every stored path length; longest keys first."""
    suffixes, at = [host], host.find(".")
    while at >= 0:
        suffixes.append(host[at + 1 :])
        at = host.find(".", at + 1)
    fits = [n for n in lengths if n <= len(path)]
    return sorted((s + path[:n] for s in suffixes for n in fits), key=lambda k: -len(k))


_OPEN: dict[str, DigestArray] = {}


def _judge(batches: Iterator[pa.RecordBatch], name: str, default: str) -> Iterator[pa.RecordBatch]:
    if name not in _OPEN:
        _OPEN[name] = DigestArray(SparkFiles.get(name))
    array = _OPEN[name]
    for batch in batches:
        asked = [candidates(h, p, array.lengths) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        keys = list(dict.fromkeys(k for ks in asked for k in ks))
        place = dict(zip(keys, array.find(keys).tolist()))
        rules = [next((k for k in ks if place[k] >= 0), None) for ks in asked]
        verdicts = [default if k is None else BLOCK if array.blocked[place[k]] else ALLOW for k in rules]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], names=[*batch.schema.names, "rule", "verdict"])


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """Return (id, host, path, rule, verdict), one row per input row.

    The longest fitting rule decides: its host is the url's host or a parent domain, and the url's path starts
    with its path.  Without a fitting rule the rule is NULL and the verdict is ``default``, as for a url that is in
    no list.  NULL and malformed urls have an empty host and path.  Repeated rows are judged each; other columns of
    the input are ignored; an empty table or rule list is fine.
    """
    sc = pages.sparkSession.sparkContext
    content = digest_file(rules)
    name = f"rules-{xxhash.xxh64_hexdigest(content)}.sda"
    if name not in map(os.path.basename, sc.listFiles):
        sc.addFile(local_copy(name, content))
    split = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    schema = T.StructType([*split.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    return split.mapInArrow(lambda batches: _judge(batches, name, default), schema)


def judge_by_join(pages: DataFrame, rules: DataFrame, lengths: list[int], id_col: str = "page_id", url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """The same for a table of rules (host, path, verdict) of any size: candidate keys meet the rules in a shuffle join.

    ``lengths`` are the path lengths that occur in the rules.  The id must be unique.
    """
    split = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = F.explode(F.flatten(F.transform(suffixes, lambda s: F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path")), lambda n: F.concat(s, F.substring(F.col("path"), F.lit(1), n))))))
    known = rules.groupBy(F.concat("host", "path").alias("rule")).agg(F.max(F.col("verdict")).alias("verdict"))
    best = split.select(id_col, keys.alias("rule")).join(known, "rule").groupBy(id_col).agg(F.max_by(F.struct("rule", "verdict"), F.length("rule")).alias("best"))
    return split.join(best, id_col, "left").select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
