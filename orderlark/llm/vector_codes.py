"""Vector code compression: product codes from a lexicographic trie over distinct parts.

Vectors become whole numbers (common.fixed_point) and are cut into PARTS consecutive parts.
Each part position has a codebook of at most ENTRIES entries, at first the parts of the rows
with the smallest ids. A round assigns every part to its nearest entry and replaces each entry
by the floored mean of its parts; after the rounds parts are assigned once more.

Assignment works on Arrow batches. The distinct parts of a batch, in lexicographic order, are
the leaves of a trie whose levels are the part's dimensions. A depth-first traversal carries
the distances to all entries accumulated so far, so that parts with a common prefix share
them; a subtree of at most LEAVES leaves is finished level by level in one step. Leaves take
the argmin and the sums weighted with the number of their copies. Tasks hand on one row per
entry and dimension, whatever they read, and the driver holds the codebooks alone. All numbers
are exact, so the batches, tasks and retries do not change a result, and no vector is shuffled.

Defined results: rows whose vector is null, empty, of another length than most, or holds null
or non-finite entries are left out; rows of one id are ordered by their vector when the first
entries are taken, null ids last; with fewer rows than ENTRIES there are as many entries;
entries no part is assigned to stay; a length that PARTS does not divide gives the first
parts one dimension more; an error that no long can hold is null, as is a sum of such; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlark.llm.common import fixed_point, table
from orderlark.operators.skew import null_safe_join
from orderlark.session import stored

PARTS = 16
ENTRIES = 64  # at most 256: a code has two hex digits a part
ROUNDS = 2
LEAVES = 2048
#: Numbers up to this size keep all distances and sums of a batch within 64 bits.
PLAIN = 1 << 24

Codebooks = list[np.ndarray]  # per part, entries x dimensions


def nearest(parts: np.ndarray, entries: np.ndarray, leaves: int = LEAVES) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of distinct parts in lexicographic order."""
    n, depth = parts.shape
    index, distance = np.empty(n, np.int64), np.empty(n, entries.dtype)
    # fresh[d, i]: the prefix of i up to dimension d is not that of the leaf before.
    fresh = np.ones((depth, n), bool)
    fresh[:, 1:] = np.logical_or.accumulate((parts[1:] != parts[:-1]).T, axis=0)
    squares = lambda values, d: (values[:, None] - entries[None, :, d]) ** 2
    open_ = [(0, n, 0, np.zeros(len(entries), entries.dtype))]
    while open_:
        start, end, level, so_far = open_.pop()
        heads, sums = np.array([start]), so_far[None, :]
        for d in range(level, depth):
            below = start + np.flatnonzero(fresh[d, start:end])
            parent = np.searchsorted(heads, below, side="right") - 1
            if end - start > leaves:
                ends = [*below[1:].tolist(), end]
                sums = so_far + squares(parts[below, d], d)
                open_.extend((a, b, d + 1, s) for a, b, s in reversed(list(zip(below.tolist(), ends, sums, strict=True))))
                break
            heads, sums = below, sums[parent] + squares(parts[below, d], d)
        else:
            index[start:end] = sums.argmin(axis=1)
            distance[start:end] = sums[np.arange(end - start), index[start:end]]
    return index, distance


def batch_matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def assigned(x: np.ndarray, codebooks: Codebooks) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per part position: distinct parts, their copies, the leaf of each row, and the index
    and distance of each leaf's nearest entry."""
    at = 0
    largest = max(int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))), *(int(np.abs(e).max(initial=0)) for e in codebooks))
    exact = np.int64 if largest <= PLAIN else object
    for entries in codebooks:
        part = x[:, at : at + entries.shape[1]]
        at += entries.shape[1]
        order = np.lexsort(part.T[::-1])
        ordered = part[order]
        first = np.concatenate(([True], (ordered[1:] != ordered[:-1]).any(axis=1)))
        leaf = np.empty(len(x), np.int64)
        leaf[order] = np.cumsum(first) - 1
        leaves = ordered[first].astype(exact)
        yield leaves, np.bincount(leaf), leaf, *nearest(leaves, entries.astype(exact))


def first_codebooks(kept: DataFrame, parts: int, entries: int) -> Codebooks:
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()
    if not rows:
        return []
    x = np.array([r["x"] for r in rows], object)
    return np.array_split(x, parts, axis=1)


def refined(kept: DataFrame, codebooks: Codebooks) -> Codebooks:
    """One round: entries become the floored means of the parts assigned to them."""

    def add(batches):
        totals = [np.zeros(e.shape, object) for e in codebooks]
        counts = [np.zeros(len(e), np.int64) for e in codebooks]
        for batch in batches:
            if not batch.num_rows:
                continue
            for p, (leaves, copies, _, index, _) in enumerate(assigned(batch_matrix(batch), codebooks)):
                weighted = np.zeros(totals[p].shape, leaves.dtype)
                np.add.at(weighted, index, leaves * copies[:, None].astype(leaves.dtype))
                totals[p] += weighted
                counts[p] += np.bincount(index, copies, len(counts[p])).astype(np.int64)
        rows = [(p, e, d, int(counts[p][e]), str(int(totals[p][e, d]))) for p, t in enumerate(totals) for e, d in np.ndindex(*t.shape) if counts[p][e]]
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "place", "n", "total"])

    sums = kept.select("x").mapInArrow(add, "part int, entry int, place int, n long, total string")
    found = sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    out = [e.copy() for e in codebooks]
    for r in found:
        out[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return out


def trained(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    codebooks = first_codebooks(kept, parts, entries)
    for _ in range(rounds if codebooks else 0):
        codebooks = refined(kept, codebooks)
    return codebooks


def encoded(kept: DataFrame, codebooks: Codebooks) -> DataFrame:
    """The rows with code and error in place of x."""
    names = [c for c in kept.columns if c != "x"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "x")
    most = np.iinfo(np.int64).max

    def encode(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, errors = np.empty((batch.num_rows, len(codebooks)), np.uint8), 0
            for p, (_, _, leaf, index, distance) in enumerate(assigned(batch_matrix(batch), codebooks)):
                codes[:, p] = index[leaf]
                errors = errors + distance[leaf]
            text, width = codes.tobytes().hex(), 2 * len(codebooks)
            found = [text[i : i + width] for i in range(0, len(text), width)]
            error = pa.array([e if e <= most else None for e in errors.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(found, pa.string()), error], names=[*names, "code", "error"])

    return kept.select(*names, "x").mapInArrow(encode, f"{kinds}, code string, error long")


def digest(codebooks: Codebooks) -> str:
    return hashlib.sha256(",".join(str(int(v)) for e in codebooks for v in e.ravel()).encode()).hexdigest()


def compressed(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error (of all rows of the label) and the codebooks' digest."""
    kept = fixed_point(df, id_col, vec_col, label=label_col)
    codebooks = trained(kept, parts, entries, rounds)
    coded = stored(encoded(kept, codebooks), "codes")
    per_label = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count_if(F.col("error").isNull()).alias("_lost"))
    per_label = per_label.select("label", F.when(F.col("_lost") == 0, F.col("label_error")).alias("label_error"))
    out = null_safe_join(coded, per_label, ["label"])
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_vector_codes": op13_vector_codes}


def _round(old: str, new: str, at: int) -> str:
    means = ", ".join(f"floor(sum(q[{i}])::DOUBLE / count(*))::BIGINT" for i in range(1, 5))
    return f"""
{new} AS MATERIALIZED (SELECT c.part, c.k, coalesce(m.q, c.q) AS q FROM {old} c
  LEFT JOIN (SELECT part, k, [{means}] AS q FROM a{at} GROUP BY part, k) m USING (part, k)),"""


def _assign(books: str, at: int) -> str:
    apart = " + ".join(f"(p.q[{i}] - c.q[{i}]) * (p.q[{i}] - c.q[{i}])" for i in range(1, 5))
    return f"""
a{at} AS MATERIALIZED (SELECT row, part, any_value(q) AS q, min(d * 64 + k) % 64 AS k, min(d) AS d
  FROM (SELECT p.row, part, p.q, c.k, {apart} AS d FROM p JOIN {books} c USING (part)) GROUP BY row, part),"""


ORACLE = {
    "op13_vector_codes": f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS MATERIALIZED (SELECT row, vec_id, part, x[4 * part + 1:4 * part + 4] AS q FROM v, range(16) t(part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS k, q
  FROM p JOIN (SELECT row FROM v ORDER BY vec_id LIMIT 64) USING (row)),{_assign("c0", 1)}{_round("c0", "c1", 1)}{_assign("c1", 2)}{_round("c1", "c2", 2)}{_assign("c2", 3)}
s AS (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY part, k)) AS codebooks_sha256 FROM c2),
e AS (SELECT row, string_agg(printf('%02x', k), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a3 GROUP BY row)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM v JOIN e USING (row), s""",
}
