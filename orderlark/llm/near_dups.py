"""MinHash near-dedup: universal hash minima, banding, verification, star components.

1. One Arrow pass gives each text its class (digest of its lower-cased words), the size of
   its shingle set, and HASHES minima of multiply-shift hashes. Copies of a text fall
   together here and travel on as one class.
2. Classes that share one of BANDS band keys of ROWS minima form a bucket. A large bucket is
   dealt into parts, and each pair of parts is one bounded group of rows. A task compares
   the minima inside a group and hands on only a spanning forest of the pairs that agree
   often enough for a link to be possible, at most one row for each row it got.
3. The forests' components are clusters that no link leaves. Their full shingle sets are
   compared in the same manner, in bounded groups, and again only a spanning forest of the
   confirmed links goes on.
4. Both forests become components by alternating large-star and small-star steps; then the
   smallest document ids spread to all copies.

With 24 bands of 5 minima a pair at the threshold of 0.85 meets in no band with probability
(1 - 0.85^5)^24 < 1e-6, and a closer pair with less. No bucket or cluster is capped.

Defined results: null and empty texts have no shingles and are linked with nothing (each is
its own component); a text of fewer words than a shingle has its whole sequence as its only
one; rows are documents, so a repeated doc_id gives a row each time; a null doc_id counts as
no id when the smallest is taken; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlark.llm.common import packed, space_words, table, text_bytes
from orderlark.session import stored

SHINGLE = 3
THRESHOLD = 85  # per cent of the union
BANDS, ROWS = 24, 5
HASHES = BANDS * ROWS
#: Pairs whose share of equal minima is this many deviations below the threshold are no link.
SLACK = 5
#: Sizes of a part of a bucket in classes and of a cluster in shingles.
PART_CLASSES = 1024
PART_SHINGLES = 400_000

_SEEDS = np.random.default_rng(20240229)
_A = _SEEDS.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _SEEDS.integers(0, 2**63, HASHES, dtype=np.uint64)
_MIX = _SEEDS.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
CHUNK = 2048  # shingles hashed at a time


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[60]
    return (x ^ (x >> np.uint64(29))) * _MIX[61] ^ (x >> np.uint64(32))


def word_hashes(texts: Sequence[Sequence[bytes]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """64-bit hashes of the distinct words of some texts, and each text as places in them."""
    code: dict[bytes, int] = {}
    coded = [np.array([code.setdefault(w, len(code)) for w in words], np.int64) for words in texts]
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in code), np.uint64, len(code)), coded


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct 64-bit hashes of the n-word shingles, from 64-bit word hashes."""
    if len(words) == 0:
        return words
    if len(words) < n:
        whole = np.bitwise_xor.reduce(_stir(words * _MIX[: len(words)])) + np.uint64(len(words))
        return _stir(np.array([whole], np.uint64))
    total = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        total += words[i : len(words) - n + 1 + i] * _MIX[32 + i]
    return np.unique(_stir(total))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of every universal hash over the set, as 32 high bits."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        block = hashes[at : at + CHUNK]
        np.minimum(least, (_A[:, None] * block[None, :] + _B[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """The band keys of signatures, one row each."""
    rows = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    return _stir((rows * _MIX[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _MIX[40]).view(np.int64)


SKETCH = "doc_id long, row_hash long, class binary, n_shingles long, signature binary"


def sketches(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """One row per document: its class, set size and minima (null without words)."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row_hash"), F.col(text_col).alias("text"))

    def sketch(batches):
        for batch in batches:
            texts = [space_words(t) for t in text_bytes(batch, "text")]
            hashed, coded = word_hashes(texts)
            out: dict[str, list] = {"class": [], "n_shingles": [], "signature": []}
            for words, codes in zip(texts, coded, strict=True):
                found = shingle_hashes(hashed[codes], shingle)
                out["n_shingles"].append(len(found))
                if len(found) == 0:
                    for c in ("class", "signature"):
                        out[c].append(None)
                    continue
                out["class"].append(hashlib.md5(b" ".join(words)).digest())
                out["signature"].append(minima(found).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_hash"), pa.array(out["class"], pa.binary()), pa.array(out["n_shingles"], pa.int64()), pa.array(out["signature"], pa.binary())],
                names=["doc_id", "row_hash", "class", "n_shingles", "signature"],
            )

    return slim.mapInArrow(sketch, SKETCH)


def banded(classes: DataFrame) -> DataFrame:
    """(class, band): a row for each band key of a class."""

    def spread(batches):
        for batch in batches:
            if batch.num_rows:
                signatures = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES)
                names = batch.column("class").take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))
                yield pa.RecordBatch.from_arrays([names, pa.array(band_keys(signatures).ravel())], names=["class", "band"])

    return classes.select("class", "signature").mapInArrow(spread, "class binary, band long")


def paired_parts(rows: DataFrame, key: str, parts: Column) -> DataFrame:
    """Deal each key's rows into parts and give every pair of parts (i, j) its rows, so that
    any two rows of a key meet in a group that holds two parts at most."""
    own = F.pmod(F.xxhash64("class", F.lit(7)), F.col("_parts"))
    dealt = rows.withColumn("_parts", parts.cast("long")).withColumn("_own", own)
    met = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    paired = met.withColumns({"i": F.least("_own", "_other"), "j": F.greatest("_own", "_other")}).drop("_parts", "_own", "_other")
    return paired.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of sorted rows, with the groups' bounds."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = pa.Table.from_batches(held).combine_chunks()
        bounds = _bounds(rows, key)
        if len(bounds) > 2:
            yield rows.slice(0, bounds[-2]), bounds[:-1]
            held = rows.slice(bounds[-2]).combine_chunks().to_batches()
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        yield rows, _bounds(rows, key)


def _bounds(rows: pa.Table, key: str) -> np.ndarray:
    changes = np.zeros(rows.num_rows, bool)
    for name in (key, "i", "j"):
        column = rows.column(name).combine_chunks()
        if len(column) > 1:
            same = pc.equal(column.slice(1), column.slice(0, len(column) - 1))
            changes[1:] |= ~np.asarray(same.to_numpy(zero_copy_only=False), bool)
    return np.concatenate(([0], np.flatnonzero(changes), [rows.num_rows]))


def least_labels(adjacent: np.ndarray) -> np.ndarray:
    """For each row of a symmetric adjacency matrix, the least row of its component."""
    labels = np.arange(len(adjacent))
    while True:
        reached = np.minimum(labels, np.where(adjacent, labels[None, :], len(labels)).min(axis=1))
        reached = np.minimum(reached, reached[reached])
        if (reached == labels).all():
            return labels
        labels = reached


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Counts of equal minima between all rows of two signature matrices."""
    out = np.empty((len(a), len(b)), np.int16)
    for at in range(0, len(a), 64):
        out[at : at + 64] = (a[at : at + 64, None, :] == b[None, :, :]).sum(axis=2, dtype=np.int16)
    return out


def least_agreement(threshold: int) -> float:
    share = threshold / 100
    return (share - SLACK * (share * (1 - share) / HASHES) ** 0.5) * HASHES


FOREST = "a binary, b binary"


def _edges(names: pa.Array, a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    ends = [names.take(pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))) for x in (a, b)]
    return pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in ends], names=["a", "b"])


def likely(buckets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """A spanning forest of the pairs of a bucket whose minima agree often enough."""
    least = least_agreement(threshold)

    def compare(batches):
        for rows, bounds in whole_groups(batches, "band"):
            signatures = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES)
            sizes, a, b = np.diff(bounds), [], []
            for size in (2, 3):  # most buckets: compared in one step
                starts = bounds[:-1][sizes == size]
                for x, y in combinations(range(size), 2):
                    near = (signatures[starts + x] == signatures[starts + y]).sum(axis=1) >= least
                    a.append(starts[near] + x)
                    b.append(starts[near] + y)
            for start, end in zip(bounds[:-1][sizes > 3].tolist(), bounds[1:][sizes > 3].tolist(), strict=True):
                own = signatures[start:end]
                labels = least_labels(agreement(own, own) >= least)
                moved = np.flatnonzero(labels != np.arange(len(labels)))
                a.append(moved + start)
                b.append(labels[moved] + start)
            yield _edges(rows.column("class").combine_chunks(), a, b)

    return buckets.mapInArrow(compare, FOREST)


def confirmed(clusters: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """A spanning forest of the links of a cluster, found on the full shingle sets."""
    least = least_agreement(threshold)

    def compare(batches):
        for rows, bounds in whole_groups(batches, "cluster"):
            a, b = [], []
            packed_sets, packed = rows.column("shingles").to_pylist(), rows.column("signature").to_pylist()
            for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                sets = [np.frombuffer(x, np.uint64) for x in packed_sets[start:end]]
                sizes = np.array([len(x) for x in sets])
                signatures = np.frombuffer(b"".join(packed[start:end]), np.uint32).reshape(-1, HASHES)
                labels = np.arange(len(sets))
                # Rows with the most likely links first: what they join is not compared again.
                near = agreement(signatures, signatures) >= least
                for one in np.argsort(-near.sum(axis=1), kind="stable").tolist():
                    others = np.flatnonzero(near[one] & (labels != labels[one]) & (100 * np.minimum(sizes, sizes[one]) >= threshold * np.maximum(sizes, sizes[one])))
                    if not len(others):
                        continue
                    pooled = np.concatenate([sets[x] for x in others])
                    at = np.minimum(np.searchsorted(sets[one], pooled), sizes[one] - 1)
                    both = np.add.reduceat(sets[one][at] == pooled, np.concatenate(([0], np.cumsum(sizes[others])[:-1])), dtype=np.int64)
                    for other in others[100 * both >= threshold * (sizes[others] + sizes[one] - both)].tolist():
                        if labels[other] != labels[one]:
                            labels[labels == labels[other]] = labels[one]
                            a.append(np.array([start + one]))
                            b.append(np.array([start + other]))
            yield _edges(rows.column("class").combine_chunks(), a, b)

    return clusters.mapInArrow(compare, FOREST)


def shingle_sets(docs: DataFrame, wanted: DataFrame, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The full sorted shingle set of each wanted class (class, row_hash), from one of its texts."""
    picked = docs.select(F.xxhash64(text_col).alias("row_hash"), F.col(text_col).alias("text"))
    picked = picked.join(wanted.select("row_hash").distinct(), "row_hash", "left_semi")

    def sets(batches):
        for batch in batches:
            words = [space_words(t) for t in text_bytes(batch, "text")]
            hashed, coded = word_hashes(words)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([hashlib.md5(b" ".join(w)).digest() for w in words], pa.binary()),
                    pa.array([shingle_hashes(hashed[c], shingle).tobytes() for c in coded], pa.binary()),
                ],
                names=["class", "shingles"],
            )

    named = picked.select("text").mapInArrow(sets, "class binary, shingles binary")
    # Copies of a text share its row hash, so each class comes once for every copy.
    return named.join(wanted.drop("row_hash"), "class").groupBy("class").agg(*[F.first(c).alias(c) for c in ("shingles", *wanted.drop("row_hash", "class").columns)])


def star_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of undirected links (a, b), root being the least node.

    Large-star hangs all greater neighbours of a node under its least neighbour, small-star
    hangs the lesser ones and the node itself there; alternating both ends in stars. Only
    least neighbours are aggregated, never neighbour lists.
    """

    def least(directed: DataFrame) -> DataFrame:
        """(node, m): the least of a node and its neighbours."""
        return directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    def large(edges: DataFrame) -> DataFrame:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        joined = both.join(least(both), "u").where("v > u AND v != m")
        return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()

    def small(edges: DataFrame) -> DataFrame:
        down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        joined = down.join(least(down), "u")
        rehung = joined.where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return rehung.union(joined.select("u", "m").distinct()).distinct()

    edges, before = stored(links.select("a", "b").where("a != b").distinct(), "links"), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64(F.greatest("a", "b"), F.least("a", "b")).cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        edges = stored(small(large(edges)), "links")
    stars = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    return stars.union(stars.select("root", "root").distinct())


def linked_classes(classes: DataFrame, docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(node, root) of all classes that are linked with another one."""
    spread = stored(banded(classes), "bands")
    shared = spread.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = spread.join(shared, "band").join(classes.select("class", "signature"), "class")
    near = star_components(likely(paired_parts(members, "band", F.ceil(F.col("n") / PART_CLASSES)), threshold))
    clusters = near.select(F.col("node").alias("class"), F.col("root").alias("cluster")).join(classes.select("class", "row_hash", "n_shingles", "signature"), "class")
    sets = stored(shingle_sets(docs, clusters, text_col, shingle), "sets")
    totals = sets.groupBy("cluster").agg(F.sum("n_shingles").alias("total"))
    rows = sets.join(totals, "cluster").drop("n_shingles")
    return star_components(confirmed(paired_parts(rows, "cluster", F.ceil(F.col("total") / PART_SHINGLES)).drop("total"), threshold))


def components(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, row_hash, class, root, n_shingles, component_id, kept: one row per document;
    root is the least class of the component, null without words."""
    rows = stored(sketches(docs, text_col, id_col, shingle), "sketches")
    with_words = rows.where("class IS NOT NULL")
    classes = stored(
        with_words.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.min("row_hash").alias("row_hash"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")),
        "classes",
    )
    roots = linked_classes(classes, docs, text_col, shingle, threshold)
    named = classes.select("class", "doc_id").join(roots.withColumnsRenamed({"node": "class"}), "class", "left").withColumn("root", F.coalesce("root", "class"))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    labels = named.join(smallest, "root").select("class", "root", "component_id")
    out = with_words.join(labels, "class").select("doc_id", "row_hash", "class", "root", "n_shingles", "component_id")
    alone = rows.where("class IS NULL").select("doc_id", "row_hash", "class", F.col("class").alias("root"), "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each component, that of the smallest id; all documents without words.

    Where several rows of a component bear its smallest id, the one with the least hash stays.
    """
    found = components(docs, text_col, id_col, shingle, threshold)
    with_words = found.where("kept AND class IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("kept_id"), F.min("row_hash").alias("kept_hash"), F.count(F.lit(1)).alias("n"))
    empty = found.where("class IS NULL").select(F.lit(None).cast("binary").alias("root"), F.col("doc_id").alias("kept_id"), F.col("row_hash").alias("kept_hash"), F.lit(1).cast("long").alias("n")).distinct()
    # Two components may keep equal rows only if these have no words.
    keep = stored(with_words.unionByName(empty).drop("root"), "kept")
    hashed = packed(docs, id=F.col(id_col).cast("long"), hash=F.xxhash64(text_col))
    chosen = hashed.join(keep, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("kept_hash")))
    out = chosen.where("n = 1")
    if not keep.where("n > 1").isEmpty():
        out = out.unionByName(chosen.where("n > 1").dropDuplicates(["id", "hash"]))
    return out.select("row.*")


def op4_near_dups(spark, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op4_near_dups": op4_near_dups}

ORACLE = {
    "op4_near_dups": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS g
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
both_ways AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.b FROM reach r JOIN both_ways l ON l.a = r.y)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m AS component_id, m = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) r ON r.x = d.doc_id""",
}
