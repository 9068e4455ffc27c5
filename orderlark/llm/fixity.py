"""Merkle fixity audit of WARC archives.

Pages are rendered as WARC resource records. Each replica is a table of its own, hashed and laid
out alone in one logical archive by id, url and digest; offsets come from running sums inside
range partitions plus the totals before them. A tree's leaves are fixed ranges of the hashed keys
(id, url), as many as the larger archive has RANGE_BYTES, so that a lost or added record moves no
other to another leaf: the hash of the digests and copies of its records. FANOUT neighbours make a
node of the next level, up to one root. Roots are compared first, and a level's nodes only below
nodes that differ. Only records of ranges that differ are joined in full: equal digests are set off
against each other, what is left of a key is paired in order, and the rest is missing or extra.

Records are hashed where they are read; only digests and lengths travel. A range has about as
many records as fit into its bytes, a node FANOUT children; a group grows only with the different
payloads of one key.

Defined results: null urls and payloads count as empty, a null id is written as empty and
comes first; rows equal in all three are one run of copies; two empty archives have no findings;
other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlark.llm.common import table
from orderlark.session import stored

RANGE_BYTES = 1 << 20
FANOUT = 16
PART_ROWS = 200_000  # records in one range partition of the layout
BREAK = "\r\n"


def record(id_: Column, url: Column, payload: Column) -> Column:
    """A WARC resource record as text."""
    payload = F.coalesce(payload, F.lit(""))
    head = [
        F.lit(f"WARC/1.1{BREAK}WARC-Type: resource{BREAK}WARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit(f"{BREAK}WARC-Record-ID: <urn:page:"),
        F.coalesce(id_.cast("string"), F.lit("")),
        F.lit(f">{BREAK}Content-Type: text/html{BREAK}Content-Length: "),
        F.octet_length(payload).cast("string"),
        F.lit(BREAK * 2),
    ]
    return F.concat(*head, payload, F.lit(BREAK * 2))


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """id, url, length, digest and copies of the records of one replica."""
    text = record(F.col(id_col), F.col(url_col), F.col(payload_col))
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(url_col, F.lit("")).alias("url"), F.octet_length(text).cast("long").alias("length"), F.sha2(text, 256).alias("digest"))
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))


def replicas(pages: DataFrame, other: Column, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """The archive of pages, and that of a second replica made from them: `other` is its payload,
    null where it has lost the record."""
    its = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), other.alias("payload")).where("payload IS NOT NULL")
    return archive(pages, id_col, url_col, payload_col), archive(its, "id", "url", "payload")


def located(records: DataFrame) -> DataFrame:
    """Add each record's offset in the archive."""
    keys = ["id", "url", "digest"]
    rows = stored(records, "records")
    parts = max(1, math.ceil(rows.count() / PART_ROWS))
    laid = stored(rows.repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id()), "laid")
    bytes_ = F.col("length") * F.col("copies")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = laid.groupBy("part").agg(F.sum(bytes_).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    # One row a partition of the layout.
    placed = laid.withColumn("_upto", F.sum(bytes_).over(inside)).join(F.broadcast(totals), "part")
    return placed.withColumn("offset", F.col("start") + F.col("_upto") - bytes_).drop("part", "start", "_upto")


def tree(entries: DataFrame, nodes: int) -> list[DataFrame]:
    """Levels of (node, hash) from the `nodes` ranges up to the root, of entries (node, length,
    copies, digest)."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("digest", "length", "copies"))), lambda x: F.concat_ws(":", *[x[c].cast("string") for c in ("length", "copies", "digest")]))
    level = entries.groupBy("node").agg(F.sha2(F.array_join(listed, ","), 256).alias("hash"))
    levels = [stored(level, "tree")]
    while nodes > 1:
        children = F.transform(F.sort_array(F.collect_list(F.struct("node", "hash"))), lambda x: F.concat_ws(":", x["node"].cast("string"), x["hash"]))
        level = levels[-1].groupBy(F.floor(F.col("node") / FANOUT).alias("up")).agg(F.sha2(F.array_join(children, ","), 256).alias("hash"))
        levels.append(stored(level.withColumnRenamed("up", "node"), "tree"))
        nodes = math.ceil(nodes / FANOUT)
    return levels


def differing(mine: list[DataFrame], other: list[DataFrame]) -> DataFrame:
    """The ranges (node) whose hashes differ, found from the root down."""
    below = None
    for a, b in zip(reversed(mine), reversed(other), strict=True):
        pair = [a, b]
        if below is not None:
            pair = [x.withColumn("up", F.floor(F.col("node") / FANOUT)).join(below, "up", "left_semi").drop("up") for x in pair]
        met = pair[0].join(pair[1].withColumnRenamed("hash", "its"), "node", "full")
        differ = stored(met.where(~F.col("hash").eqNullSafe(F.col("its"))).select("node"), "differing")
        below = differ.withColumnRenamed("node", "up")
    return below.withColumnRenamed("up", "node")


def audit(archives: tuple[DataFrame, DataFrame]) -> DataFrame:
    """The records that two archives do not share: id, url, and offset, length, copies and digest
    in the first and (other_...) in the second, null where it has none, and what is wrong."""
    placed = [stored(located(x), "placed") for x in archives]
    end = max(x.agg(F.sum(F.col("length") * F.col("copies"))).first()[0] or 0 for x in placed)
    nodes = max(1, math.ceil(end / RANGE_BYTES))
    ranged = [x.withColumn("node", F.pmod(F.xxhash64(F.col("id").cast("string"), "url"), F.lit(nodes)).cast("long")) for x in placed]
    ranges = differing(*[tree(x, nodes) for x in ranged])
    mine, its = (x.join(ranges, "node", "left_semi").drop("node") for x in ranged)
    # Equal records are set off against each other; what is over stays with its side.
    equal = lambda x: x.select(F.col("id").alias("_id"), F.col("url").alias("_url"), F.col("digest").alias("_digest"), F.col("copies").alias("_copies"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("url") == F.col("_url")) & (F.col("digest") == F.col("_digest"))
    over = F.col("copies") - F.coalesce("_copies", F.lit(0))
    order = Window.partitionBy("id", "url").orderBy("digest")
    left = [
        a.join(equal(b), same, "left").withColumn("copies", over).where("copies > 0").select("id", "url", "offset", "length", "copies", "digest", F.row_number().over(order).alias("_n"))
        for a, b in ((mine, its), (its, mine))
    ]
    first = left[0].withColumnsRenamed({"id": "_id", "url": "_url", "_n": "_m"})
    second = left[1].withColumnsRenamed({c: f"other_{c}" for c in ("offset", "length", "copies", "digest")})
    pair = F.col("_id").eqNullSafe(F.col("id")) & (F.col("_url") == F.col("url")) & (F.col("_m") == F.col("_n"))
    met = first.join(second, pair, "full")
    wrong = F.when(F.col("other_digest").isNull(), "missing").when(F.col("digest").isNull(), "extra").when(F.col("other_length") != F.col("length"), "length").otherwise("content")
    here = lambda a, b: F.when(F.col("digest").isNotNull(), F.col(a)).otherwise(F.col(b)).alias(b)
    columns = ["offset", "length", "copies", "digest", "other_offset", "other_length", "other_copies", "other_digest"]
    return met.select(here("_id", "id"), here("_url", "url"), *columns, wrong.alias("damage"))


def damaged(payload: Column, id_: Column) -> Column:
    """The replica that the query audits: by id, some payloads have another first character,
    some lack their second half, some are lost."""
    text = F.coalesce(payload, F.lit(""))
    return (
        F.when(id_ % 307 == 3, F.lit(None))
        .when(id_ % 211 == 13, F.substring(text, F.lit(1), F.floor(F.char_length(text) / 2).cast("int")))
        .when(id_ % 97 == 5, F.concat(F.lit("x"), F.substr(text, F.lit(2))))
        .otherwise(text)
    )


def op3_fixity(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    replica = stored(pages.withColumn("html", damaged(F.col("html"), F.col("page_id"))).where("html IS NOT NULL"), "replica")
    found = audit((archive(pages), archive(replica)))
    return found.select(F.col("id").alias("page_id"), F.col("offset").alias("record_offset"), "length", "copies", F.col("digest").alias("expected_sha256"), F.col("other_digest").alias("found_sha256"), "damage")


QUERIES = {"op3_fixity": op3_fixity}

_RECORD = (
    "'WARC/1.1' || nl || 'WARC-Type: resource' || nl || 'WARC-Target-URI: ' || url || nl || 'WARC-Record-ID: <urn:page:' || id || '>' || nl "
    "|| 'Content-Type: text/html' || nl || 'Content-Length: ' || strlen({0}) || nl || nl || {0} || nl || nl"
)
ORACLE = {
    "op3_fixity": f"""
WITH p AS (SELECT page_id, coalesce(page_id::VARCHAR, '') AS id, coalesce(url, '') AS url, coalesce(html, '') AS html, chr(13) || chr(10) AS nl,
    CASE WHEN page_id % 307 = 3 THEN NULL WHEN page_id % 211 = 13 THEN substr(coalesce(html, ''), 1, length(coalesce(html, '')) // 2)
         WHEN page_id % 97 = 5 THEN 'x' || substr(coalesce(html, ''), 2) ELSE coalesce(html, '') END AS other FROM pages),
r AS (SELECT page_id, url, {_RECORD.format('html')} AS rec, {_RECORD.format('other')} AS its FROM p),
g AS (SELECT page_id, url, strlen(rec) AS length, sha256(rec) AS digest, strlen(its) AS other_length, sha256(its) AS other, count(*) AS copies FROM r GROUP BY ALL),
o AS (SELECT *, coalesce(sum(length * copies) OVER (ORDER BY page_id NULLS FIRST, url, digest, other NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS record_offset FROM g)
SELECT page_id, record_offset::BIGINT AS record_offset, length, copies, digest AS expected_sha256, other AS found_sha256,
  CASE WHEN other IS NULL THEN 'missing' WHEN other_length <> length THEN 'length' ELSE 'content' END AS damage
FROM o WHERE other IS DISTINCT FROM digest""",
}
