"""Secret scans with corpus-wide ownership frequency.

Each text is scanned once. The base kinds (assign, access, hex) count as found whatever their
value. Further candidates, opaque values behind a bearer word and free-standing mixed tokens,
are only shapes. Whether a value is a live credential is told by who holds it: the values of all
spans, base ones included, are hashed without full stops at their end, and each hash is counted
by distinct owners and distinct repositories over the whole corpus, in whatever shape it is
written. A value that several owners or many repositories hold is a copied example; one that
stays with its owner is owner-specific. Base spans are all reported, with their verdict; a
further candidate is reported as an added span if it looks random and is owner-specific.

Copies are reduced to (hash, owner, repository) before they are counted, and only the hashes
of owner-specific values meet the spans again, in a join Spark can split.

Defined results: a null or empty text has no spans; rows are documents, so a repeated id
gives a row each time (equal rows count as one repository); null owners and repositories
count as one of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlark.llm.common import table
from orderlark.session import stored

MOST_OWNERS = 1
MOST_REPOSITORIES = 20
MIN_ENTROPY = 3.5  # bits a character

# The base kinds, in order. Letters of the key words are in either case.
KEY_WORDS = ("password", "passwd", "secret", "token", "api_?key")
_EITHER = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in KEY_WORDS)
ASSIGN = re.compile(rf"""({_EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")
BASE_KINDS = ("assign", "access", "hex")
# Added shapes: a value after an authorisation word, and a free-standing token of mixed kinds.
# A full stop parts free-standing tokens and does not end a bearer value.
BEARER = re.compile(r"\b[Bb]earer\x20+([A-Za-z0-9+/_.=-]{15,}[A-Za-z0-9+/_=-])")
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
KINDS = (*BASE_KINDS, "bearer", "opaque")


def entropy(value: str) -> float:
    counts = Counter(value).values()
    return -sum(n / len(value) * math.log2(n / len(value)) for n in counts)


def looks_random(value: str) -> bool:
    """Letters of both cases and digits, without much repetition."""
    kinds = any("a" <= c <= "z" for c in value) + any("A" <= c <= "Z" for c in value) + any("0" <= c <= "9" for c in value)
    return kinds == 3 and entropy(value) >= MIN_ENTROPY


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base kinds, by start and then kind."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def added_candidates(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Spans of the added shapes that look random and overlap no base span."""
    found = [(m.start(), 3, m.end(), m[1]) for m in BEARER.finditer(text) if looks_random(m[1])]
    found += [(m.start(), 4, m.end(), m[0]) for m in OPAQUE.finditer(text) if looks_random(m[0])]
    out, at, end = [], 0, -1
    for span in sorted(found):
        while at < len(taken) and taken[at][2] <= span[0]:
            at += 1
        if span[0] >= end and (at == len(taken) or taken[at][0] >= span[2]):
            out.append(span)
            end = span[2]
    return out


def hashed(value: str) -> bytes:
    """Hash of a value without the full stops of a sentence that ends with it."""
    return hashlib.sha256((value.rstrip(".") or value).encode()).digest()[:16]


SCANNED = "doc_id long, text_hash long, owner string, repository string, spans array<struct<start:int,kind:int,end:int,value:binary,base:boolean>>"


def scanned(docs: DataFrame, text_col: str, id_col: str, owner_col: str, repository_col: str) -> DataFrame:
    """Candidate spans of every document, values as hashes only."""
    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(owner_col).cast("string").alias("owner"), F.col(repository_col).cast("string").alias("repository"), F.col(text_col).alias("text")
    )
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.binary()), ("base", pa.bool_())]))

    def scan(batches):
        for batch in batches:
            spans = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                found = [(*s, True) for s in base] + [(*s, False) for s in added_candidates(text or "", base)]
                spans.append([{"start": a, "kind": k, "end": e, "value": hashed(v), "base": b} for a, k, e, v, b in sorted(found)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names[:4]), pa.array(spans, kind)], names=[*batch.schema.names[:4], "spans"])

    return slim.mapInArrow(scan, SCANNED)


def ownership(found: DataFrame) -> DataFrame:
    """value, n_spans, n_repositories, n_owners, verdict: one row for each distinct value."""
    each = found.select("owner", "repository", F.explode("spans").alias("s")).select("owner", "repository", "s.value")
    held = each.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = held.groupBy("value", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("r"))
    by_value = by_owner.groupBy("value").agg(F.sum("n").alias("n_spans"), F.sum("r").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"))
    own = (F.col("n_owners") <= MOST_OWNERS) & (F.col("n_repositories") <= MOST_REPOSITORIES)
    return by_value.withColumn("verdict", F.when(own, "owner-specific").otherwise("copied example"))


def located(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", owner_col: str = "source", repository_col: str = "doc_id") -> DataFrame:
    """doc_id and its reported spans (start, kind, end, value hash, base, own: whether the value
    is owner-specific), one row per document: all base spans, and added ones that are own."""
    found = stored(scanned(docs, text_col, id_col, owner_col, repository_col), "spans")
    live = ownership(found).where("verdict = 'owner-specific'").select("value")
    # Documents with values to decide; those that repeat an id and text decide together.
    values = F.array_distinct(F.transform("spans", lambda s: s["value"]))
    each = found.where(F.size("spans") > 0).select("doc_id", "text_hash", F.explode(values).alias("value")).distinct()
    per_doc = each.join(live, "value", "left_semi").groupBy("doc_id", "text_hash").agg(F.collect_set("value").alias("_live"))
    per_doc = per_doc.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    joined = found.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    judged = F.transform("spans", lambda s: s.withField("own", F.coalesce(F.array_contains("_live", s["value"]), F.lit(False))))
    return joined.select("doc_id", F.filter(judged, lambda s: s["base"] | s["own"]).alias("spans"))


def redacted(text: str, spans: list[tuple[int, int]], mark: str = "[secret]") -> str:
    """A text with spans (start, end) replaced."""
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _joined(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = located(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{KINDS[k]}")
    verdicts = F.array_join(F.transform("spans", lambda s: F.when(s["own"], "owner-specific").otherwise("copied example")), ",")
    n = lambda own: F.size(F.filter("spans", lambda s: s["own"] == F.lit(own))).cast("long")
    return found.select(
        "doc_id", count(0), count(1), count(2), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        verdicts.alias("verdicts"), n(True).alias("n_owner_specific"), n(False).alias("n_copied_example"),
    )


QUERIES = {"op1_secret_scan": op1_secret_scan}
ORACLE = {}
