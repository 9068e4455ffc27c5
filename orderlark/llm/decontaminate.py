"""Benchmark decontamination with a generalised suffix automaton over the test items.

The items' word sequences are put into one automaton per bounded block of items. Documents
are streamed through it word by word: the state and the length of the longest match that
ends at each word are carried along, and a match of at least `window` words marks its words
as hit. A word that no item holds resets the automaton, so only runs of known words are
stepped through; that skips work, not matches.

Each block of items holds at most about BLOCK_WORDS words, which bounds the broadcast; a
larger benchmark is met in further passes over the documents, each with its own block.

Defined results: a null or empty text has no words and is clean; a null or empty item has no
windows; an item with a null id hits words, but is not among the items met; repeated items and documents are handled row by row; an empty benchmark leaves every
document clean; an empty document table gives an empty result; other columns pass through
remove_spans, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlark.llm.common import ALNUM_WORDS, alnum_words, packed, table, text_bytes
from orderlark.session import stored

WINDOW = 10
BLOCK_WORDS = 100_000
#: A longer item is cut into overlapping pieces of this many words, which keep every window.
PIECE_WORDS = 20_000
#: Blocks of items that one pass over the documents carries at a time.
BLOCKS_PER_PASS = 4
#: A document with a larger share of hit words goes whole; below it only the spans go.
MAX_COVERAGE = 0.2


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, annotated with the items that hold
    each window. States are numbered; 0 is the start."""

    def __init__(self, items: Iterable[tuple[int, Sequence[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.go: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for item, words in items:
            if words:
                ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
                coded.append((item, ids))
                self._insert(ids)
        self._annotate(coded)

    def _state(self, length: int, go: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.go.append(go)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, source: int, word: int, target: int) -> int:
        """The state that stands for the part of `target` reached from `source` in one word."""
        if self.length[target] == self.length[source] + 1:
            return target
        part = self._state(self.length[source] + 1, dict(self.go[target]), self.link[target])
        self.link[target] = part
        while source >= 0 and self.go[source].get(word) == target:
            self.go[source][word] = part
            source = self.link[source]
        return part

    def _insert(self, ids: Sequence[int]) -> None:
        last = 0
        for word in ids:
            known = self.go[last].get(word)
            if known is not None:
                last = self._split(last, word, known)
                continue
            new, at = self._state(self.length[last] + 1, {}, 0), last
            while at >= 0 and word not in self.go[at]:
                self.go[at][word] = new
                at = self.link[at]
            if at >= 0:
                self.link[new] = self._split(at, word, self.go[at][word])
            last = new

    def _holder(self, state: int, n: int) -> int:
        """The state of the last n words of a match in `state`."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _annotate(self, coded: list[tuple[int, list[int]]]) -> None:
        self.items: dict[int, set[int]] = {}  # holder of a full window -> items
        self.short: dict[int, list[tuple[int, int]]] = {}  # state -> (words, item) of short items
        self.holder = [0] * len(self.length)
        for state in range(1, len(self.length)):
            if self.length[state] >= self.window:
                self.holder[state] = self._holder(state, self.window)
        for item, ids in coded:
            state = 0
            for at, word in enumerate(ids):
                state = self.go[state][word]
                if at + 1 >= self.window:
                    self.items.setdefault(self.holder[state], set()).add(item)
            if len(ids) < self.window:
                self.short.setdefault(self._holder(state, len(ids)), []).append((len(ids), item))
        # The nearest state at or above each that ends a short item.
        self.above = [0] * len(self.length)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            self.above[state] = state if state in self.short else self.above[self.link[state]]
        self.least = min([self.window if self.items else math.inf, *(n for v in self.short.values() for n, _ in v)])

    def match(self, words: Sequence[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit intervals (first, end) in words, not merged, and the items met."""
        hits: list[tuple[int, int]] = []
        met: set[int] = set()
        if len(words) < self.least:
            return hits, met
        get = self.vocabulary.get
        codes = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], codes >= 0, [False])).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        longest = ends - starts >= self.least
        go, link, length, window = self.go, self.link, self.length, self.window
        for start, end in zip(starts[longest].tolist(), ends[longest].tolist(), strict=True):
            state, size = 0, 0
            for at, word in enumerate(codes[start:end].tolist(), start):
                while word not in go[state]:
                    state = link[state]
                    size = length[state]
                state = go[state][word]
                size += 1
                if size >= window:
                    hits.append((at - size + 1, at + 1))
                    met |= self.items[self.holder[state]]
                up = self.above[state]
                while up:
                    for n, item in self.short[up]:
                        if n <= size:
                            hits.append((at - n + 1, at + 1))
                            met.add(item)
                    up = self.above[link[up]]
        return hits, met


def item_blocks(items: DataFrame, id_col: str, text_col: str, window: int = WINDOW, block_words: int = BLOCK_WORDS):
    """Yield the benchmark as automata of bounded size, one block of items at a time.

    Items longer than PIECE_WORDS are cut into pieces that overlap by window - 1 words, and
    pieces are dealt over blocks by hash, so a block's size does not grow with the benchmark.
    """
    clean = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    clean = clean.where("text IS NOT NULL").distinct()
    step = PIECE_WORDS - window + 1

    def pieces(batches):
        for batch in batches:
            out = []
            for item, text in zip(batch.column("item").to_pylist(), text_bytes(batch, "text"), strict=True):
                words = alnum_words(text)
                for at in range(0, max(1, len(words) - window + 1), step):
                    if words:
                        out.append((item, b" ".join(words[at : at + PIECE_WORDS]).decode(), len(words[at : at + PIECE_WORDS])))
            yield pa.RecordBatch.from_pydict(
                {"item": [x[0] for x in out], "piece": [x[1] for x in out], "n": [x[2] for x in out]},
                schema=pa.schema({"item": pa.string(), "piece": pa.string(), "n": pa.int64()}),
            )

    cut = stored(clean.mapInArrow(pieces, "item string, piece string, n long"), "items")
    total = cut.agg(F.sum("n")).first()[0] or 0
    blocks = math.ceil(total / block_words)
    dealt = cut.withColumn("block", F.pmod(F.xxhash64("item", "piece"), F.lit(max(1, blocks))))
    for block in range(blocks):
        rows = dealt.where(F.col("block") == block).orderBy("item", "piece").collect()
        yield SuffixAutomaton([(r["item"], r["piece"].encode().split()) for r in rows], window)


def find_spans(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Add n_words, hits (word positions inside a matched window) and items (ids met, sorted)."""
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("n_words", "hits", "items")]
    out = docs.select(
        *kept, F.lit(0).cast("long").alias("n_words"), F.expr("CAST(array() AS array<int>)").alias("hits"), F.expr("CAST(array() AS array<string>)").alias("items")
    )
    schema = out.schema
    automata = list_or_empty(item_blocks(items, item_id, item_text, window))
    for number, automaton in enumerate(automata):
        shared = spark.sparkContext.broadcast(automaton)

        def scan(batches, shared=shared):
            automaton = shared.value
            for batch in batches:
                counts, hits, met = [], [], []
                before = zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True)
                for text, (old_hits, old_items) in zip(text_bytes(batch, text_col), before, strict=True):
                    words = alnum_words(text)
                    spans, items_met = automaton.match(words)
                    counts.append(len(words))
                    hits.append(sorted({*old_hits, *(i for a, b in merged(spans) for i in range(a, b))}) if spans else old_hits)
                    met.append(sorted({*old_items, *(x for x in items_met if x is not None)}) if items_met else old_items)
                arrays = {"n_words": pa.array(counts, pa.int64()), "hits": pa.array(hits, pa.list_(pa.int32())), "items": pa.array(met, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([arrays.get(c, batch.column(c)) for c in batch.schema.names], names=batch.schema.names)

        out = out.mapInArrow(scan, schema)
        if number % BLOCKS_PER_PASS == BLOCKS_PER_PASS - 1:
            out = stored(out, "scanned")
    return out


def list_or_empty(automata: Iterable[SuffixAutomaton]) -> Iterable[SuffixAutomaton]:
    """At least one automaton, so that words are counted without items too."""
    empty = True
    for automaton in automata:
        empty = False
        yield automaton
    if empty:
        yield SuffixAutomaton([], WINDOW)


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_spans(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_coverage: float = MAX_COVERAGE, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """Documents without benchmark passages: spans of at least `window` matched words are cut
    out, and a document that loses more than max_coverage of its words goes whole.

    Cutting can bring the words around a span together, so a cut text is matched again until
    no item hits it; words that are cut in such a later round count as lost too. Each round
    cuts what all items together hit, so the size of the blocks changes nothing. Texts without
    a hit come back unchanged, byte for byte.
    """
    spark = docs.sparkSession
    automata = [spark.sparkContext.broadcast(a) for a in item_blocks(items, item_id, item_text, window, block_words)]
    if not automata:
        return docs
    zero = F.lit(0).cast("long")
    rows = packed(docs, text=F.col(text_col), n_words=zero, lost=zero, hits=F.expr("CAST(array() AS array<int>)"))
    schema, to_the_end = rows.schema, len(automata) == 1

    def scan(batches, shared):
        for batch in batches:
            hits = batch.column("hits").to_pylist()
            for i, raw in enumerate(text_bytes(batch, "text")):
                spans, _ = shared.value.match(alnum_words(raw))
                if spans:
                    hits[i] = sorted({*hits[i], *(at for a, b in merged(spans) for at in range(a, b))})
            yield batch.set_column(batch.schema.get_field_index("hits"), "hits", pa.array(hits, pa.list_(pa.int32())))

    def cut(batches):
        for batch in batches:
            texts, words, lost = (batch.column(c).to_pylist() for c in ("text", "n_words", "lost"))
            for i, (raw, hits) in enumerate(zip(text_bytes(batch, "text"), batch.column("hits").to_pylist(), strict=True)):
                found = alnum_words(raw)
                words[i] = max(words[i], len(found))
                spans = automata[0].value.match(found)[0] if to_the_end else [(at, at + 1) for at in hits]
                while spans:
                    texts[i], n = without(texts[i], merged(spans))
                    lost[i] += n
                    # With a single block a text is finished here.
                    spans = automata[0].value.match(alnum_words(texts[i].encode()))[0] if to_the_end else []
            arrays = {"text": pa.array(texts, batch.column("text").type), "n_words": pa.array(words, pa.int64()), "lost": pa.array(lost, pa.int64())}
            yield pa.RecordBatch.from_arrays([arrays.get(c, batch.column(c)) for c in batch.schema.names], names=batch.schema.names)

    out = None
    if to_the_end:
        out = rows.mapInArrow(cut, schema)
    while out is None or not to_the_end:
        for number, shared in enumerate(automata):
            rows = rows.mapInArrow(lambda batches, shared=shared: scan(batches, shared), schema)
            if number % BLOCKS_PER_PASS == BLOCKS_PER_PASS - 1:
                rows = stored(rows, "scanned")
        rows = stored(rows.mapInArrow(cut, schema), "cut")
        clean = rows.where("size(hits) = 0")
        out = clean if out is None else out.unionByName(clean)
        rows = rows.where("size(hits) > 0").withColumn("hits", F.expr("CAST(array() AS array<int>)"))
        if rows.isEmpty():
            break
    kept = out.where(F.col("lost") <= F.lit(max_coverage) * F.col("n_words"))
    return kept.withColumn("row", F.col("row").withField(f"`{text_col}`", F.col("text"))).select("row.*")


def without(text: str, spans: Sequence[tuple[int, int]]) -> tuple[str, int]:
    """The text without the words of the spans and what stands between them; words cut."""
    places = [m.span() for m in re.finditer("[^ ]+", text.encode().translate(ALNUM_WORDS).decode())]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    out.append(text[at:])
    return "".join(out), sum(b - a for a, b in spans)


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The digest columns of the query."""
    slim = docs.select("doc_id", "text")
    found = find_spans(slim, items)
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op2_decontaminate": op2_decontaminate}

ORACLE = {
    "op2_decontaminate": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
          FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT r, i, win.n, item_id FROM grams JOIN win USING (n, g)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN ids USING (r)""",
}
