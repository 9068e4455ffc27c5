"""Decontamination gives the same texts whatever the size of the benchmark's blocks."""

import random

from orderlark.llm import decontaminate
from orderlark.llm.common import alnum_words


def test_no_window_is_left_at_any_block_size(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    items = [(i if i else None, " ".join(rng.choice(words) for _ in range(6))) for i in range(8)]
    texts = []
    for i in range(40):
        body = [f"x{rng.randrange(50)}" for _ in range(60)]
        for _ in range(rng.randrange(3)):
            # An item inside another one: it appears in full once the inner one is cut.
            outer, inner = rng.choice(items)[1].split(), rng.choice(items)[1].split()
            at, cut = rng.randrange(60), rng.randrange(7)
            body[at:at] = outer[:cut] + inner + outer[cut:]
        texts.append((i, " ".join(body), "a", "b", "c"))
    docs = spark.createDataFrame([*texts, (99, None, None, None, None)], "doc_id long, text string, hits string, lost string, row string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    windows = {tuple(t.encode().split()) for _, t in items}
    found = []
    for block_words in (6, 20, 100_000):
        kept = decontaminate.remove_spans(docs, benchmark, window=6, max_coverage=1.0, block_words=block_words).collect()
        found.append(sorted(map(tuple, kept), key=str))
        for r in kept:
            held = alnum_words((r["text"] or "").encode())
            assert not windows & {tuple(held[i : i + 6]) for i in range(len(held))}
    assert found[0] == found[1] == found[2] and len(found[0]) == 41
    assert decontaminate.find_spans(docs, benchmark, window=6).count() == 41
