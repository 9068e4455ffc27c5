"""Whitening, URL rules and vector codes against brute force, and on odd rows."""

import hashlib
import re

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from orderlark.llm import url_rules, vector_codes, whitening
from orderlark.llm.common import fixed_point, table

INF, NAN = float("inf"), float("nan")
# Extra columns bear names that the operators use themselves.
VECTORS = "vec_id long, embedding array<float>, label int, x string, n string, h1 string, part string, index string, code string, error string, whitened string, v string"
BAD = [(90, None), (91, [1.0, None, 0.0, 0.5]), (92, [INF, 0.0, 0.0, 0.0]), (93, [NAN, 0.0, 0.0, 0.0]), (94, []), (95, [1.0, 2.0])]


def vector_table(spark, rows):
    return spark.createDataFrame([(i, v, None if i is None or i % 3 == 0 else i % 2, *["a"] * 9) for i, v in rows], VECTORS)


def odd_rows(seed=3, n=60, d=4):
    made = np.random.default_rng(seed).normal(0, 0.2, (n, d)).astype(np.float32)
    rows = [(i, [float(c) for c in made[i % 40]]) for i in range(n)]
    return [*rows, (None, rows[0][1]), (5, rows[7][1]), (5, rows[5][1]), (-1, [-0.0] * d), (70, [-3.5] * d), *BAD]


def whole(rows):
    good = [(i, v) for i, v in rows if v and len(v) == 4 and all(c is not None and np.isfinite(c) for c in v)]
    return [i for i, _ in good], np.floor(256 * np.array([v for _, v in good], np.float64)).astype(np.int64)


# 11


def check_whitening(found, ids, x):
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    got = {}
    for r in found:
        got.setdefault(r["component"], []).append(r)
    assert set(got) == set(range(1, 1 + min(4, x.shape[1])))
    for k, rows in got.items():
        want = (x - sums / n) @ vectors[:, -k] / np.sqrt(values[-k])
        deviations = ((n * x - sums) ** 2).sum(axis=1)
        key = lambda t: (t[0] is None, t[0] or 0, t[1], t[2])
        for sign in (1, -1):
            a = sorted([(r["vec_id"], r["deviation"], r["whitened"]) for r in rows], key=key)
            b = sorted([(i, int(dv), sign * w) for i, dv, w in zip(ids, deviations, want)], key=key)
            if [t[:2] for t in a] == [t[:2] for t in b] and np.allclose([t[2] for t in a], [t[2] for t in b], atol=1e-9):
                break
        else:
            raise AssertionError(f"component {k}")
        assert all(r["n"] == n and abs(r["explained"] / (values[-k] / values.sum()) - 1) < 1e-9 and r["identity_error"] < 1e-9 for r in rows)


def test_whitening_of_the_table(spark):
    rows = table(spark, SF, "embeddings").orderBy("vec_id").collect()
    x = np.floor(256 * np.array([r["embedding"] for r in rows], np.float64)).astype(np.int64)
    check_whitening(whitening.op11_whitening(spark, SF).collect(), [r["vec_id"] for r in rows], x)


def test_whitening_of_odd_rows_in_small_blocks(spark, monkeypatch, forced_skew):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 8)
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 3)
    monkeypatch.setattr(whitening, "SPLIT_BLOCKS", 2)
    rows = odd_rows()
    check_whitening(whitening.whitened(vector_table(spark, rows)).collect(), *whole(rows))


def test_whitening_of_a_hot_vector(spark, forced_skew):
    rows = [*odd_rows(), *[(100 + i, [0.25, 0.5, -0.25, 0.0]) for i in range(200)]]
    check_whitening(whitening.whitened(vector_table(spark, rows)).collect(), *whole(rows))


def test_whitening_without_variance(spark):
    assert whitening.whitened(vector_table(spark, BAD[:5])).count() == 0
    same = whitening.whitened(vector_table(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert {(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same} == {(i, k, 1, 0, None, 0.0, None) for i in (1, 2) for k in (1, 2)}
    line = whitening.whitened(vector_table(spark, [(1, [0.5, 0.25]), (2, [0.25, 0.5])])).collect()
    assert {(r["component"], r["whitened"] is None) for r in line} == {(1, False), (2, True)}
    huge = whitening.whitened(vector_table(spark, [(1, [1e38, 0.25]), (2, [0.25, 0.5]), (3, [0.0, 0.0])])).collect()
    assert len(huge) == 6 and all(r["deviation"] is None for r in huge)


def test_whitening_matches_schema_when_empty(spark):
    empty = whitening.whitened(vector_table(spark, [])).schema
    full = whitening.whitened(vector_table(spark, odd_rows())).schema
    assert [(f.name, f.dataType) for f in empty] == [(f.name, f.dataType) for f in full]


# 12

URLS = [
    None,
    "",
    "no scheme.org/es/",
    "HTTP://Example.ORG/es/a",
    "https://example.org",
    "https://example.org?x=.org/",
    "http://a.example.org/en/12?q#f",
    "http://badexample.org/en/12",
    "http://x.com/FR/",
    "http://x.com/fr/",
    "ftp://user@h.net:80/de/a.pdf",
    "http://h.net/cart?x=1",
    "http://h.net/cartoon/x",
    "http://h.net/a/Casino/b",
    "http://casino.example.net/",
    "http://mycasino.example.net/",
    "http://docs.h.net/search/",
    "http://h.net/search/",
    "http://h.net/?SessionID=3",
    "http://h.net/tag/x/page/3",
    "http://h.net/ключ\n://x/ads/y",
    "a://b://c.org/es/#://",
    "http://h.net/" + "long/" * 20_000 + "ads/",
    "http://h.net/sp%C3%A4m",
]
PAGES = "page_id long, url string, host string, path string, rule string, verdict string, index string, target string, candidates string"


def brute_force(url, rules):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    lower = host.translate({c: c + 32 for c in range(65, 91)})
    target = lower + rest[len(host) :]
    for r in rules:
        if target and re.search(r.regex, target):
            return lower, path, r.text if r.base else None, r.verdict, None if r.base else r.text
    return lower, path, None, "allow", None


def test_url_rules_against_brute_force(spark):
    df = spark.createDataFrame([(i, u, *["a"] * 7) for i, u in [*enumerate(URLS), (None, URLS[3]), (3, URLS[3])]], PAGES)
    # A pattern without a bounded token and one that two patterns share.
    rules = [*url_rules.ruleset(), *[url_rules.pattern_rule(p, "block") for p in ("sp%c3", "*onlin*", "|h.net/sp")]]
    found = url_rules.judged(df, rules).collect()
    want = [(i, *brute_force(u, rules)) for i, u in [*enumerate(URLS), (None, URLS[3]), (3, URLS[3])]]
    assert sorted([tuple(r)[:6] for r in found], key=repr) == sorted(want, key=repr)
    assert {r["page_id"]: r["pattern"] for r in found}[23] == "sp%c3"
    verdicts = {r["page_id"]: (r["rule"], r["verdict"]) for r in found}
    assert verdicts[6] == ("example.org/en/1", "block") and verdicts[9] == ("com/fr/", "allow") and verdicts[7] == ("org/", "allow")
    # Rules whose rarest token is missing from a URL are not run on it.
    assert max(r["candidates"] for r in found) < len(rules) / 4


def test_url_rules_are_filed_under_their_rarest_token(spark):
    targets = spark.createDataFrame([("a.net/common/x",), ("b.net/common/y",), ("c.net/rare/common/",)], "target string")
    index = url_rules.rule_index(targets, [url_rules.pattern_rule("/rare/common/", "block"), url_rules.pattern_rule("*open*", "block")]).first()["index"]
    assert [e["token"] for s in index["slots"] for e in s] == ["rare"]
    assert [r["text"] for r in index["always"]] == ["*open*"]


def test_url_rules_of_an_empty_table(spark):
    assert url_rules.judged(spark.createDataFrame([], PAGES)).count() == 0
    with pytest.raises(ValueError):
        url_rules.judged(spark.createDataFrame([], PAGES), url_rules.ruleset() * 2000)


def test_url_rules_run_no_python_and_shuffle_no_urls(spark):
    plan = url_rules.op12_url_rules(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "Exchange" not in plan.split("Subquer")[0]


# 13


def codes_by_brute_force(ids, labels, x, parts, entries, rounds):
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, x[i].tolist()))[:entries]
    cut = np.array_split(x, parts, axis=1)
    books = [c[order].copy() for c in cut]
    for last in [False] * rounds + [True]:
        distances = [((c[:, None, :] - b[None]) ** 2).sum(axis=2) for c, b in zip(cut, books)]
        index = [d.argmin(axis=1) for d in distances]
        if not last:
            for c, b, k in zip(cut, books, index):
                for e in set(k.tolist()):
                    b[e] = c[k == e].sum(axis=0) // (k == e).sum()
    errors = sum(d.min(axis=1) for d in distances)
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    total = lambda label: int(sum(e for e, b in zip(errors, labels) if b == label))
    return [(i, "".join(f"{k[r]:02x}" for k in index), int(errors[r]), total(labels[r]), sha) for r, i in enumerate(ids)]


def test_vector_codes_of_odd_rows(spark):
    rows = odd_rows()
    ids, x = whole(rows)
    labels = [None if i is None or i % 3 == 0 else i % 2 for i in ids]
    for parts, entries in ((2, 5), (3, 64), (4, 100)):
        found = vector_codes.compressed(vector_table(spark, rows), parts=parts, entries=entries)
        want = codes_by_brute_force(ids, labels, x, parts, entries, 2)
        assert sorted([tuple(r) for r in found.collect()], key=repr) == sorted(want, key=repr)


def test_vector_codes_of_wide_numbers(spark):
    rows = [(i, [1e9 * (i % 7), -3e8, 0.5, float(i)]) for i in range(30)]
    found = vector_codes.compressed(vector_table(spark, rows).withColumn("embedding", F.col("embedding").cast("array<double>")), parts=2, entries=4).collect()
    x = np.floor(256 * np.array([v for _, v in rows])).astype(np.int64).astype(object)
    want = codes_by_brute_force([i for i, _ in rows], [None if i % 3 == 0 else i % 2 for i, _ in rows], x, 2, 4, 2)
    most = 2**63 - 1
    assert {r["vec_id"]: (r["code"], r["error"]) for r in found} == {w[0]: (w[1], w[2] if w[2] <= most else None) for w in want}


def test_vector_codes_of_an_empty_table(spark):
    assert vector_codes.compressed(vector_table(spark, BAD[:5])).count() == 0


def test_trie_finds_the_nearest_entry():
    rng = np.random.default_rng(5)
    parts = np.unique(rng.integers(-6, 6, (4000, 5)), axis=0)
    entries = rng.integers(-6, 6, (64, 5))
    distances = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
    for leaves in (1, 7, 100, 10_000):
        index, least = vector_codes.nearest(parts, entries, leaves)
        assert (index == distances.argmin(axis=1)).all() and (least == distances.min(axis=1)).all()


def test_fixed_point_takes_the_frequent_length(spark):
    kept = fixed_point(vector_table(spark, [(1, [0.5]), (2, [-0.001, 1.0]), (3, [0.0, 0.0])]))
    assert sorted((r["vec_id"], r["x"]) for r in kept.collect()) == [(2, [-1, 256]), (3, [0, 0])]
