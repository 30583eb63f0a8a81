"""Periodic runs against a plain search for all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import ODD_DOCS, documents, sorted_rows
from webloom.llm import runs


def plain_runs(words, least_length=6, least_periods=4):
    """Every stretch of equal words q apart, kept if no smaller period holds in all of it."""
    n, out = len(words), []
    for q in range(1, n // least_periods + 1):
        at = 0
        while at + q < n:
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - at + q
            stretch = words[at : at + length]
            smaller = any(all(stretch[k] == stretch[k + p] for k in range(length - p)) for p in range(1, q))
            if end > at and length >= max(least_length, least_periods * q) and not smaller:
                out.append((at, length, q))
            at = max(end, at + 1) if end == at else end + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_summary(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = sorted(found, key=lambda r: (-r[1], r[0], r[2]))[:1]
    top = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(2, 4), st.integers(2, 8))
def test_runs_equal_trying_all_periods(letters, periods, least):
    words = [b"abc"[x : x + 1] for x in letters]
    assert runs.find_runs(words, least, periods) == plain_runs(words, least, periods)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=5), st.integers(1, 9)), max_size=5))
def test_runs_of_repeated_parts(parts):
    words = [b"abcd"[x : x + 1] for part, times in parts for _ in range(times) for x in part]
    assert runs.find_runs(words) == plain_runs(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=40))
def test_tree_orders_suffixes_and_knows_common_extensions(letters):
    tree, n = runs.SuffixTree(letters), len(letters)
    assert sorted(range(n + 1), key=lambda i: letters[i:]) == np.argsort(tree.rank).tolist()
    turned = [2 - x for x in letters]
    assert sorted(range(n + 1), key=lambda i: turned[i:]) == np.argsort(tree.mirrored_rank()).tolist()
    pairs = [(i, j) for i in range(n) for j in range(n) if i != j]
    if pairs:
        a, b = (np.array(x) for x in zip(*pairs))
        want = [next((k for k in range(n) if max(i, j) + k >= n or letters[i + k] != letters[j + k]), n) for i, j in pairs]
        assert tree.common(a, b).tolist() == want


def test_long_and_nested_runs():
    assert runs.find_runs([b"a"] * 100_000) == [(0, 100_000, 1)]
    words = ([b"x"] * 8 + [b"y"]) * 500
    assert runs.find_runs(words) == plain_runs(words[:200])[:0] + sorted([(0, 4500, 9)] + [(9 * k, 8, 1) for k in range(500)], key=lambda r: (r[0], r[2]))
    fib = [b"a", b"ab"]
    while len(fib[-1]) < 2000:
        fib.append(fib[-1] + fib[-2])
    letters = [fib[-1][i : i + 1] for i in range(400)]
    assert runs.find_runs(letters, 2, 2) == plain_runs(letters, 2, 2)


def test_no_runs_in_few_words():
    assert runs.find_runs([]) == runs.find_runs([b"a"] * 5) == []
    with pytest.raises(ValueError):
        runs.find_runs([b"a"] * 9, least_periods=1)


def docs_with_runs():
    rng, rows = random.Random(3), []
    for k in range(120):
        words = [rng.choice("the of a tion er".split()) for _ in range(rng.randint(0, 60))]
        at = rng.randint(0, len(words))
        part = [rng.choice("the of a".split()) for _ in range(rng.randint(1, 4))]
        rows.append((k, " ".join(words[:at] + part * rng.randint(0, 9) + words[at:])))
    return rows + [(1000 + i, "one\ttwo\x0b three\x1cfour\xa0five\n" * i) for i in range(8)] + ODD_DOCS


def test_summaries_equal_plain_version(spark):
    rows = docs_with_runs()
    rows = [(i, t if t is None or len(t) < 40_000 else t[-300:]) for i, t in rows]
    found = runs.summarise(documents(spark, rows))
    assert sorted_rows(found, *found.columns) == sorted([plain_summary(i, t) for i, t in rows], key=repr)
    assert sum(plain_summary(i, t)[1] > 0 for i, t in rows) > 40


def test_very_long_text_null_and_empty_table(spark):
    found = {r.doc_id: r for r in runs.summarise(documents(spark)).collect()}
    assert (found[7].start, found[7].length, found[7].period, found[7].exponent_milli) == (1, 20_000, 1, 20_000_000)
    assert found[2].n_runs == 0 and found[2].start is None and found[2].collapsed_sha256 == hashlib.sha256(b"").hexdigest()
    assert runs.summarise(documents(spark, [])).collect() == []


def test_runs_and_collapsed_text_beside_the_rows(spark):
    given = documents(spark, [(1, "so so so so so so good\nno"), (2, None)])
    got = {r.doc_id: r for r in runs.with_runs(given).collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 6, 1)] and got[1].collapsed == "so good no" and got[1].key == "key"
    assert got[2].runs == [] and got[2].collapsed == ""
    with pytest.raises(ValueError):
        runs.with_runs(given.withColumnRenamed("key", "Runs"))
