"""The score of a match against a plain loop in single precision, and against known values."""

import random
from math import exp, sqrt

import numpy as np
import pytest

from test_documents import T0, docs
from webloom.operators import results, search
from webloom.operators.postings import build_postings

f32 = np.float32


def plain_near(positions):
    res = f32(-1)
    for i in range(len(positions)):
        for k in range(i):
            for x in positions[i]:
                for y in positions[k]:
                    d = abs(x - y)
                    if not d:
                        continue
                    wd = f32(1e-30) if d > 100 else f32(1.0 / (1.005 + 0.05 * exp(float(f32(d)) / 1.5 - 2)))
                    w = f32(sqrt(f32(f32(0.1) * f32(0.1)) * wd))
                    res = w if res < 0 else f32(1.0 - (1.0 - float(res)) * (1.0 - float(w)))
    return f32(1e-20) if res < 0 else res


def plain_often(positions):
    res = f32(0)
    for found in positions:
        if found:
            total = f32(0)
            for j in range(len(found)):
                total = f32(total + f32(f32(0.1) / f32((j + 1) ** 2)))
            res = f32(float(res) + float(f32(f32(f32(0.1) + total) - f32(0.1))) / 1.64493406685)
    return f32(res / f32(len(positions)))


def counted(words, term):
    found = []
    for at, word in enumerate(words):
        if word == term and (p := min(at + 1, 16383)) not in found[-1:] and len(found) < 255:
            found.append(p)
    return found


TEXTS = {
    "a1": "cat dog",
    "a2": "cat x dog",
    "a3": "dog cat dog cat",
    "a4": "cat",
    "a5": "bird cat " + "x " * 150 + "dog",
    "a6": "cat " * 300 + "dog",
    "a7": "x " * 16400 + "cat dog cat dog dog",
    "a8": "bird bird bird dog",
    "a9": "cat cat",
}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    texts = TEXTS | {f"r{k}": " ".join(rng.choices(["cat", "dog", "bird", "x", "y"], k=rng.randint(1, 40))) for k in range(60)}
    table = docs(spark, [(key, f"u/{key}", None, text, T0, 0.5) for key, text in texts.items()]).persist()
    return texts, table, build_postings(table, english=False).persist()


@pytest.mark.parametrize(
    ("query", "phrase", "terms", "near"),
    [
        ("cat", False, ["cat"], False),
        ("dog cat", False, ["cat", "dog"], True),
        ("cat bird dog", False, ["bird", "cat", "dog"], True),
        ("cat dog", True, ["cat", "dog"], True),
        ('"cat dog" bird', False, ["bird", "cat", "dog"], True),
        ("cat cat", False, ["cat"], False),
        ('"cat cat"', False, ["cat"], False),
        ("dog -cat", False, ["cat", "dog"], True),
        ("cat or dog", False, ["cat", "dog"], False),
        ("cat dog or bird -x", False, ["bird", "cat", "dog", "x"], False),
        ("-cat", False, ["cat"], False),
        ('-"cat dog"', False, ["cat", "dog"], False),
    ],
)
def test_scores_equal_a_plain_loop(corpus, query, phrase, terms, near):
    texts, table, postings = corpus
    read = search.read_phrase if phrase else search.read_query
    found = search.matches(table, postings, read(table, query, False), "ts_rank").collect()
    assert found
    for row in found:
        words = ("  " + texts[row.link_id]).split()
        positions = [counted(words, t) for t in terms]
        want = plain_near(positions) if near else plain_often(positions)
        assert f32(row.relevance) == want == row.relevance, (row, want)


def test_known_values(corpus):
    _, table, postings = corpus

    def score(text, key):
        rows = search.matches(table, postings, search.read_query(table, text, False), "ts_rank").collect()
        return {r.link_id: r.relevance for r in rows}[key]

    assert score("cat", "a4") == pytest.approx(0.06079271, abs=1e-8)
    assert score("cat", "a9") == pytest.approx(0.075990885, abs=1e-8)
    assert score("cat dog", "a1") == pytest.approx(0.09910322, abs=1e-8)
    assert score("cat dog", "a2") == pytest.approx(0.098500855, abs=1e-8)
    assert score("cat or bird", "a4") == pytest.approx(0.030396355, abs=1e-8)
    assert score("bird -cat", "a8") == pytest.approx(1e-20)


def test_least_relevant_first_and_the_other_way_round(corpus):
    texts, table, postings = corpus
    near = {k: plain_near([counted(t.split(), w) for w in ("cat", "dog")]) for k, t in texts.items() if {"cat", "dog"} <= set(t.split())}
    for order, sign in (("asc", 1), ("desc", -1)):
        want = sorted(near, key=lambda k: (sign * near[k], k))
        page = search.search(table, postings, "dog cat", english=False, relevance_order=order, limit=None).page
        assert [r.link_id for r in page.collect()] == want
        last = page.collect()[4]
        rest = search.search(table, postings, "dog cat", english=False, relevance_order=order, after=(last.relevance, 0.5, last.link_id))
        assert [r.link_id for r in rest.page.collect()] == want[5:15]
    hits = results.search_results(table, postings, "dog cat", english=False).hits.collect()
    assert [r.link_id for r in hits] == sorted(near, key=lambda k: (near[k], k))[:10]


def test_rankings_are_named(corpus):
    _, table, postings = corpus
    with pytest.raises(ValueError):
        search.search(table, postings, "cat", ranking="bm25")
    plain = search.search(table, postings, "cat", english=False, ranking="log_tf", limit=None).page.collect()
    assert {r.link_id: r.relevance for r in plain}["a9"] == pytest.approx(1 + np.log(2), abs=1e-6)


def test_only_positions_of_phrases_are_gathered(corpus):
    _, table, postings = corpus

    def gathered(text):
        found = search.matches(table, postings, search.read_query(table, text, False), "ts_rank")
        return "collect_list" in found._jdf.queryExecution().executedPlan().toString()

    assert gathered('"cat dog" or bird') and gathered("cat dog")
    assert not gathered("cat or dog or bird")
