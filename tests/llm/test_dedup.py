"""Line dedup, SimHash, I-Match and the pipeline against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from helpers import ODD_DOCS, documents, sorted_rows
from webloom.llm import imatch, linededup, packing, quality, simhash
from webloom.session import fresh_path

# -- line dedup ---------------------------------------------------------------

LINES = ["A shared line of text", "  a SHARED line of text\t", "short", "another line, rather long", "unique line number", "", "ÄÖ shared line", "äÖ shared line"]


def lined_documents(seed, first, count):
    draw = random.Random(seed)
    return [(first + k, "\n".join(draw.choice(LINES) + ("" if draw.random() < 0.7 else str(k)) for _ in range(draw.randint(0, 6)))) for k in range(count)]


def plain_lines(rows):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for i, text in rows:
        if i is not None and text is not None:
            for line in text.split("\n"):
                if len(key(line)) >= 10:
                    holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        given = (text or "").split("\n")
        lost = [line for line in given if i is not None and len(holders.get(key(line), ())) > 1 and min(holders[key(line)]) != i]
        kept = [line for line in given if not (i is not None and len(holders.get(key(line), ())) > 1 and min(holders[key(line)]) != i)]
        out.append((i, None if text is None else "\n".join(kept), len(given), len(lost)))
    return sorted(out, key=repr)


def test_lines_equal_a_plain_count(spark):
    rows = lined_documents(1, 100, 60) + ODD_DOCS
    docs = documents(spark, rows)
    kept = linededup.drop_repeated(docs, linededup.build(docs, shards=3))
    assert kept.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert sorted_rows(kept, "doc_id", "text", "n_lines", "n_dropped") == plain_lines(rows)


def test_no_lines(spark):
    docs = documents(spark, [])
    assert linededup.drop_repeated(docs, linededup.build(docs, shards=2)).count() == 0


def counts_of(index):
    return sorted_rows(index.counts, "hi", "lo", "n", "min_doc", "max_doc")


def test_inserting_and_deleting_is_reversible(spark):
    first, second = lined_documents(1, 0, 40), lined_documents(2, 20_000, 40)
    a, b = documents(spark, first), documents(spark, second)
    one = linededup.store(linededup.build(a, shards=4))
    two = linededup.store(linededup.insert(one, b))
    assert counts_of(two) == counts_of(linededup.build(a.unionByName(b), shards=4))
    back = linededup.store(linededup.delete(two, b))
    assert counts_of(back) == counts_of(one)
    early = linededup.delete(two, a.where("doc_id < 30"))
    assert counts_of(early) == counts_of(linededup.build(a.unionByName(b).where("doc_id >= 30"), shards=4))
    nothing = linededup.delete(back, a)
    assert nothing.counts.count() == 0
    assert counts_of(linededup.delete(one, spark.createDataFrame([(987654,), (None,)], "doc_id long"))) == counts_of(one)
    known = {r.shard: linededup.CuckooFilter.from_bytes(r.filter) for r in two.filters.collect()}
    rows = two.counts.collect()
    assert all(known[r.shard].contains(np.array([r.hi]), np.array([r.lo]))[0] for r in rows)
    left = {r.shard: linededup.CuckooFilter.from_bytes(r.filter) for r in nothing.filters.collect()}
    assert all(not f.table.any() for f in left.values())


def test_cuckoo_filter_finds_what_is_in_it():
    draw = np.random.default_rng(5)
    hi, lo = draw.integers(-(1 << 62), 1 << 62, (2, 5000))
    known = linededup.CuckooFilter.of(hi, lo)
    assert known.contains(hi, lo).all()
    other = draw.integers(-(1 << 62), 1 << 62, (2, 5000))
    assert known.contains(*other).mean() < 0.01
    known.delete(hi[:2000], lo[:2000])
    assert known.contains(hi[2000:], lo[2000:]).all() and known.contains(hi[:2000], lo[:2000]).mean() < 0.01
    assert not linededup.CuckooFilter(8).insert(hi, lo)
    same = np.full(40, 7)
    assert not linededup.CuckooFilter(16).insert(same, same)


def test_a_full_filter_is_made_anew(spark):
    one = linededup.store(linededup.build(documents(spark, [(1, "a line that is long enough")]), shards=1))
    many = documents(spark, [(k, "\n".join(f"line number {k} {j} of many" for j in range(40))) for k in range(2, 12)])
    grown = linededup.insert(one, many)
    assert counts_of(grown) == counts_of(linededup.build(documents(spark, [(1, "a line that is long enough")]).unionByName(many), shards=1))


# -- SimHash ------------------------------------------------------------------


def plain_fingerprint(text, words=4):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(found[k : k + words]) for k in range(max(1, len(found) - words + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance):
    """{row: smallest known id}, over (id, fingerprint) rows."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= distance:
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return [low.get(find(k)) for k in range(len(prints))]


def near_copies(seed, count):
    draw = random.Random(seed)
    base = [f"w{draw.randint(0, 5000)}" for _ in range(300)]
    rows = []
    for k in range(count):
        words = list(base)
        for _ in range(draw.randint(0, 4)):
            words[draw.randrange(300)] = "changed"
        rows.append((1000 + k, " ".join(words)))
    return rows


@pytest.mark.parametrize("segments,most", [(None, simhash.ANCHOR_ROWS), (2, 5), (3, 5), (4, 40)])
def test_components_equal_comparing_all_pairs(spark, segments, most):
    rows = near_copies(3, 60) + ODD_DOCS + [(500 + k, f"text {k} of its own kind " * 3) for k in range(20)]
    found = simhash.near_duplicates(documents(spark, rows), words=4, distance=4, segments=segments, most=most)
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    wanted = [(i, f"{f:016x}", c) for (i, f), c in zip(prints, plain_components(prints, 4))]
    assert sorted_rows(found, "doc_id", "fingerprint", "component_id") == sorted(wanted, key=repr)


def test_no_fingerprints(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    assert simhash.near_duplicates(documents(spark, [(4, "alone")])).collect()[0].component_id == 4
    with pytest.raises(ValueError):
        simhash.near_duplicates(documents(spark), segments=1)


@pytest.mark.parametrize("segments,distance", [(3, 4), (2, 4), (3, 5), (4, 7)])
def test_homes_see_every_close_fingerprint(segments, distance):
    draw = np.random.default_rng(segments)
    a = draw.integers(0, 1 << 63, 400, dtype=np.uint64)
    b = a.copy()
    for k in range(len(b)):
        for bit in draw.choice(64, distance, replace=False):
            b[k] ^= np.uint64(1) << np.uint64(bit)
    seen = np.zeros(len(a), dtype=bool)
    for shift, width in simhash.segment_bounds(segments):
        own, other = (((x >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64) for x in (a, b))
        home = simhash.nearest_anchor(own)
        rows, anchors = simhash.anchors_within(other, width, simhash.COVERING_RADIUS + distance // segments)
        seen[rows[anchors == home[rows]]] = True
        assert (np.bitwise_count(own ^ home) <= simhash.COVERING_RADIUS).all()
    assert seen.all()


def test_long_chains_become_one_component(spark):
    edges = [(k, k + 1) for k in range(1, 200)] + [(1000, 1001)] + [(5000, 6000 + k) for k in range(100)]
    random.Random(2).shuffle(edges)
    found = simhash.components(spark.createDataFrame(edges, "a long, b long"))
    roots = dict(sorted_rows(found, "node", "root"))
    assert all(roots[k] == 1 for k in range(2, 201)) and roots[1001] == 1000
    assert all(roots[6000 + k] == 5000 for k in range(100)) and len(roots) == 300


# -- I-Match ------------------------------------------------------------------


def article(draw, size):
    return " ".join(f"term{draw.randint(0, 400)}" for _ in range(size))


def test_fingerprints_follow_the_next_document(spark):
    draw = random.Random(4)
    rows = [(100 + k, article(draw, draw.randint(5, 300))) for k in range(80)] + ODD_DOCS
    docs = documents(spark, rows)
    found = imatch.fingerprint_with_next(docs, parts=4).collect()
    order = sorted(((-1 if i is None else i, t or "") for i, t in rows))
    known = imatch.lexicon(docs)
    wanted = []
    for k, (i, text) in enumerate(order):
        follows = order[(k + 1) % len(order)][1]
        cut = len(text) // 4
        changed = text[: len(text) - cut] + follows[:cut]
        own = known.fingerprint(text)
        wanted.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, imatch.likeness(own, known.fingerprint(changed)), imatch.likeness(own, known.fingerprint(follows))))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.near_edited, r.near_next) for r in found) == sorted(wanted)
    long = [r for r in found if r.n_chars > 800 and r.doc_id and r.doc_id >= 100]
    assert np.mean([r.near_edited for r in long]) > 0.3 > 0.2 > np.mean([r.near_next for r in long])


def test_likeness():
    known = imatch.Lexicon(np.zeros(0, dtype=np.uint64))
    a, b = known.fingerprint("one two three four five"), known.fingerprint("six seven eight")
    assert imatch.likeness(a, a) == 1.0 and imatch.likeness(a, b) == 0.0
    assert imatch.likeness("", "") == 1.0 and imatch.likeness("", a) == 0.0
    assert known.fingerprint("two one, FIVE four three one") == a
    near = known.fingerprint("one two three four six")
    assert 0.2 < imatch.likeness(a, near) < 1.0


def test_document_frequencies_cover_all_rows(spark):
    rows = [(k, f"common mid{k % 10} rare{k}") for k in range(100)]
    known = imatch.lexicon(documents(spark, rows), rarest=0.05, commonest=0.2)
    assert len(known.terms) == 10
    assert known.holds(imatch.term_hashes([b"mid3"]))[0] and not known.holds(imatch.term_hashes([b"common"]))[0]
    assert len(imatch.lexicon(documents(spark, [])).terms) == 0
    assert imatch.fingerprint_with_next(documents(spark, []), parts=2).count() == 0
    one = imatch.fingerprint_with_next(documents(spark, [(3, "only one here")]), parts=2).collect()[0]
    assert one.near_next == 1.0


def test_copies_do_not_make_terms_common(spark):
    rows = [(k, f"common mid{k % 10} rare{k}") for k in range(100)]
    once = imatch.lexicon(documents(spark, rows), rarest=0.05, commonest=0.2)
    again = imatch.lexicon(documents(spark, rows + [(200 + k, rows[3][1]) for k in range(60)]), rarest=0.05, commonest=0.2)
    assert np.array_equal(once.terms, again.terms)


def test_an_edited_text_stays_near_whatever_the_lexicon_holds(spark):
    draw = random.Random(8)
    shared = " ".join(f"shared{k}" for k in range(200))
    rows = [(k, f"{shared} own{k}" if k % 3 == 0 else " ".join(f"term{draw.randint(0, 3000)}" for _ in range(150))) for k in range(300)]
    found = imatch.fingerprint_with_next(documents(spark, rows), parts=4).collect()
    assert np.mean([r.near_edited for r in found if r.doc_id % 3 == 0]) > 0.3


# -- pipeline -----------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small folder of tables, with cases for every stage."""
    draw = random.Random(9)

    def prose(k, size=40):
        return " ".join(f"word{draw.randint(0, 800)}" for _ in range(size)) + f".\nline {k} of the document\nA line that all of them share."

    rows = [(k, prose(k)) for k in range(60)]
    rows += [(100, rows[3][1]), (101, rows[4][1].replace("document", "document", 1))]
    rows += [(k, " ".join(f"BUY{draw.randint(0, 99)}!! WIN%%%" for _ in range(30))) for k in range(200, 240)]
    item = " ".join(f"quiz{k}" for k in range(20))
    rows += [(300, f"Some text before. {item} and after."), (301, None), (302, "")]
    folder = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, int(i < 200), 0) for i, _ in rows if i < 240]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_take_effect(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    given, columns = docs, docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        made, path = stage(spark, docs, corpus), fresh_path(spark, "stage")
        made.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == columns
        kept.append((name, before, docs))
    good, lines, near, clean, _ = (after for _, _, after in kept)
    rows = {r.doc_id: r.text for r in given.collect()}

    model = quality.fit_on_rest(given, spark.read.parquet(f"{corpus}/labels.parquet"))
    scores = dict(zip(rows, model.scorer()([t or "" for t in rows.values()])))
    assert {r.doc_id for r in good.collect()} == {i for i, s in scores.items() if s >= quality.THRESHOLD}
    assert not {r.doc_id for r in good.collect()} & set(range(200, 240))

    plain = plain_lines([(r.doc_id, r.text) for r in good.collect()])
    wanted = sorted(((i, t) for i, t, _, n in plain if not n or (t or "").strip()), key=repr)
    assert sorted_rows(lines, "doc_id", "text") == wanted
    assert lines.where(F.col("n_chars") != F.length("text")).count() == 0

    prints = [(i, plain_fingerprint(t)) for i, t in wanted]
    assert {r.doc_id for r in near.collect()} == {c for c in plain_components(prints, 4)}

    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in near.collect()} - {300}
    pieces = corpus_pipeline.run(spark, corpus)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in clean.collect()}
    assert pieces.columns == [f.split()[0] for f in packing.PIECES.split(", ")]


def test_rows_without_an_id_stay(spark, corpus):
    docs = spark.createDataFrame([(None, "the same text in all of these rows", "en", "s", 1), (5, "the same text in all of these rows", None, None, None)] , "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    for name in ("line dedup", "SimHash near-dedup", "benchmark decontamination"):
        assert sorted_rows(stages[name](spark, docs, corpus), "doc_id") == [(5,), (None,)]


def test_stages_keep_columns_named_like_their_own(spark, corpus):
    names = ["n_lines", "n_dropped", "score", "passages_n_hit", "_passages_items", "component_id", "fingerprint", "__text", "__key", "ids"]
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    docs = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES:
        made, path = stage(spark, docs, corpus), fresh_path(spark, "stage")
        made.write.parquet(path)
        if name != "packing":
            docs, before = spark.read.parquet(path), docs
            assert docs.columns == before.columns
            assert docs.select(*names).distinct().collect() == [tuple(range(len(names)))], name


def test_stages_of_no_documents(spark, corpus):
    none = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, corpus).count() == 0
