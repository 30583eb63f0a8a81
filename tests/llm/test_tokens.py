import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helpers import ODD_DOCS, documents
from webloom.llm import dac, packing
from webloom.llm.tokens import CachedEncoder, encoder
from webloom.session import fresh_path

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def plain_ids(path, text, end_id):
    tokenizer = Tokenizer.from_file(path)
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id], dtype="<u4")


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_cached_ids_are_the_tokenizers_own(path):
    own, cached = Tokenizer.from_file(path), CachedEncoder(path, max_entries=50)
    draw, letters = random.Random(1), "abXY éÉßñİΣς日²½ªº,.'’s't\n\t 09_\xa0\x85\x1c\xad🙂$#×ǅ́"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 40))) for _ in range(2000)]
    for text in [*texts, "<|endoftext|> It's DON'T we'll", "Ünïcode  ÄÖÜ\n\n x", "hi <|endoftext|> there", "a<|endoftext|><|startoftext|>", "<|ENDOFTEXT|> <|endoftext", "é <|endoftext|>\x1c"]:
        assert cached.ids(text).tolist() == own.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize(("path", "ids"), [(WORD, [49407]), (BYTE, [50256])])
def test_an_added_token_in_a_text_is_one_id(path, ids):
    found = CachedEncoder(path).ids("hi <|endoftext|> there").tolist()
    assert set(ids) <= set(found) and len(found) <= 5


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500))
@settings(max_examples=60, deadline=None)
def test_codes_give_every_token_and_range_back(ids):
    file = dac.TokenFile(dac.encode_file([1, None], [len(ids), 0], np.array(ids, dtype=np.uint64)))
    assert file.tokens(0, len(ids)).tolist() == ids
    for at in range(0, len(ids), 37):
        assert file.token(at) == ids[at]
        assert file.tokens(at, min(len(ids), at + 600)).tolist() == ids[at : at + 600]
    assert file.document(1).tolist() == []
    with pytest.raises(IndexError):
        file.token(len(ids))


@pytest.mark.parametrize("file_tokens", [dac.FILE_TOKENS, 100])
def test_token_files_hold_all_documents_in_order(spark, file_tokens):
    manifest = dac.write_tokens(documents(spark), fresh_path(spark, "tokens"), WORD, 2, shards=3, file_tokens=file_tokens)
    found = dac.read_tokens(manifest).collect()
    assert len(found) == len(ODD_DOCS)
    rows = sorted(found, key=lambda r: r.start)
    order = [r.doc_id for r in rows]
    assert order == sorted(order, key=lambda i: -1 if i is None else i)
    at, texts = 0, dict(ODD_DOCS)
    for row in rows:
        ids = plain_ids(WORD, texts[row.doc_id], 2)
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_files_of_no_documents(spark):
    manifest = dac.write_tokens(documents(spark, []), fresh_path(spark, "tokens"), WORD, 2, shards=2)
    assert manifest.count() == 0 and dac.read_tokens(manifest).count() == 0


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), max_size=6), st.integers(0, 60))
@settings(max_examples=200, deadline=None)
def test_closest_multiset_is_the_best_there_is(counts, room):
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * k for s in sums for k in range(c + 1)}
    picked = packing.closest_multiset(counts, room)
    assert all(picked[n] <= counts[n] for n in picked)
    assert sum(n * k for n, k in picked.items()) == max(s for s in sums if s <= room)


@pytest.mark.parametrize("window,block", [(2048, packing.BLOCK_TOKENS), (16, 40), (7, 1)])
def test_packing_places_every_id_once(spark, window, block):
    rows = ODD_DOCS + [(100 + k, "some words " * (k % 9)) for k in range(120)]
    pieces = packing.pack(documents(spark, rows).coalesce(1), BYTE, 1, window=window, with_ids=True, block_tokens=block)
    found = pieces.collect()
    by_sequence, by_doc = {}, {}
    for p in found:
        assert len(p.ids) == 4 * p.length and zlib.crc32(p.ids) == p.ids_crc32
        by_sequence.setdefault(p.sequence_id, []).append(p)
        by_doc.setdefault(p.doc_id, []).append(p)
    padding = 0
    for held in by_sequence.values():
        at = 0
        for p in sorted(held, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 or at == window else window - at
    assert padding == 0
    for doc_id, text in rows:
        ids = plain_ids(BYTE, text, 1)
        own = sorted((p.start, p.ids) for p in by_doc[doc_id])
        copies = sum(i == doc_id for i, _ in rows)
        assert sum(len(x) for _, x in own) == 4 * copies * len(ids)
        if copies == 1:
            assert b"".join(x for _, x in own) == ids.tobytes()
    whole = packing.sequences(spark.createDataFrame(found, pieces.schema)).collect()
    assert {r.sequence_id: r.n_tokens for r in whole} == {s: sum(p.length for p in h) for s, h in by_sequence.items()}
    assert all(len(r.ids) == 4 * r.n_tokens for r in whole)


def test_packing_of_no_documents(spark):
    assert packing.pack(documents(spark, []), BYTE, 1).count() == 0


def test_the_worker_keeps_one_encoder():
    assert encoder(WORD) is encoder(WORD)


def test_the_cache_holds_the_pieces_of_many_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    cached = CachedEncoder(path)
    cached.pieces.update({f"x{k}": b"" for k in range(500_000)})
    want = Tokenizer.from_file(path).encode("One more word é, un9 mot", add_special_tokens=False).ids
    assert cached.ids("One more word é, un9 mot").tolist() == want
    assert len(cached.pieces) > 500_000
