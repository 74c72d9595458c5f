from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from salesledger.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
TOKENIZER.encode_special_tokens = True


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ids_are_those_of_the_tokenizers_file(text):
    assert packing.token_ids(text, PATH).tolist() == ids_of(text)


def test_special_names_are_text():
    text = "a<|endoftext|> b  \n\n c\x1f d 's 'LL ½²"
    assert packing.token_ids(text, PATH).tolist() == ids_of(text) and 50256 not in packing.token_ids(text, PATH)


def test_pack_gives_the_ids_of_the_file_as_it_loads(spark):
    loaded = Tokenizer.from_file(PATH)
    texts = ["a<|endoftext|> b", "<|endoftext|><|endoftext|>", "x <|endoftext|>\n\n<|endoftext| >.", "plain. <|ENDOFTEXT|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.start, r.length, r.doc_tokens, r.ids_crc32) for r in packing.pack(df).collect()}
    wanted = set()
    for i, text in enumerate(texts):
        ids = [*loaded.encode(text, add_special_tokens=False).ids, 1]
        wanted.add((i, 0, len(ids), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert got == wanted and loaded.encode(texts[0], add_special_tokens=False).ids == [64, 50256, 275]


def cost(at, prices, length, picked):
    total = 0.0
    for i, j in zip(picked, picked[1:]):
        n = at[j] - at[i]
        assert 0 < n <= length
        free = j == len(at) - 1 and n.bit_count() == 1
        total += (0 if free else length - n) + prices[j]
    return total


def test_cuts_cost_least():
    rng = np.random.default_rng(0)
    for _ in range(200):
        at = np.concatenate([[0], np.cumsum(rng.integers(1, 9, 30))])
        prices = rng.choice([0.0, 2.0, 9.0], len(at))
        best = [0.0] + [float("inf")] * 30
        for j in range(1, 31):
            for i in range(j):
                n = int(at[j] - at[i])
                if n <= 16:
                    free = j == 30 and n.bit_count() == 1
                    best[j] = min(best[j], best[i] + (0 if free else 16 - n) + prices[j])
        picked = packing.cuts(at, prices, 16)
        assert abs(cost(at.tolist(), prices, 16, picked) - best[30]) < 1e-9


def check(docs, length=2048):
    rows = packing.pack(docs, length=length).collect()
    wanted = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        wanted[r.doc_id].append(ids_of(r.text))
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(wanted)
    for doc_id, own in pieces.items():
        whole = {len(ids): ids for ids in wanted[doc_id]}
        assert sum(r.length for r in own) == sum(map(len, wanted[doc_id]))
        for r in own:
            part = np.array(whole[r.doc_tokens][r.start : r.start + r.length], "<u4")
            assert zlib.crc32(part.tobytes()) == r.ids_crc32
        if len(wanted[doc_id]) == 1:
            starts = sorted((r.start, r.length) for r in own)
            assert [s for s, _ in starts] == [0, *np.cumsum([n for _, n in starts])[:-1].tolist()]
    padding = 0
    for place in places.values():
        place.sort()
        total = sum(n for _, n in place)
        assert [o for o, _ in place] == [0, *np.cumsum([n for _, n in place])[:-1].tolist()] and total <= length
        padding += 0 if total.bit_count() == 1 else length - total
    return padding, sum(sum(map(len, x)) for x in wanted.values()), rows


def test_round_trip(spark, documents):
    padding, total, rows = check(documents)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert padding <= 0.01 * total + parts * 2048
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))]
    assert order == sorted(order)


def test_chunks_of_a_stream(spark, documents, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 20_000)
    padding, total, _ = check(documents.coalesce(1))
    assert padding <= 0.02 * total + 2048 * 8


def test_odd_rows(spark, odd_documents):
    check(odd_documents)
    check(odd_documents.where("text IS NULL"))
    assert packing.pack(odd_documents.limit(0)).count() == 0
