"""Window packing against the tokenizer's own ids, and its parts alone."""

import zlib

import numpy as np
import public_tokenizers as public
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrystone.llm import token_parts, windows

FILE = public.path("byte_bpe_50k.json")


def check(rows, pieces, capacity):
    """Every id in one piece, windows without gaps or padding, checksums as the tokenizer gives them."""
    from tokenizers import Tokenizer

    coder, wanted = Tokenizer.from_file(FILE), {}
    for doc, text in rows:
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        wanted.setdefault(doc, []).append(ids)
    by_doc, by_window = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_window.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == set(wanted)
    for doc, found in by_doc.items():
        copies = wanted[doc]
        assert sorted(i for p in found for i in range(p["start"], p["start"] + p["length"])) == sorted(i for ids in copies for i in range(len(ids)))
        for p in found:
            assert any(len(ids) == p["doc_tokens"] and zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for ids in copies)
    for found in by_window.values():
        at = 0
        for p in sorted(found, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at == capacity or at & (at - 1) == 0


TEXTS = [None, "", "a", "<|endoftext|> foo <|endoftext|>bar", "  a  b \n c\t d ", "你好 ½ \U0001f600", "a" * 9000, "hello world " * 4000, "one two " * 90, "one two " * 90, "\x1c \x85 z"]


@pytest.mark.parametrize(("capacity", "turn"), [(1024, 4_000_000), (64, 300), (100, 1)])
def test_odd_texts(spark, capacity, turn):
    """Nulls, empty and long texts, repeated rows, special tokens, a null id, a further column of a clashing name, several turns."""
    rows = [(k if k else None, t) for k, t in enumerate(TEXTS)] + [(8, TEXTS[8])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("offset", F.lit(1)).repartition(3)
    check(rows, windows.pack(docs, FILE, capacity, turn).collect(), capacity)


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    check([tuple(r) for r in docs.collect()], windows.pack(docs, FILE).collect(), 1024)


def test_empty_table(spark):
    assert windows.pack(spark.createDataFrame([], "doc_id long, text string"), FILE).collect() == []


@given(st.lists(st.integers(1, 63), max_size=60))
def test_best_fit_is_the_tightest(lengths):
    """Every item's window is the one that a search over all open windows would take."""
    got, room, order = windows.best_fit(lengths, 64), {}, {}
    place = {i: w for w, items in enumerate(got) for i in items}
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fits = [r for r in room.values() if r >= lengths[i]]
        before = room.get(place[i], 64)
        assert before == min(fits) if fits else place[i] not in room
        room[place[i]] = before - lengths[i]
    assert sorted(place) == list(range(len(lengths))) and all(r >= 0 for r in room.values()) and order == {}


@given(st.lists(st.lists(st.integers(1, 30), min_size=1, max_size=2), max_size=30))
def test_levelled_windows_need_no_padding(sizes):
    held = [[windows.Item(k, 0, np.arange(n, dtype="<u4"), n) for n in s] for k, s in enumerate(sizes)]
    done, rest = windows.levelled(held, 64)
    lengths = [sum(len(x.ids) for x in w) for w in done]
    assert all(n == 64 or n & (n - 1) == 0 for n in lengths)
    left = sum(len(x.ids) for x in rest)
    powers = [sum(len(x.ids) for x in w) for w in windows.in_powers(rest)]
    assert sum(powers) == left < 64 and all(n & (n - 1) == 0 for n in powers) and sum(lengths) + left == sum(map(sum, sizes))


def test_stretches_are_encoded_alike():
    text = "Don't  stop, it's 12345 times.\n\n Yes <|endoftext|> no\t\tend. " * 50
    coder = token_parts.byte_level(FILE)
    for size in (1, 7, 100):
        parts = list(token_parts.stretches(text, size))
        assert "".join(parts) == text and [i for p in parts for i in coder.ids(p)] == coder._coder.encode(text, add_special_tokens=False).ids
