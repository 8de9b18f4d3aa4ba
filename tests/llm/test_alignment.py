"""Cross-tokenizer alignment against a walk over both token lists."""

import collections
import functools
import hashlib

import public_tokenizers as public
import pytest
from pyspark.sql import functions as F

from quarrystone.llm import align, token_parts

A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@functools.cache
def coders():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    return a, b


def walked(text):
    """(tokens of A, tokens of B, groups, links) of one text, token by token; None without tokens."""
    if not text:
        return None
    a, b = coders()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    letters = token_parts._byte_of_letter()
    bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    links, groups, i, j, end_a, end_b, open_a, open_b = [], [], 0, 0, len(bytes_a[0]), len(bytes_b[0]), [ids_a[0]], [ids_b[0]]
    while True:
        links.append((ids_a[i], ids_b[j]))
        step_a, step_b = end_a <= end_b, end_b <= end_a
        if step_a and step_b:
            groups.append(",".join(map(str, open_a)) + "|" + ",".join(map(str, open_b)))
            open_a, open_b = [], []
        i, j = i + step_a, j + step_b
        if i == len(ids_a) and j == len(ids_b):
            return len(ids_a), len(ids_b), groups, links
        if step_a:
            end_a += len(bytes_a[i])
            open_a.append(ids_a[i])
        if step_b:
            end_b += len(bytes_b[j])
            open_b.append(ids_b[j])


def expected(rows):
    found = [walked(t) for _, t in rows]
    held = collections.Counter(p for f in found if f for p in set(f[3]))
    top = {}
    for (a, _), n in held.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for (doc, _), f in zip(rows, found, strict=True):
        if f is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        best, total = sum(held[p] == top[p[0]] for p in f[3]), sum(held[p] for p in f[3])
        out.append((doc, f[0], f[1], len(f[2]), len(f[3]), best, total, hashlib.sha256(";".join(f[2]).encode()).hexdigest()))
    return sorted(out, key=str)


TEXTS = [
    None, "", "a", "x▁y", "<|endoftext|> foo <s> </s> <0x41>", "  a  b \n c\t d ", "café naïve \U0001f600 你好 ½ ﬁ", "a" * 3000, "hello world " * 400, "hello world " * 400, " ", "\n\n",
    "\x00 b \x1c c \x85 d", "don't they'll 1234567 %$#   nb", "one two three four five six", "two  two\n\n two",
]


@pytest.mark.parametrize(("stretch", "run_links"), [(7, 50), (200_000, 1_500_000)])
def test_odd_texts(spark, stretch, run_links):
    """Nulls, empty and changed texts, repeated rows, long words, texts of several stretches, a null id, a further column of a clashing name."""
    rows = [(k if k else None, t) for k, t in enumerate(TEXTS)] + [(8, TEXTS[8])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("run", F.lit("x")).repartition(3)
    got = align.align(docs, A, B, stretch, run_links).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = align.align(docs, A, B, 500, 3000).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == expected([tuple(r) for r in docs.collect()])


def test_empty_table(spark):
    assert align.align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_cache_forgets_the_least_used():
    cache = token_parts.Cache([lambda keys: [[len(k), 7] for k in keys]], limit=5)
    first, new = cache.numbered(["a", "bb", "ccc", "bb", "dddd", "bb", "a", "e", "f", "g"])
    assert new == ["a", "bb", "ccc", "dddd", "e", "f", "g"] and cache.full()
    kept = cache.forget()
    assert kept.tolist() == [0] or kept.tolist() == [1]
    numbers, new = cache.numbered(["bb", "zz"])
    assert new == ["zz"] and cache.gathered(0, numbers)[0].tolist() == [2, 7, 2, 7]
