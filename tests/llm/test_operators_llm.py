"""Each operator against brute force, a round trip or held-out accuracy, on small tables with nulls, ties, repeats and odd columns."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarrystone.llm import bagminhash, bpe, components, divergence, ego, kernel_lang, line_spread, native, packing, pii, quality_ordinal, warc
from quarrystone.llm.common import importable

tokenizers = pytest.importorskip("public_tokenizers")
RANKS, VOCABULARY = tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " \n\t ", "a", "Ünï 😀 ½ ²³ 　 x", "aaaa " * 300, "x" * 3000, "tab\tsep\r\nline\x0bend\x1cz", "٢٣ ٣ <|endoftext|> y", "don't we'll I'd  've   \n\n  end  "]


@pytest.fixture(scope="module", autouse=True)
def _ready(spark):
    importable(spark)


def docs_of(spark, texts, **more):
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t), i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long")


def test_components_match_union_find(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    want = {x: find(x) for a, b in edges if a is not None and a != b for x in (a, b)}
    links = spark.createDataFrame(edges, "a long, b long").repartition(5)
    assert {r.id: r.component for r in components.components(links).collect()} == want
    before, components.ONE_TASK = components.ONE_TASK, 10
    try:
        assert {r.id: r.component for r in components.components(links).collect()} == want
    finally:
        components.ONE_TASK = before
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ordinal_gradient_and_order():
    rng = np.random.default_rng(0)
    s, g, w, theta = rng.normal(size=50), rng.integers(0, 4, 50), np.full(50, 0.02), np.array([-1.0, 0.2, 1.1])
    value, by_score, by_theta = quality_ordinal.objective(s, g, theta, w)
    for k in (0, 7, 31):
        t = s.copy()
        t[k] += 1e-6
        assert (quality_ordinal.objective(t, g, theta, w)[0] - value) / 1e-6 == pytest.approx(by_score[k], abs=1e-5)
    for k in range(3):
        t = theta.copy()
        t[k] += 1e-6
        assert (quality_ordinal.objective(s, g, t, w)[0] - value) / 1e-6 == pytest.approx(by_theta[k], abs=1e-5)


def test_ordinal_classifier_learns_grades(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{k}" for k in range(400)]
    texts, rows = [], []
    for i in range(600):
        words = list(rng.choice(vocabulary, 60))
        kind = i % 3
        if kind == 0:
            words = [w + "###" for w in words]
        if kind == 1:
            words[int(rng.integers(60))] = "scum"
            words[int(rng.integers(60))] = "idiot"
        texts.append(" ".join(words))
        rows.append((i, int(kind > 0), int(kind == 1)))
    labels = spark.createDataFrame([r for r in rows if r[0] < 450] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, [*texts, None, ""])
    got = quality_ordinal.classify(docs, quality_ordinal.graded(labels)).toPandas()
    assert len(got) == 602 and got.tail_probability.between(0, 1).all() and got.expected_grade.between(0, 2).all()
    test = got[(got.doc_id >= 450) & (got.doc_id < 600)]
    assert (test.kept == (test.doc_id % 3 == 2)).mean() > 0.95
    assert set(docs.columns) < set(got.columns)
    none = quality_ordinal.classify(docs, quality_ordinal.graded(labels.limit(0))).toPandas()
    assert none.kept.all()


def test_ordinal_scores_by_brute_force(spark):
    """Both numbers of every document from its words one by one, whatever the partitions."""
    rng = np.random.default_rng(3)
    texts = [" ".join(str(w) for w in rng.choice(["Alpha", "beta!!", "gamma#", "|", "LOUD!", "runnings", "x"], int(n))) for n in rng.integers(1, 200, 80)] + [None, "", " ", "word " * 60_000]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 1)) for i in range(80)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, texts).repartition(9)
    model = quality_ordinal.OrdinalModel(rng.normal(size=quality_ordinal.N_FEATURES), np.array([-0.5, 0.75]))
    model.weights = model.weights.astype(np.float32).astype(float)
    crc = lambda b: zlib.crc32(b) % quality_ordinal.N_WORD
    for r in quality_ordinal.score(docs, model).collect():
        words = (texts[r.doc_id] or "").split()
        cores = [re.sub(r"^\W+|\W+$", "", w).lower() for w in words]
        places = {crc(c.encode()) for c in cores if c} | {crc(b"^" + c[:4].encode()) for c in cores if len(c) >= 6}
        tests = [[any(c in "#*$%&<>^~" for c in w) for w in words], [w.isupper() and len(c) > 1 and c != w for w, c in zip(words, cores, strict=True)], [a == b for a, b in zip(cores, cores[1:], strict=False)], [w == "|" for w in words], ["!!" in w for w in words]]
        for k, hits in enumerate(tests if words else []):
            share = sum(hits) / len(hits) if hits else 0
            places.add(quality_ordinal.N_WORD + k * quality_ordinal.LEVELS + (0 if not share else min(max(math.ceil(math.log2(share * 256)), 1), quality_ordinal.LEVELS - 1)))
        s = sum(model.weights[p] for p in places)
        tails = [1 / (1 + math.exp(t - s)) for t in model.thetas]
        assert r.expected_grade == pytest.approx(sum(tails), abs=1e-4) and r.tail_probability == pytest.approx(tails[-1], abs=1e-4), texts[r.doc_id]


def test_packing_is_whole_and_tight(spark):
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(2)
    texts = ODD + [" ".join(rng.choice(["alpha", "bet", "the", "q7", "zürich"], int(n))) for n in rng.integers(1, 3000, 150)]
    docs = docs_of(spark, texts).repartition(9)
    got = packing.pack(docs, VOCABULARY).toPandas()
    total = 0
    for i, t in enumerate(texts):
        ids = [*hf.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        mine = got[got.doc_id == i].sort_values("piece")
        assert mine.piece.tolist() == list(range(len(mine))) and mine.length.sum() == len(ids)
        assert (mine.length.iloc[1:] == 2048).all()
        for r in mine.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for _, bin_ in got.sort_values("offset").groupby("sequence_id"):
        assert bin_.offset.tolist() == [0, *np.cumsum(bin_.length)[:-1]] and bin_.length.sum() <= 2048
    lengths = got.length.to_numpy()
    assert got.sequence_id.nunique() <= len(packing.best_fit(lengths)[1]) * 1.1 + 2
    assert packing.pack(docs.limit(0), VOCABULARY).count() == 0


def test_open_bins_lose_no_partner(spark):
    """Bins of 1500 places that never pair are done at once; a few small ones keep as many roomy hosts as they are."""
    kind = packing._BIN
    bins = [(k % 5, 548, [(k, 0, 0, 1500, 0, 0)]) for k in range(300)]
    done, rest = packing._open_bins(spark.createDataFrame(bins, kind), 2048)
    assert done.count() == 300 and rest.count() == 0
    bins += [(7, 2048 - n, [(1000 + n, 0, 0, n, 0, 0)]) for n in (5, 100, 600)] + [(8, 700, [(2000, 0, 0, 1348, 0, 0)])]
    done, rest = packing._open_bins(spark.createDataFrame(bins, kind), 2048)
    kept = [r["items"][0].doc_id for r in rest.collect()]
    assert {1005, 1100, 1600, 2000} < set(kept) and 6 <= len(kept) <= 10 and done.count() + len(kept) == 304
    done, rest = packing._open_bins(spark.createDataFrame([(0, 1024, [(1, 0, 0, 1024, 0, 0)]), (1, 3, [(2, 0, 0, 2045, 0, 0)])], kind), 2048)
    assert done.count() == 1 and rest.count() == 1


def test_callers_columns_come_back(spark):
    """Names that the operators use themselves, a map column, repeated rows."""
    rows = [(i, f"mail a{i}@b.org and a common footer line here\nwords w{i} x{i} y{i} z{i} q{i} r{i}", f"s{i}", i, i, i, i, i, i, i, {"k": i}) for i in range(12)]
    names = "cut int, _id int, _text int, base int, added int, found int, _score int, kept int"
    docs = spark.createDataFrame([r[:3] + (r[3],) * 8 + (r[10],) for r in rows] * 2, f"doc_id long, text string, source string, {names}, more map<string,int>")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    own = [c for c in docs.columns if c not in ("text", "kept")]
    for out in (line_spread.deduplicated(docs), pii.redacted(docs), bagminhash.deduplicated(docs), quality_ordinal.classify(docs, quality_ordinal.graded(labels))):
        got = out.select(*own).collect()
        assert len(got) in (12, 24) and set(docs.columns) <= set(out.columns)
        assert all(r[c] == r["doc_id"] for r in got for c in own if c not in ("doc_id", "source", "more")) and all(r["more"] == {"k": r["doc_id"]} for r in got)
    kept = pii.spans(docs).select("cut", "base").first()
    assert isinstance(kept["base"], list)


def test_line_spread(spark):
    common, near_miss = "this footer stands on every site", "this line stands on few sites"
    rows = []
    for i in range(40):
        own = [f"own words of page number {i} line {k} here" for k in range(6)]
        rows.append((i, "\n".join([*own, common, *([near_miss] if i % 8 < 4 else [])]), f"site{i % 8}"))
    rows += [(100, common, "site9"), (101, None, None), (102, "", "x"), (0, rows[0][1], "site0")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, pos long")
    got = line_spread.deduplicated(docs, min_sites=5).toPandas()
    assert len(got) == len(rows) and list(got.columns) == [*docs.columns, "n_lines_removed"]
    page = got[got.doc_id == 1]
    assert common not in page.text.iloc[0] and near_miss in page.text.iloc[0] and page.n_lines_removed.iloc[0] == 1
    assert got[got.doc_id == 100].text.iloc[0] == common  # all boilerplate: a copy, left to document-level dedup
    spread = collections.defaultdict(set)
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            if len(line.split()) >= 5:
                spread[line].add(s)
    marks = line_spread.boilerplate(line_spread.lines_of(docs, 5), 5).count()
    assert marks == sum(len(s) >= 5 for s in spread.values())


def test_line_spread_cleans_pages_of_any_share(spark):
    licence = "this long licence text is shared by the pages of every site and is most of each page"
    story = [f"sentence number {k} of a story that many sites carry" for k in range(20)]
    poem = [f"verse number {k} of a poem that stands alone on its pages" for k in range(3)]
    rows = [(i, f"title {i}\n{licence}", f"a{i}") for i in range(8)]
    rows += [(20 + i, "\n".join([f"header of site {i}", *story[: 20 - (i == 0)]]), f"b{i}") for i in range(7)]
    rows += [(40 + i, "\n".join(poem), f"c{i}") for i in range(6)]
    rows += [(60, "\n".join(["a page about the poem", *poem]), "d")]
    got = line_spread.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas().set_index("doc_id")
    text, removed = got.text.to_dict(), got.n_lines_removed.to_dict()
    assert text[0] == rows[0][1] and removed[0] == 0  # the licence's last copy
    assert all(text[i] == f"title {i}" and removed[i] == 1 for i in range(1, 8))
    assert text[20] == rows[8][1] and text[21] == f"header of site 1\n{story[19]}" and removed[21] == 19  # each line of the story once
    assert all(text[20 + i] == f"header of site {i}" and removed[20 + i] == 20 for i in range(2, 7))
    assert all(text[40 + i] == "\n".join(poem) for i in range(6)) and text[60] == "a page about the poem"  # nothing else would be left of a poem's page


def test_line_spread_counts_short_lines(spark):
    rows = [(i, f"own words of the page with number {i}\n  All rights reserved.\t\n\nA.\n}}", f"s{i % 12}") for i in range(24)]
    rows = [(i, t if i % 12 < 9 else t.replace("\nA.", ""), s) for i, t, s in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert line_spread.boilerplate(line_spread.lines_of(docs, 5), 5).count() == 2
    got = line_spread.deduplicated(docs).toPandas()
    for i, text, n in zip(got.doc_id, got.text, got.n_lines_removed, strict=True):  # nine sites are too few for a short line, twelve are enough
        assert text == f"own words of the page with number {i}\n" + ("\nA." if i % 12 < 9 else "") and n == 2


def test_ego_join_is_exact(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16))
    x[100:160] = x[:60] + rng.normal(size=(60, 16)) * 0.3
    x[160:170] = x[3]
    rows = [(i, [float(v) for v in np.float32(r)], i % 4) for i, r in enumerate(x)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [1.0, None] + [0.0] * 14, 0), (903, [float("nan")] * 16, 0), (904, [], 0), (905, [1.0, 2.0], 0), (None, [1.0] * 16, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    u = np.float32(x).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    want = near.sum(1) - 1
    before, ego.BLOCK, ego.LEAF = (ego.BLOCK, ego.LEAF), 64, 16
    try:
        got = ego.near_duplicates(frame).toPandas()
    finally:
        ego.BLOCK, ego.LEAF = before
    assert len(got) == len(rows)
    by_id = got[got.vec_id < 300].astype({"vec_id": int}).sort_values("vec_id")
    assert by_id.n_links.tolist() == want.tolist()
    label = np.arange(300)
    for _ in range(300):
        new = np.array([label[near[i]].min() for i in range(300)])
        if (new == label).all():
            break
        label = new
    assert by_id.component_id.tolist() == label.tolist()
    assert (got[got.vec_id >= 900].n_links == 0).all()


def test_kernel_language(spark):
    rng = np.random.default_rng(5)
    parts = {"en": ["the", "ing", "wh", "ou", "ther", "nd"], "fr": ["eau", "que", "é", "oi", "tion", "le"], "de": ["sch", "ung", "ü", "ei", "cht", "pf"]}
    rows = []
    for i in range(400):
        lang = list(parts)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(30)), lang if i % 7 else None))
    rows += [(1000, None, "en"), (1001, "12 34 !!", "fr"), (1002, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = kernel_lang.identify(docs, kernel_lang.train(docs)).toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    test = got[(got.doc_id < 400) & got.held_out]
    assert (test.lang_pred == [list(parts)[i % 3] for i in test.doc_id]).mean() > 0.97
    odd = spark.createDataFrame([(1, "½ ²", None), (2, "①②", None), (3, "٣ 12 Ⅷ", None), (4, "½ the thing", None)], docs.schema)
    assert [r.lang_pred == "und" for r in kernel_lang.identify(odd, kernel_lang.train(docs)).orderBy("doc_id").collect()] == [True, True, True, False]
    assert set(got[got.doc_id >= 1000].lang_pred) == {"und"} and got.score.between(0, 1).all()
    a, b = kernel_lang.presence("The cat"), kernel_lang.presence("a cat")
    model = kernel_lang.fit([a, b], ["x", "y"], landmarks=1)
    assert model.kernel([b])[0, 0] == pytest.approx(len(np.intersect1d(a, b)) / math.sqrt(len(a) * len(b)), rel=1e-5)
    nothing = kernel_lang.identify(docs, kernel_lang.train(docs.where("lang is null"))).toPandas()
    assert set(nothing.lang_pred) == {"und"}


def test_kernel_language_scores_by_brute_force(spark):
    """Every document's language and score from sets of n-grams, landmark by landmark."""
    rng = np.random.default_rng(8)
    texts = [" ".join("".join(rng.choice(list("abcdeé" if i % 2 else "stuvwß"), 4)) for _ in range(20)) for i in range(60)] + ["a", "é!", None, "7", "Word " * 30_000]
    docs = spark.createDataFrame([(i, t, "x" if i % 2 else "y") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(7)
    model = kernel_lang.train(docs)
    held = [set(np.flatnonzero(model.landmarks[:, j])) for j in range(model.landmarks.shape[1])]

    def places(text):
        low = " " + re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip() + " "
        found = set()
        for n in (1, 2, 3, 4):
            for at in range(min(len(low), 10_000) - n + 1):  # the long text repeats itself
                gram = ord(low[at])
                for c in low[at + 1 : at + n]:
                    gram = (gram * 0x100000001B3 + ord(c)) % 2**64
                x = (gram * 0x9E3779B97F4A7C15 + n) % 2**64
                found.add(((x ^ x >> 29) * 0xBF58476D1CE4E5B9 % 2**64) >> 49)
        return found if low.strip() else set()

    for r in kernel_lang.identify(docs, model).collect():
        mine = places(texts[r.doc_id])
        if not mine:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        margins = np.array([len(mine & z) / math.sqrt(len(mine) * len(z)) for z in held]) @ model.weights * model.scale
        p = np.exp(margins) / np.exp(margins).sum()
        assert r.lang_pred == model.languages[int(p.argmax())] and r.score == pytest.approx(p.max(), abs=1e-4)


def test_kernel_language_learns_every_language(spark):
    docs = spark.createDataFrame([(i, f"text {chr(0x4E00 + i % 210) * 3} here", f"l{i % 210}") for i in range(420)], "doc_id long, text string, lang string")
    seen = {f"l{i % 210}" for i in range(420) if zlib.crc32(str(i).encode()) % 5}
    assert len(seen) > 200 and set(kernel_lang.train(docs).languages) == seen


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def accepted(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {"email": True, "ip": all(int(p) <= 255 for p in s.split(".")) if kind == "ip" else False, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def test_pii_base_spans(spark):
    rng = np.random.default_rng(6)
    bits = list("0123456789.@ +-()ab_%é😀") + ["192.168.1.1", "a@b.co", "4111 1111 1111 1111", "+1 (244) 555-4688"]
    texts = ODD + ["".join(rng.choice(bits, int(n))) for n in rng.integers(1, 120, 400)] + ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "0" * 400 + ".1.1.1", "1 " * 2000]
    got = pii.report(docs_of(spark, texts)).toPandas().sort_values("doc_id")
    for t, r in zip(texts, got.itertuples(), strict=True):
        want = [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, t or "") if accepted(k, m[0])]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), t
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[0] == k for w in want) for k in PLAIN]
        assert r.spans.startswith(joined)


def test_pii_finds_secrets_of_any_length(spark):
    long, late = hashlib.sha256(b"a").hexdigest() * 40, "q" * 40 + "ZxKvWpTb" * 4 + "7" + "mN4rT9" * 30
    texts = [f"password={long} and more", f"api_key: {late}, then", f"secret: {long[:40]}=", "x" * 5000 + " no secret"]
    got = pii.redacted(docs_of(spark, texts)).toPandas().sort_values("doc_id").text.tolist()
    assert long not in got[0] and long[:100] not in got[0] and got[0].endswith(" and more")
    assert late not in got[1] and got[1].endswith(", then") and long[:40] not in got[2] and got[3] == texts[3]


def test_pii_redaction_and_trees(spark):
    docs = docs_of(spark, ["mail a.b@c.org now", 'token = "8a4e6e1f6463a8c2573135e353846cd2315d3e1e" end', "on 2024-01-02 order 12345678", None, ""])
    got = pii.redacted(docs).orderBy("doc_id").toPandas()
    assert list(got.columns) == docs.columns
    assert got.text[0] == "mail [EMAIL] now" and got.text[1] == 'token = "[SECRET]" end' and got.text[2] == "on 2024-01-02 order 12345678" and got.text[3] is None
    x = np.random.default_rng(0).normal(size=(400, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    trees = pii.Boosted(x, y)
    assert ((trees.score(x) > 0) == y).mean() > 0.9
    row = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], "a double, b double, c double")
    assert np.allclose([r[0] for r in row.selectExpr(trees.sql(["a", "b", "c"])).collect()], trees.score(x[:50]))


def test_prefix_sums(spark):
    for n in (0, 1, 127, 128, 129, 700):
        got = spark.range(1).select(native.prefix_sums(F.array(*[F.lit(k % 7).cast("long") for k in range(n)]) if n else F.array().cast("array<bigint>")).alias("p")).first()[0]
        assert got == [sum(k % 7 for k in range(j)) for j in range(n)]


def test_divergence_counts(spark):
    rng = np.random.default_rng(7)
    texts = ODD + [" ".join(rng.choice(["a", "b", "c#", "d|d"], int(n))) + "\nx y\nx y\n \n" for n in rng.integers(0, 90, 60)]
    got = divergence.judged(docs_of(spark, texts)).toPandas().sort_values("doc_id")
    for t, r in zip(texts, got.itertuples(), strict=True):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)), t
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.base_failed and r.kept)


def test_divergence_distance(spark):
    p, q = np.array([3, 0, 5]) / 8, np.array([1, 1, 0]) / 2
    m = (p + q) / 2
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x)
    arr = lambda v: F.array(*[F.lit(int(x)).cast("long") for x in v])
    got = spark.range(1).select(divergence.distance(arr([3, 0, 5]), arr([1, 1, 0]))).first()[0]
    assert got == pytest.approx(math.sqrt((kl(p) + kl(q)) / 2))
    words = F.split(F.lit("x y z x y z q"), " ")
    assert spark.range(1).select(divergence.repeated_words(words)).first()[0] == 6
    before, divergence._BITS = divergence._BITS, 1  # every text takes the form for texts with too many windows
    try:
        assert spark.range(1).select(divergence.repeated_words(words)).first()[0] == 6
    finally:
        divergence._BITS = before
    before, F.xxhash64 = F.xxhash64, lambda a, b, c: F.lit(7).cast("long")  # all windows meet in one hash
    try:
        assert spark.range(1).select(divergence.repeated_words(words)).first()[0] == 6
    finally:
        F.xxhash64 = before


def test_bpe_round_trip(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(8)
    alphabet = list("abcdefghijklmnopqrstuvwxyzABCXYZ0123456789  \n\t.,;!?'\"-_äöüéñçß") + ["the", " of", "中文", "😀", " ", "̀", "ǅ", "Ⅷ", " "]
    texts = ODD + ["".join(rng.choice(alphabet, int(n))) for n in rng.integers(1, 200, 250)]
    for known in (1_000_000, 5):
        got = bpe.digests(docs_of(spark, texts), RANKS, tokenizers.PATTERN, max_known=known).toPandas().sort_values("doc_id")
        for t, r in zip(texts, got.itertuples(), strict=True):
            ids = library.encode_ordinary(t or "")
            assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), t
            assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digests(docs_of(spark, texts).limit(0), RANKS, tokenizers.PATTERN).count() == 0


def test_bpe_with_empty_partitions_and_long_words(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(18)
    long = ["".join(rng.choice(list("abcdeñé"), n)) for n in (1999, 2000, 2001, 6000, 60_000)] + ["ab" * 30_000, "z" * 5001, "words then " + "-" * 9000 + " more"]
    docs = docs_of(spark, [*long, "short", None]).repartition(24)
    got = bpe.digests(docs, RANKS, tokenizers.PATTERN).toPandas().sort_values("doc_id")
    for t, r in zip([*long, "short", ""], got.itertuples(), strict=True):
        ids = np.array(library.encode_ordinary(t), "<u4").tobytes()
        assert r.ids_sha256 == hashlib.sha256(ids).hexdigest() and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    for word in ("x", "the", " hello", "naïve" * 30, "".join(rng.choice(list("abc'é "), 500))):
        assert bpe.merged_by_heap(word.encode(), ranks) == library._encode_single_piece(word.encode())


def test_signatures_are_unbiased():
    rng = np.random.default_rng(9)
    items = bagminhash.mix(np.arange(80, dtype=np.uint64) + np.uint64(5))
    x = rng.integers(0, 40, 80)
    y = np.maximum(0, x + rng.integers(-9, 10, 80))
    want = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    s = bagminhash.signatures([(items[x > 0], x[x > 0]), (items[y > 0], y[y > 0])], 8192)
    assert abs((s[0] == s[1]).mean() - want) < 0.02


def near_copies(rng):
    vocabulary = [f"v{k}" for k in range(3000)]
    texts = []
    for _ in range(25):
        base = list(rng.choice(vocabulary, int(rng.integers(20, 160))))
        for _ in range(int(rng.integers(1, 9))):
            copy = list(base)
            for k in rng.integers(0, len(copy), int(rng.integers(0, max(1, len(copy) // 18)))):
                copy[k] = str(rng.choice(vocabulary))
            texts.append(" ".join(copy))
    return texts + texts[:5] + ["a b", "a b", "", None, " ", "one two three four"]


def classes_by_brute_force(texts):
    bags = []
    for t in texts:
        w = (t or "").split()
        bags.append(collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            union = sum((bags[i] | bags[j]).values())
            if union and sum((bags[i] & bags[j]).values()) >= 0.8 * union - 1e-9:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in range(len(texts))}


def test_bagminhash_classes(spark):
    texts = near_copies(np.random.default_rng(10))
    want = classes_by_brute_force(texts)
    docs = docs_of(spark, texts).repartition(4).withColumn("more", F.create_map(F.lit("k"), F.lit(1)))
    got = {r.doc_id: r.class_id for r in bagminhash.classes(docs).collect()}
    assert got == want
    kept = bagminhash.deduplicated(docs.union(docs.where("doc_id = 3")))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values())) and kept.columns == docs.columns
    assert bagminhash.classes(docs.limit(0)).count() == 0


@pytest.mark.parametrize("with_base", [True, False])
def test_bagminhash_splits_large_groups_without_losing_links(spark, with_base):
    """Copies of one text with 0 to 20 changed words, copies of copies, texts with repeated passages: groups far beyond the bound of one task."""
    rng = np.random.default_rng(21)
    vocabulary = [f"v{k}" for k in range(3000)]
    base = list(rng.choice(vocabulary, 120))
    texts = [" ".join(base)] if with_base else []
    for k in range(150):
        copy = list(texts[int(rng.integers(len(texts)))].split() if k % 4 == 3 and texts else base)
        for at in rng.integers(0, len(copy), int(rng.integers(0 if with_base else 2, 12))):
            copy[at] = str(rng.choice(vocabulary))
        if k % 10 == 0:
            copy = copy[: int(rng.integers(90, 120))] + copy[:10] * int(rng.integers(1, 4))
        texts.append(" ".join(copy))
    want = classes_by_brute_force(texts)
    assert 3 < len(set(want.values())) < len(texts)
    before = bagminhash.GROUP, bagminhash.COHORT
    try:
        bagminhash.GROUP, bagminhash.COHORT = 12, 8
        got = {r.doc_id: r.class_id for r in bagminhash.classes(docs_of(spark, texts).repartition(3)).collect()}
        assert got == want
    finally:
        bagminhash.GROUP, bagminhash.COHORT = before


def test_meeting_places_of_linked_texts_coincide():
    """Whatever the reference: a link is found by the centre or in a prefix."""
    rng = np.random.default_rng(22)
    share = (1 - 0.8) / (1 + 0.8)
    for _ in range(60):
        universe = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
        common = rng.choice(universe, 150, replace=False)
        bags = []
        for _ in range(30):
            own = common[rng.random(len(common)) > rng.uniform(0, 0.25)]
            bags.append(np.unique(np.concatenate([own, rng.choice(universe, int(rng.integers(0, 40)))])))
        known, held = np.unique(np.concatenate(bags[:7]), return_counts=True)
        deltas = [bagminhash.differences(x, known, held, 7) for x in bags]
        r = [len(d) - share * len(x) for x, d in zip(bags, deltas, strict=True)]
        low, width = min(r), float(rng.uniform(1, 12))
        places = [{(a, b, e) for a, b, n in bagminhash.prefixes(len(x), k, len(d), width, low, 0.8) for e in d[:n].tolist()} for x, k, d in zip(bags, r, deltas, strict=True)]
        for i in range(30):
            for j in range(i):
                assert len(np.setxor1d(deltas[i], deltas[j])) == len(np.setxor1d(bags[i], bags[j]))
                if bagminhash.overlap(bags[i], bags[j]) >= 0.8 and max(r[i], r[j]) > -low + 1e-9:
                    assert places[i] & places[j]
                if r[i] + r[j] <= 0:
                    assert bagminhash.overlap(bags[i], bags[j]) >= 0.8


def test_warc_resolution(spark):
    rows = [
        (1, "response", "http://WWW.a.com:80/x/?b=2&a=1&utm_source=q#f", 10, {"ETag": '"v1"', "Content-Type": "text/html", "Date": "10"}, "d1"),
        (2, "response", "https://a.com/x?a=1&b=2", 20, {"ETag": '"v2"', "Content-Type": "text/plain"}, "d2"),
        (3, "revisit", "https://a.com/x?b=2&a=1", 15, {"etag": 'W/"v1"', "Date": "15", "Content-Type": "no"}, None),
        (4, "revisit", "https://a.com/x?b=2&a=1", 25, {"etag": '"v1"'}, None),
        (5, "revisit", "https://a.com/x?b=2&a=1", 20, {}, "d1"),
        (6, "revisit", "https://b.com/", 99, {}, None),
        (7, "revisit", "https://a.com/x?a=1&b=2", 30, None, None),
        (8, "revisit", None, 30, {}, None),
        (9, "revisit", "https://a.com/x?a=1&b=2", 10, {}, None),
    ]
    records = spark.createDataFrame(rows, "record_id long, kind string, url string, captured_at long, headers map<string,string>, digest string")
    for slices in (2, 64):
        got = {r.record_id: r for r in warc.resolve(records.union(records.where("record_id = 3")), slices).collect()}
        assert {k: (r.response_id, r.status) for k, r in got.items()} == {3: (1, "resolved"), 4: (2, "mismatch"), 5: (1, "resolved"), 6: (None, "no_response"), 7: (2, "unchecked"), 9: (None, "no_response")}
        assert got[3].headers == {"etag": 'W/"v1"', "date": "15", "content-type": "text/html"} and got[4].headers is None
    assert warc.resolve(records.limit(0)).count() == 0


def test_ego_join_of_any_magnitude(spark):
    """Squares that overflow or vanish; directions decide alone. Rows that repeat an id count one another."""
    rows = [(1, [1e200, 1e200]), (2, [1.0, 1.0]), (3, [1e-200, 1e-200]), (4, [5e-324, 0.0]), (5, [1e308, 0.0]), (6, [0.0, 0.0]), (7, [-1e200, -1e200]), (8, [0.0, 3.0]), (8, [0.0, 4.0]), (9, [0.0, -1.0]), (9, [0.0, -1.0])]
    got = ego.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [
        (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 1, 4, True), (5, 1, 4, False), (6, 0, 6, True), (7, 0, 7, True), (8, 2, 8, True), (8, 2, 8, True), (9, 1, 9, True), (9, 1, 9, True),
    ]


def test_bpe_words_of_a_part():
    """Parts told apart without the pattern give the pattern's words: letters of several scripts, marks, and what only looks like letters."""
    import regex

    exact, words_of = regex.compile(tokenizers.PATTERN), bpe._words_of_part(bpe.word_splitter(tokenizers.PATTERN))
    searched = []
    counted = bpe._words_of_part(lambda text: searched.append(text) or exact.findall(text))
    for part in ["word", "word.", "word,", "été", "été!", "ªº", "x²", "²", "a.b", "word..", "don't", "'s", "_a", "a_", "12", "a1", "漢字", "漢字,", "ǅ", "a\n", ".", "a'", "Ⅷ", "ﬁn;", "é."]:
        assert words_of(part) == tuple(exact.findall(" " + part)) == tuple(counted(part)), part
    assert not {" word", " word.", " word,", " été", " été!"} & set(searched) and " 漢字" in searched


def test_bpe_words_told_by_folded_words(spark):
    """Ids of a word whose neighbouring ids folded words hold are the library's, and only words with other neighbours are left to the fold; counts are those of the pattern."""
    import base64

    import pyarrow as pa
    import regex
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(21)
    parts = ["the", "er", "on", "an", "ß", "é", "ción", "re", "ing", "th", "ü", "s", "中", "12", "--", "a"]
    words = sorted({first + "".join(rng.choice(parts, int(n))) for n in rng.integers(1, 7, 9000) for first in ("", " ")})
    ids = {w: library._encode_single_piece(w.encode()) for w in words}
    folded = [w for w in words if rng.random() < 0.3]
    known = [np.array(ids[w], "<u4").tobytes() for w in folded]
    pairs = {p for w in folded for p in zip(ids[w], ids[w][1:], strict=False)}
    seen = {x for w in folded for x in ids[w]}
    joined = bpe.Joined(known, RANKS)
    told = 0
    for w in words:
        want = ids[w] if set(ids[w]) <= seen and set(zip(ids[w], ids[w][1:], strict=False)) <= pairs else None
        assert joined.ids(w.encode()) == want, w
        told += want is not None and w not in set(folded)
    assert told > 3000 and bpe.Joined([], RANKS).ids(b" the") is None
    held = bpe._Parts(pa.table({"word": folded, "ids": known, "bytes": pa.nulls(len(folded), pa.binary())}), RANKS, tokenizers.PATTERN)
    before, bpe.KEPT_PARTS = bpe.KEPT_PARTS, 3
    try:
        for w in [w for w in words if w.isalpha() or w[1:].isalpha()][:3000] * 2:
            got = held[w.removeprefix(" ") + ","]
            assert got.__class__ is tuple or got == np.array(library.encode_ordinary(" " + w.removeprefix(" ") + ","), "<u4").tobytes()
    finally:
        bpe.KEPT_PARTS = before

    texts = [*ODD, " led by a space", "two  spaces, and.a\nline ", *rng.choice(["".join(rng.choice([*parts, " ", "\n", "."], 40)) for _ in range(20)], 40)]
    want = collections.Counter(w for t in texts for w in regex.findall(tokenizers.PATTERN, t or "") if len(w) <= bpe.LONG_WORD // 4)
    parts_of = bpe._parts_of(docs_of(spark, texts), tokenizers.PATTERN)
    rows = parts_of.mapInArrow(bpe._counted(tokenizers.PATTERN), "word string, n long").collect()
    got = collections.Counter()
    for r in rows:
        got[r.word] += r.n
    assert all(got[w] == n for w, n in want.items() if not w.isspace())
    assert parts_of.count() == len({(k > 0, p) for t in texts if t is not None for k, p in enumerate(t.split(" "))})


def test_bpe_decodes_ids(spark):
    """decoded bytes are the pieces of the ids, not the text again: with ids of other words in the dictionary they are those words; words merged by a heap or told by others as well."""
    import base64
    import types

    import pyarrow as pa
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    code = lambda text: np.array(library.encode_ordinary(text), "<u4").tobytes()
    known = pa.table({"word": [" the", "ab", " word"], "ids": [code(" of course"), code("cd"), code(" word")], "bytes": pa.nulls(3, pa.binary())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, known.schema) as out:
        out.write_table(known)
    long = "ab" * 1500
    texts = ["ab the word", "ab", "", None, long + " the", "zq the"]
    docs = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["doc_id", "text"])
    got = [r for b in bpe._split_up(types.SimpleNamespace(value=sink.getvalue().to_pybytes()), RANKS, tokenizers.PATTERN)([docs]) for r in b.to_pylist()]
    assert [r["bytes"] for r in got] == [[b"cd of course word"], [b"cd"], [b""], [b""], [long.encode() + b" of course"], [b"", b" of course"]]
    assert all(b == library.decode_bytes(np.frombuffer(x, "<u4").tolist()) for r in got for x, b in zip(r["ids"], r["bytes"], strict=True))
