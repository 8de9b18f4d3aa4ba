"""Normalised text against the rule itself, on every code point."""

import re
import sys
import unicodedata

from pyspark.sql import functions as F

from quarrystone.functions import text as T


def normal(text):
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9]+", " ", plain.casefold()).strip()


def test_every_code_point(spark):
    """Alone between letters, and in runs, so that marks are reordered and neighbours meet."""
    points = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) not in ("Cs", "Cn")]
    texts = [f"a{c}B" for c in points] + ["".join(points[k : k + 50]) for k in range(0, len(points), 50)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(8).select("t", T.normalise(F.col("t")).alias("n")).collect()
    wrong = [(r.t, r.n, normal(r.t)) for r in rows if r.n != normal(r.t)]
    assert not wrong, wrong[:10]


def test_names(spark):
    texts = [None, "", "  ", "Chaves & Hugo", "ﬁne ÅNGSTRÖM", "Straße ẞ", "½ Ⅷ ２３", "İstanbul ıI", "e\u0301\u0327 x", "\u212a9"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normalise(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == {t: None if t is None else normal(t) for t in texts}
