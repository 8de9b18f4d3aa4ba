"""Every training-data query that has SQL gives the SQL's rows, on the given tables and on odd texts."""

import math
from pathlib import Path

import duckdb
import pytest

from quarrystone.llm import queries

FOLDER = Path("/root/testdata/sf0.001")


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x) or str(x) in ("<NA>", "NaT"):
        return "NULL"
    if isinstance(x, float):
        return str(int(x)) if x == int(x) else f"{x:.6f}"
    return str(x)


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


def compare(spark, folder, name):
    con = duckdb.connect()
    for at in Path(folder).glob("*.parquet"):
        con.execute(f"create view {at.stem} as select * from '{at}{'/*.parquet' if at.is_dir() else ''}'")
    got, want = queries.QUERIES[name](spark, str(folder)).toPandas(), con.execute(queries.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    return got


@pytest.mark.skipif(not FOLDER.exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_tables(spark, name):
    compare(spark, FOLDER, name)


def test_odd_texts(spark, tmp_path):
    page = lambda n: " ".join(f"the Word{(7 * k + n) % 90} of {k} lines and it is" if k % 9 == 0 else f"in plain{k * n} thing" for k in range(60))
    texts = [None, "", " \n\t ", "a b c", page(2), page(3) + "\n# | $\n# | $\n", "DAS IST DER TAG UND DIE NACHT " * 12, "x y z " * 60, " ".join(map(str, range(1000, 1200))), "Ärger über Öl " * 40]
    langs = ["en", None, "de", "fr", "en", "en", "de", "xx", "en", "de"]
    docs = [(i, t, langs[i % 10], f"s{i % 12}", 0) for i, t in enumerate(texts * 2)] + [(50 + n, page(n), "en", None, 0) for n in range(5, 20)]
    footer = [(100 + i, f"own line of page {i}\n this footer stands on every site \nTop", "en", f"s{i % 13}", 0) for i in range(30)]
    spark.createDataFrame(docs + footer, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    judged = compare(spark, tmp_path, "op8_divergence")
    assert judged.kept.any() and (~judged.base_failed & ~judged.kept).any()  # the rule and the method both have a say
    lines = compare(spark, tmp_path, "op4_line_spread")
    assert (lines[lines.doc_id >= 100].n_lines_removed == 2).sum() == 29  # the footer is most of these pages: the first keeps its last copy
