"""The SQL texts of op4 and op8 give their operators' rows, on a small corpus and on a whole test table."""

import random

import duckdb
import pytest

from cohortlens.llm import queries as Q


def _copies() -> list[tuple]:
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé😀") for _ in range(rng.randint(1, 9)))
    base = [" ".join(word() for _ in range(n)) for n in (3, 4, 5, 40, 120, 200, 300)]
    texts = [None, "", " \n\t", "One two", "ONE TWO", "a " * 900, *base, *base]
    for t in base[3:]:
        w = t.split(" ")
        for k in range(1, 6):
            near = list(w)
            near[k * len(w) // 7] = f"x{k}"
            texts.append(" ".join(near).upper() if k == 2 else "\n".join(near))
        texts.append("before " + t + " after " + t)
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("sql") / "small")
    spark.createDataFrame(_copies(), "doc_id long, text string").write.parquet(f"{out}/documents.parquet")
    return out


@pytest.mark.parametrize("name", ["op4_ngram_jaccard", "op8_repeats"])
@pytest.mark.parametrize("where", ["small", "/root/testdata/sf0.001"])
def test_sql_equals_the_operator(spark, folder, where, name):
    path = folder if where == "small" else where
    got = Q.queries()[name](spark, path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet{'/*.parquet' if where == 'small' else ''}')")
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({Q.oracle_sql()[name]})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
