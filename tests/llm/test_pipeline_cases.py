"""Each stage over odd rows, over no rows, and over columns that clash with the operators' own."""

import pytest

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, copies string, n_hit string"
LONG = " ".join(f"w{i * 7919 % 10007}" for i in range(30_000))
TEXTS = [(1, None), (2, ""), (3, " \n"), (4, "One two three"), (5, "One two three"), (6, LONG), (6, LONG), (7, LONG + " end"), (None, "no id at all"), (8, "😀 é")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, None if k % 2 else "s", None, "a", "b", "c", "d") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


WANT = {
    "toxicity": TEXTS,
    "near_duplicates": [x for x in TEXTS if x not in [(5, "One two three"), (7, LONG + " end")]],
    "decontaminate": TEXTS,
    "secrets": TEXTS,
}


@pytest.mark.parametrize("name,stage", P.STAGES[:-1], ids=[n for n, _ in P.STAGES[:-1]])
def test_stage_keeps_odd_rows_and_columns(spark, odd, name, stage):
    got = stage(spark, odd, SF)
    assert got.columns == odd.columns and [f.dataType for f in got.schema] == [f.dataType for f in odd.schema]
    assert texts(got) == sorted(WANT[name], key=str)
    assert {(r.score, r.size, r.copies, r.n_hit) for r in got.collect()} == {("a", "b", "c", "d")}


@pytest.mark.parametrize("name,stage", P.STAGES, ids=[n for n, _ in P.STAGES])
def test_stage_over_no_rows(spark, odd, name, stage):
    assert stage(spark, odd.limit(0), SF).count() == 0


def test_mix_over_odd_rows(spark, odd):
    """Columns named like the mix's own are replaced; each row's size is its text's."""
    found = P.STAGES[-1][1](spark, odd, SF)
    assert len(set(found.columns)) == len(found.columns) and set(odd.columns) <= set(found.columns)
    got = found.collect()
    assert got and all(1 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"] for r in got)
    assert all(r["size"] == len((r.text or "").split()) and (r.score, r.n_hit) == ("a", "d") for r in got)
    assert {(r.doc_id, r.text) for r in got} <= set(TEXTS)
