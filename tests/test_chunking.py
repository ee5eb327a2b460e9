"""Chunker: goldens, properties, and the independent DuckDB statement of the rule."""

from conftest import plan_text
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from docmill.operators.chunking import _check, chunk, chunk_count


EDGE_LENGTHS = [0, 1, 199, 200, 201, 799, 800, 801, 999, 1000, 1001, 1002, 1500, 1800]


def _edge_texts():
    texts = ["", "no period at all " * 120, "\n" * 1500, " " * 1800, "\U0001F600" * 1200 + "." + "z" * 900,
             "line one\r\nline two.\r\n" * 90, ("x" * 350 + ".") * 8, "a." * 700]
    for n in EDGE_LENGTHS:
        texts.append(("word " * 500)[:n])
        texts.append(("Sentence here. " * 200)[:n])
    # start in (300, 499) with a late break: second cut adaptive at an absolute offset
    texts.append("a" * 700 + "." + "b" * 200 + "c" * 400 + "." + "d" * 2000)
    texts.append(("y" * 520 + ".") + ("q" * 300 + "\n") + "r" * 3000)
    return texts


def _chunks(spark, texts, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [tuple(r) for r in chunk(df, **kw).orderBy("doc_id", "chunk_index").collect()]


def _by_sql(texts):
    import duckdb
    import pyarrow as pa

    from docmill.plans.oracle import CHUNKS_CTE
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()),
                                        "text": pa.array(texts, pa.string())}))
    return con.execute(f"WITH {CHUNKS_CTE.strip()} SELECT doc_id, chunk_index, start_char, end_char, text FROM chunks "
                       "ORDER BY doc_id, chunk_index").fetchall()


def _check_properties(texts, got, size, overlap):
    half = size // 2
    for i, t in enumerate(texts):
        mine = [g[1:] for g in got if g[0] == i]
        assert (mine == []) == (t == "")
        for k, (index, start, end, text) in enumerate(mine):
            assert index == k and text == t[start:end].strip()
            assert start == (0 if k == 0 else mine[k - 1][2] - overlap)  # the overlap
            if end - start != size:  # an early cut: right after a break that lies behind the middle
                assert t[start:start + size][end - 1] in ".\n" and end > start + half + 1
                assert start + size < len(t) and start < size - 1 - half
        if mine:
            assert mine[-1][2] >= len(t) - (0 if mine[-1][2] >= len(t) else overlap)
            assert mine[-1][1] < len(t)


def test_edge_cases_match_the_sql_form(spark):
    texts = _edge_texts()
    got = _chunks(spark, texts)
    assert got == _by_sql(texts)
    _check_properties(texts, got, 1000, 200)


def test_goldens(spark):
    texts = ["", "a" * 801, "x" * 969 + "." + "y" * 1489]
    got = _chunks(spark, texts)
    assert [g for g in got if g[0] == 0] == []
    assert [g[2:4] for g in got if g[0] == 1] == [(0, 1000), (800, 1800)]
    # a text of 2,459 characters whose first cut is at 970 has four chunks
    assert [g[2:4] for g in got if g[0] == 2] == [(0, 970), (770, 1770), (1570, 2570), (2370, 3370)]


def test_chunk_count_matches_explode(spark):
    texts = _edge_texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counts = {r.doc_id: r.chunk_count for r in chunk_count(df).collect()}
    got = _chunks(spark, texts)
    assert counts == {i: sum(g[0] == i for g in got) for i in range(len(texts))}


@pytest.mark.parametrize("size,overlap", [(300, 50), (100, 10), (64, 0), (1000, 200)])
def test_other_parameters(spark, size, overlap):
    texts = [("Alpha beta. Gamma\ndelta " * 60)[:n] for n in (0, 50, 99, 100, 101, 350, 777, 1234)]
    _check_properties(texts, _chunks(spark, texts, size=size, overlap=overlap), size, overlap)


def test_refuses_stalling_parameters():
    with pytest.raises(ValueError):
        _check(100, 60)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab .\n\t é")), min_size=0, max_size=2600),
                min_size=1, max_size=4))
def test_property_random_texts(spark, texts):
    got = _chunks(spark, texts)
    assert got == _by_sql(texts)
    _check_properties(texts, got, 1000, 200)


def test_plan_is_narrow_and_python_free(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    plan = plan_text(chunk(df))
    for node in ("Exchange", "EvalPython", "MapInArrow", "MapInPandas", "PythonUDF"):
        assert node not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
