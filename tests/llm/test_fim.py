"""Fill-in-middle against a plain reading of its contract, SQL, and odd rows."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from knotwork.llm import fim

SCHEMA = "doc_id long, text string, n long, units string, form string"


def plain(ident, text):
    text = text or ""
    u = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n, h = len(u), hashlib.sha256(f"1:{'' if ident is None else ident}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


TEXTS = ["", None, "one", "a<P>b", "<M>", "< P > <S", "naïve 𝔘nit\n\n<S and M>", "tabs\tand\r\nlines", "x" * 70_000 + " 1" * 30_000, "the same", "the same", "é", "<<P", "ends with <"]


def rows(spark):
    data = [(None if k % 50 == 7 else k // 2, TEXTS[k % len(TEXTS)], k, "u", "f") for k in range(300)]
    return data, spark.createDataFrame(data, SCHEMA)


def test_whole_texts_as_the_contract_reads(spark):
    data, d = rows(spark)
    got = fim.transform(d).select("doc_id", "text", "fim.*", fim.restored(F.col("fim.output"), F.col("fim.form")).alias("back")).collect()
    assert len(got) == len(data)
    for r in got:
        n, form, p, m, out = plain(r.doc_id, r.text)
        assert (r.n, r.form, r.output, r.back) == (n, form, out, r.text or "")
        assert (None if r.prefix is None else len(r.prefix), None if r.middle is None else len(r.middle)) == (p, m)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_clashing_columns_stay_and_empty_tables_give_no_rows(spark):
    _, d = rows(spark)
    out = fim.transform(d.withColumn("fim", F.lit(1)))
    assert out.columns == [*d.columns, "fim"] and out.where("units = 'u' and form = 'f'").count() == d.count()
    assert fim.transform(d.limit(0)).count() == 0


@pytest.mark.parametrize("output,form", [("<P>a<S>b", "psm"), ("<S>a<P>b<M>c", "psm"), ("x<P>a<S>b<M>c", "psm")])
def test_outputs_of_another_form_restore_to_null(spark, output, form):
    d = spark.createDataFrame([(output, form)], "o string, f string")
    assert d.select(fim.restored(F.col("o"), F.col("f")).alias("t")).first().t is None


def test_query_equals_its_sql(spark, tmp_path):
    _, d = rows(spark)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = db.sql(fim.ORACLE)
    got = fim.op13_fim(spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


def test_no_shuffle_and_no_python(spark, tmp_path):
    rows(spark)[1].write.parquet(f"{tmp_path}/documents.parquet")
    plan = fim.op13_fim(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan and plan.count("regexp_extract_all") == 1
