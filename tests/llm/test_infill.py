"""Fill-in-middle against plain loops and its SQL."""

from __future__ import annotations

import hashlib
import re

import duckdb
import pyarrow as pa
import pytest

from tessera.llm import infill

key = lambda r: tuple(map(str, r))
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def brute(doc_id, text, seed=1, rate=90, spm_rate=20):
    """(n, form, prefix_chars, middle_chars, output)."""
    text = text or ""
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < spm_rate
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_op13_of_awkward_rows(docs, rows):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, t in rows:
        *head, out = brute(i, t)
        want.append((i, *head, sha(out), sha(t or "")))
    assert sorted(map(tuple, infill.op13(docs).collect()), key=key) == sorted(want, key=key)


def test_outputs_of_one_batch(spark):
    texts = [None, "", "a", "<", "<P", "P>", "a<S", "S>b <M", "has <M> mark", "é" * 40, "a1b22 " * 300, "日本 🙂", "\x00\n\r", "<P" * 9, "Zz[@`{" * 5, "word " * 40_000]
    given = [(i * 37 + k, t) for k in range(6) for i, t in enumerate(texts)]
    df = spark.createDataFrame(given, "doc_id long, text string").coalesce(2)
    for rate, spm in ((100, 50), (100, 0), (0, 50), (90, 100)):
        made = infill.fill_in_middle(df, 7, rate, spm)
        got = [tuple(r) for r in made.withColumn("back", infill.restored(made.output, made.form)).collect()]
        want = [(i, *brute(i, t, 7, rate, spm), t or "") for i, t in given]
        assert sorted(got, key=key) == sorted(want, key=key)


def test_unit_lists_of_a_slice():
    text = pa.array(["skip", "ab1 cd", "", "éa", "x"])[1:4]
    assert infill.unit_lists(text).to_pylist() == [["ab", "1", " ", "cd"], [], ["é", "a"]]
    assert infill.unit_lists(text[:0]).to_pylist() == []


def test_empty_table(none):
    assert infill.op13(none).count() == 0


@pytest.mark.parametrize("column", ["n", "form", "output_sha256"])
def test_sql(spark, sf, column):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, {column} FROM ({infill.OP13_SQL})").fetchall()
    got = infill.op13(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", column).collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
