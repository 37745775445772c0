"""Located findings of odd texts and keys equal their SQL."""

import duckdb

from loomstone import catalog

TEXTS = (
    "", " ", ".", " . The end.", ".The", None, "The", "The ", "The. x", "Theory.", "And so on. The", "Le chat\n dort. x", "Y\r\na. b", "x\u2028y z.", "The\u2028", "And\u2029", "The\u0085", "\u0085The cat.", "a\x0bb. c", "a \x0b\x0b b.", "\x0bThe cat.", " \x0b The", "The\x0b",
    "a\x1cb", "a\u00a0 b. c", "\u3000El", "é\U0001f600. x", "DOC_7: The cat. x", ": x", "\r", "The\r", "The\n\n", "x" * 70000, "   ",
)


def test_odd_texts_and_keys_are_located_as_their_sql_says(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(-5, "The cat. x"), (None, "Und ja. x"), (None, None), (3, "The"), (2**62, "El x")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    columns = ["doc_id", "locator", "characters", "role"]
    ours = [tuple(r) for r in catalog.queries()["located_findings"](spark, str(tmp_path)).select(*columns).collect()]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    theirs = con.execute(f"select {', '.join(columns)} from ({catalog.oracle_sql()['located_findings']})").fetchall()
    assert sorted(ours, key=repr) == sorted(theirs, key=repr)
