"""Lines are lowered letter by letter, as the SQL of op10 does."""

import random

import duckdb

from quillgraph.llm import queries


def test_lines_with_letters_lowered_by_place_equal_the_sql(spark, tmp_path):
    rng = random.Random(7)
    pool = ["ΟΔΟΣ", "οδοσ", "οδος", "İstanbul", "istanbul", "i\u0307stanbul", "ΣΑΣ Σ", "σασ σ", "σας ς",
            "Straße", "STRASSE", "ß", "ẞ", ""]
    docs = [(i, "\n".join(rng.choices(pool, k=3))) for i in range(40)]
    folder, con = str(tmp_path), duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.execute(f"COPY documents TO '{folder}/documents.parquet'")
    name = "op10_line_dedup"
    df = queries.QUERIES[name](spark, folder)
    answer = con.execute(queries.ORACLES[name])
    assert [c[0] for c in answer.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(answer.fetchall())
