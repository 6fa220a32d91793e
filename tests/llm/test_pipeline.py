"""The pipeline over planted documents, and the registered queries over a folder of odd tables."""

import random

import pytest
import tiktoken

import corpus_pipeline
from trawl.llm import byte_bpe
from trawl.llm.registry import ORACLES, QUERIES

EXTRA = "kept string, item_ids string, `a.b` int, t long, n_words string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = f"file://{tmp_path_factory.mktemp('tables')}"
    good = [(i, prose(i, 60 + i)) for i in range(20)]
    item = prose(700, 30)
    odd = [(100, prose(3, 63)), (101, prose(4, 64) + " more"), (102, "$# " * 40), (103, None), (104, ""), (105, f"{prose(50, 30)} {item} {prose(51, 30)}"), (106, f'{prose(52, 40)} token = "0123456789abcdef0123"'), (None, prose(60, 70)), (107, prose(61, 50)), (107, prose(61, 50))]
    rows = [(i, t, "en", "s", len(t or ""), "x", "y", 1, 2, "z") for i, t in [*good, *odd]]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{top}/documents.parquet")
    docs.where("false").write.parquet(f"{top}/none/documents.parquet")
    other = {
        "benchmark": ([(1, item), (2, None)], "item_id long, text string"),
        "labels": ([(i, 1, 0) for i in range(20)] + [(102, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int"),
        "pages": ([(1, "http://a.example.com/en/1", "<p>"), (None, None, None)], "page_id long, url string, html string"),
        "conversations": ([(0, 0, "user", "a"), (1, 0, "user", "a"), (None, 1, None, None)], "conv_id long, turn long, role string, text string"),
    }
    for name, (values, ddl) in other.items():
        df = spark.createDataFrame(values, ddl)
        df.write.parquet(f"{top}/{name}.parquet")
        df.where("false").write.parquet(f"{top}/none/{name}.parquet")
    return top


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = []
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = corpus_pipeline.materialize(stage(spark, docs, folder))
        if name != "byte_bpe":
            assert docs.columns == columns
        left.append(sorted((r.doc_id for r in docs.collect()), key=lambda i: (i is not None, i or 0)))
    everything = [None, *range(20), 100, 101, 105, 106, 107, 107]
    assert left[0] == everything
    assert left[1] == [None, *range(20), 105, 106, 107]
    assert left[2] == left[3] == left[4] == [None, *range(20), 106, 107]
    path, pattern = byte_bpe.public_ranks()
    with open(path, "rb") as f:
        library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.ByteBPE.from_file(f.read(), pattern).ranks, special_tokens={})
    rows = {r.doc_id: r.ids for r in docs.collect()}
    assert rows[106] == library.encode_ordinary(f'{prose(52, 40)} token = "[SECRET]"') and rows[7] == library.encode_ordinary(prose(7, 67))
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, folder).collect()} == rows


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith("op")])
def test_queries_take_odd_and_empty_tables(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0
    assert QUERIES[name](spark, f"{folder}/none").count() == 0


@pytest.mark.parametrize("name", ORACLES)
def test_oracles(spark, name):
    import duckdb
    import pandas as pd

    top = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{top}/{t}.parquet'")
    tidy = lambda df: sorted(repr(tuple(None if pd.isna(v) else v if isinstance(v, str) else float(v) for v in r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))
    assert tidy(QUERIES[name](spark, top).toPandas()) == tidy(con.sql(ORACLES[name]).df())
