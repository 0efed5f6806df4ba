import os
import zlib

import numpy as np
import pytest
from conftest import CLASHING, prose

import corpus_pipeline
from expkit.llm import common, op8_packing
from expkit.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    rng = random.Random(12)
    path = tmp_path_factory.mktemp("sf")
    docs, labels = [], []
    for i in range(240):
        words = prose(rng, rng.randint(8, 40))
        if toxic := i % 6 == 0:
            words += " vilekor grosumt"
        docs.append((i, words + ("\nall rights reserved" if i % 3 == 0 else "")))
        labels.append((i, 1, int(toxic)))
    docs += [(300 + i, docs[7][1] + "\n") for i in range(4)] + [(310, prose(rng, 25) + " token=abcdefgh12345"), (311, None), (312, "")]
    spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), dict(docs), {i: t for i, _, t in labels}


def test_stages_take_effect_and_keep_the_columns(spark, folder):
    path, texts, toxic = folder
    docs = common.table(spark, path, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "secrets", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.stored(stage(spark, docs, path), name)
        assert out.columns == COLUMNS and out.dtypes == docs.dtypes
        docs, kept[name] = out, {r.doc_id: r for r in out.collect()}
    assert set(kept["toxicity"]) == {i for i in texts if not toxic.get(i)}
    assert all("all rights reserved" not in r.text for r in kept["line_dedup"].values())
    assert set(kept["line_dedup"]) == set(kept["toxicity"])
    assert all(r.n_chars == len(r.text) for r in kept["line_dedup"].values())
    assert set(kept["toxicity"]) - set(kept["ngram_join"]) == {300, 301, 302, 303, 312}
    assert kept["secrets"][310].text.endswith(" [SECRET]")
    pieces = corpus_pipeline.packing(spark, docs, path).collect()
    assert {r.doc_id for r in pieces} == set(kept["secrets"])


def test_run_gives_the_last_stage(spark, folder):
    path, *_ = folder
    out = corpus_pipeline.run(spark, path)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_run_gives_every_piece_of_the_stages(spark, folder):
    path, *_ = folder
    docs = common.table(spark, path, "documents")
    for stage in (corpus_pipeline.toxicity, corpus_pipeline.line_dedup, corpus_pipeline.ngram_join, corpus_pipeline.secrets):
        rows = stage(spark, docs, path).collect()
        docs = spark.createDataFrame(rows, docs.schema)
    ids = {r.doc_id: [*_library().encode(r.text or "", add_special_tokens=False).ids, 1] for r in rows}
    assert len(ids) == len(rows)
    pieces = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in df.collect())
    got = pieces(corpus_pipeline.run(spark, path))
    assert got == pieces(corpus_pipeline.packing(spark, docs, path))
    # And by brute force: the pieces of each document follow one another and hold all its ids.
    at = dict.fromkeys(ids, 0)
    for i, start, length, crc, tokens in got:
        assert (start, tokens) == (at[i], len(ids[i]))
        assert crc == zlib.crc32(np.array(ids[i][start : start + length], "<u4").tobytes())
        at[i] += length
    assert at == {i: len(x) for i, x in ids.items()}


def _library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(op8_packing.tokenizer_path())


def test_stages_on_an_empty_table_with_clashing_columns(spark, folder, table):
    path, *_ = folder
    docs = table([])
    assert set(CLASHING) < set(docs.columns)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        assert out.count() == 0


def test_registered_where_it_can_be_imported():
    import __spark_entry__ as entry

    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES}
    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet{'/*' if os.path.isdir(f'{sf_dir}/{t}.parquet') else ''}')")
    rel = con.sql(ORACLE_SQL[name])
    columns = sorted(rel.columns)
    want = sorted(tuple(map(str, r)) for r in rel.select(*columns).fetchall())
    df = QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == columns
    assert sorted(tuple(map(str, r)) for r in df.select(*columns).collect()) == want


def test_run_on_a_table_with_repeated_ids_and_rows(spark, folder, tmp_path):
    import random

    path, *_ = folder
    rng = random.Random(3)
    a, b = prose(rng, 40), prose(rng, 40)
    rows = [(3, b), (4, b), (1, a), (3, a), (1, a), (9, None), (None, a)]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in rows], common.table(spark, path, "documents").schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    common.table(spark, path, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    tokens = {x: len(_library().encode(x or "", add_special_tokens=False).ids) + 1 for x in (a, b, None)}
    left = sorted(((1, tokens[a]), (3, tokens[b]), (9, tokens[None]), (None, tokens[a])), key=repr)
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        key = (r.doc_id, r.doc_tokens)
        got[key] = got.get(key, 0) + r.length
    assert sorted(got, key=repr) == left and all(n == k[1] for k, n in got.items())
