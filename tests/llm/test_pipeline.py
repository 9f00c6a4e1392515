import hashlib

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

import corpus_pipeline
from linkweave.llm import bpe
from linkweave.llm.queries import ORACLES, QUERIES
from linkweave.session import small_batches

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs)
    return seen


def test_stages_against_plain_versions(spark, stages):
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = [{r["doc_id"] for r in s.collect()} for s in stages]
    assert kept[1] <= kept[0] and kept[2] <= kept[1] and kept[3] <= kept[2] and kept[4] == kept[3]
    known = [i for i in labels if i in rows]
    # a small table with few toxic documents: clean documents stay
    assert np.mean([i in kept[0] for i in known if not labels[i]["toxic"]]) > 0.97
    assert np.mean([(i in kept[1]) == bool(labels[i]["quality"]) for i in known if i in kept[0]]) > 0.9
    # no two of the documents that stay are near copies, and one of each group does
    sets = {}
    for i in kept[1]:
        words = rows[i]["text"].encode().lower().split()
        sets[i] = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
    near = lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)
    stay = sorted(kept[2])
    assert not any(near(sets[a], sets[b]) for n, a in enumerate(stay) for b in stay[:n])
    assert all(any(near(sets[i], sets[j]) for j in kept[1] if j < i) for i in kept[1] - kept[2])
    tokens = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load(P.path("byte_bpe_multi_50k.tiktoken")).ranks, special_tokens={})
    for r in stages[4].collect():
        ids = tokens.encode_ordinary(rows[r["doc_id"]]["text"])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def test_run_gives_the_rows_of_the_stages(spark, stages):
    key = lambda df: sorted(map(str, df.collect()))
    assert key(corpus_pipeline.run(spark, SF)) == key(stages[-1])


def test_python_tasks_get_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["rows", "bytes"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    for name, stage in corpus_pipeline.STAGES:
        if name == "mix":  # has no Python tasks
            continue
        session = spark.newSession()
        docs = session.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
        assert stage(session, docs, SF).count() == 0
        texts = session.range(2000, numPartitions=1).selectExpr("id", "repeat('words ', 1000) AS text")
        found = texts.mapInArrow(sizes, "rows long, bytes long").collect()
        assert sum(r["rows"] for r in found) == 2000 and max(r["bytes"] for r in found) < 2 << 20, name
    session = spark.newSession()
    session.conf.set(key, "4m")
    small_batches(session)
    assert session.conf.get(key) == "4m"


def test_nulls_and_empty_tables_pass(spark, tmp_path):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "short text", None, "a", 10), (3, "Word after word goes by. " * 5000, "en", "a", None)]
    for name, rows in (("odd", odd), ("none", [])):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / name / str(len(list(tmp_path.glob(f"{name}/*")))))
            stage(spark, docs, str(tmp_path)).write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.columns[0] == "doc_id"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(ORACLES[name]).fetchall()
    names = [d[0] for d in con.description]
    got = [tuple(r[n] for n in names) for r in QUERIES[name](spark, SF).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
