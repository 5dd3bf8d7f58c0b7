"""The pipeline stage by stage against brute force on a small fixture, and the registered queries against DuckDB."""

import hashlib
import os

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
import public_tokenizers
from pricetide.llm import byte_bpe, factorisation, line_frequency
from test_operators import DOCS, brute_components, docs_of, edited, prose
from tools.check_oracle import norm


@pytest.fixture(scope="module")
def fixture_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    item = prose(4321, 40, 5000)
    rows = [(i, prose(i, 120), "a") for i in range(40)]
    rows += [(100 + i, "BUY NOW!! $$$ ### *** " * 25 + prose(i, 8), "a") for i in range(20)]
    rows += [(200 + k, edited(k, prose(7, 120), k % 3), "b") for k in range(12)] + [(300, prose(3, 120), "c"), (301, prose(3, 120).upper(), "c"), (301, prose(3, 120).upper(), "c")]
    rows += [(400 + k, f"{prose(5000 + k, 60)}\n{item}\n{prose(6000 + k, 60)}", "b") for k in range(4)]
    rows += [(500, None, None), (501, "", "a"), (502, "few words", "a"), (None, prose(900, 100), None), (503, prose(901, 20_000), "a")]
    docs_of(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(not 100 <= i < 120), 0) for i, _, _ in rows if i is not None and i < 400], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, fixture_dir, tmp_path):
    docs, columns = spark.read.parquet(f"{fixture_dir}/documents.parquet"), None
    key = lambda r: (str(r["doc_id"]), r["text"])
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, fixture_dir).write.parquet(str(tmp_path / name))
        source, docs = docs, spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        if name != "tokens":
            assert docs.columns == source.columns
        if name == "quality_rules":
            kept = [r["doc_id"] for r in line_frequency.quality_report(source).collect() if r["kept"]]
            assert sorted(map(str, kept)) == sorted(str(r["doc_id"]) for r in after)
            assert all(r["n_chars"] == len(r["text"]) for r in after) and not {500, 501, 502} & {r["doc_id"] for r in after}
        elif name == "quality_classifier":
            scores = factorisation.classify(source, spark.read.parquet(f"{fixture_dir}/labels.parquet")).collect()
            assert sorted(str(r["doc_id"]) for r in scores if r["predicted"]) == sorted(str(r["doc_id"]) for r in after)
            assert not any(r["doc_id"] is not None and 100 <= r["doc_id"] < 120 for r in after) and {r["doc_id"] for r in after} >= set(range(40))
        elif name == "near_duplicates":
            groups = brute_components([(r["doc_id"], r["text"], "") for r in before])
            assert sorted(map(str, {c for _, _, c in groups})) == sorted(str(r["doc_id"]) for r in after)
            assert {key(r) for r in after} <= {key(r) for r in before}
        elif name == "decontamination":
            assert {key(r) for r in before} - {key(r) for r in after} == {key(r) for r in before if r["doc_id"] is not None and 400 <= r["doc_id"] < 404}
        else:
            encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(byte_bpe.VOCABULARY), special_tokens={})
            want = sorted((str(r["doc_id"]), hashlib.sha256(np.array(encoding.encode_ordinary(r["text"]), "<u4").tobytes()).hexdigest()) for r in before)
            assert sorted((str(r["doc_id"]), r["ids_sha256"]) for r in after) == want and all(r["exact"] for r in after)


def test_stages_on_an_empty_table(spark, fixture_dir):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, fixture_dir).count() == 0


ORACLES = [name for name in entry.oracle_sql() if name.startswith("op") and name[2].isdigit()]


@pytest.mark.parametrize("name", ORACLES)
def test_oracle(spark, folder, name):
    db = duckdb.connect()
    for file in os.listdir(folder):
        db.execute(f"create view {file.split('.')[0]} as select * from '{folder}/{file}'")
    df = entry.queries()[name](spark, folder)
    cursor = db.execute(entry.oracle_sql()[name])
    found = [d[0] for d in cursor.description]
    assert sorted(found) == sorted(df.columns)
    want = sorted(repr(tuple(norm(r[found.index(c)]) for c in sorted(found))) for r in cursor.fetchall())
    assert sorted(repr(tuple(norm(r[c]) for c in sorted(found))) for r in df.collect()) == want


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_stages_bound_their_batches(spark, monkeypatch):
    """A stage's Arrow batches are bounded by bytes: the texts of a partition are not one batch."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    monkeypatch.setattr(byte_bpe, "round_trip", lambda docs, **_: docs.mapInArrow(sizes, "size long"))
    docs = spark.range(0, 300, 1, 1).selectExpr("id as doc_id", "repeat('word ', 20000) as text")
    found = [r["size"] for r in corpus_pipeline.tokens(spark, docs, "").collect()]
    assert sum(found) >= 30_000_000 and max(found) < 10_000_000
