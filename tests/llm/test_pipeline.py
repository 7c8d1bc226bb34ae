import corpus_pipeline
import duckdb
import numpy as np
from conftest_llm import DIR, ODD
from test_dedup import near_groups, repeats

from verdigris.llm import minhash, suffix_array
from verdigris.llm.queries import llm_oracle_sql, llm_queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_do_what_their_operators_find(spark, tmp_path):
    directory = DIR
    docs = spark.read.parquet(f"{directory}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{directory}/labels.parquet").collect()}
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, directory).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()} if k < 4 else docs.collect())
        if k < 4:
            assert docs.columns == COLUMNS, name
    clean = [i for i, r in labels.items() if r["toxic"] == 0]
    assert np.mean([i in kept[0] for i in clean]) > 0.97
    good = [i for i, r in labels.items() if r["quality"] == 1 and i in kept[0]]
    assert np.mean([i in kept[1] for i in good]) > 0.93
    gone = {i for i, _ in near_groups(kept[1], minhash.THRESHOLD)}
    assert set(kept[2]) == set(kept[1]) - gone
    # No passage is left that two documents share, and first holders keep theirs.
    assert not repeats(kept[3], suffix_array.MIN_WORDS)
    cut = {x[0] for x in repeats(kept[2], suffix_array.MIN_WORDS) if x[1] != x[0]}
    assert all(kept[3][i] == t for i, t in kept[2].items() if i not in cut)
    assert {r["doc_id"] for r in kept[4]} <= set(kept[3])


def test_run_is_the_stages_in_turn(spark):
    rows = corpus_pipeline.run(spark, DIR)
    assert rows.count() > 0 and "seq_id" in rows.columns
    assert corpus_pipeline.ORACLE_SQL is None


def test_queries_match_their_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    for name, sql in llm_oracle_sql().items():
        want = con.execute(sql).df()
        got = llm_queries()[name](spark, DIR).toPandas()[want.columns.tolist()]
        assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist())), name


def test_stages_take_odd_rows_and_no_rows(spark, make, tmp_path):
    """Nulls, empty and long texts, repeated rows, two texts under one doc_id, clashing columns, and an empty table."""
    prose = ". ".join(f"The {a} of the {b} was seen by {c} on the way to the old town" for a, b, c in zip(*[iter("river mill stone bridge walker house garden tree winter meadow stream light shadow market street window table candle".split())] * 3)) + "."
    other = prose.replace("old town", "harbour wall").replace("seen by", "made for")
    rows = [*ODD, (30, prose), (31, prose), (31, other + " A further sentence that only this one has."), (32, None), (None, prose), (33, prose), (33, prose)]
    for clash in (True, False):
        for part in (rows, []):
            docs = make(part, clash)
            for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
                path = str(tmp_path / f"{clash}-{len(part)}-{name}")
                stage(spark, docs, DIR).write.parquet(path)
                docs = spark.read.parquet(path)
                if k < 4:
                    assert docs.columns == COLUMNS, name
                if name == "minhash_near_dedup" and part:
                    left = {(r["doc_id"], r["text"]) for r in docs.collect()}
                    assert (33, prose) not in left and (31, prose) not in left
                    assert (None, prose) in left or not any(t == prose for _, t in left)
            assert bool(docs.count()) == bool(part)
