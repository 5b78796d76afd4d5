import duckdb
import pytest

import corpus_pipeline
from quillspark.llm import common, decontamination, queries, secrets, sentencepieces, simhash, toxicity


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr([None if x is None or x != x else float(x) if isinstance(x, (int, float)) else str(x) for x in r]) for r in frame.astype(object).values.tolist())


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_runs_and_equals_its_sql(spark, data, name):
    ours = queries.QUERIES[name](spark, data).toPandas()
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for t in "documents embeddings pages benchmark labels".split():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
        assert rows(ours) == rows(con.execute(queries.ORACLE_SQL[name]).df())


def test_pipeline_equals_its_stages_done_by_hand(spark, data):
    """Each stage's decision taken from the operator's report, applied to rows in Python."""
    table = lambda n: spark.read.parquet(f"{data}/{n}.parquet")
    docs = table("documents")
    out, now = docs, docs.collect()
    frame = lambda rs: spark.createDataFrame(rs, docs.schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, data)
        assert out.columns == docs.columns
        kept = sorted(map(tuple, out.collect()))
        before = frame(now)
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.detect(before, table("labels")).collect()}
            now = [r for r in now if r.doc_id not in bad]
        elif name == "simhash_near_dedup":
            gone = {r.doc_id for r in simhash.groups(before).filter("doc_id <> group_id").collect()}
            now = [r for r in now if r.doc_id not in gone]
        elif name == "benchmark_decontamination":
            found = {r.doc_id: r for r in decontamination.find(before, table("benchmark")).collect()}
            now = [r if r.doc_id not in found else (r.doc_id, t, r.lang, r.source, len(t)) for r in now if (t := found[r.doc_id].clean_text if r.doc_id in found else "") is not None]
        else:
            hits = {}
            for r in secrets.scan(before).collect():
                hits.setdefault(r.doc_id, []).append(r)
            done = []
            for r in map(tuple, now):
                text = r[1]
                for h in sorted(hits.get(r[0], []), key=lambda h: -h.start):
                    text = text[: h.start] + f"[{h.kind}]" + text[h.end :]
                done.append((r[0], text, r[2], r[3], len(text)))
            now = done
        assert kept == sorted(map(tuple, now)), name
        out = frame([tuple(r) for r in now])
    codec = sentencepieces.PieceCodec()
    last = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, out, data).collect()}
    assert len(last) == len(now)
    for r in map(tuple, now):
        ids, *_ = codec.encode([r[1]])
        assert last[r[0]].ids == ids.tolist()


def test_pipeline_runs_and_its_tables_can_go(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0
    assert common.drop_stored(spark) > 4 and common.drop_stored(spark) == 0


def test_stages_on_awkward_rows(spark, data):
    long = "word " * 300_000
    rows = [(1, "a text of some words", "en", "s", 20), (1, "a text of some words", "en", "s", 20), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "no id", "en", "s", 5), (None, "no id", "en", "s", 5), (4, long, "en", "s", len(long)), (5, " .!", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", "'k' AS qs_key", "1 AS node", "2 AS words", "3 AS ids", "4 AS key", "5 AS qs_id", "6 AS count", "7 AS starts")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), data)
        now = stage(spark, now, data)
        assert empty.count() == 0 and empty.columns == now.columns
        if name != "sentencepiece":
            assert now.columns == docs.columns, name
    out = sorted((repr(r.doc_id), r.n_tokens) for r in now.collect())
    assert [i for i, _ in out] == ["1", "2", "3", "4", "5", "None", "None"]
    assert dict(out)["2"] is None and dict(out)["3"] == 0 and dict(out)["4"] >= 300_000
