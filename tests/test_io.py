import io
import sys

import pytest
from pyspark.sql import functions as F

from quillspark import cli
from quillspark.functions.normalize import NormalizerConfig
from quillspark.model import Model
from quillspark.operators.encode import Encoder, encode
from quillspark.sources import corpus as C
from quillspark.streaming.encode import count_stream, encode_stream, write_stream

MODEL = Model(tuple("▁abcdehlorw"), (("l", "l"), ("▁", "h")), NormalizerConfig("NONE", "PREFIX", chunking="GPT2"))


def pairs(df, *columns):
    return [tuple(r) for r in df.select(*(columns or ("doc_id", "text"))).orderBy("doc_id").collect()]


def test_lines(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_text(" one \n\n  \ntwo\tx\nthree", encoding="utf-8")
    assert pairs(C.read_lines(spark, str(path))) == [(0, " one "), (1, "two\tx"), (2, "three")]
    assert pairs(C.resolve(spark, str(path)))[2] == (2, "three") and pairs(C.read_lines(spark, str(path), True))[0] == (0, "one")
    assert pairs(C.resolve(spark, ["a", "b"])) == [(0, "a"), (1, "b")] and pairs(C.resolve(spark, path=str(path)))[1] == (1, "two\tx")
    with pytest.raises(ValueError):
        C.resolve(spark)
    with pytest.raises(FileNotFoundError):
        C.resolve(spark, str(tmp_path / "none.txt"))


def test_whole_files_and_languages(spark, tmp_path):
    (tmp_path / "src" / "deep").mkdir(parents=True)
    (tmp_path / "src" / "b.py").write_text("x = 1\n" * 30)
    (tmp_path / "src" / "a.py").write_text("short")
    (tmp_path / "src" / "deep" / "c.py").write_text("y = 2\n" * 40)
    (tmp_path / "src" / "note.md").write_text("z" * 500)
    flat = C.read_files(spark, str(tmp_path / "src"))
    assert [p.rsplit("/", 1)[1] for _, p in pairs(flat, "doc_id", "path")] == ["a.py", "b.py", "note.md"]
    deep = C.read_files(spark, str(tmp_path / "src"), "*.py", recursive=True, min_chars=100)
    assert deep.count() == 2 and C.read_files(spark, str(tmp_path / "src"), "*.py", True, 100, 1).count() == 1
    assert C.pick_files(deep.withColumn("path", F.lit("s.py")), 1).count() == 1 and C.pick_files(deep.withColumn("path", F.lit("tests/s.py")), 1).count() == 0
    (tmp_path / "langs").mkdir()
    (tmp_path / "langs" / "en.txt").write_text(" hello \n\nyou\n")
    (tmp_path / "langs" / "de.txt").write_text("hallo\n")
    assert sorted((x, t) for _, x, t in pairs(C.read_languages(spark, str(tmp_path / "langs")), "doc_id", "lang", "text")) == [("de", "hallo"), ("en", "hello"), ("en", "you")]


def test_generated_corpora(spark):
    assert pairs(C.fallback_corpus(spark, 3))[20][1] == C.FALLBACK_LINES[0] and C.fallback_corpus(spark, 3).count() == 60
    rows = C.synthetic_corpus(spark, 12).collect()
    stems, ends = C.stems_and_ends("German")
    for r in rows:
        if r.lang == "German":
            i = r.doc_id - 24
            assert r.text == " ".join(stems[(i * j + j) % len(stems)] + ends[(i + 3 * j) % len(ends)] for j in range(5 + i % 6))
    assert len(rows) == 48
    assert [tuple(r) for r in C.manifest(spark.createDataFrame([("en", "a b"), ("en", None)], "lang string, text string")).collect()] == [("en", 2, 3, 2)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, "hello"), (1, "world")], "doc_id bigint, text string").withColumn("tokens", encode(F.col("text"), MODEL))
    C.write_tokens(df.coalesce(1), str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == [" ".join(Encoder(MODEL).encode(t)) for t in ("hello", "world")]
    C.write_csv(df.select("doc_id", "text"), str(tmp_path / "c"))
    C.write_json(df, str(tmp_path / "j"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["doc_id", "text"] and spark.read.json(str(tmp_path / "j")).count() == 2


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("hello", "2024-01-01 00:01:00"), ("world", "2024-01-01 00:02:00"), (None, "2024-01-01 00:07:00")], "text string, at string").select("text", F.col("at").cast("timestamp").alias("at")).coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("text string, at timestamp").parquet(str(source))
    write_stream(encode_stream(stream, MODEL), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert {r.text: r.tokens for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {t: Encoder(MODEL).encode(t) for t in ("hello", "world", None)}
    query = count_stream(stream, MODEL).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.n_texts for r in spark.table("counted").collect()) == [1, 2]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    lines = tmp_path / "c.txt"
    lines.write_text("hello world\nhello there\n")
    model = str(tmp_path / "m.json")
    cli.main(["train", str(lines), model, "-v", "20", "-p", "gpt2"])
    cli.main(["apply", model, "-i", str(lines), "-o", str(tmp_path / "out.txt")])
    encoder = Encoder(Model.load(model))
    assert (tmp_path / "out.txt").read_text().splitlines() == [" ".join(encoder.encode(t)) for t in ("hello world", "hello there")]
    monkeypatch.setattr(sys, "stdin", io.StringIO("hello\n\n"))
    capsys.readouterr()
    cli.main(["apply", model])
    assert capsys.readouterr().out == " ".join(encoder.encode("hello")) + "\n"
    cli.main(["inspect", model, "--top-merges", "2"])
    cli.main(["explain", "hello", model])
    cli.main(["version"])
    out = capsys.readouterr().out
    assert "num_merges" in out and "chunk 0 step 1" in out and "0.1.0" in out
    with pytest.raises(SystemExit) as stop:
        cli.main(["inspect", str(tmp_path / "none")])
    assert stop.value.code == 1
