"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON.

train_*: training to a vocabulary size. encode_*: encoding and counting the tokens of every
document with each way of chunking under a vocabulary of 10,000 tokens: medians of BENCH_RUNS
runs (3; the slowest and the rate are told too). The rest are queries of the registry.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [HERE, os.environ.get("PYTHONPATH")]))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from quillspark.functions.normalize import NormalizerConfig  # noqa: E402
from quillspark.operators.encode import count_tokens  # noqa: E402
from quillspark.operators.training import train_bpe  # noqa: E402
from quillspark.plans.registry import QUERIES  # noqa: E402

NAMES = ("ws_word_count", "pretok_gpt2", "word_freq", "pair_freq", "char_entropy", "bigram_pmi", "fertility_by_lang")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "4m").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    n_chars = docs.agg(F.sum(F.length("text"))).first()[0]
    seconds: dict[str, float] = {}
    rates: dict[str, float] = {}

    def timed(name, f):
        began = time.perf_counter()
        out = f()
        seconds[name] = round(time.perf_counter() - began, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
        return out

    for name in NAMES:
        timed(name, lambda name=name: QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save())
    gpt2 = NormalizerConfig(chunking="gpt2")
    models = {size: timed(f"train_vocab_{size}", lambda size=size: train_bpe(docs, size, normalizer=gpt2)) for size in (1000, 5000, 10_000)}
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    slowest: dict[str, float] = {}
    for chunking in ("none", "whitespace", "gpt2", "code"):
        model = type(models[10_000])(models[10_000].tokens, models[10_000].merges, NormalizerConfig(chunking=chunking))
        name, took = f"encode_{chunking}", []
        for _ in range(runs):
            timed(name, lambda model=model: docs.agg(F.sum(count_tokens(F.col("text"), model))).first())
            took.append(seconds[name])
        seconds[name], slowest[name] = round(median(took), 3), max(took)
        rates[name] = round(n_chars / 1e6 / seconds[name], 2)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/")), "encode_million_chars_per_sec": rates, "encode_slowest_run": slowest}))
    spark.stop()


if __name__ == "__main__":
    main()
