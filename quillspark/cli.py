"""Command line: train, apply, inspect, explain, version."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillspark import __version__
from quillspark.functions.normalize import CHUNKINGS, FORMS, SPACERS, NormalizerConfig
from quillspark.model import Model, model_info
from quillspark.operators.encode import Encoder, encode
from quillspark.operators.training import train_bpe
from quillspark.sources.corpus import read_lines


def _session() -> SparkSession:
    return SparkSession.builder.appName("quillspark").getOrCreate()


def _there(path: str) -> str:
    if not Path(path).exists():
        print(f"not found: {path}", file=sys.stderr)
        raise SystemExit(1)
    return path


def _train(a: argparse.Namespace) -> None:
    texts = read_lines(_session(), _there(a.corpus), strip_ends=True)
    model = train_bpe(texts, a.vocab_size, normalizer=NormalizerConfig(a.normalization, a.spacer, a.lowercase, a.pre_tokenization), byte_fallback=a.byte_fallback, verbose=a.verbose)
    model.save(a.output, {"corpus_path": a.corpus, "num_training_texts": texts.count()})
    print(f"{a.output}: {len(model)} tokens, {len(model.merges)} merges")


def _apply(a: argparse.Namespace) -> None:
    model = Model.load(_there(a.model))
    if a.input:
        texts = read_lines(_session(), _there(a.input), strip_ends=True)
        rows = (r["line"] for r in texts.select("doc_id", F.array_join(encode(F.col("text"), model), " ").alias("line")).orderBy("doc_id").toLocalIterator())
    else:
        encoder = Encoder(model)
        rows = (" ".join(encoder.encode(line.strip())) for line in sys.stdin if line.strip())
    if a.output:
        with open(a.output, "w", encoding="utf-8") as out:
            out.writelines(f"{row}\n" for row in rows)
    else:
        for row in rows:
            print(row)


def _inspect(a: argparse.Namespace) -> None:
    info = model_info(_there(a.model))
    for key in ("algorithm", "version", "created_at", "vocab_size", "num_merges", "byte_fallback", "model_hash", "normalizer"):
        print(f"{key}: {info[key]}")
    for rank, (left, right) in enumerate(Model.load(a.model).merges[: a.top_merges]):
        print(f"{rank}\t{left}\t{right}\t{left + right}")


def _explain(a: argparse.Namespace) -> None:
    for chunk, step, left, right, rank, tokens in Encoder(Model.load(_there(a.model))).explain(a.text, a.whole):
        merge = "start" if rank is None else f"{left} + {right} (rank {rank})"
        print(f"chunk {chunk} step {step}: {merge}: {' '.join(tokens)}")


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quillspark")
    commands = parser.add_subparsers(required=True)
    train = commands.add_parser("train")
    train.add_argument("corpus")
    train.add_argument("output")
    train.add_argument("-v", "--vocab-size", type=int, default=1000)
    train.add_argument("-n", "--normalization", default="NFKC", type=str.upper, choices=FORMS)
    train.add_argument("-s", "--spacer", default="PREFIX", type=str.upper, choices=[*SPACERS, "SEPARATOR"])
    train.add_argument("-p", "--pre-tokenization", default="NONE", type=str.upper, choices=[*CHUNKINGS, "PYTHON"])
    train.add_argument("--byte-fallback", action=argparse.BooleanOptionalAction, default=True)
    train.add_argument("--lowercase", action="store_true")
    train.add_argument("--verbose", action="store_true", help="tell of every 500 merges")
    train.set_defaults(run=_train)
    apply = commands.add_parser("apply")
    apply.add_argument("model")
    apply.add_argument("-i", "--input")
    apply.add_argument("-o", "--output")
    apply.set_defaults(run=_apply)
    inspect = commands.add_parser("inspect")
    inspect.add_argument("model")
    inspect.add_argument("--top-merges", type=int, default=20)
    inspect.set_defaults(run=_inspect)
    explain = commands.add_parser("explain")
    explain.add_argument("text")
    explain.add_argument("model")
    explain.add_argument("--whole", action="store_true", help="take the text as one chunk")
    explain.set_defaults(run=_explain)
    commands.add_parser("version").set_defaults(run=lambda a: print(__version__))
    a = parser.parse_args(arguments)
    a.run(a)


if __name__ == "__main__":
    main()
