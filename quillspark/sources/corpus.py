"""Corpora from files, and what is written back as text, CSV or JSON."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.whitespace import strip, word_count
from quillspark.sources.shared import stored

FALLBACK_LINES = (
    "if total >= limit and count <= 10:", "def scale(values, by=2):", "result = left + right", "for row in table.rows():", "while not queue.empty():",
    "return [x ** 2 for x in items]", "import json", "from pathlib import Path", "name = record['name']", "assert size != 0",
    "total += price * amount", "left -= 1", "flag = a == b", "lambda x: x // 2", "class Reader(Base):",
    "with open(path) as handle:", "try:", "except ValueError as error:", "raise KeyError(name)", "print(f'{total:.2f}')",
)


def _numbered(lines: DataFrame) -> DataFrame:
    """doc_id in order of path and line: rank of the line within its partition plus what the partitions before hold. Files are read in partitions of one path range each, so no row needs a global sort."""
    rows = lines.select("*", F.input_file_name().alias("qs_path"), F.monotonically_increasing_id().alias("qs_id"))
    rows = stored(rows, "lines").repartitionByRange("qs_path", "qs_id").select("*", F.spark_partition_id().alias("qs_part"))
    rows = stored(rows, "lines")
    before = rows.groupBy("qs_part").count().withColumn("qs_before", F.coalesce(F.sum("count").over(Window.orderBy("qs_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    rank = F.row_number().over(Window.partitionBy("qs_part").orderBy("qs_path", "qs_id")) - 1
    return rows.withColumn("qs_rank", rank).join(F.broadcast(before), "qs_part").select((F.col("qs_rank") + F.col("qs_before")).cast("bigint").alias("doc_id"), *lines.columns)


def _text(spark: SparkSession, path: str | Sequence[str], wholetext: bool = False, **options) -> DataFrame:
    try:
        return spark.read.options(**options).text(path if isinstance(path, str) else list(path), wholetext=wholetext)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(str(path)) from error
        raise


def read_lines(spark: SparkSession, path: str | Sequence[str], strip_ends: bool = False) -> DataFrame:
    """texts(doc_id, text) of the lines of files that aren't blank; strip_ends also takes whitespace from their ends."""
    lines = _text(spark, path, lineSep="\n").filter(strip(F.col("value")) != "")
    return _numbered(lines.select((strip(F.col("value")) if strip_ends else F.col("value")).alias("text")))


def resolve(spark: SparkSession, texts: DataFrame | Iterable[str] | str | None = None, path: str | None = None) -> DataFrame:
    """texts(doc_id, text) from a table, a list, or a path (a string is one); an error where nothing is given."""
    if isinstance(texts, str) or texts is None and path is not None:
        return read_lines(spark, texts or path)
    if texts is None:
        raise ValueError("texts or a path is needed")
    if isinstance(texts, DataFrame):
        return texts
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


def read_files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False, min_chars: int = 0, max_files: int | None = None) -> DataFrame:
    """texts(doc_id, path, text) of whole files in order of path; those of at most min_chars are left out, at most max_files taken. What can't be read is passed over."""
    files = _text(spark, folder, wholetext=True, recursiveFileLookup=recursive, pathGlobFilter=pattern, ignoreCorruptFiles=True, ignoreMissingFiles=True).select(F.input_file_name().alias("path"), F.col("value").alias("text")).filter(F.length("text") > min_chars)
    numbered = _numbered(files.orderBy("path"))
    return numbered if max_files is None else numbered.filter(F.col("doc_id") < max_files)


def read_languages(spark: SparkSession, folder: str, suffix: str = ".txt") -> DataFrame:
    """texts(doc_id, lang, text) of files named for their language, lines stripped, blank ones left out."""
    lines = _text(spark, folder, pathGlobFilter=f"*{suffix}", lineSep="\n")
    lang = F.regexp_extract(F.input_file_name(), r"([^/]+)" + suffix.replace(".", r"\.") + "$", 1)
    return _numbered(lines.select(lang.alias("lang"), strip(F.col("value")).alias("text")).filter("text <> ''"))


def fallback_corpus(spark: SparkSession, times: int = 10) -> DataFrame:
    """Lines of source code, some times over, for where there is no file."""
    lines = spark.createDataFrame(list(enumerate(FALLBACK_LINES)), "k int, text string")
    n = len(FALLBACK_LINES)
    return lines.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).select((F.col("i") * n + F.col("k")).cast("bigint").alias("doc_id"), "text")


def pick_files(files: DataFrame, count: int, least: int = 10, most: int = 500) -> DataFrame:
    """Evenly spread sample of source files(path, text): no tests, examples or docs, least to most lines, every k-th by number of lines (then path)."""
    lines = F.size(F.split("text", "\n"))
    kept = files.filter(~F.lower("path").rlike("test|example|doc")).withColumn("n_lines", lines).filter(F.col("n_lines").between(least, most))
    every = F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy(F.lit(0))) / count))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("n_lines", "path")) - 1
    return kept.withColumn("qs_k", rank).withColumn("qs_step", every).filter("qs_k % qs_step = 0 AND qs_k / qs_step < " + str(count)).drop("qs_k", "qs_step")


def manifest(texts: DataFrame, by: str = "lang") -> DataFrame:
    """samples, chars and words of each language."""
    return texts.groupBy(by).agg(F.count("*").alias("samples"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("bigint").alias("chars"), F.coalesce(F.sum(word_count(F.col("text"))), F.lit(0)).cast("bigint").alias("words"))


#: The k-th stems of the four languages, in order; the last language has one less.
_STEMS = (
    "the el der hızlı",
    "quick rápido schnell kahverengi",
    "brown marrón braun tilki",
    "fox zorro fuchs atlar",
    "jumps salta springt üzerinde",
    "over sobre über tembel",
    "lazy perro hund köpek",
    "dog perezoso faul merhaba",
    "hello hola hallo dünya",
    "world mundo welt test",
    "test prueba test program",
    "program programa programm bilgisayar",
    "computer computadora computer bilim",
    "science ciencia wissenschaft yapay",
    "artificial artificial künstlich zeka",
    "intelligence inteligencia intelligenz makine",
    "machine máquina maschine öğrenme",
    "learning aprendizaje lernen sinir",
    "neural red neuron ağ",
    "network neuronal netzwerk",
)
LANGUAGES = ("English", "Spanish", "German", "Turkish")
_FRONT_AND_BACK = " ".join(f"l{v}k" for v in "iıuü") + " " + " ".join(f"c{v}" for v in "iıuü")
#: Endings besides the empty one.
_ENDS = (
    "s ed ing er est",
    "o a os as ado ada ados adas ando iendo",
    "s es en er ung heit keit lich isch",
    f"lar ler im in i de den e dan {_FRONT_AND_BACK}",
)


def stems_and_ends(language: str) -> tuple[list[str], list[str]]:
    k = LANGUAGES.index(language)
    return [w[k] for w in (line.split() for line in _STEMS) if k < len(w)], ["", *_ENDS[k].split()]


def synthetic_corpus(spark: SparkSession, sentences: int = 500) -> DataFrame:
    """texts(lang, lang_ord, doc_id, text): sentences of stems and endings picked by arithmetic on their numbers."""
    table = spark.createDataFrame([(name, k, *stems_and_ends(name)) for k, name in enumerate(LANGUAGES)], "lang string, lang_ord int, stems array<string>, ends array<string>")
    rows = table.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(sentences - 1))))
    word = "concat(stems[(i * j + j) % size(stems)], ends[(i + j * 3) % size(ends)])"
    text = F.expr(f"array_join(transform(sequence(0, 4 + i % 6), j -> {word}), ' ')")
    return rows.select("lang", "lang_ord", (F.col("lang_ord") * sentences + F.col("i")).cast("bigint").alias("doc_id"), text.alias("text"))


def write_tokens(encoded: DataFrame, path: str, line: Column | None = None) -> None:
    """A line of tokens between spaces for each row. line: the lines, where there are no tokens."""
    encoded.select((F.array_join("tokens", " ") if line is None else line).alias("value")).write.mode("overwrite").text(path)


def write_csv(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").option("header", True).csv(path)


def write_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)
