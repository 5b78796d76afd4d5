"""Quality and fairness of tokenisation, as aggregations.

Functions over encoded texts take a DataFrame with text and tokens (array<string>), and the
columns to group by. Ratios whose divisor is 0 are 0, unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.whitespace import SPACER, code_points, word_count, words
from quillspark.sources.shared import stored

OPERATORS = ("!=", "&&", "*=", "+=", "-=", "->", "//", "/=", "<<", "<=", "==", "=>", ">=", ">>", "||")
TEN_OPERATORS = ("!=", "&&", "+=", "-=", "->", "<=", "==", "=>", ">=", "||")
KEYWORDS = ("as", "async", "await", "class", "def", "elif", "else", "except", "for", "from", "if", "import", "lambda", "return", "try", "while", "with", "yield")
LISTED_KEYWORDS = ("assert", "async", "await", "class", "def", "else", "except", "for", "from", "if", "import", "lambda", "raise", "return", "try", "while", "with")
CLASS_KEYWORDS = ("class", "def", "else", "for", "from", "if", "import", "return")
CLASS_OPERATORS = ("(", ")", "*", "+", "-", "/", ":", "<=", "=", "==", ">=")


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def fertility(tokens: Column, text: Column) -> Column:
    """Tokens for each word of one text."""
    return ratio(F.size(tokens), word_count(text))


def corpus_report(encoded: DataFrame, by: Sequence[str] = ("lang",)) -> DataFrame:
    """n_tokens, n_words, n_chars, fertility and compression (tokens for each character), pooled."""
    sums = encoded.groupBy(*by).agg(F.sum(F.size("tokens")).cast("bigint").alias("n_tokens"), F.sum(word_count(F.col("text"))).cast("bigint").alias("n_words"), F.sum(F.length("text")).cast("bigint").alias("n_chars"))
    return sums.withColumn("fertility", ratio(F.col("n_tokens"), F.col("n_words"))).withColumn("compression", ratio(F.col("n_tokens"), F.col("n_chars")))


def text_sums(texts: DataFrame, by: str = "lang") -> DataFrame:
    """n_texts, n_words and n_chars, for pooled_report and pooled_coverage."""
    return texts.groupBy(by).agg(F.count("text").alias("n_texts"), F.sum(word_count(F.col("text"))).cast("bigint").alias("n_words"), F.sum(F.length("text")).cast("bigint").alias("n_chars"))


def _with_tokens(sums: DataFrame, tokens: DataFrame, by: str, **columns: Column) -> DataFrame:
    """text_sums with sums over tokens(by, token, n); 0 where texts have no token, null without a text."""
    counts = tokens.groupBy(F.col(by).alias("qs_by")).agg(*[F.sum(v).cast("bigint").alias(k) for k, v in columns.items()])
    both = sums.join(counts, sums[by].eqNullSafe(counts["qs_by"]), "left")
    return both.select(by, "n_words", "n_chars", *[F.when(F.col("n_texts") > 0, F.coalesce(k, F.lit(0))).alias(k) for k in columns])


def pooled_report(sums: DataFrame, tokens: DataFrame, by: str = "lang") -> DataFrame:
    """corpus_report from text_sums and counts of tokens."""
    out = _with_tokens(sums, tokens, by, n_tokens=F.col("n")).select(by, "n_tokens", "n_words", "n_chars")
    return out.withColumn("fertility", ratio(F.col("n_tokens"), F.col("n_words"))).withColumn("compression", ratio(F.col("n_tokens"), F.col("n_chars")))


def pooled_coverage(sums: DataFrame, tokens: DataFrame, by: str = "lang") -> DataFrame:
    """coverage from text_sums and counts of tokens."""
    c, plain = F.col, ~F.col("token").contains("<0x")
    all_ = _with_tokens(sums, tokens, by, num_tokens=c("n"), plain=F.when(plain, c("n")).otherwise(0), plain_chars=F.when(plain, c("n") * F.length(F.replace("token", F.lit(SPACER), F.lit("")))).otherwise(0))
    return all_.select(by, ratio(c("num_tokens"), c("n_words")).alias("fertility"), ratio(c("num_tokens") - c("plain"), c("num_tokens")).alias("fallback_rate"), ratio(c("plain_chars"), c("n_chars")).alias("char_coverage"), ratio(c("plain_chars"), c("plain")).alias("avg_token_length"), "num_tokens", c("n_words").alias("num_words"))


def mean_compression(encoded: DataFrame, by: Sequence[str] = ("lang",), n_tokens: Column | None = None) -> DataFrame:
    """Mean over texts of tokens for each character. n_tokens: of each text, where there are no tokens."""
    return encoded.groupBy(*by).agg(F.avg(ratio(F.size("tokens") if n_tokens is None else n_tokens, F.length("text"))).alias("mean_compression"))


def coverage(encoded: DataFrame, by: Sequence[str] = ("lang",)) -> DataFrame:
    """fertility, fallback_rate (tokens with byte tokens), char_coverage, avg_token_length (without the spacer) and counts."""
    bare = F.transform(F.filter("tokens", lambda t: ~t.contains("<0x")), lambda t: F.length(F.replace(t, F.lit(SPACER), F.lit(""))))
    rows = encoded.select(*by, F.size("tokens").alias("t"), word_count(F.col("text")).alias("w"), F.length("text").alias("c"), F.size(bare).alias("plain"), F.aggregate(bare, F.lit(0), lambda s, x: s + x).alias("plain_chars"))
    sums = rows.groupBy(*by).agg(*[F.sum(x).cast("bigint").alias(y) for x, y in (("t", "num_tokens"), ("w", "num_words"), ("c", "num_chars"), ("plain", "plain"), ("plain_chars", "plain_chars"))])
    c = F.col
    return sums.select(*by, ratio(c("num_tokens"), c("num_words")).alias("fertility"), ratio(c("num_tokens") - c("plain"), c("num_tokens")).alias("fallback_rate"), ratio(c("plain_chars"), c("num_chars")).alias("char_coverage"), ratio(c("plain_chars"), c("plain")).alias("avg_token_length"), "num_tokens", "num_words")


def gini(values: DataFrame, column: str) -> DataFrame:
    """One row: 0 for all alike, toward 1 for all in one. Meant for a row a language; the window over all rows sorts in one task."""
    ranked = values.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x")).withColumn("i", F.row_number().over(Window.orderBy("x")))
    n, total = F.count("*"), F.sum("x")
    return ranked.agg(F.coalesce(F.when((n > 1) & (total != 0), 2 * F.sum(F.col("i") * F.col("x")) / (n * total) - (n + 1) / n), F.lit(0.0)).alias("gini"))


def _ranked(values: DataFrame, column: str) -> DataFrame:
    by = Window.orderBy("x")
    ranked = values.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    return ranked.withColumn("i", F.row_number().over(by)).withColumn("upto", F.sum("x").over(by.rowsBetween(Window.unboundedPreceding, 0)))


def gini_forms(values: DataFrame, column: str) -> DataFrame:
    """One row with three ways to write the same index: by rank (as gini), by centred rank, and by the curve of running sums. Equal for positive values; 0 for fewer than two values or where all are 0."""
    n, total = F.count("*"), F.sum("x")
    i, x = F.col("i"), F.col("x")
    some = (n > 1) & (total != 0)
    centred = F.abs(2 * F.sum(i * x) - (n + 1) * total) / (n * total)
    curve = (n + 1 - 2 * F.sum("upto") / total) / n
    forms = {"by_rank": 2 * F.sum(i * x) / (n * total) - (n + 1) / n, "by_centred_rank": centred, "by_curve": curve}
    return _ranked(values, column).agg(*[F.coalesce(F.when(some, v), F.lit(0.0)).alias(k) for k, v in forms.items()])


def fairness_summary(values: DataFrame, column: str = "fertility") -> DataFrame:
    """One row: gini, cv, max_min_ratio, max_median_ratio, mean, std (of the population), median, min, max. Ratios to 0 are infinite."""
    x = F.col(column)
    one = values.agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.median(x).alias("median"), F.min(x).alias("min"), F.max(x).alias("max"))
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).when(F.col(b).isNotNull(), F.lit(float("inf")))
    cv = F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(0.0)
    return one.crossJoin(gini(values, column)).select("gini", cv.alias("cv"), over("max", "min").alias("max_min_ratio"), over("max", "median").alias("max_median_ratio"), "mean", "std", "median", "min", "max")


def fairness_report(values: DataFrame, column: str = "fertility") -> DataFrame:
    """values with flag (ok below 1.2 medians, high below 1.5, else very high) and verdict (FAIR for a gini below 0.2)."""
    summary = fairness_summary(values, column).select("gini", "median")
    x, m = F.col(column), F.col("median")
    flag = F.when(x < 1.2 * m, "ok").when(x < 1.5 * m, "high").otherwise("very high")
    return values.crossJoin(F.broadcast(summary)).select(*values.columns, flag.alias("flag"), F.when(F.col("gini") < 0.2, "FAIR").otherwise("BIASED").alias("verdict"))


def relative_cost(report: DataFrame, baseline: str = "en", key: str = "lang") -> DataFrame:
    """Fertility and tokens of each language over those of a baseline language; null without the baseline."""
    base = report.filter(F.col(key) == baseline).agg(F.max("fertility").alias("f0"), F.max("n_tokens").alias("t0"))
    return report.crossJoin(F.broadcast(base)).select(key, "fertility", F.col("n_tokens"), (F.col("fertility") / F.col("f0")).alias("fertility_ratio"), (F.col("n_tokens") / F.col("t0")).alias("token_ratio"))


def fairness_gap(values: DataFrame, column: str = "fertility") -> DataFrame:
    """One row: min over max, max over min, and max less min."""
    one = values.agg(F.min(column).alias("a"), F.max(column).alias("b"))
    return one.select((F.col("a") / F.col("b")).alias("fairness_ratio"), (F.col("b") / F.col("a")).alias("efficiency_gap"), (F.col("b") - F.col("a")).alias("fertility_gap"))


def char_entropy(texts: DataFrame, by: Sequence[str] = ("lang",)) -> DataFrame:
    """Bits a character, from the shares of characters."""
    chars = texts.filter("text IS NOT NULL").select(*by, F.explode(code_points(F.col("text"))).alias("c")).filter("c <> ''")
    counts = chars.groupBy(*by, "c").agg(F.count("*").alias("n"))
    total = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    shares = counts.withColumn("p", F.col("n") / F.sum("n").over(total))
    return shares.groupBy(*by).agg((-F.sum(F.col("p") * F.log2("p"))).alias("char_entropy"))


def info_per_token(encoded: DataFrame, by: Sequence[str] = ("lang",), report: DataFrame | None = None) -> DataFrame:
    """char_entropy, fertility and the first over the second. report: that of the texts, where they have no tokens."""
    both = (corpus_report(encoded, by) if report is None else report).select(*by, "fertility").join(char_entropy(encoded, by), list(by))
    return both.select(*by, "char_entropy", "fertility", ratio(F.col("char_entropy"), F.col("fertility")).alias("info_per_token"))


def spread(values: DataFrame, columns: Sequence[str]) -> DataFrame:
    """metric, gap, variance (of the population) and cv of each column, one row each."""
    rows = values.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x")) for c in columns])).alias("r")).select("r.*")
    return rows.groupBy("metric").agg((F.max("x") - F.min("x")).alias("gap"), F.var_pop("x").alias("variance"), ratio(F.stddev_pop("x"), F.avg("x")).alias("cv"))


def token_rows(encoded: DataFrame, *columns: str) -> DataFrame:
    """columns, pos and token: a row for each token."""
    return encoded.select(*columns, F.posexplode("tokens").alias("pos", "token"))


def operator_preservation(encoded: DataFrame, by: Sequence[str] = (), operators: Sequence[str] = OPERATORS) -> DataFrame:
    """Tokens that are an operator over tokens that hold one; 1 where none does."""
    holds = F.greatest(*[F.col("token").contains(o) for o in operators])
    sums = token_rows(encoded, *by).groupBy(*by).agg(F.count_if(F.col("token").isin(*operators)).alias("whole"), F.count_if(holds).alias("holding"))
    return sums.withColumn("preservation", F.when(F.col("holding") > 0, F.col("whole") / F.col("holding")).otherwise(1.0))


def keyword_preservation(encoded: DataFrame, by: Sequence[str] = (), keywords: Sequence[str] = KEYWORDS) -> DataFrame:
    """constant_rate is 1.0, as always; rate: tokens that are a keyword (spacers aside) over words of the texts that are one."""
    kept = token_rows(encoded, *by).groupBy(*by).agg(F.count_if(F.replace(F.col("token"), F.lit(SPACER), F.lit("")).isin(*keywords)).alias("as_tokens"))
    there = encoded.select(*by, F.explode(words(F.col("text"))).alias("word")).groupBy(*by).agg(F.count_if(F.col("word").isin(*keywords)).alias("as_words"))
    both = kept.join(there, list(by)) if by else kept.crossJoin(there)
    return both.select(*by, "as_tokens", "as_words", F.lit(1.0).alias("constant_rate"), F.when(F.col("as_words") > 0, F.col("as_tokens") / F.col("as_words")).otherwise(1.0).alias("rate"))


def presence(encoded: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row: how many of the names occur as whole tokens, and their share."""
    found = token_rows(encoded).filter(F.col("token").isin(*names)).agg(F.count_distinct("token").alias("n_present"))
    return found.withColumn("rate", F.col("n_present") / F.lit(len(names)))


def vocab_size_estimate(texts: DataFrame) -> DataFrame:
    """One row: 1.5 times the distinct words, between 300 and 2000."""
    n = texts.select(F.explode(words(F.col("text"))).alias("w")).agg(F.count_distinct("w").alias("n_distinct"))
    return n.withColumn("vocab_size", F.greatest(F.lit(300), F.least(F.lit(2000), F.floor(F.col("n_distinct") * 1.5))).cast("bigint"))


def token_stats(encoded: DataFrame) -> DataFrame:
    """One row about all tokens; no row where there is none."""
    t = token_rows(encoded).select("token", F.octet_length("token").alias("b"), F.length("token").alias("c"))
    return t.agg(F.count("*").alias("total_tokens"), F.count_distinct("token").alias("unique_tokens"), F.avg("b").alias("avg_bytes"), F.median("b").alias("median_bytes"), F.max("b").cast("bigint").alias("max_bytes"), F.min("b").cast("bigint").alias("min_bytes"), F.avg("c").alias("avg_chars")).filter("total_tokens > 0")


def stats_of_counts(tokens: DataFrame) -> DataFrame:
    """token_stats from tokens(token, n)."""
    n, b = F.col("n"), F.octet_length("token")
    mean = lambda x: F.sum(n * x) / F.sum(n)
    return tokens.agg(F.sum(n).alias("total_tokens"), F.count_distinct("token").alias("unique_tokens"), mean(b).alias("avg_bytes"), F.percentile(b, F.lit(0.5), n).alias("median_bytes"), F.max(b).cast("bigint").alias("max_bytes"), F.min(b).cast("bigint").alias("min_bytes"), mean(F.length("token")).alias("avg_chars")).filter("total_tokens > 0")


def top_of_counts(tokens: DataFrame, k: int = 10) -> DataFrame:
    """top_tokens from tokens(token, n, first)."""
    return tokens.groupBy("token").agg(F.sum("n").alias("n"), F.min("first").alias("first")).orderBy(F.desc("n"), "first").limit(k).select("token", "n")


def top_tokens(encoded: DataFrame, k: int = 10) -> DataFrame:
    """The k commonest tokens; of equal ones those met first."""
    counts = token_rows(encoded, "doc_id").groupBy("token").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(k).select("token", "n")


def token_class(token: Column) -> Column:
    """keyword, operator, literal, identifier or other, the first that fits."""
    bare = F.replace(token, F.lit(SPACER), F.lit(""))
    keyword = F.regexp_replace(token, f"^[{SPACER} ]+|[{SPACER} ]+$", "").isin(*CLASS_KEYWORDS)
    return F.when(keyword, "keyword").when(F.trim(token).isin(*CLASS_OPERATORS), "operator").when(token.rlike("^[\"']") | token.rlike(r"^\p{Nd}+$"), "literal").when(bare.rlike(r"^[\p{L}_][\p{L}\p{N}\p{M}_]*$"), "identifier").otherwise("other")


def vocab_utilization(encoded: DataFrame, vocab_size: int) -> DataFrame:
    """One row: distinct tokens in use, and percent of the vocabulary."""
    return token_rows(encoded).agg(F.count_distinct("token").alias("used")).withColumn("percent", F.col("used") * 100.0 / F.lit(vocab_size))


def ngram_top(tokens: DataFrame, n: int = 1, k: int = 100) -> DataFrame:
    """The k commonest tokens (n=1) or pairs of neighbours (n=2) of rows (doc_id, tokens); ties by text."""
    rows = token_rows(tokens, "doc_id")
    if n == 2:
        rows = bigrams(tokens).withColumn("token", F.concat_ws("||", "left", "right"))
    return rows.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(k)


def bigrams(tokens: DataFrame) -> DataFrame:
    """left and right: every pair of neighbours, without a shuffle."""
    pair = F.transform(F.sequence(F.lit(1), F.size("tokens") - 1), lambda i: F.struct(F.element_at("tokens", i).alias("left"), F.element_at("tokens", i + 1).alias("right")))
    return tokens.filter(F.size("tokens") > 1).select(F.explode(pair).alias("p")).select("p.*")


def pmi(tokens: DataFrame) -> DataFrame:
    """left, right, n and pmi (bits) of pairs of neighbours, from their share of pairs and their tokens' shares of tokens. Pairs and tokens are counted once, and stored."""
    pairs = stored(bigrams(tokens).groupBy("left", "right").agg(F.count("*").alias("n")), "pairs")
    single = stored(token_rows(tokens).groupBy("token").agg(F.count("*").alias("u")), "tokens")
    n_pairs, n_tokens = (float(df.agg(F.sum(c)).first()[0] or 0) for df, c in ((pairs, "n"), (single, "u")))
    joined = pairs.join(single.select(F.col("token").alias("left"), F.col("u").alias("ul")), "left").join(single.select(F.col("token").alias("right"), F.col("u").alias("ur")), "right")
    d = lambda c: F.col(c).cast("double")
    return joined.select("left", "right", "n", F.log2(d("n") / n_pairs / (d("ul") / n_tokens * (d("ur") / n_tokens))).alias("pmi"))


def branching_entropy(tokens: DataFrame) -> DataFrame:
    """token, and the entropy (bits) of what follows it and of what comes before."""
    pairs = stored(bigrams(tokens).groupBy("left", "right").agg(F.count("*").alias("n")), "pairs")

    def side(key: str, name: str) -> DataFrame:
        sums = pairs.groupBy(key).agg(F.sum("n").alias("all"))
        p = F.col("n") / F.col("all")
        return pairs.join(sums, key).groupBy(F.col(key).alias("token")).agg((-F.sum(p * F.log2(p))).alias(name))

    return side("left", "right_entropy").join(side("right", "left_entropy"), "token", "full")


def parity(ours: DataFrame, theirs: DataFrame, by: Sequence[str] = (), seconds: tuple[float, float] | None = None) -> DataFrame:
    """Two tokenisers over the same rows (doc_id, n_tokens, n_chars): mean and maximum percent of difference in tokens, and in compression. seconds, what each took: also speed_ratio, theirs over ours."""
    both = ours.select(*by, "doc_id", F.col("n_tokens").alias("a"), "n_chars").join(theirs.select(*by, "doc_id", F.col("n_tokens").alias("b")), [*by, "doc_id"])
    apart = F.when(F.col("b") == 0, 0.0).otherwise(F.abs(F.col("a") - F.col("b")) * 100.0 / F.col("b"))
    return both.groupBy(*by).agg(F.avg(apart).alias("mean_token_diff"), F.max(apart).alias("max_token_diff"), (F.abs(F.sum("a") - F.sum("b")) / F.sum("n_chars")).alias("compression_diff"), *([] if seconds is None else [F.lit(seconds[1] / seconds[0]).alias("speed_ratio")]))


def model_summary(results: DataFrame) -> DataFrame:
    """Rows of single files (model, chars, tokens, compression_ratio, time_ms_median) summed up by model, the best compression first."""
    return results.groupBy("model").agg(F.count("*").alias("files"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"), F.avg("compression_ratio").alias("mean_compression"), F.median("compression_ratio").alias("median_compression"), F.avg("time_ms_median").alias("mean_ms"), F.median("time_ms_median").alias("median_ms")).orderBy("mean_compression", "model")


def winners(results: DataFrame, lower: Sequence[str], higher: Sequence[str], name: str = "model") -> DataFrame:
    """metric, winner and value: the least of the metrics where lower is better, else the greatest; ties by name."""
    struct = lambda c: F.struct(F.col(c).cast("double").alias("v"), F.col(name).alias("who"))
    best = [F.struct(F.lit(c).alias("metric"), F.min(struct(c)).alias("b")) for c in lower]
    rows = results.agg(F.array(*best).alias("r")).select(F.explode("r").alias("r")) if best else None
    for c in higher:
        top = results.agg(F.max(F.col(c).cast("double")).alias("v"))
        one = results.crossJoin(top).filter(F.col(c).cast("double") == F.col("v")).agg(F.struct(F.lit(c).alias("metric"), F.struct(F.max("v").alias("v"), F.min(name).alias("who")).alias("b")).alias("r"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.select("r.metric", F.col("r.b.who").alias("winner"), F.col("r.b.v").alias("value"))
