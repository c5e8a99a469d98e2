"""Smoothed log-probabilities of states by context, over a table of counts.

Counts are a DataFrame with columns context, state and n. Each method adds
logprob and p0 (the log-probability of a state that a context has not seen).
Sums over a context are windows over the counts, which a context's states
bound; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def _total() -> Column:
    return F.sum("n").over(Window.partitionBy("context"))


def _kinds() -> Column:
    return F.count("*").over(Window.partitionBy("context"))


def _with(df: DataFrame, p: Column, p0: Column) -> DataFrame:
    log = lambda x: F.when(x > 0, F.log(x)).otherwise(F.lit(float("-inf")))
    return df.withColumn("logprob", log(p)).withColumn("p0", log(p0))


def uniform(df: DataFrame, unseen: float = 0.0) -> DataFrame:
    """The same for every seen state."""
    return _with(df, (1 - F.lit(unseen)) / _kinds(), F.lit(unseen))


def random(df: DataFrame, seed: int = 0, unseen: float = 0.0) -> DataFrame:
    """Shares drawn anew for every state of a context, whatever its count; a seed gives the same shares again."""
    draw = (F.pmod(F.xxhash64(F.lit(seed), "context", "state"), F.lit(2**53)) + 1) / F.lit(float(2**53))
    return _with(df, draw / F.sum(draw).over(Window.partitionBy("context")) * (1 - F.lit(unseen)), F.lit(unseen))


def mle(df: DataFrame, unseen: float = 0.0) -> DataFrame:
    """Relative frequency, less the mass kept for unseen states."""
    return _with(df, F.col("n") / _total() * (1 - F.lit(unseen)), F.lit(unseen))


def lidstone(df: DataFrame, gamma: float, bins: Column | int) -> DataFrame:
    """gamma added to each of bins counts."""
    whole = _total() + (bins if isinstance(bins, Column) else F.lit(bins)) * gamma
    return _with(df, (F.col("n") + gamma) / whole, F.lit(gamma) / whole)


def laplace(df: DataFrame, bins: Column | int) -> DataFrame:
    return lidstone(df, 1.0, bins)


def ele(df: DataFrame, bins: Column | int) -> DataFrame:
    """Expected likelihood: half a count added."""
    return lidstone(df, 0.5, bins)


def wittenbell(df: DataFrame, bins: int) -> DataFrame:
    """n / (N + T) with T kinds seen; the rest is shared by the unseen bins (one at least)."""
    unseen = F.greatest(F.lit(bins) - _kinds(), F.lit(1))
    return _with(df, F.col("n") / (_total() + _kinds()), _kinds() / (unseen * (_total() + _kinds())))


def certainty_degree(df: DataFrame, bins: int, unseen: float = 0.0) -> DataFrame:
    """Relative frequency times the degree of certainty 1 - (kinds / (bins + 1)) ^ N, at most 1 - unseen."""
    certain = F.least(1 - F.pow(_kinds() / (bins + 1.0), _total()), F.lit(1 - unseen))
    return _with(df, F.col("n") / _total() * certain, 1 - certain)


def simple_good_turing(df: DataFrame, unseen: float = 0.0, confidence: float = 0.95) -> DataFrame:
    """Simple Good-Turing (Gale and Sampson, 1995) within each context.

    Counts of counts are averaged over the gaps around them, a line through
    their logarithms gives the smoothed ones, and the plain estimate holds up
    to the first count at which it is within the confidence width of the line.
    """
    z = NormalDist().inv_cdf(1 - (1 - confidence) / 2)
    freq = df.groupBy("context", F.col("n").alias("r")).agg(F.count("*").alias("nr"))
    order = Window.partitionBy("context").orderBy("r")
    freq = freq.withColumn("low", F.coalesce(F.lag("r").over(order), F.lit(0))).withColumn("high", F.lead("r").over(order))
    freq = freq.withColumn("z", F.when(F.col("high").isNull(), F.col("nr") / (F.col("r") - F.col("low"))).otherwise(2.0 * F.col("nr") / (F.col("high") - F.col("low"))))
    line = freq.groupBy("context").agg(F.regr_slope(F.log("z"), F.log("r")).alias("slope"), F.regr_intercept(F.log("z"), F.log("r")).alias("at"))
    joined = freq.join(line, "context")
    smooth = lambda r: F.exp(F.coalesce("at", F.log("z")) + F.coalesce("slope", F.lit(-1.0)) * F.log(r))
    next_nr = F.when(F.col("high") == F.col("r") + 1, F.lead("nr").over(order))
    y = (F.col("r") + 1) * smooth(F.col("r") + 1) / smooth(F.col("r"))
    x = (F.col("r") + 1) * next_nr / F.col("nr")
    width = z * F.sqrt((F.col("r") + 1) * (F.col("r") + 1) * next_nr / (F.col("nr") * F.col("nr")) * (1 + next_nr / F.col("nr")))
    marked = joined.select("context", "r", "nr", x.alias("x"), y.alias("y"), F.coalesce((F.abs(x - y) <= width), F.lit(True)).alias("settled"))
    so_far = Window.partitionBy("context").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("star", F.when(F.max(F.col("settled").cast("int")).over(so_far) == 1, F.col("y")).otherwise(F.col("x")))
    whole = Window.partitionBy("context")
    total = F.sum(F.col("r") * F.col("nr")).over(whole)
    ones = F.coalesce(F.max(F.when(F.col("r") == 1, F.col("nr"))).over(whole), F.lit(0))
    p0 = F.when(ones > 0, ones / total).otherwise(F.lit(unseen))
    norm = F.sum(F.col("star") * F.col("nr")).over(whole)
    probs = marked.select("context", "r", ((1 - p0) * F.col("star") / norm).alias("p"), p0.alias("rest"))
    found = df.join(probs.withColumnRenamed("r", "n"), ["context", "n"]).select(*df.columns, "p", "rest")
    return _with(found, F.col("p"), F.col("rest")).drop("p", "rest")


METHODS: dict[str, Callable[..., DataFrame]] = {
    "uniform": uniform,
    "random": random,
    "mle": mle,
    "lidstone": lidstone,
    "laplace": laplace,
    "ele": ele,
    "wittenbell": wittenbell,
    "certaintydegree": certainty_degree,
    "sgt": simple_good_turing,
}


def smooth(df: DataFrame, method: str, **options) -> DataFrame:
    """Counts with logprob and p0 by the named method."""
    return METHODS[method](df, **options)


def model_entropy(smoothed: DataFrame) -> DataFrame:
    """Minus the sum of p log2 p over all contexts and states (one row)."""
    return smoothed.agg((-F.sum(F.exp("logprob") * F.col("logprob") / F.log(F.lit(2.0)))).alias("entropy"))


def score_sequences(positions: DataFrame, smoothed: DataFrame) -> DataFrame:
    """id, score, entropy and perplexity of sequences; positions: id, context, state for every segment.

    A state that its context has not seen has the context's p0; a context that
    is not in the model leaves the segment out of the score.
    """
    backing = smoothed.groupBy("context").agg(F.max("p0").alias("__p0"))
    joined = positions.join(smoothed.select("context", "state", "logprob"), ["context", "state"], "left").join(backing, "context", "left")
    per = joined.groupBy("id").agg(F.sum(F.coalesce("logprob", "__p0")).alias("score"), F.count("*").alias("length"))
    entropy = -F.col("score") / F.log(F.lit(2.0)) / F.col("length")
    return per.select("id", "score", entropy.alias("entropy"), F.pow(F.lit(2.0), entropy).alias("perplexity"))
