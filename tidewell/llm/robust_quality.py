"""Quality rules: base rules, and robust multivariate outliers per language and source.

Each text becomes a vector of transformed statistics: ln words, ln mean word length (shrunk towards PRIOR_LENGTH by
PRIOR_WORDS words, so that ten words can't look odd), root of symbols per word and root of repeated words per word.
The minimum-covariance-determinant estimate of a group has one start, its medians and quartiles, and takes C-steps: the
half of the group with the smallest Mahalanobis distances gives the next mean and covariance. The steps end when no half
sample changes any more, or after MOST_STEPS. Then the estimate is made anew from all rows within REWEIGHT. Rows beyond
CUTOFF are rejected. Variances have floors, as most texts have no symbols and no repeats at all.

Groups are all documents, each language, and each language and source. Every document is judged by the estimate of its
language and source, whatever its size: mean and covariance are drawn towards those of the language as if PRIOR_ROWS of
its documents belonged to the group, and the language's towards those of all documents. So a source of one document is
judged by its language, one of thousands by itself, and no number of documents switches from one to the other.

Everything is DataFrame functions: order statistics come from counts per fixed bin, moments from exact integer sums
(fixed-point statistics), so groups of any size are pre-aggregated and a rerun gives the same bits. Up to 10,000 groups'
estimates (30 numbers each) are broadcast; beyond that, the rows of a large group meet its estimate in parts dealt over tasks.

Defined results: null or empty text has no words, fails the base rules and isn't kept; null lang or source is a group of
its own; rows that repeat count as often as they occur; an empty table gives no rows; where no document passes the base
rules there is no estimate and nothing to keep; other columns of docs may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime

SCALE = 10_000
PRIOR_WORDS, PRIOR_LENGTH = 50, 5.5
#: Least standard deviation of each statistic.
FLOORS = (0.5, 0.08, 0.06, 0.15)
#: Documents of the language (of all documents) that count beside the own ones of a source (a language).
PRIOR_ROWS = 50.0
MOST_STEPS = 8
#: Squared distances: the 0.999 quantile of chi-square with 4 degrees of freedom; six standard deviations.
REWEIGHT, CUTOFF = 18.47, 36.0
#: A half sample's covariance is this much too small in 4 dimensions.
HALF = 2.1
_P = len(FLOORS)
_PAIRS = [(i, j) for i in range(_P) for j in range(i, _P)]
_SPACE = " \t\n\x0b\f\r"
_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_statistics(docs: DataFrame, *keep: str, fence: bool = False) -> DataFrame:
    """keep columns and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of docs.text.

    fence adds a column __fence: a filter that uses it stays above the statistics, where the optimizer would else copy
    their expressions into the filter, once for each use.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(_SPACE))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1))
    rows = docs.select(
        *keep,
        words.alias("__w"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
    )
    # a window's hash is that of its words' hashes: each word is hashed once
    rows = rows.select(*keep, F.size("__w").alias("__n"), F.length(F.array_join("__w", "")).cast("long").alias("word_chars"), *_BASE[2:4], F.transform("__w", lambda x: F.xxhash64(x)).alias("__x"))
    five = lambda x, i: F.xxhash64(x, *(F.get("__x", i + k) for k in range(1, 5)))
    windows = F.transform(F.slice("__x", 1, F.greatest(F.col("__n") - 4, F.lit(0))), five)
    rows = rows.select(*keep, F.col("__n").cast("long").alias("n_words"), *_BASE[1:4], windows.alias("__h"))
    # only texts in which some window comes back are looked at further: by sorting, never by comparing all windows
    again = F.size(F.array_distinct("__h")) < F.size("__h")
    placed = F.when(again, F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.select(*keep, *_BASE[:4], placed.alias("__s"))
    last = F.size("__s") - 1
    same = F.filter("__s", lambda e, k: ((k > 0) & (F.get("__s", k - 1)["h"] == e["h"])) | ((k < last) & (F.get("__s", k + 1)["h"] == e["h"])))
    rows = rows.select(*keep, *_BASE[:4], F.array_sort(F.transform(same, lambda e: e["i"])).alias("__p"))
    start = F.struct(F.lit(0).alias("n"), F.lit(-5).alias("at"))
    covered = F.aggregate("__p", start, lambda a, p: F.struct((a["n"] + F.least(F.lit(5), p - a["at"])).alias("n"), p.alias("at")), lambda a: a["n"])
    more = [F.monotonically_increasing_id().alias("__fence")] if fence else []
    return rows.select(*keep, *_BASE[:4], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), *more)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _vector(rows: DataFrame) -> DataFrame:
    """Adds the statistics as fixed-point longs, x0 to x3."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    x = (F.ln(n), F.ln((F.col("word_chars") + PRIOR_WORDS * PRIOR_LENGTH) / (n + PRIOR_WORDS)), F.sqrt(F.col("n_symbols") / n), F.sqrt(F.col("n_repeat_words") / n))
    return rows.withColumns({f"x{i}": F.round(v * SCALE).cast("long") for i, v in enumerate(x)})


def _keys() -> list[Column]:
    """The groups of a row: all documents, its language, its language and source."""
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    return [F.lit("a"), F.concat(F.lit("l"), named("lang")), F.concat(F.lit("s"), F.concat_ws("\n", named("lang"), named("source")))]


def _order_statistic(counts: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """First bins at which the cumulative count of a key reaches the shares; counts: keys, bin, n with a bounded number of bins."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    run = counts.withColumns({"upto": F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(w)})
    return run.groupBy(*keys).agg(*(F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * s), F.col("bin"))).alias(name) for name, s in shares.items()))


def _inverse(c: dict[tuple[int, int], Column]) -> dict[tuple[int, int], Column]:
    """Inverse of a symmetric 4 x 4 matrix by its 2 x 2 minors."""
    a = lambda i, j: c[min(i, j), max(i, j)]
    m = lambda i, j, k, n: a(i, k) * a(j, n) - a(i, n) * a(j, k)
    s = [m(0, 1, *p) for p in ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))]
    t = [m(2, 3, *p) for p in ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))]
    det = s[0] * t[5] - s[1] * t[4] + s[2] * t[3] + s[3] * t[2] - s[4] * t[1] + s[5] * t[0]
    out = {
        (0, 0): a(1, 1) * t[5] - a(1, 2) * t[4] + a(1, 3) * t[3],
        (0, 1): -a(0, 1) * t[5] + a(0, 2) * t[4] - a(0, 3) * t[3],
        (0, 2): a(3, 1) * s[5] - a(3, 2) * s[4] + a(3, 3) * s[3],
        (0, 3): -a(2, 1) * s[5] + a(2, 2) * s[4] - a(2, 3) * s[3],
        (1, 1): a(0, 0) * t[5] - a(0, 2) * t[2] + a(0, 3) * t[1],
        (1, 2): -a(3, 0) * s[5] + a(3, 2) * s[2] - a(3, 3) * s[1],
        (1, 3): a(2, 0) * s[5] - a(2, 2) * s[2] + a(2, 3) * s[1],
        (2, 2): a(3, 0) * s[4] - a(3, 1) * s[2] + a(3, 3) * s[0],
        (2, 3): -a(2, 0) * s[4] + a(2, 1) * s[2] - a(2, 3) * s[0],
        (3, 3): a(2, 0) * s[3] - a(2, 1) * s[1] + a(2, 2) * s[0],
    }
    return {k: v / det for k, v in out.items()}


def _distance() -> Column:
    """Squared Mahalanobis distance of x0..x3 from m0..m3 under the inverse covariance v00..v33."""
    d = [F.col(f"x{i}") / SCALE - F.col(f"m{i}") for i in range(_P)]
    return sum(((1 if i == j else 2) * d[i] * d[j] * F.col(f"v{i}{j}") for i, j in _PAIRS), F.lit(0.0))


def _moments(rows: DataFrame, factor: float) -> DataFrame:
    exact = lambda c: F.sum(c.cast("decimal(38,0)")).cast("double")
    sums = rows.groupBy("key").agg(F.count("*").alias("n"), *(exact(F.col(f"x{i}")).alias(f"s{i}") for i in range(_P)), *(exact(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in _PAIRS))
    mean = sums.select("key", "n", *(F.col(f"s{i}{j}") for i, j in _PAIRS), *((F.col(f"s{i}") / F.col("n") / SCALE).alias(f"m{i}") for i in range(_P)))
    cov = {}
    for i, j in _PAIRS:
        c = F.col(f"s{i}{j}") / F.col("n") / (SCALE * SCALE) - F.col(f"m{i}") * F.col(f"m{j}")
        cov[i, j] = c * factor if i != j else F.greatest(c * factor, F.lit(0.0)) + F.lit(FLOORS[i] ** 2 / 4)
    held = mean.select("key", "n", *(f"m{i}" for i in range(_P)), *(cov[i, j].alias(f"c{i}{j}") for i, j in _PAIRS))
    # a floor is reached by adding what is missing, so the matrix stays positive definite
    return held.withColumns({f"c{i}{i}": F.greatest(F.col(f"c{i}{i}"), F.lit(FLOORS[i] ** 2)) for i in range(_P)})


def _inverted(est: DataFrame) -> DataFrame:
    """The estimate with the inverse covariance v00 to v33 in place of the covariance."""
    inv = _inverse({(i, j): F.col(f"c{i}{j}") for i, j in _PAIRS})
    return est.withColumns({f"v{i}{j}": inv[i, j] for i, j in _PAIRS}).drop(*(f"c{i}{j}" for i, j in _PAIRS))


def _start(rows: DataFrame) -> DataFrame:
    """Medians and quartiles of each statistic, to a hundredth, from counts per bin."""
    each = rows.select("key", F.explode(F.array(*(F.struct(F.lit(i).alias("dim"), F.floor(F.least(F.col(f"x{i}"), F.lit(40 * SCALE)) / 100).alias("bin")) for i in range(_P)))).alias("e")).select("key", "e.dim", "e.bin")
    q = _order_statistic(each.groupBy("key", "dim", "bin").agg(F.count("*").alias("n")), ["key", "dim"], {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    pick = lambda i, c: F.max(F.when(F.col("dim") == i, c))
    cols = []
    for i in range(_P):
        sd = F.greatest((F.col("q3") - F.col("q1")) / 100 / 1.349, F.lit(FLOORS[i]))
        cols += [pick(i, (F.col("q2") + 0.5) / 100).alias(f"m{i}"), pick(i, 1 / (sd * sd)).alias(f"v{i}{i}")]
    out = q.groupBy("key").agg(*cols)
    return out.withColumns({f"v{i}{j}": F.lit(0.0) for i, j in _PAIRS if i != j})


def fit(stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a table of statistics (not of texts): the groups' estimates (place, m0 to m3, v00 to v33), and their sizes (place, n), both stored."""
    sizes = runtime.cut(stats.groupBy(*(k.alias(f"k{i}") for i, k in enumerate(_keys()))).agg(F.count("*").alias("n")), "groups")
    each = F.explode(F.array(*_keys())).alias("key")
    rows = runtime.cut(_vector(stats.where(~base_failed())).select(each, *(f"x{i}" for i in range(_P))), "vectors")
    weights = runtime.cut(rows.groupBy("key").agg(F.count("*").alias("n")), "weights")
    beside = lambda est: runtime.beside(rows, est, ["key"], weights, "x0")
    est, state = runtime.cut(_start(rows), "estimate"), None
    for _ in range(MOST_STEPS):
        d = beside(est).withColumn("bin", F.least(F.floor(F.ln(1 + _distance()) * 200), F.lit(8191)))
        half = _order_statistic(d.groupBy("key", "bin").agg(F.count("*").alias("n")), ["key"], {"edge": 0.5})
        near = beside(est.join(half, "key")).withColumn("bin", F.least(F.floor(F.ln(1 + _distance()) * 200), F.lit(8191))).where("bin <= edge")
        after = runtime.cut(_inverted(_moments(near, HALF)).drop("n"), "estimate")
        runtime.drop(est)
        est, before = after, state
        # exact sums give equal bits for equal half samples
        state = est.agg(F.sum(F.xxhash64("key", *(f"m{i}" for i in range(_P)), *(f"v{i}{j}" for i, j in _PAIRS)).cast("decimal(38,0)"))).first()[0]
        if state == before:
            break
    own = runtime.cut(_moments(beside(est).where(_distance() <= REWEIGHT), 1.0), "moments")
    numbers = [f"m{i}" for i in range(_P)] + [f"c{i}{j}" for i, j in _PAIRS]
    out = sizes.select("k0", "k1", F.col("k2").alias("place"))
    for level, key in enumerate(("k0", "k1", "place")):
        # three tables of one row per group
        out = out.join(own.select(F.col("key").alias("__key"), *(F.col(c).alias(f"o_{c}") for c in ["n", *numbers])), F.col(key) == F.col("__key"), "left").drop("__key")
        weight = F.coalesce(F.col("o_n"), F.lit(0)) / (F.coalesce(F.col("o_n"), F.lit(0)) + PRIOR_ROWS) if level else F.lit(1.0)
        drawn = {c: F.when(F.col("o_n").isNull(), F.col(c)).otherwise(weight * F.col(f"o_{c}") + (1 - weight) * F.col(c)) if level else F.col(f"o_{c}") for c in numbers}
        out = out.withColumns(drawn).drop("o_n", *(f"o_{c}" for c in numbers))
    out = runtime.cut(_inverted(out).drop("k0", "k1"), "estimate")
    for t in (rows, weights, est, own):
        runtime.drop(t)
    return out, sizes.select(F.col("k2").alias("place"), "n")


def judged(stats: DataFrame) -> DataFrame:
    """stats with base_failed, distance2 (null where there is no estimate) and kept; every row of stats stays."""
    estimate, sizes = fit(stats)
    out = runtime.beside(_vector(stats).withColumn("place", _keys()[2]), estimate, ["place"], sizes, "x0")
    return out.withColumns({"base_failed": base_failed(), "distance2": _distance()}).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance2") <= CUTOFF, F.lit(True)))


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance2 per row of docs."""
    stats = runtime.cut(base_statistics(docs, "doc_id", "lang", "source"), "stats")
    return judged(stats).select(F.col("doc_id").cast("long").alias("doc_id"), *_BASE, "base_failed", "kept", "distance2")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with all their columns.

    Statistics cost many times what storing a text costs, so they are made once and written beside the rows that pass the
    base rules; the estimate reads only the statistics' columns of that table.
    """
    packed = docs.select(F.struct(*docs.columns).alias("__row"), "text", "lang", "source")
    stats = base_statistics(packed, "__row", "lang", "source", fence=True)
    stats = runtime.cut(stats.where(~base_failed() & (F.col("__fence") >= 0)).drop("__fence"), "stats")
    return judged(stats).where("kept").select("__row.*")
