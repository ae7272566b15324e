"""Quality rules: counts of words, symbols and repeats, and robust multivariate outliers among them.

All of it is DataFrame expressions. For each language and source (languages, then everything, stand in
for small groups) a minimum-covariance-determinant estimate of the transformed counts starts from several
robust scatters; each is refined by concentration steps (distances, the share of rows closest to the
centre, their mean and covariance) until its determinant no longer falls, the least determinant is
chosen and the estimate taken again from all rows near it. A document whose Mahalanobis distance from
its group's centre is beyond the cut-off is rejected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, stored, text_or_empty, words_of

SYMBOLS = r"[^#*$%&|<>]+"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Transformed statistics, each with the least standard deviation that it is given credit for.
FEATURES = {"y_length": 0.5, "y_word": 0.1, "y_symbol": 0.01, "y_repeat": 0.1, "y_line": 0.05}
#: Groups up to which their estimates are sent to all tasks.
BROADCAST_GROUPS = 20_000


def chi2_cdf(x: float, k: int) -> float:
    """Lower regularised gamma function, by its series."""
    a, z = k / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while abs(term) > 1e-15 * abs(total):
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return (lo + hi) / 2


def with_text_stats(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns in keep and STATS (longs) for each row.

    Words are runs of other characters than ASCII white space. n_repeat_words counts words that lie in
    a window of three that the text has twice or more. A window's hash and place share a long, so that
    sorting longs brings equal windows together; the words are compared where neighbours agree.
    """
    # Each step's arrays are used more than once in the next, so no step is merged into the other's lambdas.
    kept = [F.col(c) for c in keep]
    one = docs.select(*kept, text_or_empty(text_col).alias("__t"))
    two = one.select(*keep, "__t", words_of(F.col("__t")).alias("__w"), F.split("__t", "\n", -1).alias("__l"))
    n = F.size("__w")
    # The lowest bits hold the place: the mask is 2^k - 1 for the least k with 2^k > n.
    three = two.withColumn("__m", F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n))) - 1)
    at = lambda i: F.get("__w", i.cast("int"))
    windows = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    key = lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)).bitwiseAND(F.bitwise_not("__m")).bitwiseOR(i.cast("long"))
    four = three.withColumn("__s", F.sort_array(F.transform(windows, key)))

    def same(x: Column, y: Column) -> Column:
        i, j = x.bitwiseAND(F.col("__m")), y.bitwiseAND(F.col("__m"))
        alike = x.bitwiseXOR(y).bitwiseAND(F.bitwise_not("__m")) == 0
        return F.coalesce(alike & (at(i) == at(j)) & (at(i + 1) == at(j + 1)) & (at(i + 2) == at(j + 2)), F.lit(False))

    twice = F.filter("__s", lambda x, i: same(x, F.get("__s", i - 1)) | same(x, F.get("__s", i + 1)))
    five = four.withColumn("__p", F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(F.col("__m")))))
    covered = F.aggregate(
        F.transform("__p", lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get("__p", i + 1) - p, F.lit(3).cast("long")))),
        F.lit(0).cast("long"), lambda a, x: a + x,
    )
    worded = F.filter("__l", lambda line: F.btrim(line, F.lit(WHITE)) != "")
    return five.withColumn("__worded", worded).select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__t", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("__worded") - F.size(F.array_distinct("__worded"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )


def _features() -> list[Column]:
    words = F.greatest("n_words", F.lit(1)).cast("double")
    chars = F.greatest("word_chars", F.lit(1)).cast("double")
    return [
        F.log(words).alias("y_length"),
        F.log(chars / words).alias("y_word"),
        (F.col("n_symbols") / chars).alias("y_symbol"),
        (F.col("n_repeat_words") / words).alias("y_repeat"),
        (F.col("n_dup_lines") / words).alias("y_line"),
    ]


def _distance() -> Column:
    """Squared Mahalanobis distance, by forward substitution with the factor's entries l_i_j."""
    names = list(FEATURES)
    solved: list[Column] = []
    for i, name in enumerate(names):
        rest = F.col(name) - F.col(f"c_{i}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}_{j}") * solved[j]
        solved.append(rest / F.col(f"l_{i}_{i}"))
    total = solved[0] * solved[0]
    for z in solved[1:]:
        total = total + z * z
    return total


GROUP = ("level", "a", "b")


def _factor(got: DataFrame, scale: float) -> DataFrame:
    """got with the Cholesky factor l_i_j of the covariances v_i_j, scaled and with the least variances added, in their place, and its log determinant."""
    floors = list(FEATURES.values())
    p = len(floors)
    for i in range(p):  # one column after the other, each from those before it
        for j in range(i + 1):
            v = F.coalesce(F.col(f"v_{i}_{j}"), F.lit(0.0)) * scale + (floors[i] ** 2 if i == j else 0.0)
            for k in range(j):
                v = v - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            got = got.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(v, F.lit(floors[i] ** 2))) if i == j else v / F.col(f"l_{j}_{j}"))
    det = sum((F.log(f"l_{i}_{i}") for i in range(1, p)), F.log("l_0_0"))
    return got.withColumn("det", 2 * det).drop(*[f"v_{i}_{j}" for i in range(p) for j in range(i + 1)])


def _scatter(core: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, the centre c_i and the covariances v_i_j of the features, divided by the number of rows."""
    names = list(FEATURES)
    cells = [F.covar_pop(names[i], names[j]).alias(f"v_{i}_{j}") for i in range(len(names)) for j in range(i + 1)]
    return core.groupBy(*by).agg(*[F.avg(x).alias(f"c_{i}") for i, x in enumerate(names)], *cells)


def _starts(z: DataFrame) -> DataFrame:
    """(start, GROUP, c_i, l_i_j, det): for each group three scatters from its standardised features z_i with centre c_i and scale d_i.

    Start 0 is the scales alone; 1 has the correlations of the features' hyperbolic tangents, 2 those of
    their directions from the centre.
    """
    p = len(FEATURES)
    length = F.sqrt(sum((F.col(f"z_{i}") ** 2 for i in range(1, p)), F.col("z_0") ** 2))
    soft = z.withColumns({f"t_{i}": F.tanh(f"z_{i}") for i in range(p)} | {f"u_{i}": F.when(length > 0, F.col(f"z_{i}") / length).otherwise(F.lit(0.0)) for i in range(p)})
    cells = [(x, i, j) for x in "tu" for i in range(p) for j in range(i + 1)]
    got = stored(soft.groupBy(*GROUP).agg(
        *[F.first(f"{x}_{i}").alias(f"{x}_{i}") for x in "cd" for i in range(p)], *[F.avg(F.col(f"{x}_{i}") * F.col(f"{x}_{j}")).alias(f"{x}{x}_{i}_{j}") for x, i, j in cells]
    ))
    made = []
    for start, x in enumerate(("", "t", "u")):
        def cell(i: int, j: int, x: str = x) -> Column:
            if not x:
                return F.col(f"d_{i}") ** 2 if i == j else F.lit(0.0)
            both = F.sqrt(F.col(f"{x}{x}_{i}_{i}") * F.col(f"{x}{x}_{j}_{j}"))
            return F.when(both > 0, F.col(f"{x}{x}_{i}_{j}") / both).otherwise(F.lit(float(i == j))) * F.col(f"d_{i}") * F.col(f"d_{j}")

        made.append(got.select(F.lit(start).alias("start"), *GROUP, *[f"c_{i}" for i in range(p)], *[cell(i, j).alias(f"v_{i}_{j}") for i in range(p) for j in range(i + 1)]))
    return _factor(made[0].union(made[1]).union(made[2]), 1.0)


def mcd_estimates(rows: DataFrame, core_share: float, steps: int, few: bool = True) -> DataFrame:
    """(GROUP, c_i, l_i_j, det): the minimum-covariance-determinant estimate of each group of rows (GROUP and the features).

    few: the groups' facts may be broadcast. The core of a start is the share core_share of its rows nearest to it; a start takes
    at most `steps` concentration steps, and none once its determinant no longer falls. The least determinant
    wins, of equals the first start. The rows within the 97.5 % quantile of the winner make the estimate.
    """
    p, names = len(FEATURES), list(FEATURES)
    scale = core_share / chi2_cdf(chi2_quantile(core_share, p), p + 2)

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnsRenamed({"level": "r_level", "a": "r_a", "b": "r_b"})
        on = (F.col("level") == F.col("r_level")) & F.col("a").eqNullSafe(F.col("r_a")) & F.col("b").eqNullSafe(F.col("r_b"))
        return left.join(F.broadcast(right) if few else right, on).drop("r_level", "r_a", "r_b")

    middles = stored(rows.groupBy(*GROUP).agg(*[F.percentile_approx(x, 0.5, 1000).alias(f"c_{i}") for i, x in enumerate(names)]))
    spread = meet(rows, middles).groupBy(*GROUP).agg(
        *[F.first(f"c_{i}").alias(f"c_{i}") for i in range(p)],
        *[F.percentile_approx(F.abs(F.col(x) - F.col(f"c_{i}")), 0.5, 1000).alias(f"d_{i}") for i, x in enumerate(names)],
    )
    spread = stored(spread.withColumns({f"d_{i}": F.sqrt((F.col(f"d_{i}") * 1.4826) ** 2 + f**2) for i, f in enumerate(FEATURES.values())}))
    z = meet(rows, spread).withColumns({f"z_{i}": (F.col(x) - F.col(f"c_{i}")) / F.col(f"d_{i}") for i, x in enumerate(names)})
    now = stored(_starts(z).withColumn("falls", F.lit(True)))
    key = ("start", *GROUP)
    for step in range(steps):
        far = lambda: meet(rows, now.where("falls")).withColumn("d2", _distance()).select(*key, "d2", "det", *names)
        edge = stored(far().groupBy(*key).agg(F.percentile_approx("d2", core_share, 1000).alias("edge")))
        edges = edge.withColumnsRenamed({c: f"e_{c}" for c in key})
        on = (F.col("start") == F.col("e_start")) & (F.col("level") == F.col("e_level")) & F.col("a").eqNullSafe(F.col("e_a")) & F.col("b").eqNullSafe(F.col("e_b"))
        core = far().join(F.broadcast(edges) if few else edges, on).where("d2 <= edge").select(*key, "det", *names)
        new = _factor(_scatter(core.withColumnRenamed("det", "was"), (*key, "was")), scale)
        # The first step leaves the start's own scatter, whose determinant tells nothing.
        kept = now.where("NOT falls") if step else now.limit(0)
        now = stored(kept.select(*now.columns).union(new.withColumn("falls", F.lit(True) if not step else F.col("det") < F.col("was") - 1e-3).select(*now.columns)))
        if not now.where("falls").head(1):
            break
    shape = [c for c in now.columns if c not in (*key, "falls")]
    best = now.groupBy(*GROUP).agg(F.min_by(F.struct(*shape), F.struct("det", "start")).alias("best")).select(*GROUP, "best.*")
    near = meet(rows, stored(best)).where(_distance() <= chi2_quantile(0.975, p)).select(*GROUP, *names)
    return stored(_factor(_scatter(near, GROUP), 0.975 / chi2_cdf(chi2_quantile(0.975, p), p + 2)))


def robust_outliers(
    stats: DataFrame, lang_col: str, source_col: str, core_share: float, tail: float, least_group: int, steps: int
) -> DataFrame:
    """stats (with the columns of _features and fit, whether a row counts for estimates) with distance and limit."""
    limit = chi2_quantile(1 - tail, len(FEATURES))
    key = lambda level, a, b: F.struct(F.lit(level).alias("level"), a.alias("a"), b.alias("b"))
    none = F.lit(None).cast("string")
    lang, source = F.col(lang_col).cast("string"), F.col(source_col).cast("string")
    levels = F.array(key(0, lang, source), key(1, lang, none), key(2, none, none))
    names = list(FEATURES)
    groups = stored(stats.where("fit").select(F.explode(levels).alias("g")).groupBy("g").agg(F.count("*").alias("n")).select("g.*", "n"))
    few = groups.count() <= BROADCAST_GROUPS
    rows = stats.where("fit").select(F.explode(levels).alias("g"), *names).select("g.*", *names)
    now = mcd_estimates(rows, core_share, steps, few)

    def meet(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        right = right.withColumnsRenamed({"level": "r_level", "a": "r_a", "b": "r_b"})
        on = (F.col("level") == F.col("r_level")) & F.col("a").eqNullSafe(F.col("r_a")) & F.col("b").eqNullSafe(F.col("r_b"))
        return left.join(F.broadcast(right) if few else right, on, how).drop("r_level", "r_a", "r_b")

    big = groups.where((F.col("n") >= least_group) | (F.col("level") == 2)).select("level", "a", "b", F.lit(True).alias("big"))
    ready = stored(meet(now, big).drop("big"))
    fine, wide = ready.where("level = 0"), ready.where("level = 1")
    every = ready.where("level = 2")

    def packed(df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in df.columns if c not in ("level", "a", "b")]
        return df.select(F.col("a").alias(f"{name}_a"), F.col("b").alias(f"{name}_b"), F.struct(*rest).alias(name))

    f, w, e = packed(fine, "f"), packed(wide, "w"), packed(every, "e").drop("e_a", "e_b")
    if few:
        f, w = F.broadcast(f), F.broadcast(w)
    out = stats.join(f, lang.eqNullSafe(F.col("f_a")) & source.eqNullSafe(F.col("f_b")), "left").join(w, lang.eqNullSafe(F.col("w_a")), "left")
    out = out.join(F.broadcast(e), F.lit(True), "left")  # one row
    out = out.withColumn("used", F.coalesce("f", "w", "e")).select(*stats.columns, "used.*")
    return out.withColumn("distance", F.coalesce(_distance(), F.lit(0.0))).withColumn("limit", F.lit(limit))


def rate_quality(
    docs: DataFrame,
    core_share: float = 0.75,
    tail: float = 1e-6,
    least_group: int = 200,
    steps: int = 8,
    least_words: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """(id_col, STATS, base_failed, kept, distance), a row for each row of docs.

    base_failed: fewer than least_words words, or more than half of them in repeated windows. kept: not
    base_failed, and the squared distance of the transformed counts from the centre of the document's
    language and source is within the chi-squared quantile that leaves tail. Groups under least_group
    documents use their language's estimate, or everyone's. Documents that fail the base rules count for
    no estimate; a null text is an empty one and fails them. Null languages and sources are groups of
    their own. Ids may be null or repeat and are passed on; other columns are not looked at. An empty
    table gives an empty one.
    """
    raw = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    stats = with_text_stats(raw, "text", ("id", "lang", "source"))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = stored(stats.withColumn("base_failed", failed)).select("*", *_features()).withColumn("fit", ~F.col("base_failed"))
    out = robust_outliers(stats, "lang", "source", core_share, tail, least_group, steps)
    kept = ~F.col("base_failed") & (F.col("distance") <= F.col("limit"))
    return out.select(F.col("id").alias(id_col), *STATS, "base_failed", kept.alias("kept"), "distance")
