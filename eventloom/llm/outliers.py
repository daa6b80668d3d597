"""Quality rules: robust multivariate outliers by the minimum covariance determinant.

Statistics of each text become a vector of roughly symmetric numbers. For each language and source the mean and
scatter of the half-or-more of the vectors whose scatter has the least determinant are estimated with concentration
steps: distances under the present estimate, the share of nearest vectors, their mean and scatter, again. Two
deterministic starts are taken and the smaller determinant wins. Vectors far from their group's centre in Mahalanobis
distance are rejected. All of it is grouped sums and approximate quantiles, so a group of any size is aggregated in
parts; estimates, a row a group, are sent to the rows.

Statistics of short texts are noisy, so rates are taken over PRIOR further words that are like the language's average.
A feature may be constant among a group's nearest vectors: most texts have no symbol at all. Its variance is then taken as
that of the least difference that can be seen, of one count in the group's median number of words (`resolutions`); a
larger estimate is not touched. Estimates of n vectors are shrunk towards those of their language with weight n / (n + SMALL),
and a language's towards those of all texts likewise, so a small group has its own estimate as far as it bears one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import BLANK, Scratch, plain_words, text_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
SHARE = 0.75
STEPS = 4
#: Vectors at which an estimate weighs as much as its parent's; with fewer in all, nothing is rejected.
SMALL = 40
#: Words of average kind that are added to each text, and what one symbol, duplicate line and repeated window count.
PRIOR = 50.0
UNITS = (1.0, 1.0, 6.0)
FEATURES = ("x0", "x1", "x2", "x3")
#: The least standard deviation of the mean word length's logarithm, which is no count.
LEAST_LENGTH = 1e-3
#: The 0.9999 quantile of chi-square with 4 degrees of freedom, a fixed value.
CHI2_CUT = 23.513
#: Share of a normal vector's variance within the nearest 75 %, by its number of dimensions: chi-square(p + 2) below the 0.75
#: quantile of chi-square(p), over 0.75; fixed values.
SHRINKS = (0.369, 0.538, 0.621, 0.673)
#: Estimates of up to this many groups are sent to all workers; more are joined as any table.
MOST_SENT = 50_000


def base_statistics(text: Column | str = "text") -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines of a text."""
    t = text_of(text)
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.regexp_replace(x, BLANK, "")) > 0)
    return {
        "n_words": F.size(plain_words(t)).cast("long"),
        "word_chars": F.length(F.regexp_replace(t, BLANK, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def repeated_words(df: DataFrame, words: str, out: str, width: int = 3) -> DataFrame:
    """Adds the number of words that stand in a window of `width` words found twice or more in the row's own words.

    Windows are 64-bit hashes. Only where some are equal are they sorted with their places, runs of equal ones found,
    and the places covered counted.
    """
    n = F.greatest(F.size(words) - (width - 1), F.lit(0))
    hashes = F.transform(F.slice(words, F.lit(1), n), lambda w, i: F.xxhash64(w, *[F.get(F.col(words), i + k) for k in range(1, width)]))
    step = df.withColumn("__h", hashes).withColumn("__n", F.size("__h")).withColumn("__twice", F.size(F.array_distinct("__h")) < F.col("__n"))
    placed = F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn("__s", F.when(F.col("__twice"), placed))
    same = lambda a, b: F.coalesce(F.get("__s", a)["h"] == F.get("__s", b)["h"], F.lit(False))
    places = F.filter(F.transform("__s", lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["i"])), lambda x: x.isNotNull())
    step = step.withColumn("__p", F.array_sort(places))
    gaps = F.transform("__p", lambda x, i: F.least(F.lit(width), F.coalesce(F.get("__p", i + 1) - x, F.lit(width))))
    total = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)
    return step.withColumn(out, F.coalesce(total, F.lit(0)).cast("long")).drop("__h", "__n", "__twice", "__s", "__p")


def vector() -> list[Column]:
    """Mean word length, symbols, duplicate lines and repeated words, each per word and levelled by a logarithm or root."""
    n = F.col("n_words") + PRIOR
    return [
        F.log((F.greatest(F.col("word_chars"), F.lit(1)) + PRIOR * F.col("usual")) / n),
        F.sqrt(F.col("n_symbols") / n),
        F.log1p(10.0 * F.col("n_dup_lines") / F.sqrt(n)),
        F.sqrt(F.col("n_repeat_words") / n),
    ]


def resolutions(n_words: Column) -> list[Column]:
    """What one count changes in each feature of a text of n_words words."""
    n = n_words + PRIOR
    return [F.lit(LEAST_LENGTH), F.sqrt(UNITS[0] / n), F.log1p(10.0 * UNITS[1] / F.sqrt(n)), F.sqrt(UNITS[2] / n)]


def _moments(weight: Column | None = None) -> list[Column]:
    pick = (lambda c: c) if weight is None else (lambda c: F.when(weight, c))
    out = [F.avg(pick(F.col(x))).alias(f"m{i}") for i, x in enumerate(FEATURES)]
    for i, x in enumerate(FEATURES):
        for j, y in enumerate(FEATURES[: i + 1]):
            out.append(F.covar_pop(pick(F.col(x)), pick(F.col(y))).alias(f"c{i}{j}"))
    return out


def _scatter(params: DataFrame, inner: bool) -> DataFrame:
    """Takes no variance below the resolution; adds the log determinant and the factor l_ij.

    The scatter c_ij of inner vectors is corrected for what the outer ones would add. Features that vary by less than the
    resolution do not count as dimensions there.
    """
    several = sum(((F.coalesce(F.col(f"c{i}{i}"), F.lit(0.0)) > F.col(f"r{i}") * F.col(f"r{i}")).cast("int") for i in range(len(FEATURES))), F.lit(0))
    shrink = F.element_at(F.array(*[F.lit(x) for x in SHRINKS]), F.greatest(several, F.lit(1))) if inner else F.lit(1.0)
    params = params.withColumn("_s", shrink)
    for i in range(len(FEATURES)):
        for j in range(i + 1):
            c = F.coalesce(F.col(f"c{i}{j}"), F.lit(0.0)) / F.col("_s")
            params = params.withColumn(f"c{i}{j}", F.greatest(c, F.col(f"r{i}") * F.col(f"r{i}")) if i == j else c)
    return _factored(params.drop("_s"))


def _factored(params: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l_ij of the scatter c_ij and its log determinant."""
    out = params
    for i in range(len(FEATURES)):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    return out.withColumn("logdet", sum((F.log(F.col(f"l{i}{i}")) for i in range(len(FEATURES))), F.lit(0.0)) * 2)


def _sent(table: DataFrame) -> DataFrame:
    """A written table of a row a group, for a join that leaves the rows where they are if it is small enough."""
    return F.broadcast(table) if table.count() <= MOST_SENT else table


def _distance(df: DataFrame, out: str = "d2") -> DataFrame:
    """Adds the squared Mahalanobis distance by forward substitution."""
    z: list[Column] = []
    for i, x in enumerate(FEATURES):
        rest = F.col(x) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * z[k]
        df = df.withColumn(f"__z{i}", rest / F.col(f"l{i}{i}"))
        z.append(F.col(f"__z{i}"))
    return df.withColumn(out, sum((c * c for c in z), F.lit(0.0))).drop(*[f"__z{i}" for i in range(len(FEATURES))])


def estimate(vectors: DataFrame, keep, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """(lang, source, x0..x3, n_words) to one row a group: lang, source, members, m_i, c_ij, l_ij, logdet.

    keep(df, name) writes a table; the estimates are written after each step, as each reads the one before. Without n_words
    no variance is taken below LEAST_LENGTH squared.
    """
    by, k = ["lang", "source"], range(len(FEATURES))
    usual = [F.percentile_approx("n_words", 0.5, 2000).alias("_n")] if "n_words" in vectors.columns else [F.lit(None).cast("long").alias("_n")]
    medians = vectors.groupBy(*by).agg(F.count("*").alias("members"), *usual, *[F.percentile_approx(x, 0.5, 2000).alias(f"m{i}") for i, x in enumerate(FEATURES)])
    least = [F.coalesce(r, F.lit(LEAST_LENGTH)).alias(f"r{i}") for i, r in enumerate(resolutions(F.col("_n")))]
    medians = keep(medians.select(*by, "members", *[f"m{i}" for i in k], *least), "medians")
    facts = _sent(medians.select(*by, *[f"r{i}" for i in k]))
    spread = vectors.join(_sent(medians), by).groupBy(*by).agg(*[F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5, 2000).alias(f"s{i}") for i, x in enumerate(FEATURES)])
    flat = spread.join(medians, by).select(*by, F.lit(0).alias("start"), *[F.col(f"m{i}") for i in k], *[(F.pow(F.col(f"s{i}") * 1.4826, 2) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in k for j in range(i + 1)])
    whole = vectors.groupBy(*by).agg(*_moments()).withColumn("start", F.lit(1))
    params = keep(_scatter(flat.unionByName(whole).join(facts, by), False), "mcd0")
    for n in range(1, steps + 1):
        near = _distance(vectors.join(_sent(params.drop("logdet")), by))
        cut = keep(near.groupBy(*by, "start").agg(F.percentile_approx("d2", share, 2000).alias("cut")), f"cut{n}")
        inner = near.join(_sent(cut), [*by, "start"]).filter("d2 <= cut")
        params = keep(_scatter(inner.groupBy(*by, "start").agg(*_moments()).join(facts, by), True), f"mcd{n}")
    best = params.groupBy(*by).agg(F.min_by(F.struct(*[c for c in params.columns if c not in by]), F.struct("logdet", "start")).alias("b"))
    return best.select(*by, "b.*").join(medians.select(*by, "members"), by)


def _mixture(own: DataFrame, parent: dict[str, Column]) -> DataFrame:
    """Estimates shrunk towards the parent's, given by name."""
    weight = F.col("members") / (F.col("members") + SMALL)
    return own.withColumns({c: weight * F.col(c) + (1 - weight) * x for c, x in parent.items()})


def shrunk(params: DataFrame) -> DataFrame:
    """(lang, source, members, m_i, c_ij) of groups, of languages (source *) and of all (lang *) to those of groups, with factors."""
    names = [c for c in params.columns if c[0] in "mc" and c[1:].isdigit()]
    whole = params.filter("lang = '*'").first()
    if whole is None or whole.members < SMALL:
        return _factored(params.select("lang", "source", "members", *names).limit(0))
    languages = _mixture(params.filter("lang <> '*' and source = '*'").select("lang", "members", *names), {c: F.lit(whole[c]) for c in names})
    languages = languages.select(F.col("lang").alias("_l"), *[F.col(c).alias(f"_{c}") for c in names])
    own = params.filter("source <> '*'").select("lang", "source", "members", *names).join(languages, F.col("lang") == F.col("_l"))
    return _factored(_mixture(own, {c: F.col(f"_{c}") for c in names}).select("lang", "source", "members", *names))


def judge(docs: DataFrame, cut: float = CHI2_CUT) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, the four statistics, base_failed, kept, distance.

    Fails at once: under MIN_WORDS words, or more than half the words in repeated three-word windows; null texts have no
    words. The others vote in their language and source; if there are fewer than SMALL of them in all, nothing is rejected
    (distance null). Null languages and sources are groups of their own. Repeated rows count as often as they stand. Very long
    texts are read whole. Vectors at the same distance as the last of a share all belong to it. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "outliers")
    t = docs.select(
        F.col("doc_id"),
        *[F.when(F.col(c).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(c).cast("string"))).alias(c) for c in ("lang", "source")],
        plain_words(text_of()).alias("w"),
        *[c.alias(n) for n, c in base_statistics().items() if n != "n_words"],
    )
    t = repeated_words(t, "w", "n_repeat_words").withColumn("n_words", F.size("w").cast("long")).drop("w")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    t = scratch.keep(t.withColumn("base_failed", failed), "counted")
    usual = t.filter("not base_failed").groupBy("lang").agg((F.sum("word_chars") / F.sum("n_words")).alias("usual"))
    t = t.join(_sent(scratch.keep(usual, "usual")), "lang", "left").withColumns(dict(zip(FEATURES, vector())))
    t = scratch.keep(t, "statistics")
    groups = F.array(F.struct("lang", "source"), F.struct(F.col("lang"), F.lit("*").alias("source")), F.struct(F.lit("*").alias("lang"), F.lit("*").alias("source")))
    vectors = t.filter("not base_failed").select(F.explode(groups).alias("g"), "n_words", *FEATURES).select("g.lang", "g.source", "n_words", *FEATURES)
    params = scratch.keep(estimate(scratch.keep(vectors, "vectors"), scratch.keep), "estimates")
    params = _sent(scratch.keep(shrunk(params).drop("members", "logdet"), "shrunk"))
    marked = _distance(t.join(params, ["lang", "source"], "left"), "distance")
    return marked.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= cut, F.lit(True))).alias("kept"),
        F.when(~F.col("base_failed"), F.col("distance")).alias("distance"),
    )
