"""Quality rules: fixed limits, and robust multivariate outliers per language and source.

Every text becomes a vector of five transformed statistics. For each (lang, source) the minimum
covariance determinant is sought by concentration steps from two starts (median and MAD; mean and
standard deviation): the half of the vectors nearest to the centre gives the next centre and
covariance, until no determinant falls any longer; the start that ends with the lower one is taken.
Equal vectors of a (lang, source) count once, so copies can't outvote the rest; of different vectors,
just under half may be outliers. As usual, the estimates are then made once more of all vectors that
lie within the WEIGHED quantile of the first ones, as half of the data alone understate the tails. A
row is rejected when its squared Mahalanobis distance, made consistent for a normal distribution,
exceeds the chi-square quantile of 1 - TAIL, widened by (n^2 - 1) / (n (n - 5)) as the estimates are
of n vectors. Nothing here is fitted to labels.

DataFrame functions only. Statistics are made once and kept as a table in the shared folder; groups
are only ever aggregated with partial sums and quantile sketches, never gathered. Their small tables
of estimates are joined back by group and salt: AQE broadcasts them while they are small, and where
it doesn't, a hot group is dealt over SALTS tasks and aggregated in each before it is brought together.

Defined results: null and empty texts have no words and fail the base limits; null languages and
sources are groups of their own. Rows that fail the base limits enter no estimates. (lang, source)
groups of fewer than LEAST_ROWS different vectors are pooled by language; what is still smaller is
held to the estimates of all groups' vectors together, and where even those are fewer, only to the
base limits. Rows
are judged one by one, so repeated rows and null doc_ids stay as they are; extra columns are
carried through or left out, and an empty table gives an empty result.
"""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trawl.llm.shared import materialize, pick, table

LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
LEAST_ROWS, HALF, SALTS = 200, 0.5, 64
#: A clean row is rejected with this probability; the estimates are weighed within this quantile.
TAIL, WEIGHED = 1e-5, 0.975
#: A determinant that falls by less, in its logarithm, has stopped falling.
SETTLED = 1e-3
#: Standard deviations below which a statistic doesn't count as varying: half of a word's logarithm, a tenth of one elsewhere,
#: and the share that a single repeated window has in a text of some 350 words.
FLOORS = {"x_words": 0.5, "x_length": 0.1, "x_symbols": 0.1, "x_lines": 0.1, "x_repeat": 0.15}
XS = list(FLOORS)
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SPACE = r"\x20\x09-\x0D"


def chi_square(x: float, more: int = 0) -> float:
    """The chi-square distribution function with 5 degrees of freedom, or 7 if more is 2."""
    tail = math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    return math.erf(math.sqrt(x / 2)) - tail * (1 + x / 3 + (x * x / 15 if more else 0))


def quantile(p: float) -> float:
    """The chi-square quantile with 5 degrees of freedom, by bisection."""
    low, high = 0.0, 1e3
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle) < p else (low, middle)
    return high


#: By which the covariance of vectors within the WEIGHED quantile is too small.
CONSISTENCY = WEIGHED / chi_square(quantile(WEIGHED), 2)


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _window_hashes(hashes: Column) -> Column:
    """Of each run of WINDOW words one hash."""
    return F.when(
        F.size(hashes) >= WINDOW,
        let(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))),
    ).otherwise(F.array().cast("array<long>"))


def _repeated(windows: Column) -> Column:
    """Words in windows that occur twice or more: equal hashes are neighbours once sorted."""

    def covered(s: Column) -> Column:
        last = F.size(s) - 1
        starts = F.filter(
            F.transform(
                F.sequence(F.lit(0), last),
                lambda k: F.when(((k > 0) & (F.get(s, k - 1)["h"] == F.get(s, k)["h"])) | ((k < last) & (F.get(s, k + 1)["h"] == F.get(s, k)["h"])), F.get(s, k)["i"]),
            ),
            lambda i: i.isNotNull(),
        )
        first = F.struct(F.lit(-WINDOW).alias("before"), F.lit(0).alias("n"))
        return F.aggregate(F.sort_array(starts), first, lambda a, i: F.struct(i.alias("before"), (a["n"] + F.least(F.lit(WINDOW), i - a["before"])).alias("n")), lambda a: a["n"])

    dealt = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(dealt, covered)).otherwise(0)


def with_stats(docs: DataFrame) -> DataFrame:
    """docs (with a column text) and the statistics, the vector of the outlier rule, base_failed."""
    text = F.coalesce("text", F.lit(""))
    words = docs.withColumn("_words", F.regexp_extract_all(text, F.lit(f"[^{_SPACE}]+"), F.lit(0)))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{_SPACE}]"))
    windows = words.select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _window_hashes(F.transform("_words", lambda w: F.xxhash64(w))).alias("_windows"),
    )
    counted = windows.select(*docs.columns, *STATS[:-1], _repeated(F.col("_windows")).cast("long").alias("n_repeat_words"))
    n = F.greatest(F.col("n_words"), F.lit(1))
    return counted.select(
        "*",
        ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))).alias("base_failed"),
        F.log1p("n_words").alias("x_words"),
        F.log1p(F.col("word_chars") / n).alias("x_length"),
        F.sqrt(F.col("n_symbols") / n).alias("x_symbols"),
        F.sqrt(F.col("n_dup_lines") / n).alias("x_lines"),
        F.sqrt(F.col("n_repeat_words") / n).alias("x_repeat"),
    )


def _groups(rows: DataFrame, least: int) -> DataFrame:
    """Of each (_lang, _source) the _group whose estimates hold for it; none where even all judged rows are too few."""
    counts = materialize(rows.groupBy("_lang", "_source").agg(F.count_if(~F.col("base_failed")).alias("n")))
    by_lang = counts.where(F.col("n") < least).groupBy("_lang").agg(F.sum("n").alias("n_lang"))
    total = counts.agg(F.sum("n").alias("n_all"))
    own = F.concat_ws("\x01", F.lit("own"), "_lang", "_source")
    return counts.join(by_lang, "_lang", "left").crossJoin(F.broadcast(total)).select(  # one row
        "_lang",
        "_source",
        F.when(F.col("n") >= least, own).when(F.col("n_lang") >= least, F.concat_ws("\x01", F.lit("lang"), "_lang")).when(F.col("n_all") >= least, F.lit("all")).alias("_group"),
    )


def _with(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows, salted, with a row of small for each key."""
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.join(salted, [*keys, "_salt"], how)


def _estimates(moments: DataFrame, keys: list[str]) -> DataFrame:
    """Cholesky factors of the covariances, floors added, and the log determinant."""
    out = moments
    for i, x in enumerate(XS):
        for j in range(i + 1):
            low = F.col(f"c_{j}_{i}") + (F.lit(FLOORS[x] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                low = low - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            low = F.sqrt(F.greatest(low, F.lit(1e-9))) if i == j else low / F.col(f"l_{j}_{j}")
            out = out.withColumn(f"l_{i}_{j}", low)
    det = sum((F.log(f"l_{i}_{i}") for i in range(len(XS))), F.lit(0.0))
    return out.select(*keys, *[f"m_{i}" for i in range(len(XS))], *[f"l_{i}_{j}" for i in range(len(XS)) for j in range(i + 1)], det.alias("log_det"))


def _distance(rows: DataFrame) -> DataFrame:
    """rows joined with _estimates(), and d2, the squared Mahalanobis distance, by forward substitution."""
    for i, x in enumerate(XS):
        z = F.col(x) - F.col(f"m_{i}")
        for k in range(i):
            z = z - F.col(f"l_{i}_{k}") * F.col(f"z_{k}")
        rows = rows.withColumn(f"z_{i}", z / F.col(f"l_{i}_{i}"))
    return rows.withColumn("d2", sum((F.col(f"z_{i}") ** 2 for i in range(len(XS))), F.lit(0.0)))


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    pairs = list(combinations_with_replacement(range(len(XS)), 2))
    return rows.groupBy(*keys).agg(*[F.avg(x).alias(f"m_{i}") for i, x in enumerate(XS)], *[F.covar_pop(XS[i], XS[j]).alias(f"c_{i}_{j}") for i, j in pairs])


def mcd(rows: DataFrame, half: float = HALF) -> DataFrame:
    """rows: _group, _salt and the vector. Per _group: centre, Cholesky factor of the reweighted minimum-determinant covariance, n of the vectors it is of."""
    medians = rows.groupBy("_group").agg(*[F.percentile_approx(x, 0.5, 10_000).alias(f"m_{i}") for i, x in enumerate(XS)])
    spread = _with(rows, medians, ["_group"]).groupBy("_group").agg(
        *[F.first(f"m_{i}").alias(f"m_{i}") for i in range(len(XS))],
        *[F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{i}")), 0.5, 10_000).alias(f"s_{i}") for i, x in enumerate(XS)],
    )
    zero = [F.lit(0.0).alias(f"c_{i}_{j}") for i, j in combinations_with_replacement(range(len(XS)), 2) if i != j]
    robust = spread.select("_group", *[f"m_{i}" for i in range(len(XS))], *[((1.4826 * F.col(f"s_{i}")) ** 2).alias(f"c_{i}_{i}") for i in range(len(XS))], *zero)
    starts = robust.withColumn("_start", F.lit(0)).unionByName(_moments(rows, ["_group"]).withColumn("_start", F.lit(1)))
    now, first = materialize(_estimates(starts, ["_group", "_start"])), True
    while True:
        near = _distance(_with(rows, now, ["_group"]))
        limit = near.groupBy("_group", "_start").agg(F.percentile_approx("d2", half, 10_000).alias("limit"))
        inside = _with(near, limit, ["_group", "_start"]).where(F.col("d2") <= F.col("limit"))
        then = materialize(_estimates(_moments(inside, ["_group", "_start"]), ["_group", "_start"]))
        # a start isn't of half of the vectors, so its determinant can't be compared
        falls = first or not then.join(now.select("_group", "_start", F.col("log_det").alias("before")), ["_group", "_start"]).where(F.col("log_det") < F.col("before") - SETTLED).isEmpty()
        now, first = then, False
        if not falls:
            break
    best = now.groupBy("_group").agg(F.min(F.struct("log_det", "_start", *[c for c in now.columns if c[1] == "_" and c[0] in "ml"])).alias("b")).select("_group", "b.*")
    near = _distance(_with(rows, best.drop("_start"), ["_group"]))
    # where the floors are most of a covariance, distances are small by themselves, and are not blown up
    scale = near.groupBy("_group").agg(F.greatest(F.percentile_approx("d2", 0.5, 10_000) / quantile(0.5), F.lit(0.2)).alias("scale"))
    within = _with(near, scale, ["_group"]).where(F.col("d2") <= quantile(WEIGHED) * F.col("scale"))
    weighed = _estimates(_moments(within, ["_group"]), ["_group"])
    return materialize(weighed.join(within.groupBy("_group").agg(F.count("*").cast("double").alias("n")), "_group"))


def quality_rules(docs: DataFrame, keep: list[str], tail: float = TAIL, least: int = LEAST_ROWS) -> DataFrame:
    """Per row of docs: keep, the statistics, base_failed, distance (null where no group is large enough), kept."""
    names = list(dict.fromkeys([*keep, "text", "lang", "source"]))
    plain = pick(docs, *names).toDF(*[f"_in{i}" for i in range(len(names))])
    at = {n: f"_in{i}" for i, n in enumerate(names)}
    group = {k: F.coalesce(F.concat(F.lit("="), at[n]), F.lit("")).alias(k) for k, n in (("_lang", "lang"), ("_source", "source"))}
    out = {k: f"_out{i}" for i, k in enumerate(keep)}
    made = with_stats(plain.select(F.col(at["text"]).alias("text"), *group.values(), *[F.col(at[k]).alias(out[k]) for k in keep]))
    made = materialize(made.drop("text"))
    # copies have one vector, so the salt is the row's place in its file
    salted = lambda df, salt: df.withColumn("_salt", F.pmod(salt, F.lit(SALTS)))
    vectors = materialize(salted(made.select("_lang", "_source", "base_failed", *XS).distinct(), F.xxhash64(*XS)))
    groups = materialize(_groups(vectors, least))
    keyed = _with(salted(made, F.monotonically_increasing_id()), groups, ["_lang", "_source"], "left")
    dealt = _with(vectors.where(~F.col("base_failed")), groups, ["_lang", "_source"])
    judged = dealt.where(F.col("_group").isNotNull() & (F.col("_group") != "all")).select("_group", "_salt", *XS)
    if groups.where(F.col("_group") == "all").limit(1).count():
        # a leftover may be a single row: it is held to everyone's estimates, not to its own
        judged = judged.union(dealt.select(F.lit("all"), "_salt", *XS))
    estimates = mcd(judged)
    far = _distance(_with(keyed, estimates, ["_group"], "left")).withColumn("distance", F.col("d2") / CONSISTENCY)
    n = F.col("n")
    cutoff = quantile(1 - tail) * (n * n - 1) / (n * (n - len(XS)))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return far.select(*[F.col(out[k]).alias(k) for k in keep], *STATS, "base_failed", kept.alias("kept"), "distance")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), ["doc_id"])


def base_sql() -> str:
    """doc_id, the statistics and base_failed, which the estimates play no part in."""
    w = WINDOW
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
ws AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
wins AS (SELECT r, i, list_aggregate(words[i:i + {w - 1}], 'string_agg', ' ') AS win FROM (SELECT r, words, unnest(range(1, len(words) - {w - 2})) AS i FROM ws WHERE len(words) >= {w})),
twice AS (SELECT r, i FROM wins QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, {w})) AS k) GROUP BY r),
s AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM ws LEFT JOIN covered USING (r))
SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM s"""
