"""URL filters: rules by host and path, and gradient-boosted trees on lexical features.

The longest fitting rule decides; what no rule fits, the trees decide. The trees are grown from
labelled URLs by histograms: the features are cut at quantiles, each level of a tree is one
aggregation of gradient sums by (node, feature, bin), and only those bounded sums reach the driver;
leaves get their weights from the sums of the level above. A grown forest is one SQL expression, so
scoring is a projection inside the scan's stage.

The query's labels come from what the pages hold, not from their URLs: a page whose visible text is
full of symbols, or of few different words, is one to block. One in HELD_OUT URLs, by hash, is kept out
of fitting, to measure by (`auc`).

DataFrame functions only. Fitting takes at most SAMPLE labelled URLs, those of lowest hash; of host
endings the SUFFIXES most frequent ones in that sample have statistics of their own, all others share
the overall rate.

Defined results: a null URL, or one without `://`, has an empty host and path, fits no rule and is
scored on what it has. Of rules of equal length the first in the list wins. Rows are independent:
repeated rows and null page_ids stay, extra columns change nothing, an empty table gives an empty
result. Null pages have an empty text and are no pages to block. Without labelled URLs of both kinds
every score is the share of blocked ones, or 0.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from trawl.llm.shared import materialize, pick, table

#: Fixed values: (verdict, host/path).
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
SAMPLE, TREES, DEPTH, BINS, RATE, RIDGE, SUFFIXES = 20_000, 10, 3, 16, 0.3, 1.0, 256
#: A page is one to block from this share of symbols, or below this share of different words among at least so many.
SYMBOLS, DIFFERENT, LEAST_WORDS, HELD_OUT = 0.03, 0.2, 50, 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(rows: DataFrame) -> DataFrame:
    """rows (with a column url) and host, path."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce("url", F.lit(""))
    return rows.withColumns({"host": F.translate(F.regexp_extract(url, parts, 1), _UPPER, _LOWER), "path": F.regexp_extract(url, parts, 2)})


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), else null; the rules are a short list."""
    tests = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        on, _, at = rule.partition("/")
        fits = ((host == on) | host.endswith(f".{on}")) & path.startswith(f"/{at}")
        tests = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(tests)
    return tests


def _count(text: Column, chars: str) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("double")


def _entropy(text: Column) -> Column:
    """Bits a character: log2 n less the mean of log2 of how often each occurs. Runs of the sorted characters are counted in one pass."""
    zero = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    done = lambda a: a["sum"] + F.when(a["run"] > 0, a["run"] * F.log2(a["run"])).otherwise(0.0)

    def step(a: Column, c: Column) -> Column:
        same = a["c"] == c
        return F.struct(c.alias("c"), F.when(same, a["run"] + 1).otherwise(F.lit(1.0)).alias("run"), F.when(same, a["sum"]).otherwise(done(a)).alias("sum"))

    n = F.char_length(text).cast("double")
    return F.when(n > 0, F.log2(n) - F.aggregate(F.array_sort(F.filter(F.split(text, ""), lambda c: c != "")), zero, step, done) / n).otherwise(0.0)


def suffix(host: Column) -> Column:
    return F.element_at(F.split(host, r"\."), -1)


def features(suffix_rates: dict[str, tuple[float, float]], rate: float) -> dict[str, Column]:
    """Lexical features of url, host and path; suffix_rates holds the blocked share and log count of suffixes."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    n = F.greatest(F.char_length(url), F.lit(1))
    labels = F.split(host, r"\.")
    out = {
        "length": F.char_length(url).cast("double"),
        "depth": _count(path, "/"),
        "digits": _count(url, "0123456789") / n,
        "entropy": _entropy(host),
        "params": F.when(url.contains("?"), 1 + _count(url, "&")).otherwise(0.0),
        "hyphens": _count(host, "-"),
        "host_length": F.char_length(host).cast("double"),
        "host_labels": F.size(labels).cast("double"),
        "host_digits": _count(host, "0123456789"),
        "longest_label": F.array_max(F.transform(labels, lambda x: F.char_length(x))).cast("double"),
        "marks": _count(url, "%=_~@") / n,
        "secure": url.startswith("https").cast("double"),
    }
    known = F.create_map(*[F.lit(x) for s, v in suffix_rates.items() for x in (s, v[0])]) if suffix_rates else None
    seen = F.create_map(*[F.lit(x) for s, v in suffix_rates.items() for x in (s, v[1])]) if suffix_rates else None
    out["suffix_rate"] = F.coalesce(F.try_element_at(known, suffix(host)), F.lit(rate)) if suffix_rates else F.lit(rate)
    out["suffix_count"] = F.coalesce(F.try_element_at(seen, suffix(host)), F.lit(0.0)) if suffix_rates else F.lit(0.0)
    return out


class Forest:
    """suffixes, base score and trees; a tree is (feature, cut, tree below or at the cut, tree above) or a weight."""

    def __init__(self, suffixes: dict, rate: float, base: float, trees: list):
        self.suffixes, self.rate, self.base, self.trees = suffixes, rate, base, trees

    def margin(self, columns: dict[str, Column]) -> Column:
        def walk(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            name, cut, low, high = tree
            return F.when(columns[name] <= cut, walk(low)).otherwise(walk(high))

        return reduce(lambda a, t: a + walk(t), self.trees, F.lit(self.base))


def _grow(binned: DataFrame, names: list[str], cuts: dict[str, list[float]], margin: Column) -> object:
    """One tree: each of DEPTH levels is one aggregation of gradients and curvatures by node, feature and bin."""
    p = 1 / (1 + F.exp(-margin))
    rows = binned.select((p - F.col("y")).alias("g"), (p * (1 - p)).alias("h"), F.array(*[f"b_{x}" for x in names]).alias("bins"))
    node, tree, weight = F.lit(0), {}, lambda g, h: -RATE * g / (h + RIDGE)
    for _ in range(DEPTH):
        exploded = rows.select(node.alias("node"), "g", "h", F.posexplode("bins").alias("feature", "bin")).where("node >= 0")
        sums: dict = {}
        for r in exploded.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():  # nodes x features x bins
            sums.setdefault(r.node, {}).setdefault(r.feature, {})[r.bin] = (r.g, r.h)
        tests, split = F.lit(-1), False
        for k, by_feature in sums.items():
            g, h = (sum(v[i] for v in by_feature[0].values()) for i in (0, 1))
            best = (1e-6, None)
            for f, bins in sorted(by_feature.items()):
                gl = hl = 0.0
                for b in range(len(cuts[names[f]])):
                    gl, hl = gl + bins.get(b, (0, 0))[0], hl + bins.get(b, (0, 0))[1]
                    if hl >= 1.0 and h - hl >= 1.0:
                        gain = gl**2 / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g**2 / (h + RIDGE)
                        best = max(best, (gain, (f, b, gl, hl)), key=lambda x: x[0])
            if best[1] is None:
                tree[k] = weight(g, h)
                continue
            f, b, gl, hl = best[1]
            tree[k], split = (names[f], cuts[names[f]][b]), True
            # leaves, unless the next level splits them
            tree[2 * k + 1], tree[2 * k + 2] = weight(gl, hl), weight(g - gl, h - hl)
            tests = F.when(node == k, F.when(F.get("bins", F.lit(f)) <= b, 2 * k + 1).otherwise(2 * k + 2)).otherwise(tests)
        if not split:
            break
        rows, node = rows.withColumn("at", tests), F.col("at")

    def build(k: int) -> object:
        v = tree.get(k, 0.0)
        return float(v) if not isinstance(v, tuple) else (*v, build(2 * k + 1), build(2 * k + 2))

    return build(0)


def fit(labelled: DataFrame, sample: int = SAMPLE, trees: int = TREES) -> Forest:
    """labelled: url, label (1: block). Rows with a null label take no part."""
    rows = pick(labelled, "url", "label").where(F.col("label").isNotNull()).orderBy(F.xxhash64("url", "label"), "url", "label").limit(sample)
    rows = materialize(with_parts(rows).select("url", "host", "path", F.col("label").cast("double").alias("y")))
    n, blocked = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if not 0 < blocked < n:
        return Forest({}, blocked / n if n else 0.0, 40.0 if blocked else -40.0, [])
    rate = blocked / n
    top = rows.groupBy(suffix(F.col("host")).alias("s")).agg(F.count("*").alias("n"), F.sum("y").alias("b")).orderBy(F.desc("n"), "s").limit(SUFFIXES).collect()
    suffixes = {r.s: ((r.b + 10 * rate) / (r.n + 10), math.log1p(r.n)) for r in top}
    columns = features(suffixes, rate)
    names = list(columns)
    made = materialize(rows.select("y", *[c.cast("double").alias(x) for x, c in columns.items()]))
    at = [k / BINS for k in range(1, BINS)]
    quantiles = made.agg(*[F.percentile_approx(x, at, 10_000).alias(x) for x in names]).first()
    cuts = {x: sorted(set(quantiles[x])) for x in names}
    bins = {x: reduce(lambda a, c, x=x: a + (F.col(x) > c).cast("int"), cuts[x], F.lit(0)).alias(f"b_{x}") for x in names}
    binned = materialize(made.select("y", *names, *bins.values()))
    forest = Forest(suffixes, rate, math.log(rate / (1 - rate)), [])
    for _ in range(trees):
        forest.trees.append(_grow(binned, names, cuts, forest.margin({x: F.col(x) for x in names})))
    return forest


def url_verdicts(pages: DataFrame, forest: Forest, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, score (the trees' probability of block)."""
    rows = with_parts(pick(pages, "page_id", "url")).withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    columns = features(forest.suffixes, forest.rate)
    rows = rows.select("page_id", "host", "path", "fit", *[c.cast("double").alias(f"f_{x}") for x, c in columns.items()])
    score = 1 / (1 + F.exp(-forest.margin({x: F.col(f"f_{x}") for x in columns})))
    return rows.withColumn("score", score).select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def held_out() -> Column:
    return F.pmod(F.xxhash64(F.lit(HELD_OUT), "url"), F.lit(HELD_OUT)) == 0


def visible(html: Column) -> Column:
    """The text of a page: without scripts, styles, comments and tags; the five common entities are characters."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return bare


def page_labels(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """url, label (1: block) of about sample pages, those of lowest hash, by what they hold."""
    rows = pick(pages, "url", "html").withColumn("h", F.xxhash64("url"))
    # the hash up to which a page is in the sample; only those pages' texts are looked at
    last = rows.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    text = rows.where(F.col("h") <= (last if last is not None else 0)).select("url", visible(F.coalesce("html", F.lit(""))).alias("text"))
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    n = F.char_length(F.regexp_replace("text", r"\s", ""))
    told = text.select("url", "text", words.alias("w")).select(
        "url",
        ((_count(F.col("text"), "#*$%&|<>") > SYMBOLS * n) | (F.size("w") >= LEAST_WORDS) & (F.size(F.array_distinct("w")) < DIFFERENT * F.size("w"))).cast("int").alias("label"),
    )
    return told.distinct()


def auc(scored: DataFrame) -> float:
    """score, label: the share of pairs of a 1 and a 0 that the score orders rightly, ties half."""
    counts = scored.groupBy("score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    below = F.sum("n").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1))  # of the bounded sample's different scores
    right, p, n = counts.select("p", "n", (F.col("p") * (F.coalesce(below, F.lit(0)) + F.col("n") / 2)).alias("right")).agg(F.sum("right"), F.sum("p"), F.sum("n")).first()
    return right / (p * n) if p and n else 0.5


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    labelled = materialize(page_labels(pages))
    return url_verdicts(pages, fit(labelled.where(~held_out())))


def rules_sql() -> str:
    """page_id, host, path and rule, which the trees play no part in."""
    tests = []
    for verdict, rule in sorted(RULES, key=lambda r: -len(r[1])):
        on, _, at = rule.partition("/")
        tests.append(f"WHEN (host = '{on}' OR ends_with(host, '.{on}')) AND starts_with(path, '/{at}') THEN '{rule}'")
    parts = "regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', {})"
    return f"""WITH p AS (SELECT page_id, translate({parts.format(1)}, '{_UPPER}', '{_LOWER}') AS host, {parts.format(2)} AS path FROM pages)
SELECT page_id, host, path, CASE {' '.join(tests)} END AS rule FROM p"""
