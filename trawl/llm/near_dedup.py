"""Near-duplicate detection by ProbMinHash.

A text is a weighted set: its runs of SHINGLE words, each with how often it occurs. Every shingle
has exponential arrivals at the rate of its weight, each at a random register; a register keeps the
shingle of its earliest arrival, and a shingle's arrivals end once they are later than every
register's. Two texts agree in a register with the probability of their probability Jaccard
    J_P(a, b) = sum over common d of 1 / sum over all e of max(a_e / a_d, b_e / b_d).
BANDS bands of ROWS registers deal texts into buckets. Links are pairs with an exact J_P of
THRESHOLD or more, and classes are what links connect:

1. Equal texts are one from here on. In each bucket the text that shares most buckets with others
   is the hub; every other member is compared exactly with it, one pair a member.
2. Buckets that these links leave in several classes are compared further, member by member across
   classes, in blocks of BLOCK texts by their registers' low bytes; a bucket's largest class is
   only dealt to the blocks of its other members. Pairs whose estimate is within
   MARGIN (five standard deviations) of the threshold are compared exactly, each only in the first
   band whose full hash it shares. Members of buckets over SMALL first get FINE registers, whose estimates
   leave few pairs that are not links.

What is lost is by chance alone, and little: a pair at exactly J_P = 0.8 shares no band in 2 of
100,000 cases (0.85: 4 of 100 million), and of those left to step 2 the estimate prunes 3 of 10
million; both fall fast above the threshold. Nothing is lost by the number of a text's copies,
partners or candidates. A group of copies or near copies costs a number of rows in proportion to it
in step 1; in step 2 it grows with the product of the texts outside of a bucket's largest class and
all: texts that are all just below the threshold to one another are compared pair by pair, by
estimates.

Words are runs of bytes other than ASCII white space, A-Z lower-cased. A text of fewer words than
SHINGLE is one shingle; a text without words only equals itself. Null texts are empty texts. Every
row gets a class, repeated rows and null doc_ids included: class_id is the least doc_id of the class
(null if it has none but null). Of a class the row of least doc_id, of equals one, is kept. Extra
columns change nothing, and an empty table gives an empty result. Texts are told apart by 64-bit
hashes; where a second hash shows that two collided, both are classes of their own.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from trawl.llm.components import components
from trawl.llm.shared import bitmap, chunks, materialize, mix, pick, prefix_hash, span_hash, table

SHINGLE, THRESHOLD, BANDS, ROWS, BLOCK, MARGIN = 5, 0.8, 36, 6, 1024, 0.137
SMALL, FINE, FINE_MARGIN = 64, 1024, 0.063
#: Sums of floats come out this close to the J_P that they stand for.
ROUNDING = 1e-9
REGISTERS = BANDS * ROWS
_G = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) of the distinct shingles, ordered by text, then shingle."""
    raw = [(t or "").encode() for t in texts]
    data = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    ends = np.cumsum([len(r) + 1 for r in raw])
    blank = _BLANK[data]
    start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    end = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    word, text = span_hash(prefix_hash(data), start, end), np.searchsorted(ends, start, "right")
    n = np.bincount(text, minlength=len(raw))
    first = np.cumsum(n) - n
    left = np.repeat(first + n, n) - np.arange(len(word))  # words from here on in its text
    full = np.flatnonzero(left >= SHINGLE)
    runs = np.zeros(len(full), np.uint64)
    for k in range(SHINGLE):
        runs = mix(runs * _G + word[full + k])
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    few = np.zeros(len(short), np.uint64)
    for k in range(SHINGLE - 1):
        on = n[short] > k
        few[on] = mix(few[on] * _G + word[first[short[on]] + k])
    of, hashes = np.concatenate([text[full], short]), np.concatenate([runs, mix(few + _G)])
    order = np.lexsort((hashes, of))
    of, hashes = of[order], hashes[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(of) != 0) | (hashes[1:] != hashes[:-1])])) if len(of) else order
    return of[new], hashes[new], np.diff(np.concatenate([new, [len(of)]]))


def prob_min_hash(of: np.ndarray, elements: np.ndarray, weights: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """The elements in the registers of each text; rows of texts without elements are 0."""
    times, kept = np.full(texts * registers, np.inf), np.zeros(texts * registers, np.uint64)
    rate, at, late = 1.0 / weights, np.zeros(len(of)), np.zeros(len(of), np.uint64)
    while len(of):
        m = int(np.clip(20_000 // len(of), 1, 64))  # arrivals at a time
        step = late[:, None] + np.arange(m, dtype=np.uint64)
        random = mix(elements[:, None] + (step + np.uint64(1)) * _G)
        arrivals = at[:, None] + np.cumsum(-np.log(((random >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * rate[:, None], 1)
        register = (mix(random) % np.uint64(registers)).astype(np.int64) + (of * registers)[:, None]
        np.minimum.at(times, register.ravel(), arrivals.ravel())
        won = times[register] == arrivals
        kept[register[won]] = np.broadcast_to(elements[:, None], register.shape)[won]
        at, late = arrivals[:, -1], late + np.uint64(m)
        go = at < times.reshape(texts, registers).max(1)[of]
        of, elements, rate, at, late = of[go], elements[go], rate[go], at[go], late[go]
    return kept.reshape(texts, registers)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """J_P of two weighted sets (sorted elements, weights)."""
    every = np.union1d(a[0], b[0])
    w, v = np.zeros(len(every)), np.zeros(len(every))
    w[np.searchsorted(every, a[0])], v[np.searchsorted(every, b[0])] = a[1], b[1]
    both = (w > 0) & (v > 0)
    if not both.any():
        return 0.0
    with np.errstate(divide="ignore"):
        ratio = w / v
    order = np.argsort(ratio, kind="stable")
    sorted_, below_v = ratio[order], np.concatenate([[0], np.cumsum(v[order])])
    above_w = w.sum() - np.concatenate([[0], np.cumsum(w[order])])
    at = np.searchsorted(sorted_, ratio[both], "left")
    return float((1 / (above_w[at] / w[both] + below_v[at] / v[both])).sum())


def _with_hashes(docs: DataFrame, *more: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return pick(docs, *dict.fromkeys([*more, "text"])).select(*more, *([] if "text" in more else ["text"]), F.xxhash64(text).alias("t"), F.xxhash64(F.lit(1), text).alias("t2"))


def _signatures(rows: DataFrame) -> DataFrame:
    """Of each text with words, once in a task: t, bands, sketch (its registers' low bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in chunks(batches):
            new = {}
            for k, t in enumerate(b.column("t").to_pylist()):
                if t not in seen and t not in new:
                    new[t] = k
            if len(seen) < 1 << 20:
                seen.update(new)
            texts = b.column("text").to_pylist()
            of, elements, weights = shingles([texts[k] for k in new.values()])
            kept = prob_min_hash(of, elements, weights, len(new))
            some = np.flatnonzero(np.bincount(of, minlength=len(new)))
            kept = kept[some]
            hashes = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(some), BANDS)).copy()
            for r in range(ROWS):
                hashes = mix(hashes * _G + kept.reshape(-1, BANDS, ROWS)[:, :, r])
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * BANDS), pa.array(hashes.ravel().view(np.int64)))
            sketch = (kept & np.uint64(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(list(new), np.int64)[some]), bands, pa.array([s.tobytes() for s in sketch], pa.binary())], names=["t", "bands", "sketch"])

    return rows.select("t", "text").mapInArrow(run, "t long, bands array<long>, sketch binary")


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """t and text of the wanted t, once each; a bitmap keeps most other texts from the shuffle."""
    bits = bitmap(wanted.select("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            ok = bits.has(b.column("t").to_numpy())
            for k in np.flatnonzero(ok):
                t = b.column("t")[int(k)].as_py()
                ok[k] = t not in seen
                if len(seen) < 1 << 20:
                    seen.add(t)
            yield b.filter(pa.array(ok))

    found = rows.select("t", "text").mapInArrow(run, "t long, text string")
    return materialize(found.join(wanted.select("t").distinct(), "t", "left_semi").dropDuplicates(["t"]))


def _linked(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (u, v) those with an exact J_P of threshold or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, tuple] = OrderedDict()

        def profile(t: int, text: str) -> tuple:
            if t not in held:
                if len(held) >= 256:
                    held.popitem(last=False)
                held[t] = shingles([text])[1:]
            held.move_to_end(t)
            return held[t]

        for b in batches:
            u, v, a, c = (b.column(k).to_pylist() for k in ("u", "v", "a", "c"))
            near = [probability_jaccard(profile(v[k], c[k]), profile(u[k], a[k])) >= threshold - ROUNDING for k in range(b.num_rows)]
            yield b.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

    left = pairs.join(texts.toDF("u", "a"), "u")
    return left.join(texts.toDF("v", "c"), "v").select("u", "v", "a", "c").mapInArrow(run, "u long, v long")


def _fine(texts: DataFrame) -> DataFrame:
    """t, text -> t, fine: the low bytes of FINE registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            kept = prob_min_hash(*shingles(b.column("text").to_pylist()), b.num_rows, FINE)
            yield pa.RecordBatch.from_arrays([b.column("t"), pa.array([k.tobytes() for k in (kept & np.uint64(255)).astype(np.uint8)], pa.binary())], names=["t", "fine"])

    return texts.mapInArrow(run, "t long, fine binary")


def _across(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (b, i, j, own, t, c, sketch, bands, band, fine), sorted by b, i, j: pairs of different c that may be near, from whole groups."""

    def compare(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        block, own = (t.column(k).to_numpy() for k in ("j", "own"))
        same = t.column("i").to_numpy() == block
        ts, cs, band = (t.column(k).to_numpy() for k in ("t", "c", "band"))
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, REGISTERS)
        bands = np.concatenate([x.flatten().to_numpy() for x in t.column("bands").chunks]).reshape(-1, BANDS)
        fine = t.column("fine")
        if fine.null_count:
            full, least = sketch, (threshold - MARGIN) * REGISTERS
        else:
            full, least = np.frombuffer(b"".join(fine.to_pylist()), np.uint8).reshape(-1, FINE), (threshold - FINE_MARGIN) * FINE
        left = np.flatnonzero(own == t.column("i").to_numpy())
        right = left if same[0] else np.flatnonzero(own != t.column("i").to_numpy())
        us, vs = [], []
        for k in left:
            others = right[(cs[right] != cs[k]) & ((ts[right] > ts[k]) | (not same[0]))]
            for x in range(0, len(others), 4096):
                other = others[x : x + 4096]
                other = other[(full[other] == full[k]).sum(1) >= least]
                first = (bands[other] == bands[k]).argmax(1) == band[k]
                us.append(np.full(first.sum(), ts[k])), vs.append(ts[other[first]])
        return (np.concatenate(us), np.concatenate(vs)) if us else (np.empty(0, np.int64),) * 2

    def groups() -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(k).to_numpy() for k in ("b", "i", "j")])
            if held and tuple(held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in ("b", "i", "j")) != tuple(keys[:, 0]):
                yield pa.Table.from_batches(held)
                held = []
            cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(0)) + 1).tolist(), b.num_rows]
            for x, y in zip(cuts, cuts[1:], strict=False):
                held.append(b.slice(x, y - x))
                if y < b.num_rows:
                    yield pa.Table.from_batches(held)
                    held = []
        if held:
            yield pa.Table.from_batches(held)

    for g in groups():
        u, v = compare(g)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])


def near_classes(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """rows: text, t. Per t that is linked and not the least of its class: t, c, the least t."""
    signed = materialize(_signatures(rows))
    bands = signed.select("t", F.posexplode("bands").alias("band", "b"))
    shared = bands.groupBy("b").agg(F.min("t").alias("low"), F.max("t").alias("high"), F.count("*").alias("n")).where("low <> high").select("b", "n")
    shared = materialize(shared)
    bits = bitmap(shared.select("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(bits.has(b.column("b").to_numpy())))

    members = materialize(bands.mapInArrow(run, "t long, band int, b long").join(shared, "b").distinct())
    degree = members.groupBy("t").agg(F.sum("n").alias("degree"))
    ranked = materialize(members.join(degree, "t"))
    hubs = ranked.groupBy("b").agg(F.max(F.struct("degree", "t")).alias("hub")).select("b", F.col("hub.t").alias("v"))
    pairs = materialize(ranked.join(hubs, "b").where(F.col("t") != F.col("v")).select(F.col("t").alias("u"), "v").distinct())
    texts = _texts(rows, members.select("t"))
    links = materialize(_linked(pairs, texts, threshold))
    first = components(links)

    of = members.join(first.withColumnRenamed("u", "t"), "t", "left").withColumn("c", F.coalesce("c", "t"))
    of = materialize(of.select("t", "band", "b", "c"))
    # of each bucket left in several classes, the largest class is only compared with the rest
    every = of.groupBy("b", "c").agg(F.count("*").alias("n")).groupBy("b")
    left = materialize(every.agg(F.max(F.struct("n", "c")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("classes")).where("classes > 1"))
    blocks = left.select(
        "b",
        F.col("top.c").alias("main"),
        (F.col("n") > SMALL).alias("large"),
        F.when(F.col("n") > BLOCK, F.ceil((F.col("n") - F.col("top.n")) / BLOCK)).otherwise(1).cast("int").alias("rest"),
        F.when(F.col("n") > BLOCK, F.ceil(F.col("top.n") / BLOCK)).otherwise(0).cast("int").alias("more"),
    )
    # a text's copies from different tasks have the same sketch and bands
    sketches = signed.join(of.join(left, "b", "left_semi").select("t").distinct(), "t", "left_semi").select("t", "sketch", "bands").dropDuplicates(["t"])
    fine = _fine(texts.join(of.join(left.where(F.col("n") > SMALL), "b", "left_semi").select("t").distinct(), "t", "left_semi"))
    in_main = (F.col("c") == F.col("main")) & (F.col("more") > 0)
    own = F.when(in_main, F.col("rest") + F.pmod(F.xxhash64("t"), F.col("more"))).otherwise(F.pmod(F.xxhash64("t"), F.col("rest")))
    dealt = of.join(blocks, "b").withColumn("own", own.cast("int")).join(sketches, "t").join(fine, "t", "left")
    last = F.when(in_main, F.col("rest")).otherwise(F.col("rest") + F.col("more")) - 1
    met = dealt.select("*", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    met = met.select("b", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "t", "c", "sketch", "bands", "band", F.when(F.col("large"), F.col("fine")).alias("fine"))
    more = met.repartition("b", "i", "j").sortWithinPartitions("b", "i", "j").mapInArrow(lambda it: _across(it, threshold), "u long, v long").distinct()
    known = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    second = materialize(_linked(materialize(more.join(known, ["u", "v"], "left_anti")), texts, threshold))
    return components(first.toDF("u", "v").union(second)).toDF("t", "c")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per text hash t (and t2, null but where t has collided): class_id, class_size, first (the t of the row kept)."""
    rows = _with_hashes(docs, "doc_id")
    classes = near_classes(rows.select("t", "text"), threshold)
    ids = rows.select("doc_id", "t", "t2").groupBy("doc_id", "t", "t2").agg(F.count("*").alias("n"))
    equal = ids.groupBy("t").agg(F.min("t2").alias("low"), F.max("t2").alias("high"), F.min("doc_id").alias("least"), F.sum("n").alias("n"))
    clashing = F.col("low") != F.col("high")
    equal = materialize(equal.join(classes, "t", "left").withColumn("c", F.when(~clashing, F.coalesce("c", "t"))))
    size = equal.where(F.col("c").isNotNull()).groupBy("c").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"), F.min(F.struct(F.col("least").isNull(), "least", "t")).alias("first"))
    known = equal.join(size, "c").select("t", "class_id", "class_size", F.col("first.t").alias("first"))
    alone = ids.join(equal.where(clashing).select("t"), "t", "left_semi").groupBy("t", "t2").agg(F.min("doc_id").alias("own_id"), F.sum("n").alias("own_size"))
    return materialize(known.join(alone, "t", "full").select("t", "t2", F.coalesce("class_id", "own_id").alias("class_id"), F.coalesce("class_size", "own_size").alias("class_size"), F.coalesce("first", "t").alias("first")))


def near_dedup_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, class_id, class_size (rows of the class)."""
    rows = pick(docs, "doc_id", "text")
    table_ = near_duplicates(docs, threshold).withColumnsRenamed({"t": "c_t", "t2": "c_t2"})
    own = _with_hashes(rows, "doc_id").select("doc_id", "t", "t2")
    fits = (F.col("t") == F.col("c_t")) & (F.col("c_t2").isNull() | (F.col("c_t2") == F.col("t2")))
    return own.join(table_, fits).select("doc_id", "class_id", "class_size")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, with one row of each class: the one of least doc_id."""
    columns = docs.columns
    at = [f"_{i}" for i in range(len(columns))]
    plain = docs.toDF(*at)
    text, doc_id = at[columns.index("text")], at[columns.index("doc_id")]
    filled = F.coalesce(text, F.lit(""))
    rows = plain.withColumns({"t": F.xxhash64(filled), "t2": F.xxhash64(F.lit(1), filled)})
    several = near_duplicates(docs, threshold).where("class_size > 1").withColumnsRenamed({"t": "c_t", "t2": "c_t2"})
    bits = bitmap(several.select("c_t"))

    def told(yes: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(bits.has(b.column("t").to_numpy()) == yes))

        return run

    single = rows.mapInArrow(told(False), rows.schema)
    fits = (F.col("t") == F.col("c_t")) & (F.col("c_t2").isNull() | (F.col("c_t2") == F.col("t2")))
    held = rows.mapInArrow(told(True), rows.schema).join(several, fits, "left")
    first = held.where(F.col("c_t").isNotNull() & (F.col("t") == F.col("first")) & F.col(doc_id).eqNullSafe(F.col("class_id"))).dropDuplicates(["t", "t2"])
    out = single.select(*at).union(held.where(F.col("c_t").isNull()).select(*at)).union(first.select(*at))
    return out.toDF(*columns)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup_classes(table(spark, sf_dir, "documents"))
