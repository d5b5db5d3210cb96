"""Mixing sources to target weights by entropy balancing.

Document rates stay as close to 1 in relative entropy as the token constraints allow: sum of rate * size = target for
each source, rate <= ``most``. The dual is convex and splits by source; its solution is rate = min(most, exp(x * size /
mean size)), with one multiplier x a source, found by Newton steps whose sums are taken over a table of (source, size,
documents). The rates are then rounded into whole copies.
"""

from __future__ import annotations

import math
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import WORD, Stored, few, pick, release

#: Documents of a source that are rounded together, about, and equal rows that are one row on the way there.
ROUNDED = 2_000
#: Sources up to which their table is broadcast.
BROADCAST = 100_000


def targets(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of the total by weight, none above ``most`` times its source's size; what is cut off is dealt to the others by weight."""
    total, out, free = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while free:
        weight = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / weight > most * sizes[i]}
        if not over:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        free -= over
    return out


def rate(size, x, mean, most):
    """Column of the tilted rate; an exponent beyond the limit is the limit."""
    return F.least(F.lit(float(most)), F.exp(F.least(x * size / mean, F.lit(math.log(most)))))


def sized(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, source, size, place (a hash that orders equals), row: slim rows, from one scan of the texts."""
    rows = pick(docs, "doc_id", "text", "source", *([row] if row else []))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    number = F.col(row) if row else F.lit(None)
    return rows.select(F.col("doc_id").cast("bigint"), F.col("source"), size.alias("size"), F.xxhash64("doc_id", "text").alias("place"), number.cast("bigint").alias("row"))


def solve(counted: DataFrame, plan: dict, most: float, tolerance: float, rounds: int) -> dict:
    """Multiplier of each source. ``plan``: source -> (mean size, target). Each round is one aggregate over ``counted``."""
    spark = counted.sparkSession
    cap = {s: math.isclose(t, most * m * n) for s, (m, t, n) in plan.items()}
    x, low, high = ({s: v for s in plan} for v in (0.0, -math.inf, math.inf))
    for _ in range(rounds):
        open_ = [s for s in plan if not cap[s]]
        if not open_:
            break
        now = spark.createDataFrame([(s, x[s], plan[s][0]) for s in open_], "source string, x double, mean double")
        w = rate(F.col("size"), F.col("x"), F.col("mean"), most)
        inner = F.when(w < most, w * F.col("size") * F.col("size") / F.col("mean")).otherwise(0.0)
        now = F.broadcast(now) if len(open_) <= BROADCAST else now
        terms = counted.join(now, counted.source.eqNullSafe(now.source)).select(now.source, (w * F.col("size") * F.col("n")).alias("g"), (inner * F.col("n")).alias("h"))
        worst = 0.0
        for s, g, h in terms.groupBy("source").agg(F.sum("g"), F.sum("h")).collect():
            gap = plan[s][1] - g
            if abs(gap) < tolerance * plan[s][1]:
                continue
            worst = max(worst, abs(gap))
            (low if gap > 0 else high)[s] = x[s]
            step = x[s] + gap / h if h > 0 else math.inf
            if not low[s] < step < high[s]:  # outside the bracket: halve it, or widen it while it is open
                step = (low[s] + high[s]) / 2 if math.isfinite(low[s] + high[s]) else x[s] + math.copysign(1 + abs(x[s]), gap)
            x[s] = step
        if not worst:
            break
    return {s: math.inf if cap[s] else round(x[s], 9) for s in plan}  # the order of a sum must not show


def rounded(most: int):
    """Rounds the rates of the documents of one bucket: from the largest size down, what rounding gains or loses is carried on.

    A row stands for ``many`` equal documents, each of which gets ``copies``, ``extra`` of them one more.
    """

    def run(rows: pa.Table) -> pa.Table:
        release()
        rows = rows.sort_by([("size", "descending"), *((c, "ascending") for c in ("place", "doc_id", "piece", "row"))])
        carry, copies, extra = 0.0, [], []
        for size, rate_, many in zip(rows["size"].to_pylist(), rows["rate"].to_pylist(), rows["many"].to_pylist()):
            n = min(most * many, max(0, math.floor(rate_ * many + (carry / size if size else 0.0) + 0.5)))
            carry += size * (rate_ * many - n)
            copies.append(n // many)
            extra.append(n % many)
        kept = rows.select(["doc_id", "source", "place", "row", "size", "source_size", "target", "many"])
        return kept.append_column("copies", pa.array(copies, pa.int32())).append_column("extra", pa.array(extra, pa.int32()))

    return run


def pieces(slim: DataFrame, row: str | None) -> DataFrame:
    """The rows of ``sized``, with the number of equal ones that each stands for (many, ROUNDED at most) and a number among them (piece).

    So a group of equal rows, however large, is dealt to many buckets. Rows that have numbers of their own stay apart:
    there only those of a group beyond ROUNDED are dealt, by their numbers.
    """
    if row is None:
        grouped = slim.groupBy("doc_id", "source", "size", "place").agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("bigint").alias("row"))
        cut = grouped.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / ROUNDED).cast("int"))))
        return cut.withColumn("many", F.least(F.lit(ROUNDED), F.col("n") - F.col("piece") * ROUNDED).cast("int")).drop("n")
    hot = few(slim.groupBy(F.col("place").alias("hot")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ROUNDED))
    told = slim.join(hot, F.col("place") == F.col("hot"), "left")
    piece = F.coalesce(F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / ROUNDED)), F.lit(0)).cast("int")
    return told.withColumns({"piece": piece, "many": F.lit(1)}).drop("hot", "n")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, tolerance: float = 1e-5, rounds: int = 60, row: str | None = None) -> DataFrame:
    """Copies of each document: doc_id, source, place, row, size, source_size, target, rate's rounding ``copies``, taken.

    Sources in code point order, null last, get ``weights`` in turn and share the total of all sizes; see ``targets``.
    taken = copies * size. One row for each row of ``docs``; a null or empty text has size 0, and its copies don't count
    towards any target. Sources without a word have target 0. Repeated rows and null ids stay. What comes to the driver
    is one row for each source, which weights are set for one by one. Documents of a source are rounded in buckets
    of about ROUNDED, dealt by the hash of id and text; so a hot source is spread, and reruns agree. ``row`` names a
    column of row numbers, if there is one; it goes along. An empty table gives no rows; other columns are ignored.
    """
    slim = Stored(sized(docs, row))
    counted = Stored(slim.df.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    sums = counted.df.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("total"), F.sum("n").alias("rows")).collect()
    sums.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    goal = targets([r["total"] for r in sums], [weights[i % len(weights)] for i in range(len(sums))], most)
    plan = {r["source"]: (r["total"] / r["rows"], t, r["rows"]) for r, t in zip(sums, goal) if r["total"]}
    x = solve(counted.df, plan, most, tolerance, rounds)
    counted.drop()
    terms = [(r["source"], r["total"], t, x.get(r["source"], 0.0), max(r["total"] / r["rows"], 1e-9), math.ceil(r["rows"] / ROUNDED)) for r, t in zip(sums, goal)]
    known = docs.sparkSession.createDataFrame(terms, "of string, source_size bigint, target double, x double, mean double, buckets int")
    side = F.broadcast(known) if len(terms) <= BROADCAST else known
    cut = pieces(slim.df, row)
    rows = cut.join(side, cut.source.eqNullSafe(known.of))
    tilt = F.when(F.col("x") == float("inf"), float(most)).otherwise(rate(F.col("size"), F.col("x"), F.col("mean"), most))
    rows = rows.withColumns({"rate": F.when(F.col("size") > 0, tilt).otherwise(1.0), "bucket": F.pmod(F.xxhash64("place", "piece"), F.col("buckets"))})
    schema = "doc_id bigint, source string, place bigint, row bigint, size bigint, source_size bigint, target double, many int, copies int, extra int"
    made = rows.select("doc_id", "source", "place", "row", "size", "source_size", "target", "rate", "bucket", "piece", "many").groupBy("source", "bucket").applyInArrow(rounded(most), schema)
    made = made.withColumn("number", F.explode(F.sequence(F.lit(1), "many"))).withColumn("copies", F.col("copies") + (F.col("number") <= F.col("extra")).cast("int"))
    return made.select("doc_id", "source", "place", "row", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, columns: list[str], **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as ``mix`` takes it, with ``columns``.

    The rows are written once under numbers, by which their copies are found again; so equal rows are told apart, and
    the join is by a key that no two rows share. Texts without a word stay once; null ids and sources stay as they are;
    a document of any length is written as often as it is taken; an empty table gives no rows.
    """
    known = pick(docs, *dict.fromkeys([*columns, "doc_id", "text", "source"])).withColumn("row_", F.monotonically_increasing_id())
    rows = Stored(known)
    made = Stored(mix(rows.df, row="row_", **options).where("copies > 0").select(F.col("row").alias("row_"), "copies"))
    out = rows.df.join(few(made.df), "row_").withColumn("again_", F.explode(F.sequence(F.lit(1), "copies")))
    return out.select(*columns)
