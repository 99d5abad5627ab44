"""Mixing sources to target weights by pivotal dependent rounding. DataFrame operations only.

Every document of a source has the same expected number of copies, target / size of the source. Its whole part is
taken for sure; the fractional parts are rounded by a tournament: documents meet in blocks of about `FAN`, the one still
undecided meets the next, mass moves between the two (weighted by their sizes, so that the block's expected words stay as
they are) until one of them is 0 or 1, and each block's last undecided document goes on to the next level. One document a
source is undecided in the end and is rounded to the nearer value, so a source's words differ from its target by at most
half a document.

Null text counts 0 words and is never taken for any; a null source is a source of its own, the last. Repeated rows (equal
id, source and text) are documents of their own: of m such rows with fraction p, floor(m p) get one copy more for sure, and one
row with the rest of the fraction meets other documents. Which of the equal rows that are is arbitrary, so they are counted,
not ranked. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, Scratch, real_id, row_key

WEIGHTS = (5, 2, 1)
FAN = 32
#: So many equal rows are made from one row of counts at once.
CHUNK = 4096


def sized(df: DataFrame) -> DataFrame:
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), SPACE), lambda w: w != "")).cast("long")
    return df.select(*row_key("source"), "doc_id", "source", words.alias("size"))


def targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target): `share` of all words by weight, no source above `most` times its size.

    What a full source can't take goes to the others by weight, until none is above. That is a common level
    (words per weight) that full sources don't reach: the first source, by its room per weight, that is above the level
    the sources before it leave, sets the level. The windows are over one row a source.
    """
    per = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), nth + 1).cast("double"))
    room = Window.orderBy("room", F.col("source").asc_nulls_last())
    before = room.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy(F.lit(1))
    per = per.withColumn("room", most * F.col("source_size") / F.col("weight"))
    level = (share * F.sum("source_size").over(everyone) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (
        F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    per = per.withColumn("level", level)
    common = F.min(F.when(F.col("room") > F.col("level"), F.struct("room", "level"))).over(everyone)["level"]
    target = F.least(most * F.col("source_size"), F.coalesce(common * F.col("weight"), most * F.col("source_size")))
    return per.select(F.col("source").alias("of"), "source_size", target.alias("target"))


def _unit(seed: int, *cols: str) -> Column:
    """A number in [0, 1) that depends on the seed and the row only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


def _meet(a: Column, x: Column) -> tuple[Column, Column, Column, Column]:
    """Pivotal step of a (undecided so far) and x: (a is decided, its value or x's, residual's p if a stays, if x stays)."""
    rise = F.least((1 - a["p"]) * a["s"], x["p"] * x["s"])
    fall = F.least(a["p"] * a["s"], (1 - x["p"]) * x["s"])
    up = x["u"] * (rise + fall) < fall
    a_full = (1 - a["p"]) * a["s"] <= x["p"] * x["s"]
    a_void = a["p"] * a["s"] <= (1 - x["p"]) * x["s"]
    decided_a = F.when(up, a_full).otherwise(a_void)
    value = F.when(up, F.when(a_full, 1).otherwise(0)).otherwise(F.when(a_void, 0).otherwise(1))
    p_a = a["p"] + F.when(up, rise).otherwise(-fall) / a["s"]
    p_x = x["p"] - F.when(up, rise).otherwise(-fall) / x["s"]
    bound = lambda p: F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
    return decided_a, value, bound(p_a), bound(p_x)


def _level(rows: DataFrame, seed: int) -> DataFrame:
    """One level: rows (source, b, n, k1, k2, s, p) to blocks; `done` has the decisions, `left` the undecided one."""
    item = F.struct(F.xxhash64(F.lit(seed), "k1", "k2").alias("o"), "k1", "k2", "s", "p", _unit(seed + 1, "k1", "k2").alias("u"))
    met = rows.groupBy("source", "b", "n").agg(F.sort_array(F.collect_list(item)).alias("items"))
    none = F.slice(F.transform("items", lambda i: F.struct(i["k1"].alias("k1"), i["k2"].alias("k2"), F.lit(0).alias("x"))), 1, 0)

    def step(acc: Column, x: Column) -> Column:
        a = acc["a"]
        decided_a, value, p_a, p_x = _meet(a, x)
        done = F.struct(F.when(decided_a, a["k1"]).otherwise(x["k1"]).alias("k1"), F.when(decided_a, a["k2"]).otherwise(x["k2"]).alias("k2"), value.alias("x"))
        rest = F.struct(*[F.when(decided_a, x[c]).otherwise(a[c]).alias(c) for c in ("o", "k1", "k2", "s")], F.when(decided_a, p_x).otherwise(p_a).alias("p"), x["u"].alias("u"))
        return F.struct(rest.alias("a"), F.concat(acc["done"], F.array(done)).alias("done"))

    start = F.struct(F.element_at("items", 1).alias("a"), none.alias("done"))
    return met.select("source", "n", F.aggregate(F.slice("items", 2, F.greatest(F.size("items") - 1, F.lit(0))), start, step).alias("r"))


def choose(docs: DataFrame, per: DataFrame, scratch: Scratch, seed: int = 7) -> DataFrame:
    """(k1, k2, source, size, m, whole, extra): m equal rows get `whole` copies each, and `extra` of them one more."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = (
        docs.join(per, F.col("source").eqNullSafe(F.col("of")), "left")
        .select("k1", "k2", "source", "size", rate.alias("rate"))
        .groupBy("k1", "k2", "source", "rate").agg(F.max("size").alias("size"), F.count("*").alias("m"))
        .withColumns({"whole": F.floor("rate").cast("int"), "s": F.col("size").cast("double"), "due": F.col("m") * (F.col("rate") - F.floor("rate"))})
        .select("k1", "k2", "source", "size", "m", "whole", "s", F.floor("due").alias("sure"), (F.col("due") - F.floor("due")).alias("p"))
    )
    units = scratch.save(units, "units")
    rows = units.where((F.col("p") > 0) & (F.col("s") > 0)).select("source", "k1", "k2", "s", "p")
    n = rows.groupBy(F.col("source").alias("of")).agg(F.count("*").alias("n"))
    most = n.agg(F.max("n")).first()[0] or 0
    rows = rows.join(n, F.col("source").eqNullSafe(F.col("of"))).select("source", "k1", "k2", "s", "p", "n")
    decided, level = [], 0
    while most > 0:
        blocks = F.ceil(F.col("n") / FAN).cast("long")
        rows = rows.withColumn("n", blocks).withColumn("b", F.pmod(F.xxhash64(F.lit(seed + 10 * level), "k1", "k2"), "n"))
        met = scratch.save(_level(rows, seed + 10 * level + 3), f"level{level}")
        decided.append(met.select(F.inline("r.done")))
        rest = met.select("source", "n", "r.a.k1", "r.a.k2", "r.a.s", "r.a.p")
        if most <= FAN:
            decided.append(rest.select("k1", "k2", (F.col("p") >= 0.5).cast("int").alias("x")))
            break
        # a source down to one block is finished; the others' undecided documents go on
        rest_done = rest.where("n = 1").select("k1", "k2", (F.col("p") >= 0.5).cast("int").alias("x"))
        decided.append(rest_done)
        rows, most, level = rest.where("n > 1").select("source", "k1", "k2", "s", "p", "n"), -(-most // FAN), level + 1
    out = units.select("k1", "k2", "source", "size", "m", "whole", "sure")
    if decided:
        extra = decided[0]
        for d in decided[1:]:
            extra = extra.unionByName(d)
        out = out.join(extra, ["k1", "k2"], "left")
    else:
        out = out.withColumn("x", F.lit(0))
    return scratch.save(out.withColumn("extra", F.col("sure") + F.coalesce("x", F.lit(0))).drop("sure", "x"), "chosen")


def mix(spark: SparkSession, df: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per input row, made from the counts of equal rows."""
    scratch = Scratch(spark, "mix")
    docs = scratch.save(sized(df), "sized")
    per = targets(docs)
    chosen = choose(docs, per, scratch, seed)
    rows = chosen.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(m - 1) div {CHUNK}"))))
    if (chosen.agg(F.max("m")).first()[0] or 0) > CHUNK:
        rows = rows.repartition("k1", "k2", "chunk")  # a hot row's equals are made in many tasks
    first = F.col("chunk") * CHUNK
    rows = rows.withColumn("j", F.explode(F.sequence(first, F.least(first + CHUNK, F.col("m")) - 1)))
    out = rows.join(per, F.col("source").eqNullSafe(F.col("of")), "left")
    taken = F.col("size") * (F.col("whole") + (F.col("j") < F.col("extra")).cast("int"))
    return out.select(real_id().alias("doc_id"), "size", "source_size", "target", taken.cast("long").alias("taken"))


def _placed(named: DataFrame, scratch: Scratch) -> DataFrame:
    """named with `__j`, the number of a row among its equals from 0: its place in its part of the table and the equals in parts before."""
    rows = scratch.save(named.withColumn("__m", F.monotonically_increasing_id()), "rows")
    part = F.shiftright("__m", 33).alias("__part")
    many = scratch.save(rows.groupBy("__k1", "__k2").agg(F.count("*").alias("n")).where("n > 1").select("__k1", "__k2"), "many")
    equal = rows.select("__k1", "__k2", "__m", part).join(many, ["__k1", "__k2"])
    here = equal.groupBy("__k1", "__k2", "__part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("__k1", "__k2").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    start = here.select("__k1", "__k2", "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = equal.withColumn("r", F.row_number().over(Window.partitionBy("__k1", "__k2", "__part").orderBy("__m")) - 1)
    place = scratch.save(own.join(start, ["__k1", "__k2", "__part"]).select("__m", (F.col("start") + F.col("r")).alias("__j")), "places")
    return rows.join(place, "__m", "left").withColumn("__j", F.coalesce("__j", F.lit(0))).drop("__m")


def mixed(spark: SparkSession, df: DataFrame, seed: int = 7) -> DataFrame:
    """The documents as the mix takes them: each row as often as it was chosen, numbered by `copy` from 1.

    The result's `copy` takes the place of a column of that name in the input.
    """
    scratch = Scratch(spark, "mixed")
    docs = scratch.save(sized(df), "sized")
    chosen = choose(docs, targets(docs), scratch, seed)
    kept = [c for c in df.columns if c not in ("copy", "__k1", "__k2", "__n", "__j", "__m")]
    k1, k2 = row_key("source")
    named = df.select(*kept, k1.alias("__k1"), k2.alias("__k2"))
    named = _placed(named, scratch) if (chosen.agg(F.max("m")).first()[0] or 0) > 1 else named.withColumn("__j", F.lit(0))
    wanted = chosen.where("whole + extra > 0").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("whole").alias("__w"), F.col("extra").alias("__x"))
    rows = named.join(wanted, ["__k1", "__k2"]).withColumn("__n", F.col("__w") + (F.col("__j") < F.col("__x")).cast("int")).where("__n > 0")
    return rows.select(*kept, F.explode(F.sequence(F.lit(1), "__n")).alias("copy"))
