"""Mixing sources to target weights: water-filled targets, then pivotal rounding of copies in a reduction tree.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridscore.llm.rows import packed, unpacked
from gridscore.session import stored

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2, 42
#: Leaves, or residuals of the level below, that one node of the tree reduces.
FAN = 64
#: Repeats of a row, or copies of it, that are listed in one go; more are dealt out first.
LISTED = 1024
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, rows and target of each source of `sizes` (source, size, times: how often it has that size).

    Sources in code-point order, null last, weigh `weights` in turn and share `share` of all sizes; no target is above
    `most` times its source's size, and what is cut off is shared again by weight. The level at which
    sum(min(most * size, level * weight)) meets the whole is found among prefix sums in the order of most * size /
    weight. The windows see one row a source.
    """
    by = stored(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.sum("times").alias("rows")), "sources")
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = by.withColumn("_w", weight).withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    before = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    # the first source in this order whose level lies within its cap fixes the level for itself and all after it
    filled = ranked.withColumn("_level", level).withColumn("_fixed", F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), F.col("_level").alias("level")))).over(whole))
    target = F.when(F.col("_fixed").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_fixed.level") * F.col("_w")))
    return filled.select("source", "source_size", "rows", target.alias("target"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _uniform(*columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _item(x: Column, p: Column) -> Column:
    return F.struct(x["h"].alias("h"), x["key"].alias("key"), x["tie"].alias("tie"), x["size"].alias("size"), p.alias("p"))


def _pivot(acc: Column, x: Column) -> Column:
    """One step: words move between the open item of `acc` and x until one of them is whole; the other stays open.

    The chances of the two directions keep each expected number of copies, and the step keeps the sum of
    size x copies.
    """
    r = acc["open"]
    room = F.struct((r["size"] * (1 - r["p"])).alias("r_up"), (r["size"] * r["p"]).alias("r_down"), (x["size"] * (1 - x["p"])).alias("x_up"), (x["size"] * x["p"]).alias("x_down"))

    def step(m: Column) -> Column:
        up, down = F.least(m["r_up"], m["x_down"]), F.least(m["r_down"], m["x_up"])
        rises = _uniform(F.lit(SEED), r["h"], x["h"], r["size"], x["size"]) * (up + down) < down
        one, nought = F.lit(1.0), F.lit(0.0)
        first = F.when(rises, m["r_up"] <= m["x_down"]).otherwise(m["r_down"] <= m["x_up"])
        done = F.when(first, _item(r, F.when(rises, one).otherwise(nought))).otherwise(_item(x, F.when(rises, nought).otherwise(one)))
        still = F.when(first, _item(x, F.when(rises, x["p"] - up / x["size"]).otherwise(x["p"] + down / x["size"]))).otherwise(_item(r, F.when(rises, r["p"] + up / r["size"]).otherwise(r["p"] - down / r["size"])))
        return F.struct(F.array_append(acc["done"], done).alias("done"), still.alias("open"))

    return F.when(r.isNull(), F.struct(acc["done"].alias("done"), x.alias("open"))).otherwise(_let(room, step))


def _reduce(items: DataFrame, kind: str) -> DataFrame:
    """One level of the tree: source, node, done (items that are whole) and open (the residual) of each node."""
    start = F.struct(F.expr(f"cast(array() as array<{kind}>)").alias("done"), F.expr(f"cast(null as {kind})").alias("open"))
    grouped = items.groupBy("source", "node").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return grouped.select("source", "node", F.aggregate("items", start, _pivot).alias("acc")).select("source", "node", "acc.*")


def _numbered(groups: DataFrame, times: str) -> DataFrame:
    """Each row `times` times, numbered from 0 in `n`; what is repeated often is dealt over tasks first, in parts of LISTED.

    `groups` is read twice if it has such rows: it should be a stored table.
    """

    def listed(df: DataFrame, first: Column) -> DataFrame:
        last = F.least(F.col(times), first + LISTED) - 1
        return df.withColumn("n", F.explode(F.sequence(first.cast("long"), last.cast("long")))).drop("_part")

    often = groups.where(F.col(times) > LISTED)
    every = listed(groups.where(F.col(times).between(1, LISTED)), F.lit(0))
    if often.isEmpty():
        return every
    parts = often.withColumn("_part", F.explode(F.sequence(F.lit(0), F.floor((F.col(times) - 1) / LISTED))))
    tasks = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return every.unionByName(listed(parts.repartition(tasks, F.xxhash64(*[c for c in groups.columns if c != "row"], "_part")), F.col("_part") * LISTED))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", tie: Column | None = None) -> DataFrame:
    """key, source, size, source_size, target and copies of each row of df, and tie, if given; copies are whole, 0 to 2.

    A source's copies a row are target / source_size: its whole part everywhere, and its fraction rounded by pivotal
    steps. Rows are dealt by hash into leaves of about FAN rows, so one source's rows are spread however many it has;
    each node reduces its items to whole ones and one residual, and FAN nodes' residuals meet in the next level. So
    what a source takes differs from its target by half of one row's words at most, and one row is then flipped to close
    that gap as well as a row can. All chances come from hashes: reruns
    agree. Null texts and texts without words have size 0 and get the whole part only; a null source is a source; a
    null key is a key like others; rows that repeat a key (and size, and tie) are counted first, then numbered, and
    rounded one by one, each in a leaf by its number; an empty table gives no rows.
    """
    tied = F.lit(0) if tie is None else tie
    sized = df.select(df[key].alias("key"), df[source].alias("source"), words(df[text]).alias("size"), tied.alias("tie"))
    groups = stored(sized.groupBy("source", "key", "size", "tie").agg(F.count("*").alias("times")), "sizes")
    shares = stored(targets(groups), "targets")
    sized = _numbered(groups, "times")
    known = shares.withColumn("p", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))).withColumn("base", F.floor("p"))
    same = sized["source"].eqNullSafe(known["source"])
    rows = sized.join(known, same).select(sized["key"], sized["source"], "size", "tie", "n", (F.col("p") - F.col("base")).alias("f"), F.ceil(F.col("rows") / FAN).alias("leaves"))
    open_ = (F.col("f") > 0) & (F.col("size") > 0)
    h = F.xxhash64(F.lit(SEED), "key", "size", "tie", "n")
    item = F.struct(h.alias("h"), F.col("key"), F.col("tie"), F.col("size"), F.col("f").alias("p"))
    kinds = dict(sized.dtypes)
    kind = f"struct<h:bigint,key:{kinds['key']},tie:{kinds['tie']},size:bigint,p:double>"
    level = rows.where(open_).select("source", F.pmod(F.xxhash64(h), "leaves").alias("node"), item.alias("item"))
    whole = rows.where(~open_).select("source", "key", "tie", "size", F.lit(0).alias("extra"), F.expr("cast(null as struct<depth:int,node:bigint,at:int>)").alias("id"))
    taken = [whole]
    leaves, depth = (shares.agg(F.max("rows")).first()[0] or 0) / FAN, 0

    def items(found: DataFrame, at: Column, x: Column, copies: Column) -> DataFrame:
        return found.select("source", x["key"].alias("key"), x["tie"].alias("tie"), x["size"].alias("size"), copies.cast("int").alias("extra"), F.struct(F.lit(depth).alias("depth"), F.col("node").cast("long").alias("node"), at.alias("at")).alias("id"))

    while True:
        level = stored(_reduce(level, kind), "level")
        taken.append(items(level.select("source", "node", F.posexplode("done").alias("at", "x")), F.col("at"), F.col("x"), F.col("x.p")))
        if leaves <= 1:
            break
        level = level.select("source", F.floor(F.col("node") / FAN).alias("node"), F.col("open").alias("item"))
        leaves, depth = leaves / FAN, depth + 1
    taken.append(items(level.where("open is not null"), F.lit(-1), F.col("open"), F.round("open.p")))
    every = reduce(DataFrame.unionByName, taken)
    # the last residual's rounding leaves a gap; the one row whose size fits it best gives or takes a copy
    known = shares.withColumn("base", F.floor(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))).alias("k")
    gaps = every.groupBy("source").agg(F.sum(F.col("size") * F.col("extra")).alias("sum")).alias("g")
    gaps = stored(known.join(gaps, F.expr("k.source <=> g.source")).select("k.*", (F.col("target") - F.col("base") * F.col("source_size") - F.col("sum")).alias("gap")), "gaps")
    off = F.abs(F.abs("gap") - F.col("size"))
    fits = F.col("id").isNotNull() & (F.col("extra") == (F.col("gap") < 0).cast("int")) & (off < F.abs("gap"))
    best = every.alias("e").join(gaps.alias("g"), F.expr("e.source <=> g.source")).where(fits).groupBy("g.source").agg(F.min(F.struct(off.alias("off"), F.col("size"), F.col("id"))).alias("best"))
    final = stored(gaps.alias("g").join(best.alias("b"), F.expr("g.source <=> b.source"), "left").select("g.*", "b.best.id"), "final").alias("f")
    extra = F.when(F.col("e.id") == F.col("f.id"), 1 - F.col("extra")).otherwise(F.col("extra"))
    named = [F.col("key").alias(key), F.col("e.source").alias("source"), F.col("size"), F.col("source_size"), F.col("target"), (F.col("base") + extra).cast("int").alias("copies")]
    return every.alias("e").join(final, F.expr("e.source <=> f.source")).select(*named, *([] if tie is None else ["tie"]))


def mixed(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of df, each as often as the mix takes it; columns unchanged.

    Rows that agree in all columns are alike, so one of them stands for all and is taken as often as they are together;
    rows that differ anywhere are told apart by a hash of 128 bits over all columns but maps. Texts are shuffled once.
    """
    whole = [c for f in df.schema.fields if "map<" not in f.dataType.simpleString() for c in (df[f.name].isNull(), df[f.name])]
    tie = F.struct(F.xxhash64(F.lit(0), *whole).alias("a"), F.xxhash64(F.lit(1), *whole).alias("b"))
    parts = F.transform(F.array(tie), lambda t: F.struct(t["a"], t["b"]))[0]
    taken = mix(df, key, text, source, parts).groupBy("tie").agg(F.sum("copies").alias("times"))
    taken = stored(taken.where("times > 0").select(F.col("tie.a").alias("a"), F.col("tie.b").alias("b"), "times"), "taken")
    rows = df.select(packed(df).alias("row"), tie["a"].alias("a"), tie["b"].alias("b")).dropDuplicates(["a", "b"])
    often = taken.where(F.col("times") > LISTED)
    copies = F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))
    kept = rows.join(taken.where(F.col("times") <= LISTED), ["a", "b"]).withColumn("copy", copies).select("row")
    if not often.isEmpty():
        kept = kept.unionByName(_numbered(stored(rows.join(often, ["a", "b"]), "often"), "times").select("row"))
    return kept.select(*unpacked(df.columns))
