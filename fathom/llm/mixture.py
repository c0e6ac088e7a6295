"""Mixing sources to target weights, as DataFrame expressions throughout.

The words of a source are laid end to end and cut into blocks of BLOCK words (fewer for a source of under LEAST_BLOCKS such blocks).  The mix is a row of slots, each of which takes one block.
Every output shard of SHARD slots draws how many of its slots each source gets: one categorical draw a slot, so the counts of a shard
are multinomial.  Draws beyond a source's number of slots are dealt to the sources that are short, so totals meet the targets.  The k-th
slot of a source takes block P(k) of it, where P is a pseudorandom permutation; each further round through a source uses another one.

The permutation acts on a grid of a * b cells, the smallest near-square that holds all blocks: alternately one coordinate is shifted by a
hash of the other, which can be undone step by step.  Some of the cells stand for no block; slots that land there take nothing, and the
number of slots allows for them.

Targets: sources weigh 3, 1, 2 in turn by name in code point order, null last, and share ``share`` of all sizes; none goes above
CAP times its own size, and what is cut off goes to the others by weight.

Defined results: null and empty texts have size 0 and take 0; a source of size 0 has a target of 0; repeated rows are mixed as rows of
their own; an empty table gives no slots and no documents; texts of any length count whole; only the named columns are read; draws depend on the seed, the sources' sizes and the slot, never on partitioning or time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathom.llm.common import free_name
from fathom.plans.staging import Workspace

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BLOCK = 64
#: Blocks that a source has at least, if it has words enough.
LEAST_BLOCKS = 256
SHARD = 4096
SEED = 20240607
#: Rows that one task of a running sum holds, and runs that there are at least where rows suffice.
RUN_ROWS = 50_000
LEAST_RUNS = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """(source, source_size, weight, target) for (source, source_size), one row a source.

    With the sources ordered by cap over weight, those before some place stop at their cap and all others get the same multiple of
    their weight; running sums give that multiple at each place.  One task holds the list of sources, never their documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int"))).withColumn("cap", CAP * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, after, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    s = s.withColumns({"full": F.coalesce(F.sum("cap").over(before), F.lit(0)), "left": F.sum("weight").over(after), "all": F.sum("source_size").over(whole), "place": F.row_number().over(order)})
    s = s.withColumn("level", (share * F.col("all") - F.col("full")) / F.col("left"))
    # the first place at which the common multiple stays within the cap holds for all later ones
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))).over(whole)["level"])
    target = F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def permuted(k: Column, a: Column, b: Column, *salt: Column) -> Column:
    """Place of k in a permutation of 0 .. a * b - 1, another one for each salt."""
    x, y = F.round((k - F.pmod(k, b)) / b).cast("long"), F.pmod(k, b)
    for r in range(0, 4, 2):
        x = F.pmod(x + F.pmod(F.xxhash64(y, F.lit(SEED + r), *salt), a), a)
        y = F.pmod(y + F.pmod(F.xxhash64(x, F.lit(SEED + r + 1), *salt), b), b)
    return x * b + y


def laid_out(sized: DataFrame, runs: int) -> DataFrame:
    """``sized`` with ``off``: the words of the source before each document.

    Documents are dealt to ``runs`` runs by a hash of their id; a running sum goes over the runs of a source and another one inside each
    run, so that a source with a third of all rows is spread over as many tasks as any.
    """
    s = sized.withColumn("run", F.pmod(F.xxhash64("doc_id", "text_hash", "size"), F.lit(runs)))
    heads = s.groupBy("source_no", "run").agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("source_no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("base", F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n")
    inside = Window.partitionBy("source_no", "run").orderBy("doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return s.join(heads, ["source_no", "run"]).withColumn("off", (F.col("base") + F.col("inside")).cast("long")).drop("run", "base", "inside")


def draw(sources: DataFrame, total: int, shard: int, space: Workspace) -> DataFrame:
    """(slot, source_no, k): every slot's source, and its number among the slots of that source.

    ``sources(source_no, slots, first)``: slots to fill, and where the source starts in a row of all of them.
    """
    spark = sources.sparkSession
    cell = max(1, math.ceil(total / 4096))
    wide = sources.where("slots > 0").select("source_no", "slots", "first", F.explode(F.sequence(F.floor(F.col("first") / cell), F.floor((F.col("first") + F.col("slots") - 1) / cell))).alias("cell"))
    v = F.pmod(F.xxhash64("slot", F.lit(SEED)), F.lit(total))
    slots = spark.range(total).select(F.col("id").alias("slot")).withColumn("v", v).withColumn("cell", F.floor(F.col("v") / cell))
    drawn = slots.join(wide, "cell").where((F.col("v") >= F.col("first")) & (F.col("v") < F.col("first") + F.col("slots"))).select("slot", F.floor(F.col("slot") / shard).alias("shard"), "source_no")
    drawn = space.put("drawn", drawn)
    # the counts of the shards, and what each source has got in the shards before
    counts = space.put("counts", drawn.groupBy("source_no", "shard").agg(F.count("*").alias("n")))
    # in two steps, so that no task has all shards of a source
    counts = counts.withColumn("part", F.floor(F.col("shard") / RUN_ROWS))
    parts = counts.groupBy("source_no", "part").agg(F.sum("n").alias("whole"))
    upto = Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("whole").over(upto), F.lit(0))).drop("whole")
    inside = Window.partitionBy("source_no", "part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, ["source_no", "part"])
    counts = counts.select("source_no", "shard", "n", (F.col("before") + F.col("inside")).alias("base"))
    got = counts.groupBy("source_no").agg(F.sum("n").alias("got"))
    within = F.row_number().over(Window.partitionBy("shard", "source_no").orderBy("slot")) - 1
    numbered = drawn.withColumn("r", within).join(counts.drop("n"), ["source_no", "shard"]).select("slot", "source_no", (F.col("base") + F.col("r")).cast("long").alias("k"))
    # surplus draws, numbered through, go to the places that are still short, numbered through as well
    state = sources.join(got, "source_no", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    run = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    over, short = F.greatest(F.col("got") - F.col("slots"), F.lit(0)), F.greatest(F.col("slots") - F.col("got"), F.lit(0))
    state = state.withColumns({"over": over, "short": short}).withColumns({"over_at": F.coalesce(F.sum("over").over(run), F.lit(0)), "short_at": F.coalesce(F.sum("short").over(run), F.lit(0))})
    open_ = state.where("short > 0").select(F.col("source_no").alias("to_source"), "got", "short_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("short") - 1)).alias("j")).select("to_source", (F.col("got") + F.col("j")).alias("to_k"), (F.col("short_at") + F.col("j")).alias("e"))
    marked = numbered.join(state.select("source_no", "slots", "over_at"), "source_no").withColumn("e", F.when(F.col("k") >= F.col("slots"), F.col("over_at") + F.col("k") - F.col("slots")))
    moved = marked.where("e is not null").select("slot", "e").join(open_, "e").select("slot", F.col("to_source").alias("source_no"), F.col("to_k").alias("k"))
    return marked.where("e is null").select("slot", "source_no", "k").unionByName(moved)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, block: int = BLOCK, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(slots, documents).

    ``slots(slot, shard, source_no, round, block)`` is the mix itself, in order.  ``documents(doc_id, text_hash, source, size,
    source_size, target, taken)`` says how many words of each document it takes.
    """
    spark = docs.sparkSession
    space = Workspace(spark)
    sized = space.put("sizes", docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("text_hash")))
    rows = sized.count()
    plan = targets(sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), weights, share)
    # a small source has smaller blocks, so that its taken words come near its target
    plan = plan.withColumn("block_words", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("source_size") / LEAST_BLOCKS))).cast("long"))
    n = F.ceil(F.col("source_size") / F.col("block_words"))
    side = F.greatest(F.ceil(F.sqrt(n.cast("double"))), F.lit(1))
    plan = plan.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))).cast("long")).withColumn("b", F.greatest(F.ceil(n / side), F.lit(1)).cast("long")).withColumn("a", side.cast("long"))
    per_slot = F.col("source_size") / (F.col("a") * F.col("b"))
    fill = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") / per_slot), CAP * F.col("a") * F.col("b"))).otherwise(0).cast("long")
    plan = plan.withColumn("slots", fill)
    plan = space.put("sources", plan.withColumn("first", F.coalesce(F.sum("slots").over(Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")))
    total = plan.agg(F.sum("slots")).first()[0] or 0
    named = sized.join(plan, sized["source"].eqNullSafe(plan["source"])).select("doc_id", "text_hash", plan["source"], "size", "source_size", "target", "source_no", "block_words")
    if not total:
        empty = spark.createDataFrame([], "slot long, shard long, source_no long, round long, block long")
        return empty, named.select("doc_id", "text_hash", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    dealt = draw(plan.select("source_no", "slots", "first"), total, shard, space).join(plan.select("source_no", "a", "b"), "source_no")
    cells = F.col("a") * F.col("b")
    dealt = dealt.withColumn("round", F.floor(F.col("k") / cells)).withColumn("block", permuted(F.pmod("k", cells), F.col("a"), F.col("b"), F.col("source_no"), F.col("round")))
    slots = dealt.select("slot", F.floor(F.col("slot") / shard).alias("shard"), "source_no", "round", "block")
    taken = slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    placed = laid_out(named, max(1, math.ceil(rows / RUN_ROWS), min(LEAST_RUNS, rows // 100)))
    lo, hi = F.col("off"), F.col("off") + F.col("size")
    pieces = placed.where("size > 0").select("doc_id", "text_hash", "source", "size", "source_size", "target", "source_no", "off", "block_words", F.explode(F.sequence(F.floor(lo / F.col("block_words")), F.floor((hi - 1) / F.col("block_words")))).alias("block"))
    words = F.col("block_words")
    overlap = F.least(hi, (F.col("block") + 1) * words) - F.greatest(lo, F.col("block") * words)
    keys = ["doc_id", "text_hash", "source", "size", "source_size", "target"]
    got = pieces.join(taken, ["source_no", "block"], "left").groupBy(*keys, "source_no", "off").agg(F.sum(overlap * F.coalesce("times", F.lit(0))).cast("long").alias("taken"))
    return slots, got.select(*keys, "taken").unionByName(named.where("size = 0").select(*keys, F.lit(0).cast("long").alias("taken")))


def copies(taken: Column, size: Column, doc_id: Column) -> Column:
    """How often a document comes: taken over size, the fraction rounded up with its own probability, drawn from the id."""
    share = F.coalesce(taken / F.when(size > 0, size), F.lit(0.0))
    u = F.pmod(F.xxhash64(doc_id, F.lit(SEED + 99)), F.lit(1 << 40)) / float(1 << 40)
    return (F.floor(share) + F.when(u < share - F.floor(share), 1).otherwise(0)).cast("int")


def repeat_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """``docs`` as whole documents in the proportions of the mix; all columns stay, and a document comes 0, 1 or 2 times.

    Rows that repeat id and text come equally often; an id's other texts are counted by themselves.
    """
    _, found = mix(docs, doc_id, text, source, **how)
    key, hashed, times = free_name(docs.columns, "mixed_id"), free_name(docs.columns, "mixed_hash"), free_name(docs.columns, "times")
    per_text = found.groupBy(F.col("doc_id").alias(key), F.col("text_hash").alias(hashed)).agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    often = per_text.select(key, hashed, copies(F.col("taken"), F.col("size"), F.col(key)).alias(times)).where(F.col(times) > 0)
    out = docs.join(often, docs[doc_id].eqNullSafe(often[key]) & (F.xxhash64(docs[text]) == often[hashed]))
    return out.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(times))).alias(times)).select(*docs.columns)
