"""Mixing sources to target weights by Pfair scheduling (DataFrame functions only).

Rows of a source are shuffled by a seeded digest and grouped into blocks; a slot of time takes one block. Each source
is to get blocks in proportion to its weight until it runs out; then those that are left share all slots, in proportion
to theirs: a phase for each source that runs out. Phases are cut into epochs of ``period`` slots (the last one of the rest). In each epoch
every source has an integer share: the growth of its target over the epoch, rounded so that shares add up to
the slots and that at the ends of all epochs every source is less than one block from its exact target (floor(p) -
floor(p'), p and p' the sums of the targets with and without it). With share a of A slots, block k may run from
slot floor(k A / a) and must run before slot ceil((k + 1) A / a). Earliest-deadline-first over the epoch meets every
window, so inside an epoch a source is less than one block from its share's line. Against the exact target that is
less than one block wherever the targets at the epochs' ends are integers, and less than two elsewhere, however long
the mixture is and in all phases. Only a phase in which some source would get less than one block has no epoch of its
own: it is the first part of the next one, in which sources can be some blocks from their exact targets. An epoch is one row: epochs are scheduled side by side.

A source whose weight gives it less than one block in ``period`` slots shares one lane with all others of that kind;
inside the lane their blocks go by ideal time, (k + 1/2) / weight. Any number of sources is taken so. Where that
lane as a whole would get less, its blocks come after all others.

Defined results: every row is placed exactly once; a null source is a source of its own; a source without
a target, or with one of zero or below, comes after all others; ``exact`` tells the rows of scheduled
epochs, the others have no slot, release or deadline. The shuffle is by id and text, so that rows without an id or
of one id are mixed like all others; identical rows are interchangeable. Extra columns are not read. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import broadcast_if_small, key_of, materialise, rank_in_group, rank_overall

#: The weight of a source without a target, as a part of all weights.
NEARLY_NOTHING = 1e-12


def identity(docs: DataFrame) -> Column:
    """With doc_id what tells rows apart: a hash of the text, if there is one."""
    return F.xxhash64(docs["text"]) if "text" in docs.columns else F.lit(0).cast("long")


def targets(ranked: DataFrame, weights: Mapping[str, float] | Column | None, flatten: float) -> DataFrame:
    """_source, _blocks, _w (adds up to one) and _aimed (whether there is a target) of every source; one row each."""
    sizes = ranked.groupBy("_source").agg((F.max("_block") + 1).alias("_blocks"), F.max("_of").alias("_of"), F.max("_weight").alias("_weight"))
    if weights is None:
        weight = F.pow(F.col("_of").cast("double"), F.lit(flatten))
    elif isinstance(weights, Column):
        weight = F.col("_weight")
    else:
        given = [F.lit(x) for name, w in weights.items() for x in (f"={name}", float(w))]
        weight = F.create_map(*given)[F.col("_source")] if given else F.lit(0.0)
    weighed = sizes.select("_source", "_blocks", F.greatest(F.coalesce(weight, F.lit(0.0)), F.lit(0.0)).alias("_raw"))
    whole = weighed.agg(F.sum("_raw").alias("_sum"))  # one row
    part = F.coalesce(F.try_divide("_raw", "_sum"), F.lit(0.0))
    shared = weighed.crossJoin(F.broadcast(whole))
    return shared.select("_source", "_blocks", F.greatest(part, F.lit(NEARLY_NOTHING)).alias("_w"), (part > 0).alias("_aimed"))


def epochs(lanes: DataFrame, period: int) -> DataFrame:
    """_epoch (its first slot), _length and the array _lanes of (lane, first, share) of every epoch.

    lanes: _lane, _blocks, _lw; at most ``period`` + 1 rows. In the order in which they run out, b and w are the sums
    of blocks and weights so far: when the lanes before m have run out and the others have had v blocks for each unit
    of weight, those up to i have had b(i) blocks, if i is before m, else b(m) + v (w(i) - w(m)).
    """
    order = Window.orderBy("_r", "_lane")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    part = lanes.withColumn("_lw", F.col("_lw") / F.sum("_lw").over(Window.partitionBy())).withColumn("_r", F.col("_blocks") / F.col("_lw"))
    part = part.withColumns({"_i": F.row_number().over(order), "_b": F.sum("_blocks").over(upto), "_w": F.sum("_lw").over(upto)})
    every = part.agg(
        F.sort_array(F.collect_list(F.struct("_i", "_lane", "_b", "_w", F.col("_blocks").alias("_n"), F.col("_lw").alias("_x")))).alias("_every"),
        F.max("_b").alias("_all"),
        F.max("_w").alias("_one"),
    )  # one row
    # In a phase of so many slots every lane that lasts through it gets a block.
    later = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    part = part.withColumn("_least", F.sum("_lw").over(later) / F.min("_lw").over(later) - 1e-6)
    ends = part.groupBy("_r").agg(F.max("_i").alias("m"), F.max("_b").alias("b"), F.max("_w").alias("w"), F.max("_least").alias("_least"))
    ends = ends.crossJoin(F.broadcast(every))
    # The slot at which the lanes up to m have run out, and v there; all lanes are left at slot 0.
    left = F.when(F.col("b") < F.col("_all"), F.col("_one") - F.col("w"))
    fluid = F.col("b") + F.coalesce(F.col("_r") * left, F.lit(0.0))
    ends = ends.withColumn("t", F.least(F.ceil(fluid - 1e-6), F.col("_all"))).withColumn("v", F.col("_r") + F.coalesce((F.col("t") - fluid) / left, F.lit(0.0)))
    along = Window.orderBy("_r")
    none = F.struct(F.lit(0).alias("m"), F.lit(0).cast("long").alias("b"), F.lit(0.0).alias("w"), F.lit(0).cast("long").alias("t"), F.lit(0.0).alias("v"))
    here = F.struct("m", "b", "w", "t", "v")
    phases = ends.withColumn("_before", F.coalesce(F.lag(here).over(along), none))
    length = F.col("t") - F.col("_before.t")
    phases = phases.withColumn("_kept", (length >= F.col("_least")) | (F.col("t") == F.col("_all")))
    last_kept = F.last(F.when(F.col("_kept"), here), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    cut = phases.withColumn("_from", F.coalesce(last_kept, none)).filter("_kept").withColumn("_n", F.greatest(F.lit(1), F.floor(length / period) + (length % period >= F.col("_least")).cast("int")))
    cut = cut.withColumn("_e", F.explode(F.expr("sequence(0L, cast(_n as bigint) - 1)")))

    def inside(e: Column) -> Column:
        """What is known at the end of the e-th period of a phase."""
        p = F.col("_before")
        return F.struct(p["m"].alias("m"), p["b"].alias("b"), p["w"].alias("w"), (p["t"] + e * period).alias("t"), (p["v"] + e * period / (F.col("_one") - p["w"])).alias("v"))

    cut = cut.select("_every", F.when(F.col("_e") == 0, F.col("_from")).otherwise(inside(F.col("_e"))).alias("p"), F.when(F.col("_e") == F.col("_n") - 1, here).otherwise(inside(F.col("_e") + 1)).alias("q"))

    def had(at: Column, lane: Column) -> Column:
        def upto(i: Column, b: Column, w: Column) -> Column:
            sum_ = F.when(i <= at["m"], b.cast("double")).otherwise(at["b"] + at["v"] * (w - at["w"]))
            return F.floor(sum_ + 1e-5)

        return upto(lane["_i"], lane["_b"], lane["_w"]) - upto(lane["_i"] - 1, lane["_b"] - lane["_n"], lane["_w"] - lane["_x"])

    one = lambda x: F.struct(x["_lane"].alias("_lane"), had(F.col("p"), x).alias("first"), (had(F.col("q"), x) - had(F.col("p"), x)).alias("share"))
    made = cut.filter("q.t > p.t").select(F.col("p.t").alias("_epoch"), (F.col("q.t") - F.col("p.t")).alias("_length"), F.transform("_every", one).alias("_lanes"))
    return made.repartition("_epoch")


def schedule(found: DataFrame) -> DataFrame:
    """The earliest-deadline-first schedule of every epoch: _lane, _turn (the lane's block), slot, release, deadline."""
    # The eligible block (released by slot t) with the earliest deadline; ties go to the larger share, then the lane.
    pick = """
        element_at(array_sort(filter(
            transform(s, (x, i) -> named_struct(
                'deadline', ((acc.had[i] + 1) * a + x.share - 1) div x.share,
                'rest', -x.share, 'i', i, 'open', (acc.had[i] * a) div x.share <= t and acc.had[i] < x.share)),
            y -> y.open)), 1).i
    """
    # State: how many blocks each lane has had, and which lane and block each slot went to.
    step = """
        aggregate(
          sequence(0L, a - 1),
          named_struct('had', transform(s, x -> 0L), 'order', cast(array() as array<struct<i: int, k: bigint>>)),
          (acc, t) -> aggregate(
            array(PICK),
            acc,
            (old, p) -> named_struct(
              'had', transform(old.had, (h, i) -> h + if(i = p, 1, 0)),
              'order', concat(old.order, array(named_struct('i', p, 'k', old.had[p]))))))
    """.replace("PICK", pick)
    some = found.select("_epoch", F.col("_length").alias("a"), F.filter("_lanes", lambda x: x["share"] > 0).alias("s"))
    slots = some.select("_epoch", "a", "s", F.posexplode(F.expr(f"({step}).order")).alias("_at", "_o"))
    return slots.selectExpr(
        "s[_o.i]._lane AS _lane",
        "s[_o.i].first + _o.k AS _turn",
        "_epoch + _at AS slot",
        "_epoch + (_o.k * a) div s[_o.i].share AS release",
        "_epoch + ((_o.k + 1) * a + s[_o.i].share - 1) div s[_o.i].share AS deadline",
    )


def positions(
    docs: DataFrame,
    *,
    weights: Mapping[str, float] | Column | None = None,
    flatten: float = 0.7,
    block_rows: int = 16,
    period: int = 2000,
    seed: str = "mix-1",
    buckets: int = 4096,
) -> DataFrame:
    """The columns of ``mix`` and _all, the number of rows."""
    own = weights.cast("double") if isinstance(weights, Column) else F.lit(None).cast("double")
    rows = docs.select(
        "doc_id",
        "source",
        identity(docs).alias("_text"),
        key_of("source").alias("_source"),
        own.alias("_weight"),
    ).withColumn("_u", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("_text").cast("string"))))
    rows = rows.withColumn("_bucket", F.floor(F.conv(F.substring("_u", 1, 8), 16, 10).cast("double") / 2**32 * buckets).cast("int"))
    ranked = rank_in_group(rows, ["_source"], "_bucket", [F.col("_u"), F.col("doc_id"), F.col("_text")], "_rank", "_of")
    ranked = materialise(ranked.withColumn("_block", F.expr(f"_rank div {block_rows}")).drop("_bucket", "_u"))
    target = materialise(targets(ranked, weights, flatten).withColumn("_own", F.col("_aimed") & (F.col("_w") * period >= 1)))
    # Lanes by themselves are named by their source ('' or '=...'); the common lane is '~'.
    shared = materialise(
        target.filter("_aimed AND NOT _own").select("_source", "_w", F.explode(F.expr("sequence(0L, _blocks - 1)")).alias("_block")).withColumn(
            "_ideal",
            (F.col("_block") + 0.5) / F.col("_w"),
        )
    )
    common = rank_overall(shared, [F.col("_ideal"), F.col("_source"), F.col("_block")], "_turn", "_all").select(
        "_source",
        "_block",
        F.lit("~").alias("_lane"),
        "_turn",
    )
    lanes = target.filter("_own").select(F.col("_source").alias("_lane"), "_blocks", F.col("_w").alias("_lw"))
    rest = target.filter("_aimed AND NOT _own").agg(F.sum("_blocks").alias("_blocks"), F.sum("_w").alias("_lw")).filter(F.col("_lw") * period >= 1).select(
        F.lit("~").alias("_lane"),
        "_blocks",
        "_lw",
    )
    slots = materialise(schedule(epochs(lanes.unionByName(rest), period)))
    own = slots.filter("_lane <> '~'").select(F.col("_lane").alias("_source"), F.col("_turn").alias("_block"), "slot", "release", "deadline")
    both = own.unionByName(common.join(slots, ["_lane", "_turn"]).select("_source", "_block", "slot", "release", "deadline"))
    placed = ranked.join(target.select("_source", F.col("_w").alias("weight")), "_source").join(both, ["_source", "_block"], "left")
    placed = materialise(placed.withColumn("_ideal", (F.col("_block") + 0.5) / F.col("weight")).drop("_of", "_weight"))
    order = [F.coalesce("slot", F.lit((1 << 63) - 1)), F.col("_ideal"), F.col("_source"), F.col("_rank")]
    placed = placed.withColumns({f"_o{i}": c for i, c in enumerate(order)})
    return rank_overall(placed, [F.col(f"_o{i}") for i in range(len(order))], "position", "_all").select(
        "doc_id", "source", "weight", F.col(
            "_block"
        ).alias("block"), "slot", "release", "deadline", "position", F.col("slot").isNotNull().alias("exact"), "_all", "_text"
    )


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, source, weight, block, slot, release, deadline, position, exact for every row.

    ``weights`` are targets by source, or a column that gives a row its source's; without them a source's target is
    its row count to the power ``flatten``. ``period`` is the length of an epoch and bounds the lanes: one row of
    as many entries.
    """
    return positions(docs, **parameters).drop("_all", "_text")


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs``, all of them, in the order of the mixture (partition by partition).

    The place of a row is found by its id and a hash of its text, so rows without an id, or of one id, are mixed too;
    rows that are equal in both stand together at their first place.
    """
    needed = [c for c in ("doc_id", "source", "text") if c in docs.columns]
    found = positions(docs.select(*needed), **parameters)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Places are known and dense: partitions are cut from them and need no sampling.
    places = found.groupBy(F.col("doc_id").alias("_id"), "_text").agg(
        F.min("position").alias("_position"),
        F.min(F.expr(f"cast((position * {parts}) div _all as int)")).alias("_part"),
    )
    same = docs["doc_id"].eqNullSafe(F.col("_id")) & (identity(docs) == F.col("_text"))
    # Numbers only: where they are few, texts are shuffled once, to their places.
    ordered = docs.join(broadcast_if_small(materialise(places)), same).repartitionById(parts, "_part").sortWithinPartitions("_position")
    return ordered.select(*[docs[c] for c in docs.columns])
