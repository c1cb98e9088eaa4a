"""Mix sources to target weights by a low-discrepancy schedule.

A source's target comes from its weight, bounded by ``max_repeat`` times its size; what a bound
cuts off is shared among the others by weight (one pass over the sources in order of the level at
which they fill up). The mix is cut into equal blocks of up to ``BLOCK_WORDS`` words, as many as the power of two
that this takes. Slot ``i`` takes the ``i``-th van der Corput point, the point falls into one source's stretch of the cumulative
targets, and the slot's rank within its source names the block of that source's shuffled words it
receives. Every prefix of the schedule is therefore close to the target weights, not only its end. A source's last block ends at
its target, rounded to words, so what a source gets doesn't depend on the grid; the schedule may have a slot more or
less for a source than that takes, and blocks without a slot come last.

A source's documents are laid end to end in the order of a keyed hash, once per pass. The running
sizes that this takes are sums inside 4096 hash blocks per source plus one total per block, so a
source with a third of all rows is spread over its blocks. Rows of equal id, size and source are laid as one and told apart by
counting, so their number doesn't matter either. Texts take no part: what a row gets follows from where its hash stands to
that of the one document of its source that is cut.

Null texts have size 0 and are never taken. Null is a source of its own and the last. Repeated
rows and rows sharing an id are documents of their own; which of several equal in id, size and source is cut is left
open. Extra columns stay as they are, whatever their names. Texts may be of any length. An empty table gives an empty mix.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.scale import running_rank, running_total
from .common import words, write_shared

#: Words of a block at most; more than half as many, except in a mix of fewer.
BLOCK_WORDS = 1 << 10
#: Ranks and copies that one row is spread to at a time.
_SPREAD = 1 << 16
#: Hash blocks of a source; their number bounds the window over one source's totals.
_HEX = 3


def with_size(documents: DataFrame, text: str = "text") -> DataFrame:
    return documents.withColumn("size", F.size(words(F.col(text))).cast("long"))


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, max_repeat: int = 2
) -> DataFrame:
    """One row per source: (source, source_size, weight, target, low, high).

    ``weights`` repeat over the sources in order of their code points, null last. ``low`` and
    ``high`` are the source's stretch of the cumulative targets, between 0 and 1.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Windows over the sources themselves, which are few beside the documents.
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    pick = F.array(*[F.lit(float(w)) for w in weights])
    s = per_source.withColumn("_n", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(pick, ((F.col("_n") - 1) % len(weights) + 1).cast("int"))
    )
    everything = Window.partitionBy(F.lit(0))
    fill = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("weight"), "_n")
    s = (
        s.withColumn("_cap", (F.col("source_size") * max_repeat).cast("double"))
        .withColumn("_all", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_full", F.coalesce(F.sum("_cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_left", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        # The level if this source and all after it stay below their bounds. It is right for the
        # first source in the order of filling that does.
        .withColumn("_level", (F.col("_all") - F.col("_full")) / F.col("_left"))
        .withColumn("_level", F.first(F.when(F.col("weight") * F.col("_level") <= F.col("_cap"), F.col("_level")), ignorenulls=True)
                    .over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("target", F.least("_cap", F.coalesce(F.col("weight") * F.col("_level"), F.col("_cap"))))
    )
    total = F.sum("target").over(everything)
    before = F.coalesce(F.sum("target").over(by_name.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    s = s.withColumn("mix_size", total).withColumn("low", F.when(total > 0, before / total).otherwise(F.lit(0.0)))
    return s.withColumn("high", F.when(total > 0, F.coalesce(F.lead("low").over(by_name), F.lit(1.0))).otherwise(F.lit(0.0))).select(
        "source", "source_size", "weight", "target", "mix_size", "low", "high"
    )


def source_key(source: Column) -> Column:
    """A key that joins can use, as null is a source too."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def schedule(targets: DataFrame, slots: int) -> DataFrame:
    """One row per slot: (slot, _src, rank). ``slots`` is a power of two.

    The van der Corput point of a slot is its number with the bits reversed. Stretches are cut
    at a grid of 1024 cells, so that the search for a point's stretch is a join on the cell.
    """
    bits = int(math.log2(slots))
    if 1 << bits != slots:
        raise ValueError("slots must be a power of two")
    cells = min(slots, 1024)
    point = F.conv(F.reverse(F.lpad(F.bin("slot"), bits, "0")), 2, 10).cast("long")
    points = targets.sparkSession.range(slots).withColumnRenamed("id", "slot").withColumn("_p", point)
    points = points.withColumn("_cell", F.floor(F.col("_p") * cells / slots))
    last = F.least(F.ceil(F.col("high") * cells) - 1, F.lit(cells - 1))
    stretches = targets.where("high > low").select(
        source_key(F.col("source")).alias("_src"), "low", "high",
        F.explode(F.sequence(F.floor(F.col("low") * cells), F.greatest(last, F.floor(F.col("low") * cells)))).alias("_cell"),
    )
    x = F.col("_p") / F.lit(float(slots))
    hits = points.join(stretches, "_cell").where((x >= F.col("low")) & (x < F.col("high"))).select("slot", "_src")
    # Ranks in two levels: inside 4096 slots, then over the totals of these.
    return running_rank(
        hits.withColumn("_b", F.shiftright("slot", 12)), ["_src"], ["slot"], "rank", block="_b"
    ).select("slot", "_src", (F.col("rank") - 1).alias("rank"))


def slots_for(targets: DataFrame) -> int:
    """The power of two that cuts the mix into blocks of at most ``BLOCK_WORDS`` words."""
    size = targets.agg(F.max("mix_size")).first()[0] or 0.0
    return 1 << max(0, math.ceil(math.log2(max(size / BLOCK_WORDS, 1.0))))


def _key(seed: str) -> Column:
    return F.md5(F.concat_ws("/", F.lit(seed), F.col("doc_id").cast("string")).cast("binary"))


def _source_of(key: Column) -> Column:
    return F.when(key != "null", F.substring(key, 2, 1 << 30))


_PLACE = ["_src", "_key", "doc_id", "size"]


class _Layout:
    """The sources' targets, and all rows laid end to end without their texts."""

    def __init__(self, sized: DataFrame, weights: Sequence[int], share: float, max_repeat: int, seed: str):
        narrow = sized.select("doc_id", "source", F.col("size").cast("long").alias("size"))
        self.rows = write_shared(narrow.select(source_key(F.col("source")).alias("_src"), _key(seed).alias("_key"), "doc_id", "size"), "mix-rows")
        self.targets = write_shared(source_targets(narrow, weights, share, max_repeat), "mix-targets")
        most = F.col("source_size") * max_repeat
        per_source = self.targets.select(
            source_key(F.col("source")).alias("_src"), "source_size", "target", "mix_size",
            F.least(F.floor(F.col("target") + 0.5), most).cast("long").alias("_reach"),
        )
        # Equal rows are one place of ``many`` rows.
        groups = self.rows.groupBy(*_PLACE).agg(F.count(F.lit(1)).alias("many")).withColumn("_block", F.substring("_key", 1, _HEX))
        laid = running_total(groups, ["_src"], ["_key", "doc_id", "size"], F.col("size") * F.col("many"), "_end", block="_block")
        self.places = write_shared(laid.withColumn("_start", F.col("_end") - F.col("size") * F.col("many")).drop("_block").join(per_source, "_src"), "mix-places")
        self.per_source = per_source
        self.max_repeat = max_repeat

    def pieces(self, slots: int) -> DataFrame:
        """(slot, *place, pass, first, words): what each slot takes of a place; ``first`` counts from the place's first word.

        Slots are joined to the blocks of their source by rank. Block r holds the words from floor(r * length) to
        floor((r + 1) * length) of its source, and none beyond the target.
        """
        each = self.places.select("*", F.explode(F.sequence(F.lit(0), F.lit(self.max_repeat - 1))).alias("pass")).withColumn(
            "_from", F.col("source_size") * F.col("pass") + F.col("_start")
        ).withColumn("_to", F.least(F.col("_from") + F.col("size") * F.col("many"), F.col("_reach"))).where("_to > _from")
        length = F.col("mix_size") / F.lit(float(slots))
        edge = lambda r: F.floor(r * length)
        near = lambda w: F.floor(w / length).cast("long")  # noqa: E731  off by one at an edge
        ranks = each.withColumns({"_r0": F.greatest(near(F.col("_from")) - 1, F.lit(0).cast("long")), "_r1": near(F.col("_to")) + 1})
        far = ranks.withColumn("_far", F.explode(F.sequence(F.floor(F.col("_r0") / _SPREAD), F.floor(F.col("_r1") / _SPREAD))))
        spread = far.withColumn("rank", F.explode(F.sequence(
            F.greatest("_r0", F.col("_far") * _SPREAD), F.least("_r1", F.col("_far") * _SPREAD + (_SPREAD - 1))
        )))
        cut = spread.withColumns({"_a": F.greatest("_from", edge(F.col("rank"))), "_b": F.least("_to", edge(F.col("rank") + 1))}).where("_b > _a")
        return cut.join(schedule(self.targets, slots), ["_src", "rank"], "left").select(
            F.coalesce("slot", F.lit(slots).cast("long")).alias("slot"), *_PLACE, "pass", (F.col("_a") - F.col("_from")).alias("first"), (F.col("_b") - F.col("_a")).alias("words")
        )


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_copy``, a number from 0 for each row of a place."""
    held = write_shared(rows.withColumn("_task", F.spark_partition_id()), "mix-copies")
    return running_rank(held, _PLACE, ["_task"], "_copy", block="_task").withColumn("_copy", F.col("_copy") - 1).drop("_task")


def _part(words_: Column, copy: Column) -> Column:
    """What a copy gets of the words that a place of several gets; the first copies are taken whole."""
    return F.greatest(F.lit(0), F.least(F.col("size"), words_ - copy * F.col("size"))).cast("long")


def _scheduled_places(laid: _Layout, slots: int | None) -> DataFrame:
    """Per place and pass e the words that its blocks have of it, ``_p{e}``, and the first slot with one of these, ``_s{e}``."""
    passes = range(laid.max_repeat)
    got = laid.pieces(slots or slots_for(laid.targets)).groupBy(*_PLACE).pivot("pass", list(passes)).agg(
        F.sum("words").alias("p"), F.min("slot").alias("s")
    )
    got = got.toDF(*[f"_x{c}" for c in _PLACE], *[f"_{n}{e}" for e in passes for n in "ps"])
    met = [laid.places[c].eqNullSafe(got[f"_x{c}"]) for c in _PLACE]
    return write_shared(laid.places.join(got, met[0] & met[1] & met[2] & met[3], "left").select(
        *_PLACE, "many", "source_size", "target", *[F.coalesce(f"_p{e}", F.lit(0).cast("long")).alias(f"_p{e}") for e in passes],
        *[f"_s{e}" for e in passes],
    ), "mix-taken")


def taken_words(
    sized: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, max_repeat: int = 2, slots: int | None = None, seed: str = "mix",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) per row of ``sized`` (doc_id, source, size): the words of its blocks."""
    laid = _Layout(sized, weights, share, max_repeat, seed)
    names = [f"_p{e}" for e in range(max_repeat)]
    places = _scheduled_places(laid, slots).drop(*[f"_s{e}" for e in range(max_repeat)])
    several = places.where("many > 1")
    sides = several.select(*[F.col(c).alias(f"_x{c}") for c in _PLACE], "source_size", "target", *names)
    copies = laid.rows.join(sides, [laid.rows[c].eqNullSafe(sides[f"_x{c}"]) for c in _PLACE]).drop(*[f"_x{c}" for c in _PLACE])
    each = places.where("many = 1").drop("many").withColumn("_copy", F.lit(0).cast("long")).unionByName(_numbered(copies))
    total = sum((_part(F.col(c), F.col("_copy")) for c in names[1:]), _part(F.col(names[0]), F.col("_copy")))
    return each.select("doc_id", _source_of(F.col("_src")).alias("source"), "size", "source_size", "target", total.alias("taken"))


def mix(
    sized: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, max_repeat: int = 2, seed: str = "mix",
) -> DataFrame:
    """``sized`` (doc_id, source, size and any other column) with what the mix takes of each row.

    Adds source_size, target, ``taken`` (words, repeats counted) and ``passes``: for each pass over
    the source the words taken, always the first ones of the document. All but one document
    of a source are taken whole or not at all in a pass. Columns of the input with these names are replaced.
    These are the words that ``training_order`` orders; here no text is moved, as a row needs only the place that is cut.
    """
    laid = _Layout(sized, weights, share, max_repeat, seed)
    rest = F.when(F.col("source_size") > 0, F.col("_reach") % F.col("source_size")).otherwise(F.lit(0).cast("long"))
    whole = F.when(F.col("source_size") > 0, F.expr("_reach div source_size")).otherwise(F.lit(0).cast("long"))
    # A row per source: how many passes are whole, and where the one after them ends.
    cut = laid.places.withColumn("_rest", rest).where("_end > _rest").groupBy("_src").agg(
        F.min(F.struct("_key", "doc_id", "size", "_start", "many")).alias("_cut")
    )
    per_source = write_shared(
        laid.per_source.join(cut, "_src", "left").select("_src", "source_size", "target", rest.alias("_rest"), whole.alias("_whole"), "_cut"), "mix-sources"
    )
    rows = sized.select(
        F.struct("*").alias("_row"), source_key(F.col("source")).alias("_src"), _key(seed).alias("_key"), "doc_id", F.col("size").cast("long").alias("size")
    ).join(per_source, "_src")
    own = F.struct("_key", "doc_id", "size")
    edge = F.struct("_cut._key", "_cut.doc_id", "_cut.size")
    at = F.coalesce(own.eqNullSafe(edge), F.lit(False))
    none = F.lit(0).cast("long")
    tied = per_source.where("_cut.many > 1").limit(1).count() > 0
    if tied:
        alone = rows.where(~at | (F.col("_cut.many") == 1)).withColumn("_copy", none)
        rows = alone.unionByName(_numbered(rows.where(at & (F.col("_cut.many") > 1))))
    else:
        rows = rows.withColumn("_copy", none)

    def taken(e: int) -> Column:
        last = F.when(at, _part(F.col("_rest") - F.col("_cut._start"), F.col("_copy"))).when(own < edge, F.col("size")).otherwise(none)
        return F.when(F.col("_whole") > e, F.col("size")).when(F.col("_whole") == e, last).otherwise(none)

    passes = rows.withColumn("_passes", F.array(*[taken(e) for e in range(max_repeat)]))
    total = F.aggregate("_passes", none, lambda a, x: a + x)
    given = [c for c in sized.columns if c not in ("source_size", "target", "taken", "passes")]
    return passes.select(*[F.col("_row").getField(c).alias(c) for c in given], "source_size", "target", F.col("_passes").alias("passes"), total.alias("taken"))


def scheduled(
    sized: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, max_repeat: int = 2, slots: int | None = None, seed: str = "mix",
) -> tuple[DataFrame, int]:
    """(What ``mix`` returns, by the schedule, and the schedule's number of slots.)

    The words of a row are those of the blocks that slots were joined to. ``slots`` has for each pass the first slot with one of them, null
    where the pass takes none; ``in_slot_order`` orders by it.
    """
    laid = _Layout(sized, weights, share, max_repeat, seed)
    slots = slots or slots_for(laid.targets)
    places = _scheduled_places(laid, slots)
    names = [f"_p{e}" for e in range(max_repeat)]
    rows = sized.select(F.struct("*").alias("_row"), source_key(F.col("source")).alias("_src"), _key(seed).alias("_key"), "doc_id", F.col("size").cast("long").alias("size"))
    sides = places.withColumnsRenamed({c: f"_x{c}" for c in _PLACE})
    met = [rows[c].eqNullSafe(sides[f"_x{c}"]) for c in _PLACE]
    rows = rows.join(sides, met[0] & met[1] & met[2] & met[3]).drop(*[f"_x{c}" for c in _PLACE])
    # Only where a pass takes some of equal rows and not all does it matter which.
    whole = F.col("size") * F.col("many")
    apart = (F.col("many") > 1) & F.exists(F.array(*names), lambda n: (n > 0) & (n < whole))
    none = F.lit(0).cast("long")
    if places.where(apart).limit(1).count():
        rows = rows.where(~apart).withColumn("_copy", none).unionByName(_numbered(rows.where(apart)))
    else:
        rows = rows.withColumn("_copy", none)
    passes = F.array(*[F.when(F.col(n) < whole, _part(F.col(n), F.col("_copy"))).otherwise(F.col("size")) for n in names])
    rows = rows.withColumn("_passes", passes)
    first = F.array(*[F.when(F.col("_passes")[e] > 0, F.col(f"_s{e}")) for e in range(max_repeat)])
    total = F.aggregate("_passes", none, lambda a, x: a + x)
    given = [c for c in sized.columns if c not in ("source_size", "target", "taken", "passes", "slots")]
    return rows.select(
        *[F.col("_row").getField(c).alias(c) for c in given], "source_size", "target", F.col("_passes").alias("passes"), total.alias("taken"), first.alias("slots")
    ), slots


def in_slot_order(each: DataFrame, slots: int) -> DataFrame:
    """``each`` sorted by ``slot``: from partition to partition, and inside them. Slots are alike in words, so partitions are too."""
    wide = min(4096, max(512, slots // 1024))
    return each.repartitionById(slots // wide + 1, F.floor(F.col("slot") / wide).cast("int")).sortWithinPartitions("slot")


def mixed_texts(mixed: DataFrame, text: str = "text") -> DataFrame:
    """A row for each pass in which ``mix`` or ``scheduled`` takes words of a document, its text cut to those words; the latter's with their ``slot``.

    All but the last document of a source are taken whole and keep their text as it is.
    """
    rest = [c for c in mixed.columns if c not in (text, "passes", "slots")]
    if "slots" in mixed.columns:
        rest.append(F.element_at("slots", F.col("_e") + 1).alias("slot"))
    each = mixed.select("*", F.posexplode("passes").alias("_e", "_n")).select(*rest, text, "_n").where("_n > 0")
    some = F.array_join(F.slice(words(F.col(text)), 1, F.col("_n").cast("int")), " ")
    return each.withColumn(text, F.when(F.col("_n") < F.col("size"), some).otherwise(F.col(text))).drop("_n")


def training_order(
    sized: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, max_repeat: int = 2,
    slots: int | None = None, seed: str = "mix",
) -> DataFrame:
    """The mix as pieces of blocks: (slot, source, doc_id, first word, words), in slot order by sorting.

    A document that crosses blocks gives a piece to each; a piece of rows that are equal in id and size may run on into the next of
    them. ``slots`` is a power of two, that of ``slots_for`` if not given; blocks beyond those of the schedule have it as their slot.
    """
    laid = _Layout(sized, weights, share, max_repeat, seed)
    return laid.pieces(slots or slots_for(laid.targets)).select(
        "slot", _source_of(F.col("_src")).alias("source"), "doc_id", (F.col("first") % F.col("size")).alias("first_word"), "words"
    )
