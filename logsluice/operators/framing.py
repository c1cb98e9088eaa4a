"""Join physical lines into multi-line events, exactly and without scanning a source in order.

Whether a line continues the event before it depends on two bits of that event (it is a Go
stack; an explicit stack marker was seen) plus the line just before it. So a block of lines is
summarised by one letter per line, and the events inside it are the matches of one regular
expression over that letter string. Only the lines at the start of a block that may still
belong to an earlier event depend on the block before, and that dependency is a function of
five possible entry states. Such functions compose, so all blocks learn their entry state from a tree
of compositions, however long a stretch without a header is. What else crosses blocks are sums and last
values; windows carry these alone, never the letters.

Letter of a line = what happens to it:
  ``h``/``H`` starts an event (H: and opens stack context);  ``p``/``P`` the same for a Go start
  ``c``/``C`` continues any event (C: explicit stack marker)
  ``g``/``G`` continues only a Go event, otherwise starts one; ``r``/``R`` the same, as a Go start
  ``s`` continues only an event with stack context; ``b`` continues either kind
  ``.`` an empty line: vanishes without touching any state
Before neighbours are known, ``Y``/``Z`` are C/H lines that are Python frames, and ``i j k l``
are h/s/g/b lines that continue the event when they directly follow such a frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import schema as S
from ..functions import classify as C, patterns as P, redact as R, text as X
from ..session import written
from .scale import BLOCK, LINES_PER_BLOCK, composed_before, over_earlier_blocks, task_count, with_block

#: What one task sorts of the text: bytes of lines, each with so much for its other columns.
BYTES_PER_TASK = 128 * 1024 * 1024
BYTES_BESIDE_LINE = 256
#: Sources with the fullest blocks, of which so many have a width of blocks of their own; the next one's serves all others.
OWN_WIDTHS = 4096

_LETTERS = ".hHpPcCgGrRsbYZijkl"
# Runs of continuation letters by entry state; upper case opens stack context.
_AFTER_STACK = r"[cCsb.]*"
_AFTER_GO_STACK = r"[cCgGrRsb.]*"
_PLAIN_BODY = rf"[c.]*(?:C{_AFTER_STACK})?"
_GO_BODY = rf"[cgrb.]*(?:[CGR]{_AFTER_GO_STACK})?"
# States: 0 plain, 1 stack, 2 go, 3 go with stack, 4 nothing pending yet.
_BODIES = (_PLAIN_BODY, _AFTER_STACK, _GO_BODY, _AFTER_GO_STACK, r"\.*")
_EVENT = (
    f"(?:[pr]{_GO_BODY}|[PR]{_AFTER_GO_STACK}|[HCG]{_AFTER_STACK}|[hcgsb]{_PLAIN_BODY})"
)


def identify(lines: DataFrame) -> DataFrame:
    """Redact the source record and name it; needs ``source, line_no, raw`` [, ``partial``]."""
    if "partial" not in lines.columns:
        lines = lines.withColumn("partial", F.lit(False))
    lines = lines.withColumn("_safe", R.safe_source("source"))
    return lines.select(
        F.col("_safe").alias("source"), X.source_id("_safe").alias("source_id"),
        (~F.col("_safe").eqNullSafe(F.col("source"))).alias("source_changed"),
        *[c for c in lines.columns if c not in ("_safe", "source")],
    )


def stamp_lines(d: DataFrame) -> DataFrame:
    """Repair and trim each line and take its time off: adds ``body, ts_raw, trunc, doubt``."""
    kube = F.coalesce(F.col("source.type") == "kubernetes", F.lit(False))
    return (
        d.withColumn("trunc", X.line_overflows("raw") | F.col("partial"))
        .withColumn("_t", X.bounded_line("raw"))
        .withColumn("_bad", ~F.is_valid_utf8("_t"))
        .withColumn("_t", X.repair_utf8("_t"))
        .withColumn("_t", X.trim_line_end("_t"))
        .withColumn("_t", X.strip_ansi("_t"))
        .withColumn("_tok", F.when(kube, X.transport_stamp("_t")))
        .withColumn("_pre", F.when(F.col("_tok").isNull(), X.prefix_stamp("_t")).otherwise(""))
        .withColumn(
            "body",
            F.when(F.col("_tok").isNotNull(), F.expr("substr(_t, length(_tok) + 2)"))
            .when(F.col("_pre") != "", F.expr("substr(_t, length(_pre) + 1)"))
            .otherwise(F.col("_t")),
        )
        .withColumn("ts_raw", F.coalesce(
            "_tok", F.when(F.col("_pre") != "", F.trim("_pre", F.lit(" \t")))))
        .withColumn("doubt", F.col("partial") | F.col("_bad") | (kube & F.col("_tok").isNull()))
        .drop("_t", "_tok", "_pre", "_bad")
    )


def key_mark(raw: str = "raw") -> Column:
    """``BEGIN`` or ``END``: the last private-key marker of a line, else NULL."""
    marks = F.regexp_extract_all(raw, F.lit(P.KEY_MARK), F.lit(1))
    return F.when(F.col(raw).contains("PRIVATE KEY-----"), F.try_element_at(marks, F.lit(-1)))


def line_letters(d: DataFrame) -> DataFrame:
    """Add ``letter`` (line after an ordinary line), ``alt`` (after a Python frame), ``py``."""
    body = F.col("body")
    stamped = F.col("ts_raw").isNotNull()
    # Nearly all lines start with something no marker can start with: one test settles them.
    d = d.withColumn("_may", body.rlike(
        rf"^{P.SPACE}|(?:Error|Exception):|^(?:at|File|Caused by:|Suppressed:|Traceback|\.\.\.)"
    ))
    d = d.withColumn("_exp", F.col("_may") & body.rlike(P.STACK_MARK))
    d = d.withColumn("_gohead", body.startswith("goroutine ") & body.rlike(P.GO_HEADER))
    d = d.withColumn("_goline", F.col("_gohead") | (
        (body.contains("(") | body.contains(".go:") | body.startswith("created by "))
        & body.rlike(P.GO_FRAME)
    ))
    d = d.withColumn("_gostart", F.col("_gohead") | body.rlike(P.GO_START))
    d = d.withColumn(
        "_detail", F.col("_may") & stamped & (body.rlike(P.CARET_LINE) | body.rlike(P.DOTNET_LINE))
    )
    d = d.withColumn("_cont", F.when(stamped, F.col("_exp")).otherwise(
        F.col("_may") & body.rlike(P.CONTINUATION)
    ))
    letter = F.when(
        F.col("_cont"), F.when(F.col("_exp"), "C").otherwise("c")
    ).when(F.col("_goline") & F.col("_detail"), "b").when(
        F.col("_goline"),
        F.when(F.col("_gostart"), F.when(F.col("_exp"), "R").otherwise("r"))
        .otherwise(F.when(F.col("_exp"), "G").otherwise("g")),
    ).when(F.col("_detail"), "s").when(
        F.col("_gostart"), F.when(F.col("_exp"), "P").otherwise("p")
    ).otherwise(F.when(F.col("_exp"), "H").otherwise("h"))
    d = d.withColumn("letter", letter)
    python_detail = (
        stamped & (body.startswith("    ") | body.startswith("\t")) & ~body.rlike(P.LEVEL_LINE)
    )
    return d.withColumn(
        "alt", F.when(python_detail & ~F.col("_cont"), "c").otherwise(F.col("letter"))
    ).withColumn("py", body.contains("File ") & body.rlike(P.PYTHON_FRAME)).drop(
        "_may", "_exp", "_gohead", "_goline", "_gostart", "_detail", "_cont"
    )


def _exit_of(event: Column) -> Column:
    """State left behind by an event, from its letters."""
    return F.when(event.rlike("^[prPR]"), 2).otherwise(0) + F.when(
        event.rlike("[CGRHP]"), 1
    ).otherwise(0)


def _last_event(letters: Column) -> Column:
    events = F.regexp_extract_all(letters, F.lit(f"({_EVENT})"), F.lit(1))
    return F.coalesce(F.try_element_at(events, F.lit(-1)), F.lit(""))


def _exit_when_open(state: int) -> Column:
    """Exit state of a block without a definite header, entered in ``state``."""
    lead = F.length(F.regexp_extract("letters", f"^({_BODIES[state]})", 1))
    kept = F.lit(state)
    if state in (0, 2):
        kept = kept + F.when(F.col("letters").rlike("[CGR]"), 1).otherwise(0)
    tail = F.substr(F.col("letters"), lead + 1, F.length("letters"))
    return F.when(lead == F.length("letters"), kept).otherwise(_exit_of(_last_event(tail)))


def _exit_code(d: DataFrame) -> DataFrame:
    """(source_id, block, code): the exit state of each block for each entry state, three bits each.

    A block with a definite header leaves the same state whatever it was entered with.
    """
    # The last definite header of a block and what follows it settle the exit state.
    d = d.withColumn("_tail", F.regexp_extract("letters", r"([hHpP][^hHpP]*)\z", 1))
    d = d.withColumn("_x", F.when(F.col("_tail") != "", _exit_of(_last_event(F.col("_tail")))))
    code = sum((F.coalesce("_x", _exit_when_open(s)) * 8**s for s in range(5)), F.lit(0))
    return d.select("source_id", BLOCK, code.alias("code"))


def _private_flags(entered: Column) -> Column:
    """'1' per line inside or touching a key block, from the marker string ``_marks``.

    B opens (again), E closes; both marker lines belong to the block.
    """
    lead = F.when(entered, F.regexp_extract("_marks", "^([^E]*E?)", 1)).otherwise("")
    rest = F.substr(F.col("_marks"), F.length(lead) + 1, F.length("_marks"))
    spans = F.regexp_extract_all(rest, F.lit("(B[^E]*E?|E|[^BE]+)"), F.lit(1))
    return F.concat(
        F.repeat(F.lit("1"), F.length(lead)),
        F.array_join(F.transform(spans, lambda s: F.when(
            s.rlike("^[BE]"), F.repeat(F.lit("1"), F.length(s))).otherwise(F.repeat(F.lit("0"), F.length(s)))), ""),
    )


def letter_rows(stamped: DataFrame) -> DataFrame:
    """(source_id, block, line_no, letter, mark, weight) of each line; the weight is what it takes in a sort of the text."""
    d = line_letters(stamped)
    letter = F.when((F.col("body") == "") & ~F.col("trunc"), ".").when(
        F.col("py"), F.translate("letter", "CcHh", "YYZZ")
    ).when(F.col("alt") != F.col("letter"), F.translate("letter", "hsgb", "ijkl")).otherwise(F.col("letter"))
    weight = (F.coalesce(F.octet_length("body"), F.lit(0)) + BYTES_BESIDE_LINE).cast("bigint")
    return d.select(
        "source_id", BLOCK, "line_no", letter.alias("letter"), F.substring(key_mark(), 1, 1).alias("mark"), weight.alias("weight"),
    )


def widened(d: DataFrame, widths: tuple[DataFrame, int] | None) -> DataFrame:
    """``d`` with the blocks of ``block_widths``."""
    if widths is None:
        return d
    own, others = widths
    d = d.join(F.broadcast(own), "source_id", "left")
    return d.withColumn(BLOCK, F.floor(F.col(BLOCK) / F.coalesce("_width", F.lit(others))).cast("bigint")).drop("_width")


def block_widths(fine: DataFrame) -> tuple[DataFrame, int] | None:
    """How many blocks of a source make one: (source_id, _width) of the fullest, and what serves all others; None where all stay as they are.

    A source whose lines lie far apart would have a row for every few of them. A block still has no more lines than numbers.
    """
    most = fine.groupBy("source_id").agg(F.max(F.length("_plain")).alias("_most"))
    own = written(most.orderBy(F.desc("_most")).limit(OWN_WIDTHS + 1), "frame-widths")
    width = F.greatest(F.lit(1), F.floor(LINES_PER_BLOCK / F.greatest("_most", F.lit(1)))).cast("bigint")
    others, = own.agg(F.max(width)).first()
    return None if others in (None, 1) else (own.select("source_id", width.alias("_width")), others)


def block_table(letters: DataFrame) -> tuple[DataFrame, int, tuple[DataFrame, int] | None, bool]:
    """One row per block: where its events start and what it inherits from earlier blocks; the tasks to deal the text to; ``block_widths``; and
    whether an event crosses blocks.

    ``flags`` has '1' where an event starts and ``private`` (NULL in blocks untouched by key
    material) '1' on private lines; both are aligned with the lines of the block. ``cut`` is the start of an event that later blocks go on with.
    """
    by = ["source_id", BLOCK]
    d = letters.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("line_no", "letter", "mark"))).alias("_l"),
        F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("line_no"))).alias("_mark"),
        F.sum("weight").alias("_weight"),
    )
    d = written(d.select(*by, "_mark", "_weight", F.array_join(F.col("_l.letter"), "").alias("_plain"), F.when(
        F.col("_mark").isNotNull(), F.array_join(F.transform("_l", lambda x: F.coalesce(x["mark"], F.lit("-"))), "")
    ).alias("_marks")), "frame-letters")
    widths = block_widths(d)
    if widths is not None:
        d = widened(d.withColumn("_fine", F.col(BLOCK)), widths).groupBy(*by).agg(
            F.sort_array(F.collect_list(F.struct("_fine", "_mark", "_plain", "_marks"))).alias("_l"), F.sum("_weight").alias("_weight"))
        last = F.try_element_at(F.filter("_l._mark", lambda m: m.isNotNull()), F.lit(-1))
        d = written(d.withColumn("_mark", last).select(*by, "_mark", "_weight", F.array_join("_l._plain", "").alias("_plain"), F.when(
            F.col("_mark").isNotNull(),
            F.array_join(F.transform("_l", lambda x: F.coalesce(x["_marks"], F.translate(x["_plain"], _LETTERS, "-" * len(_LETTERS)))), "")
        ).alias("_marks")), "frame-letters")
    last_block, weight = d.agg(F.max(BLOCK), F.sum("_weight")).first()
    tasks = task_count(d, weight, BYTES_PER_TASK)
    d = d.join(over_earlier_blocks(d, ["source_id"], BLOCK, {"_earlier": ("last", F.col("_mark"))}), by)
    d = d.withColumn("_entered", F.coalesce(F.col("_earlier") == "B", F.lit(False)))
    touched = F.col("_entered") | F.col("_mark").isNotNull()
    d = d.withColumn("_marks", F.when(touched, F.coalesce("_marks", F.expr("repeat('-', length(_plain))"))))
    d = d.withColumn("private", F.when(touched, _private_flags(F.col("_entered"))))
    # An empty line inside a key block is an event of its own.
    with_keys = F.array_join(F.transform(F.split("_plain", ""), lambda c, i: F.when(
        (c == ".") & (F.substr(F.col("private"), i + 1, F.lit(1)) == "1"), "h").otherwise(c)), "")
    d = d.select(*by, "private", F.when(touched, with_keys).otherwise(F.col("_plain")).alias("_s"))
    # Python detail lines: resolved inside the block, then for the first line of the block.
    ends_py = F.col("_s").rlike(r"[YZ]\.*\z")
    hollow = F.col("_s").rlike(r"^\.*\z")
    d = d.join(over_earlier_blocks(d, ["source_id"], BLOCK, {"_py": ("last", F.when(~hollow, ends_py))}), by)
    d = d.withColumn("_s", F.when(
        F.coalesce("_py", F.lit(False)), F.regexp_replace("_s", r"^(\.*)[ijkl]", "$1c")).otherwise(F.col("_s")))
    d = d.select(*by, "private", F.translate(
        F.regexp_replace("_s", r"([YZ]\.*)[ijkl]", "$1c"), "ijklYZ", "hsgbCH").alias("letters"))
    # The state that a source begins in, 4, led through all blocks before.
    entry = F.shiftright("code", 12).bitwiseAND(7).cast("int")
    d = d.join(composed_before(_exit_code(d), ["source_id"], BLOCK, "code", 5, last_block or 0), by).withColumn("entry", entry).drop("code")
    lead = F.expr("CAST(0 AS INT)")
    for state in range(5):
        lead = F.when(
            F.col("entry") == state, F.length(F.regexp_extract("letters", f"^({_BODIES[state]})", 1))
        ).otherwise(lead)
    starts = F.regexp_replace(F.expr("substr(letters, _lead + 1)"), f"({_EVENT})", "|$1")
    d = (
        d.withColumn("_lead", lead)
        .withColumn("flags", F.concat(
            F.expr("repeat('0', _lead)"),
            F.regexp_replace(F.regexp_replace(starts, r"\|[a-zA-Z]", "1"), "[a-zA-Z.]", "0"),
        ))
        .withColumn("_n", F.length(F.replace(F.col("letters"), F.lit("."), F.lit(""))).cast("bigint"))
        # 1-based position of the last start, 0 when the block starts no event.
        .withColumn("_last", F.expr(
            "if(instr(flags, '1') = 0, 0, length(flags) - instr(reverse(flags), '1') + 1)"))
        .withColumn("_before_last", F.length(F.replace(
            F.expr("substr(letters, 1, _last)"), F.lit("."), F.lit(""))))
        .withColumn("orphan_at", F.when(
            (F.col("entry") == 4) & F.col("letters").rlike(r"^\.*[cC]"), F.instr("flags", "1")))
        .withColumn("_joins", F.expr("substr(letters, 1, _lead)").rlike(r"[^.]"))
    )
    d = written(d.select(*by, "flags", "private", "orphan_at", "_n", "_last", "_before_last", "_joins"), "frame-blocks")
    cut, crossed = F.lit(None).cast("int"), d.where("_joins").limit(1).count() > 0
    if crossed:
        # Looked at from the end, the next block with a line that stays says whether it goes on with an event.
        back = d.withColumn("_back", -F.col(BLOCK))
        later = over_earlier_blocks(back, ["source_id"], "_back", {"_open": ("last", F.when(F.col("_n") > 0, F.col("_joins")))})
        d = d.join(later.select("source_id", (-F.col("_back")).alias(BLOCK), "_open"), by)
        cut = F.when(F.col("_open"), F.col("_last"))
    d = d.join(over_earlier_blocks(d, ["source_id"], BLOCK, {"seen": ("sum", F.col("_n"))}), by)
    opened = F.when(F.col("_last") > 0, F.struct(
        F.col(BLOCK).alias("b"), F.col("_last").alias("i"), (F.col("seen") + F.col("_before_last")).alias("o"),
    ))
    d = d.join(over_earlier_blocks(d, ["source_id"], BLOCK, {"_in": ("last", opened)}), by)
    return d.select(
        *by, "flags", "private", "seen", F.col("_in.b").alias("in_block"), F.col("_in.i").alias("in_idx"),
        F.col("_in.o").alias("in_ord"), "orphan_at", cut.alias("cut"),
    ), tasks, widths, crossed


def mark_events(clean: DataFrame, blocks: DataFrame, tasks: int, crossed: bool) -> DataFrame:
    """Add the event key of every line that stays: block and position of its event's first line; and whether its block holds the ``whole`` event.

    Both sides are dealt to ``tasks``, so a task sorts no more for a larger input, and the joins that made ``blocks`` stay out of it.
    """
    keys = ["source_id", BLOCK]
    by = Window.partitionBy("source_id", BLOCK).orderBy("line_no")
    running = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = (
        clean.withColumn("_filled", F.col("body") != "").drop("body").repartition(tasks, *keys)
        .withColumn("_idx", F.row_number().over(by))
        # Looked up by hash, the blocks leave the lines sorted; a task has no more blocks than lines.
        .join(blocks.repartition(tasks, *keys).hint("shuffle_hash"), keys)
        .withColumn("is_private", F.coalesce(F.expr("substr(private, _idx, 1) = '1'"), F.lit(False)))
        .withColumn("text", F.when(F.col("is_private"), P.KEY_BLOCK_TEXT).otherwise(F.col("safe")))
        .where(F.col("_filled") | F.col("is_private") | F.col("trunc"))
        .withColumn("_start", F.expr("substr(flags, _idx, 1) = '1'"))
        .withColumn("size", (F.octet_length("text") + 1).cast("bigint"))
    )
    # One pass over the sorted block: ordinal, bytes so far, and the event start in force.
    d = (
        d.withColumn("_ord", F.count(F.lit(1)).over(running))
        .withColumn("_cum", F.sum("size").over(running))
    )
    mark = F.when(F.col("_start"), F.struct(
        F.col("_idx").alias("i"), F.col("_ord").alias("o"), (F.col("_cum") - F.col("size")).alias("c")))
    d = d.withColumn("_own", F.last(mark, ignorenulls=True).over(running))
    inherited = F.col("_own").isNull()
    return d.select(
        "source_id", BLOCK, "source", "line_no", "ts_raw", "text", "size", "trunc", "doubt", "changed",
        "ambiguous", "source_changed", "is_private",
        ((~inherited & ~F.coalesce(F.col("_own.i") == F.col("cut"), F.lit(False))) if crossed else F.lit(True)).alias("whole"),
        F.when(inherited, F.col("in_block")).otherwise(F.col(BLOCK)).alias("ev_block"),
        F.when(inherited, F.col("in_idx")).otherwise(F.col("_own.i")).alias("ev_idx"),
        (F.col("seen") + F.col("_ord") - F.when(inherited, F.col("in_ord"))
         .otherwise(F.col("seen") + F.col("_own.o"))).alias("nth"),
        # Bytes of the event before this line, counting this block only.
        (F.col("_cum") - F.col("size") - F.coalesce(F.col("_own.c"), F.lit(0))).alias("offset"),
        F.coalesce(F.col("_idx") == F.col("orphan_at"), F.lit(False)).alias("orphan"),
    )


def assemble(marked: DataFrame) -> DataFrame:
    """One row per event from lines that know their event.

    Nearly all events lie in one block, whose lines are in one task: only lines of the others are shuffled.
    """
    inside = _assembled(marked.where("whole"), ["source_id", BLOCK, "ev_idx"])
    return inside.unionByName(_assembled(marked.where("NOT whole"), ["source_id", "ev_block", "ev_idx"]))


def _assembled(marked: DataFrame, by: list[str]) -> DataFrame:
    # Lines that cannot reach the clipped text are counted but not collected: each earlier line
    # takes at least one byte, and the bytes of this block alone are a lower bound.
    needed = (F.col("nth") < S.MAX_EVENT_BYTES) & (F.col("offset") < S.MAX_EVENT_BYTES)
    d = marked.withColumn("_piece", F.when(
        needed, F.struct(F.col("line_no"), X.clip_bytes("text", S.MAX_EVENT_BYTES).alias("text"))
    ))
    ev = d.groupBy(*by).agg(
        F.min_by(F.struct("source", "ts_raw"), "line_no").alias("_head"),
        F.min("line_no").alias("line_start"),
        F.max("line_no").alias("line_end"),
        F.count(F.lit(1)).alias("line_count"),
        (F.sum("size") - 1).alias("_bytes"),
        F.max("trunc").alias("_trunc"),
        F.max(F.col("changed") | F.col("is_private") | F.col("source_changed")).alias("sensitive"),
        F.max(F.col("doubt") | F.col("ambiguous") | F.col("orphan")).alias("parse_uncertain"),
        F.sort_array(F.collect_list("_piece")).alias("_pieces"),
    )
    ev = (
        ev.select("*", "_head.*")
        .withColumn("text", F.array_join(F.transform("_pieces", lambda p: p["text"]), "\n"))
        .withColumn("text", X.clip_bytes("text", S.MAX_EVENT_BYTES))
        .withColumn("truncated", F.col("_trunc") | (F.col("_bytes") > S.MAX_EVENT_BYTES))
    )
    return ev.select(
        X.event_id("source", "ts_raw", "line_start", "text").alias("id"),
        "source", F.lower(F.hex("source_id")).alias("source_id"), "ts_raw", F.try_to_timestamp("ts_raw").alias("ts"), "text",
        "line_start", "line_end", "line_count", "truncated", "sensitive", "parse_uncertain",
        X.group_id("source", "text").alias("group_id"), C.baseline("text").alias("baseline"),
    )


def frame_events(lines: DataFrame, with_json: bool = True) -> DataFrame:
    """Lines (``source, line_no, raw`` [, ``partial``]) to framed, redacted events.

    Two passes over the lines: one letter per line for the block table, and the text itself,
    which is shuffled by block. Inside, ids of sources are bytes, as every row that moves has one.
    """
    stamped = stamp_lines(with_block(identify(lines), "line_no", LINES_PER_BLOCK))
    stamped = stamped.withColumn("source_id", F.coalesce(F.unhex("source_id"), F.lit(b"")))
    blocks, tasks, widths, crossed = block_table(letter_rows(stamped))
    clean = R.with_redaction(stamped, "body", with_json).drop("raw", "partial")
    return assemble(mark_events(widened(clean, widths), blocks, tasks, crossed))
