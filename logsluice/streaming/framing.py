"""Framing of unbounded line streams, with parser state per source.

Text work (repair, stamps, letters, redaction) is the same JVM-side projection as in batch; the
stateful step only follows letters: those of a longer run of lines are one string, whose events are matches of the batch's expressions. A pending event closes at the next header or at the end
marker of its source, never on a quiet timer. Sources are dealt to groups, as calling Python for each of very many short ones
takes far longer than following their lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import schema as S
from ..functions import classify as C, patterns as P, redact as R, text as X
from ..operators import framing as W
from .ordered import SortedRuns, packed, unpacked

_STATE = (
    "in_key boolean, go boolean, stack boolean, py boolean, has boolean, source string, "
    "ts_raw string, text string, line_start bigint, line_end bigint, line_count bigint, "
    "truncated boolean, sensitive boolean, uncertain boolean, newest bigint, late bigint"
)
_NAMES = [c.split()[0] for c in _STATE.split(", ")]
_OUT = (
    "source_id string, kind string, source string, ts_raw string, text string, line_start bigint, "
    "line_end bigint, line_count bigint, truncated boolean, sensitive boolean, "
    "parse_uncertain boolean, out_of_order bigint"
)
#: Groups that sources are dealt to. Part of a checkpoint: a stream goes on with the number it began with.
GROUPS = 512
#: Lines of a source from which on they are taken as arrays; fewer are followed one by one.
MANY = 24
_EVENT, _BODIES = re.compile(W._EVENT), [re.compile(b) for b in W._BODIES]
_NEVER = np.iinfo(np.int64).min
_FRESH = (False, False, False, False, False, None, None, None, 0, 0, 0, False, False, False, None, 0)


def tail_stream(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """Lines ``(source, line_no, raw)`` from JSON files that keep arriving in a folder."""
    return (
        spark.readStream.schema(S.LINE).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    )


def tail_topic(spark: SparkSession, servers: str, topic: str, per_trigger: int = 1_000_000) -> DataFrame:
    """Lines from a Kafka topic whose key is the source record as JSON; offsets number the lines.

    Needs Spark's Kafka connector on the class path.
    """
    raw = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic).option("maxOffsetsPerTrigger", per_trigger).load()
    )
    return raw.select(
        F.from_json(F.col("key").cast("string"), S.SOURCE).alias("source"),
        (F.col("offset") + 1).alias("line_no"), F.col("value").cast("string").alias("raw"),
    )


def _clip(text: str, limit: int) -> str:
    raw = text.encode("utf-8")
    return text if len(raw) <= limit else raw[:limit].decode("utf-8", "ignore")


def _text_of(lines: list[str], limit: int) -> tuple[str, bool]:
    """The clipped text of lines, and whether it was clipped."""
    text = "\n".join(lines)
    if 4 * len(text) <= limit or len(text.encode("utf-8")) <= limit:
        return text, False
    text = _clip(lines[0], limit)
    for line in lines[1:]:
        if len(text.encode("utf-8")) == limit:
            break
        text = _clip(text + "\n" + line, limit)
    return text, True


class _Columns:
    """Columns of ordered lines as arrays."""

    def __init__(self, lines: pd.DataFrame):
        def true(name):
            return lines[name].eq(True).to_numpy(dtype=bool)

        self.eof, self.partial, self.trunc, self.py = true("eof"), true("partial"), true("trunc"), true("py")
        self.marked, self.opens = lines["mark"].notna().to_numpy(), lines["mark"].eq("BEGIN").to_numpy(dtype=bool)
        self.kept = true("has_body") | self.trunc
        self.changed, self.doubt = true("changed") | true("source_changed"), true("doubt") | true("ambiguous")
        self.stamped = lines["ts_us"].notna().to_numpy()
        self.ts_us = np.full(len(lines), _NEVER)
        self.ts_us[self.stamped] = lines["ts_us"].to_numpy()[self.stamped].astype(np.int64)
        self.letter = lines["letter"].to_numpy(dtype=object)
        self.explicit = lines["letter"].isin(list("CGRHP")).to_numpy()
        # Upper case opens stack context, in a line after a Python frame too.
        alt = lines["alt"].to_numpy(dtype=object)
        self.alt = np.where(self.explicit & (alt == "c"), "C", alt)
        self.line_no, self.safe = lines["line_no"].to_numpy(), lines["safe"].to_numpy(dtype=object)
        self.source, self.ts_raw = lines["source"].to_numpy(dtype=object), lines["ts_raw"].to_numpy(dtype=object)


class FrameLines(StatefulProcessor):
    """Follows line letters of the sources of a group, one source after the other."""

    def __init__(self, preview: bool):
        self.preview = preview

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("frames", "source_id string", _STATE)
        self.runs = SortedRuns(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _OUT.split(", ")]
        any_known = self.state.exists()
        source, st, known, ended = None, None, False, False
        for lines in self.runs.in_order(unpacked(rows), ["source_id", "line_no"]):
            out, one_by_one, columns = [], None, None
            ids = lines["source_id"].to_numpy(dtype=object)
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for lo, hi in zip(cuts, cuts[1:]):
                if ids[lo] != source:
                    out += self._leave(source, st, known, ended)
                    source = ids[lo]
                    known = any_known and self.state.containsKey((source,))
                    st = dict(zip(_NAMES, self.state.getValue((source,)) if known else _FRESH))
                if hi - lo < MANY:
                    one_by_one = one_by_one or list(lines.itertuples(index=False))
                    for r in one_by_one[lo:hi]:
                        ended = bool(r.eof)
                        out += self._end(source, st, r.partial) if ended else self._line(source, st, r)
                    continue
                columns = columns or _Columns(lines)
                for end in [*(np.flatnonzero(columns.eof[lo:hi]) + lo).tolist(), hi]:
                    if lo < end:
                        out += self._lines(source, st, columns, lo, end)
                    if end < hi:
                        out += self._end(source, st, columns.partial[end])
                    lo = end + 1
                ended = bool(columns.eof[hi - 1])
            if out:
                yield pd.DataFrame(out, columns=names)
        out = self._leave(source, st, known, ended)
        if out:
            yield pd.DataFrame(out, columns=names)

    def _leave(self, source, st, known, ended):
        """Keep the state of a source after its rows of a trigger; its pending event, if that is to be shown."""
        if source is None:
            return []
        if not ended:
            self.state.updateValue((source,), tuple(st[n] for n in _NAMES))
        elif known:  # nothing of a finished source is kept
            self.state.removeKey((source,))
        return [self._row(source, "pending", st)] if self.preview and st["has"] else []

    def _end(self, key, st, partial):
        if st["has"] and partial:
            st["truncated"] = st["uncertain"] = True
        return self._close(key, st)

    def _line(self, key, st, r):
        """The event that a line closes, if any."""
        private = st["in_key"] or r.mark is not None
        if r.mark is not None:
            st["in_key"] = r.mark == "BEGIN"
        if not (r.has_body or private or r.trunc):
            return []
        late = False
        if pd.notna(r.ts_us):
            late = st["newest"] is not None and r.ts_us < st["newest"]
            if not late:
                st["newest"] = int(r.ts_us)
        text = P.KEY_BLOCK_TEXT if private else r.safe
        changed = bool(private or r.changed or r.source_changed)
        doubt = bool(r.doubt or r.ambiguous)
        explicit = r.letter in "CGRHP"
        letter = r.alt if st["py"] else r.letter
        continues = (
            letter in "cC" or (letter in "gGrRb" and st["go"]) or (letter in "sb" and st["stack"])
        )
        st["py"] = bool(r.py)
        if continues and st["has"]:
            joined = st["text"] + "\n" + text
            st["stack"] = st["stack"] or explicit
            st["line_end"], st["line_count"] = int(r.line_no), st["line_count"] + 1
            st["truncated"] = bool(
                st["truncated"] or r.trunc or len(joined.encode("utf-8")) > S.MAX_EVENT_BYTES
            )
            st["sensitive"], st["uncertain"] = st["sensitive"] or changed, st["uncertain"] or doubt
            st["text"], st["late"] = _clip(joined, S.MAX_EVENT_BYTES), st["late"] + late
            return []
        orphan = continues and not st["has"]
        closed = self._close(key, st)
        st.update(
            has=True, source=r.source, ts_raw=r.ts_raw, text=_clip(text, S.MAX_EVENT_BYTES),
            line_start=int(r.line_no), line_end=int(r.line_no), line_count=1,
            truncated=bool(r.trunc or len(text.encode("utf-8")) > S.MAX_EVENT_BYTES),
            sensitive=changed, uncertain=bool(doubt or orphan), late=int(late),
            stack=explicit, go=letter in "pPrR", py=bool(r.py),
        )
        return closed

    def _lines(self, key, st, c: _Columns, lo: int, hi: int):
        """The events that the lines from ``lo`` to ``hi`` close: what ``_line`` gives for one after the other."""
        private = np.full(hi - lo, bool(st["in_key"]))
        if c.marked[lo:hi].any():
            marked, opens = c.marked[lo:hi], c.opens[lo:hi]
            last = np.maximum.accumulate(np.where(marked, np.arange(hi - lo), -1))
            before = np.concatenate(([-1], last[:-1]))
            private = marked | np.where(before >= 0, opens[before], st["in_key"])
            st["in_key"] = bool(opens[last[-1]])
        at = np.flatnonzero(c.kept[lo:hi] | private)
        if not len(at):
            return []
        private, at = private[at], at + lo
        newest = np.maximum.accumulate(np.concatenate(([_NEVER if st["newest"] is None else st["newest"]], c.ts_us[at])))
        late = c.stamped[at] & (c.ts_us[at] < newest[:-1])
        st["newest"] = None if newest[-1] == _NEVER else int(newest[-1])
        texts = np.where(private, P.KEY_BLOCK_TEXT, c.safe[at]).tolist() if private.any() else c.safe[at].tolist()
        changed, doubt, trunc, explicit, no, py = private | c.changed[at], c.doubt[at], c.trunc[at], c.explicit[at], c.line_no[at], c.py[at]
        letters = "".join(np.where(np.concatenate(([bool(st["py"])], py[:-1])), c.alt[at], c.letter[at]).tolist())
        entry = 2 * bool(st["go"]) + bool(st["stack"]) if st["has"] else 4
        lead = _BODIES[entry].match(letters).end()
        starts = [m.start() for m in _EVENT.finditer(letters, lead)]
        if lead:
            text, cut = _text_of([st["text"], *texts[:lead]], S.MAX_EVENT_BYTES)
            st.update(
                text=text, line_end=int(no[lead - 1]), line_count=st["line_count"] + lead, late=st["late"] + int(late[:lead].sum()),
                stack=bool(st["stack"] or explicit[:lead].any()), truncated=bool(st["truncated"] or cut or trunc[:lead].any()),
                sensitive=bool(st["sensitive"] or changed[:lead].any()), uncertain=bool(st["uncertain"] or doubt[:lead].any()),
            )
        out = []
        if starts:
            out += self._close(key, st)
            ends, first = [*starts[1:], len(letters)], np.array(starts)
            held = [_text_of(texts[a:b], S.MAX_EVENT_BYTES) for a, b in zip(starts, ends)]
            cuts = np.array([h[1] for h in held]) | np.logical_or.reduceat(trunc, first)
            unsure = np.logical_or.reduceat(doubt, first)
            unsure[0] |= entry == 4 and letters[lead] in "cC"
            rows = list(zip(
                c.source[at[first]].tolist(), c.ts_raw[at[first]].tolist(), (h[0] for h in held), map(int, no[first]),
                (int(no[b - 1]) for b in ends), (b - a for a, b in zip(starts, ends)), cuts.tolist(),
                np.logical_or.reduceat(changed, first).tolist(), unsure.tolist(), np.add.reduceat(late.astype(np.int64), first).tolist(),
            ))
            out += [(key, "event", *r) for r in rows[:-1]]
            names = ("source", "ts_raw", "text", "line_start", "line_end", "line_count", "truncated", "sensitive", "uncertain", "late")
            st.update(zip(names, rows[-1]))
            st.update(has=True, stack=bool(explicit[starts[-1]:].any()), go=letters[starts[-1]] in "pPrR")
        st["py"] = bool(py[-1])
        return out

    def _row(self, key, kind, st):
        return (
            key, kind, st["source"], st["ts_raw"], st["text"], st["line_start"], st["line_end"],
            st["line_count"], st["truncated"], st["sensitive"], st["uncertain"], st["late"],
        )

    def _close(self, key, st):
        if not st["has"]:
            return []
        row = self._row(key, "event", st)
        st.update(has=False, stack=False, py=False, go=False, text=None, late=0)
        return [row]

    def close(self) -> None:
        pass


def frame_stream(lines: DataFrame, with_json: bool = True, preview: bool = False) -> DataFrame:
    """Events (``kind`` event) and, on request, pending previews of a line stream.

    An optional ``eof`` column marks the end of a source: it flushes the pending event, which is
    truncated and uncertain when the end row is ``partial``, and clears what is kept of the source.
    """
    if "eof" not in lines.columns:
        lines = lines.withColumn("eof", F.lit(False))
    d = W.line_letters(W.stamp_lines(W.identify(lines)))
    d = R.with_redaction(d, "body", with_json)
    d = d.select(
        "source_id", F.to_json("source").alias("source"), "line_no", "ts_raw", "safe",
        (F.col("body") != "").alias("has_body"),
        W.key_mark().alias("mark"),
        "letter", "alt", "py", "trunc", "changed", "ambiguous", "doubt", "source_changed",
        F.coalesce("eof", F.lit(False)).alias("eof"), F.coalesce("partial", F.lit(False)).alias("partial"),
        F.unix_micros(F.try_to_timestamp("ts_raw")).alias("ts_us"),
    )
    d = d.withColumn("group", F.pmod(F.xxhash64("source_id"), F.lit(GROUPS)).cast("int"))
    framed = d.mapInArrow(packed("group"), "group int, rows binary").groupBy("group").transformWithStateInPandas(
        statefulProcessor=FrameLines(preview), outputStructType=_OUT, outputMode="Append", timeMode="None",
    )
    framed = framed.withColumn("source", F.from_json("source", S.SOURCE))
    return framed.select(
        "kind", X.event_id("source", "ts_raw", "line_start", "text").alias("id"), "source", "source_id",
        "ts_raw", F.try_to_timestamp("ts_raw").alias("ts"), "text", "line_start", "line_end", "line_count",
        "truncated", "sensitive", "parse_uncertain", X.group_id("source", "text").alias("group_id"),
        C.baseline("text").alias("baseline"), "out_of_order",
    )
