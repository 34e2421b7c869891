"""Edits as an event log: rows are operations, states are folds of their prefixes.

Operations on one map depend on each other, so a map's log is folded in order, as a stream of
sorted rows; maps are independent.  The log is narrow (a row an edit) and the state is the order
of segments.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

STATE = "map_id long, order_index int, segment string, length long, inverted boolean, scaffold string"


def apply_operation(state: list[list], op: str, a: int, b: int, text: str | None) -> None:
    """One edit, in place, of a list of [segment, length, inverted, scaffold]; invalid ones change nothing.

    cut a at b base pairs; join a with its right neighbour; invert a; move a to b, where a
    later target counts before the removal; paint a with a scaffold (none: unpaint); delete a
    scaffold, which unpaints all of its segments; rename the scaffold of segment a.
    """
    if op == "delete":
        for s in state:
            if s[3] == text:
                s[3] = None
        return
    if not 0 <= a < len(state):
        return
    s = state[a]
    if op == "cut" and 0 < b < s[1]:
        names = ("_R", "_L") if s[2] else ("_L", "_R")
        state[a : a + 1] = [[s[0] + names[0], b, *s[2:]], [s[0] + names[1], s[1] - b, *s[2:]]]
    elif op == "join" and a + 1 < len(state):
        t = state.pop(a + 1)
        s[:3] = f"{s[0]}+{t[0]}", s[1] + t[1], s[2] and t[2]
    elif op == "invert":
        s[2] = not s[2]
    elif op == "move" and 0 <= b < len(state):
        state.insert(b - 1 if b > a else b, state.pop(a))
    elif op == "paint":
        s[3] = text
    elif op == "rename" and s[3] is not None:
        old = s[3]
        for x in state:
            if x[3] == old:
                x[3] = text


LOG_ROW = "map_id long, seq long, op string, a int, b int, text string, length long, inverted boolean"


def _sorted(initial: DataFrame, log: DataFrame) -> DataFrame:
    """Segments of a map, then its operations, all in order; maps side by side.

    A segment is a row of ``LOG_ROW`` with op ``segment``: its name is the text, its scaffold follows
    as a paint.
    """
    none = lambda kind: F.lit(None).cast(kind)
    place = F.col("order_index").cast("long")
    segments = initial.select("map_id", place.alias("seq"), F.lit("segment").alias("op"), F.lit(-1).alias("a"), F.lit(0).alias("b"), F.col("segment").alias("text"), F.col("length").cast("long").alias("length"), "inverted")
    paints = initial.where("scaffold is not null").select("map_id", place.alias("seq"), F.lit("scaffold").alias("op"), F.lit(-1).alias("a"), F.lit(1).alias("b"), F.col("scaffold").alias("text"), none("long").alias("length"), none("boolean").alias("inverted"))
    ops = log.select("map_id", F.col("seq").cast("long").alias("seq"), "op", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "text", none("long").alias("length"), none("boolean").alias("inverted"))
    first = F.when(F.col("op").isin("segment", "scaffold"), 0).otherwise(1)
    rows = segments.unionByName(paints).unionByName(ops).withColumn("first", first)
    return rows.repartition("map_id").sortWithinPartitions("map_id", "first", "seq", "b").drop("first")


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list], Iterator[tuple]]]:
    """(map_id, segments, rows of operations) of each map in sorted rows; only one map is held."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for map_id, own in itertools.groupby(rows, key=lambda r: r[0]):
        state: list[list] = []

        def operations(own=own, state=state) -> Iterator[tuple]:
            for _, seq, op, a, b, text, length, inverted in own:
                if op == "segment":
                    state.append([text, length, inverted, None])
                elif op == "scaffold":
                    state[-1][3] = text
                else:
                    yield seq, op, a, b, text

        yield map_id, state, operations()


def _state_batch(map_id: int, state: list[list]) -> pa.RecordBatch:
    n = len(state)
    columns = [pa.array(c, t) for c, t in zip(zip(*state) if state else [[]] * 4, (pa.string(), pa.int64(), pa.bool_(), pa.string()))]
    return pa.RecordBatch.from_arrays([pa.array([map_id] * n, pa.int64()), pa.array(range(n), pa.int32()), *columns], names=["map_id", "order_index", "segment", "length", "inverted", "scaffold"])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for map_id, state, operations in _maps(batches):
        for _, op, a, b, text in operations:
            apply_operation(state, op, a, b, text)
        yield _state_batch(map_id, state)


def fold(initial: DataFrame, log: DataFrame, upto: int | None = None) -> DataFrame:
    """State of every map after its operations, or after those with seq up to a number.

    ``initial`` (map_id, order_index, segment, length, inverted, scaffold) and ``log`` (map_id,
    seq, op, a, b, text) stream through tasks sorted by map: a task holds the state of one map
    and a batch of rows, however long the log is.
    """
    if upto is not None:
        log = log.where(F.col("seq") <= upto)
    return _sorted(initial, log).mapInArrow(_folded, STATE)


def replay(initial: DataFrame, log: DataFrame, recorded: DataFrame) -> DataFrame:
    """(map_id, seq, matches): the log replayed operation by operation against recorded snapshots.

    ``recorded`` (map_id, seq, digest) has the ``state_digest`` after some operations.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for map_id, state, operations in _maps(batches):
            seqs, digests = [], []
            for seq, op, a, b, text in operations:
                if op == "snapshot":
                    seqs.append(seq), digests.append(text == state_digest(state))
                else:
                    apply_operation(state, op, a, b, text)
            yield pa.RecordBatch.from_arrays([pa.array([map_id] * len(seqs), pa.int64()), pa.array(seqs, pa.int64()), pa.array(digests, pa.bool_())], names=["map_id", "seq", "matches"])

    # a snapshot sorts after the operation that it follows
    marks = recorded.select("map_id", "seq", F.lit("snapshot").alias("op"), F.lit(-1).alias("a"), F.lit((1 << 31) - 1).alias("b"), F.col("digest").alias("text"))
    columns = ["map_id", "seq", "op", "a", "b", "text"]
    return _sorted(initial, log.select(*columns).unionByName(marks)).mapInArrow(run, "map_id long, seq long, matches boolean")


def state_digest(state: list[list]) -> str:
    """MD5 of a state: its segments in order, with orientation and scaffold."""
    return hashlib.md5("|".join(f"{s[0]},{s[1]},{'-' if s[2] else '+'},{s[3] or ''}" for s in state).encode()).hexdigest()


def digests(states: DataFrame) -> DataFrame:
    """(map_id, digest): the ``state_digest`` of states in rows."""
    line = F.concat_ws(",", "segment", F.col("length").cast("string"), F.when(F.col("inverted"), "-").otherwise("+"), F.coalesce("scaffold", F.lit("")))
    rows = F.sort_array(F.collect_list(F.struct("order_index", line.alias("line"))))
    return states.groupBy("map_id").agg(F.md5(F.array_join(F.transform(rows, lambda x: x["line"]), "|")).alias("digest"))


def effective(log: DataFrame) -> DataFrame:
    """Operations that stand after undo and redo rows (of a log that never undoes what isn't there).

    An edit and a redo make the history one longer, an undo one shorter.  Of the edits that
    reached one length the last one counts, and lengths beyond the final one are undone.
    """
    w = W.Window.partitionBy("map_id").orderBy("seq")
    d = log.withColumn("depth", F.sum(F.when(F.col("op") == "undo", -1).otherwise(1)).over(w))
    end = d.groupBy("map_id").agg(F.max_by("depth", "seq").alias("final"))
    edits = d.where(~F.col("op").isin("undo", "redo"))
    last = edits.groupBy("map_id", "depth").agg(F.max("seq").alias("seq"))
    keep = last.join(end, "map_id").where("depth <= final").select("map_id", "seq")
    return log.join(keep, ["map_id", "seq"])


MAX_DEPTH = 1000


class UndoStack:
    """Edits that can be taken back, oldest first, and those taken back; (seq, batch) each.

    A new edit empties the redo side and then drops old edits beyond the depth, but for a part of a
    batch: the oldest one that stays is the first of its batch or has none.  ``settled`` are
    the dropped ones, which stand for good.
    """

    def __init__(self, depth: int):
        self.depth, self.atomic = depth, 0
        self.undo: deque[tuple[int, str | None]] = deque()
        self.redo: list[tuple[int, str | None]] = []
        self.oldest: deque[list] = deque()  # runs of one batch on the undo side: [batch, edits]
        self.settled: list[int] = []

    def _push(self, edit: tuple[int, str | None]) -> None:
        self.undo.append(edit)
        if self.oldest and edit[1] is not None and self.oldest[-1][0] == edit[1]:
            self.oldest[-1][1] += 1
        else:
            self.oldest.append([edit[1], 1])

    def _pop(self) -> tuple[int, str | None]:
        self.oldest[-1][1] -= 1
        if not self.oldest[-1][1]:
            self.oldest.pop()
        return self.undo.pop()

    def _trim(self) -> None:
        while not self.atomic and self.oldest and len(self.undo) - self.oldest[0][1] >= self.depth:
            for _ in range(self.oldest.popleft()[1]):
                self.settled.append(self.undo.popleft()[0])

    def apply(self, seq: int, op: str, batch: str | None) -> None:
        if op == "begin":
            self.atomic += 1
        elif op == "end":
            self.atomic = max(0, self.atomic - 1)
            self._trim()
        elif op in ("undo", "undo_batch"):
            first = self.undo[-1][1] if self.undo else None
            while self.undo:
                self.redo.append(self._pop())
                if op == "undo" or first is None or not self.undo or self.undo[-1][1] != first:
                    break
        elif op in ("redo", "redo_batch"):
            first = self.redo[-1][1] if self.redo else None
            while self.redo:
                self._push(self.redo.pop())
                if op == "redo" or first is None or not self.redo or self.redo[-1][1] != first:
                    break
        else:
            self.redo.clear()
            self._push((seq, batch))
            self._trim()


def standing(log: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(map_id, seq, settled) of the edits that stand after undo and redo of edits and of batches.

    ``log`` (map_id, seq, op, batch): ``undo`` and ``redo`` move one edit, ``undo_batch`` and ``redo_batch`` all
    neighbouring ones of its batch; what isn't there moves nothing.  Between ``begin`` and ``end``, which may
    nest, nothing is dropped.  ``settled`` edits have left the history and can't be undone.  A
    map's log streams through a task that holds no more than the history: ``depth`` edits, and
    the largest batch or atomic action.
    """

    def rows(map_id: int, seqs: list[int], settled: bool) -> pa.RecordBatch:
        n = len(seqs)
        return pa.RecordBatch.from_arrays([pa.array([map_id] * n, pa.int64()), pa.array(seqs, pa.int64()), pa.array([settled] * n, pa.bool_())], names=["map_id", "seq", "settled"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for map_id, own in itertools.groupby(ordered, key=lambda r: r[0]):
            stack = UndoStack(depth)
            for _, seq, op, batch in own:
                stack.apply(seq, op, batch)
                if len(stack.settled) >= 10_000:
                    yield rows(map_id, stack.settled, True)
                    stack.settled = []
            yield rows(map_id, stack.settled, True)
            yield rows(map_id, [seq for seq, _ in stack.undo], False)

    slim = log.select("map_id", F.col("seq").cast("long").alias("seq"), "op", F.col("batch").cast("string").alias("batch"))
    return slim.repartition("map_id").sortWithinPartitions("map_id", "seq").mapInArrow(run, "map_id long, seq long, settled boolean")


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """(map_id, segment, change): added, removed, inverted, moved or unchanged.

    Places are compared among the segments that both states have, so one removal does not
    move all that follow.  Inverted goes before moved.
    """
    key = ["map_id", "segment"]
    rank = lambda df, other: df.join(other.select(*key), key, "left_semi").withColumn("place", F.row_number().over(W.Window.partitionBy("map_id").orderBy("order_index")))
    a = rank(before, after).select(*key, F.col("place").alias("pa"), F.col("inverted").alias("ia"))
    b = rank(after, before).select(*key, F.col("place").alias("pb"), F.col("inverted").alias("ib"))
    both = a.join(b, key).select(*key, F.when(F.col("ia") != F.col("ib"), "inverted").when(F.col("pa") != F.col("pb"), "moved").otherwise("unchanged").alias("change"))
    gone = before.join(after, key, "left_anti").select(*key, F.lit("removed").alias("change"))
    new = after.join(before, key, "left_anti").select(*key, F.lit("added").alias("change"))
    return both.unionByName(gone).unionByName(new)


def diff_report(changes: DataFrame) -> DataFrame:
    """(map_id, body): one line a map with the number of segments of each change of ``differences``."""
    kinds = ("added", "removed", "inverted", "moved", "unchanged")
    counts = changes.groupBy("map_id").agg(*[F.count_if(F.col("change") == k).alias(k) for k in kinds])
    return counts.select("map_id", F.concat_ws(", ", *[F.concat(F.lit(k + " "), F.col(k).cast("string")) for k in kinds]).alias("body"))


def macro(log: DataFrame, marks: DataFrame) -> DataFrame:
    """Operations of each map between its two marks (map_id, after, upto), numbered from 0."""
    w = W.Window.partitionBy("map_id").orderBy("seq")
    inside = log.join(marks, "map_id").where("seq > after and seq <= upto").drop("after", "upto")
    return inside.withColumn("step", (F.row_number().over(w) - 1).cast("long"))


def replay_matches(folded: DataFrame, recorded: DataFrame) -> DataFrame:
    """(map_id, missing, extra): rows of a recorded state that a replay lacks, and the other way round."""
    missing = recorded.exceptAll(folded).groupBy("map_id").agg(F.count(F.lit(1)).alias("m"))
    extra = folded.exceptAll(recorded).groupBy("map_id").agg(F.count(F.lit(1)).alias("x"))
    maps = recorded.select("map_id").union(folded.select("map_id")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return maps.join(missing, "map_id", "left").join(extra, "map_id", "left").select("map_id", zero(F.col("m")).alias("missing"), zero(F.col("x")).alias("extra"))


def batches(log: DataFrame, by: str = "map_id", batch: str = "batch_id") -> DataFrame:
    """(by, first_seq, last_seq, n, batch): runs of neighbouring operations of one batch."""
    w = W.Window.partitionBy(by).orderBy("seq")
    new = (~F.col(batch).eqNullSafe(F.lag(batch).over(w)) | F.lag("seq").over(w).isNull() | F.col(batch).isNull()).cast("int")
    r = log.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return r.groupBy(by, "run").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).cast("long").alias("n"), F.first(batch).alias("batch")).drop("run")


def changed_values(rows: DataFrame, value: str, by: str, order: str) -> DataFrame:
    """Rows whose value differs from the one before, first ones included."""
    w = W.Window.partitionBy(by).orderBy(order)
    marked = rows.withColumn("__first", F.row_number().over(w) == 1).withColumn("__before", F.lag(value).over(w))
    return marked.where(F.col("__first") | ~F.col(value).eqNullSafe(F.col("__before"))).drop("__first", "__before")


#: Commands of a script, one a line, as patterns with named parts in order of the columns a, b, text.
COMMANDS = [
    ("cut", r"^cut\s+(\S+)\s+([0-9]+)$"),
    ("join", r"^join\s+(\S+)\s+(\S+)$"),
    ("invert", r"^invert\s+(\S+)$"),
    ("move_to", r"^move\s+(\S+)\s+to\s+([0-9]+)$"),
    ("move_before", r"^move\s+(\S+)\s+before\s+(\S+)$"),
    ("move_after", r"^move\s+(\S+)\s+after\s+(\S+)$"),
    ("select_where", r"^select\s+where\s+(\S+)(?:\s+(.*))?$"),
    ("select_all", r"^select\s+(all)$"),
    ("select_range", r"^select\s+(\S+)\.\.(\S+)$"),
    ("select", r"^select\s+(\S+)$"),
    ("deselect", r"^(deselect)$"),
    ("scaffold_create", r"^scaffold\s+create\s+(\S+)$"),
    ("scaffold_paint", r"^scaffold\s+paint\s+(\S+)\s+(\S+)$"),
    ("scaffold_unpaint", r"^scaffold\s+unpaint\s+(\S+)$"),
    ("scaffold_delete", r"^scaffold\s+delete\s+(\S+)$"),
    ("autocut", r"^(autocut)\s*(.*)$"),
    ("autosort", r"^(autosort)\s*(.*)$"),
    ("assert", r"^assert\s+(\S+)\s+(.*)$"),
    ("echo", r"^(echo)\s+(.*)$"),
    ("zoom_reset", r"^zoom\s+(reset)$"),
    ("zoom", r"^zoom\s+(\S+)$"),
    ("goto", r"^goto\s+(\S+)\s+(\S+)$"),
]


def commands(lines: DataFrame, *by: str) -> DataFrame:
    """(by, line, command, a, b) from script lines (by, line, body); unknown ones are errors, blanks and # lines vanish."""
    body = F.trim("body")
    name, a, b = F.lit("error"), F.lit(""), F.lit("")
    clean = lambda p, k: F.regexp_replace(F.regexp_extract(body, p, k), "^[\"']|[\"']$", "")
    for command, pattern in reversed(COMMANDS):
        quoted = pattern.replace(r"(\S+)", "(\"[^\"]*\"|'[^']*'|\\S+?)")
        hit = body.rlike(quoted)
        two = quoted.count("(") - quoted.count("(?") >= 2
        name, a, b = F.when(hit, command).otherwise(name), F.when(hit, clean(quoted, 1)).otherwise(a), F.when(hit, clean(quoted, 2) if two else F.lit("")).otherwise(b)
    return lines.where(~body.rlike("^(#.*)?$")).select(*by, "line", name.alias("command"), a.alias("a"), b.alias("b"))


def as_script(log: DataFrame) -> DataFrame:
    """(map_id, seq, command): operations as runnable commands on places."""
    a, b = F.col("a").cast("string"), F.col("b").cast("string")
    ref = F.concat(F.lit("#"), a)
    line = F.when(F.col("op") == "cut", F.concat_ws(" ", F.lit("cut"), ref, b)).when(F.col("op") == "join", F.concat(F.lit("join "), ref, F.lit(" #"), (F.col("a") + 1).cast("string"))).when(F.col("op") == "invert", F.concat(F.lit("invert "), ref)).when(F.col("op") == "move", F.concat(F.lit("move "), ref, F.lit(" to "), b)).when(F.col("text").isNotNull(), F.concat(F.lit("scaffold paint "), ref, F.lit(" "), "text")).otherwise(F.concat(F.lit("scaffold unpaint "), ref))
    return log.select("map_id", "seq", line.alias("command"))


__all__ = ["apply_operation", "as_script", "batches", "changed_values", "commands", "diff_report", "differences", "digests", "effective", "fold", "macro", "replay", "replay_matches", "standing", "state_digest"]
