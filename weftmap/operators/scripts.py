"""Scripts as logs: the commands of ``history.commands`` run against the states of maps, in one sorted stream.

Commands name segments by place (``#3``) or by name, so each is resolved against the state that
the ones before it left.  A failed command changes nothing and ends its own script, unless told to go on.

    cut, invert         as in ``history``
    join                two neighbours, in either order
    move to/before/after   targets count as the move itself counts them: before the removal
    select ...          selects places; the value is how many
    scaffold ...        create, paint and unpaint a segment, delete; names without regard to case
    assert              contigs, scaffolds, misassemblies, n50 or length against a number
    echo, zoom, goto    succeed if what they name is there; views are no data
    autocut, autosort   need the map: their operations come from ``batch``; here they fail
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .history import _maps, _sorted, apply_operation

EXECUTED = "map_id long, line long, command string, success boolean, value double, order_index int, segment string, length long, inverted boolean, scaffold string"
COMPARE = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq, "!=": operator.ne}
UNITS = {"": 1, "bp": 1, "kb": 1e3, "mb": 1e6, "gb": 1e9}
_CONDITION = re.compile(r"\s*(<=|>=|==|!=|<|>)\s*([0-9]*\.?[0-9]+)\s*(bp|kb|mb|gb)?\s*$", re.I)


class Session:
    """State of one script: segments, scaffold names, selected places."""

    def __init__(self, state: list[list]):
        self.state, self.names, self.selected, self.flags = state, {}, set(), 0

    def start(self) -> None:
        self.names = {s[3].lower(): s[3] for s in self.state if s[3] is not None}

    def place(self, ref: str) -> int:
        if re.fullmatch(r"#[0-9]+", ref):
            at = int(ref[1:])
            if at >= len(self.state):
                raise LookupError(ref)
            return at
        for same in (lambda s: s[0] == ref, lambda s: s[0].lower() == ref.lower()):
            for k, s in enumerate(self.state):
                if same(s):
                    return k
        raise LookupError(ref)

    def metric(self, name: str) -> float:
        lengths = sorted((s[1] for s in self.state), reverse=True)
        if name == "n50":
            sums = 0
            for x in lengths:
                sums += x
                if 2 * sums >= sum(lengths):
                    return x
            return 0
        return {"contigs": len(self.state), "scaffolds": len(self.names), "misassemblies": self.flags, "length": sum(lengths)}[name]

    def where(self, field: str, condition: str) -> set[int]:
        test = {"inverted": lambda s: bool(s[2]), "scaffolded": lambda s: s[3] is not None, "unscaffolded": lambda s: s[3] is None}.get(field)
        if field == "length":
            compare, limit = compared(condition)
            test = lambda s: compare(s[1], limit)
        return {k for k, s in enumerate(self.state) if test(s)}

    def run(self, command: str, a: str, b: str) -> float | None:
        """The value of a command that has one; an exception is a failure."""
        edit = lambda op, at, to=0, text=None: apply_operation(self.state, op, at, to, text)
        if command == "cut":
            at = self.place(a)
            if not 0 < int(b) < self.state[at][1]:
                raise ValueError(b)
            edit("cut", at, int(b))
        elif command == "join":
            x, y = self.place(a), self.place(b)
            if abs(x - y) != 1:
                raise ValueError("not neighbours")
            edit("join", min(x, y))
        elif command == "invert":
            edit("invert", self.place(a))
        elif command.startswith("move_"):
            at = self.place(a)
            to = int(b) if command == "move_to" else self.place(b)
            if command == "move_before" and to > at:
                to -= 1
            if command == "move_after" and to < at:
                to += 1
            if not 0 <= to < len(self.state):
                raise ValueError(b)
            edit("move", at, to)
        elif command in ("select", "select_range", "select_all", "select_where", "deselect"):
            if command == "select_range":
                x, y = sorted((self.place(a), self.place(b)))
                self.selected = set(range(x, y + 1))
            else:
                self.selected = {self.place(a)} if command == "select" else self.where(a, b) if command == "select_where" else set(range(len(self.state))) if command == "select_all" else set()
            return len(self.selected)
        elif command == "scaffold_create":
            self.names[a.lower()] = a
        elif command == "scaffold_paint":
            edit("paint", self.place(a), 0, self.names[b.lower()])
        elif command == "scaffold_unpaint":
            edit("paint", self.place(a))
        elif command == "scaffold_delete":
            edit("delete", 0, 0, self.names.pop(a.lower()))
        elif command == "assert":
            compare, limit = compared(b)
            value = self.metric(a)
            return value if compare(value, limit) else -1.0 - value
        elif command == "zoom":
            self.place(a)
        elif command not in ("echo", "goto", "zoom_reset"):
            raise ValueError(command)
        return None


def compared(condition: str):
    """(comparison, number) of a condition like ``>= 1.5 Mb``."""
    sign, number, unit = _CONDITION.fullmatch(condition).groups()
    return COMPARE[sign], float(number) * UNITS[(unit or "").lower()]


def _executed(batches: Iterator[pa.RecordBatch], go_on: bool) -> Iterator[pa.RecordBatch]:
    for map_id, state, operations in _maps(batches):
        session, rows, begun = Session(state), [], False
        for line, command, a, _, text in operations:
            if rows and not rows[-1][3] and not go_on:
                continue  # the script ended with a failure; the rest of its rows is passed over
            if command == "flags":
                session.flags = a
                continue
            if not begun:
                session.start()
                begun = True
            try:
                value, ok = session.run(command, *text.split("\x1f")), True
                if command == "assert" and value < 0:
                    value, ok = -1.0 - value, False
            except (LookupError, ValueError, TypeError, AttributeError):
                value, ok = None, False
            rows.append((map_id, line, command, ok, value, None, None, None, None, None))
        rows += [(map_id, None, None, None, None, k, *s) for k, s in enumerate(state)]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.float64(), pa.int32(), pa.string(), pa.int64(), pa.bool_(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[c.split()[0] for c in EXECUTED.split(", ")])


def execute(initial: DataFrame, commands: DataFrame, flags: DataFrame | None = None, continue_on_error: bool = False) -> DataFrame:
    """Results of the commands that ran and the final states of all maps, told apart by ``results`` and ``final``.

    ``commands`` (map_id, line, command, a, b); ``flags`` (map_id, misassemblies) for assertions.  A script ends
    at its first failure, which is its last result, unless ``continue_on_error``.
    """
    ops = commands.select("map_id", F.col("line").alias("seq"), F.col("command").alias("op"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.concat("a", F.lit("\x1f"), "b").alias("text"))
    if flags is not None:
        ops = ops.unionByName(flags.select("map_id", F.lit(-(1 << 62)).alias("seq"), F.lit("flags").alias("op"), F.col("misassemblies").cast("int").alias("a"), F.lit(0).alias("b"), F.lit(None).cast("string").alias("text")))
    return _sorted(initial, ops).mapInArrow(lambda batches: _executed(batches, continue_on_error), EXECUTED)


def results(executed: DataFrame) -> DataFrame:
    """(map_id, line, command, success, value): the value of a selection is its size, of an assertion what it found."""
    return executed.where("line is not null").select("map_id", "line", "command", "success", "value")


def final(executed: DataFrame) -> DataFrame:
    """The states of maps after their scripts."""
    return executed.where("line is null").select("map_id", "order_index", "segment", "length", "inverted", "scaffold")


def preview(before: DataFrame, executed: DataFrame) -> DataFrame:
    """(map_id, segment, change): what a script would do, without its states being kept."""
    from .history import differences

    return differences(before, final(executed))
