"""Where the parts of edited segments come from: logs of one map folded as a tree.

A segment is a list of pieces (source, start, end, reversed) of the segments that a map began
with.  A log names segments by place, and places depend on all edits before.  So the log is cut into
chunks, and each chunk is read on its own: its effect is a list of runs of places that moved
together, and of versions of segments that it made.  Effects compose: a run of a later one
looks up the places that it covers in an earlier one.  Composed in pairs, pairs of pairs and so on,
they lead any place of any chunk back to the beginning in as many joins as the number of chunks has
bits; every row of an effect, and every place that an edit names, is a row of these joins.

Versions that share segments (through cuts and joins) form a component, and a component is worked
out in one task: its size is the number of edits to a few segments, not that of the log. A log of a few
chunks is worked out whole, without a search for its components.

Edits that a log holds were made, so each must be valid where it stands; one that isn't is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.tables import dropped, numbered, written

#: Edits of a chunk, and places of a bucket of the joins.
CHUNK, PLACES = 1024, 4096
#: Logs of at most so many chunks are worked out as one component each. Rows and pieces of a batch that tasks return.
WHOLE, ROWS = 8, 8192
EFFECT = "map_id long, chunk long, id long, side int, start long, n long, ref long, version boolean, op string, b long, text string"
PIECE = "struct<source:string,start:long,end:long,reversed:boolean>"
RESOLVED = f"map_id long, id long, segment string, length long, inverted boolean, scaffold string, pieces array<{PIECE}>"


class Places:
    """The order of segments during a chunk: runs of places that it found, and versions that it made."""

    def __init__(self, bound: int):
        self.items: list[tuple[int, int, bool]] = [(0, bound, False)]  # first place or version, number, version

    def take(self, at: int) -> int:
        """The index of the item that stands alone at a place."""
        for k, (ref, n, version) in enumerate(self.items):
            if at < n:
                cut = [(ref, at, False), (ref + at, 1, False), (ref + at + 1, n - at - 1, False)] if not version else [(ref, 1, True)]
                cut = [x for x in cut if x[1]]
                self.items[k : k + 1] = cut
                return k + (at > 0 and not version)
            at -= n
        raise ValueError("an edit names a place behind the last segment")


def _chunk_effect(map_id: int, chunk: int, bound: int, edits: list[tuple]) -> list[tuple]:
    """Rows of ``EFFECT``: operands of versions (with op), and runs and versions in their new order (without)."""
    order, out = Places(bound), []

    def define(k: int, count: int, new: int, op: str, b: int | None, text: str | None, made: int) -> None:
        for side, (ref, _, version) in enumerate(order.items[k : k + count]):
            out.append((map_id, chunk, new, side, 0, 1, ref, version, op, b, text))
        order.items[k : k + count] = [(new + m, 1, True) for m in range(made)]

    for seq, op, a, b, text in edits:
        if op not in ("cut", "join", "invert", "move", "paint"):
            raise ValueError(f"{op} has no place; fold such logs with history.fold")
        k = order.take(a)
        if op == "move":
            item = order.items.pop(k)
            if b == a or b == a + 1:
                order.items.insert(k, item)
                continue
            to = b - 1 if b > a else b
            order.items.insert(order.take(to), item)
        elif op == "join":
            if order.take(a + 1) != k + 1:
                raise AssertionError("neighbours stand side by side")
            define(k, 2, 2 * seq, op, None, None, 1)
        else:
            define(k, 1, 2 * seq, op, b, text, 2 if op == "cut" else 1)
    start = 0
    for ref, n, version in order.items:
        out.append((map_id, chunk, -1, 0, start, n, ref, version, None, None, None))
        start += n
    return out


def _chunk_effects(edits: DataFrame) -> DataFrame:
    """Effects of chunks; ``edits`` (map_id, chunk, bound, seq, op, a, b, text)."""
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.string()]
    names = [c.split()[0] for c in EFFECT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for key, held in groupby(rows, lambda x: x[:3]):
            out += _chunk_effect(*key, [x[3:] for x in held])
            if len(out) >= ROWS:
                yield _batch(out, names, types)
                out = []
        if out:
            yield _batch(out, names, types)

    ordered = _dealt(edits.select("map_id", "chunk", "bound", "seq", "op", "a", "b", "text"), "map_id", "chunk").sortWithinPartitions("map_id", "chunk", "seq")
    return ordered.mapInArrow(run, EFFECT)


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows of few bytes and much work, in all partitions: by size alone they would be put into one or two."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _through(runs: DataFrame, effect: DataFrame, places: int) -> DataFrame:
    """Runs of places (map_id, node, start, n, ref, version, ...) led through the effects of their nodes.

    A run meets the rows of an effect bucket by bucket; each common stretch is made in the bucket
    where it begins.
    """
    cover = lambda first, n: F.explode(F.sequence(F.floor(first / places), F.floor((first + n - 1) / places)))
    left = runs.withColumn("__bucket", cover(F.col("ref"), F.col("n")))
    right = effect.select("map_id", "node", F.col("start").alias("__start"), F.col("n").alias("__n"), F.col("ref").alias("__ref"), F.col("version").alias("__version"))
    right = right.withColumn("__bucket", cover(F.col("__start"), F.col("__n")))
    low = F.greatest("ref", "__start")
    size = F.least(F.col("ref") + F.col("n"), F.col("__start") + F.col("__n")) - low
    met = left.join(right, ["map_id", "node", "__bucket"]).withColumns({"__low": low, "__size": size}).where((F.col("__size") > 0) & (F.floor(F.col("__low") / places) == F.col("__bucket")))
    moved = {"start": F.col("start") + F.col("__low") - F.col("ref"), "n": F.col("__size"), "ref": F.when(F.col("__version"), F.col("__ref")).otherwise(F.col("__ref") + F.col("__low") - F.col("__start")), "version": F.col("__version")}
    return met.withColumns(moved).select(runs.columns)


def _width(bound: int, chunk: int, level: int, places: int) -> int:
    """Places of a bucket where effects of 2**level chunks meet: about one run each, so neither runs nor buckets multiply."""
    return min(places, max(16, bound // (chunk << level)))


def _levels(effect: DataFrame, chunks: int, widths: list[int]) -> list[DataFrame]:
    """Effects (map_id, node, start, n, ref, version) of runs of 1, 2, 4, ... chunks, where a log has so many."""
    out = [written(effect.select("map_id", F.col("chunk").alias("node"), "start", "n", "ref", "version"), "effects")]
    while chunks >> len(out):
        below = out[-1]
        odd = F.col("node") % 2 == 1
        last = below.where(odd)
        runs = last.where("not version").withColumn("node", F.col("node") - 1)
        # a node without a second half ends behind the log: nothing is led through it
        whole = last.where("version").unionByName(_through(runs, below.where(~odd), widths[len(out) - 1]))
        out.append(written(whole.withColumn("node", F.shiftright("node", 1)), "effects"))
    return out


def components(edges: DataFrame) -> DataFrame:
    """(map_id, node, component): the least node that each is linked with; ``edges`` (map_id, a, b).

    In a round a node takes the least label beside it, then the label of that label, so
    long chains halve.
    """
    both = written(edges.select("map_id", F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("map_id", "b", "a")).distinct(), "links")
    now = written(both.groupBy("map_id", "node").agg(F.least("node", F.min("other")).alias("component")), "labels")
    while True:
        beside = both.join(now.select("map_id", F.col("node").alias("other"), F.col("component").alias("label")), ["map_id", "other"]).groupBy("map_id", "node").agg(F.min("label").alias("label"))
        nearer = now.join(beside, ["map_id", "node"]).select("map_id", "node", "component", F.least("component", "label").alias("label"))
        jump = now.select("map_id", F.col("node").alias("label"), F.col("component").alias("next"))
        after = written(nearer.join(jump, ["map_id", "label"], "left").select("map_id", "node", F.least("label", F.coalesce("next", "label")).alias("component"), (F.least("label", F.coalesce("next", "label")) < F.col("component")).alias("moved")), "labels")
        going = after.where("moved").limit(1).count() > 0
        dropped(now)
        now = after
        if not going:
            dropped(both)
            return now.select("map_id", "node", "component")


def cut_pieces(pieces: list[tuple], at: int) -> tuple[list[tuple], list[tuple]]:
    """Pieces before and after so many base pairs; a reversed piece is read from its end."""
    left, right = [], []
    for source, start, end, back in pieces:
        size = end - start
        own = min(max(at, 0), size)
        first, second = ((start, start + own), (start + own, end)) if not back else ((end - own, end), (start, end - own))
        if own:
            left.append((source, *first, back))
        if own < size or not size and at <= 0:
            right.append((source, *second, back))
        at -= size
    return left, right


def apply_to(op: str, operands: list[list], b: int | None, text: str | None) -> list[list]:
    """The segments [segment, length, inverted, scaffold, pieces] that an edit makes of others."""
    name, length, inverted, scaffold, pieces = operands[0]
    if op == "cut":
        if not 0 < b < length:
            raise ValueError(f"{name} of {length} base pairs can't be cut at {b}")
        left, right = cut_pieces(pieces, b)
        names = ("_R", "_L") if inverted else ("_L", "_R")
        return [[name + names[0], b, inverted, scaffold, left], [name + names[1], length - b, inverted, scaffold, right]]
    if op == "join":
        other = operands[1]
        return [[f"{name}+{other[0]}", length + other[1], inverted and other[2], scaffold, pieces + other[4]]]
    if op == "invert":
        return [[name, length, not inverted, scaffold, [(s, a, e, not back) for s, a, e, back in reversed(pieces)]]]
    return [[name, length, inverted, text, pieces]]


def _resolved(rows: DataFrame) -> DataFrame:
    """Versions that stand, worked out by component; ``rows`` (map_id, component, id, side, ref, op, b, text, segment, length, inverted, scaffold).

    A segment of the beginning is a row without op, whose id is -1 - its place; ``ref`` of an operand is a version or such an id.
    In order of id an edit comes after what it takes; a version is taken once at most, and one that isn't stands.
    """
    piece = pa.struct([("source", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reversed", pa.bool_())])
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.list_(piece)]
    names = ["map_id", "id", "segment", "length", "inverted", "scaffold", "pieces"]
    kinds = ("source", "start", "end", "reversed")

    def standing(own: Iterator[tuple]) -> Iterator[tuple]:
        """Standing versions (id, segment) of one component."""
        known: dict[int, list] = {}
        for (id_, op, b, text), operands in groupby(own, lambda x: (x[2], x[5], x[6], x[7])):
            operands = list(operands)
            if op is None:
                _, _, _, _, _, _, _, _, name, length, inverted, scaffold = operands[0]
                known[id_] = [name, length, inverted, scaffold, [(name, 0, length, inverted)]]
                continue
            if any(x[4] not in known for x in operands):
                raise ValueError("an edit names a place behind the last segment")
            for k, made in enumerate(apply_to(op, [known.pop(x[4]) for x in operands], b, text)):
                known[id_ + k] = made
        return ((id_, made) for id_, made in known.items() if id_ >= 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        every = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for (map_id, _), own in groupby(every, lambda x: x[:2]):
            for id_, (name, length, inverted, scaffold, pieces) in standing(own):
                out.append((map_id, id_, name, length, inverted, scaffold, [dict(zip(kinds, p)) for p in pieces]))
                held += 1 + len(pieces)
                if held >= ROWS:
                    yield _batch(out, names, types)
                    out, held = [], 0
        if out:
            yield _batch(out, names, types)

    ordered = _dealt(rows.select("map_id", "component", "id", "side", "ref", "op", "b", "text", "segment", "length", "inverted", "scaffold"), "map_id", "component").sortWithinPartitions("map_id", "component", "id", "side")
    return ordered.mapInArrow(run, RESOLVED)


def _owners(operands: DataFrame, maps: DataFrame, most: int, whole: int) -> list[tuple[DataFrame, DataFrame]]:
    """Operands with their component, and (map_id, component, node) of the segments that each begins with.

    Components are searched for in maps of more than so many chunks; other maps are one each.
    """
    long = F.col("chunks") > whole
    few = operands.join(maps.where(~long).select("map_id"), "map_id", "left_semi").withColumn("component", F.lit(0).cast("long"))
    out = [(few, few.where("ref < 0").select("map_id", "component", F.col("ref").alias("node")))]
    if most > whole:
        many = operands.join(maps.where(long).select("map_id"), "map_id", "left_semi")
        # both versions of a cut are one node
        node = F.when(F.col("ref") < 0, F.col("ref")).otherwise(F.col("ref") - F.col("ref") % 2)
        parts = components(many.select("map_id", F.col("id").alias("a"), node.alias("b")))
        out.append((many.join(parts.select("map_id", F.col("node").alias("id"), "component"), ["map_id", "id"]), parts.where("node < 0")))
    return out


def _with_beginnings(operands: DataFrame, nodes: DataFrame, seg: DataFrame) -> DataFrame:
    """Rows for ``_resolved``: operands, and the segments that their components begin with."""
    none = lambda kind: F.lit(None).cast(kind)
    made = operands.select("map_id", "component", "id", "side", "ref", "op", "b", "text", none("string").alias("segment"), none("long").alias("length"), none("boolean").alias("inverted"), none("string").alias("scaffold"))
    began = nodes.join(seg.withColumn("node", -1 - F.col("place")), ["map_id", "node"])
    return made.unionByName(began.select("map_id", "component", F.col("node").alias("id"), F.lit(0).alias("side"), none("long").alias("ref"), none("string").alias("op"), none("long").alias("b"), none("string").alias("text"), "segment", "length", "inverted", "scaffold"))


def fold_tree(initial: DataFrame, log: DataFrame, chunk: int = CHUNK, places: int = PLACES) -> DataFrame:
    """(map_id, order_index, segment, length, inverted, scaffold, pieces) of every map after its log.

    ``initial`` (map_id, order_index from 0, segment, length, inverted, scaffold); ``log`` (map_id, seq,
    op, a, b, text) with cut, join, invert, move and paint as in ``history.apply_operation``.
    """
    edits = numbered(log.select("map_id", F.col("seq").cast("long").alias("seq"), "op", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "text"), "map_id", "seq", name="number", start=0)
    sizes = initial.groupBy("map_id").agg(F.count(F.lit(1)).alias("segments"))
    logs = edits.groupBy("map_id").agg(F.min("number").alias("first"), F.max("number").alias("last"), F.count_if(F.col("op") == "cut").alias("cuts"))
    # a chunk is a stretch of the numbered log; the first of a map may be short
    part = lambda c: (F.floor(F.col(c) / chunk) - F.floor(F.col("first") / chunk)).cast("long")
    maps = written(sizes.join(logs, "map_id", "left").select("map_id", "segments", "first", (F.col("segments") + F.coalesce("cuts", F.lit(0))).alias("bound"), F.coalesce(part("last") + 1, F.lit(0)).alias("chunks")), "maps")
    placed = edits.join(maps.where("chunks > 0").select("map_id", "first", "bound"), "map_id").withColumn("chunk", part("number"))
    effect = written(_chunk_effects(placed), "effects")
    most, longest = (x or 0 for x in maps.agg(F.max("chunks"), F.max("bound")).first())
    widths = [_width(longest, chunk, k, places) for k in range(most.bit_length())]
    levels = _levels(effect.where("op is null"), most, widths) if most else []
    none = lambda kind: F.lit(None).cast(kind)
    ends = maps.select("map_id", F.col("chunks").alias("chunk"), F.lit(-1).cast("long").alias("id"), F.lit(0).alias("side"), F.lit(0).cast("long").alias("start"), F.col("bound").alias("n"), F.lit(0).cast("long").alias("ref"), F.lit(False).alias("version"), none("string").alias("op"), none("long").alias("b"), none("string").alias("text"))
    items = written(effect.where("op is not null").unionByName(ends), "items")
    for k, known in enumerate(levels):
        # what stands at the input of chunk c was left by the run of chunks that ends there; both halves of
        # the items read those before, so each level is written: unwritten plans would double with it
        going = (F.shiftright("chunk", k) % 2 == 1) & ~F.col("version")
        rest = items.where(~going)
        led = _through(items.where(going).withColumn("node", F.shiftright("chunk", k) - 1), known, widths[k]).drop("node")
        before, items = items, written(rest.unionByName(led).withColumn("chunk", F.shiftleft(F.shiftright("chunk", k + 1), k + 1)), "items")
        dropped(before, known)
    seg = initial.select("map_id", F.col("order_index").cast("long").alias("place"), "segment", F.col("length").cast("long").alias("length"), "inverted", "scaffold")
    # versions, with the segments that they began as
    operands = items.where("op is not null").select("map_id", "id", "side", F.when(F.col("version"), F.col("ref")).otherwise(-1 - F.col("ref")).alias("ref"), "op", "b", "text")
    rows = [_with_beginnings(*x, seg) for x in _owners(operands, maps, most, WHOLE)]
    final = items.where("op is null")
    versions = _resolved(reduce(DataFrame.unionByName, rows)).select("map_id", F.col("id").alias("ref"), "segment", "length", "inverted", "scaffold", "pieces")
    new = final.where("version").select("map_id", "start", "ref").join(versions, ["map_id", "ref"]).drop("ref")
    # runs that stand, place by place (those behind the last segment meet none), with no array longer than a bucket
    stretch = final.where("not version").select("map_id", "start", "ref", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / places))).alias("__k"))
    inside = F.sequence(F.col("__k") * places, F.least((F.col("__k") + 1) * places, F.col("n")) - 1)
    old = stretch.select("map_id", "start", "ref", F.explode(inside).alias("__at")).select("map_id", (F.col("start") + F.col("__at")).alias("start"), (F.col("ref") + F.col("__at")).alias("place")).join(seg, ["map_id", "place"]).drop("place")
    whole = F.array(F.struct(F.col("segment").alias("source"), F.lit(0).cast("long").alias("start"), F.col("length").alias("end"), F.col("inverted").alias("reversed")))
    out = written(old.withColumn("pieces", whole).unionByName(new), "folded")
    dropped(maps, effect, items)
    return out.select("map_id", F.col("start").cast("int").alias("order_index"), "segment", "length", "inverted", "scaffold", "pieces")


def pieces_of(states: DataFrame) -> DataFrame:
    """(map_id, order_index, part, source, start, end, reversed): a row a piece of ``fold_tree``'s segments."""
    e = states.select("map_id", "order_index", F.posexplode("pieces").alias("part", "p"))
    return e.select("map_id", "order_index", "part", "p.source", "p.start", "p.end", "p.reversed")


def layout_rows(states: DataFrame) -> DataFrame:
    """One row a piece in layout order: (map_id, object, part, object_start, object_end, source, start, end, orientation).

    Coordinates count from 1 to the end; segments of one scaffold follow each other in one object.
    """
    object_ = F.coalesce(F.col("scaffold"), F.concat(F.lit("unplaced_"), F.col("order_index").cast("string")))
    e = states.select("map_id", object_.alias("object"), "order_index", F.posexplode("pieces").alias("k", "p"))
    w = W.Window.partitionBy("map_id", "object").orderBy("order_index", "k")
    size = F.col("p.end") - F.col("p.start")
    end = F.sum(size).over(w.rowsBetween(W.Window.unboundedPreceding, 0))
    return e.select("map_id", "object", F.row_number().over(w).alias("part"), (end - size + 1).alias("object_start"), end.alias("object_end"), F.col("p.source").alias("source"), (F.col("p.start") + 1).alias("start"), F.col("p.end").alias("end"), F.when(F.col("p.reversed"), "-").otherwise("+").alias("orientation"))
