"""Structured Streaming over edit logs, sequence files and pair events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.history import apply_operation

FOLDED = "map_id long, seq long, edits long, late long, n_segments int, n_inverted int, segment_order string"
STATE = "base_seq long, base string, recent string, edits long, late long"
#: Edits of a map that an edit may come after, and still take its place among them.
KEEP = 10_000


def folded_stream(ops: DataFrame, initial_segments: int, keep: int = KEEP) -> DataFrame:
    """(map_id, seq, edits, late, n_segments, n_inverted, segment_order) after each batch of operations of a map.

    ``ops`` streams (map_id, seq, op, a, b, text) in any order.  State is a snapshot and the last ``keep`` edits
    after it: one that comes late takes its place among them and all after the snapshot are folded
    again, so any split and order of batches within that reach gives the fold of the whole log.
    A number that is there already is a repeat.  Older ones than the snapshot can't be told from
    repeats; they change nothing and are counted in ``late``.
    """
    import json

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            base_seq, text, recent, edits, late = state.get
            base, known = json.loads(text), {o[0]: o for o in json.loads(recent)}
        else:
            base_seq, base, known, edits, late = None, [[f"s{k}", 1000, False, None] for k in range(initial_segments)], {}, 0, 0
        for o in pd.concat(list(batches)).itertuples():
            seq = int(o.seq)
            if base_seq is not None and seq <= base_seq:
                late += 1
            elif seq not in known:
                known[seq] = [seq, o.op, int(o.a), int(o.b), None if pd.isna(o.text) else o.text]
                edits += 1
        order = [known[k] for k in sorted(known)]
        settled = max(0, len(order) - keep)
        for seq, *op in order[:settled]:
            apply_operation(base, *op)
            base_seq = seq
        segments = [list(s) for s in base]
        for _, *op in order[settled:]:
            apply_operation(segments, *op)
        state.update((base_seq, json.dumps(base), json.dumps(order[settled:]), edits, late))
        last = order[-1][0] if order else base_seq
        yield pd.DataFrame({"map_id": [key[0]], "seq": [last], "edits": [edits], "late": [late], "n_segments": [len(segments)], "n_inverted": [sum(s[2] for s in segments)], "segment_order": [",".join(s[0] for s in segments)]})

    return ops.groupBy("map_id").applyInPandasWithState(run, FOLDED, STATE, "update", GroupStateTimeout.NoTimeout)


def contact_stream(events: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, event_type, n, value): sums by event-time window; later events than the watermark are dropped."""
    e = events.withWatermark("ts", late)
    return e.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def fasta_stream(files: DataFrame) -> DataFrame:
    """(file, name, letters) of each record in whole-file text micro-batches (file, value)."""
    r = files.select("file", F.explode(F.split("value", "(?m)^>", -1)).alias("body")).where(F.trim("body") != "")
    name = F.regexp_extract("body", r"^(\S*)", 1)
    seq = F.regexp_replace(F.regexp_replace("body", r"^[^\n]*\n?", ""), r"(?m)^;.*$|\s+", "")
    return r.select("file", name.alias("name"), F.length(seq).alias("letters")).where("name <> ''")


RECORDS = "file string, record long, name string, letters long, closed boolean"
CARRY = "chunk long, tail string, record long, name string, letters long"


def fasta_chunk_stream(chunks: DataFrame) -> DataFrame:
    """(file, record, name, letters, closed) from chunks (file, chunk, value) that cut records and lines anywhere.

    State carries the unfinished line, the open record and the last chunk; a chunk up to that
    one is a repeat.  A batch gives the records that it closes, and the open one as far as it goes.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chunk, tail, record, name, letters = state.get if state.exists else (-1, "", 0, None, 0)
        out = []

        def take(line: str) -> None:
            nonlocal record, name, letters
            if line.startswith(">"):
                if name is not None:
                    out.append((key[0], record, name, letters, True))
                name, letters, record = (line[1:].split() or [""])[0], 0, record + 1
            elif name is not None and not line.startswith(";"):
                letters += len("".join(line.split()))

        for row in pd.concat(list(batches)).sort_values("chunk").itertuples():
            if row.chunk > chunk:
                *lines, tail = (tail + row.value).split("\n")
                for line in lines:
                    take(line)
                chunk = int(row.chunk)
        state.update((chunk, tail, record, name, letters))
        if name is not None:
            more = "" if tail[:1] in (">", ";") else "".join(tail.split())
            out.append((key[0], record, name, letters + len(more), False))
        yield pd.DataFrame(out, columns=["file", "record", "name", "letters", "closed"])

    return chunks.groupBy("file").applyInPandasWithState(run, RECORDS, CARRY, "update", GroupStateTimeout.NoTimeout)


def recompute(stream: DataFrame, update, checkpoint: str, every: str = "1 second"):
    """Starts a query that calls ``update(batch, id)`` on what came in, once a period at most."""
    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def recorded(ops: DataFrame, after: int, upto: int) -> DataFrame:
    """Operations between two marks of the log: a macro."""
    return ops.where((F.col("seq") > after) & (F.col("seq") <= upto))
