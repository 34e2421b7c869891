"""Functions on sequences of letters: complements, motifs, runs, GC share, chromosome names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

# Nucleotide codes and their complements; S, W and N stand for themselves.
CODES, COMPLEMENTS = "ACGTacgtRYKMBVDHrykmbvdh", "TGCAtgcaYRMKVBHDyrmkvbhd"
# Ways in which chromosomes are named.
CHROMOSOME_NAMES = [r"^(?i:chr(?:omosome)?)[_ ]?([0-9]+|[XYZWM])", r"^(?i:super)[_ ]?([0-9]+|[XYZW])", r"^(?i:lg)[_ ]?([0-9]+)", r"^(?i:scaffold)[_ ]?([0-9]+)", r"#([0-9]+)$", r"^([0-9]+|[XYZW])$"]


def reverse_complement(s: Column) -> Column:
    """All codes, case kept; other letters pass through."""
    return F.reverse(F.translate(s, CODES, COMPLEMENTS))


def reverse_complement_plain(s: Column) -> Column:
    """Upper-cased first; only A, C, G and T change."""
    return F.reverse(F.translate(F.upper(s), "ACGT", "TGCA"))


def motif_count(s: Column, motif: str) -> Column:
    """Occurrences that don't overlap, in either case; 0 for an empty motif."""
    if not motif:
        return F.lit(0)
    low = F.lower(s)
    m = motif.lower()
    return ((F.length(low) - F.length(F.replace(low, F.lit(m), F.lit("")))) / len(m)).cast("int")


def wrapped(s: Column, width: int = 80) -> Column:
    """A newline after every ``width`` letters, none at the end."""
    return F.regexp_replace(F.regexp_replace(s, f"(.{{{width}}})", "$1\n"), "\n$", "")


def gc_share(s: Column) -> Column:
    """G and C among A, C, G, T in either case; NULL without any."""
    acgt = F.length(F.regexp_replace(s, "[^ACGTacgt]", ""))
    return F.length(F.regexp_replace(s, "[^GCgc]", "")) / F.when(acgt > 0, acgt)


def letter_runs(rows: DataFrame, key: str, text: str, letters: str, least: int) -> DataFrame:
    """(key, start, length): maximal runs of some letters, at least so long.

    Splitting at the runs gives the pieces between them; running sums of lengths place them.
    """
    cls = f"[{letters}]"
    gaps = F.regexp_extract_all(text, F.lit(f"{cls}+"), F.lit(0))
    rest = F.split(F.col(text), f"{cls}+", -1)
    p = rows.select(key, F.posexplode(F.arrays_zip(gaps.alias("run"), F.slice(rest, F.lit(1), F.size(gaps)).alias("piece"))).alias("k", "z"))
    w = W.Window.partitionBy(key).orderBy("k")
    size = F.length("z.run")
    end = F.sum(F.length("z.piece") + size).over(w)
    return p.select(key, (end - size).cast("long").alias("start"), size.alias("length")).where(F.col("length") >= least)


def end_motifs(rows: DataFrame, text: str, motif: str, window: int = 10_000, least: float = 0.3) -> DataFrame:
    """Adds density_5p, density_3p and hits: share of either end's letters in a motif or its complement."""
    from_end = F.substring(F.col(text), 1, window)
    to_end = F.col(text).substr(F.greatest(F.lit(1), F.length(text) - window + 1), F.lit(window))
    back = motif[::-1].translate(str.maketrans("ACGTacgt", "TGCAtgca"))
    share = lambda s: F.coalesce(F.greatest(motif_count(s, motif), motif_count(s, back)) * len(motif) / F.when(F.length(s) > 0, F.length(s)), F.lit(0.0))
    out = rows.withColumn("density_5p", share(from_end)).withColumn("density_3p", share(to_end))
    return out.withColumn("hits", F.concat_ws(",", F.when(F.col("density_5p") >= least, "5p"), F.when(F.col("density_3p") >= least, "3p")))


def motif_windows(rows: DataFrame, text: str, motif: str, window: int = 10_000) -> DataFrame:
    """(window, density): share of each window along all segments, end to end, in a motif or its complement, at most 1.

    ``rows`` (order_index, length, ``text``): segments in order; windows may cover several.  A text is cut at the
    borders of windows in one pass, whatever its length, and motifs are counted in the parts; a text
    longer than its segment is cut off, a shorter or missing one has nothing there.
    """
    w = W.Window.orderBy("order_index")  # metadata: lengths alone
    place = rows.select("order_index", F.col("length").cast("long").alias("length"), F.sum("length").over(w).alias("end"))
    place = place.select("order_index", "length", (F.col("end") - F.col("length")).alias("start"))
    total = rows.agg(F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("total"))  # one row
    own = rows.select("order_index", F.col(text).alias("text")).join(place, "order_index").where("text is not null").withColumn("text", F.substring("text", F.lit(1), F.col("length").cast("int")))
    head = (window - F.col("start") % window).cast("int")
    tail = F.regexp_extract_all(F.substring("text", head + 1, F.length("text")), F.lit(f"(?s).{{1,{window}}}"), F.lit(0))
    parts = own.select(F.floor(F.col("start") / window).alias("first"), F.posexplode(F.concat(F.array(F.substring("text", F.lit(1), head)), tail)).alias("k", "part")).where("part <> ''")
    back = motif[::-1].translate(str.maketrans("ACGTacgt", "TGCAtgca"))
    counted = parts.groupBy((F.col("first") + F.col("k")).alias("window")).agg(F.sum((motif_count(F.col("part"), motif) + motif_count(F.col("part"), back)) * len(motif)).alias("letters"))
    every = total.where("total > 0").select("total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / window))).alias("window"))
    size = F.least(F.col("total"), (F.col("window") + 1) * window) - F.col("window") * window
    return every.join(counted, "window", "left").select("window", F.least(F.lit(1.0), F.coalesce("letters", F.lit(0)) / size).alias("density"))


def sequence_marks(rows: DataFrame, text: str, texture: int, motif: str = "TTAGGG", window: int = 10_000, least: float = 0.3) -> DataFrame:
    """(track, p): pixels with a gap (a run of N) or a telomere (motifs at an end), each once.

    ``rows`` (order_index, length, pixel_start, pixel_end, ``text``).  A run marks every pixel that it touches, one at
    least; an end marks the first or last pixel of its segment.
    """
    span, size = F.col("pixel_end") - F.col("pixel_start"), F.when(F.col("length") > 0, F.col("length")).otherwise(F.length(text))
    at = rows.where(F.col(text).isNotNull() & (span > 0) & (size > 0)).select("order_index", "pixel_start", span.alias("span"), size.alias("size"), F.col(text).alias("text"))
    runs = letter_runs(at.select("order_index", "text"), "order_index", "text", "Nn", 1).withColumnRenamed("length", "letters").join(at.drop("text"), "order_index")
    p0 = F.greatest(F.lit(0), F.floor(F.col("pixel_start") + F.col("start") / F.col("size") * F.col("span")))
    p1 = F.ceil(F.col("pixel_start") + (F.col("start") + F.col("letters")) / F.col("size") * F.col("span"))
    last = F.least(F.greatest(p0 + 1, p1), F.lit(texture)) - 1
    gaps = runs.select(p0.alias("p0"), last.alias("p1")).where("p0 <= p1").select(F.lit("gaps").alias("track"), F.explode(F.sequence("p0", "p1")).alias("p"))
    ends = end_motifs(rows.where(F.col(text).isNotNull()).select("pixel_start", "pixel_end", F.substring(F.col(text), F.lit(1), F.col("length").cast("int")).alias("text")), "text", motif, window, least)
    marks = F.array(F.when(F.col("density_5p") >= least, F.col("pixel_start")), F.when(F.col("density_3p") >= least, F.col("pixel_end") - 1))
    telomeres = ends.select(F.lit("telomeres").alias("track"), F.explode(marks).alias("p")).select("track", F.col("p").cast("long").alias("p")).where(F.col("p").between(0, texture - 1))
    return gaps.select("track", F.col("p").cast("long").alias("p")).unionByName(telomeres).distinct()


def chromosome_of(name: Column) -> Column:
    """Label by the first pattern that fits; NULL if none does."""
    out = F.lit(None).cast("string")
    for p in reversed(CHROMOSOME_NAMES):
        got = F.regexp_extract(name, p, 1)
        out = F.when(got != "", got).otherwise(out)
    return out


def one_hot(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, a, c, g, t): a row a letter; letters other than the four are all 0."""
    p = rows.select(key, F.posexplode(F.filter(F.split(F.upper(text), ""), lambda x: x != "")).alias("pos", "x"))
    return p.select(key, "pos", *[(F.col("x") == c).cast("int").alias(c.lower()) for c in "ACGT"])


def sampled_gc(s: Column, letters: int = 2000) -> Column:
    """``gc_share`` of about so many letters, taken at even steps from the first; NULL without any of the four."""
    step = F.greatest(F.lit(1), F.floor(F.length(s) / letters)).cast("int")
    # the step is bound once, not computed again for every letter
    taken = F.get(F.transform(F.array(step), lambda k: F.array_join(F.filter(F.split(s, ""), lambda x, i: i % k == 0), "")), F.lit(0))
    return gc_share(taken)


def gc_of_bins(segments: DataFrame, texture: int, size: int) -> DataFrame:
    """(p, gc): GC of ``size`` bins from segments (start, end, gc) on ``texture`` pixels, weighted by the pixels that each gives a bin.

    A segment narrower than a bin counts in one; bins without any are left out.
    """
    at = lambda c: F.greatest(F.lit(0), F.least(F.lit(size), F.floor(F.col(c) / texture * size + 0.5))).cast("int")
    s = segments.where("gc is not null").select("gc", (F.col("end") - F.col("start")).alias("pixels"), at("start").alias("b0"), at("end").alias("b1"))
    s = s.withColumn("w", F.col("pixels") / F.greatest(F.lit(1), F.col("b1") - F.col("b0")))
    bins = s.select("gc", "w", F.explode(F.sequence("b0", F.greatest("b0", F.col("b1") - 1))).alias("p")).where(F.col("p") < size)
    return bins.groupBy("p").agg((F.sum(F.col("gc") * F.col("w")) / F.when(F.sum("w") > 0, F.sum("w"))).alias("gc")).where("gc is not null")
