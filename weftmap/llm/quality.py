"""Quality rules: repetition counts and distribution divergence, all in DataFrame functions.

A document is compared with the reference of its language in two histograms: shares of
character classes, and shares of common words among all words.  The references are sums
over *all* documents of each language.  Distance is the Jensen-Shannon distance (square root
of the divergence in bits), 0 for equal and 1 for disjoint histograms.

Defined results
    null, empty, blank text    no words: base_failed, not kept
    short text                 under ``min_chars`` or ``min_words`` a histogram says little:
                               that distance is null and rejects nothing
    unknown or null language   the smallest distance over all references counts
    no usable reference        distances are null; only the base rules decide
    repeated rows, extra or clashing columns   each row is judged alone; columns are kept, but for one of
                               the name that the verdict gets
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import positional, restored, saved, words_of

# Frequent function words of each language, lower case.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "are", "as", "with", "be", "this"],
    "de": ["der", "die", "und", "das", "von", "zu", "mit", "den", "ist", "des", "auf", "für", "ein", "eine", "sich", "als"],
    "fr": ["le", "les", "et", "des", "un", "une", "du", "pour", "que", "qui", "dans", "est", "par", "au", "sur", "elle"],
    "es": ["el", "los", "y", "la", "de", "que", "en", "las", "del", "se", "por", "con", "una", "para", "su", "al"],
}
#: Most frequent first, language by language in turn.
VOCABULARY = list(dict.fromkeys(w for rank in zip(*COMMON_WORDS.values()) for w in rank))
LETTERS = string.ascii_letters + string.digits
#: Character classes, taken off the text one after the other; what is left is the last class.
CLASSES = ["[a-z]+", "[ ]+", r"\p{Ll}+", "[A-Z]+", r"[.,;:!?'\"()\-]+", r"[\x09-\x0D]+", "[0-9]+", r"\p{L}+"]
WINDOW = 5

MAX_CHAR_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.50
MIN_CHARS = 200
MIN_WORDS = 80


def _bind(value: Column, f) -> Column:
    """f(value), with the value computed once for all lambdas in f."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words inside ``window``-word windows that occur twice or more in the array.

    One sort finds them: hash bits of the window above, its position below, in one long, so
    equal windows become neighbours in a primitive sort.  The words themselves are compared
    before a pair of neighbours counts, so a chance collision adds nothing.  Window hashes
    are folded pairwise (1, 2, 4, ... words), which needs few steps a word.
    """
    n = F.size(words)
    rest = lambda x, k: F.slice(x, k + 1, F.greatest(n - k, F.lit(0)))

    def fold(h: Column) -> Column:
        """Hashes of ``window`` words from hashes of one; the last window - 1 mean nothing."""
        have, size, out, at = h, 1, None, 0
        left = window
        while left:
            if left & 1:
                part = rest(have, at) if at else have
                out = part if out is None else F.zip_with(out, part, lambda a, b: F.xxhash64(a, b))
                at += size
            left >>= 1
            if left:
                have = F.zip_with(have, rest(have, size), lambda a, b: F.xxhash64(a, b))
                size *= 2
        return out

    def count(bits: Column) -> Column:
        up = lambda x: F.call_function("shiftleft", x, bits)  # noqa: E731  the width is a column
        down = lambda x: F.call_function("shiftright", x, bits)

        def place(x: Column) -> Column:
            return (x - up(down(x))).cast("int")

        def same(a: Column, b: Column) -> Column:
            equal = down(a.bitwiseXOR(b)) == 0
            for k in range(window):
                equal = equal & (F.get(words, place(a) + k) == F.get(words, place(b) + k))
            return equal

        def covered(order: Column) -> Column:
            hit = F.filter(order, lambda x, k: same(x, F.get(order, k - 1)) | same(x, F.get(order, k + 1)))
            return F.sort_array(F.transform(hit, place))

        def total(at: Column) -> Column:
            steps = F.transform(at, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - p, F.lit(window))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        hashes = F.slice(fold(F.transform(words, lambda w: F.xxhash64(w))), F.lit(1), n - window + 1)
        packed = F.sort_array(F.transform(hashes, lambda h, i: up(h).bitwiseOR(i.cast("long"))))
        return _bind(_bind(packed, covered), total)

    bits = F.ceil(F.log2(n.cast("double") + 1)).cast("int")
    return F.when(n < window, F.lit(0).cast("long")).otherwise(_bind(bits, count))


def char_histogram(text: Column) -> Column:
    """Array of code point counts, one for each class of ``CLASSES`` and one for the rest."""
    left, sizes = text, [F.length(text)]
    for pattern in CLASSES:
        left = F.regexp_replace(left, pattern, "")
        sizes.append(F.length(left))
    counts = [a - b for a, b in zip(sizes, sizes[1:])] + [sizes[-1]]
    return F.array(*[c.cast("double") for c in counts])


def word_histogram(words: Column) -> Column:
    """Array of counts of ``VOCABULARY`` and, last, of all other words.

    Each common word becomes one letter of a string; taking a letter off the string gives its count.
    """
    common = F.filter(words, lambda w: w.isin(VOCABULARY))
    vocabulary = F.array(*[F.lit(w) for w in VOCABULARY])
    letters = F.array_join(F.transform(common, lambda w: F.substring(F.lit(LETTERS), F.array_position(vocabulary, w).cast("int"), F.lit(1))), "")
    taken = lambda s: F.transform(F.array(*[F.lit(c) for c in LETTERS[: len(VOCABULARY)]]), lambda c: (F.octet_length(s) - F.octet_length(F.replace(s, c, F.lit("")))).cast("double"))
    return _bind(letters, lambda s: F.array_append(taken(s), (F.size(words) - F.octet_length(s)).cast("double")))


def js_distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance of two count arrays; null if either is empty or sums to 0."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    def bits(p: Column, q: Column) -> Column:
        return (part(p, (p + q) / 2) + part(q, (p + q) / 2)) / 2

    def distance(sums: Column) -> Column:
        d = total(F.zip_with(a, b, lambda x, y: bits(x / sums["a"], y / sums["b"])))
        return F.when((sums["a"] > 0) & (sums["b"] > 0), F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), d))))

    # the sums are bound once, not summed again for every bin
    return _bind(F.struct(total(a).alias("a"), total(b).alias("b")), distance)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def histograms(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the words __w, and the histograms __c of character classes and __f of common words."""
    df = docs.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("__w", words_of(F.col("__t")))
    return df.withColumn("__c", char_histogram(F.col("__t"))).withColumn("__f", word_histogram(F.col("__w")))


def features(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with __c, __f and the struct __n of counts."""
    df = histograms(docs, text)
    lines = F.filter(F.split("__t", "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("__l", lines)
    counts = F.struct(
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__w")).alias("n_repeat_words"),
        F.length("__t").cast("long").alias("chars"),
    )
    return df.withColumn("__n", counts).drop("__w", "__l", "__t")


def language_references(parts: DataFrame, lang: str) -> DataFrame:
    """One row: __refs, the summed histograms of each language of ``COMMON_WORDS`` that is found.

    Its size is bounded by the list of languages, whatever the input holds.
    """
    known = parts.where(F.col(lang).isin(*COMMON_WORDS)).select(F.col(lang).alias("__lang"), "__c", "__f")
    nc, nf = len(CLASSES) + 1, len(VOCABULARY) + 1
    sums = known.groupBy("__lang").agg(*[F.sum(F.col("__c")[i]).alias(f"c{i}") for i in range(nc)], *[F.sum(F.col("__f")[i]).alias(f"f{i}") for i in range(nf)])
    entry = F.struct("__lang", F.array(*[f"c{i}" for i in range(nc)]).alias("__rc"), F.array(*[f"f{i}" for i in range(nf)]).alias("__rf"))
    return sums.agg(F.collect_list(entry).alias("__refs"))


def judged(df: DataFrame, refs: DataFrame, lang: str, min_chars: int, min_words: int, max_char: float, max_word: float) -> DataFrame:
    """Rows of ``features`` with the struct __quality in place of the helper columns."""
    df = df.crossJoin(F.broadcast(refs))  # one row, of at most one entry a language
    own = F.filter("__refs", lambda r: r["__lang"] == F.col(lang))
    df = df.withColumn("__refs", F.when(F.size(own) > 0, own).otherwise(F.col("__refs")))
    least = lambda mine, theirs: F.array_min(F.transform("__refs", lambda r: js_distance(F.col(mine), r[theirs])))
    n = F.col("__n")
    df = df.withColumn("__d", F.struct(F.when(n["chars"] >= min_chars, least("__c", "__rc")).alias("chars"), F.when(n["n_words"] >= min_words, least("__f", "__rf")).alias("words")))
    failed = (n["n_words"] < 10) | (100 * n["n_repeat_words"] > 20 * n["n_words"])
    far = F.coalesce(F.col("__d.chars") > max_char, F.lit(False)) | F.coalesce(F.col("__d.words") > max_word, F.lit(False))
    out = F.struct(*[n[c].alias(c) for c in COUNTS], F.col("__d.chars").alias("char_distance"), F.col("__d.words").alias("word_distance"), failed.alias("base_failed"), (~failed & ~far).alias("kept"))
    # through a generator, so that a filter on the verdict can't move below and repeat what it is made of
    return df.withColumn("__quality", F.explode(F.array(out))).drop("__c", "__f", "__n", "__d", "__refs")


def judge_quality(docs: DataFrame, text: str = "text", lang: str = "lang", min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE, out: str = "__quality") -> DataFrame:
    """``docs`` with one struct column ``out`` of all counts, distances and the verdict.

    Two scans and no shuffle of texts: the first sums the references (one row), the second
    judges each row where it is read.
    """
    inner, (text, lang) = positional(docs, text, lang)
    refs = language_references(histograms(inner.select(lang, text), text), lang)
    found = judged(features(inner, text), refs, lang, min_chars, min_words, max_char, max_word)
    return found.select(*[F.col(f"in{k}").alias(c) for k, c in enumerate(docs.columns) if c != out], F.col("__quality").alias(out))


def quality_digest(docs: DataFrame, text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Verdicts without the texts: one scan writes the features, the rest reads those."""
    inner, (body, of, *kept) = positional(docs, text, lang, *keep)
    slim = saved(features(inner.select(*kept, of, body), body).drop(body), "features")
    out = judged(slim, language_references(slim, of), of, MIN_CHARS, MIN_WORDS, MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE)
    return out.select(*[F.col(c).alias(name) for c, name in zip(kept, keep)], "__quality.*")


def filter_quality(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only."""
    inner, (text, lang) = positional(docs, text, lang)
    return restored(judge_quality(inner, text, lang, out="__verdict").where("__verdict.kept"), docs)
