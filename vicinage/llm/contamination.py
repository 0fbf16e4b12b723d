"""Passages of held-out texts inside a corpus.

A *spaced seed* looks at some word positions of a window and ignores the rest.
Two seeds are used, which ignore every third word: ``11011011011`` and
``101101101101``. A run of twelve equal words holds the first seed at two starts
and the second at one, and each of the twelve places is ignored by one of these
three: the run is hit even if any single word of it is replaced. Hits are only
candidates; each is verified word by word along its alignment.

Words that no item holds can't belong to a seed that hits. A table of the items'
words (one byte a slot, sized by their counted number) tells them apart before
anything is hashed. Windows that recur in a document or an item stand for one
another: of each distinct window and its surroundings the first place is taken,
so a text that repeats itself has no more alignments than distinct windows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinage.llm.words import word_codes
from vicinage.session import cut_lineage

WINDOW = 12
#: window starts per block of a document
BLOCK = 2048
#: places that each seed looks at
SEEDS = ((0, 1, 3, 4, 6, 7, 9, 10), (0, 2, 3, 5, 6, 8, 9, 11))


@dataclass(frozen=True)
class Limits:
    """``broadcast_seeds``: the item side is broadcast up to so many seed hashes
    (about 40 bytes each), and joined by exchange beyond it. ``table_slots``: the
    table of item words has at least eight slots a word up to this size; with more
    words than that, all words are hashed."""

    broadcast_seeds: int = 500_000
    table_slots: int = 2**22


def item_words(codes: DataFrame, limits: Limits) -> tuple[bytes, int] | None:
    """Table of the words of ``codes`` (one column, ``code``): a byte of 1 in the slot of every word.

    The driver receives distinct slots, at most ``table_slots``; ``None`` if the
    words are too many for a table that tells anything apart.
    """
    words = codes.select("code").distinct()
    n = words.limit(limits.table_slots // 8 + 1).count()
    if n == 0 or n > limits.table_slots // 8:
        return None
    slots = 2 ** max(10, (16 * n - 1).bit_length() - 1)
    table = bytearray(slots)
    for r in words.select(F.pmod("code", F.lit(slots)).alias("slot")).distinct().collect():
        table[r["slot"]] = 1
    return bytes(table), slots


def seed_hashes(codes: Column, table: tuple[bytes, int] | None = None) -> Column:
    """The hashes of both seeds at every start: array of (pos, hash, window).

    ``window`` is the hash of the thirteen words from the one before the start;
    each run of twelve that the seed may belong to lies within. Starts at which a
    place of the seed holds a word that isn't in ``table`` are left out.
    Sequences shorter than the window have none.
    """
    if table is None:
        known = F.array().cast("array<boolean>")
    else:
        held_by = lambda c: F.substring(F.lit(table[0]), F.pmod(c, F.lit(table[1])).cast("int") + 1, F.lit(1)) == F.lit(b"\x01")
        known = F.transform(codes, held_by)
    held = F.struct(codes.alias("one"), known.alias("known"))
    empty = F.array().cast("array<struct<pos:int,hash:bigint,window:bigint>>")

    def at(words: Column) -> Column:
        one, known = words["one"], words["known"]

        def holds(places: Sequence[int]):
            def test(i: Column) -> Column:
                out = F.get(known, i + places[0])
                for p in places[1:]:
                    out = out & F.get(known, i + p)
                return out

            return test

        def hashed(starts: Column, n: int) -> Column:
            return F.transform(
                starts,
                lambda i: F.struct(
                    i.cast("int").alias("pos"),
                    F.xxhash64(F.lit(n), *[F.get(one, i + p) for p in SEEDS[n]]).alias("hash"),
                    F.xxhash64(F.slice(one, F.greatest(i, F.lit(1)), F.when(i > 0, 13).otherwise(12))).alias("window"),
                ),
            )

        starts = F.sequence(F.lit(0), F.size(one) - WINDOW + 1)
        if table is not None:
            # the places that both seeds look at come first
            starts = F.filter(starts, holds([p for p in SEEDS[0] if p in SEEDS[1]]))
        first, second = starts, F.filter(starts, lambda i: i <= F.size(one) - WINDOW)
        if table is not None:
            first = F.filter(first, holds([p for p in SEEDS[0] if p not in SEEDS[1]]))
            second = F.filter(second, holds([p for p in SEEDS[1] if p not in SEEDS[0]]))
        return F.concat(hashed(first, 0), hashed(second, 1))

    # a one-element array names the words, so that they aren't made again at every start
    named = F.flatten(F.transform(F.filter(F.array(held), lambda w: F.size(w["one"]) >= WINDOW), at))
    return F.coalesce(named, empty)


def _alignment(doc: Column, item: Column, shift: Column) -> Column:
    """Equality of the words of two sequences, over the part where they overlap.

    ``shift`` is the place in ``doc`` that stands against place 0 of ``item``.
    """
    first = F.greatest(F.lit(0), -shift)
    last = F.least(F.size(item), F.size(doc) - shift) - 1
    return F.transform(F.sequence(first, last), lambda i: F.get(doc, i + shift) == F.get(item, i))


def _runs(equal: Column, tolerance: int) -> Column:
    """Longest run of equal words, and longest stretch from an equal word to an equal
    word in which at least ``tolerance`` equal ones lie between any two unequal
    ones: (exact, tolerant, substitutions)."""
    zero = F.lit(0)
    start = F.struct(zero.alias("run"), zero.alias("best"), zero.alias("span"), zero.alias("since"), zero.alias("subs"), zero.alias("best_span"), zero.alias("best_subs"))

    def step(a: Column, e: Column) -> Column:
        run = F.when(e, a["run"] + 1).otherwise(0)
        # the first unequal word of a stretch is bridged, a later one when enough
        # equal ones lie between; else the stretch starts anew after the one before
        bridged = (a["span"] > 0) & ((a["subs"] == 0) | (a["since"] >= tolerance))
        anew = a["since"] > 0
        span = F.when(e | bridged, a["span"] + 1).when(anew, a["since"] + 1).otherwise(0)
        since = F.when(e, a["since"] + 1).otherwise(0)
        subs = F.when(e, a["subs"]).when(bridged, a["subs"] + 1).when(anew, 1).otherwise(0)
        # a stretch ends in an equal word
        better = e & (span > a["best_span"])
        return F.struct(
            run.alias("run"),
            F.greatest(a["best"], run).alias("best"),
            span.alias("span"),
            since.alias("since"),
            subs.alias("subs"),
            F.when(better, span).otherwise(a["best_span"]).alias("best_span"),
            F.when(better, subs).otherwise(a["best_subs"]).alias("best_subs"),
        )

    return F.aggregate(equal, start, step)


def leaked_passages(
    corpus: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    bridge: int = 5,
    limits: Limits = Limits(),
) -> DataFrame:
    """Passages of ``items`` inside ``corpus``, one row per document and item.

    Columns: ``doc_id``, ``item_id``, ``exact_words`` (longest run of equal
    consecutive words), ``tolerant_words`` and ``substitutions`` (longest stretch
    of equal words in which replaced words lie at least ``bridge`` words apart; it
    starts and ends in an equal word, so a replaced word at its edge isn't
    counted), ``shift`` (place of the item's first word in the document at the
    alignment of that stretch) and ``alignments`` (how many of them share a seed;
    of windows that recur only the first place counts, so what a document repeats
    is found where it stands first). Pairs that share a seed are given however
    short their runs; the caller filters.

    Words are runs of letters and digits without regard to case. Documents with
    a null text or id and items likewise have no passages, nor have texts of
    fewer than twelve words. Equal texts under several ids are all reported.
    Extra columns are ignored. Empty tables give an empty result.

    The corpus is read twice (hits, then verification of the few documents with
    hits) and neither its texts nor its hashes are shuffled while the items'
    hashes fit the broadcast limit; beyond it those hashes of the corpus whose
    words all occur in items are exchanged, and Spark splits hot ones.
    """
    docs = corpus.select(corpus[doc_id].alias("doc"), corpus[text].alias("text")).filter(F.col("doc").isNotNull() & F.col("text").isNotNull())
    held = items.select(items[item_id].alias("item"), word_codes(items[text]).alias("item_codes")).filter(F.col("item").isNotNull() & F.col("item_codes").isNotNull()).distinct()
    held = cut_lineage(held)
    seeds = held.select("item", F.explode(seed_hashes(F.col("item_codes"))).alias("s")).groupBy("item", "s.hash", F.col("s.window").alias("item_window")).agg(F.min("s.pos").alias("item_pos"))
    small = seeds.limit(limits.broadcast_seeds + 1).count() <= limits.broadcast_seeds
    side = F.broadcast(seeds) if small else seeds
    table = item_words(held.filter(F.size("item_codes") >= WINDOW).select(F.explode("item_codes").alias("code")), limits)
    # long texts are hashed in overlapping blocks of bounded length, each with the word before it
    coded = docs.select("doc", word_codes(F.col("text")).alias("codes"))
    blocks = coded.select("doc", "codes", F.explode(F.sequence(F.lit(0), F.greatest(F.size("codes") - WINDOW, F.lit(0)), F.lit(BLOCK))).alias("start"))
    blocks = blocks.select("doc", F.greatest(F.col("start") - 1, F.lit(0)).alias("at"), F.slice("codes", F.greatest("start", F.lit(1)), F.lit(BLOCK + WINDOW)).alias("codes"))
    hashes = blocks.select("doc", "at", F.explode(seed_hashes(F.col("codes"), table)).alias("s")).select("doc", (F.col("at") + F.col("s.pos")).alias("pos"), "s.hash", "s.window")
    met = hashes.join(side, "hash").groupBy("doc", "item", "hash", "window", "item_window").agg(F.min("pos").alias("pos"), F.min("item_pos").alias("item_pos"))
    hits = cut_lineage(met.select("doc", "item", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct())
    # documents without a hit leave before their words are counted again
    texts = docs.join(hits.select("doc").distinct(), "doc", "left_semi").select("doc", word_codes(F.col("text")).alias("codes"))
    aligned = hits.join(texts, "doc").join(F.broadcast(held) if small else held, "item")
    runs = aligned.select("doc", "item", "shift", _runs(_alignment(F.col("codes"), F.col("item_codes"), F.col("shift")), bridge).alias("r"))
    # of repeated rows each alignment counts once
    best = F.max_by(F.struct("r.best_span", "r.best_subs", "shift"), F.struct("r.best_span", "r.best", -F.col("r.best_subs"), -F.col("shift")))
    found = runs.groupBy("doc", "item").agg(F.max("r.best").alias("exact_words"), best.alias("b"), F.count_distinct("shift").alias("alignments"))
    return found.select(
        F.col("doc").alias(doc_id),
        F.col("item").alias(item_id),
        F.col("b.shift").alias("shift"),
        "exact_words",
        F.col("b.best_span").alias("tolerant_words"),
        F.col("b.best_subs").alias("substitutions"),
        "alignments",
    )


def leaked_items(passages: DataFrame, *, exact: int | None = 12, tolerant: int | None = None, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """Distinct (document, item) with a passage of at least ``exact`` equal words,
    or of ``tolerant`` words with replaced ones among them."""
    keep = F.lit(False)
    if exact is not None:
        keep = keep | (F.col("exact_words") >= exact)
    if tolerant is not None:
        keep = keep | (F.col("tolerant_words") >= tolerant)
    return passages.filter(keep).select(doc_id, item_id).distinct()
