"""Mixing of sources to target shares by Poisson replication."""

from __future__ import annotations

import base64
import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinage.session import cut_lineage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: fixed value: the splitting pattern of the vocabulary's own tokenizer
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: texts are encoded in pieces of about so many characters, cut before a blank
PIECE = 20_000


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _pieces(text: str) -> list[str]:
    """Consecutive pieces of a text; each starts where a word starts, so that the
    tokens of the pieces are those of the text."""
    out, start = [], 0
    while len(text) - start > PIECE:
        cut = start + PIECE
        while cut < len(text) and not (text[cut] == " " and text[cut - 1].isalnum()):
            cut += 1
        out.append(text[start:cut])
        start = cut
    return [*out, text[start:]]


def token_count(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """Number of tokens of a text; null for null."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encode = _encoding(tokenizer).encode_ordinary
        return texts.map(lambda t: None if t is None else sum(len(encode(p)) for p in _pieces(t))).astype("Int64")

    return count(text)


def expected_copies(rate: float, cap: int) -> float:
    """Mean of a Poisson variable of mean ``rate`` that is cut at ``cap``."""
    below, log_term, total = 0.0, -rate, 0.0
    for k in range(cap):
        term = math.exp(log_term)
        total += k * term
        below += term
        log_term += (math.log(rate) if rate > 0 else -math.inf) - math.log(k + 1)
    return total + cap * max(0.0, 1.0 - below)


def poisson_rate(mean: float, cap: int) -> float | None:
    """The rate at which copies cut at ``cap`` have the given mean; ``None`` when
    every record must be used ``cap`` times."""
    if mean <= 0:
        return 0.0
    if mean >= cap * (1 - 1e-9):
        return None
    low, high = 0.0, 1.0
    while expected_copies(high, cap) < mean:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if expected_copies(mid, cap) < mean else (low, mid)
    return (low + high) / 2


def mixing_plan(sizes: dict[str, float], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, dict]:
    """Mean copies and Poisson rate of each source.

    ``sizes``: tokens available by source; ``targets``: share and greatest number
    of copies. Sources without any token can't contribute; the shares of the
    others are scaled to sum to one. Without ``total``, the mixture is the largest
    in which every remaining source keeps its share. With a larger ``total``,
    sources at their cap give what they have and the rest keep their share of the
    total, so that the mixture falls short rather than lean on other sources.
    """
    usable = {s: (share, cap) for s, (share, cap) in targets.items() if sizes.get(s, 0) > 0 and share > 0 and cap > 0}
    weight = sum(share for share, _ in usable.values())
    if not usable:
        return {}
    if total is None:
        total = min(cap * sizes[s] * weight / share for s, (share, cap) in usable.items())
    plan = {}
    for s, (share, cap) in usable.items():
        mean = min(float(cap), total * share / weight / sizes[s])
        plan[s] = {"target_share": share, "max_repeats": cap, "mean_copies": mean, "rate": poisson_rate(mean, cap), "planned_tokens": mean * sizes[s]}
    return plan


def poisson_table(rate: float | None, cap: int) -> list[float]:
    """The Poisson distribution function at 0, 1, .. below ``cap``, up to where it is
    one to 16 digits; a null rate means ``cap`` copies, that is a function of zeros,
    which is told by an empty table."""
    if rate is None:
        return []
    table, log_term, total = [], -rate, 0.0
    for k in range(cap):
        total += math.exp(log_term)
        table.append(min(1.0, total))
        if k > rate and 1.0 - total < 1e-16:
            break
        log_term += (math.log(rate) if rate > 0 else -math.inf) - math.log(k + 1)
    return table


def copies(table: Column, cap: Column, uniform: Column) -> Column:
    """Inverse of the Poisson distribution function at ``uniform``, cut at ``cap``:
    how many entries of its :func:`poisson_table` have been passed; ``cap`` where
    the table is empty."""
    return F.least(F.when(F.size(table) == 0, cap).otherwise(F.size(F.filter(table, lambda p: uniform >= p))), cap)


def unit_hash(*columns: Column) -> Column:
    """A number in [0, 1) from the hash of the columns; 53 bits."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / float(2**53)


def sized_documents(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc``, ``source``, ``n_tokens`` of every usable document, written once.

    Documents with a null id, source or text and those without a token are left
    out. A repeated id counts once, by its greatest source and size.
    """
    rows = docs.select(docs[doc_id].alias("doc"), docs[source].alias("source"), docs[text].alias("text"))
    rows = rows.filter(F.col("doc").isNotNull() & F.col("source").isNotNull() & F.col("text").isNotNull())
    sized = rows.select("doc", "source", token_count(F.col("text"), tokenizer).alias("n_tokens")).filter(F.col("n_tokens") > 0)
    return cut_lineage(sized.groupBy("doc").agg(F.max(F.struct("source", "n_tokens")).alias("s")).select("doc", "s.source", "s.n_tokens"))


def mix_sources(
    docs: DataFrame,
    targets: DataFrame,
    *,
    total_tokens: float | None = None,
    seed: int = 17,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    tokenizer: str = TOKENIZER,
    max_sources: int = 10_000,
    sized: DataFrame | None = None,
) -> DataFrame:
    """The mixture: one row per copy of a document, in shuffled order.

    Columns: ``doc_id``, ``source``, ``copy_no`` (from 1), ``n_tokens`` and
    ``shuffle_key``; the rows are ordered by ``shuffle_key`` over all partitions.

    ``targets`` has ``source``, ``target_share`` and ``max_repeats``; it names at
    most ``max_sources`` sources (checked), and only it and one size per named
    source reach the driver. Of repeated targets the greatest counts; null or
    non-positive ones and sources without a text contribute nothing, see
    :func:`mixing_plan`. The number of copies of a document is the inverse of the
    Poisson distribution at a hash of its id and ``seed``, cut at
    ``max_repeats``; it depends on no other row. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    sized = sized_documents(docs, doc_id=doc_id, source=source, text=text, tokenizer=tokenizer) if sized is None else sized
    wanted = targets.groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).filter(F.col("source").isNotNull() & F.col("t.target_share").isNotNull() & F.col("t.max_repeats").isNotNull())
    rows = wanted.select("source", "t.target_share", "t.max_repeats").limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    named = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in rows}
    # one row for each of the at most max_sources named sources
    totals = sized.filter(F.col("source").isin(list(named))).groupBy("source").agg(F.sum("n_tokens").alias("n"))
    plan = mixing_plan({r["source"]: float(r["n"]) for r in totals.collect()}, named, total_tokens)
    # a table of a source has about as many entries as its greatest number of copies
    tables = spark.createDataFrame([(s, poisson_table(p["rate"], p["max_repeats"]), p["max_repeats"]) for s, p in plan.items()], "source string, table array<double>, cap int")
    drawn = sized.join(F.broadcast(tables), "source").withColumn("n", copies(F.col("table"), F.col("cap"), unit_hash(F.lit(seed), F.col("doc"))))
    exploded = drawn.filter(F.col("n") > 0).select("doc", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy_no"))
    keyed = exploded.withColumn("shuffle_key", F.xxhash64(F.lit(seed + 1), "doc", "copy_no"))
    ordered = keyed.repartitionByRange("shuffle_key").sortWithinPartitions("shuffle_key", "doc", "copy_no")
    return ordered.select(F.col("doc").alias(doc_id), "source", "copy_no", "n_tokens", "shuffle_key")


def mixture_shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual share of each source: ``source``, ``target_share``,
    ``max_repeats``, ``n_documents``, ``n_copies``, ``n_tokens``, ``actual_share``,
    ``most_copies``. Sources without a document in the mixture have zeros."""
    used = mixture.groupBy("source").agg(
        F.sum(F.when(F.col("copy_no") == 1, 1).otherwise(0)).alias("n_documents"),
        F.count(F.lit(1)).alias("n_copies"),
        F.sum("n_tokens").alias("n_tokens"),
        F.max("copy_no").alias("most_copies"),
    )
    total = used.agg(F.sum("n_tokens").alias("total"))
    wanted = targets.groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).filter(F.col("source").isNotNull())
    return (
        wanted.join(used, "source", "left")
        .join(F.broadcast(total))
        .select(
            "source",
            "t.target_share",
            "t.max_repeats",
            *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_documents", "n_copies", "n_tokens")],
            F.coalesce(F.try_divide("n_tokens", "total"), F.lit(0.0)).alias("actual_share"),
            F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        )
    )
