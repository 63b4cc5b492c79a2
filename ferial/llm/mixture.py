"""A mixture of sources that meets target shares of the total size in tokens.

Documents are counted by source and exact token length; only that histogram reaches the driver (at
most the square root of twice the tokens of a source in rows, whatever the number of documents). The largest total for which
every source can supply its share within its cap fixes a budget per source: whole repeats of the source first, then
a part of it. That part takes from every length the same fraction, and what is left of the budget is
fitted by a bounded knapsack over the lengths still free. Which documents of a length are taken is decided
by a seeded hash, by ranks counted in hash buckets, so that no group of equal length is ever sorted in one task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferial.runtime import broadcast_below, checkpoint, small, written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: the split before merges that goes with the rank files
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_KNAPSACK = 1 << 16
_CHOICES = 200_000  # rows of the choice table that may be broadcast


@cache
def _encoder(path: str):
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(enc.encode_ordinary(t)) for t in texts]
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda texts: [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]


def token_counts(df: DataFrame, id_col: str, source_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``id, source, tokens`` of every row with text."""
    src = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _encoder(tokenizer)
        for b in batches:
            n = count(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["id", "source", "tokens"])

    return src.where(F.length("text") > 0).mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, source string, tokens bigint")


def fit(budget: int, counts: dict[int, int]) -> dict[int, int]:
    """How many documents of each length to take so that their sum comes as close to ``budget`` as can be found, never above.

    The same fraction of every length, then the longest that fit until the rest is below 65,536 tokens, then an exact
    bounded subset sum of the rest (bit sets, lengths split into powers of two).
    """
    total = sum(n * k for n, k in counts.items())
    if budget >= total:
        return dict(counts)
    taken = {n: k * budget // total for n, k in counts.items()}
    rest = budget - sum(n * k for n, k in taken.items())
    for n in sorted(counts, reverse=True):
        if rest < _KNAPSACK:
            break
        k = min(counts[n] - taken[n], (rest - _KNAPSACK) // n + 1, rest // n)
        taken[n] += k
        rest -= n * k
    items = []
    for n in sorted(counts):
        free, size = min(counts[n] - taken[n], rest // n), 1
        while free > 0:
            k = min(size, free)
            items.append((n, k))
            free -= k
            size *= 2
    mask = (1 << (rest + 1)) - 1
    reach = [1]
    for n, k in items:
        reach.append((reach[-1] | reach[-1] << (n * k)) & mask)
        if reach[-1] >> rest & 1:
            break
    at = reach[-1].bit_length() - 1
    for i in range(len(reach) - 2, -1, -1):
        if not reach[i] >> at & 1:
            n, k = items[i]
            taken[n] += k
            at -= n * k
    return taken


@dataclass(frozen=True)
class Budget:
    """What a source supplies: ``repeats`` of all its documents, and of each length ``extra`` copies more, dealt evenly."""

    repeats: int
    extra: dict[int, int]
    goal: int


def plan(histogram: dict[str, dict[int, int]], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, Budget]:
    """A budget for every source with a share and text; ``total`` tokens in all, or as many as the caps allow."""
    sizes = {s: sum(n * k for n, k in h.items()) for s, h in histogram.items()}
    usable = {s: (Fraction(share), cap) for s, (share, cap) in targets.items() if share and share > 0 and (cap or 0) > 0 and sizes.get(s)}
    if not usable:
        return {}
    most = min(Fraction(sizes[s] * cap) / share for s, (share, cap) in usable.items())
    size = most if total is None else min(most, Fraction(total))
    out = {}
    for s, (share, cap) in usable.items():
        goal = min(round(share * size), sizes[s] * cap)
        repeats = min(goal // sizes[s], cap)
        rest = goal - repeats * sizes[s]
        extra = fit(rest, histogram[s]) if rest else {}
        if sum(n * k for n, k in extra.items()) < rest and cap - repeats > 1:
            # one more copy of each does not reach the budget: let lengths repeat up to the cap
            extra = fit(rest, {n: k * (cap - repeats) for n, k in histogram[s].items()})
        out[s] = Budget(repeats, extra, goal)
    return out


def mixture(
    docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    tokenizer: str = TOKENIZER, seed: int = 42, total: int | None = None,
) -> DataFrame:
    """``id, source, tokens, copies`` of every document used; targets hold ``source, target_share, max_repeats``.

    Defined results: documents without text, without a source or of a source without a target are not used; rows
    repeated under an id count once; a source that has a share but no text supplies nothing (the report shows it). Equal
    texts under different ids are different documents. The same seed gives the same mixture.
    """
    spark = docs.sparkSession
    wanted = {r[0]: (r[1], r[2]) for r in targets.select("source", "target_share", "max_repeats").where("source IS NOT NULL").collect()}
    known = docs.where(F.col(f"`{source_col}`").isin(list(wanted))) if wanted else docs.limit(0)
    counted = token_counts(known, id_col, source_col, text_col, tokenizer).where("tokens > 0").dropDuplicates(["id"])
    sizes = checkpoint(counted)
    histogram: dict[str, dict[int, int]] = {}
    for r in sizes.groupBy("source", "tokens").count().toLocalIterator():
        histogram.setdefault(r[0], {})[r[1]] = r[2]
    budgets = plan(histogram, wanted, total)
    rows = [(s, n, b.repeats + b.extra.get(n, 0) // k, b.extra.get(n, 0) % k) for s, b in budgets.items() for n, k in histogram[s].items()]
    choice = written(small(spark, rows, "source string, tokens bigint, repeats bigint, extra bigint"))

    chosen = sizes.join(broadcast_below(choice, F.lit(1), _CHOICES), ["source", "tokens"])
    order = F.xxhash64(F.lit(seed), F.col("id"))
    part = chosen.where("extra > 0").select("id", "source", "tokens", "repeats", "extra", order.alias("h"))
    part = part.withColumn("bucket", F.shiftrightunsigned("h", 54))  # 1,024 of them, in the order of the hash
    w = Window.partitionBy("source", "tokens").orderBy("bucket")
    before = (
        part.groupBy("source", "tokens", "bucket").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(w) - F.col("n")).select("source", "tokens", "bucket", "before")
    )
    ranked = part.join(before, ["source", "tokens", "bucket"]).withColumn(
        "rank", F.col("before") + F.row_number().over(Window.partitionBy("source", "tokens", "bucket").orderBy("h", "id"))
    )
    some = ranked.select("id", "source", "tokens", (F.col("repeats") + (F.col("rank") <= F.col("extra")).cast("bigint")).alias("copies"))
    rest = chosen.where("extra = 0").select("id", "source", "tokens", F.col("repeats").alias("copies"))
    return some.unionByName(rest).where("copies > 0").withColumnsRenamed({"id": id_col, "source": source_col})


def shares(mixed: DataFrame, targets: DataFrame, source_col: str = "source") -> DataFrame:
    """The report: per target ``source, target_share, actual_share, tokens, documents, most_copies, max_repeats``."""
    got = mixed.groupBy(F.col(source_col).alias("source")).agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies")
    )
    want = targets.select("source", "target_share", "max_repeats")
    out = want.join(got, "source", "left").na.fill(0, ["tokens", "documents", "most_copies"])
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # one row per source
    return out.withColumn("actual_share", F.coalesce(F.col("tokens") / F.nullif(whole, F.lit(0)), F.lit(0.0)))
