"""Mixing sources to target shares of the total size in tokens.

Method: Sainte-Lague apportionment. The total is cut into blocks of equal token size; blocks go to sources
one by one to the highest quotient share / (2 k + 1), a source leaving once its text is used as often as it
may. A source's blocks go in the same way to its shards by their tokens, which gives whole quotas per shard.
In a shard, documents stand in a fixed order that is cut into blocks of that many tokens; whole passes over the
shard are taken first, then single blocks drawn by seed until the quota is used up.

The driver sees one row per source and shard of SHARD_TOKENS tokens, never documents or blocks.
"""

from __future__ import annotations

import base64
import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataline.session import cut

#: Tokens of a shard; a source of more is spread over more shards, so no sort holds a whole source.
SHARD_TOKENS = 200_000_000
#: Rows of quotas up to which they are sent to all tasks.
QUOTAS_AT_ONCE = 50_000
DEFAULT_TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> tuple[str, str]:
    """(path, split pattern) of a public tokenizer's rank file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def count_tokens(docs: DataFrame, key: str, source: str, text: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, source, n_tokens) of every document, whole texts. Null and blank texts have 0 tokens.

    The rank file (under 1 MB, fixed) is read on the driver and sent once to every executor.
    """
    if path is None or pattern is None:
        path, pattern = tokenizer_path()
    ranks = docs.sparkSession.sparkContext.broadcast(open(path, "rb").read())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.value.splitlines()) if a}
        enc = tiktoken.Encoding("mix", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t and not t.isspace() else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    slim = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string"))
    return slim.mapInArrow(read, "doc_id bigint, source string, n_tokens bigint")


def sainte_lague(shares: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by the highest quotients share / (2 k + 1), at most ``caps[i]`` each; ties go to the first.

    Found by bisection on the last quotient that wins, then single seats, so the cost doesn't grow with the
    seats. Fewer seats than asked are given only if the caps leave no more.
    """
    n = len(shares)
    seats = min(seats, sum(c for s, c in zip(shares, caps, strict=True) if s > 0))
    if seats <= 0:
        return [0] * n

    def won(q: float) -> list[int]:
        # seats whose quotient is greater than q: the k-th has share / (2 k - 1)
        return [min(c, max(0, math.ceil((s / q + 1) / 2) - 1)) if s > 0 else 0 for s, c in zip(shares, caps, strict=True)]

    lo, hi = max(min((s for s in shares if s > 0), default=1.0), 1e-300) / (4.0 * seats + 4) / 1e3, max(shares) * 2
    for _ in range(200):
        mid = (lo * hi) ** 0.5
        if sum(won(mid)) > seats:
            lo = mid
        else:
            hi = mid
    got = won(hi * (1 + 1e-7))  # a little fewer; seats with equal quotients are given one by one
    next_ = [(-shares[i] / (2 * got[i] + 1), i) for i in range(n) if got[i] < caps[i] and shares[i] > 0]
    heapq.heapify(next_)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(next_)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(next_, (-shares[i] / (2 * got[i] + 1), i))
    return got


def plan(tokens: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int | None = None) -> tuple[list[dict], list[dict], int]:
    """(rows per source, rows per source and shard, block size in tokens).

    Without ``total_tokens`` the mix is as large as it can be with every source that has text reaching its
    share (shares of sources without any text are spread over the others in proportion). Without
    ``block_tokens`` there are about 20,000 blocks, of at least 64 tokens.
    """
    want = {}
    for r in targets.select("source", "target_share", "max_repeats").where("source is not null and target_share > 0").orderBy("source").collect():
        want.setdefault(r["source"], (float(r["target_share"]), max(0.0, float(r["max_repeats"] if r["max_repeats"] is not None else 1.0))))
    have = tokens.where(F.col("source").isin(list(want)) & (F.col("n_tokens") > 0)) if want else tokens.limit(0)
    sizes = {r["source"]: (int(r["t"]), int(r["n"])) for r in have.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}
    present = [s for s in want if sizes.get(s, (0, 0))[0] and want[s][1] > 0]
    part = sum(want[s][0] for s in present)
    most = {s: int(sizes[s][0] * want[s][1]) for s in present}
    if total_tokens is None:
        total_tokens = int(min((most[s] * part / want[s][0] for s in present), default=0))
    block = block_tokens or max(64, total_tokens // 20_000)
    seats = sainte_lague([want[s][0] / part for s in present], total_tokens // block, [most[s] // block for s in present]) if present else []
    by_source = [
        {"source": s, "target_share": want[s][0], "max_repeats": want[s][1], "tokens": sizes.get(s, (0, 0))[0], "blocks": dict(zip(present, seats, strict=True)).get(s, 0)}
        for s in want
    ]
    shards = {s: max(1, -(-sizes[s][0] // SHARD_TOKENS)) for s in present}
    rows = shard_of(have, shards).groupBy("source", "shard").agg(F.sum("n_tokens").alias("t")).collect() if present else []
    per: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["source"], r["shard"])):
        per.setdefault(r["source"], []).append(r)
    by_shard = []
    for s, n in zip(present, seats, strict=True):
        at = per.get(s, [])
        caps = [int(r["t"] * want[s][1]) // block for r in at]
        quota = sainte_lague([float(r["t"]) for r in at], n, caps)
        by_shard += [{"source": s, "shard": r["shard"], "shard_tokens": int(r["t"]), "quota": q, "n_shards": shards[s], "max_repeats": want[s][1]} for r, q in zip(at, quota, strict=True)]
    return by_source, by_shard, block


def shard_of(tokens: DataFrame, shards: dict[str, int]) -> DataFrame:
    n = F.lit(1)
    for s, k in shards.items():
        if k > 1:
            n = F.when(F.col("source") == s, F.lit(k)).otherwise(n)
    return tokens.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit("shard")), n).cast("int"))


def mix(tokens: DataFrame, targets: DataFrame, seed: int = 17, total_tokens: int | None = None, block_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen documents with repeats, report per source).

    chosen: (doc_id, source, n_tokens, block, repeats), repeats >= 1 and at most the source's max_repeats rounded up.
    A document belongs to the block of its shard that its last token falls in. A source's tokens are used at most
    max_repeats times: blocks are drawn in seeded order as long as they fit what is left of the quota, so a source
    can fall short by part of a block per shard. Documents with a null source, a source without target, or no
    tokens are not chosen; a source without text is reported with nothing chosen. The same seed gives the same
    choice whatever the partitioning.
    """
    spark: SparkSession = tokens.sparkSession
    tokens = cut(tokens)
    by_source, by_shard, block = plan(tokens, targets, total_tokens, block_tokens)
    schema = "source string, shard int, shard_tokens bigint, quota bigint, n_shards int, max_repeats double"
    quotas = spark.createDataFrame([tuple(r.values()) for r in by_shard], schema)
    shards = {r["source"]: r["n_shards"] for r in by_shard}
    docs = shard_of(tokens.where("n_tokens > 0 and source is not null"), shards).join(F.broadcast(quotas) if len(by_shard) <= QUOTAS_AT_ONCE else quotas, ["source", "shard"])
    at = Window.partitionBy("source", "shard")
    up_to = (Window.unboundedPreceding, Window.currentRow)
    budget = F.col("quota") * F.lit(block)
    passes = F.floor(budget / F.col("shard_tokens"))
    end = F.sum("n_tokens").over(at.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(*up_to))
    docs = docs.withColumn("block", F.floor((end - 1) / F.lit(block))).withColumn("__passes", passes)
    blocks = docs.groupBy("source", "shard", "block").agg(F.sum("n_tokens").alias("__size"), F.max(budget - passes * F.col("shard_tokens")).alias("__left"))
    drawn = F.sum("__size").over(at.orderBy(F.xxhash64("source", "shard", "block", F.lit(seed)), "block").rowsBetween(*up_to)) <= F.col("__left")
    blocks = blocks.select("source", "shard", "block", drawn.cast("bigint").alias("__drawn"))
    chosen = (
        docs.join(blocks, ["source", "shard", "block"])
        .select("doc_id", "source", "n_tokens", "block", (F.col("__passes") + F.col("__drawn")).cast("int").alias("repeats"))
        .where("repeats > 0")
    )
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("used_tokens"), F.sum("repeats").alias("documents_out"))
    plan_rows = spark.createDataFrame([tuple(r.values()) for r in by_source], "source string, target_share double, max_repeats double, source_tokens bigint, blocks bigint")
    report = plan_rows.join(used, "source", "left").na.fill(0, ["used_tokens", "documents_out"])
    total = F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))
    report = report.select(
        "source", "target_share", "max_repeats", "source_tokens", "blocks", F.lit(block).cast("bigint").alias("block_tokens"), "used_tokens", "documents_out",
        F.when(total > 0, F.col("used_tokens") / total).otherwise(0.0).alias("reached_share"),
        F.when(F.col("source_tokens") > 0, F.col("used_tokens") / F.col("source_tokens")).otherwise(0.0).alias("reached_repeats"),
    )
    return chosen, report
