"""Sharding of linked documents by balanced label propagation.

Documents are linked by the lines that they share (copies, boilerplate, quoted passages): a bipartite
graph of documents and repeated lines, so a line in n documents costs n edges and not n squared. In a
round every linked document scores the shards by the weight of its lines' other documents there;
moves that gain are admitted, highest gains first, while the target shard has room and the one that is left
has documents to spare. Rounds alternate between moves to higher and to lower shards, so that neighbours don't swap
past each other, and end when they settle.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, maybe_broadcast, only, ranked

SHARDS = 16
#: Rounds end when two in turn move at most this share of the linked documents, or after so many.
SETTLED = 0.002
ROUNDS = 12
#: A shard may hold so much more or less than the mean.
SLACK = 0.1
#: Shorter lines link nothing: a definition of the graph, not a cut in its work.
LEAST_LINE = 16
#: Steps into which gains are sorted; within a step documents go by hash.
STEPS = 32
#: Lines with more than one in so many of all edges are heavy; there are so many of them at most, so they are broadcast and no task gathers one.
HEAVY_LINES = 10_000


def document_links(docs: DataFrame, least_line: int = LEAST_LINE) -> DataFrame:
    """(doc_id, line, weight, n): the lines that occur in n > 1 documents; weight is 1 / (n - 1)."""
    lines = docs.select("doc_id", F.explode(F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: F.length(x) >= least_line), lambda x: F.xxhash64(x)))).alias("line")).distinct()
    often = lines.groupBy("line").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("line", (1.0 / (F.col("_n") - 1)).alias("weight"), F.col("_n").alias("n"))
    return lines.join(often, "line").select("doc_id", "line", "weight", "n")


def _votes(edges: DataFrame, heavy: int | None) -> DataFrame:
    """(doc_id, shard, weight, v): each edge (doc_id, shard, line, weight, n) with the shards of its line's documents and how many are there.

    heavy: lines in more documents than this are broadcast; None where there are none.
    """

    def spread(some: DataFrame) -> DataFrame:
        at_line = some.groupBy("line", "shard").agg(F.count(F.lit(1)).alias("there"))
        return at_line.groupBy("line").agg(F.collect_list(F.struct(F.col("shard").alias("s"), F.col("there").alias("n"))).alias("_spread"))  # as many as shards at most

    light = edges if heavy is None else edges.filter(F.col("n") <= heavy)
    told = light.join(spread(light), "line")
    if heavy is not None:
        large = edges.filter(F.col("n") > heavy)
        told = told.unionByName(large.join(F.broadcast(spread(large)), "line"))  # HEAVY_LINES rows at most
    return told.select("doc_id", "shard", "weight", F.explode("_spread").alias("v"))


def _admitted(counts: list[tuple[int, int, int, int]], size: dict[int, int], least: int, most: int) -> list[tuple[int, int, int, int]]:
    """(from, to, step, quota) of (from, to, step, wishes): earlier steps first, within what shards may gain and lose."""
    room, spare = {s: most - n for s, n in size.items()}, {s: n - least for s, n in size.items()}
    out = []
    for step, to, at, n in sorted((c, b, a, n) for a, b, c, n in counts):
        q = max(0, min(n, room.get(to, most), spare.get(at, 0)))
        if q:
            room[to] = room.get(to, most) - q
            spare[at] -= q
            out.append((at, to, step, q))
    return out


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, slack: float = SLACK, least_line: int = LEAST_LINE, heavy_lines: int = HEAVY_LINES) -> DataFrame:
    """(doc_id, shard, first_shard): one row for each distinct doc_id.

    first_shard is where it began: ranks (by hash bucket, then id) dealt round, so sizes differ by one at most. No shard
    exceeds ceil((1 + slack) * documents / shards) documents or falls below floor((1 - slack) * documents / shards).
    Null ids are left out; a doc_id that repeats is one document with the lines of all its rows. Documents that are
    null, empty or without shared lines don't move. Ties between shards go to the one where the document is, else to
    the lower number. A text of any length links by
    all its lines. An empty table gives an empty one. The driver plans with shards * shards * STEPS numbers a round.
    """
    docs = only(docs, ["doc_id", "text"]).filter(F.col("doc_id").isNotNull())
    spark = docs.sparkSession
    links = durable(document_links(docs, least_line))
    ids = durable(docs.select("doc_id").distinct())
    total = ids.count()
    if not total:
        return ids.select("doc_id", F.lit(0).alias("shard"), F.lit(0).alias("first_shard"))
    most, least = math.ceil((1 + slack) * total / shards), math.floor((1 - slack) * total / shards)
    dealt = ranked(ids.withColumn("_all", F.lit(0)), ["_all"], ["doc_id"], total)
    labels = durable(dealt.select("doc_id", (F.col("rank") % shards).cast("int").alias("shard")).withColumn("first_shard", F.col("shard")))
    linked = durable(links.select("doc_id").distinct())
    number = linked.count()
    edges_in_all, widest = links.agg(F.count(F.lit(1)), F.max("n")).first()
    heavy = max(1, edges_in_all // heavy_lines)
    side = maybe_broadcast(linked, number, 40)
    alone, now = labels.join(side, "doc_id", "left_anti"), durable(labels.join(side, "doc_id", "left_semi"))
    size = {r[0]: r[1] for r in labels.groupBy("shard").count().collect()}  # one row a shard
    before = number
    for turn in range(rounds if number else 0):
        up = turn % 2 == 0
        edges = links.join(maybe_broadcast(now.select("doc_id", "shard"), number, 40), "doc_id")
        votes = _votes(edges, heavy if widest > heavy else None)
        score = votes.groupBy("doc_id", "shard", F.col("v.s").alias("to")).agg(F.sum(F.col("weight") * (F.col("v.n") - (F.col("v.s") == F.col("shard")).cast("int"))).alias("score"))
        best = score.groupBy("doc_id", "shard").agg(
            F.sum(F.when(F.col("to") == F.col("shard"), F.col("score")).otherwise(0.0)).alias("stay"),
            F.max(F.when((F.col("to") > F.col("shard")) if up else (F.col("to") < F.col("shard")), F.struct(F.round("score", 9).alias("score"), (-F.col("to")).alias("to")))).alias("go"),
        )
        want = best.select("doc_id", "shard", (-F.col("go.to")).cast("int").alias("to"), F.round(F.col("go.score") - F.col("stay"), 9).alias("gain")).filter("gain > 0.000001")
        step = F.floor(STEPS * F.col("gain") / (1 + F.col("gain"))).cast("int")
        want = durable(want.select("doc_id", "shard", "to", (STEPS - step).alias("step")))
        counts = [tuple(r) for r in want.groupBy("shard", "to", "step").count().collect()]
        quota = _admitted(counts, size, least, most)
        moved = sum(q for *_, q in quota)
        if moved:
            wished = {c[:3]: c[3] for c in counts}
            cells = spark.createDataFrame([(*x, wished[x[:3]] > x[3]) for x in quota], "_at int, _to int, _step int, _quota bigint, _some boolean")
            able = want.join(F.broadcast(cells), (F.col("shard") == F.col("_at")) & (F.col("to") == F.col("_to")) & (F.col("step") == F.col("_step")))
            movers = able.filter("NOT _some").select("doc_id", "to")
            if cut := sum(wished[x[:3]] for x in quota if wished[x[:3]] > x[3]):
                part = ranked(able.filter("_some").select("doc_id", "shard", "to", "step", "_quota"), ["shard", "to", "step"], ["doc_id"], cut).filter(F.col("rank") < F.col("_quota"))
                movers = movers.unionByName(part.select("doc_id", "to"))
            now = durable(now.join(maybe_broadcast(movers, moved, 40), "doc_id", "left").select("doc_id", F.coalesce("to", "shard").alias("shard"), "first_shard"))
            for at, to, _, q in quota:
                size[at] -= q
                size[to] = size.get(to, 0) + q
        if turn and moved + before <= SETTLED * number:
            break
        before = moved
    return alone.unionByName(now)


def cut_weight(docs: DataFrame, shards: DataFrame, column: str = "shard", least_line: int = LEAST_LINE) -> float:
    """Share of the link weight between documents of different shards."""
    links = document_links(only(docs, ["doc_id", "text"]), least_line)
    at = links.join(shards.select("doc_id", F.col(column).alias("s")), "doc_id").groupBy("line", "s").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("w"))
    whole = at.groupBy("line").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("same"), F.max("w").alias("w"))
    cut, total = whole.agg(F.sum(F.col("w") * (F.col("all") * F.col("all") - F.col("same"))), F.sum(F.col("w") * F.col("all") * (F.col("all") - 1))).first()
    return (cut or 0.0) / total if total else 0.0
