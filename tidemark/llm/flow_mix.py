"""Mixing sources to target weights: a minimum-cost flow over membership patterns, then seeded documents."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import settle

#: Bits of the seeded order of documents, and by how much they are cut for coarse and fine ranges of that order.
BITS, RANGES = 60, (48, 36)
#: Rows written out of one row of equal documents at a time.
PIECE = 4096
WORD = r"[^\x20\x09-\x0D]+"


def source_order(names: Sequence[str | None]) -> list[str | None]:
    """By code point, null last."""
    return sorted(names, key=lambda n: (n is None, n or ""))


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], total: float, most: int) -> dict[str | None, float]:
    """Shares of `total` by weight, none above `most` times its source: the excess is shared again by weight."""
    out: dict[str | None, float] = {}
    free = set(sizes)
    while free:
        rest, weight = total - sum(out.values()), sum(weights[s] for s in free)
        share = {s: rest * weights[s] / weight if weight else 0.0 for s in free}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return out | share
        out |= {s: float(most * sizes[s]) for s in above}
        free -= set(above)
    return out


def min_cost_flow(nodes: int, arcs: list[tuple[int, int, int, int]], start: int, end: int) -> list[int]:
    """Flow of each arc (from, to, capacity, cost) of a greatest flow of least cost, by successive shortest paths.

    Arcs are taken in their order, so equal costs always give the same flow.
    """
    to, room, cost, out = [], [], [], [[] for _ in range(nodes)]
    for a, b, c, w in arcs:
        for x, y, r, z in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y)
            room.append(r)
            cost.append(z)
    while True:
        far, via, waiting, queued = {start: 0}, {}, deque([start]), {start}
        while waiting:
            x = waiting.popleft()
            queued.discard(x)
            for e in out[x]:
                if room[e] > 0 and far[x] + cost[e] < far.get(to[e], 1 << 62):
                    far[to[e]], via[to[e]] = far[x] + cost[e], e
                    if to[e] not in queued:
                        queued.add(to[e])
                        waiting.append(to[e])
        if end not in far:
            return [room[2 * i + 1] for i in range(len(arcs))]
        path, x = [], end
        while x != start:
            path.append(via[x])
            x = to[via[x] ^ 1]
        amount = min(room[e] for e in path)
        for e in path:
            room[e] -= amount
            room[e ^ 1] += amount


def route(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], most: int) -> list[dict[int, int]]:
    """Words of each pattern (sources, size) for each of its sources.

    A pattern offers its size `most` times; the k-th repetition costs k, so that, as costs grow, words are repeated
    evenly before any is repeated more often. Sources end in their quotas.
    """
    arcs, n = [], len(patterns)
    for p, (_, size) in enumerate(patterns):
        arcs += [(0, 1 + p, size, k) for k in range(most)]
    first = len(arcs)
    links = [(p, s) for p, (sources, _) in enumerate(patterns) for s in sources]
    arcs += [(1 + p, 1 + n + s, most * patterns[p][1], 0) for p, s in links]
    arcs += [(1 + n + s, 1 + n + len(quotas), q, 0) for s, q in enumerate(quotas)]
    flow = min_cost_flow(n + len(quotas) + 2, arcs, 0, 1 + n + len(quotas))
    out: list[dict[int, int]] = [{} for _ in patterns]
    for (p, s), f in zip(links, flow[first:]):
        out[p][s] = f
    return out


def _seeded(seed: int) -> Column:
    """Place of a document in the seeded order: a hash of its id and size."""
    named = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"))
    return F.conv(F.substring(F.md5(named), 1, BITS // 4), 16, 10).cast("long")


def _select(units: DataFrame, need: DataFrame, by: Sequence[str]) -> DataFrame:
    """For each group with `need` (by, rest): the place up to which units are picked, and what is still missing.

    Finds the range of the seeded order that holds the border from sums of coarse, then of fine ranges; only the units of
    one fine range of a group are sorted. A group whose words do not exceed the rest has no border and no row.
    """
    by = list(by)
    at = need.select(*by, "rest", F.lit(0).cast("long").alias("range"))
    words = F.col("size") * F.col("n")
    former = None
    for shift in RANGES:
        near = units.join(at, by)
        if former:
            near = near.where(F.shiftright("key", former) == F.col("range"))
        sums = near.groupBy(*by, "rest", F.shiftright("key", shift).alias("own")).agg(F.sum(words).alias("words"))
        earlier = Window.partitionBy(*by).orderBy("own").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
        at = sums.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
        # Written out, so that Spark knows how small it is and need not deal the units by group for the next join.
        at = settle(at.select(*by, (F.col("rest") - F.col("before")).alias("rest"), F.col("own").alias("range")))
        former = shift
    near = units.join(at, by).where(F.shiftright("key", former) == F.col("range"))
    earlier = Window.partitionBy(*by).orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("before", F.coalesce(F.sum(words).over(earlier), F.lit(0)))
    border = near.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + words))
    more = F.floor((F.col("rest") - F.col("before")) / F.col("size")).cast("long")
    gap = (F.col("rest") - F.col("before") - more * F.col("size")).alias("gap")
    return border.select(*by, F.struct("key", "id", "size").alias("border"), more.alias("part"), gap)


def _fill(table: pa.Table) -> pa.Table:
    """Of one pattern's sizes (pattern, gap, size, n), how many to take of each: as many as fit, from the greatest down."""
    rows = sorted(table.to_pylist(), key=lambda r: -r["size"])
    left, out = rows[0]["gap"], []
    for r in rows:
        times = min(r["n"], left // r["size"])
        if times:
            left -= times * r["size"]
            out.append((r["pattern"], r["size"], times * r["size"]))
    return pa.table({name: pa.array([o[i] for o in out], kind) for i, (name, kind) in enumerate((("pattern", pa.int32()), ("size", pa.int64()), ("rest", pa.int64())))})


def mix(
    docs: DataFrame,
    members: Column,
    weights: Callable[[list[str | None]], dict[str | None, float]],
    most: int = 3,
    total: float | None = None,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, size, members, source_sizes, targets, taken of every document.

    `members` is the array of sources a document belongs to (it may be in several, null is a source too; repeats count once, an
    empty or null array is in none); `weights` gives the weight of each source from their names in `source_order`. Sizes are runs of
    other than space and control characters 9 to 13; null texts have size 0. Targets share `total` (all words, if none
    is given) by weight, none above `most` times the words of its source.

    Documents are summed by membership pattern. A minimum-cost flow routes the words of the patterns to the targets: a
    pattern's words may be taken `most` times, the k-th repetition at cost k. The driver holds one row for each pattern that
    occurs and one for each source, whatever the number of documents; sources need a weight each, so they are a list that
    someone has written down. A pattern that sends q times its words and a rest takes all its documents q times and
    documents in a seeded order once more, up to the rest. What then is missing (less than one document) is filled
    by sizes from the greatest that fits down, as many of each as fit. Where the rest is more than half of the words, the
    documents that are not taken once more are chosen so instead, which leaves more to fill from. Documents are taken whole;
    sums differ from targets by what no left document fits into.

    Rows that repeat (doc_id, members, size) are one row with a count until the end. Null ids are one id. An empty
    table gives no rows; a table without words takes 0 of all. Other columns are not read.
    """
    spark = docs.sparkSession
    # Null is an ordinary source, so names are marked: arrays with nulls are not joined on.
    marked = F.array_sort(F.array_distinct(F.transform(F.coalesce(members, F.array().cast("array<string>")), lambda s: F.coalesce(F.concat(F.lit("v"), s), F.lit("n")))))
    size = F.coalesce(F.regexp_count(docs[text_col].cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), marked.alias("members"), size.alias("size"))
    units = settle(rows.groupBy("doc_id", "members", "size").agg(F.count(F.lit(1)).alias("n")))
    found = units.groupBy("members").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()  # one row a pattern
    patterns = sorted((tuple(r["members"]), int(r["words"])) for r in found)
    name = lambda m: None if m == "n" else m[1:]
    sources = source_order(list({name(m) for p, _ in patterns for m in p}))
    at = {s: i for i, s in enumerate(sources)}
    sizes = {s: sum(w for p, w in patterns if s in {name(m) for m in p}) for s in sources}
    goal = targets(sizes, weights(sources), float(sum(w for _, w in patterns)) if total is None else total, most)
    flows = route([(tuple(at[name(m)] for m in p), w) for p, w in patterns], [int(goal[s] + 0.5) for s in sources], most)
    plan = []
    for i, ((p, words), flow) in enumerate(zip(patterns, flows)):
        copies, rest = divmod(sum(flow.values()), words) if words else (0, 0)
        plan.append((list(p), i, copies, min(rest, words - rest), 2 * rest > words, [name(m) for m in p], [sizes[name(m)] for m in p], [goal[name(m)] for m in p]))
    kind = "members array<string>, pattern int, copies long, pick long, omit boolean, names array<string>, source_sizes array<long>, targets array<double>"
    plans = settle(spark.createDataFrame(plan, kind))

    units = units.join(plans.select("members", "pattern"), "members").select("pattern", "doc_id", "size", "n", _seeded(seed).alias("key"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"))
    units = settle(units)
    border = settle(_select(units, plans.where("pick > 0").select("pattern", F.col("pick").alias("rest")), ["pattern"]))
    own = F.struct("key", "id", "size")
    behind = units.join(border, "pattern").where((own > F.col("border")) & (F.col("size") > 0) & (F.col("size") <= F.col("gap")))
    counts = behind.groupBy("pattern", "gap", "size").agg(F.sum("n").alias("n")).select("pattern", "gap", "size", "n")
    fill = settle(counts.groupBy("pattern").applyInArrow(_fill, "pattern int, size long, rest long"))
    ends = _select(behind.select(*units.columns), fill, ["pattern", "size"]).select("pattern", "size", F.col("border").alias("end"), F.col("part").alias("end_part"))
    filled = fill.join(settle(ends), ["pattern", "size"], "left").withColumn("full", F.col("end").isNull()).drop("rest")
    done = units.join(plans.drop("members"), "pattern").join(border, "pattern", "left").join(filled, ["pattern", "size"], "left")
    last = F.when(F.col("full") | (own < F.col("end")), F.col("n")).when(own == F.col("end"), F.col("end_part")).otherwise(0)
    picked = F.when(F.col("border").isNull(), 0).when(own < F.col("border"), F.col("n")).when(own == F.col("border"), F.col("part")).otherwise(last)
    done = done.withColumn("more", F.when(F.col("omit"), F.col("n") - picked).otherwise(picked).cast("long"))
    piece = lambda n, copies: F.struct(n.cast("long").alias("n"), (F.col("size") * copies).cast("long").alias("taken"))
    pieces = F.filter(F.array(piece(F.col("more"), F.col("copies") + 1), piece(F.col("n") - F.col("more"), F.col("copies"))), lambda x: x["n"] > 0)
    done = done.select("doc_id", "size", F.col("names").alias("members"), "source_sizes", "targets", F.explode(pieces).alias("x")).select("doc_id", "size", "members", "source_sizes", "targets", "x.n", "x.taken")
    few = done.where(F.col("n") <= PIECE)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / PIECE)), lambda i: F.least(F.lit(PIECE), F.col("n") - i * PIECE))
    many = done.where(F.col("n") > PIECE).select(*[c for c in done.columns if c != "n"], F.posexplode(blocks).alias("block", "n"))
    many = many.repartition("doc_id", "size", "taken", "block").drop("block")
    columns = ["doc_id", "size", "members", "source_sizes", "targets", "taken"]
    return few.unionByName(many).withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select(*columns)


def repeating(cycle: Sequence[float]) -> Callable[[list[str | None]], dict[str | None, float]]:
    """Weights that go to the sources in order, over and over."""
    return lambda sources: {s: cycle[i % len(cycle)] for i, s in enumerate(sources)}


SQL = r"""
WITH RECURSIVE sized AS MATERIALIZED (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
),
src AS MATERIALIZED (SELECT source, sum(size)::BIGINT AS words, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM sized GROUP BY source),
-- The level is found by filling the sources in the order of cap to weight.
lined AS (
  SELECT *, coalesce(sum(3 * words) OVER up, 0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER up, 0) AS free, sum(words) OVER () AS total
  FROM src WINDOW up AS (ORDER BY 3 * words / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
level AS (
  SELECT min_by(total - capped, (ord)) AS rest, min_by(free, (ord)) AS free FROM (SELECT *, row_number() OVER (ORDER BY 3 * words / w, source NULLS LAST) AS ord FROM lined)
  WHERE (total - capped)::DOUBLE * w / free <= 3 * words
),
aim AS MATERIALIZED (SELECT source, words, coalesce(least(l.rest::DOUBLE * w / l.free, 3 * words), 3 * words)::DOUBLE AS target FROM src, level l),
plan AS MATERIALIZED (
  SELECT source, words, target, copies, omit, least(rest, words - rest) AS rest FROM (
    SELECT *, 2 * rest > words AS omit FROM (
      SELECT *, CASE WHEN words > 0 THEN floor(target + 0.5)::BIGINT // words ELSE 0 END AS copies, CASE WHEN words > 0 THEN floor(target + 0.5)::BIGINT % words ELSE 0 END AS rest FROM aim))
),
keyed AS (
  SELECT s.*, row_number() OVER () AS rid, ('0x' || substr(md5('0|' || coalesce(doc_id::VARCHAR, '') || '|' || size), 1, 15))::BIGINT AS key FROM sized s
),
run AS MATERIALIZED (
  SELECT k.*, p.words, p.target, p.copies, p.rest, p.omit, sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS FIRST, size, rid ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM keyed k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source
),
front AS (SELECT source, max(upto) AS given, any_value(rest) - max(upto) AS gap, max(key) AS last FROM (
  SELECT source, rest, upto, key FROM run WHERE rest > 0 AND upto <= rest UNION ALL SELECT source, rest, 0, -1 FROM run WHERE rest > 0) GROUP BY source),
left_over AS MATERIALIZED (
  SELECT r.source, r.size, r.rid, f.gap, row_number() OVER (PARTITION BY r.source, r.size ORDER BY r.key, r.doc_id NULLS FIRST, r.rid) AS nth
  FROM run r JOIN front f ON r.source IS NOT DISTINCT FROM f.source WHERE r.upto > r.rest AND r.size > 0 AND r.size <= f.gap
),
counts AS MATERIALIZED (SELECT source, size, count(*) AS n FROM left_over GROUP BY ALL),
fill AS (
  SELECT source, gap, 9223372036854775807 AS size, 0::BIGINT AS times FROM front
  UNION ALL
  SELECT source, gap - least(n, gap // size) * size, size, least(n, gap // size) FROM (
    SELECT f.source, f.gap, max(l.size) AS size, max_by(l.n, l.size) AS n FROM fill f JOIN counts l ON f.source IS NOT DISTINCT FROM l.source AND l.size <= f.gap AND l.size < f.size GROUP BY f.source, f.gap
  )
),
chosen AS (SELECT l.rid FROM fill f JOIN left_over l ON f.source IS NOT DISTINCT FROM l.source AND f.size = l.size WHERE l.nth <= f.times)
SELECT r.doc_id, r.size, r.words AS source_size, r.target,
  (r.size * (r.copies + CASE WHEN (r.rest > 0 AND (r.upto <= r.rest OR c.rid IS NOT NULL)) <> r.omit THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run r LEFT JOIN chosen c USING (rid)
"""
