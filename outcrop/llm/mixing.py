"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks.

Targets. Sources in code-point order (null last) weigh 5, 2, 1, repeating. They share the total number of tokens by weight, but a
source's target stops at `epochs` times its own tokens, and what is over is shared again by weight until no target is above.

Schedule. Slot t has the golden-ratio point t * 2654435769 mod 2**32, which falls into one source's part of the cumulative
targets: at any length the mix is within a few slots of its weights. A source whose part no point meets has one slot, where its part begins.

Blocks. A source's texts are shuffled by hash and laid end to end, over and over, up to its target in whole tokens; that stretch is cut into as many equal
blocks as the source has slots, and the slot of rank r takes block r. As slots are in proportion to targets, blocks of all sources are about
equal, those of small sources less so; every source takes exactly its target, and repeats of a text are whole epochs apart.

Ranks and positions are prefix sums in two steps, within hash ranges of a source and over the few ranges, so neither the
largest source nor the schedule is ever in one task. Everything is a function of the rows: reruns agree.

Defined results: a null, empty or blank text has size 0 and is taken 0 times; null sources are one source, the last; repeated
rows of one doc_id and text are separate rows, one after the other in their source's order; with no tokens at all every target and
taken is 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SLOTS, SLOTS_A_SOURCE = 65536, 256
GOLDEN = 2654435769  # 2**32 over the golden ratio
CELLS = 64  # ranges of points a source, for the join of points and sources
BROADCAST_SOURCES = 100_000
BROADCAST_BLOCKS = 1_000_000  # rows of 32 bytes; with more the blocks are joined by shuffle
SEED = ":mix-1"


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(common.WORD)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(sk, source_size, weight, total, target) from (sk, source_size), one row a source.

    With sources by rising epochs * size / weight, the first ones stop at epochs * size: those below the level that
    (total - what the stopped ones have) / (weight of the others) gives.
    """
    chosen = f"case (row_number() over (order by sk) - 1) % {len(weights)}" + "".join(f" when {i} then {w}" for i, w in enumerate(weights)) + " end"
    earlier = "over (order by ratio, sk rows between unbounded preceding and 1 preceding)"
    s = sizes.selectExpr("sk", "source_size", f"cast({chosen} as bigint) as weight")
    s = s.selectExpr("*", f"cast({epochs} * source_size as double) / weight as ratio", "sum(source_size) over () as total", "sum(weight) over () as weights")
    s = s.selectExpr("*", f"cast(total - {epochs} * coalesce(sum(source_size) {earlier}, 0) as double) / (weights - coalesce(sum(weight) {earlier}, 0)) as level")
    s = s.selectExpr("*", "(min(case when level <= ratio then struct(ratio, sk, level) end) over ()).level as water")
    return s.selectExpr("sk", "source_size", "weight", "total", f"least(cast({epochs} * source_size as double), weight * coalesce(water, ratio)) as target")


def schedule(totals: DataFrame) -> DataFrame:
    """(sk, rank, slot): the slots of every source that has tokens, in order, ranks from 0."""
    spark = totals.sparkSession
    shape = totals.agg(F.max("total").alias("total"), F.count(F.lit(1)).alias("sources")).first()
    size = max(1, -(-(shape.total or 0) // (SLOTS + SLOTS_A_SOURCE * shape.sources)))
    slots = -(-(shape.total or 0) // size)
    parts = totals.where("source_size > 0").selectExpr("*", "sum(target) over (order by sk) as upto", "row_number() over (order by sk desc) as from_last")
    parts = parts.selectExpr("*", "case when from_last = 1 then 4294967296 else cast(floor(upto / total * 4294967296) as bigint) end as high")
    parts = parts.selectExpr("*", "coalesce(lag(high) over (order by sk), 0) as low")
    # Ranges of points, several for each source: a point is in one, and few sources are. So an equi-join leaves few comparisons.
    width = max(1, (1 << 32) >> (CELLS * shape.sources).bit_length())
    cells = parts.selectExpr("sk", "low", "high", f"explode(sequence(low div {width}, greatest(low, high - 1) div {width})) as cell")
    points = spark.range(0, slots).selectExpr("id as slot", f"(id * {GOLDEN}) % 4294967296 as point", "id div 4096 as stretch").selectExpr("*", f"point div {width} as cell")
    hits = points.join(cells, "cell").where("point >= low and point < high").select("sk", "slot", "stretch")
    # Rank of a slot in its source: the source's slots of earlier stretches, and those before it in its own.
    before = hits.groupBy("sk", "stretch").agg(F.count(F.lit(1)).alias("n")).selectExpr("sk", "stretch", "coalesce(sum(n) over (partition by sk order by stretch rows between unbounded preceding and 1 preceding), 0) as before")
    ranked = hits.selectExpr("*", "row_number() over (partition by sk, stretch order by slot) - 1 as place").join(before, ["sk", "stretch"]).selectExpr("sk", "before + place as rank", "slot")
    missed = parts.join(before.select("sk").distinct(), "sk", "left_anti").selectExpr("sk", "0L as rank", f"cast(floor(low / 4294967296 * {slots}) as bigint) as slot")
    return ranked.unionByName(missed)


def mix(docs: DataFrame, keep: list[str] | None = None, text: str = "text", source: str = "source", weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Every row of docs as `row` (its columns, or those in keep), with size, source_size, target, taken (tokens that the mix takes of
    it, repeats counted), copies (how often the place where it starts is taken) and first_slot (the slot whose block that place first is in; null where it isn't taken)."""
    scratch = common.Scratch(docs.sparkSession, "mixing")
    row = F.struct(*[F.col(f"`{c}`") for c in (keep or docs.columns)])
    origin = F.col(f"`{source}`").cast("string")
    s = docs.select(row.alias("row"), F.when(origin.isNull(), "b").otherwise(F.concat(F.lit("a"), origin)).alias("sk"), size_of(F.col(f"`{text}`")).alias("size"), F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(SEED))).alias("key"))
    s = s.withColumn("part", F.substring("key", 1, 3))
    sums = scratch.save(s.groupBy("sk", "part").agg(F.sum("size").alias("n")))
    totals = scratch.save(targets(sums.groupBy("sk").agg(F.sum("n").alias("source_size")), weights, epochs))
    slots = scratch.save(schedule(totals))
    n = slots.groupBy("sk").agg(F.count(F.lit(1)).alias("n_slots"))
    wanted = "case when source_size > 0 then greatest(1L, cast(round(target) as bigint)) else 0L end as wanted"
    sources = scratch.save(totals.join(n, "sk", "left").selectExpr("sk", "source_size", "target", "n_slots", wanted))
    # A row a source: where these are few, no row of a large source has to move to be joined with its own.
    if sources.count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    before = sums.selectExpr("sk", "part", "coalesce(sum(n) over (partition by sk order by part rows between unbounded preceding and 1 preceding), 0) as before")
    placed = s.selectExpr("*", "coalesce(sum(size) over (partition by sk, part order by key, size rows between unbounded preceding and 1 preceding), 0) as place").join(before, ["sk", "part"]).join(sources, "sk")
    placed = placed.selectExpr("row", "sk", "size", "source_size", "target", "n_slots", "wanted", "before + place as start")
    # Of the stretch 0 to wanted, a text has its place in each whole epoch and what of it lies in the last, cut one.
    placed = placed.selectExpr("*", "case when size > 0 and start < wanted then start * n_slots div wanted end as rank")
    by_rank = F.broadcast(slots) if slots.count() <= BROADCAST_BLOCKS else slots
    found = placed.join(by_rank.withColumnRenamed("slot", "first_slot"), ["sk", "rank"], "left")
    taken = "case when size = 0 then 0L else wanted div source_size * size + greatest(0L, least(start + size, wanted % source_size) - start) end as taken"
    copies = "cast(case when size = 0 then 0 else wanted div source_size + if(start < wanted % source_size, 1, 0) end as int) as copies"
    return found.selectExpr("row", "size", "source_size", "target", taken, copies, "first_slot")


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of the mix with the columns of docs: a row comes as often as the place where it starts is taken; blank texts go."""
    m = mix(docs).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return common.unnested(m)


def query(spark, sf_dir: str) -> DataFrame:
    m = mix(common.read(spark, sf_dir, "documents"), keep=["doc_id"])
    return m.select("row.doc_id", "size", "source_size", "target", "taken", "copies", "first_slot")


def mix_sql(table: str = "documents") -> str:
    """DuckDB: (d, size, source_size, target, taken, copies, first_slot) for every row d of table."""
    return rf"""
    with m_d as materialized (select d, case when d.source is null then 'b' else 'a' || d.source end as sk, len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, md5(coalesce(d.doc_id::varchar, '') || '{SEED}') as key from {table} d),
    m_s as (select sk, sum(size)::bigint as source_size from m_d group by sk),
    m_w as (select *, (case (row_number() over (order by sk) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end)::bigint as weight from m_s),
    m_r as (select *, ({EPOCHS} * source_size)::double / weight as ratio, (sum(source_size) over ())::bigint as total, (sum(weight) over ())::bigint as weights from m_w),
    m_l as (select *, (total - {EPOCHS} * coalesce(sum(source_size) over e, 0))::double / (weights - coalesce(sum(weight) over e, 0))::double as level from m_r window e as (order by ratio, sk rows between unbounded preceding and 1 preceding)),
    m_t as (select sk, source_size, weight, total, least(({EPOCHS} * source_size)::double, weight * coalesce((select level from m_l where level <= ratio order by ratio, sk limit 1), ratio)) as target from m_l),
    m_b as (select greatest(1, ((max(total) + {SLOTS} + {SLOTS_A_SOURCE} * count(*) - 1) // ({SLOTS} + {SLOTS_A_SOURCE} * count(*))))::bigint as b, max(total) as total from m_t),
    m_p as (select sk, case when row_number() over (order by sk desc) = 1 then 4294967296 else floor(sum(target) over (order by sk) / m_t.total * 4294967296)::bigint end as high from m_t, m_b where source_size > 0),
    m_i as (select *, coalesce(lag(high) over (order by sk), 0) as low from m_p),
    m_h as (select sk, slot from (select r.slot, (r.slot * {GOLDEN}) % 4294967296 as point from m_b, range(0, (total + b - 1) // b) r(slot)) p join m_i on point >= low and point < high),
    m_k as materialized (select sk, row_number() over (partition by sk order by slot) - 1 as rank, slot from m_h union all select sk, 0, floor(low / 4294967296 * ((total + b - 1) // b))::bigint from m_i, m_b where sk not in (select sk from m_h)),
    m_n as (select m_t.*, n_slots, case when source_size > 0 then greatest(1, round(target)::bigint) else 0 end as wanted from m_t left join (select sk, count(*) as n_slots from m_k group by sk) using (sk)),
    m_q as (select m_d.*, coalesce(sum(size) over (partition by sk order by key, size rows between unbounded preceding and 1 preceding), 0)::bigint as start from m_d)
    select q.d, q.size, n.source_size, n.target, (case when q.size = 0 then 0 else wanted // source_size * q.size + greatest(0, least(q.start + q.size, wanted % source_size) - q.start) end)::bigint as taken,
    (case when q.size = 0 then 0 else wanted // source_size + (q.start < wanted % source_size)::int end)::int as copies, k.slot as first_slot
    from m_q q join m_n n using (sk) left join m_k k on k.sk = q.sk and q.size > 0 and q.start < wanted and k.rank = q.start * n_slots // wanted"""


SQL = f"select d.doc_id, size, source_size, target, taken, copies, first_slot from ({mix_sql()})"
