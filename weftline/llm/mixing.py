"""Temperature mixing of sources to target weights, as DataFrame operations only.

Token shares of the sources are raised to an exponent a in [0, 1] and normalised. The exponent is
bisected: the largest a whose weights reach the target entropy, but never below the smallest a at
which no source has to be repeated more than `max_repeat` times within the budget. Each source then
gets weight x budget tokens: whole epochs of all its documents, and a last partial epoch that is
dealt over blocks. A block is a pseudo-random set of about `block_docs` documents of one source,
permuted pseudo-randomly; it has the share of the partial epoch that its tokens have in the source
and takes documents from the front of its permutation until that budget is met (a document that
straddles the end is taken if at least half of it fits). Blocks keep a hot source spread over many
tasks, and no task orders a whole source.

Tokens are white-space words. A null source is a source of its own. Documents without words cost
nothing; sources without words are left out, but where all documents stay (`cover`), once each. Rows that share an id share a block; equal rows are
each scheduled. An empty table gives no rows. Of extra columns only those named in `carry` stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import common

#: Candidate exponents tried in one pass; each pass thus does five bisection steps.
FAN = 32
PASSES = 8


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def exponent(sources: DataFrame, budget: float, target_entropy: float | None, max_repeat: float | None) -> float:
    """The exponent for a table (source, tokens) of one row per source, to six decimals."""
    top = F.lit(float(sources.agg(F.max("tokens")).first()[0]))
    n = sources.count()
    if n <= 1:
        return 1.0

    def measured(points: list[float]) -> list[tuple[float, float, float]]:
        z = F.pow(F.col("tokens") / top, F.col("a"))
        rows = (
            sources.select("tokens", F.explode(F.array(*map(F.lit, points))).alias("a"))
            .groupBy("a")
            .agg(F.sum(z).alias("z"), F.sum(z * F.log(z)).alias("zlz"), F.max(z / F.col("tokens")).alias("rep"))
            .select("a", (F.log("z") - F.col("zlz") / F.col("z")).alias("entropy"), (F.col("rep") / F.col("z") * F.lit(float(budget))).alias("repeat"))
            .orderBy("a")
            .collect()  # FAN rows
        )
        return [(r["a"], r["entropy"], r["repeat"]) for r in rows]

    def bisect(low_side) -> float:
        """The boundary in [0, 1] below which low_side(entropy, repeat) holds and above which not."""
        low, high = 0.0, 1.0
        for _ in range(PASSES):
            step = (high - low) / FAN
            points = [low + step * i for i in range(1, FAN)]
            inside = [a for a, e, r in measured(points) if low_side(e, r)]
            low, high = (max(inside) if inside else low), (max(inside) if inside else low) + step
        return (low + high) / 2

    ends = measured([0.0, 1.0])
    a = 1.0
    if target_entropy is not None and ends[1][1] < target_entropy:
        a = bisect(lambda e, r: e >= target_entropy) if ends[0][1] >= target_entropy else 0.0
    elif target_entropy is None and max_repeat is not None:
        a = 0.0
    if max_repeat is not None and ends[0][2] > max_repeat:
        a = max(a, bisect(lambda e, r: r > max_repeat) if ends[1][2] <= max_repeat else 1.0)
    return round(a, 6)


def mix(docs: DataFrame, *, budget_tokens: int | None = None, cover: bool = False, entropy_share: float | None = 0.97, max_repeat: float = 4.0, seed: str = "mix", block_docs: int = 1024, carry: tuple[str, ...] = (), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The schedule: one row per document and epoch (id, source, block, position, epoch, tokens).

    budget_tokens: tokens to schedule, all tokens of the table if None. cover: instead, the budget
    at which the least repeated source has one whole epoch, so that every document stays.
    entropy_share: target entropy as a share of the log of the number of sources; None for the
    flattest weights that max_repeat allows.
    """
    keys = {"id": id_col, "source": source_col}
    extra = [F.col(c).alias(f"x_{i}") for i, c in enumerate(carry)]
    d = docs.select(*[F.col(v).alias(f"m_{k}") for k, v in keys.items()], words(F.col(text_col)).alias("m_tokens"), *extra)
    sources = common.cut(d.groupBy("m_source").agg(F.sum("m_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")))
    wordless = sources.filter("tokens = 0").select("m_source")
    sources = sources.filter("tokens > 0")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    budget = float(budget_tokens or total)
    n = sources.count()
    target = None if entropy_share is None or n < 2 else entropy_share * math.log(n)
    if cover:
        # relative to the largest source: one epoch of it, and (largest / own) ** (1 - a) of the others
        a = exponent_cover(sources, max_repeat) if n > 1 else 1.0
    else:
        a = exponent(sources, budget, target, max_repeat) if n else 1.0
    top = float(sources.agg(F.max("tokens")).first()[0] or 1)  # sources: a row a source
    z = F.pow(F.col("tokens") / F.lit(top), F.lit(a))
    z_sum = sources.agg(F.sum(z)).first()[0] or 1.0
    epochs = F.pow(F.col("tokens") / F.lit(top), F.lit(a - 1.0)) if cover else z / F.lit(z_sum) * F.lit(budget) / F.col("tokens")
    plan = sources.select(
        F.col("m_source").alias("p_source"),
        F.least(epochs, F.lit(float(max(max_repeat, 1.0)))).alias("p_epochs"),
        F.ceil(F.col("docs") / F.lit(block_docs)).cast("long").alias("p_blocks"),
    )
    if cover:  # sources without words cost nothing: one epoch of each
        plan = plan.union(wordless.select("m_source", F.lit(1.0), F.lit(1).cast("long")))
    key = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("m_id").cast("string"), F.lit("")))
    number = lambda tag: F.conv(F.substring(F.md5(F.concat(F.lit(tag), key).cast("binary")), 1, 15), 16, 10).cast("long")
    d = d.join(plan, F.col("m_source").eqNullSafe(F.col("p_source"))).withColumns({"m_block": number("b|") % F.col("p_blocks"), "m_order": number("o|")})
    block = Window.partitionBy("m_source", "m_block")
    order = block.orderBy("m_order", "m_id", "m_tokens")
    d = d.withColumns(
        {
            "m_position": F.row_number().over(order).cast("long"),
            "m_before": F.coalesce(F.sum("m_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "m_block_tokens": F.sum("m_tokens").over(block),
        }
    )
    whole = F.floor("p_epochs")
    last = (F.col("p_epochs") > whole) & (F.col("m_before") + F.col("m_tokens") / 2 <= (F.col("p_epochs") - whole) * F.col("m_block_tokens"))
    d = d.withColumn("m_copies", (whole + F.when(last, 1).otherwise(0)).cast("int")).filter("m_copies > 0")
    d = d.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("m_copies"))))
    return d.select(
        F.col("m_id").alias(id_col), F.col("m_source").alias(source_col), F.col("m_block").alias("block"), F.col("m_position").alias("position"), "epoch", F.col("m_tokens").alias("tokens"),
        *[F.col(f"x_{i}").alias(c) for i, c in enumerate(carry) if c not in (id_col, source_col)],
    )


def exponent_cover(sources: DataFrame, max_repeat: float) -> float:
    """With one epoch of the largest source, the others have (largest / own) ** (1 - a) of them: the
    smallest a at which that stays within max_repeat, bisected."""
    ends = sources.agg(F.max("tokens"), F.min("tokens")).first()
    ratio = ends[0] / ends[1]
    low, high = 0.0, 1.0
    if ratio <= max_repeat:
        return 0.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if ratio ** (1 - mid) > max_repeat else (low, mid)
    return round(high, 6)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).drop("tokens")


SQL = """
with recursive d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as tokens from documents
), s as (
  select source, sum(tokens)::double as t, count(*) as n from d group by source having sum(tokens) > 0
), c as (
  select max(t) as top, sum(t) as total, 0.97 * ln(count(*)) as target from s
), search(i, lo_e, hi_e, lo_r, hi_r) as (
  select 0, 0.0::double, 1.0::double, 0.0::double, 1.0::double
  union all
  select i + 1,
    case when e >= target then (lo_e + hi_e) / 2 else lo_e end, case when e >= target then hi_e else (lo_e + hi_e) / 2 end,
    case when r > 4 then (lo_r + hi_r) / 2 else lo_r end, case when r > 4 then hi_r else (lo_r + hi_r) / 2 end
  from (
    select i, lo_e, hi_e, lo_r, hi_r, any_value(target) as target,
      ln(sum(ze)) - sum(ze * ln(ze)) / sum(ze) as e, max(zr / t) / sum(zr) * any_value(total) as r
    from (select q.*, s.t, c.target, c.total, pow(s.t / c.top, (lo_e + hi_e) / 2) as ze, pow(s.t / c.top, (lo_r + hi_r) / 2) as zr
          from search q, s, c where q.i < 42) g
    group by i, lo_e, hi_e, lo_r, hi_r) h
), ends as (
  select ln(sum(t / top)) - sum(t / top * ln(t / top)) / sum(t / top) as e1, ln(count(*)) as e0, max(1 / t) / count(*) * any_value(total) as r0 from s, c
), a as (
  select round(greatest(case when e1 >= target or (select count(*) from s) < 2 then 1.0 else lo_e end, case when r0 > 4 then lo_r else 0.0 end), 6) as a
  from search, ends, c where i = 42
), w as (
  select source, t, n, pow(t / top, a) as z from s, c, a
), p as (
  select source, least(z / (select sum(z) from w) * total / t, 4.0) as epochs, ceil(n / 1024)::bigint as blocks from w, c
), o as (
  select d.*, epochs,
    ('0x' || substr(md5('b|mix|' || coalesce(doc_id::varchar, '')), 1, 15))::bigint % blocks as block,
    ('0x' || substr(md5('o|mix|' || coalesce(doc_id::varchar, '')), 1, 15))::bigint as ord
  from d join p on d.source is not distinct from p.source
), r as (
  select *, row_number() over q as position, coalesce(sum(tokens) over (q rows between unbounded preceding and 1 preceding), 0) as before,
    sum(tokens) over (partition by source, block) as in_block
  from o window q as (partition by source, block order by ord, doc_id, tokens)
)
select doc_id, source, block, position, unnest(generate_series(1, copies))::int as epoch from (
  select *, floor(epochs)::int + case when epochs > floor(epochs) and before + tokens / 2 <= (epochs - floor(epochs)) * in_block then 1 else 0 end as copies from r)
where copies > 0
"""
