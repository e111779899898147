"""The three-section narrative of interval facts, for many prompts at once: timelines, order of all facts, succession chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import duration_words
from .facts import capped_overlaps
from .graph import settled

COMPACT_OVER, FULL_OVERLAPS, COMPACT_OVERLAPS, BUDGET = 150, 3, 1, 400_000
ORDER = ["start", "end", "subject", "role"]
CUT = "... (truncated for length)"


def _place(section: int, number: Column | int = -1, object_: Column | str = "", *rest: Column | int) -> Column:
    """Where a line stands: section, object (by its number, then its name), and up to five numbers within it."""
    at = [F.lit(x) if isinstance(x, int) else x for x in rest] + [F.lit(0)] * (5 - len(rest))
    parts = [F.lit(section), F.lit(number) if isinstance(number, int) else number, F.lit(object_) if isinstance(object_, str) else object_, *at]
    kinds = ["int", "long", "string"] + ["long"] * 5
    return F.struct(*(p.cast(k).alias(f"k{i}") for i, (p, k) in enumerate(zip(parts, kinds)))).alias("place")


def _text(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def lines(facts: DataFrame, number: Column, compact_over: int = COMPACT_OVER, full_overlaps: int = FULL_OVERLAPS, compact_overlaps: int = COMPACT_OVERLAPS, budget: int | None = None) -> DataFrame:
    """prompt, place, line of the whole narrative, in no order; identical facts of a prompt count once.

    With a *budget*, objects go whose timeline begins beyond that many characters by the facts' own lines before it; all that follows is beyond it, too.

    *facts*: prompt, subject, role, object, start, end (years); *number* orders the objects.  A prompt with
    over *compact_over* facts is compact: fewer overlaps, no order of all facts.
    """
    per = Window.partitionBy("prompt")
    start, end, subject, role, obj, no = (F.col(c) for c in ("start", "end", "subject", "role", "object", "no"))
    told = _text("  [", start, "–", end, "] ", subject, " as ", role, " — ", duration_words(end - start))
    f = facts.select("prompt", "subject", "role", "object", "start", "end").distinct().withColumn("no", number.cast("long"))
    sizes = f.groupBy("prompt", "no", "object").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("low"), F.max("end").alias("high"), F.coalesce(F.sum(F.length(told) + 1), F.lit(0)).alias("c"))
    if budget is not None:
        sizes = settled(sizes)
    stats = sizes.groupBy("prompt").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    if budget is not None:
        stats = settled(stats)
        before = Window.partitionBy("prompt").orderBy("no", "object").rowsBetween(Window.unboundedPreceding, -1)
        reached = sizes.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))).filter(F.col("before") <= budget).select(F.col("prompt").alias("_prompt"), F.col("object").alias("_object"))
        f = facts.join(reached, facts["prompt"].eqNullSafe(F.col("_prompt")) & facts["object"].eqNullSafe(F.col("_object")), "left_semi")
        f = f.select("prompt", "subject", "role", "object", "start", "end").distinct().withColumn("no", number.cast("long"))
    f = settled(f.join(stats.select("prompt", "n"), "prompt").withColumn("compact", F.col("n") > compact_over).drop("n"))
    span = F.col("high") - F.col("low")
    always = F.array(
        F.struct(_place(0, -1, "", 0), _text("TEMPORAL CONTEXT (", F.col("low"), "–", F.col("high"), ", spanning ", span, " years)").alias("line")),
        F.struct(_place(0, -1, "", 1), F.lit("").alias("line")),
        F.struct(_place(1, -1, "", 0), F.lit("═══ ENTITY TIMELINES ═══").alias("line")), F.struct(_place(1, -1, "", 1), F.lit("").alias("line")),
        F.struct(_place(3, -1, "", 0), F.lit("═══ KEY TEMPORAL RELATIONSHIPS ═══").alias("line")), F.struct(_place(3, -1, "", 1), F.lit("").alias("line")),
        F.struct(_place(4), F.lit("").alias("line")),
    )
    full = F.array(
        F.struct(_place(2, -1, "", 0), F.lit("═══ TEMPORAL ORDERING (all facts by start time) ═══").alias("line")),
        F.struct(_place(2, -1, "", 1), F.lit("").alias("line")), F.struct(_place(2, -1, "", 3), F.lit("").alias("line")),
    )
    fixed = stats.select("prompt", F.explode(F.when(F.col("n") > compact_over, always).otherwise(F.concat(always, full))).alias("x")).select("prompt", "x.*")

    # 1: a line a fact by object, its overlaps after it, and who held what
    own = Window.partitionBy("prompt", "object").orderBy(*ORDER)
    gap = start - F.lag("end").over(own)
    relation = F.when(gap > 0, _text(" (", gap, "yr gap)")).when(gap == 0, " (immediately following)").when(gap < 0, _text(" (began ", -gap, "yr before prev ended)")).otherwise("")
    placed = settled(f.withColumn("i", F.row_number().over(own)).withColumn("relation", relation))
    timeline = placed.select("prompt", _place(1, no, obj, 1, F.col("i")), _text(told, F.col("relation")).alias("line"))
    heads = f.select("prompt", "no", "object").distinct().select("prompt", F.explode(F.array(
        F.struct(_place(1, no, obj, 0), _text("▸ Timeline for ", obj, ":").alias("line")), F.struct(_place(1, no, obj, 3), F.lit("").alias("line")),
    )).alias("x")).select("prompt", "x.*")
    keyed = f.withColumn("object", F.struct("prompt", "object"))
    met = capped_overlaps(keyed, max(full_overlaps, compact_overlaps)).select(
        F.col("a_object.prompt").alias("prompt"), F.col("a_object.object").alias("object"), *(F.col(f"a_{c}").alias(c) for c in ORDER), "rank", *(F.col(f"b_{c}").alias(f"b_{c}") for c in ORDER)
    )
    both = met.join(placed, ["prompt", "object", *ORDER]).filter(F.col("rank") <= F.when(F.col("compact"), compact_overlaps).otherwise(full_overlaps))
    shared = F.greatest("start", "b_start"), F.least("end", "b_end")
    concurrent = both.select("prompt", _place(1, no, obj, 1, F.col("i"), F.col("rank")), _text("    ↔ concurrent with ", F.col("b_subject"), " as ", F.col("b_role"), " (", shared[0], "–", shared[1], ")").alias("line"))
    holders = f.groupBy("prompt", "no", "object", "role").agg(F.array_sort(F.collect_list(F.struct(*ORDER[:3]))).alias("h"))
    one = _text(role, ": ", F.array_join(F.transform("h", lambda x: x["subject"].cast("string")), ", "))
    summed = holders.groupBy("prompt", "no", "object").agg(F.array_sort(F.collect_list(F.struct("role", one.alias("text")))).alias("r"))
    summary = summed.select("prompt", _place(1, no, obj, 2), _text("  Summary: ", F.array_join(F.transform("r", lambda x: x["text"]), "; ")).alias("line"))

    # 2: all facts of a prompt that is not compact, so at most compact_over rows a window
    every = per.orderBy("start", "end", "subject", "role", "no", "object")
    i, since = F.row_number().over(every), start - F.lag("start").over(every)
    sequel = F.when(since == 0, " — same start as previous").when(since > 0, _text(" — starts ", since, "yr after #", i - 1)).otherwise("")
    ordered = f.filter(~F.col("compact")).withColumn("i", i).withColumn("sequel", sequel)
    order = ordered.select("prompt", _place(2, -1, "", 2, F.col("i")), _text("  ", F.col("i"), ". [", start, "→", end, "] ", subject, " was ", role, " of ", obj, " (", duration_words(end - start), ")", F.col("sequel")).alias("line"))

    # 3: first and last holder of each role, and who followed whom
    held = Window.partitionBy("prompt", "object", "role").orderBy("start", "end", "subject")
    roles = f.select("prompt", "object", "role").distinct().withColumn("role_no", F.row_number().over(Window.partitionBy("prompt", "object").orderBy("role")))
    chain = f.withColumn("i", F.row_number().over(held)).withColumn("next", F.lead(F.struct(*ORDER[:3])).over(held)).join(roles, ["prompt", "object", "role"])
    ends = chain.groupBy("prompt", "no", "object", "role", "role_no").agg(F.min_by(F.struct("subject", "start"), "i").alias("a"), F.max_by(F.struct("subject", "start"), "i").alias("z"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = ends.select("prompt", _place(3, no, obj, F.col("role_no")), _text("  ", obj, "/", role, ": first=", F.col("a.subject"), " (", F.col("a.start"), "), last=", F.col("z.subject"), " (", F.col("z.start"), "), ", F.col("n"), " total holders").alias("line"))
    step = F.col("next.start") - end
    how = F.when(step == 0, "immediately succeeded by").when(step > 0, _text("succeeded ", step, "yr later by")).otherwise(_text("overlapped (", -step, "yr) then succeeded by"))
    steps = chain.filter("next is not null").select("prompt", _place(3, no, obj, F.col("role_no"), F.col("i")), _text("    ", subject, " (", start, "–", end, ") ", how, " ", F.col("next.subject"), " (", F.col("next.start"), "–", F.col("next.end"), ")").alias("line"))
    out = fixed
    for part in (timeline, heads, concurrent, summary, order, first, steps):
        out = out.unionByName(part)
    return out


def assembled(placed: DataFrame, budget: int = BUDGET) -> DataFrame:
    """prompt, position, line: the lines in order, joined by line breaks at most *budget* characters; then a mark that the rest is cut.

    Lines of a prompt are summed by section and object first, so only those that the budget reaches are numbered.
    """
    size = F.length("line") + 1
    group = ["place.k0", "place.k1", "place.k2"]
    keyed = settled(placed.withColumn("chars", size).withColumn("g", F.struct(*(F.col(g).alias(g[-2:]) for g in group))))
    groups = keyed.groupBy("prompt", "g").agg(F.sum("chars").alias("c"), F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy("prompt").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    before = groups.select("prompt", "g", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("c0"), F.coalesce(F.sum("m").over(w), F.lit(0)).alias("m0"), F.sum("c").over(Window.partitionBy("prompt")).alias("total"))
    reached = keyed.join(before.filter(F.col("c0") <= budget), ["prompt", "g"])
    inside = Window.partitionBy("prompt", "g").orderBy("place", "line")
    start = F.col("c0") + F.coalesce(F.sum("chars").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = reached.select("prompt", (F.col("m0") + F.row_number().over(inside)).alias("position"), "line", start.alias("at"), "total").filter(F.col("at") <= budget)
    shown = numbered.select("prompt", "position", F.col("line").substr(F.lit(1), F.least(F.length("line"), budget - F.col("at")).cast("int")).alias("line"))
    over = numbered.filter(F.col("total") - 1 > budget).groupBy("prompt").agg((F.max("position") + 1).alias("position"), F.lit(CUT).alias("line"))
    return shown.unionByName(over.select("prompt", "position", "line"))


def narrated(facts: DataFrame, number: Column, budget: int = BUDGET, **modes: int) -> DataFrame:
    """prompt, position, line of the narratives of all prompts."""
    return assembled(lines(facts, number, budget=budget, **modes), budget)
