"""Interval facts (subject, role, object, start, end in years): overlaps, gaps, successions, derived sentences, relevance."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import settled

FACT = ("start", "end", "subject", "role")
#: Facts of one object that a task takes as one; objects with more are spread over cells or running counts.
HOT_FACTS = 100_000
#: The types of whole numbers.
WHOLE = ("byte", "short", "integer", "long")


def _cells(start: Column, end: Column, width: int) -> Column:
    """The cells of a time grid (*width* in the units of the bounds) that a half-open interval touches; none if it is empty."""
    cell = lambda c: F.floor(c / width).cast("long")
    return F.when(start < end, F.sequence(cell(start), cell(end - 1))).otherwise(F.array().cast("array<long>"))


def _number(df: DataFrame, column: str) -> Column:
    """Dates as days, so that bounds are whole numbers."""
    return F.unix_date(column) if df.schema[column].dataType.typeName() == "date" else F.col(column)


def overlapping(facts: DataFrame, start: str = "start", end: str = "end", width: int | None = None) -> DataFrame:
    """Pairs of different facts on one object whose half-open intervals overlap, each pair once.

    a_* precedes b_* in the order of (start, end, subject, role).  An object is cut into cells of a time
    grid (*width*: 4 years, or 365 days for dates): a fact stands in all cells that it touches and asks in that of its start, so a pair meets
    once, in the cell of its later start, and a hot object is spread over its cells.
    """
    width = width or (365 if facts.schema[start].dataType.typeName() == "date" else 4)
    x, y = _number(facts, start), _number(facts, end)
    stand = facts.withColumn("_cell", F.explode(_cells(x, y, width)))
    ask = facts.filter(x < y).withColumn("_cell", F.floor(x / width).cast("long"))
    a = stand.select(*(F.col(c).alias(f"a_{c}") for c in facts.columns), "_cell")
    b = ask.select(*(F.col(c).alias(f"b_{c}") for c in facts.columns), "_cell")
    names = dict.fromkeys([start, end, "subject", "role"])
    before = F.struct(*(F.col(f"a_{c}") for c in names)) < F.struct(*(F.col(f"b_{c}").alias(f"a_{c}") for c in names))
    met = F.col(f"b_{start}") < F.col(f"a_{end}")
    return a.join(b, (F.col("a_object") == F.col("b_object")) & a["_cell"].eqNullSafe(b["_cell"]) & met & before).select(*(f"{p}_{c}" for p in "ab" for c in facts.columns))


def overlap_counts(facts: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Each fact with the number of others on its object that overlap it, without any pairs.

    Half-open intervals: of the others, those that began before it ends less those that
    ended by its start.  An object's facts are counted in one task, after one shuffle; those of an object of over HOT_FACTS facts, and
    bounds that are no dates or numbers of one kind, by running counts of its starts and ends.
    """
    real = facts.filter((F.col(end) > F.col(start)) & F.col("object").isNotNull())
    kinds, of = {facts.schema[c].dataType.typeName() for c in (start, end)}, facts.schema["object"].dataType.typeName()
    if len(kinds) > 1 or not kinds <= {"date", *WHOLE, "float", "double"} or of not in {"string", "date", *WHOLE}:
        return _counted_by_marks(real, start, end)
    hot = hot_objects(real)
    if hot.isEmpty():
        return _counted_whole(real, start, end)
    cold, rest = (real.join(F.broadcast(hot), "object", how) for how in ("left_anti", "left_semi"))
    return _counted_whole(cold, start, end).unionByName(_counted_by_marks(rest, start, end))


def _counted_whole(facts: DataFrame, start: str, end: str) -> DataFrame:
    """:func:`overlap_counts` of objects that a task can hold one at a time."""
    x, y = _number(facts, start), _number(facts, end)
    ordered = facts.select(*facts.columns, x.alias("_x"), y.alias("_y")).repartition("object").sortWithinPartitions("object")
    at, width = facts.columns.index("object"), len(facts.columns)

    def counted(rows: pa.Table) -> pa.Table:
        own = rows.column(at).combine_chunks()
        begins = np.concatenate([[True], pc.not_equal(own[1:], own[:-1]).to_numpy(zero_copy_only=False)]) if len(own) else np.zeros(0, bool)
        group = np.cumsum(begins)
        x, y = (rows.column(c).to_numpy() for c in (width, width + 1))
        is_start = np.repeat([False, True], len(x))  # at one time ends stand before starts
        order = np.lexsort((is_start, np.concatenate([y, x]), np.concatenate([group, group])))
        began, ended = (np.empty(2 * len(x), dtype=np.int64) for _ in range(2))
        began[order], ended[order] = np.cumsum(is_start[order]), np.cumsum(~is_start[order])
        return rows.select(range(width)).append_column("overlaps", pa.array(began[: len(x)] - ended[len(x) :] - 1))

    def run(batches):
        held = []  # the last object so far, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(at)
            cuts = np.flatnonzero(pc.not_equal(own[1:], own[:-1]).to_numpy(zero_copy_only=False)) + 1
            if held and held[-1].column(at)[-1] != own[0]:
                yield from counted(pa.Table.from_batches(held)).to_batches()
                held = []
            cut = int(cuts[-1]) if len(cuts) else 0
            if cut:
                yield from counted(pa.Table.from_batches([*held, batch.slice(0, cut)])).to_batches()
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from counted(pa.Table.from_batches(held)).to_batches()

    return ordered.mapInArrow(run, T.StructType([*facts.schema.fields, T.StructField("overlaps", T.LongType())]))


def _counted_by_marks(facts: DataFrame, start: str, end: str) -> DataFrame:
    """:func:`overlap_counts` by running counts over the different starts and ends of an object."""
    s, e = F.col(start), F.col(end)
    marks = facts.select("object", F.explode(F.array(F.struct(s.alias("at"), F.lit(1).alias("s"), F.lit(0).alias("e")), F.struct(e.alias("at"), F.lit(0).alias("s"), F.lit(1).alias("e")))).alias("m"), F.when(e > s, 1).otherwise(0).alias("real"))
    sums = marks.filter("real = 1").groupBy("object", F.col("m.at").alias("at")).agg(F.sum("m.s").alias("s"), F.sum("m.e").alias("e"))
    w = Window.partitionBy("object").orderBy("at")
    running = sums.select(
        "object", "at",
        F.coalesce(F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("began_before"),
        F.sum("e").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("ended_by"),
    )
    at_end = running.select("object", F.col("at").alias(end), "began_before")
    at_start = running.select("object", F.col("at").alias(start), "ended_by")
    real = facts.filter(e > s)
    counted = real.join(at_end, ["object", end]).join(at_start, ["object", start]).withColumn("overlaps", F.col("began_before") - F.col("ended_by") - 1)
    return counted.drop("began_before", "ended_by")


def hot_objects(facts: DataFrame) -> DataFrame:
    """object: those with over HOT_FACTS facts, so at most one for so many rows."""
    return settled(facts.groupBy("object").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_FACTS).select("object"))


def capped_overlaps(facts: DataFrame, k: int, width: int = 4) -> DataFrame:
    """For each different fact at most *k* facts that overlap it, in the order of (start, end, subject, role).

    No pairs beyond those are made.  An object is swept once in that order: a fact gets the first
    *k* that are still open when it starts, and is handed to every open one that has fewer than *k* so far.  An object of over
    HOT_FACTS facts is swept by the cells of the time grid; the best *k* of a fact's cells are its answer.
    """
    one = facts.select("object", *FACT).filter(F.col("start") < F.col("end"))
    hot = hot_objects(one)
    if hot.isEmpty():
        return _swept(one, k)
    whole = _swept(one.join(F.broadcast(hot), "object", "left_anti"), k)
    cells = one.join(F.broadcast(hot), "object", "left_semi").distinct().withColumn("cell", F.explode(_cells(F.col("start"), F.col("end"), width)))
    w = Window.partitionBy("a_object", *(f"a_{c}" for c in FACT)).orderBy(*(f"b_{c}" for c in FACT))
    by_cells = _swept(cells, k, width).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return whole.unionByName(by_cells)


def _swept(facts: DataFrame, k: int, width: int | None = None) -> DataFrame:
    """a_*, b_* and rank of the sweeps of whole objects; with a *width*, of each cell, then ranks count within one only."""
    by = ["object"] if width is None else ["object", "cell"]
    ordered = facts.repartition(*by).sortWithinPartitions(*by, *FACT).select(*by, *FACT)
    kinds = {c: facts.schema[c].dataType.simpleString() for c in ("object", *FACT)}
    names = ["a_object", *(f"a_{c}" for c in FACT), "b_object", *(f"b_{c}" for c in FACT)]
    ddl = ", ".join(f"{n} {kinds[n[2:]]}" for n in names)

    def run(batches):
        now, last, sweep = None, None, None
        for batch in batches:
            objects, out = [], []
            types = [*(batch.schema.field(n[2:]).type for n in names), pa.int32()]
            keys = zip(*(batch.column(i).to_pylist() for i in range(len(by))))
            for key, fact in zip(keys, zip(*(batch.column(c).to_pylist() for c in FACT))):
                if key != now or sweep is None:
                    now, last, sweep = key, None, Sweep(k)
                if fact == last:
                    continue
                last = fact
                found = sweep.met(fact, width is None or fact[0] // width == key[1])
                out += found
                objects += [key[0]] * len(found)
            a, b, ranks = zip(*out) if out else ((), (), ())
            columns = [objects, *(zip(*a) if a else [()] * 4), objects, *(zip(*b) if b else [()] * 4), ranks]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[*names, "rank"])

    return ordered.mapInArrow(run, f"{ddl}, rank int")


class Sweep:
    """Facts (start, end, ...) of one object or cell in order; at most *k* partners for each, the earlier ones first."""

    def __init__(self, k: int):
        self.k, self.open, self.hungry, self.closed = k, [], [], 0

    def met(self, fact: tuple, starts_here: bool) -> list[tuple[tuple, tuple, int]]:
        """(asking fact, its partner, its rank here); facts from earlier cells only wait to be met."""
        pairs, n = [], 0
        if starts_here:
            self.closed = 0
            for other in self.open:
                if other[1] <= fact[0]:
                    self.closed += 1
                    continue
                n += 1
                pairs.append((fact, other, n))
                if n == self.k:
                    break
            if self.closed > 16 and 2 * self.closed > len(self.open):
                self.open = [x for x in self.open if x[1] > fact[0]]
            still = []
            for entry in self.hungry:
                if entry[0][1] > fact[0]:
                    entry[1] += 1
                    pairs.append((entry[0], fact, entry[1]))
                    if entry[1] < self.k:
                        still.append(entry)
            self.hungry = still
        self.open.append(fact)
        if n < self.k:
            self.hungry.append([fact, n])
        return pairs


def holding_in(facts: DataFrame, years: Sequence[int]) -> DataFrame:
    """Facts that hold in one of the given years, both ends included, once for each such ``year``."""
    asked = F.array(*(F.lit(y) for y in sorted(set(years)))).cast("array<int>")
    return facts.withColumn("year", F.explode(F.filter(asked, lambda y: y.between(F.col("start"), F.col("end")))))


def held_counts(facts: DataFrame, years: Sequence[int]) -> DataFrame:
    """year, role, n_facts, n_objects (different ones): the rows of :func:`holding_in` counted by year and role.

    Objects meet once with a count for each year, not once a year, which the maps of the tasks would have to hold apart.
    """
    asked = sorted(set(years))
    held = [F.lit(y).between(F.col("start"), F.col("end")) for y in asked]
    some = facts.filter(F.exists(F.array(*(F.lit(y) for y in asked)).cast("array<int>"), lambda y: y.between(F.col("start"), F.col("end"))))
    per = some.groupBy("object", "role").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(h).alias(f"n{i}") for i, h in enumerate(held)))
    of = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = per.groupBy("role").agg(F.count(F.lit(1)).alias("n"), *(F.struct(of(f"n{i}").alias("n_facts"), F.count_if((F.col(f"n{i}") > 0) & F.col("object").isNotNull()).alias("n_objects")).alias(f"y{i}") for i in range(len(asked))))
    rows = F.array(*(F.struct(F.lit(y).alias("year"), F.col(f"y{i}.n_facts"), F.col(f"y{i}.n_objects")) for i, y in enumerate(asked)))
    return sums.select("role", F.explode(rows).alias("x")).filter("x.n_facts > 0").select("x.year", "role", "x.n_facts", "x.n_objects")


def in_order(facts: DataFrame) -> DataFrame:
    """Each fact with its number (from 1) in the order of (start, end, subject, role, object) and the years since the previous one's start.

    Sorted by range; a range adds the rows of the ranges before it, so no task sees them all.
    """
    keys = ["start", "end", "subject", "role", "object"]
    sorted_ = facts.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    split = settled(sorted_).withColumn("_range", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = split.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.max_by("start", "_id").alias("_last"))  # a row for each range
    before = Window.orderBy("_range")
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lag("_last").over(before).alias("_prev"))
    inside = Window.partitionBy("_range").orderBy("_at")
    joined = split.join(F.broadcast(offsets), "_range")
    gap = F.col("start") - F.coalesce(F.lag("start").over(inside), F.col("_prev"))
    return joined.select(*facts.columns, (F.col("_before") + F.col("_at") + 1).alias("number"), gap.alias("years_since"))


def gaps(facts: DataFrame) -> DataFrame:
    """Each fact with the years since the previous one of its object: gap, following or overlap."""
    w = Window.partitionBy("object").orderBy("start", "end", "subject", "role")
    gap = F.col("start") - F.lag("end").over(w)
    kind = F.when(F.col("gap") > 0, "gap").when(F.col("gap") == 0, "following").when(F.col("gap") < 0, "overlap").otherwise("first")
    return facts.withColumn("gap", gap).withColumn("relation", kind)


def successions(facts: DataFrame) -> DataFrame:
    """Per object and role with two holders or more: first and last holder, their starts, number of holders."""
    order = F.struct("start", "end", "subject")
    return (
        facts.groupBy("object", "role")
        .agg(F.min(order).alias("a"), F.max(order).alias("z"), F.count(F.lit(1)).alias("holders"))
        .filter("holders >= 2")
        .select("object", "role", F.col("a.subject").alias("first_subject"), F.col("a.start").alias("first_start"), F.col("z.subject").alias("last_subject"), F.col("z.start").alias("last_start"), "holders")
    )


def succession_steps(facts: DataFrame) -> DataFrame:
    """Each holder with the next one of its object and role and the years between."""
    w = Window.partitionBy("object", "role").orderBy("start", "end", "subject")
    step = F.lead("start").over(w) - F.col("end")
    return facts.select("object", "role", "subject", "start", "end", F.lead("subject").over(w).alias("next_subject"), step.alias("years")).filter("next_subject is not null").withColumn(
        "relation", F.when(F.col("years") == 0, "immediately").when(F.col("years") > 0, "later").otherwise("overlapped")
    )


def era(year: Column, first: Column, last: Column) -> Column:
    """early, middle or later: thirds of the whole span, a year at least."""
    size = F.greatest(F.floor((last - first) / 3), F.lit(1))
    return F.when(year - first < size, "early").when(year - first < 2 * size, "middle").otherwise("later")


def _sentences(years: Sequence[int]) -> list[tuple[str, Column]]:
    """The kinds and sentences of a fact; null where one does not apply."""
    s, r, o = (F.col(c).cast("string") for c in ("subject", "role", "object"))
    a, b = F.col("start").cast("string"), F.col("end").cast("string")
    was = lambda y: F.concat(F.lit("In "), y, F.lit(", "), s, F.lit(" was the "), r, F.lit(" of "), o, F.lit("."))
    return [
        ("start", F.concat(s, F.lit(" started being the "), r, F.lit(" of "), o, F.lit(" in "), a, F.lit("."))),
        ("stop", F.concat(s, F.lit(" stopped being the "), r, F.lit(" of "), o, F.lit(" in "), b, F.lit("."))),
        ("duration", F.concat(s, F.lit(" was the "), r, F.lit(" of "), o, F.lit(" for "), (F.col("end") - F.col("start")).cast("string"), F.lit(" years ("), a, F.lit("-"), b, F.lit(")."))),
        ("boundary", was(a)),
        ("boundary", F.when(F.col("end") != F.col("start"), was(b))),
        *(("year", F.when((F.col("start") < y) & (F.lit(y) < F.col("end")), was(F.lit(str(y))))) for y in sorted(set(years))),
    ]


def derived_sentences(facts: DataFrame, years: tuple[int, ...] = ()) -> DataFrame:
    """The facts with a sentence each for start, end, duration, both boundary years and the given years between."""
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), x.alias("sentence")) for k, x in _sentences(years)))
    return facts.withColumn("x", F.explode(rows)).filter("x.sentence is not null").select(*facts.columns, "x.kind", "x.sentence")


def first_sentences(facts: DataFrame, years: tuple[int, ...] = ()) -> DataFrame:
    """subject, role, object, kind, n, sentence: how many :func:`derived_sentences` of each kind, and the first of them.

    Equal facts are counted first, and sentences are worded after the shuffles, so neither they nor a row for each are moved.
    """
    key = ["subject", "role", "object"]
    counted = facts.groupBy(*key, "start", "end").agg(F.count(F.lit(1)).alias("m")).repartition(*key)
    kinds: dict[str, list[Column]] = {}
    for kind, sentence in _sentences(years):
        kinds.setdefault(kind, []).append(sentence)
    per = [x for k, xs in kinds.items() for x in (
        F.sum(F.col("m") * sum((F.when(x.isNotNull(), 1).otherwise(0) for x in xs), F.lit(0))).alias(f"n_{k}"),
        F.min(F.least(*xs) if len(xs) > 1 else xs[0]).alias(f"s_{k}"),
    )]
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"n_{k}").alias("n"), F.col(f"s_{k}").alias("sentence")) for k in kinds))
    return counted.groupBy(*key).agg(*per).select(*key, F.explode(rows).alias("x")).filter("x.n > 0").select(*key, "x.*")


def question_class(question: Column) -> Column:
    """compound_time, point_in_time, end_time, start_time, ordering, duration, count, timeline or general: the first that fits."""
    q = F.lower(question)
    has = lambda *ws: F.rlike(q, F.lit("|".join(ws)))
    return (
        F.when((has("at the") & has("time of")) | has("at the start", "at the end"), "compound_time")
        .when(has(r"in \d{4}", r"during \d{4}"), "point_in_time")
        .when(has("stop", "end", "cease", "no longer", "finish"), "end_time")
        .when(has("start", "begin", "first time", "initially"), "start_time")
        .when(has("first", "last", "before", "after", "earlier", "later"), "ordering")
        .when(has("how long", "duration", "years", "span", "period"), "duration")
        .when(has("how many", "count", "number of"), "count")
        .when(has("timeline", "sequence", "order"), "timeline")
        .otherwise("general")
    )


def is_compound(question: Column) -> Column:
    q = F.lower(question)
    has = lambda w: F.contains(q, F.lit(w))
    return (has("at the") & has("time of")) | has("at the start") | has("at the end") | has(",")


def question_ids(question: Column, letter: str) -> Column:
    """The distinct ids such as E12 of a question, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(question, F.lit(rf"{letter}\d+"), F.lit(0)))


def question_years(question: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(question, F.lit(r"\b(19\d{2}|20\d{2})\b"), F.lit(1)), lambda y: y.cast("int")))


def relevance_tiers(facts: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id, facts and tier (0 exact to 3) of the facts that share an id with a question.

    *questions*: question_id, entities and roles (arrays of ids), compound.  Facts meet
    a question by an equi-join on the ids, not by a product.
    """
    q = questions.withColumn("subject_hint", F.when((F.size("entities") >= 2) & ~F.col("compound"), F.get("entities", F.lit(0)))).withColumn(
        "object_hint", F.when((F.size("entities") >= 2) & ~F.col("compound"), F.element_at("entities", -1))
    )
    wanted = q.withColumn("id", F.explode("entities"))
    sides = facts.withColumn("id", F.explode(F.array_distinct(F.array("subject", "object"))))
    met = sides.join(wanted, "id").dropDuplicates(["question_id", "subject", "role", "object", "start", "end"])
    both = F.array_contains("entities", F.col("subject")) & F.array_contains("entities", F.col("object")) & (F.col("subject") != F.col("object"))
    role = F.array_contains("roles", F.col("role"))
    exact = role & (F.col("subject") == F.col("subject_hint")) & (F.col("object") == F.col("object_hint"))
    tier = F.when(exact, 0).when(both, 1).when(role, 2).otherwise(3)
    return met.select("question_id", "compound", "subject", "role", "object", "start", "end", tier.alias("tier"))


def relevant_facts(facts: DataFrame, questions: DataFrame, cap: int = 80, compound_cap: int = 150) -> DataFrame:
    """The first facts of each question by tier, then by (start, end, subject, role, object)."""
    w = Window.partitionBy("question_id").orderBy("tier", "start", "end", "subject", "role", "object")
    ranked = relevance_tiers(facts, questions).withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= F.when(F.col("compound"), compound_cap).otherwise(cap)).drop("compound")
