"""The narratives of many prompts equal a loop over each."""

import random

from pyspark.sql import functions as F

from tidemark.operators import fact_narrative as m


def duration(n):
    return "less than a year" if n == 0 else "1 year" if n == 1 else f"{n} years (brief)" if n <= 2 else f"{n} years" if n <= 5 else f"{n} years (extended)" if n <= 10 else f"{n} years (long-standing)"


def told(facts, compact_over, budget):
    facts = sorted(set(facts), key=lambda f: (f[3], f[4], f[0], f[1], int(f[2][1:])))
    compact, low, high = len(facts) > compact_over, min(f[3] for f in facts), max(f[4] for f in facts)
    objects = {o: [f for f in facts if f[2] == o] for o in sorted({f[2] for f in facts}, key=lambda o: int(o[1:]))}
    out = [f"TEMPORAL CONTEXT ({low}–{high}, spanning {high - low} years)", "", "═══ ENTITY TIMELINES ═══", ""]
    for o, own in objects.items():
        out.append(f"▸ Timeline for {o}:")
        for i, (s, r, _, a, b) in enumerate(own):
            gap = a - own[i - 1][4]
            tail = "" if not i else f" ({gap}yr gap)" if gap > 0 else " (immediately following)" if not gap else f" (began {-gap}yr before prev ended)"
            out.append(f"  [{a}–{b}] {s} as {r} — {duration(b - a)}{tail}")
            shared = [x for x in own if x != own[i] and max(a, x[3]) < min(b, x[4])]
            out += [f"    ↔ concurrent with {x[0]} as {x[1]} ({max(a, x[3])}–{min(b, x[4])})" for x in shared[: 1 if compact else 3]]
        roles = sorted({f[1] for f in own})
        out.append("  Summary: " + "; ".join(f"{r}: {', '.join(f[0] for f in own if f[1] == r)}" for r in roles))
        out.append("")
    if not compact:
        out += ["═══ TEMPORAL ORDERING (all facts by start time) ═══", ""]
        for i, (s, r, o, a, b) in enumerate(facts):
            since = a - facts[i - 1][3]
            tail = "" if not i else f" — starts {since}yr after #{i}" if since else " — same start as previous"
            out.append(f"  {i + 1}. [{a}→{b}] {s} was {r} of {o} ({duration(b - a)}){tail}")
        out.append("")
    out += ["═══ KEY TEMPORAL RELATIONSHIPS ═══", ""]
    for o, own in objects.items():
        for r in sorted({f[1] for f in own}):
            held = [f for f in own if f[1] == r]
            if len(held) > 1:
                out.append(f"  {o}/{r}: first={held[0][0]} ({held[0][3]}), last={held[-1][0]} ({held[-1][3]}), {len(held)} total holders")
                for x, y in zip(held, held[1:]):
                    gap = y[3] - x[4]
                    how = "immediately succeeded by" if not gap else f"succeeded {gap}yr later by" if gap > 0 else f"overlapped ({-gap}yr) then succeeded by"
                    out.append(f"    {x[0]} ({x[3]}–{x[4]}) {how} {y[0]} ({y[3]}–{y[4]})")
    out.append("")
    text = "\n".join(out)
    return text if len(text) <= budget else text[:budget] + "\n" + m.CUT


def test_narratives_equal_a_loop_over_prompts(spark):
    rng, rows = random.Random(5), []
    for p in range(6):
        for _ in range([1, 3, 12, 30, 31, 90][p]):
            a = rng.randrange(1950, 1990)
            rows.append((p, f"Ann {rng.randrange(12)}", rng.choice(["chair", "dean"]), f"E{rng.randrange(1, 14)}", a, a + rng.choice([0, 1, 2, 4, 9, 20])))
    rows += rows[:2]
    df = spark.createDataFrame(rows, "prompt int, subject string, role string, object string, start int, end int")
    number = F.substring("object", 2, 20).cast("long")
    for budget in (400_000, 700, 1):
        got = {}
        for r in sorted(m.narrated(df, number, budget, compact_over=30).collect(), key=lambda r: r.position):
            got.setdefault(r.prompt, []).append(r.line)
        for p in range(6):
            assert "\n".join(got[p]) == told([r[1:] for r in rows if r[0] == p], 30, budget), (p, budget)
    assert m.narrated(df.limit(0), number).collect() == []


def test_objects_beyond_the_budget_are_left_out_early(spark):
    rows = [(p, f"Ann {i % 5}", "chair", f"E{i % 60}", 1950 + i % 9, 1952 + i % 11) for p in range(3) for i in range([4, 300, 900][p])]
    df = spark.createDataFrame(rows, "prompt int, subject string, role string, object string, start int, end int")
    number = F.substring("object", 2, 20).cast("long")
    kept, every = (m.lines(df, number, budget=b).groupBy("prompt").count().collect() for b in (900, None))
    kept, every = ({r.prompt: r["count"] for r in x} for x in (kept, every))
    assert kept[0] == every[0] and kept[1] < every[1] / 3 and kept[2] < every[2] / 3
    by = lambda d: sorted(map(tuple, d.collect()))
    assert by(m.narrated(df, number, 900)) == by(m.assembled(m.lines(df, number), 900))
