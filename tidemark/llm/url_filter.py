r"""URL filters: rules first, then words of the address.

*Segmentation.* Hosts often glue words together.  A unigram model counts the words of
the visible text of all pages; a Viterbi search splits each run of letters into its
likeliest words.  Each distinct run is split once: its substrings are joined with
the word counts, so the counts are never sent around as a whole.  *Classifier.*
Multinomial naive Bayes over the words of host and path and over where both meet (:func:`combined`), with add-one smoothing.

*Labels.* The rules label the addresses that they cover.  Beyond them an address with a
seed word is labelled block, any other is weak evidence for allow; seed words are left out
of the features, so what is learnt there are the words beside them.  An address with a seed word and
without a rule is blocked, whatever its score.
*Folds.* The hosts fall into ``FOLDS`` folds and an address is scored by the labels of
the other folds, never by its own host's; :func:`evaluation` compares such scores with
the rules.

Words, tokens and their weights are joined by shuffles; only keys with more than one in
``HOT_SHARE`` of the rows are joined by a broadcast, and there are fewer than
``HOT_SHARE`` of those at any input size.

Defined cases: a null address, or one without ``://``, has empty host and path,
matches no rule and scores by the prior; words that no label knows count nothing; an
empty table gives an empty result; repeated rows are judged each, and alike; ties of the
score allow; ties of the search take the longer last word; other columns are unread.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize, skew_join, table

#: (verdict, host and path), as fixed by the task.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Words that mark an address as unwanted.
SEEDS = frozenset("adult bet bets betting casino cialis escort gambling jackpot loan loans lottery malware payday phishing pills poker porn roulette scam sex slots spam viagra warez xxx".split())
FOLDS = 5
#: Stretches of so many letters are proposed as they stand; longer words are found by their first WORD_CHARS letters.  An unknown stretch is no longer.
WORD_CHARS = 20
#: What an unknown word costs besides the total, and for each letter.
UNKNOWN, UNKNOWN_LETTER = math.log(10), 2.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """page_id, host, path of every address."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce("url", F.lit(""))
    return pages.select(
        "page_id",
        F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER).alias("host"),
        F.regexp_extract(url, pattern, 2).alias("path"),
    )


def matching_rule(rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(slash + path))
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


# -- words ---------------------------------------------------------------------------


def word_counts(pages: DataFrame) -> DataFrame:
    """word, n: the words of two letters or more in the visible text of all pages."""
    visible = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)[^>]*>.*?</\1>|<[^>]*>", " ")
    words = pages.select(F.explode(F.split(F.lower(visible), "[^a-z]+")).alias("word"))
    return words.filter(F.length("word") > 1).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def best_split(run: str, known: dict[tuple[int, int], float], total: float) -> list[str]:
    """Viterbi: the cheapest split of each prefix; *known* has the cost of the words at (start, end)."""
    unknown = math.log(max(total, 1)) + UNKNOWN
    best: list[tuple[float, int]] = [(0.0, 0)]
    longer: dict[int, list[int]] = {}
    for start, end in known:
        if end - start > WORD_CHARS:
            longer.setdefault(end, []).append(start)
    for end in range(1, len(run) + 1):
        options = []
        for start in (*range(max(0, end - WORD_CHARS), end), *longer.get(end, ())):
            cost = known.get((start, end))
            options.append((best[start][0] + (unknown + UNKNOWN_LETTER * (end - start) if cost is None else cost), start))
        best.append(min(options))
    out, end = [], len(run)
    while end:
        start = best[end][1]
        out.append(run[start:end])
        end = start
    return out[::-1]


def substrings(runs: DataFrame, batch_rows: int = 100_000) -> DataFrame:
    """id, start, word: all stretches of two to WORD_CHARS letters of *runs* (id, run)."""
    schema = pa.schema([("id", pa.int64()), ("start", pa.int32()), ("word", pa.string())])

    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for i, run in zip(batch.column(0).to_pylist(), batch.column(1)):
                run = run.as_py()
                for start in range(len(run) - 1):
                    held += [(i, start, run[start:end]) for end in range(start + 2, min(len(run), start + WORD_CHARS) + 1)]
                    if len(held) >= batch_rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return runs.select("id", "run").mapInArrow(run_batches, "id long, start int, word string")


def segmented(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """run, words: each of the distinct *runs* (run) of letters a to z, split by the word *counts*."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    runs = materialize(runs.select("run", F.monotonically_increasing_id().alias("id")), "url-distinct-runs")
    parts = materialize(substrings(runs), "url-substrings")
    cost = F.log(F.lit(float(max(total, 1))) / F.col("n"))
    found = skew_join(parts, counts, "word").select("id", "start", (F.col("start") + F.length("word")).alias("end"), cost.alias("cost"))
    long_words = counts.filter(F.length("word") > WORD_CHARS).select(F.substring("word", 1, WORD_CHARS).alias("word"), F.col("word").alias("whole"), "n")
    begun = parts.filter(F.length("word") == WORD_CHARS).join(long_words.hint("merge"), "word").join(runs.hint("merge"), "id")
    begun = begun.filter(F.col("run").substr(F.col("start") + 1, F.length("whole")) == F.col("whole"))
    found = found.unionByName(begun.select("id", "start", (F.col("start") + F.length("whole")).alias("end"), cost.alias("cost")))
    known = found.groupBy("id").agg(F.collect_list(F.struct("start", "end", "cost")).alias("known"))  # at most WORD_CHARS a letter
    rows = runs.join(known, "id", "left")

    def split(columns: list[list]) -> list[list]:
        out = []
        for run, found in zip(*columns):
            out.append(best_split(run, {(x["start"], x["end"]): x["cost"] for x in found or ()}, total))
        return [columns[0], out]

    schema = pa.schema([("run", pa.string()), ("words", pa.list_(pa.string()))])
    return map_rows(rows.select("run", "known"), split, schema, "run string, words array<string>")


def with_tokens(addresses: DataFrame, counts: DataFrame) -> DataFrame:
    """*addresses* (row, host, path) and their distinct-by-place ``tokens``: words of the host (``h:``) and of the path (``p:``); a run of digits is ``0``."""
    pattern = F.lit(r"[a-z]+|[0-9]+|\p{L}+")

    def runs_of(field: str, text: Column) -> Column:
        return F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda r: F.struct(F.lit(field).alias("field"), r.alias("run")))

    pieces = addresses.select("row", F.posexplode(F.concat(runs_of("h", F.col("host")), runs_of("p", F.lower("path")))).alias("place", "x"))
    pieces = materialize(pieces.select("row", "place", "x.field", "x.run"), "url-runs")
    letters = pieces.filter(F.col("run").rlike("^[a-z]"))
    split = materialize(segmented(letters.select("run").distinct(), counts), "url-words")
    token = lambda w: F.concat("field", F.lit(":"), w)
    worded = skew_join(letters, split, "run").select("row", "place", F.transform("words", token).alias("tokens"))
    others = pieces.filter(~F.col("run").rlike("^[a-z]")).select("row", "place", F.array(token(F.when(F.col("run").rlike("^[0-9]"), "0").otherwise(F.col("run")))).alias("tokens"))
    by_row = worded.unionByName(others).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "tokens"))).alias("all"))
    out = addresses.join(by_row, "row", "left")
    flat = F.flatten(F.transform("all", lambda x: x["tokens"]))
    return out.withColumn("tokens", F.coalesce(flat, F.array().cast("array<string>"))).drop("all")


# -- classifier --------------------------------------------------------------------------


def combined(tokens: Column) -> Column:
    """Where a host stands and what is asked there, as features of their own: its last word with the first word of the path, and its first word with both.

    A rule joins host and path, which no sum over single words can follow.
    """
    of = lambda field: F.filter(tokens, lambda t: F.startswith(t, F.lit(field)))
    first, last, path = F.try_element_at(of("h:"), F.lit(1)), F.try_element_at(of("h:"), F.lit(-1)), F.try_element_at(of("p:"), F.lit(1))
    name = lambda *parts: F.concat(F.lit("x:"), *(F.substring(p, 3, 1 << 30) if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.filter(F.array(name(last, "/", path), name(first, "..", last, "/", path)), lambda t: t.isNotNull())


def labelled(tokens: DataFrame, rules: Sequence[tuple[str, str]] = RULES, seeds=SEEDS) -> DataFrame:
    """*tokens* with n_seeds, features (tokens that are no seed words, and :func:`combined` ones of those), fold (of the host) and label: by the rules, else block for a seed word, else allow."""
    marks = F.array(*(F.lit(f"{f}:{w}") for f in "hp" for w in sorted(seeds))).cast("array<string>")
    out = tokens.withColumn("n_seeds", F.size(F.filter("tokens", lambda t: F.array_contains(marks, t))))
    out = out.withColumn("features", F.filter("tokens", lambda t: ~F.array_contains(marks, t)))
    out = out.withColumn("features", F.concat("features", combined(F.col("features"))))
    label = F.coalesce(matching_rule(rules)["verdict"], F.when(F.col("n_seeds") > 0, "block").otherwise("allow"))
    return out.withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")).withColumn("label", label)


def fold_weights(marked: DataFrame) -> tuple[list[float], DataFrame]:
    """Naive Bayes from :func:`labelled` rows: the prior log-odds of block by fold, and (key, weight), the key being fold and token.

    Fold f has the log-odds of what the labels of the other folds say; tokens that those do not know have none.
    """
    is_block, is_allow = (F.col("label") == v for v in ("block", "allow"))
    sizes = {r.fold: r for r in marked.groupBy("fold").agg(F.count_if(is_block).alias("b"), F.count_if(is_allow).alias("a")).collect()}
    rows_b, rows_a = (sum(r[k] for r in sizes.values()) for k in ("b", "a"))
    own = lambda f, k: sizes[f][k] if f in sizes else 0
    priors = [math.log((rows_b - own(f, "b") + 1) / (rows_a - own(f, "a") + 1)) for f in range(FOLDS)]
    exploded = marked.select("fold", "label", F.explode("features").alias("token"))
    by_fold = [F.count_if(c & (F.col("fold") == f)).alias(f"{k}{f}") for k, c in (("b", is_block), ("a", is_allow)) for f in range(FOLDS)]
    counts = materialize(exploded.groupBy("token").agg(*by_fold), "url-tokens")
    total = lambda k: sum((F.col(f"{k}{f}") for f in range(FOLDS)), F.lit(0))
    names = [f"{k}{f}" for k in "ba" for f in range(FOLDS)]
    sums = counts.agg(F.count(F.lit(1)).alias("v"), *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names)).first()
    all_b, all_a = (sum(sums[f"{k}{f}"] for f in range(FOLDS)) for k in "ba")
    parts = []
    for f in range(FOLDS):
        b, a = total("b") - F.col(f"b{f}"), total("a") - F.col(f"a{f}")
        n_b, n_a = (n - sums[f"{k}{f}"] + sums.v for n, k in ((all_b, "b"), (all_a, "a")))
        odds = F.log((b + 1) / F.lit(float(max(n_b, 1)))) - F.log((a + 1) / F.lit(float(max(n_a, 1))))
        parts.append(F.when(a + b > 0, F.struct(F.concat(F.lit(f"{f}:"), "token").alias("key"), odds.alias("weight"))))
    weights = counts.select(F.explode(F.array(*parts)).alias("x")).filter("x is not null").select("x.*")
    return priors, weights


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, seeds=SEEDS) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the log-odds of block by the other folds), tokens, n_seeds."""
    addresses = materialize(with_host_and_path(pages).withColumn("row", F.monotonically_increasing_id()), "url-addresses")
    counts = materialize(word_counts(pages), "url-counts")
    marked = materialize(labelled(with_tokens(addresses, counts), rules, seeds), "url-tokens")
    priors, weights = fold_weights(marked)
    keys = marked.select("row", F.explode("features").alias("token"), "fold")
    keys = keys.select("row", F.concat(F.col("fold").cast("string"), F.lit(":"), "token").alias("key"))
    sums = skew_join(keys, materialize(weights, "url-weights"), "key").groupBy("row").agg(F.sum("weight").alias("odds"))
    prior = F.element_at(F.array(*map(F.lit, priors)), F.col("fold") + 1)
    score = prior + F.coalesce("odds", F.lit(0.0))
    return (
        marked.join(sums, "row", "left")
        .withColumn("score", F.round(score, 9))
        .withColumn("matched", matching_rule(rules))
        .select(
            "page_id",
            "host",
            "path",
            F.col("matched.rule").alias("rule"),
            F.coalesce("matched.verdict", F.when((F.col("n_seeds") > 0) | (F.col("score") > 0), "block").otherwise("allow")).alias("verdict"),
            "score",
            "tokens",
            "n_seeds",
        )
    )


def evaluation(judged: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """precision, recall of block among the addresses under a rule, by scores that never saw a label of their host; covered, blocked."""
    ruled = judged.withColumn("truth", matching_rule(rules)["verdict"] == "block").filter("rule is not null")
    hit, said, true = F.count_if(F.col("truth") & (F.col("score") > 0)), F.count_if(F.col("score") > 0), F.count_if("truth")
    return ruled.agg(
        F.try_divide(hit, said).alias("precision"), F.try_divide(hit, true).alias("recall"), F.count(F.lit(1)).alias("covered"), true.alias("blocked")
    )


def op3_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))
