r"""Spelling variants by forward and backward minimal acyclic automata.

Two words are near if one inserted, deleted or replaced code point makes one of the other.
Then the first half of a word is unchanged in the other, or its second half is.  So words
are dealt by halves: forward, every word asks among the words that begin with its first half;
backward, with all words reversed, among those that end in its second half.  A task builds one minimal
acyclic automaton of the words dealt to it, a slice of whole groups at a time.  A question descends its half exactly and
completes the rest with one error; edges carry how many words come before them, so the way down adds up to
the *number* of the word found (a perfect hash), under which its text and count lie.  What the backward
automaton finds with the first half unchanged was the forward one's, so no pair counts twice.

A group with over ``SHARE`` words is dealt over shares: its words lie in one each, its questions go to all.
Counts combine in the tasks first.  Roots follow by pointer doubling: the count at least doubles with each form, so chains are short.

Defined cases: null texts have no words; a null doc_id hashes as the empty text; repeated rows count
again; a run is changed in all its places in a document; without words of the needed length and count the
result is empty; other columns are unread.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_rows, materialize, slices, table, text_or_empty

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_CHARS, LEAST_COUNT, CHANGED, RATIO = 5, 3, 97, 2
#: Distinct words a task counts before it sends them on.
HELD = 400_000
#: Characters of an automaton (some 300 bytes each at most; more only where one group has them), and words of a share of a group.
SLICE, SHARE = 300_000, 20_000


# -- words --------------------------------------------------------------------------------


def counted_words(doc_id: int | None, text: str, counts: Counter) -> None:
    """Adds the words of one document, with the changed runs, to *counts*."""
    runs = RUNS.findall(text.encode().lower().decode())  # bytes know A-Z only
    counts.update(runs)
    crc, start = zlib.crc32, zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    changed = [(w, h % len(w)) for w in set(runs) if not (h := crc(w.encode(), start)) % CHANGED]
    if changed:
        own = Counter(runs) if len(changed) > 8 else {w: runs.count(w) for w, _ in changed}
        for w, at in changed:
            n = own[w]
            counts[w[:at] + w[at + 1 :]] += n
            counts[w] -= n
            if not counts[w]:
                del counts[w]


def words(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the distinct words long and frequent enough."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def sent(counts: Counter) -> pa.RecordBatch:
        kept = [(w, n) for w, n in counts.items() if len(w) >= least_chars]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept) if kept else ([], []), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for part in slices(batch, 4_000_000):
                for doc_id, text in zip(*(c.to_pylist() for c in part.columns)):
                    counted_words(doc_id, text, counts)
                if len(counts) > HELD:
                    yield sent(counts)
        yield sent(counts)

    found = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


# -- the automaton --------------------------------------------------------------------------


class Node:
    __slots__ = ("final", "edges", "words")

    def __init__(self):
        self.final, self.edges, self.words = False, {}, 0


class Automaton:
    """The minimal acyclic automaton of words added in order, with their numbers.

    ``edges`` maps a character to (node, how many words come before that way).
    """

    def __init__(self):
        self.root, self.known, self.open, self.last = Node(), {}, [], ""
        self.open.append(self.root)

    def add(self, word: str) -> None:
        if word <= self.last and self.last:
            raise ValueError("words have to come in order, each once")
        same, last = 0, self.last
        for a, b in zip(word, last):
            if a != b:
                break
            same += 1
        self._close(same)
        node = self.open[-1]
        for c in word[same:]:
            child = Node()
            node.edges[c] = child
            self.open.append(child)
            node = child
        node.final, self.last = True, word

    def _close(self, depth: int) -> None:
        """Nodes below *depth* get no more edges: count them, and take the known node of the same shape."""
        while len(self.open) > depth + 1:
            node = self.open.pop()
            self._number(node)
            shape = (node.final, *((c, id(child)) for c, (child, _) in node.edges.items()))
            self.open[-1].edges[self.last[len(self.open) - 1]] = self.known.setdefault(shape, node)

    @staticmethod
    def _number(node: Node) -> None:
        n = int(node.final)
        for c, child in node.edges.items():
            node.edges[c] = (child, n)
            n += child.words
        node.words = n

    def done(self) -> Automaton:
        self._close(0)
        self._number(self.root)
        return self

    def after(self, half: str) -> tuple[Node | None, int]:
        """The node after *half*, and the number of the first word there."""
        node, number = self.root, 0
        for c in half:
            edge = node.edges.get(c)
            if edge is None:
                return None, 0
            node, before = edge
            number += before
        return node, number

    def number(self, word: str) -> int | None:
        node, number = self.after(word)
        return number if node is not None and node.final else None


def with_one_error(node: Node, number: int, rest: str) -> set[int]:
    """Numbers of the words below *node* that end in *rest* with one character inserted, deleted or replaced."""
    found = set()
    for i in range(len(rest) + 1):
        own, then = rest[i : i + 1], rest[i + 1 : i + 2]
        others = [(child, number + before) for x, (child, before) in node.edges.items() if x != own]
        ways = [(child, n, i) for child, n in others if not own or own in child.edges]  # inserted
        if own:
            ways += [(child, n, i + 1) for child, n in others if not then or then in child.edges]  # replaced
            if own != then and (not then or then in node.edges):  # deleted; of equal neighbours the last one
                ways.append((node, number, i + 1))
        for at, n, start in ways:
            for c in rest[start:]:
                edge = at.edges.get(c)
                if edge is None:
                    break
                at, before = edge
                n += before
            else:
                if at.final:
                    found.add(n)
        edge = node.edges.get(rest[i : i + 1])
        if edge is None:
            break
        node, before = edge
        number += before
    return found


# -- near words -----------------------------------------------------------------------------


def dealt(counted: DataFrame) -> DataFrame:
    """backward, half, text, n, asks: each word under each half by which a word of its length or one more or less asks.

    ``text`` is the word, reversed in the backward direction; it asks under the half of its own length.
    """
    length = F.length("word")
    rows = []
    for backward in (False, True):
        # the exact half of a word of length L: L // 2 code points forward, the other L - L // 2 backward
        exact = lambda n, b=backward: F.floor((n + (1 if b else 0)) / 2).cast("int")
        halves = F.array_distinct(F.array(exact(length - 1), exact(length), exact(length + 1)))
        text = F.reverse("word") if backward else F.col("word")
        each = counted.select(text.alias("text"), "n", F.explode(halves).alias("chars"), exact(length).alias("own"))
        rows.append(each.select(F.lit(backward).alias("backward"), F.substring("text", 1, F.col("chars")).alias("half"), "text", "n", (F.col("chars") == F.col("own")).alias("asks")))
    return rows[0].unionByName(rows[1])


def shared_out(rows: DataFrame, share: int = SHARE) -> DataFrame:
    """*rows* with share and lies: a word lies in one share of its group, and asks in all."""
    large = rows.groupBy("backward", "half").agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("shares")).filter("shares > 1")
    sized = rows.join(large, ["backward", "half"], "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    own = F.pmod(F.xxhash64("text"), F.col("shares").cast("long")).cast("int")
    every = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("shares") - 1)).otherwise(F.array(own))
    return sized.withColumn("share", F.explode(every)).withColumn("lies", F.col("share") == own).drop("shares")


def near_in_slices(rows: DataFrame, slice_chars: int = SLICE) -> DataFrame:
    """word, k, top, form: how many near words each question found, and the most frequent (ties: the first)."""
    schema = pa.schema([("word", pa.string()), ("k", pa.int64()), ("top", pa.int64()), ("form", pa.string())])

    def answered(groups: list[tuple[str, list, list]]) -> pa.RecordBatch:
        automaton, texts, counts, out = Automaton(), [], [], []
        for tag, (_, lying, _) in enumerate(groups):  # a character of its own keeps groups apart; words hold none above 0xFF
            mark = chr(0x100 + tag)
            for text, n in lying:
                automaton.add(mark + text)
                texts.append(text)
                counts.append(n)
        automaton.done()
        for tag, (key, _, asking) in enumerate(groups):
            backward, half = key[0], key[1]
            node, first = automaton.after(chr(0x100 + tag) + half)
            if node is None:
                continue
            for text in asking:
                found = with_one_error(node, first, text[len(half) :])
                if backward and found:  # with the first half unchanged, too, it is the forward one's
                    front = text[::-1][: len(text) // 2]
                    found = [i for i in found if not texts[i][::-1].startswith(front)]
                if found:
                    top = max(counts[i] for i in found)
                    form = min(texts[i][::-1] if backward else texts[i] for i in found if counts[i] == top)
                    out.append((text[::-1] if backward else text, len(found), top, form))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else ([],) * 4, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, now, held = [], None, 0
        for batch in batches:
            for *key, text, n, asks, lies in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now:
                    if held >= slice_chars or len(groups) >= 50_000:
                        yield answered(groups)
                        groups, held = [], 0
                    now = key
                    groups.append((key, [], []))
                if lies:
                    groups[-1][1].append((text, n))
                    held += len(text)
                if asks:
                    groups[-1][2].append(text)
        if groups:
            yield answered(groups)

    keys = ["backward", "half", "share"]
    ordered = rows.select(*keys, "text", "n", "asks", "lies").repartition(*keys).sortWithinPartitions(*keys, "text")
    return ordered.mapInArrow(run, "word string, k long, top long, form string")


def near_words(counted: DataFrame, share: int = SHARE, slice_chars: int = SLICE) -> DataFrame:
    """word, n_near, top, nearest: of every word with near words."""
    found = near_in_slices(shared_out(dealt(counted), share), slice_chars)
    best = F.min(F.struct((-F.col("top")).alias("minus"), "form"))
    return found.groupBy("word").agg(F.sum("k").alias("n_near"), best.alias("x")).select("word", "n_near", (-F.col("x.minus")).alias("top"), F.col("x.form").alias("nearest"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every word with a form (word, form): forms followed to the last, by doubling."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = now.join(further.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = materialize(step, "spelling-roots")
        discard(now)
        now = step.select("word", "root")
        if not step.filter("moved").limit(1).count():
            return now


def variants(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, ratio: int = RATIO, share: int = SHARE, slice_chars: int = SLICE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    counted = materialize(words(docs, least_chars, least_count), "spelling-words")
    near = near_words(counted, share, slice_chars)
    frequent = F.col("top") >= F.col("n") * ratio
    joined = counted.join(near.hint("merge"), "word", "left").select(
        "word", F.when(frequent, F.col("nearest")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("top")).alias("form_n")
    )
    joined = materialize(joined, "spelling-forms")
    last = roots(joined.filter("form is not null"))
    return joined.join(last.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def normalized(docs: DataFrame, found: DataFrame) -> DataFrame:
    """*docs* with the words of their texts that have a form replaced by their root; *found*: word, root.

    Runs are replaced as they stand lower-cased; others, and all between them, stay as they are.  The
    lookup is by a shuffle of the distinct words of each document, so the table of variants may be of any size.
    """
    row, texts = "tm_row", docs.withColumn("tm_row", F.monotonically_increasing_id())
    texts = materialize(texts, "spelling-texts")
    own = F.array_distinct(F.regexp_extract_all(text_or_empty(), F.lit("([A-Za-zÀ-ÿ]+)"), F.lit(1)))
    lower = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = texts.select(row, F.explode(own).alias("run")).withColumn("word", lower)
    changed = asked.join(found.filter("word <> root").select("word", "root").hint("merge"), "word")
    pairs = changed.groupBy(row).agg(F.collect_list("run").alias("tm_runs"), F.collect_list("root").alias("tm_roots"))  # bounded by a document
    both = texts.join(pairs.hint("merge"), row, "left")
    schema = pa.schema([(row, pa.int64()), ("text", pa.string())])

    def replaced(columns: list[list]) -> list[list]:
        out = []
        for text, runs, to in zip(*columns[1:]):
            swap = dict(zip(runs or (), to or ()))
            out.append(RUNS.sub(lambda m: swap.get(m[0], m[0]), text) if swap and text else text)
        return [columns[0], out]

    new = map_rows(both.filter("tm_runs is not null").select(row, "text", "tm_runs", "tm_roots"), replaced, schema, f"{row} long, text string")
    new = new.withColumnRenamed("text", "tm_text").withColumn("tm_new", F.lit(True))
    return texts.join(new.hint("merge"), row, "left").withColumn("text", F.when(F.col("tm_new"), F.col("tm_text")).otherwise(F.col("text"))).select(*docs.columns)


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: Near words share a spelling with one code point left out (at one place, for a replacement); the checksum goes bit by bit.
OP13_SQL = r"""
WITH RECURSIVE bits AS (SELECT i, i::UINTEGER AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, (CASE WHEN c % 2 = 1 THEN xor((c // 2)::UINTEGER, 3988292384::UINTEGER) ELSE (c // 2)::UINTEGER END)::UINTEGER, k + 1 FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS n FROM
    (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  GROUP BY doc_id, run),
bytes AS (SELECT doc_id, run, n, hex(encode(doc_id::VARCHAR || ':' || run)) AS h FROM runs),
summed AS (
  SELECT doc_id, run, n, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT),
    lambda a, b: xor(a // 256, crc.t[((xor(a, b) % 256) + 1)::INTEGER]::BIGINT), 4294967295::BIGINT), 4294967295) AS h FROM bytes, crc),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM
    (SELECT CASE WHEN h % 97 = 0 THEN run[:(h % len(run))::INTEGER] || run[(h % len(run))::INTEGER + 2:] ELSE run END AS word, n FROM summed)
  WHERE len(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS MATERIALIZED (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON w.word = c.rest
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON w.word = c.rest),
best AS (SELECT word, count(*) AS n_near, min({'minus': -n, 'other': other}) AS b FROM near GROUP BY word),
formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -b.minus >= 2 * w.n THEN b.other END AS form, CASE WHEN -b.minus >= 2 * w.n THEN -b.minus END AS form_n
  FROM words w LEFT JOIN best ON best.word = w.word),
chain AS (SELECT word, word AS root, form AS next FROM formed
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.next)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""
