"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule is a predicate over a document that holds for documents to reject. A bounded sample gives the share of rows each
rule rejects, alone and after others, and the time each rule takes beyond the splitting into words that all share; the cascade orders
the rules greedily by rejection per cost, and a nested CASE evaluates a later rule only on what the earlier ones let pass. The
order never changes the verdict, only the work. ``keep_good`` has every rule in the cascade, the base rule's two parts as well, and
computes nothing for a rule that is not reached; ``apply_rules`` reports the base statistics of every row, so there they are
computed first and the cascade orders the rest.

Defined cases: null text is empty and has no words; a document without words fails the base rule; very long texts are read whole,
in n log n; ties and repeated rows give a result row each; an empty table gives no rows. Other columns are ignored by ``quality_stats``
but for those named in ``keep``, of which one called like a result gets ``_given`` behind its name; ``keep_good`` keeps all, whatever
their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborweft.llm.common import SPACE, materialise, words_of

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _covered(starts: Column) -> Column:
    """How many words the 3-word windows at these ascending starts cover."""
    return F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )


def _repeat_words(words: Column, n: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. Windows are compared by 64-bit hash inside one text: sort
    the hashes, take those with an equal neighbour, and look positions up in that short list; where it is long, sort
    (hash, position) pairs instead, so the work stays n log n."""

    def positions(h: Column) -> Column:
        def few(dups: Column) -> Column:
            return F.filter(
                F.transform(h, lambda x, i: F.when(F.array_contains(dups, x), i)), lambda p: p.isNotNull()
            )

        def many() -> Column:
            pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
            return _let(
                pairs,
                lambda s: F.sort_array(
                    F.transform(
                        F.filter(
                            s,
                            lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"]))
                            | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)),
                        ),
                        lambda x: x["i"],
                    )
                ),
            )

        dups = _let(
            F.sort_array(h),
            lambda s: F.array_distinct(F.filter(s, lambda x, k: (k > 0) & (F.get(s, k - 1) == x))),
        )
        return _let(dups, lambda d: F.when(F.size(d) <= 48, _covered(few(d))).otherwise(_covered(many())))

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    found = _let(words, lambda w: _let(hashes(w), positions))
    return F.when(n < 3, F.lit(0).cast("long")).otherwise(found)


class Doc:
    """What rules may ask of a text: each attribute is an expression, computed where a rule is reached."""

    def __init__(self, text: Column, words: Column) -> None:
        self.text, self.words = text, words

    @property
    def n_words(self) -> Column:
        return F.when(self.words[0] == "", 0).otherwise(F.size(self.words)).cast("long")

    @property
    def word_chars(self) -> Column:
        return F.length(F.array_join(self.words, "")).cast("long")

    @property
    def n_symbols(self) -> Column:
        return F.regexp_count(self.text, F.lit(r"[#*$%&|<>]")).cast("long")

    @property
    def n_bars(self) -> Column:
        """Bars that stand alone, as between the cells of a table."""
        return F.size(F.filter(self.words, lambda x: x == "|")).cast("long")

    @property
    def n_capitals(self) -> Column:
        return F.regexp_count(self.text, F.lit("[A-Z]")).cast("long")

    def lines(self, body: Callable[[Column], Column]) -> Column:
        """body(lines that have a word), which are split once for it."""
        return _let(F.filter(F.split(self.text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != ""), body)

    @property
    def n_dup_lines(self) -> Column:
        return self.lines(lambda own: (F.size(own) - F.size(F.array_distinct(own))).cast("long"))

    @property
    def n_repeat_words(self) -> Column:
        return _repeat_words(self.words, self.n_words)


class Known(Doc):
    """The same of rows whose base statistics are columns."""

    def __init__(self) -> None:
        super().__init__(F.col("_text"), F.col("_words"))

    n_words = property(lambda self: F.col("n_words"))
    word_chars = property(lambda self: F.col("word_chars"))
    n_symbols = property(lambda self: F.col("n_symbols"))
    n_dup_lines = property(lambda self: F.col("n_dup_lines"))
    n_repeat_words = property(lambda self: F.col("n_repeat_words"))


@dataclass(frozen=True)
class Rule:
    """reject(doc): where it is true, the document goes."""

    name: str
    reject: Callable[[Doc], Column]


def base_rules() -> list[Rule]:
    """The fixed base rule in its two parts: too short, or most words in repeated windows."""
    return [Rule("few_words", lambda d: d.n_words < 50), Rule("repeats", lambda d: d.n_repeat_words * 100 > d.n_words * 50)]


def default_rules() -> list[Rule]:
    """Rules that junk fails and prose of any language passes, in lines or in the cells of a table; all read whole texts.

    Bars that stand alone are layout: neither symbols nor words. Symbols and lengths are judged without them only where they fail with them,
    as leaving bars out never makes a text fail."""
    of_lines = lambda pattern, times, most: lambda d: d.lines(lambda own: F.size(F.filter(own, lambda x: x.rlike(pattern))) * times > F.size(own) * most)
    return [
        Rule("symbols", lambda d: (d.n_symbols * 10 > d.n_words) & (d.n_symbols * 10 - d.n_bars * 9 > d.n_words)),
        Rule("word_length", lambda d: _let(d.word_chars, lambda c: ((c < d.n_words * 2) & (c + d.n_bars < d.n_words * 2)) | (c > d.n_words * 15))),
        Rule("dup_lines", lambda d: d.lines(lambda own: (F.size(own) - F.size(F.array_distinct(own))) * 2 > F.size(own))),
        Rule("shouting", lambda d: d.n_capitals * 2 > d.word_chars),
        Rule("ellipsis", of_lines(r"(\.\.\.|…)\s*$", 10, 3)),
        Rule("bullets", of_lines(r"^\s*[-•*]", 10, 9)),
        Rule("letters", lambda d: F.size(F.filter(d.words, lambda x: x.rlike(r"\p{L}"))) * 10 < (d.n_words - d.n_bars) * 7),
    ]


def _whole(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def quality_stats(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns named in keep (doc_id unless given), the text, its words as an array and the statistics of every whole text."""
    t = _whole(text)
    named = [F.col(f"`{c}`").alias(f"{c}_given" if c in (*STATS, "base_failed", "failed_rule", "kept") else c) for c in keep or ["doc_id"]]
    step = docs.select(*named, t.alias("_text"), words_of(t).alias("_words"))
    doc = Doc(F.col("_text"), F.col("_words"))
    step = step.withColumn("n_words", doc.n_words)
    return step.select("*", *(getattr(doc, c).alias(c) for c in STATS[1:4]), _repeat_words(F.col("_words"), F.col("n_words")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def _judged(text: Column, rules: list[Rule], found: Callable[[Doc], Column]) -> Column:
    """found(doc) for a text whose words are split once."""
    return _let(words_of(text), lambda words: found(Doc(text, words)))


def measure(sample: DataFrame, rules: list[Rule], rounds: int = 2) -> dict[str, float]:
    """Seconds that each rule takes over a sample (text) beyond splitting it into words, the best of some rounds."""

    def took(of: Callable[[Doc], Column]) -> float:
        best = float("inf")
        for _ in range(rounds):
            run = sample.agg(F.count_if(_judged(_whole("text"), rules, of)))
            run._jdf.queryExecution().executedPlan()  # planned before the clock starts
            began = time.perf_counter()
            run.collect()
            best = min(best, time.perf_counter() - began)
        return best

    shared = took(lambda d: d.n_words < 0)
    return {r.name: max(1e-4, shared / 20, took(r.reject) - shared) for r in rules}  # smaller differences are noise


def order_rules(rules: list[Rule], failed: dict[int, int], cost: dict[str, float]) -> list[Rule]:
    """The rules by rejection per cost among what earlier rules let pass. failed: rows by the set of rules they fail, as bits."""
    left, order = dict(failed), []
    rest = list(range(len(rules)))
    while rest:
        alive = max(1, sum(left.values()))
        gain = {i: (sum(c for m, c in left.items() if m >> i & 1) + 0.5) / (alive + 1) / cost[rules[i].name] for i in rest}
        best = min(rest, key=lambda i: (-gain[i], i))
        rest.remove(best)
        order.append(rules[best])
        left = {m: c for m, c in left.items() if not m >> best & 1}
    return order


def cascade_order(docs: DataFrame, rules: list[Rule], sample_rows: int = 2000, seed: int = 17, before: list[Rule] | None = None) -> list[Rule]:
    """The rules in the order of the cascade, from a sample of about so many rows of docs (text) that the rules of ``before`` pass.

    What comes to the driver is one row for each set of rules that fail together, at most 2 ** len(rules)."""
    if not rules:
        return []
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = materialise(docs.select("text").sample(fraction=share, seed=seed).coalesce(1), "sample")

    def mask(d: Doc) -> Column:
        own = sum((F.when(r.reject(d), 1 << i).otherwise(0) for i, r in enumerate(rules)), F.lit(0))
        for r in before or ():
            own = F.when(r.reject(d), -1).otherwise(own)
        return own

    counts = sample.groupBy(_judged(_whole("text"), rules, mask).alias("mask")).count().where("mask >= 0").collect()
    return order_rules(rules, {r["mask"]: r["count"] for r in counts}, measure(sample, rules))


def keep_good(docs: DataFrame, rules: list[Rule] | None = None, **options) -> DataFrame:
    """The documents that no rule rejects, base rules included, all columns as they were, whatever their names."""
    rules = base_rules() + (default_rules() if rules is None else rules)
    order = cascade_order(docs, rules, **options)

    def passes(d: Doc) -> Column:
        out = F.lit(True)
        for r in reversed(order):
            out = F.when(r.reject(d), False).otherwise(out)
        return out

    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_document"))
    good = packed.where(_judged(_whole(F.col("_document")["text"]), order, passes))
    return good.select("_document.*")


def apply_rules(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 2000, keep: list[str] | None = None, seed: int = 17) -> DataFrame:
    """``keep`` columns, the statistics, base_failed, failed_rule (null if none) and kept for every document."""
    rules = default_rules() if rules is None else rules
    order = cascade_order(docs, rules, sample_rows, seed, before=base_rules())
    stats = quality_stats(docs, keep=keep)
    failed = F.when(F.col("base_failed"), "base")
    for r in order:
        failed = failed.when(r.reject(Known()), r.name)
    out = stats.withColumn("base_failed", base_failed()).withColumn("failed_rule", failed)
    return out.withColumn("kept", F.col("failed_rule").isNull()).drop("_text", "_words")
