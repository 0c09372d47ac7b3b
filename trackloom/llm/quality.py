"""Quality rules: learned decision lists over text statistics.

The statistics of each whole text are DataFrame expressions on its word and line
arrays, so a document needs no shuffle and no Python. A bounded sample of labelled
documents trains an ordered list of threshold conjunctions by sequential covering
(grow on two thirds by information gain, prune on the rest, drop what isn't
precise there, remove what is covered, repeat). The list is emitted as one
``CASE WHEN`` expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\f\r"
#: Labelled documents that the list is fitted on, at most (by hash order of doc_id).
LABELLED = 12_000
WINDOW = 8
FEATURES = ("n_words", "mean_chars", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "bang_share")


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(WHITE))
    return F.when(F.length(bare) > 0, F.split(bare, "[ \\t-\\r]+")).otherwise(F.array().cast("array<string>"))


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the statistics of ``text``: n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words (base), n_lines, n_distinct, n_upper, n_bang.

    A null or blank text has no words and zero everywhere. Windows of eight words
    are told apart by 64-bit hashes within one document.
    """
    d = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_t"))
    d = d.select(*keep, "_t", _words(F.col("_t")).alias("_w"), F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^ \\t-\\r]")).alias("_l"))
    hashes = F.transform(F.sequence(F.lit(1), F.size("_w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_w", i, F.lit(WINDOW))))
    d = d.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.aggregate("_w", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
        F.regexp_count("_t", F.lit("[A-ZÀ-ÖØ-Þ]")).cast("long").alias("n_upper"),
        (F.length("_t") - F.length(F.replace("_t", F.lit("!"), F.lit("")))).cast("long").alias("n_bang"),
        F.when(F.size("_w") >= WINDOW, hashes).alias("_h"),
    )
    own = [c for c in d.columns if c != "_h"]
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    pairs = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.select(*own, F.when(twice, pairs).alias("_p"))
    same = lambda k, x: F.get(F.col("_p"), k)["h"] == x["h"]
    at = F.filter("_p", lambda x, k: F.coalesce(same(k - 1, x), F.lit(False)) | F.coalesce(same(k + 1, x), F.lit(False)))
    d = d.select(*own, F.sort_array(F.transform(at, lambda x: x["i"])).alias("_i"))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"))
    return d.select(*own, F.coalesce(F.aggregate("_i", start, step)["n"], F.lit(0)).cast("long").alias("n_repeat_words"))


def features(stats: DataFrame) -> DataFrame:
    """Adds :data:`FEATURES` but ``n_words``, as doubles (0 where there are no words)."""

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b)).otherwise(F.lit(0.0))

    return stats.withColumns({
        "mean_chars": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"), "distinct_share": share("n_distinct", "n_words"), "upper_share": share("n_upper", "word_chars"), "bang_share": share("n_bang", "n_words"),
    })


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, row) -> bool:
        return row[self.feature] >= self.threshold if self.at_least else row[self.feature] < self.threshold

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= self.threshold if self.at_least else c < self.threshold


def fit(rows: list[dict], min_precision: float = 0.99, min_cover: int = 5, max_conditions: int = 4, max_rules: int = 12, cuts: int = 48) -> list[list[Condition]]:
    """Ordered conjunctions that find rows with ``bad`` set. ``rows`` hold the
    features, ``bad`` and ``fold`` (0, 1: grow; 2: prune)."""
    grow, prune, rules, tries = [r for r in rows if r["fold"] < 2], [r for r in rows if r["fold"] == 2], [], 0
    hits = lambda rule, some: [r for r in some if all(c.holds(r) for c in rule)]

    def precise(rule: list[Condition]) -> bool:
        test = hits(rule, prune)
        every = hits(rule, grow) + test
        bad = sum(r["bad"] for r in every)
        return bad >= min_cover and bad >= min_precision * len(every) and sum(r["bad"] for r in test) >= min_precision * len(test)

    while len(rules) < max_rules and tries < 2 * max_rules:
        tries += 1
        full = _grow(grow, max_conditions, cuts)
        if not full:
            break
        # prune: of its precise beginnings the one that is worth most on the held-out third, the shorter on ties
        kept = [full[:k] for k in range(1, len(full) + 1) if precise(full[:k])]
        if kept:
            rule = max(kept, key=lambda p: (sum(r["bad"] for r in hits(p, prune)), -len(p)))
            rules.append(rule)
            grow, prune = [r for r in grow if not all(c.holds(r) for c in rule)], [r for r in prune if not all(c.holds(r) for c in rule)]
        else:  # these can't be told apart this way: look for others
            grow = [r for r in grow if not (r["bad"] and all(c.holds(r) for c in full))]
    return rules


def _grow(rows: list[dict], most: int, cuts: int) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < most:
        p0 = sum(r["bad"] for r in rows)
        if p0 == 0 or p0 == len(rows):
            break
        base, best = math.log2(p0 / len(rows)), (1e-9, None)
        for f in FEATURES:
            values = sorted((r[f], r["bad"]) for r in rows)
            n, step = len(values), max(1, len(values) // cuts)
            below = 0
            for i in range(1, n):
                below += values[i - 1][1]
                if values[i][0] == values[i - 1][0] or (i % step and values[i][1] == values[i - 1][1]):
                    continue
                cut = (values[i][0] + values[i - 1][0]) / 2
                for at_least, p, t in ((True, p0 - below, n - i), (False, below, i)):
                    if p and (gain := p * (math.log2(p / t) - base)) > best[0]:
                        best = (gain, Condition(f, at_least, cut))
        if best[1] is None:
            break
        rule.append(best[1])
        rows = [r for r in rows if best[1].holds(r)]
    return rule


def learn(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> list[list[Condition]]:
    """Fit on at most ``bound`` labelled documents. Rows without doc_id or quality
    are left out; of contradicting labels the worse counts; no labels, no rules."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_q"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    some = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most ``bound`` narrow rows
    rows = features(statistics(some, ("doc_id", "_q"))).select(
        *FEATURES, (F.col("_q") == 0).cast("int").alias("bad"), F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)).alias("fold"), F.xxhash64("doc_id").alias("_o")
    )
    return fit([r.asDict() for r in rows.orderBy("_o").collect()])


def accepted(rules: list[list[Condition]]) -> Column:
    """The decision list as one conditional expression."""
    verdict = None
    for rule in rules:
        hit = rule[0].column()
        for c in rule[1:]:
            hit = hit & c.column()
        verdict = F.when(hit, False) if verdict is None else verdict.when(hit, False)
    return F.lit(True) if verdict is None else verdict.otherwise(True)


def judge(docs: DataFrame, rules: list[list[Condition]], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the base statistics, ``base_failed`` and ``kept``, per row of ``docs``.

    Null, empty and blank texts have no words and fail the base rules. Repeated rows
    and null ids stay; columns other than ``keep`` are ignored; an empty table gives
    no rows.
    """
    d = features(statistics(docs, keep))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    d = d.withColumn("base_failed", failed)
    # A filter on the verdict would be pushed below the statistics, where each use of
    # one repeats its whole expression (inside lambdas: per element). A row number,
    # not being deterministic, keeps filters above.
    kept = F.when(F.monotonically_increasing_id() >= 0, ~F.col("base_failed") & accepted(rules))
    return d.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def accepted_documents(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """The rows of ``docs`` (all columns, unchanged) that the base and the learned
    rules keep. Null and blank texts go; null ids and repeated rows stay; an empty
    table gives no rows."""
    rules = learn(docs, labels, bound)
    return judge(docs.select(F.struct("*").alias("_row"), "text"), rules, ("_row",)).where("kept").select("_row.*")
