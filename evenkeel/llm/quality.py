"""Quality rules as weak supervision, in DataFrame expressions only.

Each rule looks at one signal of a document and votes good (+1), bad (-1) or
abstains (0). The accuracy of each rule (how it votes on good and on bad
documents) and the share of good documents are estimated by expectation-maximisation over the counts of vote patterns, which
is one small aggregate for each round: ``3 ** len(RULES)`` patterns at most, at
any size of the corpus. A document is kept when the posterior probability that
it is good reaches one half.

Cases: a null or empty text has no words, fails the base rule and is rejected
with all counts 0; a text of one long line or one long word is an ordinary
text; repeated rows get the same answer; an empty table gives an empty result.
Repeats of 5-word windows are found by 64-bit hashes inside one text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.text import row_hash, row_id, whole_row, words
from evenkeel.session import reuse, write_scratch

#: A word without a letter.
BARE = r"(?:^|(?<=[\x20\x09-\x0D]))[^\x20\x09-\x0D\p{L}]+(?=[\x20\x09-\x0D]|$)"
#: A word with a symbol.
MARKED = r"[^\x20\x09-\x0D#*$%&|<>]*[#*$%&|<>][^\x20\x09-\x0D]*"
#: Words in a window whose repeats are counted.
WINDOW = 5
MIN_WORDS = 10
#: Repeated words in percent of all words above which a text fails at once.
MAX_REPEATED = 20
ROUNDS = 30
#: Starting chance of a bad and a good vote, for good and for bad documents, and the prior: documents
#: that count as if seen with these chances, as a share of all and at least.
START = {"good": (0.03, 0.85), "bad": (0.35, 0.4)}
START_PRIOR = 0.85
PRIOR_SHARE, PRIOR_LEAST = 0.01, 10
#: Chances that move less than this have settled.
SETTLED = 1e-4

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SIGNALS = [*BASE, "n_lines", "n_ended", "n_upper", "n_bangs", "n_distinct", "n_bare", "n_marked"]


def signals(docs: DataFrame) -> DataFrame:
    """Add ``__q``, a struct of counts, to each row; all other columns stay."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("__w", words(F.col("text")))
    df = df.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    df = df.withColumn("__lines", F.filter(
        F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    h, n = F.col("__h"), F.size("__h")
    at = lambda i, k: F.get(h, (i + k).cast("int"))
    df = df.withColumn("__win", F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(0), n - WINDOW),
        lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))).otherwise(
            F.array().cast("array<bigint>")))
    win = F.col("__win")
    # only texts with a repeated window pay for the sort
    df = df.withColumn("__sorted", F.when(
        F.size(F.array_distinct(win)) < F.size(win),
        F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col("__sorted")
    same = lambda x, j: F.coalesce(
        F.get(s, F.when(j >= 0, j).otherwise(F.size(s)).cast("int"))["h"] == x["h"], F.lit(False))
    df = df.withColumn("__hit", F.sort_array(F.transform(
        F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])))
    hit = F.col("__hit")
    covered = F.aggregate(
        F.transform(hit, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(
            F.get(hit, (j + 1).cast("int")) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    lines = F.col("__lines")
    q = F.struct(
        n.cast("long").alias("n_words"),
        F.coalesce(F.length(F.array_join("__w", "")), F.lit(0)).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.filter(lines, lambda x: x.rlike(r"[\p{Po}\p{Pf}][\x20\x09-\x0D]*$")))
        .cast("long").alias("n_ended"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(text, F.lit("!")).cast("long").alias("n_bangs"),
        F.size(F.array_distinct(h)).cast("long").alias("n_distinct"),
        F.regexp_count(text, F.lit(BARE)).cast("long").alias("n_bare"),
        F.regexp_count(text, F.lit(MARKED)).cast("long").alias("n_marked"))
    # a generator keeps the planner from copying the counts into every rule that reads them
    return df.withColumn("__q", F.explode(F.array(q))).drop("__w", "__h", "__lines", "__win", "__sorted", "__hit")


def base_failed(q) -> Column:
    return (q("n_words") < MIN_WORDS) | (
        100 * q("n_repeat_words") > MAX_REPEATED * q("n_words"))


def _vote(value: Column, good: Column, bad: Column) -> Column:
    """+1, -1 or 0; null signals (no words) abstain."""
    return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0)


def _low(value: Column, good: float, bad: float) -> Column:
    return _vote(value, value <= good, value >= bad)


def votes(q) -> dict[str, Column]:
    """One vote for each rule; ``q(name)`` gives a signal."""
    share = lambda a, b: q(a) / F.nullif(q(b), F.lit(0))
    length = share("word_chars", "n_words")
    ended = share("n_ended", "n_lines")
    return {
        "symbols": _low(share("n_symbols", "n_words"), 0.02, 0.1),
        "marked": _low(share("n_marked", "n_words"), 0.05, 0.25),
        "letters": _low(share("n_bare", "n_words"), 0.1, 0.2),
        "capitals": _low(share("n_upper", "word_chars"), 0.2, 0.5),
        "bangs": _low(share("n_bangs", "n_words"), 0.02, 0.1),
        "repeats": _low(share("n_repeat_words", "n_words"), 0.02, 0.1),
        "word_length": _vote(length, (length >= 3) & (length <= 10), (length < 2.5) | (length > 12)),
        "sentences": _vote(ended, ended >= 0.8, ended <= 0.5),
        "variety": -_low(share("n_distinct", "n_words"), 0.1, 0.3),
        "size": _vote(q("n_words"), q("n_words") >= 40, q("n_words") < 25),
    }


RULES = ["symbols", "marked", "letters", "capitals", "bangs", "repeats", "word_length", "sentences",
         "variety", "size"]


Model = tuple[float, list[dict[str, tuple[float, float]]]]


def _score(vote: Column, chance: dict[str, tuple[float, float]]) -> Column:
    """What a vote adds to the log-odds that the document is good."""
    (gb, gg), (bb, bg) = chance["good"], chance["bad"]
    return (F.when(vote < 0, math.log(gb / bb)).when(vote > 0, math.log(gg / bg))
            .otherwise(math.log((1 - gb - gg) / (1 - bb - bg))))


def posterior(vote: list[Column], model: Model) -> Column:
    """Probability that a document is good, given its votes."""
    prior, chances = model
    score = F.lit(math.log(prior / (1 - prior)))
    for v, c in zip(vote, chances, strict=True):
        score = score + _score(v, c)
    return 1 / (1 + F.exp(-score))


def _chances(bad: float, good: float, total: float, start: tuple[float, float], weight: float) -> tuple[float, float]:
    """Shares of bad and good votes among some documents and ``weight`` more that vote like the start."""
    return tuple((n + weight * s) / (total + weight) for n, s in zip((bad, good), start, strict=True))


def _named(model: Model) -> Model:
    """The class that gets the bad votes is the bad one: summed over rules, they speak against it."""
    prior, chances = model
    against = sum(math.log(c["bad"][0] / c["good"][0]) for c in chances)
    return model if against >= 0 else (1 - prior, [{"good": c["bad"], "bad": c["good"]} for c in chances])


def fit_rules(voted: DataFrame, rounds: int = ROUNDS) -> Model:
    """Share of good documents, and how each rule votes on good and on bad ones.

    ``voted`` has one vote column for each rule. Expectation: the posterior of
    each vote pattern. Maximisation: weighted vote counts, one aggregate a round.
    Every chance is learned; a weak prior keeps it off 0 and 1, and which class
    is the good one is told by the sum of what bad votes weigh.
    """
    patterns = reuse(voted.groupBy(*RULES).agg(F.count(F.lit(1)).alias("n")))
    model: Model = (START_PRIOR, [START] * len(RULES))
    for _ in range(rounds):
        good = F.col("n") * F.col("p")
        sums = [F.sum("n"), F.sum(good)]
        for r in RULES:
            for sign in (-1, 1):
                hit = F.col(r) == sign
                sums += [F.sum(F.when(hit, good).otherwise(0.0)), F.sum(F.when(hit, F.col("n")).otherwise(0))]
        row = patterns.withColumn("p", posterior([F.col(r) for r in RULES], model)).agg(
            *[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
        x = [v or 0 for v in row]
        total, good_n = x[0], x[1]
        weight = max(PRIOR_LEAST, PRIOR_SHARE * total)
        chances = []
        for i in range(len(RULES)):
            bad_good, bad_all, good_good, good_all = x[2 + 4 * i: 6 + 4 * i]
            chances.append({
                "good": _chances(bad_good, good_good, good_n, START["good"], weight),
                "bad": _chances(bad_all - bad_good, good_all - good_good, total - good_n, START["bad"], weight)})
        before, model = model, ((good_n + weight * START_PRIOR) / (total + weight), chances)
        if _moved(before, model) < SETTLED:
            break
    patterns.unpersist()
    return _named(model)


def _moved(a: Model, b: Model) -> float:
    """The largest change of a chance."""
    return max([abs(a[0] - b[0]), *(abs(p - q) for c, d in zip(a[1], b[1], strict=True)
                                    for k in c for p, q in zip(c[k], d[k], strict=True))])


def _judge(df: DataFrame, q, model: Model) -> dict[str, Column]:
    chance = posterior(list(votes(q).values()), model)
    failed = base_failed(q)
    return {"base_failed": failed, "kept": ~failed & (chance >= 0.5),
            "quality": F.when(failed, 0.0).otherwise(chance)}


def rate(docs: DataFrame) -> DataFrame:
    """``doc_id``, the signals, ``base_failed``, ``kept`` and ``quality`` of each row."""
    table = write_scratch(
        signals(docs.select("doc_id", "text")).select("doc_id", "__q.*"), "quality")
    model = fit_rules(table.filter(~base_failed(F.col)).select(
        *[v.alias(k) for k, v in votes(F.col).items()]))
    return table.withColumns(_judge(table, F.col, model))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows whose verdict is good, with all columns as they came.

    Texts are read once for the counts, which are written, and once for the rows that stay.
    """
    named = docs.select("text", row_id().alias("id"), row_hash().alias("h"))
    table = write_scratch(signals(named).select("id", "h", "__q.*"), "quality")
    model = fit_rules(table.filter(~base_failed(F.col)).select(
        *[v.alias(k) for k, v in votes(F.col).items()]))
    good = table.filter(_judge(table, F.col, model)["kept"]).select("id", "h")
    # the row travels as one column, so that no name of its columns can clash
    df = docs.select(whole_row(docs), row_id().alias("id"), row_hash().alias("h"))
    return df.join(good, ["id", "h"], "left_semi").select("row.*")
