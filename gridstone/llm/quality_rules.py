"""Quality rules: decision lists that sequential covering learns from labelled statistics.

Statistics and verdicts are Spark SQL expressions; no Python runs on the executors. The
learner runs on the driver over at most MOST_LABELLED rows of statistics.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstone.llm.common import aside, mark_for, named, restored

#: Labelled rows that the learner gets at most: those of the smallest hashes of their ids.
MOST_LABELLED = 6_000

_SPACES = "\t\n\x0b\x0c\r"
_WHITE = r"[\x20\x09-\x0D]+"
_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules may test; each is a share or a mean, so that a rule means the same for texts of any length.
FEATURES = ("mean_word", "symbol_share", "bang_share", "digit_share", "upper_share", "stop_share", "dup_line_share", "repeat_share", "words_per_line", "distinct_share", "n_words")


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the statistics of its texts.

    n_words: runs of characters other than ASCII white space; word_chars: their code points;
    n_symbols: characters of ``[#*$%&|<>]``; n_dup_lines: lines with a word that equal an
    earlier line; n_repeat_words: words in runs of five that the text has twice or more
    (runs are compared by 64-bit hashes); further shares for the rules. A null text has no
    words, and all counts are 0. Columns of these names in df are replaced, any other kept,
    whatever its name.
    """
    mark = mark_for(df)
    w, lines, t, h, joined, five, repeats, ordered, at = (f"{mark}{x}" for x in ("w", "l", "t", "h", "joined", "five", "repeats", "sorted", "at"))
    bangs, digits, upper, n_lines, distinct, short = (f"{mark}{x}" for x in ("bangs", "digits", "upper", "lines", "distinct", "short"))
    d = df.drop(*_STATS, *FEATURES).withColumn(t, F.coalesce(named(text), F.lit("")))
    d = d.withColumn(w, F.array_remove(F.split(t, _WHITE), ""))
    d = d.withColumn(lines, F.filter(F.split(t, "\n"), lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]"))))
    d = d.withColumns({h: F.transform(w, lambda x: F.xxhash64(x)), joined: F.array_join(w, "")})
    d = d.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(joined).cast("long"),
            "n_symbols": F.size(F.regexp_extract_all(joined, F.lit(r"[#*$%&|<>]"), F.lit(0))).cast("long"),
            bangs: F.size(F.regexp_extract_all(joined, F.lit("[!?]"), F.lit(0))),
            digits: F.size(F.regexp_extract_all(joined, F.lit("[0-9]"), F.lit(0))),
            upper: F.size(F.regexp_extract_all(joined, F.lit("[A-Z]"), F.lit(0))),
            n_lines: F.size(lines),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            distinct: F.size(F.array_distinct(h)),
            short: F.size(F.filter(w, lambda x: F.octet_length(x) <= 3)),
        }
    )
    runs = f"case when size({h}) >= 5 then transform(slice({h}, 1, size({h}) - 4), (x, i) -> xxhash64(x, {h}[i + 1], {h}[i + 2], {h}[i + 3], {h}[i + 4])) else cast(array() as array<bigint>) end"
    d = d.withColumn(five, F.expr(runs))
    d = d.withColumn(repeats, F.expr(f"size(array_distinct({five})) < size({five})"))
    # Only for texts with a repeated run: runs beside an equal one when sorted by hash, back in the text's order.
    d = d.withColumn(ordered, F.expr(f"case when {repeats} then sort_array(transform({five}, (x, i) -> named_struct('h', x, 'i', i))) end"))
    twice = f"sort_array(transform(filter({ordered}, (x, k) -> (k > 0 and {ordered}[greatest(k - 1, 0)].h = x.h) or (k < size({ordered}) - 1 and {ordered}[least(k + 1, size({ordered}) - 1)].h = x.h)), x -> x.i))"
    d = d.withColumn(at, F.expr(f"case when {repeats} then {twice} end"))
    covered = f"aggregate(transform({at}, (p, k) -> case when k < size({at}) - 1 then least(5, {at}[least(k + 1, size({at}) - 1)] - p) else 5 end), 0L, (s, x) -> s + x)"
    d = d.withColumn("n_repeat_words", F.expr(f"case when {repeats} then {covered} else 0L end"))

    def share(part: str, of: str) -> Column:
        return F.when(F.col(of) > 0, F.col(part) / F.col(of)).otherwise(0.0).cast("double")

    d = d.withColumns(
        {
            "mean_word": share("word_chars", "n_words"),
            "symbol_share": share("n_symbols", "n_words"),
            "bang_share": share(bangs, "n_words"),
            "digit_share": share(digits, "word_chars"),
            "upper_share": share(upper, "word_chars"),
            "stop_share": share(short, "n_words"),
            "dup_line_share": share("n_dup_lines", n_lines),
            "repeat_share": share("n_repeat_words", "n_words"),
            "words_per_line": share("n_words", n_lines),
            "distinct_share": share(distinct, "n_words"),
        }
    )
    # Leaves through a generator: a filter on a statistic must not be pushed below, where it would compute them all once more.
    own = [F.col(c).alias(c) for c in dict.fromkeys(_STATS + FEATURES)]
    return d.select(*map(named, df.drop(*_STATS, *FEATURES).columns), F.inline(F.array(F.struct(*own))))


def base_failed() -> Column:
    return F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")


# ---------------------------------------------------------------- learner

Test = tuple[str, str, float]  # feature, "<=" or ">", threshold


@dataclass(frozen=True)
class Rule:
    """If all tests hold, the text is bad."""

    tests: tuple[Test, ...]
    bad: int = 0  # of the growing and pruning rows that it covers
    good: int = 0

    def __str__(self) -> str:
        return " and ".join(f"{f} {op} {t:g}" for f, op, t in self.tests) + f"  ({self.bad} bad, {self.good} good)"

    def column(self) -> Column:
        out = F.lit(True)
        for f, op, t in self.tests:
            out = out & (F.col(f) <= F.lit(t) if op == "<=" else F.col(f) > F.lit(t))
        return out


def _holds(row: dict, tests: tuple[Test, ...]) -> bool:
    return all(row[f] <= t if op == "<=" else row[f] > t for f, op, t in tests)


def _thresholds(rows: list[dict], feature: str, most: int = 48) -> list[float]:
    """Middles between neighbouring values, at about equal numbers of rows."""
    values = sorted({r[feature] for r in rows})
    step = max(1, (len(values) - 1) / most)
    picked = sorted({round(k * step) for k in range(most)} & set(range(len(values) - 1)))
    return [(values[k] + values[k + 1]) / 2 for k in picked]


def _grow(rows: list[tuple[dict, bool]], most_tests: int) -> tuple[Test, ...]:
    """Add the test with the largest FOIL gain until no good row is covered or nothing gains."""
    tests: tuple[Test, ...] = ()
    while len(tests) < most_tests:
        p0, n0 = sum(bad for _, bad in rows), sum(not bad for _, bad in rows)
        if not p0 or not n0:
            break
        before, best, gain = log(p0 / (p0 + n0)), None, 1e-9
        for f in FEATURES:
            ordered = sorted((r[f], bad) for r, bad in rows)
            cuts, k, p, n = _thresholds([r for r, _ in rows], f), 0, 0, 0
            for t in cuts:
                while k < len(ordered) and ordered[k][0] <= t:
                    p, n, k = p + ordered[k][1], n + (not ordered[k][1]), k + 1
                for op, a, b in (("<=", p, n), (">", p0 - p, n0 - n)):
                    if a and (g := a * (log(a / (a + b)) - before)) > gain:
                        best, gain = (f, op, t), g
        if best is None:
            break
        tests += (best,)
        rows = [(r, bad) for r, bad in rows if _holds(r, (best,))]
    return tests


def _prune(tests: tuple[Test, ...], rows: list[tuple[dict, bool]]) -> tuple[Test, ...]:
    """Drop last tests as long as (bad - good) / (bad + good) of the pruning rows doesn't fall."""

    def worth(tests: tuple[Test, ...]) -> float:
        p = sum(bad and _holds(r, tests) for r, bad in rows)
        n = sum(not bad and _holds(r, tests) for r, bad in rows)
        return (p - n) / (p + n) if p + n else -1.0

    best, value = tests, worth(tests)
    for k in range(len(tests) - 1, 0, -1):
        if (v := worth(tests[:k])) >= value:
            best, value = tests[:k], v
    return best


def learn(rows: list[tuple[dict, bool]], most_rules: int = 12, most_tests: int = 4, least_cover: int = 3, least_precision: float = 0.98) -> list[Rule]:
    """A decision list from rows (features, bad): each rule is grown on two thirds, pruned on a third, and covers rows that earlier ones leave.

    A rule enters the list if at least least_precision of what it covers is bad; the
    covering ends at the first that doesn't. The same rows in the same order give the same list.
    """
    left, rules = rows, []
    while len(rules) < most_rules and any(bad for _, bad in left):
        grow, prune = [x for k, x in enumerate(left) if k % 3], left[::3]
        tests = _prune(_grow(grow, most_tests), prune)
        if not tests:
            break
        bad = sum(b for r, b in left if _holds(r, tests))
        good = sum(not b for r, b in left if _holds(r, tests))
        if bad < least_cover or bad < least_precision * (bad + good):
            break
        rules.append(Rule(tests, bad, good))
        left = [(r, b) for r, b in left if not _holds(r, tests)]
    return rules


def rejected(rules: list[Rule]) -> Column:
    """The list as one conditional expression: the first rule that holds decides; none: not rejected."""
    out = F.lit(False)
    for rule in reversed(rules):
        out = F.when(rule.column(), F.lit(True)).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", most: int = MOST_LABELLED) -> list[Rule]:
    """Learn from the texts that labels (id, quality 0 or 1) cover.

    The driver gets the statistics of at most ``most`` labelled rows, those of the smallest
    hashes of their ids; rows with a null id, text or quality, and texts that the base rules
    reject, don't teach. An id counts once for each quality it is labelled with: of several
    rows of docs the one of the smallest statistics teaches, however many they are.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col(id_column).isNotNull()).select(id_column, "quality").distinct()
    picked = known.orderBy(F.xxhash64(F.col(id_column)), id_column, "quality").limit(most)
    rows = docs.where(F.col(text).isNotNull()).select(id_column, text).join(F.broadcast(picked), id_column)
    seen = with_statistics(rows, text).where(~base_failed()).select(id_column, "quality", *FEATURES)
    once = seen.groupBy(id_column, "quality").agg(F.min(F.struct(*FEATURES)).alias("row")).select(id_column, "quality", "row.*")
    found = sorted(tuple(r) for r in once.collect())
    return learn([(dict(zip(FEATURES, r[2:], strict=True)), r[1] == 0) for r in found])


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """docs with the statistics, base_failed and kept: not base_failed and not rejected by the rules.

    A null or empty text has no words, so base_failed. Repeated rows are judged alike.
    Empty table: no rows. Columns of docs named like a statistic are replaced.
    """
    d = with_statistics(docs.drop("base_failed", "kept"), text).withColumn("base_failed", base_failed())
    return d.withColumn("kept", ~F.col("base_failed") & ~rejected(rules))


def accepted(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows of docs that judge() keeps, with their own columns and values, whatever the names; see judge()."""
    rows, back = aside(docs, [n for n in (*_STATS, *FEATURES, "base_failed", "kept") if n != text])
    return restored(judge(rows, rules, text).where("kept"), docs.columns, back)
