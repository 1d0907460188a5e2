"""Quality rules: a table of thresholds compiled into one projection of built-in expressions.

A rule says when a document is rejected: ``left_factor * left`` over or under ``right_factor * right``,
in whole numbers, for documents of at least so many words.  The table compiles to Spark columns and,
for the tests, to SQL text, from the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Rejects where ``a * left <sign> b * right`` and n_words >= least_words."""

    name: str
    a: int
    left: str
    sign: str
    b: int
    right: str
    least_words: int = 0
    base: bool = False

    def sql(self) -> str:
        return f"({self.a} * {self.left} {self.sign} {self.b} * {self.right} AND n_words >= {self.least_words})"


RULES = (
    Rule("few_words", 1, "n_words", "<", 10, "1", base=True),
    Rule("repeated_windows", 100, "n_repeat_words", ">", 20, "n_words", base=True),
    Rule("symbols", 100, "n_symbols", ">", 10, "n_words"),
    Rule("shouting", 100, "n_marks", ">", 30, "n_words"),
    Rule("short_words", 10, "word_chars", "<", 24, "n_words", 20),
    Rule("long_words", 1, "word_chars", ">", 14, "n_words", 20),
    Rule("duplicate_lines", 100, "n_dup_lines", ">", 50, "n_lines"),
    Rule("few_distinct_words", 100, "n_distinct", "<", 25, "n_words"),
    Rule("no_stop_words", 1000, "n_stop", "<", 10, "n_words", 100),
)

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was were what with "
    "au aux avec ce dans de des du elle en est et il la le les leur mais ne ou par pas pour qui que se sur un une "
    "als auf aus bei das dem den der die ein eine es für im ist mit nicht sich sie und von zu "
    "al como con del el los las lo más no para por su y"
).split()

_SPACE = " \t\n\x0b\x0c\r"
_WINDOW = 5
#: Words of a stretch in which distinct words are counted: their share falls as a text grows, whatever the text is like.
DISTINCT_WORDS = 5000


def _distinct_windows(hashes: str) -> str:
    """Sorted places of the windows that occur twice or more, from an array of window hashes."""
    ordered = f"array_sort(transform({hashes}, (h, i) -> named_struct('h', h, 'i', i)))"
    return f"""transform(array(({ordered})), s -> array_sort(transform(filter(transform(s, (x, k) -> named_struct(
        'i', x.i, 'twin', x.h = get(s, k - 1).h OR x.h = get(s, k + 1).h)), x -> coalesce(x.twin, false)), x -> x.i)))[0]"""


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_marks, n_lines, n_dup_lines, n_repeat_words, n_distinct, n_stop.

    ``n_distinct`` is the sum over stretches of ``DISTINCT_WORDS`` words, the whole text in turn; a shorter text is one stretch.
    Names that ``docs`` has already are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(t, F.lit(_SPACE))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    one = docs.withColumns({
        "__words": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")),
        "__lines": lines,
        "word_chars": F.length(F.translate(t, _SPACE, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
        "n_marks": (F.length(t) - F.length(F.translate(t, "!", ""))).cast("long"),
    })
    stretches = f"sequence(0, (size(__words) - 1) div {DISTINCT_WORDS})"
    distinct = f"aggregate({stretches}, 0L, (n, k) -> n + size(array_distinct(slice(__words, cast(k AS int) * {DISTINCT_WORDS} + 1, {DISTINCT_WORDS}))))"
    two = one.withColumns({
        "n_words": F.size("__words").cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_distinct": F.expr(distinct),
        "n_stop": F.size(F.filter("__words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
        "__hashes": F.transform("__words", lambda w: F.xxhash64(w)),
    })
    gets = ", ".join(f"get(__hashes, i + {k})" for k in range(_WINDOW))
    three = two.withColumn("__windows", F.expr(f"CASE WHEN n_words < {_WINDOW} THEN cast(array() AS array<bigint>) ELSE transform(sequence(0, size(__hashes) - {_WINDOW}), i -> xxhash64({gets})) END"))
    four = three.withColumn("__twins", F.expr(f"CASE WHEN size(array_distinct(__windows)) = size(__windows) THEN cast(array() AS array<int>) ELSE {_distinct_windows('__windows')} END"))
    covered = F.expr(f"CASE WHEN size(__twins) = 0 THEN 0L ELSE aggregate(__twins, named_struct('n', 0L, 'end', 0), (a, p) -> named_struct('n', a.n + p + {_WINDOW} - greatest(a.end, p), 'end', p + {_WINDOW})).n END")
    return four.withColumn("n_repeat_words", covered).drop("__words", "__lines", "__hashes", "__windows", "__twins")


def _failed(rules: tuple[Rule, ...]) -> Column:
    out = F.lit(False)
    for rule in rules:
        out = out | F.expr(rule.sql())
    return out


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``measures`` with ``base_failed``, ``kept`` and the names of the ``broken`` rules, of every row.

    Null texts have no words, so they fail the base rules.  Repeated rows are judged alike; an empty table gives
    an empty result.  Windows are compared by 64-bit hashes of the words' 64-bit hashes, within one text.
    """
    broken = F.array_compact(F.array(*[F.when(F.expr(r.sql()), F.lit(r.name)) for r in rules]))
    out = measures(docs, text)
    return out.withColumns({"base_failed": _failed(tuple(r for r in rules if r.base)), "kept": ~_failed(rules), "broken": broken})


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their own columns only.

    The verdict goes through a generator: the optimizer would push a plain filter below the projections and
    put their expressions into one another, which multiplies them.
    """
    told = judge(docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("__row"), F.col("text").alias("__text")), rules, "__text")
    return told.select("__row", F.explode(F.array("kept")).alias("__stays")).filter("__stays").select("__row.*")
