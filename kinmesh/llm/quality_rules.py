"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Ratios of length, symbols, stop words and lines are columns over the words of a text; each row of
:data:`RULES` becomes one comparison. Nothing is shuffled and nothing leaves the JVM.

Defined cases: a null text has no words; an empty text too; both fail the base rule. A repeated row is
judged by itself. Extra columns of the input are kept unless they have the name of a result column, in
which case the result replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmesh.llm.common import SPACE_REGEX, SPACES

SYMBOLS = "#*$%&|<>"

#: Frequent function words of the languages served.
STOP_WORDS = tuple(
    """the of and to in is that it for was on with as be by this are or from at
    der die und das den von zu mit sich des auf für ist im dem nicht ein eine
    le la les de des et en un une du dans que pour qui est pas sur au avec
    el los las y un una por con para del se no su al es lo""".split()
)


@dataclass(frozen=True)
class Rule:
    """``numerator / denominator`` has to lie within ``[least, most]``; a zero denominator counts as 1."""

    name: str
    numerator: str
    denominator: str
    least: float | None = None
    most: float | None = None

    def column(self) -> Column:
        ratio = f"(cast({self.numerator} as double) / greatest({self.denominator}, 1))"
        parts = [f"{ratio} >= {self.least}D"] * (self.least is not None) + [f"{ratio} <= {self.most}D"] * (self.most is not None)
        return F.expr(" and ".join(parts))

    def sql(self) -> str:
        ratio = f"(cast({self.numerator} as double) / greatest({self.denominator}, 1))"
        return " and ".join([f"{ratio} >= {self.least}"] * (self.least is not None) + [f"{ratio} <= {self.most}"] * (self.most is not None))


#: The verdict beyond the base rule. Bounds in the spirit of published web-corpus filters.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 16.0),
    Rule("symbols_per_word", "n_symbols", "n_words", most=0.1),
    Rule("stop_words_per_word", "n_stop_words", "n_words", least=0.02),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=0.5),
)
BASE_WORDS = 50
BASE_REPEAT_PERCENT = 50

RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _once(*columns: Column) -> Column:
    """The columns as the output of a generator of one row: a filter above is not pushed below it, which would copy their expressions into each place, even into the functions over arrays."""
    return F.inline(F.array(F.struct(*columns)))


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts that the rules speak of: those of the base, n_lines (with a word) and n_stop_words."""
    keep = [c for c in docs.columns if c not in (*RESULTS, "n_lines", "n_stop_words")]
    own = [F.col(f"`{c}`") for c in keep]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    step = docs.select(
        *own,
        _once(
            F.filter(F.split(t, SPACE_REGEX), lambda w: w != "").alias("__words"),
            F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACES, "") != "").alias("__lines"),
        ),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    windows = F.when(
        F.size("__words") >= 3,
        F.transform(F.sequence(F.lit(0), F.size("__words") - 3), lambda i: F.xxhash64(F.col("__words")[i], F.col("__words")[i + 1], F.col("__words")[i + 2])),
    ).otherwise(F.array().cast("array<bigint>"))
    step = step.select(
        *own,
        "word_chars",
        "n_symbols",
        F.size("__words").cast("long").alias("n_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("__words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        windows.alias("__windows"),
    )
    # Equal windows become neighbours by sorting; texts without any are told apart first, by a hash set.
    step = step.select(
        "*",
        F.when(
            F.size(F.array_distinct("__windows")) < F.size("__windows"),
            F.sort_array(F.transform("__windows", lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
        )
        .otherwise(F.expr("cast(array() as array<struct<g:bigint,i:int>>)"))
        .alias("__sorted"),
    ).drop("__windows")
    covered = F.zip_with(
        "__sorted",
        F.when(F.size("__sorted") > 1, F.slice("__sorted", F.lit(2), F.greatest(F.size("__sorted"), F.lit(1)))).otherwise(F.col("__sorted")),
        lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], a["i"] + 1, a["i"] + 2, b["i"], b["i"] + 1, b["i"] + 2)).otherwise(F.array().cast("array<int>")),
    )
    repeated = F.size(F.array_distinct(F.flatten(covered))).cast("long").alias("n_repeat_words")
    return step.select(*own, _once(*map(F.col, ("n_words", "word_chars", "n_symbols", "n_dup_lines")), repeated, *map(F.col, ("n_lines", "n_stop_words"))))


def quality_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The input's rows with the counts, ``base_failed`` and ``kept`` (the base holds and so does every rule)."""
    failed = f"n_words < {BASE_WORDS} or 100 * n_repeat_words > {BASE_REPEAT_PERCENT} * n_words"
    verdict = ~F.expr(failed)
    for rule in rules:
        verdict = verdict & rule.column()
    return with_counts(docs, text).select("*", F.expr(failed).alias("base_failed"), verdict.alias("kept"))


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same in DuckDB, over whole tables."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    verdict = " and ".join(f"({r.sql()})" for r in rules)
    word = r"[^\x20\x09-\x0D]+"
    return f"""
    with t as (select doc_id, coalesce(text, '') as text, row_number() over () as r from documents),
    w as (select r, doc_id, text, regexp_extract_all(text, '{word}') as words,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) as lines from t),
    g as (select r, unnest(range(1, len(words) - 1)) as i, words from w where len(words) >= 3),
    h as (select r, i, count(*) over (partition by r, words[i], words[i + 1], words[i + 2]) as n from g),
    p as (select r, count(distinct i + k) as n from h, (values (0), (1), (2)) v(k) where h.n > 1 group by r),
    c as (select doc_id, cast(len(words) as bigint) as n_words,
                 cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as bigint) as word_chars,
                 cast(length(text) - length(translate(text, '{SYMBOLS}', '')) as bigint) as n_symbols,
                 cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
                 cast(coalesce(p.n, 0) as bigint) as n_repeat_words,
                 len(lines) as n_lines,
                 len(list_filter(words, lambda x: lower(x) in ({stop}))) as n_stop_words
          from w left join p using (r)),
    b as (select *, n_words < {BASE_WORDS} or 100 * n_repeat_words > {BASE_REPEAT_PERCENT} * n_words as base_failed from c)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           not base_failed and {verdict} as kept
    from b
    """


def op3_quality_rules(spark, sf_dir):
    """Counts and verdict for every whole text of ``documents``."""
    from kinmesh.llm.common import table

    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", *RESULTS)
