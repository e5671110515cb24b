"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfprice.llm.common import read_table

#: Words of a window whose repetition counts; base limits of words and of repeated words in percent.
WINDOW, FEWEST_WORDS, REPEATED_PERCENT = 5, 10, 20
WORD_BREAKS = r"[\x20\x09-\x0D]+"
#: Frequent words of English, French, German and Spanish prose, as they stand in a text: lower case, capitalised or upper case.
STOP_WORDS = (
    "the of and to in is that for it with as on be at by this are was or not from "
    "de la le les et des en un une du que qui est dans pour sur par "
    "der die und den das von mit zu im ist auf sich dem nicht ein eine "
    "el los las y del se con por su para al lo como una"
).split()


@dataclass(frozen=True)
class Rule:
    """part / whole has to lie between least and most thousandths; a bound of None holds always, and so does the rule where whole is 0."""

    name: str
    part: str
    whole: str
    least: int | None
    most: int | None


#: The threshold table: lengths, symbols, stop words and lines.
RULES = (
    Rule("words", "n_words", "one", 10_000, 100_000_000),
    Rule("word_length", "word_chars", "n_words", 2_000, 12_000),
    Rule("symbols", "n_symbols", "n_words", None, 100),
    Rule("stop_words", "n_stop_words", "n_words", 20, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 300),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 900),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 300),
    Rule("line_length", "n_words", "n_lines", 1_000, None),
)


def holds(rule: Rule) -> str:
    """The rule as an SQL condition over the measures, in whole numbers."""
    bounds = [f"{rule.least} * {rule.whole} <= 1000 * {rule.part}"] * (rule.least is not None)
    bounds += [f"1000 * {rule.part} <= {rule.most} * {rule.whole}"] * (rule.most is not None)
    return f"({' AND '.join(bounds) or 'true'})"


def verdict(rules: tuple[Rule, ...]) -> str:
    return " AND ".join(map(holds, rules)) or "true"


def stop_words() -> list[str]:
    return sorted({form for w in STOP_WORDS for form in (w, w.capitalize(), w.upper())})


def repeated_words(hashes: str) -> tuple[dict[str, Column], Column]:
    """Columns to add one after the other, and the number of words that repeated windows cover.

    hashes are those of the windows in the order of their places. Only texts that hold a window twice are sorted: equal hashes
    become neighbours, their places are put in order again, and each covers words up to the next place or its own end.
    """
    twice = F.size(hashes) > F.size(F.array_distinct(hashes))
    placed = F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), i.alias("place")))
    none = F.expr("cast(array() AS array<struct<hash: bigint, place: int>>)")

    def beside(x: Column, i: Column) -> Column:
        return F.coalesce(F.get("_sorted", i - 1)["hash"] == x["hash"], F.lit(False)) | F.coalesce(F.get("_sorted", i + 1)["hash"] == x["hash"], F.lit(False))

    steps = {"_sorted": F.when(twice, F.sort_array(placed)).otherwise(none), "_places": F.sort_array(F.transform(F.filter("_sorted", beside), lambda x: x["place"]))}
    reach = F.transform("_places", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_places", i + 1) - p, F.lit(WINDOW))).cast("long"))
    return steps, F.aggregate(reach, F.lit(0).cast("long"), lambda a, b: a + b)


def measured(rows: DataFrame) -> DataFrame:
    """rows (row, text) with the measures n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words,
    n_bullet_lines and n_ellipsis_lines, all long.

    Words are runs of other characters than ASCII white space; lines are cut at line feeds and count if they hold a word.
    Null texts measure as empty ones: all zero. Each row is measured for itself, so repeated rows have equal measures.
    Windows are compared by 64-bit hashes within one text. Nothing is grouped or shuffled.
    """
    whole = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(whole, WORD_BREAKS), "")
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    at = F.transform(
        F.slice("_words", F.lit(1), F.greatest(F.size("_words") - (WINDOW - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *(F.get("_words", i + k) for k in range(1, WINDOW))),
    )
    steps, repeated = repeated_words("_windows")
    out = rows.withColumns({"_text": whole, "_words": words, "_lines": lines}).withColumn("_windows", at)
    for name, column in steps.items():
        out = out.withColumn(name, column)
    start = r"^[\x20\x09-\x0D]*([-*\x{2022}]|[0-9]+[.)])[\x20\x09]"
    counts = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": repeated,
        "n_lines": F.size("_lines"),
        "n_stop_words": F.size(F.filter("_words", lambda w: w.isin(stop_words()))),
        "n_bullet_lines": F.size(F.filter("_lines", lambda x: x.rlike(start))),
        "n_ellipsis_lines": F.size(F.filter("_lines", lambda x: x.rlike(r"(\.\.\.|\x{2026})[\x20\x09-\x0D]*$"))),
    }
    measures = F.struct(*(v.cast("long").alias(k) for k, v in counts.items()))
    # Through a one-element explode, so that later filters aren't pushed into all the steps above.
    return out.select("row", F.explode_outer(F.array(measures)).alias("m")).select("row", "m.*")


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with its measures, base_failed, kept and failed_rules, the names of the rules that do not hold.

    base_failed: fewer than FEWEST_WORDS words, or more than REPEATED_PERCENT percent of them in repeated windows. kept: neither
    that nor a failed rule. Empty and null texts are not kept. An empty table gives an empty one. Columns of docs that have the
    name of a column made here are replaced, all others stay.
    """
    inner = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    base = F.expr(f"n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {REPEATED_PERCENT} * n_words")
    out = measured(inner).withColumns({"one": F.lit(1), "base_failed": base})
    failed = F.array_compact(F.array(*(F.when(~F.expr(holds(r)), F.lit(r.name)) for r in rules))) if rules else F.array().cast("array<string>")
    out = out.withColumns({"kept": ~F.col("base_failed") & F.expr(verdict(rules)), "failed_rules": failed})
    made = [c for c in out.columns if c not in ("row", "one")]
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in made), *made)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP12_SQL = f"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), cut AS (
  SELECT rid, doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM texts
), windows AS (
  SELECT rid, unnest(range(1, len(w) - {WINDOW - 2})) AS place, unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' '))) AS win
  FROM cut WHERE len(w) >= {WINDOW}
), repeated AS (
  SELECT rid, unnest(range(place, place + {WINDOW})) AS word
  FROM (SELECT rid, place, count(*) OVER (PARTITION BY rid, win) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT word) AS n_repeat_words FROM repeated GROUP BY rid
), measures AS (
  SELECT doc_id, 1 AS one, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
         len(list_filter(w, lambda x: list_contains([{', '.join(f"'{w}'" for w in stop_words())}], x))) AS n_stop_words,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*([-*\\x{{2022}}]|[0-9]+[.)])[\\x20\\x09]'))) AS n_bullet_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|\\x{{2026}})[\\x20\\x09-\\x0D]*$'))) AS n_ellipsis_lines
  FROM cut LEFT JOIN covered USING (rid)
), based AS (
  SELECT *, n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {REPEATED_PERCENT} * n_words AS base_failed FROM measures
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {verdict(RULES)} AS kept
FROM based
"""
