"""Licence scans by ordered signature rules, with DataFrame functions only.

A text becomes lower-case words with single spaces. A few gate words and then each rule's keyword decide which regexes
run at all; a hit is an interval of words. Hits inside an interval of a rule that is at least as good are suppressed;
what is left names the labels. Base phrases are counted wherever they stand and always keep their labels.

The score is the confidence of the best hit that is left (1 for an identifier or a licence's own sentence, 0.9 for a
licensing clause, 0.7 for a bare name; a base phrase has 0.9), 0 without any.

Defined results: null and empty texts have no words, null first and last word and empty labels; a label that two rules
give counts once; rows that repeat are documents of their own; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower
from .license_rules import BASE, CONFIDENCE, GATES, Rule, rules

NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normalised(text: Column) -> Column:
    """Lower-case words, each between single spaces; one space if there are none."""
    inner = F.btrim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), NOT_ALNUM, " "))
    return F.when(inner == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), inner, F.lit(" ")))


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _rule_table(all_rules: list[Rule]) -> Column:
    """The rules as one array literal, in SQL, which Catalyst folds to a constant."""
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    row = lambda k, r: (
        f"named_struct('rule', {k}, 'label', {quoted(r.label)}, 'keyword', {quoted(r.keyword)}, "
        f"'regex', {quoted(f'(?<= )(?:{r.regex})(?= )')}, 'priority', {r.priority})"
    )
    return F.expr(f"array({', '.join(row(k, r) for k, r in enumerate(all_rules))})")


def _hits(norm: Column, table: Column) -> Column:
    """(rule, label, priority, order, words before since the rule's last hit, words) of every hit."""

    def of(rule: Column) -> Column:
        found = F.regexp_extract_all(norm, rule["regex"], F.lit(0))
        gaps = F.split(norm, rule["regex"], -1)
        return F.transform(
            found,
            lambda m, i: F.struct(
                rule["rule"].alias("rule"), rule["label"].alias("label"), rule["priority"].alias("priority"),
                i.alias("nth"), _spaces(F.get(gaps, i)).alias("gap"), _spaces(m).alias("inner"),
            ),
        )

    return F.flatten(F.transform(F.filter(table, lambda r: F.contains(norm, r["keyword"])), of))


def detect(docs: DataFrame, extra_rules: list[Rule] | None = None) -> DataFrame:
    """One row a hit (and one with nulls for a document without any): rid, doc_id, n_words, label, priority, start, end
    (words, from 0, end exclusive) and kept."""
    every = [Rule(*b) for b in BASE] + (rules() if extra_rules is None else extra_rules)
    norm = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), normalised(F.col("text")).alias("norm"))
    gate = F.lit(False)
    for word in GATES:
        gate = gate | F.contains("norm", F.lit(word))
    hits = F.when(gate, _hits(F.col("norm"), _rule_table(every)))
    n_words = F.when(F.col("norm") == " ", F.lit(0)).otherwise(_spaces(F.col("norm")) - 1).cast("long")
    rows = norm.select("rid", "doc_id", n_words.alias("n_words"), F.explode_outer(hits).alias("h")).repartition("rid")
    by_rule = Window.partitionBy("rid", "h.rule").orderBy("h.nth").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("h.gap") + F.col("h.inner")).over(by_rule), F.lit(0)) + F.col("h.gap") - 1
    placed = rows.select(
        "rid", "doc_id", "n_words", "h.rule", "h.label", "h.priority",
        before.cast("long").alias("start"), (before + F.col("h.inner") + 1).cast("long").alias("end"),
    )
    order = Window.partitionBy("rid").orderBy("start", F.desc("end"), "priority", "rule").rowsBetween(Window.unboundedPreceding, -1)
    worst = max(r.priority for r in every)
    kept = F.col("priority") == 0
    for level in range(1, worst + 1):
        cover = F.coalesce(F.max(F.when(F.col("priority").between(1, level), F.col("end"))).over(order), F.lit(-1))
        kept = kept | ((F.col("priority") == level) & (cover < F.col("end")))
    return placed.withColumn("kept", kept)


def license_report(docs: DataFrame) -> DataFrame:
    base = F.col("priority") == 0
    confidence = F.element_at(F.array(*[F.lit(c) for c in CONFIDENCE]), F.col("priority") + 1)
    listed = lambda condition: F.array_join(F.array_sort(F.collect_set(F.when(condition, F.col("label")))), ",")
    return (
        detect(docs)
        .groupBy("rid")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("start"))).alias("first_word"),
            F.max(F.when(base, F.col("start"))).alias("last_word"),
            listed(base).alias("base_labels"),
            listed(F.col("kept")).alias("labels"),
            F.coalesce(F.max(F.when(F.col("kept"), confidence)), F.lit(0.0)).alias("score"),
        )
        .drop("rid")
    )
