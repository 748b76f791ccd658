"""Validity of labels: allow and deny rules, of which the last that matches decides."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

META = set(".?+*()[]{}\\|$^")  # fixed values: a rule with one of these is a regular expression


@dataclass(frozen=True)
class Rule:
    allow: bool
    text: str

    @property
    def is_pattern(self) -> bool:
        return bool(META & set(self.text))


def parse_rules(lines: list[str]) -> list[Rule]:
    """Rules of a file: '+' allows, '-' denies, '#' and '%' start comments; anything else is an error."""
    rules = []
    for number, line in enumerate(lines, 1):
        line = line.rstrip("\r\n")
        if not line.strip() or line[0] in "#%":
            continue
        if line[0] not in "+-":
            raise ValueError(f"line {number} is neither a rule nor a comment: {line!r}")
        rules.append(Rule(line[0] == "+", line[1:]))
    return rules


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Rules of a text file at ``path``; a rule file is a short list."""
    text = spark.read.text(path, wholetext=True).first()
    return parse_rules(text["value"].split("\n") if text else [])


DEFAULT = [Rule(True, ".+")]


def matches(label: Column, rule: Rule) -> Column:
    return label.rlike(f"^(?:{rule.text})$") if rule.is_pattern else label == rule.text


def is_valid(label: Column, rules: list[Rule], otherwise: bool) -> Column:
    """Whether the last matching rule allows the label; ``otherwise`` where none matches."""
    if not rules:
        return F.lit(otherwise)
    decided = None
    for rule in reversed(rules):
        decided = F.when(matches(label, rule), F.lit(rule.allow)) if decided is None else decided.when(matches(label, rule), F.lit(rule.allow))
    return F.coalesce(decided.otherwise(F.lit(otherwise)), F.lit(False))


def valid_labels(labels: DataFrame, rules: list[Rule]) -> DataFrame:
    """(label, valid) of a dictionary; what no rule names is invalid."""
    return labels.select("label", is_valid(F.col("label"), rules, otherwise=False).alias("valid"))


def known_or_free(nodes: DataFrame, dictionary: DataFrame, rules: list[Rule]) -> DataFrame:
    """Nodes with a column ``valid``: dictionary labels need a rule that allows them, labels outside
    the dictionary one that denies them to be invalid."""
    seen = dictionary.select("label", F.lit(True).alias("seen"))
    known, free = is_valid(F.col("label"), rules, False), is_valid(F.col("label"), rules, True)
    return nodes.join(seen, "label", "left").select("query_id", "node", "label", "given", F.when(F.col("seen"), known).otherwise(free).alias("valid"))


def dictionary(*labels: DataFrame) -> DataFrame:
    """(label, id): distinct labels with dense ids from 0 in order of the label.

    Labels are sorted in ranges, which Spark cuts by a sample, so labels that begin alike don't share a
    task; ids come from the ranges' sizes.  The sorted labels are written before they are counted.
    """
    from functools import reduce

    from pyspark.sql import Window

    from graphloom.operators.lineage import cut

    every = reduce(DataFrame.unionByName, labels).where("label is not null").distinct()
    place = F.monotonically_increasing_id()  # the range above 33 bits of the place in it
    every = cut(every.repartitionByRange("label").sortWithinPartitions("label").select("label", place.alias("place")))
    every = every.select("label", F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND((1 << 33) - 1).alias("place"))
    sizes = every.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return every.join(before, "part").select("label", (F.col("before") + F.col("place")).alias("id"))


def literal(text: str) -> str:
    """``text`` as a pattern that matches it alone."""
    return re.escape(text)
