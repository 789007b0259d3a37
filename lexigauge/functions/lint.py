"""Lint of texts: a registry of rules, each an expression that gives messages, and fixes for some.

The rules here are made of the writing guidance that the evaluation is about: short sentences, few commas, short runs of
kanji, no circumlocution, no double negative. Packs name the rules that are on; a step of an intervention names a pack.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .compat import squeeze, units
from .text import KANJI, REWRITES, UNTOUCHED, VERY_LONG, split_sentences, strip_markdown

MESSAGE = "struct<ruleId:string,message:string,line:int,column:int,fixable:boolean>"
FIXES = REWRITES[:11]
DOUBLE_NEGATIVE = "なくはない|ないわけではない|ないことはない|なくもない"


Hits = Callable[[Column, Column], Column]


def _messages(lines: Column, rule: str, text: str, hits: Hits, fixable: bool = False) -> Column:
    """A message for each hit of each line."""
    made = lambda x, i: F.transform(hits(x["line"], x["sentences"]), lambda _: F.struct(F.lit(rule).alias("ruleId"), F.lit(text).alias("message"), (i + 1).cast("int").alias("line"), F.lit(1).alias("column"), F.lit(fixable).alias("fixable")).cast(MESSAGE))
    return F.flatten(F.transform(lines, made))


def _found(pattern: str) -> Hits:
    return lambda line, _: F.regexp_extract_all(line, F.lit(pattern), F.lit(0))


def _sentences(bad: Callable[[Column], Column]) -> Hits:
    return lambda _, sentences: F.filter(sentences, bad)


def split_lines(plain: Column) -> Column:
    """Lines with their sentences."""
    return F.transform(F.split(plain, "\n", -1), lambda x: F.struct(x.alias("line"), split_sentences(x).alias("sentences")))


#: rule -> (message, hits of a line and its sentences, whether fix() mends it)
RULES: dict[str, tuple[str, Hits, bool]] = {
    "sentence-length": ("a sentence of more than 100 characters", _sentences(lambda s: units(squeeze(s)) > VERY_LONG), False),
    "max-ten": ("more than three commas in a sentence", _sentences(lambda s: F.regexp_count(s, F.lit("、")) > 3), False),
    "max-kanji-run": ("five kanji or more in a row", _found(f"[{KANJI}]{{5,}}"), False),
    "no-redundant-expression": ("a circumlocution", _found("|".join(p for p, _ in FIXES)), True),
    "no-double-negative": ("a double negative", _found(DOUBLE_NEGATIVE), False),
}
PACKS: dict[str, tuple[str, ...]] = {"default": tuple(RULES), "fixable": ("no-redundant-expression",)}


def register(rule: str, message: str, hits: Hits, fixable: bool = False, pack: str = "default") -> None:
    """Adds a rule to a pack."""
    RULES[rule] = (message, hits, fixable)
    PACKS[pack] = (*PACKS.get(pack, ()), rule)


def pack_of(path: str) -> str:
    """The pack that a JSON configuration file, {"rules": {rule: true or false}}, switches on; it is registered under its content."""
    names = json.loads(Path(path).read_text("utf-8")).get("rules", {})
    on = tuple(r for r, v in names.items() if v is not False)
    for r in on:
        if r not in RULES:
            raise ValueError(f"{path}: no rule {r!r}; there are: {', '.join(RULES)}")
    name = "rules:" + ",".join(on)
    PACKS[name] = on
    return name


def packages_of(config: str) -> list[str]:
    """The packages that a lint configuration in JSON names by its rules and filters, by the linter's naming rules, with the linter itself; of broken JSON only that."""
    try:
        found = json.loads(config)
    except ValueError:
        found = {}

    def full(name: str, prefix: str) -> str:
        scope, _, rest = name.rpartition("/")
        return (f"{scope}/" if scope else "") + (rest if rest.startswith(prefix) else prefix + rest)

    kinds = (("rules", "textlint-rule-"), ("filters", "textlint-filter-rule-"))
    return sorted({"textlint", *(full(name, prefix) for key, prefix in kinds for name, on in (found.get(key) or {}).items() if on is not False)})


def rules_version(pack: str = "default") -> str:
    """What a pack's results depend on: its rules with their messages and expressions."""
    sample = split_lines(F.col("text"))
    rules = [(r, RULES[r][0], str(_messages(sample, r, *RULES[r]))) for r in PACKS[pack]]
    numbered = re.compile(r"(namedlambdavariable\(\)|\b[a-z]+_\d+)")
    return hashlib.sha256(json.dumps([(r, m, numbered.sub("x", e)) for r, m, e in rules], ensure_ascii=False).encode()).hexdigest()


def lint(text: Column, pack: str = "default") -> Column:
    """All messages of a text, code left out, by rule and line."""
    return of_lines(split_lines(strip_markdown(text)), pack)


def of_lines(lines: Column, pack: str) -> Column:
    parts = [_messages(lines, r, *RULES[r]) for r in PACKS[pack]]
    return F.concat(*parts) if parts else F.array().cast(f"array<{MESSAGE}>")


def rule_counts(messages: Column) -> Column:
    """Messages as a map from rule to number, of rules with any."""
    rules = F.array_distinct(F.transform(messages, lambda m: m["ruleId"]))
    return F.map_from_arrays(rules, F.transform(rules, lambda r: F.size(F.filter(messages, lambda m: m["ruleId"] == r)).cast("long")))


def density(messages: Column, text: Column) -> Column:
    """Messages for each 1,000 characters of the text without marks, white space and code."""
    return F.size(messages) / F.greatest(units(squeeze(strip_markdown(text))), F.lit(1)).cast("double") * 1000.0


def fixable(messages: Column) -> Column:
    return F.size(F.filter(messages, lambda m: m["fixable"]))


def fix(text: Column, pack: str = "default") -> Column:
    """struct(text, applied, remaining): with the fixable rules mended, how many messages that took, how many are left."""
    fixes = FIXES if any(RULES[r][2] for r in PACKS[pack]) else ()
    mended = F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.when(x.rlike(UNTOUCHED), x).otherwise(reduce(lambda c, rule: F.regexp_replace(c, *rule), fixes, x))), "\n")
    before, after = F.size(lint(text, pack)), F.size(lint(mended, pack))
    return F.struct(mended.alias("text"), F.greatest(before - after, F.lit(0)).cast("int").alias("applied"), after.cast("int").alias("remaining"))


def with_lint(df: DataFrame, text: str, out: str, pack: str = "default") -> DataFrame:
    """df with the messages of a text column; lines and messages are columns of their own, so that they are found once."""
    df = df.withColumn("_plain", strip_markdown(F.coalesce(F.col(text), F.lit("")))).withColumn("_lines", split_lines(F.col("_plain")))
    return df.withColumn(out, of_lines(F.col("_lines"), pack)).drop("_plain", "_lines")
