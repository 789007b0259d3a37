"""Readability metrics of a text as native expressions: Markdown removal, sentences, counts and ratios.

Name intermediate results (plain, sentences, body) as columns of their own, as with_surface() does: Catalyst then
computes each once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .compat import WS, squeeze, trim, units

#: Sentence ends and closers, scripts, circumlocutions, and the rewriting table, in the order they apply.
SENTENCE = "[^。！？!?]*[。！？!?][」』）)]?|[^。！？!?]+"
KANJI, HIRAGANA, KATAKANA, LATIN = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3005}", r"\x{3040}-\x{309F}", r"\x{30A0}-\x{30FF}", "A-Za-z"
NOMINAL = "こと(?:が|を|は|に|も|で)|という|というもの|ものである|ものです|ことができ|を行(?:う|い|っ)|において|における|に関して|に対して"
REWRITES = (
    ("することができます", "できます"), ("することができる", "できる"), ("を行います", "します"), ("を行う", "する"), ("を実施し", "し"),
    ("ということ", "こと"), ("というもの", "もの"), ("において", "で"), ("における", "の"), ("に関して", "について"), ("ではないでしょうか", "でしょう"),
    ("(です|ます)が、", "$1。"), ("(る|た|い)が、", "$1。"), ("ており、", "ています。"), ("ものの、", "ました。ただし、"),
)
UNTOUCHED = "^" + WS + r"*(#|[-*]|\d+\.|```)"
LONG, VERY_LONG, MANY_COMMAS = 60, 100, 4

_STATE = "struct<fc:string,fl:int,blank:boolean,offsets:array<int>,skip:int,out:array<string>>"


#: Lines that are folded at once: what is kept is copied at each line of a block and at each block, not at each line.
LINES = 512
#: White space and quote marks up to the last mark of a line's beginning; a class, as Java's groups recurse at each repetition.
QUOTED = f"{WS[:-1]}>]*> ?"


def remove_code_blocks(text: Column) -> Column:
    """Without fenced and indented code, as one fold over the lines, block by block.

    The state has the open fence (character and length), whether the line before was blank, the columns at which the
    bodies of the enclosing list items begin, and from which indent on lines of an indented block are dropped (-1: none).
    """
    quote = "^" + QUOTED
    wide = lambda c: F.length(F.regexp_replace(c, "\t", "    "))

    def state(s: Column, **new: Column) -> Column:
        return F.struct(*[new.get(k, s[k]).alias(k) for k in ("fc", "fl", "blank", "offsets", "skip", "out")]).cast(_STATE)

    def step(s: Column, raw: Column) -> Column:
        line = F.regexp_replace(raw, quote, "")
        fence = F.regexp_extract(line, f"^{WS}*(`{{3,}}|~{{3,}})", 1)
        closing = F.regexp_extract(line, f"^{WS}*(`{{3,}}|~{{3,}}){WS}*$", 1)
        blank = trim(line) == ""
        indent = wide(F.regexp_extract(line, "^[ \t]*", 0))
        marker = line.rlike(r"^[ \t]*(?:[-*+]|\d+[.)])[ \t]+")
        before = F.regexp_extract(line, r"^([ \t]*)(?:[-*+]|\d+[.)])[ \t]+", 1)
        sign = F.regexp_extract(line, r"^[ \t]*([-*+]|\d+[.)])[ \t]+", 1)
        gap = wide(F.regexp_extract(line, r"^[ \t]*(?:[-*+]|\d+[.)])([ \t]+)", 1))
        # offsets only grow along the list, so what is deeper than the line is its tail
        offsets = F.filter(s["offsets"], lambda o: o <= indent)
        limit = F.coalesce(F.try_element_at(offsets, F.lit(-1)), F.lit(0)) + 4
        keep = lambda c: F.concat(s["out"], F.array(c))
        none, off = F.lit(""), F.lit(-1)
        in_block = (s["skip"] >= 0) & (blank | (indent >= s["skip"]))
        ends = (closing != "") & (F.left(closing, F.lit(1)) == s["fc"]) & (F.length(closing) >= s["fl"])
        return (
            F.when(in_block, s)
            .when((s["fc"] != "") & ends, state(s, fc=none, fl=F.lit(0), blank=F.lit(True), out=keep(F.lit(""))))
            .when(s["fc"] != "", s)
            .when(fence != "", state(s, fc=F.left(fence, F.lit(1)), fl=F.length(fence), skip=off))
            .when(blank, state(s, blank=F.lit(True), out=keep(raw), skip=off))
            .when(~marker & s["blank"] & (indent >= limit), state(s, offsets=offsets, skip=limit, blank=F.lit(True), out=keep(F.lit(""))))
            .when(marker, state(s, offsets=F.concat(offsets, F.array(wide(before) + F.length(sign) + F.when(gap > 4, F.lit(1)).otherwise(gap))), blank=F.lit(False), out=keep(raw), skip=off))
            .otherwise(state(s, offsets=offsets, blank=F.lit(False), out=keep(raw), skip=off))
        )

    start = F.struct(F.lit("").alias("fc"), F.lit(0).alias("fl"), F.lit(True).alias("blank"), F.array().cast("array<int>").alias("offsets"), F.lit(-1).alias("skip"), F.array().cast("array<string>").alias("out")).cast(_STATE)
    lines = F.split(text, "\n", -1)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / LINES).cast("int")), lambda k: F.slice(lines, k * LINES + 1, F.lit(LINES)))

    def block(s: Column, some: Column) -> Column:
        done = F.aggregate(some, state(s, out=F.array().cast("array<string>")), step)
        return F.transform(F.array(done), lambda d: state(d, out=F.when(F.size(d["out"]) == 0, s["out"]).otherwise(F.concat(s["out"], F.array(F.array_join(d["out"], "\n"))))))[0]

    folded = F.aggregate(blocks, start, block, lambda s: F.array_join(s["out"], "\n"))
    # most texts have neither a fence nor an indented line
    return F.when(text.rlike(f"```|~~~|(?m)^{WS[:-1]}>]*[ \t]"), folded).otherwise(text)


#: A table's rule: cells of dashes, on one line or, where a line ends without a bar, on several. Repetitions are possessive, as others recurse.
_BLANK = WS.replace(r"\n", "")
_DASHES = ":?+-++:?+"
_CELLS = f"(?:{_BLANK}*+\\|{_BLANK}*+{_DASHES})*+"
_NEXT_LINE = f"(?:(?:{_BLANK}*+\\n{WS}*+\\|{WS}*+|{_BLANK}*+\\|{_BLANK}*+\\n{WS}*+){_DASHES}{_CELLS}(?={WS}*\\|?{WS}*$))*+"
TABLE_RULE = f"(?m)^{WS}*\\|?{WS}*:?-+:?{_CELLS}{_NEXT_LINE}{WS}*\\|?{WS}*$"

#: What is stripped from code-free text, in order: (pattern, replacement). White space at a line's begin may span lines.
MARKDOWN = (
    (r"(?<!`)(`+)(?!`)([^\n]*?)(?<!`)\1(?!`)", "X"),
    (f"(?m)^{WS}{{0,3}}#{{1,6}}{WS}+", ""),
    (f"(?m)^{WS}{{0,3}}(=+|-+){WS}*$", ""),
    (f"(?m)^{WS}*[-*+]{WS}+", ""),
    (rf"(?m)^{WS}*\d+[.)]{WS}+", ""),
    (f"(?m)^{WS}*>{WS}?", ""),
    (TABLE_RULE, ""),
    (r"\|", " "),
    (r"\*\*([^*]+)\*\*", "$1"),
    (r"\[([^\]]+)\]\([^)]*\)", "$1"),
    (r"[ \t]+", " "),
)


def strip_inline(text: Column) -> Column:
    """Markdown marks off a text without code blocks."""
    return reduce(lambda c, rule: F.regexp_replace(c, *rule), MARKDOWN, text)


def strip_markdown(text: Column) -> Column:
    return strip_inline(remove_code_blocks(text))


def split_sentences(plain: Column) -> Column:
    """Sentences of plain text: a line ends one, and so does an end mark with the closer behind it."""
    lines = F.filter(F.transform(F.split(plain, "\n+", -1), trim), lambda x: x != "")
    parts = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(SENTENCE), F.lit(0))))
    return F.filter(F.transform(parts, trim), lambda x: x != "")


def split_paragraphs(plain: Column) -> Column:
    return F.filter(F.transform(F.split(plain, f"\n{WS}*\n", -1), trim), lambda x: x != "")


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def of_script(body: Column, script: str) -> Column:
    return F.length(F.regexp_replace(body, f"[^{script}]", ""))


def longest_run(body: Column, script: str) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(body, F.lit(f"[{script}]+"), F.lit(0)), F.length)), F.lit(0))


def setext_headings(text: Column) -> Column:
    """Lines of = or - below a line that is neither blank, a table row nor a list item."""
    lines = F.split(text, "\n", -1)
    under = lambda x: x.rlike(f"^{WS}{{0,3}}(=+|-+){WS}*$")
    above = lambda x: (trim(x) != "") & ~x.rlike(rf"^{WS}*\|") & ~x.rlike(rf"^{WS}*([-*+]|\d+[.)]){WS}")
    pairs = F.arrays_zip(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))).alias("a"), F.slice(lines, 2, F.size(lines)).alias("b"))
    return F.size(F.filter(pairs, lambda p: above(p["a"]) & under(p["b"])))


def headings(code_free: Column) -> Column:
    return count(code_free, f"(?m)^{WS}{{0,3}}#{{1,6}}{WS}+") + setext_headings(code_free)


def list_lines(code_free: Column) -> Column:
    return count(code_free, rf"(?m)^{WS}*([-*+]|\d+[.)]){WS}+")


def share(part: Column, whole: Column) -> Column:
    """part / whole with whole at least 1."""
    return part.cast("double") / F.greatest(whole, F.lit(1)).cast("double")


def with_surface(df: DataFrame, text: str = "text") -> DataFrame:
    """df with a column for each metric that needs no tokens."""
    df = df.withColumn("code_free", remove_code_blocks(F.coalesce(F.col(text), F.lit(""))))
    df = df.withColumn("plain", strip_inline(F.col("code_free")))
    df = df.withColumns({"body": squeeze(F.col("plain")), "sentence_list": split_sentences(F.col("plain"))})
    df = df.withColumn("lengths", F.transform("sentence_list", lambda s: units(squeeze(s)).cast("long"))).withColumn("commas", F.transform("sentence_list", lambda s: F.regexp_count(s, F.lit("、")).cast("long")))
    n, chars = F.size("sentence_list"), units(F.col("body"))
    over = lambda c, k: F.size(F.filter(c, lambda x: x > k))
    return df.withColumns(
        {
            "chars": chars.cast("long"),
            "sentences": n.cast("long"),
            "paragraphs": F.size(split_paragraphs(F.col("plain"))).cast("long"),
            "meanSentenceLength": share(total(F.col("lengths")), n),
            "maxSentenceLength": F.coalesce(F.array_max("lengths"), F.lit(0)).cast("long"),
            "longSentenceRatio": share(over("lengths", LONG), n),
            "veryLongSentenceRatio": share(over("lengths", VERY_LONG), n),
            "tenPerSentence": share(total(F.col("commas")), n),
            "manyTenRatio": share(over("commas", MANY_COMMAS - 1), n),
            **{f"{k}Ratio": share(of_script(F.col("body"), s), chars) for k, s in (("kanji", KANJI), ("hiragana", HIRAGANA), ("katakana", KATAKANA), ("latin", LATIN))},
            "maxKanjiRun": longest_run(F.col("body"), KANJI).cast("long"),
            "nominalizationPer1k": share(count(F.col("plain"), NOMINAL), chars) * 1000.0,
            "listLines": list_lines(F.col("code_free")).cast("long"),
            "headings": headings(F.col("code_free")).cast("long"),
        }
    ).drop("code_free", "body", "lengths", "commas")


SURFACE = ("chars", "sentences", "paragraphs", "meanSentenceLength", "maxSentenceLength", "longSentenceRatio", "veryLongSentenceRatio", "tenPerSentence", "manyTenRatio", "kanjiRatio", "hiraganaRatio", "katakanaRatio", "latinRatio", "maxKanjiRun", "nominalizationPer1k", "listLines", "headings")


def metric_map(df: DataFrame, keys: tuple[str, ...] = SURFACE) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[F.col(k).cast("double") for k in keys]))


def escape_delimiters(text: Column, tags: list[str]) -> Column:
    """<tag> and </tag > of the named tags, in any case, can no longer close a prompt's section."""
    return F.regexp_replace(text, rf"(?i)<(/?)({'|'.join(tags)})({WS}*)>", "&lt;$1$2$3&gt;")


def delimiter_tags(template: Column, default: list[str]) -> Column:
    """The default tags and those that a template closes."""
    return F.array_union(F.array(*[F.lit(t) for t in default]), F.regexp_extract_all(template, F.lit(r"</([A-Za-z_][A-Za-z0-9_-]*)\s*>"), F.lit(1)))


def tagged(text: Column, tag: str) -> Column:
    """What the first pair of tags encloses; null if there is none."""
    pattern = f"(?s)<{tag}>\n?(.*?)\n?</{tag}>"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def prompt_of(prefix: Column, prompt: Column, suffix: Column) -> Column:
    """The parts that are not empty, with a blank line between."""
    return F.concat_ws("\n\n", *[F.nullif(c, F.lit("")) for c in (prefix, prompt, suffix)])


def rewrite(text: Column) -> Column:
    """Deterministic plainer wording, line by line; headings, list items and fences stay."""
    plainer = lambda x: reduce(lambda c, rule: F.regexp_replace(c, *rule), REWRITES, x)
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.when(x.rlike(UNTOUCHED), x).otherwise(plainer(x))), "\n")


def heuristic(sentences: Column) -> Column:
    """0 to 100: short sentences with few commas score high. Sentence lengths have inner spaces here."""
    n = F.size(sentences)
    lengths = F.transform(sentences, lambda s: units(s).cast("long"))
    commas = total(F.transform(sentences, lambda s: F.regexp_count(s, F.lit("、")).cast("long")))
    score = F.lit(110.0) - share(total(lengths), n) - share(F.size(F.filter(lengths, lambda x: x > LONG)), n) * 25.0 - share(commas, n) * 8.0
    return F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))


def with_heuristic(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the heuristic of a text column; sentences are a column of their own, so that they are found once."""
    df = df.withColumn("_plain", strip_markdown(F.coalesce(F.col(text), F.lit("")))).withColumn("_sentences", split_sentences(F.col("_plain")))
    return df.withColumn(out, heuristic(F.col("_sentences"))).drop("_plain", "_sentences")
