"""Quality rules whose limits come from mergeable quantile sketches per language and source."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.plans.skew import attach
from panelyard.plans.stage import stage

SPLIT = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
UNIT = 1000


@dataclass(frozen=True)
class Rule:
    """A measure (integer column) with its fences.

    The upper fence of a group is q3 + reach * max(q3 - q1, least), the lower one
    q1 - reach * max(q3 - q1, least); ``least`` is the spread below which
    differences do not matter. The quartiles are the group's own.
    """

    name: str
    least: int
    low: bool = False
    reach: int = 3


#: per mille of word characters and lines; hundredths of a character. Repetition has the base cutoff only
RULES = (Rule("symbol_permille", 20), Rule("dup_line_permille", 100), Rule("word_length", 50, low=True, reach=4))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of the whole text.

    Null and empty texts have zeros. A window of eight words counts as repeated
    when an equal window (64-bit hash of its words) starts elsewhere in the text;
    its words count once however many windows hold them.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn("__words", F.array_remove(F.split(body, SPLIT), ""))
    rows = rows.withColumn("__lines", F.filter(F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    rows = rows.withColumn("n_words", F.size("__words").cast("long"))
    windows = F.expr(f"CASE WHEN n_words < {WINDOW + 1} THEN array(0L) ELSE transform(sequence(1, CAST(n_words AS INT) - {WINDOW - 1}), "
                     f"i -> xxhash64(slice(__words, i, {WINDOW}))) END")
    symbols = sum((F.octet_length(body) - F.octet_length(F.replace(body, F.lit(c), F.lit(""))) for c in SYMBOLS), F.lit(0))
    rows = rows.withColumns({
        "word_chars": F.char_length(F.array_join("__words", "")).cast("long"),
        "n_symbols": symbols.cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__windows": windows,
    }).drop("__words", "__lines")
    rows = rows.withColumn("__again", F.size("__windows") - F.size(F.array_distinct("__windows")))
    # windows in order of (hash, place); a window is repeated if a neighbour in that order has its hash
    ordered = "array_sort(transform(__windows, (h, i) -> struct(h AS h, i AS i)))"
    places = (f"aggregate(array({ordered}), array(0), (none, s) -> array_sort(transform(filter(s, (x, k) -> "
              "(k > 0 AND s[k - 1].h = x.h) OR (k < size(s) - 1 AND s[k + 1].h = x.h)), x -> x.i)))")
    rows = rows.withColumn("__places", F.expr(f"CASE WHEN __again > 0 THEN {places} ELSE array() END"))
    # each repeated window adds the words up to the next one, at most its own eight
    covered = (f"aggregate(__places, struct(0L AS n, {-WINDOW} AS last), (a, p) -> struct("
               f"a.n + least({WINDOW}, p - a.last) AS n, p AS last), a -> a.n)")
    return rows.withColumn("n_repeat_words", F.expr(covered)).drop("__windows", "__again", "__places")


def rule_values(rows: DataFrame) -> DataFrame:
    """Add the integer value of each rule, and repeat_permille."""
    def permille(part: str, whole: str) -> Column:
        return F.expr(f"(1000 * {part}) div greatest({whole}, 1)")

    return rows.withColumns({
        "symbol_permille": permille("n_symbols", "word_chars"), "dup_line_permille": permille("n_dup_lines", "n_lines"),
        "repeat_permille": permille("n_repeat_words", "n_words"), "word_length": F.expr("(100 * word_chars) div greatest(n_words, 1)")})


def sketch(rows: DataFrame, group: list[str]) -> DataFrame:
    """Quantile sketch of every rule per group: counts of values rounded down to six significant bits.

    Counts add up, so sketches of parts merge by a sum, into languages and into
    the whole. A sketch holds at most 32 buckets per power of two.
    """
    names = [r.name for r in RULES]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("v")) for n in names]))
    bits = F.expr("greatest(length(bin(v)) - 6, 0)")
    flat = rows.select(*group, pairs.alias("p")).select(*group, "p.rule", "p.v").withColumn("shift", bits)
    flat = flat.withColumn("bucket", F.expr("shiftleft(shiftright(v, shift), shift)"))
    return flat.groupBy(*group, "rule", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, group: list[str]) -> DataFrame:
    return sketches.groupBy(*group, "rule", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, group: list[str]) -> DataFrame:
    """size, q1 and q3 (buckets that hold the rank ceil(f * size)) per group and rule."""
    key = [*group, "rule"]
    rows = sketches.withColumn("upto", F.sum("n").over(Window.partitionBy(*key).orderBy("bucket")))
    rows = rows.withColumn("size", F.sum("n").over(Window.partitionBy(*key)))
    first = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("size"), F.col("bucket")))
    return rows.groupBy(*key).agg(F.max("size").alias("size"), first(1).alias("q1"), first(3).alias("q3"))


def shrunk(sketches: DataFrame, group: list[str], toward: DataFrame, on: list[str], prior: int) -> DataFrame:
    """Sketches of groups to which ``prior`` documents are added, spread as in the sketch ``toward`` of a wider group.

    Counts come back in thousandths of a document, as integers. A wider sketch
    is one row per group and rule, at most 32 buckets per power of two in it.
    """
    key = [*on, "rule"]
    wider = toward.groupBy(*key).agg(F.sum("n").alias("__total"), F.collect_list(F.struct("bucket", "n")).alias("__wider"))
    added = attach(sketches.select(*group, "rule").distinct(), wider, key).withColumn("w", F.explode("__wider"))
    share = F.expr(f"CAST({prior * UNIT} AS DECIMAL(16, 0)) * CAST(w.n AS DECIMAL(20, 0)) div __total")
    added = added.select(*group, "rule", F.col("w.bucket").alias("bucket"), share.cast("long").alias("n"))
    own = sketches.select(*group, "rule", "bucket", (F.col("n") * UNIT).alias("n"))
    return merge(own.unionByName(added), group)


def limits(rows: DataFrame, lang: str, source: str, prior: int = 200) -> DataFrame:
    """One row per (lang, source) with the fences of each rule.

    Quartiles are those of the pair's sketch with ``prior`` documents spread as in
    its language, where the language's own sketch has as many spread as in the
    whole table: the more documents a pair has, the more its fences are its own.
    """
    own = stage(sketch(rows, [lang, source]), "sketches")
    per_lang = stage(merge(own, [lang]), "sketches")
    languages = stage(shrunk(per_lang, [lang], merge(per_lang, []), [], prior), "sketches")
    every = quartiles(shrunk(own, [lang, source], languages, [lang], prior), [lang, source])
    spread = {r.name: r.reach * F.greatest(F.col("q3") - F.col("q1"), F.lit(r.least)) for r in RULES}
    fences = []
    for r in RULES:
        here = F.col("rule") == r.name
        fences.append(F.max(F.when(here, F.col("q3") + spread[r.name])).alias(f"{r.name}_high"))
        if r.low:
            fences.append(F.max(F.when(here, F.col("q1") - spread[r.name])).alias(f"{r.name}_low"))
    return every.groupBy(lang, source).agg(*fences)


def judge(docs: DataFrame, prior: int = 200) -> DataFrame:
    """Measures, fences and verdict per document; columns doc_id, lang, source, text are read.

    ``base_failed``: under 20 words, or over 30 % of the words in repeated
    windows. ``kept``: not base_failed and inside every fence of its language and
    source (null language or source: a group of its own, named by the empty
    string). Quartiles are taken of documents that pass the base. A table in
    which none does has no fences, and nothing is kept there. Other columns are
    left out of the result, so their names cannot clash; repeated rows are
    judged alike; an empty table gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
                       F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "text")
    rows = rule_values(measures(rows).drop("text"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = stage(rows.withColumn("base_failed", failed), "measures")
    fences = limits(rows.where(~F.col("base_failed")), "lang", "source", prior)
    rows = attach(rows, fences, ["lang", "source"])
    inside = F.lit(True)
    for r in RULES:
        inside = inside & (F.col(r.name) <= F.col(f"{r.name}_high"))
        if r.low:
            inside = inside & (F.col(r.name) >= F.col(f"{r.name}_low"))
    return rows.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
