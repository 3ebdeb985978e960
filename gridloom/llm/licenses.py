"""License scans with ordered signature rules, in DataFrame functions only.

Texts become lower-case words between single spaces. A gate of a few words, then each rule's keywords, decide which
regular expressions run on a text at all. A detection is an interval of characters with its rule's priority; it is
suppressed if an interval of higher priority, or of the same and longer (or first by rule), contains it. With a text's
detections in order of their start, longest first, every interval that can contain one comes before it, so one running
maximum of ends for each priority decides; that is linear in the detections of a text however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import license_rules

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values of the contract: what parts words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _spaces(column: Column) -> Column:
    return F.length(column) - F.length(F.replace(column, F.lit(" "), F.lit("")))


def lowered(text: Column) -> Column:
    """A-Z lowered. Other letters may be too: no rule has any. Only two of them become ASCII letters, and texts with these go letter by letter."""
    odd = F.contains(text, F.lit("\u0130")) | F.contains(text, F.lit("\u212a"))
    return F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def normalised(text: Column) -> Column:
    """Words between single spaces, one at either end; one space if there is no word."""
    words = F.trim(F.regexp_replace(lowered(F.coalesce(text, F.lit(""))), SEPARATORS, " "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _with_words(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    # Rows are dealt by ``spot``, which depends on their content alone: ``row`` tells apart those that are alike in it, and
    # may change when a task runs again, but then changes for all that the task gives of a text.
    rows = df.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("spot"), F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    return rows.withColumn("n_words", (_spaces(F.col("norm")) - 1).cast("long"))


def _with_base(rows: DataFrame, base: tuple[tuple[str, str], ...]) -> DataFrame:
    """Places of the base phrases: how many, the first and last word they start at, and their labels."""
    split = [F.when(F.contains("norm", F.lit(f" {p} ")), F.split("norm", f"(?<= )\\Q{p}\\E(?= )", -1)) for p, _ in base]
    rows = rows.withColumn("parts", F.array(*split))
    part = [F.col("parts")[i] for i in range(len(base))]
    first = [_spaces(p[0]) - 1 for p in part]
    last = [F.col("n_words") - len(phrase.split()) - (_spaces(F.element_at(p, -1)) - 1) for p, (phrase, _) in zip(part, base, strict=True)]
    labels = F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(p.isNotNull(), F.lit(label)) for p, (_, label) in zip(part, base, strict=True))))))
    return rows.withColumns({
        "n_base": sum((F.when(p.isNull(), 0).otherwise(F.size(p) - 1) for p in part), F.lit(0)).cast("long"),
        "first_word": F.array_min(F.array(*first)).cast("long"), "last_word": F.array_max(F.array(*last)).cast("long"), "base": labels,
    }).drop("parts")


def _matches(rows: DataFrame, rules: list[license_rules.Rule]) -> DataFrame:
    """One row for each match of each rule in each text that the keywords let through, with its segment, and one without a match for every text."""
    # A pattern that begins with a space fails sooner than one that looks behind; the space is taken off the match again.
    own = lambda pattern: " " + pattern.removeprefix("(?<= )")
    text = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    struct = lambda r: f"named_struct('number', {r.number}, 'priority', {r.priority}, 'label', {text(r.label)}, 'pattern', {text(own(r.pattern))}, 'confidence', {r.confidence!r}D)"
    gate = F.lit(False)
    for word in license_rules.gate(rules):
        gate = gate | F.contains("norm", F.lit(word))
    stand = F.expr(f"array({struct(license_rules.Rule(-1, 0, '', (), '(?!)', 0.0, ()))})")  # matches nothing; its row stands for the text
    alike: dict[tuple[str, ...], list[license_rules.Rule]] = {}
    for r in rules:
        alike.setdefault(r.keywords, []).append(r)
    # As text, which is parsed at once: thousands of columns made one by one take longer than a small scan.
    groups = F.expr(f"array({', '.join(f"named_struct('keywords', array({', '.join(map(text, words))}), 'rules', array({', '.join(map(struct, same))}))" for words, same in alike.items())})")
    held = F.flatten(F.transform(F.filter(groups, lambda g: F.exists(g["keywords"], lambda w: F.contains(F.col("norm"), w))), lambda g: g["rules"]))
    able = F.when(gate, F.concat(stand, held)).otherwise(stand) if rules else stand
    tried = rows.withColumn("rule", F.explode(able)).withColumn("found", F.regexp_extract_all("norm", F.col("rule.pattern"), F.lit(0)))
    tried = tried.filter((F.size("found") > 0) | (F.col("rule.number") < 0))
    between = F.transform(F.split("norm", F.col("rule.pattern"), -1), lambda x: F.length(x) + 1)
    spans = F.arrays_zip(F.slice(between, F.lit(1), F.size("found")).alias("gap"), F.transform("found", lambda x: F.length(x) - 1).alias("long"))
    return tried.select("spot", "row", "id", "n_words", "n_base", "first_word", "last_word", "base", "rule", F.posexplode_outer(F.when(F.size("found") > 0, spans)).alias("pos", "span"))


def detections(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[license_rules.Rule] | None = None) -> DataFrame:
    """Every detection with its interval in the normalised text and whether it is kept; every text also has a row with a null label.

    Columns: spot, row, id, n_words, n_base, first_word, last_word, base, label, priority, start, end, confidence, kept.
    """
    rules = license_rules.rules() if rules is None else rules
    made = _matches(_with_base(_with_words(df, id_col, text_col), license_rules.BASE), rules)
    spans = Window.partitionBy("spot", "row", "rule.number").orderBy("pos")
    ended = made.repartition("spot").withColumn("end", F.sum(F.col("span.gap") + F.col("span.long")).over(spans)).withColumn("start", F.col("end") - F.col("span.long"))
    order = Window.partitionBy("spot", "row").orderBy(F.col("start"), F.col("end").desc(), F.col("rule.priority").desc(), F.col("rule.number"), F.col("pos")).rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted({r.priority for r in rules} | {0})
    covered = ended.select("*", *(F.max(F.when(F.col("rule.priority") >= level, F.col("end"))).over(order).alias(f"to_{level}") for level in levels))
    reach = F.coalesce(*(F.when(F.col("rule.priority") == level, F.col(f"to_{level}")) for level in levels))
    kept = F.col("end").isNotNull() & F.coalesce(reach < F.col("end"), F.lit(True))
    out = covered.withColumn("kept", kept)
    real = F.col("end").isNotNull()
    return out.select("spot", "row", F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base", F.when(real, F.col("rule.label")).alias("label"), F.when(real, F.col("rule.priority")).alias("priority"), "start", "end", F.when(real, F.col("rule.confidence")).alias("confidence"), "kept")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[license_rules.Rule] | None = None) -> DataFrame:
    """One row for each input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null or empty text has no words, no places (first_word and last_word null), empty labels and score 0. ``labels``
    has the base labels and those of all detections that are kept, sorted and comma-joined; ``score`` is the highest
    confidence among kept detections, 0.9 for a base place. Null ids and repeated rows are each scanned on their own;
    an empty table gives an empty result; other columns are not read.
    """
    found = detections(df, id_col, text_col, rules)
    by_row = found.groupBy("spot", "row").agg(
        *(F.first(c).alias(c) for c in (id_col, "n_words", "n_base", "first_word", "last_word", "base")),
        F.collect_set(F.when(F.col("kept"), F.col("label"))).alias("more"), F.max(F.when(F.col("kept"), F.col("confidence"))).alias("best"),
    )
    return by_row.select(
        id_col, "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "more")), ",").alias("labels"), F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.9).otherwise(0.0)).alias("score"),
    )
