"""Benchmark decontamination by template windows, in DataFrame functions only.

Texts are put in a canonical form: numbers, names (capitalised words inside a
sentence) and units behind a number become typed placeholders that keep their value,
other words are lower case. A window is ``WINDOW`` successive words with placeholders
blind to their values. First, every document's windows are held against the windows
of all items. Of the documents found, the windows are joined to the windows of the
items' templates. An alignment is a shift between document and template; so are
all neighbouring shifts together (no more than ``DRIFT`` apart) where words were put in
or taken out, and there the windows broken by such an edit of at most DRIFT words
of the item count as held; placeholders at the edit are not tested. A document is contaminated by an item if it holds at least ``SHARE``
of the item's windows in one alignment, and the slots are consistent there: every value of
the item stands for one value in the document. Equal values at one shift are a verbatim
copy, all else is a re-parameterised question.

Windows with fewer than ``LITERALS`` words that are no placeholders are not used; an item
without a usable window (fewer than WINDOW words) cannot be found. Items with equal canonical words are
one item, reported under the smallest id. Items of one template are tested one by one: a document gets every item
that it holds verbatim, or else the one item of the template with fewest changed values (the smallest id of several).
Null or short texts match nothing.
Repeated rows of one doc_id and text are one document; null doc_id is found like any other. Other columns
are not read.

Windows of items are joined as Spark sees fit: it broadcasts them only while their size in
bytes is under its threshold, and shuffles both sides beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.llm.common import durable

WINDOW, DRIFT, LITERALS, SHARE = 8, 3, 5, 0.5
NUMBER, NAME, UNIT = "", "", ""
UNITS = "mm|cm|m|km|inch|inches|feet|foot|yard|yards|mile|miles|g|kg|mg|lb|lbs|pound|pounds|ounce|ounces|ml|l|litre|litres|liter|liters|second|seconds|minute|minutes|hour|hours|day|days|week|weeks|month|months|year|years|percent|dollar|dollars|cent|cents|euro|euros|degree|degrees|mph|kmh"


def _marked(text: Column) -> Column:
    """Text with a mark before each placeholder's value."""
    plain = F.translate(F.coalesce(text, F.lit("")), NUMBER + NAME + UNIT, "   ")
    named = F.regexp_replace(plain, r"(?<=[\p{L}\p{N},;:)] )(\p{Lu}[\p{L}\p{N}]*+)", NAME + "$1")
    counted = F.regexp_replace(named, rf"(?<![\p{{L}}\p{{N}}{NAME}.,])(\d++(?:[.,]\d++)*+)", f" {NUMBER}$1 ")
    counted = F.regexp_replace(counted, rf"(?i)({NUMBER}[\d.,]++ {{1,2}})({UNITS})(?![\p{{L}}\p{{N}}])", f"$1{UNIT}$2")
    # Texts without digits have no numbers and no units.
    return F.when(text.rlike(r"[0-9]"), counted).otherwise(named)


def words(text: Column) -> Column:
    """Canonical words; a placeholder is its mark and its value."""
    return F.filter(F.split(F.lower(_marked(text)), rf"(?:[^\p{{L}}\p{{N}}{NUMBER}{NAME}{UNIT}.,]|[.,](?!\d)|(?<!\d)[.,])+"), lambda w: w != "")


def blind(found: Column) -> Column:
    """Canonical words without the values of placeholders."""
    return F.transform(found, lambda w: F.when(w.substr(1, 1).isin(NUMBER, NAME, UNIT), w.substr(1, 1)).otherwise(w))


def placeholder(word: Column) -> Column:
    return word.substr(1, 1).isin(NUMBER, NAME, UNIT)


def codes(found: Column) -> Column:
    """A hash of each word, so that windows need not hash words again."""
    return F.transform(found, lambda w: F.xxhash64(w))


def windows(name: str) -> Column:
    """Hashes of the windows at every place of a column of ``codes``.

    It is a column, not an expression, since the function below is evaluated for every window.
    """
    canonical = F.col(name)
    last = F.size(canonical) - WINDOW
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.slice(canonical, i + 1, WINDOW)))).otherwise(F.array().cast("array<bigint>"))


def distinct_items(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, words, template, blind_words): each distinct list of canonical words under its smallest id; template is a hash."""
    items = benchmark.select(F.col(item_id).alias("item"), words(F.col(text)).alias("words")).groupBy("words").agg(F.min("item").alias("item"))
    return items.withColumn("blind_words", blind(F.col("words"))).withColumn("template", F.xxhash64("blind_words"))


def template_windows(items: DataFrame) -> DataFrame:
    """(h, template, r, q, n_item_windows): usable windows of each template, numbered by r, at place q."""
    one = items.select("template", "blind_words").dropDuplicates(["template"]).withColumn("codes", codes(F.col("blind_words")))
    placed = one.select("template", "blind_words", windows("codes").alias("hashes"))
    literals = lambda i: F.size(F.filter(F.slice("blind_words", i + 1, WINDOW), lambda w: ~w.isin(NUMBER, NAME, UNIT)))
    usable = placed.select("template", F.filter(F.transform("hashes", lambda h, i: F.struct(i.alias("q"), h.alias("h"), literals(i).alias("literals"))), lambda w: w.literals >= LITERALS).alias("usable"))
    return usable.select("template", F.size("usable").alias("n_item_windows"), F.posexplode("usable").alias("r", "w")).select("w.h", "template", "r", "w.q", "n_item_windows")


def _runs(shifts: DataFrame, key: list[str]) -> DataFrame:
    """Alignments of several neighbouring shifts; of a window found at two of them, that at the shift with more windows counts."""
    order = Window.partitionBy(*key).orderBy("shift")
    apart = shifts.withColumn("apart", (F.col("shift") - F.lag("shift").over(order) > DRIFT).cast("int"))
    run = apart.withColumn("run", F.sum(F.coalesce("apart", F.lit(0))).over(order))
    each = run.select(*key, "run", "n_item_windows", "shift", F.transform("found", lambda m: F.struct(m.q.alias("q"), (-F.col("n_windows")).alias("order"), F.col("shift").alias("shift"), m.r.alias("r"), m.slots.alias("slots"))).alias("found"))
    all_of = each.groupBy(*key, "run").agg(F.first("n_item_windows").alias("n_item_windows"), F.count(F.lit(1)).alias("n_shifts"), F.array_sort(F.flatten(F.collect_list("found"))).alias("all")).where("n_shifts > 1")
    once = all_of.withColumn("found", F.filter("all", lambda m, i: (i == 0) | (m.q != F.get("all", i - 1).q)))
    # Windows between two found ones at different shifts, with few words of the item between those.
    broken = F.transform("found", lambda m, i: F.when((i > 0) & (m.shift != F.get("found", i - 1).shift) & (m.q - F.get("found", i - 1).q <= WINDOW + DRIFT), m.r - F.get("found", i - 1).r - 1).otherwise(0))
    held = F.size("found") + F.aggregate(broken, F.lit(0), lambda total, n: total + F.coalesce(n, F.lit(0)))
    # Placeholders at an edit have no certain counterpart and are not tested.
    ends = F.transform("found", lambda m, i: F.when((i > 0) & (m.shift != F.get("found", i - 1).shift), F.struct(F.least(m.q, F.get("found", i - 1).q + WINDOW - 1).alias("low"), F.greatest(m.q, F.get("found", i - 1).q + WINDOW - 1).alias("high"))))
    counted = once.select(*key, "n_item_windows", held.cast("long").alias("n_windows"), "n_shifts", F.array_distinct(F.flatten("found.slots")).alias("slots"), F.filter(ends, lambda e: e.isNotNull()).alias("ends"))
    tested = F.filter("slots", lambda s: ~F.exists("ends", lambda e: s["at"].between(e.low, e.high)))
    return counted.select(*key, "n_item_windows", "n_windows", "n_shifts", tested.alias("slots"))


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, item_id, n_windows, n_item_windows, n_slots, n_changed): contaminated documents with each of their items.

    ``th`` is a hash of the text; n_slots and n_changed count placeholder values of the best alignment, and n_changed its
    further shifts.
    """
    items = durable(distinct_items(benchmark))
    usable = durable(template_windows(items))
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    seeds = slim.select("doc_id", F.xxhash64("text").alias("th"), codes(blind(words(F.col("text")))).alias("codes")).select("doc_id", "th", F.explode(windows("codes")).alias("h"))
    found = durable(seeds.join(usable.select("h").distinct(), "h", "left_semi").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct())
    hit = slim.withColumn("th", F.xxhash64("text")).join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).select("doc_id", "th", "text").distinct()
    hit = hit.select("doc_id", "th", words(F.col("text")).alias("words")).withColumn("codes", codes(blind(F.col("words"))))
    placed = hit.select("doc_id", "th", "words", F.posexplode(windows("codes")).alias("p", "h"))
    met = placed.join(usable, "h").select("doc_id", "th", "template", "q", "r", "n_item_windows", (F.col("p") - F.col("q")).alias("shift"), F.slice("words", F.col("p") + 1, WINDOW).alias("doc_words"))
    # Values of the slots with their places in the template.
    slots = F.filter(F.transform("doc_words", lambda w, k: F.struct((F.col("q") + k).alias("at"), w.alias("value"))), lambda s: placeholder(s.value))
    key = ["doc_id", "th", "template"]
    shifts = durable(
        met.select(*key, "shift", "n_item_windows", F.struct("q", "r", slots.alias("slots")).alias("m"))
        .groupBy(*key, "shift").agg(F.first("n_item_windows").alias("n_item_windows"), F.count(F.lit(1)).alias("n_windows"), F.collect_list("m").alias("found"))
    )
    single = shifts.select(*key, "n_item_windows", "n_windows", F.lit(1).cast("long").alias("n_shifts"), F.flatten("found.slots").alias("slots"))
    covered = single.unionByName(_runs(shifts, key)).where(F.col("n_windows") >= SHARE * F.col("n_item_windows")).withColumn("slots", F.array_distinct("slots"))
    # Each item of the template by itself; a place of the item and its value in the document become a pair of values.
    tried = covered.join(items.select("template", "item", "words"), "template")
    tried = tried.withColumn("pairs", F.array_distinct(F.transform("slots", lambda s: F.struct(F.get("words", s.at).alias("item_value"), s.value.alias("doc_value")))))
    tried = tried.where(F.size("pairs") == F.size(F.array_distinct("pairs.item_value")))
    changed = F.size(F.filter("pairs", lambda p: p.item_value != p.doc_value)) + F.col("n_shifts") - 1
    tried = tried.select(*key, "item", "n_windows", "n_item_windows", F.size("pairs").cast("long").alias("n_slots"), changed.cast("long").alias("n_changed"))
    verbatim = tried.where("n_changed = 0").groupBy(*key, "item").agg(F.max(F.struct("n_windows", "n_slots")).alias("b"), F.first("n_item_windows").alias("n_item_windows"))
    verbatim = verbatim.select(*key, "item", "b.n_windows", "n_item_windows", "b.n_slots", F.lit(0).cast("long").alias("n_changed"))
    rank = F.struct((-F.col("n_windows")).alias("w"), "n_changed", (-F.col("n_slots")).alias("s"), F.col("item").isNull().alias("none"), "item")
    other = tried.groupBy(*key).agg(F.min(rank).alias("b"), F.first("n_item_windows").alias("n_item_windows"), F.min("n_changed").alias("least")).where("least > 0")
    other = other.select(*key, "b.item", (-F.col("b.w")).alias("n_windows"), "n_item_windows", (-F.col("b.s")).alias("n_slots"), "b.n_changed")
    return verbatim.unionByName(other).select("doc_id", "th", F.col("item").alias("item_id"), "n_windows", "n_item_windows", "n_slots", "n_changed")


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, n_windows, n_item_windows, verdict (verbatim or re-parameterised) of every contaminated document and item."""
    return matches(docs, benchmark, doc_id, text).select("doc_id", "item_id", "n_windows", "n_item_windows", F.when(F.col("n_changed") > 0, "re-parameterised").otherwise("verbatim").alias("verdict"))


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` that no item contaminates."""
    gone = durable(matches(docs, benchmark, doc_id, text).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct())
    packed = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("_doc"), F.xxhash64(text).alias("_text"))
    return packed.join(gone, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_th")), "left_anti").select("_row.*")
