"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Numbers, units and names become typed placeholders, so that a question with other values
has the same template. Windows of five template words are hash-joined with those of the
benchmark. Where windows of a document follow an item at one offset, the values that stand
in the item's slots must map to the document's values without contradiction; windows with a
contradicting slot don't count. Windows whose words are equal as they stand (without case
and edge punctuation) always count, whatever the slots of the passage say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

WIDTH, SHARE = 5, 0.8
#: Words in a row that give a passage of a longer item away, whatever share of it they are.
RUN = 20
#: Literal words from which on a window says enough to be found by its template alone.
STRONG = 3
#: Items of fewer words than WIDTH but this many match by their words as they stand; still
#: shorter ones match documents that consist of them.
LEAST = 3
#: Windows up to which the benchmark is broadcast (about 100 bytes each); beyond, the join shuffles.
BROADCAST_WINDOWS = 200_000
SPACES = " \t\n\v\f\r"
# Unit words that make a placeholder after a number.
UNITS = ("mm", "cm", "m", "km", "mg", "g", "kg", "ml", "l", "s", "min", "h", "hours", "minutes", "seconds", "days", "weeks", "months", "years", "miles", "feet", "inches", "pounds", "ounces", "dollars", "euros", "cents", "percent", "meters", "kilometers", "grams", "kilograms", "liters")
NUMBER, UNIT, NAME = "‹n›", "‹u›", "‹p›"
PLACEHOLDER = "‹"
#: Punctuation before and after words, of which templates and values keep none (of longer runs, all but eight marks).
LEAD, TRAIL = r"""\"'(\[{“‘¿¡""", r""".,;:!?\"')\]}”’"""
BETWEEN = rf"(?:[{TRAIL}]{{0,8}}[\x20\x09-\x0D]++[{LEAD}]{{0,8}})++"
ENDS = SPACES + """\"'([{“‘¿¡.,;:!?)]}”’"""
# The patterns begin with what is rare, so that most characters are passed over at once, and
# their loops are possessive, so that no long run nests calls.
NAMES = r"\p{Lu}(?<=[\p{Ll}0-9,]\x20.)\p{L}[\p{L}’'-]*"
NUMBERS = rf"(?=[$€£0-9])(?<![\p{{L}}\p{{N}}])[$€£]?[0-9]+(?:[.,:/][0-9]++)*+(?:%|{'|'.join(UNITS)})?(?![\p{{L}}\p{{N}}])"
MEASURED = rf"{NUMBER}\x20(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])"


def worded(rows: DataFrame, name: str) -> DataFrame:
    """key, the column ``name``, words in lower case and as many template words of each text.

    A name is a word of two letters or more that begins with a capital, or is all capitals, and
    follows a word in lower case, a number or a comma.
    key is a hash of id and text, so rows that share an id only are told apart.
    """
    keyed = rows.select(F.xxhash64(rows[name], rows["text"]).alias("key"), rows[name].alias(name), rows["text"].alias("text")).where("text is not null")
    named = keyed.select("key", name, F.lower("text").alias("plain"), F.lower(F.regexp_replace("text", NAMES, NAME)).alias("low"))
    typed = F.regexp_replace(F.regexp_replace("low", NUMBERS, NUMBER), MEASURED, f"{NUMBER} {UNIT}")
    split = lambda c: F.split(F.btrim(c, F.lit(ENDS)), BETWEEN)
    return named.select("key", name, split(F.col("plain")).alias("plain"), split(typed).alias("words"))


def windows(rows: DataFrame, name: str, at: str, short: list[int], whole: bool) -> DataFrame:
    """Rows (key, name, at, width, h, kind, plain, words): windows of each text by hash.

    kind is 0 for the words as they stand and 1 for the template, of windows with a
    placeholder alone. Windows are WIDTH words wide; texts of fewer words than LEAST are one
    window, and for ``short`` widths there are windows of these too: of every text, or if
    ``whole`` of texts of that very size. A place is a number, eight times the position and
    the width: no lambda stands below the explode, so it is compiled, and plain and words are
    no copies but the text's own arrays until a row leaves the stage.
    """
    n, none = F.size("plain"), F.array().cast("array<int>")

    def places(width: int) -> Column:
        only = whole and width < WIDTH
        fits = n == width if only else n >= width
        return F.when(fits, F.sequence(F.lit(width), F.lit(width) if only else (n - width) * 8 + width, F.lit(8))).otherwise(none)

    tiny = F.when(n.between(1, LEAST - 1) & (F.get("plain", F.lit(0)) != ""), F.array(n)).otherwise(none)
    made = F.concat(places(WIDTH), tiny, *(places(w) for w in short))
    # an outer explode, as for a plain one the optimizer would push a filter, with all steps above again, below them
    spread = worded(rows, name).select("key", name, "plain", "words", F.explode_outer(made).alias("p")).where("p is not null")
    spread = spread.select("key", name, "plain", "words", F.shiftright("p", 3).alias(at), F.col("p").bitwiseAND(F.lit(7)).alias("width"))
    sized = lambda c: F.xxhash64(*(F.when(F.col("width") > k, F.get(c, F.col(at) + k)) for k in range(WIDTH)))
    typed = slot(at, 0)
    for k in range(1, WIDTH):
        typed = typed | slot(at, k)
    kinds = F.array(F.struct(sized("plain").alias("h"), F.lit(0).alias("kind")), F.struct(F.when(typed, sized("words")).alias("h"), F.lit(1).alias("kind")))
    return spread.select("key", name, at, "width", "plain", "words", F.explode(kinds).alias("k")).select("key", name, at, "width", F.col("k.h").alias("h"), F.col("k.kind").alias("kind"), "plain", "words").where("h is not null")


def slot(at: str, k: int) -> Column:
    """Whether the window's k-th word is a placeholder."""
    return (F.col("width") == WIDTH) & F.startswith(F.get("words", F.col(at) + k), F.lit(PLACEHOLDER))


def valued(found: DataFrame, at: str) -> DataFrame:
    """values, the words behind placeholders (others null), and strength, how many words are none, for the text's arrays."""
    values = F.array(*(F.when(slot(at, k), F.get("plain", F.col(at) + k)) for k in range(WIDTH)))
    strength = WIDTH - sum((slot(at, k).cast("int") for k in range(1, WIDTH)), slot(at, 0).cast("int"))
    return found.select(*(c for c in found.columns if c not in ("plain", "words")), values.alias("values"), strength.alias("strength"))


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, run: int = RUN) -> DataFrame:
    """Rows (doc_id, item_id, n_windows, n_found, longest_run) of contaminated documents.

    A document is contaminated by an item if it holds at least ``share`` of the item's
    windows, or ``run`` of its words in a row. A window is held if its words stand there, or
    if its template does, its slots don't contradict the others at that offset, and either
    STRONG of its words are literal or one is and a stronger window is held at that offset.
    Items of three or four words are one window, held if its words stand there; items of one
    or two words match documents that are no more than them.

    Null and empty texts hold nothing. Rows are told apart by id and text: equal rows count
    once, rows that share a doc_id are judged each by itself, ids may be null. Ties don't
    occur: every item that a document holds has its row. Very long texts are read whole. No
    columns but doc_id, item_id and text are read. The driver sees the number of benchmark
    windows and which of the two short sizes items have.
    """
    sizes = worded(benchmark, "item_id").select(F.size("plain").alias("n")).where(F.col("n").between(LEAST, WIDTH - 1)).distinct()
    short = sorted(r.n for r in sizes.collect())
    items = checkpointed(valued(windows(benchmark, "item_id", "j", short, whole=True), "j"))
    items = items.select(F.col("key").alias("item"), "item_id", "j", "h", "kind", "strength", F.col("values").alias("theirs"), F.col("width").alias("their_width")).distinct()
    totals = items.groupBy("item").agg(F.countDistinct("j").alias("n_windows"), F.max("their_width").alias("width"))
    few = items.count() <= BROADCAST_WINDOWS
    held = windows(docs, "doc_id", "i", short, whole=False)
    # texts' arrays may pass a broadcast join, which drops nearly all rows, but no shuffle
    found = valued(held.join(F.broadcast(items.drop("strength")), ["h", "kind"]), "i") if few else valued(held, "i").join(items.drop("strength"), ["h", "kind"])
    found = found.where("kind = 0 or strength > 0").select("key", "doc_id", "item", "item_id", (F.col("i") - F.col("j")).alias("shift"), "j", "kind", "strength", "theirs", "values")
    found = checkpointed(found)
    place = ["key", "item", "shift"]
    # values of slots, by offset: an item's value must always meet the same one
    pairs = F.arrays_zip(F.col("theirs").alias("theirs"), F.col("values").alias("ours"))
    met = found.where("kind = 1").select(*place, F.explode(pairs).alias("p")).where("p.theirs is not null")
    wrong = met.groupBy(*place, "p.theirs").agg((F.min("p.ours") != F.max("p.ours")).alias("wrong")).where("wrong")
    wrong = wrong.groupBy(*place).agg(F.collect_set("theirs").alias("wrong"))
    strong = found.where(F.expr(f"kind = 0 or strength >= {STRONG}")).select(*place).distinct().withColumn("strong", F.lit(True))
    judged = found.join(wrong, place, "left").join(strong, place, "left_semi")
    held = judged.where(F.expr("kind = 0 or wrong is null or not arrays_overlap(array_compact(theirs), wrong)"))
    held = held.select("key", "doc_id", "item", "item_id", "j").distinct()
    # a run of windows that follow one another in the item has one difference of position and rank
    order = held.withColumn("group", F.col("j") - F.expr("row_number() over (partition by key, item order by j)"))
    runs = order.groupBy("key", "doc_id", "item", "item_id", "group").agg(F.count("*").alias("n"))
    scored = runs.groupBy("key", "doc_id", "item", "item_id").agg(F.sum("n").alias("n_found"), F.max("n").alias("longest"))
    scored = scored.join(F.broadcast(totals) if few else totals, "item").withColumn("longest_run", F.col("longest") + F.col("width") - 1)
    hit = (F.col("n_found") >= share * F.col("n_windows")) | (F.col("longest_run") >= run)
    return scored.where(hit).select("doc_id", "item_id", "n_windows", "n_found", "longest_run", F.col("key").alias("row_key"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns, whether or not they have a doc_id.

    Null, empty and repeated rows stay as they are; an empty benchmark leaves every row.
    """
    bad = leaks(docs, benchmark).select(F.col("row_key").alias("leaked_row_key")).distinct()
    return docs.join(bad, F.xxhash64(docs["doc_id"], docs["text"]) == bad["leaked_row_key"], "left_anti")
