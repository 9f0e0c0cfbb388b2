"""Benchmark decontamination by templates.

Numbers, units after numbers and names become typed placeholders, so a question whose parameters were changed has the
template of the original. Windows of templates are hashed and joined; along one alignment of document and item every
value of the item must stand for one value of the document. Items without such windows are sought word by word.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyframe.llm.bytescan import ROW, marks
from plyframe.plans.scratch import written

WINDOW = 8
LITERALS = 4
SHARE = 0.5
BROADCAST_ROWS = 200_000
MARKS = ".,;:!?\"'()[]{}*#%&$€£|/\\-_+=~`@^…–—“”„‘’«»¿¡"
NUMBERS = ("one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|"
           "eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|dozen")
OPENERS = ("a|an|the|this|that|these|those|if|how|what|when|where|which|who|whose|why|is|are|was|were|do|does|did|can|could|"
           "will|would|should|there|it|he|she|we|you|they|his|her|its|their|our|your|my|in|on|at|for|from|to|of|with|by|as|"
           "and|or|but|so|then|each|every|all|some|many|most|after|before|during|while|since|suppose|assume|let|given|find|"
           "calculate|compute|determine|solve|write|explain|describe|no|not|yes")  # open sentences, so are no names there
UNITS = ("mm|cm|m|km|in|ft|yd|mi|inches|feet|yards|miles|meters|metres|kilometers|kilometres|mg|g|kg|t|oz|lb|lbs|grams|"
         "kilograms|pounds|ounces|tons|ml|cl|l|liters|litres|gallons|cups|s|sec|secs|min|mins|h|hr|hrs|seconds|minutes|hours|"
         "days|weeks|months|years|percent|dollars|cents|euros|usd|eur|degrees|mph|kmh|watts|volts")


def spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"\s+", " "))


def plain(token: Column) -> Column:
    return F.lower(F.translate(token, MARKS, ""))


def template(spaced_text: Column) -> Column:
    """Tokens, one for each word of the text: placeholders, or the word in lower case without marks."""
    t = F.regexp_replace(spaced_text, r"\p{N}(?<![\p{L}\p{N}]\p{N})[^ ]*", "<num>")
    t = F.regexp_replace(t, rf"(?i)(?<![^ ])(?:{NUMBERS})(?![\p{{L}}\p{{N}}])[^ ]*", "<num>")
    t = F.regexp_replace(t, rf"(?i)(?<=<num> )(?:{UNITS})(?![\p{{L}}\p{{N}}])[^ ]*", "<unit>")
    opener = rf"(?!(?i:{OPENERS})(?![\p{{L}}\p{{N}}]))"
    t = F.regexp_replace(t, rf"(?=\p{{Lu}}\p{{Ll}})(?:(?<=[^ .!?:] )|(?<=[.!?:] |^){opener})[^ ]+", "<name>")
    return F.split(plain(t), " ")


def _slot(token: Column) -> Column:
    return token.isin("<num>", "<unit>", "<name>")


def leaks(docs: DataFrame, items: DataFrame, id: str, text: str, item: str, item_text: str, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, n_windows, share: the documents that hold at least `share` of an item's template windows.

    A window counts if it has at least LITERALS words that are no placeholders and lies on an alignment in which no
    value of the item stands for two values of the document. An item with no such window is found by its own words
    instead: at least `share` of its windows of WINDOW words, all its words in a row if it has fewer, and for an item of
    under LITERALS words a document that has no others. An item without words is never found. A null text is empty; rows
    without an id are not reported; rows that repeat a document or an item count once. Empty tables give no rows; other
    columns are not read. Only the items' windows are broadcast, if they are few; else they are shuffled.
    """
    source = docs.select(F.col(id).cast("long").alias("doc_id"), spaced(F.col(text)).alias("text")).where("doc_id IS NOT NULL")
    source = source.select("doc_id", *marks(F.col("text")), "text")
    known = items.select(F.col(item).cast("long").alias("item_id"), spaced(F.col(item_text)).alias("text")).where(
        "item_id IS NOT NULL").distinct().withColumn("tokens", template(F.col("text")))
    known = known.withColumn("item_mark", F.md5(F.col("text").cast("binary")))
    of = ["item_id", "item_mark"]
    pair = [*ROW, *of]

    rows = _hashed(known, [*of, "tokens"])
    words = F.slice("tokens", F.col("pos") + 1, F.lit(WINDOW))
    literal = F.size(F.filter(words, lambda t: ~_slot(t) & (t != ""))) >= LITERALS
    grams = written(rows.where(literal).select(*of, F.col("pos").alias("item_pos"), "window"))
    sizes = grams.groupBy(*of).agg(F.count("*").alias("size"))

    few = grams.count() <= BROADCAST_ROWS
    # a broadcast index leaves the text in place, so a hit takes its words along; a shuffle would send the text with each window
    seen = _hashed(source.withColumn("tokens", template(F.col("text"))), [*ROW, "text"] if few else ROW)
    said = [F.slice(F.split("text", " "), F.col("pos") + 1, F.lit(WINDOW)).alias("said")] if few else []
    index = F.broadcast(grams) if few else grams
    hits = seen.join(index, "window").select(*pair, "item_pos", (F.col("pos") - F.col("item_pos")).alias("shift"), *said)
    hits = written(hits.distinct())
    likely = hits.groupBy(*pair, "item_pos").agg(F.lit(1)).groupBy(*pair).agg(F.count("*").alias("n_windows")).join(
        sizes, of).where(F.col("n_windows") >= share * F.col("size"))
    hits = written(hits.join(likely.select(*pair, "size"), pair))

    covered = F.explode(F.sequence(F.col("item_pos"), F.col("item_pos") + (WINDOW - 1)))
    places = hits.select(*pair, "shift", covered.alias("item_pos")).distinct()
    asked = places.join(_values(known, of).select(
        *of, F.col("pos").alias("item_pos"), F.concat_ws(" ", "kind", "value").alias("item_value")), [*of, "item_pos"])
    asked = written(asked.withColumn("pos", F.col("item_pos") + F.col("shift")))
    clean = hits
    if not asked.isEmpty():
        if few:
            given = hits.select(*ROW, (F.col("item_pos") + F.col("shift")).alias("start"), "said").distinct().select(
                *ROW, "start", F.posexplode("said").alias("at", "word"))
            given = given.select(*ROW, (F.col("start") + F.col("at")).alias("pos"), plain(F.col("word")).alias("value")).distinct()
        else:
            whole = source.join(asked.select(*ROW).distinct(), ROW, "left_semi").distinct()
            given = _values(whole.withColumn("tokens", template(F.col("text"))), ROW)
        values = asked.join(given.select(*ROW, "pos", "value"), [*ROW, "pos"])
        torn = values.groupBy(*pair, "shift", "item_value").agg(F.min("value").alias("a"), F.max("value").alias("b")).where("a <> b")
        clean = hits.join(torn.select(*pair, "shift").distinct(), [*pair, "shift"], "left_anti")
    clean = clean.select(*pair, "item_pos", "size")
    weak = written(known.join(sizes, of, "left_anti").select(*of, _words(F.col("text")).alias("words")).where(F.size("words") > 0))
    if not weak.isEmpty():
        clean = clean.union(_verbatim(source, weak, of))
    found = clean.distinct().groupBy(*pair, "size").agg(F.count("*").alias("n_windows"))
    found = found.withColumn("share", F.col("n_windows") / F.col("size")).where(F.col("share") >= share)
    return found.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max("share").alias("share"))


def _few(windows: DataFrame) -> DataFrame:
    return F.broadcast(windows) if windows.count() <= BROADCAST_ROWS else windows


def _words(spaced_text: Column) -> Column:
    return F.filter(F.split(plain(spaced_text), " "), lambda t: t != "")


def _windows(hashes: str, width: int) -> Column:
    last = F.size(hashes) - width
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(
        *(F.get(hashes, i + k) for k in range(width)))))


def _hashed(rows: DataFrame, kept: list[str]) -> DataFrame:
    """The columns `kept`, pos (from 0), window: a row for each window of the templates `tokens`."""
    hashed = rows.select(*kept, F.transform("tokens", lambda t: F.xxhash64(t)).alias("_hashes"))
    return hashed.select(*kept, F.posexplode(_windows("_hashes", WINDOW)).alias("pos", "window"))


def _verbatim(source: DataFrame, weak: DataFrame, of: list[str]) -> DataFrame:
    """ROW, `of`, item_pos, size: where documents have windows of the items' own `words`, as wide as the item allows.

    All widths, WINDOW of them at most, are read in one scan of the documents.
    """
    width = F.least(F.size("words"), F.lit(WINDOW))
    widths = sorted(r[0] for r in weak.select(width).distinct().collect())

    def grams(w: int) -> Column:
        allowed = (F.size("_hashes") == w) | F.lit(w >= LITERALS)
        found = F.transform(F.when(allowed, _windows("_hashes", w)), lambda h, i: F.struct(F.lit(w).alias("width"), i.alias("pos"), h.alias("window")))
        return F.coalesce(found, F.array().cast("array<struct<width:int,pos:int,window:bigint>>"))

    def each(rows: DataFrame, kept: list[str]) -> DataFrame:
        hashed = rows.select(*kept, F.transform("words", lambda t: F.xxhash64(t)).alias("_hashes"))
        return hashed.select(*kept, F.inline(F.flatten(F.array(*map(grams, widths)))))

    index = each(weak.withColumn("size", F.greatest(F.size("words") - WINDOW + 1, F.lit(1))), [*of, "words", "size"])
    index = index.where(F.col("width") == width).select(*of, "size", "width", "window", F.col("pos").alias("item_pos"))
    seen = each(source.select(*ROW, _words(F.col("text")).alias("words")), ROW)
    return seen.join(_few(index), ["width", "window"]).select(*ROW, *of, "item_pos", "size")


def _values(rows: DataFrame, kept: list[str]) -> DataFrame:
    """The columns `kept`, pos, kind, value: the placeholders of a text with the words they stand for."""
    both = F.arrays_zip(F.col("tokens").alias("kind"), F.split("text", " ").alias("word"))
    return rows.select(*kept, F.posexplode(both).alias("pos", "slot")).where(_slot(F.col("slot.kind"))).select(
        *kept, "pos", F.col("slot.kind").alias("kind"), plain(F.col("slot.word")).alias("value"))
