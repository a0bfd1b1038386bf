"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and units become typed placeholders, so a question with other numbers and names keeps its template. A
text has two templates: in the first every capitalised word is a name (a run of them is one name), in the second, of
the lower-cased text, names stay literal; so a copy in another case still has the second. Template windows of five
tokens are hash-joined with the benchmark's. Windows that line up (same distance between document and item) must fill
the item's slots consistently: equal values of the item have equal values in the document. Items without enough
windows are compared whole with whole texts and lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import pick, row_key
from shelfmark.session import checkpointed, read_table

WINDOW = 5
CONTAINED = 0.8
#: Windows of the benchmark up to which its side is broadcast; larger benchmarks are joined by a shuffle.
BROADCAST_WINDOWS = 200_000
#: A window of an item needs at least this many tokens that are no placeholder.
LITERALS = 3
#: With names as placeholders an item needs so many windows: a few say too little of it.
NAMED_WINDOWS = 4
#: Items with names in most windows that are looked for by their words; with more of them, every text gets the template with names.
DENSE_ITEMS = 64
NUMBER, NAME, UNIT = "§d", "§n", "§u"
NAMED, LITERAL = 0, 1
UNITS = (
    "mm", "cm", "m", "km", "in", "inch", "inches", "ft", "feet", "foot", "mile", "miles", "meter", "meters", "metre", "metres",
    "mg", "g", "kg", "lb", "lbs", "oz", "ton", "tons", "ml", "l", "liter", "liters", "litre", "litres", "s", "sec", "second", "seconds",
    "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "usd", "eur", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "mph", "kmh", "mb", "gb", "tb", "w", "kw", "v",
)


def _clean(text: Column) -> Column:
    """Words and numbers, apart by white space; marks become spaces, so a sentence's end leaves two.

    White space of the text is one space first, so a name after a line break is one as well.
    """
    return F.regexp_replace(F.regexp_replace(text, r"[§·\s]+", " "), r"(?<![\p{Nd}])[.,]|[.,](?![\p{Nd}])|[^\p{L}\p{Nd}\s.,]", " ")


def _joined(cleaned: Column) -> Column:
    """Successive capitalised words are one token."""
    return F.regexp_replace(cleaned, r"(?<![\p{L}\p{Nd}])(\p{Lu}\p{L}*) (?=\p{Lu})", "$1·")


def _tokens(cleaned: Column) -> Column:
    return F.split(F.trim(F.lower(cleaned)), " +")


def _typed(cleaned: Column) -> Column:
    numbered = F.regexp_replace(cleaned, r"\p{Nd}+(?:[.,]\p{Nd}+)*", NUMBER)
    return F.regexp_replace(numbered, rf"(?i)(?<={NUMBER}) ({'|'.join(UNITS)})(?![\p{{L}}\p{{Nd}}])", f" {UNIT}")


def _named(joined: Column) -> Column:
    return F.regexp_replace(joined, r"(?<![\p{L}\p{Nd}·])\p{Lu}[\p{L}·]*(?![\p{L}\p{Nd}])", NAME)


def _templates(cleaned: Column, typed: Column) -> dict[int, tuple[Column, Column]]:
    """By stream: the template's tokens, and the same tokens as they stand. ``typed`` has numbers and units replaced."""
    return {NAMED: (_tokens(_named(_joined(typed))), _tokens(_joined(cleaned))), LITERAL: (_tokens(typed), _tokens(cleaned))}


def _windows(table: DataFrame, stream: int, *keys: str) -> DataFrame:
    """keys, at and h of each window of a stream; a text of fewer tokens has none."""
    tokens = table.select(*keys, _templates(F.col("cleaned"), F.col("typed"))[stream][0].alias("t"))
    # Tokens are hashed once each, and a window's hash is one of numbers.
    hashed = tokens.select(*keys, F.transform("t", lambda x: F.xxhash64(F.lit(stream), x)).alias("t"))
    found = F.transform(F.sequence(F.lit(0), F.size("t") - WINDOW), lambda i: F.xxhash64(*[F.get("t", i + k) for k in range(WINDOW)]))
    return hashed.select(*keys, F.posexplode(F.when(F.size("t") >= WINDOW, found)).alias("at", "h"))


def _typed_text(table: DataFrame, text: Column, *keys: str) -> DataFrame:
    cleaned = table.select(*keys, _clean(F.coalesce(text, F.lit(""))).alias("cleaned"))
    return cleaned.select(*keys, "cleaned", _typed(F.col("cleaned")).alias("typed"))


def _slots(table: DataFrame, *keys: str) -> DataFrame:
    """(keys, stream, place, kind, value) of every placeholder."""
    def placed_tokens(stream: int, template: Column, plain: Column) -> Column:
        both = F.arrays_zip(template.alias("template"), plain.alias("plain"))
        return F.transform(both, lambda t, i: F.struct(F.lit(stream).alias("stream"), i.alias("place"), t["template"].alias("kind"), t["plain"].alias("value")))

    streams = [placed_tokens(k, *found) for k, found in _templates(F.col("cleaned"), F.col("typed")).items()]
    placed = table.select(*keys, F.explode(F.filter(F.concat(*streams), lambda x: x["kind"].startswith("§"))).alias("s"))
    return placed.select(*keys, "s.*")


def _item_windows(items: DataFrame) -> DataFrame:
    """item_id, version, stream, item_at, h, and is it without names, of every window with enough literal tokens."""
    found = None
    for stream in (NAMED, LITERAL):
        at = _windows(items, stream, "item_id", "version").withColumnsRenamed({"at": "item_at"})
        tokens = items.select("item_id", "version", _templates(F.col("cleaned"), F.col("typed"))[stream][0].alias("t"))
        part = F.slice("t", F.col("item_at") + 1, WINDOW)
        own = at.join(tokens, ["item_id", "version"]).where(F.size(F.filter(part, lambda t: ~t.startswith("§"))) >= LITERALS)
        own = own.select("item_id", "version", F.lit(stream).alias("stream"), "item_at", "h", (~F.array_contains(part, NAME)).alias("plain"), part.alias("part"))
        found = own if found is None else found.unionAll(own)
    return found


def _of(keyed: DataFrame, hits: DataFrame, *doc: str) -> DataFrame:
    """Templates of the few documents that have a hit; the others' texts are not looked at."""
    return _typed_text(keyed.join(hits.select("rk1", "rk2").distinct(), ["rk1", "rk2"], "left_semi"), F.col("text"), *doc)


def _may_hold(windows: DataFrame, contained: float) -> Column:
    """Has a text all literal words of one of the windows of which an item can't miss all? ``windows``: those of DENSE_ITEMS items at most."""
    first: dict[tuple, list] = {}
    for w in windows.orderBy("item_id", "version", "item_at").collect():
        own = first.setdefault((w.item_id, w.version), [])
        if len(own) <= w.item_windows * (1 - contained):
            own.append({t for t in w.part if "§" not in t})
    low, found = F.lower("text"), F.lit(False)
    for words in {frozenset(x) for own in first.values() for x in own}:
        every = F.lit(True)
        for word in sorted(words, key=lambda x: (-len(x), x)):
            every &= F.contains(low, F.lit(word))
        found |= every
    return found


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", contained: float = CONTAINED
) -> DataFrame:
    """Pairs of a document and an item that it contains: doc_id, item_id, matched, item_windows, containment, rk1, rk2.

    matched counts the item's windows, of one of the two templates, that the document has in lines with consistent
    slots; a pair is reported from ``contained`` of the item's windows on, with the template that has more of them. An
    item without a window of three literal tokens (short, or little but numbers) is found where a whole text, or a whole
    line of it, has the same words and numbers in any case; matched and item_windows are then 1. Empty and null items
    and texts match nothing. Rows that repeat both id and text are one document; items that repeat are matched each
    under its id, and rows of one item id with several texts are several items. Empty tables give an empty result.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("item_text")).distinct()
    items = _typed_text(items.withColumn("version", F.xxhash64("item_text")), F.col("item_text"), "item_id", "version")
    windows = _item_windows(items)
    sizes = windows.groupBy("item_id", "version", "stream").agg(F.countDistinct("item_at").alias("item_windows"), F.count_if("plain").alias("plain"))
    sizes = checkpointed(sizes.where((F.col("stream") == LITERAL) | (F.col("item_windows") >= NAMED_WINDOWS)))
    windows = checkpointed(windows.join(sizes, ["item_id", "version", "stream"], "left_semi"))
    few = windows.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    one_side = F.broadcast if few else (lambda df: df)
    hashes = windows.select("item_id", "version", "stream", "item_at", "h")

    base = pick(docs, id_col, text_col)
    keyed = base.select("doc_id", *row_key(F.col("doc_id"), F.col("text")), "text")
    doc = ["doc_id", "rk1", "rk2"]
    cleaned = _typed_text(keyed, F.col("text"), *doc)
    keys = [*doc, "item_id", "version", "stream"]

    def hits_of(table: DataFrame, stream: int) -> DataFrame:
        seen = _windows(table, stream, *doc).withColumnRenamed("at", "doc_at")
        found = seen.join(one_side(hashes.where(F.col("stream") == stream)), "h")
        return checkpointed(found.select(*keys, "item_at", (F.col("doc_at") - F.col("item_at")).alias("line")).distinct())

    hits = hits_of(cleaned, LITERAL)
    # Where over a fifth of an item's windows have no name, enough matched windows include one of them, which is a window of
    # the other template as well: only documents with a hit need the template with names. The others are looked for by words.
    some = _of(keyed, hits, *doc)
    dense = sizes.where((F.col("stream") == NAMED) & (F.col("plain") <= F.col("item_windows") * (1 - contained))).select("item_id", "version", "stream", "item_windows")
    if (n := dense.limit(DENSE_ITEMS + 1).count()) > DENSE_ITEMS:
        some = cleaned
    elif n:
        some = some.unionAll(_typed_text(keyed.where(_may_hold(windows.join(dense, ["item_id", "version", "stream"]), contained)), F.col("text"), *doc))
    hits = hits.unionByName(hits_of(some, NAMED))
    item_slots = _slots(items, "item_id", "version")
    hits = _consistent(hits, item_slots, _of(keyed, hits, *doc), one_side, keys)
    matched = hits.groupBy(*keys).agg(F.countDistinct("item_at").alias("matched"))
    found = matched.join(one_side(sizes.drop("plain")), ["item_id", "version", "stream"]).withColumn("containment", F.col("matched") / F.col("item_windows"))
    best = F.max(F.struct("containment", "matched", "item_windows"))
    found = found.where(F.col("containment") >= contained).groupBy("doc_id", "rk1", "rk2", "item_id", "version").agg(best.alias("b"))
    found = found.select("doc_id", "item_id", "b.matched", "b.item_windows", "b.containment", "rk1", "rk2")

    whole = items.join(sizes.select("item_id", "version").distinct(), ["item_id", "version"], "left_anti")
    whole = whole.select("item_id", F.array_join(_tokens(F.col("cleaned")), " ").alias("said")).where("said <> ''").distinct()
    if whole.isEmpty():
        return found
    lines = F.array_distinct(F.transform(F.array_append(F.split("text", r"\R"), F.col("text")), lambda x: F.array_join(_tokens(_clean(x)), " ")))
    told = keyed.select("doc_id", "rk1", "rk2", F.explode(lines).alias("said"))
    same = told.join(one_side(whole), "said").select("doc_id", "item_id", F.lit(1).cast("long").alias("matched"), F.lit(1).cast("long").alias("item_windows"), F.lit(1.0).alias("containment"), "rk1", "rk2")
    return found.unionByName(same.distinct())


def _consistent(hits: DataFrame, item_slots: DataFrame, cleaned: DataFrame, one_side, keys: list[str]) -> DataFrame:
    """Hits on lines whose slots are filled consistently, and those on lines without slots."""
    doc_slots = _slots(cleaned, "rk1", "rk2").drop("kind")
    doc_slots = doc_slots.withColumnsRenamed({"place": "doc_place", "value": "doc_value"}).distinct()
    filled = hits.join(one_side(item_slots), ["item_id", "version", "stream"]).where((F.col("place") >= F.col("item_at")) & (F.col("place") < F.col("item_at") + WINDOW))
    filled = filled.select(*keys, "line", "kind", "value", (F.col("place") + F.col("line")).alias("doc_place")).distinct()
    filled = filled.join(doc_slots, ["rk1", "rk2", "stream", "doc_place"])
    line = ["rk1", "rk2", "item_id", "version", "stream", "line"]
    per_value = filled.groupBy(*line, "kind", "value").agg(F.countDistinct("doc_value").alias("n"))
    broken = per_value.where("n > 1").select(*line).distinct()
    return hits.join(broken, line, "left_anti")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whatever they are called, that contain no item of the benchmark."""
    found = contaminated(docs, benchmark, id_col, text_col).select(F.struct("rk1", "rk2").alias("own")).distinct()
    rows = docs.select(F.struct(*row_key(F.col(id_col).cast("long"), F.col(text_col))).alias("own"), F.struct("*").alias("row"))
    return rows.join(found, "own", "left_anti").select("row.*")


def op9_decontam(spark, sf_dir: str) -> DataFrame:
    found = contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched", "item_windows", F.round("containment", 6).alias("containment"))
