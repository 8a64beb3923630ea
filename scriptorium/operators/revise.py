"""Enumerated items, contrast questions and card decks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules, text, vectors
from ..scratch import kept, numbered, sorted_join


def extract_items(chunks: DataFrame) -> DataFrame:
    """chunk_id, ordinal, item_no, item: enumerated items of (chunk_id, ordinal, text_raw), cleaned and filtered.

    A line "1) ..." or "1. ..." begins an item, other lines continue it; footnote lines
    and lines before the first item are left out.
    """
    trimmed = F.transform(F.split("text_raw", "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    lines = chunks.select("chunk_id", "ordinal", F.posexplode(trimmed).alias("line_no", "line")).filter((F.col("line") != "") & ~F.col("line").rlike(rules.FOOTNOTE))
    pattern = "(?U)" + rules.ITEM_START
    starts = lines.withColumn("begins", F.col("line").rlike(pattern))
    so_far = Window.partitionBy("chunk_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = starts.withColumn("item_no", F.sum(F.col("begins").cast("int")).over(so_far)).filter("item_no > 0")
    said = F.when(F.col("begins"), F.regexp_extract("line", pattern, 2)).otherwise(F.col("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", said.alias("said")))), lambda x: x["said"]), " ")
    items = numbered.groupBy("chunk_id", "ordinal", "item_no").agg(text.strip_glued_footnotes(text.squeeze(joined)).alias("item"))
    size = F.length("item")
    good = size.between(rules.ITEM_MIN_CHARS, rules.ITEM_MAX_CHARS) & (text.junk_ratio("item") <= rules.JUNK_ITEM) & (F.size(text.content_words("item")) >= rules.ITEM_MIN_WORDS) & ~F.col("item").rlike("(?iu)" + text.ascii_bounds(rules.SELF_DECLARING))
    return items.filter(good).select("chunk_id", "ordinal", F.col("item_no").cast("int").alias("item_no"), "item")


def item_pool(chunks: DataFrame, contrasts: Sequence[Sequence[str]] = rules.CONTRASTS) -> DataFrame:
    """Items of chunks with a contrasting category: item_idx (corpus order), item, chunk_id, category, collection, section, page_start, page_end."""
    real = [c for group in contrasts for c in group]
    real_chunks = chunks.filter(F.col("category").isin(real))
    # Written first: dealing by ranges would extract all items once more to find the ranges.
    items = kept(extract_items(real_chunks.select("chunk_id", "ordinal", "text_raw")))
    rows = numbered(items, "item_idx", "ordinal", "chunk_id", "item_no")
    return rows.join(real_chunks.select("chunk_id", "category", "collection", "section", "page_start", "page_end"), "chunk_id").select("item_idx", "item", "chunk_id", "category", "collection", "section", "page_start", "page_end")


def pool_summary(pool: DataFrame) -> DataFrame:
    """category, n, collections (sorted) of the items of each category."""
    return pool.groupBy("category").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("collection")).alias("collections"))


def contrast_of(category: Column, contrasts: Sequence[Sequence[str]] = rules.CONTRASTS) -> Column:
    """Number of the contrast set of a category; null outside all."""
    out = F.lit(None).cast("int")
    for i, group in enumerate(contrasts):
        out = F.when(category.isin(list(group)), F.lit(i)).otherwise(out)
    return out


def quiz_targets(pool: DataFrame, contrasts: Sequence[Sequence[str]] = rules.CONTRASTS) -> DataFrame:
    """collection, category, n_correct, n_wrong of pairs for which a question can be built."""
    counts = pool.withColumn("contrast", contrast_of(F.col("category"), contrasts)).filter("contrast IS NOT NULL").groupBy("collection", "contrast", "category").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("collection", "contrast"))
    return counts.select("collection", "category", F.col("n").alias("n_correct"), (total - F.col("n")).alias("n_wrong")).filter("n_wrong >= 3")


def _draw(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts)).cast("binary"))


def select_items(pool: DataFrame, n: int, seed: int = 0, contrasts: Sequence[Sequence[str]] = rules.CONTRASTS, per_category: int = 8) -> DataFrame:
    """collection, category, question_no, slot (0 correct, 1-3 wrong), item_idx, distractor_category.

    Draws are orders by md5 of seed, question and item, alike on any partitioning. The
    wrong items come from other categories of the contrast set in the same collection,
    from the narrowest length band with three of them, first one of each category by
    size of the category in the band, then any others.
    """
    keyed = pool.select("collection", "category", "item_idx", "item", F.length("item").alias("chars"), contrast_of(F.col("category"), contrasts).alias("contrast")).filter("contrast IS NOT NULL")
    drawn = [_draw(seed, F.col("item_idx")), F.col("item_idx")]
    order = Window.partitionBy("collection", "category").orderBy(*drawn)
    # A correct text that repeats is asked for once.
    distinct = keyed.withColumn("copy", F.row_number().over(Window.partitionBy("collection", "category", "item").orderBy(*drawn))).filter("copy = 1")
    correct = distinct.withColumn("question_no", F.row_number().over(order)).filter(F.col("question_no") <= n).select("collection", "contrast", "category", "question_no", F.col("item_idx").alias("correct_idx"), F.col("chars").alias("target"))
    wrong = keyed.select("collection", "contrast", F.col("category").alias("wrong_category"), "item_idx", "chars")
    # At most n questions a collection and category.
    correct = kept(correct)
    pairs = wrong.join(F.broadcast(correct), ["collection", "contrast"]).filter("wrong_category <> category")
    key = ["collection", "category", "question_no"]
    of_question = Window.partitionBy(*key)
    inside = [F.col("chars").between(F.col("target") / f, F.col("target") * f) for f in rules.LENGTH_BANDS]
    # Items are counted and only the first four of a question and category are drawn, so no task holds the items of a question.
    counts = kept(pairs.groupBy(*key, "wrong_category").agg(F.count_if(inside[0]).alias("n0"), F.count_if(inside[1]).alias("n1"), F.count("*").alias("n2")))
    enough = lambda c: F.sum(c).over(of_question) >= 3
    banded = counts.withColumn("band", F.when(enough("n0"), F.lit(0)).when(enough("n1"), F.lit(1)).otherwise(F.lit(2)))
    of_band = F.when(F.col("band") == 0, F.col("n0")).when(F.col("band") == 1, F.col("n1")).otherwise(F.col("n2"))
    sizes = kept(banded.withColumn("size", of_band).withColumn("n", F.sum("size").over(of_question)).select(*key, "wrong_category", "band", "size", "n"))
    within = pairs.join(F.broadcast(sizes), [*key, "wrong_category"]).filter(((F.col("band") == 0) & inside[0]) | ((F.col("band") == 1) & inside[1]) | (F.col("band") == 2))
    in_category = Window.partitionBy(*key, "wrong_category")
    draw = _draw(seed, F.col("correct_idx"), F.col("item_idx"))
    sized = within.withColumn("draw", draw).withColumn("nth", F.row_number().over(in_category.orderBy("draw", "item_idx"))).filter("nth <= 4")
    lead = F.when(F.col("nth") == 1, F.lit(0)).otherwise(F.lit(1))
    ranked = sized.withColumn("lead", lead).withColumn("slot", F.row_number().over(of_question.orderBy("lead", F.when(F.col("lead") == 0, -F.col("size")), F.when(F.col("lead") == 0, F.col("wrong_category")), "draw", "item_idx")))
    chosen = kept(ranked.filter("n >= 3 AND slot <= 3"))
    right = chosen.filter("slot = 1").select(*key, F.lit(0).alias("slot"), F.col("correct_idx").alias("item_idx"), F.col("category").alias("item_category"))
    return chosen.select(*key, "slot", "item_idx", F.col("wrong_category").alias("item_category")).unionByName(right)


def contrast_pairs(pool: DataFrame, contrasts: Sequence[Sequence[str]] = rules.CONTRASTS, factor: float = rules.LENGTH_BANDS[0]) -> DataFrame:
    """collection, category, other, n: pairs of items of contrasting categories in one collection whose lengths differ by `factor` at most.

    Lengths are counted first, so the pairs are never rows: at most one row a length,
    category and collection meets another.
    """
    sized = pool.select("collection", "category", F.length("item").alias("chars"), contrast_of(F.col("category"), contrasts).alias("contrast")).filter("contrast IS NOT NULL")
    counts = sized.groupBy("collection", "contrast", "category", "chars").agg(F.count("*").alias("m"))
    others = counts.select("collection", "contrast", F.col("category").alias("other"), F.col("chars").alias("other_chars"), F.col("m").alias("other_m"))
    near = counts.join(others, ["collection", "contrast"]).filter((F.col("category") != F.col("other")) & F.col("other_chars").between(F.col("chars") / factor, F.col("chars") * factor))
    return near.groupBy("collection", "category", "other").agg(F.sum(F.col("m") * F.col("other_m")).alias("n"))


def no_pool(requested: DataFrame, selected: DataFrame) -> DataFrame:
    """collection, category, check: requested pairs without a question, each a failure "no_pool"."""
    return requested.select("collection", "category").distinct().join(selected, ["collection", "category"], "left_anti").withColumn("check", F.lit("no_pool"))


def shuffle_options(selected: DataFrame, seed: int = 0) -> DataFrame:
    """`selected` with `position` (0 to 3) of each option; that of slot 0 is the correct answer's."""
    key = Window.partitionBy("collection", "category", "question_no")
    draw = _draw(seed, F.lit("shuffle"), F.col("category"), F.col("question_no"), F.col("item_idx"))
    return selected.withColumn("position", F.row_number().over(key.orderBy(draw, "item_idx")) - 1)


def assemble_questions(options: DataFrame, pool: DataFrame, stems: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions, failures) from shuffled options and stems (collection, category, question_no, question, explanation).

    Failures: option_count, empty_stem, distractor_category, source_page.
    """
    key = ["collection", "category", "question_no"]
    full = options.join(pool.select("item_idx", "item", "section", "page_start", "page_end"), "item_idx")
    option = F.struct("position", text.option_text("item").alias("text"))
    right = lambda c: F.max(F.when(F.col("slot") == 0, F.col(c)))
    rows = full.groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(option)), lambda x: x["text"]).alias("options"),
        right("position").alias("correct_index"),
        right("page_start").alias("source_page"),
        right("section").alias("section"),
        F.array_sort(F.collect_set(F.when(F.col("slot") > 0, F.col("item_category")))).alias("distractor_categories"),
        F.array_distinct(F.flatten(F.collect_list(F.sequence("page_start", "page_end")))).alias("pages"),
    )
    rows = rows.join(stems, key, "left")
    check = (
        F.when(F.size("options") != 4, F.lit("option_count"))
        .when(F.coalesce(F.trim("question"), F.lit("")) == "", F.lit("empty_stem"))
        .when(F.array_contains("distractor_categories", F.col("category")), F.lit("distractor_category"))
        .when(~F.array_contains("pages", F.col("source_page")), F.lit("source_page"))
    )
    checked = rows.withColumn("check", check)
    return checked.filter("check IS NULL").drop("check", "pages"), checked.filter("check IS NOT NULL").select(*key, "check")


def plan_deck(chunks: DataFrame, exclude_sections: Sequence[str] = ()) -> DataFrame:
    """collection, chunk_id, unit_no, n_cards: passages long enough for cards, in page order."""
    long = chunks.filter((F.length("text_raw") >= rules.DECK_MIN_CHARS) & ~F.col("section").isin(list(exclude_sections)))
    # Numbers of cards are taken before the passages are ordered, so texts stay where they are read.
    sized = long.select("collection", "chunk_id", "page_start", "part", "ordinal", vectors.cards_for(F.length("text_raw")).alias("n_cards"))
    order = Window.partitionBy("collection").orderBy("page_start", "part", "ordinal")
    return sized.select("collection", "chunk_id", F.row_number().over(order).alias("unit_no"), "n_cards")


def deck_report(chunks: DataFrame, units: DataFrame, cards: DataFrame, discarded: DataFrame) -> DataFrame:
    """collection, passages, cards, discarded, pages_total, pages_covered; cards and discarded are (collection, chunk_id)."""
    page = lambda df: df.select("collection", F.explode(F.sequence("page_start", "page_end")).alias("page"))
    total = page(chunks).groupBy("collection").agg(F.countDistinct("page").alias("pages_total"))
    covered = page(chunks.join(cards.select("chunk_id").distinct(), "chunk_id", "left_semi")).groupBy("collection").agg(F.countDistinct("page").alias("pages_covered"))
    count = lambda df, name: df.groupBy("collection").agg(F.count("*").alias(name))
    out = count(units, "passages").join(count(cards, "cards"), "collection", "left").join(count(discarded, "discarded"), "collection", "left").join(total, "collection").join(covered, "collection", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("collection", *(zero(c) for c in ("passages", "cards", "discarded", "pages_total", "pages_covered")))


def passage_cards(units: DataFrame, chunks: DataFrame, writer) -> tuple[DataFrame, DataFrame]:
    """(cards, failures) of passages (collection, chunk_id, unit_no, n_cards), written by `writer` and grounded.

    `writer.write(passages)` takes (chunk_id, n_cards, text_raw) and returns (chunk_id,
    card_no, front, back). A card whose back traces too little to its passage fails as
    card_grounding; the others carry source_page, the passage's first page.
    """
    passages = units.join(chunks.select("chunk_id", "section", "text_raw", "page_start", "page_end"), "chunk_id")
    said = writer.write(passages.select("chunk_id", "n_cards", "text_raw"))
    # A passage's words are taken once, not once a card, and the checked cards are written, as two tables come from them.
    worded = passages.withColumn("source_words", text.content_words("text_raw")).drop("text_raw")
    overlap = text.coverage(text.content_words("back"), F.col("source_words"))
    keep = ["collection", "section", "chunk_id", "unit_no", "card_no", "front", "back", "page_start", "page_end"]
    checked = kept(sorted_join(said, worded, ["chunk_id"]).select(*keep, (overlap >= rules.MIN_GROUNDING).alias("grounded")))
    cards = checked.filter("grounded").select(*keep, F.col("page_start").alias("source_page"))
    return cards, checked.filter("NOT grounded").select(*keep, F.lit("card_grounding").alias("check"))


def build_deck(chunks: DataFrame, writer, exclude_sections: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(cards, failures, report, by_section) of every collection: all passages carded, fronts that fold alike kept once a collection.

    Passages come in page order, so the first card of a front is that of the earliest
    passage. Failures are card_grounding and duplicate_front, and both count as
    discarded; a passage with a kept card covers all of its pages.
    """
    # A collection's passages are numbered once, from their places alone.
    units = kept(plan_deck(chunks, exclude_sections))
    cards, ungrounded = passage_cards(units, chunks, writer)
    first = Window.partitionBy("collection", text.fold("front")).orderBy("unit_no", "card_no")
    ranked = kept(cards.withColumn("nth", F.row_number().over(first)))
    good = ranked.filter("nth = 1").drop("nth")
    fails = ungrounded.unionByName(ranked.filter("nth > 1").drop("nth", "source_page").withColumn("check", F.lit("duplicate_front")))
    report = deck_report(chunks, units, good, fails)
    return good, fails, report, by_section(good)


def by_section(cards: DataFrame) -> DataFrame:
    """collection, section, n, place: cards of each section, largest first, then in order of their first passage."""
    counts = cards.groupBy("collection", "section").agg(F.count("*").alias("n"), F.min(F.struct("unit_no", "card_no")).alias("first"))
    order = Window.partitionBy("collection").orderBy(F.desc("n"), "first")
    return counts.select("collection", "section", "n", F.row_number().over(order).alias("place"))
