"""Sections of line streams and size-bounded chunks of sections."""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules, text
from ..scratch import kept, numbered, sorted_join


def _heading_keys(lines: DataFrame, titles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, titles), each a row a key; a line and a title that match have a key in common.

    Of a match the shorter text begins the longer one, or the title's first three words
    do. If the shorter has more than two words, both have its first two; if it has two,
    the longer has its first and the next letter; if it has one, that begins the longer's
    first word. Keys of two and one words tell which side is the shorter, so that long
    lines and long titles do not meet by a first word alone. For joins of few lines: a
    line moves once a key. `locate_headings` goes without them.
    """
    pieces = lambda c: F.split(c, " ")
    # Bounded by the longest word: the lengths of texts of one word.
    single = lambda df, c: df.filter(F.size(pieces(c)) == 1).agg(F.collect_set(F.length(c))).first()[0]

    def keys(c: str, own: str, other: str, lengths: list[int]) -> Column:
        n, first, letter = F.size(pieces(c)), pieces(c)[0], F.left(F.get(pieces(c), F.lit(1)), F.lit(1))
        key = lambda kind, *value: F.xxhash64(F.lit(kind), *value)
        begins = F.transform(F.filter(F.array(*[F.lit(x) for x in sorted(lengths)]).cast("array<int>"), lambda x: x <= F.length(first)), lambda x: key(other + "1", F.left(first, x)))
        found = F.array(
            F.when(n > 2, key("3", first, F.get(pieces(c), F.lit(1)))),
            F.when(n == 2, key(own + "2", first, letter)),
            F.when(n > 1, key(other + "2", first, letter)),
            F.when(n == 1, key(own + "1", F.col(c))),
        )
        return F.concat(F.filter(found, lambda k: k.isNotNull()), begins)

    # A hash that two keys share costs a comparison of the whole texts, which all pairs pass.
    by_line = lines.select("*", F.explode(keys("line_key", "line", "title", single(titles, "title_key"))).alias("key"))
    return by_line, titles.select("*", F.explode(keys("title_key", "title", "line", single(lines, "line_key"))).alias("key"))


class _Places:
    """Places of a document's lines under what its titles can ask for; lines come in order and are not held."""

    def __init__(self, titles: set[str]) -> None:
        self.titles = sorted(titles)
        self.probes = {t: " ".join(words[:3]) for t in titles if len(words := t.split(" ")) >= 3}
        self.begun, self.whole, self.pages = {t: array("q") for t in titles}, defaultdict(lambda: array("q")), {}
        self.near: dict[str, dict[int, array]] = {p: defaultdict(lambda: array("q")) for p in self.probes.values()}
        self.title_sizes, self.probe_sizes = sorted(set(map(len, titles))), sorted(set(map(len, self.near)))

    def add(self, line: str, size: int, pos: int, page) -> None:
        """A line's beginning, as long as the longest title at most, and the whole line's length."""
        used = False
        if size == len(line) and (at := bisect_left(self.titles, line)) < len(self.titles) and self.titles[at].startswith(line):
            self.whole[line].append(pos)
            used = True
        for n in self.title_sizes:
            if n > len(line):
                break
            if (places := self.begun.get(line[:n])) is not None:
                places.append(pos)
                used = True
        for n in self.probe_sizes:
            if n > len(line):
                break
            if (by_size := self.near.get(line[:n])) is not None:
                by_size[size].append(pos)
                used = True
        if used:
            self.pages[pos] = page

    def after(self, title: str, cursor: int) -> int | None:
        """The first place after `cursor` of a line that `text.heading_matches` the title."""
        lists = [self.begun[title], *(self.whole[title[:n]] for n in range(1, len(title) + 1) if title[:n] in self.whole)]
        if by_size := self.near.get(self.probes.get(title)):
            lists += [by_size[n] for n in range(len(title) - 12, len(title) + 13) if n in by_size]
        return min((places[at] for places in lists if (at := bisect_right(places, cursor)) < len(places)), default=None)


def _headings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries with the place and page that they take; of each document its entries come in order, then its lines in order."""
    doc, entries, places, schema = None, [], None, None

    def taken() -> Iterator[pa.RecordBatch]:
        cursor, out = -1, []
        for ord_, key, title, printed in entries:
            pos = places.after(key, cursor) if places and key else None
            cursor = cursor if pos is None else pos
            out.append((doc, ord_, title, printed, pos, places.pages[pos] if pos is not None else None))
        for a in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[a : a + 10_000], strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        kinds = [batch.schema.field(c).type for c in ("doc_id", "at", "title", "printed", "at", "page")]
        schema = pa.schema(list(zip(("doc_id", "ord", "title", "printed", "pos", "page"), kinds, strict=True)))
        for doc_id, is_line, at, key, size, page, title, printed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if doc_id != doc:
                yield from taken()
                doc, entries, places = doc_id, [], None
            if not is_line:
                entries.append((at, key, title, printed))
            elif entries and key:
                if places is None:
                    places = _Places({e[1] for e in entries if e[1]})
                places.add(key, size, at, page)
    yield from taken()


def locate_headings(stream: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(located: doc_id, ord, title, printed, pos, page; unlocated: doc_id, ord, title, printed).

    Each entry takes its first matching line after the line of the entry found before
    it; an entry without one leaves that place as it was. Of a line no more than the
    beginning that a title can have moves, once, to its document's entries; a task holds
    one document's titles and the places of the lines that match one.
    """
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    keyed = kept(entries.select("doc_id", "ord", "title", "printed", text.heading_key("title").alias("key")))
    longest = keyed.agg(F.max(F.length("key"))).first()[0] or 0
    none = lambda df, c: F.lit(None).cast(kind(df, c)).alias(c)
    asked = keyed.select("doc_id", F.lit(False).alias("is_line"), F.col("ord").cast("long").alias("at"), "key", F.lit(0).alias("size"), none(stream, "page"), "title", "printed")
    lines = stream.filter("doc_id IS NOT NULL").select("doc_id", F.col("pos").cast("long").alias("at"), "page", text.fold("line", True).alias("key"))
    lines = lines.select("doc_id", F.lit(True).alias("is_line"), "at", F.left("key", F.lit(longest)).alias("key"), F.length("key").alias("size"), "page", none(entries, "title"), none(entries, "printed"))
    met = asked.unionByName(lines).repartition("doc_id").sortWithinPartitions("doc_id", "is_line", "at")
    found = kept(met.mapInArrow(_headings, f"doc_id {kind(met, 'doc_id')}, ord long, title string, printed {kind(entries, 'printed')}, pos long, page {kind(stream, 'page')}").withColumn("ord", F.col("ord").cast(kind(entries, "ord"))))
    return found.filter("pos IS NOT NULL"), found.filter("pos IS NULL").select("doc_id", "ord", "title", "printed")


def section_lines(stream: DataFrame, located: DataFrame) -> DataFrame:
    """Lines with their section (ord, title, start_page); those before the first heading are left out."""
    marked = sorted_join(stream, located.select("doc_id", "pos", "ord", "title", F.col("page").alias("start_page")), ["doc_id", "pos"], "left")
    so_far = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    fill = lambda c: F.last(c, ignorenulls=True).over(so_far).alias(c)
    return marked.select("doc_id", "pos", "page", "line", fill("ord"), fill("title"), fill("start_page")).filter("ord IS NOT NULL")


def _greedy_parts(limit: int, starts_only: bool = False):
    """Rows, without their size, with the part numbers of lines in order of (section, pos), or of the first line of each part.

    A task goes from break to break by a search among the sums of sizes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        section, held, part = None, 0, 0
        for batch in batches:
            names = batch.column("section").to_numpy(zero_copy_only=False)
            sizes = batch.column("size").to_numpy().astype(np.int64) + 1
            parts, opens = np.empty(len(names), np.int32), np.zeros(len(names), bool)
            starts = np.concatenate(([0], np.flatnonzero(names[1:] != names[:-1]) + 1, [len(names)])) if len(names) else [0]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if names[a] != section:
                    section, held, part = names[a], 0, 0
                sums = np.cumsum(sizes[a:b])
                # `before`: the sum at which the open part began; negative where it began in an earlier batch.
                at, before = 0, -held
                while at < b - a:
                    stop = int(np.searchsorted(sums, limit + 1 + before, side="right"))
                    if (sums[at - 1] if at else 0) == before:
                        stop = max(stop, at + 1)  # a part has a line, however long
                        opens[a + at] = True
                    stop = min(stop, b - a)
                    parts[a + at : a + stop] = part
                    at = stop
                    if at < b - a:
                        part, before = part + 1, int(sums[at - 1]) if at else 0
                held = int(sums[-1]) - before
            out = batch.drop_columns("size").append_column("part", pa.array(parts))
            yield out.filter(pa.array(opens)) if starts_only else out

    return run


def split_sections(lines: DataFrame, keys: list[str], limit: int = rules.CHUNK_CHARS) -> DataFrame:
    """keys, pos, page, line, part, n_parts of section lines (keys, pos, page, line).

    A line opens a new part if the part has lines and the line would pass the limit; each
    line counts one more for its line feed. Breaks follow one from another, so a section's
    line sizes, no texts, go through one task in order, in constant memory; texts meet
    their part by their place.
    """
    section = F.sha2(F.to_json(F.struct(*keys)).cast("binary"), 256)
    named = lines.select(*keys, F.col("pos").cast("long").alias("pos"), "page", "line", section.alias("section"))
    sizes = named.select("section", "pos", F.coalesce(F.length("line"), F.lit(0)).alias("size")).repartition("section").sortWithinPartitions("section", "pos")
    parts = kept(sizes.mapInArrow(_greedy_parts(limit), "section string, pos long, part int"))
    counts = parts.groupBy("section").agg((F.max("part") + 1).alias("n_parts"))
    return sorted_join(sorted_join(named, parts, ["section", "pos"]), counts, ["section"]).select(*keys, "pos", "page", "line", "part", "n_parts")


def part_starts(stream: DataFrame, located: DataFrame, limit: int = rules.CHUNK_CHARS) -> DataFrame:
    """doc_id, ord, pos, part: the first line of each part of the located sections.

    As in `split_sections`, but of a line its place and size alone move, once.
    """
    ord_ = located.schema["ord"].dataType.simpleString()
    lines = stream.filter("doc_id IS NOT NULL").select("doc_id", F.col("pos").cast("long").alias("pos"), F.lit(None).cast(ord_).alias("ord"), F.coalesce(F.length("line"), F.lit(0)).alias("size"))
    heads = located.select("doc_id", F.col("pos").cast("long").alias("pos"), "ord", F.lit(None).cast("int").alias("size"))
    so_far = Window.partitionBy("doc_id").orderBy("pos", F.col("ord").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    filled = lines.unionByName(heads).withColumn("ord", F.last("ord", ignorenulls=True).over(so_far)).filter("size IS NOT NULL AND ord IS NOT NULL")
    sizes = filled.select("doc_id", "ord", F.concat_ws(" ", F.col("ord").cast("string"), F.col("doc_id").cast("string")).alias("section"), "pos", "size").sortWithinPartitions("doc_id", "pos")
    kind = sizes.schema["doc_id"].dataType.simpleString()
    return sizes.mapInArrow(_greedy_parts(limit, True), f"doc_id {kind}, ord {ord_}, section string, pos long, part int").drop("section")


def build_chunks(stream: DataFrame, located: DataFrame, groups: DataFrame, limit: int = rules.CHUNK_CHARS, collection: Column | None = None) -> DataFrame:
    """The chunk table: sections cut into parts, with collection, category, group, polarity, page span, ids and texts.

    `groups` (title_folded, group_id, polarity) is a small rule table. Later parts begin
    with the section's title. `ordinal` is the order of the chunks in the corpus. Parts
    are found, numbered and named without texts; lines then meet the parts of their
    document by one shuffle and are joined up where they are.
    """
    numbers = numbered(part_starts(stream, located, limit), "ordinal", "doc_id", "ord", "part")
    counted = numbers.withColumn("n_parts", F.max("part").over(Window.partitionBy("doc_id", "ord")) + 1)
    titled = sorted_join(counted, located.select("doc_id", "ord", "title", F.col("page").alias("start_page")), ["doc_id", "ord"])
    table = F.broadcast(groups) if groups.count() <= 100_000 else groups
    parts = titled.withColumn("title_folded", text.fold("title")).join(table, "title_folded", "left")
    part = F.struct("ordinal", "part", "n_parts", "title", "start_page", "group_id", "polarity").alias("chunk")
    starts = parts.select("doc_id", "pos", part)
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    lines = stream.filter("doc_id IS NOT NULL").select("doc_id", F.col("pos").cast("long").alias("pos"), F.lit(True).alias("is_line"), "page", "line", none(starts, "chunk"))
    marks = starts.select("doc_id", "pos", F.lit(False).alias("is_line"), none(stream, "page"), none(stream, "line"), "chunk")
    so_far = Window.partitionBy("doc_id").orderBy("pos", "is_line").rowsBetween(Window.unboundedPreceding, 0)
    filled = lines.unionByName(marks).withColumn("chunk", F.last("chunk", ignorenulls=True).over(so_far)).filter("is_line AND chunk IS NOT NULL")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    joined = filled.groupBy("doc_id", "chunk").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"), body.alias("body")).select("doc_id", "chunk.*", "page_start", "page_end", "body")
    named = joined.withColumn("text_raw", F.when(F.col("part") == 0, F.col("body")).otherwise(F.concat_ws("\n", "title", "body")))
    return named.select(
        text.chunk_id("start_page", "title", "part", "n_parts").alias("chunk_id"),
        "doc_id",
        (collection if collection is not None else text.assign_collection("start_page")).alias("collection"),
        F.col("title").alias("section"),
        text.classify_category("title").alias("category"),
        "group_id",
        "polarity",
        F.col("page_start").cast("int").alias("page_start"),
        F.col("page_end").cast("int").alias("page_end"),
        "part",
        "n_parts",
        "text_raw",
        text.fold("text_raw").alias("text_folded"),
        "ordinal",
    )


def group_table(spark, groups: Mapping[str, tuple[str, str]] = rules.GROUPS) -> DataFrame:
    return spark.createDataFrame([(title, *pair) for title, pair in groups.items()], "title_folded string, group_id string, polarity string")


def missing_group_members(chunks: DataFrame, groups: DataFrame) -> DataFrame:
    """title_folded, group_id, polarity of declared members that no chunk carries."""
    seen = chunks.filter("group_id IS NOT NULL").select("group_id", "polarity", text.fold("section").alias("title_folded"))
    return groups.join(seen, ["title_folded", "group_id", "polarity"], "left_anti")


def corpus_profile(chunks: DataFrame) -> DataFrame:
    """collection, category, n: chunks of each collection and of each category; the other column is null."""
    return chunks.groupingSets([["collection"], ["category"]], "collection", "category").agg(F.count("*").alias("n")).select("collection", "category", "n")


def group_summary(chunks: DataFrame) -> DataFrame:
    """group_id, n, first_page, last_page, affirmative, negative of the groups of (group_id, polarity, page_start, page_end)."""
    rows = chunks.filter("group_id IS NOT NULL").groupBy("group_id")
    return rows.agg(F.count("*").alias("n"), F.min("page_start").alias("first_page"), F.max("page_end").alias("last_page"), F.count_if(F.col("polarity") == "affirmative").alias("affirmative"), F.count_if(F.col("polarity") == "negative").alias("negative"))


def section_pages(chunks: DataFrame) -> DataFrame:
    """collection, section, ordinal, page: the first chunk of each section and its page."""
    return chunks.groupBy("collection", "section").agg(F.min("ordinal").alias("ordinal"), F.min_by("page_start", "ordinal").alias("page"))
