"""Lines repeated across the pages of one source.

The state is stored: (source, line_key, url_key), one row for each line of a page's url, with per-source line counts and
url counts. A new partition of pages becomes a delta: its triples not yet in the state. The delta's counts are added to the
stored ones, lines that cross the threshold, or fall below it as the source grows, are found, and only pages that hold
such a line are looked at again. A delta takes effect with one ledger row that names all its parts.

Two lines are the same when their letters are, without case and all other characters. Lines of fewer than
``MIN_LETTERS`` letters do not count.

Defined cases: null or empty content has no lines; pages without a source, or with a null url, are left out; a page
delivered twice counts once by its url, but each of its rows gets its lines; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from ..functions.web import source_key
from ..plans.shared import file_system, materialise, shared_path
from ..plans.skew import lookup
from ..plans.stored import MOST_DELTAS, StoredTable
from ..sources.tables import table

MIN_LETTERS = 18
MIN_URLS = 4
MIN_SHARE = 0.2


def letters_key(line: Column) -> Column:
    """A 128-bit key of the line's letters, null when it has fewer than MIN_LETTERS."""
    return let(F.regexp_replace(F.lower(line), r"[^\p{L}]+", ""), lambda letters: F.when(F.char_length(letters) >= MIN_LETTERS, F.unhex(F.md5(letters))))


def page_sources(pages: DataFrame, metadata: DataFrame) -> DataFrame:
    """(fetch_id, source): a page's sources are the domains of its cache_key. A cache_key may be hot, so the small
    side is reduced to distinct pairs first and Spark may split the skewed side."""
    known = metadata.select("cache_key", source_key(F.col("domain")).alias("source")).where("cache_key is not null and source is not null").distinct()
    return pages.join(known, "cache_key")


def page_lines(pages: DataFrame, metadata: DataFrame) -> DataFrame:
    """(fetch_id, line_no, source, url_key, line_key) of every counting line. A page's keys are one array, made before the
    join with its sources, so no text is moved and lines are not shuffled by themselves."""
    numbered = F.transform(F.split("content", "\n", -1), lambda x, i: F.struct((i + 1).alias("line_no"), letters_key(x).alias("line_key")))
    more = [c for c in ("late",) if c in pages.columns]
    packed = pages.where("content is not null and url is not null").select("fetch_id", "cache_key", *more, F.xxhash64("url").alias("url_key"), F.filter(numbered, lambda x: x["line_key"].isNotNull()).alias("lines"))
    return page_sources(packed, metadata).select("fetch_id", "source", "url_key", *more, F.inline("lines"))


@dataclass
class LineState:
    """seen: (source, line_key, url_key); urls: (source, url_key); counts: (source, line_key, n_urls); totals: (source, all_urls)."""

    seen: DataFrame
    urls: DataFrame
    counts: DataFrame
    totals: DataFrame

    def repeated(self) -> DataFrame:
        """(source, line_key, n_urls) of the lines past both thresholds. A source may hold any share of the lines."""
        enough = self.counts.where(F.col("n_urls") >= MIN_URLS)
        sizes = enough.groupBy("source").agg(F.count("*").alias("n"))
        known = materialise(self.totals.join(sizes, "source"), "source-sizes")
        total = known.agg(F.sum("n")).first()[0] or 0
        return lookup(enough, known, "source", total, F.lit(True)).where(F.col("n_urls") >= MIN_SHARE * F.col("all_urls")).select("source", "line_key", "n_urls")


class LineStore:
    """A state kept under ``path`` as parts, of which the last ledger row names the live ones."""

    TABLES = ("seen", "urls", "counts", "totals")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.ledger = spark, path, StoredTable(spark, f"{path}/ledger")

    def parts(self) -> dict[str, list[str]]:
        rows = self.ledger.read()
        return {name: [] for name in self.TABLES} if rows is None else rows.first().asDict()

    def _put(self, df: DataFrame) -> str:
        path = f"{self.path}/part-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def state(self) -> LineState | None:
        parts = self.parts()
        if not parts["seen"]:
            return None
        seen, urls, counts, totals = (self.spark.read.parquet(*parts[name]) for name in self.TABLES)
        if len(parts["counts"]) > 1:
            counts = counts.groupBy("source", "line_key").agg(F.sum("n_urls").alias("n_urls"))
            totals = totals.groupBy("source").agg(F.sum("all_urls").alias("all_urls"))
        return LineState(seen, urls, counts, totals)

    def add(self, lines: DataFrame, urls: DataFrame) -> LineState:
        """Adds a partition's (source, line_key, url_key) and (source, url_key); only unseen ones count. Beyond MOST_DELTAS
        the parts of a table become one."""
        before, parts = self.state(), self.parts()
        fresh, fresh_urls = lines.select("source", "line_key", "url_key").distinct(), urls.select("source", "url_key").distinct()
        if before is not None:
            fresh = fresh.join(before.seen, ["source", "line_key", "url_key"], "left_anti")
            fresh_urls = fresh_urls.join(before.urls, ["source", "url_key"], "left_anti")
        made = {"seen": self._put(fresh), "urls": self._put(fresh_urls)}
        made["counts"] = self._put(self.spark.read.parquet(made["seen"]).groupBy("source", "line_key").agg(F.count("*").alias("n_urls")))
        made["totals"] = self._put(self.spark.read.parquet(made["urls"]).groupBy("source").agg(F.count("*").alias("all_urls")))
        self._commit({name: [*parts[name], made[name]] for name in self.TABLES})
        if len(parts["seen"]) >= MOST_DELTAS:
            old, whole = self.parts(), self.state()
            self._commit({name: [self._put(getattr(whole, name))] for name in self.TABLES})
            for path in (p for names in old.values() for p in names):
                files, at = file_system(self.spark, path)
                files.delete(at, True)
        return self.state()

    def _commit(self, parts: dict[str, list[str]]) -> None:
        self.ledger.replace(self.spark.createDataFrame([tuple(parts[name] for name in self.TABLES)], ", ".join(f"{name} array<string>" for name in self.TABLES)))


def changed(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The (source, line_key) repeated after a delta but not before it, and the other way round."""
    at = ["source", "line_key"]
    return after.join(before.select(*at), at, "left_anti"), before.join(after.select(*at), at, "left_anti")


def found_lines(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """(fetch_id, line_no, source, line_key) of the lines that are among ``repeated``. One line may hold any share."""
    return lookup(lines.select("fetch_id", F.col("line_no").cast("int").alias("line_no"), "source", "line_key"), repeated.withColumnRenamed("n_urls", "n"), ["source", "line_key"], lines.count(), F.lit(True))


def repeated_lines(deliveries: list[tuple[DataFrame, DataFrame]], store: LineStore) -> DataFrame:
    """(fetch_id, line_no) of the repeated lines of all deliveries, each (lines, urls), by adding one after the other. What an
    earlier delivery had stays found unless its line lapsed; its pages are looked at again for newly crossed lines only."""
    found, known, earlier = None, None, []
    for lines, urls in deliveries:
        repeated = materialise(store.add(lines, urls).repeated(), "repeated")
        more = [found_lines(lines, repeated)]
        if known is not None:
            crossed, lapsed = changed(known, repeated)
            crossed = materialise(crossed, "crossed")
            more += [found.join(lapsed.select("source", "line_key"), ["source", "line_key"], "left_anti"), *(found_lines(x, crossed) for x in earlier)]
        found = materialise(reduce(lambda a, b: a.unionByName(b), more), "found-lines")
        known, earlier = repeated, [*earlier, lines]
    return found.select("fetch_id", "line_no").distinct()


def strip_lines(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(fetch_id, content) of the pages that hold found lines, without those lines; other pages stay as they are and
    are not in the result."""
    drop = found.groupBy("fetch_id").agg(F.collect_set("line_no").alias("drop_lines"))
    kept = F.filter(F.transform(F.split("content", "\n", -1), lambda x, i: F.when(~F.array_contains("drop_lines", (i + 1).cast("int")), x)), lambda x: x.isNotNull())
    return pages.select("fetch_id", "content").join(drop, "fetch_id").select("fetch_id", F.array_join(kept, "\n").alias("content"))


def _deliveries(spark: SparkSession, folder: str) -> list[tuple[DataFrame, DataFrame]]:
    """The pages as two deliveries, those that came before the middle of the time and those after it."""
    pages, metadata = table(spark, folder, "fetch_cache"), table(spark, folder, "web_metadata")
    middle = pages.agg(F.percentile_approx("created_at", 0.5)).first()[0] or 0
    late = F.coalesce(F.col("created_at") > middle, F.lit(False))
    lines = materialise(page_lines(pages.select("fetch_id", "cache_key", "url", "content", late.alias("late")), metadata), "lines")
    urls = page_sources(pages.where("url is not null").select("cache_key", F.xxhash64("url").alias("url_key"), late.alias("late")), metadata)
    return [(lines.where(F.col("late") == when), urls.where(F.col("late") == when)) for when in (False, True)]


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_lines(_deliveries(spark, folder), LineStore(spark, shared_path(spark, "site-lines")))


def p7_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Each page that holds repeated lines, without them."""
    return strip_lines(table(spark, folder, "fetch_cache"), p7_found(spark, folder))


P7_SQL = r"""
with src as (
  select distinct cache_key, regexp_replace(regexp_replace(lower(trim(domain)), ':\d*$', ''), '^www\.', '') as source
  from web_metadata where cache_key is not null and domain is not null),
pages as (select f.fetch_id, f.url, f.content, s.source from fetch_cache f join src s using (cache_key) where f.url is not null and s.source <> ''),
lines as (
  select fetch_id, url, source, unnest(string_split(content, chr(10))) as line,
         generate_subscripts(string_split(content, chr(10)), 1) as line_no
  from pages where content is not null),
keyed as (select fetch_id, url, source, line_no, regexp_replace(lower(line), '[^\p{L}]+', '', 'g') as line_key from lines),
long as (select * from keyed where length(line_key) >= 18),
totals as (select source, count(distinct url) as all_urls from pages group by source),
hits as (
  select source, line_key from long join totals using (source)
  group by source, line_key, all_urls having count(distinct url) >= 4 and count(distinct url) >= 0.2 * all_urls)
select distinct l.fetch_id, cast(l.line_no as int) as line_no from long l join hits using (source, line_key)
"""
