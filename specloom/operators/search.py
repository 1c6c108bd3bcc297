"""Case-insensitive substring search by an index of n-grams, for queries of any length.

Every text is listed under its distinct runs of one, two and three characters. A query of three characters or more
looks at its runs of three, a shorter one at itself: the rarest of them, by stored counts, gives the candidates,
whose texts are then compared. Postings and counts are tables in buckets by run, so a search opens the files of its
runs only, and a change of some texts the files of theirs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held
from .keyed import KeyedTables, Layout
from .lifecycle import add_counts

LONGEST = 3


def layouts(name: str, key: str, buckets: int = 64) -> dict[str, Layout]:
    """Layouts of an index's three tables: texts by key, postings and counts by run. A run that most texts have is spread over an eighth of the buckets."""
    postings = Layout(("gram", key), buckets, ("gram",), max(1, buckets // 8))
    return {f"{name}_texts": Layout((key,), buckets), f"{name}_postings": postings, f"{name}_counts": Layout(("gram",), buckets)}


def grams(text: Column, n: int) -> Column:
    """The distinct runs of n characters."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))


class TextIndex:
    def __init__(self, tables: KeyedTables, name: str, key: str):
        self.tables, self.key = tables, key
        self.texts, self.postings, self.counts = (f"{name}_{t}" for t in ("texts", "postings", "counts"))

    def build(self, rows: DataFrame, text: str) -> None:
        """Index rows (one for each key); a null text is found by no query."""
        own = rows.select(self.key, F.lower(text).alias("text")).where("text is not null")
        self.tables.create(self.texts, own)
        size = own.agg(F.sum(F.length("text").cast("bigint"))).first()
        self.tables.create(self.postings, self._listed(own), LONGEST * (size[0] or 0))  # no more runs than characters, of each length
        self.tables.create(self.counts, held(self.tables.read(self.postings).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))))

    def _listed(self, texts: DataFrame) -> DataFrame:
        every = F.concat(*(grams(F.col("text"), n) for n in range(1, LONGEST + 1)))
        return texts.select(F.explode(every).alias("gram"), self.key)

    def put(self, rows: DataFrame, text: str) -> None:
        """Index new and changed rows, one for each key; a null text takes its row out. All three tables change in one commit."""
        changed = held(rows.select(self.key, F.lower(text).alias("text")))
        before = self._listed(self.tables.lookup(self.texts, changed.select(self.key)))
        after = self._listed(changed.where("text is not null"))
        both = ["gram", self.key]
        moved = held(after.join(before, both, "left_anti").withColumn("n", F.lit(1).cast("bigint")).unionByName(before.join(after, both, "left_anti").withColumn("n", F.lit(-1).cast("bigint"))))
        replaced = lambda old, new, keys: old.join(new, keys, "left_anti").unionByName(new.where("text is not null"))
        relisted = lambda old, new, keys: old.join(new.where("n < 0"), keys, "left_anti").unionByName(new.where("n > 0").select(*keys))
        self.tables.commit(
            self.tables.stage(self.texts, changed, replaced),
            self.tables.stage(self.postings, moved, relisted),
            self.tables.stage(self.counts, moved.groupBy("gram").agg(F.sum("n").alias("n")), add_counts),
        )

    def search(self, queries: DataFrame) -> DataFrame:
        """q and key: every text that contains a query (column q); the empty query is contained in all."""
        asked = queries.select("q").where("q is not null").distinct().withColumn("_q", F.lower("q"))
        runs = F.when(F.length("_q") >= LONGEST, grams(F.col("_q"), LONGEST)).otherwise(F.array("_q"))
        wanted = asked.where("_q <> ''").select("q", "_q", F.explode(runs).alias("gram"))
        known = self.tables.lookup(self.counts, wanted.select("gram"))
        counted = wanted.join(known, "gram", "left")
        rarest = counted.groupBy("q", "_q").agg(F.min_by("gram", F.coalesce("n", F.lit(0))).alias("gram"), F.min(F.coalesce("n", F.lit(0))).alias("n")).where("n > 0")
        listed = self.tables.lookup(self.postings, rarest.select("gram")).join(rarest, "gram").select("q", "_q", self.key)
        found = listed.join(self.tables.read(self.texts), self.key).where(F.contains("text", "_q")).select("q", self.key)
        every = asked.where("_q = ''").select("q").join(self.tables.read(self.texts).select(self.key))  # at most one empty query
        return found.unionByName(every)
